"""Named queries: operators applied to the derived trial and draw tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, diagnostics, draws, effects, exclude, fitting, frame, joins, models, regression, sdt, summarise
from ..operators.reshape import lengthen, widen
from ..schema import CELL, CONDITION, DIRECTIONS, EXPERIMENTS, FIT, LEVEL_LABELS, MODEL_BF, MODELS, PAIR, PARTICIPANT
from ..session import materialize, scratch_path
from ..sources.results import compute_missing, read_predictive, read_rhat, write_keyed
from ..sources.trials import CSV, read_filtered, read_trials, write_by_experiment
from . import fixtures as fx

QUERIES = {}
SD_THRESHOLD = 2.0  # at the default of 4 the test tables leave the last two stages empty
BY_DIRECTION = [*PARTICIPANT, "bias_direction"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits=6) -> DataFrame:
    """Floating columns rounded, so that the order of summation does not show."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, digits) + 0.0 for name in doubles})


def _means(df):
    return rounded(df, 9)


# Participants and exclusion


@query
def participant_counts(spark, sf):
    return exclude.participant_counts(fx.trials(spark, sf))


@query
def trial_counts(spark, sf):
    return exclude.trial_counts(fx.trials(spark, sf))


@query
def start_direction_balance(spark, sf):
    return exclude.start_balance(fx.trials(spark, sf))


def _log(spark, sf):
    return exclude.exclusion_log(fx.trials(spark, sf), SD_THRESHOLD)


def _stage(spark, sf, stage):
    return rounded(_log(spark, sf).where(F.col("stage") == stage).drop("stage"))


@query
def staircase_outliers(spark, sf):
    statistics = exclude.trial_statistics(fx.trials(spark, sf))
    return rounded(exclude.zscore_outliers(exclude.staircase_values(statistics), ["experiment"], sd_threshold=SD_THRESHOLD))


@query
def low_dprime(spark, sf):
    return _stage(spark, sf, "low_dprime").select(*BY_DIRECTION, F.col("value").alias("d"))


@query
def dprime_outliers(spark, sf):
    return _stage(spark, sf, "dprime")


@query
def reproduction_outliers(spark, sf):
    return _stage(spark, sf, "reproduction")


@query
def reproduction_error(spark, sf):
    return _means(exclude.reproduction_error(fx.trials(spark, sf)))


@query
def exclusion_summary(spark, sf):
    return exclude.exclusion_summary(_log(spark, sf))


@query
def excluded_trials(spark, sf):
    """Trials left after all exclusion stages."""
    kept, _ = exclude.exclude(fx.trials(spark, sf), SD_THRESHOLD)
    return _means(kept.withColumn("answer_num", F.col("answer").try_cast("double")).drop("answer"))


# Signal detection


@query
def confusion_counts(spark, sf):
    return sdt.confusion_counts(fx.trials(spark, sf))


@query
def confusion_keys(spark, sf):
    answers = frame.by_task(fx.trials(spark, sf), "detection")
    key = frame.confusion_key(frame.accuracy("contrast_level", "answer"), "answer")
    return answers.groupBy("experiment", "bias_source", key.alias("conf_mat")).agg(F.count(F.lit(1)).alias("n"))


@query
def sdt_measures(spark, sf):
    return rounded(sdt.sdt(fx.trials(spark, sf)))


# Cell and condition summaries


@query
def proportion_present(spark, sf):
    return _means(summarise.proportion_present(fx.trials(spark, sf)))


@query
def mean_reproduction(spark, sf):
    return _means(summarise.mean_reproduction(fx.trials(spark, sf)))


@query
def proportion_zero(spark, sf):
    return _means(summarise.proportion_zero(fx.trials(spark, sf)))


@query
def proportion_zero_ceiling(spark, sf):
    return _means(summarise.proportion_zero(fx.trials(spark, sf), mode="ceiling"))


@query
def median_nonzero(spark, sf):
    return _means(summarise.median_nonzero(fx.trials(spark, sf)))


@query
def mean_nonzero(spark, sf):
    return _means(summarise.mean_nonzero(fx.trials(spark, sf)))


BY_CONDITION = ["experiment", "bias_source", "bias_direction", "contrast_level"]


@query
def summary_mean_se(spark, sf):
    return rounded(summarise.mean_se(summarise.median_nonzero(fx.trials(spark, sf)), BY_CONDITION, "value"), 12)


@query
def summary_mean_ci(spark, sf):
    return rounded(summarise.mean_ci(summarise.mean_reproduction(fx.trials(spark, sf)), BY_CONDITION, "reproduction"))


@query
def empty_cells(spark, sf):
    return summarise.empty_cells(fx.trials(spark, sf))


@query
def empty_cell_counts(spark, sf):
    return summarise.empty_cell_counts(summarise.empty_cells(fx.trials(spark, sf)))


def _complete(spark, sf):
    medians = materialize(summarise.median_nonzero(fx.trials(spark, sf)))
    return joins.exclude_keys(medians, summarise.incomplete_pairs(medians), PAIR)


@query
def nonzero_complete_pairs(spark, sf):
    return _means(_complete(spark, sf))


@query
def nonzero_wide(spark, sf):
    return _means(widen(_complete(spark, sf), PAIR, "bias_direction", "value", DIRECTIONS))


FACETS = ["experiment", "bias_source", "contrast_level", "bias_direction"]


@query
def reproduction_histogram(spark, sf):
    return _means(summarise.histogram(summarise.reproductions(fx.trials(spark, sf)), FACETS))


@query
def reproduction_histogram_limits(spark, sf):
    return _means(summarise.histogram(summarise.reproductions(fx.trials(spark, sf)), FACETS, limits=(0.0, 0.14)))


@query
def axis_grid(spark, sf):
    return _means(summarise.axis_grid(summarise.mean_reproduction(fx.trials(spark, sf)), ["experiment"], "reproduction", 0.025))


@query
def source_labels(spark, sf):
    return summarise.source_labels(fx.trials(spark, sf))


@query
def condition_labels(spark, sf):
    coded = frame.condition_codes(fx.trials(spark, sf), sep="_")
    names = summarise.recode("contrast_level", LEVEL_LABELS)
    keys = ["condition_code", "condition_code_ord", "stim_code", "stim_code_ord", "bias_source", "bias_source_ord",
            "contrast_level", "contrast_level_ord", "level_label"]
    return coded.withColumn("level_label", names).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# Paired comparisons


def _present(spark, sf):
    return summarise.proportion_present(fx.trials(spark, sf)).withColumnRenamed("proportion_present", "value")


@query
def paired_effect_size(spark, sf):
    return rounded(compare.paired_effects(_present(spark, sf)))


@query
def paired_bayes_factor(spark, sf):
    """Does the bias raise `present` answers?"""
    return rounded(compare.paired_bf(_present(spark, sf)).select(*CONDITION, "n_pairs", "n_dropped", "t", "d", "log_bf"))


@query
def paired_bayes_factor_zero(spark, sf):
    """Does the bias lower the share of zero reproductions?"""
    zero = summarise.proportion_zero(fx.trials(spark, sf)).withColumnRenamed("prop_zero", "value")
    return rounded(compare.paired_bf(zero, conditions=("present", "control")).select(*CONDITION, "n_pairs", "t", "d", "log_bf"))


@query
def bf_labels(spark, sf):
    scored = compare.paired_bf(summarise.mean_reproduction(fx.trials(spark, sf)).withColumnRenamed("reproduction", "value"))
    return compare.bf_labels(scored).select(*CONDITION, "bf_lab", "d_lab", "label")


def _whole_medians(spark, sf):
    """Medians as whole numbers, so that two engines see the same ties."""
    return _means(summarise.median_nonzero(fx.trials(spark, sf))).withColumn("value", F.col("value") * 1e9)


@query
def signed_rank(spark, sf):
    """Exact one-sided p values up to 50 pairs, those of z beyond; pairs with one side only are counted."""
    return rounded(compare.signed_rank(_whole_medians(spark, sf)))


@query
def signed_rank_flat(spark, sf):
    """One group has no effect at all."""
    flat = (F.col("bias_source") == "cue") & (F.col("contrast_level") == "absent")
    return rounded(compare.signed_rank(_whole_medians(spark, sf).withColumn("value", F.when(flat, 0.0).otherwise(F.col("value")))))


@query
def observed_cells(spark, sf):
    return _means(summarise.observed_cells(frame.model_frame(fx.trials(spark, sf))))


@query
def observed_effect(spark, sf):
    cells = summarise.observed_cells(frame.model_frame(fx.trials(spark, sf)))
    unit = [*PARTICIPANT, "contrast_level", "stim"]
    return rounded(effects.effect_table(cells, "response", unit, CONDITION))


# Designs, keys, sources


@query
def design_rows(spark, sf):
    return _means(fx.design(spark, sf))


@query
def key_grid(spark, sf):
    """Every fit to be made: the designs that have trials, with each model."""
    designs = fx.trials(spark, sf).select("experiment", F.col("bias_source").alias("condition")).distinct()
    return joins.key_grid(designs, model_name=MODELS)


@query
def missing_keys(spark, sf):
    """Fits without draws."""
    done = fx.draws_long(spark, sf).select("experiment", "condition", "model_name")
    return joins.missing_keys(key_grid(spark, sf), done, ["experiment", "condition", "model_name"])


@query
def write_read_filtered(spark, sf):
    """Trials with a column of their own, written as one CSV folder per experiment and read back as a whole."""
    path = scratch_path(spark, "filtered")
    write_by_experiment(_with_response_time(spark, sf), path, fmt="csv")
    return _answers(read_filtered(spark, path, fmt="csv"))


def _with_response_time(spark, sf):
    return fx.trials(spark, sf).withColumn("rt", F.concat((F.col("trial_index") % 977).cast("string"), F.lit(" ms")))


def _answers(trials):
    return _means(trials.withColumn("answer_num", F.col("answer").try_cast("double")).drop("answer"))


@query
def read_raw_trials(spark, sf):
    """Raw files per experiment with their columns in another order and the trial order under another name."""
    path = scratch_path(spark, "raw")
    raw = _with_response_time(spark, sf).withColumnRenamed("trial_index", "nr")
    write_by_experiment(raw.select("answer", "nr", *[c for c in raw.columns if c not in ("answer", "nr")]), path, fmt="csv")
    return _answers(read_trials(spark, {e: f"{path}/experiment={e}" for e in EXPERIMENTS}, index="nr").drop("nr"))


@query
def read_mixed_headers(spark, sf):
    """Stored CSV folders of three experiments with columns in three orders, one of them with a column of its own."""
    path, trials = scratch_path(spark, "mixed"), _with_response_time(spark, sf)
    for k, name in enumerate(EXPERIMENTS):
        own = trials.where(F.col("experiment") == name).drop("experiment")
        order = own.columns[k:] + own.columns[:k]
        own.select(*[c for c in order if c != "rt" or k == 1]).write.options(**CSV).csv(f"{path}/experiment={name}")
    return _answers(read_filtered(spark, path, fmt="csv"))


@query
def read_filtered_one(spark, sf):
    """One experiment of the stored trials; only its folder is read."""
    path = scratch_path(spark, "filtered")
    write_by_experiment(fx.trials(spark, sf), path)
    return _answers(read_filtered(spark, path, "exp2"))


@query
def keyed_round_trip(spark, sf):
    """Evidence computed for the fits that have none yet, in two goes, stored per key and read back."""
    path, keys = scratch_path(spark, "evidence"), ["experiment", "condition"]
    table = materialize(models.model_bf(fx.log_evidence(spark, sf)))
    todo = table.select(*keys).distinct()

    def compute(wanted):
        return wanted.join(table, keys)

    compute_missing(todo.where("experiment = 'exp1'"), path, keys, MODEL_BF, compute)
    compute_missing(todo, path, keys, MODEL_BF, compute)
    return rounded(spark.read.schema(MODEL_BF).parquet(path), 3)


@query
def rhat_file_round_trip(spark, sf):
    """R-hat tables written as quoted CSV files and read back by pattern; NULL is `NA` in the files."""
    path = scratch_path(spark, "rhat")
    found = rounded(diagnostics.rhat(fx.draws_long(spark, sf), rank=False)).select("parameter", "rhat", *diagnostics.FIT_KEYS)
    found.write.options(**CSV, quoteAll=True).csv(path)
    return rounded(read_rhat(spark, path, "part-*.csv"))


@query
def predictive_round_trip(spark, sf):
    """The predictive check stored per experiment and model and read back."""
    path = scratch_path(spark, "predictive")
    write_keyed(predictive_check(spark, sf), path, ["experiment", "model_name"])
    return read_predictive(spark, path)


# Hurdle models and draws


@query
def hurdle_loglik(spark, sf):
    return rounded(draws.hurdle_loglik(fx.scored_trials(spark, sf), [*PARTICIPANT, "model_name"]))


def _scored(spark, sf):
    return draws.score_draws(fx.design(spark, sf), fx.draws_fixed(spark, sf), fx.draws_random(spark, sf))


@query
def score_draws(spark, sf):
    """Scored rows summarised per cell."""
    return rounded(
        _scored(spark, sf)
        .groupBy(*draws.MODEL_CELL)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("mu").alias("mu"),
            F.avg("hu").alias("hu"),
            F.avg("sigma").alias("sigma"),
            F.min("mu").alias("mu_low"),
            F.max("mu").alias("mu_high"),
        )
    )


@query
def predict_expected(spark, sf):
    return rounded(draws.predicted_cells(_scored(spark, sf)))


@query
def predict_sampled(spark, sf):
    seeded = draws.with_seed(fx.design(spark, sf), seed=11)
    scored = draws.score_draws(seeded, fx.draws_fixed(spark, sf), fx.draws_random(spark, sf))
    return rounded(draws.sampled_cells(draws.predict_draws(scored)))


@query
def predictive_check(spark, sf):
    predicted = draws.predicted_cells(_scored(spark, sf)).drop("response_pred_gaussian")
    return _means(effects.predictive_check(frame.model_frame(fx.trials(spark, sf)), predicted))


@query
def predicted_effect(spark, sf):
    shown = draws.predicted_cells(_scored(spark, sf)).where(F.col("model_name").isin("full", "contrast", "hurdle"))
    unit = [*PARTICIPANT, "contrast_level", "stim", "model_name"]
    return rounded(effects.effect_table(shown, "response_pred", unit, [*CONDITION, "model_name"]))


def _conditional(spark, sf, model=None, pick=draws.conditional_draws):
    """The picks of every model, or of one, whose draws alone are then shuffled."""
    random = fx.draws_random(spark, sf)
    random = random if model is None else random.where(F.col("model_name") == model)
    return pick(fx.design(spark, sf), fx.draws_fixed(spark, sf), random, 100, seed=5)


def _sums(spark, sf, model=None):
    return _conditional(spark, sf, model, draws.conditional_sums)


@query
def conditional_draws(spark, sf):
    """Conditional samples of every cell, summarised."""
    sums = _sums(spark, sf).groupBy(*draws.MODEL_CELL).agg(*[F.sum(c).alias(c) for c in ("n", "n_draws", "n_pred", "pred_sum", "hu_sum")])
    cells = sums.select(*draws.MODEL_CELL, "n", "n_draws", F.try_divide("pred_sum", "n_pred").alias("pred"), F.try_divide("hu_sum", "n").alias("hu"))
    return rounded(draws.checked_size(cells, 100))


@query
def perceived_contrast_effect(spark, sf):
    """Condition effect on sampled non-zero predictions, averaged over stimuli first."""
    return rounded(effects.effect_table(effects.sampled_means(_sums(spark, sf)), "value", [*PAIR, "model_name"], [*CONDITION, "model_name"]))


@query
def perceived_vs_observed_effect(spark, sf):
    """Predicted and observed effects on non-zero reproductions, stacked."""
    return rounded(effects.perceived_vs_observed(frame.model_frame(fx.trials(spark, sf)), _sums(spark, sf, "full")))


@query
def predicted_nonzero_means(spark, sf):
    return rounded(effects.predicted_means(_sums(spark, sf)))


@query
def reproduction_error_strict(spark, sf):
    """A missing answer makes the error of its cell missing."""
    unread = fx.trials(spark, sf).withColumn("answer", F.when(F.col("trial_index") % 97 == 0, "abc").otherwise(F.col("answer")))
    return _means(exclude.reproduction_error(unread, na="propagate"))


@query
def exclusion_summary_default(spark, sf):
    """Exclusions at the default threshold of four standard deviations."""
    return exclude.exclusion_summary(exclude.exclusion_log(fx.trials(spark, sf)))


@query
def short_cells(spark, sf):
    """Cells with fewer than 100 draws."""
    return draws.short_cells(_scored(spark, sf), draws.MODEL_CELL, 100)


@query
def sample_per_cell(spark, sf):
    numbered = fx.trials(spark, sf).select(*CELL, "trial_index")
    return draws.sample_per_group(numbered, CELL, 2, ["trial_index"], seed=3).drop("pick")


@query
def rhat_split(spark, sf):
    return rounded(diagnostics.rhat(fx.draws_long(spark, sf), rank=False))


@query
def rhat_rank(spark, sf):
    return rounded(diagnostics.rhat(fx.draws_long(spark, sf)))


@query
def rhat_gate(spark, sf):
    return rounded(diagnostics.rhat_gate(diagnostics.rhat(fx.draws_long(spark, sf), rank=False)))


@query
def high_rhat(spark, sf):
    return rounded(diagnostics.high_rhat(diagnostics.rhat(fx.draws_long(spark, sf), rank=False)))


@query
def trace(spark, sf):
    return _means(diagnostics.trace(fx.draws_long(spark, sf), every=5))


@query
def trace_density(spark, sf):
    chains = diagnostics.trace(fx.draws_long(spark, sf))
    return _means(summarise.histogram(chains, ["experiment", "condition", "model_name", "parameter", "chain"], width=0.5))


@query
def model_bf(spark, sf):
    return rounded(models.model_bf(fx.log_evidence(spark, sf)), 3)


@query
def model_bf_rebase(spark, sf):
    return rounded(models.rebase(models.model_bf(fx.log_evidence(spark, sf)), "contrast"), 3)


@query
def model_baseline(spark, sf):
    return rounded(models.against_baseline(models.model_bf(fx.log_evidence(spark, sf))), 3)


@query
def model_evidence(spark, sf):
    return rounded(models.evidence(models.model_bf(fx.log_evidence(spark, sf))), 3)


@query
def hurdle_fit(spark, sf):
    return rounded(fitting.fit_hurdle(frame.model_frame(fx.trials(spark, sf))), 4)


@query
def hurdle_fit_evidence(spark, sf):
    """Bayes factors between the fitted models, by the Laplace approximation."""
    fits = fitting.fit_hurdle(frame.model_frame(fx.trials(spark, sf)))
    logml = fits.select("experiment", F.col("bias_source").alias("condition"), F.col("model_name").alias("model"), "logml")
    return rounded(models.evidence(models.model_bf(logml)), 4)


# Effect regression


def _full_model(spark, sf):
    predicted = draws.predicted_cells(_scored(spark, sf).where(F.col("model_name") == "full"))
    return effects.hurdle_and_detection(predicted, fx.trials(spark, sf))


@query
def hurdle_detection_cells(spark, sf):
    return _means(_full_model(spark, sf))


@query
def detection_vs_hurdle(spark, sf):
    return _means(effects.hurdle_vs_detection(_full_model(spark, sf)))


@query
def hurdle_detection_long(spark, sf):
    keys = ["experiment", "bias_source", "cond", "contrast_level"]
    both = lengthen(_full_model(spark, sf).drop("participant"), keys, ["hurdle_prob", "answer"], "task")
    return _means(both.groupBy("experiment", "task").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))


@query
def effect_logit(spark, sf):
    return rounded(regression.effect_logit(_full_model(spark, sf)))


def _fit(spark, sf):
    points = materialize(regression.effect_logit(_full_model(spark, sf)))
    return points, regression.effect_regression(points)


FIT_COLUMNS = ["experiment", "bias_source", "n", "df", "slope", "intercept", "r2", "r2_rounded", "se"]


@query
def effect_regression(spark, sf):
    return rounded(_fit(spark, sf)[1].select(*FIT_COLUMNS))


@query
def effect_regression_within(spark, sf):
    points = regression.effect_logit(_full_model(spark, sf))
    return rounded(regression.effect_regression(points, within=True).select(*FIT_COLUMNS))


@query
def regression_line(spark, sf):
    points, fit = _fit(spark, sf)
    return rounded(regression.regression_line(points.withColumn("answer", F.round("answer", 9)), fit))


@query
def evidence_ratio(spark, sf):
    return rounded(regression.slope_evidence(_fit(spark, sf)[1]).select("experiment", "bias_source", "evidence_ratio"), 4)


@query
def evidence_ratio_draws(spark, sf):
    """Odds of a positive condition effect on passing the hurdle, per fit and participant."""
    fixed, random = fx.draws_fixed(spark, sf), fx.draws_random(spark, sf)
    effect = random.join(fixed, [*FIT, "draw_id"]).withColumn("value", F.col("hu_cond") + F.col("r_hu_cond"))
    return rounded(diagnostics.evidence_ratio(effect, [*PARTICIPANT, "model_name"]))


@query
def bayes_r2(spark, sf):
    return rounded(diagnostics.bayes_r2(_scored(spark, sf), ["experiment", "bias_source", "model_name"]))
