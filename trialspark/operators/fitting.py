"""Mixed fits of the four hurdle models, all experiments and sources at once.

The likelihood factors into a logistic part (is the response 0?) and a normal part (the non-zero responses), each with or
without a condition effect; four part fits give all four models. Participants have an own intercept and, where the part
has a condition effect, an own condition effect. The two are correlated: their 2 x 2 covariance is estimated per part by
expectation-maximisation, held back a little towards a multiple of the identity, or is fixed to that multiple. In the
normal part it is relative to the residual variance. Participants stay rows of a table: each participant's block is
eliminated in place, only the sums of a fit meet, and one 4 x 4 system per fit is solved in a Python task.

Evidence is either the BIC approximation with the effective number of parameters or a Laplace approximation over the
participant effects, with a prior for the common coefficients that is worth one trial.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PARTICIPANT
from ..session import scratch_path
from .joins import BROADCAST_ROWS, null_safe_join

GROUP = ["experiment", "bias_source"]
PART = [*GROUP, "kind", "with_cond"]
PERSON = [*PARTICIPANT, "kind", "with_cond"]
BETA = ["b_intercept", "b_stim", "b_cond", "b_stim_cond"]
COVARIANCE = ["t11", "t12", "t22"]

# Expressions are SQL text: one call to Spark each, where columns would take one call per operator and iteration.
PREDICTOR = "b_intercept + u_intercept + b_stim * stim + (b_cond + u_cond + b_stim_cond * stim) * c"
ZERO_LOGLIK = """zeros * (least(eta, 0) - log1p(exp(-abs(eta)))) + (n - zeros) * (-greatest(eta, 0) - log1p(exp(-abs(eta))))"""
RESIDUAL = "syy - 2 * eta * sy + passed * eta * eta"


def _stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder. Its size is that of its files, while a checkpoint keeps the estimate of its plan,
    which the joins of each iteration multiply."""
    path = scratch_path(df.sparkSession, "fit")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(cells: DataFrame) -> DataFrame:
    """The cells with a number for their participant and part, `person`. Joined and summed by this one key, which is never
    missing, the cells move once in an iteration."""
    people = _stored(cells.select(*PERSON).distinct().withColumn("person", F.monotonically_increasing_id()))
    return null_safe_join(cells, people.hint("merge"), PERSON)


def _by_person(cells: DataFrame, effects: DataFrame) -> DataFrame:
    """The cells with what is known of their participant. Participants never pass through the driver, however few there are:
    a broadcast in every iteration would add up."""
    return cells.join(effects.select("person", *BETA, "u_intercept", "u_cond").hint("merge"), "person")


def _by_fit(people: DataFrame, fits: DataFrame, small: bool) -> DataFrame:
    """Rows of participants with those of their fits, of which there are few; Spark is told so, lest it broadcasts the participants."""
    return null_safe_join(people, F.broadcast(fits) if small else fits.hint("merge"), PART)


def hurdle_cells(frame: DataFrame) -> DataFrame:
    """Sufficient counts and sums per participant, condition and stimulus, once for each part: `kind` hu or mu, `with_cond`."""
    cells = frame.where("response IS NOT NULL").groupBy(*PARTICIPANT, "cond", "stim").agg(
        F.expr("CAST(count(1) AS DOUBLE) AS n"),
        F.expr("CAST(count_if(response = 0) AS DOUBLE) AS zeros"),
        F.expr("CAST(count_if(response != 0) AS DOUBLE) AS passed"),
        F.expr("coalesce(sum(CASE WHEN response != 0 THEN response END), 0D) AS sy"),
        F.expr("coalesce(sum(CASE WHEN response != 0 THEN response * response END), 0D) AS syy"),
    )
    parts = cells.withColumn("with_cond", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("kind", F.explode(F.array(F.lit("hu"), F.lit("mu"))))
    shown = parts.where("kind = 'hu' OR passed > 0")
    return shown.withColumn("c", F.expr("CAST(cond = 'present' AND with_cond = 1 AS DOUBLE)")).drop("cond")


def _moments(rows: DataFrame) -> DataFrame:
    """Weighted moments per participant around the predictor `eta`, over all rows and over those with the condition effect,
    and the log likelihood (hu) or the residual sum of squares (mu) at `eta`."""
    rows = rows.withColumn("p", F.expr("1 / (1 + exp(-eta))"))
    rows = rows.withColumn("weight", F.expr("CASE kind WHEN 'hu' THEN n * greatest(p * (1 - p), 1e-10D) ELSE passed END"))
    rows = rows.withColumn("target", F.expr("CASE kind WHEN 'hu' THEN eta + (zeros - n * p) / weight ELSE sy / passed END"))
    terms = {"w": "weight", "s": "weight * stim", "q": "weight * stim * stim", "z": "weight * target", "zs": "weight * target * stim"}
    sums = [F.expr(f"sum({x} * {on}) AS {k}{mark}") for mark, on in (("", "1"), ("1", "c")) for k, x in terms.items()]
    fit = f"sum(CASE kind WHEN 'hu' THEN {ZERO_LOGLIK} ELSE {RESIDUAL} END) AS fit"
    return rows.groupBy("person", *PERSON).agg(*sums, F.expr(fit), F.expr("sum(CASE kind WHEN 'hu' THEN n ELSE passed END) AS size"))


def _blocks(moments: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """Adds the inverse of each participant's own 2 x 2 block, the logarithm of the block's determinant, and the precision."""
    blocks = _by_fit(moments, state.drop("old", "s2", "used"), small).withColumn("_t", F.expr("t11 * t22 - t12 * t12"))
    blocks = blocks.withColumns({"p11": F.expr("t22 / _t"), "p12": F.expr("-t12 / _t"), "p22": F.expr("t11 / _t")})
    blocks = blocks.withColumn("_det", F.expr("(w + p11) * (w1 + p22) - (w1 + p12) * (w1 + p12)"))
    found = {"v11": "(w1 + p22) / _det", "v12": "-(w1 + p12) / _det", "v22": "(w + p11) / _det", "block_logdet": "ln(_det)", "cov_logdet": "ln(_t)"}
    return blocks.withColumns({k: F.expr(x) for k, x in found.items()}).drop("_det", "_t")


# Products of the regressors (1, stim, cond, stim * cond) with each other, with the participant's (1, cond), and with the target.
_XX = [["w", "s", "w1", "s1"], ["s", "q", "s1", "q1"], ["w1", "s1", "w1", "s1"], ["s1", "q1", "s1", "q1"]]
_WX = [["w", "s", "w1", "s1"], ["w1", "s1", "w1", "s1"]]
_XZ, _WZ = ["z", "zs", "z1", "zs1"], ["z", "z1"]


def _through_block(left, right):
    """left' V right for two pairs of columns."""
    (l1, l2), (r1, r2) = left, right
    return f"(v11 * {l1} * {r1} + v12 * ({l1} * {r2} + {l2} * {r1}) + v22 * {l2} * {r2})"


def _solve(blocks: DataFrame) -> DataFrame:
    """The common coefficients of each fit, participants eliminated; unused condition terms are 0.

    `fit` and `size` are summed; `schur_logdet` is the logarithm of the determinant of what is left of the system.
    """
    wx = [(_WX[0][i], _WX[1][i]) for i in range(4)]
    sums = [f"sum({_XX[i][j]} - {_through_block(wx[i], wx[j])}) AS g{i}{j}" for i in range(4) for j in range(i, 4)]
    sums += [f"sum({_XZ[i]} - {_through_block(wx[i], _WZ)}) AS h{i}" for i in range(4)]
    systems = blocks.groupBy(*PART).agg(*[F.expr(x) for x in [*sums, "sum(fit) AS fit", "sum(size) AS size"]])
    keys, beta = [*PART, "fit", "size"], list(BETA)

    def solve(batches):
        for batch in batches:
            found = np.zeros((len(batch), 5))
            for row, line in enumerate(batch.to_dict("records")):
                size = 4 if line["with_cond"] else 2
                g = np.array([[line[f"g{min(i, j)}{max(i, j)}"] for j in range(size)] for i in range(size)])
                h = np.array([line[f"h{i}"] for i in range(size)])
                found[row, :size] = np.linalg.lstsq(g, h, rcond=None)[0]
                found[row, 4] = np.linalg.slogdet(g)[1]
            out = batch[keys].copy()
            out[[*beta, "schur_logdet"]] = found
            yield out

    schema = "experiment string, bias_source string, kind string, with_cond int, fit double, size double, "
    return systems.mapInPandas(solve, schema + ", ".join(f"{b} double" for b in [*BETA, "schur_logdet"]))


def _effects(blocks: DataFrame, beta: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """Participant effects given the common coefficients, the parameters they effectively use, and how the fit moved.

    `total` is the log likelihood the moments were taken at and `change` the relative change of the deviance; unlike a
    coefficient, that settles when an outcome is separable. A change that cannot be told counts as infinite. `s2` is the
    residual variance, 1 in the logistic part.
    """
    beta = null_safe_join(beta, state.select(*PART, "old", F.expr("s2 AS _s2"), "used"), PART)
    beta = beta.withColumn("total", F.expr(f"CASE kind WHEN 'hu' THEN fit ELSE -size / 2 * (ln(2 * {math.pi}D * fit / size) + 1) END"))
    beta = beta.withColumns(
        {
            "change": F.expr("coalesce(2 * abs(total - old) / (2 * abs(total) + 0.1), double('Infinity'))"),
            "s2": F.expr("CASE kind WHEN 'hu' THEN 1D ELSE (fit + _s2 * used) / size END"),
        }
    )
    joined = _by_fit(blocks.drop("fit", "size"), beta.drop("fit", "old", "_s2", "used"), small)
    rest = [f"{z} - ({' + '.join(f'{x} * {b}' for x, b in zip(row, BETA))})" for z, row in zip(_WZ, _WX)]
    joined = joined.withColumns({"_r0": F.expr(rest[0]), "_r1": F.expr(rest[1])})
    return joined.select(
        "person", *PERSON, *BETA, *COVARIANCE, "v11", "v12", "v22", "p11", "p12", "p22", "block_logdet", "cov_logdet", "schur_logdet", "s2", "total", "change",
        F.expr("v11 * _r0 + v12 * _r1 AS u_intercept"),
        F.expr("v12 * _r0 + v22 * _r1 AS u_cond"),
        F.expr("2 - (p11 * v11 + 2 * p12 * v12 + p22 * v22) AS u_df"),
    )


def _state(effects: DataFrame, ridge: float, prior_people: float | None) -> DataFrame:
    """Per fit: the covariance of the next iteration, the log likelihood, residual variance and parameters of this one."""
    fixed = {"t11": f"{1 / ridge}D", "t12": "0D", "t22": f"{1 / ridge}D"}
    if prior_people is None:
        moved = {k: f"max({x})" for k, x in fixed.items()}
    else:
        pairs = {"t11": "u_intercept * u_intercept / s2 + v11", "t12": "u_intercept * u_cond / s2 + v12", "t22": "u_cond * u_cond / s2 + v22"}
        moved = {k: f"(sum({pairs[k]}) + {prior_people}D * {fixed[k]}) / (count(1) + {prior_people}D)" for k in COVARIANCE}
    sums = {**moved, "old": "max(total)", "s2": "max(s2)", "used": "sum(u_df)"}
    return effects.groupBy(*PART).agg(*[F.expr(f"{x} AS {k}") for k, x in sums.items()])


def fit_parts(cells: DataFrame, ridge=1.0, prior_people: float | None = 2.0, max_iter=40, tol=1e-5) -> tuple[DataFrame, int]:
    """The participants' rows of all part fits, with the coefficients of their fit, and the number of iterations.

    Reweighted least squares with one step of expectation-maximisation for the covariance in each iteration. The covariance
    is held back as if `prior_people` more participants had the covariance 1 / `ridge` times the identity; with None it is
    fixed to that. An iteration is one stored table, so that the lineage does not grow, and reads the cells once. It
    ends when all fits have settled.
    """
    effects, done, small = None, 0, cells.select(*PART).distinct().count() <= BROADCAST_ROWS
    while done < max_iter:
        if effects is None:
            rows = cells.withColumn("eta", F.lit(0.0))
            start = [f"{1 / ridge}D AS t11", "0D AS t12", f"{1 / ridge}D AS t22", "CAST(NULL AS DOUBLE) AS old", "1D AS s2", "0D AS used"]
            state = cells.select(*PART).distinct().select(*PART, *[F.expr(x) for x in start])
        else:
            rows = _by_person(cells, effects).withColumn("eta", F.expr(PREDICTOR))
            state = _state(effects, ridge, prior_people)
        blocks = _blocks(_moments(rows), state, small)
        effects = _stored(_effects(blocks, _solve(blocks), state, small))
        done += 1
        if effects.where(F.col("change") >= tol).isEmpty():
            break
    return effects, done


def fit_hurdle(
    frame: DataFrame, ridge=1.0, max_iter=40, tol=1e-5, prior_people: float | None = 2.0, evidence="laplace"
) -> DataFrame:
    """Per experiment, source and model: coefficients of both parts, sigma, the participants' standard deviations and
    correlation, log likelihood, parameters, BIC, log evidence, and whether and after how many iterations the parts converged.
    Unsettled fits are returned, marked as such.

    `evidence`: `laplace` or `bic`, the way to `logml`. `logdet` is the log determinant of the negative Hessian of the
    penalised log likelihood in all coefficients and participant effects of both parts.
    """
    if evidence not in ("laplace", "bic"):
        raise ValueError("evidence is laplace or bic")
    cells = _stored(_numbered(_stored(hurdle_cells(frame))))
    effects, done = fit_parts(cells, ridge, prior_people, max_iter, tol)
    scored = _by_person(cells, effects).withColumn("eta", F.expr(PREDICTOR))
    scores = scored.groupBy(*PART).agg(F.expr(f"sum({ZERO_LOGLIK}) AS zero"), F.expr(f"sum({RESIDUAL}) AS rss"), F.expr("sum(n) AS trials"), F.expr("sum(passed) AS m"))
    shared = [*BETA, *COVARIANCE, "s2", "schur_logdet"]
    # A participant without a condition effect has one effect; the second row of its block is that of the prior alone.
    block = "block_logdet - CASE WHEN with_cond = 0 THEN ln(p22) ELSE 0 END"
    sums = ["sum(u_df) AS used", "count(1) AS people", "max(change) AS change", f"sum({block}) AS blocks", "sum(block_logdet + cov_logdet) AS spread",
            "sum((p11 * u_intercept * u_intercept + 2 * p12 * u_intercept * u_cond + p22 * u_cond * u_cond) / s2) AS pull"]
    people = effects.groupBy(*PART).agg(*[F.expr(x) for x in sums], *[F.max(x).alias(x) for x in shared])
    whole = null_safe_join(scores, people, PART)
    # Inlined step by step: each names a quantity of one part.
    steps = {
        "n": "CASE kind WHEN 'hu' THEN trials ELSE m END",
        "sigma": "CASE kind WHEN 'mu' THEN sqrt(rss / m) END",
        "loglik": f"CASE kind WHEN 'hu' THEN zero ELSE -m / 2 * (ln(2 * {math.pi}D * rss / m) + 1) END",
        "at_s2": f"CASE kind WHEN 'hu' THEN zero ELSE -m / 2 * ln(2 * {math.pi}D * s2) - rss / (2 * s2) END",
        "terms": "2 + 2 * with_cond",
        "df": "used + terms + CASE kind WHEN 'mu' THEN 1 ELSE 0 END",
        "logdet": "schur_logdet + blocks - (terms + people * (1 + with_cond)) * ln(s2)",
        "laplace": "at_s2 - pull / 2 - spread / 2 - terms / 2D * ln(n)",
        "sd_intercept": "sqrt(t11 * s2)",
        "sd_cond": "CASE with_cond WHEN 1 THEN sqrt(t22 * s2) ELSE 0D END",
        "cor": "CASE with_cond WHEN 1 THEN t12 / sqrt(t11 * t22) END",
        "converged": f"change < {tol}D",
    }
    for name, x in steps.items():
        whole = whole.withColumn(name, F.expr(x))
    fields = [*BETA, "n", "sigma", "loglik", "df", "logdet", "laplace", "sd_intercept", "sd_cond", "cor", "converged"]
    held = f"struct({', '.join(fields)})"
    wide = whole.groupBy(*GROUP).agg(
        *[F.expr(f"max(CASE WHEN kind = '{kind}' AND with_cond = {k} THEN {held} END) AS {kind}{k}") for kind in ("hu", "mu") for k in (0, 1)]
    )
    options = {"simple": (0, 0), "contrast": (1, 0), "hurdle": (0, 1), "full": (1, 1)}
    models = ", ".join(f"struct('{m}' AS model_name, mu{i} AS mu, hu{j} AS hu)" for m, (i, j) in options.items())
    fits = wide.select(*GROUP, F.expr(f"inline(array({models}))"))
    bic = "(-2 * (mu.loglik + hu.loglik) + (mu.df + hu.df) * ln(hu.n))"
    logml = "mu.laplace + hu.laplace" if evidence == "laplace" else f"-{bic} / 2"
    out = ["hu.n AS n", *[f"mu.{b} AS {b}" for b in BETA], "mu.sigma AS sigma", *[f"hu.{b} AS {b.replace('b_', 'hu_')}" for b in BETA]]
    out += [f"{part}.{x} AS {prefix}{x}" for part, prefix in (("mu", ""), ("hu", "hu_")) for x in ("sd_intercept", "sd_cond", "cor")]
    out += ["mu.loglik + hu.loglik AS loglik", "mu.df + hu.df AS df", "mu.logdet + hu.logdet AS logdet", f"{bic} AS bic", f"{logml} AS logml"]
    out += ["mu.converged AND hu.converged AS converged", f"{done} AS iterations"]
    return fits.select(*GROUP, "model_name", *[F.expr(x) for x in out])
