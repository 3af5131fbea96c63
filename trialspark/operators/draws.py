"""Scoring a design against posterior draws of a hurdle model.

`fixed` has one row per fit and draw, `random` one per fit, draw and participant; a fit is (experiment, source, model).
Scored rows are aggregated or filtered right away, never stored.
"""

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MODULUS, column, digest, inv_logit, key_number, normal, normal_cdf, normal_lpdf, normal_pdf, uniform, with_numbers
from ..schema import DESIGN, FIT, MODELS, PARTICIPANT
from ..session import materialize
from .joins import lookup_join, null_safe_join, salted_join

MODEL_CELL = [*DESIGN, "model_name"]


def hurdle_lpdf(y, mu, sigma, hu) -> Column:
    """Log density of a response that is 0 with probability `hu`, else normal."""
    y, hu = column(y), column(hu)
    return F.when(y == 0, F.ln(hu)).otherwise(F.log1p(-hu) + normal_lpdf(y, mu, sigma))


def hurdle_loglik(df: DataFrame, keys, y="response", mu="mu", sigma="sigma", hu="hu") -> DataFrame:
    density = hurdle_lpdf(y, mu, sigma, hu)
    return df.groupBy(*keys).agg(F.sum(density).alias("loglik"), F.count(density).alias("n"))


def linear_predictor(prefix="b_", effects="r_", cond="cond") -> Column:
    """Fixed part in stimulus and condition plus the participant's intercept and condition effect."""
    shown = (F.col(cond) == "present").cast("double")

    def c(name):
        return F.col(name)

    fixed = c(f"{prefix}intercept") + c(f"{prefix}stim") * c("stim")
    by_condition = c(f"{prefix}cond") + c(f"{prefix}stim_cond") * c("stim") + c(f"{effects}cond")
    return fixed + c(f"{effects}intercept") + by_condition * shown


def score_draws(design: DataFrame, fixed: DataFrame, random: DataFrame, salt=None) -> DataFrame:
    """`mu`, `sigma`, `hu` and the logit of `hu` for every design row under every draw of its participant.

    Two equi-joins on participant and draw keys; a participant with very many draws is spread over salted sub-keys, and a
    following per-cell aggregate combines before its shuffle. Other columns of `design` are carried along. `salt`: a name under
    which the sub-key is kept; all rows of a cell and sub-key are in one task.
    """
    on = [*PARTICIPANT, "model_name"] if "model_name" in design.columns else PARTICIPANT
    draws = random.join(fixed, ["draw_id", *FIT])
    # `fixed` has one row per draw, so `random` alone tells how many rows each participant brings.
    scored = salted_join(draws, design, on, spread=["draw_id"], sizes_of=random, salt=salt)
    kept = [*MODEL_CELL, "draw_id", "mu", "sigma", "eta_hu", "hu"]
    extra = [c for c in design.columns if c not in MODEL_CELL]
    return (
        scored.withColumns({"mu": linear_predictor(), "eta_hu": linear_predictor("hu_", "r_hu_")})
        .withColumn("hu", inv_logit("eta_hu"))
        .select(*kept, *extra, *([salt] if salt else []))
    )


def predicted_cells(scored: DataFrame, keys=MODEL_CELL) -> DataFrame:
    """Expected predictive summary per cell, without sampling noise; negative predictions count as zeros in `hurdle_prob`.

    `response_pred_gaussian` is the mean of predictions that passed the hurdle, negative ones included.
    """
    mu, sigma, go = F.col("mu"), F.col("sigma"), 1.0 - F.col("hu")
    above = normal_cdf("_z")
    parts = scored.withColumn("_z", mu / sigma).withColumns({"_above": above, "_go": go})
    positive = F.col("_go") * F.col("_above")
    sums = parts.groupBy(*keys).agg(
        F.avg(F.col("_go") * mu).alias("response_pred"),
        F.avg(1.0 - positive).alias("hurdle_prob"),
        F.sum(F.col("_go") * (mu * F.col("_above") + sigma * normal_pdf("_z"))).alias("_positive_sum"),
        F.sum(positive).alias("_positive"),
        F.sum(F.col("_go") * mu).alias("_go_sum"),
        F.sum("_go").alias("_go"),
    )
    return sums.withColumns(
        {
            "response_pred_non_zero": F.try_divide("_positive_sum", "_positive"),
            "response_pred_gaussian": F.try_divide("_go_sum", "_go"),
        }
    ).drop("_positive_sum", "_positive", "_go_sum", "_go")


def with_seed(design: DataFrame, seed=0, stream="response") -> DataFrame:
    """The design with `cell_seed`, a number per row from which the random numbers of its draws are made."""
    return design.withColumn("cell_seed", key_number(*[c for c in MODEL_CELL if c in design.columns], seed=seed, stream=stream))


# Models of one fit share draw numbers; each gets a stream of its own.
MODEL_STREAM = {name: k for k, name in enumerate(MODELS, start=1)}


def _stream(part):
    """The stream of a random number of a row: its model and which number of the row it is."""
    known = F.lit(0)
    for name, k in MODEL_STREAM.items():
        known = F.when(F.col("model_name") == name, k).otherwise(known)
    return known * 8 + part


def predict_draws(scored: DataFrame) -> DataFrame:
    """One sampled response per scored row of a design `with_seed`, repeatable for its seed."""
    names = ["_hurdle", "_first", "_second"]
    numbered = with_numbers(scored, **{name: ("cell_seed", "draw_id", _stream(k)) for k, name in enumerate(names)})
    sampled = F.col("mu") + F.col("sigma") * normal("_first", "_second")
    return numbered.withColumn("prediction", F.when(uniform("_hurdle") < F.col("hu"), 0.0).otherwise(sampled)).drop("cell_seed", *names)


def sampled_cells(predicted: DataFrame, keys=MODEL_CELL) -> DataFrame:
    """Predictive summary of sampled responses, same columns as the expected one."""
    value = F.col("prediction")
    return predicted.groupBy(*keys).agg(
        F.avg(value).alias("response_pred"),
        (1 - F.avg((value > 0).cast("int"))).alias("hurdle_prob"),
        F.avg(F.when(value > 0, value)).alias("response_pred_non_zero"),
    )


def short_cells(df: DataFrame, keys, min_n) -> DataFrame:
    """Cells with fewer than `min_n` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_n)


SALTS = 64
#: From this n on Spark no longer cuts a window to its first rows before the shuffle.
GROUP_LIMIT = 1000


def first_n(df: DataFrame, keys, order, n, name="pick") -> DataFrame:
    """The first `n` rows per key, for any n and any key size.

    Below `GROUP_LIMIT` Spark cuts each key to `n` rows in every map task. Above, the rows of a key are first dealt over
    salted sub-keys, which are cut to `n` rows each, so that only those of a large key meet in the final cut.
    A hash of the key leads the sort: it tells nearly all keys apart by one number instead of several texts.
    """
    rows = df.withColumn("_key_hash", F.xxhash64(*keys))
    if n >= GROUP_LIMIT:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        place = F.row_number().over(Window.partitionBy("_key_hash", "_salt", *keys).orderBy(*order))
        rows = salted.withColumn("_place", place).where(F.col("_place") <= n).drop("_place", "_salt")
    position = F.row_number().over(Window.partitionBy("_key_hash", *keys).orderBy(*order))
    return rows.withColumn(name, position).where(F.col(name) <= n).drop("_key_hash")


def sample_per_group(df: DataFrame, keys, n, identity, seed=0) -> DataFrame:
    """`n` random rows per key without replacement, repeatable: the order is a hash of the row's identity."""
    order = df.withColumn("_held", digest(*identity, seed=seed, stream="sample"))
    return first_n(order, keys, ["_held", *identity], n).drop("_held")


#: Bits of the whole-number weight of a draw that surely passes.
WEIGHT_BITS = 40
#: Draws of a participant that stay together. Sums of weights of that many are far below 2 ** 63.
PART_DRAWS = 250_000
#: Draws, and picks, that a task holds at a time, more or less; a cell and a part are held whole.
BUCKET_DRAWS, BUCKET_PICKS = 25_000, 250_000

# The predictors of a draw, intercept and slopes of its participant: what `linear_predictor` adds up.
_COEFFICIENTS = {
    "m0": "b_intercept + r_intercept",
    "m1": "b_stim",
    "m2": "b_cond + r_cond",
    "m3": "b_stim_cond",
    "h0": "hu_intercept + r_hu_intercept",
    "h1": "hu_stim",
    "h2": "hu_cond + r_hu_cond",
    "h3": "hu_stim_cond",
}


def _conditional(n=None, summed=False):
    """(function of the draws and the cells of some participants, both Arrow tables, and the schema of what it returns).

    It returns `n` picks per cell and model, those of them that fall into the cell's part of the draws, or if `summed` one row
    of their counts and sums; without `n` the sum of the part's weights. A cell comes with its model, the number its random numbers are made from, and where its part begins in
    the whole sum of its weights (NULL: the part is the whole). All is local to this function, so it ships to workers by value.
    """
    keys, shared, coefficients = list(MODEL_CELL), [*PARTICIPANT, "model_name", "part"], list(_COEFFICIENTS)
    one, block, prime = float(1 << WEIGHT_BITS), BUCKET_PICKS, MODULUS
    kinds = {k: pa.float64() if k == "stim" else pa.string() for k in keys}
    if n is None:
        kinds |= {"part": pa.int32(), "total": pa.int64()}
    elif summed:
        kinds |= {"n": pa.int64(), "n_draws": pa.int64(), "n_pred": pa.int64(), "pred_sum": pa.float64(), "hu_sum": pa.float64()}
    else:
        kinds |= {"draw_id": pa.int64(), "hu": pa.float64(), "mu": pa.float64(), "pick": pa.int32(), "pred": pa.float64(), "again": pa.bool_()}
    schema = pa.schema(list(kinds.items()))

    def scrambled(number, pick, stream):
        """As `with_numbers` makes them in three rounds."""
        for k, step in enumerate((pick, stream, 0)):
            number = (number + np.uint64(step) * np.uint64(48_271 + 16_807 * k) + np.uint64(12_345 if k == 2 else 0)) % np.uint64(prime)
            square = number * number % np.uint64(prime)
            number = square * square % np.uint64(prime) * number % np.uint64(prime)
        return number.astype(float)

    def uniform_of(number):
        return (number + 0.5) / float(prime)

    def codes(draws, cells):
        """The same number for rows of the same participant, model and part."""
        code, size = np.zeros(draws.num_rows + cells.num_rows, dtype=np.int64), 1
        for k in shared:
            known = pa.chunked_array([*draws[k].chunks, *cells[k].chunks]).combine_chunks().dictionary_encode()
            if size * len(known.dictionary) >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                size = len(code)
            code, size = code * len(known.dictionary) + known.indices.to_numpy(), size * len(known.dictionary)
        return code[: draws.num_rows], code[draws.num_rows :]

    def places(share, sums, whole, before, total):
        """Where the picks of each cell fall inside its part, -1 outside. `sums`: of the weights of the part."""
        at = np.minimum(np.floor(share * sums[:, None].astype(float)).astype(np.int64), sums[:, None] - 1)
        for i in (i for i, w in enumerate(whole) if w is not None):
            # Whole sums may not fit 64 bits. Another machine may have added up the last bit of this part otherwise.
            inside = (min(int(p), int(whole[i]) - 1) - int(before[i]) for p in np.floor(share[i] * float(whole[i])))
            at[i] = [min(p, int(sums[i]) - 1) if 0 <= p < int(total[i]) else -1 for p in inside]
        return at

    def run(draws, cells):
        own, wanted = codes(draws, cells)
        ids, seeds, stim, shown = draws["draw_id"].to_numpy(), cells["cell_seed"].to_numpy().astype(np.uint64), cells["stim"].to_numpy(), cells["shown"].to_numpy()
        order = np.lexsort((ids, own))
        own, ids = own[order], ids[order]
        values = {c: draws[c].to_numpy()[order] for c in [*coefficients, "sigma"]}
        first = np.searchsorted(own, wanted, side="left")
        lengths = np.searchsorted(own, wanted, side="right") - first
        known = np.flatnonzero(lengths)
        borders = np.cumsum(np.maximum(lengths[known], n or 0)) // block
        out = [[] for _ in range(1 + len(schema) - len(keys))]
        for these in np.split(known, np.flatnonzero(np.diff(borders)) + 1):
            # A row for each draw of each cell, cell after cell.
            ends = np.cumsum(lengths[these])
            cell = np.repeat(these, lengths[these])
            draw = np.arange(len(cell)) + np.repeat(first[these] - (ends - lengths[these]), lengths[these])

            def predictor(kind, cell, draw):
                b, x = [values[f"{kind}{k}"][draw] for k in range(4)], stim[cell]
                return b[0] + b[1] * x + (b[2] + b[3] * x) * shown[cell]

            hu = 1 / (1 + np.exp(-predictor("h", cell, draw)))
            weight = np.where(hu <= 1, np.floor((1 - hu) * one), 0).astype(np.int64)
            # The sums of all cells end to end, so that one search does; a draw without weight is never found.
            upto = np.cumsum(weight)
            stops = upto[ends - 1] if len(these) else ends
            starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
            some = stops > starts
            these, starts, sums = these[some], starts[some], (stops - starts[: len(stops)])[some]
            if n is None:
                columns = these, cells["part"].to_numpy()[these], sums
            else:
                coarse, fine, one_, two = (scrambled(seeds[these][:, None], np.arange(1, n + 1), k) for k in range(4))
                share = (coarse + uniform_of(fine)) / float(prime)
                at = places(share, sums, *(cells[c].take(pa.array(these)).to_pylist() for c in ("whole", "before", "total")))
                here = np.flatnonzero(at.ravel() >= 0)
                found = np.searchsorted(upto, (at + starts[:, None]).ravel()[here], side="right")
                noise = (np.sqrt(-2 * np.log(uniform_of(one_))) * np.cos(2 * np.pi * uniform_of(two))).ravel()[here]
                own_cell, draw_ = cell[found], draw[found]
                mu = predictor("m", own_cell, draw_)
                pred = mu + values["sigma"][draw_] * noise
                if summed:
                    of, known_pred, seen = here // n, ~np.isnan(pred), np.zeros(len(cell), dtype=bool)
                    seen[found] = True
                    count = np.bincount(of, None, len(these))
                    weights = known_pred, np.where(known_pred, pred, 0), hu[found]
                    each = [np.bincount(cell[seen], None, cells.num_rows)[these], *(np.bincount(of, w, len(these)) for w in weights)]
                    some = count > 0
                    columns = these[some], count[some], *(x[some] for x in each)
                else:
                    again = np.ones(len(found), dtype=bool)
                    again[np.unique(found, return_index=True)[1]] = False
                    columns = own_cell, ids[draw_], hu[found], mu, here % n + 1, pred, again
            for held, column_ in zip(out, columns):
                held.append(column_)
        cell, *columns = (np.concatenate(x) for x in out)
        found = [cells[k].take(pa.array(cell)) for k in keys] + [pa.array(x, from_pandas=not summed) for x in columns]
        return pa.table(found, names=schema.names).cast(schema)

    def apply(draws, cells):
        if not draws.num_rows or not cells.num_rows:
            return schema.empty_table()
        with np.errstate(all="ignore"):
            return run(draws, cells)

    names = {pa.string(): "string", pa.float64(): "double", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
    return apply, ", ".join(f"{field.name} {names[field.type]}" for field in schema)


def conditional_sums(design: DataFrame, fixed: DataFrame, random: DataFrame, n=100, seed=0, **sizes) -> DataFrame:
    """The picks of `conditional_draws` counted and summed per cell where they are made, so that no pick leaves its task: `n`,
    `n_draws` (different ones), `n_pred` (known responses), `pred_sum` and `hu_sum`. A participant in several parts has a row of each.
    """
    return conditional_draws(design, fixed, random, n, seed, summed=True, **sizes)


def conditional_draws(
    design: DataFrame, fixed: DataFrame, random: DataFrame, n=100, seed=0, part_draws=PART_DRAWS, bucket_draws=BUCKET_DRAWS, bucket_picks=BUCKET_PICKS, summed=False
) -> DataFrame:
    """`n` sampled responses per cell given that the hurdle was passed; negative ones are kept.

    Draws are picked with replacement, with weight 1 - hu, as whole numbers of 2 ** -40: the draws of a cell lie end to end in
    a sum of weights, and n random places in it are located. It costs the same however rarely the hurdle is passed; only a cell
    whose draws all have 1 - hu below 2 ** -40 gets no rows, which `checked_size` tells. `again`: an earlier row of the cell has
    the same draw.

    The draws are shuffled once, to buckets of participants, and scored there for a few cells at a time: a scored row never
    leaves its task. A participant with more than `part_draws` draws is cut into parts at approximate quantiles of the draws,
    each a stretch of the sum of weights; those participants alone are scored once more beforehand, to tell how long the
    stretches are. The picks are the same however the draws are cut. `summed`: see `conditional_sums`.
    """
    sizes = materialize(random.groupBy(*PARTICIPANT, "model_name").agg(F.count(F.lit(1)).alias("_rows")))
    heavy = sizes.groupBy(*PARTICIPANT).agg(F.sum("_rows").alias("_rows")).where(F.col("_rows") > part_draws)
    largest = heavy.agg(F.max("_rows")).first()[0] or 0
    cells = design.select(*DESIGN).distinct().join(sizes.drop("_rows"), PARTICIPANT).withColumn("shown", (F.col("cond") == "present").cast("double"))
    cells = cells.where(F.col("stim").isNotNull() & F.col("shown").isNotNull())
    buckets = max(1, (sizes.agg(F.sum("_rows")).first()[0] or 0) // bucket_draws, cells.count() * n // bucket_picks)
    coefficients = [F.expr(x).alias(c) for c, x in _COEFFICIENTS.items()]
    own = random.join(fixed, ["draw_id", *FIT]).select(*PARTICIPANT, "model_name", "draw_id", "sigma", *coefficients)
    if largest:
        cuts = ceil(largest / part_draws)
        bounds = F.percentile_approx("draw_id", [i / cuts for i in range(1, cuts)], 10 * max(cuts, 1000)).alias("_bounds")
        parts = materialize(lookup_join(random, heavy, PARTICIPANT, "inner").groupBy(*PARTICIPANT).agg(bounds))
        part = F.size(F.filter("_bounds", lambda bound: bound < F.col("draw_id")))
        own = lookup_join(own, parts, PARTICIPANT, stored=True).withColumn("part", F.when(F.col("_bounds").isNull(), 0).otherwise(part))
        each = F.sequence(F.lit(0), F.coalesce(F.array_size("_bounds"), F.lit(0)))
        cells = lookup_join(cells, parts, PARTICIPANT, stored=True).withColumn("part", F.explode(each))
    else:
        own, cells = own.withColumn("part", F.lit(0)), cells.withColumn("part", F.lit(0))
    cells = with_seed(cells, seed, "conditional")
    alone = {c: F.lit(None).cast("decimal(38,0)") for c in ("total", "before", "whole")}
    if not largest:
        return _by_bucket(own, cells.withColumns(alone), buckets, n, summed)
    large = F.col("_bounds").isNotNull()
    sums = _by_bucket(own.where(large).drop("_bounds"), cells.where(large).drop("_bounds").withColumns(alone), buckets)
    sums = sums.withColumn("total", F.col("total").cast("decimal(28,0)"))
    whole = Window.partitionBy(*MODEL_CELL)
    stretches = {"before": F.sum("total").over(whole.orderBy("part")) - F.col("total"), "whole": F.sum("total").over(whole)}
    located = null_safe_join(cells, materialize(sums.withColumns(stretches)), [*MODEL_CELL, "part"], "left")
    return _by_bucket(own.drop("_bounds"), located.drop("_bounds"), buckets, n, summed)


def _by_bucket(own, cells, buckets, n=None, summed=False):
    """Draws and cells of the same participants and parts together, in a fixed number of partitions: adaptive execution would
    merge the small inputs, whose output is large."""
    bucket = F.pmod(F.xxhash64(*PARTICIPANT, "part"), F.lit(buckets)).alias("bucket")
    partitions = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # `toDF` gives the columns of both sides, which partly come from the same table, identities of their own.
    left, right = (df.toDF(*df.columns).select("*", bucket).repartition(partitions, "bucket").groupBy("bucket") for df in (own, cells))
    return left.cogroup(right).applyInArrow(*_conditional(n, summed))


def checked_size(counted: DataFrame, n, name="n") -> DataFrame:
    """A summary per cell, unchanged; an error if a cell has not exactly `n` rows."""
    short = F.raise_error(F.concat(F.lit(f"a cell has other than {n} rows: "), F.col(name).cast("string"))).cast("long")
    return counted.withColumn(name, F.when(F.col(name) == n, F.col(name)).otherwise(short))
