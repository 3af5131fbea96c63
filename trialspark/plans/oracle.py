"""The SQL each named query is checked against in DuckDB, written from the formulas.

Shared subqueries are listed once and put in front of a statement in this order when it names them.
"""

import re

from ..functions.numeric import (
    CDF_BOTTOM,
    CDF_TOP,
    LOG_2PI,
    QNORM_CENTRE,
    QNORM_FAR,
    QNORM_MIDDLE,
)
from . import fit_oracle
from .fixtures import DRAWS_FIXED, DRAWS_LONG, DRAWS_RANDOM, TRIALS


def _poly(x, ascending):
    text = repr(float(ascending[-1]))
    for c in reversed(ascending[:-1]):
        text = f"({text} * {x} + {float(c)!r}::DOUBLE)"
    return text


def _ratio(x, pair):
    return f"({_poly(x, pair[0])} / {_poly(x, pair[1])})"


def qnorm(p):
    """Normal quantile of a column or literal strictly between 0 and 1."""
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {r} <= 5 THEN {_ratio(f'({r} - 1.6)', QNORM_MIDDLE)} ELSE {_ratio(f'({r} - 5)', QNORM_FAR)} END"
    centre = f"({p} - 0.5) * {_ratio(f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))', QNORM_CENTRE)}"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN {centre} WHEN {p} < 0.5 THEN -({tail}) ELSE {tail} END"


def ncdf(x):
    """Normal distribution function of a column."""
    a = f"abs({x})"
    e = f"exp(-0.5::DOUBLE * {x} * {x})"
    far = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE)))))"
    upper = (
        f"CASE WHEN {a} > 37 THEN 0::DOUBLE WHEN {a} < 7.07106781186547 THEN {e} * {_poly(a, CDF_TOP)} / {_poly(a, CDF_BOTTOM)}"
        f" ELSE {e} / {far} / 2.506628274631::DOUBLE END"
    )
    return f"CASE WHEN {x} > 0 THEN 1 - ({upper}) ELSE {upper} END"


def _md5(stream, seed, *keys):
    text = " || '|' || ".join([f"'{seed}|{stream}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"md5({text})"


P31 = 2**31 - 1


def _seed(stream, seed, *keys):
    return f"(CAST('0x' || substr({_md5(stream, seed, *keys)}, 1, 15) AS BIGINT) % {P31})"


def _scrambled(source, names):
    """`source` with a random whole number per entry of `names` {name: steps}, made from its column cell_seed.

    Each step adds to the number and takes its fifth power modulo a prime, in three multiplications.
    """
    sql = source
    rounds = 1 + max(len(steps) for steps in names.values())
    for k in range(rounds):
        added, second, fourth, fifth = [], [], [], []
        for name, steps in names.items():
            step = f"(({steps[k]}) % {P31}) * {48271 + 16807 * k}" if k < len(steps) else "0"
            added.append(f"({name if k else 'cell_seed'} + {step} + {12345 if k == rounds - 1 else 0}) % {P31} AS {name}_a")
            second.append(f"{name}_a * {name}_a % {P31} AS {name}_b")
            fourth.append(f"{name}_b * {name}_b % {P31} AS {name}_c")
            fifth.append(f"{name}_c * {name}_a % {P31} AS {name}")
        drop = f" EXCLUDE ({', '.join(names)})" if k else ""
        for columns, cut in ((added, drop), (second, ""), (fourth, "")):
            sql = f"(SELECT *{cut}, {', '.join(columns)} FROM {sql})"
        held = ", ".join(f"{name}_{x}" for name in names for x in "abc")
        sql = f"(SELECT * EXCLUDE ({held}), {', '.join(fifth)} FROM {sql})"
    return sql


def _uniform(number):
    return f"(({number} + 0.5::DOUBLE) / {P31}::DOUBLE)"


def _normal(first, second):
    return f"sqrt(-2 * ln({_uniform(first)})) * cos(2 * pi() * {_uniform(second)})"


# The models' streams of random numbers.
STREAM = "CASE model_name WHEN 'simple' THEN 1 WHEN 'contrast' THEN 2 WHEN 'hurdle' THEN 3 WHEN 'full' THEN 4 ELSE 0 END * 8"


CELL_KEY = ("experiment", "participant", "bias_source", "cond", "contrast_level", "stim", "model_name")

PARTS = {
    "trials": TRIALS.format(events="events"),
    "draws_random": DRAWS_RANDOM.format(lineitem="lineitem"),
    "draws_fixed": DRAWS_FIXED.format(lineitem="lineitem"),
    "draws_long": DRAWS_LONG.format(events="events"),
    # trials by task
    "det": "SELECT * FROM trials WHERE trial_type = 'detection'",
    "rep": "SELECT *, abs(try_cast(answer AS DOUBLE)) AS a FROM trials WHERE trial_type = 'reproduction'",
    "mframe": """SELECT experiment, participant, bias_source, bias_direction AS cond, contrast_level,
        abs(target_contrast) AS stim, a AS response FROM rep""",
    "design": "SELECT DISTINCT experiment, participant, bias_source, cond, contrast_level, stim FROM mframe",
    # signal detection
    "conf": """SELECT experiment, participant, bias_source, bias_direction,
        count(*) FILTER (contrast_level <> 'absent' AND answer = 'present') AS hits,
        count(*) FILTER (contrast_level <> 'absent' AND answer = 'absent') AS misses,
        count(*) FILTER (contrast_level = 'absent' AND answer = 'absent') AS correct_rejections,
        count(*) FILTER (contrast_level = 'absent' AND answer = 'present') AS false_alarms
        FROM det GROUP BY ALL""",
    "rates": """SELECT * EXCLUDE (p), (hits + p) / (hits + misses + 2 * p) AS hr,
        (false_alarms + p) / (false_alarms + correct_rejections + 2 * p) AS fr
        FROM (SELECT *, CASE WHEN 0 IN (hits, misses, correct_rejections, false_alarms) THEN 0.5e0 ELSE 0e0 END AS p FROM conf)""",
    "zrates": f"SELECT *, {qnorm('hr')} AS zh, {qnorm('fr')} AS zf FROM rates",
    "sdt": """SELECT * EXCLUDE (zh, zf), zf AS "lambda", zh - zf AS d, (zh + zf) / 2 AS ccrit,
        (zh - zf) * (-zf - (zh - zf) / 2) AS beta FROM zrates""",
    # exclusion, two standard deviations
    "stair": """SELECT DISTINCT experiment, participant, bias_source, target_contrast AS value
        FROM trials WHERE target_contrast <> 0""",
    "stair_out": """SELECT s.*, m AS mean, m + 2 * s AS upper_boundary, m - 2 * s AS lower_boundary
        FROM stair s JOIN (SELECT experiment, avg(value) AS m, stddev_samp(value) AS s FROM stair GROUP BY 1) b USING (experiment)
        WHERE value >= m + 2 * b.s OR value <= m - 2 * b.s""",
    "sdt1": """SELECT * FROM sdt WHERE (experiment, participant, bias_source) NOT IN
        (SELECT (experiment, participant, bias_source) FROM stair_out)""",
    "low": "SELECT * FROM sdt1 WHERE d <= 0",
    "sdt2": """SELECT * FROM sdt1 WHERE (experiment, participant, bias_source) NOT IN
        (SELECT (experiment, participant, bias_source) FROM low)""",
    "d_out": """SELECT experiment, participant, bias_source, bias_direction, d AS value, m AS mean,
        m + 2 * s AS upper_boundary, m - 2 * s AS lower_boundary
        FROM sdt2 JOIN (SELECT experiment, avg(d) AS m, stddev_samp(d) AS s FROM sdt2 GROUP BY 1) USING (experiment)
        WHERE d >= m + 2 * s OR d <= m - 2 * s""",
    "bad3": """SELECT experiment, participant, bias_source FROM stair_out UNION SELECT experiment, participant, bias_source
        FROM low UNION SELECT experiment, participant, bias_source FROM d_out""",
    "err": """SELECT experiment, participant, bias_source, bias_direction, avg(abs(target_contrast) - a) AS value
        FROM rep GROUP BY ALL""",
    "err3": "SELECT * FROM err WHERE (experiment, participant, bias_source) NOT IN (SELECT (experiment, participant, bias_source) FROM bad3)",
    "err_out": """SELECT e.*, m AS mean, m + 2 * s AS upper_boundary, m - 2 * s AS lower_boundary
        FROM err3 e JOIN (SELECT experiment, avg(value) AS m, stddev_samp(value) AS s FROM err3 GROUP BY 1) USING (experiment)
        WHERE value >= m + 2 * s OR value <= m - 2 * s""",
    "bad": "SELECT * FROM bad3 UNION SELECT experiment, participant, bias_source FROM err_out",
    # cell summaries
    "nz": """SELECT experiment, participant, bias_source, bias_direction, contrast_level, median(a) AS value
        FROM rep WHERE a <> 0 GROUP BY ALL""",
    "sides": """SELECT experiment, participant, bias_source, contrast_level,
        count(*) FILTER (bias_direction = 'control') AS n_control, count(*) FILTER (bias_direction = 'present') AS n_present
        FROM rep WHERE a <> 0 GROUP BY ALL""",
    "complete": """SELECT nz.* FROM nz JOIN sides USING (experiment, participant, bias_source, contrast_level)
        WHERE n_control > 0 AND n_present > 0""",
    "obs": """SELECT experiment, participant, bias_source, cond, contrast_level, stim,
        avg(response) FILTER (response <> 0) AS response_non_zero, avg(CAST(response = 0 AS INT)) AS prop_zero,
        avg(response) AS response FROM mframe GROUP BY ALL""",
    "present_share": """SELECT experiment, participant, bias_source, bias_direction, contrast_level,
        avg(CASE answer WHEN 'present' THEN 1 WHEN 'absent' THEN 0 END) AS value FROM det GROUP BY ALL""",
    "zero_share": """SELECT experiment, participant, bias_source, bias_direction, contrast_level,
        avg(CAST(a = 0 AS INT)) AS value FROM rep GROUP BY ALL""",
    "mean_answer": """SELECT experiment, participant, bias_source, bias_direction, contrast_level, avg(a) AS value
        FROM rep GROUP BY ALL""",
    # draws
    "scored": """SELECT experiment, participant, bias_source, cond, contrast_level, stim, model_name, draw_id, sigma,
        b_intercept + b_stim * stim + r_intercept + shown * (b_cond + b_stim_cond * stim + r_cond) AS mu,
        1 / (1 + exp(-(hu_intercept + hu_stim * stim + r_hu_intercept + shown * (hu_cond + hu_stim_cond * stim + r_hu_cond)))) AS hu
        FROM (SELECT *, CAST(cond = 'present' AS INT) AS shown FROM draws_random
              JOIN draws_fixed USING (experiment, bias_source, model_name, draw_id)
              JOIN design USING (experiment, participant, bias_source))""",
    "zscored": f"SELECT *, {ncdf('z')} AS above FROM (SELECT *, mu / sigma AS z FROM scored)",
    "predicted": f"""SELECT experiment, participant, bias_source, cond, contrast_level, stim, model_name,
        avg((1 - hu) * mu) AS response_pred, avg(hu + (1 - hu) * (1 - above)) AS hurdle_prob,
        sum((1 - hu) * (mu * above + sigma * exp(-z * z / 2 - {LOG_2PI / 2}::DOUBLE))) / sum((1 - hu) * above) AS response_pred_non_zero,
        sum((1 - hu) * mu) / sum(1 - hu) AS response_pred_gaussian FROM zscored GROUP BY ALL""",
    # The draws of a cell end to end in a sum of whole-number weights, and 100 random places in it.
    "weighed": f"""SELECT *, sum(w) OVER (PARTITION BY {', '.join(CELL_KEY)} ORDER BY draw_id) - w AS at,
        sum(w) OVER (PARTITION BY {', '.join(CELL_KEY)}) AS whole
        FROM (SELECT *, CAST(floor((1 - hu) * 1099511627776e0) AS BIGINT) AS w FROM scored) WHERE w > 0""",
    "places": f"""SELECT *, {_seed('conditional', 5, *CELL_KEY)} AS cell_seed, unnest(range(1, 101)) AS pick
        FROM (SELECT DISTINCT {', '.join(CELL_KEY)}, CAST(whole AS BIGINT) AS whole FROM weighed)""",
    "placed": f"""SELECT * EXCLUDE (whole), CAST(least(floor(((u1 + {_uniform('u2')}) / {P31}::DOUBLE) * whole), whole - 1) AS HUGEINT) AS at
        FROM {_scrambled('places', {n: ('pick', str(k)) for k, n in enumerate(('u1', 'u2', 'n1', 'n2'))})}""",
    "conditional": f"""SELECT p.*, draw_id, hu, mu, mu + sigma * {_normal('n1', 'n2')} AS pred FROM placed p ASOF JOIN weighed w
        ON {' AND '.join(f'p.{k} = w.{k}' for k in CELL_KEY)} AND p.at >= w.at""",
    # diagnostics
    # Each chain in the order of its iterations: the first and the last half, without the middle draw of an odd length.
    "halves": """SELECT * FROM (SELECT *, concat(chain, CASE WHEN row_number() OVER c <= count(*) OVER d // 2 THEN ' early'
        WHEN row_number() OVER c > count(*) OVER d - count(*) OVER d // 2 THEN ' late' END) AS half,
        row_number() OVER c <= count(*) OVER d // 2 OR row_number() OVER c > count(*) OVER d - count(*) OVER d // 2 AS taken
        FROM draws_long WINDOW d AS (PARTITION BY experiment, condition, model_name, parameter, chain),
        c AS (PARTITION BY experiment, condition, model_name, parameter, chain ORDER BY iteration)) WHERE taken""",
    "split_rhat": """SELECT experiment, condition, model_name, parameter, CASE WHEN avg(v) > 0 THEN
        sqrt(((max(n) - 1) / max(n) * avg(v) + var_samp(m)) / avg(v)) END AS rhat FROM (
          SELECT experiment, condition, model_name, parameter, half, avg(value) AS m, var_samp(value) AS v, count(*)::DOUBLE AS n
          FROM halves GROUP BY ALL) GROUP BY ALL""",
    "middle": """SELECT experiment, condition, model_name, parameter,
        (max(value) FILTER (p = (n + 1) // 2) + max(value) FILTER (p = n // 2 + 1)) / 2 AS med FROM (
          SELECT *, row_number() OVER (PARTITION BY experiment, condition, model_name, parameter ORDER BY value) AS p,
            count(*) OVER (PARTITION BY experiment, condition, model_name, parameter) AS n FROM halves) GROUP BY ALL""",
    "forms": """SELECT experiment, condition, model_name, parameter, half, 'bulk' AS form, value AS x FROM halves UNION ALL
        SELECT experiment, condition, model_name, parameter, half, 'fold', abs(value - med) FROM halves
        JOIN middle USING (experiment, condition, model_name, parameter)""",
    "ranks": """SELECT *, (rank() OVER w + (count(*) OVER (w RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0e0 - 0.375e0)
        / (count(*) OVER (PARTITION BY experiment, condition, model_name, parameter, form) + 0.25e0) AS p FROM forms
        WINDOW w AS (PARTITION BY experiment, condition, model_name, parameter, form ORDER BY x)""",
    "rank_rhat": f"""SELECT experiment, condition, model_name, parameter, max(r) AS rhat FROM (
        SELECT experiment, condition, model_name, parameter, form, CASE WHEN bool_or(differs) THEN
          sqrt(((max(n) - 1) / max(n) * avg(v) + var_samp(m)) / avg(v)) END AS r FROM (
          SELECT experiment, condition, model_name, parameter, form, half, avg(z) AS m, var_samp(z) AS v, count(*)::DOUBLE AS n,
            min(p) <> max(p) AS differs
          FROM (SELECT *, {qnorm('p')} AS z FROM ranks) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""",
    # evidence
    "four": """SELECT *, CAST(cond = 'present' AS INT) AS shown FROM mframe,
        (VALUES ('simple', 0, 0), ('contrast', 1, 0), ('hurdle', 0, 1), ('full', 1, 1)) AS m(model_name, in_mu, in_hu)""",
    "density": f"""SELECT *, CASE WHEN response = 0 THEN ln(hu)
        ELSE ln(1 - hu) - 0.5e0 * ((response - mu) / 0.06e0) ** 2 - ln(0.06e0) - {LOG_2PI / 2}::DOUBLE END AS lp FROM (
          SELECT *, 0.05e0 + 0.8e0 * stim + 0.01e0 * in_mu * shown AS mu,
            1 / (1 + exp(-(0.6e0 - 20e0 * stim - 0.3e0 * in_hu * shown))) AS hu FROM four)""",
    "logml": """SELECT experiment, bias_source AS condition, model_name AS model, sum(lp) AS logml FROM density GROUP BY ALL""",
    "bf": """SELECT a.experiment, a.condition, a.model, b.model AS denominator, a.logml - b.logml AS bf_log
        FROM logml a JOIN logml b USING (experiment, condition)
        WHERE b.model = 'simple' OR (b.model = 'contrast' AND a.model IN ('contrast', 'hurdle'))""",
    # effect regression
    "full_hurdle": """SELECT experiment, participant, bias_source, cond, contrast_level, avg(hurdle_prob) AS hurdle_prob
        FROM predicted WHERE model_name = 'full' GROUP BY ALL""",
    "not_present": """SELECT experiment, participant, bias_source, bias_direction AS cond, contrast_level,
        avg(1 - CAST(answer = 'present' AS INT)) AS answer FROM det GROUP BY ALL""",
    "both_tasks": """SELECT * FROM full_hurdle FULL JOIN not_present
        USING (experiment, participant, bias_source, cond, contrast_level)""",
    "shrunk": """SELECT * EXCLUDE (k, hurdle_prob, answer), 0.5 + k * (0.5 - hurdle_prob) AS h, 0.5 + k * (0.5 - answer) AS a
        FROM both_tasks JOIN (SELECT experiment, CASE WHEN max(answer) = 1 OR min(answer) = 0 OR max(hurdle_prob) = 1
          OR min(hurdle_prob) = 0 THEN 0.95e0 ELSE 1e0 END AS k FROM both_tasks GROUP BY 1) USING (experiment)""",
    "points": """SELECT experiment, participant, bias_source, contrast_level,
        max(ln(h / (1 - h))) FILTER (cond = 'present') - max(ln(h / (1 - h))) FILTER (cond = 'control') AS hurdle_prob,
        max(ln(a / (1 - a))) FILTER (cond = 'present') - max(ln(a / (1 - a))) FILTER (cond = 'control') AS answer
        FROM shrunk GROUP BY ALL""",
    "fit": """SELECT *, sqrt(greatest(syy - slope * slope * sxx, 0) / df) AS sigma,
        sqrt(greatest(syy - slope * slope * sxx, 0) / df) / sqrt(sxx) AS se FROM (
          SELECT experiment, bias_source, CAST(regr_count(hurdle_prob, answer) AS BIGINT) AS n, CAST(regr_count(hurdle_prob, answer) AS BIGINT) - 2 AS df,
            regr_slope(hurdle_prob, answer) AS slope, regr_intercept(hurdle_prob, answer) AS intercept,
            regr_r2(hurdle_prob, answer) AS r2, regr_sxx(hurdle_prob, answer) AS sxx, regr_syy(hurdle_prob, answer) AS syy,
            regr_avgx(hurdle_prob, answer) AS x_mean FROM points GROUP BY ALL)""",
}


def _pairs(source, first="control", second="present", keys="experiment, participant, bias_source, contrast_level", by="bias_direction"):
    return (
        f"SELECT {keys}, max(value) FILTER ({by} = '{first}') - max(value) FILTER ({by} = '{second}') AS diff"
        f" FROM {source} GROUP BY ALL"
    )


def _paired(source, first="control", second="present"):
    return f"""SELECT experiment, bias_source, contrast_level, count(diff) AS n_pairs, count(*) - count(diff) AS n_dropped,
        avg(diff) AS mean_diff, stddev_samp(diff) AS sd_diff,
        avg(diff) / nullif(stddev_samp(diff), 0) * sqrt(count(diff)) AS t, -avg(diff) / nullif(stddev_samp(diff), 0) AS d
        FROM ({_pairs(source, first, second)}) GROUP BY ALL"""


def _paired_bf(source, first="control", second="present"):
    """Two nested sums: trapezoid over the root v of the scale, Simpson over the negative scaled effects near a."""
    return f"""
    g AS ({_paired(source, first, second)}),
    ys AS (SELECT *, CAST(n_pairs - 1 AS DOUBLE) AS nu, sqrt(sqrt(n_pairs - 1) + 14) * i / 400 AS v
           FROM g, range(1, 401) r(i) WHERE t IS NOT NULL),
    yw AS (SELECT *, 2 * v * exp(nu * ln(v * v) - v ** 4 / 2 - nu / 2 * ln(nu) + nu / 2) AS w, t * v * v / sqrt(nu) AS a FROM ys),
    ends AS (SELECT *, least(a, 0) - 9 AS lo, least(a + 9, 0) AS hi, 0.707e0 * sqrt(n_pairs) AS width FROM yw),
    us AS (SELECT i / 800e0 AS f, CASE WHEN i IN (0, 800) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 2400e0 AS wt FROM range(0, 801) r(i)),
    top AS (SELECT experiment, bias_source, contrast_level, sum(wt * w * (hi - lo) * exp(-0.5e0 * pow(lo + (hi - lo) * f - a, 2))
              * 2 / (pi() * width * (1 + pow((lo + (hi - lo) * f) / width, 2)))) AS s FROM ends, us GROUP BY ALL),
    bottom AS (SELECT experiment, bias_source, contrast_level, sum(w * (1 + t * t / nu) ** (-(nu + 1) / 2)) AS s FROM yw GROUP BY ALL),
    paired_bf AS (SELECT g.*, ln(top.s / bottom.s) AS log_bf FROM g
            LEFT JOIN top USING (experiment, bias_source, contrast_level)
            LEFT JOIN bottom USING (experiment, bias_source, contrast_level))"""


def _t_quantiles(source):
    """0.975 quantiles for the degrees of freedom that occur, from the integrated density."""
    return f"""
    dfs AS (SELECT DISTINCT CAST(n - 1 AS DOUBLE) AS df FROM {source} WHERE n > 1),
    grid AS (SELECT df, i * 0.0005e0 AS x,
        exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (1 + (i * 0.0005e0) ** 2 / df) ** (-(df + 1) / 2) AS f
        FROM dfs, range(0, 30001) r(i)),
    area AS (SELECT df, x, f, 0.5 + sum(f) OVER (PARTITION BY df ORDER BY x) * 0.0005e0
        - 0.00025e0 * (f + first_value(f) OVER (PARTITION BY df ORDER BY x)) AS c FROM grid),
    tq AS (SELECT df, max(x + (0.975 - c) / f) FILTER (c <= 0.975) AS q FROM area GROUP BY df)"""


def _number(x, digits=2):
    text = f"regexp_replace(regexp_replace(printf('%.{digits}f', {x}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    return f"CASE WHEN {text} = '-0' THEN '0' ELSE {text} END"


PARTS.update(fit_oracle.PARTS)


def statement(body, extra=""):
    """The body with the shared subqueries it uses, directly or through others."""
    wanted, queue = set(), [body + extra]
    while queue:
        text = queue.pop()
        for name, sql in PARTS.items():
            if name not in wanted and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                queue.append(sql)
    recursive = "RECURSIVE " if "fitrounds" in wanted or "ranksums AS" in extra else ""
    ctes = [f"{name} AS ({sql})" for name, sql in PARTS.items() if name in wanted]
    if extra:
        ctes.append(extra)
    return f"WITH {recursive}{', '.join(ctes)} {body}" if ctes else body


P3 = "experiment, participant, bias_source"
CELL5 = f"{P3}, bias_direction, contrast_level"
COND3 = "experiment, bias_source, contrast_level"
DESIGN6 = f"{P3}, cond, contrast_level, stim"
FITP = "experiment, condition, model_name, parameter"
BOUNDS = ", ".join(f"round({c}, 6) AS {c}" for c in ("value", "mean", "upper_boundary", "lower_boundary"))
TRIAL_OUT = """experiment, participant, bias_source, bias_direction, contrast_level, trial_type, trial_index,
    round(target_contrast, 9) AS target_contrast, round(try_cast(answer AS DOUBLE), 9) AS answer_num"""


def _signed_rank(value):
    """Sums of ranks per group, and in `ranksums` the chance of each doubled sum of positive ranks, rank after rank."""
    return f"""cr AS (SELECT * REPLACE ({value} AS value) FROM nz), pr AS ({_pairs('cr')}),
    rk AS (SELECT *, rank() OVER w + (ties - 1) / 2.0e0 AS r, count(*) FILTER (diff <> 0) OVER (PARTITION BY {COND3}) AS n,
        row_number() OVER (PARTITION BY {COND3}, coalesce(diff, 0) <> 0 ORDER BY abs(diff), participant) AS place
        FROM (SELECT *, count(*) OVER (PARTITION BY {COND3}, abs(diff)) AS ties FROM pr)
        WINDOW w AS (PARTITION BY {COND3}, coalesce(diff, 0) <> 0 ORDER BY abs(diff))),
    ranksums AS (SELECT DISTINCT {COND3}, 0::BIGINT AS place, 0 AS w, 1e0 AS mass FROM rk WHERE n <= 50
        UNION ALL SELECT a.experiment, a.bias_source, a.contrast_level, b.place, a.w + s * CAST(2 * b.r AS INT) AS w, sum(a.mass) / 2 FROM ranksums a
        JOIN rk b ON (a.experiment, a.bias_source, a.contrast_level, a.place + 1) = (b.experiment, b.bias_source, b.contrast_level, b.place)
        JOIN (VALUES (0), (1)) AS c(s) ON b.diff <> 0 GROUP BY ALL),
    sr AS (SELECT {COND3}, n, count(*) FILTER (diff = 0) AS n_zero, count(*) - count(diff) AS n_dropped,
        coalesce(sum(r) FILTER (diff > 0), 0) AS w_plus, coalesce(sum(r) FILTER (diff < 0), 0) AS w_minus,
        (coalesce(sum(r) FILTER (diff > 0), 0) - n * (n + 1) / 4.0e0) /
          sqrt(nullif(n * (n + 1) * (2 * n + 1) / 24.0e0 - coalesce(sum(ties * ties - 1) FILTER (diff <> 0), 0) / 48.0e0, 0)) AS z
        FROM rk GROUP BY {COND3}, n),
    tails AS (SELECT {COND3}, sum(mass) FILTER (w <= 2 * w_plus) AS less, sum(mass) FILTER (w >= 2 * w_plus) AS greater
        FROM ranksums JOIN sr USING ({COND3}) WHERE place = n GROUP BY ALL)"""


SIGNED_RANK = f"""SELECT {COND3}, n_zero, n_dropped, n AS n_pairs, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(z, 6) AS z, n <= 50 AS exact,
    round(CASE WHEN n <= 50 THEN less ELSE {ncdf('z')} END, 6) AS p_less, round(CASE WHEN n <= 50 THEN greater ELSE {ncdf('(-z)')} END, 6) AS p_greater
    FROM sr LEFT JOIN tails USING ({COND3})"""


def _rounded(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _mean_ci(source, keys, value):
    """Statement parts for mean and t interval of `value` per key."""
    extra = f"""stats AS (SELECT {keys}, count({value}) AS n, avg({value}) AS y, stddev_samp({value}) AS s FROM {source} GROUP BY ALL),
    {_t_quantiles('stats')}"""
    body = f"""SELECT {keys}, n, round(y, 6) AS y, round(y - q * s / sqrt(n), 6) AS ymin, round(y + q * s / sqrt(n), 6) AS ymax
        FROM stats LEFT JOIN tq ON df = n - 1"""
    return extra, body


def _effect_ci(source, unit, keys, value):
    """The same for the present minus control effect within `unit`."""
    pairs = f"""(SELECT {unit}, max({value}) FILTER (cond = 'present') - max({value}) FILTER (cond = 'control') AS diff
        FROM {source} GROUP BY ALL)"""
    return _mean_ci(pairs, keys, "diff")


def _histogram(where, value, width, facets, source):
    half = width / 2
    return f"""SELECT {facets}, bin, count(*) AS n, round(bin * {width}e0, 9) AS centre FROM (
        SELECT *, CAST(ceil(({value} - {half}e0) / {width}e0 - 1e-8) AS BIGINT) AS bin FROM {source} {where}) GROUP BY ALL"""


def _build():
    o = {}
    o["participant_counts"] = statement(
        "SELECT experiment, bias_source, count(DISTINCT participant) AS n FROM trials GROUP BY ALL"
    )
    o["trial_counts"] = statement(
        f"""SELECT DISTINCT experiment, bias_source, n_trials FROM
        (SELECT {P3}, count(*) AS n_trials FROM trials GROUP BY ALL)"""
    )
    o["start_direction_balance"] = statement(
        f"""SELECT experiment, bias_source, nullif(count(*) FILTER (bias_direction = 'control'), 0) AS control,
        nullif(count(*) FILTER (bias_direction = 'present'), 0) AS present FROM (
          SELECT * FROM trials QUALIFY row_number() OVER (PARTITION BY {P3} ORDER BY trial_index) = 1) GROUP BY ALL"""
    )
    o["staircase_outliers"] = statement(f"SELECT {P3}, {BOUNDS} FROM stair_out")
    o["low_dprime"] = statement(f"SELECT {P3}, bias_direction, round(d, 6) AS d FROM low")
    o["dprime_outliers"] = statement(f"SELECT {P3}, bias_direction, {BOUNDS} FROM d_out")
    o["reproduction_outliers"] = statement(f"SELECT {P3}, bias_direction, {BOUNDS} FROM err_out")
    o["reproduction_error"] = statement(f"SELECT {P3}, bias_direction, round(value, 9) AS value FROM err")
    o["exclusion_summary"] = statement("SELECT experiment, bias_source, count(*) AS n FROM bad GROUP BY ALL")
    o["excluded_trials"] = statement(
        f"SELECT {TRIAL_OUT} FROM trials WHERE (experiment, participant, bias_source) NOT IN (SELECT ({P3}) FROM bad)"
    )
    o["confusion_counts"] = statement("SELECT * FROM conf")
    o["confusion_keys"] = statement(
        """SELECT experiment, bias_source, concat(CASE WHEN (contrast_level = 'absent') = (answer = 'absent') THEN 'true'
        ELSE 'false' END, '_', answer) AS conf_mat, count(*) AS n FROM det GROUP BY ALL"""
    )
    o["sdt_measures"] = statement(
        f"""SELECT {P3}, bias_direction, hits, misses, correct_rejections, false_alarms,
        {_rounded('hr fr')}, round("lambda", 6) AS "lambda", {_rounded('d ccrit beta')} FROM sdt"""
    )
    o["proportion_present"] = statement(f"SELECT {CELL5}, round(value, 9) AS proportion_present FROM present_share")
    o["mean_reproduction"] = statement(f"SELECT {CELL5}, round(value, 9) AS reproduction FROM mean_answer")
    o["proportion_zero"] = statement(f"SELECT {CELL5}, round(value, 9) AS prop_zero FROM zero_share")
    o["proportion_zero_ceiling"] = statement(
        f"SELECT {CELL5}, round(1 - avg(ceil(a)), 9) AS prop_zero FROM rep GROUP BY ALL"
    )
    o["median_nonzero"] = statement(f"SELECT {CELL5}, round(value, 9) AS value FROM nz")
    o["mean_nonzero"] = statement(
        f"SELECT {CELL5}, round(avg(a) FILTER (a <> 0), 9) AS value FROM rep GROUP BY ALL"
    )
    keys = "experiment, bias_source, bias_direction, contrast_level"
    o["summary_mean_se"] = statement(
        f"""SELECT {keys}, n, round(y, 12) AS y, round(y - s / sqrt(n), 12) AS ymin, round(y + s / sqrt(n), 12) AS ymax FROM (
        SELECT {keys}, count(*) AS n, avg(value) AS y, stddev_samp(value) AS s FROM nz GROUP BY ALL)"""
    )
    extra, body = _mean_ci("mean_answer", keys, "value")
    o["summary_mean_ci"] = statement(body, extra)
    o["empty_cells"] = statement("SELECT * FROM sides WHERE n_control = 0 OR n_present = 0")
    o["empty_cell_counts"] = statement(
        f"SELECT {COND3}, count(*) AS n FROM sides WHERE n_control = 0 OR n_present = 0 GROUP BY ALL"
    )
    o["nonzero_complete_pairs"] = statement(f"SELECT {CELL5}, round(value, 9) AS value FROM complete")
    o["nonzero_wide"] = statement(
        f"""SELECT {P3}, contrast_level, round(max(value) FILTER (bias_direction = 'control'), 9) AS control,
        round(max(value) FILTER (bias_direction = 'present'), 9) AS present FROM complete GROUP BY ALL"""
    )
    facets = "experiment, bias_source, contrast_level, bias_direction"
    o["reproduction_histogram"] = statement(_histogram("WHERE a IS NOT NULL", "a", 0.003, facets, "rep"))
    o["reproduction_histogram_limits"] = statement(_histogram("WHERE a BETWEEN 0 AND 0.14e0", "a", 0.003, facets, "rep"))
    o["axis_grid"] = statement(
        """SELECT experiment, tick, round(lo + tick * 0.025e0, 9) AS position FROM (
        SELECT experiment, lo, CAST(unnest(range(0, CAST(floor((hi - lo) / 0.025e0 + 1e-10) AS BIGINT) + 1)) AS INT) AS tick FROM (
          SELECT experiment, min(value) AS lo, max(value) AS hi FROM mean_answer GROUP BY 1))"""
    )
    o["source_labels"] = statement(
        """SELECT experiment, bias_source, n, concat(coalesce(label, 'NA'), ' (N=', coalesce(CAST(n AS VARCHAR), 'NA'), ')') AS label
        FROM (SELECT experiment, bias_source, count(DISTINCT participant) AS n FROM trials GROUP BY ALL) c
        FULL JOIN (SELECT DISTINCT t.experiment, l.s AS bias_source, l.label FROM trials t,
          (VALUES ('cue', 'Att. cue'), ('payoff', 'Payoff'), ('baserate', 'Base rate')) AS l(s, label)) e
        USING (experiment, bias_source)"""
    )
    o["condition_labels"] = statement(
        """SELECT condition_code, CAST(list_position(['baserate_control', 'baserate_present', 'cue_control', 'cue_present',
          'payoff_control', 'payoff_present'], condition_code) AS INT) AS condition_code_ord,
        stim_code, CAST(list_position(['control_absent', 'present_absent', 'control_low', 'present_low', 'control_high',
          'present_high'], stim_code) AS INT) AS stim_code_ord,
        bias_source, CAST(list_position(['cue', 'baserate', 'payoff'], bias_source) AS INT) AS bias_source_ord,
        contrast_level, CAST(list_position(['absent', 'low', 'high'], contrast_level) AS INT) AS contrast_level_ord,
        CASE contrast_level WHEN 'absent' THEN 'Absent' WHEN 'low' THEN 'Low contrast' ELSE 'High contrast' END AS level_label,
        count(*) AS n FROM (SELECT *, concat(bias_source, '_', bias_direction) AS condition_code,
          concat(bias_direction, '_', contrast_level) AS stim_code FROM trials) GROUP BY ALL"""
    )
    o["paired_effect_size"] = statement(
        f"SELECT {COND3}, n_pairs, n_dropped, {_rounded('mean_diff sd_diff t d')} FROM ({_paired('present_share')})"
    )
    o["paired_bayes_factor"] = statement(
        f"SELECT {COND3}, n_pairs, n_dropped, {_rounded('t d log_bf')} FROM paired_bf", _paired_bf("present_share")
    )
    o["paired_bayes_factor_zero"] = statement(
        f"SELECT {COND3}, n_pairs, {_rounded('t d log_bf')} FROM paired_bf", _paired_bf("zero_share", "present", "control")
    )
    text = f"""CASE WHEN bf <= 1 THEN {_number('bf')} WHEN round_even(bf, 0) > 999 THEN printf('%.1e', bf)
        WHEN round_even(bf, 0) > 1 THEN printf('%.0f', CAST(round_even(bf, 0) AS DOUBLE)) ELSE {_number('bf')} END"""
    o["bf_labels"] = statement(
        f"""SELECT {COND3}, bf_lab, d_lab, 'atop(' || bf_lab || ', ' || d_lab || ')' AS label FROM (
        SELECT {COND3}, 'bold(BF[10]) == "' || ({text}) || '"' AS bf_lab, 'italic(d) == ' || ({_number('d')}) AS d_lab
        FROM (SELECT *, exp(log_bf) AS bf FROM paired_bf))""",
        _paired_bf("mean_answer"),
    )
    o["signed_rank"] = statement(SIGNED_RANK, _signed_rank("round(value, 9) * 1e9"))
    o["signed_rank_flat"] = statement(
        SIGNED_RANK, _signed_rank("CASE WHEN bias_source = 'cue' AND contrast_level = 'absent' THEN 0 ELSE round(value, 9) * 1e9 END")
    )
    o["observed_cells"] = statement(f"SELECT {DESIGN6.replace('stim', 'round(stim, 9) AS stim')}, {_rounded('response_non_zero prop_zero response', 9)} FROM obs")
    extra, body = _effect_ci("obs", f"{P3}, contrast_level, stim", COND3, "response")
    o["observed_effect"] = statement(body, extra)
    o["design_rows"] = statement(f"SELECT {DESIGN6.replace('stim', 'round(stim, 9) AS stim')} FROM design")
    grid = """SELECT DISTINCT experiment, bias_source AS condition, model_name FROM trials,
        (VALUES ('simple'), ('contrast'), ('hurdle'), ('full')) AS m(model_name)"""
    o["key_grid"] = statement(grid)
    o["missing_keys"] = statement(f"{grid} EXCEPT SELECT experiment, condition, model_name FROM draws_long")
    timed = f"SELECT {TRIAL_OUT}, concat(CAST(trial_index % 977 AS VARCHAR), ' ms') AS rt FROM trials"
    o["write_read_filtered"] = o["read_raw_trials"] = statement(timed)
    o["read_mixed_headers"] = statement(timed.replace("concat(", "CASE WHEN experiment = 'exp2' THEN concat(").replace("AS rt", "END AS rt"))
    o["read_filtered_one"] = statement(f"SELECT {TRIAL_OUT} FROM trials WHERE experiment = 'exp2'")
    o["keyed_round_trip"] = statement("SELECT experiment, condition, model, denominator, round(bf_log, 3) AS bf_log FROM bf")
    o["hurdle_loglik"] = statement(
        f"SELECT {P3}, model_name, round(sum(lp), 6) AS loglik, count(lp) AS n FROM density GROUP BY ALL"
    )
    cell = f"{P3}, cond, contrast_level, round(stim, 6) AS stim, model_name"
    by_cell = f"GROUP BY {P3}, cond, contrast_level, scored.stim, model_name"
    o["score_draws"] = statement(
        f"""SELECT {cell}, count(*) AS n, round(avg(mu), 6) AS mu, round(avg(hu), 6) AS hu, round(avg(sigma), 6) AS sigma,
        round(min(mu), 6) AS mu_low, round(max(mu), 6) AS mu_high FROM scored {by_cell}"""
    )
    o["predict_expected"] = statement(
        f"SELECT {cell}, {_rounded('response_pred hurdle_prob response_pred_non_zero response_pred_gaussian')} FROM predicted"
    )
    numbers = _scrambled("seeded", {n: ("draw_id", f"{STREAM} + {k}") for k, n in enumerate(("u", "n1", "n2"))})
    o["predict_sampled"] = statement(
        f"""SELECT {cell}, round(avg(p), 6) AS response_pred, round(1 - avg(CAST(p > 0 AS INT)), 6) AS hurdle_prob,
        round(avg(p) FILTER (p > 0), 6) AS response_pred_non_zero FROM (
          SELECT *, CASE WHEN {_uniform('u')} < hu THEN 0 ELSE mu + sigma * {_normal('n1', 'n2')} END AS p FROM {numbers}) AS scored
        {by_cell}""",
        f"seeded AS (SELECT *, {_seed('response', 11, *CELL_KEY[:-1])} AS cell_seed FROM scored)",
    )
    o["predictive_check"] = statement(
        f"""SELECT {cell}, {_rounded('response_pred hurdle_prob response_pred_non_zero response_non_zero prop_zero response', 9)}
        FROM predicted FULL JOIN (SELECT * FROM obs, (VALUES ('simple'), ('contrast'), ('hurdle'), ('full')) AS m(model_name))
        USING ({DESIGN6}, model_name)"""
    )
    o["predictive_round_trip"] = o["predictive_check"]
    extra, body = _effect_ci(
        "predicted", f"{P3}, contrast_level, stim, model_name", f"{COND3}, model_name", "response_pred"
    )
    o["predicted_effect"] = statement(f"{body} WHERE model_name <> 'simple'", extra)
    o["conditional_draws"] = statement(
        f"""SELECT {cell}, count(*) AS n, count(DISTINCT draw_id) AS n_draws, round(avg(pred), 6) AS pred,
        round(avg(hu), 6) AS hu FROM conditional AS scored {by_cell}"""
    )
    extra, body = _effect_ci("means", f"{P3}, contrast_level, model_name", f"{COND3}, model_name", "value")
    o["perceived_contrast_effect"] = statement(
        body,
        f"means AS (SELECT {P3}, cond, contrast_level, model_name, avg(pred) AS value FROM conditional GROUP BY ALL), {extra}",
    )
    rows = []
    for source, kind in (
        (f"(SELECT {P3}, cond, contrast_level, avg(pred) AS value FROM conditional WHERE model_name = 'full' GROUP BY ALL)", "predicted"),
        (f"(SELECT {P3}, cond, contrast_level, avg(response) AS value FROM mframe WHERE response <> 0 GROUP BY ALL)", "empirical"),
    ):
        rows.append(f"SELECT *, '{kind}' AS data_type FROM {source}")
    both = " UNION ALL ".join(rows)
    stats, body = _effect_ci("tagged", f"{P3}, contrast_level, data_type", f"{COND3}, data_type", "value")
    o["perceived_vs_observed_effect"] = statement(body, f"tagged AS ({both}), {stats}")
    o["predicted_nonzero_means"] = statement(
        """SELECT experiment, bias_source, cond, contrast_level, model_name, n, round(y, 6) AS y, round(y - s / sqrt(n), 6) AS ymin,
        round(y + s / sqrt(n), 6) AS ymax FROM (SELECT experiment, bias_source, cond, contrast_level, model_name, count(*) AS n,
          avg(value) AS y, stddev_samp(value) AS s FROM means GROUP BY ALL)""",
        f"means AS (SELECT {P3}, cond, contrast_level, model_name, avg(pred) AS value FROM conditional GROUP BY ALL)",
    )
    o["reproduction_error_strict"] = statement(
        f"""SELECT {P3}, bias_direction, CASE WHEN count(*) FILTER (trial_index % 97 = 0) = 0
        THEN round(avg(abs(target_contrast) - a), 9) END AS value FROM rep GROUP BY ALL"""
    )
    wide = "(SELECT experiment, avg(value) AS m, 4 * stddev_samp(value) AS s FROM {0} GROUP BY 1) b USING (experiment) WHERE abs(value - m) >= b.s"
    o["exclusion_summary_default"] = statement(
        "SELECT experiment, bias_source, count(*) AS n FROM (SELECT DISTINCT experiment, participant, bias_source FROM gone) GROUP BY ALL",
        f"""s4 AS (SELECT t.* FROM stair t JOIN {wide.format('stair')}), k1 AS (SELECT * FROM sdt WHERE participant NOT IN (SELECT participant FROM s4)),
        l4 AS (SELECT * FROM k1 WHERE d <= 0), k2 AS (SELECT *, d AS value FROM k1 WHERE participant NOT IN (SELECT participant FROM l4)),
        d4 AS (SELECT t.* FROM k2 t JOIN {wide.format('k2')}),
        k3 AS (SELECT * FROM err WHERE participant NOT IN (SELECT participant FROM s4 UNION SELECT participant FROM l4 UNION SELECT participant FROM d4)),
        e4 AS (SELECT t.* FROM k3 t JOIN {wide.format('k3')}),
        gone AS (SELECT {P3} FROM s4 UNION SELECT {P3} FROM l4 UNION SELECT {P3} FROM d4 UNION SELECT {P3} FROM e4)""",
    )
    o["short_cells"] = statement(f"SELECT {DESIGN6}, model_name, count(*) AS n FROM scored GROUP BY ALL HAVING count(*) < 100")
    o["sample_per_cell"] = statement(
        f"""SELECT {CELL5}, trial_index FROM trials QUALIFY row_number() OVER
        (PARTITION BY {CELL5} ORDER BY {_md5('sample', 3, 'trial_index')}, trial_index) <= 2"""
    )
    o["rhat_split"] = statement(f"SELECT {FITP}, round(rhat, 6) AS rhat FROM split_rhat")
    o["rhat_file_round_trip"] = o["rhat_split"]
    o["rhat_rank"] = statement(f"SELECT {FITP}, round(rhat, 6) AS rhat FROM rank_rhat")
    o["rhat_gate"] = statement(
        """SELECT experiment, condition, model_name, count(*) AS n_parameters, count(*) FILTER (rhat > 1.02) AS n_high,
        round(max(rhat), 6) AS max_rhat, bool_and(rhat < 1.02) AS passed FROM split_rhat GROUP BY ALL"""
    )
    o["high_rhat"] = statement(f"SELECT {FITP}, round(rhat, 6) AS rhat FROM split_rhat WHERE rhat > 1.02")
    o["trace"] = statement(f"SELECT {FITP}, chain, iteration, round(value, 9) AS value FROM draws_long WHERE iteration % 5 = 0")
    o["trace_density"] = statement(_histogram("", "value", 0.5, f"{FITP}, chain", "draws_long"))
    o["model_bf"] = statement("SELECT experiment, condition, model, denominator, round(bf_log, 3) AS bf_log FROM bf")
    o["model_bf_rebase"] = statement(
        """SELECT experiment, condition, a.model, 'contrast' AS denominator, round(a.bf_log - b.bf_log, 3) AS bf_log
        FROM bf a JOIN bf b USING (experiment, condition)
        WHERE a.denominator = 'simple' AND b.denominator = 'simple' AND b.model = 'contrast'"""
    )
    shown = "round(bf_log, 3) AS bf_log, round(asinh(bf_log / 2), 3) AS bf_pseudo_log"
    o["model_baseline"] = statement(
        f"""SELECT experiment, condition, CAST(list_position(['cue', 'baserate', 'payoff'], condition) AS INT) AS condition_ord,
        model, CAST(list_position(['contrast', 'hurdle', 'full'], model) AS INT) AS model_ord, denominator, {shown}
        FROM bf WHERE denominator = 'simple' AND model <> 'simple'"""
    )
    numbers = """n b_intercept b_stim b_cond b_stim_cond sigma hu_intercept hu_stim hu_cond hu_stim_cond sd_intercept sd_cond cor
        hu_sd_intercept hu_sd_cond hu_cor loglik df logdet bic logml"""
    o["hurdle_fit"] = statement(
        f"SELECT experiment, bias_source, model_name, {_rounded(numbers, 4)}, converged, CAST(iterations AS INT) AS iterations FROM fits"
    )
    o["hurdle_fit_evidence"] = statement(
        """SELECT experiment, condition, CAST(list_position(['payoff', 'baserate', 'cue'], condition) AS INT) AS condition_ord,
        'hurdle' AS model, 'contrast' AS denominator, CASE WHEN bf < 0 THEN 'contrast' WHEN bf > 0 THEN 'hurdle' END AS evidence,
        round(bf, 4) AS bf_log, round(asinh(bf / 2), 4) AS bf_pseudo_log
        FROM (SELECT a.experiment, a.bias_source AS condition, a.logml - b.logml AS bf FROM fits a JOIN fits b
          USING (experiment, bias_source) WHERE a.model_name = 'hurdle' AND b.model_name = 'contrast')"""
    )
    o["model_evidence"] = statement(
        f"""SELECT experiment, condition, CAST(list_position(['payoff', 'baserate', 'cue'], condition) AS INT) AS condition_ord,
        model, denominator, CASE WHEN bf_log < 0 THEN 'contrast' WHEN bf_log > 0 THEN 'hurdle' END AS evidence, {shown}
        FROM bf WHERE denominator = 'contrast' AND model = 'hurdle'"""
    )
    measures = "round(hurdle_prob, 9) AS hurdle_prob, round(answer, 9) AS answer"
    o["hurdle_detection_cells"] = statement(f"SELECT {P3}, cond, contrast_level, {measures} FROM both_tasks")
    o["detection_vs_hurdle"] = statement(
        """SELECT experiment, bias_source, cond, contrast_level, round(avg(hurdle_prob), 9) AS hurdle_prob,
        round(avg(answer), 9) AS answer FROM both_tasks GROUP BY ALL"""
    )
    o["hurdle_detection_long"] = statement(
        """SELECT experiment, 'hurdle_prob' AS task, count(hurdle_prob) AS n, round(avg(hurdle_prob), 9) AS mean FROM both_tasks GROUP BY ALL
        UNION ALL SELECT experiment, 'answer', count(answer), round(avg(answer), 9) FROM both_tasks GROUP BY ALL"""
    )
    o["effect_logit"] = statement(f"SELECT {P3}, contrast_level, {_rounded('hurdle_prob answer')} FROM points")
    fit = "experiment, bias_source, n, df, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2"
    rounded_r2 = "CAST(round_even(r2, 2) AS DOUBLE) AS r2_rounded, round(se, 6) AS se"
    o["effect_regression"] = statement(f"SELECT {fit}, {rounded_r2} FROM fit")
    o["effect_regression_within"] = statement(
        f"""SELECT {fit}, {rounded_r2} FROM (
        SELECT *, ym - slope * xm AS intercept, sxy * sxy / (sxx * syy) AS r2,
          sqrt(greatest(syy - slope * sxy, 0) / nullif(greatest(df, 0), 0)) / sqrt(sxx) AS se FROM (
        SELECT experiment, bias_source, count(*) AS n, count(*) - count(DISTINCT participant) - 1 AS df, avg(y) AS ym, avg(x) AS xm,
          sum((x - mx) * (y - my)) / sum((x - mx) ** 2) AS slope, sum((x - mx) * (y - my)) AS sxy,
          sum((x - mx) ** 2) AS sxx, sum((y - my) ** 2) AS syy
        FROM (SELECT *, hurdle_prob AS y, answer AS x, avg(hurdle_prob) OVER w AS my, avg(answer) OVER w AS mx FROM points
              WHERE hurdle_prob IS NOT NULL AND answer IS NOT NULL WINDOW w AS (PARTITION BY {P3})) GROUP BY ALL))"""
    )
    o["regression_line"] = statement(
        """SELECT experiment, bias_source, round(x, 6) AS x, round(l, 6) AS y, round(l - q * e, 6) AS ymin, round(l + q * e, 6) AS ymax
        FROM (SELECT *, intercept + slope * x AS l, sigma * sqrt(1.0e0 / n + (x - x_mean) ** 2 / sxx) AS e FROM fit
          JOIN (SELECT DISTINCT experiment, bias_source, round(answer, 9) AS x FROM points WHERE answer IS NOT NULL) USING (experiment, bias_source)) f
        JOIN tq ON tq.df = f.df""",
        f"sizes AS (SELECT df + 1 AS n FROM fit), {_t_quantiles('sizes')}",
    )
    o["evidence_ratio"] = statement(
        f"""SELECT experiment, bias_source, round(({ncdf('z')}) / ({ncdf('y')}), 4) AS evidence_ratio FROM
        (SELECT *, slope / se AS z, -slope / se AS y FROM fit)"""
    )
    o["evidence_ratio_draws"] = statement(
        f"""SELECT *, round(n_positive / nullif(n_negative, 0)::DOUBLE, 6) AS evidence_ratio FROM (
        SELECT {P3}, model_name, count(*) FILTER (hu_cond + r_hu_cond > 0) AS n_positive, count(*) FILTER (hu_cond + r_hu_cond < 0) AS n_negative
        FROM draws_random JOIN draws_fixed USING (experiment, bias_source, model_name, draw_id) GROUP BY ALL)"""
    )
    o["bayes_r2"] = statement(
        """SELECT experiment, bias_source, model_name, round(avg(v / (v + s * s)), 6) AS r2 FROM (
        SELECT experiment, bias_source, model_name, draw_id, var_samp(mu) AS v, max(sigma) AS s FROM scored GROUP BY ALL) GROUP BY ALL"""
    )
    return o


ORACLE = _build()
