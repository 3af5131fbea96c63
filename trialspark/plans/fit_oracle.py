"""SQL for the hurdle fits: reweighted least squares and expectation-maximisation as a recursion over the cells, written with
windows alone."""

RIDGE, PEOPLE = "1e0", "2e0"
FIT = "experiment, bias_source, kind, with_cond"
PERSON = f"{FIT}, participant"
TOLERANCE, ROUNDS = "1e-5", 40

CELLS = """SELECT experiment, participant, bias_source, kind, with_cond, stim, CAST(cond = 'present' AND with_cond = 1 AS INT)::DOUBLE AS c,
    count(*)::DOUBLE AS n, (count(*) FILTER (response = 0))::DOUBLE AS zeros, (count(*) FILTER (response <> 0))::DOUBLE AS passed,
    coalesce(sum(response) FILTER (response <> 0), 0) AS sy, coalesce(sum(response * response) FILTER (response <> 0), 0) AS syy
    FROM mframe, (VALUES (0), (1)) AS k(with_cond), (VALUES ('hu'), ('mu')) AS l(kind) WHERE response IS NOT NULL
    GROUP BY experiment, participant, bias_source, kind, with_cond, cond, stim
    HAVING kind = 'hu' OR count(*) FILTER (response <> 0) > 0"""

# Sums over a participant's cells: of the regressors 1 and stim and of the target, alone and with the condition.
_SUMS = {"w": "1", "s": "stim", "q": "stim * stim", "z": "t", "zs": "t * stim"}
_XX = (("w", "s", "w1", "s1"), ("s", "q", "s1", "q1"), ("w1", "s1", "w1", "s1"), ("s1", "q1", "s1", "q1"))
_WX = (("w", "s", "w1", "s1"), ("w1", "s1", "w1", "s1"))
_XZ, _WZ = ("z", "zs", "z1", "zs1"), ("z", "z1")


def _through(left, right):
    (a, b), (c, d) = left, right
    return f"(v11 * {a} * {c} + v12 * ({a} * {d} + {b} * {c}) + v22 * {b} * {d})"


def _elimination(source):
    """Adds b0 .. b3, the solution of the symmetric system g, h; of its first two rows where there is no condition."""
    names = {(i, j): f"g{min(i, j)}{max(i, j)}" for i in range(4) for j in range(4)}
    for k in range(3):
        new = []
        for i in range(k + 1, 4):
            ratio = f"CASE WHEN with_cond = 1 OR {i} < 2 THEN {names[k, i]} / {names[k, k]} ELSE 0 END"
            new += [f"{names[i, j]} - ({ratio}) * {names[k, j]} AS {names[i, j]}_{k}" for j in range(i, 4)]
            new.append(f"h{i} - ({ratio}) * h{k} AS h{i}_{k}")
        # The reduced rows take the place of the old ones.
        old = [x.split(" AS ")[1].rsplit("_", 1)[0] for x in new]
        source = f"(SELECT * EXCLUDE ({', '.join(old)}), {', '.join(new)} FROM {source})"
        source = f"(SELECT * EXCLUDE ({', '.join(f'{x}_{k}' for x in old)}), {', '.join(f'{x}_{k} AS {x}' for x in old)} FROM {source})"
    for i in (3, 2, 1, 0):
        known = "".join(f" - {names[i, j]} * b{j}" for j in range(i + 1, 4))
        solved = f"(h{i}{known}) / {names[i, i]}"
        source = f"(SELECT *, {f'CASE WHEN with_cond = 1 THEN {solved} ELSE 0 END' if i > 1 else solved} AS b{i} FROM {source})"
    return source


def solved(source):
    """`source` (cells with weight wt, target t, fit f, and of their fit the covariance t11, t12, t22, the last residual variance
    s2 and parameters `used`) with the coefficients b0 .. b3 of each fit, the participant's effects u0 and u1 and the
    parameters u_df these use, the new residual variance and `total`, the log likelihood of the fit."""
    sums = [f"sum(wt * {x}) OVER p AS {k}, sum(wt * c * {x}) OVER p AS {k}1" for k, x in _SUMS.items()]
    over = f"OVER (PARTITION BY {FIT})"
    sql = f"""(SELECT *, {', '.join(sums)}, row_number() OVER p = 1 AS once, sum(f) {over} AS fit, sum(CASE kind WHEN 'hu' THEN n ELSE passed END) {over} AS size
        FROM {source} WINDOW p AS (PARTITION BY {PERSON}))"""
    sql = f"""(SELECT * REPLACE (CASE kind WHEN 'hu' THEN 1 ELSE (fit + s2 * used) / size END AS s2),
        CASE kind WHEN 'hu' THEN fit ELSE -size / 2 * (ln(2 * pi() * CASE kind WHEN 'mu' THEN fit ELSE 1 END / size) + 1) END AS total, t11 * t22 - t12 * t12 AS td FROM {sql})"""
    sql = f"(SELECT *, t22 / td AS p11, -t12 / td AS p12, t11 / td AS p22 FROM {sql})"
    a, b, d = "(w + p11)", "(w1 + p12)", "(w1 + p22)"
    sql = f"(SELECT *, {a} * {d} - {b} * {b} AS bd FROM {sql})"
    sql = f"(SELECT *, {d} / bd AS v11, -{b} / bd AS v12, {a} / bd AS v22 FROM {sql})"
    wx = [(_WX[0][i], _WX[1][i]) for i in range(4)]
    terms = [f"sum({_XX[i][j]} - {_through(wx[i], wx[j])}) FILTER (once) OVER f AS g{i}{j}" for i in range(4) for j in range(i, 4)]
    terms += [f"sum({_XZ[i]} - {_through(wx[i], _WZ)}) FILTER (once) OVER f AS h{i}" for i in range(4)]
    sql = _elimination(f"(SELECT *, {', '.join(terms)} FROM {sql} WINDOW f AS (PARTITION BY {FIT}))")
    rest = [f"{z} - ({' + '.join(f'{x} * b{j}' for j, x in enumerate(row))})" for z, row in zip(_WZ, _WX, strict=True)]
    sql = f"(SELECT *, {rest[0]} AS r0, {rest[1]} AS r1 FROM {sql})"
    return f"""(SELECT *, v11 * r0 + v12 * r1 AS u0, v12 * r0 + v22 * r1 AS u1, 2 - (p11 * v11 + 2 * p12 * v12 + p22 * v22) AS u_df,
        ln(g00) + ln(g11) + CASE WHEN with_cond = 1 THEN ln(abs(g22)) + ln(abs(g33)) ELSE 0 END AS schur FROM {sql})"""


PREDICTOR = "b0 + u0 + b1 * stim + (b2 + u1 + b3 * stim) * c"
RESIDUAL = "(syy - 2 * eta * sy + passed * eta * eta)"
_CHANCE = "(-ln(1 + exp(-abs(eta))))"
LOGLIK = f"(zeros * ({_CHANCE} + least(eta, 0)) + (n - zeros) * ({_CHANCE} - greatest(eta, 0)))"


def _next(covariance, product):
    """The covariance after a round, of the effects and what is not known of them."""
    start = "0" if covariance == "t12" else f"{PEOPLE} / {RIDGE}"
    return f"(sum({product} / s2 + {covariance.replace('t', 'v')}) FILTER (once) OVER f + {start}) / (count(*) FILTER (once) OVER f + {PEOPLE})"


_OWN = "experiment, participant, bias_source, kind, with_cond, stim, c, n, zeros, passed, sy, syy"
_FOUND = "b0, b1, b2, b3, u0, u1, u_df, p11, p12, p22, t11, t12, t22, bd, td, schur, s2"
_NEXT = f"""{_next('t11', 'u0 * u0')} AS n11, {_next('t12', 'u0 * u1')} AS n12, {_next('t22', 'u1 * u1')} AS n22, sum(u_df) FILTER (once) OVER f AS used"""
_ROWS = f"""(SELECT {_OWN}, round, eta, total AS before, 1 / (1 + exp(-eta)) AS p, n11 AS t11, n12 AS t12, n22 AS t22, s2, used
    FROM fitrounds WHERE NOT settled AND round < {ROUNDS})"""
_WEIGHED = f"""(SELECT *, CASE kind WHEN 'hu' THEN n * greatest(p * (1 - p), 1e-10) ELSE passed END AS wt,
    CASE kind WHEN 'hu' THEN {LOGLIK} ELSE {RESIDUAL} END AS f FROM {_ROWS})"""
_STEP = solved(f"(SELECT *, CASE kind WHEN 'hu' THEN eta + (zeros - n * p) / wt ELSE sy / passed END AS t FROM {_WEIGHED})")
_GAIN = "coalesce(2 * abs(total - before) / (2 * abs(total) + 0.1), 'Infinity'::DOUBLE)"

#: A row per cell and round: the predictor after the round, and the log likelihood before it.
ROUNDS_SQL = f"""SELECT {_OWN}, 0 AS round, 0e0 AS eta, NULL::DOUBLE AS total, 'Infinity'::DOUBLE AS change, false AS settled,
    {', '.join(f'0e0 AS {x.strip()}' for x in _FOUND.split(',')[:-1])}, 1e0 AS s2, 1 / {RIDGE} AS n11, 0e0 AS n12, 1 / {RIDGE} AS n22, 0e0 AS used FROM fitcells
    UNION ALL SELECT {_OWN}, round + 1, {PREDICTOR}, total, change, bool_and(change < {TOLERANCE}) OVER (), {_FOUND}, {_NEXT}
    FROM (SELECT *, {_GAIN} AS change FROM {_STEP}) WINDOW f AS (PARTITION BY {FIT})"""

_ONCE = f"row_number() OVER (PARTITION BY {PERSON}) = 1 AS once"
_SHARED = ", ".join(f"max({x}) AS {x}" for x in "b0 b1 b2 b3 t11 t12 t22 s2 schur change".split())
_PULL = "p11 * u0 * u0 + 2 * p12 * u0 * u1 + p22 * u1 * u1"

FITSUMS = f"""SELECT {FIT}, {_SHARED}, max(round) AS iterations, sum({LOGLIK}) AS zero, sum({RESIDUAL}) AS rss, sum(n) AS trials, sum(passed) AS m,
    sum(u_df) FILTER (once) AS used, count(*) FILTER (once) AS people, sum({_PULL}) FILTER (once) / max(s2) AS pull,
    sum(ln(bd) - CASE WHEN with_cond = 0 THEN ln(p22) ELSE 0 END) FILTER (once) AS blocks, sum(ln(bd) + ln(td)) FILTER (once) AS spread, 2 + 2 * with_cond AS terms
    FROM (SELECT *, {_ONCE} FROM fitrounds WHERE round = (SELECT max(round) FROM fitrounds)) GROUP BY ALL"""

FITPARTS = f"""SELECT *, used + terms + CAST(kind = 'mu' AS INT) AS df, schur + blocks - (terms + people * (1 + with_cond)) * ln(s2) AS logdet,
    sqrt(rss / m) AS sigma, CASE kind WHEN 'hu' THEN zero ELSE -m / 2 * (ln(2 * pi() * rss / m) + 1) END AS ll,
    CASE kind WHEN 'hu' THEN zero ELSE -m / 2 * ln(2 * pi() * s2) - rss / (2 * s2) END - pull / 2 - spread / 2
      - terms / 2e0 * ln(CASE kind WHEN 'hu' THEN trials ELSE m END) AS laplace,
    sqrt(t11 * s2) AS sd0, with_cond * sqrt(t22 * s2) AS sd1, CASE with_cond WHEN 1 THEN t12 / sqrt(t11 * t22) END AS cor FROM fitsums"""

FITS = f"""SELECT experiment, bias_source, model_name, h.trials AS n, m.b0 AS b_intercept, m.b1 AS b_stim, m.b2 AS b_cond, m.b3 AS b_stim_cond, m.sigma,
    h.b0 AS hu_intercept, h.b1 AS hu_stim, h.b2 AS hu_cond, h.b3 AS hu_stim_cond, m.sd0 AS sd_intercept, m.sd1 AS sd_cond, m.cor,
    h.sd0 AS hu_sd_intercept, h.sd1 AS hu_sd_cond, h.cor AS hu_cor, m.ll + h.ll AS loglik, m.df + h.df AS df, m.logdet + h.logdet AS logdet,
    -2 * (m.ll + h.ll) + (m.df + h.df) * ln(h.trials) AS bic, m.laplace + h.laplace AS logml,
    m.change < {TOLERANCE} AND h.change < {TOLERANCE} AS converged, h.iterations
    FROM (VALUES ('simple', 0, 0), ('contrast', 1, 0), ('hurdle', 0, 1), ('full', 1, 1)) AS k(model_name, in_mu, in_hu)
    JOIN fitparts m ON m.with_cond = in_mu AND m.kind = 'mu' JOIN fitparts h USING (experiment, bias_source) WHERE h.with_cond = in_hu AND h.kind = 'hu'"""

PARTS = {"fitcells": CELLS, "fitrounds": ROUNDS_SQL, "fitsums": FITSUMS, "fitparts": FITPARTS, "fits": FITS}
