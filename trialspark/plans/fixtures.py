"""Trial and draw tables derived from the test tables.

The SQL runs unchanged in Spark and DuckDB; `{events}` and `{lineitem}` stand for the source tables. Every row of a
source table becomes a row (or, for draws, a key) of the derived one, so the work grows with the tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import inv_logit
from ..operators.draws import hurdle_loglik
from ..operators.frame import design_rows, model_frame
from ..operators.joins import key_grid
from ..schema import MODELS

PERSON = """
    lpad(CAST(user_id AS STRING), 6, '0') AS participant,
    concat('exp', CAST(user_id % 3 + 1 AS STRING)) AS experiment,
    CASE WHEN user_id % 9 IN (0, 1, 2) THEN 'baserate'
         WHEN user_id % 9 IN (3, 4, 5, 8) THEN 'cue' ELSE 'payoff' END AS bias_source"""

TRIALS = f"""
WITH b AS (
  SELECT event_id, user_id, value, {PERSON},
    CASE WHEN event_id % 2 = 0 THEN 'control' ELSE 'present' END AS bias_direction,
    CASE WHEN event_type IN ('view', 'signup') THEN 'absent'
         WHEN event_type IN ('click', 'error') THEN 'low' ELSE 'high' END AS contrast_level,
    CASE WHEN event_id % 4 < 2 THEN 'detection' ELSE 'reproduction' END AS trial_type
  FROM {{events}})
SELECT experiment, participant, bias_source, bias_direction, contrast_level, trial_type, event_id AS trial_index,
  CASE WHEN contrast_level = 'absent' THEN 0.0e0
       WHEN contrast_level = 'low' THEN 0.02e0 + (user_id % 10) / 1000.0e0
       ELSE 0.05e0 + (user_id % 10) / 1000.0e0 END
    * (CASE WHEN user_id % 500 = 7 THEN 10.0e0 ELSE 1.0e0 END) AS target_contrast,
  CASE WHEN trial_type = 'detection' THEN
         CASE WHEN value > (CASE contrast_level WHEN 'absent' THEN 80 WHEN 'low' THEN 40 ELSE 15 END)
                           * (CASE bias_direction WHEN 'present' THEN 0.7e0 ELSE 1.0e0 END)
              THEN 'present' ELSE 'absent' END
       WHEN value < 20 THEN '0'
       WHEN event_id % 3 = 0 THEN concat('-', CAST(value / 1000.0e0 AS STRING))
       ELSE CAST(value / 1000.0e0 AS STRING) END AS answer
FROM b"""

# Divisors are primes where they can be, so that means have no exact decimal ties for two engines to round apart.
# A line item is the draw of one participant's effects; its order is the draw, and the draw belongs to one model.
_DRAW = """
    CASE draw_id % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'contrast' WHEN 2 THEN 'hurdle' ELSE 'full' END AS model_name,
    CASE WHEN draw_id % 4 IN (1, 3) THEN 1.0e0 ELSE 0.0e0 END AS in_mu,
    CASE WHEN draw_id % 4 IN (2, 3) THEN 1.0e0 ELSE 0.0e0 END AS in_hu"""

DRAWS_RANDOM = f"""
WITH d AS (SELECT DISTINCT l_orderkey AS draw_id, CAST(floor(l_partkey * 3 / 40.0e0) AS BIGINT) AS user_id FROM {{lineitem}}),
m AS (SELECT draw_id, user_id, {PERSON}, {_DRAW} FROM d)
SELECT experiment, bias_source, model_name, draw_id, participant,
  ((draw_id * 31 + user_id * 17) % 101 - 50) / 9973.0e0 AS r_intercept,
  in_mu * ((draw_id * 37 + user_id * 13) % 101 - 50) / 19993.0e0 AS r_cond,
  ((draw_id * 41 + user_id * 19) % 101 - 50) / 49.0e0 AS r_hu_intercept,
  in_hu * ((draw_id * 43 + user_id * 23) % 101 - 50) / 97.0e0 AS r_hu_cond
FROM m"""

DRAWS_FIXED = f"""
WITH u AS (SELECT l_orderkey AS draw_id, CAST(floor(l_partkey * 3 / 40.0e0) AS BIGINT) AS user_id FROM {{lineitem}}),
p AS (SELECT draw_id, {PERSON} FROM u),
d AS (SELECT DISTINCT draw_id, experiment, bias_source FROM p),
m AS (SELECT draw_id, experiment, bias_source, {_DRAW} FROM d)
SELECT experiment, bias_source, model_name, draw_id,
  0.01e0 + (draw_id % 89) / 9973.0e0 AS b_intercept,
  0.5e0 + (draw_id % 7) / 97.0e0 AS b_stim,
  in_mu * (0.002e0 + (draw_id % 5) / 9973.0e0) AS b_cond,
  in_mu * (draw_id % 3) / 97.0e0 AS b_stim_cond,
  0.01e0 + (draw_id % 11) / 9973.0e0 AS sigma,
  0.5e0 + (draw_id % 13) / 97.0e0 AS hu_intercept,
  -40.0e0 - draw_id % 17 AS hu_stim,
  in_hu * (-0.5e0 + (draw_id % 19) / 97.0e0) AS hu_cond,
  in_hu * (draw_id % 23) / 11.0e0 AS hu_stim_cond
FROM m"""

# 50 parameters, four chains of equal length, which grows with the table. Parameter 0 is constant. Numbering starts late.
DRAWS_LONG = """
WITH d AS (
  SELECT event_id % 50 AS k, CAST(floor(event_id / 50.0e0) AS BIGINT) AS turn, value FROM {events})
SELECT concat('exp', CAST(k % 2 + 1 AS STRING)) AS experiment,
  CASE k % 3 WHEN 0 THEN 'cue' WHEN 1 THEN 'baserate' ELSE 'payoff' END AS condition,
  CASE k % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'contrast' WHEN 2 THEN 'hurdle' ELSE 'full' END AS model_name,
  CASE WHEN k = 0 THEN 'L_1[1,1]' ELSE concat('r_participant[', lpad(CAST(k AS STRING), 3, '0'), ',Intercept]') END AS parameter,
  CAST(turn % 4 + 1 AS INT) AS chain,
  CAST(floor(turn / 4.0e0) AS BIGINT) + 1001 AS iteration,
  CASE WHEN k = 0 THEN 1.0e0 ELSE sqrt(value + 1) END AS value
FROM d"""


def _derived(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def trials(spark, sf_dir):
    return _derived(spark, sf_dir, TRIALS, "events")


def draws_random(spark, sf_dir):
    return _derived(spark, sf_dir, DRAWS_RANDOM, "lineitem")


def draws_fixed(spark, sf_dir):
    return _derived(spark, sf_dir, DRAWS_FIXED, "lineitem")


def draws_long(spark, sf_dir):
    return _derived(spark, sf_dir, DRAWS_LONG, "events")


def design(spark, sf_dir):
    return design_rows(model_frame(trials(spark, sf_dir)))


def scored_trials(spark, sf_dir):
    """Every reproduction trial under each of the four models with fixed parameter values."""
    frame = key_grid(model_frame(trials(spark, sf_dir)), model_name=MODELS)
    shown = (F.col("cond") == "present").cast("double")
    in_mu, in_hu = (F.col("model_name").isin(part, "full").cast("double") for part in ("contrast", "hurdle"))
    return frame.withColumns(
        {
            "mu": 0.05 + 0.8 * F.col("stim") + 0.01 * in_mu * shown,
            "sigma": F.lit(0.06),
            "hu": inv_logit(0.6 - 20.0 * F.col("stim") - 0.3 * in_hu * shown),
        }
    )


def log_evidence(spark, sf_dir):
    """One log evidence per experiment, condition and model: here the log likelihood itself."""
    sums = hurdle_loglik(scored_trials(spark, sf_dir), ["experiment", "bias_source", "model_name"])
    return sums.select("experiment", F.col("bias_source").alias("condition"), F.col("model_name").alias("model"), F.col("loglik").alias("logml"))
