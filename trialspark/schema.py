"""Table schemas, key lists and ordered categories shared by all operators."""

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# One row per participant and trial. `answer` holds a word (detection) or a number (reproduction), so it stays text;
# `trial_index` carries the file order, which a distributed table does not have by itself.
TRIALS = _struct(
    experiment=_S,
    participant=_S,
    bias_source=_S,
    bias_direction=_S,
    contrast_level=_S,
    trial_type=_S,
    trial_index=_L,
    target_contrast=_D,
    answer=_S,
)
RHAT = _struct(parameter=_S, rhat=_D, experiment=_S, condition=_S, model_name=_S)
MODEL_BF = _struct(model=_S, denominator=_S, bf_log=_D, experiment=_S, condition=_S)
PREDICTIVE = _struct(
    experiment=_S,
    participant=_S,
    bias_source=_S,
    cond=_S,
    contrast_level=_S,
    stim=_D,
    response_non_zero=_D,
    prop_zero=_D,
    response=_D,
    response_pred=_D,
    hurdle_prob=_D,
    response_pred_non_zero=_D,
    model_name=_S,
)
DRAWS_LONG = _struct(
    experiment=_S, condition=_S, model_name=_S, parameter=_S, chain=_I, iteration=_L, value=_D
)

# A participant is identified by all three: ids restart in every experiment.
PARTICIPANT = ["experiment", "participant", "bias_source"]
PAIR = [*PARTICIPANT, "contrast_level"]
CELL = [*PARTICIPANT, "bias_direction", "contrast_level"]
CONDITION = ["experiment", "bias_source", "contrast_level"]
FIT = ["experiment", "bias_source", "model_name"]
DESIGN = [*PARTICIPANT, "cond", "contrast_level", "stim"]

# Ordered categories and display labels.
EXPERIMENTS = ["exp1", "exp2", "exp3"]
SOURCES = ["cue", "baserate", "payoff"]
DIRECTIONS = ["control", "present"]
LEVELS = ["absent", "low", "high"]
MODELS = ["simple", "contrast", "hurdle", "full"]
SOURCE_LABELS = {"cue": "Att. cue", "payoff": "Payoff", "baserate": "Base rate"}
LEVEL_LABELS = {"absent": "Absent", "low": "Low contrast", "high": "High contrast"}
DIRECTION_LABELS = {"control": "Control", "present": "Present"}
