"""Cases that are easy to get silently wrong."""

import math

import pytest
from pyspark.sql import functions as F

from trialspark.operators import exclude, frame as fr, joins, regression, reshape, sdt, summarise

TRIAL = (
    "experiment string, participant string, bias_source string, bias_direction string, contrast_level string,"
    " trial_type string, trial_index long, target_contrast double, answer string"
)


def trial(answer="0", person="001", direction="control", level="low", task="reproduction", index=0, target=0.1):
    return ("exp1", person, "cue", direction, level, task, index, target, answer)


def one(df, *cols):
    return tuple(df.first()[c] for c in cols)


def test_constant_values_are_all_flagged(frame):
    rows = frame([("e", 0.1)] * 5, "experiment string, value double")
    assert exclude.zscore_outliers(rows, ["experiment"]).count() == 5


def test_single_value_is_not_flagged(frame):
    assert exclude.zscore_outliers(frame([("e", 3.0)], "experiment string, value double"), ["experiment"]).count() == 0


def test_missing_value_can_block_flagging(frame):
    rows = frame([("e", 0.0)] * 30 + [("e", 9.0), ("e", None)], "experiment string, value double")
    assert exclude.zscore_outliers(rows, ["experiment"]).count() == 1
    assert exclude.zscore_outliers(rows, ["experiment"], na="propagate").count() == 0


def test_missing_key_is_excluded_by_missing_key(frame):
    rows = frame([(None, 1), ("a", 2)], "k string, v int")
    for limit in (100, 0):
        left = joins.exclude_keys(rows, frame([(None,)], "k string"), ["k"], max_rows=limit)
        assert [tuple(r) for r in left.collect()] == [("a", 2)]


def test_empty_confusion_class_shifts_all_four(frame):
    rows = frame([(10, 0, 8, 2)], "hits long, misses long, correct_rejections long, false_alarms long")
    hr, fr_, lam, d, c, beta = one(sdt.with_sdt(rows), "hr", "fr", "lambda", "d", "ccrit", "beta")
    assert (hr, fr_) == pytest.approx((10.5 / 11, 2.5 / 11))
    zh = d + lam
    assert c == pytest.approx((zh + lam) / 2) and beta == pytest.approx(d * (-lam - d / 2))


def test_accuracy_is_never_missing(frame):
    rows = frame([("absent", "absent"), ("low", "present"), ("low", None), (None, "present"), ("absent", "present")], "l string, a string")
    assert [r[0] for r in rows.select(fr.accuracy("l", "a")).collect()] == [True, True, False, False, False]


def test_two_codings_of_present(frame):
    rows = frame([("present",), ("absent",), ("maybe",), (None,)], "a string")
    got = rows.select(fr.is_present("a").alias("s"), fr.is_present("a", strict=False).alias("l")).collect()
    assert [r["s"] for r in got] == [1, 0, None, None] and [r["l"] for r in got] == [1, 0, 0, None]


def test_unreadable_answer(frame):
    rows = frame([trial("abc"), trial("-0.2"), trial("0.4")], TRIAL)
    assert one(summarise.mean_reproduction(rows), "reproduction")[0] == pytest.approx(0.3)
    assert one(exclude.reproduction_error(rows), "value")[0] == pytest.approx(-0.2)
    assert one(exclude.reproduction_error(rows, na="propagate"), "value") == (None,)


def test_zero_share_and_ceiling_differ_above_one(frame):
    rows = frame([trial("0"), trial("1.5")], TRIAL)
    assert one(summarise.proportion_zero(rows), "prop_zero") == (0.5,)
    assert one(summarise.proportion_zero(rows, mode="ceiling"), "prop_zero") == (0.0,)
    with pytest.raises(ValueError):
        summarise.proportion_zero(rows, mode="other")


def test_logit_moves_the_whole_vector(frame):
    rows = frame([("e", 0.0), ("e", 0.5), ("f", 0.2), ("g", 50.0)], "experiment string, p double")
    got = {(r["experiment"], i): r["p"] for i, r in enumerate(regression.logit_adjusted(rows, ["p"]).orderBy("experiment", "p").collect())}
    assert got[("e", 0)] == pytest.approx(math.log(0.025 / 0.975)) and got[("e", 1)] == pytest.approx(0)
    assert got[("f", 2)] == pytest.approx(math.log(0.2 / 0.8)) and got[("g", 3)] == pytest.approx(0)


def test_histogram_edges(frame):
    rows = frame([(0.0,), (0.0015,), (0.0016,), (0.0045,), (0.2,), (None,)], "value double")
    got = {r["bin"]: r["n"] for r in summarise.histogram(rows, [], limits=(0, 0.14)).collect()}
    assert got == {0: 2, 1: 2}


def test_missing_source_label(frame):
    labels = {r["bias_source"]: r["label"] for r in summarise.source_labels(frame([trial()], TRIAL)).collect()}
    assert labels == {"cue": "Att. cue (N=1)", "payoff": "Payoff (N=NA)", "baserate": "Base rate (N=NA)"}


def test_unknown_level_becomes_missing(frame):
    rows = fr.with_order(frame([("low",), ("odd",), (None,)], "level string"), "level", ["absent", "low"])
    assert [(r["level"], r["level_ord"]) for r in rows.collect()] == [("low", 2), (None, None), (None, None)]


def test_codes_spell_out_missing_parts(frame):
    row = fr.condition_codes(frame([trial(direction=None)], TRIAL), sep="_").first()
    assert row["condition_code"] is None and row["bias_source_ord"] == 1


def test_first_row_follows_the_trial_index(frame):
    rows = frame([trial(direction="present", index=5), trial(direction="control", index=2)], TRIAL)
    assert one(exclude.start_balance(rows.repartition(4)), "control", "present") == (1, None)


def test_widen_refuses_duplicates(frame):
    rows = frame([("a", "x", 1), ("a", "x", 2)], "k string, n string, v int")
    with pytest.raises(Exception, match="duplicate rows"):
        reshape.widen(rows, ["k"], "n", "v", ["x"]).collect()
    filled = reshape.widen(rows.limit(1), ["k"], "n", "v", ["x", "y"], fill=0)
    assert one(filled, "x", "y") == (1, 0)


def test_reshape_round_trip(frame):
    wide = frame([("a", 1.0, None)], "k string, x double, y double")
    long = reshape.lengthen(wide, ["k"], ["x", "y"])
    assert long.count() == 2
    assert one(reshape.pair_diff(long, ["k"], "x", "y", "value", by="name"), "diff") == (None,)
    packed = wide.select("k", F.struct("x", "y").alias("s"))
    assert reshape.unpack(packed, "s").columns == ["k", "x", "y"]


def test_stacking_fills_absent_columns(frame):
    both = fr.stack(frame([(1, "a")], "i int, s string"), frame([(2,)], "i int"))
    assert [tuple(r) for r in both.orderBy("i").collect()] == [(1, "a"), (2, None)]


def test_staged_exclusion_removes_whole_participants(frame):
    rows = []
    for person in range(30):
        sensitive = person != 3
        for direction in ("control", "present"):
            for k in range(12):
                level = "absent" if k % 2 else "low"
                right = "absent" if level == "absent" else "present"
                wrong = "present" if right == "absent" else "absent"
                said = right if (sensitive and k > 1 + person % 3) or (not sensitive and direction == "control" and k > 1) else wrong
                rows.append(trial(said, f"{person:03}", direction, level, "detection", k, 0.0 if k % 2 else (9.0 if person == 1 else 0.1)))
            rows.append(trial("5" if person == 2 else "0.1", f"{person:03}", direction, "low", "reproduction", 20, 9.0 if person == 1 else 0.1))
    trials = frame(rows, TRIAL)
    kept, log = exclude.exclude(trials)
    stages = {(r["stage"], r["participant"]) for r in log.collect()}
    assert stages == {("staircase", "001"), ("low_dprime", "003"), ("reproduction", "002")}
    assert kept.select("participant").distinct().count() == 27
    assert exclude.exclusion_summary(log).first()["n"] == 3
