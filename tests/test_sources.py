"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from trialspark.operators import exclude
from trialspark.operators.joins import literal_grid, missing_keys
from trialspark.schema import MODEL_BF, RHAT
from trialspark.sources import results, trials

HEADER = "participant,bias_source,bias_direction,contrast_level,trial_type,trial_index,target_contrast,answer\n"


@pytest.fixture
def raw(tmp_path):
    files = {}
    for name, lines in {
        "exp1": ["065,cue,control,low,detection,1,0.05,present", "065,cue,control,low,reproduction,2,-0.05,NA"],
        "exp3": ["065,baserate,present,high,reproduction,1,0.06,0.10"],
    }.items():
        files[name] = str(tmp_path / f"raw_{name}.csv")
        with open(files[name], "w") as out:
            out.write(HEADER + "\n".join(lines) + "\n")
    return files


def test_raw_trials_are_typed_and_tagged(spark, raw):
    df = trials.read_trials(spark, raw).orderBy("experiment", "trial_index")
    rows = df.collect()
    assert [(r["experiment"], r["participant"], r["answer"]) for r in rows] == [("exp1", "065", "present"), ("exp1", "065", None), ("exp3", "065", "0.10")]
    assert rows[1]["target_contrast"] == -0.05


def test_columns_are_matched_by_name(spark, tmp_path):
    """Any order of columns, others carried along, the trial order absent or under another name."""
    path = str(tmp_path / "odd.csv")
    with open(path, "w") as out:
        out.write("rt,bias_source,participant,bias_direction,contrast_level,trial_type,target_contrast,answer,nr\n0.5,cue,065,control,low,detection,x,present,7\n")
    r = trials.read_trials(spark, {"exp1": path}).first().asDict()
    assert "trial_index" not in r and (r["rt"], r["participant"], r["target_contrast"], r["experiment"]) == ("0.5", "065", None, "exp1")
    assert trials.read_trials(spark, {"exp1": path}, index="nr").first()["trial_index"] == 7
    with pytest.raises(ValueError, match="order"):
        trials.read_trials(spark, {"exp1": path}, index="order")
    with pytest.raises(Exception, match="trial_index"):
        exclude.start_balance(trials.read_trials(spark, {"exp1": path})).collect()


def test_files_of_a_folder_may_have_different_headers(spark, tmp_path):
    names = HEADER.strip().split(",")
    rows = [dict(zip(names, f"{p},cue,control,low,detection,{k},0.05,present".split(","), strict=True)) for k, p in enumerate(("001", "002", "003"))]
    folder = tmp_path / "raw"
    (folder / "_temporary").mkdir(parents=True)
    (folder / "_temporary" / "x.csv").write_text("nothing\n1\n")
    (folder / "empty.csv").write_text("")
    (folder / "a.csv").write_text(HEADER + ",".join(rows[0].values()) + "\n")
    turned = names[::-1] + ["rt, ms"]
    (folder / "b.csv").write_text(",".join([*turned[:-1], '"rt, ms"']) + "\r\n" + ",".join([*[rows[1][c] for c in turned[:-1]], "512"]) + "\r\n")
    with gzip.open(folder / "c.csv.gz", "wt") as out:
        out.write(",".join(turned[:-1]) + "\n" + ",".join(rows[2][c] for c in turned[:-1]) + "\n")
    for path in (str(folder), str(folder / "*.csv*")):
        df = trials.read_trials(spark, {"exp1": path})
        got = df.orderBy("participant").collect()
        assert [{c: str(r[c]) for c in names} for r in got] == rows and [r["rt, ms"] for r in got] == [None, "512", None]
    (folder / "d.csv").write_text("participant,answer\n009,present\n")
    with pytest.raises(ValueError, match="d.csv lacks the columns bias_direction, bias_source"):
        trials.read_trials(spark, {"exp1": str(folder)})
    with pytest.raises(FileNotFoundError):
        trials.read_trials(spark, {"exp1": str(tmp_path / "none")})


def test_filtered_folders_with_different_headers(spark, raw, tmp_path):
    df = trials.read_trials(spark, raw)
    path = str(tmp_path / "filtered")
    trials.write_by_experiment(df.where("experiment = 'exp1'"), path, "csv")
    other = df.where("experiment = 'exp3'").select(*df.columns[::-1]).withColumn("rt", F.lit("7"))
    other.drop("experiment").write.options(**trials.CSV).csv(path + "/experiment=exp3")
    back = trials.read_filtered(spark, path, fmt="csv")
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert {r["experiment"]: r["rt"] for r in back.collect()} == {"exp1": None, "exp3": "7"}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_filtered_trials_by_experiment(spark, raw, tmp_path, fmt):
    df = trials.read_trials(spark, raw)
    path = str(tmp_path / "filtered")
    trials.write_by_experiment(df, path, fmt)
    back = trials.read_filtered(spark, path, fmt=fmt)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    one = trials.read_filtered(spark, path, "exp3", fmt)
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(experiment" in one._jdf.queryExecution().executedPlan().toString()


def test_rhat_files(spark, tmp_path):
    for k, line in enumerate(['"r_participant[065,Intercept]",1.0001,exp2,cue,full', '"L_1[1,1]",NA,exp2,cue,full']):
        (tmp_path / f"rhat_{k}.csv").write_text("parameter,rhat,experiment,condition,model_name\n" + line + "\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    rows = results.read_many(spark, str(tmp_path), RHAT, "rhat_*.csv").orderBy("parameter").collect()
    assert [(r["parameter"], r["rhat"]) for r in rows] == [("L_1[1,1]", None), ("r_participant[065,Intercept]", 1.0001)]


def test_keyed_results_and_missing_keys(spark, tmp_path):
    path, keys = str(tmp_path / "bf"), ["experiment", "condition"]
    todo = literal_grid(spark, experiment=["exp1", "exp2"], condition=["cue", "payoff"])
    asked = []

    def compute(wanted):
        asked.append({tuple(r) for r in wanted.collect()})
        return wanted.selectExpr("'full' AS model", "'simple' AS denominator", "1.5D AS bf_log", *keys)

    results.compute_missing(todo.where("experiment = 'exp1'"), path, keys, MODEL_BF, compute)
    results.compute_missing(todo, path, keys, MODEL_BF, compute)
    assert asked == [{("exp1", "cue"), ("exp1", "payoff")}, {("exp2", "cue"), ("exp2", "payoff")}]
    stored = spark.read.parquet(path)
    assert stored.count() == 4
    results.write_keyed(stored.where("condition = 'cue'").withColumn("bf_log", stored.bf_log + 1), str(tmp_path / "copy"), keys)
    assert missing_keys(todo, results.stored_keys(spark, path, keys, MODEL_BF), keys).count() == 0
