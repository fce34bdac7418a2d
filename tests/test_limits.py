"""Both sides of limits that once changed results, and rows that once broke an operator."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathgram.functions.hashing import lane, lane_array
from pathgram.functions.ordering import number_cases
from pathgram.operators import attribution, optimum, predict, profile, resample, trees
from pathgram.operators.fit import fit_by
from pathgram.operators.moments import moment_parts, moments
from pathgram.sources import readers
from pathgram.spec import ModelSpec

SPEC = ModelSpec({"A": ["a1", "a2"], "B": ["b1", "b2"]}, [("A", "B")])


def survey(spark, n=60, group=None):
    rng = np.random.default_rng(3)
    base = rng.normal(size=n)
    rows = [(i, float(base[i] + rng.normal()), float(base[i] + rng.normal()), float(base[i] + rng.normal()), float(base[i] + rng.normal()), "x" if i % 2 else "y") for i in range(n)]
    return spark.createDataFrame(rows, "case_id long, a1 double, a2 double, b1 double, b2 double, g string")


def test_hash_of_negative_and_huge_keys(spark):
    ids = np.array([-1, -500, -(2**40), 2**53 + 1, 2**62, 0, 7], dtype=np.int64)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long")
    got = {r.id: r.v for r in df.select("id", lane(F.col("id"), 3, 42).alias("v")).collect()}
    want = lane_array(ids, np.array([3]), 42)[:, 0]
    assert [got[int(i)] for i in ids] == want.tolist()


def test_folds_of_negative_keys_are_equal(spark):
    folds = predict.assign_folds(spark.range(-500, 500).toDF("k"), "k", 5, 2)
    assert {r["count"] for r in folds.groupBy("repetition", "fold").count().collect()} == {200}


def test_constant_groups_are_named(spark):
    df = survey(spark).withColumn("a1", F.when(F.col("g") == "x", 0.1).otherwise(F.col("a1")))
    rows = fit_by(df, SPEC, ["g"]).collect()
    by_group = {g: [r for r in rows if r.g == g] for g in "xy"}
    assert [(r.metric, r.source, r.label) for r in by_group["x"]] == [("run", "skipped", "1 constant indicators")]
    assert any(r.metric == "r2" for r in by_group["y"])


def test_prediction_keeps_folds_with_a_constant_indicator(spark):
    df = survey(spark, 40).withColumn("a1", F.when(F.col("case_id") == 11, 5.0).otherwise(1.0))
    cases = predict.predict_cases(df, SPEC, "case_id", 5, 1)
    assert cases.count() == 40
    for c in cases.columns:
        assert cases.filter(F.col(c).isNull()).count() == 0


def test_totals_count_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, t string")
    assert tuple(profile.dataset_totals(df, ["x", "t"]).first()) == (3, 2, 3)


def test_grouping_columns_without_any(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("v"))
    assert profile.grouping_columns(df, ["v"]).count() == 0


@pytest.mark.parametrize("d", [9, 11, 14])
def test_optimum_of_wide_models(spark, d):
    names = [f"x{k}" for k in range(d)]
    df = spark.createDataFrame([tuple([0.0] * d), tuple([5.0] * d), tuple([2.5] * d)], ", ".join(f"{n} double" for n in names))
    out = {r.goal: r for r in optimum.response_optimum(df, names, trees.formula_predictor(" + ".join(names)), points=512, generations=4).collect()}
    assert out["min"].value == pytest.approx(0.0) and out["max"].value == pytest.approx(5.0 * d)


def test_attribution_uses_the_background_asked_for(spark):
    df = spark.range(300).select(F.col("id").alias("case_id"), (F.col("id") % 7).cast("double").alias("u"), (F.col("id") % 11).cast("double").alias("v"))
    phi = attribution.shapley(df, ["u", "v"], trees.formula_predictor("u + 2 * v"), "case_id", background=300)
    means = df.agg(F.avg("u"), F.avg("v")).first()
    wrong = phi.filter(F.abs(F.when(F.col("feature") == "u", F.col("value") - means[0]).otherwise(2 * (F.col("value") - means[1])) - F.col("phi")) > 1e-9)
    assert phi.count() == 600 and wrong.count() == 0


def test_attribution_is_exact_beyond_eight_features(spark):
    names = [f"x{k}" for k in range(10)]
    df = spark.range(4).select(F.col("id").alias("case_id"), *[(F.col("id") * (k + 1)).cast("double").alias(n) for k, n in enumerate(names)])
    phi = attribution.shapley(df, names, trees.formula_predictor(" + ".join(names)), "case_id", background=4)
    wrong = [r for r in phi.collect() if abs(r.phi - (r.case_id - 1.5) * (int(r.feature[1:]) + 1)) > 1e-9]
    assert not wrong


def test_late_bytes_decide_the_encoding(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"a;b\n" + b"1;2\n" * 50 + "Café;3\n".encode("cp1252"))
    df, _ = readers.read_delimited(spark, str(path))
    assert df.filter("a = 'Café'").count() == 1


def test_case_numbers_of_text_keys(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k"))
    for partitions in (1, 16):
        rows = number_cases(df, "k", partitions).orderBy("case_number").collect()
        assert [r.case_number for r in rows] == list(range(1, 1001))
        assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_scans_keep_their_splits_and_merge_in_two_levels(spark):
    df = spark.range(0, 4000, 1, 600).select(F.col("id").cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("y"))
    parts = moment_parts(df, ["x", "y"])
    assert parts.count() == 3  # 600 tasks, 256 partial rows merged at a time
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan
    row = moments(df, ["x", "y"]).first()
    assert row.n == 4000 and row.mean[0] == pytest.approx(1999.5)


def test_kolmogorov_law_has_no_jump():
    from pathgram.functions.distributions import MATRIX_CASES, _kolmogorov_matrix, _kolmogorov_series, kolmogorov_tail

    for z in (0.5, 0.8, 1.2, 1.6, 2.0):
        d = z / MATRIX_CASES**0.5
        assert abs(_kolmogorov_matrix(d, MATRIX_CASES) - _kolmogorov_series(d, MATRIX_CASES)) < 1e-5
    # n = 1: the distance is max(u, 1 - u); n large: the limit at 1.3581 leaves five percent.
    assert kolmogorov_tail(0.75, 1) == pytest.approx(0.5)
    assert kolmogorov_tail(1.3581 / 1e6, 1e12) == pytest.approx(0.05, abs=1e-4)


def test_entry_runs_from_another_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, '/root/repo')\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', e.entry(s).count())\n"
    ).replace("/root/repo", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def stages(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas")


def test_small_tables_are_merged_once(spark, tmp_path):
    """One merge where few tasks feed it, two levels above 256 tasks; also when names look like plan nodes."""
    spec = ModelSpec({"A": ["a1", "Join a2"], "B": ["Sort b1", "b2"]}, [("A", "B")])
    names = ["case_id", *spec.indicators]
    made = spark.range(600).select("id", *[F.rand(k).alias(n) for k, n in enumerate(spec.indicators)]).toDF(*names)
    made.coalesce(1).write.parquet(str(tmp_path / "Exchange"))
    small = spark.read.parquet(str(tmp_path / "Exchange"))
    assert stages(resample.bootstrap_samples(small, spec, "case_id", 20)) == 1
    assert stages(resample.bootstrap_samples(made.repartition(40), spec, "case_id", 20)) == 1
    wide = resample.bootstrap_samples(made.repartition(300), spec, "case_id", 20)
    assert stages(wide) == 2
    one = {(r.replicate, r.metric, r.label): r.value for r in resample.bootstrap_samples(made.repartition(40), spec, "case_id", 3).collect()}
    two = {(r.replicate, r.metric, r.label): r.value for r in resample.bootstrap_samples(made.repartition(300), spec, "case_id", 3).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
