import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathgram.functions import distributions as D
from pathgram.functions.ordering import exact_quantiles, number_cases, running_total
from pathgram.operators import prepare, profile, screening, summary
from pathgram.operators.moments import moment_table
from pathgram.plans.fixtures import SPEC, likert_items
from pathgram.session import scratch_path
from pathgram.sources import readers, writers


def test_unique_names():
    names, warnings = readers.unique_names(["a", " a ", "a_2", "", "﻿a"])
    assert len(set(names)) == 5 and names[0] == "a" and names[3] == "Unnamed" and len(warnings) == 3


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_and_byte_order_mark(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text("﻿" + sep.join(["x", "y", "x"]) + "\n" + sep.join(['"1,5"', "n/a", "3"]) + "\n", encoding="utf-8")
    df, warnings = readers.read_delimited(spark, str(path))
    assert df.columns == ["x", "y", "x_2"] and len(warnings) == 1
    assert df.first().asDict() == {"x": "1,5", "y": "n/a", "x_2": "3"}


def test_fallback_encoding(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("größe;b\n1;2\n".encode("iso-8859-1"))
    assert readers.read_delimited(spark, str(path))[0].columns == ["größe", "b"]


def test_number_rules(spark):
    texts = [" 1,5 ", "1.5", "1d", "nan", "None", "", "1e3", "Infinity", "1.234,5", None, "-.5", "+2"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r["t"] for r in prepare.coerce(df, ["t"], ["k"]).orderBy("k").collect()]
    assert got == [1.5, 1.5, None, None, None, None, 1000.0, None, None, None, -0.5, 2.0]
    assert prepare.coercion_losses(df, ["t"]).first().asDict() == {"variable": "t", "before": 11, "after": 5, "lost": 6}


def test_cleaned_csv_round_trip(spark, fx):
    path = scratch_path(spark, "out")
    writers.write_cleaned(fx, ["qty", "n_lines"], path, "csv", keep=["case_id"])
    back = readers.read_numbers(spark, path, ",", ".")
    assert back.count() == fx.count() and dict(back.dtypes)["qty"] == "double"


@pytest.mark.parametrize("bracket", [10_000, 300, 40])
def test_exact_quantiles(spark, bracket):
    rng = np.random.default_rng(3)
    x = np.round(rng.lognormal(0, 2, 3000), 3)
    y = np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 50, 3000))  # one value holds 40 % of the rows
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["x", "y"], probs, bracket)
    assert np.allclose(got["x"], np.quantile(x, probs)) and np.allclose(got["y"], np.quantile(y, probs))


def test_running_total_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).cast("long").alias("one"))
    out = running_total(df, "k", "one", 1000, "upto", rows_per_bucket=50)
    assert out.filter("upto <> k + 1").count() == 0
    assert number_cases(spark.range(5, 500, 5).toDF("id"), "id", 10).filter("case_number <> id / 5").count() == 0


def test_few_distinct_and_grouping(spark):
    df = spark.range(3000).selectExpr("cast(id % 21 as int) a", "cast(id % 20 as int) b", "id c", "1 d")
    found = {r["variable"]: r["groups"] for r in profile.grouping_columns(df, df.columns).collect()}
    assert list(found) == ["b"] and len(found["b"]) == 20
    stats = {r["variable"]: r for r in profile.column_stats(df, df.columns).collect()}
    assert stats["a"]["few"] == 21 and stats["c"]["few"] is None and stats["d"]["skew"] == 0.0


def test_profile_flags(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (1.0, 5.0, 3.0), (1.0, None, 4.5)], "flat double, gap double, v double")
    out = {r["variable"]: r for r in profile.profile(df, ["flat", "gap", "v"], ["v"]).collect()}
    assert out["flat"]["zero_variance"] and out["gap"]["high_missing"] and out["v"]["used"]
    assert out["v"]["scale_hint"] == "1-5" and out["flat"]["scale_type"] == "binary"


def test_screening(fx):
    items = likert_items(fx)
    tables = screening.screen(items, "case_id", ["f1", "f2", "v1", "v2"])
    notes = {r["variable"]: r["note"] for r in tables["outliers"].collect()}
    assert notes["f1"] == "entry_error" and tables["summary"].first()["entry_error_variables"] == 1
    assert tables["normality"].count() == 4


def test_shapiro_known_values():
    # The worked example of the published test (weights of eleven men).
    w, p = D.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float))
    assert abs(w - 0.79) < 0.005 and 0.004 < p < 0.009
    rng = np.random.default_rng(0)
    assert D.shapiro_wilk(rng.normal(size=2000))[1] > 0.05 > D.shapiro_wilk(rng.exponential(size=200))[1]


def test_student_and_normal():
    assert np.allclose(D.student_sf([2.0, 0.0, -2.0, 1.96], [10, 5, 10, 1e7]), [0.03669402, 0.5, 0.96330598, 0.0249979], atol=1e-6)
    assert np.isnan(D.student_sf([np.nan], [5])[0])
    assert np.allclose(D.normal_cdf([0.0, 1.959963984540054]), [0.5, 0.975])


def test_ks_distance(spark):
    x = np.random.default_rng(5).exponential(size=800).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    f = D.normal_cdf(z)
    n = len(z)
    want = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    row = screening.ks_table(df, profile.column_stats(df, ["x"], quartiles=False)).first()
    assert abs(row["d"] - want) < 1e-12 and row["p"] < 1e-6
    long_way = screening.ks_distance(df, "x", float(x.mean()), float(x.std(ddof=1)), 800).first()["d"]
    assert abs(long_way - want) < 1e-12


def test_moments_by_hot_key(spark):
    rng = np.random.default_rng(2)
    key = np.where(rng.random(4000) < 0.7, 0, rng.integers(1, 300, 4000))
    x = rng.normal(size=(4000, 2)) + key[:, None]
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(key, x)], "k int, a double, b double").repartition(7)
    got = moment_table(df, ["a", "b"], ["k"]).filter("k = 0 and left = 'a' and right = 'b'").first()
    hot = x[key == 0]
    assert got["n"] == len(hot) and abs(got["correlation"] - np.corrcoef(hot.T)[0, 1]) < 1e-12


def test_mean_imputation_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 5.0), ("b", None)], "g string, v double")
    got = prepare.impute_means(df, ["v"], ["g"]).groupBy("g").agg(F.sum("v").alias("s")).collect()
    assert {r["g"]: r["s"] for r in got} == {"a": 2.0, "b": 10.0}


def test_ranges_of_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in prepare.rescale_percent(df, ["a", "b"]).collect()] == [(0.0, 50.0), (100.0, 50.0)]
    assert prepare.standardise(df, ["a", "b"]).count() == 0
    assert SPEC.chains() == [("Frequency", "Volume", "Value")]


def test_summaries_merge_to_those_of_the_whole():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.gamma(2, 1e3, 5000) + 1e7, rng.integers(0, 9, 700), [np.nan] * 31])
    rng.shuffle(x)
    parts = [summary.summarise(p) for p in np.array_split(x, 23)] + [summary.summarise(np.array([np.nan])), summary.Summary()]
    one = summary.combined([summary.combined(parts[:9]), summary.combined(parts[9:])])
    v = pd.Series(x[~np.isnan(x)])
    assert (one.total, one.n, one.low, one.high, one.many) == (len(x) + 1, len(v), v.min(), v.max(), True)
    assert one.whole == bool(((v - v.round()).abs() <= 1e-8 + 1e-5 * v.round().abs()).all())
    assert np.allclose(summary.moment_values(one), (v.mean(), v.std(), v.skew(), v.kurt()), rtol=1e-9)
    few = summary.combined([summary.summarise(p) for p in np.array_split(np.arange(3000) % 700 / 2, 11)])
    assert not few.many and few.given.tolist() == sorted(set((np.arange(700) / 2).tolist())) and few.times.sum() == 3000


def jobs(spark, run):
    """Spark jobs that an action takes."""
    tracker = spark.sparkContext.statusTracker()
    name = f"counted-{id(run)}"
    spark.sparkContext.setJobGroup(name, name)
    run()
    found = len(tracker.getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("others", "others")
    return found


def test_quartiles_are_exact_and_jobs_do_not_grow_with_columns(spark, monkeypatch):
    n, wide = 30_000, 9
    rng = np.random.default_rng(5)
    data = pd.DataFrame({f"x{k}": np.where(rng.random(n) < 0.1 * (k % 2), np.nan, np.round(rng.normal(size=n) * 10**k, 3)) for k in range(wide)})
    data["x1"] = np.where(rng.random(n) < 0.4, 7.25, data["x1"])  # ties across a quartile
    df = spark.createDataFrame(data).repartition(6)
    names = list(data.columns)
    got = {r["variable"]: r for r in profile.column_stats(df, names).collect()}
    for c in names:
        v = data[c].dropna()
        assert np.allclose([got[c]["q1"], got[c]["median"], got[c]["q3"]], np.quantile(v, [0.25, 0.5, 0.75]), rtol=1e-12) and got[c]["n"] == len(v)
    df.persist().count()
    every, two = (lambda: profile.column_stats(df, names)), (lambda: profile.column_stats(df, names[:2]))
    assert jobs(spark, every) == jobs(spark, two)
    df.unpersist()
    monkeypatch.setattr(summary, "INSIDE", 50)  # brackets that hold too much
    again = {r["variable"]: r for r in profile.column_stats(df, names[:2]).collect()}
    assert all(np.allclose([again[c][q] for q in ("q1", "median", "q3")], [got[c][q] for q in ("q1", "median", "q3")], rtol=1e-12) for c in names[:2])


def test_statistics_of_awkward_columns(spark):
    df = spark.createDataFrame([(None, 5.0, "1,5", None), (None, 5.0, "x", 1.0), (float("nan"), 5.0, " 2 ", 3.0)], "a double, b double, c string, d double")
    got = {r["variable"]: r for r in profile.column_stats(df, ["a", "b", "c", "d"]).collect()}
    assert (got["a"]["n"], got["a"]["total"], got["a"]["mean"], got["a"]["median"], got["a"]["few"]) == (0, 3, None, None, 0)
    assert (got["b"]["sd"], got["b"]["skew"], got["b"]["kurt"], got["b"]["few"]) == (0.0, 0.0, None, 1)
    assert (got["c"]["n"], got["c"]["mean"], got["c"]["median"]) == (2, 1.75, 1.75) and (got["d"]["q1"], got["d"]["whole"]) == (1.5, True)
    assert profile.column_stats(df.limit(0), ["a", "b"]).collect()[0]["total"] == 0
