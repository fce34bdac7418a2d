"""Tables whose customers lack lines or discounts, samples that are computed twice, extremes with ties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.operators import predict as PD
from pathgram.operators import profile as PR
from pathgram.operators import resample as RS
from pathgram.plans import catalogue
from pathgram.plans.fixtures import SPEC, customer_indicators

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A few customers have many orders but no lines; one has lines without a discount."""
    folder = str(tmp_path_factory.mktemp("odd"))
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    orders, key = read("orders"), F.col("o_custkey")
    bare = key % 100 == 3
    owner = orders.select(F.col("o_orderkey").alias("l_orderkey"), key)
    lines = read("lineitem").join(owner, "l_orderkey", "left").filter(~bare)
    lines.withColumn("l_discount", F.when(key == 8, 0.0).otherwise(F.col("l_discount"))).drop("o_custkey").write.parquet(f"{folder}/lineitem.parquet")
    orders.withColumn("o_custkey", F.when(bare, F.lit(3).cast("long")).otherwise(key)).write.parquet(f"{folder}/orders.parquet")
    read("customer").write.parquet(f"{folder}/customer.parquet")
    return folder


def test_outliers_are_those_of_complete_cases(spark, odd):
    cases = customer_indicators(spark, odd).select("acctbal", *SPEC.indicators).toPandas()
    assert cases["n_orders"].notna().sum() > cases["n_lines"].notna().sum()
    cases = cases.dropna(subset=SPEC.indicators)
    near = {r.variable: r for r in catalogue.QUERIES["c11_iqr_outliers"](spark, odd).collect()}
    far = {r.variable: r.z_outliers for r in catalogue.QUERIES["c10_z_outliers"](spark, odd).collect()}
    for c in cases:
        x = cases[c].to_numpy()
        q1, q3 = np.quantile(x, [0.25, 0.75])
        for name, reach in (("iqr_mild", 1.5), ("iqr_severe", 3)):
            assert near[c][name] == ((x < q1 - reach * (q3 - q1)) | (x > q3 + reach * (q3 - q1))).sum()
        assert far[c] == (np.abs(x - x.mean()) / x.std(ddof=1) > 3.29).sum()


@pytest.mark.parametrize("name", ["f14_predict_indicators", "f16_linear_benchmark"])
def test_a_zero_among_actual_values_counts_as_in_sql(spark, odd, name):
    found = {r["name"]: r.mape for r in catalogue.QUERIES[name](spark, odd).collect()}
    assert found["disc_amt"] == math.inf and all(math.isfinite(v) for k, v in found.items() if k != "disc_amt")


def test_mape_leaves_zeros_out_unless_told_otherwise(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, p double")
    assert PD.holdout(df, [("x", "a", "p")]).first().mape == 50.0
    assert PD.holdout(df, [("x", "a", "p")], skip_zeros=False).first().mape == math.inf


def test_bins_belong_to_the_values_that_are_counted(spark):
    """Samples whose last digits change with every evaluation."""
    @F.pandas_udf(T.DoubleType())
    def shaky(v: pd.Series) -> pd.Series:
        return v * (1 + np.random.default_rng().normal(0, 1e-13, len(v)))

    drawn = spark.range(40 * 30).select(F.lit("path").alias("metric"), (F.col("id") % 40).cast("string").alias("label"),
                                        shaky((F.col("id") % 97 + 1).cast("double")).alias("value"))
    rows = RS.bootstrap_histograms(drawn).toPandas()
    assert rows["bin"].min() == 0 and rows["count"].sum() == 1200
    assert (rows.groupby("label")["bin"].min() == 0).all() and (rows.groupby("label")["bin"].max() == RS.BINS - 1).all()


def test_extremes_need_one_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": rng.permutation(4000), "a": rng.integers(0, 9, 4000).astype(float), "b": rng.normal(size=4000)})
    pdf.loc[pdf["id"] % 7 == 0, "b"] = None
    pdf["c"] = np.where(pdf["id"] < 3, 1.0, None).astype(float)  # fewer values than ranks
    spark.createDataFrame(pdf).repartition(6).write.parquet(str(tmp_path / "t"))
    found = PR.extremes(spark.read.parquet(str(tmp_path / "t")), "id", ["a", "b", "c"], 5)
    assert found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan") == 1
    got = {(r.variable, r.side, r.rank): (r.value, r.case_id) for r in found.collect()}
    want = {}
    for c in "abc":
        here = pdf.dropna(subset=[c])
        for side, up in (("low", True), ("high", False)):
            top = here.sort_values([c, "id"], ascending=up).head(5)
            want |= {(c, side, k + 1): (v, i) for k, (v, i) in enumerate(zip(top[c], top["id"]))}
    assert got == want


@pytest.mark.parametrize("n, block", [(5000, None), (700, 64)])
def test_exact_draws_of_many_blocks_are_those_of_the_sql(spark, n, block):
    """Every replicate draws n times from all n cases, not block by block."""
    from pathgram.functions.draws import DRAW_STREAM, deal
    from pathgram.functions.hashing import lane_array

    table = spark.range(1, n + 1).toDF("number").repartition(5)
    found = {r.number: np.frombuffer(r.w, np.uint32) for r in deal(table, "number", n, 4, 11, "w", block).collect()}
    place = lane_array(np.arange(n), np.arange(4), 11 + DRAW_STREAM) % n
    want = np.stack([np.bincount(place[:, k], minlength=n) for k in range(4)], axis=1)
    assert len(found) == n and all((found[k + 1] == want[k]).all() for k in range(n))


def test_exact_bootstrap_beyond_one_block(spark):
    from pathgram.functions.draws import DRAW_STREAM
    from pathgram.functions.hashing import lane_array
    from pathgram.spec import FitSettings, ModelSpec

    n = 4200  # more than a block
    rng = np.random.default_rng(5)
    x = rng.normal(size=n)
    y = 0.6 * x + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n) * 3, "x": x, "y": y}))
    spec = ModelSpec(constructs={"X": ["x"], "Y": ["y"]}, paths=[("X", "Y")])
    found = {r.replicate: r.value for r in RS.bootstrap_samples(df, spec, "id", 3, exact=True).filter("metric = 'path'").collect()}
    place = lane_array(np.arange(n), np.arange(3), FitSettings().seed + DRAW_STREAM) % n
    for k in range(3):
        assert found[k] == pytest.approx(np.corrcoef(x[place[:, k]], y[place[:, k]])[0, 1], abs=1e-9)
