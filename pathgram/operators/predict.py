"""Cross-validated prediction of endogenous indicators and constructs.

Every prediction is linear in the exogenous indicators, so a fold's model is one
small coefficient matrix. Training moments come from merging the other folds'
moments; rows are scored where they lie, once for all repetitions, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathgram.functions.columns import col
from pathgram.functions.cuts import fold_numbers, fold_sizes, rank_cuts
from pathgram.functions.hashing import lane, lane_array
from pathgram.functions.layout import spread
from pathgram.functions.ordering import exact_quantiles
from pathgram.operators.algebra import estimate_weights, path_matrix, solve
from pathgram.operators.moments import Moments, combine, from_rows, merge_by, replicated_parts
from pathgram.operators.prepare import prepare
from pathgram.operators.profile import basic_stats
from pathgram.spec import FitSettings, ModelError, ModelSpec

MIN_TRAIN = 10


def assign_folds(df: DataFrame, case_id: str, folds: int = 10, repetitions: int = 10, seed: int = 12345) -> DataFrame:
    """(case, repetition, fold): near-equal folds in the order of a per-repetition hash."""
    rows = df.count()
    ranks = list(np.cumsum(fold_sizes(rows, folds))[:-1])
    ranks = [k for k in ranks if 0 < k < rows]
    cuts = rank_cuts(df, case_id, rows, repetitions, ranks, seed)
    table = df.sparkSession.createDataFrame(
        [(r, [(int(a), int(b)) for a, b in cuts[r]]) for r in range(repetitions)],
        "repetition long, cuts array<struct<lane: long, case: long>>",
    )
    numbered = df.select(col(case_id).cast("long").alias("case_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repetitions - 1).cast("long"))).alias("repetition"))
    here = F.struct(lane(F.col("case_id"), F.col("repetition"), seed).alias("lane"), F.col("case_id").alias("case"))
    passed = F.size(F.filter("cuts", lambda c: c < here))
    return numbered.join(F.broadcast(table), "repetition").select("case_id", "repetition", (passed + 1).cast("long").alias("fold"))


@dataclass
class Outputs:
    """Names of the predicted columns, in coefficient order."""

    endo_items: list[str]
    endo: list[str]
    exo_items: list[str]

    @property
    def columns(self) -> list[str]:
        return ([f"pls_{i}" for i in self.endo_items] + [f"lm_{i}" for i in self.endo_items]
                + [f"pred_{c}" for c in self.endo] + [f"score_{c}" for c in self.endo])


def outputs(spec: ModelSpec) -> Outputs:
    if not spec.endogenous:
        raise ModelError("the model has no endogenous construct to predict")
    return Outputs([i for c in spec.endogenous for i in spec.constructs[c]], spec.endogenous,
                   list(dict.fromkeys(i for c in spec.exogenous for i in spec.constructs[c])))


def fold_coefficients(m: Moments, spec: ModelSpec, settings: FitSettings) -> np.ndarray:
    """Rows: outputs of ``Outputs.columns``; columns: intercept, then every indicator."""
    plain = ModelSpec(spec.constructs, spec.paths, spec.modes)  # product terms take no part in prediction
    names, items, o = plain.names, plain.indicators, outputs(plain)
    at, column = {c: k for k, c in enumerate(names)}, {i: k for k, i in enumerate(items)}
    r, sd, mean = m.correlation(), m.sd(), m.mean
    # An indicator that is constant in training has score 0 and is predicted by its mean.
    still = np.diag(m.scatter) <= m.n * (1e-13 * np.abs(mean)) ** 2
    r[still, :] = r[:, still] = 0.0
    r[still, still] = 1.0
    sd = np.where(still, 0.0, sd)
    reach = np.where(still, np.inf, sd)
    w = estimate_weights(r, plain, settings)
    paths, _ = path_matrix(w.unit.T @ r @ w.unit, plain)
    slope = w.unit / reach[:, None]
    measured = np.column_stack([-(mean @ slope), slope.T])  # construct x (1 + items)
    structural = np.zeros_like(measured)
    for c in plain.causal_order():
        before = [s for s, t in plain.paths if t == c]
        structural[at[c]] = measured[at[c]] if not before else sum(paths[at[s], at[c]] * structural[at[s]] for s in before)
    loadings = r @ w.unit
    rows = []
    for c in o.endo:
        for i in plain.constructs[c]:
            row = structural[at[c]] * loadings[column[i], at[c]] * sd[column[i]]
            row = row.copy()
            row[0] += mean[column[i]]
            rows.append(row)
    exo = [column[i] for i in o.exo_items]
    for i in o.endo_items:
        row = np.zeros(1 + len(items))
        if exo:
            beta = solve(r[np.ix_(exo, exo)], r[exo, column[i]]) * sd[column[i]] / reach[exo]
            row[0] = mean[column[i]] - beta @ mean[exo]
            row[1 + np.array(exo)] = beta
        else:
            row[:] = np.nan
        rows.append(row)
    rows += [structural[at[c]] for c in o.endo] + [measured[at[c]] for c in o.endo]
    return np.array(rows)


def predict_cases(df: DataFrame, spec: ModelSpec, case_id: str, folds: int = 10, repetitions: int = 10,
                  settings: FitSettings = FitSettings()) -> DataFrame:
    """Per case: actual endogenous indicators and out-of-sample predictions averaged over repetitions."""
    spec.check(df.columns)
    folds, repetitions, seed = max(2, folds), max(1, repetitions), settings.seed
    items, o = spec.indicators, outputs(spec)
    table, _ = prepare(df, items, settings.missing, keep=[case_id])
    rows = table.count()
    ranks = [int(k) for k in np.cumsum(fold_sizes(rows, folds))[:-1] if 0 < k < rows]
    cuts = rank_cuts(table, case_id, rows, repetitions, ranks, seed)

    def members(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        which, place = np.unique(numbers // folds, return_inverse=True)
        fold = fold_numbers(lane_array(ids, which, seed), ids, cuts[which])
        return (fold[:, place] == (numbers % folds)[None, :]).astype(float)

    parts = replicated_parts(table, case_id, items, folds * repetitions, members)
    parts = parts.withColumn("repetition", F.floor(F.col("replicate") / folds))
    least = max(MIN_TRAIN, len(spec.names) + 2)

    def train(key, pdf):
        held = {int(f) % folds: from_rows(g) for f, g in pdf.groupby("replicate")}
        out = []
        for f in held:
            others = [m for g, m in held.items() if g != f]
            if not others:
                continue
            m = combine(np.array([x.n for x in others]), np.stack([x.mean for x in others]),
                        np.stack([x.scatter for x in others]))
            if m.n >= least:
                out.append({"repetition": key[0], "fold": f, "slope": fold_coefficients(m, spec, settings).ravel()})
        return pd.DataFrame(out, columns=["repetition", "fold", "slope"])

    found = merge_by(parts, ["repetition"], train, "repetition long, fold long, slope array<double>", repetitions).collect()
    size = (len(o.columns), 1 + len(items))
    slopes = np.full((repetitions, folds, *size), np.nan)
    for r in found:
        slopes[r["repetition"], r["fold"]] = np.array(r["slope"]).reshape(size)
    shared = df.sparkSession.sparkContext.broadcast(slopes)  # folds x repetitions small matrices

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(repetitions, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            x = np.column_stack([np.ones(len(ids))] + [
                batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(items))])
            fold = fold_numbers(lane_array(ids, numbers, seed), ids, cuts)
            total, seen = np.zeros((len(ids), size[0])), np.zeros(len(ids))
            for rep in range(repetitions):
                for f in range(folds):
                    here = np.flatnonzero(fold[:, rep] == f)
                    if len(here) and np.isfinite(shared.value[rep, f]).any():
                        total[here] += x[here] @ shared.value[rep, f].T
                        seen[here] += 1
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = total / seen[:, None]
            arrays = [batch.column(0)] + [batch.column(1 + items.index(i)) for i in o.endo_items]
            arrays += [pa.array(mean[:, k], from_pandas=True) for k in range(size[0])]
            yield pa.RecordBatch.from_arrays(arrays, names=["case_id", *o.endo_items, *o.columns])

    schema = T.StructType([T.StructField("case_id", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in [*o.endo_items, *o.columns]])
    source = spread(table.select(col(case_id).cast("long").alias("case_id"), *[col(i) for i in items]))
    return source.mapInArrow(score, schema)


def holdout(cases: DataFrame, pairs: Sequence[tuple[str, str, str]], skip_zeros: bool = True) -> DataFrame:
    """(name, rmse, mae, mape, q2) for (name, actual column, predicted column); one scan.

    The baseline of q2 is the mean of the actual values that are scored. Actual values of zero are left out of mape;
    without ``skip_zeros`` they count as in IEEE division, so one of them makes mape infinite (NaN for zero by zero).
    """
    long = cases.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), col(a).alias("actual"), col(p).alias("predicted")) for n, a, p in pairs
    ]))).filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull() & ~F.isnan("predicted"))
    error = F.col("actual") - F.col("predicted")
    spread_ = F.var_pop("actual") * F.count(F.lit(1))
    by_zero = F.when(error == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    share = F.when(F.col("actual") != 0, F.abs(error / F.when(F.col("actual") != 0, F.col("actual")))).otherwise(by_zero)
    if skip_zeros:
        share = F.when(F.abs("actual") > 1e-12, share)
    return long.groupBy("name").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(share) * 100).alias("mape"),
        F.when(spread_ > 0, 1 - F.sum(error * error) / spread_).alias("q2_predict"),
    )


def indicator_metrics(cases: DataFrame, spec: ModelSpec, skip_zeros: bool = True) -> DataFrame:
    return holdout(cases, [(i, i, f"pls_{i}") for i in outputs(spec).endo_items], skip_zeros)


def benchmark_metrics(cases: DataFrame, spec: ModelSpec, skip_zeros: bool = True) -> DataFrame:
    return holdout(cases, [(i, i, f"lm_{i}") for i in outputs(spec).endo_items], skip_zeros)


def construct_metrics(cases: DataFrame, spec: ModelSpec) -> DataFrame:
    return holdout(cases, [(c, f"score_{c}", f"pred_{c}") for c in outputs(spec).endo]).drop("mape")


def compare(pls: DataFrame, lm: DataFrame) -> DataFrame:
    """Errors side by side; a negative difference favours the path model."""
    a = pls.select("name", F.col("rmse").alias("pls_rmse"), F.col("mae").alias("pls_mae"))
    b = lm.select("name", F.col("rmse").alias("lm_rmse"), F.col("mae").alias("lm_mae"))
    return a.join(b, "name").withColumn("rmse_difference", F.col("pls_rmse") - F.col("lm_rmse")).withColumn(
        "mae_difference", F.col("pls_mae") - F.col("lm_mae"))


def cross_validated_q2(constructs: DataFrame) -> DataFrame:
    """Predictive relevance as reported: the construct-level holdout q2."""
    return constructs.select("name", F.col("q2_predict").alias("q2_cv"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, range, sd and sd-standardised (ddof 1) skewness and excess kurtosis."""
    columns = list(columns)
    cuts = exact_quantiles(df, columns, [0.5])
    middle = df.sparkSession.createDataFrame([(c, cuts[c][0]) for c in columns], "variable string, median double")
    n = F.col("n").cast("double")
    ratio = (n - 1) / n
    g1 = F.col("skew") * (n - 2) / F.sqrt(n * (n - 1))
    g2 = (F.col("kurt") * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1)
    ok = (F.col("sd") > 0) & (n > 3)
    return basic_stats(df, columns).join(F.broadcast(middle), "variable").select(
        "variable", "mean", "median", "low", "high", "sd",
        F.when(ok, g1 * F.pow(ratio, F.lit(1.5))).alias("skew"),
        F.when(ok, (g2 + 3) * ratio * ratio - 3).alias("kurt"),
        "n",
    )


def describe_predictions(cases: DataFrame, spec: ModelSpec) -> DataFrame:
    """Descriptives of predictions and errors of indicators and constructs."""
    o = outputs(spec)
    values = [f"pls_{i}" for i in o.endo_items] + [f"pred_{c}" for c in o.endo]
    errors = {f"error_{i}": col(i) - col(f"pls_{i}") for i in o.endo_items}
    errors |= {f"error_{c}": col(f"score_{c}") - col(f"pred_{c}") for c in o.endo}
    wide = cases.select(*[col(v) for v in values], *[e.alias(n) for n, e in errors.items()])
    return describe(wide, [*values, *errors])
