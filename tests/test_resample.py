import numpy as np
import pytest

import rowwise
from pathgram.functions.cuts import fold_numbers, fold_sizes, rank_cuts
from pathgram.functions.draws import exact_counts
from pathgram.functions.hashing import lane, lane_array, poisson_array
from pathgram.operators import groups, predict
from pathgram.operators import resample as rs
from pathgram.operators.fit import fit_model
from pathgram.operators.metrics import flat
from pathgram.plans.fixtures import SPEC
from pathgram.spec import Effect, FitSettings, ModelSpec

TIGHT = FitSettings(stop=1e-12)


def test_hash_is_the_same_in_both_forms(spark):
    from pyspark.sql import functions as F

    ids = np.array([1, 2, 77, 2**31 + 5, 10**11 + 3], dtype=np.int64)
    got = spark.createDataFrame([(int(i),) for i in ids], "i long").select("i", *[lane(F.col("i"), r, 42).alias(f"r{r}") for r in (0, 5)])
    got = {r["i"]: (r["r0"], r["r5"]) for r in got.collect()}
    want = lane_array(ids, np.array([0, 5]), 42)
    assert [got[int(i)] for i in ids] == [tuple(w) for w in want.tolist()]
    assert (want >= 0).all()


def test_poisson_weights():
    w = poisson_array(np.arange(20000), np.arange(50), 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_same_samples_under_any_partitioning(fx):
    def draw(n):
        out = rs.bootstrap_samples(fx.repartition(n), SPEC, "case_id", 12, TIGHT, wanted=("path",)).toPandas()
        return out.sort_values(["replicate", "label"])["value"].to_numpy()

    assert np.allclose(draw(1), draw(4), atol=1e-10) and np.allclose(draw(1), draw(16), atol=1e-10)


def test_bootstrap_matches_multinomial_resampling(fx, rows):
    x = rows[SPEC.indicators].to_numpy()
    rng = np.random.default_rng(1)
    want = []
    for _ in range(150):
        _, s, _ = rowwise.fit(x[rng.integers(0, len(x), len(x))], SPEC)
        want.append(np.corrcoef(s[:, 0], s[:, 1])[0, 1])
    got = rs.bootstrap_samples(fx, SPEC, "case_id", 300, TIGHT, wanted=("path",))
    got = got.filter("label = 'Frequency -> Volume'").toPandas()["value"]
    assert len(got) == 300
    assert abs(got.mean() - np.mean(want)) < 0.01
    assert 0.75 < got.std() / np.std(want, ddof=1) < 1.35


def test_weighted_replicate_equals_repeated_rows(fx, rows):
    got = rs.bootstrap_samples(fx, SPEC, "case_id", 3, TIGHT, wanted=("weight",)).toPandas()
    weights = poisson_array(rows["case_id"].to_numpy(), np.arange(3), TIGHT.seed).astype(int)
    for b in range(3):
        x = rows[SPEC.indicators].to_numpy().repeat(weights[:, b], axis=0)
        w, _, _ = rowwise.fit(x, SPEC)
        mine = got[got["replicate"] == b].set_index("source")["value"]
        assert np.allclose(mine[SPEC.indicators], np.concatenate(w), atol=1e-7)


def test_replicates_with_product_terms(fx, rows):
    spec = ModelSpec(SPEC.constructs, SPEC.paths, effects=[Effect("quadratic", "F2", "Value", source="Frequency")])
    got = rs.bootstrap_samples(fx, spec, "case_id", 2, TIGHT, wanted=("path",)).toPandas()
    weights = poisson_array(rows["case_id"].to_numpy(), np.arange(2), TIGHT.seed).astype(int)
    x = rows[SPEC.indicators].to_numpy().repeat(weights[:, 1], axis=0)
    _, s, _ = rowwise.fit(x, SPEC)
    beta, _ = rowwise.regress(np.column_stack([s[:, 0], s[:, 1], s[:, 0] ** 2 - 0]), s[:, 2])
    scaled = beta[2] * (s[:, 0] ** 2).std(ddof=1)
    mine = got[(got["replicate"] == 1) & (got["label"] == "F2 -> Value")]["value"].iloc[0]
    assert abs(mine - scaled) < 1e-7


def test_summary(spark):
    draws = np.random.default_rng(0).normal(0.4, 0.1, 500)
    samples = spark.createDataFrame([(k, "path:a", float(v)) for k, v in enumerate(draws)], "replicate long, metric string, value double")
    original = spark.createDataFrame([("path:a", 0.42), ("path:none", 1.0)], "metric string, value double")
    out = {r["metric"]: r for r in rs.bootstrap_summary(samples, original).collect()}
    a = out["path:a"]
    assert a["valid"] == 500 and abs(a["bias"] - (draws.mean() - 0.42)) < 1e-12
    assert np.allclose([a["ci_low"], a["ci_high"]], np.quantile(draws, [0.025, 0.975]))
    from statistics import NormalDist

    z0 = NormalDist().inv_cdf((draws < 0.42).mean())
    want = np.quantile(draws, [NormalDist().cdf(2 * z0 - 1.959963984540054), NormalDist().cdf(2 * z0 + 1.959963984540054)])
    assert np.allclose([a["bc_low"], a["bc_high"]], want, atol=1e-9)
    assert out["path:none"]["valid"] == 0 and out["path:none"]["mean"] is None and out["path:none"]["p_value"] is None
    report = rs.bootstrap_report(rs.bootstrap_summary(samples, original)).collect()
    assert {r["shape"] for r in report} == {"stats", "ci", "ci_bc"} and {r["section"] for r in report} == {"path_coefficients"}


def test_flat_keys_of_fit_and_bootstrap_agree(fx):
    base = {r["metric"] for r in flat(fit_model(fx, SPEC).metrics()).collect()}
    drawn = rs.bootstrap_samples(fx, SPEC, "case_id", 2).select("metric", "label").distinct().collect()
    assert base == {f"{r['metric']}:{r['label']}" for r in drawn}


@pytest.mark.parametrize("share", [0.1, 0.5, 0.93])
def test_rank_cuts_against_a_full_sort(spark, share):
    ids = np.arange(3, 4003, 2, dtype=np.int64)
    df = spark.createDataFrame([(int(i),) for i in ids], "case_id long")
    k = int(len(ids) * share)
    cuts = rank_cuts(df, "case_id", len(ids), 9, [k], 5)
    lanes = lane_array(ids, np.arange(9), 5)
    for b in range(9):
        order = sorted(zip(lanes[:, b].tolist(), ids.tolist()))
        assert tuple(cuts[b, 0]) == order[k - 1]


def test_folds_are_near_equal(spark):
    ids = np.arange(1, 104, dtype=np.int64)
    df = spark.createDataFrame([(int(i),) for i in ids], "case_id long")
    ranks = list(np.cumsum(fold_sizes(103, 10))[:-1])
    cuts = rank_cuts(df, "case_id", 103, 4, ranks, 1)
    fold = fold_numbers(lane_array(ids, np.arange(4), 1), ids, cuts)
    for r in range(4):
        assert np.bincount(fold[:, r]).tolist() == fold_sizes(103, 10)


def test_prediction_against_row_level_folds(fx, rows):
    k, reps = 5, 2
    got = predict.predict_cases(fx, SPEC, "case_id", k, reps, TIGHT).toPandas().sort_values("case_id").reset_index(drop=True)
    x, ids = rows[SPEC.indicators].to_numpy(), rows["case_id"].to_numpy()
    lanes = lane_array(ids, np.arange(reps), TIGHT.seed)
    endo = ["n_lines", "qty", "n_supp", "revenue", "disc_amt", "tax_amt"]
    pls, lm, score, pred = (np.zeros((len(x), c)) for c in (6, 6, 2, 2))
    for r in range(reps):
        order = sorted(range(len(ids)), key=lambda i: (lanes[i, r], ids[i]))
        for test in np.array_split(np.array(order), k):
            train = np.setdiff1d(np.arange(len(x)), test)
            w, s, _ = rowwise.fit(x[train], SPEC)
            mean, sd = x[train].mean(axis=0), x[train].std(axis=0, ddof=1)
            z = (x - mean) / sd
            raw = np.column_stack([z[:, b] @ v for b, v in zip(SPEC.blocks(), w)])
            f = (raw - raw[train].mean(axis=0)) / raw[train].std(axis=0, ddof=1)
            v_hat = f[:, 0] * regress1(s[:, [0]], s[:, 1])[0]
            b = regress1(s[:, [1, 0]], s[:, 2])
            a_hat = b[0] * v_hat + b[1] * f[:, 0]
            for j, i in enumerate(endo):
                c = SPEC.indicators.index(i)
                lv, hat = (1, v_hat) if j < 3 else (2, a_hat)
                load = np.corrcoef(z[train, c], s[:, lv])[0, 1]
                pls[test, j] += (load * hat * sd[c] + mean[c])[test]
                design = np.column_stack([np.ones(len(x)), x[:, :3]])
                lm[test, j] += (design @ np.linalg.lstsq(design[train], x[train, c], rcond=None)[0])[test]
            score[test] += f[test][:, 1:]
            pred[test] += np.column_stack([v_hat, a_hat])[test]
    assert np.allclose(got[[f"pls_{i}" for i in endo]], pls / reps, rtol=1e-6)
    assert np.allclose(got[[f"lm_{i}" for i in endo]], lm / reps, rtol=1e-6)
    assert np.allclose(got[["score_Volume", "score_Value"]], score / reps, atol=1e-6)
    assert np.allclose(got[["pred_Volume", "pred_Value"]], pred / reps, atol=1e-6)


def regress1(x, y):
    return rowwise.regress(x, y)[0]


def test_group_tests(fx):
    out = groups.multi_group(fx, SPEC, "case_id", "segment", "BUILDING", "MACHINERY", 40, TIGHT).toPandas()
    assert set(out["label"]) == {f"{s} -> {t}" for s, t in SPEC.paths}
    for p in ("p_parametric", "p_welch", "p_mga"):
        assert out[p].between(0, 1).all()
    perm = groups.permutation_test(fx, SPEC, "case_id", "segment", "BUILDING", "MACHINERY", 20, TIGHT).toPandas()
    assert (perm["permutations"] == 20).all() and perm["p_permutation"].between(0, 1).all()
    with pytest.raises(ValueError, match="each group needs"):
        groups.multi_group(fx, SPEC, "case_id", "segment", "BUILDING", "nobody", 5)


def test_exact_draws_add_up_and_do_not_depend_on_the_split():
    n, replicates = 2500, np.arange(40)
    whole = exact_counts(np.arange(n), replicates, n, 42, block=300)
    assert (whole.sum(axis=0) == n).all()
    order = np.random.default_rng(1).permutation(n)
    pieces = np.zeros_like(whole)
    for part in np.array_split(order, 13):
        pieces[part] = exact_counts(part, replicates, n, 42, block=300)
    assert (pieces == whole).all()


def test_exact_draws_are_multinomial():
    """Mean 1, variance 1 - 1/n, covariance -1/n, inside and across blocks; and even over the positions."""
    n, reps = 40, 20_000
    w = exact_counts(np.arange(n), np.arange(reps), n, 7, block=8)
    assert np.abs(w.mean(axis=1) - 1).max() < 5 / np.sqrt(reps) and np.abs(w.var(axis=1) - (1 - 1 / n)).max() < 0.08
    cov = np.cov(w)
    off = cov[~np.eye(n, dtype=bool)]
    assert abs(off.mean() + 1 / n) < 2e-3 and np.abs(off + 1 / n).max() < 0.05
    total = w.sum(axis=1)
    assert ((total - reps) ** 2 / (reps * (1 - 1 / n))).sum() < n + 5 * np.sqrt(2 * n)


def test_exact_draws_of_a_model(fx):
    """A replicate is the model of its drawn rows; sizes are those of the table."""
    rows = fx.dropna().select("case_id", *SPEC.indicators).toPandas().sort_values("case_id").reset_index(drop=True)
    found = rs.bootstrap_samples(fx, SPEC, "case_id", 3, exact=True).filter("metric = 'path'").toPandas()
    again = rs.bootstrap_samples(fx.repartition(7), SPEC, "case_id", 3, exact=True).filter("metric = 'path'").toPandas()
    counts = exact_counts(np.arange(len(rows)), np.arange(3), len(rows), FitSettings().seed)
    for k in range(3):
        drawn = rows.loc[np.repeat(np.arange(len(rows)), counts[:, k].astype(int))].reset_index(drop=True)
        assert len(drawn) == len(rows)
        drawn["case_id"] = np.arange(len(drawn))
        want = fit_model(fx.sparkSession.createDataFrame(drawn), SPEC).metrics().filter("metric = 'path'").toPandas()
        a, b, c = (t.set_index("label")["value"].sort_index() for t in (found[found.replicate == k], again[again.replicate == k], want))
        assert np.allclose(a, c) and np.allclose(a, b)
