import numpy as np
import pytest

import rowwise
from pathgram.operators.fit import fit_by, fit_model
from pathgram.plans.fixtures import SPEC
from pathgram.spec import Effect, FitSettings, ModelError, ModelSpec

TIGHT = FitSettings(stop=1e-12)
REFERENCE = {
    "Frequency": [0.6086163727, 0.5297090438, 0.5907575135],
    "Volume": [0.6663078937, 0.6458004371, 0.3727942947],
    "Value": [0.5946308042, 0.5696517314, 0.5673721104],
}


def values(metrics, metric):
    return {r["label"]: r["value"] for r in metrics.filter(metrics.metric == metric).collect()}


def test_reference_weights(fx):
    model = fit_model(fx, SPEC)
    assert model.weights.iterations == 4 and model.weights.converged
    for k, (name, block) in enumerate(zip(SPEC.names, SPEC.blocks())):
        assert np.allclose(model.weights.raw[block, k], REFERENCE[name], atol=1e-8)


@pytest.mark.parametrize("scheme", ["path", "factor", "centroid"])
@pytest.mark.parametrize("modes", [{}, {"Frequency": "formative"}, {c: "formative" for c in SPEC.names}])
def test_matrix_form_equals_row_form(fx, rows, scheme, modes):
    spec = ModelSpec(SPEC.constructs, SPEC.paths, modes)
    model = fit_model(fx, spec, FitSettings(scheme=scheme, stop=1e-12))
    w, s, _ = rowwise.fit(rows[spec.indicators].to_numpy(), spec, scheme)
    for k, block in enumerate(spec.blocks()):
        assert np.allclose(model.weights.raw[block, k], w[k], atol=1e-7)
    corr = model.weights.unit.T @ model.moments.correlation() @ model.weights.unit
    assert np.allclose(corr, np.corrcoef(s.T), atol=1e-8)


def test_scores_and_effects(fx, rows):
    spec = ModelSpec(SPEC.constructs, SPEC.paths, effects=[
        Effect("interaction", "FxV", "Value", predictor="Frequency", moderator="Volume"),
        Effect("quadratic", "F2", "Value", source="Frequency"), Effect("quadratic", "bad", "Value", source="nowhere")])
    model = fit_model(fx, spec, TIGHT)
    assert any("bad" in w for w in model.warnings)
    _, s, _ = rowwise.fit(rows[spec.indicators].to_numpy(), spec)
    got = model.scores(fx, ["case_id"]).toPandas().sort_values("case_id")
    assert np.allclose(got[spec.names].to_numpy(), s, atol=1e-7)
    terms = np.column_stack([s[:, 1], s[:, 0], rowwise.scale(s[:, 0] * s[:, 1]), rowwise.scale(s[:, 0] ** 2)])
    beta, r2 = rowwise.regress(terms, s[:, 2])
    paths = values(model.metrics(), "path")
    found = [paths[f"{a} -> Value"] for a in ("Volume", "Frequency", "FxV", "F2")]
    assert np.allclose(found, beta, atol=1e-6)
    assert abs(values(model.metrics(), "r2")["Value"] - r2) < 1e-8
    keyed = fit_by(fx.selectExpr("*", "1 as one"), spec, ["one"], TIGHT)
    assert np.allclose([values(keyed, "path")[k] for k in sorted(paths)], [paths[k] for k in sorted(paths)], atol=1e-9)


def test_effect_identities(fx):
    m = fit_model(fx, SPEC, TIGHT).metrics()
    total, path, chain, indirect = (values(m, k) for k in ("total", "path", "specific", "total_indirect"))
    assert abs(total["Frequency -> Value"] - path["Frequency -> Value"] - sum(chain.values())) < 1e-12
    assert abs(indirect["Frequency -> Value"] - sum(chain.values())) < 1e-12
    assert values(m, "model_fit")["d_G"] > 0


def test_partitioning_does_not_matter(fx):
    a = fit_model(fx.repartition(1), SPEC, TIGHT).weights.raw
    b = fit_model(fx.repartition(13).orderBy("revenue"), SPEC, TIGHT).weights.raw
    assert np.allclose(a, b, atol=1e-12)


def test_large_means_keep_their_digits(fx):
    shifted = fx.withColumn("revenue", fx.revenue + 1e12)
    a, b = fit_model(fx, SPEC).moments.correlation(), fit_model(shifted, SPEC).moments.correlation()
    assert np.allclose(a, b, atol=1e-6)


def test_preconditions(fx):
    bad = {
        "construct": ModelSpec({"A": []}),
        "unknown": ModelSpec({"A": ["qty"]}, [("A", "B")]),
        "self-loop": ModelSpec({"A": ["qty"]}, [("A", "A")]),
        "cycle": ModelSpec({"A": ["qty"], "B": ["revenue"]}, [("A", "B"), ("B", "A")]),
        "not in the data": ModelSpec({"A": ["nope"]}),
    }
    for text, spec in bad.items():
        with pytest.raises(ModelError, match=text):
            fit_model(fx, spec)
    assert len(ModelSpec({"A": ["x"], "B": ["x"]}, modes={"A": "formative"}).problems()[1]) == 2


def test_guards(fx):
    flat = fx.selectExpr("case_id", *[i for i in SPEC.indicators if i != "qty"], "1.0D as qty")
    with pytest.raises(ModelError, match="zero variance: qty"):
        fit_model(flat, SPEC)
    with pytest.raises(ModelError, match="no complete rows"):
        fit_model(fx.filter("case_id < 0"), SPEC)


def test_single_indicator_blocks(fx):
    spec = ModelSpec({"A": ["n_orders"], "B": ["revenue"]}, [("A", "B")])
    m = fit_model(fx, spec).metrics()
    assert values(m, "Cronbach alpha") == {"A": 1.0, "B": 1.0}
    assert values(m, "htmt") == {} and values(m, "htmt_other") == {"A <-> B": None}
