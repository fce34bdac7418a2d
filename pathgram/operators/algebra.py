"""Small matrix steps of the path model. Input is a p x p correlation matrix, never rows.

These run inside the task that owns a model's merged moments, so a thousand
bootstrap replicates are a thousand independent groups for Spark to spread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pathgram.spec import FORMATIVE, FitSettings, ModelSpec

CUTOFF = 1e-12


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-norm solution; equals the plain one when ``a`` is regular."""
    if a.size == 1:
        return b / a[0] if a[0, 0] else np.zeros_like(b)
    return np.linalg.pinv(a, rcond=CUTOFF, hermitian=True) @ b


def regression(corr: np.ndarray, predictors: list[int], target: int) -> tuple[np.ndarray, float]:
    """Standardised coefficients and R squared from a correlation matrix."""
    rxx, rxy = corr[np.ix_(predictors, predictors)], corr[predictors, target]
    beta = solve(rxx, rxy)
    return beta, float(2 * beta @ rxy - beta @ rxx @ beta)


@dataclass
class Weights:
    raw: np.ndarray  # p x L, unit-norm columns
    unit: np.ndarray  # p x L, scaled so that scores have unit variance
    iterations: int
    converged: bool


def unit_scale(raw: np.ndarray, r: np.ndarray) -> np.ndarray:
    var = np.einsum("il,ij,jl->l", raw, r, raw)
    return raw / np.sqrt(np.where(var > 0, var, 1.0))


def _inner(c: np.ndarray, edges: list[tuple[int, int]], scheme: str) -> np.ndarray:
    size = len(c)
    linked = np.zeros((size, size), dtype=bool)
    for s, t in edges:
        linked[s, t] = linked[t, s] = True
    base = np.sign(c) if scheme == "centroid" else c
    inner = np.where(linked, base, 0.0)
    if scheme == "path":
        for t in range(size):
            before = [s for s, u in edges if u == t]
            if before:
                beta = solve(c[np.ix_(before, before)], c[before, t])
                inner[before, t] = np.where(beta != 0, beta, c[before, t])
    return inner


def _outer(r: np.ndarray, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray]:
    """Which indicator belongs to which construct, and the inverse blocks that formative weights need."""
    blocks = spec.blocks()
    member = np.zeros((len(r), len(blocks)), dtype=bool)
    inverse = np.zeros((len(blocks), len(r), len(r)))
    for lv, (name, block) in enumerate(zip(spec.names, blocks)):
        member[block, lv] = True
        at = np.ix_(block, block)
        inverse[lv][at] = solve(r[at], np.eye(len(block))) if spec.modes[name] == FORMATIVE else np.eye(len(block))
    return member, inverse


def estimate_weights(r: np.ndarray, spec: ModelSpec, settings: FitSettings) -> Weights:
    """The alternating inner/outer estimation, on the correlation matrix alone.

    All constructs move at once: their inner proxies come from one product, and one projection takes
    the proxies' covariances with the indicators to weights.
    """
    member, inverse = _outer(r, spec)
    at = {c: k for k, c in enumerate(spec.names)}
    edges = [(at[s], at[t]) for s, t in spec.paths]
    raw = member / np.sqrt(member.sum(axis=0))
    moved, rounds = np.inf, 0
    while moved >= settings.stop and rounds < settings.max_iterations:
        loadings = r @ unit_scale(raw, r)
        c = unit_scale(raw, r).T @ loadings
        inner = _inner(c, edges, settings.scheme)
        variance = ((inner.T @ c) * inner.T).sum(axis=1)
        alone = (np.abs(inner).sum(axis=0) <= 1e-8) | (variance <= 0)
        inner = np.where(alone, np.eye(len(c)), inner / np.sqrt(np.where(alone, 1.0, variance)))
        fresh = np.einsum("lij,jl->il", inverse, np.where(member, loadings @ inner, 0.0))
        length = np.linalg.norm(fresh, axis=0)
        lost = ~np.isfinite(length) | (length == 0)
        turned = np.where((fresh * raw).sum(axis=0) < 0, -1.0, 1.0)
        fresh = np.where(lost, raw, fresh * turned / np.where(lost, 1.0, length))
        moved, raw, rounds = float(np.abs(fresh - raw).max()), fresh, rounds + 1
    return Weights(raw, unit_scale(raw, r), rounds, moved < settings.stop)


def equal_weights(r: np.ndarray, spec: ModelSpec) -> Weights:
    raw = np.zeros((len(r), len(spec.names)))
    for lv, block in enumerate(spec.blocks()):
        raw[block, lv] = 1.0
    return Weights(raw, unit_scale(raw, r), 0, True)


def path_matrix(corr: np.ndarray, spec: ModelSpec) -> tuple[np.ndarray, dict[int, float]]:
    names, edges = spec.analysis_names(), spec.analysis_paths()
    at = {c: k for k, c in enumerate(names)}
    paths, r2 = np.zeros((len(names), len(names))), {}
    for target in dict.fromkeys(t for _, t in edges):
        before = [at[s] for s, t in edges if t == target]
        paths[before, at[target]], r2[at[target]] = regression(corr, before, at[target])
    return paths, r2


def total_effects(paths: np.ndarray) -> np.ndarray:
    """Direct plus all indirect effects of an acyclic path matrix.

    Chains of up to 2, 4, 8, ... steps are added by squaring; no chain is longer than the number of constructs.
    """
    reach, power = np.eye(len(paths)) + paths, paths @ paths
    while power.any():
        reach, power = reach + reach @ power, power @ power
    return reach - np.eye(len(paths))


def adjusted(r2: float, n: float, p: int) -> float:
    return 1 - (1 - r2) * (n - 1) / (n - p - 1) if n > p + 1 else float("nan")


def inflation(corr: np.ndarray, others: list[int], own: int) -> float:
    if not others:
        return 1.0
    r2 = regression(corr, others, own)[1]
    return 1.0 / (1.0 - r2) if r2 < 1 else float("inf")


def rho_a(w: np.ndarray, block: np.ndarray, fallback: float) -> float:
    """Consistent reliability: agreement, off the diagonal, of the block with the rank-one matrix of its weights."""
    outer = np.outer(w, w) * ~np.eye(len(w), dtype=bool)
    agreement, own = float((outer * block).sum()), float((outer**2).sum())
    variance = float(w @ block @ w)
    if variance <= 0 or own == 0:
        return fallback
    return float((w @ w) ** 2 * agreement / own / variance)


def mean_off_diagonal(block: np.ndarray) -> float:
    k = len(block)
    return float((block.sum() - np.trace(block)) / (k * (k - 1))) if k > 1 else float("nan")


def structural_rows(corr: np.ndarray, n: float, spec: ModelSpec) -> list[tuple]:
    """Rows (metric, source, target, label, value) of the structural model."""
    names, edges = spec.analysis_names(), spec.analysis_paths()
    at = {c: k for k, c in enumerate(names)}
    paths, r2 = path_matrix(corr, spec)
    rows = []

    def edge(metric, s, t, value):
        rows.append((metric, s, t, f"{s} -> {t}", value))

    for t_index, included in r2.items():
        t = names[t_index]
        before = [s for s, u in edges if u == t]
        rows.append(("r2", t, t, t, included))
        rows.append(("radj", t, t, t, adjusted(included, n, len(before))))
        for s in before:
            others = [at[o] for o in before if o != s]
            excluded = regression(corr, others, t_index)[1] if others else 0.0
            edge("path", s, t, paths[at[s], t_index])
            edge("f2", s, t, (included - excluded) / (1 - included) if included < 1 else float("nan"))
            edge("f2_excluded", s, t, excluded)
            edge("inner_vif", s, t, inflation(corr, others, at[s]))
    total = total_effects(paths)
    for s, t in spec.total_pairs():
        edge("total", s, t, total[at[s], at[t]])
    for s, t in spec.mediated_pairs():
        edge("total_indirect", s, t, total[at[s], at[t]] - paths[at[s], at[t]])
    for chain in spec.chains():
        value = float(np.prod([paths[at[a], at[b]] for a, b in zip(chain, chain[1:])]))
        rows.append(("specific", chain[0], chain[-1], " -> ".join(chain), value))
    return rows


def measurement_rows(r: np.ndarray, weights: Weights, spec: ModelSpec) -> list[tuple]:
    names, items, blocks = spec.names, spec.indicators, spec.blocks()
    loadings = r @ weights.unit
    phi = weights.unit.T @ loadings
    strength = np.abs(r)
    rows = []
    for lv, (name, block) in enumerate(zip(names, blocks)):
        own = loadings[block, lv]
        k = len(block)
        inside = r[np.ix_(block, block)]
        if k == 1:
            alpha = composite = ave = rho = 1.0
        else:
            alpha = k / (k - 1) * (1 - k / inside.sum()) if inside.sum() else float("nan")
            error = np.maximum(0.0, 1 - own**2).sum()
            composite = own.sum() ** 2 / (own.sum() ** 2 + error)
            ave = float((own**2).mean())
            rho = rho_a(weights.raw[block, lv], inside, alpha)
        for metric, value in (
            ("Cronbach alpha", alpha), ("Composite reliability", composite), ("AVE", ave), ("rho_A", rho),
        ):
            rows.append((metric, name, name, name, value))
        rows.append(("fornell_larcker", name, name, f"{name} <-> {name}", np.sqrt(ave)))
        for i in block:
            label = f"{items[i]} <- {name}"
            rows.append(("loading", items[i], name, label, loadings[i, lv]))
            rows.append(("weight", items[i], name, label, weights.raw[i, lv]))
            rows.append(("outer_vif", items[i], name, label, inflation(r, [o for o in block if o != i], i)))
        for i, item in enumerate(items):
            rows.append(("cross_loading", item, name, f"{item} <- {name}", loadings[i, lv]))
    inside = [mean_off_diagonal(strength[np.ix_(b, b)]) for b in blocks]
    for a, first in enumerate(names):
        for b, second in enumerate(names):
            if a >= b:
                continue
            label = f"{first} <-> {second}"
            scale = inside[a] * inside[b]
            htmt = float(strength[np.ix_(blocks[a], blocks[b])].mean()) / np.sqrt(scale) if scale > 0 else float("nan")
            eligible = FORMATIVE not in (spec.modes[first], spec.modes[second]) and np.isfinite(scale)
            rows.append(("htmt" if eligible else "htmt_other", first, second, label, htmt))
            rows.append(("lvcorr", first, second, label, phi[a, b]))
            rows.append(("fornell_larcker", second, first, f"{second} <-> {first}", phi[a, b]))
    member = np.zeros_like(loadings)
    for lv, block in enumerate(blocks):
        member[block, lv] = loadings[block, lv]
    implied = member @ phi @ member.T
    np.fill_diagonal(implied, 1.0)
    p = len(r)
    if p > 1:
        misfit = float((np.triu(r - implied, 1) ** 2).sum())
        rows.append(("model_fit", "SRMR", "SRMR", "SRMR", np.sqrt(misfit / (p * (p + 1) / 2))))
        rows.append(("model_fit", "d_ULS", "d_ULS", "d_ULS", misfit))
    rows.append(("model_fit", "d_G", "d_G", "d_G", geodesic(r, implied)))
    return rows


def geodesic(observed: np.ndarray, implied: np.ndarray) -> float:
    """Half the squared distance of two correlation matrices along the cone: squared logs of their relative roots.

    The relative roots are those of the implied matrix in coordinates where the observed one is the identity.
    """
    try:
        half = np.linalg.cholesky(observed)
    except np.linalg.LinAlgError:
        return float("nan")
    whitened = np.linalg.solve(half, np.linalg.solve(half, implied).T)
    logs = np.log(np.maximum(np.linalg.eigvalsh((whitened + whitened.T) / 2), CUTOFF))
    return float(logs[logs > np.log(CUTOFF)] @ logs[logs > np.log(CUTOFF)]) / 2 if (logs > np.log(CUTOFF)).any() else float("nan")
