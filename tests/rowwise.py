"""An independent row-level fit, used only to check the matrix form."""

import numpy as np


def scale(x):
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def regress(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    left = y - design @ beta
    return beta[1:], 1 - (left @ left) / ((y - y.mean()) @ (y - y.mean()))


def fit(x, spec, scheme="path", stop=1e-12):
    z = scale(x)
    names, blocks = spec.names, spec.blocks()
    w = [np.ones(len(b)) / np.sqrt(len(b)) for b in blocks]
    for _ in range(300):
        s = np.column_stack([scale(z[:, b] @ v) for b, v in zip(blocks, w)])
        fresh = []
        for k, name in enumerate(names):
            before = [names.index(a) for a, t in spec.paths if t == name]
            after = [names.index(t) for a, t in spec.paths if a == name]
            e = np.zeros(len(names))
            for o in before + after:
                c = np.corrcoef(s[:, o], s[:, k])[0, 1]
                e[o] = np.sign(c) if scheme == "centroid" else c
            if scheme == "path" and before:
                e[before] = regress(s[:, before], s[:, k])[0]
            proxy = scale(s @ e)
            if spec.modes[name] == "formative":
                v = regress(z[:, blocks[k]], proxy)[0]
            else:
                v = np.array([np.corrcoef(z[:, i], proxy)[0, 1] for i in blocks[k]])
            fresh.append(v / np.linalg.norm(v))
        moved = max(np.abs(a - b).max() for a, b in zip(fresh, w))
        w = fresh
        if moved < stop:
            break
    s = np.column_stack([scale(z[:, b] @ v) for b, v in zip(blocks, w)])
    return w, s, z
