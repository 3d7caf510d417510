"""Plain one-machine versions of the definitions, to compare with."""

import numpy as np

from farfield.functions.measures import resolve


def neighbours(x, k, measure="euclidean", allowed=None, skip_self=True):
    """{i: {j: dist}} with ties at the k-distance."""
    x = np.asarray(x, dtype=float)
    dist = resolve(measure).block(x, x)
    keep = np.ones(dist.shape, bool) if allowed is None else allowed.copy()
    if skip_self:
        np.fill_diagonal(keep, False)
    dist = np.where(keep & ~np.isnan(dist), dist, np.inf)
    found = {}
    for i, row in enumerate(dist):
        finite = np.sort(row[np.isfinite(row)])
        kd = finite[min(k, len(finite)) - 1] if len(finite) else np.inf
        found[i] = {int(j): row[j] for j in np.flatnonzero((row <= kd) & np.isfinite(row))}
    return found


def ratio(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.float64(a) / np.float64(b))


def lof(x, k, measure="euclidean"):
    """{i: (n, kd, lrd, lof)} over distinct rows of x."""
    near = neighbours(x, k, measure)
    kd = {i: max(n.values(), default=np.inf) for i, n in near.items()}
    lrd = {
        i: ratio(len(n), sum(max(kd[j], d) for j, d in n.items())) if n else np.inf for i, n in near.items()
    }
    return {
        i: (len(n), kd[i], lrd[i], ratio(sum(lrd[j] for j in n), lrd[i] * len(n)) if n else np.nan)
        for i, n in near.items()
    }
