"""Ward clustering of one protein's peptide profiles, and cuts of the tree.

Merges are found along chains of nearest neighbours; of equally near clusters, the one before in the chain is kept, else the
one in the lowest slot. A merged cluster takes the slot of its later member.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillon.config import Config
from quillon.errors import ContractError


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, as a full matrix."""
    d = x[:, None, :] - x[None, :, :]
    return np.sqrt((d * d).sum(-1))


def condensed(d: np.ndarray) -> np.ndarray:
    """The upper triangle, row by row."""
    return d[np.triu_indices(len(d), 1)]


def squareform(c: np.ndarray) -> np.ndarray:
    n = int(round((1 + np.sqrt(1 + 8 * len(c))) / 2))
    out = np.zeros((n, n))
    out[np.triu_indices(n, 1)] = c
    return out + out.T


def ward(d: np.ndarray) -> np.ndarray:
    """Merges (left, right, height, size) in order of height, from a distance matrix; new clusters are numbered from n on."""
    n = len(d)
    far = d.astype(float).copy()
    np.fill_diagonal(far, np.inf)
    size, alive, chain, found = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            x = chain[-1]
            row = np.where(alive, far[x], np.inf)
            y = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
                break
            chain.append(y)
        del chain[-2:]
        gone, kept = min(x, y), max(x, y)
        height = far[x, y]
        others = alive.copy()
        others[[gone, kept]] = False
        new = ((size + size[gone]) * far[gone] ** 2 + (size + size[kept]) * far[kept] ** 2 - size * height**2) / (size + size[gone] + size[kept])
        new = np.sqrt(np.maximum(new[others], 0.0))
        far[kept, others] = far[others, kept] = new
        alive[gone] = False
        size[kept] += size[gone]
        found.append((gone, kept, height))
    return _numbered(found, n)


def _numbered(found: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Merges sorted by height, their members named by the clusters they are in by then."""
    out, top, count = np.zeros((n - 1, 4)), list(range(2 * n - 1)), [1] * n

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for k, i in enumerate(np.argsort([f[2] for f in found], kind="stable").tolist() if found else []):
        a, b = sorted((root(found[i][0]), root(found[i][1])))
        top[a] = top[b] = n + k
        count.append(count[a] + count[b])
        out[k] = a, b, found[i][2], count[-1]
    return out


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 1..k, in order of the clusters' numbers: single items come before merged clusters."""
    k = max(1, min(int(k), n))
    owner = np.arange(n)
    for step in range(n - k):
        owner[np.isin(owner, merges[step, :2].astype(int))] = n + step
    return np.unique(owner, return_inverse=True)[1].reshape(-1) + 1


def cluster_count(merges: np.ndarray, n: int, low: int, high: int | None) -> int:
    """Where merge heights accelerate most; the first such place counts."""
    if n <= 1:
        return 1
    k = low
    if len(merges) > 2:
        h = merges[:, 2]
        k = n - (int(np.argmax(h[2:] - 2 * h[1:-1] + h[:-2])) + 2)
    return min(max(k, low), n - 1 if high is None else min(high, n - 1))


def silhouette(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How much nearer each item is to its own cluster than to the next; 0 for single items and for one cluster."""
    names, code = np.unique(labels, return_inverse=True)
    code, n = code.reshape(-1), len(labels)
    if len(names) < 2:
        return np.zeros(n)
    member = np.eye(len(names))[code]
    total, count = d @ member, member.sum(0)
    alone = count[code] == 1
    own = total[np.arange(n), code] / np.maximum(count[code] - 1, 1)
    mean = total / count
    mean[np.arange(n), code] = np.inf
    other = mean.min(1)
    top = np.maximum(own, other)
    return np.where(alone | (top == 0), 0.0, (other - own) / np.where(top == 0, 1.0, top))


def split_outliers(labels: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """Items below the threshold leave their cluster, one by one, for clusters of their own, unless they are its last."""
    out = labels.copy()
    if len(np.unique(labels)) < 2:
        return out
    for i in np.flatnonzero(scores < threshold):
        if (out == out[i]).sum() > 1:
            out[i] = out.max() + 1
    return out


@dataclass(frozen=True)
class DynamicTreeCut:
    name: str = "dynamic_tree"

    def labels(self, merges: np.ndarray, d: np.ndarray, config: Config) -> np.ndarray:
        return cut(merges, len(d), cluster_count(merges, len(d), config.cluster_min_clusters, config.cluster_max_clusters))


@dataclass(frozen=True)
class FixedHeightCut:
    name: str = "fixed_height"

    def labels(self, merges: np.ndarray, d: np.ndarray, config: Config) -> np.ndarray:
        return cut(merges, len(d), min(len(d), max(config.cluster_min_clusters, config.fixed_n_clusters)))


@dataclass(frozen=True)
class HybridOutlierCut:
    name: str = "hybrid_outlier"

    def labels(self, merges: np.ndarray, d: np.ndarray, config: Config) -> np.ndarray:
        first = DynamicTreeCut().labels(merges, d, config)
        return split_outliers(first, silhouette(d, first), config.hybrid_outlier_threshold)


CUTS = {c.name: c for c in (DynamicTreeCut(), FixedHeightCut(), HybridOutlierCut())}


def select_cut_strategy(name: str):
    """The cut of that name; others can be added to CUTS."""
    if name not in CUTS:
        raise ContractError(f"cut {name!r} is not supported; valid: {sorted(CUTS)}")
    return CUTS[name]


def cluster_profiles(x: np.ndarray, config: Config) -> np.ndarray:
    """Labels of the rows of one protein's profiles."""
    if len(x) < max(2, config.cluster_min_peptides):
        return np.ones(len(x), int)
    d = distances(x)
    return select_cut_strategy(config.cut).labels(ward(d), d, config)
