"""Robust one-against-the-rest tests: Huber weights, iterated on cell means for all peptides of a protein at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.tails import sf_chi2
from quillon.schema import CONDITION, NORMALIZED, PEPTIDE, PROTEIN, SAMPLE

#: Huber's tuning constant, its scale's cut, and the normal distribution's values that go with them.
HUBER_T, SCALE_D = 1.345, 2.5
NORMAL_CDF_D, MAD, ROOT_2PI = 0.9937903346742238, 0.6744897501960817, 2.5066282746310002
ROUNDS, SCALE_ROUNDS, CLOSE = 50, 29, 1e-8


def _spread(r: np.ndarray) -> np.ndarray:
    """Median absolute deviation around the median of each row, as a standard deviation."""
    return np.median(np.abs(r - np.median(r, axis=1, keepdims=True)), axis=1) / MAD


def huber_scale(r: np.ndarray, df: float) -> np.ndarray:
    """Huber's second proposal for the scale of each row of residuals; 0 where there is none."""
    n, d = r.shape[1], SCALE_D
    norm = df / n * (d * d + (1 - d * d) * NORMAL_CDF_D - 0.5 - d / ROOT_2PI * np.exp(-d * d / 2))
    s = _spread(r)
    moving = (s > 0) & (norm > 0)
    s = np.where(moving, s, 0.0)
    for _ in range(SCALE_ROUNDS):
        k = np.flatnonzero(moving)
        if not len(k):
            break
        t = r[k] / s[k, None]
        chi = np.where(np.abs(t) < d, t * t / 2, d * d / 2)
        new = np.sqrt(chi.sum(1) / (n * norm) * s[k] ** 2)
        moving[k[np.abs(new - s[k]) <= CLOSE]] = False
        s[k] = new
    return s


def _rho(z: np.ndarray) -> np.ndarray:
    a = np.abs(z)
    return np.where(a <= HUBER_T, z * z / 2, HUBER_T * a - HUBER_T**2 / 2)


def fit_protein(peptide: np.ndarray, condition: np.ndarray, y: np.ndarray, n_conditions: int) -> tuple[np.ndarray, list[str]]:
    """p-values and statuses of the peptides 0, 1, ... of one protein, from its rows."""
    n, m, k = len(y), int(peptide.max()) + 1, n_conditions
    own = peptide[None, :] == np.arange(m)[:, None]
    one_hot = np.eye(k)[condition]
    in_cell = lambda w: ((w * own) @ one_hot, (w * ~own) @ one_hot)
    counts = in_cell(np.ones((m, n)))
    valid = (counts[0] > 0).all(1) & (counts[1] > 0).all(1) & (n > 2 * k)
    p, status = np.full(m, np.nan), np.array(["rank_deficient"] * m, object)
    rows = np.flatnonzero(valid)
    if not len(rows):
        return p, status.tolist()
    own, counts, df = own[rows], (counts[0][rows], counts[1][rows]), n - 2 * k

    def step(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Residuals, the difference of cell means by condition, and the weighted variance, for the fits at."""
        o = own[at]
        with np.errstate(all="ignore"):
            means = [((w * side * y) @ one_hot) / ((w * side) @ one_hot) for side in (o, ~o)]
        r = y - np.where(o, means[0][:, condition], means[1][:, condition])
        return r, means[0] - means[1], (w * r * r).sum(1) / max(df, 1)

    every = np.arange(len(rows))
    r, d, variance = step(np.ones((len(rows), n)), every)
    scale = huber_scale(r, df)
    with np.errstate(all="ignore"):
        deviance = _rho(r / variance[:, None]).sum(1)
    active, turn = scale > 0, 1
    while active.any():
        at = np.flatnonzero(active)
        z = np.abs(r[at] / scale[at, None])
        w = np.where(z > HUBER_T, HUBER_T / np.maximum(z, 1e-300), 1.0)
        r[at], d[at], variance[at] = step(w, at)
        scale[at] = huber_scale(r[at], df)
        turn += 1
        with np.errstate(all="ignore"):
            now = _rho(r[at] / variance[at, None]).sum(1)
        done = ~(np.abs(now - deviance[at]) > CLOSE) | (turn >= ROUNDS) | (w == 1.0).all(1) | ~(scale[at] > 0)
        deviance[at] = now
        active[at[done]] = False
    usable = (scale > 0) & np.isfinite(d).all(1)
    status[rows] = np.where(usable, "wald_failed", "zero_robust_scale")
    for i in np.flatnonzero(usable):
        s = r[i] / scale[i]
        inside = np.abs(s) <= HUBER_T
        share = inside.mean()
        if share <= 0:
            continue
        grow = 1 + 2 * k / n * inside.var() / share**2
        factor = grow**2 * (np.sum(np.clip(s, -HUBER_T, HUBER_T) ** 2) / df * scale[i] ** 2) / share**2
        c = 1 / (1 / counts[0][i] + 1 / counts[1][i])
        centre = np.sum(c * d[i]) / np.sum(c)
        got = sf_chi2(float(np.sum(c * (d[i] - centre) ** 2) / factor), k - 1)
        if np.isfinite(got):
            p[rows[i]], status[rows[i]] = got, "ok"
    return p, status.tolist()


def rlm_pvalues(df: DataFrame, levels: tuple[str, ...], value: str = NORMALIZED) -> DataFrame:
    """(protein_id, peptide_id, raw_p_value, fit_status); a protein's rows meet in one task, sorted, so sums do not vary."""
    names = list(levels)

    def run(table: pa.Table) -> pa.Table:
        frame = table.sort_by([(PEPTIDE, "ascending"), (SAMPLE, "ascending")])
        labels, code = np.unique(np.array(frame.column(PEPTIDE).to_pylist(), object), return_inverse=True)
        where = np.array([names.index(c) for c in frame.column(CONDITION).to_pylist()])
        p, status = fit_protein(code.reshape(-1), where, np.array(frame.column("v").to_pylist(), float), len(names))
        return pa.table({PROTEIN: pa.array([frame.column(PROTEIN)[0].as_py()] * len(labels), pa.string()), PEPTIDE: pa.array(labels.tolist(), pa.string()), "raw_p_value": pa.array(p, pa.float64(), mask=~np.isfinite(p)), "fit_status": pa.array(status, pa.string())})

    rows = df.select(PROTEIN, PEPTIDE, SAMPLE, CONDITION, F.col(value).alias("v"))
    return rows.groupBy(PROTEIN).applyInArrow(run, "protein_id string, peptide_id string, raw_p_value double, fit_status string")
