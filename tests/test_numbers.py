"""Kernels against definitions, dense models and numeric integration."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon import Config, p_adjust, p_adjust_by_group
from quillon.errors import ContractError
from quillon.functions.correction import VALID_METHODS
from quillon.functions.hommel import corrected, hommel, lower_hull, points
from quillon.functions.qvalue import LAMBDAS, bootstrap, least_place, pi0_from_curve, smoothed_end
from quillon.functions.tails import beta_inc, gamma_upper, sf_chi2, sf_f
from quillon.operators import ward
from quillon.operators.rlm import fit_protein

P = [0.001, 0.008, 0.039, 0.041, 0.9]
CONFIG = Config(control_condition="c", conditions={"c": ("a", "b"), "t": ("d", "e")})


@pytest.mark.parametrize(
    ("method", "want"),
    [
        ("bonferroni", [0.005, 0.04, 0.195, 0.205, 1.0]),
        ("holm", [0.005, 0.032, 0.117, 0.117, 0.9]),
        ("hochberg", [0.005, 0.032, 0.082, 0.082, 0.9]),
        ("hommel", [0.005, 0.032, 0.078, 0.082, 0.9]),
        ("fdr_bh", [0.005, 0.02, 0.05125, 0.05125, 0.9]),
        ("none", P),
    ],
)
def test_known_vectors(method, want):
    assert np.allclose(p_adjust(P, method), want, atol=1e-12)


def test_more_tests_than_values():
    assert np.allclose(p_adjust([0.01, 0.02], "holm", 10), [0.1, 0.18])
    assert np.allclose(p_adjust([0.01, 0.02], "fdr_bh", 10), [0.1 / 9, 0.02])
    assert np.allclose(p_adjust([0.01, 0.02], "hommel", 2), p_adjust([0.01, 0.02], "hommel"))
    with pytest.raises(ContractError):
        p_adjust(P, "nope")


def test_order_and_range():
    rng = np.random.default_rng(3)
    p = rng.uniform(size=200)
    for method in VALID_METHODS:
        a = p_adjust(p, method)
        assert ((a >= p - 1e-12) | (method == "qvalue")).all() and (a <= 1).all()
        assert (np.diff(a[np.argsort(p)]) >= -1e-12).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=14))
def test_hommel_is_its_definition(values):
    p = np.sort(values)
    n = len(p)
    alpha = [min(j * p[n - j + k - 1] / k for k in range(1, j + 1)) for j in range(1, n + 1)]
    want = [max(min(j * x, alpha[j - 1]) for j in range(1, n + 1)) for x in p]
    assert np.allclose(hommel(p), np.minimum(1, want), atol=1e-12)


def test_hommel_of_many():
    """Ties, more tests than values, and the corners of parts in place of all points."""
    rng = np.random.default_rng(8)
    for n, more in ((400, 0), (400, 150), (37, 3)):
        p = np.sort(np.round(np.concatenate([rng.beta(0.2, 4, n // 2), rng.uniform(size=n - n // 2)]), 3))
        every = np.concatenate([p, np.ones(more)])
        m = n + more
        alpha = [np.min(j * every[m - j :] / np.arange(1, j + 1)) for j in range(1, m + 1)]
        want = [max(min(j * x, alpha[j - 1]) for j in range(1, m + 1)) for x in p]
        assert np.allclose(hommel(p, m), np.minimum(1, want), atol=1e-12)
        last = np.flatnonzero(np.append(p[1:] != p[:-1], True))
        parts = [lower_hull(last[a : a + 30] + 1, p[last[a : a + 30]]) for a in range(0, len(last), 30)]
        x, y = points(np.concatenate([c[1] for c in parts]), np.concatenate([c[0] for c in parts]), n, m)
        assert np.allclose(corrected(p, x, y, m), hommel(p, m), atol=0)


def test_groups_skip_what_is_not_tested():
    got = p_adjust_by_group([0.01, math.nan, 0.02, 0.5], ["a", "a", "a", "b"], "bonferroni")
    assert np.allclose(got, [0.02, math.nan, 0.04, 0.5], equal_nan=True)


def test_tails():
    for d2 in (1, 4, 9, 30):
        for x in (0.1, 1.0, 3.7, 40.0):
            assert sf_f(x, 2, d2) == pytest.approx((1 + 2 * x / d2) ** (-d2 / 2), rel=1e-11)
    for x in (0.2, 2.0, 30.0):
        assert sf_chi2(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert sf_chi2(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert sf_chi2(x, 6) == pytest.approx(math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2), rel=1e-11)
    t = np.linspace(0, 0.3, 200_001)
    y = t**1.5 * (1 - t) ** 3
    front = math.gamma(6.5) / math.gamma(2.5) / math.gamma(4)
    assert beta_inc(2.5, 4, 0.3) == pytest.approx(front * np.sum((y[1:] + y[:-1]) / 2) * (t[1] - t[0]), rel=1e-8)
    assert sf_f(0, 3, 5) == sf_chi2(-1, 2) == gamma_upper(2, 0) == 1.0


def test_spline_end_and_minimum():
    assert smoothed_end(2 - LAMBDAS) == pytest.approx(2 - 0.95, abs=1e-9)  # a line stays a line
    assert least_place(lambda x: (x - 3.2) ** 2, 0, 19) == pytest.approx(3.2, abs=1e-5)
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(size=8000), rng.beta(0.2, 5, 2000)])
    counts = np.array([(p > x).sum() for x in LAMBDAS], float)
    assert pi0_from_curve(counts, len(p)) == pytest.approx(0.8, abs=0.05)
    assert 0 < bootstrap(counts / (len(p) * (1 - LAMBDAS)), counts, len(p)) <= 1
    assert pi0_from_curve(np.zeros(19), 0) == 1.0


def dense_wald(peptide, condition, y, w, target, k):
    """F or chi-square parts of the one-against-the-rest model with a full design matrix."""
    own = (peptide == target).astype(float)
    cols = [np.ones(len(y)), *((condition == c).astype(float) for c in range(1, k)), own, *((condition == c) * own for c in range(1, k))]
    x = np.stack(cols, 1)
    xtw = x.T * w
    beta = np.linalg.solve(xtw @ x, xtw @ y)
    return x, beta, y - x @ beta


def test_rlm_agrees_with_a_dense_fit():
    rng = np.random.default_rng(5)
    k, m = 3, 5
    peptide, condition = np.repeat(np.arange(m), 9), np.tile(np.repeat(np.arange(k), 3), m)
    y = rng.standard_normal(len(peptide)) + (peptide == 1) * (condition == 2) * 4
    y[7] += 9
    p, status = fit_protein(peptide, condition, y, k)
    assert status == ["ok"] * m and p[1] < 0.01
    from quillon.operators.rlm import HUBER_T, _rho, huber_scale

    for t in range(m):
        n, df = len(y), len(y) - 2 * k
        x, beta, r = dense_wald(peptide, condition, y, np.ones(n), t, k)
        s = huber_scale(r[None], df)[0]
        dev, turn = _rho(r / (r @ r / df)).sum(), 1
        while True:
            z = np.abs(r / s)
            w = np.where(z > HUBER_T, HUBER_T / z, 1.0)
            x, beta, r = dense_wald(peptide, condition, y, w, t, k)
            s = huber_scale(r[None], df)[0]
            turn += 1
            now = _rho(r / (w @ (r * r) / df)).sum()
            if not abs(now - dev) > 1e-8 or turn >= 50 or (w == 1).all():
                break
            dev = now
        e = r / s
        inside = np.abs(e) <= HUBER_T
        factor = (1 + 2 * k / n * inside.var() / inside.mean() ** 2) ** 2 * (np.sum(np.clip(e, -HUBER_T, HUBER_T) ** 2) / df * s**2) / inside.mean() ** 2
        cov = factor * np.linalg.inv(x.T @ x)
        b = beta[-(k - 1) :]
        assert p[t] == pytest.approx(sf_chi2(float(b @ np.linalg.solve(cov[-(k - 1) :, -(k - 1) :], b)), k - 1), rel=1e-8)


def test_rlm_statuses():
    peptide, condition = np.repeat(np.arange(2), 4), np.tile([0, 0, 1, 1], 2)
    assert fit_protein(peptide, condition, np.ones(8), 2)[1] == ["zero_robust_scale"] * 2
    assert fit_protein(peptide, np.tile([0, 0, 0, 1], 2) * (peptide > 0), np.arange(8.0), 2)[1] == ["rank_deficient"] * 2
    assert fit_protein(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.arange(4.0), 2)[1] == ["rank_deficient"] * 2


def brute_ward(x):
    """Merge heights by recomputing all centroids."""
    groups, heights = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        best = min((math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    return heights


def test_ward_heights():
    assert np.allclose(ward.ward(ward.distances(np.array([[0.0], [1.0], [2.0]])))[:, 2], [1, math.sqrt(3)])
    rng = np.random.default_rng(0)
    for n in (2, 5, 17):
        x = rng.standard_normal((n, 3))
        assert np.allclose(ward.ward(ward.distances(x))[:, 2], brute_ward(x))


def test_condensed_and_square():
    d = ward.distances(np.array([[0.0, 0], [3, 4], [6, 8]]))
    assert np.allclose(ward.condensed(d), [5, 10, 5])
    assert np.allclose(ward.squareform(ward.condensed(d)), d)


def test_cuts():
    x = np.array([[0.0], [0.1], [0.2], [10.0]])
    labels = ward.cluster_profiles(x, CONFIG)
    assert len(set(labels)) == 2 and labels[3] not in labels[:3]
    assert set(ward.cluster_profiles(x, CONFIG.replace(cut="fixed_height", fixed_n_clusters=9))) == {1, 2, 3, 4}
    assert list(ward.cluster_profiles(x[:1], CONFIG)) == [1]
    assert list(ward.cluster_profiles(x[:3], CONFIG.replace(cut="dynamic_tree"))) == [1, 1, 1]
    assert list(ward.split_outliers(np.array([1, 1, 2]), np.array([0.9, -0.5, -0.5]), 0.05)) == [1, 3, 2]
    with pytest.raises(ContractError):
        ward.select_cut_strategy("nope")


def test_silhouette_by_definition():
    rng = np.random.default_rng(2)
    x, labels = rng.standard_normal((12, 2)), np.array([1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4])
    d = ward.distances(x)
    want = []
    for i in range(12):
        own = [d[i, j] for j in range(12) if j != i and labels[j] == labels[i]]
        if not own:
            want.append(0.0)
            continue
        b = min(np.mean([d[i, j] for j in range(12) if labels[j] == c]) for c in set(labels) - {labels[i]})
        want.append((b - np.mean(own)) / max(b, np.mean(own)))
    assert np.allclose(ward.silhouette(d, labels), want)
