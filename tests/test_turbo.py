"""Separable overlap spectra: moments and bases by quadrature, invariance, compressions."""

import math

import numpy as np
import pytest

from latticeweave.errors import ConfigurationError
from latticeweave.operators.local import harmonics
from latticeweave.operators.turbo import SOAPTurbo, moments, overlaps
from latticeweave.sources.structures import from_frames

SPECIES = (1, 8)
Z = [1, 8, 1, 8, 8]
P = np.random.default_rng(31).uniform(0, 2.6, (5, 3))
Q, _ = np.linalg.qr(np.random.default_rng(6).normal(size=(3, 3)))
Q = Q * np.sign(np.linalg.det(Q))


@pytest.fixture(scope="module")
def tables(spark):
    return from_frames(spark, [{"numbers": Z, "positions": p.tolist()} for p in (P, P @ Q + 1.0)])


def features(tables, operator):
    return np.array([r.features for r in operator.compute(*tables).orderBy("structure_id", "atom_index").collect()]).reshape(2, 5, -1)


def test_moments_below_the_cutoff_equal_quadrature():
    t, w = np.polynomial.legendre.leggauss(80)
    x, w = 0.05 + 0.4 * (t + 1), 0.4 * w
    got = moments(np.array([0.3, 0.9]), np.array([0.1, 0.2]), 0.05, 0.85, 4)
    for row, (centre, width) in enumerate(((0.3, 0.1), (0.9, 0.2))):
        for k in range(1, 5):
            want = math.sqrt(2 * k + 5) * (w * (1 - x) ** (k + 2) * np.exp(-((x - centre) ** 2) / (2 * width**2))).sum()
            assert got[row, k - 1] == pytest.approx(want, rel=1e-8)


def test_overlaps():
    t, w = np.polynomial.legendre.leggauss(80)
    x, w = (t + 1) / 2, w / 2
    basis = np.array([math.sqrt(2 * k + 5) * (1 - x) ** (k + 2) for k in (1, 2, 3)])
    np.testing.assert_allclose(overlaps(3, None)[0], basis * w @ basis.T, atol=1e-12)
    gram, column = overlaps(3, 0.1)
    gauss = math.sqrt(2 / 0.1) / math.pi**0.25 * np.exp(-(x**2) / (2 * 0.1**2))
    np.testing.assert_allclose(column[:2], basis[:2] * w @ gauss, rtol=1e-8)
    np.testing.assert_allclose(gram[2], column)


def test_spectrum_equals_loops(spark, tables):
    operator = SOAPTurbo(SPECIES, 2, 2, 3.0, 2.4, 6.0, atom_sigma_r=(0.4, 0.5), atom_sigma_t=(0.5, 0.6), atom_sigma_t_scaling=0.1, central_weight=(1.0, 0.5), radial_enhancement=1)
    got = features(tables, operator)[0]
    t, w = np.polynomial.legendre.leggauss(120)
    # A steep step (nf 6) leaves nothing at the hard cutoff, where the moments drop a term by convention.
    x, w = np.concatenate([0.4 * (t + 1), 0.8 + 0.1 * (t + 1)]), np.concatenate([0.4 * w, 0.1 * w])
    basis = np.array([math.sqrt(2 * k + 5) * (1 - x) ** (k + 2) for k in (1, 2)])
    values, vectors = np.linalg.eigh(basis * w @ basis.T)
    basis = (vectors / np.sqrt(values)) @ vectors.T @ basis
    for i in range(5):
        c = np.zeros((4, 9))
        for j in range(5):
            d = P[j] - P[i]
            r, kind = np.linalg.norm(d), SPECIES.index(Z[j])
            if r >= 3.0:
                continue
            s, wide = (0.4, 0.5)[kind] / 3, (0.5, 0.6)[kind] + 0.1 * r
            y = r / 3
            # Beyond the soft cutoff the atom's Gaussian is multiplied by another about that cutoff.
            step = np.where(x < 0.8, 1.0, np.exp(-((x - 0.8) ** 2) / (2 * (0.2 / 6) ** 2)))
            near = 1.0 if 0.8 - y < 4 * s else 0.0
            cloud = np.exp(-((x - y) ** 2) / (2 * s * s)) * np.where(x < 0.8, 1.0, near) * step
            g = (basis * w * cloud).sum(1) / s * (y + math.sqrt(2 / math.pi) * s) * math.sqrt(3)
            if i == j:
                g *= (1.0, 0.5)[kind]
            z = (r / wide) ** 2
            u = np.linspace(-1, 1, 2001)
            for k in range(3):
                legendre = np.polynomial.legendre.Legendre.basis(k)(u)
                bessel = 0.5 * np.trapezoid(np.exp(z * (u - 1)) * legendre, u)
                c[2 * kind : 2 * kind + 2, k * k : (k + 1) ** 2] += np.outer(g, harmonics(d[None], 2)[0, k * k : (k + 1) ** 2]) * 4 * math.pi * 9 / wide**2 * bessel
        want = np.array([(1 if a == b else math.sqrt(2)) * (c[a] * c[b])[k * k : (k + 1) ** 2].sum() for a in range(4) for b in range(a, 4) for k in range(3)])
        np.testing.assert_allclose(got[i], want / np.linalg.norm(want), atol=2e-5)


@pytest.mark.parametrize("options", [{"basis": "poly3gauss"}, {"compression": "trivial"}, {"rcut_soft": 2.5, "amplitude_scaling": 1.0, "radial_enhancement": 2}, *[{"compression": f"{a}_{b}"} for a in range(3) for b in range(3)]])
def test_invariance_and_width(spark, tables, options):
    operator = SOAPTurbo(SPECIES, 3, 2, 3.0, **options)
    a, b = features(tables, operator)
    assert a.shape[1] == operator.width
    np.testing.assert_allclose(np.linalg.norm(a, axis=1), 1, atol=1e-12)
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_compressions_merge_channels():
    for mode, kept in (("2_2", 21), ("0_0", 1), ("1_1", 6), ("1_0", 3), ("0_1", 2), ("2_0", 6), ("0_2", 3), ("2_1", 18), ("1_2", 12)):
        names, weights = SOAPTurbo(SPECIES, 3, 2, 3.0, compression=mode).recipe()
        assert len(names) == kept == len(weights)
        # Merged products are those of merged channels; unordered pairs of different keys carry the root of two.
        c = np.random.default_rng(1).normal(size=(2, 3))
        first, second = np.triu_indices(6)
        dense = c.ravel()[first] * c.ravel()[second] * np.where(first == second, 1, math.sqrt(2))
        merged = lambda slot, mode=mode: c.sum(axis=tuple(a for a, k in enumerate(map(int, mode[::-2])) if k <= slot)).ravel()
        left, right = merged(0), merged(1)
        if "1" in mode:
            want = np.outer(left, right).ravel()
        else:
            a, b = np.triu_indices(len(left))
            want = left[a] * left[b] * np.where(a == b, 1, math.sqrt(2))
        np.testing.assert_allclose(weights @ dense, want)


def test_centres_and_errors(spark, tables):
    got = features(tables, SOAPTurbo(SPECIES, 2, 1, 3.0, central_species=(8,)))[0]
    assert [bool(r.any()) for r in got] == [z == 8 for z in Z]
    for wrong in ({"alpha_max": 11}, {"rcut_soft": 6.0}, {"compression": "3_0"}, {"alpha_max": (2, 3), "compression": "1_1"}, {"atom_sigma_r": 0.0}, {"central_species": (6,)}, {"atom_sigma_t": (0.5,)}, {"basis": "x"}):
        with pytest.raises(ConfigurationError):
            SOAPTurbo(SPECIES, **wrong)
