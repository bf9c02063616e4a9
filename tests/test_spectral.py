"""Bessel power spectra and long-range expansions against plain sums and quadrature."""

import itertools
import math

import numpy as np
import pytest
from test_local import grid, lowdin, projected

from latticeweave.errors import ConfigurationError, UnsupportedPeriodicityError
from latticeweave.operators.bessel import C00PSMLFF, bessel_zeros, interpolated, spherical_bessel
from latticeweave.operators.local import harmonics
from latticeweave.operators.longrange import LodeSphericalExpansion, exponential_integral
from latticeweave.sources.structures import from_frames

SPECIES = (1, 8)
Z = [1, 8, 1, 8]
P = np.random.default_rng(21).uniform(0, 2.5, (4, 3))
CELL = np.array([[4.0, 0.2, 0.1], [0.3, 4.2, 0.0], [0.0, 0.4, 3.9]])


def test_bessel_functions():
    x = np.array([0.3, 4.0, 30.0])
    np.testing.assert_allclose(spherical_bessel(x, 1), np.sin(x) / x**2 - np.cos(x) / x, atol=1e-13)
    np.testing.assert_allclose(bessel_zeros(1, 2)[1], [4.493409457909064, 7.725251836937707], rtol=1e-12)
    np.testing.assert_allclose(interpolated(lambda r: np.sin(3 * r)[:, None], 5.0, 60)(x[:2])[:, 0], np.sin(3 * x[:2]), atol=1e-12)


@pytest.mark.parametrize("options", [{}, {"cutoff_function": "mo", "normalize_radial": True, "exclude_self_interaction": False}, {"cutoff_function": "wmc", "radial_sigma": 0.0}, {"cutoff_function": "rj", "normalize_angular": True, "super_vector": True, "radial_weight": 0.3}])
def test_bessel_spectra_equal_loops(spark, options):
    cut, size, top = 3.0, 3, 2
    operator = C00PSMLFF(SPECIES, cut, size, top, **options)
    got = np.array([r.features for r in operator.compute(*from_frames(spark, [{"numbers": Z, "positions": P.tolist()}])).orderBy("atom_index").collect()])
    assert got.shape == (4, operator.width)
    counts = [len(z) for z in operator.roots]
    assert counts == [3, 2, 2]
    s, ws, u, wu = grid(cut, 160, 40)
    sigma, kind = operator.radial_sigma, operator.cutoff_function

    def fade(r):
        if kind == "bp":
            return 0.5 * (math.cos(math.pi * r / cut) + 1)
        if kind == "mo":
            x = 4 * r / cut - 3
            return 1.0 if x < -1 else 0.25 * (x**3 - 3 * x + 2)
        a, b = cut**2, 2.5**2
        value = 1.0 if r < 2.5 else (a - r * r) ** 2 * (a + 2 * r * r - 3 * b) / (a - b) ** 3
        return value / (1 + (r / 2) ** 7) if kind == "wmc" else value

    def radial(k, n, r):
        j = lambda x: spherical_bessel(np.asarray(x) * operator.roots[k][n] / cut, k)
        norm = math.sqrt((j(s) ** 2 * ws).sum())
        if sigma == 0:
            return float(j(np.array([r]))[0]) / norm
        # The smeared function by quadrature over the sphere: a Gaussian at distance r along z, projected on (k, 0).
        y = harmonics(u, k)[:, k * k + k]
        cloud = np.exp(-((s[:, None, None] * u - np.array([0, 0, r])) ** 2).sum(2) / (2 * sigma**2)) / (2 * math.pi * sigma**2) ** 1.5
        return ((cloud * (wu * y)).sum(1) * j(s) * ws).sum() / norm / math.sqrt((2 * k + 1) / (4 * math.pi))

    for i in range(4):
        near = [(Z[j], P[j] - P[i]) for j in range(4) if j != i and np.linalg.norm(P[j] - P[i]) <= cut]
        first, rest = [], []
        for k in range(top + 1):
            g = [[fade(np.linalg.norm(d)) * radial(k, n, np.linalg.norm(d)) for n in range(counts[k])] for _, d in near]
            c = {(z, n): sum(g[a][n] * harmonics(d[None], k)[0, k * k :] for a, (t, d) in enumerate(near) if t == z) for z in SPECIES for n in range(counts[k])}
            if k == 0:
                first = [sum(g[a][n] for a, (t, _) in enumerate(near) if t == z) / math.sqrt(4 * math.pi) for z in SPECIES for n in range(counts[0])]
            for p, q in itertools.combinations_with_replacement(c, 2):
                value = np.sum(c[p] * c[q])
                if operator.exclude_self_interaction and p[0] == q[0] == Z[i]:
                    value -= (2 * k + 1) / (4 * math.pi) * sum(g[a][p[1]] * g[a][q[1]] for a, (t, _) in enumerate(near) if t == Z[i])
                rest.append(value * math.sqrt(8 * math.pi**2 / (2 * k + 1)) * (1 if p[1] == q[1] else math.sqrt(2)))
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        first = unit(first) if operator.normalize_radial else np.array(first)
        rest = unit(rest) if operator.normalize_angular else np.array(rest)
        want = np.concatenate([first, rest])
        if operator.super_vector:
            want = unit(np.concatenate([first * math.sqrt(operator.radial_weight), rest]))
        np.testing.assert_allclose(got[i], want, atol=1e-7)


def test_exponential_integrals():
    t, w = np.polynomial.legendre.leggauss(400)
    u = 0.5 * (t + 1)
    for order, x in itertools.product((0, 0.5, 1, 1.5, 2.5, 4), (0.05, 0.7, 1.2, 8.0)):
        # With distance = 1 + y^2 / (1 - y)^2.
        y = u**2 / (1 - u) ** 2
        want = (w / 2 * np.exp(-x * (1 + y)) * (1 + y) ** -order * 2 * u / (1 - u) ** 3).sum()
        assert exponential_integral(order, x) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("exponent", [1, 3, 6])
def test_long_range_expansion_equals_quadrature(spark, exponent):
    operator = LodeSphericalExpansion(SPECIES, 2.0, 0.6, 2, 2, 3.0, exponent)
    frames = [{"numbers": Z, "positions": P.tolist(), "cell": CELL, "pbc": True}]
    got = np.array([r.features for r in operator.compute(*from_frames(spark, frames)).orderBy("atom_index").collect()]).reshape(4, 2, 2, 9, 3)
    reciprocal = 2 * math.pi * np.linalg.inv(CELL).T
    k = np.array(list(itertools.product(range(-5, 6), repeat=3))) @ reciprocal
    length = np.linalg.norm(k, axis=1)
    k, length = k[(length > 1e-9) & (length < 3.0)], length[(length > 1e-9) & (length < 3.0)]
    density = np.array([operator.density(v) for v in length]) / abs(np.linalg.det(CELL))
    r, wr, u, wu = grid(9.0, 80, 24)
    widths = [2.0 * max(math.sqrt(n), 1) / 3 for n in range(3)]
    raw = np.array([r**n * np.exp(-(r**2) / (2 * s * s)) for n, s in enumerate(widths)])
    radial = lowdin(raw / np.sqrt((raw**2 * wr).sum(1))[:, None], wr)
    i = 1
    for t, z in enumerate(SPECIES):
        factor = np.exp(1j * k @ (P[i] - P[[j for j in range(4) if Z[j] == z]]).T).sum(1) * density
        field = lambda x, factor=factor: (np.exp(1j * x @ k.T) @ factor).real
        np.testing.assert_allclose(got[i, SPECIES.index(Z[i]), t], projected(field, radial, r, wr, u, wu, 2), atol=1e-7)
    assert not got[i, 1 - SPECIES.index(Z[i])].any()


def test_coulomb_density_and_errors(spark):
    assert LodeSphericalExpansion(SPECIES).density(2.0) == pytest.approx(4 * math.pi * math.exp(-0.5 * 4 * 0.09) / 4)
    isolated = from_frames(spark, [{"numbers": Z, "positions": P.tolist()}])
    with pytest.raises(UnsupportedPeriodicityError):
        LodeSphericalExpansion(SPECIES).compute(*isolated)
    with pytest.raises(Exception, match="no wave"):
        LodeSphericalExpansion(SPECIES, k_cutoff=0.5).compute(*from_frames(spark, [{"numbers": Z, "positions": P.tolist(), "cell": CELL, "pbc": True}])).collect()
    for wrong in ({"r_cut": 0}, {"cutoff_function": "x"}, {"include_radial": False, "include_angular": False}):
        with pytest.raises(ConfigurationError):
            C00PSMLFF(SPECIES, **wrong)
    assert C00PSMLFF(SPECIES, include_angular=False).compute(*isolated).first().features != []
