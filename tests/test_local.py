"""Local expansions against quadrature and plain loops; invariances; matrices' spectra."""

import itertools
import math

import numpy as np
import pytest

from latticeweave.errors import ConfigurationError
from latticeweave.operators.local import MTP, SO3, SOAP, SoapPowerSpectrum, SoapRadialSpectrum, SphericalExpansion, SphericalExpansionByPair, harmonics, modified_bessel, scaled_kummer
from latticeweave.operators.pairs import CoulombMatrix, EwaldSumMatrix
from latticeweave.sources.structures import from_frames

Z = [1, 8, 1, 8, 8]
P = np.random.default_rng(5).uniform(0, 2.6, (5, 3))
Q, _ = np.linalg.qr(np.random.default_rng(6).normal(size=(3, 3)))
Q = Q * np.sign(np.linalg.det(Q))
SPECIES = (1, 8)


@pytest.fixture(scope="module")
def tables(spark):
    frames = [{"numbers": Z, "positions": P.tolist(), "id": "a"}, {"numbers": Z, "positions": (P @ Q + [3, -1, 2]).tolist(), "id": "b"}]
    return from_frames(spark, frames)


def features(tables, operator, frame="a"):
    structures, atoms = tables
    keys = [c for c in ("atom_index", "i", "j", "sx") if c in operator.compute(*tables).columns]
    got = operator.compute(structures, atoms).join(structures.where(f"id = '{frame}'").select("structure_id"), "structure_id").orderBy("structure_id", *keys).toPandas()
    return np.array(got.features.tolist())


def grid(radius, n=90, m=40):
    """Points and weights of a ball."""
    x, w = np.polynomial.legendre.leggauss(n)
    r, wr = radius * (x + 1) / 2, w * radius / 2
    c, wc = np.polynomial.legendre.leggauss(m)
    phi = np.arange(2 * m) * math.pi / m
    s = np.sqrt(1 - c * c)
    u = np.stack([np.outer(s, np.cos(phi)), np.outer(s, np.sin(phi)), np.outer(c, np.ones(2 * m))], -1).reshape(-1, 3)
    return r, wr * r * r, u, np.repeat(wc, 2 * m) * math.pi / m


def lowdin(functions, weights):
    values, vectors = np.linalg.eigh(functions * weights @ functions.T)
    return (vectors / np.sqrt(values)) @ vectors.T @ functions


def projected(density, radial, r, wr, u, wu, top):
    """(harmonics, radial) of a density by quadrature."""
    at = density((r[:, None, None] * u).reshape(-1, 3)).reshape(len(r), len(u))
    return (harmonics(u, top) * wu[:, None]).T @ at.T @ (radial * wr).T


def test_special_functions():
    d = np.random.default_rng(1).normal(size=(4, 3))
    x, y, z = (d / np.linalg.norm(d, axis=1)[:, None]).T
    got = harmonics(d, 2)
    np.testing.assert_allclose(got[:, 1:4], math.sqrt(3 / (4 * math.pi)) * np.stack([y, z, x], 1), atol=1e-14)
    np.testing.assert_allclose(got[:, 8], math.sqrt(15 / (16 * math.pi)) * (x * x - y * y), atol=1e-14)
    t = np.array([0.0, 0.3, 5.0, 59.9, 60.1, 300.0])
    np.testing.assert_allclose(scaled_kummer(2.5, 2.5, t), np.ones(6), rtol=1e-12)
    np.testing.assert_allclose(modified_bessel(t[1:], 0), np.sinh(t[1:]) / t[1:], rtol=1e-12)
    np.testing.assert_allclose(modified_bessel(t[2:], 1), (t[2:] * np.cosh(t[2:]) - np.sinh(t[2:])) / t[2:] ** 2, rtol=1e-12)


def expansion(cutoff, width, size, top):
    """Coefficients (atoms, species, harmonics, radial) by quadrature."""
    r, wr, u, wu = grid(cutoff * 3)
    sigma = [cutoff * max(math.sqrt(n), 1) / size for n in range(size)]
    raw = np.array([r**n * np.exp(-(r**2) / (2 * s * s)) for n, s in enumerate(sigma)])
    radial = lowdin(raw / np.sqrt((raw**2 * wr).sum(1))[:, None], wr)
    out = np.zeros((5, 2, (top + 1) ** 2, size))
    for i, j in itertools.product(range(5), repeat=2):
        d = P[j] - P[i]
        far = np.linalg.norm(d)
        if far >= cutoff:
            continue
        fade = 1.0 if far <= cutoff - 0.5 else 0.5 * (1 + math.cos(math.pi * (far - cutoff + 0.5) / 0.5))
        density = lambda x, d=d: np.exp(-((x - d) ** 2).sum(1) / (2 * width**2)) / (math.pi * width**2) ** 0.75
        out[i, SPECIES.index(Z[j])] += fade * projected(density, radial, r, wr, u, wu, top)
    return out


def test_expansion_family_equals_quadrature(spark, tables):
    cutoff, width, size, top = 2.2, 0.6, 3, 2
    want, parameters = expansion(cutoff, width, size, top), (SPECIES, cutoff, width, size - 1, top)
    got = features(tables, SphericalExpansion(*parameters)).reshape(5, 2, 2, 9, size)
    radial = features(tables, SoapRadialSpectrum(*parameters)).reshape(5, 2, 2, size)
    power = features(tables, SoapPowerSpectrum(*parameters))
    assert power.shape[1] == SoapPowerSpectrum(*parameters).width == 2 * 3 * (top + 1) * size * size
    for i, z in enumerate(Z):
        own = SPECIES.index(z)
        np.testing.assert_allclose(got[i, own], want[i], atol=1e-8)
        assert not got[i, 1 - own].any()
        np.testing.assert_allclose(radial[i, own], want[i, :, 0], atol=1e-8)
        mixed = power.reshape(5, 2, 3, top + 1, size, size)[i, own, 1, 1]
        np.testing.assert_allclose(mixed, -math.sqrt(2 / 3) * want[i, 0, 1:4].T @ want[i, 1, 1:4], atol=1e-8)
    pairs = features(tables, SphericalExpansionByPair(*parameters)).reshape(-1, 9, size)
    np.testing.assert_allclose(pairs.sum(0), want.sum((0, 1)), atol=1e-7)


def test_soap_equals_quadrature(spark, tables):
    r_cut, n_max, top, sigma = 2.0, 3, 2, 0.5
    r, wr, u, wu = grid(8.0)
    c = np.zeros((5, 2, n_max, 9))
    radii = np.linspace(1.0, r_cut, n_max)
    for k in range(top + 1):
        alpha = -np.log(1e-3 / radii**k) / radii**2
        radial = lowdin(r**k * np.exp(-alpha[:, None] * r**2), wr)
        for i, j in itertools.product(range(5), repeat=2):
            d = P[j] - P[i]
            if np.linalg.norm(d) <= r_cut + sigma * math.sqrt(-2 * math.log(1e-3)):
                density = lambda x, d=d: np.exp(-((x - d) ** 2).sum(1) / (2 * sigma**2))
                c[i, SPECIES.index(Z[j]), :, k * k : (k + 1) ** 2] += projected(density, radial, r, wr, u, wu, top)[k * k : (k + 1) ** 2].T
    named = {}
    for average in ("off", "inner", "outer"):
        operator = SOAP(SPECIES, r_cut, n_max, top, sigma, average)
        named[average] = features(tables, operator)
        assert named[average].shape == (5 if average == "off" else 1, operator.width)
    labels = SOAP(SPECIES, r_cut, n_max, top, sigma).labels()
    for name, a, b, k, m, n in (("Z=1,1 l=0 n=0,2", 0, 0, 0, 0, 2), ("Z=1,8 l=2 n=2,1", 0, 1, 2, 2, 1), ("Z=8,8 l=1 n=1,1", 1, 1, 1, 1, 1)):
        of, scale, at = slice(k * k, (k + 1) ** 2), math.pi * math.sqrt(8 / (2 * k + 1)), labels.index(name)
        want = scale * (c[:, a, m, of] * c[:, b, n, of]).sum(1)
        np.testing.assert_allclose(named["off"][:, at], want, rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(named["outer"][0, at], want.mean(), rtol=1e-7, atol=1e-9)
        mean = c.mean(0)
        np.testing.assert_allclose(named["inner"][0, at], scale * mean[a, m, of] @ mean[b, n, of], rtol=1e-7, atol=1e-9)
    for compression, blocks in (("mu2", 6), ("mu1nu1", 18), ("crossover", 12)):
        operator = SOAP(SPECIES, r_cut, n_max, top, sigma, "off", compression)
        assert features(tables, operator).shape[1] == operator.width == blocks * 3


@pytest.mark.parametrize("weighting", [{}, {"function": "poly", "r0": 2.2, "c": 1.5, "m": 2, "w0": 0.3}, {"function": "pow", "r0": 1.0, "c": 1.0, "d": 0.5, "m": 3}, {"function": "exp", "r0": 2.0, "c": 1.0, "d": 0.5}])
@pytest.mark.parametrize("rbf", ["gto", "polynomial"])
def test_soap_bases_and_weights_equal_quadrature(spark, tables, rbf, weighting):
    operator = SOAP(SPECIES, 2.2, 2, 1, 0.5, "off", rbf=rbf, weighting=weighting, species_weighting=(0.7, 1.2))
    got = features(tables, operator)
    r, wr, u, wu = grid(2.2 if rbf == "polynomial" else 8.0, 120, 24)
    c = np.zeros((5, 2, 2, 4))
    for k in range(2):
        raw = np.array([(2.2 - r) ** n for n in (3, 4)])
        if rbf == "gto":
            radii = np.linspace(1.0, 2.2, 2)
            raw = r**k * np.exp(np.log(1e-3 / radii**k)[:, None] / radii[:, None] ** 2 * r**2)
        radial = lowdin(raw, wr)
        for i, j in itertools.product(range(5), repeat=2):
            d = P[j] - P[i]
            far = np.linalg.norm(d)
            if far > operator.reach:
                continue
            x = far / weighting.get("r0", 1)
            weight = {"poly": lambda: 1.5 * (1 + 2 * x**3 - 3 * x**2) ** 2 if x <= 1 else 0.0, "pow": lambda: 1 / (0.5 + x**3), "exp": lambda: 1 / (0.5 + math.exp(-x))}.get(weighting.get("function"), lambda: 1.0)()
            weight = (weighting.get("w0", weight) if i == j else weight) * (0.7, 1.2)[SPECIES.index(Z[j])]
            density = lambda p, d=d: np.exp(-((p - d) ** 2).sum(1) / 0.5)
            of = slice(k * k, (k + 1) ** 2)
            c[i, SPECIES.index(Z[j]), :, of] += weight * projected(density, radial, r, wr, u, wu, 1)[of].T
    for name, a, b, k, m, n in (("Z=1,1 l=0 n=0,1", 0, 0, 0, 0, 1), ("Z=1,8 l=1 n=1,0", 0, 1, 1, 1, 0)):
        of = slice(k * k, (k + 1) ** 2)
        want = math.pi * math.sqrt(8 / (2 * k + 1)) * (c[:, a, m, of] * c[:, b, n, of]).sum(1)
        np.testing.assert_allclose(got[:, operator.labels().index(name)], want, rtol=1e-6, atol=1e-9)


def test_soap_cutoff_follows_from_weighting():
    assert SOAP(SPECIES).radius == 6.0 and SOAP(SPECIES, weighting={"function": "poly", "r0": 3.0, "c": 1, "m": 1}).radius == 3.0
    assert SOAP(SPECIES, weighting={"function": "pow", "r0": 2.0, "c": 1, "d": 1, "m": 2}).radius == pytest.approx(2 * math.sqrt(99))
    assert SOAP(SPECIES, weighting={"function": "exp", "r0": 2.0, "c": 1, "d": 1}).radius == pytest.approx(2 * math.log(99))
    for wrong in ({"weighting": {"function": "x"}}, {"weighting": {"function": "pow", "r0": 1, "c": 1}}, {"rbf": "x"}, {"species_weighting": (1.0,)}, {"r_cut": 0.5}):
        with pytest.raises(ConfigurationError):
            SOAP(SPECIES, **wrong)


def test_moment_tensors_equal_loops(spark, tables):
    operator = MTP(SPECIES, 0.2, 2.5, 2, 2, 3)
    got, channels = features(tables, operator), 8
    assert got.shape == (5, operator.width)
    for i in range(5):
        moments = [np.zeros((channels,) + (3,) * k) for k in range(4)]
        for j in range(5):
            r = np.linalg.norm(P[j] - P[i])
            if i == j or not 0.2 <= r <= 2.5:
                continue
            x, u = (r - 0.2) / 2.3, (P[j] - P[i]) / r
            for f, n in itertools.product(range(2), range(2)):
                value = (0.5 * (1 + math.cos(math.pi * x))) ** 2 * x**f * (1, 2 * x - 1)[n]
                for k in range(4):
                    tensor = np.array(value)
                    for _ in range(k):
                        tensor = np.multiply.outer(tensor, u)
                    moments[k][SPECIES.index(Z[j]) * 4 + f * 2 + n] += tensor
        want = [t for c in range(channels) for t in (moments[0][c], np.trace(moments[2][c]))]
        want += [(m[a] * m[b]).sum() for m in moments for a in range(channels) for b in range(a, channels)]
        np.testing.assert_allclose(got[i], want, atol=1e-10)


@pytest.mark.parametrize("weight_on", [False, True])
def test_so3_isotropic_part_equals_loops(spark, tables, weight_on):
    operator = SO3(2, 1, 3.0, 1.5, weight_on)
    got = features(tables, operator)
    x, w = np.polynomial.legendre.leggauss(200)
    q, wq = 1.5 * (x + 1), 1.5 * w
    radial = lowdin(np.array([(3.0 - q) ** (k + 2) / math.sqrt(2 * 3.0 ** (2 * k + 7) / ((2 * k + 5) * (2 * k + 6) * (2 * k + 7))) for k in (1, 2)]), q * q * wq)
    for i in range(5):
        c = np.zeros(2)
        for j in range(5):
            r = np.linalg.norm(P[j] - P[i])
            if i != j and r < 3.0:
                sign = -1 if weight_on and Z[i] != Z[j] else 1
                weight = sign * Z[j] * 4 * math.pi * math.exp(-1.5 * r * r) * 0.5 * (math.cos(math.pi * r / 3) + 1)
                c += weight * (radial * q * q * np.exp(-1.5 * q * q) * np.sinh(3 * r * q) / (3 * r * q) * wq).sum(1) * math.sqrt(2 * math.sqrt(2) * math.pi) / math.sqrt(4 * math.pi)
        np.testing.assert_allclose(got[i, [0, 2, 4]], [c[0] ** 2, c[0] * c[1], c[1] ** 2], rtol=1e-3)


@pytest.mark.parametrize("operator", [SoapPowerSpectrum(SPECIES, 2.5, 0.5, 2, 2), SOAP(SPECIES, 2.0, 2, 2, 0.5, "inner"), MTP(SPECIES, 0, 3.0, 2, 1, 3), SO3(2, 2, 3.0)])
def test_rotation_invariance(spark, tables, operator):
    a, b = features(tables, operator, "a"), features(tables, operator, "b")
    assert np.abs(a).sum() > 0
    np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)


def test_isolated_and_empty(spark, tables):
    alone = from_frames(spark, [{"numbers": [1], "positions": [[0, 0, 0]]}])
    assert MTP(SPECIES).compute(*alone).first().features == [0.0] * MTP(SPECIES).width
    assert SphericalExpansion(SPECIES, 3.0, 0.5, 1, 1).compute(*alone).first().features[0] > 0
    none = tables[0].limit(0), tables[1].limit(0)
    for operator in (SO3(), SOAP(SPECIES), SOAP(SPECIES, average="off"), SphericalExpansionByPair(SPECIES)):
        assert operator.compute(*none).count() == 0


def test_spectra_and_ewald_energy(spark):
    salt = [(11, [0, 0, 0]), (11, [0, 1, 1]), (11, [1, 0, 1]), (11, [1, 1, 0]), (17, [1, 0, 0]), (17, [0, 1, 0]), (17, [0, 0, 1]), (17, [1, 1, 1])]
    tables = from_frames(spark, [{"numbers": [z for z, _ in salt], "positions": [p for _, p in salt], "cell": np.eye(3) * 2.0, "pbc": True}])
    flat = np.array(CoulombMatrix(8, "none").compute(*tables).first().features).reshape(8, 8)
    values = np.linalg.eigvalsh(flat)
    want = [*values[np.argsort(-np.abs(values))], 0.0]
    assert CoulombMatrix(9, "eigenspectrum").compute(*tables).first().features == pytest.approx(want)
    m = [np.array(EwaldSumMatrix(8, "none", accuracy=1e-12, a=a, r_cut=r, g_cut=g).compute(*tables).first().features).reshape(8, 8) for a, r, g in ((2.0, 3.0, 22.0), (2.4, 2.6, 26.0))]
    # Off the diagonal the sums do not depend on the screening; with unit charges they give the rock salt constant.
    off = ~np.eye(8, dtype=bool)
    np.testing.assert_allclose(m[0][off], m[1][off], rtol=1e-6)
    z = np.array([z for z, _ in salt])
    charge = np.where(z == 11, 1, -1)
    unit = m[0] / np.outer(z, z)
    energy = (np.triu(unit, 1) * np.outer(charge, charge)).sum() + np.trace(unit)
    assert -energy / 4 == pytest.approx(1.7475645946, rel=1e-5)
