"""Cluster expansion: orthonormal radial part, counts of invariants, closed forms, invariance."""

import math

import numpy as np
import pytest

from latticeweave.errors import ConfigurationError
from latticeweave.operators.cluster import ACE, invariants, symmetric
from latticeweave.sources.structures import from_frames

SPECIES = (1, 8)
Z = [1, 8, 1, 8, 8]
P = np.random.default_rng(41).uniform(0, 2.6, (5, 3))
Q, _ = np.linalg.qr(np.random.default_rng(6).normal(size=(3, 3)))
Q = Q * np.sign(np.linalg.det(Q))


def test_invariants_are_counted():
    # How often the product of representations holds the trivial one.
    for angular, count in (((0,), 1), ((1, 1), 1), ((1, 2), 0), ((1, 1, 2), 1), ((1, 1, 1, 1), 3), ((2, 2, 2), 1), ((1, 1, 1), 1)):
        assert len(invariants(angular)[1]) == count
    assert len(symmetric(((0, 1, 1),) * 4)[1]) == 1
    assert len(symmetric(((0, 1, 1), (0, 1, 1), (0, 2, 1), (0, 2, 1)))[1]) == 2
    assert len(symmetric(((0, 1, 1), (0, 1, 1), (0, 1, 1)))[1]) == 0


def test_radial_part_is_orthonormal():
    operator = ACE(SPECIES, maxdeg=5.0, rcut=4.0)
    low, high = operator.transformed(np.array([4.0, 1.25]))
    t = low + (high - low) * (np.arange(1000) + 0.5) / 1000
    r = (operator.a + operator.r0) / np.sqrt(t) - operator.a
    values = operator.radial()(r)
    np.testing.assert_allclose(values.T @ values / 1000, np.eye(5), atol=1e-9)
    assert not operator.radial()(np.array([4.0, 5.0, 0.5])).any()
    # The first one is the envelope; the second grows where t does.
    envelope = (t - low) ** 2 * (t - high) ** 2
    np.testing.assert_allclose(values[:, 0], envelope / math.sqrt((envelope**2).mean()), rtol=1e-9)
    assert (np.diff(values[:, 1] / values[:, 0]) > 0).all()


@pytest.mark.parametrize("options", [{}, {"N": 4, "maxdeg": 4.5}, {"N": 2, "maxdeg": (5.0, 4.0), "wL": (1.5, 1.0)}, {"chc": 0.2, "ahc": 1.0, "constants": True, "maxdeg": 6.0, "pin": 0, "rin": 0.0}])
def test_invariance_and_orders(spark, options):
    operator = ACE(SPECIES, **{"N": 3, "maxdeg": 5.0, "rcut": 3.0, **options})
    assert operator.expansion() and [len(f) for f, _, _ in operator.expansion()] == sorted(len(f) for f, _, _ in operator.expansion())
    tables = from_frames(spark, [{"numbers": Z, "positions": p.tolist()} for p in (P, P @ Q + 1.0)])
    got = np.array([r.features for r in operator.compute(*tables).orderBy("structure_id", "atom_index").collect()])
    a, b = got[:5], got[5:10]
    assert a.shape == (5, operator.width) and np.abs(a).max() > 1e-3
    np.testing.assert_allclose(a, b, atol=1e-8 * np.abs(a).max())


def test_pairs_equal_legendre_sums(spark):
    operator = ACE((1, 8), N=2, maxdeg=6.0, rcut=3.0, rin=0.2)
    tables = from_frames(spark, [{"numbers": Z, "positions": P.tolist()}])
    got = np.array([r.features for r in operator.compute(*tables).orderBy("atom_index").collect()])
    radial = operator.radial()
    for i in range(5):
        near = [(SPECIES.index(Z[j]), P[j] - P[i]) for j in range(5) if j != i and np.linalg.norm(P[j] - P[i]) < 3.0]
        g = radial(np.array([np.linalg.norm(d) for _, d in near]))
        for at, (factors, _, row) in enumerate(operator.expansion()):
            if len(factors) == 1:
                want = sum(g[k, factors[0][1] - 1] for k, (s, _) in enumerate(near) if s == factors[0][0]) / math.sqrt(4 * math.pi)
                assert got[i, at] == pytest.approx(want, abs=1e-10)
                continue
            (s, n, k), (t, m, _) = factors
            p = np.polynomial.legendre.Legendre.basis(k)
            total = sum(g[x, n - 1] * g[y, m - 1] * p(d @ e / np.linalg.norm(d) / np.linalg.norm(e)) for x, (u, d) in enumerate(near) if u == s for y, (v, e) in enumerate(near) if v == t)
            want = total * (2 * k + 1) / (4 * math.pi) / math.sqrt(2 * k + 1) * (math.sqrt(2) if factors[0] == factors[1] else 1)
            assert abs(got[i, at]) == pytest.approx(abs(want), abs=1e-9)


def test_errors():
    for wrong in ({"N": 0}, {"rin": 6.0}, {"maxdeg": (5.0,)}, {"maxdeg": (5.0, 4.0, 3.0)}, {"p": 0.0}, {"csp": -1.0}):
        with pytest.raises(ConfigurationError):
            ACE(SPECIES, **wrong)


def test_constant_of_a_lonely_atom(spark):
    alone = from_frames(spark, [{"numbers": [8], "positions": [[0, 0, 0]]}])
    got = ACE(SPECIES, N=2, maxdeg=4.0, rcut=3.0, constants=True).compute(*alone).first().features
    assert got[0] == 1.0 and not any(got[1:])
