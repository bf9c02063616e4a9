"""Bispectra: rotations as representations, invariance, plain sums."""

import math

import numpy as np
import pytest

from latticeweave.errors import ConfigurationError
from latticeweave.operators.rotational import SNAP, SO4, LBispectrum, coupling, rotation_matrices
from latticeweave.sources.structures import from_frames

Z = [1, 8, 1, 8, 6]
P = np.random.default_rng(15).uniform(0, 2.6, (5, 3))
Q, _ = np.linalg.qr(np.random.default_rng(6).normal(size=(3, 3)))
Q = Q * np.sign(np.linalg.det(Q))


@pytest.fixture(scope="module")
def tables(spark):
    frames = [{"numbers": Z, "positions": p.tolist(), "id": n} for n, p in (("a", P), ("b", P @ Q + [3, -1, 2]))]
    return from_frames(spark, frames)


def features(tables, operator, frame="a"):
    structures, atoms = tables
    got = operator.compute(structures, atoms).join(structures.where(f"id = '{frame}'").select("structure_id"), "structure_id").orderBy("atom_index").toPandas()
    return np.array(got.features.tolist())


def test_matrices_are_unitary_and_symmetric():
    d, angle = np.random.default_rng(2).normal(size=(4, 3)), np.array([0.1, 1.0, 2.0, 3.0])
    for j, u in enumerate(rotation_matrices(d, angle, 5)):
        np.testing.assert_allclose(u @ u.conj().transpose(0, 2, 1), np.broadcast_to(np.eye(j + 1), u.shape), atol=1e-12)
        sign = (-1.0) ** np.add.outer(np.arange(j + 1), np.arange(j + 1))
        np.testing.assert_allclose(u[:, ::-1, ::-1], sign * u.conj(), atol=1e-12)
        np.testing.assert_allclose(np.trace(u, axis1=1, axis2=2).real, np.sin((j + 1) * angle) / np.sin(angle), atol=1e-12)


def test_couplings_are_orthonormal():
    for a, b in ((1, 1), (2, 1), (3, 2), (4, 4)):
        rows = np.concatenate([coupling(a, b, c).reshape(-1, c + 1) for c in range(abs(a - b), a + b + 1, 2)], axis=1)
        np.testing.assert_allclose(rows.T @ rows, np.eye((a + 1) * (b + 1)), atol=1e-12)
    np.testing.assert_allclose(coupling(1, 1, 2)[:, :, 1], [[0, math.sqrt(0.5)], [math.sqrt(0.5), 0]], atol=1e-12)


@pytest.mark.parametrize("operator", [SO4(2, 3.0), SNAP(2, 3.0, True, ((8, 0.5),)), LBispectrum(twojmax=4, diagonal=0, rmin0=0.2), LBispectrum(twojmax=3, element_radii=((1, 1.0), (6, 1.5), (8, 1.2)))])
def test_invariance_and_width(spark, tables, operator):
    a, b = features(tables, operator), features(tables, operator, "b")
    assert a.shape == (5, operator.width) and np.abs(a[:, 1:]).max() > 1e-3
    np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-8)


def test_scalar_component_equals_loops(spark, tables):
    radii = {1: 1.0, 6: 1.5, 8: 1.2}
    plain, sized = SNAP(1, 3.0, element_weights=((8, 0.5),)), LBispectrum(twojmax=0, rmin0=0.1, rcutfac=0.9, element_radii=tuple(radii.items()))
    got = features(tables, SO4(1, 3.0))[:, 0], features(tables, plain)[:, 0], features(tables, sized)[:, 0]
    for i in range(5):
        sums = [Z[i], 1.0, 1.0]
        for j in range(5):
            r = np.linalg.norm(P[j] - P[i])
            if i != j and r <= 3.0:
                fade = 0.5 * (math.cos(math.pi * r / 3) + 1)
                sums[0] += Z[j] * fade
                sums[1] += (0.5 if Z[j] == 8 else 1.0) * fade
            cut = (radii[Z[i]] + radii[Z[j]]) * 0.9
            if i != j and r <= cut:
                sums[2] += 0.5 * (math.cos(math.pi * max(0, r - 0.1) / (cut - 0.1)) + 1)
        np.testing.assert_allclose([g[i] for g in got], np.array(sums) ** 3, rtol=1e-10)


def test_component_lists():
    assert SO4(1).components() == [(0, 0, 0), (1, 0, 1), (1, 1, 2), (2, 0, 2), (2, 2, 2)]
    assert len(SO4(3).components()) == len(SNAP(3).components())
    assert LBispectrum(twojmax=2, diagonal=2).components() == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    assert all(a == b for a, b, _ in LBispectrum(twojmax=4, diagonal=1).components())
    assert (2, 2, 0) in LBispectrum(twojmax=2, diagonal=0).components() and (2, 2, 0) not in LBispectrum(twojmax=2).components()
    for wrong in ({"diagonal": 4}, {"rmin0": 4.0}, {"rcut": 0.0}):
        with pytest.raises(ConfigurationError):
            LBispectrum(**wrong)


def test_isolated_atom_has_its_identity(spark):
    alone = from_frames(spark, [{"numbers": [8], "positions": [[0, 0, 0]]}])
    got = SO4(1).compute(*alone).first().features
    # Of identities the sum over couplings of j to itself is its dimension.
    np.testing.assert_allclose(got, [8.0**3 * (c + 1) for _, _, c in SO4(1).components()], rtol=1e-12)
