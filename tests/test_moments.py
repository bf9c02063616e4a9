"""Moment tensor models against plain loops."""

import numpy as np
import pytest

from latticeweave.errors import ConfigurationError
from latticeweave.operators.local import MTP
from latticeweave.sources.structures import from_frames

Z = [1, 8, 8, 1]
P = np.random.default_rng(12).uniform(0, 2.5, (4, 3))
COEFFICIENTS = np.random.default_rng(2).normal(size=(2, 2, 2, 3)).round(6)
BASIC = [(0, 0, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 1), (0, 2, 1, 0)]
TIMES = [(1, 1, 1, 5), (2, 2, 1, 5), (3, 3, 1, 5), (0, 5, 2, 6)]


def model(kind="RBChebyshev"):
    braces = lambda rows: "{" + ", ".join("{" + ", ".join(map(str, r)) + "}" for r in rows) + "}"
    radial = "".join(f"\t\t{a}-{b}\n" + "".join("\t\t\t{" + ", ".join(map(repr, row.tolist())) + "}\n" for row in COEFFICIENTS[a, b]) for a in range(2) for b in range(2))
    return f"""MTP
version = 1.1.0
scaling = 0.5
species_count = 2
radial_basis_type = {kind}
\tmin_dist = 1.2
\tmax_dist = 3.0
\tradial_basis_size = 3
\tradial_funcs_count = 2
\tradial_coeffs
{radial}alpha_moments_count = 7
alpha_index_basic_count = 5
alpha_index_basic = {braces(BASIC)}
alpha_index_times_count = 4
alpha_index_times = {braces(TIMES)}
alpha_scalar_moments = 3
alpha_moment_mapping = {{0, 5, 6}}
"""


@pytest.mark.parametrize("kind", ["RBChebyshev", "RBChebyshev_repuls"])
def test_model_equals_loops(spark, kind):
    operator = MTP((1, 8), model=model(kind))
    frames = [{"numbers": Z, "positions": P.tolist()}, {"numbers": [8], "positions": [[0, 0, 0]]}]
    got = np.array([r.features for r in operator.compute(*from_frames(spark, frames)).orderBy("structure_id", "atom_index").collect()])
    for i in range(4):
        m = np.zeros(7)
        for j in range(4):
            d = P[j] - P[i]
            r = np.linalg.norm(d)
            if i == j or r > 3:
                continue
            q = max(r, 1.2) if kind.endswith("repuls") else r
            x = (2 * q - 4.2) / 1.8
            cheb = 0.5 * (q - 3) ** 2 * np.array([1, x, 2 * x * x - 1])
            value = COEFFICIENTS[(1, 8).index(Z[i]), (1, 8).index(Z[j])] @ cheb
            for k, (f, *p) in enumerate(BASIC):
                m[k] += value[f] * np.prod((d / r) ** p)
        for a, b, c, t in TIMES:
            m[t] += c * m[a] * m[b]
        np.testing.assert_allclose(got[i], [1, m[0], m[5], m[6]], atol=1e-12)
    np.testing.assert_array_equal(got[4], [1, 0, 0, 0])
    assert operator.width == 4


def test_models_are_checked(tmp_path):
    (tmp_path / "m.mtp").write_text(model())
    assert MTP((1, 8), model=str(tmp_path / "m.mtp")).reach == 3.0
    for wrong in (model().replace("species_count = 2", "species_count = 3"), model().replace("count = 5", "count = 6"), model("x"), model().replace("{0, 5, 6}", "{0, 5, 9}"), model().replace("min_dist", "min")):
        with pytest.raises(ConfigurationError):
            MTP((1, 8), model=wrong)
    with pytest.raises(ConfigurationError):
        MTP((1,), model=model())
