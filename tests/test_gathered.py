"""Structures that stream as rows: the same edges and features as the join finds, one exchange, and whole results."""

import numpy as np
import pytest

from latticeweave.functions.special import smooth
from latticeweave.operators.local import SOAP, SphericalExpansionByPair
from latticeweave.operators.longrange import LodeSphericalExpansion
from latticeweave.operators.neural import NEP
from latticeweave.operators.pairs import CoulombMatrix, EwaldSumMatrix, SineMatrix
from latticeweave.operators.rotational import SO4
from latticeweave.operators.tensors import LMBTR, valle_oganov
from latticeweave.plans import gathered
from latticeweave.plans.edges import neighbor_edges
from latticeweave.plans.queries import LOCAL, QUERIES, SPECIES, TENSORS, neural_model, rounded
from latticeweave.sources.structures import from_frames

SF = "/root/testdata/sf0.001"
CELL = [[4.0, 0.3, 0.0], [0.2, 3.5, 0.4], [0.0, 0.1, 5.0]]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    sizes = [(3, CELL), (2, None), (1, None), (5, CELL), (9, CELL), (4, None), (1, CELL)]
    frames = [{"numbers": rng.choice(SPECIES, n).tolist(), "positions": rng.uniform(-6, 6, (n, 3)).tolist(), **({"cell": c, "pbc": True} if c else {})} for n, c in sizes]
    return from_frames(spark, [*frames, {"numbers": [], "positions": []}])


def sorted_rows(frame, digits=9):
    listed = [[*(np.round(v, digits).tolist() if hasattr(v, "__len__") else [round(v, digits)])] for v in frame.itertuples(index=False) for v in [np.concatenate([np.atleast_1d(np.asarray(x, float)) for x in v])]]
    return sorted(listed)


def test_streamed_edges_equal_the_joins(spark, tables):
    structures, atoms = tables
    for boundary, exact in ((True, False), (False, True)):

        def run(batches, boundary=boundary, exact=exact):
            for whole in gathered.runs(batches):
                for part, p in gathered.edges_of(whole, 4.1, boundary, exact):
                    yield gathered.batch(["structure_id", "i", "j", "sx", "sy", "sz", "dx", "dy", "dz"], [part.sid[p.i], part.index[p.i], part.index[p.j], *p.s.astype(np.int32).T, *p.d.T])

        names = "structure_id long, i int, j int, sx int, sy int, sz int, dx double, dy double, dz double"
        got = gathered.divided(structures, atoms)[0].mapInArrow(run, names).toPandas()
        want = neighbor_edges(structures, atoms, 4.1, boundary, exact).select(*got.columns).toPandas()
        assert len(want) > 100 and sorted_rows(got) == sorted_rows(want)


def test_structures_cut_by_batches_are_whole():
    import pyarrow as pa

    n = [3, 1, 4, 2]
    table = pa.table({
        "structure_id": np.repeat(np.arange(4), n), "atom_index": np.concatenate([np.arange(k) for k in n]).astype(np.int32), "z": np.ones(10, np.int32),
        "x": np.arange(10.0), "y": np.zeros(10), "zc": np.zeros(10), "n": np.repeat(n, n).astype(np.int32), "periodic": np.zeros(10, bool), "cell": [[0.0] * 9] * 10,
    })
    for size in (1, 2, 3, 10):
        found = list(gathered.runs(table.to_batches(max_chunksize=size)))
        assert np.concatenate([r.sizes for r in found]).tolist() == n
        assert np.concatenate([r.at[:, 0] for r in found]).tolist() == list(range(10))


OPERATORS = {"inner": SOAP(SPECIES, 3.5, 3, 2, 0.5), "by_pair": SphericalExpansionByPair(SPECIES, 3.5, 0.5, 3, 2), "so4": SO4(2, 3.5), "nep": NEP(neural_model())}


@pytest.mark.parametrize("name", [*OPERATORS, "predict"])
def test_small_and_large_structures_give_the_same(tables, monkeypatch, name):
    """limit 0: all by gathered edges; 3: some of each."""
    found = {}
    for limit in (0, 3, 128):
        monkeypatch.setattr(gathered, "LARGE", limit)
        frame = OPERATORS["nep"].predict(*tables) if name == "predict" else OPERATORS[name].compute(*tables) if name in ("so4", "nep") else OPERATORS[name].plan(*tables)
        found[limit] = sorted_rows(frame.toPandas(), 8)
    for limit in (3, 128):
        assert len(found[limit]) == len(found[0]) > 0
        np.testing.assert_allclose(np.array(found[limit]), np.array(found[0]), atol=1e-7)


@pytest.fixture(scope="module")
def crystals(spark):
    """Of three cells, with more than one structure of a size and a cell."""
    rng, other = np.random.default_rng(8), [[5.0, 0.0, 0.4], [0.0, 4.2, 0.0], [0.3, 0.0, 3.9]]
    sizes = [(3, CELL), (2, other), (1, CELL), (3, CELL), (6, CELL), (4, other), (4, other)]
    return from_frames(spark, [{"numbers": rng.choice(SPECIES, n).tolist(), "positions": rng.uniform(-6, 6, (n, 3)).tolist(), "cell": c, "pbc": True} for n, c in sizes])


PERIODIC = {
    "lode": LodeSphericalExpansion(SPECIES, 3.5, 0.5, 2, 3, 2.5),
    "coulomb": CoulombMatrix(8), "sine": SineMatrix(8), "sine spectrum": SineMatrix(8, "eigenspectrum"), "ewald": EwaldSumMatrix(8, "none"),
    "distances": valle_oganov(SPECIES, n=20, sigma=0.2, r_cut=3.0), "angles": valle_oganov(SPECIES, "angle", n=19, sigma=8.0, r_cut=3.0),
    "numbers": TENSORS["mbtr_atomic_number"], "unit": TENSORS["mbtr_distance"], "local": TENSORS["lmbtr_distance"], "local angles": LMBTR(SPECIES, "angle", grid_max=180.0, grid_n=7, grid_sigma=9.0, weighting="inverse_square", r_cut=3.0),
}


@pytest.mark.parametrize("name", PERIODIC)
def test_matrices_waves_and_tensors_of_small_and_large_structures(crystals, monkeypatch, name):
    """limit 3: some stream, some meet in joins. Values of rounding errors alone may be rows or not."""
    found = {}
    monkeypatch.setattr(gathered, "CANDIDATES", 200)
    for limit in (0, 3):
        monkeypatch.setattr(gathered, "LARGE", limit)
        frame = PERIODIC[name].plan(*crystals).toPandas()
        frame = frame[(frame.value.abs() > 1e-9) | (name != "lode")]
        found[limit] = np.array(sorted_rows(frame, 12))
    assert len(found[0]) == len(found[3]) > 0
    np.testing.assert_allclose(found[3], found[0], rtol=1e-7, atol=1e-8)


STREAMED = [*LOCAL, "mtp", "nep_low", "nep_predict", "lode_spherical_expansion", "coulomb_matrix_sorted", "sine_matrix_spectrum", "ewald_sum_matrix", *TENSORS]


@pytest.mark.parametrize("name", STREAMED)
def test_atoms_are_exchanged_once(spark, name):
    """Atoms and the structures' keys, and nothing of what was made of them."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_undeclared_numbers_fail(spark):
    tables = from_frames(spark, [{"numbers": [1, 7], "positions": [[0, 0, 0], [1, 0, 0]]}])
    with pytest.raises(Exception, match="undeclared atomic number 7"):
        SOAP((1, 8), 3.0, 2, 1, 0.5, "off").compute(*tables).collect()


def test_interpolation_is_as_good_as_the_function():
    r = np.linspace(0, 3.5, 501)
    for function in (lambda x: np.stack([np.exp(-((x - 2) ** 2) / 0.02), np.cos(9 * x)], 1), lambda x: np.ones((len(x), 2)), lambda x: np.zeros((len(x), 1))):
        np.testing.assert_allclose(smooth(function, 3.5)(r), function(r), atol=1e-12)


def test_halves_are_rounded_away_from_zero_and_no_value_is_lost(spark):
    values = [0.0000005, -0.0000005, 1.2345674, -1.2345676, 3e12 + 0.5, float("inf"), float("nan"), 0.0, -4e-7]
    got = [r.value for r in rounded(spark.createDataFrame([(v,) for v in values], "value double")).collect()]
    assert got[:6] == [1e-6, -1e-6, 1.234567, -1.234568, 3e12 + 0.5, float("inf")] and np.isnan(got[6]) and got[7:] == [0.0, 0.0]
