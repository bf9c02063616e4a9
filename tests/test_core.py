"""The atomic-structure operators: SQL oracles at the smallest scale, brute force, invariances, errors."""

import itertools
import math

import duckdb
import numpy as np
import pytest

from latticeweave.errors import ConfigurationError, InputError, UnsupportedPeriodicityError
from latticeweave.functions.special import erf_sql, erfc_sql
from latticeweave.operators.pairs import AtomicComposition, CoulombMatrix, EwaldSumMatrix, NeighborList, SineMatrix, SortedDistances
from latticeweave.operators.symmetry import ACSF, EAD
from latticeweave.plans.edges import large_structures, neighbor_edges
from latticeweave.plans.queries import ORACLE_SQL, QUERIES, ROOM
from latticeweave.sources.structures import from_frames

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    return sorted(tuple(float(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


CELL = [[4.0, 0.3, 0.0], [0.2, 3.5, 0.4], [0.0, 0.1, 5.0]]
FRAMES = [
    {"numbers": [1, 8, 1], "positions": [[0, 0, 0], [0.9, 0.2, 0], [-5.1, 0.8, 9.3]], "cell": CELL, "pbc": True},
    {"numbers": [6, 6], "positions": [[0, 0, 0], [1.2, 0, 0]]},
    {"numbers": [], "positions": []},
]


def brute_edges(frame, cutoff):
    p, cell = np.array(frame["positions"], float).reshape(-1, 3), np.array(frame.get("cell", np.zeros((3, 3))))
    reach = 8 if frame.get("pbc") else 0
    out = []
    for i, j in itertools.product(range(len(p)), repeat=2):
        for s in itertools.product(range(-reach, reach + 1), repeat=3):
            d = p[j] + np.array(s) @ cell - p[i]
            if d @ d <= cutoff**2 and not (i == j and s == (0, 0, 0)):
                out.append((i, j, *s, *np.round(d, 8)))
    return sorted(out)


@pytest.mark.parametrize("cubes", [False, True])
def test_periodic_edges_equal_brute_force(spark, cubes):
    structures, atoms = from_frames(spark, FRAMES)
    found = neighbor_edges(structures, atoms, 4.1, cubes=cubes, large=0).toPandas()
    ids = [r.structure_id for r in structures.orderBy("id").collect()]
    for sid, frame in zip(ids, FRAMES, strict=True):
        own = found[found.structure_id == sid]
        got = sorted((r.i, r.j, r.sx, r.sy, r.sz, *np.round([r.dx, r.dy, r.dz], 8)) for r in own.itertuples())
        assert got == brute_edges(frame, 4.1)


def test_half_list_and_self_pairs(spark):
    one = {"numbers": [1], "positions": [[0, 0, 0]], "cell": np.eye(3) * 3.0, "pbc": True}
    tables = from_frames(spark, [one])
    assert NeighborList(3.1).plan(*tables).count() == 6
    assert NeighborList(3.1, full_neighbor_list=False).plan(*tables).count() == 3
    assert NeighborList(3.1, self_pairs=True).plan(*tables).count() == 7


@pytest.mark.parametrize("operator", [ACSF((1, 8), 4.0, g2=((0.4, 0.5),), g3=(0.7,), g4=((0.1, 2.0, 1.0),), g5=((0.1, 1.0, -1.0),)), EAD(L=2, Rc=4.0), SortedDistances((1, 8), 4.0, 3)])
def test_rotation_translation_invariance(spark, operator):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 3, (6, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    z = [1, 8, 1, 1, 8, 8]
    moved = {"numbers": z, "positions": (p @ q + [1, -2, 5]).tolist(), "id": "b"}
    structures, atoms = from_frames(spark, [{"numbers": z, "positions": p.tolist(), "id": "a"}, moved])
    got = operator.compute(structures, atoms).join(structures, "structure_id").orderBy("id", "atom_index").toPandas()
    a, b = (np.array(got[got.id == k].features.tolist()) for k in "ab")
    assert a.shape == (6, operator.width) and np.abs(a).sum() > 0
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_matrices(spark):
    structures, atoms = from_frames(spark, [{"numbers": [1, 8], "positions": [[0, 0, 0], [0, 0, 2]]}])
    got = CoulombMatrix(3).compute(structures, atoms).first().features
    assert got == pytest.approx([0.5 * 8**2.4, 4, 0, 4, 0.5, 0, 0, 0, 0])
    with pytest.raises(UnsupportedPeriodicityError):
        SineMatrix(3).compute(structures, atoms)


def test_isolated_atoms_and_empty_tables(spark):
    structures, atoms = from_frames(spark, [{"numbers": [1], "positions": [[0, 0, 0]]}])
    assert ACSF((1,), 3.0).compute(structures, atoms).first().features == [0.0]
    none = structures.limit(0), atoms.limit(0)
    assert AtomicComposition((1,)).compute(*none).count() == 0
    assert NeighborList(2.0).compute(*none).count() == 0


def test_invalid_frames_and_species(spark):
    for bad in ({"numbers": [0], "positions": [[0, 0, 0]]}, {"numbers": [1], "positions": []}, {"numbers": [1], "positions": [[0, 0, 0]], "pbc": [True, False, True]}, {"numbers": [1], "positions": [[0, 0, 0]], "pbc": True}):
        with pytest.raises(InputError):
            from_frames(spark, [bad])
    structures, atoms = from_frames(spark, [{"numbers": [9], "positions": [[0, 0, 0]]}])
    with pytest.raises(Exception, match="undeclared atomic number"):
        AtomicComposition((1,)).plan(structures, atoms).collect()


def test_erf(spark):
    xs = [-30.0, -5.0, -1.3, -0.2, 0.0, 0.1, 0.46, 0.5, 1.0, 3.9, 4.1, 5.5, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr(f"{erf_sql('x')} AS a", f"{erfc_sql('x')} AS b").collect()
    other = duckdb.sql(f"SELECT {erf_sql('x', '')} FROM (SELECT unnest({xs}::DOUBLE[]) AS x)").fetchall()
    for x, r, (o,) in zip(xs, got, other, strict=True):
        assert r.a == pytest.approx(math.erf(x), abs=1e-15) and r.b == pytest.approx(math.erfc(x), rel=5e-13, abs=1e-300) and o == pytest.approx(r.a, abs=1e-15)


def test_sparse_and_single_precision(spark):
    from latticeweave.operators.base import as_float32
    from latticeweave.operators.symmetry import ACSF
    from latticeweave.sources.structures import from_frames

    tables = from_frames(spark, [{"numbers": [1, 8, 1], "positions": [[0, 0, 0], [1, 0, 0], [9, 9, 9]]}])
    operator = ACSF((1, 8), 3.0, g2=((0.5, 0.0),))
    dense = {r.atom_index: r.features for r in operator.compute(*tables).collect()}
    for row in operator.sparse(*tables).collect():
        assert row.width == operator.width
        want = [(k, v) for k, v in enumerate(dense[row.atom_index]) if v != 0]
        assert list(zip(row.positions, row["values"])) == want
    single = as_float32(operator.compute(*tables))
    assert dict(single.dtypes)["features"] == "array<float>" and dict(as_float32(operator.sparse(*tables)).dtypes)["values"] == "array<float>"


def test_large_structures_meet_on_cubes(spark):
    rng = np.random.default_rng(8)
    skewed = [[14.0, 0, 0], [3.0, 13.0, 0], [1.0, -2.0, 12.0]]
    frames = [
        {"numbers": [6] * 700, "positions": rng.uniform(-20, 30, (700, 3)), "cell": skewed, "pbc": True},
        {"numbers": [1] * 600, "positions": rng.uniform(0, 12, (600, 3))},
        {"numbers": [8] * 5, "positions": rng.uniform(0, 3, (5, 3)), "cell": [[2.0, 0, 0], [0.3, 2.5, 0], [0, 0, 3.0]], "pbc": True},
    ]
    structures, atoms = from_frames(spark, frames)
    rows = lambda cubes: sorted(map(tuple, neighbor_edges(structures, atoms, 2.2, cubes=cubes).select("structure_id", "i", "j", "sx", "sy", "sz").collect()))
    assert large_structures(atoms)
    plain = rows(False)
    assert rows(None) == plain and len(set(plain)) == len(plain)


def test_a_large_frame_takes_linear_work(spark):
    rng = np.random.default_rng(9)
    n, edge, reach = 20_000, 60.0, 2.0
    at = rng.uniform(0, edge, (n, 3))
    structures, atoms = from_frames(spark, [{"numbers": [6] * n, "positions": at, "cell": np.eye(3) * edge, "pbc": True}])
    found = neighbor_edges(structures, atoms, reach)
    count = found.count()
    assert abs(count / n - (n - 1) / edge**3 * 4 / 3 * np.pi * reach**3) < 0.3
    for row in found.where("i < 3").groupBy("i").count().collect():
        d = at - at[row.i]
        d -= edge * np.round(d / edge)
        assert row["count"] == ((d**2).sum(1) <= reach**2).sum() - 1


def test_matrices_hold_the_largest_order_of_every_scale(spark):
    for sf in ("0.001", "0.01", "0.1"):
        lines = spark.read.parquet(f"/root/testdata/sf{sf}/lineitem.parquet")
        assert lines.groupBy("l_orderkey").count().agg({"count": "max"}).first()[0] <= ROOM
    assert QUERIES["coulomb_matrix"](spark, "/root/testdata/sf0.001").count() > 0
    with pytest.raises(ConfigurationError):
        EwaldSumMatrix(w=0.0)
