"""Neighbour edges: a periodic fixed-radius self-join per structure.

Both sides meet on structure_id, so one exchange of the atoms serves the join and every later aggregation by structure
or centre. Where a structure is large, its atoms also meet on cubes of the cutoff's edge: images know their cube, centres
look into 27, so the work grows with the atoms and no structure is one key.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_COLUMNS = ("structure_id", "i", "j", "zi", "zj", "sx", "sy", "sz", "dx", "dy", "dz", "d2")
#: Atoms beyond which a structure is cut into cubes.
LARGE = 512
#: Fractions of a cell by which an image may miss the reach through rounding.
_EDGE = 1e-9


def _inverse(cell: Column) -> list[Column]:
    """Closed-form inverse of a row-major 3x3 matrix."""
    m = [[F.get(cell, F.lit(3 * r + c)) for c in range(3)] for r in range(3)]
    cof = [[m[(c + 1) % 3][(r + 1) % 3] * m[(c + 2) % 3][(r + 2) % 3] - m[(c + 1) % 3][(r + 2) % 3] * m[(c + 2) % 3][(r + 1) % 3] for c in range(3)] for r in range(3)]
    det = m[0][0] * cof[0][0] + m[0][1] * cof[1][0] + m[0][2] * cof[2][0]
    return [cof[r][c] / det for r in range(3) for c in range(3)]


def framed(structures: DataFrame, cutoff: float | Column) -> DataFrame:
    """structure_id, cell, periodic, inverse cell, cutoff and, for each axis, how far the cutoff reaches in fractions of
    the cell (nowhere in structures that are not periodic)."""
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    inverse = F.when(F.col("periodic"), F.array(*_inverse(F.col("cell")))).otherwise(F.array(*[F.lit(0.0)] * 9))
    reach = lambda k: F.col("cutoff") * F.sqrt(sum((F.get("inverse", F.lit(3 * r + k)) ** 2 for r in range(3)), F.lit(0.0)))
    return structures.withColumns({"inverse": inverse, "cutoff": cutoff}).select("structure_id", "cell", "periodic", "inverse", "cutoff", *[reach(k).alias(f"reach{k}") for k in range(3)])


def _wrapped(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds the cell shift w* that brings each periodic atom into the cell, its position p* and its fractions s* there."""
    at = [F.col(c) for c in ("x", "y", "zc")]
    joined = atoms.join(frames, "structure_id")
    joined = joined.withColumns({f"s{k}": sum((at[r] * F.get("inverse", F.lit(3 * r + k)) for r in range(3)), F.lit(0.0)) for k in range(3)})
    joined = joined.withColumns({f"w{k}": F.when(F.col("periodic"), F.floor(F.col(f"s{k}"))).otherwise(0).cast("int") for k in range(3)})
    moved = lambda c: at[c] - sum((F.col(f"w{k}") * F.get("cell", F.lit(3 * k + c)) for k in range(3)), F.lit(0.0))
    return joined.withColumns({f"p{c}": moved(c) for c in range(3)} | {f"s{k}": F.col(f"s{k}") - F.col(f"w{k}") for k in range(3)})


def _packed(cubes: list[Column]) -> Column:
    """Three cube numbers as one long; numbers 2**21 cubes apart share one, which only costs comparisons."""
    low = [F.pmod(c.cast("long"), F.lit(1 << 21)) for c in cubes]
    return F.shiftleft(low[0], 42) + F.shiftleft(low[1], 21) + low[2]


def neighbor_edges(structures: DataFrame, atoms: DataFrame, cutoff: float | Column, boundary: bool = True, exact_self: bool = False, cubes: bool | None = None, large: int = LARGE) -> DataFrame:
    """EDGE_COLUMNS; d = image of j minus i. An edge to the atom itself without a shift is the exact self.

    cutoff: one radius, or a column of structures. Of a periodic atom only images within the cutoff of the cell's faces
    are made. cubes: whether structures of more than `large` atoms also meet on cubes of the cutoff's edge; smaller ones
    stay in one cube. Where it is not given, a count of each structure's atoms decides."""
    own = isinstance(cutoff, Column)
    cubes = large_structures(atoms, large) if cubes is None else cubes
    placed = _wrapped(atoms, framed(structures, cutoff))
    on = ["structure_id"]
    if cubes:
        sizes = atoms.groupBy("structure_id").agg((F.count(F.lit(1)) > large).alias("large"))
        placed, on = placed.join(sizes, "structure_id"), ["structure_id", "cube"]
    images = placed
    for k in range(3):
        low, high = F.ceil(-F.col(f"reach{k}") - F.col(f"s{k}") - _EDGE), F.floor(1 + F.col(f"reach{k}") - F.col(f"s{k}") + _EDGE)
        one = F.when(F.col("periodic"), F.sequence(F.least(low, F.lit(0)).cast("int"), F.greatest(high, F.lit(0)).cast("int"))).otherwise(F.array(F.lit(0)))
        images = images.select("*", F.explode(one).alias(f"t{k}"))
    there = lambda c: F.col(f"p{c}") + sum((F.col(f"t{k}") * F.get("cell", F.lit(3 * k + c)) for k in range(3)), F.lit(0.0))
    right = images.select("structure_id", F.col("atom_index").alias("j"), F.col("z").alias("zj"), *[F.col(f"t{k}") for k in range(3)], *[F.col(f"w{k}").alias(f"v{k}") for k in range(3)], *[there(c).alias(f"q{c}") for c in range(3)], *(["large", "cutoff"] if cubes else []))
    left = placed.select("structure_id", F.col("atom_index").alias("i"), F.col("z").alias("zi"), "w0", "w1", "w2", "p0", "p1", "p2", *(["cutoff"] if own or cubes else []), *(["large"] if cubes else []))
    if cubes:
        cube = lambda name: [F.floor(F.col(f"{name}{c}") / F.col("cutoff")) for c in range(3)]
        around = [_packed([c + s for c, s in zip(cube("p"), shift, strict=True)]) for shift in product((-1, 0, 1), repeat=3)]
        right = right.withColumn("cube", F.when(F.col("large"), _packed(cube("q"))).otherwise(F.lit(0).cast("long"))).drop("large", "cutoff")
        left = left.withColumn("cube", F.explode(F.when(F.col("large"), F.array_distinct(F.array(*around))).otherwise(F.array(F.lit(0).cast("long"))))).drop("large")
    d = [F.col(f"q{c}") - F.col(f"p{c}") for c in range(3)]
    edges = left.join(right, on).withColumns({"dx": d[0], "dy": d[1], "dz": d[2]})
    edges = edges.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    square = F.col("cutoff") * F.col("cutoff") if own else cutoff**2
    edges = edges.where(F.col("d2") <= square if boundary else F.col("d2") < square)
    if not exact_self:
        edges = edges.where(~((F.col("i") == F.col("j")) & (F.col("t0") == 0) & (F.col("t1") == 0) & (F.col("t2") == 0)))
    out = {"sx": 0, "sy": 1, "sz": 2}
    return edges.select("structure_id", "i", "j", "zi", "zj", *[(F.col(f"t{k}") + F.col(f"w{k}") - F.col(f"v{k}")).alias(n) for n, k in out.items()], "dx", "dy", "dz", "d2")


def half_list(edges: DataFrame) -> DataFrame:
    """One of each pair: j > i, or an image of the centre whose first non-zero shift is positive."""
    first = F.when(F.col("sx") != 0, F.col("sx")).when(F.col("sy") != 0, F.col("sy")).otherwise(F.col("sz"))
    return edges.where((F.col("j") > F.col("i")) | ((F.col("i") == F.col("j")) & (first >= 0)))


def large_structures(atoms: DataFrame, limit: int = LARGE) -> bool:
    """Whether any structure has more than limit atoms: one count by structure, of keys only."""
    return bool(atoms.groupBy("structure_id").count().where(F.col("count") > limit).limit(1).count())
