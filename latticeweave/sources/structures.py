"""Atomic structures as two tables.

structures(structure_id, id, cell array<double>[9] row-major, periodic), atoms(structure_id, atom_index, z, x, y, zc).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError

FRAME = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("numbers", T.ArrayType(T.IntegerType())),
    T.StructField("positions", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("cell", T.ArrayType(T.DoubleType())),
    T.StructField("periodic", T.BooleanType()),
])


def from_frames(spark: SparkSession, frames: list[dict]) -> tuple[DataFrame, DataFrame]:
    """frames: dicts with numbers, positions and optional id, cell (3x3) and pbc (all or nothing)."""
    rows = []
    for n, f in enumerate(frames):
        numbers, positions = list(f["numbers"]), [list(map(float, p)) for p in f["positions"]]
        if len(numbers) != len(positions) or any(len(p) != 3 for p in positions):
            raise InputError("numbers and positions differ in length", f"frames[{n}].positions")
        if any(isinstance(z, bool) or int(z) != z or z <= 0 for z in numbers):
            raise InputError("atomic numbers are positive integers", f"frames[{n}].numbers")
        pbc = f.get("pbc", False)
        flags = {bool(pbc)} if isinstance(pbc, (bool, int)) else {bool(p) for p in pbc}
        if len(flags) != 1:
            raise InputError("partial periodicity", f"frames[{n}].pbc")
        cell = [float(x) for row in f.get("cell", [[0.0] * 3] * 3) for x in row]
        a, b, c = cell[:3], cell[3:6], cell[6:]
        volume = abs(a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
        if True in flags and volume < 1e-14:
            raise InputError("a periodic structure needs a cell with a volume", f"frames[{n}].cell")
        rows.append((str(f.get("id", n)), [int(z) for z in numbers], positions, cell, True in flags))
    return unpack(spark.createDataFrame(rows, FRAME).withColumn("structure_id", F.monotonically_increasing_id()))


def unpack(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From one row per frame (structure_id and the fields of FRAME) to the two tables."""
    structures = frames.select("structure_id", "id", "cell", "periodic")
    atoms = frames.select("structure_id", F.posexplode(F.arrays_zip("numbers", "positions")).alias("atom_index", "a"))
    place = lambda i, name: F.get("a.positions", F.lit(i)).alias(name)
    return structures, atoms.select("structure_id", "atom_index", F.col("a.numbers").alias("z"), place(0, "x"), place(1, "y"), place(2, "zc"))


#: The driver's lineitem table as structures: one per order.
LINEITEM_ATOMS = """
SELECT l_orderkey AS structure_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INT) AS atom_index,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 6 ELSE 8 END AS z,
       CAST(l_quantity AS DOUBLE) / 5 AS x, CAST(l_extendedprice AS DOUBLE) / 10000 AS y, CAST(l_tax AS DOUBLE) * 100 AS zc
FROM {lineitem}"""

#: What orders an order's lines.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lineitem_structures(spark: SparkSession, sf_dir: str, edge: float = 12.0, periodic: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """periodic: of every order alike; where it is not given, orders of even key are. The rows of LINEITEM_ATOMS, by a
    window over the structures' own key, so that what follows by structure needs no second exchange."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 6).otherwise(8)
    keyed = lines.select(F.col("l_orderkey").alias("structure_id"), number.alias("z"), *ORDER)
    index = F.row_number().over(Window.partitionBy("structure_id").orderBy(*ORDER)) - 1
    place = {"x": F.col("l_quantity").cast("double") / 5, "y": F.col("l_extendedprice").cast("double") / 10000, "zc": F.col("l_tax").cast("double") * 100}
    atoms = keyed.select("structure_id", index.cast("int").alias("atom_index"), "z", *[v.alias(k) for k, v in place.items()])
    cell = F.array(*[F.lit(edge if i % 4 == 0 else 0.0) for i in range(9)])
    key = F.col("l_orderkey")
    structures = lines.select("l_orderkey").distinct().select(key.alias("structure_id"), key.cast("string").alias("id"), cell.alias("cell"), (key % 2 == 0 if periodic is None else F.lit(periodic)).alias("periodic"))
    return structures, atoms
