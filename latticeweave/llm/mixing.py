"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of all documents. A target stops
at three times its source's size; the excess is shared again by weight (the level is found in closed form from prefix
sums over the sources sorted by cap per weight). Within a source every document expects target / size copies. Documents
stand in order of size, so that equal steps through them take equal shares of short and long ones; a document is
emitted once for each integer that its step over the prefix sum, plus the source's random offset, crosses.

The order is by size and then by a hash of id and text, and the prefix sum over it is exact and spread over levels, so
that no window holds more than a few rows however large a source is: counts by block of 64 sizes (within a source), by
size (within a block), by the hash's first digits (within a size), and ranks of documents (within those digits). The
number of digits follows the number of documents, so that thousands of equal copies, or a third of all rows, fall into
many groups of about GROUP rows. Only the table of sources, a row each, meets in one window.

Defined cases: null text has size 0; a null id is allowed; a null source is a source of its own; equal rows share their copies in
any order, with the same result as a set of rows; rows equal in id and text stand in the order of a hash of all their columns; an empty table gives no rows. Extra columns are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, spread_join, written

#: Documents ranked at once, about; sizes to a block.
GROUP, BLOCK = 1 << 16, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: (source, source_size, ...), a row per source. Adds target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_repeat))
    everyone = Window.partitionBy()
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "total": F.sum("source_size").over(everyone).cast("double"),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # Level if every source before this one is at its cap; the level holds from the first source that stays under its cap.
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    ranked = ranked.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everyone)["level"])
    return ranked.select(*sizes.columns, F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _before(counts: DataFrame, inside: list[str], by: str, name: str) -> DataFrame:
    """Adds what stands before each row, within `inside` in the order of `by`."""
    return counts.withColumn(name, F.coalesce(F.sum("n").over(Window.partitionBy(*inside).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def prefixes(cells: DataFrame) -> DataFrame:
    """cells: (key, size, b, n). Instead of n, the number of documents of the key before each cell."""
    cells = cells.withColumn("block", F.floor(F.col("size") / BLOCK))
    sizes = cells.groupBy("key", "block", "size").agg(F.sum("n").alias("n"))
    blocks = sizes.groupBy("key", "block").agg(F.sum("n").alias("n"))
    placed = _before(cells, ["key", "block", "size"], "b", "in_size").drop("n")
    placed = placed.join(_before(sizes, ["key", "block"], "size", "in_block").drop("n"), ["key", "block", "size"])
    placed = placed.join(_before(blocks, ["key"], "block", "in_key").drop("n"), ["key", "block"])
    return placed.select("key", "size", "b", (F.col("in_size") + F.col("in_block") + F.col("in_key")).alias("before"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_repeat: int = 3) -> DataFrame:
    """(doc, size, source_size, target, copies): doc is a struct of all the input's columns."""
    # A key that is never null, so that it joins.
    key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("key")
    text = F.col(f"`{text_col}`").cast("string")
    digest = lambda *parts: F.md5(F.concat_ws(":", *parts).cast("binary"))
    h = digest(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(str(seed)))
    digits = next(k for k in range(1, 33) if docs.count() <= GROUP * 16**k)
    b, size = F.substring("h", 1, digits).alias("b"), word_count(text).alias("size")
    known = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key, size, h.alias("h"), F.xxhash64(*known).alias("tie")).select("*", b)
    cells = docs.select(key, size, h.alias("h")).select("key", "size", b).groupBy("key", "size", "b").agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells)
    sizes = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes.select(F.when(F.col("key") != "", F.substring("key", 2, 2147483647)).alias("source"), "source_size", "key"), max_repeat)
    offset = F.conv(F.substring(digest(F.col("key"), F.lit(str(seed))), 1, 10), 16, 10).cast("double") / float(16**10)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    known_sources = targets.drop("source").withColumns({"rate": rate, "u": offset})
    plan = spread_join(written(prefixes(cells)), written(known_sources), "key", "inner")
    rank = F.row_number().over(Window.partitionBy("key", "size", "b").orderBy("h", "tie"))
    joined = rows.withColumn("rank", rank).drop("h", "tie").join(plan, ["key", "size", "b"])
    at = F.col("before") + F.col("rank")
    copies = F.least(F.floor(at * F.col("rate") + F.col("u")) - F.floor((at - 1) * F.col("rate") + F.col("u")), F.lit(max_repeat))
    return joined.select("doc", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("copies"))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's columns, a row for each copy."""
    mixed = mix(docs, **options).where(F.col("copies") > 0)
    return mixed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
