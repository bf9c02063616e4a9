"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of every word shingle, repeats included; a bit is set if it is set in over half of the
hashes. Equal fingerprints meet first, so copies cost one row each and never pair up.

Two ways to link:

* ``radius``: fingerprints of 64 bits that differ in at most 3. Search is exact: of four 16-bit bands one must agree, and
  of the other 48 bits cut into four again one 12-bit band must agree, so two linked fingerprints share one of 16 keys.
  A key of too many fingerprints is cut again by four bands of its remaining bits, as often as needed, which is exact
  for the same reason.
* ``similarity``: shingle sets whose estimated Jaccard similarity reaches it. Fingerprints have 512 bits, whose expected
  difference follows from the similarity; blocks to compare come from ten keys of three minimum hashes of the same
  shingles (a pair of similarity 0.8 shares one with a probability of 0.999). A block of too many fingerprints is dealt
  over parts, and every two parts meet in a task of their own, so that each pair of the block is still compared.

Inside a block fingerprints stand as vertical bit planes, 64 to a machine word, and are compared with themselves shifted
by 1, 2, ... places, or with one pivot after another. Differences add up in carry-save counters that start so far below
their overflow that a carry out says "beyond the radius", and a word is abandoned once all its pairs are. Links leave as
a forest (at most one row per fingerprint and block), never as all pairs. In a long block, members near a pivot are one
cluster at once; clusters are compared member by member only where the distance of their pivots leaves room for a link.

Components: alternating large-star and small-star steps over written tables until nothing changes; the hub of a large
component is a hot key and is salted.

Defined cases: texts without words (and null texts) have fingerprint zero and link like any other; texts of fewer words
than a shingle hash their whole sequence; null ids take part, and a component's id is the smallest non-null one; repeated
rows come out as often as they come in; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._common import ascii_lower, bounded_batches, spread_join, wide_batches, work_dir, written

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Words of 64 bits of a fingerprint that is compared by similarity; keys of minimum hashes, and hashes to a key.
WIDE, KEYS, ROWS = 8, 10, 3
#: Long runs are cut inside a worker, HOT keys before they reach one.
LONG_RUN, CHUNK, HOT = 2048, 1 << 16, 1 << 17
_MIX = np.random.default_rng(2).integers(0, 1 << 63, (2, WIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MINIMA = np.random.default_rng(3).integers(0, 1 << 63, KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included, in pieces; nothing for a text without words."""
    words = ascii_lower(text).split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    k = min(shingle, len(words))
    starts = (ends - size + 1)[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    for at in range(0, len(starts), CHUNK):
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], np.uint64)


def _majority(pieces: Iterator[np.ndarray]) -> np.ndarray:
    """Bits set in over half of the hashes; pieces: (hashes, words)."""
    total, counts = 0, 0
    for hashes in pieces:
        counts = counts + np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return np.packbits(2 * counts > total, bitorder="little").view(np.uint64) if total else np.zeros(0, np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As a signed 64-bit integer."""
    found = _majority(h[:, None] for h in shingle_hashes(text, shingle, seed))
    return int(found.view(np.int64)[0]) if len(found) else 0


def widened(hashes: np.ndarray) -> np.ndarray:
    """(hashes, WIDE) independent words from one hash each."""
    x = hashes[:, None] * _MIX[0]
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    return np.ascontiguousarray(x ^ (x >> np.uint64(29)))


def wide_fingerprint(text: str | None, shingle: int) -> tuple[bytes, list[int]]:
    """512 bits, and KEYS keys of minimum hashes; zeros for a text without words."""
    least = np.full(KEYS * ROWS, np.iinfo(np.uint64).max)

    def pieces() -> Iterator[np.ndarray]:
        nonlocal least
        for hashes in shingle_hashes(text, shingle):
            for at in range(0, len(hashes), 4096):
                some = hashes[at : at + 4096]
                least = np.minimum(least, (some[:, None] * _MINIMA).min(axis=0))
                yield widened(some)

    bits = _majority(pieces())
    if not len(bits):
        return bytes(8 * WIDE), [0] * KEYS
    rows = least.reshape(KEYS, ROWS)
    return bits.tobytes(), [xxh64_intdigest(rows[k].tobytes(), k) - (1 << 63) for k in range(KEYS)]


def radius_of(similarity: float) -> int:
    """Bits of 64 * WIDE in which sets of that Jaccard similarity are expected to differ."""
    return round(64 * WIDE * acos(min(1.0, 2 * similarity / (1 + similarity))) / pi)


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return made(text.cast("string"))


def wide_fingerprints(text: Column, shingle: int) -> Column:
    @F.pandas_udf("fp binary, keys array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([wide_fingerprint(t, shingle) for t in texts], columns=["fp", "keys"])

    return made(text.cast("string"))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of (n, words) values: a row of machine words for each bit, a bit per fingerprint, and a zero word behind."""
    words = -(-len(values) // 64) + 1
    bits = np.zeros((words * 64, values.shape[1] * 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _shifted(sheet: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """Words `at` of the planes, moved by `by` places."""
    whole, part = divmod(by, 64)
    last = sheet.shape[1] - 1
    low = sheet[:, np.minimum(at + whole, last)]
    if not part:
        return low
    high = sheet[:, np.minimum(at + whole + 1, last)]
    return (low >> np.uint64(part)) | (high << np.uint64(64 - part))


def within(differences, count: int, at: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (and their bits) of `mask` where at most `radius` planes differ.

    differences(planes, words): the differing bits of some planes. Carry-save counters: each level holds one waiting
    vector, a second one is added to the level's counter, and the carry goes one level up."""
    levels = radius.bit_length()
    start = (1 << levels) - 1 - radius
    full = ~np.uint64(0)
    counter = [np.full(len(at), full if start >> k & 1 else np.uint64(0)) for k in range(levels)]
    waiting: list[np.ndarray | None] = [None] * levels
    over = np.zeros(len(at), np.uint64)
    for group in range(0, count, 8):
        if not len(at):
            return at, mask
        for carry in differences(slice(group, group + 8), at):
            for k in range(levels):
                if waiting[k] is None:
                    waiting[k] = carry
                    break
                a, c = waiting[k], counter[k]
                waiting[k], either = None, c ^ a
                counter[k], carry = either ^ carry, (c & a) | (either & carry)
            else:
                over |= carry
        mask = mask & ~over
        keep = mask != 0
        if not keep.all():  # abandoned: every pair of these words exceeds the radius
            at, mask, over = at[keep], mask[keep], over[keep]
            counter = [c[keep] for c in counter]
            waiting = [w if w is None else w[keep] for w in waiting]
    for k in range(levels):  # what still waits
        if waiting[k] is not None:
            carry = waiting[k]
            for up in range(k, levels):
                counter[up], carry = counter[up] ^ carry, counter[up] & carry
            over |= carry
    mask = mask & ~over
    return at[mask != 0], mask[mask != 0]


def _marks(words: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Positions of the bits set in some words."""
    row, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return words[row] * 64 + bit


def _words(flags: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that hold a flagged position, and their bits."""
    own = np.zeros(width * 64, np.uint8)
    own[: len(flags)] = flags
    mask = np.packbits(own, bitorder="little").view(np.uint64)
    at = np.flatnonzero(mask)
    return at, mask[at]


class Forest:
    """Union-find over positions of an array, by smallest position."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                break
            r = nxt
        self.up[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def _compare(values: np.ndarray, lengths: np.ndarray, origin: np.ndarray, forest: Forest, radius: int) -> None:
    """values: fingerprints, run after run of the given lengths; origin: their positions in the forest. All pairs of each
    run: short runs together, long ones by pivots."""
    starts = np.cumsum(lengths) - lengths
    for at, n in zip(starts[lengths > 64], lengths[lengths > 64], strict=True):
        _by_pivots(values[at : at + n], origin[at : at + n], forest, radius)
    picked = lengths <= 64
    if not picked.any():
        return
    inside = np.repeat(picked, lengths)
    part, own, size = values[inside], origin[inside], lengths[picked]
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    sheet = planes(part)
    for by in range(1, int(size.max())):
        words, mask = _words(left > by, sheet.shape[1])
        i = _marks(*within(lambda p, at: sheet[p][:, at] ^ _shifted(sheet[p], at, by), len(sheet), words, mask, radius))  # noqa: B023
        if len(i):
            forest.join(own[i], own[i + by])


def _near(sheet: np.ndarray, value: np.ndarray, flags: np.ndarray, radius: int) -> np.ndarray:
    """Flagged positions whose fingerprint is within the radius of value."""
    bits = np.unpackbits(value.view(np.uint8), bitorder="little").astype(np.uint64) * ~np.uint64(0)
    words, mask = _words(flags, sheet.shape[1])
    return _marks(*within(lambda p, at: sheet[p][:, at] ^ bits[p, None], len(sheet), words, mask, radius))


def _by_pivots(values: np.ndarray, origin: np.ndarray, forest: Forest, radius: int) -> None:
    """Clusters around pivots, then links between clusters that their pivots' distance allows."""
    n, sheet = len(values), planes(values)
    free, cluster, pivots = np.ones(n, np.uint8), np.zeros(n, int), []
    while True:
        at = int(free.argmax())
        if not free[at]:
            break
        found = _near(sheet, values[at], free, radius)
        forest.join(np.full(len(found), origin[at]), origin[found])
        cluster[found], free[found] = len(pivots), 0
        pivots.append(at)
    heads = values[pivots]
    apart = lambda a, b: np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    reach = np.zeros(len(pivots), np.int64)
    np.maximum.at(reach, cluster, apart(values, heads[cluster]))
    size = np.bincount(cluster)
    for k in range(len(pivots)):
        others = np.flatnonzero(apart(heads, heads[k]) <= radius + reach + reach[k])
        # The smaller cluster's members are the pivots; a single member is its own pivot and has been compared.
        others = others[(others != k) & ((size[others] > size[k]) | ((size[others] == size[k]) & (others > k))) & (size[others] > 1)]
        if not len(others):
            continue
        for member in np.flatnonzero(cluster == k):
            roots = forest.roots(origin[pivots])
            open_ = others[roots[others] != roots[k]]
            if not len(open_):
                break
            found = _near(sheet, values[member], np.isin(cluster, open_).astype(np.uint8), radius)
            forest.join(np.full(len(found), origin[member]), origin[found])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return edges, np.diff(np.append(edges, len(keys)))


def link(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (position, root) between fingerprints of one key. keys are sorted; values (n, words) are distinct within one."""
    forest = Forest(len(values))
    starts, lengths = _runs(keys)
    narrow = values.shape[1] == 1
    plain = (lengths > 1) & ((lengths <= LONG_RUN) | (not narrow))
    inside = np.flatnonzero(np.repeat(plain, lengths))
    if len(inside):
        _compare(values[inside], lengths[plain], inside, forest, radius)
    for at, n in zip(starts[(lengths > 1) & ~plain], lengths[(lengths > 1) & ~plain], strict=True):
        _long(values[at : at + n], np.arange(at, at + n), forest, radius)
    root = forest.roots(np.arange(len(values)))
    moved = np.flatnonzero(root != np.arange(len(values)))
    return moved, root[moved]


def _long(values: np.ndarray, origin: np.ndarray, forest: Forest, radius: int) -> None:
    """A long run: pairs within the radius agree in one of radius + 1 shares of the bits that vary most."""
    bits = np.unpackbits(values.view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    order = np.argsort(np.abs(bits.mean(axis=0) - 0.5), kind="stable")
    for share in range(radius + 1):
        key = np.ascontiguousarray(np.packbits(bits[:, order[share :: radius + 1]], axis=1, bitorder="little")).view(np.uint16).ravel()
        by = np.argsort(key, kind="stable")
        _, lengths = _runs(key[by])
        inside = np.repeat(lengths > 1, lengths)
        if inside.any():
            _compare(values[by][inside], lengths[lengths > 1], origin[by][inside], forest, radius)


def _link_batches(radius: int):
    """Input sorted by key: (key, node, fp). A key's rows are kept together, across batches where need be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frames: list[pd.DataFrame]) -> pd.DataFrame:
            whole = pd.concat(frames) if len(frames) > 1 else frames[0]
            fp = whole["fp"].to_numpy()
            values = fp.astype(np.int64).view(np.uint64)[:, None] if fp.dtype != object else np.frombuffer(b"".join(fp), np.uint64).reshape(len(fp), -1)
            a, b = link(whole["key"].to_numpy(), np.ascontiguousarray(values), radius)
            node = whole["node"].to_numpy()
            return pd.DataFrame({"a": node[a], "b": node[b]})

        size = 0
        for batch in batches:
            keys = batch["key"].to_numpy()
            if not len(keys):
                continue
            held.append(batch)
            size += len(keys)
            cut = int(np.searchsorted(keys, keys[-1]))
            if size >= CHUNK and (cut or len(held) > 1 and held[-2]["key"].iloc[-1] != keys[0]):
                tail = batch.iloc[cut:]
                held[-1] = batch.iloc[:cut]
                yield done(held)
                held, size = [tail], len(tail)
        if held:
            yield done(held)

    return run


def _bands(bits: list[int], fp: Column, parts: int) -> list[Column]:
    """The values of `parts` bands of some bits of fp."""
    out = []
    step = -(-len(bits) // parts)
    for own in (bits[at : at + step] for at in range(0, len(bits), step)):
        value, at = F.lit(0).cast("long"), 0
        while at < len(own):  # runs of neighbouring bits
            n = 1
            while at + n < len(own) and own[at + n] == own[at] + n:
                n += 1
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, own[at]).bitwiseAND(F.lit((1 << n) - 1)), at))
            at += n
        out.append(value)
    return out


def candidate_keys() -> list[tuple[int, Column]]:
    """The 16 keys of fp, a 16-bit band and a 12-bit band of what remains, each with the mask of the bits it leaves."""
    fp, keys = F.col("fp"), []
    for b in range(4):
        own = list(range(16 * b, 16 * b + 16))
        rest = [x for x in range(64) if x not in own]
        for s, value in enumerate(_bands(rest, fp, 4)):
            left = sum(1 << x for i, x in enumerate(rest) if i // 12 != s)
            keys.append((left - (left >> 63 << 64), F.lit((b * 4 + s) << 28).cast("long").bitwiseOR(F.shiftleft(_bands(own, fp, 1)[0], 12)).bitwiseOR(value)))
    return keys


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row under four new keys: its key and one of four bands of the bits that its mask leaves; a mask of under eight
    bits becomes zero, which says that the key is cut no further."""
    for batch in batches:
        for mask, rows in batch.groupby("mask"):
            bits = [b for b in range(64) if int(mask) >> b & 1]
            if len(bits) < 8:
                yield rows.assign(mask=0)
                continue
            fp, key, step = rows["fp"].to_numpy().view(np.uint64), rows["key"].to_numpy().view(np.uint64), -(-len(bits) // 4)
            for k in range(4):
                own = bits[k * step : (k + 1) * step]
                value = sum(((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(own))
                new = (key * _MIX[0, 0] ^ (value + np.uint64(k << 32)) * _MIX[0, 1]) * _MIX[0, 2]
                left = int(mask) & ~sum(1 << b for b in own) & ((1 << 64) - 1)
                yield rows.assign(key=(new ^ (new >> np.uint64(31))).view(np.int64), mask=left - (left >> 63 << 64))


def _exact_keys(nodes: DataFrame, hot: int) -> DataFrame:
    """(key, node, fp) for a radius of 3; hot keys are cut by four bands of their remaining bits until none is hot."""
    keys = F.array(*[F.struct(F.lit(mask).cast("long").alias("mask"), key.alias("key")) for mask, key in candidate_keys()])
    keyed, done = nodes.select("node", "fp", F.explode(keys).alias("k")).select("k.key", "k.mask", "node", "fp"), []
    while True:
        big = written(keyed.where("mask <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"))
        if not big.limit(1).count():
            break
        done.append(keyed.join(F.broadcast(big), "key", "left_anti"))
        keyed = written(keyed.join(F.broadcast(big), "key").mapInPandas(_cut, keyed.schema))
    for part in done:
        keyed = keyed.unionByName(part)
    return keyed.select("key", "node", "fp")


def _block_keys(nodes: DataFrame, hot: int) -> DataFrame:
    """(key, node, fp) from keys of minimum hashes. A hot key's rows are dealt over parts of about half of `hot` rows, and
    each two parts get a key of their own: every pair of the block shares one, at parts - 1 copies of a row."""
    keyed = nodes.select("node", "fp", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    counts = written(counts.select("key", F.ceil(2 * F.col("n") / hot).cast("int").alias("parts")))
    if not counts.limit(1).count():
        return keyed.select("key", "node", "fp")
    cold = keyed.join(F.broadcast(counts.select("key")), "key", "left_anti")
    large = keyed.join(F.broadcast(counts), "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: other != F.col("part"))
    large = large.withColumn("other", F.explode(others))
    met = large.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "node", "fp")
    return cold.select("key", "node", "fp").unionByName(met)


def links(nodes: DataFrame, radius: int = RADIUS, hot: int | None = None) -> DataFrame:
    """Links (a, b) that connect every component. nodes: (node, fp), fp distinct; with keys where fp is wide. Written.

    The list of hot keys is broadcast: each holds over `hot` rows, so it has at most one row in `hot` of the input's."""
    hot = HOT if hot is None else hot
    keyed = _block_keys(nodes, hot) if "keys" in nodes.columns else _exact_keys(nodes, hot)
    with wide_batches(nodes.sparkSession, CHUNK if "keys" not in nodes.columns else CHUNK // WIDE):
        return written(keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_link_batches(radius), "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches. Nodes without an edge are absent."""
    path, step = work_dir(edges.sparkSession), 0
    # As (child, parent) with parent < child.
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/{step}")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        step += 1
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(spread_join(both, low, "u", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{path}/{step}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", "inner").select("v", "u", "m").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, f"{path}/{step}")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id). Links at RADIUS bits of 64, or, where similarity is given, at that similarity."""
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    named = F.col(f"`{id_col}`").alias("doc_id")
    if similarity is None:
        rows = written(docs.select(named, fingerprints(text, shingle).alias("fp")))
        nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("node", F.col("fp"))
        radius = RADIUS
    else:
        rows = written(docs.select(named, wide_fingerprints(text, shingle).alias("s")).select("doc_id", "s.fp", "s.keys"))
        # Texts of one fingerprint and one set of keys are one node; its number is written, so that it stays.
        nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))
        radius = radius_of(similarity)
    stars = components(links(nodes.drop("rep"), radius))
    joined = nodes.drop("keys").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = written(joined.select("fp", "rep", "root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    labelled = spread_join(joined, least, "root", "inner").select("fp", "component_id")
    return spread_join(rows.select("doc_id", "fp"), labelled, "fp", "inner").select("doc_id", "fp", "component_id")
