"""Quality rules: counts of words, symbols, repeated lines and repeated windows, and n-gram perplexity bands.

The model is an interpolated modified Kneser-Ney model of order 4 over characters, of each language (null is one of its
own). Letters and all characters beyond ASCII stay what they are; ASCII capitals, digits, symbols and kinds of punctuation
share a symbol each. Spark counts the n-grams of all texts, the distinct predecessors that lower orders need, the totals of contexts and
the counts of counts; its tables grow with the corpus and stay distributed. No n-gram is left out: joins over the orders give
each 4-gram that occurs its cost, in whole units of 1/UNIT bit, so that sums are the same in any order. Where there are
more than HELD_GRAMS of them, the costs of those that make up more than one in HELD_GRAMS of all characters (so they are
fewer) are broadcast, sorted by code, and texts look them up by binary search; of the others each text gives its counts,
which meet their costs in a join on the 4-gram, and each distinct text the sum. Of 4-grams this rare none is a hot key.

`train` collects a model that can score texts of elsewhere, whole or of the more frequent n-grams only; verdicts don't use it.

Each language gets a band of bits a character: the median of its texts plus and minus
a number of scaled median absolute deviations, from exact percentiles over bins of 0.001 bit. The numbers below and above
are each language's own, fitted on labelled texts (README); languages without labels share one pair. The mean over a short
text scatters more: under SHORT characters a band widens as the root of SHORT over the text's characters.

Defined cases: a null text has no words and fails; empty texts likewise; texts with under ten words don't count for
bands; a band reaches at least FLOOR bits to each side, and FEW_FLOOR in a language of under FEW texts, whose spread
can't be told; characters above U+FFFF share the symbol of their hash with one below; long texts are cut into blocks that
keep the characters before; equal rows get equal results; an empty table gives no rows and no model.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import HOT_ROWS, HOT_SHARE, bounded_batches, spread_join, written

#: A symbol has 16 bits, so that four fill a long.
ORDER, BITS = 4, 16
#: 4-grams whose costs are broadcast, and units of a bit in which costs are counted.
HELD_GRAMS, UNIT = 1 << 20, 1 << 24
#: Characters of a block of texts, and distinct n-grams that a counting task holds.
BLOCK, HELD = 1 << 20, 1 << 21
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: Deviations below and above the median that a text may be off.
WIDTHS = {"de": (2.5, 8.0), "en": (4.75, 4.75), "es": (2.5, 8.0), "fr": (3.5, 8.0)}
OTHER_WIDTHS = (4.0, 4.0)
#: Characters under which a text's band widens.
SHORT = 400
#: Bits a character. The floor is below every fitted width, so that it doesn't stand in for one.
FLOOR, FEW, FEW_FLOOR = 0.05, 30, 0.25
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: cost: of the 4-grams that are broadcast; rare: the text's digest if it has others.
COST = "cost long, rare binary"

Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[Block]:
    """(4-gram codes, one for each character; texts' numbers; characters of each in the block)."""
    held, at, lengths, chars = [], [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text), size):
            own = text[start : start + size]
            held.append(text[max(0, start - ORDER + 1) : start].rjust(ORDER - 1, "\0") + own)
            at.append(i)
            lengths.append(len(own))
            chars += len(own)
            if chars >= size:
                yield _codes(held), np.array(at), np.array(lengths)
                held, at, lengths, chars = [], [], [], 0
    if held:
        yield _codes(held), np.array(at), np.array(lengths)


def _folded() -> np.ndarray:
    """Symbols of ASCII: lower-case letters stay, other classes share their first character."""
    table = np.arange(128, dtype=np.uint16)
    for group in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,", "!?", "'\";:-", "([{)]}", "#$%&*+/<=>@\\^_`~"):
        table[[ord(c) for c in group]] = ord(group[0])
    return table


FOLDED = _folded()


def _codes(held: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.where(points < 128, FOLDED[points & 127], (points ^ (points >> 16) * 40503) & 0xFFFF).astype(np.uint64)
    code = symbols[: 1 - ORDER].copy()
    for i in range(1, ORDER):
        code <<= np.uint64(BITS)
        code |= symbols[i : len(symbols) - ORDER + 1 + i]
    own = np.ones(len(code), bool)
    for end in np.cumsum([len(t) for t in held])[:-1]:
        own[end - ORDER + 1 : end] = False  # windows that begin in one text and end in the next
    return code[own]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            for codes, _, _ in blocks(["" if t is None else t for t in rows["text"]]):
                new = np.unique(codes, return_counts=True)
                total[lang] = _merged(total[lang], new) if lang in total else new
        if sum(len(code) for code, _ in total.values()) > HELD:
            yield _rows(total)
            total = {}
    if total:
        yield _rows(total)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(n, first)


def _rows(total: dict[int, tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"lang": lang, "code": code.view(np.int64), "n": n}) for lang, (code, n) in total.items()])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(lang: np.ndarray, code: np.ndarray) -> np.ndarray:
    """64-bit hashes of language and code; each order has arrays of its own."""
    return _mix(code.view(np.uint64) ^ _mix(lang.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _found(store: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: float) -> np.ndarray:
    keys, values = store
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2, 3 and more, a row for each row of how many n-grams have counts 1, 2, 3 and 4."""
    n = np.maximum(n, 1).astype(float)
    y = n[:, 0] / (n[:, 0] + 2 * n[:, 1])
    return np.stack([np.clip(i + 1 - (i + 2) * y * n[:, i + 1] / n[:, i], 0.05, i + 0.95) for i in range(3)], axis=1)


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[DataFrame]:
    """(lang, code, n, raw) of all n-grams of all texts, a written table for each of the orders 1 to 4. raw: how often it
    occurs; n: likewise, in lower orders the distinct characters that precede it."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(lang_id(lang_col).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInPandas(_count, "lang long, code long, n long")
    found = [written(rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))).select("lang", "code", "n", F.col("n").alias("raw"))]
    for order in range(ORDER - 1, 0, -1):
        code = F.col("code").bitwiseAND(F.lit((1 << BITS * order) - 1))
        found.append(written(found[-1].groupBy("lang", code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw"))))
    return found[::-1]


def costs(tables: list[DataFrame], max_broadcast_langs: int = 10_000) -> DataFrame:
    """(lang, code, raw, cost) of every 4-gram that occurs: the units of its last character after the others. Written."""
    lower = None
    for order, level in enumerate(tables, 1):
        ones = level.groupBy("lang").agg(*[F.greatest(F.sum((F.col("n") == i).cast("long")), F.lit(1)).cast("double").alias(f"n{i}") for i in range(1, 5)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        off = [F.least(F.greatest(i + 1 - (i + 2) * y * F.col(f"n{i + 2}") / F.col(f"n{i + 1}"), F.lit(0.05)), F.lit(i + 0.95)) for i in range(3)]
        off = written(ones.select("lang", *[d.alias(f"d{i}") for i, d in enumerate(off, 1)]))
        few = off.limit(max_broadcast_langs + 1).count() <= max_broadcast_langs
        rows = level.join(F.broadcast(off), "lang") if few else spread_join(level, off, "lang", "inner")
        after = Window.partitionBy("lang", F.shiftrightunsigned("code", BITS))
        kind = F.least("n", F.lit(3))
        discount = F.when(kind == 1, F.col("d1")).when(kind == 2, F.col("d2")).otherwise(F.col("d3"))
        total = F.sum("n").over(after)
        # Whole numbers are summed, so that the order of rows doesn't matter.
        back = sum(F.sum((kind == i).cast("long")).over(after) * F.col(f"d{i}") for i in range(1, 4)) / total
        rows = rows.select("lang", "code", "raw", ((F.col("n") - discount) / total).alias("share"), back.alias("back"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(2.0**-BITS))  # order 0: uniform
        else:
            rows = rows.withColumn("tail", F.col("code").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))).join(lower, ["lang", "tail"])
        p = F.col("share") + F.col("back") * F.col("below")
        lower = rows.select("lang", F.col("code").alias("tail"), p.alias("below"))
    return written(rows.select("lang", "code", "raw", F.round(-F.log2(p) * UNIT).cast("long").alias("cost")))


def held(table: DataFrame) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], DataFrame | None]:
    """Of each language the codes, sorted, and costs that are broadcast; and the table of the others, if there are any."""
    rest = None
    if table.count() > HELD_GRAMS:
        least = table.agg(F.sum("raw")).first()[0] / HELD_GRAMS
        rest, table = table.where(F.col("raw") <= least), table.where(F.col("raw") > least)
    rows, store = table.select("lang", "code", "cost").toPandas(), {}
    for lang, own in rows.groupby("lang"):
        store[int(lang)] = _sorted(own["code"].to_numpy(np.int64).view(np.uint64), own["cost"].to_numpy(np.int64))
    return store, rest


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share_bits: int | None = None) -> list[dict]:
    """The model of all texts: for orders 1 to 4, grams (hashes, shares) and contexts (hashes, back-off weights). With
    share_bits a smaller model: n-grams of at most 2**-share_bits of all characters are left to the back-off."""
    tables, model = levels(docs, text_col, lang_col), []
    least = (tables[0].agg(F.sum("raw")).first()[0] or 0) / 2**share_bits if share_bits is not None else 0
    for level in tables:
        stored = F.max("raw") > least
        ones = level.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)], stored.alias("stored")).where("stored").toPandas()
        grams = level.where(F.col("raw") > least).select("lang", "code", "n").toPandas()
        heads = level.groupBy("lang", F.shiftrightunsigned("code", BITS).alias("context")).agg(F.sum("n").alias("total"), stored.alias("stored")).where("stored").toPandas()
        model.append(_store(ones, grams, heads))
    return model


def _store(ones: pd.DataFrame, grams: pd.DataFrame, heads: pd.DataFrame) -> dict:
    if not len(grams):
        none = (np.zeros(0, np.uint64), np.zeros(0))
        return {"grams": none, "contexts": none}
    lang, code, n = (grams[c].to_numpy(np.int64) for c in ("lang", "code", "n"))
    by_lang = dict(zip(ones["lang"], discounts(ones[["n1", "n2", "n3", "n4"]].to_numpy()), strict=True))
    langs, which = np.unique(lang, return_inverse=True)
    discount = np.stack([by_lang[x] for x in langs])[which, np.minimum(n, 3) - 1]
    context = (code.view(np.uint64) >> np.uint64(BITS)).view(np.int64)
    keys, totals = _sorted(hashed(heads["lang"].to_numpy(np.int64), heads["context"].to_numpy(np.int64)), heads["total"].to_numpy(float))
    at = np.searchsorted(keys, hashed(lang, context))
    share = (n - discount) / totals[at]
    back = np.maximum(1 - np.bincount(at, weights=share, minlength=len(keys)), 1e-12)
    return {"grams": _sorted(hashed(lang, code), share), "contexts": (keys, back)}


def probability(model: list[dict], lang: int, codes: np.ndarray) -> np.ndarray:
    """Of each 4-gram's last character after the others."""
    lang = np.array([lang], np.int64)
    p = np.full(len(codes), 2.0**-BITS)  # order 0: uniform
    for order, part in enumerate(model, 1):
        code = codes & np.uint64((1 << BITS * order) - 1)
        p = p * _found(part["contexts"], hashed(lang, code >> np.uint64(BITS)), 1.0) + _found(part["grams"], hashed(lang, code), 0.0)
    return p


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(SPACES))
        else:
            seen.add(line)
    repeat, n = 0, REPEAT_WINDOW
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) < len(windows):
        counts, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeat += i + n - max(i, until)
                until = i + n
    return len(words), chars, symbols, dup, repeat


def bits_per_char(texts: list[str], lang: int, model: list[dict]) -> np.ndarray:
    bits, lengths = np.zeros(len(texts)), np.array([max(1, len(t)) for t in texts])
    for codes, at, own in blocks(texts):
        distinct, which = np.unique(codes, return_inverse=True)
        sums = np.concatenate(([0.0], np.cumsum(-np.log2(probability(model, lang, distinct))[which])))
        ends = np.cumsum(own)
        np.add.at(bits, at, sums[ends] - sums[ends - own])
    return bits / lengths


def text_costs(texts: list[str], lang: int, store: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pd.DataFrame]:
    """Each text's cost of the 4-grams in the store, and how often it has which others: (text, code, n)."""
    keys, own_costs = store.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    total, others = np.zeros(len(texts), np.int64), []
    for codes, at, own in blocks(texts):
        distinct, which = np.unique(codes, return_inverse=True)
        place = np.searchsorted(keys, distinct)
        place[place == len(keys)] = 0
        known = keys[place] == distinct if len(keys) else np.zeros(len(distinct), bool)
        cost = np.zeros(len(distinct), np.int64)
        cost[known] = own_costs[place[known]]
        sums, ends = np.concatenate(([0], np.cumsum(cost[which]))), np.cumsum(own)
        np.add.at(total, at, sums[ends] - sums[ends - own])
        if not known.all():
            left = ~known[which]
            others.append(pd.DataFrame({"text": np.repeat(at, own)[left], "code": codes[left].view(np.int64)}))
    found = pd.concat(others) if others else pd.DataFrame({"text": np.zeros(0, int), "code": np.zeros(0, np.int64)})
    return total, found.groupby(["text", "code"]).size().reset_index(name="n")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _costs(langs: pd.Series, texts: list[str], store) -> Iterator[tuple[int, np.ndarray, np.ndarray, pd.DataFrame]]:
    """(language, rows, costs, others) of each language of a batch."""
    langs = langs.to_numpy(np.int64)
    for lang in np.unique(langs):
        rows = np.flatnonzero(langs == lang)
        yield int(lang), rows, *text_costs([texts[i] for i in rows], int(lang), store)


def rare_costs(docs: DataFrame, shared, rest: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, rare, more, copies) of each distinct text with 4-grams that are not broadcast: their cost, and its rows. Written."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            for lang, rows, _, others in _costs(batch["lang"], texts, shared.value):
                names = {i: _digest(texts[rows[i]]) for i in others["text"].unique()}
                yield pd.DataFrame({"lang": lang, "rare": others["text"].map(names).astype(object), "code": others["code"], "n": others["n"]})

    rows = docs.select(lang_id(lang_col).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInPandas(counted, "lang long, rare binary, code long, n long")
    rows = rows.groupBy("lang", "rare", "code").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    rows = rows.join(rest.select("lang", "code", "cost"), ["lang", "code"])
    return written(rows.groupBy("lang", "rare").agg(F.sum(F.col("n") * F.col("cost")).alias("more"), F.max("copies").alias("copies")))


def with_rare(rows: DataFrame, more: DataFrame | None, hot: int) -> DataFrame:
    """rows (lang, s.cost, s.rare, ...) with the whole cost. Texts of more than `hot` rows get theirs by broadcast; a row that
    needs none has a key of its own, so no key is hot."""
    if more is None:
        return rows.withColumn("cost", F.col("s.cost"))
    often = F.broadcast(more.where(F.col("copies") > hot).select("lang", "rare", F.col("more").alias("often")))
    seldom = more.where(F.col("copies") <= hot).select("lang", F.col("rare").alias("at"), F.col("more").alias("seldom"))
    rows = rows.withColumn("rare", F.col("s.rare")).join(often, ["lang", "rare"], "left")
    alone = F.format_string("%020d", F.monotonically_increasing_id()).cast("binary")
    rows = rows.withColumn("at", F.when(F.col("rare").isNull() | F.col("often").isNotNull(), alone).otherwise(F.col("rare"))).join(seldom, ["lang", "at"], "left")
    return rows.withColumn("cost", F.col("s.cost") + F.coalesce("often", "seldom", F.lit(0))).drop("at", "rare", "often", "seldom")


def stats_udf(shared, base: bool = True):
    """A function of a language's id and a text: struct of COUNTS and COST, or of COST and whether words are enough."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + f", {COST}" if base else f"enough boolean, {COST}")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for langs, series in batches:
            texts = ["" if t is None else t for t in series]
            if base:
                found = pd.DataFrame([text_stats(t) for t in texts], columns=COUNTS)
            else:
                found = pd.DataFrame({"enough": [len(t.encode("utf-8", "replace").split(None, MIN_WORDS)) >= MIN_WORDS for t in texts]})
            cost, rare = np.zeros(len(texts), np.int64), np.full(len(texts), None, object)
            for _, rows, own, others in _costs(langs, texts, shared.value):
                cost[rows] = own
                for i in rows[others["text"].unique()]:
                    rare[i] = _digest(texts[i])
            yield found.assign(cost=cost, rare=rare)

    return scored


def bits_of(chars):
    return F.round(F.col("cost") / (F.greatest(chars, F.lit(1)) * F.lit(float(UNIT))), 6)


def bands(scores: DataFrame, widths: dict[str, tuple[float, float]] = WIDTHS, other: tuple[float, float] = OTHER_WIDTHS, floor: float = FLOOR) -> DataFrame:
    """(language key, mid, below, above), a row per language: the band is [mid - below, mid + above]. scores: (lang_key, bits)
    of the texts that count."""
    bins = scores.groupBy("lang_key", F.round("bits", 3).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("lang_key", "bin", "n")
    middle = bins.groupBy("lang_key").agg(F.expr("percentile(bin, 0.5, n)").alias("mid"))
    spread = bins.join(middle, "lang_key").groupBy("lang_key", "mid").agg(F.expr("percentile(abs(bin - mid), 0.5, n)").alias("mad"), F.sum("n").alias("texts"))
    least = F.when(F.col("texts") < FEW, F.greatest(F.lit(FEW_FLOOR), F.lit(floor))).otherwise(F.lit(floor))

    def side(at: int):
        width = F.lit(other[at])
        for lang, own in widths.items():
            width = F.when(F.col("lang_key") == f"+{lang}", F.lit(own[at])).otherwise(width)
        return F.greatest(F.col("mad") * 1.4826 * width, least)

    return spread.select("lang_key", "mid", side(0).alias("below"), side(1).alias("above"))


def _lang(lang_col: str):
    return F.coalesce(F.concat(F.lit("+"), F.col(f"`{lang_col}`").cast("string")), F.lit(""))


def lang_id(lang_col: str):
    return F.xxhash64(_lang(lang_col))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_broadcast_langs: int = 10_000, short: int = SHORT, **widths) -> DataFrame:
    """(doc, stats, base_failed, kept): doc is a struct of all the input's columns. Three scans, no text is shuffled
    while there are at most max_broadcast_langs languages and HELD_GRAMS distinct 4-grams; beyond the languages, the bands
    join by shuffle, beyond the 4-grams a fourth scan counts the rare ones and their costs join by shuffle."""
    store, rest = held(costs(levels(docs, text_col, lang_col), max_broadcast_langs))
    shared = docs.sparkSession.sparkContext.broadcast(store)
    more = None if rest is None else rare_costs(docs, shared, rest, text_col, lang_col)
    hot = 0 if more is None else max(HOT_ROWS, docs.count() // HOT_SHARE)
    text, lang = F.col(f"`{text_col}`").cast("string"), lang_id(lang_col)
    named = [_lang(lang_col).alias("lang_key"), F.char_length(text).alias("chars"), lang.alias("lang")]
    scores = written(docs.select(*named, stats_udf(shared, base=False)(lang, text).alias("s")))
    limits = written(bands(with_rare(scores, more, hot).where("s.enough").select("lang_key", bits_of(F.col("chars")).alias("bits")), **widths))
    own = [F.col(f"`{c}`").alias(f"doc_{i}") for i, c in enumerate(docs.columns)]
    rows = with_rare(docs.select(*own, *named, stats_udf(shared)(lang, text).alias("s")), more, hot)
    rows = rows.withColumn("stats", F.struct(*[F.col(f"s.{c}") for c in COUNTS], bits_of(F.col("chars")).alias("bits")))
    if limits.limit(max_broadcast_langs + 1).count() <= max_broadcast_langs:
        limits = F.broadcast(limits)
    failed = (F.col("stats.n_words") < MIN_WORDS) | (100 * F.col("stats.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("stats.n_words"))
    rows = rows.join(limits, "lang_key", "left").withColumn("base_failed", failed)
    wider = F.sqrt(F.greatest(F.lit(1.0), short / F.greatest(F.col("chars"), F.lit(1))))
    off = (F.col("stats.bits") - F.col("mid")) / wider
    inside = F.coalesce(off.between(-F.col("below"), F.col("above")), F.lit(True))
    doc = F.struct(*[F.col(f"doc_{i}").alias(c) for i, c in enumerate(docs.columns)])
    return rows.select(doc.alias("doc"), "stats", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
