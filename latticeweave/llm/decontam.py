"""Benchmark decontamination with one Aho-Corasick automaton over the normalised items.

Text is lower-cased (A-Z) and cut into words of ASCII letters and digits and all characters above \\x7F. Windows of ten
item words (the whole item, where it has fewer) are the automaton's patterns; each text is scanned once, and hits map
back to code-point spans of the original text.

Up to ``max_shard_chars`` characters of items make one automaton, which a worker builds once. A larger benchmark is cut
into shards of that size, collected one at a time and shipped as compressed item texts; a worker then holds one automaton
at a time and scans ``PASS_BYTES`` of documents with each of them, so that building them is paid once for that many bytes.

Defined cases: null texts and items have no words; an item without words has no window; rows with a null item id count
as hits and under an empty id; repeated items count once by id; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

WINDOW, MAX_SHARD_CHARS, PASS_BYTES = 10, 8 << 20, 64 << 20
#: ASCII letters and digits stay (upper case folded), other ASCII becomes a space, bytes above \x7F stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_ORIGINAL = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_KEPT: dict[str, ahocorasick.Automaton] = {}
RESULT = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_TABLE).split()


def item_windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Pattern -> (number of words, ids of the items that have it)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            found.setdefault(b" ".join([b"", *part, b""]).decode(), (len(part), set()))[1].add(item)
    return {k: (n, tuple(ids)) for k, (n, ids) in found.items()}


def _automaton(windows: dict[str, tuple[int, tuple[str, ...]]]):
    made = ahocorasick.Automaton()
    for pattern, what in windows.items():
        made.add_word(pattern, what)
    if windows:
        made.make_automaton()
    return made


def _packed(rows: list[tuple[str, str | None]]) -> bytes:
    return zlib.compress(json.dumps(rows).encode())


def _kept_automaton(packed: bytes, window: int, keep: bool):
    """Made once by each worker where there is one shard only."""
    key = f"{window}:{hashlib.sha1(packed).hexdigest()}"
    if key in _KEPT:
        return _KEPT[key]
    _KEPT.clear()
    made = _automaton(item_windows([tuple(r) for r in json.loads(zlib.decompress(packed))], window))
    if keep:
        _KEPT[key] = made
    return made


def scan(words: list[bytes], automaton) -> tuple[np.ndarray, set[str]]:
    """Marks of the words inside any occurrence, and the ids of the items with occurrences."""
    hit, ids = np.zeros(len(words) + 1, np.int32), set()
    if not words or not len(automaton):
        return hit[:-1] > 0, ids
    ends = None
    text = b" ".join([b"", *words, b""]).decode()
    for end, (n, items) in automaton.iter(text):
        if ends is None:  # position of the space behind each word
            ends = np.cumsum([len(w.decode()) + 1 for w in words])
        last = int(np.searchsorted(ends, end))
        hit[last - n + 1] += 1
        hit[last + 1] -= 1
        ids.update(items)
    return np.cumsum(hit[:-1]) > 0, ids


def spans_of(text: str, marks: np.ndarray) -> list[dict]:
    """Code-point spans in the original text of each run of marked words."""
    if not marks.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    at = [m.span() for m in _ORIGINAL.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def hit_columns(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_shard_chars: int = MAX_SHARD_CHARS):
    """A function of a text column: struct RESULT. The benchmark is read here, shard by shard."""
    spark = benchmark.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // max_shard_chars))
    shards = []
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).distinct().collect()
        shards.append(spark.sparkContext.broadcast(_packed(sorted((r.item, r.text or "") for r in rows))))

    def judged(texts: list[str | None]) -> pd.DataFrame:
        words = [words_of(t) for t in texts]
        found = [(np.zeros(len(w), bool), set()) for w in words]
        for shard in shards:
            automaton = _kept_automaton(shard.value, window, len(shards) == 1)
            for i, w in enumerate(words):
                marks, ids = scan(w, automaton)
                found[i] = (found[i][0] | marks, found[i][1] | ids)
        return pd.DataFrame({
            "n_words": [len(w) for w in words],
            "n_hit": [int(m.sum()) for m, _ in found],
            "n_items": [len(ids) for _, ids in found],
            "items": [sorted(ids) for _, ids in found],
            "spans": [spans_of(t, m) if ids else [] for t, (m, ids) in zip(texts, found, strict=True)],
        })

    @F.pandas_udf(RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if len(shards) == 1:
            for texts in batches:
                yield judged(texts.tolist())
            return
        # Several batches in one pass over the shards; each batch's rows still leave as one frame.
        held, size = [], 0
        for texts in batches:
            held.append(texts.tolist())
            size += sum(len(t) for t in held[-1] if t)
            if size >= PASS_BYTES:
                yield from _cut_up(judged([t for part in held for t in part]), held)
                held, size = [], 0
        if held:
            yield from _cut_up(judged([t for part in held for t in part]), held)

    return scanned


def _cut_up(frame: pd.DataFrame, parts: list[list]) -> Iterator[pd.DataFrame]:
    at = 0
    for part in parts:
        yield frame.iloc[at : at + len(part)].reset_index(drop=True)
        at += len(part)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """(doc, hits): doc is a struct of all the input's columns, hits as RESULT."""
    scanned = hit_columns(benchmark, **options)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), scanned(F.col(f"`{text_col}`").cast("string")).alias("hits"))
