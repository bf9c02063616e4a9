"""Token counts by separator scan.

``write_token_files`` tokenises texts with a public byte-level BPE vocabulary and writes flat, unindexed files of
big-endian 16-bit ids, each document ended by the end-of-document id. The files are written by Spark's own text writer,
whose line separator is that id: U+07FF is the two bytes DF BF in UTF-8, id 57279, above the vocabulary's 50,257 ids. So
executors need no shared local folder, and a lost task is written again by the committer. One pass over the documents
gives both the tokens and the order of their ids, and one write keeps both, so they can't differ.

``count_tokens`` reads files back in blocks, finds separators in each block with one vectorised comparison, and stitches
documents over block boundaries: a running maximum of the last separator's position (the prefix scan) gives the place
where each block's first document began, a running count its number.

A file is closed after ``max_docs_per_file`` documents or ``max_file_bytes`` bytes, so a reader holds that much, or one
document if that is longer (at most 2 GB, as any value of a row).

Defined cases: a null text is empty; empty texts have no tokens; a text may be longer than any block; repeated rows and
null ids keep their own places; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, work_dir

EOD_CHAR = "߿"
EOD = int.from_bytes(EOD_CHAR.encode(), "big")
#: Pre-tokenisation of the byte-level vocabulary (fixed values).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS, CACHE = 1 << 16, 400_000
_ENCODERS: dict[str, tuple] = {}


def encoder(vocabulary: bytes):
    """(encode a text to big-endian ids, the same without a cache), kept by a worker. vocabulary: the file's bytes."""
    key = hashlib.sha1(vocabulary).hexdigest()
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        if len(ranks) > EOD:
            raise ValueError("ids above the end-of-document id")
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        cache: dict[str, bytes] = {}

        def encode(text: str) -> bytes:
            return np.array(own.encode_ordinary(text), ">u2").tobytes()

        def cached(text: str) -> bytes:
            # The pattern never joins characters over a single space that a non-space follows, so such pieces stand alone.
            first, *rest = text.split(" ")
            if "" in rest:
                return encode(text)
            parts = [encode(first)]
            if len(cache) > CACHE:
                cache.clear()
            for piece in rest:
                got = cache.get(piece)
                if got is None:
                    got = encode(" " + piece)
                    if len(piece) <= 64:
                        cache[piece] = got
                parts.append(got)
            return b"".join(parts)

        _ENCODERS[key] = (cached, encode)
    return _ENCODERS[key]


def _rows(vocabulary, max_docs: int, max_bytes: int):
    """For each document a row of its tokens and a row of its place and id; file numbers count up within a task."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(vocabulary.value)[0]
        base, file, docs, size = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            kinds, files, ordinals, values = [], [], [], []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if docs >= max_docs or size >= max_bytes:
                    file, docs, size = file + 1, 0, 0
                tokens = b"" if text is None else encode(text)
                kinds += ["tokens", "order"]
                files += [base + file] * 2
                ordinals += [docs] * 2
                values += [tokens, f"{docs}:{'' if doc is None else '=' + doc.encode().hex()}".encode()]
                docs, size = docs + 1, size + len(tokens) + 2
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(files, pa.int64()), pa.array(ordinals, pa.int64()), pa.array(values, pa.binary())], ["kind", "shard", "ordinal", "value"])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", max_docs_per_file: int = 4096, max_file_bytes: int = 32 << 20) -> None:
    """path/tokens/kind=tokens/shard=S/part-*: flat files; path/tokens/kind=order/shard=S/part-*: the ids of their
    documents. vocabulary: a file of the driver's, which goes to the workers as a broadcast."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.mapInArrow(_rows(shared, max_docs_per_file, max_file_bytes), "kind string, shard long, ordinal long, value binary")
    # Sorted here, so the writer's own sort by file, which could mix equal keys, is not needed.
    rows.sortWithinPartitions("kind", "shard", "ordinal").select("kind", "shard", F.col("value").cast("string").alias("value")).write.mode("overwrite").partitionBy("kind", "shard").option("lineSep", EOD_CHAR).text(f"{path}/tokens")


def summarise(path_key, content: bytes, block_tokens: int = BLOCK_TOKENS) -> list[tuple]:
    """A row per block: its number, its size, and the positions of its separators."""
    tokens = np.frombuffer(content, ">u2")
    rows = []
    for n, at in enumerate(range(0, len(tokens), block_tokens)):
        block = tokens[at : at + block_tokens]
        rows.append((path_key, n, at, np.flatnonzero(block == EOD).astype(np.int32)))
    return rows


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            yield pd.DataFrame(summarise(path, content), columns=["path", "block", "offset", "separators"])


def count_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ordinal, n_tokens) of every document in the flat files below path."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(f"{path}/tokens/kind=tokens").select("path", "content")
    blocks = files.mapInPandas(_blocks, "path string, block int, offset long, separators array<int>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("separators") > 0, F.col("offset") + F.element_at("separators", -1))
    stitched = blocks.withColumns({"open": F.coalesce(F.max(last).over(before) + 1, F.lit(0)), "done": F.coalesce(F.sum(F.size("separators")).over(before), F.lit(0))})
    one = F.posexplode("separators").alias("i", "at")
    docs = stitched.where(F.size("separators") > 0).select("path", "offset", "open", "done", "separators", one)
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("offset") + F.get("separators", F.col("i") - 1) + 1)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    return docs.select(shard.alias("shard"), (F.col("done") + F.col("i")).cast("long").alias("ordinal"), (F.col("offset") + F.col("at") - start).alias("n_tokens"))


def read_order(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(shard, ordinal, doc_id): which document stands where."""
    lines = spark.read.schema("value string, shard long").option("lineSep", EOD_CHAR).text(f"{path}/tokens/kind=order")
    doc = F.substring_index("value", "=", -1)
    return lines.select("shard", F.substring_index("value", ":", 1).cast("long").alias("ordinal"), F.when(F.col("value").contains("="), F.decode(F.unhex(doc), "UTF-8")).cast(id_type).alias("doc_id"))


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, n_tokens) of all documents, through flat files. Fails if a document is missing from them."""
    spark = docs.sparkSession
    path = path or work_dir(spark)
    if docs.limit(1).count() == 0:
        return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"))
    write_token_files(docs, path, id_col=id_col, **options)
    order = read_order(spark, path, docs.schema[id_col].dataType.simpleString())
    joined = order.join(count_tokens(spark, path), ["shard", "ordinal"], "full")
    return joined.select("doc_id", F.coalesce("n_tokens", F.raise_error(F.lit("a document is missing from the token files")).cast("long")).alias("n_tokens"))
