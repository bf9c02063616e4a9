"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion.

Tokens are the words of a text, A-Z lower-cased, and one end. A token's bucket is its crc32 modulo ``BUCKETS``; hidden
states emit buckets, and a bucket emits its tokens by absolute discounting, with a slot for tokens never seen:

    P(text) = [sum over state paths of products of A and E(bucket)] * product of P(token | bucket)

so the states' tables have a fixed size, and the part that grows with the vocabulary is a sum over tokens. The
likelihood is exact: a text is cut into segments, each segment's matrix product is taken, and products are chained,
scaled as they go. Training is exact in the same way: messages reach each segment through the products of the segments
before and behind it. All training texts count whole, and each task's expected counts are added up by Spark.

Token counts are exact for every token. The most frequent ``hot_tokens`` are broadcast (a stated bound); all others
meet their counts in a join on the token, so nothing that grows with the vocabulary reaches the driver or a worker.

Defined cases: null texts are empty (one end token); a null id counts as an empty text for the fold; repeated rows are
scored each; without any training text the scores use the uniform slot of each bucket; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, bounded_batches, bucket_of, work_dir, written

BUCKETS, STATES, ROUNDS, WINDOW, SEGMENT = 16384, 5, 3, 64, 64
HOT_TOKENS, PRIOR, SEED = 100_000, 2000.0, 11
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    return [*ascii_lower(text).split(), END]


def buckets_of(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, tokens), np.uint32, len(tokens)) & np.uint32(BUCKETS - 1)


def _bucket_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's buckets as little-endian 16-bit integers."""
    for batch in batches:
        yield pd.DataFrame({"buckets": [buckets_of(tokens_of(t)).astype("<u2").tobytes() for t in batch["text"]]})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    out = lambda: pd.DataFrame({"token": list(counts), "c": np.fromiter(counts.values(), np.int64, len(counts))})
    for batch in batches:
        for text in batch["text"]:
            counts.update(tokens_of(text))
        if len(counts) > 400_000:
            yield out()
            counts.clear()
    if counts:
        yield out()


def start_model(share: np.ndarray, states: int = STATES, seed: int = SEED) -> dict[str, np.ndarray]:
    """Sticky states whose emissions are the corpus shares, tilted at random."""
    rng = np.random.default_rng(seed)
    tilt = np.exp(rng.normal(0, 0.5, (states, len(share)))) * share
    stay = np.full((states, states), 0.001 / max(1, states - 1))
    np.fill_diagonal(stay, 0.999 if states > 1 else 1.0)
    return {"start": np.full(states, 1 / states), "move": stay, "emit": tilt / tilt.sum(axis=1, keepdims=True)}


def _windows(buckets: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into rows of `width`: ids, which of them are real, and the row count of each text."""
    rows = np.array([-(-len(b) // width) for b in buckets], np.int64)
    ids = np.zeros((int(rows.sum()), width), np.int64)
    real = np.zeros(ids.shape, bool)
    lengths = np.array([len(b) for b in buckets], np.int64)
    at = np.repeat((np.cumsum(rows) - rows) * width - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    ids.ravel()[at] = np.concatenate(buckets) if buckets else 0
    real.ravel()[at] = True
    return ids, real, rows


def _products(by_bucket: np.ndarray, move: np.ndarray, ids: np.ndarray, real: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ids the scaled matrix product of its steps (a text's first token has no move before it), and the
    logarithms of the scales."""
    k, width = len(move), ids.shape[1]
    product = np.broadcast_to(np.eye(k, dtype=move.dtype), (len(ids), k, k)).copy()
    logs = np.zeros(len(ids))
    for t in range(width):
        live = real[:, t]
        if not live.any():
            break
        moved = (product.reshape(-1, k) @ move).reshape(-1, k, k)
        if t == 0:
            moved[opening] = product[opening]
        moved *= by_bucket[ids[:, t]][:, None, :]
        product = moved if live.all() else np.where(live[:, None, None], moved, product)
        if t % 8 == 7 or t == width - 1:
            peak = product.max(axis=(1, 2))
            product /= peak[:, None, None]
            logs += np.log(peak)
    peak = product.max(axis=(1, 2))
    return product / peak[:, None, None], logs + np.log(peak)


def _steps(rows: np.ndarray) -> list[np.ndarray]:
    """For each step, the texts that have so many rows."""
    order = np.argsort(-rows, kind="stable")
    return [order[: int(np.searchsorted(-rows[order], -step, "left"))] for step in range(int(rows.max(initial=0)))]


def expected_counts(model: dict[str, np.ndarray], buckets: list[np.ndarray], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch over whole texts: expected starts, moves and emissions, and the log-likelihood.

    Texts are cut into rows of `width` that are worked on at once: forward and backward messages reach every row through
    the products of the rows before and behind it."""
    single = np.float32  # rows are short and scaled at each step; sums over them are kept in double
    start, move = model["start"].astype(single), model["move"].astype(single)
    k, size = model["emit"].shape
    ids, real, rows = _windows(buckets, width)
    n = len(ids)
    share = model["emit"].mean(axis=0)  # emissions relative to their mean stay near one
    by_bucket = np.ascontiguousarray((model["emit"] / share).T.astype(single))
    first = np.cumsum(rows) - rows
    opening = np.zeros(n, bool)
    opening[first] = True
    before, behind = np.zeros((n, k), single), np.ones((n, k), single)
    before[first] = start
    if n > len(buckets):
        product, _ = _products(by_bucket, move, ids, real, opening)
        steps = _steps(rows)
        for step in range(1, len(steps)):
            at = first[steps[step]] + step
            ahead = np.einsum("nk,nkj->nj", before[at - 1], product[at - 1])
            before[at] = ahead / ahead.sum(axis=1, keepdims=True)
        for step in range(len(steps) - 1, 0, -1):
            at = first[steps[step]] + step
            back = np.einsum("nkj,nj->nk", product[at], behind[at])
            behind[at - 1] = back / back.max(axis=1, keepdims=True)
    seen = np.where(real.T[:, :, None], by_bucket[ids.T], single(1))  # width, n, k
    forward = np.empty((width, n, k), single)
    scale = np.ones((width, n), single)
    entered = np.where(opening[:, None], before, before @ move)
    now = entered * seen[0]
    for t in range(width):
        if t:
            now = np.where(real[:, t, None], (now @ move) * seen[t], now)
        scale[t] = now.sum(axis=1)
        now = now / scale[t][:, None]
        forward[t] = now
    moves = np.zeros((k, k))
    gamma = np.empty((width, n, k), single)
    # Scaled so that a row's forward and backward messages sum to one at every step.
    back = behind / (now * behind).sum(axis=1, keepdims=True)
    for t in range(width - 1, -1, -1):
        gamma[t] = forward[t] * back
        ahead = np.where(real[:, t, None], seen[t] * back / scale[t][:, None], single(0))
        if t:
            moves += move * (forward[t - 1].T @ ahead)
            back = np.where(real[:, t, None], ahead @ move.T, back)
        else:  # the move over a row's edge
            inner = ~opening
            moves += move * (before[inner].T @ ahead[inner])
    flat = ids.T.ravel()
    weight = gamma * real.T[:, :, None]
    emits = np.stack([np.bincount(flat, weight[:, :, s].ravel(), size) for s in range(k)])
    fit = np.log(scale, dtype=np.float64).sum() + np.log(share[ids[real]]).sum()
    return gamma[0][opening].sum(axis=0, dtype=np.float64), moves, emits, float(fit)


def _expect(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        total, held, size = None, [], 0

        def add() -> None:
            nonlocal total, held, size
            got = expected_counts(m, held)
            flat = np.concatenate([got[0], got[1].ravel(), got[2].ravel(), [got[3]]])
            total = flat if total is None else total + flat
            held, size = [], 0

        for batch in batches:
            for raw in batch["buckets"]:
                ids = np.frombuffer(raw, "<u2")
                held.append(ids)
                size += len(ids)
                if size >= 1 << 17:
                    add()
        if held:
            add()
        if total is not None:
            cell = np.flatnonzero(total)
            yield pd.DataFrame({"cell": cell, "value": total[cell]})

    return run


def train(ids: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], list[float]]:
    """ids: (buckets) of the training texts. The driver gets one row per parameter."""
    model, seen = start_model(share, states), []
    spark = ids.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        cells = ids.mapInPandas(_expect(shared), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(states + states * states + states * len(share) + 1)
        flat[cells["cell"].to_numpy(np.int64)] = cells["value"].to_numpy()
        starts, moves, emits = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 : -1].reshape(states, -1)
        emits = emits + PRIOR * share
        model = {"start": (starts + 1) / (starts + 1).sum(), "move": (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), "emit": emits / emits.sum(axis=1, keepdims=True)}
        seen.append(float(flat[-1]))
        shared.unpersist()
    return model, seen


def log_likelihoods(model: dict[str, np.ndarray], buckets: list[np.ndarray], width: int = SEGMENT) -> np.ndarray:
    """Natural log-likelihood of each whole sequence, by the scaled forward recursion over segments' matrix products."""
    out = np.zeros(len(buckets))
    if not buckets:
        return out
    start, move, emit = model["start"], model["move"], model["emit"]
    k = len(start)
    ids, real, rows = _windows(buckets, width)
    first = np.cumsum(rows) - rows
    opening = np.zeros(len(ids), bool)
    opening[first] = True
    product, logs = _products(np.ascontiguousarray(emit.T), move, ids, real, opening)
    # Chain the segments of all texts, step by step.
    now = np.broadcast_to(start, (len(buckets), k)).copy()
    for step, live in enumerate(_steps(rows)):
        at = first[live] + step
        ahead = np.einsum("nk,nkj->nj", now[live], product[at])
        total = ahead.sum(axis=1)
        out[live] += np.log(total) + logs[at]
        now[live] = ahead / total[:, None]
    return out


def _score(model, hot, stats):
    """doc_id, held_out, text -> sums over hot tokens, and the rest with their multiplicities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, known = model.value, hot.value
        lookup, lone = stats.value  # per hot token: log10(c + 1), log10 P(token | bucket); per bucket: log10 of its slot
        for batch in batches:
            n, n_known, base, inner, rest, times, ids = [], [], [], [], [], [], []
            for text in batch["text"]:
                tokens = tokens_of(text)
                own = Counter(tokens)
                b = u = 0.0
                k, r, c = 0, [], []
                for token, f in own.items():
                    i = known.get(token)
                    if i is None:
                        r.append(token)
                        c.append(f)
                        u += f * lone[crc32(token) & (BUCKETS - 1)]
                    else:
                        k += f
                        b += f * lookup[0][i]
                        u += f * lookup[1][i]
                n.append(len(tokens)), n_known.append(k), base.append(b), inner.append(u), rest.append(r), times.append(c)
                ids.append(buckets_of(tokens).astype(np.int64))
            path = np.zeros(len(ids))
            at = 0
            while at < len(ids):  # bounded numbers of tokens at a time
                to, size = at + 1, len(ids[at])
                while to < len(ids) and size + len(ids[to]) <= 1 << 17:
                    size += len(ids[to])
                    to += 1
                path[at:to] = log_likelihoods(m, ids[at:to])
                at = to
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": n, "hot_known": n_known, "hot_base": base, "inner": np.array(inner) + path / math.log(10), "rest": rest, "times": times})

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, hot_tokens: int = HOT_TOKENS, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores in log10."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = work_dir(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(id_col, folds) == held_fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learn = rows.where(~F.col("held_out"))
    counts = written(learn.select("text").mapInPandas(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")).withColumn("bucket", F.crc32("token").bitwiseAND(F.lit(BUCKETS - 1))), f"{path}/counts")
    ids = written(learn.select("text").mapInPandas(_bucket_ids, "buckets binary"), f"{path}/ids")

    per = counts.groupBy("bucket").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"), F.sum((F.col("c") == 1).cast("long")).alias("ones"), F.sum((F.col("c") == 2).cast("long")).alias("twos")).toPandas()
    total, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    total[per["bucket"]], types[per["bucket"]] = per["total"], per["types"]
    n, v = int(total.sum()), int(types.sum())
    ones, twos = int(per["ones"].sum()), int(per["twos"].sum())
    discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
    # A bucket's unseen slot, log10; 0 where the bucket itself was never seen.
    slot = np.log10(np.where(total > 0, discount * types / np.maximum(total, 1), 1.0))
    share = (total + 0.5) / (total + 0.5).sum()
    model, _ = train(ids, share, states, rounds)

    # The most frequent tokens by a threshold, found from a histogram of at most 1008 bins: a sort with a limit would
    # send hot_tokens rows from every task.
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, kept = 1 << 20, 0
    for at, size in bins:
        kept += size
        if kept > hot_tokens:
            break
        least = at
    top = counts.where(step >= least).toPandas()
    hot = {bytes(t): i for i, t in enumerate(top["token"])}
    c, at = top["c"].to_numpy(float), top["bucket"].to_numpy(np.int64)
    inside = np.log10((c - discount) / total[at]) if len(top) else c
    share_all = spark.sparkContext.broadcast
    scored = written(rows.mapInPandas(_score(share_all(model), share_all(hot), share_all(((np.log10(c + 1).tolist(), inside.tolist()), slot.tolist()))), "doc_id " + docs.schema[id_col].dataType.simpleString() + ", held_out boolean, n_tokens long, hot_known long, hot_base double, inner double, rest array<binary>, times array<int>").withColumn("row", F.monotonically_increasing_id()), f"{path}/scored")

    # The other tokens: what each adds to the sums if it is known.
    per_bucket = spark.createDataFrame(pd.DataFrame({"bucket": np.arange(BUCKETS, dtype=np.int64), "total": total, "slot": slot}))
    gain = counts.join(F.broadcast(per_bucket), "bucket").select("token", F.log10(F.col("c") + 1).alias("base"), (F.log10((F.col("c") - discount) / F.col("total")) - F.col("slot")).alias("inner"))
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("row", F.col("t.rest").alias("token"), F.col("t.times").alias("f"))
    found = rest.join(gain, "token").groupBy("row").agg(F.sum("f").alias("k"), F.sum(F.col("f") * F.col("base")).alias("b"), F.sum(F.col("f") * F.col("inner")).alias("g"))
    whole = scored.drop("rest", "times").join(found, "row", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("hot_known") + zero("k")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("hot_base") + zero("b") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), (F.col("inner") + zero("g")).alias("score"))
