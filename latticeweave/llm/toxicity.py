"""Toxicity by weak supervision.

1. Lexicon: words and word beginnings (3 to 7 characters) that labelled training texts of label 1 hold far more often,
   learnt from a sample of at most ``max_labelled`` labelled rows (by hash of the id; the documented bound).
2. Voters: many lexicon voters (shares of the lexicon, two or more different terms, density) and pattern voters (shouting,
   repeated marks, second-person phrases near lexicon terms, ...). Each votes yes or no on every text; the votes of all
   texts are counted as bit patterns, at most 2 ** voters rows.
3. Generative label model: EM over all vote patterns estimates every voter's accuracy; voters that still correlate given
   the label are merged into groups, whose joint votes get a table of their own. Where a label is known it is one
   more voter with an estimated accuracy.
4. Classifier: logistic regression on term counts, densities and votes, fitted to the posterior labels of the sample.

Scores read the text only. Defined cases: null texts are empty and get the score of a text without any feature; labels
that are null are ignored; a document labelled twice counts with its larger label; without any usable label
every score is 0.5; an empty table gives no rows. Extra columns are kept inside ``doc``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, bucket_of, written

MAX_LABELLED, MAX_TERMS, SHARES = 20_000, 3000, 6
PREFIXES = range(3, 8)
_WORD = re.compile(r"[^\W\d_]+")
_SECOND = re.compile(r"\b(?:you|your|du|dein|tu|ton|vous|eres|tus)\b")
_CACHE: dict[str, dict] = {}
THRESHOLD = 0.7


def terms_of_word(word: str) -> list[str]:
    return [f"={word}"] + [f"^{word[:n]}" for n in PREFIXES if len(word) > n]


def _document_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: term, texts that hold it by label, occurrences by label."""
    texts_with, occurrences = (Counter(), Counter()), (Counter(), Counter())
    kept: dict[str, tuple[str, ...]] = {}

    def terms(word: str) -> tuple[str, ...]:
        got = kept.get(word)
        if got is None:
            got = kept[word] = tuple(terms_of_word(word))
        return got

    def out() -> pd.DataFrame:
        every = list(occurrences[0].keys() | occurrences[1].keys())
        column = lambda c: np.fromiter(map(c.__getitem__, every), np.int64, len(every))
        return pd.DataFrame({"term": every, "pos": column(texts_with[1]), "neg": column(texts_with[0]), "pos_n": column(occurrences[1]), "neg_n": column(occurrences[0])})

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            found = list(chain.from_iterable(map(terms, _WORD.findall((text or "").lower()))))
            occurrences[toxic].update(found)
            texts_with[toxic].update(set(found))
        if len(kept) > 100_000 or len(occurrences[0]) > 400_000:
            yield out()
            for counter in (*texts_with, *occurrences):
                counter.clear()
            kept.clear()
    if occurrences[0] or occurrences[1]:
        yield out()


class Lexicon:
    """Terms with their weights (shrunken log-odds), and the votes of a text."""

    def __init__(self, terms: list[str], weights: np.ndarray) -> None:
        self.index = {t: i for i, t in enumerate(terms)}
        self.weights = weights
        self.share = [i % SHARES for i in range(len(terms))]  # by rank, so that shares are alike
        self.key = uuid.uuid4().hex

    names = (*(f"lexicon_{i}" for i in range(SHARES)), "strong_term", "two_terms", "four_terms", "dense", "near_second_person", "shouting", "marks", "repeated_word")

    def hits(self, text: str) -> tuple[dict[int, int], int]:
        """Occurrences of each term, and the number of words."""
        kept = _CACHE.get(self.key)
        if kept is None or len(kept) > 300_000:
            _CACHE.clear()
            kept = _CACHE[self.key] = {}
        found: dict[int, int] = {}
        words = Counter(_WORD.findall(text.lower()))
        for word, n in words.items():
            at = kept.get(word)
            if at is None:
                at = tuple(self.index[t] for t in terms_of_word(word) if t in self.index)
                if len(word) <= 40:
                    kept[word] = at
            for i in at:
                found[i] = found.get(i, 0) + n
        return found, sum(words.values())

    def votes(self, text: str, found: dict[int, int], n: int) -> int:
        strong = [i for i in found if self.weights[i] > 3.0]
        shares = {self.share[i] for i in found}
        weight = sum(min(found[i], 3) * self.weights[i] for i in strong)
        words = text.split()
        tests = [s in shares for s in range(SHARES)]
        tests += [
            bool(strong),
            len(strong) >= 2,
            len(strong) >= 4,
            weight > 0.02 * n,
            bool(strong) and bool(_SECOND.search(text.lower())),
            sum(w.isupper() and len(w) > 2 for w in words) > 0.3 * len(words) > 0,
            text.count("!") + text.count("?") > 0.2 * len(words) > 0,
            len(set(words)) < 0.3 * len(words),
        ]
        return sum(1 << i for i, x in enumerate(tests) if x)

    def features(self, found: dict[int, int], n: int, votes: int) -> tuple[list[int], list[float]]:
        """Sparse: log counts of terms, then totals, then votes."""
        at = sorted(found)
        values = [float(np.log1p(found[i])) for i in at]
        size = len(self.weights)
        weight = sum(found[i] * max(self.weights[i], 0) for i in at)
        totals = [np.log1p(weight), np.log1p(50 * weight / max(n, 1)), np.log1p(sum(self.weights[i] > 3 for i in at)), np.log1p(n)]
        bits = [i for i in range(len(self.names)) if votes >> i & 1]
        return at + [size + i for i in range(4)] + [size + 4 + i for i in bits], values + [float(x) for x in totals] + [1.0] * len(bits)

    @property
    def width(self) -> int:
        return len(self.weights) + 4 + len(self.names)


def learn_lexicon(labelled: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """labelled: (text, toxic) of the bounded sample."""
    totals = labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r.toxic: r.n for r in totals}
    pos, neg = n.get(1, 0), n.get(0, 0)
    counted = labelled.mapInPandas(_document_terms, "term string, pos long, neg long, pos_n long, neg_n long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pos_n", "neg_n")])
    odds = F.log((F.col("pos_n") + 0.5) / (pos + 1.0)) - F.log((F.col("neg_n") + 0.5) / (neg + 1.0))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counted.where(F.col("pos") >= 5).select("term", odds.alias("odds"), (odds - 3 * error).alias("bound")).where("bound > 0").orderBy(F.desc("bound"), "term").limit(max_terms).collect()
    return Lexicon([r.term for r in best], np.array([r.bound for r in best], float))


class LabelModel:
    """Yes-no voters, possibly in correlated groups, over one hidden yes-no label."""

    def __init__(self, voters: int) -> None:
        self.groups = [[i] for i in range(voters)]
        self.prior, self.tables, self.label = 0.1, [], np.array([[0.95, 0.05], [0.05, 0.95]])

    def _states(self, masks: np.ndarray) -> list[np.ndarray]:
        bit = lambda i: (masks >> i) & 1
        return [sum(bit(v) << k for k, v in enumerate(g)) for g in self.groups]

    def posterior(self, masks: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(1 | votes, label where it is 0 or 1)."""
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(masks), 1))
        for state, table in zip(self._states(masks), self.tables, strict=True):
            logs += np.log(table[:, state]).T
        known = label >= 0
        logs[known] += np.log(self.label[:, label[known]]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def _fit(self, masks: np.ndarray, label: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            weight = np.stack([n * (1 - p), n * p])
            self.prior = float(np.clip(weight[1].sum() / max(weight.sum(), 1e-9), 1e-3, 0.5))
            self.tables = []
            for g, state in zip(self.groups, self._states(masks), strict=True):
                table = np.stack([np.bincount(state, w, 1 << len(g)) for w in weight]) + 1.0
                self.tables.append(table / table.sum(axis=1, keepdims=True))
            known = label >= 0
            table = np.stack([np.bincount(label[known], w[known], 2) for w in weight]) + np.array([[20.0, 1.0], [1.0, 20.0]])
            self.label = table / table.sum(axis=1, keepdims=True)
            p = self.posterior(masks, label)
        return p

    def fit(self, masks: np.ndarray, label: np.ndarray, n: np.ndarray, rounds: int = 25, limit: float = 0.2, largest: int = 6) -> LabelModel:
        """Accuracies by EM from the known labels; then voters whose votes correlate given the label are grouped."""
        known = label >= 0
        rate = (n[known] @ label[known]) / max(n[known].sum(), 1)
        seen = pd.DataFrame({"m": masks, "k": n * known, "y": n * known * np.maximum(label, 0)}).groupby("m").sum()
        first = ((seen["y"] + rate) / (seen["k"] + 1)).reindex(masks).to_numpy()
        p = self._fit(masks, label, n, np.where(known, 0.1 * first + 0.9 * label, first), 3)
        bits = (masks[:, None] >> np.arange(len(self.groups))) & 1
        rest = np.zeros((bits.shape[1], bits.shape[1]))
        for weight in (n * (1 - p), n * p):
            mean = weight @ bits / max(weight.sum(), 1e-9)
            off = bits - mean
            cov = (off * weight[:, None]).T @ off / max(weight.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rest = np.maximum(rest, np.abs(cov / np.outer(sd, sd)))
        self.correlations = rest
        for i, j in sorted(((i, j) for i in range(len(rest)) for j in range(i)), key=lambda x: -rest[x]):
            a = next(g for g in self.groups if i in g)
            b = next(g for g in self.groups if j in g)
            if rest[i, j] > limit and a is not b and len(a) + len(b) <= largest:
                self.groups = [g for g in self.groups if g is not a and g is not b] + [sorted(a + b)]
        self._fit(masks, label, n, p, rounds)
        return self


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, width: int, rounds: int = 200, ridge: float = 1.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and feature scales, by accelerated gradient steps; positive and negative targets weigh as they are."""
    counts = np.array([len(a) for a, _ in rows])
    row = np.repeat(np.arange(len(rows)), counts)
    col = np.concatenate([np.array(a, int) for a, _ in rows]) if rows else np.zeros(0, int)
    val = np.concatenate([np.array(v, float) for _, v in rows]) if rows else np.zeros(0)
    scale = np.maximum(np.sqrt(np.bincount(col, val**2, width) / max(len(rows), 1)), 1e-2)
    val = val / scale[col]
    w, b = np.zeros(width), float(np.log((target.sum() + 1) / (len(target) - target.sum() + 1)))
    step = 1.0 / (0.25 * max(np.bincount(row, val**2, len(rows)).mean() * 2, 1.0))
    vw, vb = w.copy(), b
    for r in range(rounds):
        z = np.bincount(row, val * vw[col], len(rows)) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        nw = vw - step * (np.bincount(col, val * g[row], width) / len(rows) + ridge * vw / len(rows))
        nb = vb - step * g.mean()
        vw, vb = nw + r / (r + 3) * (nw - w), nb + r / (r + 3) * (nb - b)
        w, b = nw, nb
    return w / scale, b, scale


def _scoring(lexicon, weights: np.ndarray, bias: float):
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lex = lexicon.value
        for texts in batches:
            out = []
            for text in texts:
                text = text or ""
                found, n = lex.hits(text)
                at, values = lex.features(found, n, lex.votes(text, found, n))
                z = bias + float(weights[at] @ np.array(values))
                out.append(1 / (1 + np.exp(-min(max(z, -50), 50))))
            yield pd.Series(out, dtype="float64")

    return scored


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_fold: int = 1, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc, held_out, score, predicted): doc is a struct of all the input's columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & (bucket_of("label_id", folds) != held_fold))
    usable = usable.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    # The stated bound on labelled rows also bounds this broadcast. The sample is a range of the ids' hashes.
    slots = 1 << 20
    share = min(1.0, 0.95 * max_labelled / max(1, usable.count()))
    sample = written(usable.where(F.pmod(F.xxhash64("label_id"), F.lit(slots)) < int(slots * share)) if share < 1 else usable)
    if sample.count() > max_labelled:
        raise ValueError("ids whose hashes are not spread exceed the bound on labelled rows")
    sample = F.broadcast(sample)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), (bucket_of(id_col, folds) == held_fold).alias("held_out"), text.alias("text"))
    labelled = base.select(F.col(f"doc.`{id_col}`").alias("label_id"), "text").join(sample, "label_id").select("text", "toxic")
    lexicon = learn_lexicon(labelled)
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("votes int, at array<int>, value array<double>")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                found, n = lex.hits(t)
                votes = lex.votes(t, found, n)
                rows.append((votes, *lex.features(found, n, votes)))
            yield pd.DataFrame(rows, columns=["votes", "at", "value"])

    @F.pandas_udf("int")
    def vote_mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lex = shared.value
        for texts in batches:
            yield pd.Series([lex.votes(t, *lex.hits(t)) for t in texts], dtype="int32")

    train = labelled.select("toxic", voted("text").alias("v")).toPandas()
    patterns = base.select(vote_mask("text").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if train.empty or train["toxic"].nunique() < 2:
        weights, bias = np.zeros(lexicon.width), 0.0
    else:
        votes = np.array([v["votes"] for v in train["v"]], np.int64)
        y = train["toxic"].to_numpy(np.int64)
        known = pd.DataFrame({"m": votes, "y": y}).groupby(["m", "y"]).size().reset_index(name="n")
        masks = np.concatenate([patterns["m"].to_numpy(np.int64), known["m"].to_numpy(np.int64)])
        label = np.concatenate([np.full(len(patterns), -1), known["y"].to_numpy(np.int64)])
        n = np.concatenate([patterns["n"].to_numpy(float), known["n"].to_numpy(float)])
        model = LabelModel(len(lexicon.names)).fit(masks, label, n)
        rows = [(np.asarray(v["at"]), np.asarray(v["value"])) for v in train["v"]]
        weights, bias, _ = fit_logistic(rows, model.posterior(votes, y), lexicon.width)
    score = _scoring(shared, weights, bias)
    out = base.select("doc", "held_out", score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
