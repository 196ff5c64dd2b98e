"""Quality scores from weak labels: expectation-maximisation over overlapping heuristics, then a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document. Votes are counted by pattern over *all* documents (at most
``3 ** labellers`` patterns, summed per task), and expectation-maximisation on these counts estimates how often each labeller
is right for good and for bad documents, and how many are good. The posterior of each document's pattern is its weak label.
A logistic regression over hashed words and word pairs, with the labellers' measures as further features, is fitted to
the posteriors of at most ``sample_rows`` distinct texts with words (a documented bound) and scores every document. A text is drawn
with a chance that grows with the number of its copies and has a weight, so that the sample stands for all rows and a group of copies has
one place in it.

Defined results: a null text counts as empty, gets no vote and the score of the intercept; with no documents or a single
pattern the prior decides; repeated documents get equal results; an empty table gives none; other columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import distinct_texts, packed, slices, text_hash
from emberline.llm.words import WHITE, WORD_BASE, Words, find_words, mix

SLICE_BYTES = 2 << 20
HASH_BITS = 18
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
CLUTTER = np.zeros(256, bool)
CLUTTER[[ord(c) for c in "#$%&*<>=@\\^_{}|~!"]] = True
GOOD, BAD, NONE = 2, 0, 1

# labeller: measure, bad from this value on, good up to this value
LABELLERS = (
    ("clutter", 0.05, 0.005),
    ("capitals", 0.5, 0.15),
    ("repeats", 0.7, 0.5),
    ("lone_signs", 0.2, 0.02),
    ("long_words", 0.25, 0.1),
    ("top_word", 0.3, 0.12),
)


def measures(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Of each text: shares of clutter bytes, of capitals among letters, of repeated words, of words without a letter, of
    words over 18 bytes, and of the most frequent word."""
    n = len(offsets) - 1
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    sizes, counts, letters = np.diff(offsets), words.counts, LETTER[data]
    doc = words.doc()
    inside = np.concatenate([[0], np.cumsum(letters)])
    lone = np.bincount(doc, (inside[words.end] - inside[words.start]) == 0, n) if len(doc) else np.zeros(n)
    wide = np.bincount(doc, words.end - words.start > 18, n) if len(doc) else np.zeros(n)
    order = np.lexsort((words.hash, doc))
    new = np.concatenate([[True], (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(doc) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    distinct, top = np.bincount(doc[order][begin], minlength=n), np.zeros(n)
    np.maximum.at(top, doc[order][begin], np.diff(np.append(begin, len(doc))))
    some = np.maximum(counts, 1)
    return np.stack([total(CLUTTER[data]) / np.maximum(sizes, 1), total(UPPER[data]) / np.maximum(total(letters), 1), 1 - distinct / some, lone / some, wide / some, top / some], axis=1) * (counts > 0)[:, None]


def votes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Votes of the labellers, and none on texts without words; the frequency ones need 20 words."""
    out = np.full(values.shape, NONE, np.int64)
    for i, (name, bad, good) in enumerate(LABELLERS):
        enough = counts >= (20 if name in ("repeats", "top_word") else 1)
        out[:, i] = np.where(enough & (values[:, i] >= bad), BAD, np.where(enough & (values[:, i] <= good), GOOD, NONE))
    return out


def pattern(vote: np.ndarray) -> np.ndarray:
    return vote @ (3 ** np.arange(vote.shape[1]))


@dataclass
class LabelModel:
    """Share of good documents, and the chance of each vote of each labeller on bad and on good ones."""

    prior: float
    chances: np.ndarray

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        logs = np.log(self.chances)
        good = np.log(self.prior) + sum(logs[1, i, vote[:, i]] for i in range(vote.shape[1]))
        bad = np.log1p(-self.prior) + sum(logs[0, i, vote[:, i]] for i in range(vote.shape[1]))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, turns: int = 200) -> LabelModel:
    """Expectation-maximisation on pattern counts. It starts from labellers that are right more often than not."""
    k = len(LABELLERS)
    vote = (patterns[:, None] // 3 ** np.arange(k)) % 3
    start = np.tile(np.array([[[0.4, 0.5, 0.1]], [[0.1, 0.5, 0.4]]]), (1, k, 1))
    model = LabelModel(0.8, start)
    for _ in range(turns):
        good = model.posterior(vote)
        weight = np.stack([(1 - good) * counts, good * counts])
        before = model.prior
        chances = np.stack([[np.bincount(vote[:, i], w, 3) + 1.0 for i in range(k)] for w in weight])
        model = LabelModel(float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3)), chances / chances.sum(axis=2, keepdims=True))
        if abs(model.prior - before) < 1e-9:
            break
    return model


def hashed_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of pairs of neighbouring words, and the text of each."""
    doc = words.doc()
    pairs = words.hash[:-1] * np.array([WORD_BASE], np.uint64) + words.hash[1:] if len(doc) > 1 else words.hash[:0]
    same = doc[:-1] == doc[1:] if len(doc) > 1 else np.zeros(0, bool)
    both = np.concatenate([words.hash, mix(pairs)[same]]) >> np.uint64(64 - HASH_BITS)
    return both.astype(np.int64), np.concatenate([doc, doc[:-1][same] if len(doc) > 1 else doc])


@dataclass
class Scorer:
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, values: np.ndarray, words: Words) -> np.ndarray:
        feature, doc = hashed_features(words)
        n = len(values)
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        total = np.bincount(doc, self.weights[feature], n) / count + values @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def fit_scorer(values: np.ndarray, words: Words, target: np.ndarray, weight: np.ndarray, turns: int = 150, rate: float = 0.2) -> Scorer:
    """Logistic regression on the posteriors by full-batch adaptive steps; each text counts by its weight."""
    feature, doc = hashed_features(words)
    part = weight / max(weight.sum(), 1e-300)
    share = 1.0 / np.maximum(np.bincount(doc, minlength=max(len(values), 1)), 1)
    model, spent = Scorer(np.zeros(1 << HASH_BITS), np.zeros(values.shape[1]), 0.0), np.full(1 << HASH_BITS, 1e-12)
    spent_d, spent_b = np.full(values.shape[1], 1e-12), 1e-12
    for _ in range(turns if len(values) else 0):
        miss = (model.score(values, words) - target) * part
        step = np.bincount(feature, (miss * share)[doc], 1 << HASH_BITS) + 1e-7 * model.weights
        spent += step**2
        model.weights -= rate * step / np.sqrt(spent)
        dense = values.T @ miss
        spent_d += dense**2
        model.dense -= rate * dense / np.sqrt(spent_d)
        spent_b += miss.sum() ** 2
        model.bias -= rate * miss.sum() / np.sqrt(spent_b)
    return model


def text_facts(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    words = find_words(data, offsets, WHITE, lower=True)
    values = measures(data, offsets, words)
    return words, values, votes(values, words.counts)


def label_model(docs: DataFrame) -> LabelModel:
    """The labellers' accuracies from the vote patterns of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                totals += np.bincount(pattern(text_facts(data, offsets)[2]), minlength=len(totals))
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["pattern", "n"])

    rows = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return fit_labels(np.array([r["pattern"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64))


def fitting_texts(docs: DataFrame, sample_rows: int, sample_bytes: int = 16 << 20) -> DataFrame | None:
    """``text, weight``: at most ``sample_rows`` distinct texts with words, of ``sample_bytes`` in all, and how many documents each stands for.

    Priority sampling: the texts with the least ``u / copies`` for a ``u`` in (0, 1] that the text's hash gives. With ``t`` as the inverse of the next
    one's, each stands for ``max(copies, t)`` documents: frequent texts are surely drawn and count as often as they occur. Texts of more than a
    sixteenth of ``sample_bytes`` are not drawn.
    """
    fits = F.col("text").rlike(r"[^\x20\x09-\x0D]") & (F.octet_length("text") <= sample_bytes // 16)
    some = docs.select("text").filter(fits)
    counted = some.groupBy(text_hash().alias("_hash")).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("_bytes"))
    place = (F.shiftrightunsigned("_hash", 11) + 1) / F.lit(float(1 << 53)) / F.col("n")
    first = counted.withColumn("place", place).orderBy("place", "_hash").limit(sample_rows + 1).collect()
    sizes = np.cumsum([r["_bytes"] for r in first])
    drawn = min(sample_rows, int(np.searchsorted(sizes, sample_bytes, side="right")))
    if not drawn:
        return None
    stands = 1 / first[drawn]["place"] if len(first) > drawn else 0.0
    weights = docs.sparkSession.createDataFrame([(r["_hash"], max(float(r["n"]), stands)) for r in first[:drawn]], "_hash long, weight double")
    return distinct_texts(some, [r["_hash"] for r in first[:drawn]]).join(F.broadcast(weights), "_hash").select("text", "weight")


def train(docs: DataFrame, sample_rows: int = 2000, sample_bytes: int = 16 << 20) -> tuple[LabelModel, Scorer]:
    """The label model of all documents, and a scorer fitted to its posteriors in one task on the bounded sample."""
    labels = label_model(docs)
    rows = fitting_texts(docs, sample_rows, sample_bytes)
    if rows is None:
        return labels, Scorer(np.zeros(1 << HASH_BITS), np.zeros(len(LABELLERS)), float(np.log(labels.prior) - np.log1p(-labels.prior)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted((r["text"], r["weight"]) for batch in batches for r in batch.to_pylist())
        raw = [text.encode() for text, _ in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words, values, vote = text_facts(np.frombuffer(b"".join(raw), np.uint8), offsets)
        scorer = fit_scorer(values, words, labels.posterior(vote), np.array([w for _, w in texts], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(scorer)], pa.binary())], ["model"])

    return labels, pickle.loads(rows.repartition(1).mapInArrow(learn, "model binary").first()["model"])


def with_quality(docs: DataFrame, models: tuple[LabelModel, Scorer]) -> DataFrame:
    """``doc_id, text, _rest`` with ``_weak`` (posterior of the votes), ``_votes`` (labellers that voted) and ``_quality``."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    rows = packed(docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = held.value
        for batch in batches:
            weak, number, quality = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for low, high, data, offsets in slices(batch, "text", SLICE_BYTES):
                words, values, vote = text_facts(data, offsets)
                weak[low:high], number[low:high] = labels.posterior(vote), (vote != NONE).sum(axis=1)
                quality[low:high] = scorer.score(values, words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weak), pa.array(number), pa.array(quality)], [*batch.schema.names, "_weak", "_votes", "_quality"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(judge, shape + ", _weak double, _votes int, _quality double")
