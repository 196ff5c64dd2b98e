"""Language identification with a linear-chain conditional random field over words.

Each word has features: its affixes and inner byte n-grams (hashed, with marked word ends) and its lexicon entry (log shares of the
languages among the fitting rows). Emissions and learned transitions give, by forward-backward, the probability of each
language at each word, so text that switches its language is labelled part by part. A document's language is the one with the
largest sum, its score that sum over the number of words.

The model is fitted on distinct labelled texts with words, ``sample_rows`` in all and equally many of each language as far as it has them, but
``LEAST_TEXTS`` of each language at least, and ``sample_bytes`` in all (documented bounds; chosen by a hash of the text). One task of an executor fits it,
so the driver holds the weights only. The words are cut into stretches and joined across languages, so that switches occur. Prediction reads whole texts and nothing else.

Defined results: a null text or one without a letter is ``und`` with score 0; without any labelled row every text is ``und``;
digits and signs are between words; repeated documents get equal results; an empty table gives none; other columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import distinct_texts, packed, slices, text_hash, unpacked, written
from emberline.llm.words import BYTE_VALUES, LOWER, Words, find_words, mix

SLICE_BYTES = 1 << 20
SCORED_WORDS = 10_000  # words whose features are held at once
UNKNOWN = "und"
HASH_BITS = 16
GRAMS = (1, 2, 3, 4)
MIN_LEXICON = 3
LEAST_TEXTS = 20  # of each language, also where that is more than the sample's share
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    """Languages, feature weights (hashed n-grams by language), lexicon, and log transitions; the start is uniform."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    shares: np.ndarray
    trust: np.ndarray
    moves: np.ndarray


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features of words with marked ends, side by side, and where each word's features begin."""
    sizes = end - start + 2
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    marked = np.repeat(sizes, sizes)
    source = np.clip(np.repeat(start, sizes) + place - 1, 0, max(len(data) - 1, 0))
    letters = np.where(place == 0, 1, np.where(place == marked - 1, 2, LOWER[data[source]] if len(data) else 0)).astype(np.uint8)
    values = BYTE_VALUES[letters]
    out, owners = [], []
    word = np.repeat(np.arange(len(sizes)), sizes)
    hashed = np.zeros(len(values), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(values), np.uint64)
        shifted[: len(values) - n + 1] = values[n - 1 :] if n > 1 else values
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + shifted
        if n in GRAMS:
            whole = place + n <= marked
            out.append((mix(hashed[whole] + np.array([n], np.uint64)) >> np.uint64(64 - HASH_BITS)).astype(np.int32))
            owners.append(word[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(owner[order], np.arange(len(sizes) + 1))


def lexicon_rows(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Log shares of the languages for each word; zeros for unknown words."""
    if not len(model.lexicon):
        return np.zeros((len(hashes), len(model.languages)))
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    return np.where((model.lexicon[at] == hashes)[:, None], model.shares[at], 0.0)


def emissions(model: Model, data: np.ndarray, words: Words) -> np.ndarray:
    """Scores of the languages for every word; each distinct word is scored once."""
    hashes, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
    if not len(hashes):
        return np.zeros((0, len(model.languages)))
    scores = model.trust * lexicon_rows(model, hashes)
    for low in range(0, len(hashes), SCORED_WORDS):
        some = first[low : low + SCORED_WORDS]
        features, begin = word_features(data, words.start[some], words.end[some])
        scores[low : low + SCORED_WORDS] += np.add.reduceat(model.weights[features], begin[:-1], axis=0)
    return scores[back]


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word of many texts at once (and the expected transitions); texts without words are allowed."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = first[:-1][order], sizes[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    likely = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    table = np.exp(moves)
    alpha, beta = np.empty_like(likely), np.empty_like(likely)
    for t in range(steps):
        at = starts[: active[t]] + t
        now = likely[at] if t == 0 else (alpha[at - 1] @ table) * likely[at]
        alpha[at] = now / now.sum(axis=1, keepdims=True)
    expected = np.zeros_like(table)
    for t in range(steps - 1, -1, -1):
        at = starts[: active[t]] + t
        now = np.ones((len(at), likely.shape[1]))
        more = int(active[t + 1]) if t + 1 < steps else 0
        if more:
            ahead = likely[at[:more] + 1] * beta[at[:more] + 1]
            now[:more] = ahead @ table.T
            if pairs:
                total = ((alpha[at[:more]] @ table) * ahead).sum(axis=1, keepdims=True)
                expected += alpha[at[:more]].T @ (ahead / total) * table
        beta[at] = now / now.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300), expected


def fit(rows: list[tuple[str, str]], turns: int = 2, seed: int = 7, batch_words: int = 12_000, rate: float = 0.3) -> Model | None:
    """Maximum likelihood of the labels of joined stretches, by adaptive gradient steps."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    random = np.random.default_rng(seed)
    raw = [text.encode() for text, _ in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words = find_words(data, offsets, BETWEEN, lower=True)
    label = np.repeat(np.array([languages.index(lang) for _, lang in rows]), words.counts)
    hashes, where, kind = np.unique(words.hash, return_index=True, return_inverse=True)
    parts, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for low in range(0, len(hashes), SCORED_WORDS):
        some = where[low : low + SCORED_WORDS]
        block, inner = word_features(data, words.start[some], words.end[some])
        parts.append(block)
        ends.append(inner[1:] + ends[-1][-1])
    features, begin = np.concatenate(parts), np.concatenate(ends)
    counts = np.stack([np.bincount(kind[label == i], minlength=len(hashes)) for i in range(len(languages))], axis=1) if len(hashes) else np.zeros((0, len(languages)))
    often = counts.sum(axis=1) >= MIN_LEXICON
    share = np.log((counts + 0.5) / (counts.sum(axis=0) + 1))
    share -= share.mean(axis=1, keepdims=True) if len(share) else 0
    model = Model(languages, np.zeros((1 << HASH_BITS, len(languages))), hashes[often], share[often], np.zeros(len(languages)), np.zeros((len(languages),) * 2))
    spent_w, spent_t, spent_m = np.full(model.weights.shape, 1e-3), np.full(len(languages), 1e-3), np.full(model.moves.shape, 1e-3)
    shares = np.where(often[:, None], share, 0.0)
    for _ in range(turns):
        stretches = []
        for i, n in enumerate(words.counts.tolist()):
            at = 0
            while at < n:
                size = int(random.integers(6, 60))
                stretches.append((int(words.first[i]) + at, min(size, n - at)))
                at += size
        random.shuffle(stretches)
        queue = iter(stretches)
        while True:
            places, sizes = [], []
            while sum(sizes) < batch_words:
                parts = [s for s in (next(queue, None) for _ in range(int(random.integers(1, 6)))) if s]
                if not parts:
                    break
                places += [np.arange(a, a + n) for a, n in parts]
                sizes.append(sum(n for _, n in parts))
            if not sizes:
                break
            at, first = np.concatenate(places), np.concatenate([[0], np.cumsum(sizes)])
            types, back = np.unique(kind[at], return_inverse=True)
            spans = [features[begin[t] : begin[t + 1]] for t in types.tolist()]
            lengths = np.array([len(s) for s in spans])
            flat = np.concatenate(spans)
            scores = np.add.reduceat(model.weights[flat], np.cumsum(lengths) - lengths, axis=0) + model.trust * shares[types]
            marginals, expected = forward_backward(scores[back], first, model.moves, pairs=True)
            slope = marginals
            slope[np.arange(len(at)), label[at]] -= 1
            by_type = np.stack([np.bincount(back, slope[:, i], len(types)) for i in range(len(languages))], axis=1) / len(at)
            seen = np.unique(flat)
            step = np.stack([np.bincount(flat, np.repeat(by_type[:, i], lengths), 1 << HASH_BITS)[seen] for i in range(len(languages))], axis=1)
            spent_w[seen] += step**2 * 1e4
            model.weights[seen] -= rate * step * 1e2 / np.sqrt(spent_w[seen])
            step = (by_type * shares[types]).sum(axis=0)
            spent_t += step**2
            model.trust -= 0.1 * step / np.sqrt(spent_t)
            follow = np.ones(len(at), bool)
            follow[first[:-1]] = False
            after = np.flatnonzero(follow)
            real = np.zeros_like(expected)
            np.add.at(real, (label[at[after - 1]], label[at[after]]), 1)
            step = (expected - real) / len(at)
            spent_m += step**2
            model.moves -= rate * step / np.sqrt(spent_m)
    model.weights = model.weights.astype(np.float32)
    return model


def places_by_language(totals: dict[str, int], sample_rows: int) -> dict[str, int]:
    """How many texts of each language are fitted: equal numbers; what a language does not have goes to the others."""
    out, left = {}, sample_rows
    for i, lang in enumerate(sorted(totals, key=lambda x: (totals[x], x))):
        out[lang] = min(totals[lang], max(left // (len(totals) - i), LEAST_TEXTS))
        left = max(0, left - out[lang])
    return out


def fitting_rows(docs: DataFrame, sample_rows: int, sample_bytes: int = 16 << 20) -> DataFrame | None:
    """``place, text, lang``: distinct labelled texts with words, of each language those with the least hash; a text with several labels has its most
    frequent one. The languages share ``sample_bytes`` evenly: a text that no longer fits is passed over, and a language with none that fits has its shortest."""
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")).select("text", "lang")
    labels = known.groupBy(text_hash().alias("_hash"), "lang").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("_bytes"))
    texts = written(labels.groupBy("_hash").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("_bytes").alias("_bytes")), "fitting-texts")
    totals = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = places_by_language(totals, sample_rows)
    if not wanted:
        return None
    # so many more than wanted that fewer practically never come
    shares = {lang: min(1.0, (n + 8 * n**0.5 + 30) / totals[lang]) for lang, n in wanted.items()}
    bound = F.create_map([F.lit(x) for lang, share in shares.items() for x in (lang, int(share * (1 << 53)))])
    place = F.shiftrightunsigned("_hash", 11)
    near = texts.filter(place <= bound[F.col("lang")]).select("_hash", "lang", "_bytes", place.alias("_place")).collect()
    chosen, taken, left = {}, dict.fromkeys(wanted, 0), dict.fromkeys(wanted, sample_bytes // len(wanted))
    for r in sorted(near, key=lambda r: (r["_place"], r["_hash"])):
        if taken[r["lang"]] < wanted[r["lang"]] and r["_bytes"] <= left[r["lang"]]:
            chosen[r["_hash"]] = r["lang"]
            taken[r["lang"]] += 1
            left[r["lang"]] -= r["_bytes"]
    for lang in [x for x, n in taken.items() if not n]:
        least = min((r for r in near if r["lang"] == lang), key=lambda r: (r["_bytes"], r["_hash"]))
        chosen[least["_hash"]] = lang
    picked = spark.createDataFrame([(i, h, lang) for i, (h, lang) in enumerate(chosen.items())], "place int, _hash long, lang string")
    # at most ``sample_rows`` narrow rows, and ``LEAST_TEXTS`` of each language
    return distinct_texts(known, list(chosen)).join(F.broadcast(picked), "_hash").select("place", "text", "lang")


def train(docs: DataFrame, sample_rows: int = 1500, sample_bytes: int = 16 << 20) -> Model | None:
    """A model from ``text`` and ``lang`` of the given documents, fitted in one task on the bounded sample."""
    rows = fitting_rows(docs, sample_rows, sample_bytes)
    if rows is None:
        return None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r["place"], r["text"], r["lang"]) for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1:] for r in sample]))], pa.binary())], ["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(learn, "model binary").first()["model"])


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, text, _rest`` with ``_lang``, ``_score``, ``_certainty`` (mean over words of the most likely language's probability)
    and ``_parts``: runs of words of one language (``start, length, lang``)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs)

    def answer(rows: pa.RecordBatch, langs: list, scores: list, sure: list, parts: list) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))
        new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64()), pa.array(parts, kind)]
        return pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, "_lang", "_score", "_certainty", "_parts"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for low, high, data, offsets in slices(batch, "text", SLICE_BYTES):
                langs, scores, sure, parts = [UNKNOWN] * (high - low), [0.0] * (high - low), [0.0] * (high - low), [[] for _ in range(high - low)]
                if model is None:
                    yield answer(batch.slice(low, high - low), langs, scores, sure, parts)
                    continue
                words = find_words(data, offsets, BETWEEN, lower=True)
                marginals, _ = forward_backward(emissions(model, data, words), words.first, model.moves)
                counts = words.counts
                sums = np.zeros((high - low, len(model.languages)))
                some = np.flatnonzero(counts)
                if len(some):
                    sums[some] = np.add.reduceat(marginals, words.first[:-1][some], axis=0)
                    best_sums = np.add.reduceat(marginals.max(axis=1), words.first[:-1][some])
                best, total = sums.argmax(axis=1), np.maximum(counts, 1)
                label_of = marginals.argmax(axis=1)
                change = np.flatnonzero(np.concatenate([[True], label_of[1:] != label_of[:-1]])) if len(label_of) else np.zeros(0, np.int64)
                begins = np.union1d(change, words.first[:-1][some])
                ends = np.append(begins[1:], len(label_of))[: len(begins)]
                owner = np.searchsorted(words.first, begins, side="right") - 1
                ascii_letters = np.add.reduceat(np.concatenate([~BETWEEN[data] & (data < 128), [False]]).astype(np.int64), offsets[:-1]) if len(data) else np.zeros(high - low)
                for k, i in enumerate(some.tolist()):
                    if ascii_letters[i] or has_letter(data[offsets[i] : offsets[i + 1]].tobytes()):
                        langs[i] = model.languages[best[i]]
                        scores[i] = min(1.0, float(sums[i, best[i]] / total[i]))
                        sure[i] = min(1.0, float(best_sums[k] / total[i]))
                for a, b, i in zip(begins.tolist(), ends.tolist(), owner.tolist(), strict=True):
                    if langs[i] != UNKNOWN:
                        parts[i].append({"start": a - int(words.first[i]), "length": b - a, "lang": model.languages[label_of[a]]})
                yield answer(batch.slice(low, high - low), langs, scores, sure, parts)

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(label, shape + ", _lang string, _score double, _certainty double, _parts array<struct<start:int,length:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Model | None, min_certainty: float = 0.0, into: str | None = None) -> DataFrame:
    """The documents with a language: not ``und``, and words labelled with a certainty of at least ``min_certainty`` in the mean. A document that
    mixes languages has a low score, but not a low certainty. The column ``into``, if the documents have it, takes the language found."""
    found = with_language(docs, model)
    kept = found.filter((F.col("_lang") != UNKNOWN) & (F.col("_certainty") >= min_certainty))
    if into not in docs.columns:
        return unpacked(kept, docs.columns)
    return unpacked(kept, docs.columns, {into: F.col("_lang")})
