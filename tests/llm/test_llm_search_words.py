"""Ranked search, SentencePiece ids and spelling variants on small and odd tables, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from emberline.llm import pieces, ranked_search, spelling
from emberline.llm.words import BYTE_VALUES, WHITE, find_words, span_hashes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, ids string, item long, word string, n long"
ODD = [
    (1, None, None, 1, "a", 1),
    (2, "", "x", None, "b", None),
    (3, " \t\n ", None, 2, None, 3),
    (4, "Same words words", None, 3, "c", 4),
    (4, "Same words words", None, 3, "c", 4),
    (None, "same WORDS here", "y", 4, "d", 5),
    (5, "▁▁ marked▁words  and \x00 bytes <0x41> </s>", None, 5, "e", 6),
    (6, "ÀÉÿ thése théses wordss 日本 🙂", None, 6, "f", 7),
    (7, " ".join(f"word{i % 977} thése" for i in range(20_000)), None, 7, "g", 8),
    (8, "x" * 300_000, None, 8, "h", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, top):
    known = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_docs, n_terms = len(known), sum(n for _, _, n in known)
    df = Counter(t for _, counts, _ in known for t in counts)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in set(items):
        found = []
        for i, counts, n in known:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(weight[t] * (10**9 * counts[t] // (1000 * counts[t] + 20 * m)) for t in set(terms(text)) if t in counts)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k, None if nameless else i, -score) for k, (score, nameless, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def test_ranked_search_ties_blocks_and_odd_rows(spark, odd, empty):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "é", "x"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(200)]
    docs += [(7, "w1 w2"), (None, "w1 w2 W3"), (None, None)] + [(400 + i, "w1 w2 w3 same") for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(30)]
    items += [(1, "w1 w2"), (1, "w1 w2"), (None, "w3 w4"), (50, None)] + [(60 + i, f"w1 w2 w3 w4 w5 common part w{i}") for i in range(9)]
    table, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = ranked(docs, items, 7)
    for block in (200_000, 60):
        assert sorted([tuple(r) for r in ranked_search.search(table, queries, 7, block).collect()], key=str) == want
    clash = queries.selectExpr("item_id", "text", "1 AS doc_id", "'x' AS terms", "2 AS rank")
    assert sorted([tuple(r) for r in ranked_search.search(odd, clash, 7).collect()], key=str) == ranked([r[:2] for r in ODD], items, 7)
    assert ranked_search.search(empty, queries).count() == 0 and ranked_search.search(odd, queries.limit(0)).count() == 0


def test_query_graph_sums_disjoint_terms_once():
    rng = np.random.default_rng(5)
    shared = rng.choice(10_000, 40, replace=False).astype(np.uint64)
    lists = [np.unique(np.concatenate([shared[: rng.integers(10, 40)], rng.integers(0, 10_000, rng.integers(1, 20)).astype(np.uint64)])) for _ in range(50)]
    graph = ranked_search.query_graph(np.arange(50), np.array([len(x) for x in lists]), np.concatenate(lists))
    values = rng.integers(0, 1 << 40, (len(graph.terms), 3))
    sums = np.zeros((graph.size(), 3), np.int64)
    np.add.at(sums, graph.leaf, values)
    want = np.array([values[np.searchsorted(graph.terms, x)].sum(axis=0) for x in lists])
    assert (graph.sums(sums) == want).all()
    assert len(graph.left) > 0 and len(graph.nodes) + len(graph.left) < sum(len(x) for x in lists) / 2


def test_best_keeps_ties_in_order():
    best = ranked_search.Best(1, 3)
    for ids in ([9, 4], [7, 1], [3, 8]):
        best.add(np.full((1, 2), 5), np.array(ids), np.zeros(2, bool))
    assert best.doc[0].tolist() == [1, 3, 4]


def library_rows(rows):
    model = SentencePieceProcessor(model_file=MODEL)
    out = [(i, model.encode(t or "")) for i, t in rows]
    return sorted([(i, ids, model.decode(ids) if ids else "") for i, ids in out], key=str)


def test_pieces_odd(odd, empty, monkeypatch):
    want = library_rows([r[:2] for r in ODD])
    got = pieces.encoded(odd, MODEL)
    assert got.columns == ["doc_id", "ids", "decoded"] and sorted([tuple(r) for r in got.collect()], key=str) == want
    assert pieces.encoded(empty, MODEL).count() == 0


def test_pieces_against_the_library(spark):
    rng = random.Random(1)
    letters = "ab  ▁é\n\t<0x41>s/\x00 日本🙂  unk"
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "▁a", "a▁ b", "  \n ", "x" * 5000] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted([(r["doc_id"], r["ids"], r["decoded"]) for r in pieces.encoded(docs, MODEL).collect()], key=str) == library_rows(rows)


def test_pieces_slices_of_few_bytes():
    """A slice fed in parts knows each distinct chunk once and every position."""
    import pyarrow as pa

    held = pieces.Slice()
    for ids, texts in (([1, 2], [b"a b  a", b""]), ([3], [b" b a"])):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        held.add(pa.array(ids), np.frombuffer(b"".join(texts), np.uint8), offsets)
    row = held.row(pa.int64())
    chunks = pieces.expanded(row["chunks"]).tobytes().split(b"\xff")[:-1]
    assert [chunks[i] for i in pieces.codes_from_bytes(row["codes"], row["low_codes"])] == [b"a", b"b", b" a", b" b", b"a"]
    assert pieces.from_bytes(row["counts"]).tolist() == [3, 0, 2] and len(set(chunks)) == row["n_chunks"] == 4


def test_pieces_reject_models_that_cross_markers(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.pieces[400].piece = "a▁b"
    (tmp_path / "crossing.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        pieces.check_model(str(tmp_path / "crossing.model"))


def variants(docs, drop, min_length=5, min_count=3):
    n = Counter()
    for i, text in docs:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    groups, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w) + 1):
            groups[w[:k] + "*" + w[k:]].add(w)
            groups[w[:k] + "*" + w[k + 1 :] if k < len(w) else w + "*"].add(w)
    for group in groups.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * c else None
    out = {}
    for w, c in n.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, c, len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_spelling_variants_and_odd_rows(spark, odd, empty):
    rng = random.Random(2)
    texts = [(i, " ".join("".join(rng.choice("aabÉçB") for _ in range(rng.randint(4, 8))) for _ in range(200))) for i in range(40)] + [(None, "aaaaa " * 5), (101, "ÀÿýþÝ" * 40 + " 12 "), (102, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for drop in (97, None):
        for table, rows in ((docs, texts), (odd, [r[:2] for r in ODD])):
            found = spelling.variants(spelling.word_counts(table, drop))
            assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()} == variants(rows, drop)
    assert spelling.variants(spelling.word_counts(empty, 97)).count() == 0


def test_spelling_chains_and_runs_of_letters(spark):
    counts = {"words": 100, "wordss": 40, "wordsss": 12, "wordssss": 4, "word": 9, "sword": 9, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.variants(table, min_length=4).collect()}
    assert got["wordssss"] == ("wordsss", "words", 1) and got["words"] == (None, "words", 2)
    assert got["word"] == ("words", "words", 2) and got["sword"] == (None, "sword", 1)
    assert got["aaaaa"] == ("aaaaaa", "aaaaaa", 1) and got["aaaaaa"] == (None, "aaaaaa", 2)


def test_checksums_of_spans():
    rng = random.Random(3)
    texts = [bytes(rng.choices(range(1, 255), k=k)) for k in (1, 2, 5, 63, 64, 65, 200, 7)]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(texts))], np.uint32)
    assert spelling.checksums(data, np.cumsum(size) - size, size, before).tolist() == [zlib.crc32(t, int(b)) for t, b in zip(texts, before, strict=True)]


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from emberline.llm import words

    data = np.frombuffer(b" ".join(bytes([97 + i % 26]) * (1 + i % 37) for i in range(400)) + b" " + b"long" * 300, np.uint8)
    offsets = np.array([0, len(data)])
    whole = find_words(data, offsets, WHITE, lower=True).hash
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    assert (find_words(data, offsets, WHITE, lower=True).hash == whole).all()
    assert span_hashes(data, np.array([0]), np.array([1]), BYTE_VALUES)[0] == whole[0]
