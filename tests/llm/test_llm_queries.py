"""Queries of the llm subpackage against SQL, or against brute force where SQL does not express them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from emberline.llm import language_id, mpeg_audio, packing
from emberline.llm.oracle import LLM_ORACLE
from emberline.llm.queries import LLM_QUERIES

DATA = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
PLAIN = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall())


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(r[i] for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_sql(spark, duck, name):
    if name == "pipeline":
        pytest.skip("tested below")
    df = LLM_QUERIES[name](spark, DATA)
    want = duck.execute(LLM_ORACLE[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in want.description], want.fetchall())


def test_all_registered():
    assert set(LLM_QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {n.split("_")[0] for n in LLM_QUERIES if n != "pipeline"} == {f"op{i}" for i in range(1, 14)}


def components(texts, size, p, q):
    sets = {}
    for i, t in texts.items():
        w = re.findall(PLAIN, (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common * q >= (len(sets[a]) + len(sets[b]) - common) * p:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in LLM_QUERIES["op1_ngram_join"](spark, DATA).collect()}
    assert got == components(texts, 3, 9, 10)


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, k * 2048, min(2048, len(ids) - k * 2048)) for k in range(-(-len(ids) // 2048))]
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces]
        total += len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    lengths = np.array([r["length"] for r in rows])
    assert -(-total // 2048) <= packing.lower_bound(lengths, 2048) <= len(by_sequence) <= packing.lower_bound(lengths, 2048) + 1


def test_packing(spark, texts):
    check_packing(LLM_QUERIES["op3_packing"](spark, DATA).collect(), texts)


def test_language_id(spark, duck):
    rows = LLM_QUERIES["op4_language_id"](spark, DATA).collect()
    truth = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)


def test_quality(spark, duck):
    rows = {r["doc_id"]: r["quality"] for r in LLM_QUERIES["op2_quality"](spark, DATA).collect()}
    labels = duck.sql("SELECT doc_id, quality FROM labels").fetchall()
    good, bad = [[rows[i] for i, q in labels if q == x] for x in (1, 0)]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


def test_mpeg_audio(spark, texts):
    for r in LLM_QUERIES["op5_mpeg_audio"](spark, DATA).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        stored = mpeg_audio.carry(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        feature = dict(x.split("=") for x in r["feature"].split(";"))
        frames = frame_places(stored)
        assert int(feature["frames"]) == int(feature["seek_points"]) == len(frames)
        assert int(feature["seek_crc32"]) == zlib.crc32(",".join(map(str, frames)).encode())


def frame_places(data):
    """Where the audio frames begin, by their headers alone: after the tag at the start and the frame with the table."""
    at = 0
    if data[:3] == b"ID3":
        at = 10 + sum((b & 127) << 7 * (3 - i) for i, b in enumerate(data[6:10]))
    places = []
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xE0 == 0xE0:
        kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][data[at + 2] >> 4]
        rate = [44100, 48000, 32000][data[at + 2] >> 2 & 3]
        places.append(at)
        at += 144 * kbps * 1000 // rate + (data[at + 2] >> 1 & 1)
    return places[1:]


def test_pieces(spark, texts):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for i, text in texts.items():
        ids = model.encode(text or "")
        want[i] = (len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in LLM_QUERIES["op12_pieces"](spark, DATA).collect()}
    assert got == want


def test_pipeline(spark, duck, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    from emberline.llm.store import written

    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), "test-stage")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    # languages: whatever the model gives, only texts without a letter go
    model = language_id.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    seen = {r["doc_id"]: r for r in language_id.with_language(spark.read.parquet(f"{DATA}/documents.parquet"), model).collect()}
    assert set(kept[0]) == {i for i, r in seen.items() if r["_lang"] != "und"}
    # lines
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found, first = Counter(), {}
    for i in sorted(kept[0]):
        lines = (kept[0][i] or "").split("\n")
        found.update({key(x) for x in lines if key(x)})
        for n, x in enumerate(lines):
            first.setdefault(key(x), (i, n))
    want = {}
    for i, t in kept[0].items():
        lines = (t or "").split("\n")
        stay = [x for n, x in enumerate(lines) if found[key(x)] < 10 or first[key(x)] == (i, n)]
        if len(stay) == len(lines) or "\n".join(stay).strip(" \t\n\x0b\x0c\r"):
            want[i] = "\n".join(stay)
    assert kept[1] == want
    # groups
    assert set(kept[2]) == {i for i, (_, root) in components(kept[1], 5, 4, 5).items() if i == root}
    # benchmark
    windows = set()
    for (text,) in duck.sql("SELECT text FROM benchmark").fetchall():
        w = re.findall(ALNUM, text.translate(LOWER))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(x) for x in windows}
    clean = set()
    for i, t in kept[2].items():
        w = re.findall(ALNUM, (t or "").translate(LOWER))
        hit = {k for n in sizes for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for k in range(a, a + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert set(kept[3]) == clean
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect(), kept[3])


def test_the_language_found_follows_a_document_through_the_pipeline(spark):
    texts = {"en": "the house stands by the river and the children play in the garden", "de": "das haus steht am fluss und die kinder spielen im garten"}
    rows = [(i, f"{texts[x]} {i}", x) for i, x in enumerate(["en", "de"] * 30)]
    rows += [(100, f"{texts['de']} und das wasser ist kalt", "en"), (101, f"{texts['en']} and the water is cold", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = corpus_pipeline.identify_language(spark, docs, DATA)
    assert found.columns == docs.columns and found.count() == len(rows)
    pieces = corpus_pipeline.pack_sequences(spark, found, DATA).collect()
    langs = {r["doc_id"]: r["lang"] for r in pieces}
    assert (langs[100], langs[101]) == ("de", "en")
    assert [langs[i] for i in range(60)] == ["en", "de"] * 30
    assert "lang" not in corpus_pipeline.pack_sequences(spark, docs.drop("lang"), DATA).columns
