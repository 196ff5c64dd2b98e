"""Operators of the llm subpackage on small and odd tables."""

import itertools
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import chat_events, components, decontaminate, language_id, line_dedup, mpeg_audio, ngram_join, packing, quality, substring_dedup, zip_archives
from emberline.llm.words import NOT_ALNUM, WHITE, find_words, prefix, mix, shingle_sets, windows

TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, _rest string, _kept string, v long"
ODD = [
    (1, None, None, "a", None, 1),
    (2, "", "en", None, "b", None),
    (3, " \t\n \r\x0b", "en", "c", "d", 2),
    (4, "one", None, None, None, 3),
    (5, "the same text twice over and over again", "en", "x", None, 4),
    (5, "the same text twice over and over again", "en", "x", None, 4),
    (6, "The SAME text twice over and over again", "en", "y", None, 5),
    (7, LONG, "en", None, None, 6),
    (8, LONG, "en", None, None, 6),
    (None, "no id here but words all the same", "en", None, None, None),
    (9, "éé ÉÉ ß\u2003wide 42 !!", "fr", None, None, 7),
    (10, "12 34 -- ??", "fr", None, None, 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    raw = text.encode()
    return find_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WHITE, lower=False)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# words


@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x85\u2003.9", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_split_and_hashed(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    found = find_words(data, offsets, WHITE, lower=True)
    plain = data.tobytes()
    got = [[plain[s:e] for s, e in zip(found.start[a:b], found.end[a:b], strict=True)] for a, b in itertools.pairwise(found.first)]
    assert got == [r.split() for r in raw]
    lowered = [w.lower() for ws in got for w in ws]  # bytes.lower touches A-Z only
    hashes = found.hash.tolist()
    assert all((lowered[i] == lowered[j]) == (hashes[i] == hashes[j]) for i in range(len(lowered)) for j in range(i))


def test_windows_stay_inside_texts():
    raw = [b"a b c", b"b c", b"", b"a b c d"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.array([0, 5, 8, 8, 15])
    at, hashes = windows(find_words(data, offsets, WHITE, False), 3)
    assert at.tolist() == [0, 5, 6] and hashes[0] == hashes[1] != hashes[2]


# line dedup


def test_line_dedup_odd(spark, odd, empty):
    kept = line_dedup.drop_lines(odd, min_docs=2)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    got = {(r["doc_id"], r["lang"]): r["text"] for r in kept.collect()}
    assert got[1, None] is None and got[2, "en"] == "" and got[5, "en"] == "" and got[6, "en"] == "" and got[7, "en"] == ""
    assert got[3, "en"] == " \t\n \r\x0b" and got[4, None] == "one"
    assert line_dedup.drop_lines(empty).count() == 0


def test_line_dedup_first_and_bitmaps(spark):
    docs = spark.createDataFrame([(1, "x\nkeep\nX \n"), (2, "own\n x"), (3, "x\nx\nlast")], "doc_id long, text string")
    assert rows(line_dedup.drop_lines(docs, min_docs=3), "doc_id", "text") == [(1, "keep\n"), (2, "own"), (3, "last")]
    assert rows(line_dedup.drop_lines(docs, min_docs=3, keep_first=True), "doc_id", "text") == [(1, "x\nkeep\n"), (2, "own"), (3, "last")]
    bitmaps = {r["doc_id"]: (r["n_lines"], r["n_dropped"], [tuple(x) for x in r["kept"]]) for r in line_dedup.keep_bitmaps(docs, min_docs=3).collect()}
    assert bitmaps == {1: (4, 2, [(1, 1), (3, 1)]), 2: (2, 1, [(0, 1)]), 3: (3, 2, [(2, 1)])}
    assert line_dedup.drop_lines(docs.filter("doc_id > 1").union(docs.filter("doc_id = 1")), min_docs=4).exceptAll(docs).count() == 0
    assert rows(line_dedup.drop_lines(spark.createDataFrame([(i, "a") for i in range(4)], docs.schema), 2, keep_first=True, drop_emptied=True), "doc_id") == [(0,)]


def test_line_dedup_is_native(spark, odd):
    plan = line_dedup.drop_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_keep_one_tells_rows_with_one_id_apart(spark):
    near = "a b c d e f g h i j k l m n o p q r s t"
    docs = spark.createDataFrame([(1, near), (2, near), (2, "a clean text that nobody else has written so far"), (3, near + " u"), (3, near + " u"), (4, "")], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"][:7]) for r in ngram_join.keep_one(docs).collect())
    assert kept == [(1, near[:7]), (2, "a clean"), (4, "")]


def test_wide_stars_are_spread_and_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR", 4)
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"x{i}"])) for i in range(40)], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.component_ids(docs).collect()} == {0}


# decontamination


def test_decontaminate_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "text twice over"), (2, None), (3, ""), (None, "one"), (4, "W5 w6 w7"), (4, "W5 w6 w7")], "item_id long, text string")
    marked = decontaminate.judged(odd, items)
    got = {r["doc_id"]: (r["_n_words"], r["_n_hit"], r["_items"], r["_contaminated"]) for r in marked.collect()}
    assert got[1] == (0, 0, [], False) and got[4] == (1, 1, [], True)  # an item without an id hits
    assert got[5] == got[6] == (8, 3, ["1"], True)
    assert got[7] == (30_000, 93, ["4"], False)
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns
    assert rows(decontaminate.drop_contaminated(odd, items), "doc_id").count((5,)) == 0
    assert decontaminate.drop_contaminated(odd, items.limit(0)).count() == len(ODD)
    assert decontaminate.judged(empty, items).count() == 0


def test_items_without_an_id_hit_words_and_shares_are_exact(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, passage + " " + " ".join(f"o{i}" for i in range(17))), (2, passage + " o" * 18)], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage)], "item_id long, text string")
    got = {r["doc_id"]: (r["_n_hit"], r["_items"], r["_contaminated"]) for r in decontaminate.judged(docs, items, share=13 / 30).collect()}
    assert got == {1: (13, [], True), 2: (13, [], False)}


def test_decontaminate_blocks_and_similarity(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(30)] + [(100 + i, " ".join(t.split()[3:12])) for i, t in enumerate(texts[:9])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = rows(decontaminate.judged(docs, bench, window=4), "doc_id", "_n_hit", "_items")
    assert plain == rows(decontaminate.judged(docs, bench, window=4, block=7), "doc_id", "_n_hit", "_items")
    for similarity in (1.0, 0.6):
        got = {r["doc_id"]: set(r["_items"]) for r in decontaminate.judged(docs, bench, window=None, shingle=3, similarity=similarity).collect()}
        for d, text in enumerate(texts):
            w, want = text.split(), set()
            for i, item in items:
                v = item.split()
                k = min(3, len(v))
                need = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
                for a in range(len(w) - len(v) + 1):
                    here = w[a : a + len(v)]
                    have = need & {tuple(here[b : b + k]) for b in range(len(v) - k + 1)}
                    if here == v if similarity == 1 else len(have) >= similarity * len(need) - 1e-9:
                        want.add(str(i))
            assert got[d] == want


# n-gram join


def test_ngram_join_odd(odd, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.component_ids(odd, 3, (9, 10)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 6, 5), (6, 6, 5), (7, 977, 7), (8, 977, 7), (None, 6, None)} <= got
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and rows(kept, "doc_id").count((8,)) == 0 and kept.filter("doc_id = 5").count() == 1
    assert kept.filter("doc_id in (1, 2, 3)").count() == 3
    assert ngram_join.component_ids(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


@pytest.mark.parametrize("similarity", [(9, 10), (4, 5), (1, 2)])
def test_similar_sets_share_a_signature(similarity):
    rng = np.random.default_rng(5)
    bands = ngram_join.Bands(*similarity)
    for n in [1, 2, 3, 5, 9, 10, 11, 40, 41, 150, 700]:
        for _ in range(6):
            base = rng.integers(0, 2**64, n, np.uint64)
            other = base
            while True:  # take away and add members as long as the two stay similar
                cut = other[1:] if rng.random() < 0.5 else np.append(other, rng.integers(0, 2**64, 1, np.uint64))
                common = len(np.intersect1d(base, cut))
                if common * similarity[1] < (len(base) + len(cut) - common) * similarity[0]:
                    break
                other = rng.permutation(cut)
            a, b = np.unique(base), np.unique(other)
            if len(a) == len(b) and (a == b).all():
                continue
            x, y = [set(ngram_join.signatures(s, prefix(mix(s)), bands)[0].tolist()) for s in (a, b)]
            assert x & y
            bits = min(bands.sketch_bits(len(a)), bands.sketch_bits(len(b)))
            p, q = [np.frombuffer(ngram_join.parity_sketch(s, bits), np.uint8) for s in (a, b)]
            assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b)) <= bands.difference(len(a) + len(b))


def near_copies(seed, groups, copies):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(words))
    return list(enumerate(out))


@pytest.mark.parametrize("similarity", [(9, 10), (4, 5)])
def test_ngram_join_finds_all_links(spark, similarity):
    p, q = similarity
    texts = near_copies(11, 6, 25)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in texts}
    linked = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * q >= len(sets[a] | sets[b]) * p}
    ids, pairs = ngram_join.similar_sets(docs, 3, similarity)
    name = {}
    for r in ids.collect():
        name.setdefault(r["v"], []).append(r["doc_id"])
    got = {tuple(sorted((x, y))) for r in pairs.collect() for x in name[r["a"]] for y in name[r["b"]]} | {(x, y) for same in name.values() for x in same for y in same if x < y}
    assert got == linked
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.component_ids(docs, 3, similarity).collect()} == root


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (103, 103), (205, 200), (200, 205)]
    got = dict(rows(components.connected(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100, 205: 200}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# packing


def test_packing_odd(odd, empty):
    pieces = packing.token_pieces(odd, TOKENIZER, capacity=64, end_id=0)
    packed = packing.pack(pieces, capacity=64, group_rows=50)
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).filter("doc_id in (1, 2, 3)").filter("n <> 1").count() == 0
    assert packed.count() == pieces.count()
    use = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert use.filter("n > 64 or n <> end").count() == 0
    whole = packing.sequences(pieces.filter("doc_id in (4, 6, 9)"), packed)
    assert whole.filter(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0
    assert packing.pack(packing.token_pieces(empty, TOKENIZER)).count() == 0


def test_pieces_without_ids_are_spread(spark, monkeypatch):
    seen = []
    plain = packing.pack_group

    def watched(capacity, bits, last):
        seen.append(last)
        return plain(capacity, bits, last)

    monkeypatch.setattr(packing, "pack_group", watched)
    pieces = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(0 AS INT) AS piece", "CAST(0 AS BIGINT) AS start", "id % 50 + 1 AS length")
    packed = packing.pack(pieces, capacity=64, group_rows=500)
    first = packed.select((F.shiftright("sequence_id", 24)).alias("g")).filter("g % 1024 = 0").groupBy("g").count().collect()
    assert packed.count() == 3000 and seen[0] is False and len(first) >= 5


@given(st.lists(st.integers(1, 40), max_size=9))
@settings(max_examples=80, deadline=None)
def test_lower_bound_is_one(lengths):
    def best(left, bins):
        if not left:
            return len(bins)
        tries = [best(left[1:], [*bins[:i], b - left[0], *bins[i + 1 :]]) for i, b in enumerate(bins) if b >= left[0]]
        return min([*tries, best(left[1:], [*bins, 40 - left[0]])])

    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets, free = packing.best_fit_decreasing(lengths, 40)
    used = np.bincount(bins, lengths, len(free)) if len(lengths) else np.zeros(0)
    assert (used + free == 40).all() and len(free) >= packing.lower_bound(lengths, 40)
    if len(lengths) <= 7:
        assert packing.lower_bound(lengths, 40) <= best(lengths.tolist(), []) <= len(free)


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    texts = ["", "It's I'LL don'T x'ſ 's", "a\x1cb c\x85d e\xa0f", "é e\u0301 ́a <|endoftext|>b <|endof", "가 ΑΣ. İstanbul 12 a1 ªº²¼ŉ ß", "漢字 かな x" * 3, "y" * 3000]
    texts += ["".join(map(chr, range(1, 0x180))), " ".join(chr(c) + "a" + chr(c) for c in range(1, 0x250))]
    coder, whole = packing.TextIds(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text, raw in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


# substring dedup


def brute_repeats(texts, window):
    seen, out = set(), {}
    for i, (_, text) in enumerate(texts):
        words = (text or "").encode().split()
        gone = set()
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone.update(range(a, a + window))
            seen.add(key)
        out[i] = b" ".join(w for n, w in enumerate(words) if n not in gone).decode()
    return out


@pytest.mark.parametrize("window,gram", [(20, 5), (6, 3), (3, 5), (1, 1)])
def test_substring_dedup(spark, window, gram):
    rng = random.Random(window)
    line = " ".join(f"p{i}" for i in range(30))
    texts = [(i, " ".join(rng.choices("abcdef", k=rng.randint(0, 60)))) for i in range(30)]
    texts += [(30 + i, f"u{i} {line[: rng.randint(20, 80)]} t{i} {line}") for i in range(12)] + [(50, "x y z " * 40), (51, None), (52, ""), (53, "x y z " * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["_kept"] for r in substring_dedup.without_repeats(docs, window, gram).collect()}
    want = brute_repeats(texts, window)
    assert got == {i: want[n] for n, (i, _) in enumerate(texts)}


def test_substring_dedup_odd(odd, empty):
    done = substring_dedup.drop_repeats(odd, window=6, gram=3)
    assert done.columns == odd.columns and done.count() == len(ODD)
    got = rows(done, "doc_id", "text")
    assert (1, None) in got and (2, "") in got and (3, " \t\n \r\x0b") in got
    assert sorted(len(t) for i, t in got if i == 5) == [0, len(ODD[4][1])]
    assert [t for i, t in got if i == 8] == [""] and [len(t.split()) for i, t in got if i == 7] == [977]
    assert substring_dedup.without_repeats(empty).count() == 0


# language


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    scores, moves, first = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 9])
    got, expected = language_id.forward_backward(scores, first, moves, pairs=True)
    want, pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 9)):
        paths = list(itertools.product(range(3), repeat=b - a))
        weight = np.exp([sum(scores[a + t, s] for t, s in enumerate(p)) + sum(moves[x, y] for x, y in itertools.pairwise(p)) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for t, s in enumerate(p):
                want[a + t, s] += w
            for x, y in itertools.pairwise(p):
                pairs[x, y] += w
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_language_parts_and_odd(spark, odd, empty):
    rng = random.Random(4)
    said = {"aa": [f"ka{x}ro" for x in "abcdefgh"], "bb": [f"{x}enti" for x in "mnopqrst"]}
    known = [(i, " ".join(rng.choices(said[lang], k=40)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    model = language_id.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    mixed = " ".join(said["aa"] * 2 + said["bb"] * 2)
    got = language_id.with_language(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [(p["start"], p["length"], p["lang"]) for p in got["_parts"]] == [(0, 16, "aa"), (16, 16, "bb")] and abs(got["_score"] - 0.5) < 0.1
    found = language_id.with_language(odd, model)
    byid = {r["doc_id"]: (r["_lang"], r["_score"]) for r in found.collect()}
    assert byid[1] == byid[2] == byid[3] == byid[10] == ("und", 0.0) and byid[9][0] != "und"
    assert language_id.keep_identified(odd, model).columns == odd.columns
    assert language_id.keep_identified(odd, model, 0.0).count() == len(ODD) - 4
    assert language_id.with_language(empty, model).count() == 0
    none = language_id.train(empty)
    assert none is None and language_id.with_language(odd, none).filter("_lang <> 'und' or _score <> 0").count() == 0


def test_language_sample_is_distinct_texts_of_each_language(spark):
    rng = random.Random(8)
    said = {"aa": [f"ka{x}ro" for x in "abcdefgh"], "bb": [f"{x}enti" for x in "mnopqrst"], "cc": [f"ul{x}ush" for x in "bdfgkpvz"]}
    text = lambda lang: " ".join(rng.choices(said[lang], k=30))
    plain = [(text(lang), lang) for lang in ["aa"] * 1500 + ["bb"] * 60 + ["cc"] * 12]
    copies = [(plain[i][0], "aa") for i in range(40) for _ in range(50)]
    other = [(plain[0][0], "bb"), (None, "dd"), ("12 -- 3", "dd"), (text("aa"), None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(plain + copies + other)], "doc_id long, text string, lang string").repartition(5)
    taken = lambda *bounds: [(r["text"], r["lang"]) for r in language_id.fitting_rows(docs, *bounds).collect()]
    drawn = taken(72)
    assert len(dict(drawn)) == len(drawn) and set(drawn) <= set(plain)
    assert {lang: sum(x == lang for _, x in drawn) for lang in said} == {"aa": 30, "bb": 30, "cc": 12}
    few = taken(72, 3000)
    assert {lang for _, lang in few} == set(said) and sum(len(t) for t, _ in few) <= 3000 and set(few) <= set(plain)
    assert sorted(lang for _, lang in taken(72, 3)) == sorted(said)  # the shortest, where none fits
    new = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 5)]
    got = language_id.with_language(spark.createDataFrame(new, "doc_id long, text string, lang string"), language_id.train(docs, 72))
    assert {r["doc_id"]: r["_lang"] for r in got.collect()} == {i: lang for i, _, lang in new}


def test_documents_that_mix_languages_stay(spark):
    rng = random.Random(5)
    said = {"aa": [f"ka{x}ro" for x in "abcdefgh"], "bb": [f"{x}enti" for x in "mnopqrst"], "cc": [f"ul{x}ush" for x in "bdfgkpvz"], "dd": [f"g{x}yng" for x in "aeioumlr"]}
    known = [(i, " ".join(rng.choices(said[lang], k=40)), lang) for i, lang in enumerate([*said] * 30)]
    model = language_id.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, " ".join(w for words in said.values() for w in words * 2)), (2, "12 -- 3")], "doc_id long, text string")
    mixed = language_id.with_language(docs, model).filter("doc_id = 1").first()
    assert mixed["_score"] < 0.4 and mixed["_certainty"] > 0.9 and len(mixed["_parts"]) == 4
    assert [r["doc_id"] for r in language_id.keep_identified(docs, model).collect()] == [1]
    assert [r["doc_id"] for r in language_id.keep_identified(docs, model, 0.9).collect()] == [1]


# quality


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(6)
    k, n = len(quality.LABELLERS), 60_000
    good = rng.random(n) < 0.85
    right = np.linspace(0.75, 0.95, k)
    vote = np.where(rng.random((n, k)) < 0.2, quality.NONE, np.where((rng.random((n, k)) < right) == good[:, None], quality.GOOD, quality.BAD))
    patterns, counts = np.unique(quality.pattern(vote), return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.03
    assert np.allclose(model.chances[1, :, quality.GOOD] / (1 - model.chances[1, :, quality.NONE]), right, atol=0.03)
    assert ((model.posterior(vote) > 0.5) == good).mean() > 0.96


def test_quality_odd(odd, empty):
    got = quality.with_quality(odd, quality.train(odd))
    assert got.count() == len(ODD) and got.filter("_quality is null or _quality < 0 or _quality > 1 or _weak is null").count() == 0
    assert got.filter("doc_id in (1, 2, 3) and _votes > 0").count() == 0
    assert quality.with_quality(empty, quality.train(empty)).count() == 0


def test_quality_sample_is_distinct_texts_with_words(spark):
    rng = random.Random(3)
    fair = [" ".join(rng.choices(["river", "stone", "garden", "letter", "window", "morning"], k=30)) for _ in range(60)]
    junk = [" ".join(rng.choices(["$$$", "BUY!!", "<<NOW>>", "***", "{}#@"], k=30)) for _ in range(60)]
    copies = {t: 300 if i == 0 else 1 for i, t in enumerate(fair + junk)}
    rows = [(t,) for t, n in copies.items() for _ in range(n)] + [(None,)] * 400 + [("",), (" \n\t",)] * 50
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id long, text string").repartition(5)
    taken = lambda *bounds: [(r["text"], r["weight"]) for r in quality.fitting_texts(docs, *bounds).collect()]
    drawn = taken(40)
    assert sum(len(t) for t, _ in taken(40, 8000)) <= 8000
    assert len(drawn) == len(dict(drawn)) == 40 and set(dict(drawn)) <= set(copies)
    assert dict(drawn)[fair[0]] == 300 and 60 < sum(dict(drawn).values()) - 300 < 240  # stands for the 119 others
    assert dict(taken(500)) == copies
    scores = {r["text"]: r["_quality"] for r in quality.with_quality(docs, quality.train(docs, 40)).collect()}
    assert min(scores[t] for t in fair) > max(scores[t] for t in junk)


def test_label_model_is_the_plain_expectation_maximisation():
    """The pattern counts give the same model as a loop over single documents."""
    rng = np.random.default_rng(9)
    k = len(quality.LABELLERS)
    vote = rng.integers(0, 3, (400, k))
    patterns, counts = np.unique(quality.pattern(vote), return_counts=True)
    got = quality.fit_labels(patterns, counts.astype(float), turns=5)
    prior, chance = 0.8, np.tile(np.array([[[0.4, 0.5, 0.1]], [[0.1, 0.5, 0.4]]]), (1, k, 1))
    for _ in range(5):
        good = []
        for row in vote.tolist():
            yes, no = prior, 1 - prior
            for i, v in enumerate(row):
                yes, no = yes * chance[1, i, v], no * chance[0, i, v]
            good.append(yes / (yes + no))
        sums = np.ones((2, k, 3))
        for row, g in zip(vote.tolist(), good, strict=True):
            for i, v in enumerate(row):
                sums[0, i, v] += 1 - g
                sums[1, i, v] += g
        prior, chance = (sum(good) + 1) / (len(vote) + 2), sums / sums.sum(axis=2, keepdims=True)
    assert abs(got.prior - prior) < 1e-9 and np.allclose(got.chances, chance)


# MPEG audio


@given(st.binary(max_size=4000))
@settings(max_examples=60, deadline=None)
def test_mpeg_round_trip(payload):
    data = mpeg_audio.carry(payload)
    stream = mpeg_audio.parse(data)
    assert stream.offsets[0] >= 0
    if b"\xff" not in payload:
        assert stream.skipped_bytes == 0
    assert mpeg_audio.payload_of(data, stream) == payload
    assert stream.bad_checksums == 0 and stream.checked == len(stream.offsets) + 1 == stream.table["frames"] + 1
    assert stream.duration == Fraction(1152 * len(stream.offsets), 48000)


@pytest.mark.parametrize("size", [300, 800, 937, 4000])
@pytest.mark.parametrize("flags", [0, 0x80000000])
def test_mpeg_payload_may_look_like_a_tag(size, flags):
    plain = mpeg_audio.carry(b"x" * size)
    pad = len(plain) - plain.rindex(b"x") - 1
    final = mpeg_audio.parse(plain).sizes[-1]
    looks = [(128, b"TAG")] + [(32, b"APETAGEX" + struct.pack("<IIII", 2000, n, 1, flags)) for n in (32, 200, final - 32, final, 10**6)]
    looks += [(160, b"APETAGEX" + struct.pack("<IIII8x", 2000, max(final - 128, 32), 1, flags) + b"TAG")]
    for place, mark in looks:
        at = size - (place - pad)
        if at + len(mark) > size or at < 0:
            continue
        payload = b"x" * at + mark + b"x" * (size - at - len(mark))
        data = mpeg_audio.carry(payload)
        assert data[len(data) - place :].startswith(mark)
        for tail in (b"", b"TAG" + bytes(125), b"APETAGEX" + struct.pack("<IIII8x", 2000, 32, 0, 0) + b"TAG" + bytes(125)):
            stream = mpeg_audio.parse(data + tail)
            assert mpeg_audio.payload_of(data + tail, stream) == payload and stream.skipped_bytes == 0
        with pytest.raises(ValueError):
            mpeg_audio.facts(data[:-1])


def test_mpeg_damage_and_tables():
    good = mpeg_audio.carry(b"abc" * 2000)
    clean = mpeg_audio.parse(good)
    noisy = b"noise\xff\xfb" + good[: clean.offsets[2]] + b"\xff\xfa\x00\xffxx" + good[clean.offsets[2] :] + b"APETAGEX" + struct.pack("<IIII8x", 2000, 32, 0, 0) + b"TAG" + bytes(125)
    again = mpeg_audio.parse(noisy)
    assert len(again.offsets) == len(clean.offsets) and again.skipped_bytes > 6 and again.table == clean.table
    flipped = bytearray(good)
    flipped[clean.offsets[1] + 4] ^= 1
    assert mpeg_audio.parse(bytes(flipped)).bad_checksums == 1
    assert clean.seek(Fraction(0)) == clean.offsets[0] and clean.seek(Fraction(10)) == clean.offsets[-1]
    frame = bytearray(bytes((0xFF, 0xFB, 0xE4, 0xC0)).ljust(960, b"\0"))
    frame[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 2880, 2, 2, 1, 2, 1)
    frame[62:66] = struct.pack(">HH", 960, 960)
    plain = bytes((0xFF, 0xFB, 0xE4, 0xC0)).ljust(960, b"\0")
    vbri = mpeg_audio.parse(bytes(frame) + plain * 2)
    assert vbri.table == {"kind": "VBRI", "frames": 2, "bytes": 2880, "steps": [960, 960], "frames_per_step": 1} and vbri.offsets == [960, 1920]
    nothing = mpeg_audio.parse(b"no audio at all \xff\xff\xff")
    assert nothing.duration is None and nothing.seek(Fraction(1)) is None
    tagged = mpeg_audio.parse(b"ID3\x04\0\0" + bytes((0, 0, 0, 14)) + b"TIT2" + bytes((0, 0, 0, 4, 0, 0)) + b"\x03\xc3\xa9\0" + plain)
    assert tagged.tags == {"TIT2": "é"} and tagged.offsets == [24]


def test_mpeg_odd(odd, empty):
    back = mpeg_audio.with_facts(mpeg_audio.stored(odd))
    got = {r["doc_id"]: r for r in back.collect()}
    assert back.count() == len(ODD) and got[1]["n_bytes"] == 0 and got[1]["facts"]["payload_bytes"] == 192
    assert got[7]["facts"]["media_sha256"] == got[8]["facts"]["media_sha256"] and got[7]["facts"]["frames"] == len(got[7]["facts"]["seek_offsets"])
    assert mpeg_audio.with_facts(mpeg_audio.stored(empty)).count() == 0


# ZIP archives


@pytest.mark.parametrize("zip64", [False, True])
def test_package_reads_ranges(zip64):
    import io
    import zipfile

    records = [zip_archives.build_record(i, f"http://a/{i} b", b"payload %d" % i, "0" * 64, None if i % 2 else 7) for i in range(5)]
    warc = b"".join(records)
    at = np.cumsum([0, *map(len, records)]).tolist()
    index = "\n".join(zip_archives.index_line("http://a/", "a.warc", a, b - a) for a, b in itertools.pairwise(at)).encode()
    data = zip_archives.build_package([("archive/a.warc", warc), (zip_archives.INDEX, index), ("é.txt", b"")], zip64)
    assert zipfile.ZipFile(io.BytesIO(data)).read("archive/a.warc") == warc  # others read it too
    reads = []
    package = zip_archives.Package(lambda a, n: reads.append(n) or data[a : a + n], len(data))
    assert list(package.members) == ["archive/a.warc", zip_archives.INDEX, "é.txt"]
    assert list(package.walk()) == package.index()
    assert [r.fields["warc-type"] for r in package.records()] == ["revisit", "response"] * 2 + ["revisit"]
    assert [r.payload for r in package.records()][1] == b"payload 1" and package.range("archive/a.warc", at[3], 5) == b"WARC/"
    with pytest.raises(ValueError):
        package.range("archive/a.warc", at[-1], 1)
    with pytest.raises(ValueError):
        zip_archives.Package(lambda a, n: data[a : a + n], len(data) - 1)
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", warc * 20)
        z.comment = b"PK\x05\x06 in a comment"
    raw = squeezed.getvalue()
    with pytest.raises(ValueError):
        zip_archives.Package(lambda a, n: raw[a : a + n], len(raw)).range("archive/a.warc", 0, 1)


def test_archives_odd(spark):
    long = "p" * 100
    pages = [(3, "http://x/ y", long, 1), (1, None, long, 2), (2, "u", None, 3), (4, "u", "", 4), (5, "u", "p" * 99, 5), (6, "u", "p" * 99, 6), (7, "é\r\n", "é" * 50, 7), (8, "u", "é" * 50, 8), (None, "u", long, 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest long")
    stored = zip_archives.archived(df.repartition(2), package_bytes=900, member_bytes=400)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in zip_archives.records(stored).collect()}
    assert stored.count() > 2 and got == {
        1: (100, "response", None), 2: (0, "response", None), 3: (100, "revisit", 1), 4: (0, "response", None), 5: (99, "response", None),
        6: (99, "response", None), 7: (100, "response", None), 8: (100, "revisit", 7), None: (100, "revisit", 1),
    }
    assert zip_archives.records(zip_archives.archived(df.limit(0))).count() == 0


# chats


@given(st.text(alphabet="\\<|s>/[INST]im_endar\n é", max_size=40), st.text(alphabet="us\\er\n<|im_start|>", max_size=12))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(text, role):
    rendered, begin, end = chat_events.render(role, text)
    assert chat_events.read_message(rendered) == (role, text) and chat_events.unescape(rendered[begin:end]) == text
    assert not chat_events.FORBIDDEN.search(rendered[begin:end])


def test_fold_of_events(spark):
    log = [
        (1, 3, "b", "delta", None, "to "), (1, 1, "a", "open", "user", None), (1, 2, "a", "delta", None, "hi"), (1, 4, "b", "open", "assistant", None),
        (1, 5, "b", "delta", None, "throw"), (1, 6, "b", "regenerate", None, None), (1, 7, "b", "delta", None, "keep "), (1, 9, "b", "delta", None, "this"),
        (1, 8, "a", "edit", None, "hello"), (2, 1, "a", "delta", None, None), (None, 1, "z", "open", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string").repartition(3)
    got = rows(chat_events.messages(df), "conv_id", "message", "role", "text")
    assert got == [(1, "a", "user", "hello"), (1, "b", "assistant", "keep this"), (2, "a", "", ""), (None, "z", "", "")]
    masked = chat_events.messages(df).filter("mask_start is not null").collect()
    assert [(r["rendered"][r["mask_start"] : r["mask_end"]]) for r in masked] == ["keep this"]
    assert chat_events.messages(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_events.fold(iter([("other", None, None)]))


def test_event_log_folds_back(spark):
    turns = [(1, 1, "assistant", "x" * 950), (1, 0, "user", None), (1, None, None, "n"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", "\\n<s>"), (-7, 10, "user", ""), (-7, 9, "assistant", "é")]
    df = spark.createDataFrame([(*t, i) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string, seq int")
    got = chat_events.messages(chat_events.event_log(df))
    assert rows(got, "conv_id", "role", "text") == sorted(((c, r or "", t or "") for c, _, r, t in turns), key=str)
    order = [(r["conv_id"], r["text"][:1]) for r in got.orderBy("conv_id", "message").collect()]
    assert order == [(-7, "é"), (-7, ""), (1, "n"), (1, ""), (1, "x"), (2, "\\"), (2, "a"), (2, "a")]
    counts = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_events.conversation_digests(got).collect()}
    assert counts == {-7: (2, 1), 1: (3, 950), 2: (3, 5)}
    assert chat_events.conversation_digests(chat_events.messages(chat_events.event_log(df.limit(0)))).count() == 0


def test_sets_of_short_texts():
    sets = shingle_sets(words_of("a b"), 3) + shingle_sets(words_of("a b c"), 3) + shingle_sets(words_of(""), 3)
    assert [len(s) for s in sets] == [1, 1, 0] and sets[0][0] != sets[1][0]
    assert NOT_ALNUM[ord("A")] and not NOT_ALNUM[ord("a")]


def test_event_log_grows_with_the_text(spark):
    """Deltas are cut in one pass: code points beyond 16 bits stay whole, and a long text costs no more than its length."""
    text = "ab\n🙂é" * 150_000
    turns = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", ""), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    log = chat_events.event_log(turns)
    got = {r["message"][19:20]: r["text"] for r in chat_events.messages(log).collect()}
    assert list(got.values()).count("") == 2 and text in got.values()
    sizes = [len(r["text"]) for r in log.filter("kind = 'delta' and length(text) > 40").select("text").collect()]
    assert max(sizes) == chat_events.EVENT_TEXT and sum(sizes) == len(text)


@pytest.mark.parametrize("compressed", [True, False])
def test_packages_in_files_are_read_by_ranges(spark, tmp_path, compressed):
    pages = spark.createDataFrame([(i, f"http://Host{i % 3}/p?{i}", ("page é " * (i % 7) * 30) or None) for i in range(60)], "page_id long, url string, html string")
    packed = zip_archives.packages(pages.coalesce(2), package_bytes=20_000, member_bytes=4_000, compressed=compressed).collect()
    for r in packed:
        (tmp_path / r["package"]).write_bytes(r["bytes"])
    paths = spark.createDataFrame([(str(tmp_path / r["package"]),) for r in packed], "path string")
    columns = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    got = rows(zip_archives.file_records(paths), *columns)
    assert got == rows(zip_archives.records(spark.createDataFrame(packed)), *columns) and len(got) == 60
    assert {r[0]: r[6] for r in got if r[4] == "response"} == {i: (("page é " * (i % 7) * 30)).encode() for i in range(60) if i < 7 or i % 7 == 0}

    # ranges only: never more of a package than a directory, an index or a record
    raw, asked = packed[0]["bytes"], []
    package = zip_archives.Package(lambda at, n: asked.append(n) or raw[at : at + n], len(raw))
    listed = package.index()
    assert sorted(listed) == sorted(package.walk())
    asked.clear()
    assert len(list(package.records())) == len(listed) and max(asked) < len(raw) / 2


def test_a_package_with_a_deflated_index(spark):
    import io
    import zipfile

    record = zip_archives.build_record(5, "http://a/b", b"text", __import__("hashlib").sha256(b"text").hexdigest(), None)
    data, place = zip_archives.gzipped(record), io.BytesIO()
    with zipfile.ZipFile(place, "w") as file:
        file.writestr("archive/x.warc.gz", zip_archives.gzipped(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n") + data)
        at = file.getinfo("archive/x.warc.gz").file_size - len(data)
        file.writestr("indexes/index.cdxj", '!meta {"format": "cdxj"}\n' + zip_archives.index_line("http://a/b", "x.warc.gz", at, len(data)), zipfile.ZIP_DEFLATED)
        file.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
    got = zip_archives.records(spark.createDataFrame([(bytearray(place.getvalue()),)], "bytes binary")).collect()
    assert [(r["page_id"], r["url"], bytes(r["payload"]), r["record_type"]) for r in got] == [(5, "http://a/b", b"text", "response")]
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as file:
        file.writestr("archive/x.warc.gz", data)
    package = zip_archives.Package(lambda at, n: bare.getvalue()[at : at + n], len(bare.getvalue()))
    assert [r.payload for r in package.records()] == [b"text"]


def test_frequent_lines_are_matched_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(["all", f"some {i % 3}", f"own {i}", "all"])) for i in range(60)], "doc_id long, text string").repartition(4)
    want = rows(line_dedup.drop_lines(docs, min_docs=10, keep_first=True), "doc_id", "text")
    assert dict(want) == {i: "\n".join([*(["all"] if i == 0 else []), *([f"some {i}"] if i < 3 else []), f"own {i}"]) for i in range(60)}
    for parts in (1, 10, 100_000):
        monkeypatch.setattr(line_dedup, "HOT_PARTS", parts)
        assert rows(line_dedup.drop_lines(docs, min_docs=10, keep_first=True), "doc_id", "text") == want
