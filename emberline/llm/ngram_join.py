"""Jaccard join of documents on their word n-grams through PartEnum signatures.

Sets are put into bands of sizes such that similar sets lie in one band or in neighbouring ones. Within two neighbouring
bands a similarity ``p / q`` bounds the symmetric difference by ``k = (q - p) * (s + t) / (q + p)``. The hashed feature domain is cut
into ``n1`` partitions, each of ``n2`` parts; some partition of two similar sets holds at most ``m = k // n1`` differences, so the
two agree on one of the subsets of ``n2 - m`` parts of it. A signature is the hash of a set's features in one such subset:
similar sets share one, whatever the rest.

Equal sets are one vertex from the start, so copies are never paired. Sets that share a signature meet in a bucket of bounded
size. A bucket pairs its members with its least one; after these pairs are verified on the whole sets and merged into components, only
members of *different* components in a bucket are compared, by parity sketches whose distance never exceeds the symmetric
difference, and only what that exact bound leaves is verified: first the nearest pair of any two components, then all that is left. So a group of thousands of near copies costs a star, not all pairs,
and no link between components is lost.

Defined results: documents without words or text have an empty set and link with nothing; equal sets link; repeated rows and
rows that share a ``doc_id`` stand each for its own text; a null ``doc_id`` is not a representative unless all of its class are null;
an empty table gives none. Vertices are 64-bit hashes of sets, shingles 64-bit hashes of words.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.components import connected
from emberline.llm.store import packed, slices, unpacked, written
from emberline.llm.words import WHITE, find_words, mix, prefix, shingle_sets, stretches

SLICE_BYTES = 2 << 20
BUCKET_ENTRIES = 1_000_000
BROADCAST_IDS = 250_000  # a few MB; beyond it the texts are shuffled
LEAST_BUCKETS = 64  # so that small inputs use many tasks too
COMPARED_ROWS = 512  # rows of a group compared with all others at once, fewer in a large group
COMPARED_CELLS = 1 << 20
STAR = 256  # partners of a set that one task compares with it
PARTS = 3  # second-level parts of a partition; one of them may differ
SEED = np.uint64(0x2545F4914F6CDD1D)


class Bands:
    """Size bands and difference bounds for the similarity ``p / q``."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.ends = p, q, [0]
        while self.ends[-1] < 1 << 40:
            low = self.ends[-1] + 1
            self.ends.append(low * q // p)

    def band(self, n: int) -> int:
        return bisect_left(self.ends, n)

    def difference(self, total: int) -> int:
        """The largest symmetric difference of similar sets with ``total`` members together."""
        return (self.q - self.p) * total // (self.q + self.p)

    def bound(self, band: int) -> int:
        """``k`` for sets of the band and the next one."""
        return self.difference(self.ends[band] + self.ends[band + 1])

    def sketch_bits(self, n: int) -> int:
        return 1 << max(6, (5 * self.bound(self.band(n)) - 1).bit_length())

    def signature_count(self, n: int) -> int:
        return sum(signature_number(self.bound(b)) for b in (self.band(n) - 1, self.band(n)) if b > 0)


def signature_number(k: int) -> int:
    """Signatures of a set where ``k`` members may differ; equal sets (``k = 0``) are one vertex and need none."""
    return PARTS * -(-(k + 1) // 2) if k else 0


@cache
def kept_parts() -> np.ndarray:
    return np.array(list(combinations(range(PARTS), PARTS - 1)))


def signatures(members: np.ndarray, mixed: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a set, given as sorted hashes and the prefix sums of the mixed hashes, and which of them are weak: their
    parts hold no member at all, as those of many unlike sets."""
    out, weak = [], []
    band = bands.band(len(members))
    for b in (band - 1, band):
        k = bands.bound(b) if b > 0 else 0
        if not k:
            continue
        parts = PARTS * -(-(k + 1) // 2)
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        cuts = np.concatenate([[0], np.searchsorted(members, edges), [len(members)]])
        sums = mix(mixed[cuts[1:]] - mixed[cuts[:-1]] + np.arange(parts, dtype=np.uint64) * SEED).reshape(-1, PARTS)
        subsets = kept_parts()
        total = sums[:, subsets].sum(axis=2, dtype=np.uint64) + np.arange(len(subsets), dtype=np.uint64) * SEED
        out.append(mix(total.ravel() + np.array([b], np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        weak.append((np.diff(cuts).reshape(-1, PARTS)[:, subsets].sum(axis=2) == 0).ravel())
    return (np.concatenate(out), np.concatenate(weak)) if out else (np.zeros(0, np.uint64), np.zeros(0, bool))


def vertex(members: np.ndarray, mixed: np.ndarray) -> int:
    return int(mix(mixed[-1:] + np.array([len(members)], np.uint64) * SEED).view(np.int64)[0])


def parity_sketch(members: np.ndarray, bits: int) -> bytes:
    """Bit ``i`` is the parity of the members with low bits ``i``: it changes with at most as many bits as members differ."""
    places = (members & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def document_sets(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """``doc_id, v, n, sketch, weak`` per document: vertex (null for the empty set), set size, parity sketch, weak signatures."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n, sketches, weak = [], [], [], []
            for _, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                for members in shingle_sets(find_words(data, offsets, WHITE, lower=True), size):
                    n.append(len(members))
                    if not len(members):
                        v.append(None)
                        sketches.append(None)
                        weak.append(None)
                        continue
                    mixed = prefix(mix(members))
                    sigs, empty = signatures(members, mixed, bands)
                    v.append(vertex(members, mixed))
                    sketches.append(parity_sketch(members, bands.sketch_bits(len(members))))
                    weak.append(sigs[empty].view(np.int64).tolist())
            columns = [batch.column("doc_id"), pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(weak, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "n", "sketch", "weak"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {kind}, v long, n long, sketch binary, weak array<long>")


def signature_blobs(docs: DataFrame, size: int, bands: Bands, buckets: int) -> DataFrame:
    """The signatures of each slice that are not weak, by bucket: ``bucket, vs, counts, sigs``, with each vertex once and its signatures after one another."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                vs, all_sigs, seen = [], [], set()
                for members in shingle_sets(find_words(data, offsets, WHITE, lower=True), size):
                    if not len(members):
                        continue
                    mixed = prefix(mix(members))
                    v = vertex(members, mixed)
                    if v not in seen:
                        seen.add(v)
                        vs.append(v)
                        found, empty = signatures(members, mixed, bands)
                        all_sigs.append(found[~empty])
                sigs = np.concatenate(all_sigs) if all_sigs else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(len(vs)), [len(s) for s in all_sigs]) if vs else np.zeros(0, np.int64)
                bucket = (sigs % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                there, begin = np.unique(bucket[order], return_index=True)
                short, names = (sigs >> np.uint64(32)).astype("<u4"), np.array(vs, "<i8")
                columns: tuple[list, list, list] = ([], [], [])
                for a, b in stretches(begin, len(order)):
                    mine, counts = np.unique(owner[order[a:b]], return_counts=True)
                    columns[0].append(names[mine].tobytes())
                    columns[1].append(counts.astype("<u4").tobytes())
                    columns[2].append(short[order[a:b]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(there), *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "vs", "counts", "sigs"])

    return docs.select("text").mapInArrow(build, "bucket long, vs binary, counts binary, sigs binary")


def shared_signatures(group: pa.Table) -> pa.Table:
    """The groups of two or more vertices with one signature: members side by side, and sizes."""
    blob = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    v, sig = np.repeat(blob("vs", "<i8"), blob("counts", "<u4")), blob("sigs", "<u4")
    order = np.lexsort((v, sig))
    v, sig = v[order], sig[order]
    fresh = np.concatenate([[True], (v[1:] != v[:-1]) | (sig[1:] != sig[:-1])]) if len(v) else np.zeros(0, bool)
    v, sig = v[fresh], sig[fresh]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(v) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(v)))
    many = np.repeat(sizes > 1, sizes)
    return pa.table(
        {
            "bucket": group.column("bucket").slice(0, 1),
            "members": pa.array([v[many].astype("<i8").tobytes()], pa.binary()),
            "sizes": pa.array([sizes[sizes > 1].astype("<u4").tobytes()], pa.binary()),
        }
    )


def star_pairs(groups: DataFrame) -> DataFrame:
    """Each member of a group with the least one, once per bucket."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, sizes in zip(batch.column("members").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                v, size = np.frombuffer(members, "<i8"), np.frombuffer(sizes, "<u4").astype(np.int64)
                first = np.cumsum(size) - size
                pairs = np.stack([np.repeat(v[first], size), v], axis=1) if len(v) else np.zeros((0, 2), np.int64)
                pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    return groups.mapInArrow(pair, "a long, b long").distinct()


def folded(sketch: np.ndarray, length: int) -> np.ndarray:
    """A sketch cut to fewer bits: positions that fall together add their parities."""
    while len(sketch) > length:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def close_pairs(pairs: DataFrame, facts: DataFrame, bands: Bands) -> DataFrame:
    """The pairs ``a, b`` that sizes and sketches do not exclude."""
    p, q = bands.p, bands.q
    left = facts.select(F.col("v").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_s"))
    right = facts.select(F.col("v").alias("b"), F.col("n").alias("_m"), F.col("sketch").alias("_t"))
    both = pairs.join(left, "a").join(right, "b").filter(F.abs(F.col("_n") - F.col("_m")) * (p + q) <= (F.col("_n") + F.col("_m")) * (q - p))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = batch.column("_s").to_pylist(), batch.column("_t").to_pylist()
            total = (batch.column("_n").to_numpy() + batch.column("_m").to_numpy()).tolist()
            keep = []
            for x, y, n in zip(s, t, total, strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                length = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, length) ^ folded(y, length)).sum()) <= bands.difference(n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(judge, "a long, b long")


def compared(sketches: list[bytes], sizes: np.ndarray, bands: Bands, comps: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs ``i < j`` of a group (of different components, if given) that sizes and sketches do not exclude, with their sketch
    distances. Rows are compared in blocks, so memory is bounded."""
    raw = [np.frombuffer(s, np.uint8) for s in sketches]
    length, n = min(map(len, raw)), len(raw)
    bits = np.stack([folded(x, length) for x in raw]).view(np.uint64)
    step = max(8, min(COMPARED_ROWS, COMPARED_CELLS // n))
    for low in range(0, n, step):
        rows = slice(low, min(low + step, n))
        limit = (bands.q - bands.p) * (sizes[rows, None] + sizes[None, :]) // (bands.q + bands.p)
        near = (np.abs(sizes[rows, None] - sizes[None, :]) <= limit) & (np.arange(low, rows.stop)[:, None] < np.arange(n)[None, :])
        if comps is not None:
            near &= comps[rows, None] != comps[None, :]
        i, j = np.nonzero(near)
        for cut in range(0, len(i), 1 << 16):
            x, y = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            distance = np.bitwise_count(bits[low + x] ^ bits[y]).sum(axis=1)
            ok = distance <= limit[x, y]
            yield low + x[ok], y[ok], distance[ok].astype(np.int64)


def weak_groups(bands: Bands):
    """The groups of weak signatures, cut down to members for which sizes and sketches leave a partner."""

    def live(group: pa.Table) -> pa.Table:
        sig, v, n = (group.column(c).to_numpy() for c in ("sig", "v", "n"))
        sketches, order = group.column("sketch").to_pylist(), np.lexsort((v, sig))
        begin = np.flatnonzero(np.concatenate([[True], sig[order][1:] != sig[order][:-1]]))
        members, sizes = [], []
        for a, b in stretches(begin, len(order)):
            some = order[a:b]
            if len(some) > 1:
                kept = np.zeros(len(some), bool)
                for i, j, _ in compared([sketches[k] for k in some], n[some], bands):
                    kept[i] = kept[j] = True
                if kept.any():
                    members.append(v[some[kept]])
                    sizes.append(int(kept.sum()))
        packed_members = np.concatenate(members).astype("<i8").tobytes() if members else b""
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "members": pa.array([packed_members], pa.binary()), "sizes": pa.array([np.array(sizes, "<u4").tobytes()], pa.binary())})

    return live


def unresolved(members: pa.Table, comps: pa.Table) -> pa.Table:
    """The groups of a bucket whose members are in several components."""
    if not members.num_rows or not comps.num_rows:
        return members.slice(0, 0)
    known = comps.column("v").to_numpy()
    order = np.argsort(known)
    v = np.frombuffer(members.column("members")[0].as_py(), "<i8")
    sizes = np.frombuffer(members.column("sizes")[0].as_py(), "<u4").astype(np.int64)
    comp, first = comps.column("comp").to_numpy()[order][np.searchsorted(known[order], v)], np.cumsum(sizes) - sizes
    many = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first) if len(first) else np.zeros(0, bool)
    if not many.any():
        return members.slice(0, 0)
    kept = pa.array([v[np.repeat(many, sizes)].tobytes()], pa.binary()), pa.array([sizes[many].astype("<u4").tobytes()], pa.binary())
    return pa.table({"bucket": members.column("bucket"), "members": kept[0], "sizes": kept[1]})


def bucket_pairs(bands: Bands, nearest: bool):
    """Of a bucket, the pairs of different components that sizes and sketches do not exclude; with ``nearest`` only the one with
    the least sketch distance of any two components."""

    def pair(members: pa.Table, facts: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []  # a, b, and the two components and the distance
        if members.num_rows and facts.num_rows:
            known = facts.column("v").to_numpy()
            order = np.argsort(known)
            comp, size = facts.column("comp").to_numpy()[order], facts.column("n").to_numpy()[order]
            sketches = facts.column("sketch").to_pylist()
            v = np.frombuffer(members.column("members")[0].as_py(), "<i8")
            at = np.searchsorted(known[order], v)
            sizes = np.frombuffer(members.column("sizes")[0].as_py(), "<u4").astype(np.int64)
            done = set()
            for begin, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                group = at[begin : begin + n]
                if (key := group.tobytes()) in done:
                    continue
                done.add(key)
                for i, j, distance in compared([sketches[order[k]] for k in group], size[group], bands, comp[group]):
                    ends = np.sort(np.stack([comp[group[i]], comp[group[j]]], axis=1), axis=1)
                    out.append(np.column_stack([v[begin + i], v[begin + j], ends, distance]))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 5), np.int64)
        if nearest and len(pairs):
            pairs = pairs[np.lexsort((pairs[:, 4], pairs[:, 3], pairs[:, 2]))]
            pairs = pairs[np.concatenate([[True], (pairs[1:, 2:4] != pairs[:-1, 2:4]).any(axis=1)])]
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})

    return pair


def bucket_members(groups: DataFrame) -> DataFrame:
    """``bucket, v``: each member of a bucket's groups once."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("members").to_pylist(), strict=True):
                v = np.unique(np.frombuffer(raw, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), bucket)), pa.array(v)], ["bucket", "v"])

    return groups.select("bucket", "members").mapInArrow(members, "bucket long, v long")


def candidate_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``v, members``: the sets of the representatives in ``wanted`` (``doc_id``)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                sets = [s for s in shingle_sets(find_words(data, offsets, WHITE, lower=True), size) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([vertex(s, prefix(mix(s))) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["v", "members"]
                )

    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    near = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(wanted["_id"]), "left_semi")
    return near.select("text").mapInArrow(build, "v long, members binary")


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs ``a, b`` that are similar, on the whole sets. The sets of an ``a`` and its partners stream through one task;
    an ``a`` with more than ``STAR`` partners is spread over as many as they need."""
    pairs = written(pairs, "pairs")
    wide = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("_tasks")).filter("_tasks > 1")
    spread = pairs.join(wide, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_tasks", F.lit(1).cast("long"))).alias("_salt"))
    wanted = spread.select("a", "_salt", F.col("b").alias("v")).union(spread.select("a", "_salt", F.col("a").alias("v")).distinct())
    rows = wanted.join(sets, "v").withColumn("_rest", F.col("v") != F.col("a"))
    streams = rows.repartition("a", "_salt").sortWithinPartitions("a", "_salt", "_rest")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base = None, None
        for batch in batches:
            a, v, members = batch.column("a").to_pylist(), batch.column("v").to_pylist(), batch.column("members").to_pylist()
            left, right = [], []
            for x, y, raw in zip(a, v, members, strict=True):
                if x == y:
                    held, base = x, np.frombuffer(raw, "<u8")
                    continue
                if held != x:
                    raise ValueError("the set of a pair is missing")
                other = np.frombuffer(raw, "<u8")
                small, large = (base, other) if len(base) < len(other) else (other, base)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if common * bands.q >= (len(base) + len(other) - common) * bands.p:
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return streams.select("a", "v", "members").mapInArrow(judge, "a long, b long").distinct()


def classes(docs: DataFrame, size: int, similarity: tuple[int, int], every_link: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets per document, components of vertices, links between vertices (all of them if ``every_link``)."""
    spark, bands = docs.sparkSession, Bands(*similarity)
    sets = written(document_sets(docs, size, bands), "sets")
    facts = written(sets.filter("v is not null").groupBy("v").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("weak").alias("weak")), "facts")
    # every size is known, so the number of signatures is too: 0.1 to 1 for a shingle
    per_size = facts.groupBy("n").count().withColumn("sigs", F.col("count") * F.col("n")).agg(F.sum("sigs")).first()[0] or 0
    rate = 3.2 * (bands.q - bands.p) / (bands.q + bands.p) * PARTS
    buckets = max(LEAST_BUCKETS, math.ceil(per_size * rate / BUCKET_ENTRIES))
    shape = "bucket long, members binary, sizes binary"
    strong = signature_blobs(docs, size, bands, buckets).groupBy("bucket").applyInArrow(shared_signatures, shape)
    # weak signatures bring their sketches along, so that sets with nothing in common do not become candidates
    entries = facts.select("v", "n", "sketch", F.explode("weak").alias("sig")).withColumn("bucket", -1 - F.pmod("sig", F.lit(buckets)))
    weak = entries.groupBy("bucket").applyInArrow(weak_groups(bands), shape)
    groups = written(strong.union(weak).filter(F.octet_length("members") > 0), "groups")
    wanted = written(bucket_members(groups).select("v").distinct().join(facts.select("v", "rep"), "v").select(F.col("rep").alias("_id")).distinct(), "wanted")
    held = written(candidate_sets(docs, wanted, size), "members")
    no_links = spark.createDataFrame([], "a long, b long")
    links = no_links if every_link else written(verified(close_pairs(star_pairs(groups), facts, bands), held, bands), "links")
    roots = connected(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # the nearest pair of any two components first, which merges most; then every pair that is left between components
    for nearest in (False,) if every_link else (True, False):
        labelled = facts.join(roots.select(F.col("node").alias("v"), "root"), "v", "left").select("v", "n", "sketch", F.coalesce("root", "v").alias("comp"))
        comps = bucket_members(groups).join(labelled.select("v", "comp"), "v")
        groups = written(groups.groupBy("bucket").cogroup(comps.groupBy("bucket")).applyInArrow(unresolved, shape), "groups")
        known = bucket_members(groups).join(labelled, "v").select("bucket", "v", "n", "comp", "sketch")
        rest = groups.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(bucket_pairs(bands, nearest), "a long, b long").distinct()
        more = written(verified(rest, held, bands), "links")
        if not more.isEmpty():
            links = links.union(more)
            edges = more.select(F.col("a").alias("u"), F.col("b").alias("v"))
            roots = connected(edges.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    return sets, roots, links


def component_ids(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and the vertex ``v`` of every document: the least id it is linked with, directly or not."""
    sets, roots, _ = classes(docs, size, similarity, every_link=False)
    rooted = sets.select("doc_id", "n", "v").join(roots.select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = rooted.filter("v is not null").groupBy("root").agg(F.min("doc_id").alias("_least"))
    return rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"), "v")


def similar_sets(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> tuple[DataFrame, DataFrame]:
    """The whole join: ``doc_id, n, v`` of every document, and all pairs ``a, b`` of different similar sets."""
    sets, _, links = classes(docs, size, similarity, every_link=True)
    return sets.select("doc_id", "n", "v"), links


def with_vertex(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (with a ``text``) and the vertex ``_v`` of each, null for an empty set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = []
            for _, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(find_words(data, offsets, WHITE, lower=True), size)
                v += [vertex(s, prefix(mix(s))) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v, pa.int64())], [*batch.schema.names, "_v"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(build, f"{shape}, _v long")


def keep_one(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One document of each component, the one with the least ``doc_id``; documents with an empty set all stay.

    Rows that share a ``doc_id`` stand each for its own text; of those with equal sets one stays. Rows without a ``doc_id`` cannot be named and stay.
    """
    ids = component_ids(docs.select("doc_id", "text"), size, similarity)
    gone = ids.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("v").alias("_gone_v")).distinct()
    rows = packed(docs)
    if ids.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        return unpacked(rows.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"), docs.columns)
    told = with_vertex(rows, size)
    rows = told.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("_v") == F.col("_gone_v")), "left_anti")
    alone = F.col("_v").isNull() | F.col("doc_id").isNull()
    return unpacked(rows.filter(alone).unionByName(rows.filter(~alone).dropDuplicates(["doc_id", "_v"])), docs.columns)
