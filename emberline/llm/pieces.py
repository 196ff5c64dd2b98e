"""SentencePiece ids of whole texts through a table of distinct chunks, and the texts decoded from them.

The library puts a marker for each space and one before the text. Where no piece of a model crosses from a letter to a marker, a text
falls apart into chunks - a run of markers and what follows up to the next one - that are segmented independently. So every
distinct chunk is segmented once, whatever its number of occurrences, and ids are joined back by position:

1. each slice of about ``SLICE_BYTES`` of text is written as one row: its documents, its distinct chunks, and for every position the chunk there;
2. the distinct chunks of all slices are dealt into buckets of their hash; a bucket encodes and decodes each of its chunks once
   and answers every slice that asked, in the order asked;
3. a slice meets its answers and lines up ids and texts by position.

Hot chunks cost one entry a slice. What a task holds is a slice or a bucket; the number of buckets follows the chunks asked for.

Defined results: a null or empty text has no ids and decodes to an empty text; rows that share a ``doc_id`` and repeated rows stand each for its
own text; a null ``doc_id`` stays null; further columns are not returned, so none can clash; an empty table gives none. Chunks are told
apart by 64-bit hashes within a slice, and by their bytes in the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import slices, written
from emberline.llm.words import BYTE_VALUES, mix, runs_inside, span_hashes, stretches

MARKER = "▁"
SLICE_BYTES = 32 << 20
PART_BYTES = 4 << 20  # of a slice, cut at once
BUCKET_BYTES = 12 << 20  # of chunks asked for, in the mean
LEAST_BUCKETS = 24
ANSWER_CHUNKS = 150_000  # positions in one batch of results
FREQUENT = 1 << 16  # chunks of a slice that come first by frequency; the others are in the order of their bytes, which packs better
SPACE, BREAK = 32, 255  # the second is no byte of a text
LEVEL = 9  # of compression
LOW_BITS = 6


def check_model(path: str) -> None:
    """Raises unless the model segments chunks independently: markers only at the start of pieces, one put before the text, nothing else changed."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    spec = proto.normalizer_spec
    plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    crossing = any(MARKER in p.piece.lstrip(MARKER) for p in proto.pieces)
    special = any(p.type == p.USER_DEFINED for p in proto.pieces)
    if not plain or crossing or special or proto.trainer_spec.treat_whitespace_as_suffix or MARKER not in {p.piece for p in proto.pieces}:
        raise ValueError(f"{path}: pieces may cross markers, so chunks cannot be segmented one by one")


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every chunk without its first marker, and where each text's chunks begin (``n + 1`` places)."""
    begins, _ = runs_inside(data == SPACE, offsets)
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    # the marker before a text starts its first chunk, to which spaces right at the start belong
    inner = np.setdiff1d(begins, filled, assume_unique=True)
    start = np.union1d(filled, inner + 1)
    first = np.searchsorted(start, offsets)
    last = np.isin(np.arange(1, len(start) + 1), first)
    end = np.append(start[1:] - 1, len(data))[: len(start)]
    end[last] += 1
    if len(end):
        end[-1] = len(data)
    return start, end, first


class Slice:
    """Documents of one slice, its distinct chunks, and the chunk at every position."""

    def __init__(self):
        self.docs: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.texts: list[bytes] = []
        self.bytes = self.known = 0

    def add(self, docs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        start, end, first = chunk_spans(data, offsets)
        hashes, where, back = np.unique(span_hashes(data, start, end, BYTE_VALUES), return_index=True, return_inverse=True)
        raw = data.tobytes()
        self.texts += [raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
        self.hashes.append(hashes)
        self.codes.append((back + self.known).astype(np.int32))
        self.counts.append(np.diff(first))
        self.docs.append(docs)
        self.known += len(hashes)
        self.bytes += len(data)

    def row(self, kind: pa.DataType) -> dict:
        """The documents, the distinct chunks - the most frequent ones first, so that their numbers are small -, and the number at every position."""
        hashes, where, back = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        codes = back[np.concatenate(self.codes)]
        often = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")
        seldom = sorted(often[FREQUENT:].tolist(), key=lambda i: self.texts[where[i]])
        ordered = np.concatenate([often[:FREQUENT], np.array(seldom, np.int64)])
        rank = np.empty(len(ordered), np.uint32)
        rank[ordered] = np.arange(len(ordered))
        texts = [self.texts[i] for i in where[ordered].tolist()]
        docs = pa.chunked_array(self.docs, kind).combine_chunks()
        return {
            "docs": docs,
            "counts": as_bytes(np.concatenate(self.counts)),
            **dict(zip(("codes", "low_codes"), codes_as_bytes(rank[codes]))),
            "chunks": squeezed(b"".join([t + bytes([BREAK]) for t in texts])),
            "n_chunks": len(texts),
            "n_bytes": sum(map(len, texts)),
        }


def squeezed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def expanded(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)


def as_bytes(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes; the high planes of frequent chunks are nearly all zero."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return squeezed(np.ascontiguousarray(planes).tobytes())


def from_bytes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(expanded(raw).reshape(4, -1).T).view("<u4").ravel()


def codes_as_bytes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """The high bits of the codes in place, and the low bits of all codes grouped by their high bits: those of frequent chunks are unevenly used."""
    high = codes >> LOW_BITS
    low = (codes & ((1 << LOW_BITS) - 1)).astype(np.uint8)
    return as_bytes(high), squeezed(low[np.argsort(high, kind="stable")].tobytes())


def codes_from_bytes(high: bytes, low: bytes) -> np.ndarray:
    codes = from_bytes(high)
    order = np.argsort(codes, kind="stable")
    codes = codes << LOW_BITS
    codes[order] |= expanded(low)
    return codes


def ids_as_bytes(ids: np.ndarray) -> bytes:
    """Piece ids in the order of similar chunks, two bytes each where they fit: the compressor finds the beginnings that neighbours share."""
    wide = len(ids) and int(ids.max()) >= 1 << 16
    return squeezed((b"4" if wide else b"2") + ids.astype("<u4" if wide else "<u2").tobytes())


def ids_from_bytes(raw: bytes) -> np.ndarray:
    data = expanded(raw).tobytes()
    return np.frombuffer(data[1:], "<u4" if data[:1] == b"4" else "<u2").astype(np.int32)


def chunk_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of a row begin and end."""
    end = np.flatnonzero(data == BREAK)
    return np.concatenate([[0], end[:-1] + 1]) if len(end) else end, end


def cut(docs: DataFrame) -> DataFrame:
    """One row per slice: ``slice, docs, counts, codes, low_codes, chunks, n_chunks, n_bytes``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def finished(held: Slice) -> pa.RecordBatch:
            row, name = held.row(kind), np.frombuffer(uuid.uuid4().bytes[:8], "<i8")
            ids = pa.ListArray.from_arrays(pa.array([0, len(row["docs"])], pa.int32()), row.pop("docs"))
            columns = [pa.array(name), ids, *[pa.array([x]) for x in row.values()]]
            return pa.RecordBatch.from_arrays(columns, ["slice", "docs", *row])

        held, kind = Slice(), None
        for batch in batches:
            kind = batch.column("doc_id").type
            # a written marker is what a space becomes
            plain = pc.replace_substring(batch.column("text"), pattern=MARKER, replacement=" ")
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), plain], ["doc_id", "text"])
            for low, high, data, offsets in slices(rows, "text", PART_BYTES):
                held.add(rows.column("doc_id").slice(low, high - low), data, offsets)
                if held.bytes >= SLICE_BYTES:
                    yield finished(held)
                    held = Slice()
        if held.docs:
            yield finished(held)

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"slice long, docs array<{id_kind}>, counts binary, codes binary, low_codes binary, chunks binary, n_chunks long, n_bytes long"
    return docs.select("doc_id", "text").mapInArrow(build, shape)


def dealt(data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice's chunks by bucket, in the slice's order within each; the buckets there are, and where each begins."""
    bucket = (mix(span_hashes(data, start, end, BYTE_VALUES)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    there, begin = np.unique(bucket[order], return_index=True)
    return order, there, begin


def gather(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the spans that ``codes`` name, one after another, and their sizes."""
    n = sizes[codes]
    return values[np.repeat(begin[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def asked_chunks(cuts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, slice, chunks``: what each slice asks each bucket, in the slice's order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunks in zip(*[batch.column(c).to_pylist() for c in ("slice", "chunks")], strict=True):
                data = expanded(chunks)
                start, end = chunk_places(data)
                order, there, begin = dealt(data, start, end, buckets)
                asked = [squeezed(gather(data, start, end - start + 1, order[a:b])[0].tobytes()) for a, b in stretches(begin, len(order))]
                arrays = [pa.array(there), pa.array(np.full(len(there), name)), pa.array(asked, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "slice", "chunks"])

    return cuts.select("slice", "chunks").mapInArrow(deal, "bucket long, slice long, chunks binary")


def answered(asked: DataFrame, model_path: str) -> DataFrame:
    """``slice, bucket, n_ids, ids, odd``: the ids of every chunk asked for; each distinct chunk of a bucket is encoded and decoded once.

    ``odd`` lists the chunks whose decoded text is not the chunk, by place, and these texts."""

    def answer(group: pa.Table) -> pa.Table:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        index: dict[bytes, int] = {}
        asks = []
        for chunks in group.column("chunks").to_pylist():
            texts = expanded(chunks).tobytes().split(bytes([BREAK]))[:-1]
            asks.append(np.array([index.setdefault(t, len(index)) for t in texts], np.int64))
        distinct = [t.decode() for t in index]
        bare = model.piece_to_id(MARKER)  # the marker alone, for which there is no text to encode
        ids = [found if text else [bare] for text, found in zip(distinct, model.encode(distinct, num_threads=1), strict=True)]
        odd = {i: back for i, (text, back) in enumerate(zip(distinct, model.decode(ids, num_threads=1), strict=True)) if text != back}
        counts = np.array([len(x) for x in ids], np.int64)
        flat, begin = np.array([i for x in ids for i in x], np.uint32), np.cumsum(counts) - counts
        columns: tuple[list, list, list] = ([], [], [])
        for ask in asks:
            some, n = gather(flat, begin, counts, ask)
            columns[0].append(as_bytes(n))
            columns[1].append(ids_as_bytes(some))
            columns[2].append([{"place": k, "text": odd[i]} for k, i in enumerate(ask.tolist()) if i in odd] if odd else [])
        kind = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string())]))
        return pa.table({"slice": group.column("slice"), "bucket": group.column("bucket"), "n_ids": pa.array(columns[0], pa.binary()), "ids": pa.array(columns[1], pa.binary()), "odd": pa.array(columns[2], kind)})

    return asked.groupBy("bucket").applyInArrow(answer, "slice long, bucket long, n_ids binary, ids binary, odd array<struct<place:int,text:string>>")


def lined_up(row: dict, docs: pa.Array, answers: list[dict], buckets: int) -> Iterator[pa.RecordBatch]:
    """The documents of one slice with ids and decoded texts, a few MB at a time."""
    data = expanded(row["chunks"])
    start, end = chunk_places(data)
    order, there, begin = dealt(data, start, end, buckets)
    answers = sorted(answers, key=lambda a: a["bucket"])
    counts_of = [from_bytes(a["n_ids"]) for a in answers]
    if [a["bucket"] for a in answers] != there.tolist() or sum(map(len, counts_of)) != len(order):
        raise ValueError("chunks of a slice are without an answer")
    n_ids, ids_begin, text_begin, sizes = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), start, end - start
    flat = np.concatenate([np.zeros(0, np.int32), *[ids_from_bytes(a["ids"]) for a in answers]])
    n_ids[order] = np.concatenate([np.zeros(0, np.uint32), *counts_of])
    ids_begin[order] = np.cumsum(n_ids[order]) - n_ids[order]
    for low, answer in zip(begin.tolist(), answers, strict=True):
        for x in answer["odd"]:
            text = np.frombuffer(x["text"].encode(), np.uint8)
            at = order[low + x["place"]]
            text_begin[at], sizes[at] = len(data), len(text)
            data = np.concatenate([data, text])
    codes, counts = codes_from_bytes(row["codes"], row["low_codes"]), from_bytes(row["counts"]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    low = 0
    while low < len(counts):
        high = max(int(np.searchsorted(first, first[low] + ANSWER_CHUNKS, side="right")) - 1, low + 1)
        some = codes[first[low] : first[high]]
        ids, n = gather(flat, ids_begin, n_ids, some)
        marked, m = gather(data, text_begin, sizes, some)
        # a space before each chunk but the first of a text, whose marker decoding takes away
        inner = np.ones(len(some), np.int64)
        inner[(first[low:high] - first[low])[counts[low:high] > 0]] = 0
        spans = m + inner
        out = np.full(int(spans.sum()), SPACE, np.uint8)
        out[np.repeat(np.cumsum(spans) - m - (np.cumsum(m) - m), m) + np.arange(m.sum())] = marked
        places = first[low : high + 1] - first[low]
        ids_at, text_at = np.concatenate([[0], np.cumsum(n)])[places], np.concatenate([[0], np.cumsum(spans)])[places]
        yield pa.RecordBatch.from_arrays(
            [
                docs.slice(low, high - low),
                pa.ListArray.from_arrays(pa.array(ids_at, pa.int32()), pa.array(ids)),
                pa.StringArray.from_buffers(high - low, pa.py_buffer(text_at.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())),
            ],
            ["doc_id", "ids", "decoded"],
        )
        low = high


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every document: what the library's ``encode`` gives for the whole text, and its ``decode`` for these ids."""
    check_model(model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = written(cut(docs), "cuts")
    total = cuts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / BUCKET_BYTES))
    answers = answered(asked_chunks(cuts, buckets), model_path)
    # the answers of a slice stream past before its documents
    both = answers.withColumn("_last", F.lit(False)).unionByName(cuts.drop("n_chunks", "n_bytes").withColumn("_last", F.lit(True)), allowMissingColumns=True)
    streams = both.repartition("slice").sortWithinPartitions("slice", "_last")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            last, docs_of = batch.column("_last").to_pylist(), batch.column("docs")
            for i in range(batch.num_rows):
                if last[i]:
                    row = {c: batch.column(c)[i].as_py() for c in ("counts", "codes", "low_codes", "chunks")}
                    yield from lined_up(row, docs_of[i].values, held, buckets)
                    held = []
                else:
                    held.append({c: batch.column(c)[i].as_py() for c in ("bucket", "n_ids", "ids", "odd")})

    return streams.mapInArrow(join, f"doc_id {kind}, ids array<int>, decoded string")
