"""Best-fit packing of token pieces into sequences, certified by dual-feasible-function bounds.

Pieces are spread over groups of bounded size by a hash. Each group runs best-fit decreasing and compares its bin count with
the largest of several lower bounds (dual feasible functions: the sum of the lengths, and rounded sums that count pieces too
long to share a bin). A group at its bound is certified and gives back only its loosest bin; a group with a gap gives back
every bin that is not tight. The documents given back meet those of other groups in fewer groups and are packed again, until one group
is left; rounds shrink quickly, as a group gives back a few bins. Nothing passes through the driver but counts.

A document's tokens are the tokenizer's ids and then ``end_id``; only longer documents are cut, into full pieces and a rest.

Defined results: a null or empty text is the end id alone; repeated documents are packed as often as they occur; ties are
broken by ``doc_id`` and piece; an empty table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import slices, written

SLICE_BYTES = 2 << 20
CACHED_PIECES = 500_000  # pre-tokens a worker remembers, about 0.3 KB each
TURNS = 1024  # rounds of packing that sequence numbers tell apart
# Latin letters before U+0180 are composed already and have lower-case forms of one letter, but for U+0130
NOT_PLAIN = re.compile("[\u0130\u0180-\U0010ffff]|<\\|")
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
# fixed values: the pre-token pattern, for these letters, and the byte alphabet of the vocabulary file
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\t-\r \x85\xa0{LETTERS}{NUMBERS}]+")
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED) if b != 0x20}


class TextIds:
    """Ids of texts as little-endian 32-bit bytes, for tokenizers with the steps of ``word_bpe_49k.json``.

    Nothing joins text across white space, so the ids of a text are those of its pre-tokens in turn. A text of Latin letters,
    digits and signs is lower-cased and cut here as the tokenizer would; pre-tokens not seen lately go through its model in one
    batch. Of other texts the words that are not plain take the whole tokenizer.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        self.cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.bare.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        if not new:
            return
        letters = " ".join(new).encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = np.array(self.bare.encode(letters, add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary has no word ends for some bytes")
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        self.known.update(zip(new, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def cut(self, text: str) -> list[str] | None:
        """Pre-tokens of a plain text; None for others."""
        return None if NOT_PLAIN.search(text) else PRE_TOKENS.findall(text.lower())

    def mixed(self, text: bytes) -> bytes:
        """A text that is not plain, word by word."""
        out = []
        for word in text.split():
            pieces = self.cut(word.decode())
            if pieces is None:
                out.append(np.array(self.whole.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes())
            else:
                self.learn([p for p in dict.fromkeys(pieces) if p not in self.known])
                out += [self.known[p] for p in pieces]
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.cached:
            self.known.clear()
        cuts = [self.cut(t.decode()) for t in texts]
        self.learn(list({p for pieces in cuts if pieces for p in pieces} - self.known.keys()))
        known = self.known
        return [self.mixed(t) if pieces is None else b"".join([known[p] for p in pieces]) for t, pieces in zip(texts, cuts, strict=True)]


_TOKENIZERS: dict[str, TextIds] = {}


def text_ids(path: str, cached: int) -> TextIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TextIds(path)
    _TOKENIZERS[path].cached = cached
    return _TOKENIZERS[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, cached: int = CACHED_PIECES, carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the pieces of every document; ``ids`` are little-endian 32-bit integers. Columns of the
    documents named in ``carry`` follow."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail, step = text_ids(tokenizer, cached), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for low, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                owner, piece, start, length, ids = [], [], [], [], []
                for i, coded in enumerate(coder.encode(texts)):
                    coded += tail
                    for k, at in enumerate(range(0, len(coded), step)):
                        part = coded[at : at + step]
                        owner.append(low + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                mine = pa.array(owner, pa.int64())
                doc_ids, *others = [batch.column(c).take(mine) for c in ("doc_id", *carry)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), *others],
                    ["doc_id", "piece", "start", "length", "ids", *carry],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    others = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *[F.col(f"`{c}`") for c in carry]).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary{others}")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of several dual-feasible lower bounds on the number of bins, exact integer arithmetic.

    With threshold ``k <= capacity / 2``, pieces over ``capacity - k`` fill a bin, those under ``k`` count nothing, others
    their length; with ``m`` parts, a piece counts the whole parts ``(m + 1) * length / capacity`` holds, over ``m``.
    """
    if not len(lengths):
        return 0
    lengths = np.asarray(lengths, np.int64)
    best = -(-int(lengths.sum()) // capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    size = np.arange(capacity + 1)
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # pieces of this length or more
    mass = np.concatenate([[0], np.cumsum(counts * size)])  # total length of pieces shorter than this
    k = np.arange(1, capacity // 2 + 1)
    full = above[capacity - k + 1]
    best = max(best, int((full + -(-(mass[capacity - k + 1] - mass[k]) // capacity)).max()))
    for m in range(1, 21):
        scaled = (m + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * m, (scaled // capacity) * capacity)  # times m * capacity
        best = max(best, -(-int((counts * value).sum()) // (m * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the free space of each bin. Bins by free space are found through a bit set."""
    bins, offsets, free = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = holders[room].pop()
            if not holders[room]:
                some ^= 1 << room
        else:
            room, at = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        free[at] = left
        if left:
            holders[left].append(at)
            some |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def pack_group(capacity: int, group_bits: int, last: bool):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        if last or not len(free):
            open_bins = np.zeros(len(free), bool)
        elif len(free) == lower_bound(lengths, capacity):
            open_bins = free == free.max()
            open_bins &= np.cumsum(open_bins) == 1
            open_bins &= free > 0
        else:
            open_bins = free > 0
        number = group.column("_group").to_numpy()
        new = {
            "sequence_id": pa.array((number << group_bits) | bins),
            "offset": pa.array(offsets),
            "_open": pa.array(open_bins[bins]),
        }
        return pa.table([new.get(name, group.column(name) if name in group.column_names else None) for name in (*group.column_names, *new)], names=[*group.column_names, *new])

    return pack


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 20_000) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and whatever else is narrow) with ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own, with negative numbers; all others are packed in rounds of groups of about
    ``group_rows`` pieces.
    """
    full = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    done, rest, turn = [full], pieces.filter(F.col("length") < capacity), 0
    count = rest.count()
    while count:
        groups = math.ceil(count / group_rows)
        # by row and not by id, so that pieces without an id or of repeated ids are spread like all others
        keyed = rest.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)) * TURNS + turn)
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", sequence_id long, offset long, _open boolean"
        packed = written(keyed.groupBy("_group").applyInArrow(pack_group(capacity, 24, groups == 1), shape), "packed")
        done.append(packed.filter(~F.col("_open")).drop("_group", "_open"))
        rest, turn = packed.filter("_open").drop("_group", "_open", "sequence_id", "offset"), turn + 1
        left = rest.count() if groups > 1 else 0
        count = left if left < count else 0
        if left and not count:  # nothing was gained: keep these bins as they are
            done.append(packed.filter("_open").drop("_group", "_open"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, n_tokens, ids``, each at most one capacity long."""
    parts = pieces.select("doc_id", "piece", "ids").join(packed.select("doc_id", "piece", "sequence_id", "offset", "length"), ["doc_id", "piece"])
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return parts.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
