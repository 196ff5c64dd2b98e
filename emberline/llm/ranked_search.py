"""Ranked lexical search of many queries over all documents, sharing what queries have in common.

Items share term sets: the same passage, the same stop words. Before any document is read, each block of items is turned into a
directed acyclic graph of sums. Terms found in exactly the same items are one leaf. In every item the leaves are in order of how
many items hold them; the neighbours that stand side by side in most items become one node, again and again, until no two
neighbours are found twice. An item is the sum of the few nodes that are left of it. Every node is the sum of a disjoint set of terms.

Documents are then read in steps of bounded size. A step holds one accumulator per node and document: the leaves take the
weighted terms, the nodes are added along the graph, level by level, each once whatever the number of items below it, and items add
up theirs. Each task keeps the best documents of every item, so only these are shuffled. All sums are 64-bit integers, so
neither the graph nor the order of additions can change a score.

The corpus is read twice per block of items: for term statistics, and for scores. A block is bounded by ``block_terms``, and only
the graphs, the vocabulary and the statistics of one block are broadcast.

Defined results: a null or empty text has no terms, and a document or item without terms is in no result; repeated items (equal id and text) are
one, items that share an id or have none are ranked each for itself; repeated documents are ranked each; a null ``doc_id`` comes
last among equal scores; ``doc_id`` is an integer; other columns are not read; empty tables give no rows. Terms are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.store import slices, written
from emberline.llm.words import NOT_ALNUM, find_words

SLICE_BYTES = 2 << 20
BLOCK_TERMS = 200_000
CELLS = 4_000_000  # accumulators of a step
MERGED_TASKS = 64  # tasks whose best documents are merged first


@dataclass
class Graph:
    """Leaves, then the nodes of each level: ``left`` and ``right`` of node ``leaves + i``; items as lists of nodes."""

    terms: np.ndarray
    leaf: np.ndarray
    leaves: int
    left: np.ndarray
    right: np.ndarray
    levels: np.ndarray
    items: np.ndarray
    nodes: np.ndarray
    first: np.ndarray

    def size(self) -> int:
        return self.leaves + len(self.left)

    def sums(self, leaf_sums: np.ndarray) -> np.ndarray:
        """Item sums by column from leaf sums by column; ``leaf_sums`` has a row for every node, filled here."""
        for low, high in zip(self.levels[:-1].tolist(), self.levels[1:].tolist(), strict=True):
            leaf_sums[self.leaves + low : self.leaves + high] = leaf_sums[self.left[low:high]] + leaf_sums[self.right[low:high]]
        return np.add.reduceat(leaf_sums[self.nodes], self.first[:-1], axis=0)


def shared_leaves(item: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms and their leaf - the terms with exactly the same items -, and for every pair of leaf and item the two, by item and leaf.
    Leaves of many items come first."""
    order = np.lexsort((item, term))
    item, term = item[order].astype(np.int64), term[order]
    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    ends = np.append(begin[1:], len(term))
    names: dict[bytes, int] = {}
    group = np.array([names.setdefault(item[a:b].tobytes(), len(names)) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)])
    members = [np.frombuffer(n, np.int64) for n in names]
    place = np.argsort([-len(m) for m in members], kind="stable")
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    leaf = np.concatenate([np.full(len(members[p]), i) for i, p in enumerate(place.tolist())])
    owner = np.concatenate([members[p] for p in place.tolist()])
    by_item = np.lexsort((leaf, owner))
    return term[begin], rank[group], owner[by_item], leaf[by_item]


def shared_nodes(owner: np.ndarray, symbol: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turns neighbours found in two or more items into nodes until none are left.

    Returns ``left, right`` of the nodes, where each level's nodes begin, and the shortened lists by owner.
    """
    left, right, levels, known = [], [], [0], fresh
    while len(symbol) > 1:
        pair = symbol[:-1] * (1 << 32) + symbol[1:]
        pair[owner[:-1] != owner[1:]] = -1
        kinds, back, often = np.unique(pair, return_inverse=True, return_counts=True)
        weight = np.where(pair < 0, 0, often[back])
        # of overlapping places the more frequent pair goes first, then the left one
        around = np.concatenate([[0], weight, [0]])
        chosen = (weight > 1) & (weight > around[:-2]) & (weight >= around[2:])
        chosen &= np.bincount(back, chosen, len(kinds))[back] > 1
        if not chosen.any():
            break
        at = np.flatnonzero(chosen)
        made, name = np.unique(pair[at], return_inverse=True)
        left.append(made >> 32)
        right.append(made & 0xFFFFFFFF)
        levels.append(levels[-1] + len(made))
        symbol = symbol.copy()
        symbol[at] = known + name
        known += len(made)
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        owner, symbol = owner[stays], symbol[stays]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), np.array(levels), owner, symbol


def query_graph(items: np.ndarray, sizes: np.ndarray, terms: np.ndarray) -> Graph:
    """The graph of a block of items, given their distinct terms one item after another."""
    vocabulary, leaf, owner, symbol = shared_leaves(np.repeat(np.arange(len(items)), sizes), terms)
    leaves = int(leaf.max()) + 1
    left, right, levels, owner, symbol = shared_nodes(owner, symbol, leaves)
    return Graph(vocabulary, leaf, leaves, left, right, levels, items, symbol, np.searchsorted(owner, np.arange(len(items) + 1)))


GRAPH_FIELDS = ("terms", "leaf", "left", "right", "levels", "items", "nodes", "first")
GRAPH_TYPE = ", ".join(f"{f} binary" for f in GRAPH_FIELDS)


def mined(group: pa.Table) -> pa.Table:
    order = np.argsort(group.column("item").to_numpy())
    texts = [group.column("terms")[int(i)].as_py() for i in order]
    sizes = np.array([len(t) // 8 for t in texts])
    graph = query_graph(group.column("item").to_numpy()[order], sizes, np.frombuffer(b"".join(texts), "<u8"))
    return pa.table({"block": group.column("block").slice(0, 1), **{f: pa.array([np.ascontiguousarray(getattr(graph, f)).tobytes()], pa.binary()) for f in GRAPH_FIELDS}})


def read_graph(row) -> Graph:
    parts = {f: np.frombuffer(row[f], np.uint64 if f == "terms" else np.int64) for f in GRAPH_FIELDS}
    return Graph(leaves=int(parts["leaf"].max()) + 1, **parts)


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, terms, n``: a number for each distinct item with terms, and its sorted distinct terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch, "text", SLICE_BYTES):
                words = find_words(data, offsets, NOT_ALNUM, lower=True)
                terms = [np.unique(words.hash[a:b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                columns = [batch.column("item_id").slice(low, high - low), pa.array([t.astype("<u8").tobytes() for t in terms], pa.binary()), pa.array([len(t) for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "terms", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").distinct().mapInArrow(build, f"item_id {kind}, terms binary, n long").filter("n > 0")
    return written(found.withColumn("item", F.monotonically_increasing_id()), "items")


def occurrences(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in ``terms`` and number of occurrences of every term of a document, by document; and the terms of each document with repeats."""
    words = find_words(data, offsets, NOT_ALNUM, lower=True)
    at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
    known = terms[at] == words.hash
    pair, times = np.unique(words.doc()[known] * len(terms) + at[known], return_counts=True)
    return pair // len(terms), pair % len(terms), times.astype(np.int64), words.counts.astype(np.int64)


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and the documents holding each of ``terms``."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        totals, some, all_terms = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                _, term, _, sizes = occurrences(data, offsets, terms)
                totals += np.bincount(term, minlength=len(terms))
                some += int((sizes > 0).sum())
                all_terms += int(sizes.sum())
        there = np.flatnonzero(totals)
        places = np.concatenate([there, [-1, -2]])
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.concatenate([totals[there], [some, all_terms]]))], ["place", "n"])

    found = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    numbers = {r["place"]: r["n"] for r in found}
    df = np.zeros(len(terms), np.int64)
    for place, n in numbers.items():
        if place >= 0:
            df[place] = n
    return numbers.get(-1, 0), numbers.get(-2, 0), df


class Best:
    """The best documents of every item so far: scores and ids, best first."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = np.zeros((items, top), np.int64)
        self.doc = np.zeros((items, top), np.int64)
        self.unnamed = np.zeros((items, top), bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, unnamed: np.ndarray) -> None:
        """Scores by item and document."""
        item, k = np.nonzero((scores >= np.maximum(self.score[:, -1:], 1)))
        if not len(item):
            return
        touched = np.unique(item)
        rows = np.concatenate([np.repeat(touched, self.top), item])
        score = np.concatenate([self.score[touched].ravel(), scores[item, k]])
        doc = np.concatenate([self.doc[touched].ravel(), docs[k]])
        nameless = np.concatenate([self.unnamed[touched].ravel(), unnamed[k]])
        order = np.lexsort((doc, nameless, -score, rows))
        begin = np.searchsorted(rows[order], touched)
        kept = order[(begin[:, None] + np.arange(self.top)).ravel()]
        shape = (len(touched), self.top)
        self.score[touched], self.doc[touched], self.unnamed[touched] = score[kept].reshape(shape), doc[kept].reshape(shape), nameless[kept].reshape(shape)


def scored(docs: DataFrame, graph: Graph, totals: tuple[int, int, np.ndarray], top: int) -> DataFrame:
    """``item, doc_id, score``: of every task the best documents of each item of a block."""
    n_docs, n_terms, df = totals
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    held = docs.sparkSession.sparkContext.broadcast((graph, weights))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights = held.value
        best = Best(len(graph.items), top)
        step = max(8, CELLS // (graph.size() + len(graph.nodes) + len(graph.items)))
        for batch in batches:
            ids = batch.column("doc_id")
            unnamed = ids.is_null().to_numpy(zero_copy_only=False)
            names = ids.fill_null(0).to_numpy()
            for low, high, data, offsets in slices(batch, "text", SLICE_BYTES):
                doc, term, times, sizes = occurrences(data, offsets, graph.terms)
                length = 50 + 50 * sizes * n_docs // max(n_terms, 1)
                value = weights[term] * (1_000_000_000 * times // (1000 * times + 20 * length[doc]))
                for at in range(0, high - low, step):
                    width = min(step, high - low - at)
                    some = slice(*np.searchsorted(doc, [at, at + width]))
                    sums = np.zeros((graph.size(), width), np.int64)
                    np.add.at(sums, (graph.leaf[term[some]], doc[some] - at), value[some])
                    rows = slice(low + at, low + at + width)
                    best.add(graph.sums(sums), names[rows], unnamed[rows])
        item, k = np.nonzero(best.score > 0)
        columns = [pa.array(graph.items[item]), pa.array(best.doc[item, k], mask=best.unnamed[item, k]), pa.array(best.score[item, k])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rank, "item long, doc_id long, score long")


def first_rows(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    ranked = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    queries = item_terms(items)
    total = queries.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_terms))
    dealt = queries.select("item", "terms", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
    graphs = written(dealt.groupBy("block").applyInArrow(mined, f"block long, {GRAPH_TYPE}"), "graphs")
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for block in range(blocks):
        row = graphs.filter(F.col("block") == block).first()
        if row is not None:
            graph = read_graph(row)
            found = found.union(scored(docs, graph, statistics(docs, graph.terms), top))
    near = first_rows(found.withColumn("_tasks", F.floor(F.spark_partition_id() / MERGED_TASKS)), ["item", "_tasks"], top).drop("_tasks", "rank")
    return first_rows(near, ["item"], top).join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
