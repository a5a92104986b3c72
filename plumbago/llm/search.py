"""Ranked lexical search: an index of compressed posting blocks, walked by Block-Max WAND."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, byte_class, give_back, named, schema_with, span_hashes, table, text_udf, texts_of, tune
from .divergence import terms

#: Bytes that part terms: ASCII without letters and digits. A-Z are lower-cased.
APART = bytes(b for b in range(128) if not chr(b).isalnum())
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_APART = byte_class(APART)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Postings of one block.
BLOCK = 128
#: Bytes of text of one segment; a longer text is a segment alone.
SEGMENT_BYTES = 16 << 20
#: Items of one group of queries.
ITEMS = 512
#: Query terms are broadcast up to so many, joined by shuffles beyond.
BROADCAST_TERMS = 200_000
#: Pivots scored at a time.
PIVOTS = 512
#: Fixed numbers of the score.
UNIT, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75


class Index(NamedTuple):
    """Blocks of all terms, and what scores need: documents with a term, and terms, of all documents.

    Rows of `blocks`: segment, term, block, n (postings), first, last (numbers of
    documents in the segment), peak (the highest impact without the term's weight), body. Rows of
    term null have the id of the segment's document of number `first`; numbers go up with
    ids, null last.
    """

    blocks: DataFrame
    documents: int
    words: int


def build(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> Index:
    """Index whole texts.

    Segments are made where the texts are read, of some `segment_bytes` each: no text and no
    posting is shuffled, and a task holds one segment. Impacts depend on the number
    and the mean length of all documents, so those are counted in a pass before.
    Null and empty texts have no terms; each of repeated rows is a document; ids may be null.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(named(doc_id).alias("id"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    counted = rows.select(text_udf(_sizes, "n long", spark)("text")["n"].alias("n"), F.octet_length("text").alias("bytes"))
    total = counted.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum("bytes")).first()
    documents, words = total[0], total[1] or 0
    parts = max(spark.sparkContext.defaultParallelism, (total[2] or 0) // segment_bytes + 1)
    schema = schema_with(rows, ["id"], "segment long, term string, block int, n int, first int, last int, peak long, body binary")
    blocks = rows.coalesce(parts).mapInArrow(lambda batches: _segments(batches, documents, words, segment_bytes), schema)
    return Index(table(blocks), documents, words)


def _sizes(texts: list[bytes]) -> dict:
    return {"n": Words([t.translate(_LOWER) for t in texts], hashes=False, apart=_IS_APART).counts}


def _segments(batches: Iterator[pa.RecordBatch], documents: int, words: int, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    number, ids, texts, size, kind = TaskContext.get().partitionId() << 32, [], [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            if size and size + len(t) > segment_bytes:
                yield _segment(number, pa.array(ids, kind), texts, documents, words)
                number, ids, texts, size = number + 1, [], [], 0
                give_back()
            ids.append(i)
            texts.append(t.translate(_LOWER))
            size += len(t) + 1
    if ids:
        yield _segment(number, pa.array(ids, kind), texts, documents, words)


def _segment(number: int, ids: pa.Array, texts: list[bytes], documents: int, words: int) -> pa.RecordBatch:
    """One segment's blocks: documents in the order of their ids, postings in that of terms and documents."""
    order = pc.sort_indices(ids, null_placement="at_end")
    w = Words([texts[i] for i in order.to_pylist()], hashes=False, apart=_IS_APART)
    terms, term_of, seed = None, None, 1
    while terms is None:
        terms, term_of = _distinct(w, seed)
        seed += 2
    # one posting for each term and document
    key, tf = np.unique(term_of * np.int64(len(ids)) + w.text, return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    impact = (UNIT * tf) // (1000 * tf + SATURATION * _norms(w.counts, documents, words)[doc])

    starts = np.flatnonzero(np.diff(term, prepend=-1))
    counts = np.diff(np.append(starts, len(term)))
    blocks = (counts + BLOCK - 1) // BLOCK
    block_no = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(starts, blocks) + block_no * BLOCK
    n = np.diff(np.append(begin, len(term)))
    last = begin + n - 1
    peak = np.maximum.reduceat(impact, begin) if len(begin) else np.zeros(0, np.int64)
    # a block's body: gaps between its documents, then its impacts
    gaps = np.diff(doc, prepend=0)
    gaps[begin] = 0
    at = np.arange(len(term)) + np.repeat(begin, n)
    values = np.empty(2 * len(term), np.int64)
    values[at] = gaps
    values[at + np.repeat(n, n)] = impact
    data, ends = _encode(values)
    body = _binary(data, np.concatenate(([0], ends[2 * (last + 1) - 1])), pa.binary())
    of, docs = np.repeat(np.arange(len(blocks)), blocks), np.arange(len(ids))

    def column(values, kind: pa.DataType, of_docs=None) -> pa.Array:
        return pa.concat_arrays([pa.array(values, kind), pa.nulls(len(docs), kind) if of_docs is None else pa.array(of_docs, kind)])

    n32 = pa.int32()
    columns = [
        pa.concat_arrays([pa.nulls(len(n), ids.type), ids.take(order)]), column(np.full(len(n), number), pa.int64(), np.full(len(docs), number)),
        column(terms.take(pa.array(of)), pa.string()), column(block_no, n32), column(n, n32), column(doc[begin], n32, docs), column(doc[last], n32),
        column(peak, pa.int64()), column(body, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "segment", "term", "block", "n", "first", "last", "peak", "body"])


def _distinct(w: Words, seed: int) -> tuple[pa.Array | None, np.ndarray | None]:
    """The distinct words, and each word's place among them; none where two words share a hash (a second hash tells)."""
    h, check = (span_hashes(w.data, w.starts, w.ends, s) for s in (seed, seed + 1))
    _, at, of = np.unique(h, return_index=True, return_inverse=True)
    if (check[at][of] != check).any():
        return None, None
    starts, sizes = w.starts[at], (w.ends - w.starts)[at]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = w.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return _binary(data, offsets, pa.string()), of.astype(np.int64)


def _binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _norms(counts: np.ndarray, documents: int, words: int) -> np.ndarray:
    """100 - share + share * (length / mean length), in integers."""
    if LENGTH_SHARE * int(counts.max(initial=0)) * documents < 1 << 63:
        scaled = LENGTH_SHARE * counts * documents // max(words, 1)
    else:
        scaled = np.array([LENGTH_SHARE * int(c) * documents // max(words, 1) for c in counts], np.int64)
    return 100 - LENGTH_SHARE + scaled


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the highest bit set in all but a value's last byte; and where each value ends."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= 1 << 7 * k
    ends = np.cumsum(sizes)
    out, left = np.empty(ends[-1] if len(ends) else 0, np.uint8), values.copy()
    for k in range(int(sizes.max(initial=0))):
        more = np.flatnonzero(sizes > k)
        out[ends[more] - sizes[more] + k] = (left[more] & 127) | np.where(sizes[more] > k + 1, 128, 0)
        left[more] >>= 7
    return out, ends


def _decode(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps summed up (from 0), and impacts, of a block of n postings."""
    data = np.frombuffer(body, np.uint8)
    final = np.flatnonzero(data < 128)
    first = np.concatenate(([0], final[:-1] + 1))
    shift = 7 * (np.arange(len(data)) - np.repeat(first, final - first + 1))
    values = np.add.reduceat((data & np.int64(127)) << shift, first)
    return np.cumsum(values[:n]), values[n:]


def ranked(index: Index, items: DataFrame, k: int, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, by Block-Max WAND.

    Only blocks of the items' terms are read. They are joined to the terms (with
    their weights, for groups of `ITEMS` items) and meet by segment and group of items, which
    one task searches; the segments' best are ranked together. Rows of equal item_id are one item, null
    too. Items without terms, or that no document scores for, have no rows. Documents of equal score
    go by id, null last.
    """
    spark = items.sparkSession
    asked = items.select(named(item_id).alias("item_id"), F.explode(terms(named(text), BETWEEN)).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    grouped = asked.select("item_id").distinct()
    groups = grouped.count() // ITEMS + 1
    asked = table(asked.withColumn("items", F.pmod(F.xxhash64("item_id"), F.lit(groups))))
    wanted = asked.select("term").distinct()
    few = wanted.count() <= BROADCAST_TERMS
    hint = F.broadcast if few else lambda df: df
    frequency = index.blocks.join(hint(wanted), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double"))).alias("weight")
    weighted = asked.join(frequency.select("term", weight), "term").where("weight > 0")
    # one row a term and group of items; a group has some ITEMS items
    queries = table(weighted.groupBy("items", "term").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("item_id", "times")).alias("asked")))
    found = index.blocks.where("term is not null").join(hint(queries), "term").withColumn("asked", F.when(F.col("block") == 0, F.col("asked")))
    found = found.select("segment", "items", "term", "block", "n", "first", "last", "peak", "body", "weight", "asked")
    schema = schema_with(asked, ["item_id"], "segment long, first int, score long")
    best = found.groupBy("segment", "items").applyInArrow(lambda t: _search(t, k), schema)
    # ids matter for equal scores only: they are looked up for what may still be among the k
    close = best.withColumn("rank", F.rank().over(Window.partitionBy("item_id").orderBy(F.desc("score")))).where(F.col("rank") <= k).drop("rank")
    ids = index.blocks.where("term is null").select("segment", "first", F.col("id").alias("doc_id"))
    out = close.join(ids, ["segment", "first"]).select("item_id", "doc_id", "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("item_id").alias(item_id), "rank", "doc_id", "score")


def _search(found: pa.Table, k: int) -> pa.Table:
    """The k best of each item in one segment."""
    segment, postings = found.column("segment")[0].as_py(), Postings(found)
    items: dict = {}
    heads = found.filter(pc.is_valid(found.column("asked")))
    for term, asked in zip(heads.column("term").to_pylist(), heads.column("asked").to_pylist()):
        for one in asked:
            items.setdefault(one["item_id"], []).append((postings.place[term], one["times"]))
    out = []
    for item, wanted in items.items():
        docs, scores = postings.best(wanted, k)
        out += [(item, segment, d, s) for d, s in zip(docs.tolist(), scores.tolist())]
    give_back()
    kind = heads.schema.field("asked").type.value_type.field("item_id").type
    kinds = [("item_id", kind), ("segment", pa.int64()), ("first", pa.int32()), ("score", pa.int64())]
    return pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


class Postings:
    """Blocks of some terms in one segment: pointers move over first, last and peak; a body is decompressed when a pivot may lie in it."""

    def __init__(self, found: pa.Table):
        found = found.sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
        terms = found.column("term").to_pylist()
        self.n, self.first, self.last, self.peak, weight = (found.column(c).to_numpy().astype(np.int64) for c in ("n", "first", "last", "peak", "weight"))
        self.bodies, self.decoded = found.column("body").combine_chunks(), {}
        starts = [i for i in range(len(terms)) if i == 0 or terms[i] != terms[i - 1]]
        self.place = {terms[i]: p for p, i in enumerate(starts)}
        self.ranges, self.weight = list(zip(starts, [*starts[1:], len(terms)])), weight[starts]
        self.size = int(self.last.max()) + 1

    def body(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if block not in self.decoded:
            gaps, impacts = _decode(self.bodies[block].as_py(), int(self.n[block]))
            self.decoded[block] = gaps + self.first[block], impacts
        return self.decoded[block]

    def best(self, wanted: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores (above 0) of the k best documents for terms and their times; equal scores by number.

        Shallow moves alone give each document the sum of the peaks of the blocks
        it may be in (and the true impacts of terms that have one block). Pivots are the documents whose sum reaches the k-th best score
        so far: first those of the highest sums, to raise that score, then all
        others in ascending order.
        """
        wanted = sorted(((int(self.weight[t]) * times, *self.ranges[t]) for t, times in wanted), key=lambda w: -w[0] * int(self.peak[w[1] : w[2]].max()))
        change, sure = np.zeros(self.size + 1, np.int64), np.zeros(self.size, np.int64)
        few, wanted = [w for w in wanted if w[2] - w[1] == 1], [w for w in wanted if w[2] - w[1] > 1]
        for factor, a, _ in few:
            docs, impacts = self.body(a)
            sure[docs] += factor * impacts
        for factor, a, b in wanted:
            np.add.at(change, self.first[a:b], factor * self.peak[a:b])
            np.subtract.at(change, self.last[a:b] + 1, factor * self.peak[a:b])
        bound = np.cumsum(change[:-1]) + sure
        docs = scores = np.zeros(0, np.int64)
        left = np.flatnonzero(bound)
        pivots = np.sort(left[np.argpartition(-bound[left], PIVOTS)[:PIVOTS]]) if len(left) > PIVOTS else left
        while len(pivots):
            left = np.setdiff1d(left, pivots, assume_unique=True)
            d, s = self.scored(pivots, bound[pivots], wanted, int(scores[k - 1]) if len(scores) >= k else 1)
            docs, scores = np.concatenate((docs, d)), np.concatenate((scores, s))
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            if len(scores) >= k:
                left = left[bound[left] >= scores[k - 1]]
            pivots = left[:PIVOTS]
        return docs, scores

    def scored(self, pivots: np.ndarray, bound: np.ndarray, wanted: list, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The pivots that score `least` or more. Term by term, weightiest first, a peak makes way for the true impact; who falls below is left out, and blocks that only they are in stay compressed."""
        for factor, a, b in wanted:
            at = a + np.searchsorted(self.last[a:b], pivots)
            inside = np.flatnonzero(at < b)
            inside = inside[self.first[at[inside]] <= pivots[inside]]
            if not len(inside):
                continue
            blocks = at[inside]
            bound[inside] -= factor * self.peak[blocks]
            bodies = [self.body(int(x)) for x in np.unique(blocks)]
            docs, impacts = (np.concatenate(part) for part in zip(*bodies))
            place = np.minimum(np.searchsorted(docs, pivots[inside]), len(docs) - 1)
            hit = docs[place] == pivots[inside]
            bound[inside[hit]] += factor * impacts[place[hit]]
            stay = bound >= least
            pivots, bound = pivots[stay], bound[stay]
        return pivots, bound
