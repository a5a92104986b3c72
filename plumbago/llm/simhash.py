"""SimHash near-duplicates: fingerprints and a binary-trie self-join.

Two tries hold the distinct fingerprints: one over bits 0..63, one over the
bits rotated by half. Of at most `budget` differing bits, one of the halves
has at most budget // 2, so in one of the two tries the error budget of the
first 32 levels is budget // 2 and below it the whole budget. The top levels of
a trie are the tasks: a fingerprint goes to its own subtree and to those whose
prefix differs in as many bits as the budget allows. In a task, node pairs are
walked together level by level, differing bits are added up, and a pair is
pruned when it exceeds the budget. Subtrees over `cell_rows` fingerprints are
cut into blocks that meet pairwise.

Where a similarity of the texts themselves is asked for, no budget of bits finds
all pairs. The trie's links are then candidates that are verified by the sets of
shingles, and a prefix-filtered join on rare shingles finds what is missing,
exactly and at any distance.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Words, bit_flag, bit_table, drop, give_back, has_bit, named, per_text, slices, table, texts_of, tune
from .graph import components, union

FULL = (1 << 64) - 1


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles of a text, A-Z lower-cased; no word: 0."""
    return of_hashes(shingle_hashes(text, words, seed))


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words: of the whole sequence; none: no hash."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64)


def of_hashes(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[s : s + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, also=()) -> DataFrame:
    """(id, `also`, fp long) for each row; a null text has no words, and so fingerprint zero."""

    def run(texts):
        return {"fp": np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)}

    return per_text(df, run, "fp long", text=text_col, keep=[id_col, *also])


def trie_pairs(a: np.ndarray, b: np.ndarray, budget: int, part: int, span: int, emit) -> None:
    """Walk the tries of a and b (sorted distinct uint64 arrays; the same object: a self-join) together.

    `emit(i, j)` gets index arrays of pairs within `budget` bits. `part` is the
    budget of the first `span` levels. The frontier is handled in pieces, depth
    first, so memory stays bounded.
    """
    same = a is b
    one = lambda x: np.array([x], np.int64)
    stack = [(0, one(0), one(len(a)), one(0), one(len(b)), one(0))] if len(a) and len(b) else []
    while stack:
        level, l1, h1, l2, h2, d = stack.pop()
        if len(l1) > 1 << 17:
            for s in range(0, len(l1), 1 << 17):
                stack.append((level, *(x[s : s + (1 << 17)] for x in (l1, h1, l2, h2, d))))
            continue
        small = (h1 - l1) * (h2 - l2) <= 32
        if level == 64:
            small[:] = True
        if small.any():
            n1, n2 = (h1 - l1)[small], (h2 - l2)[small]
            n = n1 * n2
            at = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = l1[small][at] + k // n2[at], l2[small][at] + k % n2[at]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                emit(i[near], j[near])
            l1, h1, l2, h2, d = (x[~small] for x in (l1, h1, l2, h2, d))
        if not len(l1):
            continue
        bit = np.uint64(1 << (63 - level))
        upto = np.uint64(FULL ^ ((1 << (63 - level)) - 1))
        m1 = np.clip(np.searchsorted(a, (a[l1] & upto) | bit), l1, h1)
        m2 = np.clip(np.searchsorted(b, (b[l2] & upto) | bit), l2, h2)
        most = part if level < span else budget
        kids = []
        for x, y, z, w, cost in ((l1, m1, l2, m2, 0), (m1, h1, m2, h2, 0), (l1, m1, m2, h2, 1), (m1, h1, l2, m2, 1)):
            ok = (y > x) & (w > z) & (d + cost <= most)
            if same and cost and (x is m1):
                ok &= l1 != l2  # of a node with itself, the mixed pair comes once
            kids.append((x[ok], y[ok], z[ok], w[ok], d[ok] + cost))
        merged = tuple(np.concatenate(c) for c in zip(*kids))
        if len(merged[0]):
            stack.append((level + 1, *merged))


def _tries(budget: int) -> tuple[int, int]:
    """Number of tries, and the budget of a trie's first 64 / tries levels: one of so many blocks of bits has at most that."""
    tries = 2 if budget < 8 else 4
    return tries, budget // tries


def _cells(fps: DataFrame, budget: int, cell_rows: int) -> DataFrame:
    """Rows (trie, lo, hi, i, j, side, key, other columns): a task's two sets of keys have one value of the first five."""
    more = [c for c in fps.columns if c != "fp"]
    n = fps.count()
    tries, part = _tries(budget)
    span = 64 // tries
    depth = max(0, min(span, 24, math.ceil(math.log2(max(1, n) / cell_rows * 4)))) if n > cell_rows else 0
    masks = [sum(1 << b for b in bits) for k in range(part + 1) for bits in itertools.combinations(range(depth), k)]
    both = None
    for t in range(tries):
        turned = F.shiftleft("fp", span * t).bitwiseOR(F.shiftrightunsigned("fp", 64 - span * t)) if t else F.col("fp")
        one = fps.select(F.lit(t).alias("trie"), turned.alias("key"), *more)
        both = one if both is None else both.union(one)
    top = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    both = both.withColumn("own", top)
    sizes = both.groupBy("trie", "own").agg(F.count("*").alias("n_keys"))
    # blocks of a subtree; a pair of subtrees meets block by block
    blocks = sizes.select("trie", "own", F.ceil(F.col("n_keys") / cell_rows).cast("int").alias("k"))
    placed = both.join(blocks, ["trie", "own"])
    mine = F.pmod(F.xxhash64("key"), F.col("k").cast("long")).cast("int")
    placed = placed.withColumn("block", mine).withColumn("other", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(m)) for m in masks])))
    ks = blocks.select(F.col("trie"), F.col("own").alias("other"), F.col("k").alias("k2"))
    placed = placed.join(ks, ["trie", "other"])  # only subtrees that exist
    first = F.col("own") <= F.col("other")
    placed = placed.withColumn("meet", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
    cell = [
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), F.least("block", "meet")).when(first, F.col("block")).otherwise(F.col("meet")).alias("i"),
        F.when(F.col("own") == F.col("other"), F.greatest("block", "meet")).when(first, F.col("meet")).otherwise(F.col("block")).alias("j"),
    ]
    side = F.when(F.col("own") == F.col("other"), F.col("block")).otherwise(F.when(first, -1).otherwise(-2)).alias("side")
    return placed.select("trie", *cell, side, "key", *more)


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The two sorted sets of keys of a task (one object for a set that meets itself)."""
    x = pdf.iloc[0]
    key, side = pdf["key"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
    if x["lo"] == x["hi"] and x["i"] == x["j"]:
        a = np.unique(key)
        return a, a
    one, two = (x["i"], x["j"]) if x["lo"] == x["hi"] else (-1, -2)
    return np.unique(key[side == one]), np.unique(key[side == two])


def _turn_back(keys: np.ndarray, bits: int) -> np.ndarray:
    if bits:
        keys = (keys >> np.uint64(bits)) | (keys << np.uint64(64 - bits))
    return keys.view(np.int64)


def links(fps: DataFrame, budget: int = 3, cell_rows: int = 20000) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of `fps` (column fp, long).

    All pairs within `budget` bits are found; of each task's pairs, a spanning
    forest is returned, which has the same components. Budgets below 32 only.
    """
    tries, part = _tries(budget)
    span = 64 // tries

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(pdf)
        names = a if a is b else np.union1d(a, b)
        parent = np.arange(len(names))
        ia, ib = np.searchsorted(names, a), np.searchsorted(names, b)
        trie_pairs(a, b, budget, part, span, lambda i, j: union(parent, ia[i], ib[j]))
        moved = np.flatnonzero(parent != np.arange(len(names)))
        back = int(pdf["trie"].iloc[0]) * span
        return pd.DataFrame({"a": _turn_back(names[moved], back), "b": _turn_back(names[parent[moved]], back)})

    return _cells(fps.select("fp"), budget, cell_rows).groupBy("trie", "lo", "hi", "i", "j").applyInPandas(walk, "a long, b long")


SHINGLE = Rolling(0xA24BAED4963EE407)
#: Slots of the sketch that orders shingles by how often they occur.
SKETCH = 1 << 20


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, size): the distinct shingles of a slice of texts, by text and hash, and each text's number of them.

    A-Z lower-cased; a text of fewer words has one shingle, the whole sequence; a text without words none.
    """
    w = Words([t.lower() for t in texts])
    at = np.arange(max(0, len(w.hash) - words + 1))
    at = at[w.text[at] == w.text[at + words - 1]]
    short = np.flatnonzero((w.counts > 0) & (w.counts < words))
    starts, ends = np.concatenate([at, w.first[short]]), np.concatenate([at + words, w.last[short]])
    text, h = np.concatenate([w.text[at], short]), SHINGLE.spans(w.hash, starts, ends)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    text, h = text[new], h[new]
    return text, h, np.bincount(text, minlength=len(texts))


def prefixes(text: np.ndarray, h: np.ndarray, size: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, rank) of each text's prefix: its rarest shingles by (count in the sketch, hash), ranks from 0.

    Two similar sets have their first common shingle, in that order, where either
    still has enough shingles to come, itself included: at least the share `similarity` of its own.
    """
    order = np.lexsort((h, counts[h & np.uint64(SKETCH - 1)], text))
    text, h = text[order], h[order]
    rank = np.arange(len(h)) - (np.cumsum(size) - size)[text]
    near = size[text] - rank >= similarity * size[text] - 1e-9
    return text[near], h[near], rank[near]


def _shared_prefixes(df: DataFrame, words: int, similarity: float, max_filter_bits: int, sample_rows: int = 50_000) -> DataFrame:
    """(h, th, n, i) as a table: prefix shingles that more than one row has, with their text, its number of shingles and their rank in it. df: th, text.

    The order of the shingles is set by a sketch of about `sample_rows` texts,
    chosen by hash; any order finds the same pairs, with more or less work.
    """
    sc = df.sparkSession.sparkContext

    def sketch(batches):
        sums = np.zeros(SKETCH, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                np.add.at(sums, shingle_sets(texts[a:b], words)[1] & np.uint64(SKETCH - 1), 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["slot", "n"])

    some = F.pmod(F.xxhash64("th", F.lit(31)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / max(1, df.count())) * (1 << 30)))
    got = df.where(some).select("text").mapInArrow(sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    counts = np.zeros(SKETCH, np.int32)
    counts[got.column("slot").to_numpy()] = np.minimum(got.column("n").to_numpy(), (1 << 31) - 1)
    order = sc.broadcast(counts)

    def count(batches):
        for batch in batches:
            found, texts = [np.zeros(0, np.uint64)], list({t for t in texts_of(batch.column(0)) if t})
            for a, b in slices(texts):
                found.append(prefixes(*shingle_sets(texts[a:b], words), order.value, similarity)[1])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
        give_back()

    repeated = table(df.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    shared = sc.broadcast(bit_table(repeated, max_filter_bits))
    drop(repeated)

    def again(batches):
        for batch in batches:
            th, texts = batch.column(0).to_numpy(), texts_of(batch.column(1))
            for a, b in slices(texts):
                text, h, size = shingle_sets(texts[a:b], words)
                text, h, rank = prefixes(text, h, size, order.value, similarity)
                hit = has_bit(shared.value, h.view(np.int64))
                text, h, rank = text[hit], h[hit], rank[hit]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(th[a:b][text]), pa.array(size[text]), pa.array(rank)], ["h", "th", "n", "i"])
        give_back()

    return table(df.select("th", "text").where("text IS NOT NULL").mapInArrow(again, "h long, th long, n long, i long").distinct())


#: Bins of shingles by hash; counts in them bound what two sets share.
BINS = 128


def _sets(df: DataFrame, wanted: DataFrame, words: int, max_filter_bits: int) -> DataFrame:
    """(th, set, bins) as a table: the shingles of the texts whose hash is in `wanted`, and how many of them fall into each of BINS bins. df: th, text."""

    def run(texts):
        text, h, size = shingle_sets(texts, words)
        bins = np.bincount(text * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), minlength=len(texts) * BINS).astype(np.int32).reshape(-1, BINS)
        return {"set": np.split(h.view(np.int64), np.cumsum(size)[:-1]), "bins": list(bins)}

    wanted = table(wanted.distinct())
    some = bit_flag(bit_table(wanted.select(F.col("th").alias("h")), max_filter_bits), df.sparkSession)
    one = df.where(some("th")).join(wanted, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    out = table(per_text(one, run, "set array<long>, bins array<int>", text="text", keep=["th"]))
    drop(wanted)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, max_filter_bits: int) -> DataFrame:
    """The rows of `pairs` (a, b: text hashes) whose sets have that Jaccard similarity, as a table; two empty sets are equal.

    Two sets share no more in a bin than the smaller of their counts there: pairs that
    this rules out go before whole sets are joined, and only sets of the pairs left are shuffled.
    """
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("th").alias(end), F.col("bins").alias(name)), end)
    most = total(F.zip_with("x", "y", lambda x, y: F.least(x, y)))
    pairs = table(pairs.where(most >= F.lit(similarity / (1 + similarity)) * (total(F.col("x")) + total(F.col("y"))) - 1e-9).select("a", "b"))
    both = pairs
    for end, name in (("a", "x"), ("b", "y")):
        some = bit_flag(bit_table(pairs.select(F.col(end).alias("h")).distinct(), max_filter_bits), pairs.sparkSession)
        both = both.join(sets.where(some("th")).select(F.col("th").alias(end), F.col("set").alias(name)), end)
    shared = F.size(F.array_intersect("x", "y"))
    out = table(both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"))
    drop(pairs)
    return out


def _merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """The table of components (th, component) after further links (a, b): only the components that these touch are joined anew."""
    if links.isEmpty():
        return of
    for end in ("a", "b"):
        links = links.join(of.select(F.col("th").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    links = table(links.where("a <> b").distinct())
    new = table(components(links))
    out = of.join(new.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("th", F.coalesce("up", "component").alias("component"))
    # texts that were on their own
    out = table(out.union(new.select(F.col("node").alias("th"), "component").join(of.select("th"), "th", "left_anti")))
    drop(links, new, of)
    return out


#: Rows of prefixes that a round may compare with hubs, as a multiple of all rows of prefixes.
ROUND = 32
#: Shingles of a text before each one that tell whether two texts have met at an earlier one.
EARLIER = 4
#: Number of first rounds, in which texts meet only the texts that their shingles name, and how many a shingle names.
NAMED, PICKS = 1, 4


def _meetings(rows: DataFrame, enough: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Pairs (a, th) of texts of different components to be compared, of which a is a hub of this round. rows: h, th, n, i, early, component, now, earlier.

    Texts that share a shingle in `earlier` meet at that one, where both are earlier
    still and have more to come, so a passage that two texts share makes one row
    of them, not one a shingle. Two hubs meet once, not once from each side.
    """
    others = rows.select("h", "th", "n", "i", "early", "component", "now", "earlier")
    centres = rows.where("now").select("h", *[F.col(c).alias(d) for c, d in (("th", "a"), ("n", "na"), ("i", "ia"), ("early", "ea"), ("component", "ca"), ("earlier", "before"))])
    new = ~F.coalesce(F.arrays_overlap("earlier", "before"), F.lit(False))
    fits = (F.col("component") != F.col("ca")) & enough(F.col("n"), F.col("i"), F.col("na"), F.col("ia")) & (~F.col("now") | (F.col("a") < F.col("th"))) & new
    met = centres.where("ea").join(others, "h").where(fits).select("a", "th")
    return met.union(centres.where("NOT ea").join(others.where("early"), "h").where(fits).select("a", "th"))


def similar_components(texts: DataFrame, df: DataFrame, *, words: int, budget: int, similarity: float, cell_rows: int, max_filter_bits: int = 1 << 27) -> DataFrame:
    """(th, component) as a table: the least text hash that links of Jaccard similarity >= `similarity` reach, for texts with any. texts: th, fp; df: th, text.

    First the trie's links between fingerprints, verified. Then NAMED rounds in
    which each shingle names some texts of its largest component (PICKS, chosen
    anew each round), and its texts outside meet only those: a multiple of the
    rows at most, after which a group of copies is one component but for a few.
    Then exact rounds: all texts outside a shingle's largest component are hubs,
    which are compared with all others of other components whose first common
    shingle comes early enough for both to have enough more, and are done with;
    the shingle then is, too. Where that would compare more than ROUND times the
    rows, a share of the hubs, by hash, is left to later rounds. No pair
    between components is left out.

    Of two similar texts, the one of fewer shingles has the first common one among
    its own first ninth, roughly (at similarity 0.8): only such rows meet all others, so that a
    passage in many texts, which comes after each one's own words, makes no pairs of them.
    """
    stand = texts.groupBy("fp").agg(F.min("th").alias("th"))
    near = links(stand, budget, cell_rows)
    a, b = stand.select(F.col("fp").alias("a"), F.col("th").alias("ta")), stand.select(F.col("fp").alias("b"), F.col("th").alias("tb"))
    pairs = near.join(a, "a").join(b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    equal = texts.join(stand.select("fp", F.col("th").alias("a")), "fp").where("th <> a").select("a", F.col("th").alias("b"))
    pairs = table(pairs.union(equal).distinct())
    rows = _shared_prefixes(df, words, similarity, max_filter_bits)
    # as the text of fewer shingles, at most as far as both being equally long allows
    graded = rows.withColumn("early", F.col("n") - F.col("i") >= F.lit(2 * similarity / (1 + similarity)) * F.col("n") - 1e-9)
    more = graded.groupBy("h").agg(F.count("*").alias("k"), F.count_if("early").alias("e")).where("k > 1 AND e > 0")
    several = table(graded.join(more.select("h"), "h", "left_semi"))
    drop(rows)
    rows = several
    most = ROUND * rows.count()
    sets = _sets(df, pairs.select(F.col("a").alias("th")).union(pairs.select(F.col("b").alias("th"))).union(rows.select("th")), words, max_filter_bits)
    found = _verified(pairs, sets, similarity, max_filter_bits)
    of = table(components(found).select(F.col("node").alias("th"), "component"))
    drop(pairs, found)
    done = 0
    while True:
        before = rows
        rows = rows.select("h", "th", "n", "i", "early").join(of, "th", "left").withColumn("component", F.coalesce("component", "th"))
        picks = [F.min(F.struct(F.xxhash64("th", F.lit(done * PICKS + k)).alias("x"), "th", "n", "i", "early")).alias(f"p{k}") for k in range(PICKS if done < NAMED else 0)]
        some = rows.groupBy("h", "component").agg(F.count("*").alias("m"), F.count_if("early").alias("e"), *picks)
        named_texts = F.array(*[F.struct(*[F.col(f"p{k}.{c}").alias(c) for c in ("th", "n", "i", "early")]) for k in range(len(picks))])
        largest = F.max_by(F.struct("component", "m", *([F.array_distinct(named_texts).alias("named")] if picks else [])), F.struct("m", "component"))
        some = some.groupBy("h").agg(F.sum("m").alias("k"), F.sum("e").alias("e"), F.count("*").alias("parts"), largest.alias("major"))
        some = table(some.where("parts > 1 AND e > 0").drop("parts"))
        if some.isEmpty():
            drop(before, sets, some)
            return of
        rows = table(rows.join(some, "h"))
        drop(before, some)
        outside = rows.where(F.col("component") != F.col("major.component"))
        # what is left from the first common shingle on must be enough for both
        enough = lambda n, i, m, j: F.least(n - i, m - j) >= F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9
        if done < NAMED:
            # a component of one text has named it before
            met = outside.where(F.col("major.m") > (1 if done else 0)).select("th", "n", "i", "early", F.explode("major.named").alias("p"))
            met = met.where((F.col("early") | F.col("p.early")) & enough(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i"))).select("th", F.col("p.th").alias("a"))
            met = table(met.select(F.least("a", "th").alias("a"), F.greatest("a", "th").alias("b")).distinct())
            found = _verified(met, sets, similarity, max_filter_bits)
            drop(met)
            of = _merged(of, found)
            drop(found)
            done += 1
            continue
        # EARLIER shingles of the same text before each row, in the order that all texts share
        places = Window.partitionBy("th").orderBy("i")
        earlier = F.array(*[F.lag("h", k).over(places) for k in range(1, EARLIER + 1)]).alias("earlier")
        hubs = outside.select("th").distinct().withColumn("hub", F.lit(True))
        marked = table(rows.join(hubs, "th", "left").select("h", "th", "n", "i", "early", "component", "k", "e", F.coalesce("hub", F.lit(False)).alias("hub"), earlier))
        meet = marked.where("hub").groupBy("h").agg((F.count_if("early") * F.max("k") + F.count_if(~F.col("early")) * F.max("e")).alias("x")).agg(F.sum("x")).first()[0]
        share = F.lit(max(1, int(min(1.0, most / max(1, meet)) * (1 << 30))))
        judged = marked.withColumn("now", F.col("hub") & (F.pmod(F.xxhash64("th", F.lit(done)), F.lit(1 << 30)) < share))
        met = _meetings(judged, enough)
        met = table(met.select(F.least("a", "th").alias("a"), F.greatest("a", "th").alias("b")).distinct())
        found = _verified(met, sets, similarity, max_filter_bits)
        left = table(judged.where("NOT now").select("h", "th", "n", "i", "early"))
        drop(rows, marked, met)
        of = _merged(of, found)
        drop(found)
        rows, done = left, done + 1


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3, seed: int = 42, cell_rows: int = 20000,
    similarity: float | None = None,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable).

    Documents link if their fingerprints differ in at most `budget` bits; where
    `similarity` is given, if their sets of shingles have at least that Jaccard
    similarity instead, whatever their fingerprints. A null or empty text has
    fingerprint zero and no shingles and links with its like. Copies are one
    class and meet once. Repeated ids are rows of their own with the same id; a
    null id never names a component unless all its members' ids are null. Very
    long texts are read whole. Empty table: empty result. Columns other than the
    two are ignored.
    """
    tune(df.sparkSession)
    text = named(text_col).cast("string")
    base = df.select(named(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    docs = table(fingerprints(base, id_col="id", words=words, seed=seed, also=["th"]))
    key = "fp" if similarity is None else "th"
    classes = table(docs.groupBy(key).agg(F.min("id").alias("low"), *([F.first("fp").alias("fp")] if key == "th" else [])), docs.count())
    if similarity is None:
        comp = components(links(classes, budget, cell_rows)).select(F.col("node").alias(key), "component")
    else:
        comp = similar_components(classes.select("th", "fp"), base.select("th", "text"), words=words, budget=budget, similarity=similarity, cell_rows=cell_rows)
    of = classes.select(key, "low").join(comp, key, "left").withColumn("component", F.coalesce("component", key))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(low, "component").select(key, "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return docs.join(of, key).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `df` that stand for their group: one document (the least id) of each component.

    Repeated rows of the kept id all stay; rows with a null id stay only if no
    other id is in their group. Columns of `df` are returned as they are,
    whatever their names. Empty table: empty result.
    """
    verdict = near_duplicates(df, id_col=id_col, **options)
    stays = table(verdict.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).cast("long").alias("id")).distinct())
    rows = df.select(F.struct(*map(named, df.columns)).alias("row"), named(id_col).cast("long").alias("me"))
    return rows.join(stays, F.col("me").eqNullSafe(F.col("id")), "left_semi").select("row.*")
