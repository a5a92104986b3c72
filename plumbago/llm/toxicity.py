"""Toxicity by class-conditional Kneser-Ney models.

An expression is the beginning of a word (the first characters of a run of
letters, A-Z lower-cased), so that inflected forms count together; a model's
n-grams are expressions and pairs of adjacent expressions. For class c

    P_c(w | v) = max(c_c(v w) - D, 0) / c_c(v .) + lambda_c(v) P_c(w)
    P_c(w)     = max(c_c(w) - D, 0) / c_c(.)     + gamma_c S(w)
    S(w)       = number of distinct expressions before w, as a share of all pairs

where c_c counts documents of the class (at most as many as the n-gram has
distinct expressions before it, so that copies of a text add nothing; both
classes' counts are cut in proportion, in c_c(v .) too), D is the absolute discount, lambda and
gamma hand the discounted mass down, and the continuation probability S is
shared: it is taken over the documents of both classes. Class counts are used
for n-grams whose two counts differ by more than chance would let any n-gram of
the corpus differ (a likelihood ratio test, Bonferroni-corrected by the number
of n-grams, so that it needs no tuning). All other n-grams, rare ones above
all, have the shared backoff probability in both classes, scaled so that each
distribution sums to one. A text's score is the difference of its two
log-likelihoods per expression, calibrated by isotonic regression on labelled rows
that were not counted.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Words, bit_flag, bit_table, byte_class, drop, give_back, named, per_text, slices, span_hashes, table, texts_of, tune
from .quality import isotonic

#: Characters of an expression, absolute discount, and chance that any n-gram passes the test by luck. Set on a split of the training rows.
STEM, DISCOUNT, LUCK = 5, 0.75, 0.05
#: Bits of the table of labelled ids, at most.
LABEL_BITS = 1 << 27
#: Keys of a model's files that are handled at once.
FILE_KEYS = 1 << 16
#: Ids of no expression and of a text's start; expressions have ids of 32 bits from 2 on.
NONE, START = 0, 1
NOT_LETTER = byte_class(bytes(c for c in range(128) if not chr(c).isalpha()))


@dataclass
class Lookup:
    """Values of sorted keys; a small bit filter comes before the search."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Lookup:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    @cached_property
    def _maybe(self) -> np.ndarray:
        bits = np.zeros(1 << min(24, max(16, (8 * len(self.keys)).bit_length())), bool)
        for a in range(0, len(self.keys), FILE_KEYS):
            bits[self.keys[a : a + FILE_KEYS] & np.uint64(len(bits) - 1)] = True
        return bits

    def add_to(self, out: np.ndarray, keys: np.ndarray, known: np.ndarray | None = None) -> None:
        """Add the values of the keys that are here to `out`, and mark them in `known`."""
        if not len(self.keys):
            return
        at = np.flatnonzero(self._maybe[keys & np.uint64(len(self._maybe) - 1)])
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[place] == keys[at]
        at, place = at[hit], place[hit]
        out[at] += self.values[place]
        if known is not None:
            known[at] = True


class Mapped(Lookup):
    """A lookup of any size: its two files are sent to the executors by Spark's own file server and mapped there, not held in a worker's memory."""

    def __init__(self, name: str):
        self.name = name

    @cached_property
    def keys(self) -> np.ndarray:
        return np.memmap(SparkFiles.get(f"{self.name}.keys"), np.uint64, "r")

    @cached_property
    def values(self) -> np.ndarray:
        return np.memmap(SparkFiles.get(f"{self.name}.values"), np.float64, "r")

    def __getstate__(self):
        return {"name": self.name}


def lookup(rows: DataFrame, max_keys: int) -> Lookup:
    """All rows (k, value; distinct k): in memory up to max_keys, in files past that, which are written in pieces as the rows arrive in order."""
    got = rows.select("k", "value").limit(max_keys + 1).toArrow()
    if got.num_rows <= max_keys:
        return Lookup.of(got.column("k").to_numpy().view(np.uint64), got.column("value").to_numpy())
    name, folder = f"ngrams-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="plumbago-")
    # as numbers without a sign
    inorder = rows.select("k", "value").orderBy(F.col("k") < 0, "k").toLocalIterator()
    with open(f"{folder}/{name}.keys", "wb") as keys, open(f"{folder}/{name}.values", "wb") as values:
        while some := list(islice(inorder, FILE_KEYS)):
            np.array([r[0] for r in some], np.int64).tofile(keys)
            np.array([r[1] for r in some], np.float64).tofile(values)
    for part in ("keys", "values"):
        rows.sparkSession.sparkContext.addFile(f"{folder}/{name}.{part}")
    return Mapped(name)


@dataclass
class Model:
    words: Lookup = field(default_factory=Lookup)  # log P(w | toxic) - log P(w | ordinary), without context
    base: float = 0.0  # the same for all other expressions
    contexts: Lookup = field(default_factory=Lookup)  # what a context adds: log of its two lambdas' quotient
    pairs: Lookup = field(default_factory=Lookup)  # the whole difference of pairs with counts of their own
    knots: np.ndarray = field(default_factory=lambda: np.zeros((2, 1)))  # difference, probability

    def difference(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihood difference per expression; 0 without any."""
        w, ids = expressions(texts)
        before = contexts(w, ids)
        plain = np.zeros(len(ids))
        known = np.zeros(len(ids), bool)
        self.words.add_to(plain, ids, known)
        plain[~known] = self.base
        self.contexts.add_to(plain, before)
        own, paired = np.zeros(len(ids)), np.zeros(len(ids), bool)
        self.pairs.add_to(own, before << np.uint64(32) | ids, paired)
        total = np.bincount(w.text, weights=np.where(paired, own, plain), minlength=len(texts))
        return total / np.maximum(w.counts, 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.clip(np.interp(self.difference(texts), *self.knots), 0.0, 1.0)


def expressions(texts: list[bytes], stem: int = STEM) -> tuple[Words, np.ndarray]:
    """The runs of letters of the texts, and the id of each one's first `stem` characters."""
    w = Words([t.lower() for t in texts], hashes=False, apart=NOT_LETTER)
    lead = np.flatnonzero((w.data & 0xC0) != 0x80)
    nth = np.searchsorted(lead, w.starts) + stem
    ends = np.minimum(w.ends, np.append(lead, len(w.data))[np.minimum(nth, len(lead))])
    return w, np.maximum(span_hashes(w.data, w.starts, ends) >> np.uint64(32), np.uint64(START + 1))


def contexts(w: Words, ids: np.ndarray) -> np.ndarray:
    """The expression before each one, START for a text's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[w.first[w.counts > 0]] = START
    return before


def _once_a_text(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of one occurrence of each key in each text."""
    order = np.lexsort((keys, text))
    t, k = text[order], keys[order]
    return order[np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))]


def ngram_counts(rows: DataFrame, buffered: int = 1 << 21) -> DataFrame:
    """(k, c0, c1, before): documents of each class that have an n-gram; rows: text, y (0 or 1).

    The upper half of k is the expression before (NONE: k is a single
    expression), the lower half the expression. `before` is the number of
    distinct expressions before a pair. Counted in tasks first.
    """

    def run(batches):
        kept, size = [], 0

        def counted():
            k, u, n, ones = (np.concatenate(c) for c in zip(*kept))
            kept.clear()
            order = np.lexsort((u, k)).astype(np.int32)
            k, u = k[order], u[order]
            first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (u[1:] != u[:-1])))
            n, ones = (np.add.reduceat(c[order], first, dtype=np.int32) for c in (n, ones))
            made = [pa.array(k[first].view(np.int64)), pa.array(u[first].view(np.int32)), pa.array(n - ones), pa.array(ones)]
            del k, u, n, ones, order
            give_back(0.0)
            # the JVM holds a batch whole
            for a in range(0, len(first), BATCH_ROWS << 6):
                yield pa.RecordBatch.from_arrays([c.slice(a, BATCH_ROWS << 6) for c in made], ["k", "u", "c0", "c1"])

        for batch in batches:
            texts, y = texts_of(batch.column(0)), batch.column(1).to_numpy().astype(np.int64)
            for a, b in slices(texts):
                w, ids = expressions(texts[a:b])
                if not len(ids):
                    continue
                v = contexts(w, ids)
                for k, u in ((ids, np.zeros_like(ids)), (v << np.uint64(32) | ids, contexts(w, v))):
                    # a document counts at an n-gram's first place, its other places only show what comes before
                    n = np.zeros(len(k), bool)
                    n[_once_a_text(w.text, k)] = True
                    kept.append((k, u.astype(np.uint32), n, n & (y[a:b][w.text] == 1)))
                    size += len(k)
                if size > buffered:
                    yield from counted()
                    size = 0
        if kept:
            yield from counted()

    # dealt out by n-gram once, which both sums keep to; rows are added up in tasks already
    made = rows.select("text", "y").mapInArrow(run, "k long, u int, c0 int, c1 int").repartition("k")
    sums = [F.sum("c0").alias("c0"), F.sum("c1").alias("c1")]
    return made.groupBy("k", "u").agg(*sums).groupBy("k").agg(*sums, F.count("*").alias("before"))


def _ratio_test(c0: Column, c1: Column, e0: Column, e1: Column) -> Column:
    """Likelihood ratio of two counts against expectations in the proportion e0 : e1."""
    share = (c0 + c1) / (e0 + e1)
    term = lambda c, e: F.when(c > 0, c * F.log(c / (share * e))).otherwise(0.0)
    return 2 * (term(c0, e0) + term(c1, e1))


def fit(
    labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", discount: float = DISCOUNT, luck: float = LUCK, support: int = 5,
    calibration: int = 5, max_keys: int = 1 << 18,
) -> Model:
    """Fit on the rows whose label is 0 or 1, all of them.

    Counts are summed in Spark; the n-grams that pass the test reach the tasks, all of them:
    up to `max_keys` of each kind in their memory (16 bytes each), more in mapped files. Pairs are tested from `support`
    documents on. Every `calibration`-th row by the text's hash is kept for the
    calibration and not counted (all rows serve for both if one part
    would lack a class). Repeated rows count each; null and empty texts have no
    expressions. Without rows of both classes the model is constant: the share
    of ones (0 without any row).
    """
    tune(labelled.sparkSession)
    text = named(text_col).cast("string")
    rows = labelled.where(named(label_col).isin(0, 1)).select(text.alias("text"), named(label_col).cast("int").alias("y"))
    rows = table(rows.withColumn("later", F.pmod(F.xxhash64("text", F.lit(23)), F.lit(calibration)) == 0))
    n = {(r.y, r.later): r["n"] for r in rows.groupBy("y", "later").agg(F.count("*").alias("n")).collect()}
    n0, n1 = (sum(n.get((y, x), 0) for x in (False, True)) for y in (0, 1))
    if not n0 or not n1:
        return Model(knots=np.array([[0.0], [n1 / max(1, n0 + n1)]]))
    apart = len(n) == 4
    counts = table(ngram_counts(rows.where("NOT later") if apart else rows))
    model = from_counts(counts, discount, luck, support, max_keys)
    model.knots = _calibrated(rows.where("later") if apart else rows, model)
    drop(rows, counts)
    return model


def from_counts(counts: DataFrame, discount: float = DISCOUNT, luck: float = LUCK, support: int = 5, max_keys: int = 1 << 18) -> Model:
    """The two models' differences from a table of ngram_counts; no n-grams: no difference."""
    upper, lower = F.shiftrightunsigned("k", 32), F.col("k").bitwiseAND(F.lit(0xFFFFFFFF))
    pairs = counts.where(upper != NONE).select(upper.alias("v"), lower.alias("w"), "c0", "c1", "before")
    shared = pairs.groupBy("w").agg(F.count("*").alias("n"))
    cut = F.least(F.lit(1.0), F.col("n") / (F.col("c0") + F.col("c1")))
    words = counts.where(upper == NONE).select(F.col("k").alias("w"), "c0", "c1").join(shared, "w")
    words = table(words.select("w", (F.col("c0") * cut).alias("a0"), (F.col("c1") * cut).alias("a1"), "n"))
    t = words.agg(
        F.sum("a0").alias("N0"), F.sum("a1").alias("N1"), F.sum((F.col("a0") > 0).cast("int")).alias("T0"), F.sum((F.col("a1") > 0).cast("int")).alias("T1"),
        F.sum("n").alias("pairs"), F.count("*").alias("types"),
    ).first()
    if not t["N0"] or not t["N1"]:
        return Model()
    total = (t["N0"], t["N1"])
    gamma = [discount * t[f"T{c}"] / total[c] for c in (0, 1)]
    test = _ratio_test(F.col("a0"), F.col("a1"), F.lit(float(total[0])), F.lit(float(total[1])))
    floor = 2 * math.log(t["types"] / luck)
    own = lambda c: F.greatest(F.col(f"a{c}") - discount, F.lit(0.0)) / total[c] + gamma[c] * F.col("n") / t["pairs"]
    firm = words.withColumn("g", test).where(F.col("g") > floor)
    mass = firm.agg(F.sum(own(0)), F.sum(own(1)), F.sum("n") / t["pairs"]).first()
    rest = [max(1e-12, 1 - (mass[c] or 0)) / max(1e-12, 1 - (mass[2] or 0)) for c in (0, 1)]  # scale of the shared probabilities
    apart = F.log(own(1)) - F.log(own(0))
    model = Model(lookup(firm.select(F.col("w").alias("k"), apart.alias("value")), max_keys), math.log(rest[1] / rest[0]))

    # pairs whose counts differ from what their parts let one expect
    cut = F.least(F.lit(1.0), F.col("before") / (F.col("c0") + F.col("c1")))
    pairs = pairs.select("v", "w", (F.col("c0") * cut).alias("c0"), (F.col("c1") * cut).alias("c1"))
    within = pairs.groupBy("v").agg(F.sum("c0").alias("v0"), F.sum("c1").alias("v1"))
    cand = pairs.where(F.col("c0") + F.col("c1") >= support).join(within, "v").join(words.withColumn("g", test), "w")
    low = lambda c: F.when(F.col("g") > floor, own(c)).otherwise(rest[c] * F.col("n") / t["pairs"])
    cand = cand.withColumns({"p0": low(0), "p1": low(1)})
    test2 = _ratio_test(F.col("c0"), F.col("c1"), F.greatest("v0", F.lit(0.5)) * F.col("p0"), F.greatest("v1", F.lit(0.5)) * F.col("p1"))
    firm = table(cand.where(test2 > 2 * math.log(t["pairs"] / luck)).select("v", "w", "c0", "c1", "v0", "v1", "p0", "p1"))
    e = lambda c: F.greatest(F.col(f"c{c}") - discount, F.lit(0.0)) / F.greatest(F.col(f"v{c}"), F.lit(1.0))
    left = table(firm.groupBy("v").agg((1 - F.sum(e(0))).alias("l0"), (1 - F.sum(e(1))).alias("l1")))
    whole = lambda c: e(c) + F.col(f"l{c}") * F.col(f"p{c}")
    model.contexts = lookup(left.select(F.col("v").alias("k"), (F.log("l1") - F.log("l0")).alias("value")), max_keys)
    value = F.log(whole(1)) - F.log(whole(0))
    model.pairs = lookup(firm.join(left, "v").select(F.shiftleft("v", 32).bitwiseOR(F.col("w")).alias("k"), value.alias("value")), max_keys)
    drop(words, firm, left)
    return model


def _calibrated(rows: DataFrame, model: Model, bins: int = 40001, reach: float = 2.0) -> np.ndarray:
    """Isotonic regression of the label on the difference, over a histogram of at most `bins` bins that Spark sums."""
    def run(texts):
        d = np.clip(model.difference(texts), -reach, reach)
        return {"bin": np.rint((d + reach) / (2 * reach) * (bins - 1)).astype(np.int64)}

    got = per_text(rows, run, "bin long", text="text", keep=["y"]).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).toPandas().sort_values("bin")
    return isotonic(got["bin"].to_numpy() / (bins - 1) * 2 * reach - reach, got["n"].to_numpy(float), got["ones"].to_numpy(float), ends=True)


def labelled_rows(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """(text, label) of the documents that `labels` covers; of several labels of one id, the greatest; null ids have none.

    All labelled rows, however many: both sides are shuffled by id, and each
    task holds its own share of the labels (not of the texts) in a hash table. A table of at most
    LABEL_BITS bits keeps most texts without a label out of the shuffle.
    """
    spark = docs.sparkSession
    tune(spark)
    one = labels.where(named(id_col).isNotNull() & named(label_col).isNotNull()).groupBy(named(id_col).alias("id")).agg(F.max(named(label_col)).alias("label"))
    may = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    # numbers or strings of one type are equal just where their texts are
    kind = one.schema["id"].dataType.simpleString()
    if kind == may.schema["id"].dataType.simpleString() and kind in ("int", "bigint", "string"):
        key = F.xxhash64(F.col("id").cast("string"))
        hashes = table(one.select(key.alias("h")))
        may = may.where(bit_flag(bit_table(hashes, LABEL_BITS), spark)(key))
        drop(hashes)
    both = may.join(one.hint("shuffle_hash"), "id")
    return both.select(F.col("text").alias(text_col), F.col("label").alias(label_col))


def scorer(df: DataFrame, model: Model, threshold: float):
    """The function of slices of texts that gives their scores, and its columns' DDL; the model is sent to each executor once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        s = shared.value.score(texts)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return run, "score double, predicted int"


def score(df: DataFrame, model: Model, *, text_col: str = "text", keep: list[str], threshold: float = 0.7) -> DataFrame:
    """`keep`, score (0 to 1), predicted (score >= threshold), for each row.

    A null or empty text has no words and gets the score of a difference of 0.
    Every row is scored on its own, repeated or not; texts are read whole.
    Empty table: empty result. Columns other than the text and `keep` are
    ignored, whatever their names.
    """
    return per_text(df, *scorer(df, model, threshold), text=text_col, keep=keep)
