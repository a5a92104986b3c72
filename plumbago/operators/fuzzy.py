"""Fuzzy pairs of labels: an exact join for high token-set ratios of stemmed words."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions.code import vectorised
from plumbago.functions.stem import stem
from plumbago.runtime import scratch, ship


@vectorised("string")
def stemmed_set(label: pd.Series) -> pd.Series:
    """The distinct stemmed words of a label (what lies between characters that are no letter or digit), sorted, joined by spaces."""
    def one(x):
        kept = "".join(c if c.isalnum() else " " for c in " ".join(stem(w) for w in (x or "").lower().split()))
        return " ".join(sorted(set(kept.split())))

    return label.map(one)


def token_set_score(a: str, b: str) -> int:
    """0 to 100: the best ratio of the common words, with and without either side's other words (both sides as from stemmed_set)."""
    s, t = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(x)) for x in (s & t, s - t, t - s))
    if both and not (left and right):
        return 100
    x, y = f"{both} {left}".strip(), f"{both} {right}".strip()

    def ratio(p, q):
        return round(100 * difflib.SequenceMatcher(None, p, q, autojunk=False).ratio()) if p and q else 0

    return max(ratio(both, x), ratio(both, y), ratio(x, y))


@vectorised("int")
def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b)])


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "fuzzy")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_rarity(parts: DataFrame) -> DataFrame:
    """(key, part, ...) with `before`: how much of the key, by `size`, its rarer parts make up, and `rank` among them."""
    n = parts.groupBy("part").agg(F.count("*").alias("n"))
    order = W.partitionBy("key").orderBy("n", "part")
    return parts.join(n, "part").withColumns({"rank": F.row_number().over(order), "before": F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})


def _pairs(a: DataFrame, b: DataFrame, also: Column) -> DataFrame:
    """Different keys that share a part and meet `also` (of x, y, sx, sy), in both tables' order, the lesser first; a and b: part, key, s."""
    x, y = a.select("part", F.col("key").alias("x"), F.col("s").alias("sx")), b.select("part", F.col("key").alias("y"), F.col("s").alias("sy"))
    both = x.join(y, "part").where((F.col("x") != F.col("y")) & also)
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


#: Numbers of 64 bits that sum up a key's parts; a bit that is set in one key's and not in another's tells of a part that the other lacks.
LONGS = 4


def _bits(parts: DataFrame) -> DataFrame:
    """(key, s): a bit for each part of a key, by its hash, in an array of LONGS numbers."""
    at = F.pmod(F.xxhash64("part", F.lit(5)), F.lit(64 * LONGS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)))
    return parts.groupBy("key").agg(F.array(*[F.bit_or(F.when(F.floor(at / 64) == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(LONGS)]).alias("s"))


def _lacked(one: str, other: str) -> Column:
    """How many bits of one key the other hasn't: never more than the parts that it lacks."""
    return sum((F.bit_count(F.get(one, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(i))))) for i in range(1, LONGS)), F.bit_count(F.get(one, F.lit(0)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(0))))))


#: Keys of a block that share a part, and how many of them meet a block at once.
BLOCK, AT_ONCE = 16384, 64


def _alike(keys: DataFrame) -> DataFrame:
    """Different keys that share a part, where either's bits lack at most `lost` of the other's; the lesser first. keys: part, n, key, s, lost.

    Parts are few and in many keys, so these meet in blocks by part and n, and a task compares the bits of a key with those of a whole block at once, so no row is a pair before it passes.
    """
    ship(keys.sparkSession)
    cut = F.col("n") / BLOCK + 1
    every, mine = F.explode(F.sequence(F.lit(0), cut.cast("int") - 1)), F.pmod(F.xxhash64("key"), cut.cast("int")).cast("int")
    x = keys.select("part", mine.alias("i"), every.alias("j"), "key", "s", "lost")
    y = keys.select(F.col("part").alias("of"), every.alias("p"), mine.alias("q"), F.col("key").alias("other"), F.col("s").alias("t"), F.col("lost").alias("most"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.intp), np.zeros(0, np.intp))]
        if len(x) and len(y):
            x, y = x.sort_values("key"), y.sort_values("other")
            sx, sy = (np.ascontiguousarray(np.stack(z.to_numpy()).view(np.uint64).T) for z in (x["s"], y["t"]))
            lx, ly, unset = x["lost"].to_numpy(), y["most"].to_numpy(), ~sy
            for first in range(0, len(x), AT_ONCE):
                some = slice(first, first + AT_ONCE)
                # lesser keys have met these already
                after = int(y["other"].searchsorted(x["key"].iloc[first]))
                # 256 bits at most, so a sum that overflows lets a pair pass
                lacked = sum(np.bitwise_count(sx[i, some, None] & unset[i, after:]) for i in range(LONGS))
                p, q = np.nonzero(lacked <= lx[some, None])
                p, q = p + first, q + after
                good = np.bitwise_count(sy[:, q] & ~sx[:, p]).sum(axis=0) <= ly[q]
                found.append((p[good], q[good]))
        p, q = (np.concatenate(z) for z in zip(*found))
        return pd.DataFrame({"x": x["key"].to_numpy()[p], "y": y["other"].to_numpy()[q]})

    both = x.groupBy("part", "i", "j").cogroup(y.groupBy("of", "p", "q")).applyInPandas(meet, "x string, y string").where("x <> y")
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def candidates(keys: DataFrame, threshold: int = 95) -> DataFrame:
    """(x, y): all pairs of distinct keys (key: words in order) that may score `threshold` or more; x < y.

    Such a pair has one of two forms. Either the words of one side that the other lacks
    are a small share of its common ones, so the pair shares one of the rarest words that
    together exceed that share; the other side may be of any length. Or both
    strings are alike as a whole, so their lengths are close, and they share most pairs of
    adjacent characters, hence one of each one's rarest few. Bits of all their parts
    rule out most pairs that share one, before they are rows.
    """
    t = (threshold - 0.5) / 100  # scores are rounded
    words = _stored(_by_rarity(keys.select("key", F.explode(F.split("key", " ")).alias("part")).withColumn("size", F.length("part"))))
    lacking = (1 / t - 1) * 2
    # a word that is longer than what may be lacked is in both, so the other side has its bit
    must = words.where(F.col("size") > F.lit(lacking) * F.length("key"))
    none = F.array(*[F.lit(0).cast("long")] * LONGS)
    first = words.where(F.col("before") <= F.lit(lacking) * F.length("key")).join(_bits(must), "key", "left").withColumn("s", F.coalesce("s", none))
    contained = _pairs(first, words.join(_bits(words), "key"), _lacked("sx", "sy") == 0)
    # a side of n characters has n + 1 pairs of characters; with u unmatched ones in both sides, at most u + 1 matched runs
    # of (n + m - u) / 2 characters in all, and m >= n - u, all but 2 + 2 u of its pairs are shared
    unmatched, padded = F.floor(F.lit((1 - t) * 2 / t) * F.length("key") + F.lit(1e-9)), F.concat(F.lit(" "), F.col("key"), F.lit(" "))
    grams = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substr(padded, i, F.lit(2)))).alias("gram"))
    grams = grams.withColumn("nth", F.row_number().over(W.partitionBy("key", "gram").orderBy("gram"))).select("key", F.concat("gram", F.col("nth").cast("string")).alias("part"), F.lit(1).alias("size"))
    few = _stored(_by_rarity(grams).where(F.col("rank") <= 2 * unmatched + 3).join(_bits(grams), "key"))
    few = few.withColumn("lost", (2 + 2 * unmatched).cast("int"))
    near = F.least(F.length("x"), F.length("y")) >= F.lit(t / (2 - t)) * F.greatest(F.length("x"), F.length("y")) - 1e-9
    return contained.union(_alike(few).where(near)).distinct()


def fuzzy_parents(labels: DataFrame, label: str, threshold: int = 95) -> DataFrame:
    """parent, child, kind: 'root' for every distinct label; 'same' from the first of the labels of equal stemmed words to the others; 'like' between
    the first labels of two such classes that score `threshold` or more. The shorter label is the parent, at equal length the lesser.

    Members of a class are not paired with each other nor with other classes
    again, so a large class adds a row a member. Null and wordless labels have the root only.
    """
    x = labels.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    x = _stored(x.withColumn("key", stemmed_set("label")))
    first = _stored(x.where("key <> ''").groupBy("key").agg(F.min(F.struct(F.length("label").alias("n"), "label"))["label"].alias("first")))
    same = x.join(first, "key").where("label <> first").select(F.col("first").alias("parent"), F.col("label").alias("child"), F.lit("same").alias("kind"))
    pairs = candidates(first.select("key"), threshold).where(_scores("x", "y") >= threshold)
    a, b = first.select(F.col("key").alias("x"), F.col("first").alias("a")), first.select(F.col("key").alias("y"), F.col("first").alias("b"))
    low = F.struct(F.length("a"), "a") <= F.struct(F.length("b"), "b")
    like = pairs.join(a, "x").join(b, "y").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("parent"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("child"), F.lit("like").alias("kind"))
    return x.select(F.lit("root").alias("parent"), F.col("label").alias("child"), F.lit("root").alias("kind")).union(same).union(like)
