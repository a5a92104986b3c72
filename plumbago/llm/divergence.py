"""Source divergence audit: how far each source's words lie from those of other sources and of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, table

#: What lies between terms: a term is a run of letters and of characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of (lang, source) are broadcast up to so many; beyond, they are joined by shuffles over SALTS shares of each key.
BROADCAST_GROUPS = 20_000
SALTS = 64


def terms(text: Column, between: str = BETWEEN) -> Column:
    """All runs of characters that a pattern doesn't match, A-Z lower-cased; none in a null.

    Split, not extracted: extraction copies the whole text at each match.
    """
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), between), "")


def counted_terms(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it): one row a term of a group, of one pass over the texts.

    A row's terms are followed by its distinct terms, so one explode serves both
    counts; they are added up inside each task before the shuffle.
    """
    rows = docs.select(_read(lang).alias("lang"), _read(source).alias("source"), terms(named(text)).alias("terms"))
    many = rows.select("lang", "source", F.size("terms").alias("many"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    seen = F.col("at") < F.col("many")
    return many.groupBy("lang", "source", "term").agg(F.sum(seen.cast("long")).alias("n"), F.sum((~seen).cast("long")).alias("docs"))


def share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exact: in longs where the product fits, else in decimals of 38 digits."""
    fits = n < (2**63 - 1) // scale - 1
    wide = F.expr("0L") + (F.lit(scale).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"))
    return 1 + F.when(fits, _div(F.when(fits, n + 1).otherwise(0) * F.lit(scale).cast("long"), total)).otherwise(_div(wide, total))


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _read(column: str) -> Column:
    return F.coalesce(named(column).cast("string"), F.lit(""))


def with_groups(df: DataFrame, groups: DataFrame, on: list[str], few: bool) -> DataFrame:
    """df joined to the groups' rows by `on`: by broadcast where their number was found small, else by key and share, as one key may hold most rows."""
    if few:
        return df.join(F.broadcast(groups), on)
    salted = df.withColumn("__salt", F.abs(F.hash("lang", "term")) % SALTS)
    return salted.join(groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "__salt"]).drop("__salt")


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, scale: int = 10**9, top: int = 200) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: divergences between the term shares of groups of documents.

    A group is the rows of one (lang, source). A lang keeps the terms that at
    least `least` of its rows hold, V of them. The groups are crossed with their
    lang's kept terms, so that every term has a count in every group, zeros
    too, and a smoothed share p; see `share`. Two groups of a lang meet in a
    self-join on (lang, term): floor((p-q)^2/q) summed over the terms is the value of
    'pair' rows (0 where V is 0). 'term' rows are those terms of a group whose
    share exceeds the whole lang's, the `top` highest. Ranks go by value, highest
    first, then by item in UTF-8 order.

    Nulls in lang, source and text read as ''; a row without terms counts for its
    group's existence only. Each of repeated rows counts. Other columns are not
    read. An empty table gives an empty one.
    """
    by_term = Window.partitionBy("lang", "term").orderBy("source")
    whole = by_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = counted_terms(docs, lang, source, text).select(
        "lang", "source", "term", "n", F.sum("docs").over(whole).alias("docs"), F.sum("n").over(whole).alias("all"), (F.row_number().over(by_term) == 1).alias("head")
    )
    # a number for each kept term of a lang, given in the task that writes its rows
    held = held.where(F.col("docs") >= least).drop("docs").withColumn("number", F.when(F.col("head"), F.monotonically_increasing_id()))
    kept = table(held.withColumn("number", F.max("number").over(whole)))
    heads = kept.where("head").groupBy("lang").agg(F.sum("all").alias("lang_n"), F.count("*").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select(_read(lang).alias("lang"), _read(source).alias("source")).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(heads, "lang", "left").na.fill(0, ["group_n", "lang_n", "v"])
    groups = table(groups.withColumn("group", F.monotonically_increasing_id()))
    few = groups.count() <= BROADCAST_GROUPS

    counts = with_groups(kept, groups, ["lang", "source"], few)
    crossed = with_groups(kept.where("head").select("lang", "term", "number"), groups.drop("source"), ["lang"], few).select("number", "group", (F.col("group_n") + F.col("v")).alias("total"))
    dense = crossed.join(counts.select("number", "group", "n"), ["number", "group"], "left")
    dense = dense.select("number", "group", share(F.coalesce("n", F.lit(0)), F.col("total"), scale).alias("p"))
    # each two groups meet once, and both directions are summed
    # (the same plan on both sides, so that one shuffle serves both)
    p, q, met = F.col("a.p"), F.col("b.p"), dense.alias("a").join(dense.alias("b"), "number").where(F.col("a.group") < F.col("b.group"))
    met = met.groupBy(F.col("a.group"), F.col("b.group").alias("other")).agg(F.sum(divergence(p, q)).alias("there"), F.sum(divergence(q, p)).alias("back"))
    met = met.join(groups.select("group", "lang", "source"), "group").join(groups.select(F.col("group").alias("other"), F.col("source").alias("item")), "other")
    sides = F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), F.col("there").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")),
    )
    found = met.select("lang", F.inline(sides))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where(F.col("source") != F.col("item")).join(found, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    own = counts
    p, q = share(F.col("n"), F.col("group_n") + F.col("v"), scale), share(F.col("all"), F.col("lang_n") + F.col("v"), scale)
    own = own.select("lang", "source", "term", p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    # the limit on ranks reaches the tasks before the shuffle
    return pairs.select("*", ranked).unionByName(own.select("*", ranked).where(F.col("rank") <= top))
