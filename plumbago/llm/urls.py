"""URL filters with DataFrame functions only: rules first, then a listed-URL lookup.

The list of canonical URLs is a blocked Bloom filter: a hash picks one block of
256 bits, and bits in each of the block's four words are set. Rows whose bits
are all set are possible hits; an exact hash join with the list removes those
that only look so. The filter's blocks are capped, so its broadcast is bounded
however long the list is; beyond the cap more rows go on to the exact join and
the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty if there is no `://`."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading `www.`, and the path without slashes at its end; null for an empty host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is (verdict, `host/path prefix`)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits in each of a block's four 64-bit words, from independent hashes."""
    out = []
    for k in range(4):
        h = F.xxhash64(key, F.lit(k + 1))
        out.append(
            F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseOR(
                F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6).bitwiseAND(F.lit(63)).cast("int"))
            )
        )
    return out


def bloom(listed: DataFrame, key: str, max_blocks: int = 1 << 15, keys_a_block: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w3) of the filter of a list's keys, and its number of blocks (one pass to count the list)."""
    n = listed.count()
    blocks = max(1, min(max_blocks, -(-n // keys_a_block)))
    masked = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(_masks(F.col(key)))])
    return masked.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)]), blocks


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    list_col: str = "canonical",
    max_blocks: int = 1 << 15,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, canonical, listed.

    The longest rule that fits decides; without one, a page is blocked if its
    canonical URL is in `listed`, else allowed. A null url, or one without
    `://`, has an empty host and path and no canonical URL: no rule fits and it
    is allowed. Nulls and repeats in the list don't matter; an empty list
    blocks nothing. Repeated pages are judged each on their own. Other columns
    are ignored. The filter is broadcast: at most max_blocks rows of 5 numbers.
    """
    known = listed.select(F.col(list_col).alias("__key")).where("__key is not null").distinct()
    filter_, blocks = bloom(known, "__key", max_blocks)
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "__said": verdict, "canonical": canonical(F.col("host"), F.col("path"))})
    seen = seen.withColumn("__block", _block(F.col("canonical"), blocks))
    probe = seen.join(F.broadcast(filter_.withColumnRenamed("block", "__b")), F.col("__block") == F.col("__b"), "left")
    possible = F.lit(True)
    for k, m in enumerate(_masks(F.col("canonical"))):
        possible = possible & (F.col(f"w{k}").bitwiseAND(m) == m)
    probe = probe.withColumn("__may", F.coalesce(possible & F.col("canonical").isNotNull(), F.lit(False)))
    cols = [id_col, "host", "path", "rule", "__said", "canonical"]
    # only possible hits are joined with the list; Spark can split a hot URL's rows, as the list has it once
    hits = probe.where("__may").select(*cols).join(known.hint("shuffle_hash"), F.col("canonical") == F.col("__key"), "left")
    out = hits.select(*cols, F.col("__key").isNotNull().alias("listed")).union(
        probe.where("NOT __may").select(*cols, F.lit(False).alias("listed"))
    )
    said = F.coalesce("__said", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", said.alias("verdict"), "canonical", "listed")
