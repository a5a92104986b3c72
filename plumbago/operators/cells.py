"""Notebooks as rows: cells in order, windows over them, and duplicates of whole notebooks.

A notebook is a row (nb_id, path, context, code): `context` lists the cells
before the target cell, newest first, as structs (cell_type, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.runtime import scratch

#: Fixed ids of cell types in a type sequence, and of its two ends.
TYPE_IDS = {"raw": 1, "code": 2, "markdown": 3, "heading": 4}
START, END = 0, 5


def notebooks_from_cells(cells: DataFrame, nb: str, pos: str, cell_type: str, content: str) -> DataFrame:
    """Nested notebooks of flat cells; the last cell of each is the target."""
    by = W.partitionBy(nb)
    marked = cells.withColumn("__last", F.max(pos).over(by) == F.col(pos))
    context = F.sort_array(F.collect_list(F.when(~F.col("__last"), F.struct(F.col(pos).alias("pos"), F.col(cell_type).alias("cell_type"), F.col(content).alias("content")))), asc=False)
    return marked.groupBy(F.col(nb).alias("nb_id")).agg(
        context.alias("context"), F.max(F.when(F.col("__last"), F.col(content))).alias("code"),
        F.max(F.when(F.col("__last"), F.col(cell_type))).alias("target_type"),
    )


def cell_rows(notebooks: DataFrame, target_type: str | Column = "code") -> DataFrame:
    """(nb_id, pos, cell_type, content): the context oldest first, then the target cell."""
    kind = F.lit(target_type) if isinstance(target_type, str) else target_type
    target = F.struct(kind.alias("cell_type"), F.col("code").alias("content"))
    context = F.transform(F.reverse("context"), lambda c: F.struct(c["cell_type"].alias("cell_type"), c["content"].alias("content")))
    rows = notebooks.select("nb_id", F.posexplode(F.concat(context, F.array(target))).alias("pos", "cell"))
    return rows.select("nb_id", "pos", "cell.cell_type", "cell.content")


def type_ids(notebooks: DataFrame) -> DataFrame:
    """(nb_id, ids): start, the context's type ids, the target's, end. Unknown types count as code."""
    known = F.create_map(*[F.lit(x) for kv in TYPE_IDS.items() for x in kv])
    inner = F.transform(F.reverse("context"), lambda c: F.coalesce(F.try_element_at(known, c["cell_type"]), F.lit(TYPE_IDS["code"])))
    return notebooks.select("nb_id", F.concat(F.array(F.lit(START)), inner, F.array(F.lit(TYPE_IDS["code"]), F.lit(END))).alias("ids"))


def query_answer_pairs(notebooks: DataFrame) -> DataFrame:
    """(nb_id, query, answer): the newest markdown cell before the target, or empty, and the target."""
    md = F.filter("context", lambda c: c["cell_type"] == "markdown")
    return notebooks.select("nb_id", F.coalesce(F.get(md, F.lit(0))["content"], F.lit("")).alias("query"), F.col("code").alias("answer"))


def wrapped(cell_type: Column, content: Column) -> Column:
    """Cell text between the markers of its type."""
    return F.when(cell_type == "markdown", F.concat(F.lit("<text>\n"), content, F.lit("\n</text>"))).otherwise(
        F.concat(F.lit("<cell>\n"), content, F.lit("\n</cell>"))
    )


def context_windows(cells: DataFrame, width: int = 5, only: str | None = None) -> DataFrame:
    """For each cell but the first: the last `width` wrapped cells as input, its type as label.

    With `only`, targets of that type alone, and the input ends in an opening text marker.
    """
    by = W.partitionBy("nb_id").orderBy("pos")
    before = F.collect_list(wrapped(F.col("cell_type"), F.col("content"))).over(by.rowsBetween(-width, -1))
    out = cells.withColumn("input", F.array_join(before, "\n")).withColumn("n_context", F.size(before)).where("n_context > 0")
    if only:
        out = out.where(F.col("cell_type") == only).withColumn("input", F.concat("input", F.lit("\n<text>")))
    return out.select("nb_id", "pos", "n_context", "input", F.col("cell_type").alias("label"))


def last_cells(cells: DataFrame, width: int) -> DataFrame:
    """(nb_id, n, text): the last `width` cells of each notebook, oldest first, joined by blank lines."""
    by = W.partitionBy("nb_id").orderBy(F.desc("pos"))
    kept = cells.withColumn("back", F.row_number().over(by)).where(F.col("back") <= width)
    text = F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda c: c["content"])
    return kept.groupBy("nb_id").agg(F.count("*").alias("n"), F.array_join(text, "\n\n").alias("text"))


def mentions(cells: DataFrame) -> DataFrame:
    """(content, n, first_nb, first_pos): each distinct content with where it occurs."""
    return cells.groupBy("content").agg(
        F.count("*").alias("n"), F.min(F.struct("nb_id", "pos")).alias("at"), F.sort_array(F.collect_list(F.struct("nb_id", "pos"))).alias("mentions")
    ).select("content", "n", F.col("at.nb_id").alias("first_nb"), F.col("at.pos").alias("first_pos"), "mentions")


def look_up(kb: DataFrame, cells: DataFrame, key: str = "content") -> DataFrame:
    """Knowledge-base rows with the places of their content in cells; none: n_places 0."""
    places = cells.groupBy(key).agg(F.count("*").alias("n_places"), F.countDistinct("nb_id").alias("n_notebooks"))
    out = kb.join(places, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_places", "n_notebooks")})


def previous_of_type(cells: DataFrame, cell_type: str = "markdown") -> DataFrame:
    """Each cell with the content of the last cell of a type before it (null if none)."""
    by = W.partitionBy("nb_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("previous", F.last(F.when(F.col("cell_type") == cell_type, F.col("content")), ignorenulls=True).over(by))


def content_by_type(cell_type: Column, code: Column, markdown: Column, raw: Column) -> Column:
    """The trimmed content under the key that the cell's type names."""
    return F.trim(F.when(cell_type == "code", code).when(cell_type == "markdown", markdown).otherwise(raw))


def title_from_path(path: Column) -> Column:
    """Last path segment up to its first dot, underscores and camel case split, in title case."""
    from plumbago.functions.text import camel_spaced

    name = F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))
    return F.initcap(F.lower(camel_spaced(F.translate(name, "_", " "))))


def as_function_body(code: Column) -> Column:
    return F.concat(F.lit("def func():\n\t"), F.replace(code, F.lit("\n"), F.lit("\n\t")))


def longest_per_key(df: DataFrame, key: str, size: Column, row_id: str) -> DataFrame:
    """One row for each key: the largest, of equal ones that with the least row id."""
    by = W.partitionBy(key).orderBy(size.desc(), F.col(row_id))
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def duplicates(df: DataFrame, key: str, row_id: str, size: Column) -> DataFrame:
    """(key, n, members): the (id, size) of the rows of each key, ordered."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(row_id).alias("id"), size.alias("size")))).alias("members"))


def merge_duplicates(cells: DataFrame, group: str, record: str) -> DataFrame:
    """(group, pos, content): records of a group merged into one.

    Records are taken by falling length (ties: id); each adds the contents that
    are not there yet, in its order. The order is a total one, so the result
    does not depend on which record comes first.
    """
    size = cells.groupBy(group, record).agg(F.count("*").alias("__size"))
    ranked = cells.join(size, [group, record])
    by = W.partitionBy(group, "content").orderBy(F.desc("__size"), record, "pos")
    first = ranked.withColumn("__n", F.row_number().over(by)).where("__n = 1")
    place = W.partitionBy(group).orderBy(F.desc("__size"), record, "pos")
    return first.select(group, (F.row_number().over(place) - 1).alias("pos"), "content")


def groups_of_many(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys with at least `least` distinct values."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(value).alias("n_distinct")).where(F.col("n_distinct") >= least)


def run_lengths(cells: DataFrame) -> DataFrame:
    """(nb_id, run, cell_type, length, first_pos): runs of cells of one type."""
    by = W.partitionBy("nb_id").orderBy("pos")
    new = F.coalesce(F.col("cell_type") != F.lag("cell_type").over(by), F.lit(True)).cast("int")
    marked = cells.withColumn("run", F.sum(new).over(by))
    return marked.groupBy("nb_id", "run", "cell_type").agg(F.count("*").alias("length"), F.min("pos").alias("first_pos"))


def interleaving(cells: DataFrame) -> DataFrame:
    """(nb_id, n_cells, switches, longest, mean_run) of each notebook."""
    return run_lengths(cells).groupBy("nb_id").agg(
        F.sum("length").alias("n_cells"), (F.count("*") - 1).alias("switches"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean_run")
    )


def squeezed(seq: Column) -> Column:
    """An array without consecutive duplicates."""
    return F.filter(seq, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(seq, i - 1)))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements of two arrays that are equal after trimming."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(F.trim(x) == F.trim(y), F.lit(False)))
    miss = F.array_position(same, F.lit(False))
    return F.when(miss > 0, miss - 1).otherwise(F.size(same)).cast("int")


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "classes")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_hashes(sequences: DataFrame, group: str, seq_id: str, seq: str) -> DataFrame:
    """(g, id, n, k, h): for each length k from 0 to n, the hash of a sequence's first k elements, trimmed; each adds to the one before."""
    s = sequences.select(F.col(group).alias("g"), F.col(seq_id).alias("id"), F.size(seq).alias("n"), F.transform(seq, lambda x: F.trim(x)).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.array(F.lit(0).cast("long")).alias("all"))
    chain = lambda acc, x: F.struct(F.xxhash64(acc["h"], x).alias("h"), F.concat(acc["all"], F.array(F.xxhash64(acc["h"], x))).alias("all"))
    return s.select("g", "id", "n", F.posexplode(F.aggregate("s", start, chain)["all"]).alias("k", "h"))


#: Members of one block of a class, whose pairs with another block are one row until the end; Spark holds the pairs of such a row at once, so blocks are small.
MEMBERS = 256


def _classes(sequences: DataFrame, group: str, seq_id: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """Equal sequences of a group as one, stored: (g, c, s) with a number c, and the class's members in blocks (g, c, block, ids)."""
    x = sequences.select(F.col(group).alias("g"), F.col(seq_id).alias("id"), F.transform(seq, lambda x: F.trim(x)).alias("s")).where("g is not null and id is not null and s is not null")
    classes = _stored(x.groupBy("g", "s").agg(F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()))
    # ids are dealt out to blocks by hash: as many as the class's size asks for
    member = x.join(classes.withColumnRenamed("g", "cg").withColumnRenamed("s", "cs"), (F.col("g") == F.col("cg")) & (F.col("s") == F.col("cs")))
    block = F.pmod(F.xxhash64("id"), F.floor(F.col("n") / MEMBERS) + 1).cast("int")
    blocks = member.select("g", "c", block.alias("block"), "id").groupBy("g", "c", "block").agg(F.collect_list("id").alias("ids"))
    return classes.select("g", "c", "s"), _stored(blocks)


def _members(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The columns of pairs (g, x, y: classes) for each two members a and b of the classes.

    Blocks of members meet, and are dealt out to all cores; the members' pairs are made last, so none is shuffled.
    """
    a = blocks.select(F.col("c").alias("x"), F.col("block").alias("i"), F.col("ids").alias("as"))
    b = blocks.select(F.col("c").alias("y"), F.col("block").alias("j"), F.col("ids").alias("bs"))
    met = pairs.join(a, "x").join(b, "y").repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "x", "y", "i", "j")
    return met.withColumn("a", F.explode("as")).drop("as").withColumn("b", F.explode("bs")).drop("bs")


def prefix_pairs(sequences: DataFrame, group: str, seq_id: str, seq: str) -> DataFrame:
    """Pairs of sequences of one group whose shorter one is a prefix of the longer; of equal ones the lesser id is the shorter.

    Equal sequences are one class, whose hash meets the hashes of other classes' prefixes of its length, so only
    pairs that are in the result (but for equal hashes of 64 bits, which are compared) are made. Members' pairs follow from the classes' without a shuffle of pairs.
    """
    classes, blocks = _classes(sequences, group, seq_id, seq)
    every = prefix_hashes(classes, "g", "c", "s")
    whole = every.where("k = n").select("g", "k", "h", F.col("id").alias("x"), F.col("n").alias("nx"))
    both = whole.join(every.select("g", "k", "h", F.col("id").alias("y"), F.col("n").alias("ny")), ["g", "k", "h"]).where("nx < ny OR x = y")
    both = both.join(classes.select(F.col("c").alias("x"), F.col("s").alias("sx")), "x").join(classes.select(F.col("c").alias("y"), F.col("s").alias("sy")), "y")
    both = both.where((F.col("nx") == 0) | (F.col("x") == F.col("y")) | (common_prefix(F.col("sx"), F.col("sy")) == F.col("nx"))).select("g", "x", "y")
    return _members(both, blocks).where("x <> y OR a < b").select(F.col("g").alias(group), F.col("a").alias("shorter"), F.col("b").alias("longer"))


def overlap_lengths(sequences: DataFrame, group: str, seq_id: str, seq: str) -> DataFrame:
    """group, common_len, n_pairs: how many pairs of a group's sequences have just that many first elements in common.

    Counted without making the pairs: m sequences that begin alike for k elements are m (m - 1) / 2 pairs of at least that
    common length. Sequences must have distinct ids.
    """
    same = prefix_hashes(sequences, group, seq_id, seq).groupBy("g", "k", "h").agg(F.count("*").alias("m"))
    least = same.groupBy("g", "k").agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("pairs")).where("pairs > 0")
    further = F.coalesce(F.lead("pairs").over(W.partitionBy("g").orderBy("k")), F.lit(0))
    just = least.select(F.col("g").alias(group), F.col("k").alias("common_len"), (F.col("pairs") - further).alias("n_pairs"))
    return just.where("n_pairs > 0")


def overlaps(sequences: DataFrame, group: str, seq_id: str, seq: str) -> DataFrame:
    """group, a, b, min_len, max_len, common_len: pairs of a group's sequences (a < b) that begin alike, and for how many elements; pairs with nothing in common are left out.

    Two classes of equal sequences meet once, at the last length at which their prefixes' hashes are equal. Members' pairs follow from the classes' without a shuffle of pairs.
    """
    classes, blocks = _classes(sequences, group, seq_id, seq)
    every = prefix_hashes(classes, "g", "c", "s").withColumn("next", F.lead("h").over(W.partitionBy("g", "id").orderBy("k"))).where("k > 0")
    met = every.alias("p").join(every.alias("q"), ["g", "k", "h"])
    last = F.coalesce(F.col("p.next") != F.col("q.next"), F.lit(True))
    met = met.where(last & ((F.col("p.id") < F.col("q.id")) | ((F.col("p.id") == F.col("q.id")) & (F.col("k") == F.col("p.n")))))
    met = met.select("g", F.col("p.id").alias("x"), F.col("q.id").alias("y"), F.least("p.n", "q.n").alias("min_len"), F.greatest("p.n", "q.n").alias("max_len"), F.col("k").alias("common_len"))
    pairs = _members(met, blocks).where("a < b OR (x <> y AND a <> b)")
    return pairs.select(F.col("g").alias(group), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "min_len", "max_len", "common_len")
