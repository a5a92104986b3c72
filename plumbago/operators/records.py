"""Nested records: evaluation tables, methods and data sets to triples; nested objects to paths; diff and phrase records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def triple(df: DataFrame, sub, rel: str, obj) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(sub).alias("sub"), F.lit(rel).alias("rel"), as_col(obj).alias("obj")).where("sub is not null AND obj is not null")


def evaluation_triples(rows: DataFrame) -> DataFrame:
    """Triples of recursive evaluation rows (task, datasets array<struct<dataset, models array<string>>>, subtasks as JSON).

    Each level of subtasks is parsed and exploded in turn, until there is none.
    """
    schema = "array<struct<task:string,datasets:array<struct<dataset:string,models:array<string>>>,subtasks:string>>"
    parts, now = [], rows.select("task", "datasets", "subtasks", F.lit(None).cast("string").alias("parent"))
    while not parts or not now.isEmpty():
        d = now.select("task", F.explode("datasets").alias("d"))
        m = d.select("task", F.col("d.dataset").alias("dataset"), F.explode("d.models").alias("model"))
        parts += [triple(now, "task", "SUBTASK OF", "parent"), triple(d, "task", "HAS DATASET", F.col("d.dataset")), triple(m, "dataset", "EVALUATES", "model"), triple(m, "model", "CAN MODEL", "task")]
        now = now.select(F.col("task").alias("parent"), F.explode(F.from_json("subtasks", schema)).alias("s")).select("s.task", "s.datasets", "s.subtasks", "parent")
    return union_all(parts).distinct()


def array_triples(df: DataFrame, sub: str, arrays: dict[str, str]) -> DataFrame:
    """Triples of a record's name with the members of some of its arrays; arrays: column to relation."""
    return union_all([triple(df.select(sub, F.explode(c).alias("x")), sub, rel, "x") for c, rel in arrays.items()]).distinct()


def paths_of_objects(df: DataFrame, id_col: str, column: str, most: int = 6) -> DataFrame:
    """(id, path, value): the leaves of nested JSON objects, level by level through VARIANT; deeper levels stay JSON text."""
    now = df.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.parse_json(column).alias("v"))
    leaves = []
    for _ in range(most):
        now.createOrReplaceTempView("plumbago_objects")
        x = now.sparkSession.sql(
            "SELECT id, concat(path, CASE WHEN path = '' THEN '' ELSE '->' END, key) AS path, value AS v FROM plumbago_objects, LATERAL variant_explode(v) AS t(pos, key, value)"
        )
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        leaves.append(x.where(~is_object).select("id", "path", F.to_json("v").alias("value")))
        now = x.where(is_object)
    leaves.append(now.select("id", "path", F.to_json("v").alias("value")))
    return union_all(leaves)


def bad_keys(paths: DataFrame, reserved: tuple[str, ...] = ("STEPS", "DESC")) -> DataFrame:
    """Path keys that are neither `name::TYPE[::relation]` nor reserved."""
    key = F.explode(F.split("path", "->")).alias("key")
    x = paths.select("id", key).distinct()
    return x.where(~F.col("key").isin(*reserved) & (F.size(F.split("key", "::")) < 2))


def collapsed(v: Column) -> Column:
    """A list of strings as one text."""
    return F.array_join(v, "\n")


def inverted(df: DataFrame, key: str, values: str) -> DataFrame:
    """(value, keys) of a map from keys to lists."""
    return df.select(key, F.explode(values).alias("value")).groupBy("value").agg(F.sort_array(F.collect_set(key)).alias("keys"))


def later_wins(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of maps; of equal keys the last map's value."""
    x = union_all([p.select(key, value).withColumn("__k", F.lit(i)) for i, p in enumerate(parts)])
    return x.groupBy(key).agg(F.max_by(value, "__k").alias(value))


def fresh_phrases(phrases: Column) -> Column:
    """Phrases, in order, that bring a word not seen in those kept before."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, p: Column) -> Column:
        words = F.split(p, " ")
        new = F.size(F.array_except(words, s["seen"])) > 0
        return F.struct(
            F.when(new, F.concat(s["kept"], F.array(p))).otherwise(s["kept"]).alias("kept"),
            F.when(new, F.array_union(s["seen"], words)).otherwise(s["seen"]).alias("seen"),
        )

    return F.aggregate(phrases, start, step, lambda s: s["kept"])


def nested_text(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(nb_id, text): a hierarchy printed depth first, two spaces a level; tree rows joined with their depth."""
    x = tree.join(paths.select("nb_id", "pos", "depth"), ["nb_id", "pos"])
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), "content")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("t")))), lambda s: s["t"])
    return x.groupBy("nb_id").agg(F.array_join(parts, "\n").alias("text"))


def grown_context(labels: Column, centre: Column, budget: int) -> Column:
    """Indices around a centre, taken before and after in turn, until a budget of lines is used or both ends are reached."""
    n = F.size(labels)
    wide = F.transform(F.sequence(F.lit(1), n), lambda k: F.array(centre - k, centre + k))
    order = F.filter(F.concat(F.array(centre), F.flatten(wide)), lambda i: (i >= 0) & (i < n))
    return F.array_sort(F.slice(order, 1, budget))


def refinement_pair(old: Column, new: Column, comment: Column, joiner: str = "<add>") -> Column:
    """Source and target of a refinement: first characters of lines dropped, lines trimmed and joined."""
    def lines(x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, "\n"), lambda s: F.trim(F.substr(s, F.lit(2)))), joiner)

    return F.struct(F.concat(lines(old), F.lit(" <msg>"), comment).alias("source"), lines(new).alias("target"))
