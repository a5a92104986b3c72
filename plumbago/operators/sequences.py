"""Sequences: next steps, transitions, question blocks, alignment, longest common subsequences."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions.code import vectorised
from plumbago.runtime import scratch, ship


def bigrams(df: DataFrame, seq: str, order: list[str], symbol: str) -> DataFrame:
    """(a, b, n): how often b follows a."""
    by = W.partitionBy(seq).orderBy(*order)
    pairs = df.select(F.col(symbol).alias("a"), F.lead(symbol).over(by).alias("b")).where("b is not null")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def transitions(df: DataFrame, seq: str, order: list[str], symbol: str) -> DataFrame:
    """Bigram counts with the probability of b after a."""
    n = bigrams(df, seq, order, symbol)
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(W.partitionBy("a")), 6))


def likely_walk(probabilities: DataFrame, start: str, steps: int) -> DataFrame:
    """(step, symbol): always the likeliest next symbol (ties: the least). Recursive in SQL; one row a step."""
    spark = probabilities.sparkSession
    best = probabilities.groupBy("a").agg(F.max_by("b", F.struct("n", F.lit(0))).alias("unused"), F.max("n").alias("n"))
    best = probabilities.join(best.select("a", "n"), ["a", "n"]).groupBy("a").agg(F.min("b").alias("b"))
    best.createOrReplaceTempView("plumbago_likely")
    return spark.sql(
        f"""WITH RECURSIVE walk(step, symbol) AS (
              SELECT 0, '{start}' UNION ALL SELECT step + 1, b FROM walk JOIN plumbago_likely ON a = symbol WHERE step < {int(steps)})
            SELECT step, symbol FROM walk"""
    )


def question_blocks(cells: DataFrame, is_question: Column, is_answer: Column) -> DataFrame:
    """(nb_id, qa_id, question, answer): each question with the run of answers right after it."""
    by = W.partitionBy("nb_id").orderBy("pos")
    x = cells.withColumns({"__q": F.coalesce(is_question, F.lit(False)), "__a": F.coalesce(is_answer, F.lit(False))})
    x = x.withColumn("qa_id", F.sum(F.col("__q").cast("int")).over(by))
    inner = W.partitionBy("nb_id", "qa_id").orderBy("pos")
    x = x.withColumn("__stop", F.sum((~F.col("__q") & ~F.col("__a")).cast("int")).over(inner))
    x = x.where("qa_id > 0 AND __stop = 0")
    answers = F.transform(F.sort_array(F.collect_list(F.when(~F.col("__q"), F.struct("pos", "content")))), lambda c: c["content"])
    return x.groupBy("nb_id", "qa_id").agg(F.max(F.when(F.col("__q"), F.col("content"))).alias("question"), F.array_join(answers, "\n").alias("answer"))


def _common(a: list, b: list):
    """After each element of `b`, the length of its longest common subsequence with `a` so far: rows of the table as bits of one number."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
        yield len(a) - row.bit_count()


@vectorised("int")
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays; null if one is."""
    return pd.Series([None if x is None or y is None else max(_common(list(x), list(y)), default=0) for x, y in zip(a, b)], dtype="Int32")


def prefixes(df: DataFrame, seq_id: str, seq: str) -> DataFrame:
    """(id, depth, prefix, next): each proper prefix with the step after it."""
    depth = F.explode(F.sequence(F.lit(1), F.size(seq) - 1)).alias("depth")
    x = df.where(F.size(seq) > 1).select(seq_id, seq, depth)
    return x.select(seq_id, "depth", F.slice(seq, F.lit(1), F.col("depth")).alias("prefix"), F.get(seq, F.col("depth")).alias("next"))


#: Sequences of a block that meets prompts in one task (and steps of them, in all, per sequence), and prompts of one.
BLOCK, STEPS, PROMPTS = 4096, 128, 1024
#: Bytes of a block's tables of places that are kept, and sequences of the least ids that are compared before all others.
PLACES, FIRST = 64 << 20, 32


class Block:
    """Sequences side by side, longest first: a number of 64 bits for each and every 64 steps, so that one pass over a prompt aligns all of them."""

    def __init__(self, sequences: list[list], ids):
        size = np.array([len(x) for x in sequences], int)
        order = np.argsort(-size, kind="stable")
        self.sequences, self.ids, self.size = [sequences[k] for k in order], np.asarray(ids)[order], size[order]
        flat = [y for x in self.sequences for y in x]
        self.codes = {y: i for i, y in enumerate(dict.fromkeys(flat))}
        code = np.array([self.codes[y] for y in flat], np.intp)
        self._by_code = np.argsort(code, kind="stable")
        self._ends = np.searchsorted(code[self._by_code], np.arange(len(self.codes)), side="right")
        self._of = np.repeat(np.arange(len(order)), self.size)
        self._at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        #: how many sequences have steps in each 64
        self.longer = [int((self.size > t).sum()) for t in range(0, max(1, max(self.size, default=0)), 64)]
        self._places, self._most = {}, max(1, PLACES // (8 * sum(self.longer) + 1))

    def places(self, step) -> list[np.ndarray] | None:
        """The places of a step in the sequences as bits; null if it is in none."""
        code = self.codes.get(step)
        if code is None:
            return None
        if code not in self._places:
            if len(self._places) >= self._most:
                self._places.clear()
            some = self._by_code[self._ends[code - 1] if code else 0 : self._ends[code]]
            of, at = self._of[some], self._at[some]
            out = []
            for w, n in enumerate(self.longer):
                bits, here = np.zeros(n, np.uint64), at >> 6 == w
                np.bitwise_or.at(bits, of[here], np.uint64(1) << (at[here] & 63).astype(np.uint64))
                out.append(bits)
            self._places[code] = out
        return self._places[code]

    def aligned(self, prompt: list):
        """Rows of the tables of common subsequences after each step of a prompt: a bit is 0 where the length grows. The same arrays each time."""
        rows = [np.full(n, ~np.uint64(0)) for n in self.longer]
        hits, sums = np.empty(len(self.ids), np.uint64), np.empty(len(self.ids), np.uint64)
        for step in prompt:
            over = None
            for row, bits in zip(rows, self.places(step) or ()):
                hit, total = hits[: len(row)], sums[: len(row)]
                np.bitwise_and(row, bits, out=hit)
                np.add(row, hit, out=total)
                if len(rows) > 1:
                    carry = total < hit
                    if over is not None:
                        total += over[: len(row)]
                        carry |= over[: len(row)] & (total == 0)
                    over = carry
                row ^= hit
                row |= total
            yield rows

    def common(self, prompt: list) -> np.ndarray:
        """The length of each sequence's longest common subsequence with a prompt."""
        rows = []
        for rows in self.aligned(prompt):
            pass
        return _grown(rows, 64 * len(self.longer), len(self.ids))


def _grown(rows: list[np.ndarray], n: int, size: int) -> np.ndarray:
    """How many of the first n bits are 0, for each sequence; bits past its end are 1."""
    out = np.zeros(size, np.uint8 if n < 256 else np.int32)
    for w, row in enumerate(rows[: -(-n // 64)]):
        out[: len(row)] += np.bitwise_count(~row & np.uint64((1 << min(64, n - 64 * w)) - 1))
    return out


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "sequences")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _met(prompts: DataFrame, corpus: DataFrame, made, one_by_one, ddl: str) -> DataFrame:
    """What `one_by_one(prompt, block)` yields for each prompt (id, intent, seq) and block, `made` of sequences (seq_id, intent, seq) of its intent and their ids, after the prompt's id.

    Both sides meet in blocks whose number follows from their rows and steps. Both are stored tables.
    """
    ship(prompts.sparkSession)
    size = corpus.groupBy("intent").agg(F.count("*").alias("n"), F.sum(F.size("seq")).alias("steps")).agg(F.max("n"), F.max("steps")).first()
    n_c = max((size[0] or 0) // BLOCK, (size[1] or 0) // (BLOCK * STEPS)) + 1
    n_p = (prompts.groupBy("intent").count().agg(F.max("count")).first()[0] or 0) // PROMPTS + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    c = corpus.select("intent", F.pmod(F.xxhash64("seq_id"), F.lit(n_c)).cast("int").alias("i"), every(n_p).alias("j"), "seq_id", "seq")
    p = prompts.select(F.col("intent").alias("at"), every(n_c).alias("pi"), F.pmod(F.xxhash64("id"), F.lit(n_p)).cast("int").alias("pj"), "id", F.col("seq").alias("prompt"))
    kind = prompts.schema["id"].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in ddl.split(", "))]

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(mine) and len(theirs):
            theirs = theirs.sort_values("seq_id")
            block = made([list(x) for x in theirs["seq"]], theirs["seq_id"].to_numpy())
            rows = [(key, *r) for key, prompt in zip(mine["id"], mine["prompt"]) for r in one_by_one(list(prompt), block)]
        return pd.DataFrame(rows, columns=names)

    return p.groupBy("at", "pi", "pj").cogroup(c.groupBy("intent", "i", "j")).applyInPandas(meet, f"id {kind}, {ddl}")


def next_step(prompts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, next, score, seq_id, depth): the step after the corpus prefix nearest to each prompt by common subsequence.

    prompts: id, prefix (a stated query set). corpus: seq_id, seq; sequences of
    one step have no prefix. The first greatest wins, by seq_id and depth. The common length with a
    sequence's longest prefix is that with its best one, so one bit-parallel pass aligns a prompt with a whole block of sequences,
    and only the winner's depth is looked for. Equal prompts and equal sequences are aligned once; only a block's best leave it.
    """
    one = _stored(corpus.where(F.size("seq") > 1).groupBy("seq").agg(F.min("seq_id").alias("seq_id")).select("seq_id", F.lit(0).alias("intent"), "seq"))
    asked = _stored(prompts.groupBy("prefix").agg(F.min("id").alias("id")).select("id", F.lit(0).alias("intent"), F.col("prefix").alias("seq")))
    proper = one.withColumn("seq", F.slice("seq", F.lit(1), F.size("seq") - 1))

    def best(prompt: list, block: Block):
        score = block.common(prompt)
        first = np.flatnonzero(score == score.max())
        k = first[np.argmin(block.ids[first])]
        depth = next((n for n, x in enumerate(_common(prompt, block.sequences[k]), 1) if x == score[k]), 1)
        yield int(score[k]), int(block.ids[k]), depth

    found = _met(asked, proper, Block, best, f"score int, seq_id {one.schema['seq_id'].dataType.simpleString()}, depth int")
    found = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("lost"), "seq_id", "depth")).alias("b")).select("id", (-F.col("b.lost")).alias("score"), "b.seq_id", "b.depth")
    found = found.join(one.select("seq_id", "seq"), "seq_id").select(F.col("id").alias("asked"), F.get("seq", F.col("depth")).alias("next"), "score", "seq_id", "depth")
    alike = prompts.select("id", "prefix").join(asked.select(F.col("id").alias("asked"), "seq"), F.col("prefix") == F.col("seq"))
    return alike.select("id", "asked").join(found, "asked").select("id", "next", "score", "seq_id", "depth")


def foretold(prompts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, depth, next, told): for each proper prefix of each prompt, the step after it and the one foretold.

    prompts: id, intent, seq (a stated query set); corpus: seq_id, intent, seq. A prefix of n steps is compared with the first n of each
    sequence of its intent by common subsequence; the first greatest wins, by seq_id, and foretells its next step (null if it has none).
    One bit-parallel pass over a prompt scores all its prefixes against a block of sequences: the rows after n steps tell the common length
    of both sides' first n. Equal sequences and equal prompts of an intent are aligned once; only a block's best leave it.
    """
    one = _stored(corpus.where(F.size("seq") > 0).groupBy("intent", "seq").agg(F.min("seq_id").alias("seq_id")).select("seq_id", "intent", "seq"))
    asked = _stored(prompts.where(F.size("seq") > 1).groupBy("intent", "seq").agg(F.min("id").alias("id")).select("id", "intent", "seq"))
    kind = one.schema["seq_id"].dataType.simpleString()
    found = _met(asked, one, _parts, lambda prompt, parts: _best_of(prompt, parts)[0], f"depth int, score int, seq_id {kind}, told string")
    best = found.groupBy("id", "depth").agg(F.min_by("told", F.struct((-F.col("score")).alias("lost"), "seq_id")).alias("told"))
    alike = prompts.join(asked.select(F.col("intent").alias("at"), F.col("seq").alias("same"), F.col("id").alias("asked")), F.col("intent").eqNullSafe(F.col("at")) & (F.col("seq") == F.col("same")))
    steps = prefixes(alike.select(F.struct("id", "asked").alias("of"), "seq"), "of", "seq").select("of.id", F.col("of.asked").alias("asked"), "depth", "next")
    return steps.join(best.withColumnRenamed("id", "asked"), ["asked", "depth"], "left").select("id", "depth", "next", "told")


def best_by_depth(prompt: list, sequences: list[list], ids) -> tuple[list[tuple], int]:
    """(depth, score, seq_id, next) of the best sequence for each proper prefix of a prompt (equal ones: the least id), and how many were aligned; sequences by ascending id."""
    return _best_of(prompt, _parts(sequences, ids))


def _parts(sequences: list[list], ids) -> list[Block]:
    """The sequences of the least ids, then all others; sequences by ascending id."""
    return [Block(sequences[a:b], ids[a:b]) for a, b in ((0, FIRST), (FIRST, len(ids))) if len(ids) > a]


def _best_of(prompt: list, parts: list[Block]) -> tuple[list[tuple], int]:
    """best_by_depth over blocks of ascending ids; where all prefixes are found whole, later blocks can't win."""
    depth, count = len(prompt) - 1, 0
    best: list[tuple] = [(-1, None, None)] * max(0, depth)
    for block in parts:
        if all(best[n][0] == n + 1 for n in range(depth)):
            break
        count += len(block.ids)
        for n, rows in enumerate(block.aligned(prompt[:depth])):
            score = _grown(rows, n + 1, len(block.ids))
            most = score.max()
            if most > best[n][0]:
                tie = np.flatnonzero(score == most)
                k = tie[np.argmin(block.ids[tie])]
                best[n] = int(most), int(block.ids[k]), block.sequences[k]
    return [(n + 1, score, key, x[n + 1] if len(x) > n + 1 else None) for n, (score, key, x) in enumerate(best) if x is not None], count


def sequence_similarity(df: DataFrame, pairs: DataFrame, seq: str, item: str, vec: str, rows: int = 2000) -> DataFrame:
    """(a, b, similarity): of two sequences of vectors, the mean of row maxima plus the mean of column maxima of their cosines.

    pairs: a, b (sequence names). Sequences are cut into blocks of some `rows`
    items that meet pairwise, so no task holds a whole long sequence.
    """
    n = df.groupBy(seq).agg(F.ceil(F.count("*") / rows).cast("int").alias("n"))
    cut = df.join(n, seq).select(F.col(seq).alias("s"), F.col(item).alias("item"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(item), "n").cast("int").alias("i"), "n")
    n = n.select(F.col(seq).alias("s"), "n")
    other = lambda side, far: cut.join(pairs, F.col("s") == F.col(side)).join(n.select(F.col("s").alias("far"), F.col("n").alias("nf")), F.col("far") == F.col(far)).select(
        "a", "b", F.lit(side).alias("side"), "item", "v", "i", F.explode(F.sequence(F.lit(0), F.col("nf") - 1)).alias("j")
    )
    both = other("a", "b").union(other("b", "a").select("a", "b", "side", "item", "v", F.col("j").alias("i"), F.col("i").alias("j")))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == "a"], pdf[pdf["side"] == "b"]
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "side": [], "item": [], "m": []})
        u, v = (np.stack(z["v"].to_numpy()) for z in (x, y))
        s = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
        out = pd.concat([x.assign(m=s.max(axis=1)), y.assign(m=s.max(axis=0))])
        return out[["a", "b", "side", "item", "m"]]

    types = dict(pairs.dtypes) | {"item": dict(df.dtypes)[item]}
    found = both.groupBy("a", "b", "i", "j").applyInPandas(best, f"a {types['a']}, b {types['b']}, side string, item {types['item']}, m double")
    found = found.groupBy("a", "b", "side", "item").agg(F.max("m").alias("m")).groupBy("a", "b", "side").agg(F.avg("m").alias("m"))
    return found.groupBy("a", "b").agg(F.round(F.sum("m"), 6).alias("similarity"))


def align(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """Cells that differ from the reference notebook's cell at the same place from the start or, where longer, the end.

    cells and reference: nb_id / pos / content. A notebook of the reference's
    length is compared place by place; longer and shorter ones from their start
    up to the first difference and from their end back to it.
    """
    n_ref = reference.agg(F.count("*").alias("n_ref"))
    sized = cells.withColumn("n", F.count("*").over(W.partitionBy("nb_id"))).crossJoin(F.broadcast(n_ref))  # one row
    ref = F.broadcast(reference.select(F.col("pos").alias("rp"), F.col("content").alias("rc")))  # one notebook
    head = sized.join(ref, F.col("pos") == F.col("rp"), "left").withColumn("same_head", F.coalesce(F.col("content") == F.col("rc"), F.lit(False))).drop("rp", "rc")
    both = head.join(ref, F.col("pos") - F.col("n") + F.col("n_ref") == F.col("rp"), "left").withColumn("same_tail", F.coalesce(F.col("content") == F.col("rc"), F.lit(False)))
    up = W.partitionBy("nb_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("nb_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    kept = F.when(F.col("n") == F.col("n_ref"), ~F.col("same_head")).otherwise(
        ~F.bool_and("same_head").over(up) & ~F.bool_and("same_tail").over(down)
    )
    return both.where("content is not null").withColumn("differs", kept).where("differs").select("nb_id", "pos", "content")
