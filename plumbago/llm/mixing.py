"""Mixing to target weights with soft memberships.

A classifier learnt from a labelled table gives each document a posterior over
domains. Document rates r, not negative, minimise the squared gap between expected domain tokens
sum_d r_d n_d p_dk and the targets, by projected gradient from r = 1. A document's gradient is its posterior times one vector of K numbers, so
a rate is a function of its posterior and of the vectors so far: every step is
one distributed sum, and no rates are stored or shuffled. The gap is measured
in the metric of the Gram matrix of all memberships, in which a step of length 1 always
lowers it; each pass also tries longer steps, and steps in the metric of the memberships
whose rate is above 0, and keeps the best. There is a fixed
number of passes at most, so the work is in proportion to the table.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality, toxicity
from .common import drop, fresh, named, table, text_udf, tune

#: Target shares of expected tokens for the domains of the labels table.
TARGETS = {"plain": 0.90, "low": 0.08, "toxic": 0.02}
#: Most passes over the posteriors, the gap at which no more are made, and the step lengths that each one tries in the metric of all rows and in that of the rates above 0.
PASSES, ENOUGH, LENGTHS, FREE_LENGTHS = 12, 1e-4, (1.0, 4.0, 16.0), (1.0, 0.5, 0.125)


@dataclass
class Mixture:
    domains: list[str]
    lexical: toxicity.Model
    model: quality.Model | None
    most: float = math.inf  # bound of all rates
    steps: list[np.ndarray] = field(default_factory=list)
    gaps: list[float] = field(default_factory=list)  # largest gap of a domain before each pass and at the end, as a share of all target tokens

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full((len(x), len(self.domains)), 1 / len(self.domains))
        p = np.clip(self.model.raw(x), 1e-3, None)
        return p / p.sum(axis=1, keepdims=True)

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for g in self.steps:
            r = np.clip(r - p @ g, 0.0, self.most)
        return r

    def rate(self, p: list[Column]) -> Column:
        """The same as an expression of the posterior's columns."""
        r = F.lit(1.0)
        for g in self.steps:
            r = _stepped(r, p, g, self.most)
        return r

    @property
    def gap(self) -> float:
        """What is left of the largest gap; 0 without tokens."""
        return self.gaps[-1] if self.gaps else 0.0


def _stepped(r: Column, p: list[Column], g: np.ndarray, most: float) -> Column:
    back = sum((c * float(x) for c, x in zip(p, g)), F.lit(0.0))
    r = F.greatest(F.lit(0.0), r - back)
    return r if math.isinf(most) else F.least(F.lit(most), r)


def _lexical(model: toxicity.Model):
    return lambda texts: np.clip(model.difference(texts), -1, 1)


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **options) -> Mixture:
    """Classifier and rates; see fit_with_inputs."""
    mixture, soft = fit_with_inputs(docs, labels, targets, **options)
    drop(soft)
    return mixture


def fit_with_inputs(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    anchor: str = "plain",
    anchor_rate: float = 1.1,
    passes: int = PASSES,
    tolerance: float = 1e-3,
    most: float = math.inf,
    classifier_rows: int = 40_000,
) -> tuple[Mixture, DataFrame]:
    """Classifier and rates, and the posteriors (id, n_tokens, p0, p1, ...) as a table. labels: id, quality, toxic; domains are toxic (1), else low (quality 0), else plain; toxic rows are low where the targets have no toxic domain.

    The classifier learns from about `classifier_rows` labelled rows, chosen by
    the id's hash (from all of them, if there are no more); posteriors, token
    counts and rates are of all rows. The token budget is set so that the anchor domain's expected tokens, times
    `anchor_rate`, are its target share. Rows whose two labels are null and null
    ids are no labelled rows; of several labels of one id, toxic and low hold.
    Repeated rows count each. Without labels all posteriors are equal; without
    tokens (an empty table) all rates are 1. Rates have no bound but 0 unless `most` is
    given. A gap over `tolerance` after the
    passes, as where targets can't be reached, is in Mixture.gap and a warning.
    """
    tune(docs.sparkSession)
    known = named("quality").isNotNull() | named("toxic").isNotNull()
    labelled = labels.where(named(id_col).isNotNull() & known).groupBy(named(id_col).alias("id")).agg(
        F.coalesce(F.max("toxic"), F.lit(0)).cast("int").alias("toxic"), F.coalesce(F.min("quality"), F.lit(1)).cast("int").alias("quality")
    )
    share = min(1.0, classifier_rows / max(1, labelled.count()))
    labelled = labelled.where(F.pmod(F.xxhash64("id", F.lit(37)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    base = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    lexical = toxicity.fit(toxicity.labelled_rows(base, labelled, id_col="id"))
    domains = list(targets)
    mixture = Mixture(domains, lexical, None, most)
    stats = table(quality.with_statistics(base, text_col="text", keep=["id"], more=_lexical(lexical)))
    domain = F.when(F.col("toxic") == 1, "toxic" if "toxic" in targets else "low").when(F.col("quality") == 0, "low").otherwise("plain")
    y = F.array(*[(domain == d).cast("double") for d in domains])
    train = table(stats.join(labelled, "id").select("x", y.alias("y")))
    mixture.model = quality.fit(train, len(domains))
    soft = table(_posteriors(stats, mixture))
    drop(train, stats)
    project(soft, mixture, targets, anchor, anchor_rate, passes)
    if mixture.gap > tolerance:
        warnings.warn(f"mixing: a gap of {mixture.gap:.2g} of the tokens is left", stacklevel=2)
    return mixture, soft


def project(soft: DataFrame, mixture: Mixture, targets: dict[str, float], anchor: str, anchor_rate: float, passes: int) -> None:
    """Projected gradient over a table of posteriors (n_tokens, p0, p1, ...): sets the mixture's steps and gaps."""
    k = len(mixture.domains)
    p = [F.col(f"p{i}") for i in range(k)]
    (tokens, gram), total = _sums(soft, p, [F.lit(1.0)], mixture.most)
    if not total:
        return
    share = np.array([targets[d] for d in mixture.domains])
    at = mixture.domains.index(anchor)
    want = share * anchor_rate * tokens[at] / share[at]
    ridge = 1e-9 * total * np.eye(k)
    metric = np.linalg.inv(gram + ridge)
    cost = lambda t: float((t - want) @ metric @ (t - want))
    mixture.gaps.append(float(np.abs(tokens - want).max() / want.sum()))
    for _ in range(passes):
        if mixture.gap < ENOUGH:
            break
        steps = [a * (metric @ (tokens - want)) for a in LENGTHS] + [a * np.linalg.solve(gram + ridge, tokens - want) for a in FREE_LENGTHS]
        r = mixture.rate(p)
        *tried, _ = _sums(soft, p, [_stepped(r, p, g, mixture.most) for g in steps], mixture.most)
        best = min(range(len(steps)), key=lambda i: cost(tried[i][0]))
        if cost(tried[best][0]) >= cost(tokens):
            break
        mixture.steps.append(steps[best])
        tokens, gram = tried[best]
        mixture.gaps.append(float(np.abs(tokens - want).max() / want.sum()))


def _posteriors(stats: DataFrame, mixture: Mixture) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                p = mixture.posterior(np.stack(pdf["x"]))
                yield pd.DataFrame({"id": pdf["id"], "n_tokens": pdf["n_words"]} | {f"p{k}": p[:, k] for k in range(p.shape[1])})

    schema = stats.select("id").schema.add("n_tokens", "long")
    for k in range(len(mixture.domains)):
        schema = schema.add(f"p{k}", "double")
    return stats.select("id", "n_words", "x").mapInPandas(run, schema)


def _sums(soft: DataFrame, p: list[Column], rates: list[Column], most: float) -> list:
    """For each rate, the expected tokens of each domain and the Gram matrix of memberships at rates between 0 and the bound; then all tokens. One pass."""
    k = len(p)
    names = [f"r{i}" for i in range(len(rates))]
    rated = soft.select("n_tokens", *p, *[r.alias(n) for n, r in zip(names, rates)])
    aggs = []
    for name in names:
        aggs += [F.sum(F.col("n_tokens") * F.col(name) * p[i]) for i in range(k)]
        aggs += [F.sum(F.when((F.col(name) > 0) & (F.col(name) < most), F.col("n_tokens") * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(i, k)]
    x = [v or 0.0 for v in rated.agg(*aggs, F.sum("n_tokens")).first()]
    out, each = [], k + k * (k + 1) // 2
    for s in range(0, len(x) - 1, each):
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = x[s + k : s + each]
        out.append((np.array(x[s : s + k]), gram + np.triu(gram, 1).T))
    return [*out, float(x[-1])]


def rates(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Fit, and the result of apply for the same documents (id kept), in one pass over their texts.

    Empty table: empty result. See fit_with_inputs for nulls and repeated rows,
    apply for the columns; `gap` is the share of tokens by which targets were missed.
    """
    mixture, soft = fit_with_inputs(docs, labels, id_col=id_col, **options)
    p = [F.col(f"p{i}") for i in range(len(mixture.domains))]
    rate = mixture.rate(p)
    return soft.select(
        F.col("id").alias(id_col), "n_tokens", *[c.alias(f"p_{d}") for c, d in zip(p, mixture.domains)], rate.alias("rate"), _copies(rate, F.col("id")).alias("copies"), F.lit(mixture.gap).alias("gap")
    )


def _copies(rate: Column, id_: Column) -> Column:
    u = F.pmod(F.xxhash64(id_, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def rated(docs: DataFrame, mixture: Mixture, name: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and a struct column `name`: n_tokens, p_<domain>, rate, copies; see apply."""
    shared = docs.sparkSession.sparkContext.broadcast(mixture)
    more = _lexical(mixture.lexical)

    def run(texts):
        x = quality.statistics(texts)
        n = np.rint(np.expm1(x[:, 0])).astype(np.int64)
        return {"n": n, "p": list(shared.value.posterior(np.concatenate([x, more(texts)[:, None]], axis=1)))}

    tune(docs.sparkSession)
    made = fresh(docs, "__made")
    with_p = docs.withColumn(made, text_udf(run, "n long, p array<double>", docs.sparkSession)(named(text_col).cast("string")))
    p = [named(made)["p"][i] for i in range(len(mixture.domains))]
    with_p = with_p.withColumn(name, F.struct(
        named(made)["n"].alias("n_tokens"), *[c.alias(f"p_{d}") for c, d in zip(p, mixture.domains)], mixture.rate(p).alias("rate"), _copies(mixture.rate(p), named(id_col)).alias("copies")
    ))
    return with_p.drop(made)


def apply(docs: DataFrame, mixture: Mixture, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str]) -> DataFrame:
    """`keep`, n_tokens, p_<domain>, rate, copies for each row.

    copies is the rate rounded up or down by a hash of the id, so that it is
    the rate on average. A null or empty text has no tokens, counts nothing and
    gets the rate of its posterior. Repeated rows get equal rates and copies.
    Empty table: empty result. Columns of docs may have any names.
    """
    name = fresh(docs, "__mixed")
    return rated(docs, mixture, name, id_col=id_col, text_col=text_col).select(*[named(c) for c in keep], f"{name}.*")
