"""Mixing documents to target weights of domains, with soft membership.

1. A classifier table. From a bounded sample of labelled rows (at most `MAX_LABELLED`, those with the smallest
   hash of doc_id) every word is counted for each domain; the table has a row for each of these words and the
   log of its smoothed share in each domain. No word is left out, so a scarce domain keeps its words however
   frequent those of another are.
2. Posteriors. Each document's words meet that table; the summed logs plus the domains' log priors give the
   probability of each domain (softmax, rounded to three digits and made to sum to one).
3. Rates. Document i has t_i words and expected t_i * p_ik words of domain k. Wanted are rates lower <= r_i <= upper
   for which the expected totals sum_i r_i t_i p_ik equal the targets T_k. Starting from r = 1 the least-squares
   objective falls by projected gradient steps, r_i <- min(upper, max(lower, r_i - sum_k p_ik y_k)), where y is the errors
   of the domains scaled by the inverse of sum_i t_i p_ik p_il over the documents that are free to move; a step that does not
   come closer is halved. Each is a distributed sum over the data, which sends a few numbers for each domain to the
   driver. Documents of equal posteriors have equal rates, so the sums run over cells (posterior, words), which are
   aggregated once.
4. The size of the mixture follows from the weights: the smallest one in which every domain can be met with rates
   of one or more ("up", documents repeat), or the largest one with rates of at most one ("down"). Where steps
   stop to come closer (soft posteriors with a lower bound on rates), a mixture "up" is enlarged by GROWTH, ENLARGED times
   at most. What is missed after that, or after MAX_STEPS steps in all, is not hidden: the column `missed` says by which share of the mixture the worst domain is off.

Everything is DataFrame operations. What grows with the corpus stays distributed: broadcast are only the words of the
sample (joined by a shuffle where they are many) and, as literals, the error vectors of the steps.

Defined results: null and empty texts have no words, the prior as their posterior, and the rate 1, as they cannot help;
null domains are not trained on; repeated rows (equal doc_id and text) are one row with the tokens of all of them and the
posterior of one, and the stage repeats each of them alike; a null doc_id is a value of its own; very long texts are split whole, one text in memory at a time; an empty table gives an empty result; one without labelled rows, gives posteriors from the priors that are there (uniform without any); columns of the input that
are named like a computed one are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ROW_KEY, counted, stored, table

MAX_LABELLED = 4000
MAX_STEPS = 40
TOLERANCE = 1e-4
#: A mixture whose miss is not halved by any of PATIENCE steps is enlarged.
PATIENCE, GROWTH, ENLARGED = 3, 1.04, 6
#: No document is to occur more often than this.
MAX_RATE = 100.0
#: Shares that the query and the pipeline ask for.
TARGETS = {"en": 0.45, "fr": 0.2, "de": 0.2, "es": 0.15}

_WORDS = "filter(split(lower(text), '[ \\\\x09-\\\\x0D]+'), x -> x <> '')"


def _words(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.expr(_WORDS)).alias("word"))


def classifier_table(docs: DataFrame, labels: DataFrame, domain: str, domains: list[str], max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[float]]:
    """(word, w0, w1, ...): log shares by domain; and the log priors."""
    ids = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = docs.where(F.col(domain).isin(domains)).select("doc_id", F.col(domain).alias("domain"), "text")
    known = known.join(F.broadcast(ids), "doc_id", "left_semi")  # max_labelled ids
    counts = _words(known, "domain").groupBy("word").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)])
    counts = stored(counts, "markers")
    n_words, *sums = counts.agg(F.count("*"), *[F.sum(f"n{k}") for k in range(len(domains))]).first()
    weights = [F.log((F.col(f"n{k}") + 0.5) / F.lit((sums[k] or 0) + 0.5 * max(n_words, 1))).alias(f"w{k}") for k in range(len(domains))]
    rows = known.groupBy("domain").count().collect()  # one row for each of the named domains
    seen = {r["domain"]: r["count"] for r in rows}
    every = sum(seen.values()) + len(domains)
    return counts.select("word", *weights), [math.log((seen.get(d, 0) + 1) / every) for d in domains]


def posteriors(docs: DataFrame, markers: DataFrame, priors: list[float], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_hash, tokens, copies and posterior p (array) of every different (doc_id, text)."""
    ks = range(len(priors))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), *keep, F.coalesce("text", F.lit("")).alias("text"))
    split = rows.select("doc_id", "text_hash", *keep, F.expr(_WORDS).alias("ws"))
    words = split.select("doc_id", "text_hash", *keep, F.size("ws").alias("n"), F.explode_outer("ws").alias("word"))
    scored = words.join(counted(markers), "word", "left")
    summed = scored.groupBy("doc_id", "text_hash", *keep).agg(F.count("word").alias("words"), F.max("n").alias("n"), *[F.sum(F.coalesce(f"w{k}", F.lit(0.0))).alias(f"s{k}") for k in ks])
    # equal rows are summed together: one of them has n of the words
    logs = [F.col(f"s{k}") * F.when(F.col("words") > 0, F.col("n") / F.col("words")).otherwise(1.0) + F.lit(priors[k]) for k in ks]
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    raw = summed.withColumn("e", F.array(*[F.exp(x - most) for x in logs]))
    # three digits, so that documents gather in cells; the largest takes what rounding leaves
    rounded = F.transform("e", lambda x: F.round(1000 * x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).cast("int"))
    raw = raw.withColumn("m", rounded)
    spare = F.lit(1000) - F.aggregate("m", F.lit(0), lambda a, b: a + b)
    top = F.array_position("m", F.array_max("m")) - 1
    p = F.transform("m", lambda x, i: (x + F.when(i == top, spare).otherwise(0)) / 1000)
    return raw.withColumn("p", p).selectExpr("doc_id", "text_hash", *keep, "words as tokens", "p")


@dataclass
class Rates:
    """The fitted rate of a posterior: a fold over the steps' weighted errors, and how it went."""

    steps: list[list[float]]
    lower: float
    upper: float
    targets: list[float]
    reached: list[float]

    @property
    def missed(self) -> float:
        """The share of the mixture by which the worst domain is off."""
        total = sum(self.targets)
        return max(abs(a - b) for a, b in zip(self.reached, self.targets, strict=True)) / total if total else 0.0

    def column(self, p: Column) -> Column:
        if not self.steps:
            return F.lit(1.0)
        each = F.array(*[F.array(*[F.lit(x) for x in g]) for g in self.steps])
        dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.aggregate(each, F.lit(1.0), lambda r, g: F.least(F.lit(self.upper), F.greatest(F.lit(self.lower), r - dot(g))))


def fit_rates(post: DataFrame, weights: list[float], size: str = "up", lower: float = 0.0, max_steps: int = MAX_STEPS, upper: float = MAX_RATE) -> Rates:
    """Projected-gradient least squares on the cells of a posterior table (tokens, p)."""
    k_all = range(len(weights))
    cells = stored(post.groupBy("p").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    expected = lambda r: [F.sum(r * F.col("tokens") * F.col("p")[k]) for k in k_all]
    mass = [float(x or 0) for x in cells.agg(*expected(F.lit(1.0))).first()]
    scale = sum(weights) or 1.0
    share = [w / scale for w in weights]
    ratios = [m / w for m, w in zip(mass, share, strict=True) if w > 0 and m > 0]
    total = (max(ratios) if size == "up" else min(ratios)) if ratios else 0.0
    targets = [total * w for w in share]
    fitted = Rates([], lower, upper, targets, mass)
    best, slow, enlarged = fitted, 0, 0
    for _ in range(max_steps if ratios else 0):
        if fitted.missed <= TOLERANCE:
            break
        error = [a - b for a, b in zip(fitted.reached, fitted.targets, strict=True)]
        # sum_i t_i p_ik p_il over the cells whose rate the gradient moves: its inverse turns errors into a step
        rate, p, pull = fitted.column(F.col("p")), F.col("p"), sum((F.col("p")[k] * F.lit(error[k]) for k in k_all), F.lit(0.0))
        free = ((rate > lower) | (pull < 0)) & ((rate < upper) | (pull > 0))
        gram = cells.where(free).agg(*[F.sum(F.col("tokens") * p[k] * p[j]) for k in k_all for j in k_all]).first()
        matrix = np.array([float(x or 0) for x in gram]).reshape(len(weights), -1)
        step = np.linalg.solve(matrix + np.eye(len(weights)) * (1e-6 * matrix.trace() + 1e-9), np.array(error))
        for part in (1.0, 0.5, 0.25, 0.125):
            tried = replace(fitted, steps=[*fitted.steps, (part * step).tolist()])
            tried.reached = [float(x or 0) for x in cells.agg(*expected(tried.column(p))).first()]
            if tried.missed < fitted.missed:
                break
        closer = tried.missed < fitted.missed
        slow = slow + 1 if tried.missed > fitted.missed / 2 else 0
        if closer:
            fitted = tried
            best = min(best, fitted, key=lambda x: x.missed)
        if slow >= PATIENCE or not closer:
            if size != "up" or enlarged == ENLARGED:
                break
            fitted, enlarged, slow = replace(fitted, targets=[GROWTH * t for t in fitted.targets]), enlarged + 1, 0
    return best


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "lang", size: str = "up", lower: float = 0.0, upper: float = MAX_RATE) -> DataFrame:
    """doc_id, text_hash, tokens, p_<domain>..., rate, copies and missed of every different (doc_id, text).

    copies is rate rounded down or up by a hash of the document, so that its mean is the rate.
    """
    domains = list(targets)
    markers, priors = classifier_table(docs, labels, domain, domains)
    post = stored(posteriors(docs, markers, priors), "posteriors")
    fitted = fit_rates(post, [targets[d] for d in domains], size, lower, upper=upper)
    out = post.withColumn("rate", F.when(F.col("tokens") > 0, fitted.column(F.col("p"))).otherwise(1.0))
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text_hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    return out.select("doc_id", "text_hash", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)], "rate", copies, F.lit(fitted.missed).alias("missed"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mixture wants it; none goes (rates are one or more)."""
    mixed = mix(docs, table(spark, sf_dir, "labels"), TARGETS, lower=1.0)
    key = lambda text_hash: dict(zip(ROW_KEY, (F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), text_hash), text_hash), strict=True))
    again = mixed.where("copies > 1").withColumns(key(F.col("text_hash"))).select(*ROW_KEY, F.explode(F.expr("sequence(2, copies)")).alias("_copy"))
    again = counted(stored(again, "again"))
    whole = docs.withColumns(key(F.xxhash64(F.coalesce("text", F.lit("")))))
    return docs.unionByName(whole.join(again, ROW_KEY).select(*docs.columns))
