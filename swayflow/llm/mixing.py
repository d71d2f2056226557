"""Soft-membership mixing: domain posteriors from labelled rows, document rates by projected gradients.

DataFrame operations only. The classifier holds every domain against the one with the most labelled
rows. It adds up, over the words that speak for a domain, the log-odds of the domain against the
others given that the text has the word or has it not; words that speak against a domain, such as
those of another language, say nothing of it. The log-odds count as far as the labelled rows bear
them out: they are multiplied by 1 - EVIDENCE / G, G being the
log-likelihood ratio of the word's counts, and are 0 below it. All words of the labelled rows are
looked at; those that say something meet the words of the texts by broadcast.

Rates r >= 0 minimise the squared distance of the expected token totals sum(r * tokens *
p(domain)) from the targets, with a slight pull (RIDGE) to r = 1 that makes them unique. The
gradient is summed per domain; each step scales it by the inverse of the domains' products over
the rows that are not at 0, and projects every row's rate to r >= 0. A step needs one row of
totals and the rates stay one short expression of the posteriors. It ends when the gradient is
below TOLERANCE, and raises if that takes over MOST_STEPS steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load, words_of

DOMAINS = ("clean", "junk", "toxic")
#: Shares of all tokens that the mix is to have.
TARGETS = {"clean": 0.98, "junk": 0.01, "toxic": 0.01}
#: Bounds of the classifier only: labelled rows it is fitted on, and bytes of their texts.
LABELLED, LABELLED_BYTES = 20_000, 256 << 20
#: A domain with fewer labelled rows can't be learned; it is left out, with its target.
LEAST_LABELLED = 16
#: The log-likelihood ratio below which a word says nothing (16: four standard errors).
EVIDENCE = 16.0
RIDGE, TOLERANCE, MOST_STEPS = 1e-8, 1e-7, 60


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, domain, words of the labelled rows drawn by hash; labels of one id that differ: the worst counts; texts of one id that differ: one of them, by hash."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").otherwise("clean")
    found = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", domain.alias("domain")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most LABELLED rows
    found = scratch.save("labelled", found)
    upto = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id")  # of at most LABELLED narrow rows
    few = found.select("doc_id", F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(upto).alias("_b")).where(F.col("_b") <= LABELLED_BYTES).select("doc_id")
    return found.join(F.broadcast(few), "doc_id").select("doc_id", "domain", F.array_distinct(words_of(F.lower("text"))).alias("words"))


def classifier(sample: DataFrame, scratch: Scratch) -> tuple[dict[str, float], DataFrame | None]:
    """Bias of each domain (-inf: left out), and word, w (a weight for each of DOMAINS) of the words that say something."""
    n = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    used = [d for d in DOMAINS if n.get(d, 0) >= LEAST_LABELLED]
    if len(used) < 2:
        return {d: 0.0 if not used or d in used else -math.inf for d in DOMAINS}, None
    rows, base = sum(n[d] for d in used), max(used, key=lambda d: n[d])
    counts = sample.where(F.col("domain").isin(used)).select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in used])
    total = sum(F.col(d) for d in used)

    def weight(d: str) -> Column:
        cells = [(F.col(d), n[d], total), (n[d] - F.col(d), n[d], rows - total), (total - F.col(d), rows - n[d], total), (rows - n[d] - total + F.col(d), rows - n[d], rows - total)]
        ratio = 2 * sum((F.when(seen > 0, seen * F.log(seen * F.lit(float(rows)) / (F.lit(float(of)) * every))).otherwise(0.0) for seen, of, every in cells), F.lit(0.0))
        a, b, c, e = (seen + 0.5 for seen, _, _ in cells)
        borne_out = F.when((ratio > EVIDENCE) & (a * e > b * c), 1 - EVIDENCE / ratio).otherwise(0.0)
        return F.array(F.log(a * e / (b * c)) * borne_out, F.log(b * (c + e) / (e * (a + b))) * borne_out)

    words = counts.select("word", *[(weight(d) if d in used and d != base else F.array(F.lit(0.0), F.lit(0.0))).alias(f"_{d}") for d in DOMAINS])
    words = words.select("word", *[F.array(*[F.get(f"_{d}", F.lit(k)) for d in DOMAINS]).alias(c) for k, c in enumerate(("w", "missing"))]).where(F.exists("w", lambda x: x != 0))
    words = scratch.save("weights", words)
    # What it says that a text has none of the words; a word that is there takes its part back.
    none = words.agg(*[F.sum(F.get("missing", F.lit(k))).alias(d) for k, d in enumerate(DOMAINS)]).first()
    return {d: math.log(n[d] / rows) + (none[d] or 0.0) if d in used else -math.inf for d in DOMAINS}, words.select("word", "w")


def posteriors(docs: DataFrame, bias: dict[str, float], words: DataFrame | None, text: str = "text") -> DataFrame:
    """Adds n_tokens (words) and p_<domain> to every row, of which the text is dropped; words: as `classifier` gives them, of at most LABELLED_BYTES of text.

    The distinct words of a text meet their weights by broadcast. A text's words are in one task, so
    they are summed there, and one narrow row of each text is shuffled.
    """
    # Lowered as a whole, as in `labelled`: a letter's lower form may depend on its neighbours. It leaves as many words.
    out = docs.withColumn("_words", words_of(F.lower(F.col(text)))).withColumn("n_tokens", F.size("_words").cast("long")).drop(text)
    score = [F.lit(bias[d]) for d in DOMAINS]
    if words is not None:
        keys = [c for c in out.columns if c != "_words"]
        weights = F.broadcast(words.select(F.col("word").alias("_word"), *[F.get("w", F.lit(k)).alias(f"_w{k}") for k in range(len(DOMAINS))]))
        each = out.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keys, F.explode_outer(F.array_distinct("_words")).alias("_word")).join(weights, "_word", "left")
        out = each.groupBy("_row", *keys).agg(*[F.sum(f"_w{k}").alias(f"_w{k}") for k in range(len(DOMAINS))]).drop("_row")
        score = [b + F.coalesce(F.col(f"_w{k}"), F.lit(0.0)) for k, b in enumerate(score)]
    out = out.withColumns({f"_s{k}": s for k, s in enumerate(score)})
    top = F.greatest(*[F.col(f"_s{k}") for k in range(len(DOMAINS))])
    out = out.withColumns({f"_e{k}": F.exp(F.col(f"_s{k}") - top) for k in range(len(DOMAINS))})
    total = sum(F.col(f"_e{k}") for k in range(len(DOMAINS)))
    out = out.withColumns({f"p_{d}": F.col(f"_e{k}") / total for k, d in enumerate(DOMAINS)})
    return out.drop("_words", *[f"_{x}{k}" for x in "wse" for k in range(len(DOMAINS))])


def rates(rows: DataFrame, targets: dict[str, float]) -> tuple[Column, dict[str, float], int]:
    """The rate of a row as one expression, the shares of the expected totals, and how many steps it took.

    rows: n_tokens and p_<domain>, written. Domains without tokens, as those left out, can't be met: the others share their targets.
    """
    start = rows.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]).first()
    n = start["n"] or 0
    used = [d for d in DOMAINS if n and start[d] > 1e-9 * n]
    if not used:
        return F.lit(1.0), {}, 0
    met = sum(targets[d] for d in used)
    wanted = np.array([targets[d] / met if met else 1 / len(used) for d in used])

    def rate(z: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum(F.col(f"p_{d}") * F.lit(float(x)) for d, x in zip(used, z)))

    def sums(z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """What the steps raise, its gradient, the shares, and the products of the domains over the rows that are not at 0."""
        mass = {d: F.col("n_tokens") * F.col(f"p_{d}") for d in used}
        pairs = [(d, e) for k, d in enumerate(used) for e in used[k:]]
        got = rows.withColumn("_r", rate(z)).agg(F.sum(F.col("n_tokens") * F.col("_r") * F.col("_r")).alias("_q"), *[F.sum(mass[d] * F.col("_r")).alias(d) for d in used], *[F.sum(F.when(F.col("_r") > 0, mass[d] * F.col(f"p_{e}")).otherwise(0.0)).alias(f"{d}*{e}") for d, e in pairs]).first()
        have = np.array([got[d] / n for d in used])
        products = np.array([[got[f"{d}*{e}"] if (d, e) in pairs else got[f"{e}*{d}"] for e in used] for d in used]) / n
        return -got["_q"] / n / 2 - float(z @ wanted) - RIDGE / 2 * float(z @ z), have - wanted - RIDGE * z, have, products

    z, steps = np.zeros(len(used)), 0
    height, gradient, have, products = sums(z)
    while np.abs(gradient).max() > TOLERANCE:
        move, share = np.linalg.solve(products + RIDGE * np.eye(len(used)), gradient), 1.0
        while True:
            steps += 1
            if steps > MOST_STEPS:
                raise RuntimeError(f"rates have not converged: gradient {np.abs(gradient).max():.2g} after {MOST_STEPS} steps")
            next_ = sums(z + share * move)
            if next_[0] >= height + 1e-4 * share * float(gradient @ move) or np.abs(next_[1]).max() <= TOLERANCE:
                break
            share /= 4
        z, (height, gradient, have, products) = z + share * move, next_
    return rate(z), dict(zip(used, have.tolist())), steps


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies, residual, place (a hash of the text) of every row.

    copies is the whole part of the rate, plus one with the chance of the rest by a hash of the
    row, so repeated rows are rated and copied alike. residual: how far the farthest domain's share
    of the expected tokens is from its target; 0 but for the ridge where the targets can be met.
    Null or empty texts have no tokens and the domains' prior; domains of fewer than LEAST_LABELLED
    labelled rows have p 0 and no target, and where that holds for all, all are as likely. Rows
    without an id are never labelled. There are no ties to break. A text of any length is one row of
    one task. An empty table gives none; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    body = docs.select("doc_id", F.col(text).alias("text"))
    bias, words = classifier(labelled(body, labels, scratch), scratch)
    draw = (F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("_u")
    rows = scratch.save("rows", posteriors(body.select("doc_id", "text", F.xxhash64("text").alias("place"), draw), bias, words))
    rate, shares, _ = rates(rows, targets)
    met = sum(targets[d] for d in shares)
    residual = max((abs(x - (targets[d] / met if met else 1 / len(shares))) for d, x in shares.items()), default=0.0)
    out = rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + F.col("_u")).cast("int"))
    return out.select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies", F.lit(residual).alias("residual"), "place")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
