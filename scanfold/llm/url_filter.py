"""URL filters: rules by host and path, and a ratio of two character models for the rest.

Urls that a rule decides are the labelled samples: those it allows train the model of accepted
urls, those it blocks that of rejected ones. Each is a Markov model over a fixed alphabet whose
order varies: a character's chance after two others is mixed with that after one, after none and
with an even one, by how many different followers each context has had (Witten-Bell). A url's
score is the difference of the two log-likelihoods per character. A fifth of the labelled urls,
chosen by hash, is kept from training and sets the threshold, where both classes' held-out scores are
equally many standard deviations away.

DataFrame functions only. The model is an array of one size for any input, and reaches the scoring
as a scalar subquery; nothing but counts by character triple is shuffled. A null url, or one
without ``://``, has an empty host and path and fits no rule; its score is that of its characters,
0 without any. If a class has no samples, scores are even and the threshold is 0, so the method
allows. Urls of any length are read whole; rows that repeat are judged each for itself.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Letters, one sign for every digit, punctuation of urls, one sign for all else.
SIGNS = string.ascii_lowercase + "0" + "/.-_?=&%:#~+,;@!" + "^"
A = len(SIGNS) + 1  # and the place before a url begins
HOLD_OUT = 5


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains, and paths that begin so."""

    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _decided(rules, host: Column, path: Column, of) -> Column:
    """``of`` the longest rule that fits; of equally long ones the first listed."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(of(rule))).otherwise(found)
    return found


def _codes(url: Column) -> Column:
    """The url's characters as numbers from 1."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"\d", "0"), r"(?s)[^a-z0/.\-_?=&%:#~+,;@!]", "^")
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SIGNS), c))


def _triples(codes: Column) -> Column:
    """The number of each character together with the two before it."""
    def zeros(n):
        return F.array(*[F.lit(0)] * n)

    before = F.zip_with(F.concat(zeros(2), codes), F.concat(zeros(1), codes), lambda a, b: a * A + b)
    return F.filter(F.zip_with(before, codes, lambda ab, c: ab * A + c), lambda x: x.isNotNull())


def train(labelled: DataFrame) -> DataFrame:
    """One row, one column: the log-likelihood ratio of each triple's last character, accepted over
    rejected. ``labelled`` has url and verdict."""
    spark = labelled.sparkSession
    seen = labelled.select("verdict", F.explode(_triples(_codes(F.col("url")))).alias("abc"))
    counts = seen.groupBy("abc").agg(F.count_if(F.col("verdict") == "allow").alias("n1"), F.count_if(F.col("verdict") == "block").alias("n0"))
    three = (spark.range(A ** 3).join(counts, F.col("id") == F.col("abc"), "left")
             .select("id", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n0", F.lit(0)).alias("n0"),
                     F.floor(F.col("id") / A).alias("context"), (F.col("id") % A ** 2).alias("bc")))

    def mixed(rows: DataFrame, context, lower) -> DataFrame:
        """Chances p1 and p0: counts and the lower order's chances, mixed by the number of followers."""
        own = W.partitionBy(*context)
        for k in "10":
            total, kinds = F.sum(f"n{k}").over(own), F.sum((F.col(f"n{k}") > 0).cast("int")).over(own)
            rows = rows.withColumn(f"p{k}", F.when(total > 0, (F.col(f"n{k}") + kinds * lower(k)) / (total + kinds)).otherwise(lower(k)))
        return rows

    two = three.groupBy("bc").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).select(
        "bc", "n1", "n0", F.floor(F.col("bc") / A).alias("context"), (F.col("bc") % A).alias("c"))
    one = two.groupBy("c").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).withColumn("all", F.lit(0))
    one = mixed(one, ["all"], lambda k: F.lit(1.0 / A)).select("c", F.col("p1").alias("q1"), F.col("p0").alias("q0"))
    two = mixed(two.join(one, "c"), ["context"], lambda k: F.col(f"q{k}")).select("bc", F.col("p1").alias("q1"), F.col("p0").alias("q0"))
    three = mixed(three.join(two, "bc"), ["context"], lambda k: F.col(f"q{k}"))
    ratio = F.struct("id", (F.log("p1") - F.log("p0")).alias("r"))
    return three.agg(F.transform(F.sort_array(F.collect_list(ratio)), lambda x: x["r"]).alias("model"))


def score(url: Column, model: Column) -> Column:
    """The difference of log-likelihoods per character."""
    codes = _codes(url)
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(codes, zero, lambda t, c: F.struct(
        t["b"].alias("a"), c.alias("b"), (t["s"] + F.coalesce(F.get(model, (t["a"] * A + t["b"]) * A + c), F.lit(0.0))).alias("s"), (t["n"] + 1).alias("n")),
        lambda t: t["s"] / F.greatest(t["n"], F.lit(1)))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("*", _decided(rules, F.col("host"), F.col("path"), lambda r: r.host + r.path).alias("rule"),
                       _decided(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("by_rule"))
    labelled = rows.filter("by_rule is not null").select("url", F.col("by_rule").alias("verdict"), (F.pmod(F.xxhash64("url"), F.lit(HOLD_OUT)) == 0).alias("held_out"))
    model = train(labelled.filter("not held_out"))
    # The optimizer puts the subquery's value where the column is used, so rows don't carry it.
    held = labelled.filter("held_out").withColumn("model", model.scalar()).select("verdict", score(F.col("url"), F.col("model")).alias("score"))
    part = {v: F.when(F.col("verdict") == v, F.col("score")) for v in ("allow", "block")}
    m1, m0, s1, s0 = F.avg(part["allow"]), F.avg(part["block"]), F.stddev_pop(part["allow"]), F.stddev_pop(part["block"])
    threshold = held.agg(F.coalesce(F.when(s1 + s0 > 0, (m1 * s0 + m0 * s1) / (s1 + s0)), (m1 + m0) / 2, F.lit(0.0)).alias("threshold"))
    scored = rows.withColumn("model", model.scalar()).select("id", "host", "path", "rule", "by_rule", score(F.col("url"), F.col("model")).alias("score"))
    by_model = F.when(F.col("score") >= threshold.scalar(), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
