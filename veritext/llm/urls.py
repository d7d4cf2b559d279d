"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host and rolled up to the registered domain, the
suffix and the whole. Each level's rate is shrunk towards its parent's posterior mean by a beta prior
whose strength is fitted to the spread between siblings (method of moments); a host without labels has
its domain's rate, and so on up. A host is blocked when the lower bound of its posterior bad rate, the
mean less ``z`` standard deviations, lies above the overall rate (or above ``max_bad``, where one is given).
Explicit rules come before the model.

A host's suffix is its last label, or its last two where the last is a country's (two letters) and the one
before is of the kind under which countries register (``SECOND_LEVEL``), or where the two are named in
``long_suffixes``; the registered domain is the suffix and one label more.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged
by the overall rate; a page without label adds nothing; repeated rows count as often as they occur; with
no labels at all nothing is blocked; urls of any length are read whole; only the named columns are read, so
others may have any name. A hot host is only ever pre-aggregated or joined, never grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import ascii_lower, written

#: Labels that stand for a kind of registrant before a country's label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "ltd", "mil", "ne", "net", "nom", "or",
                "org", "plc", "sch")
Z = 1.0
#: Range in which a fitted prior strength (in pages) is held.
STRENGTH = (2.0, 200.0)
BAD = "bad"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def path_number(path: Column) -> Column:
    """The whole number that a path ends in, an extension and a slash aside; else null."""
    return F.regexp_extract(path, r"([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1).try_cast("bigint")


def _long(host: Column, long_suffixes: Sequence[str]) -> Column:
    two = F.substring_index(host, ".", -2)
    kind, country = F.substring_index(two, ".", 1), F.substring_index(two, ".", -1)
    return (kind.isin(*SECOND_LEVEL) & country.rlike("^[a-z]{2}$") & two.contains(".")) | two.isin(*long_suffixes)


def suffix_of(host: Column, long_suffixes: Sequence[str] = ()) -> Column:
    return F.when(_long(host, long_suffixes), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = ()) -> Column:
    return F.when(_long(host, long_suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. ``rules``: (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        rule_host, slash, rest = text.partition("/")
        rule_host = "".join(c.lower() if c.isascii() else c for c in rule_host)
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame) -> float:
    """Prior strength of a level from ``children`` (n, bad, parent_mean): the spread of the counts beyond
    the binomial one gives the correlation of pages within a child, 1 / (1 + strength)."""
    n, k, m = F.col("n").cast("double"), F.col("bad").cast("double"), F.col("parent_mean")
    binomial = n * m * (1 - m)
    row = children.agg(F.sum((k - n * m) * (k - n * m) - binomial).alias("excess"),
                       F.sum(binomial * (n - 1)).alias("pairs")).first()
    low, high = STRENGTH
    if not row["pairs"] or row["excess"] <= 0:
        return high
    return min(max(row["pairs"] / row["excess"] - 1.0, low), high)


def reputation(outcomes: DataFrame, long_suffixes: Sequence[str] = ()) -> tuple[DataFrame, float]:
    """(host, n, bad, mean, sd), the posterior of the bad rate per host; and the overall rate.

    ``outcomes``: (host, bad), one row per page; ``bad`` is null where the page has no label. Only the
    overall rate and three prior strengths come to the driver.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"),
                                         F.count_if(F.col("bad")).alias("bad"))
    hosts = written(hosts.select("host", domain_of(F.col("host"), long_suffixes).alias("domain"),
                                 suffix_of(F.col("host"), long_suffixes).alias("suffix"), "n", "bad"), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 0.1) / ((total["n"] or 0) + 1.0)

    def means(children: DataFrame) -> tuple[DataFrame, Column]:
        s = _strength(children)
        return children, (F.col("bad") + s * F.col("parent_mean")) / (F.col("n") + s)

    top, mean = means(suffixes.withColumn("parent_mean", F.lit(overall)))
    top = top.select("suffix", mean.alias("parent_mean"))
    middle, mean = means(domains.join(top, "suffix"))
    middle = middle.select("domain", mean.alias("parent_mean"))
    low = hosts.join(middle, "domain")
    s = _strength(low)
    a = F.col("bad") + s * F.col("parent_mean")
    all_ = F.col("n") + s
    mean = a / all_
    return low.select("host", "n", "bad", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (all_ + 1)).alias("sd")), overall


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), url_col: str = "url",
          page_col: str = "page_id", label_col: str = "doc_id", shows: Column | None = None,
          bad: Column | None = None, z: float = Z, max_bad: float | None = None,
          long_suffixes: Sequence[str] = ()) -> DataFrame:
    """(page, host, path, rule, verdict, host_labelled, host_bad, bad_rate, bad_rate_low) per row of ``pages``.

    ``shows``: the id, over the columns host and path, by which ``labels`` names the outcome of a page
    (by default the number that the path ends in). Several labels of an id count as one, bad if any is.
    """
    bad = bad if bad is not None else (F.col("toxic") == 1) | (F.col("quality") == 0)
    known = (labels.select(F.col(label_col).alias("_page"), bad.alias(BAD)).filter("_page IS NOT NULL")
             .groupBy("_page").agg(F.max(BAD).alias(BAD)))
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    parsed = pages.select(F.col(page_col), host.alias("host"), path.alias("path"))
    shows = shows if shows is not None else path_number(F.col("path"))
    outcomes = parsed.select("host", shows.alias("_shows"))
    outcomes = outcomes.join(known, F.col("_shows") == F.col("_page"), "left").select("host", BAD)
    hosts, overall = reputation(outcomes, long_suffixes)
    limit = overall if max_bad is None else max_bad
    rated = hosts.select(
        F.col("host").alias("_host"), F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"),
        F.col("mean").alias("bad_rate"), (F.col("mean") - z * F.col("sd")).alias("bad_rate_low"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("bad_rate_low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return (parsed.join(rated, F.col("host") == F.col("_host"), "left")
            .select(F.col(page_col), "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, model).alias("verdict"), "host_labelled", "host_bad", "bad_rate",
                    "bad_rate_low"))
