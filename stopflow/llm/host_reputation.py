"""Host reputation: labelled page outcomes, shrunk from suffix to registered domain to host."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.llm.frames import stored


class UrlRule(NamedTuple):
    """Fits the host and its subdomains when the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))

# A page outcome counts as bad; hosts are blocked when the posterior says with
# this many standard deviations that more than MAX_BAD of their pages are bad.
MAX_BAD = 0.5
Z = 1.645
# Weight of the flat prior at the top, and limits of a level's prior weight.
TOP_WEIGHT = 2.0
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1000.0

# Suffixes of two labels under which anybody registers a domain; others have one.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "co.za", "com.br", "com.cn", "com.mx", "com.tr")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, domain and suffix. The suffix is the last label, or two that
    are one of SUFFIXES, the domain has one label more; a port belongs to
    neither. A url that is null or has no `://` has an empty host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    out = pages.drop("host", "path", "domain", "suffix", "_u_rest").withColumn("_u_rest", rest)
    out = out.withColumn("host", F.translate(F.regexp_extract("_u_rest", r"^([^/?#]*)", 1), _UPPER, _LOWER))
    out = out.withColumn("path", F.regexp_extract("_u_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_u_rest")
    name = F.regexp_replace("host", r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(*SUFFIXES)
    return out.withColumn("domain", F.when(wide, F.substring_index(name, ".", -3)).otherwise(two)).withColumn("suffix", F.when(wide, two).otherwise(F.substring_index(name, ".", -1)))


def rule_for(rules: Sequence[UrlRule], what: str) -> Column:
    """Name or verdict of the longest rule that fits, else null; of equally long
    ones the first in alphabetical order."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


def _level(counts: DataFrame, key: str, parent: str | None, prior: DataFrame | Column) -> DataFrame:
    """Posterior mean of each `key` from its counts and its parent's mean.

    The weight of the prior is fitted once per level by the method of moments
    from how far the keys' rates spread around their parents' beyond what
    binomial noise explains: w = (1 - rho) / rho with rho the excess variance
    relative to m (1 - m). It is one number per level, from sums over all keys.
    """
    keys = [key] if parent is None else [key, parent]
    merged = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    if parent is None:
        merged = merged.withColumn("_m", prior)
    else:
        merged = merged.join(prior.select(F.col("_k").alias(parent), F.col("_mean").alias("_m")), parent)
    v = F.col("_m") * (1 - F.col("_m"))
    d = F.col("bad") / F.col("n") - F.col("_m")
    excess, room = F.sum(F.col("n") * d * d) - F.sum(v), F.sum((F.col("n") - 1) * v)
    rho = F.when(room > 0, excess / room).otherwise(F.lit(0.0))
    weight = merged.where("n > 0").agg(F.coalesce(rho, F.lit(0.0)).alias("rho")).select(
        F.when(F.col("rho") <= 1 / (1 + MAX_WEIGHT), F.lit(MAX_WEIGHT)).when(F.col("rho") >= 1 / (1 + MIN_WEIGHT), F.lit(MIN_WEIGHT)).otherwise((1 - F.col("rho")) / F.col("rho"))).scalar()
    out = merged.withColumn("_w", weight)
    a, b = F.col("_m") * F.col("_w") + F.col("bad"), (1 - F.col("_m")) * F.col("_w") + F.col("n") - F.col("bad")
    return out.select(F.col(key).alias("_k"), (a / (a + b)).alias("_mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("_sd"), "n", "bad")


def reputations(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", bad: str = "bad") -> DataFrame:
    """One row per host: labelled pages, bad ones, posterior mean, deviation and
    lower bound of the share of bad pages.

    `outcomes` has (page_id, bad 0/1); null ids or outcomes are ignored, and the
    outcomes of an id that occurs several times all count. Outcomes are added up
    per host before anything else is shuffled, so a host with a third of all
    pages costs one row. Hosts without labels get their domain's posterior.
    """
    labelled = outcomes.where(F.col(bad).isNotNull()).select(F.col(page_id).alias("_id"), F.col(bad).cast("long").alias("bad")).groupBy("_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    parts = with_parts(pages).select(F.col(page_id).alias("_id"), "host", "domain", "suffix")
    counts = parts.join(labelled, "_id", "left").groupBy("host", "domain", "suffix").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    counts = stored(counts, "host-counts")
    n, b = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))
    top = counts.agg(((b + TOP_WEIGHT / 2) / (n + TOP_WEIGHT)).alias("m")).scalar()
    suffixes = _level(counts, "suffix", None, top)
    domains = _level(counts, "domain", "suffix", suffixes)
    hosts = _level(counts, "host", "domain", domains)
    return hosts.select(F.col("_k").alias("host"), F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.round("_mean", 9).alias("bad_mean"), F.round("_sd", 9).alias("bad_sd"),
                        F.round(F.greatest(F.lit(0.0), F.col("_mean") - Z * F.col("_sd")), 9).alias("bad_low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule] = RULES, max_bad: float = MAX_BAD, page_id: str = "page_id", url: str = "url", bad: str = "bad") -> DataFrame:
    """Adds host, path, rule, verdict and the host's posterior to the pages;
    columns of these names are replaced. A rule that fits decides; otherwise a
    host is blocked when the lower bound of its share of bad pages is above
    `max_bad`. Rows with equal ids are judged each by their own url. The table
    of hosts is joined by adaptive execution, which splits a hot host."""
    added = ("rule", "verdict", "n_labelled", "n_bad", "bad_mean", "bad_sd", "bad_low")
    parts = with_parts(pages.drop(*added), url)
    rated = reputations(pages.select(page_id, F.col(url).alias("url")), outcomes, page_id, bad)
    out = parts.join(rated, "host", "left")
    by_method = F.when(F.col("bad_low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", rule_for(rules, "name")).withColumn("verdict", F.coalesce(rule_for(rules, "verdict"), by_method)).drop("domain", "suffix")
