"""URL filter: written rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are summed by host, registered domain and suffix. Each level's rate is beta-binomial
with a prior centred on the posterior mean of the level above it and a strength estimated from the corpus (moments of
the rates between siblings), so a host with few labels is judged mostly by its domain, and one with many by its own
record. A host is blocked only where the posterior's lower bound exceeds the limit: doubt allows.

Only DataFrame functions are used. The pages are never gathered by host: counts are summed before they are shuffled,
and the pages meet the finished host table in a join that Spark may split where one host has many pages.

Null urls, and urls without ://, have an empty host and path and are judged as one host. A null page_id has no outcome.
Repeated pages count and are returned as often as they occur. Of several labels of one page the page is bad if one says
so. Page ids may be of any type. Urls of any length are read whole; other columns are not read, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import settle


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class ReputationPolicy:
    """A host is blocked if the posterior's lower bound exceeds lift times the bad rate of all labelled pages, and
    block_above where that is less. z: the bound's distance in standard deviations. Strengths are held between the two
    limits, as few siblings say little of their spread. second_level: labels that make a suffix of two parts together
    with a country's code of two letters."""

    block_above: float = 0.5
    lift: float = 2.0
    z: float = 1.645
    least_strength: float = 2.0
    most_strength: float = 200.0
    second_level: tuple[str, ...] = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org")


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(text, verdict) of the longest rule that fits, else null."""
    picked = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: len(r.text), reverse=True)
    ]
    return F.coalesce(*picked)


IP = r"^(?:[0-9]+\.){3}[0-9]+$|^\["


def site_of(host: Column) -> Column:
    """The host without user, port and a closing dot."""
    named = F.regexp_extract(host, "([^@]*)$", 1)
    return F.regexp_replace(F.regexp_replace(named, "(?<=[^:]):[0-9]*$", ""), "\\.$", "")


def two_parts(site: Column, policy: ReputationPolicy) -> Column:
    return site.rlike(rf"(?:^|\.)(?:{'|'.join(policy.second_level)})\.[a-z]{{2}}$")


def suffix_of(host: Column, policy: ReputationPolicy) -> Column:
    """The last label, or two under a country's code; addresses have a suffix of their own."""
    site = site_of(host)
    return F.when(site.rlike(IP), F.lit("(address)")).when(two_parts(site, policy), F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))


def domain_of(host: Column, policy: ReputationPolicy) -> Column:
    """The suffix and one label before it; an address is its own domain."""
    site = site_of(host)
    return F.when(site.rlike(IP), site).when(two_parts(site, policy), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def strength(level: DataFrame, policy: ReputationPolicy) -> float:
    """The prior's strength for the rows of level (n, bad): from how much more their rates differ than chance allows."""
    seen = level.where("n > 0")
    total = seen.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()
    if not total["n"] or total["k"] < 2:
        return policy.most_strength
    n, mean = float(total["n"]), float(total["bad"]) / float(total["n"])
    chance, spare = mean * (1 - mean), n - float(total["nn"]) / n
    if chance <= 0 or spare <= 0:
        return policy.most_strength
    between = (float(total["bb"]) - n * mean * mean - (total["k"] - 1) * chance) / spare
    rho = min(max(between / chance, 1e-6), 0.999)
    return min(max(1 / rho - 1, policy.least_strength), policy.most_strength)


def host_reputation(outcomes: DataFrame, policy: ReputationPolicy | None = None) -> DataFrame:
    """outcomes: host, bad (boolean; null: not labelled). One row per host: n, bad, the posterior's mean and lower bound,
    and the limit of the corpus."""
    policy = policy or ReputationPolicy()
    hosts = settle(
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad"))
        .withColumns({"domain": domain_of(F.col("host"), policy), "suffix": suffix_of(F.col("host"), policy)}),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1).alias("a"), (F.coalesce(F.sum("n"), F.lit(0)) + 2).alias("b")).first()
    overall = root["a"] / root["b"]

    def mean(prior: Column, s: float) -> Column:
        return (prior * s + F.col("bad")) / (F.lit(s) + F.col("n"))

    s_suffix, s_domain, s_host = strength(suffixes, policy), strength(domains, policy), strength(hosts, policy)
    suffix_mean = suffixes.select("suffix", mean(F.lit(overall), s_suffix).alias("suffix_mean"))
    domain_mean = domains.join(suffix_mean, "suffix").select("domain", "suffix", mean(F.col("suffix_mean"), s_domain).alias("domain_mean"))
    posterior = mean(F.col("domain_mean"), s_host)
    spread = F.sqrt(posterior * (1 - posterior) / (F.col("n") + s_host + 1))
    return hosts.join(domain_mean, ["domain", "suffix"]).select("host", "n", "bad", posterior.alias("bad_rate"), F.greatest(posterior - policy.z * spread, F.lit(0.0)).alias("bad_rate_low"), F.lit(min(policy.block_above, policy.lift * overall)).alias("limit"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, policy: ReputationPolicy | None = None) -> DataFrame:
    """pages: page_id, url. outcomes: page_id, bad boolean. Returns page_id, host, path, rule, verdict and the host's
    posterior."""
    policy = policy or ReputationPolicy()
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    once = outcomes.where("page_id IS NOT NULL").groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    labelled = parts.select("page_id", "host").join(once, "page_id", "left").select("host", "bad")
    reputation = settle(host_reputation(labelled, policy), "reputation")
    judged = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).join(reputation, "host", "left")
    learned = F.when(F.col("bad_rate_low") > F.col("limit"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.text").alias("rule"), F.coalesce("fit.verdict", learned).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_rate_low", 6).alias("bad_rate_low"))


def op5_url_filters(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The supplied labels carry one integer id; a page's outcome is the label of its own id, bad where the quality is
    0 or the toxic mark is set."""
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(pages, outcomes)
