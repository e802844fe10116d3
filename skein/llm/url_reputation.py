"""URL filter: empirical-Bayes host reputation with hand-written rules on top.

Labelled page outcomes are shrunk through beta-binomial priors from host to registered domain to suffix to the whole
table; a host is blocked when a lower bound of its posterior bad rate exceeds a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common public suffixes of two labels.
SUFFIXES = tuple("ac.jp ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.sg com.tr com.tw edu.au gov.au gov.uk ne.jp net.au or.jp org.au org.nz org.uk blogspot.com github.io".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or for null."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def site_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port: the suffix is the longest fitting one of the list, else
    the last label, and the domain has one label more, if there is one."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    domain, suffix = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    for s in sorted(suffixes, key=lambda s: (s.count("."), s)):
        fits = (name == s) | name.endswith("." + s)
        domain, suffix = F.when(fits, F.substring_index(name, ".", -2 - s.count("."))).otherwise(domain), F.when(fits, F.lit(s)).otherwise(suffix)
    return domain, suffix


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule. rules: (allow or block, 'host/path'); a rule fits its host and its
    subdomains when the path starts with the rule's. The list comes from a person, so it is small."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the beta-binomial strength, by moments, of the groups' rates around the mean rate; 1 to 1000."""
    sums = groups.agg(F.sum("bad").alias("x"), F.sum("n").alias("m"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.when(F.col("n") > 0, F.col("bad").cast("double") * F.col("bad") / F.col("n")).otherwise(0.0)).alias("r2"))
    mean = F.col("x").cast("double") / F.col("m")
    spread = (F.col("r2") - F.col("x") * mean) / (mean * (1 - mean))
    rho = (spread - (F.col("k") - 1)) / (F.col("m") - F.col("n2").cast("double") / F.col("m") - (F.col("k") - 1))
    usable = (F.col("x") > 0) & (F.col("x") < F.col("m")) & (F.col("m") - F.col("n2").cast("double") / F.col("m") - (F.col("k") - 1) > 0)
    return sums.select(F.coalesce(F.when(usable & (rho > 0.000999), F.least(F.greatest((1 - rho) / rho, F.lit(1.0)), F.lit(1000.0))), F.lit(1000.0)).alias(name), ((F.coalesce("x", F.lit(0)) + 1.0) / (F.coalesce("m", F.lit(0)) + 2.0)).alias("mean_" + name))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A row (host, n, bad, posterior, lower) for each host of pages (page_id, url).

    outcomes (page_id, bad 0/1): repeated page_ids count once, at their largest bad; nulls don't count. Hosts without
    outcomes get their domain's posterior. Only aggregates by host, domain and suffix are shuffled, after partial sums."""
    marks = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(marks, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = site_of(F.col("host"), suffixes)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    level = lambda key: hosts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = level("suffix")
    k = _strength(suffixes.where("n > 0"), "k1").crossJoin(_strength(domains.where("n > 0"), "k2").select("k2")).crossJoin(_strength(hosts.where("n > 0"), "k3").select("k3"))  # one row each
    suffixes = suffixes.crossJoin(F.broadcast(k)).select("suffix", "k2", "k3", ((F.col("bad") + F.col("k1") * F.col("mean_k1")) / (F.col("n") + F.col("k1"))).alias("ms"))
    domains = domains.join(suffixes, "suffix").select("domain", "k3", ((F.col("bad") + F.col("k2") * F.col("ms")) / (F.col("n") + F.col("k2"))).alias("md"))
    total = F.col("n") + F.col("k3")
    mean = (F.col("bad") + F.col("k3") * F.col("md")) / total
    return hosts.join(domains, "domain").select("host", "n", "bad", mean.alias("posterior"), (mean - z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.3, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labelled, host_bad for each row of pages (page_id, url).

    The verdict is the longest fitting rule's, else block where the host's posterior lower bound exceeds threshold,
    else allow. Null or odd urls have an empty host and path and are judged as one host; long urls are read whole; of rules
    of one length that fit, the last by code point wins; repeated rows give repeated rows; an empty table on either side is
    no outcome or an empty result; other columns are ignored. The host table joins by a shuffle unless Spark sees that it is small; a hot host
    is split by the adaptive skew join."""
    own = pages.select("page_id", "url")
    known = host_reputation(own, outcomes, z)
    rated = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).join(known, "host")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return rated.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("n").alias("host_labelled"), F.col("bad").cast("long").alias("host_bad"))
