"""URL filters: rules by host and path, then the reputation of the host.

The method is an empirical-Bayes estimate of how often a host's pages are good. Labelled page
outcomes are counted by host; each level's beta-binomial prior comes from the level above it
(host, registered domain, suffix, all), with a strength fitted to that level's spread by the
method of moments. A host is blocked if even the upper bound of its posterior lies below
`least_good`.

A host's reputation is its name's: without user, port and final dots. All of it is DataFrame
operations. Counts are grouped before they are joined; the names join the pages by a join that
deals hot names to many tasks; the counts of all pages reach the driver only as one row of sums a
level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import ascii_lower, join_spread, written

#: Endings of two labels under which names are registered, where no table of suffixes is given.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.cn", "co.in", "co.za", "com.mx")


@dataclass(frozen=True)
class Rule:
    """allow or block hosts at or below `host` whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, text: str) -> Rule:
        """'block example.org/es/' and the like."""
        verdict, _, place = text.partition(" ")
        host, slash, path = place.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {text!r}")
        return cls(verdict, host, slash + path)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and final dots."""
    return F.rtrim(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), F.lit("."))


def _address(host: Column) -> Column:
    return host.rlike(r"^[0-9.]*$") | host.startswith("[")


def suffix_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The host's last label, or last two if these are a known ending; empty for an address of digits and dots."""
    two = F.substring_index(host, ".", -2)
    return F.when(_address(host), F.lit("")).when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The host's suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(_address(host), host).when(two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(two)


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (host, which is no other row's) with domain and suffix.

    suffixes (suffix string, of any number of labels) are the endings under which names are
    registered, the longest that fits counts; without them the last label, or TWO_LABEL_SUFFIXES.
    """
    host = F.col("host")
    if suffixes is None:
        return hosts.withColumns({"domain": domain_of(host), "suffix": suffix_of(host)})
    labels = F.size(F.split(host, r"\."))
    ends = hosts.where(~_address(host)).select("host", F.explode(F.sequence(F.lit(1), labels)).alias("__n"))
    ends = ends.withColumn("__end", F.expr("substring_index(host, '.', -__n)"))
    fits = ends.join(suffixes.select(F.col("suffix").alias("__end")).distinct(), "__end").groupBy("host").agg(F.max("__n").alias("__n"))
    told = hosts.join(fits, "host", "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    told = told.withColumns({"domain": F.when(_address(host), host).otherwise(F.expr("substring_index(host, '.', -(__n + 1))")), "suffix": F.when(_address(host), "").otherwise(F.expr("substring_index(host, '.', -__n)"))})
    return told.drop("__n")


def strength(groups: DataFrame, default: float = 10.0, least: float = 1.0, most: float = 1000.0) -> tuple[float, float]:
    """The share of good outcomes in all groups (n, good), and how many outcomes their prior is worth.

    From sums over the groups: the spread between them beyond a binomial's gives the
    beta-binomial's correlation rho; the strength is 1 / rho - 1, kept within bounds. Without
    outcomes the share is 1/2; where nothing tells the spread, the strength is the default.
    """
    sums = groups.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("s")).first()
    n = float(sums.n or 0)
    if not n:
        return 0.5, default
    p = float(sums.good) / n
    within, between = sums.groups - 1.0, n - sums.n2 / n - (sums.groups - 1.0)
    if p in (0.0, 1.0) or between <= 0:
        return p, default
    spread = (sums.s - n * p * p) / (p * (1 - p))
    rho = min(1 / (1 + least), max(1 / (1 + most), (spread - within) / between))
    return p, 1 / rho - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645, others: DataFrame | None = None, endings: DataFrame | None = None) -> DataFrame:
    """Posterior of each host in `outcomes` (host string, good 0 or 1; other rows are left out).

    Returns host, outcomes, good, posterior mean, lower and upper bound. The bounds lie z
    standard deviations of the beta posterior from its mean. A host of `others` (host string)
    that has no outcomes has its prior: the mean of its domain, else of its suffix, else of all.
    endings: a table of suffixes, as of with_domains.
    """
    hosts = outcomes.where(F.col("host").isNotNull() & F.col("good").isin(0, 1)).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    hosts = written(with_domains(hosts, endings).select("host", "domain", "suffix", "n", "good"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    (p, k_suffix), (_, k_domain), (_, k_host) = strength(suffixes), strength(domains), strength(hosts)

    def shrunk(prior: Column, k: float) -> Column:
        return (F.col("good") + prior * F.lit(k)) / (F.col("n") + F.lit(k))

    suffixes = suffixes.select("suffix", shrunk(F.lit(p), k_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), k_domain).alias("domain_mean"))
    mean, size = F.col("mean"), F.col("n") + F.lit(k_host)
    deviation = F.sqrt(mean * (1 - mean) / (size + 1))
    if others is not None:
        new = others.select("host").distinct().join(hosts, "host", "left_anti")
        hosts = hosts.unionByName(with_domains(new, endings).withColumns({"n": F.lit(0).cast("long"), "good": F.lit(0).cast("long")}))
    hosts = hosts.join(domains, "domain", "left").join(suffixes, "suffix", "left").withColumn("mean", shrunk(F.coalesce("domain_mean", "suffix_mean", F.lit(p)), k_host))
    return hosts.select("host", F.col("n").alias("outcomes"), "good", "mean", F.greatest(F.lit(0.0), mean - F.lit(z) * deviation).alias("lower"), F.least(F.lit(1.0), mean + F.lit(z) * deviation).alias("upper"))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null. The rules are parameters, tried longest first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], url: str = "url", least_good: float = 0.5, z: float = 1.645, endings: DataFrame | None = None) -> DataFrame:
    """`pages` with host, path, rule, verdict and the host's reputation.

    outcomes: url and good (0 or 1), one row for each labelled page. A row stands for itself:
    repeated pages are all judged, repeated outcomes all count. A null url, or one without ://,
    has an empty host and path; the empty host has a reputation like any other. Hosts that differ
    in user, port or final dots share one. A host without outcomes is judged by its domain's or
    suffix's; `endings` is a table of suffixes, as of with_domains. Columns of `pages` that have
    the names of new columns are replaced.
    """
    mine = ("host", "path", "rule", "verdict", "outcomes", "good", "mean", "lower", "upper")
    pages = pages.select(*(c for c in pages.columns if c not in mine or c == url), host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    pages = pages.withColumn("__of", name_of(F.col("__host")))
    met = written(pages.groupBy("__of").agg(F.count(F.lit(1)).alias("__pages")))
    reputation = host_reputation(outcomes.select(name_of(host_of(F.col("url"))).alias("host"), "good"), z, met.select(F.col("__of").alias("host")), endings)
    reputation = reputation.select(*(F.col(c).alias(f"__{c}") for c in reputation.columns if c != "host"), F.col("host").alias("__of"))
    judged = join_spread(pages, written(reputation.join(met, "__of")), "__of", n="__pages")
    rule, ruled = fitting_rule(F.col("__host"), F.col("__path"), rules)
    by_method = F.when(F.col("__upper") < F.lit(least_good), "block").otherwise("allow")
    kept = [c for c in pages.columns if not c.startswith("__")]
    return judged.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(ruled, by_method).alias("verdict"), *(F.col(f"__{c}").alias(c) for c in ("outcomes", "good", "mean", "lower", "upper")))
