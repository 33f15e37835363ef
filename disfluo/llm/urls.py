"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host. Each level of the name shrinks its own rate towards its parent's through a
beta-binomial prior: host to registered domain, domain to suffix, suffix to the whole. A level's prior strength comes
from the spread of its members' rates around their parents' (method of moments). A host is allowed if the lower bound
of its posterior good rate reaches a floor.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the overall rate; a host
of one label is its own suffix and domain; hosts without labelled pages take their domain's mean, with the wider bound
that goes with it; without any label the prior mean is one half; repeated rows count and are judged as often as they
stand; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import read, stable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Suffixes of two labels that this filter knows; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")

#: (host, path, verdict); a rule holds for its host and the host's subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Reputation:
    """z: how many posterior standard deviations below the mean the bound lies; floor: least bound of the good rate;
    weakest, strongest: limits of a prior's strength, in pages."""

    z: float = 1.645
    floor: float = 0.5
    weakest: float = 2.0
    strongest: float = 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the longest wraps the others
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _strength(counts: DataFrame, cfg: Reputation) -> float:
    """Prior strength from rows (n, good, parent mean): the intra-class correlation around the parents' means."""
    v = F.col("mean") * (1 - F.col("mean"))
    r = counts.agg(F.sum(F.pow(F.col("good") - F.col("n") * F.col("mean"), 2) / F.col("n") - v).alias("over"), F.sum(v * (F.col("n") - 1)).alias("under")).first()
    rho = (r["over"] or 0.0) / r["under"] if r["under"] else 0.0
    return cfg.strongest if rho <= 0 else min(cfg.strongest, max(cfg.weakest, 1 / rho - 1))


def reputations(outcomes: DataFrame, cfg: Reputation = Reputation()) -> tuple[dict[str, DataFrame], float, dict[str, float]]:
    """Posterior means of suffixes, domains and hosts from rows (host, good: 0 or 1).

    Returns a table for each level with columns (name, a, b: the posterior's parameters), the overall mean, and the prior
    strengths. Counts by host come from one aggregation with partial sums, so a host that holds most pages is no hot spot.
    """
    hosts = stable(outcomes.filter(F.col("good").isin(0, 1)).groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good")))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (1 + (total["good"] or 0)) / (2 + (total["n"] or 0))
    levels, strengths, parents = {}, {}, None
    for level, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keep = [parent] if parent else []
        own = hosts.groupBy(level, *keep).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        own = own.withColumn("mean", F.lit(overall)) if parent is None else own.join(parents, parent)
        k = strengths[level] = _strength(own, cfg)
        a, b = F.col("mean") * k + F.col("good"), (1 - F.col("mean")) * k + F.col("n") - F.col("good")
        levels[level] = stable(own.select(F.col(level).alias("name"), a.alias("a"), b.alias("b")))
        parents = levels[level].select(F.col("name").alias(level), (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
    return levels, overall, strengths


def judge(pages: DataFrame, outcomes: DataFrame, cfg: Reputation = Reputation(), rules=RULES) -> DataFrame:
    """Host, path, rule and verdict of each page, with the posterior mean and bound of its host.

    Only (page_id, host, path) is shuffled to meet the reputations; the join on host is a plain sort-merge join, whose hot
    keys adaptive execution splits.
    """
    levels, overall, strengths = reputations(outcomes, cfg)
    url = F.col("url").cast("string")
    out = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    names = stable(out.select("host").distinct())
    names = names.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    for level in ("suffix", "domain", "host"):
        names = names.join(levels[level].select(F.col("name").alias(level), F.col("a").alias(f"a_{level}"), F.col("b").alias(f"b_{level}")), level, "left")
    mean = lambda level: F.col(f"a_{level}") / (F.col(f"a_{level}") + F.col(f"b_{level}"))
    at_domain = F.coalesce(mean("domain"), mean("suffix"), F.lit(overall))
    a = F.coalesce("a_host", at_domain * strengths["host"])
    b = F.coalesce("b_host", (1 - at_domain) * strengths["host"])
    names = names.select("host", a.alias("a"), b.alias("b"))
    bound = F.col("mean") - cfg.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    names = names.withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).withColumn("bound", bound).select("host", "mean", "bound")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") >= cfg.floor, "allow").otherwise("block")
    return out.join(names, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("mean").alias("good_rate"), F.col("bound").alias("good_bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of the pages whose document has a quality label; the last number in a page's path is the document it shows."""
    path = path_of(F.col("url").cast("string"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})[^/0-9]*/?$", 1)
    shown = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id"))
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    return shown.join(good, "doc_id").select("host", "good")


def op1_url_reputation(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, page_outcomes(pages, read(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(level: str, parent: str | None, cfg: Reputation) -> str:
    """Common table expressions of one level: counts with the parent's mean (c_), prior strength (k_) and posterior (l_)."""
    keep = f", c.{parent}" if parent else ""
    source = "h c, t" if parent is None else f"h c JOIN l_{parent} USING ({parent})"
    mean = "t.overall" if parent is None else f"l_{parent}.mean"
    return f"""c_{level} AS (SELECT {level}{keep.replace('c.', '')}, CAST(sum(c.n) AS DOUBLE) AS n, CAST(sum(c.good) AS DOUBLE) AS good, any_value({mean}) AS m FROM {source} GROUP BY {level}{keep.replace('c.', '')}),
r_{level} AS (SELECT sum((good - n * m) * (good - n * m) / n - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS rho FROM c_{level}),
k_{level} AS (SELECT CASE WHEN coalesce(rho, 0) <= 0 THEN {cfg.strongest} ELSE least({cfg.strongest}, greatest({cfg.weakest}, 1 / rho - 1)) END AS k FROM r_{level}),
l_{level} AS (SELECT {level}, m * k + good AS a, (1 - m) * k + n - good AS b, (m * k + good) / (k + n) AS mean FROM c_{level}, k_{level})"""


def _rules_sql() -> tuple[str, str]:
    name, verdict = "NULL", "NULL"
    for h, p, what in sorted(RULES, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        name, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {name} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    return name, verdict


def _names_sql(columns: str, source: str) -> str:
    two = "array_to_string(parts[-2:], '.')"
    known = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    return f"SELECT {columns}, CASE WHEN {two} IN ({known}) THEN array_to_string(parts[-3:], '.') ELSE {two} END AS domain, CASE WHEN {two} IN ({known}) THEN {two} ELSE parts[-1] END AS suffix FROM (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts FROM {source})"


_CFG = Reputation()
ORACLE_OP1 = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT host, quality FROM (SELECT host, CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/0-9]*/?$', 1), '') AS BIGINT) AS doc_id FROM p) JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
g AS (SELECT host, count(*) AS n, sum(quality) AS good FROM o GROUP BY host), h AS ({_names_sql("host, n, good", "g")}),
t AS (SELECT (1 + coalesce(sum(good), 0)) / CAST(2 + coalesce(sum(n), 0) AS DOUBLE) AS overall FROM h),
{_level_sql("suffix", None, _CFG)}, {_level_sql("domain", "suffix", _CFG)}, {_level_sql("host", "domain", _CFG)},
e AS ({_names_sql("host", "(SELECT DISTINCT host FROM p)")}),
q AS (SELECT e.host, coalesce(x.a, coalesce(d.mean, s.mean, overall) * k) AS a, coalesce(x.b, (1 - coalesce(d.mean, s.mean, overall)) * k) AS b
  FROM e CROSS JOIN t CROSS JOIN k_host LEFT JOIN l_host x ON x.host = e.host LEFT JOIN l_domain d ON d.domain = e.domain LEFT JOIN l_suffix s ON s.suffix = e.suffix),
v AS (SELECT host, a / (a + b) - {_CFG.z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) >= {_CFG.floor} AS good FROM q)
SELECT page_id, host, path, {_rules_sql()[0]} AS rule, coalesce({_rules_sql()[1]}, CASE WHEN good THEN 'allow' ELSE 'block' END) AS verdict FROM p JOIN v USING (host)
"""
