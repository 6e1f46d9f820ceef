"""URL filters by empirical-Bayes host reputation, in DataFrame expressions only.

Labelled page outcomes (bad or not) are counted by host.  Each host's rate is
shrunk towards that of its registered domain, the domain's towards its
suffix, and the suffix's towards the rate of all: at each level the prior is a beta
distribution around the level above, whose strength comes from the spread of the
rates on that level (method of moments, weighted by labels).  A host's posterior bound is its mean less ``Z``
standard deviations of its beta posterior; a page is blocked when that bound is
over ``MAX_BAD``.  Hosts without labels take the posterior of the closest level that has some.

Listed rules come first: of those that fit a page, the longest gives the verdict.

Counts are aggregated before they are shuffled, to one row a host, so a hot host costs one row a
task.  Pages meet their host's row in a join that Spark broadcasts by its measured size
only, or else splits where a host is hot.  Registered domain: the last two
labels of a host; suffix: the last one.

Null urls, and those without ``://``, have an empty host and path, no rule, and the
verdict of the prior of all.  Repeated rows stay, empty tables give no rows, urls may be of any length, and columns of other names are not read.  With no labels the rate of all is that of one good and one bad page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import checkpoint

#: (host, path) and verdict; fixed values.
RULES = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
MAX_BAD, Z = 0.5, 1.645
MAX_STRENGTH = 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _rule(value: str) -> str:
    """CASE over the rules, longest first; value: what a rule that fits gives."""
    cases = []
    for (host, path), verdict in sorted(RULES.items(), key=lambda x: -len("".join(x[0]))):
        then = {"rule": f"'{host}{path}'", "verdict": f"'{verdict}'"}[value]
        cases.append(f"WHEN (host = '{host}' OR right(host, {len(host) + 1}) = '.{host}') AND left(path, {len(path)}) = '{path}' THEN {then}")
    return f"CASE {' '.join(cases)} END"


def _level(name: str, key: str, above: str, above_key: str) -> str:
    """A level's counts, its prior's strength and its posterior mean."""
    return f"""
{name}_raw AS (SELECT l.{key}, l.n, l.bad, a.mean AS prior FROM (SELECT {key}, {above_key}, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY {key}, {above_key}) l
  JOIN {above} a ON l.{above_key} = a.{above_key}),
{name}_fit AS (SELECT CASE WHEN spread > 0 AND mu > 0 AND mu < 1 THEN least(greatest(mu * (1 - mu) / spread - 1, 1e0), {MAX_STRENGTH}e0) ELSE {MAX_STRENGTH}e0 END AS m FROM (
  SELECT mu, CASE WHEN n - n2 / n > 0 THEN (ss - (k - 1) * mu * (1 - mu)) / (n - n2 / n) ELSE 0e0 END AS spread FROM (
    SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * n) AS DOUBLE) AS n2, sum(n * prior) / sum(n) AS mu,
           sum(n * (CAST(bad AS DOUBLE) / n - prior) * (CAST(bad AS DOUBLE) / n - prior)) AS ss FROM {name}_raw) x) y),
{name} AS (SELECT {key}, (bad + (SELECT m FROM {name}_fit) * prior) / (n + (SELECT m FROM {name}_fit)) AS mean, n + (SELECT m FROM {name}_fit) AS weight
  FROM {name}_raw)"""


#: DuckDB's SQL; placeholders: pages (page_id, url) and outcomes (url, bad 0 or 1).
SQL = f"""
WITH p AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM {{pages}}),
q AS (SELECT page_id, host, path, {_rule("rule")} AS rule, {_rule("verdict")} AS listed FROM p),
h AS (SELECT {HOST} AS host, count(*) AS n, sum(bad) AS bad FROM {{outcomes}} WHERE bad IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, n, bad, CASE WHEN regexp_extract(host, '([^.]+[.][^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+[.][^.]+)$', 1) END AS domain,
          CASE WHEN regexp_extract(host, '([^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+)$', 1) END AS suffix, 0 AS top FROM h),
alls AS (SELECT 0 AS top, (coalesce(sum(bad), 0) + 1e0) / (coalesce(sum(n), 0) + 2e0) AS mean, coalesce(sum(n), 0) + 2e0 AS weight FROM hosts),
{_level("suffixes", "suffix", "alls", "top").lstrip()},
{_level("domains", "domain", "suffixes", "suffix").lstrip()},
{_level("by_host", "host", "domains", "domain").lstrip()},
u AS (SELECT q.*, CASE WHEN regexp_extract(host, '([^.]+[.][^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+[.][^.]+)$', 1) END AS domain,
      CASE WHEN regexp_extract(host, '([^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+)$', 1) END AS suffix, 0 AS top FROM q),
r AS (SELECT u.page_id, u.host, u.path, u.rule, u.listed, coalesce(b.mean, d.mean, s.mean, a.mean) AS mean, coalesce(b.weight, d.weight, s.weight, a.weight) AS weight
  FROM u LEFT JOIN by_host b ON u.host = b.host LEFT JOIN domains d ON u.domain = d.domain
  LEFT JOIN suffixes s ON u.suffix = s.suffix LEFT JOIN alls a ON u.top = a.top)
SELECT page_id, host, path, rule,
  coalesce(listed, CASE WHEN mean - {Z}e0 * sqrt(mean * (1 - mean) / (weight + 1)) > {MAX_BAD}e0 THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_rate
FROM r
"""

#: Labelled outcomes of pages: a page shows the document whose number ends its path.
NUMBER = f"try_cast(regexp_extract({PATH}, '^/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT)"
OUTCOMES_SQL = f"SELECT url, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM (SELECT url, {NUMBER} AS doc FROM pages) x JOIN labels ON doc = doc_id"


_DOMAIN, _SUFFIX = "([^.]+[.][^.]+)$", "([^.]+)$"


def _last(host: Column, pattern: str) -> Column:
    found = F.regexp_extract(host, pattern, 1)
    return F.when(found == "", host).otherwise(found)


def _fit(level: DataFrame) -> float:
    """Strength of a level's prior, by the method of moments: one row of sums reaches the driver."""
    n, bad, prior = F.col("n"), F.col("bad").cast("double"), F.col("prior")
    x = level.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * n).alias("n2"), F.sum(n * prior).alias("mu"), F.sum(n * (bad / n - prior) * (bad / n - prior)).alias("ss")).first()
    if not x["n"]:
        return MAX_STRENGTH
    total, mu = float(x["n"]), x["mu"] / x["n"]
    room = total - float(x["n2"]) / total
    spread = (x["ss"] - (x["k"] - 1) * mu * (1 - mu)) / room if room > 0 else 0.0
    return min(max(mu * (1 - mu) / spread - 1, 1.0), MAX_STRENGTH) if spread > 0 and 0 < mu < 1 else MAX_STRENGTH


def _posterior(level: DataFrame, key: str) -> DataFrame:
    m = F.lit(_fit(level))
    return level.select(key, ((F.col("bad") + m * F.col("prior")) / (F.col("n") + m)).alias(f"{key}_mean"), (F.col("n") + m).alias(f"{key}_weight"))


def reputation(outcomes: DataFrame) -> tuple[dict[str, DataFrame], float, float]:
    """Posterior mean and weight of each suffix, domain and host with labels, and those of all."""
    counts = outcomes.filter("bad IS NOT NULL").groupBy(F.expr(HOST).alias("host")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = checkpoint(counts.select("host", "n", "bad", _last(F.col("host"), _DOMAIN).alias("domain"), _last(F.col("host"), _SUFFIX).alias("suffix")))
    x = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    weight = x["n"] + 2.0
    mean = (x["bad"] + 1.0) / weight
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    out = {"suffix": checkpoint(_posterior(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(mean)), "suffix"))}
    above = out["suffix"].select("suffix", F.col("suffix_mean").alias("prior"))
    out["domain"] = checkpoint(_posterior(hosts.groupBy("domain", "suffix").agg(*sums).join(above, "suffix"), "domain"))
    above = out["domain"].select("domain", F.col("domain_mean").alias("prior"))
    out["host"] = _posterior(hosts.join(above, "domain"), "host")
    return out, mean, weight


def judge(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate`` for each row of ``pages``.

    ``outcomes``: ``url`` and ``bad`` (1: bad, 0: good, null: ignored).
    """
    levels, mean, weight = reputation(outcomes.select(F.col("url").cast("string"), F.col("bad").cast("long")))
    p = pages.select("page_id", F.col("url").cast("string")).select("page_id", F.expr(HOST).alias("host"), F.expr(PATH).alias("path"))
    p = p.withColumns({"domain": _last(F.col("host"), _DOMAIN), "suffix": _last(F.col("host"), _SUFFIX)})
    for key in ("host", "domain", "suffix"):
        p = p.join(levels[key], key, "left")
    names = ("host", "domain", "suffix")
    p = p.withColumns({"mean": F.coalesce(*[f"{k}_mean" for k in names], F.lit(mean)), "weight": F.coalesce(*[f"{k}_weight" for k in names], F.lit(weight))})
    bound = F.col("mean") - F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    own = F.when(bound > MAX_BAD, "block").otherwise("allow")
    return p.select("page_id", "host", "path", F.expr(_rule("rule")).alias("rule"), F.coalesce(F.expr(_rule("verdict")), own).alias("verdict"), F.round("mean", 6).alias("bad_rate"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    numbered = pages.select("url", F.expr(NUMBER).alias("doc"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")
    return numbered.join(labels.select(F.col("doc_id").alias("doc"), bad), "doc").select("url", "bad")
