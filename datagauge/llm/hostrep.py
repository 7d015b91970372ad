"""URL filters: rules on host and path, and where none fits an empirical-Bayes reputation of the host.

A page's labelled outcome is good or bad. Bad rates are shrunk level by level: a suffix's towards the rate of all outcomes, a registered domain's
towards its suffix's, a host's towards its domain's. The rate of a node with k bad among n outcomes below a parent of rate p has the beta-binomial
posterior Beta(m p + k, m (1 - p) + n - k). The strength m of a level is fitted by moments over all its nodes: with r = 1 / (m + 1),
the expected squared deviation of k from n p is n p (1 - p) (1 + (n - 1) r). A host is blocked if its posterior's lower bound, mean less ``SIGMAS``
deviations, is above ``LIMIT``; a host without outcomes has its domain's rate.

A url without ``://``, or null, has an empty host and path, which no rule fits. A port belongs to the host for rules, not for reputation. The suffix is the last label, or two where
``SUFFIXES`` has them; the registered domain is one label more; a host of one label, and an address of digits, is its own domain under its own suffix. Null ids are kept;
repeated rows each get their row and each count; an empty table gives no rows; without outcomes every rate is a half and its bound below ``LIMIT``. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Rules of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Suffixes of two labels under which names are registered. Fixed values; give a longer list as a parameter.
SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.tr", "gov.uk", "org.uk"]
SIGMAS = 1.645
LIMIT = 0.5
#: Least and greatest correlation of outcomes under one node: strengths from 1 to 999.
LEAST, GREATEST = 0.001, 0.5
LEVELS = ["suffix", "domain", "host"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule, as struct (verdict, rule), else null; of equal ones that of the longer host, then ``block``."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def registered(host: Column, suffixes: list[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    whole = name.rlike(r"^[0-9.]*$") | ~name.contains(".")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    longer = two.isin(suffixes)
    return F.when(whole, name).when(longer, three).otherwise(two), F.when(whole, name).when(longer, two).otherwise(F.substring_index(name, ".", -1))


def _strength(nodes: DataFrame) -> float:
    """The prior's strength that the deviations of ``nodes`` (n, k, p: the parent's rate) are due to."""
    v = F.col("n") * F.col("p") * (1 - F.col("p"))
    r = nodes.where("n > 0").agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("p"), 2) - v).alias("over"), F.sum(v * (F.col("n") - 1)).alias("pairs")).first()
    rho = r["over"] / r["pairs"] if r["pairs"] else LEAST
    return 1 / min(max(rho, LEAST), GREATEST) - 1


def _posterior(m: float) -> tuple[Column, Column]:
    """Mean and standard deviation of the posterior of (n, k, p)."""
    mean = (F.col("k") + m * F.col("p")) / (F.col("n") + m)
    return mean, F.sqrt(mean * (1 - mean) / (F.col("n") + m + 1))


def reputations(outcomes: DataFrame, suffixes: list[str] = SUFFIXES, sigmas: float = SIGMAS) -> DataFrame:
    """Every host of ``outcomes`` (host, bad: 1, 0, or null where nothing is known): host, outcomes, bad_rate, bad_bound (lower).

    Outcomes are summed by host before they are shuffled by it, hosts by domain, domains by suffix. The host table is written once; three
    figures, a strength each, come to the driver.
    """
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    with store.scope() as keep:
        hosts = store.materialize(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "op13-hosts")
        total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
        sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
        domains = hosts.groupBy("domain", "suffix").agg(*sums)
        rates = domains.groupBy("suffix").agg(*sums).withColumn("p", F.lit((total["k"] + 0.5) / (total["n"] + 1)))
        for level, below in (("suffix", domains), ("domain", hosts)):
            mean, _ = _posterior(_strength(rates))
            rates = below.join(rates.select(level, mean.alias("p")), level)
        mean, deviation = _posterior(_strength(rates))
        return keep(store.materialize(rates.select("host", F.col("n").alias("outcomes"), F.round(mean, 6).alias("bad_rate"), F.round(mean - sigmas * deviation, 6).alias("bad_bound")), "op13-reputations"))


def judge(pages: DataFrame, outcomes: DataFrame, key: Column, rules: list[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """Every page (page_id, url) with host, path, rule, verdict and its host's reputation.

    ``outcomes`` (key, bad) has one row a key; ``key`` finds it from the page's host and path. Pages meet their outcomes, and their host's reputation,
    in joins whose other side has one row a key: where many pages share one, only the pages' side is large, which is split at run time.
    """
    host, path = host_and_path(F.col("url"))
    with store.scope() as keep:
        # A page without a key finds nothing; its id keeps such pages from meeting in one task.
        rows = pages.select("page_id", host.alias("host"), path.alias("path"))
        rows = rows.withColumn("key", F.coalesce(key.cast("string"), F.concat(F.lit("-"), F.xxhash64("page_id", "host", "path").cast("string"), F.lit("-"))))
        rows = rows.join(outcomes.select(F.col("key").cast("string").alias("key"), "bad"), "key", "left")
        rows = keep(store.materialize(rows.select("page_id", "host", "path", "bad"), "op13-pages"))
        known = keep(reputations(rows))
    fit = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce("fit.verdict", F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return rows.join(known, "host").withColumn("fit", fit).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "outcomes", "bad_rate", "bad_bound")


def labelled(labels: DataFrame) -> DataFrame:
    """Outcome by doc_id: bad where a label says toxic or of no quality, good where the labels say something else."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max(bad).alias("bad"))


def op13_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document of the first number in its path; the document's labels are the page's outcome."""
    number = F.regexp_extract("path", "/([0-9]+)", 1).try_cast("bigint")
    return judge(store.table(spark, sf_dir, "pages"), labelled(store.table(spark, sf_dir, "labels")), number)


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path FROM h),
o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) bad FROM labels GROUP BY 1),
j AS (SELECT p.*, bad, regexp_replace(host, ':[0-9]*$', '') name FROM p LEFT JOIN o ON o.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]+)', 1) AS bigint)),
l AS (SELECT *, string_split(name, '.') part, regexp_matches(name, '^[0-9.]*$') OR strpos(name, '.') = 0 whole FROM j),
d AS (SELECT *, array_to_string(part[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.tr', 'gov.uk', 'org.uk') longer FROM l),
e AS (SELECT page_id, host, path, bad, CASE WHEN whole THEN name WHEN longer THEN array_to_string(part[-3:], '.') ELSE array_to_string(part[-2:], '.') END "domain",
  CASE WHEN whole THEN name WHEN longer THEN array_to_string(part[-2:], '.') ELSE part[-1] END suffix FROM d),
n3 AS (SELECT host, "domain", suffix, count(bad) n, coalesce(sum(bad), 0) k FROM e GROUP BY ALL),
n2 AS (SELECT "domain", suffix, sum(n) n, sum(k) k FROM n3 GROUP BY ALL),
p1 AS (SELECT suffix, sum(n) n, sum(k) k, ((SELECT sum(k) FROM n3) + 0.5::double) / ((SELECT sum(n) FROM n3) + 1) p FROM n2 GROUP BY 1),
m1 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / nullif(sum(n * p * (1 - p) * (n - 1)), 0), 0.001::double), 0.001::double), 0.5::double) - 1 m FROM p1 WHERE n > 0),
p2 AS (SELECT n2.*, (p1.k + m * p) / (p1.n + m) p FROM n2 JOIN p1 USING (suffix), m1),
m2 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / nullif(sum(n * p * (1 - p) * (n - 1)), 0), 0.001::double), 0.001::double), 0.5::double) - 1 m FROM p2 WHERE n > 0),
p3 AS (SELECT n3.*, (p2.k + m * p) / (p2.n + m) p FROM n3 JOIN p2 USING ("domain"), m2),
m3 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / nullif(sum(n * p * (1 - p) * (n - 1)), 0), 0.001::double), 0.001::double), 0.5::double) - 1 m FROM p3 WHERE n > 0),
r AS (SELECT host, n outcomes, (k + m * p) / (n + m) mean, n + m + 1 total FROM p3, m3),
b AS (SELECT host, outcomes, round(mean, 6) bad_rate, round(mean - 1.645::double * sqrt(mean * (1 - mean) / total), 6) bad_bound FROM r),
f AS (SELECT page_id, host, path, outcomes::bigint outcomes, bad_rate, bad_bound,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END "rule"
  FROM e JOIN b USING (host))
SELECT page_id, host, path, "rule", CASE WHEN "rule" IN ('net/', 'example.com/de/') THEN 'block' WHEN "rule" IS NOT NULL THEN 'allow' WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END verdict, outcomes, bad_rate, bad_bound FROM f
"""
