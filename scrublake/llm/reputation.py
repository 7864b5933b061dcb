"""URL filters: rules first, then empirical-Bayes host reputation. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, load, materialize

#: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A host is blocked if its share of bad pages exceeds MAX_BAD with a posterior probability above CONFIDENCE.
MAX_BAD, CONFIDENCE = 0.3, 0.95
#: Public suffixes of two labels below which sites register; all others are taken as one label.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "appspot.com", "blogspot.com", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa",
    "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.tw", "github.io", "gitlab.io", "go.jp", "go.kr", "gov.au", "gov.br", "gov.cn", "gov.in",
    "gov.uk", "herokuapp.com", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "netlify.app", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.tw",
    "org.uk", "org.za", "pages.dev", "sch.uk", "vercel.app", "web.app", "workers.dev",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


#: What isn't part of a host's name (user, port, closing dots), and names that are addresses.
_AROUND, _ADDRESS = r"(?s)^.*@|\.*(:[0-9]*)?\z", r"^\[|^[0-9]+(\.[0-9]+){3}\z"


def name_of(host: Column) -> Column:
    """The host without user, port and closing dots."""
    return F.regexp_replace(host, _AROUND, "")


def suffix_of(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last two labels if they are one of ``suffixes``, else the last one; of IP addresses ``ip``."""
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), "ip").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def registered_domain(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """One label more than the suffix, or the name itself if it has no more; an IP address stands for itself."""
    longer = F.substring_index(name, ".", -2).isin(*suffixes)
    return F.when(name.rlike(_ADDRESS), name).when(longer, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def _log_gamma(z: Column) -> Column:
    """Stirling's series at z + 8, taken back by the recurrence."""
    w = z + 8
    steps = z
    for i in range(1, 8):
        steps = steps * (z + i)
    series = 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w) - 1 / (1680 * w * w * w * w * w * w * w)
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def _least_terms(x: float) -> int:
    """Terms after which a falling series of powers of x or 1 - x is below the last digit."""
    return math.ceil(-40 / math.log(max(x, 1 - x)))


def beta_cdf(x: float, a: str, b: str) -> Column:
    """P(share <= x) for a share that is Beta(a, b), of the columns ``a`` and ``b``, by the power series of the incomplete beta function,
    from the side of the mean where its terms fall; their number grows with the root of a + b. A zero parameter is a share that is
    certain.
    """
    a, b = F.col(a), F.col(b)
    left = a > x * (a + b)
    p, q, y = F.when(left, a).otherwise(b), F.when(left, b).otherwise(a), F.when(left, x).otherwise(1 - x)
    front = F.exp(p * F.log(y) + q * F.log(1 - y) + _log_gamma(p + q) - _log_gamma(p + 1) - _log_gamma(q))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"), p.alias("p"), (p + q).alias("pq"), y.alias("y"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (acc["pq"] + j) / (acc["p"] + 1 + j) * acc["y"]
        return F.struct(term.alias("term"), (acc["sum"] + acc["term"]).alias("sum"), acc["p"].alias("p"), acc["pq"].alias("pq"), acc["y"].alias("y"))

    terms = F.sequence(F.lit(0), (_least_terms(x) + 10 * F.sqrt(a + b)).cast("int"))
    tail = F.least(F.lit(1.0), front * F.aggregate(terms, start, step, lambda acc: acc["sum"]))
    return F.when(a <= 0, 1.0).when(b <= 0, 0.0).when(left, tail).otherwise(1 - tail)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _level(hosts: DataFrame, key: str, parent: DataFrame | None, parent_key: str | None) -> DataFrame:
    """Counts of a level, with its posterior mean under a prior around the parent's mean (the overall share, above).

    The prior's weight kappa comes from the spread of the level's counts by the method of moments: sums of products of
    whole numbers, so that the order of addition doesn't matter.
    """
    d = lambda c: F.col(c).cast("decimal(38,0)")
    more = ["pages"] if key == "host" else []
    counts = hosts.groupBy(key, *([parent_key] if parent_key else [])).agg(*(F.sum(c).alias(c) for c in ("n", "k", *more)))
    kk, kn, nn, s, t = (F.col(x).cast("double") for x in ("_kk", "_kn", "_nn", "_s", "_t"))
    m = F.when(s > 0, t / s).otherwise(0.5)
    var = m * (1 - m)
    rho = F.when(var * (nn - s) > 0, (kk - 2 * m * kn + m * m * nn - s * var) / (var * (nn - s))).otherwise(0.5)
    prior = counts.agg(
        F.sum(d("k") * d("k")).alias("_kk"), F.sum(d("k") * d("n")).alias("_kn"), F.sum(d("n") * d("n")).alias("_nn"),
        F.sum(d("n")).alias("_s"), F.sum(d("k")).alias("_t"),
    ).select(m.alias("_m"), F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.999)).alias("_rho"))
    prior = prior.select(F.lit(1).alias("_one"), "_m", (1 / F.col("_rho") - 1).alias("_kappa"))
    out = counts.withColumn("_one", F.lit(1)).join(F.broadcast(prior), "_one")  # one row
    mean = F.col("_m")
    if parent is not None:
        out = out.join(parent.select(parent_key, F.col("mean").alias("_up")), parent_key)
        mean = F.col("_up")
    a = F.col("k") + F.col("_kappa") * mean
    total = F.col("n") + F.col("_kappa")
    keep = [key, *([parent_key] if parent_key else [])]
    return out.select(*keep, *more, "n", "k", (a / total).alias("mean"), total.alias("weight"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior of the share of bad pages for each host: host, pages, n, k, mean, doubt.

    ``pages`` has page_id and host; ``outcomes`` has page_id and bad (boolean, null: unknown). Several outcomes of a
    page count as bad if one of them is. Hosts without labelled pages get their domain's mean, domains without any
    their suffix's. ``doubt`` is the posterior probability that the share is ``max_bad`` at most: it is below 0.05
    where the share's lower 95 % bound, a quantile of the beta posterior, is above ``max_bad``.
    """
    known = outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        pages.select("page_id", "host").join(known, "page_id", "left")
        .groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.count_if("bad").alias("k"))
        .withColumn("name", name_of(F.col("host")))
        .withColumns({"domain": registered_domain(F.col("name"), suffixes), "suffix": suffix_of(F.col("name"), suffixes)}).drop("name")
    )
    hosts = materialize(hosts, "hosts")  # pages are read and parsed once for all levels
    suffixes = _level(hosts, "suffix", None, None)
    domains = _level(hosts, "domain", suffixes, "suffix")
    scored = _level(hosts, "host", domains, "domain")
    scored = scored.withColumns({"a": F.col("mean") * F.col("weight"), "b": (1 - F.col("mean")) * F.col("weight")})
    return scored.select("host", "pages", "n", "k", "mean", beta_cdf(max_bad, "a", "b").alias("doubt"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """Judge each page: page_id, host, path, rule, verdict, bad_rate, doubt.

    A null url or one without ``://`` has an empty host and path; such pages share the reputation of the empty host.
    Repeated rows are judged alike. Columns of ``pages`` besides page_id and url are not looked at.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "_said": verdict})
    hosts = host_reputation(p, outcomes, max_bad)
    by_host = F.when(F.col("doubt") < 1 - CONFIDENCE, "block").otherwise("allow")
    judged = materialize(hosts.select("host", "pages", "mean", "doubt", by_host.alias("_by_host")), "judged")
    return join_skewed(p, judged, ["host"], "pages").select(
        "page_id", "host", "path", "rule", F.coalesce("_said", "_by_host").alias("verdict"), F.col("mean").alias("bad_rate"), "doubt"
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. A page's outcome is the label of its number: bad if toxic or of low quality."""
    labels = load(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return filter_urls(load(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def _sql_level(name: str, key: str, parent: str | None, parent_key: str | None) -> str:
    pk = f", {parent_key}" if parent_key else ""
    up = f"JOIN {parent} u USING ({parent_key})" if parent else ""
    mean = "u.mean" if parent else "p.m"
    return f"""
{name}_c AS (SELECT {key}{pk}, sum(n) n, sum(k) k FROM hosts GROUP BY ALL),
{name}_s AS (SELECT sum(k::HUGEINT*k)::DOUBLE kk, sum(k::HUGEINT*n)::DOUBLE kn, sum(n::HUGEINT*n)::DOUBLE nn, sum(n)::DOUBLE s, sum(k)::DOUBLE t FROM {name}_c),
{name}_m AS (SELECT *, CASE WHEN s > 0 THEN t / s ELSE 0.5::DOUBLE END m FROM {name}_s),
{name}_p AS (SELECT m, 1 / least(greatest(CASE WHEN m * (1 - m) * (nn - s) > 0
  THEN (kk - 2 * m * kn + m * m * nn - s * (m * (1 - m))) / (m * (1 - m) * (nn - s)) ELSE 0.5 END, 0.001::DOUBLE), 0.999::DOUBLE) - 1 kappa FROM {name}_m),
{name} AS (SELECT c.*, (c.k + p.kappa * {mean}) / (c.n + p.kappa) mean, c.n + p.kappa weight FROM {name}_c c CROSS JOIN {name}_p p {up})"""


_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}={w}'"
    for w, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
_SUFFIX_LIST = ", ".join(f"'{s}'" for s in SUFFIXES)
#: The incomplete beta function: terms of its series by logarithms of gamma functions.
_TAIL = f"""exp(p * ln(y) + q * ln(1 - y) - lgamma(q)) * list_sum(list_transform(range(0, ({_least_terms(MAX_BAD)} + 10 * sqrt(p + q))::INT),
  lambda j: exp(lgamma(p + q + j) - lgamma(p + 1 + j) + j * ln(y))))"""
OP2_SQL = f"""
WITH u AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') host,
  coalesce(regexp_extract(url, '{_URL}', 2), '') path FROM pages),
r AS (SELECT *, CASE {_CASES} END said FROM u),
o AS (SELECT doc_id page_id, max((toxic = 1 OR quality = 0)::INT) bad FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY 1),
named AS (SELECT host, string_split(regexp_replace(host, '{_AROUND}', '', 'g'), '.') l, count(bad) n, coalesce(sum(bad), 0)::BIGINT k FROM r LEFT JOIN o USING (page_id) GROUP BY host),
parts AS (SELECT *, array_to_string(l, '.') nm, array_to_string(l[-2:], '.') two, array_to_string(l[-2:], '.') IN ({_SUFFIX_LIST}) is_two FROM named),
hosts AS (SELECT host, n, k,
  CASE WHEN regexp_matches(nm, '{_ADDRESS}') THEN nm WHEN is_two THEN array_to_string(l[-3:], '.') ELSE two END "domain",
  CASE WHEN regexp_matches(nm, '{_ADDRESS}') THEN 'ip' WHEN is_two THEN two ELSE l[-1] END suffix FROM parts),
{_sql_level("sfx", "suffix", None, None)},
{_sql_level("dom", '"domain"', "sfx", "suffix")},
{_sql_level("hst", "host", "dom", '"domain"')},
ab AS (SELECT host, mean * weight a, (1 - mean) * weight b, mean * weight > {MAX_BAD} * weight lft FROM hst),
pq AS (SELECT *, CASE WHEN lft THEN a ELSE b END p, CASE WHEN lft THEN b ELSE a END q, CASE WHEN lft THEN {MAX_BAD}::DOUBLE ELSE 1 - {MAX_BAD}::DOUBLE END y FROM ab),
tails AS (SELECT host, a, b, lft, CASE WHEN a > 0 AND b > 0 THEN {_TAIL} END tail FROM pq),
doubts AS (SELECT host, CASE WHEN a <= 0 THEN 1 WHEN b <= 0 THEN 0 WHEN lft THEN tail ELSE 1 - tail END doubt FROM tails)
SELECT page_id, r.host, path, regexp_extract(said, '^(.*)=', 1) "rule",
  coalesce(regexp_extract(said, '=(.*)$', 1), CASE WHEN doubt < {1 - CONFIDENCE} THEN 'block' ELSE 'allow' END) verdict
FROM r JOIN doubts ON r.host = doubts.host
"""
