"""URL filtering: explicit host and path rules, then empirical-Bayes host reputation.

Labelled outcomes of pages (bad or not) are counted per host. Each level is shrunk towards the one above it through a beta prior: suffixes towards
all pages, registered domains towards their suffix, hosts towards their domain. The priors' strengths come from the data by the
method of moments. A host is blocked when even the lower bound of its posterior bad rate is above ``max_bad``.

The suffix is the host's last label, or its last two where these are in a short table of suffixes of two labels; one label more makes the registered domain.
Ports don't count for reputation, and an address of numbers is a domain of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Production rules: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_BAD, Z, WEAKEST, STRONGEST = 0.3, 1.645, 2.0, 10_000.0
#: Common public suffixes of two labels; callers may give a longer list.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "org.nz", "ac.jp", "co.jp", "ne.jp", "or.jp", "co.kr", "com.cn", "com.tw", "com.hk", "com.sg", "co.in",
    "com.br", "com.ar", "com.mx", "com.tr", "co.za", "co.il", "com.ua", "com.pl",
)
ADDRESSES = "(address)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(verdict, rule), else null. Equal lengths: the longer host, then the smaller host.

    ``rules`` is a short list in the plan; it is no table that grows with the data.
    """
    found = None
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + prefix).alias("rule"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found


def bare_host(host: Column) -> Column:
    """Without a port; null is ''."""
    return F.regexp_replace(F.coalesce(host, F.lit("")), ":[0-9]*$", "")


def domain_parts(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a bare host."""
    two = F.substring_index(host, ".", -2)
    address, double = host.rlike(r"^[0-9]+([.][0-9]+){3}$|^\[.*\]$"), two.isin(*suffixes)
    domain = F.when(address, host).when(double, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, F.when(address, ADDRESSES).when(double, two).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame) -> float:
    """a + b of the beta prior that explains how the rates x / n of ``groups(n, x)`` scatter (method of moments): one number to the driver."""
    n, x = F.col("n").cast("double"), F.col("x").cast("double")
    s = groups.where("n > 0").agg(F.count("*").alias("k"), F.sum(n).alias("nn"), F.sum(x).alias("xx"), F.sum(n * n).alias("n2"), F.sum(x * x / n).alias("x2"))
    s = s.withColumn("p", F.expr("try_divide(xx, nn)")).withColumn("v", F.expr("p * (1 - p)"))
    s = s.withColumn("spread", F.expr("try_divide(x2 - nn * p * p, k - 1)")).withColumn("size", F.expr("try_divide(nn - try_divide(n2, nn), k - 1)"))
    s = s.withColumn("rho", F.expr("try_divide(spread - v, (size - 1) * v)"))
    return s.select(F.when(F.col("rho") > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / F.col("rho") - 1))).otherwise(STRONGEST)).first()[0]


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``outcomes(host string, bad int)`` -> host, n, x, bad_mean, bad_bound (lower posterior bound, 0 at least: normal approximation of the beta).

    Hosts are without ports in the result. Null ``bad`` is unlabelled: it counts for nothing, yet its host gets its prior. A null host counts as ''. No rows: no rows.
    Sums are combined before each shuffle, so one host with most rows is no hot spot. Counts of hosts and domains are written once; what reaches the driver is the mean
    of all and three strengths.
    """
    hosts = outcomes.groupBy(bare_host(F.col("host")).alias("host")).agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("x"))
    domain, suffix = domain_parts(F.col("host"), suffixes)
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = domains.agg(F.expr("coalesce(try_divide(cast(sum(x) as double), sum(n)), 0)")).first()[0]
    by_suffix, by_domain, by_host = (_strength(g) for g in (tops, domains, hosts))

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("x") + strength * prior) / (F.col("n") + strength)

    m1 = tops.select("suffix", shrunk(F.lit(mean), by_suffix).alias("m1"))
    m2 = domains.join(m1, "suffix").select("domain", shrunk(F.col("m1"), by_domain).alias("m2"))
    scored = hosts.join(m2, "domain").withColumn("bad_mean", shrunk(F.col("m2"), by_host))
    deviation = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("n") + by_host + 1))
    return scored.select("host", "n", "x", "bad_mean", F.greatest(F.lit(0.0), F.col("bad_mean") - z * deviation).alias("bad_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``pages(page_id, url)`` and ``outcomes(page_id, bad int)`` -> page_id, host, path, rule, verdict, bad_mean, bad_bound.

    Null urls and urls without ``://`` have an empty host, which has a reputation like any other. Repeated pages stay repeated; several outcomes of
    one page count as one (the worst). Outcomes of unknown pages and of a null page_id are ignored. Without any outcome every rate is 0
    and nothing is blocked but by rules. Other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    worst = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    reputation = host_reputation(urls.join(worst, "page_id", "left").select("host", "bad"), z, suffixes)
    judged = urls.withColumn("bare", bare_host(F.col("host"))).join(reputation.withColumnRenamed("host", "bare"), "bare", "left").withColumn("hit", match_rules(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("hit")["rule"].alias("rule"), F.coalesce(F.col("hit")["verdict"], own).alias("verdict"),
        F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_bound", 6).alias("bad_bound"),
    )


def page_outcomes(spark, sf_dir) -> DataFrame:
    """A page's outcome: bad if the labels row with its number says low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
