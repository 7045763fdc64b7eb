"""URL filter by empirical-Bayes host reputation, under explicit rules.

Outcomes (good or bad pages) are counted per host and shrunk through three
beta-binomial levels: suffix towards the overall rate, registered domain
towards its suffix, host towards its domain. Each level's prior strength is
estimated from the spread of its units' rates (method of moments). A host is
blocked when the lower bound of its posterior bad rate exceeds ``limit``.

Rules come first: a rule ``host/path`` fits its host and all subdomains if the
url's path starts with the rule's path; the longest fitting rule decides.

Nulls and special cases: a null url, or one without ``://``, has empty host
and path, fits no rule and is allowed; hosts without outcomes are judged by
their domain's and suffix's posterior; with no outcomes at all the rate is
one half and nothing is blocked; repeated rows are judged each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.shared import written

#: suffixes of more than one label, below which domains are registered
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")
#: one-sided normal quantile of the bound, and the bad rate above which it blocks
Z, LIMIT = 1.645, 0.5
#: rows of a host are spread over so many keys for the lookup of its verdict
SPREAD = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    """The label before the suffix, and the suffix; a bare suffix is its own domain."""
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(
        F.substring_index(host, ".", -2)
    )


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _strength(units: DataFrame) -> float:
    """Prior strength 1 / rho - 1 of units (n, bad): rho is the moment
    estimate of how much of the variance lies between units."""
    s = units.agg(
        F.sum("n").alias("n"), F.sum("bad").alias("x"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("xx"),
    ).first()
    if not s.n or not 0 < s.x < s.n:
        return _capped(None)
    p = s.x / s.n
    spread = s.xx - s.x * p - p * (1 - p) * (s.k - 1)
    room = p * (1 - p) * (s.n - s.nn / s.n - (s.k - 1))
    return _capped(spread / room if room > 0 else None)


def _capped(rho: float | None) -> float:
    rho = min(max(0.0 if rho is None else rho, 0.001), 0.5)
    return 1 / rho - 1


def reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, mean, bound) for every host of ``outcomes`` (host, bad),
    where a null ``bad`` is a page without an outcome."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    counts = written(counts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = counts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    strength = [_strength(x.where("n > 0")) for x in (suffixes, domains, counts)]
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = (whole.bad + 1) / (whole.n + 2)

    def shrunk(prior: Column, m: float) -> Column:
        return (F.col("bad") + m * prior) / (F.col("n") + m)

    by_suffix = suffixes.select("suffix", shrunk(F.lit(overall), strength[0]).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("suffix_mean"), strength[1]).alias("domain_mean"))
    mean, weight = shrunk(F.col("domain_mean"), strength[2]), F.col("n") + strength[2]
    return (
        counts.join(by_domain, "domain")
        .withColumn("mean", mean)
        .select("host", "n", "bad", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1))).alias("bound"))
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], limit: float = LIMIT, z: float = Z) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_n, host_bad) per row of
    ``pages`` (page_id, url); ``outcomes`` is (host, bad)."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SPREAD))
    # outcomes of hosts, each copied once per salt: a host with very many rows is spread over tasks
    known = reputations(outcomes, z).select("host", "n", "bad", (F.col("bound") > limit).alias("blocked"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<long>")))
    judged = rows.withColumn("salt", salt).join(known, ["host", "salt"], "left")
    rule = rule_column(F.col("host"), F.col("path"), rules)
    ruled = F.lit(None).cast("string")
    for name, verdict in rules.items():
        ruled = F.when(F.col("rule") == name, verdict).otherwise(ruled)
    own = F.when(F.coalesce("blocked", F.lit(False)) & (F.col("host") != ""), "block").otherwise("allow")
    return judged.withColumn("rule", rule).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(ruled, own).alias("verdict"),
        F.coalesce("n", F.lit(0)).alias("host_n"),
        F.coalesce("bad", F.lit(0)).alias("host_bad"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) per page: bad if the document that the path ends with is
    labelled of low quality or toxic, null if it has no label."""
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})(\.html)?/?$", 1)
    named = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    outcome = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(bad).alias("bad"))
    return named.join(outcome, "doc_id", "left").select("host", "bad")
