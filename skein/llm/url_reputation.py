"""URL filter by empirical-Bayes host reputation, in DataFrame functions alone.

Labelled page outcomes (1 bad, 0 good) are counted by host and rolled up to registered domain and
public suffix. At each level the share of bad pages is a beta-binomial posterior. Its prior's mean is
the level above without the unit's own outcomes; its strength in pseudo-counts is fitted by moments
from how much units of one parent differ beyond chance (the analysis-of-variance estimator of the
intraclass correlation). The root's prior is flat. A host is blocked when the lower bound of its
posterior reaches the threshold. Explicit rules come first: the longest that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a fitted prior strength, and the strength where the outcomes can't tell.
WEAKEST, STRONGEST, UNKNOWN = 1.0, 1000.0, 8.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column, two_label_suffixes: tuple[str, ...]) -> Column:
    """The registered domain: one label more than the suffix."""
    labels = F.split(host, r"\.")
    long = F.substring_index(host, ".", -2).isin(*two_label_suffixes) & (F.size(labels) > 2) if two_label_suffixes else F.lit(False)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(domain: Column) -> Column:
    """The public suffix: the domain without its first label (a host of one label is its own suffix)."""
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def with_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: the longest fitting rule (``host/path``), or null.

    A rule fits its host and that host's subdomains where the path starts with its path. Equal
    lengths: the first given wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the last that fits is the longest
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def counts(outcomes: DataFrame, two_label_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per host of ``outcomes`` (host, bad 0/1; null outcomes don't count): host, domain, suffix, k bad ones of n.
    Partial sums come before any shuffle, so a hot host is one row per task."""
    by_host = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.sum(F.col("bad").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    return by_host.withColumn("domain", domain_of(F.col("host"), two_label_suffixes)).withColumn("suffix", suffix_of(F.col("domain")))


def strength(units: DataFrame, parent: list[str], name: str) -> DataFrame:
    """One row: the prior strength of units (k of n outcomes each) that share a parent.

    With correlation r of outcomes within a unit, the strength is 1 / r - 1, kept between ``WEAKEST`` and
    ``STRONGEST``; where no parent has two units, or no unit two outcomes, it is ``UNKNOWN``."""
    p = F.col("k") / F.col("n")
    own = units.groupBy(*parent).agg(
        F.sum("k").alias("kp"), F.sum("n").alias("np"), F.count(F.lit(1)).alias("m"), F.sum(p * F.col("k")).alias("kkn"), F.sum(F.col("k") * (1 - p)).alias("within"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    # The sum over a parent's units of n * (p - its p) ** 2, and what the sizes make of it.
    own = own.select("np", "m", "within", (F.col("kkn") - F.col("kp") * F.col("kp") / F.col("np")).alias("between"), (F.col("nn") / F.col("np")).alias("nn"))
    total = own.agg(F.sum("np").alias("n"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("g"), F.sum("between").alias("b"), F.sum("within").alias("w"), F.sum("nn").alias("nn"))
    b, w, size = F.col("b") / (F.col("m") - F.col("g")), F.col("w") / (F.col("n") - F.col("m")), (F.col("n") - F.col("nn")) / (F.col("m") - F.col("g"))
    r = F.greatest((b - w) / F.nullif(b + (size - 1) * w, F.lit(0.0)), F.lit(1e-9))
    fitted = F.least(F.greatest(F.coalesce(1 / r - 1, F.lit(STRONGEST)), F.lit(WEAKEST)), F.lit(STRONGEST))
    return total.select(F.when((F.col("m") > F.col("g")) & (F.col("n") > F.col("m")), F.round(fitted, 6)).otherwise(F.lit(UNKNOWN)).alias(name))


def _mean(k: str, n: str, own_k: str, own_n: str, prior: Column, weight: Column) -> Column:
    """A level's posterior mean without what one unit below it contributed."""
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (at(k) - at(own_k) + weight * prior) / (at(n) - at(own_n) + weight)


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", keep: tuple[str, ...] = ("page_id",), z: float = 1.645, threshold: float = 0.5, two_label_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Adds host, path, rule, verdict, and the reputation behind a verdict without a rule.

    ``outcomes``: (host, bad). The bound is ``z`` standard deviations of the posterior below its mean.
    Null urls and urls without ``://`` have an empty host and path and no
    rule, and are judged by the reputation of the empty host. Hosts without outcomes have their domain's
    mean, which alone never blocks with less evidence than a weak prior holds. Without any outcomes all is
    allowed. Repeated pages are judged each. Columns other than ``keep`` and the url are not
    read, so clashing names don't matter. Hosts with more than a 64th of all pages are joined in 16 parts."""
    rows = with_rules(pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")), rules)
    hosts = counts(outcomes, two_label_suffixes)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    root = suffixes.agg(F.sum("k").alias("kr"), F.sum("n").alias("nr"))
    fits = root.crossJoin(strength(hosts, ["domain", "suffix"], "of_host")).crossJoin(strength(domains, ["suffix"], "of_domain")).crossJoin(strength(suffixes, [], "of_suffix"))  # one row each
    # One row per host of the pages, with its counts at each level.
    seen = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumn("domain", domain_of(F.col("host"), two_label_suffixes)).withColumn("suffix", suffix_of(F.col("domain")))
    hot = [r.host for r in seen.crossJoin(F.broadcast(seen.agg(F.sum("pages").alias("all")))).filter("pages * 64 > all").select("host").collect()]  # fewer than 64
    seen = seen.join(hosts.select("host", "k", "n"), "host", "left")
    seen = seen.join(domains.select("domain", F.col("k").alias("kd"), F.col("n").alias("nd")), "domain", "left").join(suffixes.select("suffix", F.col("k").alias("ks"), F.col("n").alias("ns")), "suffix", "left")
    seen = seen.crossJoin(F.broadcast(fits))  # one row
    above = _mean("kr", "nr", "ks", "ns", F.lit(0.5), F.lit(2.0))
    above = _mean("ks", "ns", "kd", "nd", above, F.col("of_suffix"))
    above = _mean("kd", "nd", "k", "n", above, F.col("of_domain"))
    own = F.coalesce("n", F.lit(0))
    seen = seen.select("host", own.alias("host_outcomes"), "of_host", ((F.coalesce("k", F.lit(0)) + F.col("of_host") * above) / (own + F.col("of_host"))).alias("posterior"))
    seen = seen.withColumn("bound", F.col("posterior") - F.lit(z) * F.sqrt(F.col("posterior") * (F.lit(1.0) - F.col("posterior")) / (F.col("host_outcomes") + F.col("of_host") + F.lit(1.0))))
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("bound") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    if hot:
        rows = rows.withColumn("salt", F.when(F.col("host").isin(hot), F.pmod(F.xxhash64("path", *keep), F.lit(16))).otherwise(F.lit(0)))
        seen = seen.withColumn("salt", F.explode(F.when(F.col("host").isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return rows.join(seen, ["host", "salt"] if hot else ["host"], "left").select(*keep, "host", "path", "rule", verdict.alias("verdict"), "posterior", "bound", "host_outcomes")


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]], **options) -> DataFrame:
    """:func:`judge` where the labelled outcomes are the pages that the rules themselves decide: there are no other labels."""
    found = with_rules(pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    outcomes = found.filter(F.col("rule_verdict").isNotNull()).select("host", (F.col("rule_verdict") == "block").cast("int").alias("bad"))
    return judge(pages, outcomes, rules, **options)
