"""URL filtering by rules and by the reputation of hosts.

Labelled pages (good or not) are counted per host. A host's rate of good pages is shrunk towards that of its
registered domain, the domain's towards its suffix, the suffix's towards all pages: each level's beta prior has
the level above's posterior mean and a strength estimated from the spread of the counts at that level (empirical Bayes, method of
moments). A page is blocked when even the upper bound of its host's posterior lies below a threshold, so
that hosts with few labels pass. Rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import lower_ascii
from marketlens.sources.scratch import materialise

# (verdict, host, path start), fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Public suffixes of two labels; all others are the last label.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "net.nz", "org.nz",
    "com.br", "net.br", "org.br", "gov.br", "com.ar", "com.mx", "com.co", "com.pe",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "or.kr", "com.cn", "net.cn", "org.cn", "com.tw", "com.hk", "com.sg",
    "co.in", "net.in", "org.in", "com.tr", "co.il", "co.za", "com.pl", "com.ua", "com.ru",
)
# Upper posterior bound: mean plus so many standard deviations; below MIN_GOOD a host is blocked.
DEVIATIONS = 2.0
MIN_GOOD = 0.5
# Prior strengths, in pages, are kept within these.
STRENGTH = (2.0, 1000.0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix of a host: its last two labels if they are in ``SUFFIXES``, else the last one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain of a host: its public suffix and the label before that."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def document_of(url: Column) -> Column:
    """The document that a page shows: the number that begins the last part of its path, null if there is none."""
    return F.regexp_extract(path_of(url), r"/([0-9]+)[^/]*\z", 1).try_cast("long")


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a parent of it) and path start; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(of + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, prior: str) -> DataFrame:
    """One row: the prior's strength from groups (n, good, prior mean).

    The variance of rates around their prior means exceeds the binomial one by mean * (1 - mean) / (strength + 1).
    """
    mean = F.col(prior)
    noise = mean * (1 - mean)
    groups = level.where("n > 0")
    sums = groups.agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) * (F.col("good") / F.col("n") - mean)).alias("spread"),
        F.sum(noise).alias("binomial"),
        F.sum((F.col("n") - 1) * noise).alias("weight"),
    )
    # spread = binomial + weight * rho, where rho = 1 / (strength + 1).
    rho = (F.col("spread") - F.col("binomial")) / F.col("weight")
    low, high = STRENGTH
    strength = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(low)), F.lit(high))).otherwise(F.lit(high))
    return sums.select(F.coalesce(strength, F.lit(high)).alias("strength"))


def reputations(hosts: DataFrame) -> DataFrame:
    """host, mean, upper of every row of ``hosts`` (host, n, good): one row per host, counts may be 0.

    Hosts without labels have the mean of their domain, and so on upwards; without any label the mean is 1/2.
    """
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    keyed = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    prior = keyed.withColumn("prior", F.lit(((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)))
    for level in ("suffix", "domain", "host"):
        counts = prior.groupBy(level).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.first("prior").alias("prior"))
        counts = materialise(counts)
        strength = F.lit(_strength(counts, "prior").first()["strength"])
        own = counts.select(
            F.col(level).alias("_of"),
            ((F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)).alias("mean"),
            (F.col("n") + strength).alias("size"),
        )
        if level != "host":
            prior = keyed.join(own, keyed[level] == own["_of"]).select(keyed["*"], F.col("mean").alias("prior"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return own.select(F.col("_of").alias("host"), "mean", (F.col("mean") + DEVIATIONS * deviation).alias("upper"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, document: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, upper of every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) has the outcome of pages by the document they show: ``document`` of a page's columns, or
    else page_id. A page is good with quality 1 and toxic not 1. Labels of
    unknown pages, without an id or without a quality are ignored; several labels of a page count each.
    Null urls and urls without ``://`` have an empty host and path, share the reputation of the empty host and fit no
    rule. Repeated rows are judged each. Other columns are not read.
    """
    parsed = materialise(
        pages.select(
            "page_id",
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            (F.col("page_id") if document is None else document).cast("long").alias("document"),
        )
    )
    outcomes = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("long")).alias("good"),
        )
    )
    labelled = parsed.join(outcomes, parsed["document"] == outcomes["doc_id"], "left")
    zero = F.lit(0).cast("long")
    counts = labelled.groupBy("host").agg(
        F.sum(F.coalesce("n", zero)).alias("n"), F.sum(F.coalesce("good", zero)).alias("good")
    )
    hosts = materialise(reputations(materialise(counts)))
    rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("upper") < MIN_GOOD, "block").otherwise("allow")
    return parsed.join(hosts, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(decided, by_host).alias("verdict"), "mean", "upper"
    )
