"""URL filters: rules first, then the reputation of the host by empirical Bayes.

Labelled pages make a host's share of good pages. It is shrunk towards its registered domain's, that towards its
suffix's, that towards the share over all pages, each time with a beta prior whose strength is fitted by moments to how
much the children of one parent differ. A page is blocked when even the upper bound of its host's posterior is below a stated part of
the share of good pages over all hosts: hosts that are a little worse than the average stay, however sure their share becomes
as pages grow, and the limit moves with the outcomes and not with how strict their labels are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stash

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path begins with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A host is blocked when mean + Z standard deviations of its posterior stay below the overall share of good pages, times TOLERANCE.
Z, TOLERANCE = 2.0, 0.9
#: What the query takes for a bad page, as the tables have no labels: one of these signs for so many visible words or fewer.
SIGNS, WORDS_PER_SIGN = "[#*$%|]", 10
#: Priors are worth so many pages at least and at most: the first keeps a few pages from deciding, the second is where children of one
#: parent differ by no more than chance. Both hold at any number of pages.
WEAKEST, STRONGEST = 4.0, 1000.0
#: Suffixes of two labels under which names are registered; a table of more can be given instead. Any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")


def url_host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """suffix and domain of each host: the longest known suffix that it ends with (its last label, if none), and one label more.

    suffixes: a table with the column suffix, lower-case, of two labels or more; LONG_SUFFIXES if there is none. Every end of a host is
    looked up, so the join is one of equality.
    """
    if suffixes is None:
        suffixes = hosts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, LONG_SUFFIXES))).alias("suffix"))
    name = F.regexp_replace("host", r"(^.*@)|(:[0-9]*$)", "")
    labels = F.split(name, r"\.")
    own = stash(hosts.withColumn("_name", name), "named-hosts")
    ends = own.select("host", F.explode(F.when(F.size(labels) > 2, F.sequence(F.lit(-2), 1 - F.size(labels))).otherwise(F.array(F.lit(-2)))).alias("k"), "_name")
    ends = ends.select("host", F.expr("substring_index(_name, '.', k)").alias("suffix"), F.col("k"))
    known = ends.join(suffixes.select("suffix").distinct().hint("merge"), "suffix").groupBy("host").agg(F.min("k").alias("_k"))
    k = F.coalesce("_k", F.lit(-1))
    found = own.join(known.hint("merge"), "host", "left").withColumn("_k", k)
    return found.withColumn("suffix", F.expr("substring_index(_name, '.', _k)")).withColumn("domain", F.expr("substring_index(_name, '.', _k - 1)")).drop("_name", "_k")


def posterior(rows: DataFrame, mean: str, strength: float) -> DataFrame:
    """a and b of the beta posterior of k good pages of n, under a prior of this mean and strength."""
    return rows.withColumn("a", F.col("k") + strength * F.col(mean)).withColumn("b", F.col("n") - F.col("k") + strength * (1 - F.col(mean)))


def prior_strength(rows: DataFrame, mean: str) -> float:
    """Pages that a parent's share is worth: children of one parent differ by chance and by 1 / (strength + 1) of p q.

    One row comes to the driver. It is rounded, so that the order in which partitions are summed doesn't matter.
    """
    chance = F.col(mean) * (1 - F.col(mean))
    beyond = F.sum((F.col("k") - F.col("n") * F.col(mean)) ** 2 - F.col("n") * chance)
    room = F.sum(F.col("n") * (F.col("n") - 1) * chance)
    r = rows.agg(F.floor(beyond / F.nullif(room, F.lit(0.0)) * 1e6 + 0.5).alias("r")).first()["r"]
    share = (r or 0) / 1e6
    return STRONGEST if share <= 1 / (STRONGEST + 1) else max(WEAKEST, 1 / share - 1)


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host to n, k, mean and upper bound of its share of good pages, and the share over all hosts.

    pages: page_id and url; outcomes: page_id and good (boolean), at most a row for each page, any of them missing. A host
    without labelled pages has its prior for a posterior.
    """
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"))
    best = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    counted = seen.join(best.hint("merge"), "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.count_if(F.col("good")).alias("k"))
    hosts = stash(levels(counted, suffixes), "hosts")
    domains = stash(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    ends = stash(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    whole = ends.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    n, k = whole["n"] or 0, whole["k"] or 0
    share = lambda rows, name: rows.withColumn(name, F.col("a") / (F.col("a") + F.col("b"))).drop("n", "k", "a", "b")
    s = ends.withColumn("p", F.lit((k + 1) / (n + 2)))
    s = share(posterior(s, "p", prior_strength(s, "p")).drop("p"), "p_suffix")
    d = stash(domains.join(s.hint("merge"), "suffix"), "domain-priors")
    d = share(posterior(d, "p_suffix", prior_strength(d, "p_suffix")).drop("p_suffix", "suffix"), "p_domain")
    h = stash(hosts.join(d.hint("merge"), "domain"), "host-priors")
    h = posterior(h, "p_domain", prior_strength(h, "p_domain"))
    mean, size = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    return h.select("host", "n", "k", F.lit((k + 1) / (n + 2)).alias("overall"), mean.alias("mean"), (mean + Z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("upper"))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest of the rules that fit, as struct<length, rule, verdict>; null where none does."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.greatest(*fits, none) if fits else none


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, tolerance: float = TOLERANCE, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the reputation behind it (mean, upper, overall), a row for each row of pages.

    A url that is null or has no :// has an empty host and path, and the reputation of the empty host. Repeated rows and
    null page_ids are judged like any other. Other columns of either table are ignored; empty tables give no rows, and no
    outcomes at all leave every host at the overall share of one half, with an upper bound above it, which is allowed. Without rules the
    reputation decides alone.
    """
    reputation = stash(host_reputation(pages, outcomes, suffixes), "reputation")
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    # one host may have most pages: a merge join is split where it is hot
    return rows.join(reputation.hint("merge"), "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("upper") < F.col("overall") * tolerance, "block").otherwise("allow")).alias("verdict"),
        "mean",
        "upper",
        "overall",
    )


def page_outcomes(pages: DataFrame, signs: str = SIGNS, words_per_sign: int = WORDS_PER_SIGN) -> DataFrame:
    """page_id and good: whether few signs stand among a page's visible words; null html has no outcome.

    A stand-in for labels, which the reputation takes from any table of page_id and good. Visible is what is left without scripts,
    styles and tags. A page without words is good.
    """
    seen = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</(script|style)>|<[^>]*>", " ")
    few = F.regexp_count(seen, F.lit(signs)) * words_per_sign <= F.regexp_count(seen, F.lit(r"[^\x20\x09-\x0D]+"))
    return pages.select("page_id", few.alias("good"))
