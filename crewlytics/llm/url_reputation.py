"""Host reputation from labelled pages by empirical Bayes, with explicit rules on top.

Counts of bad pages are shrunk from suffix to registered domain to host: the posterior mean of
one level is the prior mean of the next, and the strength of each level's prior is fitted to how
much its members differ, by moments of the beta-binomial. A host is blocked when the lower bound
of its posterior share of bad pages is above a limit. Everything is SQL over one row per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlytics.llm.scratch import stored

#: Public suffixes of two labels that are taken as one; others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (up to ``/ ? #``, A-Z lower-cased) and path (up to ``? #``); without ``://`` both are empty."""
    rest = F.expr(f"case when instr(`{url}`, '://') > 0 then substring(`{url}`, instr(`{url}`, '://') + 3) else '' end")
    rows = urls.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0)
    return rows.withColumn("path", path).withColumn("host", F.translate("_host", UPPER, LOWER)).drop("_rest", "_host")


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.

    ``rules`` are (verdict, ``host/path``) pairs given by the caller and so bounded. A rule fits
    its host and all subdomains if the path begins with the rule's. Of equal rules the first counts.
    """
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_counts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad): labelled pages of every host, 0 where none is labelled.

    ``pages`` has host and id, ``outcomes`` id and bad (0 or 1); repeated ids count once, as bad if
    any of their rows is. Counts are partial sums per task before any host's rows meet.
    """
    known = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    marked = pages.select("host", "id").join(known, "id", "left")
    counts = marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    is_two = two.isin(*TWO_LABEL_SUFFIXES)
    several = F.size(labels) > 1
    suffix = F.when(several & is_two, two).otherwise(F.element_at(labels, -1))
    domain = (
        F.when(several & is_two & (F.size(labels) > 2), F.array_join(F.slice(labels, -3, 3), "."))
        .when(several, two)
        .otherwise(F.col("host"))
    )
    return counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")


STRENGTH = """
    select round(1 / least(greatest(coalesce(
        (sum(pow(bad - n * prior, 2)) - sum(n * prior * (1 - prior)))
        / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), {least}), {least}), 0.5D) - 1, 6) from {level}
"""
#: The statement; also run by another engine to check it, so it keeps to plain SQL.
REPUTATION = f"""
    with suffixes as (
        select suffix, sum(n) as n, sum(bad) as bad,
            (select (sum(bad) + 0.5D) / (sum(n) + 1) from counts) as prior
        from counts group by suffix
    ), suffix_means as (
        select suffix, (bad + strength * prior) / (n + strength) as mean
        from (select *, ({STRENGTH.format(level="suffixes", least="0.001D")}) as strength from suffixes) s
    ), domains as (
        select d.domain, d.n, d.bad, m.mean as prior from (
            select domain, suffix, sum(n) as n, sum(bad) as bad from counts group by domain, suffix
        ) d join suffix_means m on d.suffix = m.suffix
    ), domain_means as (
        select domain, (bad + strength * prior) / (n + strength) as mean
        from (select *, ({STRENGTH.format(level="domains", least="0.001D")}) as strength from domains) d
    ), hosts as (
        select c.host, c.n, c.bad, m.mean as prior
        from counts c join domain_means m on c.domain = m.domain
    ), posterior as (
        select host, n, bad, bad + strength * prior as a, n - bad + strength * (1 - prior) as b
        from (select *, ({STRENGTH.format(level="hosts", least="0.001D")}) as strength from hosts) h
    )
    select host, n, bad, a / (a + b) as mean,
        a / (a + b) - {{z}} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low_bound
    from posterior
"""


def reputation(counts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, mean, low_bound) of the posterior share of bad pages of every host.

    ``low_bound`` is ``z`` standard deviations below the mean. Hosts without labelled pages have
    their domain's estimate, and so on up to the share over all pages; without any label that
    share is one half and its bound far below.
    """
    return counts.sparkSession.sql(REPUTATION.format(z=f"{z}D").replace("from counts", "from {counts}"), counts=counts)


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], max_bad: float = 0.5, z: float = 1.645,
    id: str = "page_id", url: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    The verdict is the longest fitting rule's, else block where ``low_bound`` of the host's
    reputation exceeds ``max_bad``, else allow. Null urls and urls without ``://`` have an empty
    host, which is judged like any other. Repeated rows each give a row; other columns are not read.
    """
    rows = with_host(pages.select(F.col(id).alias("id"), F.col(url).alias("url")))
    counts = stored(host_counts(rows, outcomes), "hosts")
    found = reputation(counts, z).select("host", "low_bound")
    rule, said = matching_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("low_bound") > max_bad, "block").otherwise("allow")
    return rows.join(found, "host", "left").select(
        F.col("id").alias(id), "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict")
    )
