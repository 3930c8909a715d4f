"""From URLs to sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..functions.urls import host, is_valid


def split_valid(df: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows with a usable web address, trimmed; rejected rows)."""
    ok = F.coalesce(is_valid(F.col(url)), F.lit(False))
    good = df.filter(ok).withColumn(url, strip(F.col(url)))
    return good, df.filter(~ok).withColumn("detail", F.lit("invalid_url"))


def host_suffixes(name: Column) -> Column:
    """The host and every parent domain: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(name, r"\.")
    size = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.array_join(F.slice(labels, i, size - i + 1), "."),
    )


def route(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Append ``site`` (null when no site covers the host).

    The domain test is an equi-join on the host's dot suffixes, made per
    distinct host: hosts are few compared with pages, so the fan-out never
    touches the page rows, and one busy host costs one row here.
    """
    domains = rules.select("site", "priority", F.explode("domains").alias("domain"))
    hosts = df.select(host(F.col(url)).alias("host")).filter("host <> ''").distinct()
    best = (
        hosts.withColumn("domain", F.explode(host_suffixes(F.col("host"))))
        .join(domains, "domain")
        .groupBy("host")
        .agg(F.min_by("site", F.struct(-F.col("priority"), F.col("site"))).alias("site"))
    )
    return df.withColumn("host", host(F.col(url))).join(best, "host", "left")


def site_of(url: Column, sites) -> Column:
    """Name of the site that covers a URL's host, null without one: a projection over literal rules."""
    name = host(url)
    covered = F.lit(None).cast("string")
    # The site of highest priority is asked first, ties in order of name.
    for site in sorted(sites, key=lambda s: (-s.priority, s.name), reverse=True):
        hit = name.isin(*site.domains)
        for domain in site.domains:
            hit = hit | name.endswith("." + domain)
        covered = F.when(hit, F.lit(site.name)).otherwise(covered)
    return covered


def list_sites(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("priority"), "site")


def site_by_name(rules: DataFrame, names: DataFrame) -> DataFrame:
    """Look up sites by name; unknown names stay with null columns."""
    return names.join(rules, "site", "left")


def error_detail(kind: Column, message: Column) -> Column:
    """Detail code of a failure class; the first matching class wins."""
    # Failure classes and their codes.
    return (
        F.when(kind == "UnsupportedSite", F.lit("unsupported_site"))
        .when(kind == "StoppedBeforeStart", F.lit("stopped_empty"))
        .when(kind == "Parser", F.concat(F.lit("parser_error: "), message))
        .when(kind == "BrowserUnavailable", F.concat(F.lit("playwright_unavailable: "), message))
        .when(kind == "Fetch", F.concat(F.lit("fetch_error: "), message))
        .otherwise(F.concat(F.lit("unknown_error: "), kind, F.lit(": "), message))
    )


# Message keys, in the order in which they are tried.
ERROR_KEYS = (
    "invalid_url", "unsupported_site", "parser_error", "playwright_unavailable",
    "stopped_empty", "import_error", "fetch_error",
)


def error_key(detail: Column) -> Column:
    """Message key of a detail code: the first key it starts with."""
    found = [F.when(detail.startswith(key), F.lit(f"error.{key}")) for key in ERROR_KEYS]
    return F.coalesce(*found, F.lit("error.unknown"))
