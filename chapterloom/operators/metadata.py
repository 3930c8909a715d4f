"""Novel metadata from page nodes by site rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import nodes as N
from ..functions.text import filled, let, strip
from ..functions.urls import normalize_for_site, resolve
from ..plans.site_rules import Site
from .cleaning import flat_text

DESCRIPTION_LIMIT = 2000


def split_tags(value: Column) -> Column:
    """Comma list to trimmed, non-empty tags."""
    return F.filter(F.transform(F.split(value, ","), strip), lambda t: t != "")


def _tags(site: Site, nodes: Column, among: Column) -> Column:
    texts = F.array().cast("array<string>")
    if site.tags:
        hits = N.matches(among, site.tags)
        # Tag texts join their pieces without a blank.
        each = F.transform(hits, lambda t: N.text_of(N.inside(nodes, t), ""))
        texts = F.filter(each, lambda t: t != "")
    if not site.tags_meta:
        return texts
    return let(
        N.meta(among, site.tags_meta),
        lambda listed: F.when(listed != "", split_tags(listed)).otherwise(texts),
    )


def _cover(site: Site, among: Column, page_url: Column) -> Column:
    image = N.first(among, site.cover)["attrs"]["src"] if site.cover else F.lit(None).cast("string")
    source = F.coalesce(filled(image), filled(N.meta(among, site.cover_meta)))
    usable = (lambda s: ~s.contains(site.cover_reject)) if site.cover_reject else (lambda s: s.isNotNull())
    return let(source, lambda s: F.when(usable(s), resolve(page_url, s)))


def _description(site: Site, nodes: Column, among: Column) -> Column:
    listed = F.coalesce(N.meta(among, site.description_meta), F.lit(""))
    if not site.description:
        return listed
    # The text is null only when the element is missing: an empty one counts.
    whole = let(N.inside(nodes, N.first(among, site.description)), lambda part: flat_text(part, DESCRIPTION_LIMIT))
    return F.coalesce(whole, listed)


def novel_fields(site: Site, nodes: Column, source_url: Column) -> Column:
    """All metadata of one novel page as a struct.

    A page is passed over once: whatever a selector of the site could use is put aside, a few nodes, and
    all fields are looked up there.
    """
    groups = [*site.title.groups(), *site.author.groups(), site.description, site.cover, site.tags]
    steps = N.steps_of(*groups, N.path(N.el("meta")))
    return let(
        N.candidates(nodes, steps),
        lambda among: F.struct(
            site.title.value(nodes, among).alias("title"),
            site.author.value(nodes, among).alias("author"),
            _description(site, nodes, among).alias("description"),
            F.lit(site.language).alias("language"),
            _cover(site, among, source_url).alias("cover_url"),
            source_url.alias("source_url"),
            _tags(site, nodes, among).alias("tags"),
            F.lit(site.publisher).cast("string").alias("publisher"),
        ),
    )


def novel_metadata(df: DataFrame, sites: Sequence[Site], url: str = "url") -> DataFrame:
    """Pages (url, site, nodes) to one metadata row each; other sites' pages drop out.

    The sites' rules are branches of one CASE on ``site``, so a page is read
    and tokenised once, whatever the number of sites.
    """
    known = df.filter(F.col("site").isin(*[s.name for s in sites]))
    case = None
    for site in sites:
        source = normalize_for_site(F.col(url), F.lit(site.url_prefix).cast("string"))
        fields = novel_fields(site, F.col("nodes"), source)
        hit = F.col("site") == site.name
        case = F.when(hit, fields) if case is None else case.when(hit, fields)
    kept = [c for c in df.columns if c != "nodes"]
    return known.withColumn("_m", case).select(*kept, "_m.*")


def override_language(requested: Column, found: Column) -> Column:
    return F.coalesce(F.nullif(requested, F.lit("")), found)


def chapter_titles(site: Site, nodes: Column, catalog_title: Column) -> list[Column]:
    """Title sources of a chapter page in order; the catalog's title comes last."""
    return [site.chapter_title.value(nodes), catalog_title]
