"""Chapter cleaning: hidden rules, subtree removal, allowlists, serialisation.

Every function works on a DataFrame with one row per page and a ``nodes``
column (see ``sources.html_nodes``). Nothing is exploded, so the whole chain
runs in the stage that tokenised the page, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import nodes as N
from ..functions.text import collapse, is_blank, let, shorten, strip
from ..functions.urls import resolve

# ---- fixed values -------------------------------------------------------
ALLOWED_TAGS = (
    "a b blockquote br code div em figcaption figure h1 h2 h3 h4 h5 h6 hr i img li ol p pre s "
    "small span strong sub sup table tbody td tfoot th thead tr u ul"
).split()
DROP_TAGS = (
    "script style iframe noscript form input button select textarea svg canvas video audio "
    "object embed ins"
).split()
ALLOWED_ATTRS = {
    "a": ["href", "title"],
    "img": ["src", "alt", "width", "height"],
    "td": ["colspan", "rowspan"],
    "th": ["colspan", "rowspan"],
}
HIDDEN = r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0)"
CSS_RULE = r"([^{}]+)\{([^{}]*)\}"
SIMPLE_SELECTOR = r"(?U)^(\.|#)?(--|-?[A-Za-z_\x{80}-\x{10FFFF}])[\w-]*$"
KEEPS_BLOCK = ["img", "br", "hr", "table"]
MAYBE_EMPTY = ["p", "div", "span"]
VOID_OUT = ["br", "hr", "img"]
# -------------------------------------------------------------------------


def hidden_selectors(nodes: Column) -> Column:
    """Simple selectors of the page's own CSS rules that hide what they match."""
    sheets = F.transform(F.filter(nodes, lambda x: x["kind"] == "css"), lambda x: x["text"])

    def rules(css: Column) -> Column:
        heads = F.regexp_extract_all(css, F.lit(CSS_RULE), F.lit(1))
        bodies = F.regexp_extract_all(css, F.lit(CSS_RULE), F.lit(2))
        hiding = F.filter(F.arrays_zip(heads.alias("head"), bodies.alias("body")),
                          lambda r: r["body"].rlike(HIDDEN))
        return F.flatten(F.transform(hiding, lambda r: F.split(r["head"], ",")))

    names = F.transform(F.flatten(F.transform(sheets, rules)), collapse)
    return F.array_distinct(F.filter(names, lambda s: s.rlike(SIMPLE_SELECTOR)))


def css_hidden_rules(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per page and hiding selector."""
    return df.select(*keys, F.explode(hidden_selectors(F.col("nodes"))).alias("selector"))


def is_css_hidden(selectors: Column, node: Column) -> Column:
    classes = F.split(node["attrs"]["class"], r"\s+")
    # Most pages hide nothing this way.
    return (F.size(selectors) > 0) & (node["kind"] == "el") & (
        F.array_contains(F.transform(selectors, F.lower), node["tag"])
        | F.coalesce(F.array_contains(selectors, F.concat(F.lit("#"), node["attrs"]["id"])), F.lit(False))
        | F.coalesce(
            F.exists(classes, lambda c: F.array_contains(selectors, F.concat(F.lit("."), c))),
            F.lit(False),
        )
    )


def is_inline_hidden(node: Column) -> Column:
    return (node["kind"] == "el") & (
        F.coalesce(F.map_contains_key(node["attrs"], "hidden"), F.lit(False))
        | F.coalesce(node["attrs"]["style"].rlike(HIDDEN), F.lit(False))
    )


Ads = Sequence[N.Step] | Callable[[Column], Column]


def is_ad(node: Column, ads: Ads) -> Column:
    if callable(ads):
        return ads(node)
    hit = F.lit(False)
    for step in ads:
        hit = hit | step.test(node)
    return hit


def _with_page(df: DataFrame) -> DataFrame:
    """Keep the page as read in ``page_nodes``, where position equals id."""
    return df if "page_nodes" in df.columns else df.withColumn("page_nodes", F.col("nodes"))


def _remove(df: DataFrame, doomed) -> DataFrame:
    """Drop the subtrees of all nodes for which ``doomed`` holds."""
    df = _with_page(df)
    roots = N.subtree_roots(F.col("nodes"), doomed)
    df = df.withColumn("roots", roots)
    kept = N.without_ranges(F.col("page_nodes"), F.col("nodes"), F.col("roots"))
    return df.withColumn("nodes", kept).drop("roots")


def strip_hidden(df: DataFrame, ads: Ads = ()) -> DataFrame:
    """Page-level pass: the site's ads, then elements hidden by the CSS that is left.

    Runs before a container is chosen, because the style sheet sits in the head. A style
    sheet inside an ad goes with it and hides nothing.
    """
    if ads:
        df = strip_ads(df, ads)
    df = df.withColumn("hidden_css", hidden_selectors(F.col("nodes")))
    hidden = F.col("hidden_css")
    out = _remove(df, lambda x: is_css_hidden(hidden, x))
    return out.drop("hidden_css")


def strip_ads(df: DataFrame, ads: Ads) -> DataFrame:
    return _remove(df, lambda x: is_ad(x, ads))


def strip_comments(df: DataFrame) -> DataFrame:
    """Only elements and character data are content."""
    return _with_page(df).withColumn(
        "nodes", F.filter("nodes", lambda x: x["kind"].isin("el", "tx", "css", "js"))
    )


def drop_tags(df: DataFrame, tags: Sequence[str] = tuple(DROP_TAGS)) -> DataFrame:
    return _remove(df, lambda x: x["tag"].isin(*tags))


def drop_inline_hidden(df: DataFrame) -> DataFrame:
    return _remove(df, is_inline_hidden)


def drop_images(df: DataFrame) -> DataFrame:
    return _remove(df, lambda x: x["tag"] == "img")


def keep_container(df: DataFrame, groups: Sequence[N.Group] | Column) -> DataFrame:
    """Reduce each page to its content container; ``has_container`` tells if there is one.

    ``groups`` are the selectors in order, or a finished expression for the node.
    """
    found = groups if isinstance(groups, Column) else N.first_of(F.col("nodes"), groups)
    df = _with_page(df).withColumn("container", found)
    inside = N.below(F.col("nodes"), F.col("container"))
    empty = F.filter("nodes", lambda x: F.lit(False))
    return (
        df.withColumn("has_container", F.col("container").isNotNull())
        .withColumn("nodes", F.coalesce(inside, empty))
        .drop("container")
    )


def unwrap_tags(df: DataFrame) -> DataFrame:
    """Markup outside the allowlist goes, the text below it stays."""
    return _with_page(df).withColumn(
        "nodes",
        F.filter("nodes", lambda x: (x["kind"] == "tx") | x["tag"].isin(*ALLOWED_TAGS)),
    )


def allowed_attrs(node: Column, base_url: Column | None = None) -> Column:
    """The node's attributes under the allowlist, links resolved against the page."""
    by_tag = F.create_map(
        *[c for tag, names in ALLOWED_ATTRS.items()
          for c in (F.lit(tag), F.array(*[F.lit(n) for n in names]))]
    )
    extra = F.coalesce(by_tag[node["tag"]], F.array().cast("array<string>"))
    kept = F.map_filter(node["attrs"], lambda k, v: (k == "id") | F.array_contains(extra, k))
    if base_url is None:
        return kept
    return F.transform_values(
        kept,
        lambda k, v: F.when(
            ((node["tag"] == "a") & (k == "href") | (node["tag"] == "img") & (k == "src")) & (v != ""),
            resolve(base_url, v),
        ).otherwise(v),
    )


def attr_allowlist(df: DataFrame, base_url: Column | None = None) -> DataFrame:
    return df.withColumn(
        "nodes",
        F.transform(
            "nodes",
            lambda x: F.when(x["kind"] == "el", x.withField("attrs", allowed_attrs(x, base_url))).otherwise(x),
        ),
    )


def _empty_blocks(nodes: Column) -> Column:
    """Blocks with neither text nor a tag worth keeping, by one backward pass.

    Going backwards, ``next`` is the closest supporting node behind the current
    one; the block is empty when that lies beyond its last descendant.
    """
    zero = F.struct(
        F.lit(2**31 - 1).alias("next"),
        F.array().cast("array<struct<id:int,last:int>>").alias("roots"),
    )

    def visit(acc: Column, x: Column) -> Column:
        supports = F.when(x["kind"] == "tx", ~is_blank(x["text"])).otherwise(x["tag"].isin(*KEEPS_BLOCK))
        empty = x["tag"].isin(*MAYBE_EMPTY) & (acc["next"] > x["last"])
        root = F.struct(x["id"].alias("id"), x["last"].alias("last"))
        roots = acc["roots"]
        return (
            F.when(supports, F.struct(x["id"].alias("next"), roots.alias("roots")))
            .when(empty, F.struct(acc["next"].alias("next"), F.array_append(roots, root).alias("roots")))
            .otherwise(acc)
        )

    return F.aggregate(F.reverse(nodes), zero, visit, lambda acc: acc["roots"])


def _leading_breaks(nodes: Column) -> Column:
    """Line breaks with nothing but blanks and breaks before them in their parent.

    ``open`` is the end of the closest preceding node that is neither blank
    text nor a break (0 for text): the break leads its parent exactly when that
    node is the parent itself, or when there is none.
    """
    zero = F.struct(
        F.lit(2**31 - 1).alias("open"),
        F.array().cast("array<struct<id:int,last:int>>").alias("roots"),
    )

    def visit(acc: Column, x: Column) -> Column:
        is_break = F.coalesce(x["tag"] == "br", F.lit(False))
        root = F.struct(x["id"].alias("id"), x["last"].alias("last"))
        roots = acc["roots"]
        leading = F.struct(acc["open"].alias("open"), F.array_append(roots, root).alias("roots"))
        return (
            F.when(is_break, F.when(acc["open"] >= x["id"], leading).otherwise(acc))
            .when(x["kind"] == "el", F.struct(x["last"].alias("open"), roots.alias("roots")))
            .when(is_blank(x["text"]), acc)
            .otherwise(F.struct(F.lit(0).alias("open"), roots.alias("roots")))
        )

    return F.aggregate(nodes, zero, visit, lambda acc: acc["roots"])


def drop_empty(df: DataFrame) -> DataFrame:
    """Empty p/div/span first, then the leading breaks of every parent."""
    df = _with_page(df)
    for doomed in (_empty_blocks, _leading_breaks):
        df = df.withColumn("roots", doomed(F.col("nodes")))
        kept = N.without_ranges(F.col("page_nodes"), F.col("nodes"), F.col("roots"))
        df = df.withColumn("nodes", kept)
    return df.drop("roots")


def _attr_text(name: Column, value: Column) -> Column:
    """One attribute as markup; quotes follow the value's own quotes."""
    safe = value
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(entity))
    double = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    single = F.concat(F.lit("'"), safe, F.lit("'"))
    quoted = F.when(safe.contains('"') & ~safe.contains("'"), single).otherwise(double)
    return F.concat(F.lit(" "), name, F.lit("="), quoted)


def serialize(nodes: Column) -> Column:
    """The nodes as an XHTML fragment.

    Opening marks sort at the node's own id, closing marks behind its last
    descendant, deeper ones first; one sort then yields the document.
    """

    def opening(x: Column) -> Column:
        attrs = F.array_join(
            F.transform(F.array_sort(F.map_entries(x["attrs"])), lambda e: _attr_text(e["key"], e["value"])),
            "",
        )
        end = F.when(x["tag"].isin(*VOID_OUT), F.lit("/>")).otherwise(F.lit(">"))
        text = x["text"]
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(raw), F.lit(entity))
        mark = F.when(x["kind"] == "el", F.concat(F.lit("<"), x["tag"], attrs, end)).otherwise(text)
        return F.struct(x["id"].alias("at"), F.lit(0).alias("side"), F.lit(0).alias("rank"), mark.alias("s"))

    def closing(x: Column) -> Column:
        mark = F.concat(F.lit("</"), x["tag"], F.lit(">"))
        return F.struct(
            x["last"].alias("at"), F.lit(1).alias("side"), (-x["depth"]).alias("rank"), mark.alias("s")
        )

    closable = F.filter(nodes, lambda x: (x["kind"] == "el") & ~x["tag"].isin(*VOID_OUT))
    marks = F.sort_array(F.concat(F.transform(nodes, opening), F.transform(closable, closing)))
    return strip(F.array_join(F.transform(marks, lambda m: m["s"]), ""))


def sanitize_nodes(
    df: DataFrame, base_url: Column | None = None, keep_images: bool = False
) -> DataFrame:
    """The whole cleaning pass over ``nodes``; appends ``clean_html`` and ``clean_text``."""
    df = df.withColumn("hidden_css", hidden_selectors(F.col("nodes")))
    hidden = F.col("hidden_css")

    def doomed(x: Column) -> Column:
        hit = x["tag"].isin(*DROP_TAGS) | is_inline_hidden(x) | is_css_hidden(hidden, x)
        return hit if keep_images else hit | (x["tag"] == "img")

    df = _remove(df, doomed).drop("hidden_css")
    df = drop_empty(unwrap_tags(df))
    df = attr_allowlist(df, base_url)
    return df.withColumn("clean_html", serialize(F.col("nodes"))).withColumn(
        "clean_text", flat_text(F.col("nodes"))
    )


def flat_text(nodes: Column, limit: int | None = None) -> Column:
    """Visible text on one line, optionally shortened."""
    text = collapse(N.text_of(nodes))
    return let(text, lambda t: shorten(t, limit)) if limit else text


def chapter_contents(
    df: DataFrame,
    containers: Sequence[N.Group] | Column,
    titles: Sequence[Column],
    ads: Ads = (),
    base_url: Column | None = None,
    keep_images: bool = False,
) -> DataFrame:
    """Pages to chapters: hidden and ad blocks, container, title, cleaning, status.

    ``titles`` are expressions over ``nodes`` (after the page-level pass) and
    other columns, in order of preference; the last one is usually the catalog
    title. Pages without content keep their row, with a status instead; a
    column ``parsed``, see ``with_nodes``, marks those that could not be read.
    """
    told = "parsed" in df.columns
    df = strip_hidden(df, ads)
    df = df.withColumn("title", F.coalesce(*titles))
    df = keep_container(df, containers)
    df = sanitize_nodes(df, base_url, keep_images)
    status = (
        F.when(~F.col("parsed") if told else F.lit(False), F.lit("parse_error"))
        .when(~F.col("has_container"), F.lit("no_content"))
        .when(F.col("clean_text") == "", F.lit("empty_after_cleaning"))
        .otherwise(F.lit("ok"))
    )
    return df.withColumn("status", status).drop("nodes", "page_nodes", "has_container", "parsed")
