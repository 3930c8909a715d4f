"""Site rules as data: routing, URL shape, and where each field is found.

A new site is one more ``Site``; no operator changes. The rules are written in
code, so their number, and thus every table made from them, is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import nodes as N
from ..functions.nodes import Group, Step, either, el, path
from ..functions.text import filled


@dataclass(frozen=True)
class FieldRule:
    """Sources of one text field, tried in order: ("text", groups) or ("meta", names)."""

    sources: tuple[tuple[str, tuple], ...]
    default: str | None = None

    def value(self, nodes: Column, among: Column | None = None) -> Column:
        """The field of a page; ``among`` has the candidates of its selectors and the meta tags, see ``nodes.candidates``."""
        found = [
            N.first_text(nodes, args, among) if kind == "text" else N.meta(nodes if among is None else among, args)
            for kind, args in self.sources
        ]
        found = [filled(v) for v in found]
        if self.default is not None:
            found.append(F.lit(self.default))
        return F.coalesce(*found)


    def groups(self) -> list[Group]:
        return [g for kind, args in self.sources if kind == "text" for g in args]


def text(*groups: Group) -> tuple[str, tuple]:
    return ("text", groups)


def meta(*names: str) -> tuple[str, tuple]:
    return ("meta", names)


@dataclass(frozen=True)
class Site:
    name: str
    label: str
    domains: tuple[str, ...]
    priority: int = 0
    needs_browser: bool = False
    url_prefix: str | None = None
    list_base: str | None = None
    title: FieldRule = FieldRule(())
    author: FieldRule = FieldRule(())
    description: Group = ()
    description_meta: tuple[str, ...] = ("og:description", "description")
    cover: Group = ()
    cover_meta: tuple[str, ...] = ()
    cover_reject: str | None = None
    tags_meta: tuple[str, ...] = ()
    tags: Group = ()
    publisher: str | None = None
    language: str = "en"
    containers: tuple[Group, ...] = ()
    chapter_title: FieldRule = FieldRule(())
    ads: tuple[Step, ...] = ()
    toc_containers: tuple[Group, ...] = ()
    toc_rows: Group = ()
    toc_pages: Group = ()
    extras: dict = field(default_factory=dict)


# ---- fixed values: the two supported sites ------------------------------
SITE_A = Site(
    name="royalroad",
    label="RoyalRoad",
    domains=("royalroad.com",),
    url_prefix=r"^(https?://[^/]+/fiction/\d+(?:/[^/?#]+)?)",
    list_base="https://www.royalroad.com",
    title=FieldRule(
        (text(path(el("div", "fic-title"), el("h1")), path(el("h1", "font-white"))),
         meta("og:title", "twitter:title")),
        "Unknown title",
    ),
    author=FieldRule(
        (text(path(el("div", "fic-title"), el("h4"), el("a")), path(el("h4", "font-white"), el("a"))),
         meta("books:author", "author")),
        "Unknown",
    ),
    description=either(path(el("div", "description")), path(el("div", "hidden-content"))),
    cover=either(path(el("div", "cover-art-container"), el("img")), path(el("img", "thumbnail"))),
    cover_meta=("og:image", "twitter:image"),
    cover_reject="nocover",
    tags=either(path(el("span", "tags"), el("a", "fiction-tag")), path(el("a", "label", "tags"))),
    publisher="RoyalRoad",
    containers=(path(el("div", "chapter-content")), path(el("div", "chapter-inner"))),
    chapter_title=FieldRule(
        (text(path(el("h1", "font-white")), path(el("div", "fic-header"), el("h1")),
              path(el("h1", "chapter-title"))),)
    ),
    toc_rows=either(
        path(el("table", id="chapters"), el("tbody"), el("tr")),
        path(el("table", "chapter-list"), el("tbody"), el("tr")),
    ),
)

SITE_B = Site(
    name="freewebnovel",
    label="FreeWebNovel",
    domains=("freewebnovel.com",),
    url_prefix=r"^(https?://[^/]+/novel/[^/?#]+)",
    title=FieldRule((meta("og:novel:novel_name", "og:title"), text(path(el("h1", "tit")))), "Unknown title"),
    author=FieldRule(
        (meta("og:novel:author"),
         text(path(el("div", "m-book1"), el("div", "txt"), el("div", "item"),
                   el("a", attr="href", prefix="/author/")))),
        "Unknown",
    ),
    description=either(
        path(el("div", "m-desc"), el("div", "txt"), el("div", "inner")),
        path(el("div", "m-desc"), el("div", "txt")),
    ),
    cover=either(
        path(el("div", "m-imgtxt"), el("img", attr="src")), path(el("div", "pic"), el("img", attr="src"))
    ),
    cover_meta=("og:image", "image"),
    tags_meta=("og:novel:genre",),
    tags=path(el("a", attr="href", prefix="/genre/")),
    publisher="FreeWebNovel",
    containers=(path(el(id="article")), path(el("div", "m-read"), el("div", "txt"))),
    chapter_title=FieldRule((meta("og:novel:chapter_name"), text(path(el("span", "chapter"))))),
    ads=(el(None, "reader-ad-skip"), el(attr="id", prefix="bg-ssp"), el(attr="id", prefix="pf-"),
         el(None, "comments-widget")),
    toc_containers=(path(el(id="idData")), path(el("div", "m-newest2"), el("ul", "ul-list5"))),
    toc_pages=path(el("select", id="indexselect"), el("option")),
)
CHAPTER_LINK = "/chapter-"
MAX_LIST_PAGES = 400
# -------------------------------------------------------------------------

SITES = (SITE_A, SITE_B)


def rules_table(spark: SparkSession, sites: tuple[Site, ...] = SITES) -> DataFrame:
    """site_rules: one row per site.

    Built inside the plan from literals, so Catalyst knows that it is tiny.
    """
    rows = [
        F.struct(
            F.lit(s.name).alias("site"),
            F.lit(s.label).alias("label"),
            F.array(*[F.lit(d) for d in s.domains]).alias("domains"),
            F.lit(s.needs_browser).alias("needs_browser"),
            F.lit(s.priority).alias("priority"),
            F.lit(s.url_prefix).cast("string").alias("url_prefix"),
        )
        for s in sites
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
