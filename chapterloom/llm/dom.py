"""A page's block elements with their texts and the features of each."""

from __future__ import annotations

import html
import re

import numpy as np

#: Elements without content, elements whose content is no text of the page, those of them that run to the end of the
#: page if nothing closes them, elements that may stand outside of the body, elements that break lines.
VOID = frozenset(
    ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
)
RAW = frozenset(["script", "style", "iframe", "textarea", "title"])
TO_END = RAW - {"iframe"}
OUTSIDE = frozenset(["html", "head", "body", "base", "link", "meta", "noscript", "script", "style", "template", "title"])
BLOCK = frozenset(
    [
        "html", "head", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details",
        "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
        "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
        "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
    ]
)
#: An open element of the second kind ends where one of the first begins.
_ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
_ENDS_P = BLOCK - {"html", "head", "body", "li", "dd", "dt", "td", "th", "tr", "option", "caption", "legend", "button"}

#: Tokens of class and id that speak for and against main text.
AGAINST = frozenset(
    [
        "ad", "ads", "adv", "advert", "adverts", "advertisement", "alert", "author", "banner", "bar", "breadcrumb", "breadcrumbs",
        "btn", "button", "byline", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "dialog",
        "discussion", "footer", "form", "header", "legal", "links", "login", "masthead", "menu", "meta", "modal", "nav", "navbar", "navigation",
        "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related",
        "reply", "replies", "reviews", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
        "tags", "teaser", "toolbar", "widget",
    ]
)
FOR = frozenset(
    ["article", "body", "content", "entry", "main", "page", "post", "story", "text", "chapter", "prose", "copy"]
)
AWAY = frozenset(
    ["nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "option", "address", "head"]
)
TOWARDS = frozenset(["article", "main"])
PROSE = frozenset(["p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "td", "dd"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*+|\d+")
_SPACE = re.compile(r"\s+")

FEATURES = (
    "depth", "chars", "own", "link_density", "tags", "density", "children", "place", "alike", "punctuation", "prose_tag",
    "heading", "list_item", "away", "towards", "against", "for", "away_above", "towards_above", "against_above", "for_above",
    "share", "prose_inside", "prose_share", "against_inside", "div_like", "page_towards",
)


class Page:
    """Block elements in document order: tag, attr (tokens), parent, and lines (own texts in order).

    What stands outside of head and body is in the body, which is implied where the page does not open one.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.attr, self.parent = ["html"], [frozenset()], [-1]
        self.links, self.marks = [0], [0]
        #: (element, text) for each line, in page order.
        self.lines: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("html", 0)]  # name, block element
        anchor = body = 0
        text: list[str] = []
        size = len(source)
        at = 0

        def flush() -> None:
            if text:
                line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
                text.clear()
                if line:
                    self.lines.append((open_[-1][1], line))

        def close(name: str) -> None:
            nonlocal anchor
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    if any(x[0] in BLOCK for x in open_[k:]):
                        flush()
                    anchor -= sum(x[0] == "a" for x in open_[k:])
                    del open_[k:]
                    return

        def add(name: str, tokens: frozenset) -> int:
            self.tag.append(name)
            self.attr.append(tokens)
            self.parent.append(open_[-1][1])
            self.links.append(0)
            self.marks.append(0)
            return len(self.tag) - 1

        def enter(name: str) -> None:
            """Open the body, again or unseen, if text (an empty name) or an element stands outside of it."""
            nonlocal body
            if self.tag[open_[-1][1]] == "head" and (not name or name in BLOCK and name != "head"):
                close("head")
            if open_[-1][1] == 0 and name not in OUTSIDE:
                flush()
                body = body or add("body", frozenset())
                open_.append(("body", body))

        while at < size:
            found = _TOKEN.search(source, at)
            if found is None:
                piece = source[at:]
                at = size
            else:
                piece = source[at : found.start()]
                at = found.end()
            if piece:
                if not piece.isspace():
                    enter("")
                text.append(piece)
                if anchor:
                    self.links[open_[-1][1]] += len(piece)
            if found is None or found[2] is None:
                continue
            name = found[2].lower()
            if not found[1]:
                enter(name)
            self.marks[open_[-1][1]] += 1
            if found[1]:
                close(name)
                continue
            if name in ("html", "body") and any(x[0] == name for x in open_):
                continue
            if name in BLOCK or name == "br":
                if name in _ENDS_P and any(x[0] == "p" for x in open_):
                    close("p")
                for other in _ENDED_BY.get(name, ()):
                    for k in range(len(open_) - 1, 0, -1):
                        if open_[k][0] in ("ul", "ol", "dl", "table", "select"):
                            break
                        if open_[k][0] == other:
                            close(other)
                            break
                if name == "br":
                    text.append(" ")
                    continue
                flush()
            if name in RAW and not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*+[^>]*+(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size if name in TO_END else at
                continue
            if name in BLOCK and name not in VOID:
                tokens = frozenset(
                    w.lower() for m in _ATTR.finditer(found[3]) for w in _WORDS.findall(m[2])
                ) if found[3] else frozenset()
                if name == "body" and body:  # one that was implied before
                    self.attr[body] |= tokens
                    open_.append((name, body))
                    continue
                new = add(name, tokens)
                if name == "body":
                    body = new
                if not found[3].endswith("/"):
                    open_.append((name, new))
            elif name not in VOID and not found[3].endswith("/"):
                open_.append((name, open_[-1][1]))
                anchor += name == "a"
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        own, commas = [0] * n, [0] * n
        for i, line in self.lines:
            own[i] += len(line)
            commas[i] += line.count(",") + line.count(".") + line.count(";")
        chars, links, marks, points = own[:], self.links[:], self.marks[:], commas[:]
        prose = [o if t in PROSE else 0 for o, t in zip(own, self.tag, strict=True)]
        against = [len(a & AGAINST) > 0 or t in AWAY for a, t in zip(self.attr, self.tag, strict=True)]
        bad = [own[i] if against[i] else 0 for i in range(n)]
        count = [0] * n
        kinds: dict[tuple[int, str], int] = {}
        place = [0] * n
        for i in range(1, n):
            p = parent[i]
            place[i] = count[p]
            count[p] += 1
            kinds[p, self.tag[i]] = kinds.get((p, self.tag[i]), 0) + 1
        paragraphs = [t == "p" for t in self.tag]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            marks[p] += marks[i]
            points[p] += points[i]
            prose[p] += prose[i]
            bad[p] += chars[i] if against[i] else bad[i]
            paragraphs[p] += paragraphs[i]
        total = max(1, chars[0])
        rows = []
        above = [(0, 0, 0, 0, 0)] * n
        page_towards = any(t in TOWARDS for t in self.tag)
        for i in range(n):
            tag, attr = self.tag[i], self.attr[i]
            up = above[parent[i]] if i else (0, 0, 0, 0, -1)
            away, towards = tag in AWAY, tag in TOWARDS
            con, pro = len(attr & AGAINST), len(attr & FOR)
            above[i] = (up[0] or away, up[1] or towards, up[2] or con > 0, up[3] or pro > 0, up[4] + 1)
            p = parent[i] if i else 0
            rows.append(
                (
                    up[4] + 1, np.log1p(chars[i]), np.log1p(own[i]), links[i] / max(1, chars[i]), np.log1p(marks[i]),
                    chars[i] / (1 + marks[i]), count[i], place[i], kinds.get((p, tag), 1), points[i] / max(1, chars[i]),
                    tag in PROSE, tag[0] == "h" and len(tag) == 2, tag in ("li", "ul", "ol"), away, towards, con, pro,
                    up[0], up[1], up[2], up[3], chars[i] / total, paragraphs[i], prose[i] / max(1, chars[i]),
                    bad[i] / max(1, chars[i]), tag in ("div", "section"), page_towards,
                )
            )
        return np.array(rows, float)

    def own_sizes(self) -> np.ndarray:
        out = np.zeros(len(self.tag))
        for i, line in self.lines:
            out[i] += len(line)
        return out
