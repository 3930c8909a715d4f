"""Raw HTML to a node array: the one step that needs a Python worker.

Each page becomes one ARRAY<STRUCT> in document order, so every later cleaning
rule is a higher-order function inside the page's own row: no shuffle, no
exploded rows, and a group is never larger than one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

NODE_TYPE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),      # 1-based, document order
        T.StructField("parent", T.IntegerType()),  # 0 at the top
        T.StructField("last", T.IntegerType()),    # id of the last descendant (or self)
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),     # el, tx, css, js, other
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)

_ARROW_NODE = pa.struct(
    [
        ("id", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()),
        ("kind", pa.string()), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    ]
)

# Elements that never hold content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW_KIND = {"style": "css", "script": "js", "template": "other"}


class _Nodes(HTMLParser):
    """Flat pre-order list of one page; an end tag closes the nearest open match."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.count: dict[str, int] = {}

    def _add(self, kind: str, tag: str | None, attrs: dict | None, text: str | None) -> int:
        number = len(self.rows) + 1
        parent = self.open[-1] if self.open else 0
        self.rows.append([number, parent, number, len(self.open), kind, tag, attrs, text])
        return number

    def _shut(self) -> None:
        row = self.rows[self.open.pop() - 1]
        row[2] = len(self.rows)
        self.count[row[5]] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        number = self._add("el", tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(number)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        while self.count.get(tag):
            nearest = self.rows[self.open[-1] - 1][5]
            self._shut()
            if nearest == tag:
                break

    def handle_data(self, data: str) -> None:
        around = self.rows[self.open[-1] - 1][5] if self.open else None
        self._add(_RAW_KIND.get(around, "tx"), None, None, data)

    def handle_comment(self, data: str) -> None:
        self._add("other", None, None, data)

    handle_decl = handle_pi = unknown_decl = handle_comment

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self._shut()
        return self.rows


# Declarations that the standard parser refuses; HTML reads them as comments.
_ODD_DECLARATION = re.compile(r"<!\[(?!CDATA\[)([^>]*)>?")


def try_parse(html: str | None) -> list[list] | None:
    """Nodes of one page; None if it cannot be parsed."""
    try:
        parser = _Nodes()
        parser.feed(_ODD_DECLARATION.sub(r"<!--\1-->", html or ""))
        return parser.finish()
    except (AssertionError, ValueError, RecursionError):
        return None


def parse_nodes(html: str | None) -> list[list]:
    """Nodes of one page. Whatever a page holds, it never fails: what cannot be parsed has no nodes."""
    return try_parse(html) or []


def _node_array(pages: list[list[list]]) -> pa.Array:
    offsets, rows = [0], []
    for page in pages:
        rows.extend(page)
        offsets.append(len(rows))
    columns = list(zip(*rows)) if rows else [[] for _ in _ARROW_NODE]
    arrays = []
    for field, values in zip(_ARROW_NODE, columns):
        if field.name == "attrs":
            values = [None if v is None else list(v.items()) for v in values]
        arrays.append(pa.array(values, type=field.type))
    struct = pa.StructArray.from_arrays(arrays, fields=list(_ARROW_NODE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


# Rows per outgoing batch: keeps a worker's memory to a few dozen pages.
_ROWS = 64


def with_nodes(df: DataFrame, html: str = "html", drop_html: bool = True, parsed: str | None = None) -> DataFrame:
    """Append ``nodes`` to each row; the page text itself is dropped by default.

    A page that cannot be parsed has no nodes; a column named ``parsed``, if
    asked for, tells it from an empty one.

    Works partition by partition, without a shuffle. Input columns that are
    not needed downstream should be pruned before, since they pass through
    the worker.
    """
    kept = [f for f in df.schema.fields if not (drop_html and f.name == html)]
    told = [T.StructField(parsed, T.BooleanType())] if parsed else []
    schema = T.StructType([*kept, T.StructField("nodes", T.ArrayType(NODE_TYPE)), *told])
    names = [f.name for f in kept]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = part.column(part.schema.get_field_index(html)).to_pylist()
                pages = [try_parse(text) for text in texts]
                made = [_node_array([page or [] for page in pages])]
                if parsed:
                    made.append(pa.array([page is not None for page in pages], pa.bool_()))
                carried = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*carried, *made], schema.names)

    return df.mapInArrow(tokenise, schema)
