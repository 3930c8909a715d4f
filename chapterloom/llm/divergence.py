"""How far the sources of a language differ in the terms they use, by chunk factorization.

Chunks are what white space parts. Each document's chunks are counted; each chunk
that occurs anywhere is split into terms once, in a table of all chunks, and its
terms are joined back by way of the slices' chunk lists (``lexicon``). Documents and
occurrences are then counted by term, distinct within a document.

A term can be in ``least`` documents of a language only if its chunks are in as many taken
together, so other terms are left out before anything is joined back: none of them
can be kept.

The sum over all kept terms of how two sources differ is taken in blocks of terms, each against
tiles of ``TILE`` by ``TILE`` sources: a task holds a block's rows of two tiles, never a language.

Defined results: null text, language and source are empty strings; every row of the table is a document of its own;
a group without terms has the share of a count of 0; a language without kept terms gives pairs of value 0; an empty
table gives no rows; doc_id and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon, textbytes as B
from ..operators.ordering import top_k
from .frames import column
from .lexicon import stored

#: Shares are whole numbers of this many parts; each kept term has so many more occurrences than were seen.
PARTS, PRIOR = 1_000_000_000, 5
#: Sources to a tile, the least rows to a block of terms and tile, and terms that are compared at once.
TILE, BLOCK_ROWS, STEP = 256, 20_000, 1024
#: Bytes of text to a slice: the larger, the fewer chunks are looked up.
SLICE = 16 << 20
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_SLICED = (
    "slice long, lang string, words array<string>, n array<long>, sources array<string>, sizes binary, chunks binary, counts binary"
)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(
        *[F.coalesce(column(docs, c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    )


def _sliced(docs: DataFrame) -> DataFrame:
    """A row a slice and language: distinct chunks with the number of documents that hold each, and each document's chunk counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, raw, offsets in lexicon.slices(batches, "text", SLICE):
            words = lexicon.Words(raw, offsets, B.VISIBLE)
            width = max(1, len(words))
            key, count = np.unique(words.row.astype(np.int64) * width + words.numbers, return_counts=True)
            doc, chunk = np.divmod(key, width)
            langs = rows.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(langs.dictionary.to_pylist()):
                docs_of = np.flatnonzero(code == k)
                own = np.flatnonzero(code[doc] == k)
                held, local, n = np.unique(chunk[own], return_inverse=True, return_counts=True)
                sizes = np.bincount(doc[own], minlength=rows.num_rows)[docs_of]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.array([name]), lexicon.as_list(words.listed.take(pa.array(held)).cast(pa.string())),
                        lexicon.as_list(pa.array(n)), lexicon.as_list(rows.column("source").take(pa.array(docs_of))),
                        lexicon.as_bytes(sizes), lexicon.as_bytes(local), lexicon.as_bytes(count[own], "<i8"),
                    ],
                    ["slice", "lang", "words", "n", "sources", "sizes", "chunks", "counts"],
                )
                number += 1

    return lexicon.stored_slices(_narrow(docs).mapInArrow(cut, _SLICED), "chunk-slices")


def occurrences(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, id) and their counts (id, source, n), no row where there are none."""
    sliced = _sliced(docs)
    chunks = stored(
        sliced.select("lang", F.explode(F.arrays_zip("words", "n")).alias("x"))
        .groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.n").alias("docs")), "chunks",
    )
    # Each chunk is split once, whatever the number of languages that use it.
    terms = chunks.groupBy("word").agg(F.collect_list(F.struct("lang", "docs")).alias("uses")).select(
        "word", "uses", F.regexp_extract_all("word", F.lit(_TERM), F.lit(0)).alias("terms")
    ).where(F.size("terms") > 0)
    split = stored(terms.select("word", "terms", F.explode("uses").alias("use")).select("word", "terms", "use.*"), "chunk-terms")
    bounds = split.select("lang", "docs", F.explode(F.array_distinct("terms")).alias("term")).groupBy("lang", "term").agg(
        F.sum("docs").alias("most")
    )
    candidates = lexicon.numbered(bounds.where(F.col("most") >= least).select("lang", "term"), "term-candidates")
    # A term that a chunk holds twice is listed twice.
    holds = split.select("lang", "word", F.explode("terms").alias("term")).join(candidates, ["lang", "term"])
    asked = lexicon.looked_up(sliced, holds.select("lang", "word", "id"), "lang")
    found = lexicon.answered(
        sliced.drop("lang"), asked, F.collect_list(lexicon.packed(F.col("place"), F.col("id"))).alias("found")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lexicon.each(batches, 8):
            lists = batch.column("found")
            for i in range(batch.num_rows):
                if not lists[i].is_valid or not len(lists[i]):
                    continue
                place, term = lexicon.unpacked(lists[i].values.to_numpy())
                numbers, term = np.unique(term, return_inverse=True)
                sizes, chunk, count = (lexicon.of_bytes(batch.column(c), i, t) for c, t in _BYTES)
                term = term[np.argsort(place, kind="stable")]
                ends = np.cumsum(np.bincount(place, minlength=int(max(place.max(), chunk.max())) + 1))
                low = np.concatenate([[0], ends])[chunk]
                times = ends[chunk] - low
                at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), times)
                key, back = np.unique(doc * np.int64(len(numbers)) + term[at], return_inverse=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, back, np.repeat(count, times))
                doc, term = np.divmod(key, len(numbers))
                sources = batch.column("sources")[i].values.dictionary_encode()
                code = sources.indices.to_numpy(zero_copy_only=False)[doc]
                key, back = np.unique(code.astype(np.int64) * len(numbers) + term, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, back, n)
                code, term = np.divmod(key, len(numbers))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers[term]), sources.dictionary.take(pa.array(code)), pa.array(total),
                        pa.array(np.bincount(back, minlength=len(key))),
                    ],
                    ["id", "source", "n", "docs"],
                )

    by_source = stored(
        found.select("sources", "sizes", "chunks", "counts", "found")
        .mapInArrow(counted, "id long, source string, n long, docs long")
        .groupBy("id", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-sources",
    )
    kept = by_source.groupBy("id").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least)
    terms = stored(candidates.join(kept, "id").select("lang", "term", "id", "n"), "kept-terms")
    return terms, by_source.select("id", "source", "n")


_BYTES = (("sizes", "<i4"), ("chunks", "<i4"), ("counts", "<i8"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(PARTS (n + PRIOR) / (total + PRIOR kept)) in whole numbers of up to 38 digits."""
    top = f"cast({PARTS} * cast({n} + {PRIOR} as decimal(19,0)) as decimal(30,0))"
    return F.expr(f"1 + ({top} div cast({total} + {PRIOR} * {kept} as decimal(19,0)))")


def _summed(key: tuple, rows: pa.Table, size: int) -> pa.Table:
    """Over the terms of a block: by how much |p1 - p2| is more than |b1 - b2|, for each pair of sources of two tiles."""
    lang, _, low, high = (k.as_py() for k in key)
    group, p, base = (rows.column(c).to_numpy() for c in ("group", "p", "base"))
    marker = rows.column("id").is_null().to_numpy()
    listed, term = np.unique(rows.column("id").fill_null(-1).to_numpy(), return_inverse=True)
    sides = []
    for tile in (low, high):
        own = group // size == tile
        names, at = np.unique(group[own], return_inverse=True)
        b = np.zeros(len(names), np.int64)
        b[at] = base[own]
        sides.append((names, b, at[~marker[own]], term[own & ~marker], p[own & ~marker]))
    (left, left_base, *_), (right, right_base, *_) = sides
    sums = np.zeros((len(left), len(right)), np.int64)
    apart = np.abs(left_base[:, None] - right_base)
    for begin in range(0, len(listed), STEP):
        width = min(STEP, len(listed) - begin)
        dense = []
        for _, b, at, t, share in sides:
            full = np.repeat(b[:, None], width, 1)
            inside = (t >= begin) & (t < begin + width)
            full[at[inside], t[inside] - begin] = share[inside]
            dense.append(full)
        for i in range(len(left)):
            sums[i] += np.abs(dense[0][i] - dense[1]).sum(1) - apart[i] * width
    one, two = np.meshgrid(left, right, indexing="ij")
    keep = one < two
    values = [one[keep], two[keep], sums[keep]]
    return pa.table([pa.array([lang] * len(values[0]), pa.string()), *map(pa.array, values)], ["lang", "one", "two", "extra"])


def _pairs(shares: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """(lang, source, item, value): each source of a language with each other one.

    A block of terms comes with a marker for every source of its language, which holds the source's share of a count
    of 0. Blocks hold so many rows that sources, markers and partial sums stay fewer than rows.
    """
    columns = ["lang", "block", "tiles", "id", "group", "p", "base"]
    real = shares.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select(columns)
    markers = groups.withColumns(
        {
            "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "id": F.lit(None).cast("long"),
            "p": F.lit(0).cast("long"),
        }
    ).select(columns)
    tiles = F.floor(F.col("group") / tile)
    dealt = real.union(markers).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "lang", "block", F.least(tiles, "other").alias("low"), F.greatest(tiles, "other").alias("high"), "id", "group", "p", "base",
    )

    def summed(key: tuple, block: pa.Table) -> pa.Table:
        return _summed(key, block, tile)

    sums = (
        # Dealt out by all four: a language that earlier steps have together must not stay so.
        dealt.repartition("lang", "block", "low", "high").groupBy("lang", "block", "low", "high").applyInArrow(summed, "lang string, one long, two long, extra long")
        .groupBy("lang", "one", "two").agg(F.sum("extra").alias("extra"))
    )

    def named(end: str, to: str) -> DataFrame:
        return groups.select("lang", F.col("group").alias(end), F.col("source").alias(to), F.col("base").alias(f"{to}_base"), "kept")

    both = sums.join(named("one", "source"), ["lang", "one"]).join(named("two", "item").drop("kept"), ["lang", "two"]).select(
        "lang", "source", "item", (F.col("extra") + F.col("kept") * F.abs(F.col("source_base") - F.col("item_base"))).alias("value")
    )
    ends = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return both.select("lang", "value", ends.alias("e")).select("lang", "e.source", "e.item", "value")


def divergence(docs: DataFrame, least: int = 30, best: int = 50, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): all ``pair`` values, and the ``best`` terms of each group.

    ``pair``: item is another source of the language, value the sum over all kept terms of the difference of shares.
    ``term``: item is a term of which the group has a greater share than its language, value by how much.
    """
    terms, counts = occurrences(docs, least)
    sources = stored(_narrow(docs).select("lang", "source").distinct(), "groups")
    by_term = counts.join(terms.select("lang", "term", "id"), "id")
    in_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    in_group = by_term.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    of_lang = Window.partitionBy("lang")
    rows = F.sum("terms").over(of_lang)
    several = F.count(F.lit(1)).over(of_lang)
    tiles = F.floor((several - 1) / tile) + 1
    # As many rows to a block as it has partial sums, or more.
    least_rows = F.greatest(F.lit(block_rows), F.least(several, F.lit(tile)) * F.least(several, F.lit(tile)))
    # A row a group: a language has as many as it has sources.
    groups = stored(
        sources.join(in_lang, "lang", "left").join(in_group, ["lang", "source"], "left").fillna(0, ["kept", "lang_total", "total", "terms"])
        .withColumn("group", F.row_number().over(of_lang.orderBy("source")).cast("long") - 1)
        .withColumn("tiles", tiles)
        .withColumn("blocks", F.greatest(F.ceil(rows / (least_rows * F.col("tiles"))), F.lit(1)))
        .withColumn("base", F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(0)), "group-totals",
    )
    shares = stored(
        counts.join(terms.select("lang", "term", "id", F.col("n").alias("lang_n")), "id").join(groups, ["lang", "source"])
        .withColumns({"p": _share("n", "total", "kept"), "q": _share("lang_n", "lang_total", "kept")})
        .select("lang", "source", "term", "id", "group", "tiles", "blocks", "p", "q", "base"), "term-shares",
    )
    over = shares.where((F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = top_k(over, ["lang", "source"], [F.col("value").desc(), F.col("item").asc()], best).withColumn("part", F.lit("term"))
    pairs = _pairs(shares, groups, tile)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ordered = pairs.withColumns({"rank": F.row_number().over(order), "part": F.lit("pair")})
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ordered.select(columns).union(ranked.select(columns))
