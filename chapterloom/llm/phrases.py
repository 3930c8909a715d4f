"""Collocations: counts of padded longest windows, summed to shorter phrases by ROLLUP.

Every word leads one window of ``LONGEST`` words that stand behind it in its piece of
text; a window that runs past the piece is padded. Only windows are counted. A
ROLLUP over the columns of the window then gives the counts of all shorter phrases,
since a phrase occurs once for each window that begins with it: no n-gram but the longest
is ever listed.

The one large shuffle is that of the windows, by their first two words; pairs, windows and what is left for ROLLUP are
summed where they lie. Windows of pairs that are too rare for a candidate go before ROLLUP, and of the others those
that are too rare themselves count as padded behind the pair: sums over prefixes stay as they are.

Words that occur fewer than ``least`` times in their language cannot be part of a
candidate, nor of a part of one: they stand as padding, and windows that they lead are
left out. Languages are part of a word's number, so windows need no column for them.

Defined results: null text is empty, null language is ``und``; rows repeated count
again; a table without words gives no rows; doc_id and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon, textbytes as B
from ..operators.ordering import top_k
from .frames import column
from .lexicon import stored

LONGEST = 3
SHARES = 32
#: Bytes of text to a slice: the larger, the fewer words are looked up.
SLICE = 16 << 20
#: Bytes that end a piece, and those that part words within one.
_STOPS = B.byte_class([*b".,;:!?", *range(0x0A, 0x0E)])
_WORD = ~(_STOPS | B.byte_class([0x20, 0x09]))

_SLICED = "slice long, lang string, words array<string>, n array<long>, ids binary"


def _sliced(docs: DataFrame) -> DataFrame:
    """A row a slice and language; the first word of a piece has a negative number."""
    narrow = docs.select(
        F.coalesce(column(docs, "lang").cast("string"), F.lit("und")).alias("lang"),
        column(docs, "text").cast("string").alias("text"),
    ).where("text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, raw, offsets in lexicon.slices(batches, "text", SLICE):
            words = lexicon.Words(raw, offsets, _WORD)
            if not len(words):
                continue
            stops = np.concatenate([[0], np.cumsum(_STOPS[raw], dtype=np.int32)])
            breaks = np.ones(len(words.starts), bool)
            breaks[1:] = stops[words.starts[1:]] > stops[words.ends[:-1]]
            breaks[words.first[:-1][np.diff(words.first) > 0]] = True
            langs = rows.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)[words.row]
            for k, name in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(lang == k)
                if not len(own):
                    continue
                held, local, n = np.unique(words.numbers[own], return_inverse=True, return_counts=True)
                ids = np.where(breaks[own], -1 - local, local)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.array([name]), lexicon.as_list(words.listed.take(pa.array(held)).cast(pa.string())),
                        lexicon.as_list(pa.array(n)), lexicon.as_bytes(ids),
                    ],
                    ["slice", "lang", "words", "n", "ids"],
                )
                number += 1

    return lexicon.stored_slices(narrow.mapInArrow(cut, _SLICED), "phrase-slices")


def _counted(codes: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of small numbers below ``base`` and how often each occurs."""
    if base ** len(codes) < 1 << 62:
        key = codes[0].astype(np.int64)
        for c in codes[1:]:
            key = key * base + c
        key, n = np.unique(key, return_counts=True)
        out = []
        for _ in codes:
            key, last = np.divmod(key, base)
            out.append(last)
        return out[::-1], n
    rows, n = np.unique(np.stack(codes, 1), axis=0, return_counts=True)
    return list(rows.T), n


def windows(sliced: DataFrame, words: DataFrame) -> DataFrame:
    """(w1, w2, w3, n): windows by the numbers of their words, 0 for padding, counted a slice."""
    asked = lexicon.looked_up(sliced, words.select("lang", "word", "id"), "lang")
    found = lexicon.answered(
        sliced.drop("lang"), asked, F.collect_list(lexicon.packed(F.col("place"), F.col("id"))).alias("found")
    )

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lexicon.each(batches, 8):
            lists, texts = batch.column("found"), batch.column("ids")
            for i in range(batch.num_rows):
                if not lists[i].is_valid or not len(lists[i]):
                    continue
                place, number = lexicon.unpacked(lists[i].values.to_numpy())
                ids = lexicon.of_bytes(texts, i)
                opens = ids < 0
                local = np.where(opens, -1 - ids, ids)
                # Places among the words with a number, from 1; all others are 0.
                small = np.zeros(max(int(local.max()), int(place.max())) + 1, np.int64)
                small[place] = np.arange(1, len(place) + 1)
                numbers = np.concatenate([[0], number])
                lead = [small[local]]
                on = np.ones(len(ids), bool)
                for k in range(1, LONGEST):
                    on[len(ids) - k :] = False
                    on[: len(ids) - k] &= ~opens[k:]
                    behind = np.zeros(len(ids), np.int64)
                    behind[: len(ids) - k] = lead[0][k:]
                    behind[~on] = 0
                    on &= behind > 0
                    lead.append(behind)
                own = lead[0] > 0
                rows, n = _counted([c[own] for c in lead], len(place) + 1)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(numbers[c]) for c in rows), pa.array(n)], [*(f"w{k + 1}" for k in range(LONGEST)), "n"]
                )

    found = lexicon.stored_slices(found.select("ids", "found"), "phrase-numbers")
    return found.mapInArrow(led, ", ".join(f"w{k + 1} long" for k in range(LONGEST)) + ", n long")


def _score(l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), in whole numbers of up to 38 digits."""
    top = "cast(cast(1000000 * cast(a as decimal(15,0)) as decimal(22,0)) * cast(a as decimal(15,0)) as decimal(38,0))"
    bottom = f"cast(cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)) as decimal(37,0))"
    return F.expr(f"{top} div {bottom}")


def collocations(docs: DataFrame, least: int = 10, best: int = 2000, within: int = 50) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``least``: occurrences of a candidate; ``within``: a candidate goes if a longer one that holds it has this
    many hundredths of its occurrences.
    """
    sliced = _sliced(docs)
    every = stored(
        sliced.select("lang", F.explode(F.arrays_zip("words", "n")).alias("x")).groupBy("lang", F.col("x.words").alias("word"))
        .agg(F.sum("x.n").alias("f")), "phrase-words",
    )
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = lexicon.numbered(every.where(F.col("f") >= least), "phrase-frequent")
    dealt = windows(sliced, words).where("w2 > 0").repartition("w1", "w2")
    counted = dealt.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n"))
    often = counted.groupBy("w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= least).select("w1", "w2")
    able = counted.join(often.hint("shuffle_hash"), ["w1", "w2"]).withColumn("w3", F.when(F.col("n") >= least, F.col("w3")).otherwise(0))
    rolled = able.rollup("w1", "w2", "w3").agg(
        F.sum("n").alias("a"), F.grouping("w2").alias("no2"), F.grouping("w3").alias("no3")
    )
    # Sums over a prefix; one whose last word is padding is no phrase.
    phrases = stored(
        rolled.where((F.col("a") >= least) & (F.col("no2") == 0) & (F.col("w2") > 0) & ((F.col("no3") == 1) | (F.col("w3") > 0)))
        .select("w1", "w2", F.when(F.col("no3") == 0, F.col("w3")).alias("w3"), "a"), "phrases",
    )
    pairs = phrases.where("w3 IS NULL").select("w1", "w2", "a")
    triples = phrases.where("w3 IS NOT NULL")

    def word(k: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"))

    first = words.select(F.col("id").alias("w1"), F.col("word").alias("t1"), F.col("f").alias("f1"), "lang")
    inside = (
        triples.select("w1", "w2", F.col("a").alias("over"))
        .union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("over").alias("over"))
    )
    two = (
        pairs.join(inside, ["w1", "w2"], "left").where(F.col("over").isNull() | (100 * F.col("over") < within * F.col("a")))
        .join(first, "w1").join(word(2), "w2")
        .select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
        .withColumn("score", _score("l", "r"))
    )
    three = (
        triples.join(pairs.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"])
        .join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
        .join(first, "w1").join(word(2), "w2").join(word(3), "w3")
        .withColumns({"one": _score("f1", "f23"), "two": _score("f12", "f3")})
        .withColumn("early", F.col("one") <= F.col("two"))
        .select(
            "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
            F.when(F.col("early"), F.col("f1")).otherwise(F.col("f12")).alias("l"),
            F.when(F.col("early"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
            F.least("one", "two").alias("score"),
        )
    )
    # The best of each share of a language first: one task then ranks no more than so many times ``best``.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    shared = two.union(three).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    ranked = top_k(top_k(shared, ["lang", "share"], order, best).drop("rank", "share"), ["lang"], order, best)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
