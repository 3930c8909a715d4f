"""Class-based n-grams: exchange clustering gives words classes, and those a smoothed model of texts.

A token is a word or the end of a text. The probability of a token is

    P(class | classes of the two known tokens before it) P(token | class),

transitions smoothed by Witten and Bell's rule from the longer to the shorter context. Of
every word of the training texts the occurrences are counted and every word has a class.

* Exchange (``exchanged``): the ``HEADS`` most frequent words start in classes by their commonest follower and
  are moved, in rounds, to where the likelihood of the class bigrams gains most. Counts of pairs of them
  come from all training texts and are stored as one row a word, so a round is a job without a shuffle;
  only the table of class pairs, of fixed size, is sent about.
* All other words (``placed``) take one exchange step with the settled classes, by all their neighbours that have one.
* Texts are coded once by their slices' word lists (``lexicon``); transitions are counted over all training texts.

A word that no training text holds has a share of n1 / N (Good and Turing) of the whole, divided by the number
of unseen words that n1 and n2 let expect (Chao), n1 and n2 words met once and twice. It leaves no context: the tokens known
before it stay the context.

Defined results: null text is empty, its tokens are the end alone; null doc_ids are training
texts; rows repeated count again; without training texts every score is 0; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon, textbytes as B
from .frames import column
from .lexicon import stored

#: Classes (the first is that of the end alone), words that are exchanged in rounds and how long they may be, rounds.
CLASSES, HEADS, HEAD_BYTES, ROUNDS = 64, 16_384, 64, 12
#: Bits for the number of a head beside how often it was met.
HEAD_BITS = 20
#: Heads whose neighbours are handled at once.
ROWS = 256
#: Candidate classes of a word whose exact gain is taken.
TRIED = 4
UNKNOWN = 255
_SLICED = "slice long, words array<string>, n array<long>, doc_ids array<{id}>, held binary, sizes binary, ids binary"


def fold(doc_id: Column) -> Column:
    """True for the test fold: crc32 of the id as text leaves 1 on division by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _sliced(docs: DataFrame, held_out: Column) -> DataFrame:
    """A row a slice: its words with their occurrences in training texts, and every text as places of words, -1 for its end."""
    narrow = docs.select(
        column(docs, "doc_id").alias("doc_id"), held_out.alias("held"), F.coalesce(column(docs, "text").cast("string"), F.lit("")).alias("text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, raw, offsets in lexicon.slices(batches, "text"):
            words = lexicon.Words(raw, offsets, B.VISIBLE)
            held = rows.column("held").to_numpy(zero_copy_only=False).astype(bool)
            n = np.bincount(words.numbers[~held[words.row]], minlength=len(words))
            sizes = np.diff(words.first) + 1
            ids = np.full(len(words.numbers) + len(sizes), -1, np.int32)
            ids[np.arange(len(words.numbers)) + words.row] = words.numbers
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]), lexicon.as_list(words.listed.cast(pa.string())), lexicon.as_list(pa.array(n)),
                    lexicon.as_list(rows.column("doc_id")), lexicon.as_bytes(held, "?"), lexicon.as_bytes(sizes), lexicon.as_bytes(ids),
                ],
                ["slice", "words", "n", "doc_ids", "held", "sizes", "ids"],
            )
            number += 1

    id_type = dict(narrow.dtypes)["doc_id"]
    return lexicon.stored_slices(narrow.mapInArrow(cut, _SLICED.format(id=id_type)), "lm-slices")


def _training(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Training texts of a slice as one run of places of words; -1 ends each text."""
    ids, sizes, held = (lexicon.of_bytes(batch.column(c), i, t) for c, t in (("ids", "<i4"), ("sizes", "<i4"), ("held", "?")))
    return ids[np.repeat(~held, sizes)]


def _of_words(table: np.ndarray, end: int, ids: np.ndarray) -> np.ndarray:
    """What a slice's table says of each token; ``end`` for ends."""
    return np.append(table, end)[ids]


def _places(words: pa.Array, heads: pa.Array) -> np.ndarray:
    """Number of each word among the heads, from 1; -1 for others."""
    found = pc.index_in(words, value_set=heads)
    return pc.fill_null(pc.add(found, 1), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def neighbours(sliced: DataFrame, heads: pa.Array) -> DataFrame:
    """(w, left, right): of each head, 0 being the end, the heads beside it and how often, packed into one number each."""
    width = len(heads) + 1

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lexicon.each(batches):
            for i in range(batch.num_rows):
                tokens = _of_words(_places(batch.column("words")[i].values, heads), 0, _training(batch, i))
                before = np.concatenate([[0], tokens[:-1]])
                both = (tokens >= 0) & (before >= 0)
                pair, n = np.unique(before[both] * width + tokens[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair // width), pa.array(pair % width), pa.array(n)], ["a", "b", "n"])

    pairs = sliced.select("words", "held", "sizes", "ids").mapInArrow(paired, "a long, b long, n long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    sides = F.explode(
        F.array(
            F.struct(F.col("b").alias("w"), F.lit(0).alias("side"), (F.shiftleft("n", HEAD_BITS) + F.col("a")).alias("x")),
            F.struct(F.col("a").alias("w"), F.lit(1).alias("side"), (F.shiftleft("n", HEAD_BITS) + F.col("b")).alias("x")),
        )
    )

    def lists(side: int) -> Column:
        return F.collect_list(F.when(F.col("side") == side, F.col("x")))

    return lexicon.stored_slices(
        pairs.select(sides.alias("s")).select("s.*").groupBy("w").agg(lists(0).alias("left"), lists(1).alias("right")), "lm-neighbours"
    )


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * _log(x)


def _beside(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a list column: row, head, how often."""
    lists = batch.column(side)
    x = lists.flatten().to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), x & ((1 << HEAD_BITS) - 1), x >> HEAD_BITS


def _by_class(batch: pa.RecordBatch, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a batch's words, and their neighbours to the left and right counted by class."""
    words = batch.column("w").to_numpy()
    sides = []
    for name in ("left", "right"):
        row, other, n = _beside(batch, name)
        sides.append(np.bincount(row * CLASSES + classes[other], n, len(words) * CLASSES).reshape(len(words), CLASSES))
    return words, *sides


def _seeded(table: DataFrame, heads: int) -> np.ndarray:
    """First classes: a word's commonest follower that is not itself, over the classes but the end's in turn."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lexicon.each(batches, ROWS):
            words = batch.column("w").to_numpy()
            row, other, n = _beside(batch, "right")
            best = np.zeros(len(words), np.int64)
            np.maximum.at(best, row, np.where(other == words[row], 0, (n << HEAD_BITS) + other))
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(best & ((1 << HEAD_BITS) - 1))], ["w", "best"])

    classes = 1 + np.arange(heads + 1) % (CLASSES - 1)
    classes[0] = 0
    for r in table.select("w", "right").mapInArrow(first, "w long, best long").collect():
        if r.w:
            classes[r.w] = 1 + r.best % (CLASSES - 1)
    return classes


def _pair_counts(table: DataFrame, classes: np.ndarray) -> np.ndarray:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, CLASSES))
        for batch in lexicon.each(batches, ROWS):
            words, left, right = _by_class(batch, classes)
            np.add.at(total, classes[words], right)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES**2)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    rows = table.mapInArrow(summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES**2)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(CLASSES, CLASSES)


def _likelihood(pairs: np.ndarray) -> float:
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def _affinity(pairs: np.ndarray) -> np.ndarray:
    """How much more often than by chance one class follows another, as a logarithm."""
    return _log(pairs + 0.1) - _log(pairs.sum(1) + 1)[:, None] - _log(pairs.sum(0) + 1)[None, :]


def gains(pairs: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the class to move to and what the likelihood gains as it leaves the one and joins the other.

    Candidates are the classes of highest first-order gain.
    """
    affinity = _affinity(pairs)
    first = left @ affinity + right @ affinity.T
    first[:, 0] = -np.inf
    tried = np.argsort(-first, axis=1)[:, :TRIED]
    ends, begins = pairs.sum(0), pairs.sum(1)

    def change(at: np.ndarray, sign: float) -> np.ndarray:
        """What the likelihood changes if a word joins (or leaves) classes ``at``."""
        into, out = pairs[:, at].T, pairs[at]
        part = _xlogx(np.maximum(into + sign * left, 0)) - _xlogx(into) + _xlogx(np.maximum(out + sign * right, 0)) - _xlogx(out)
        a, b = left.sum(1), right.sum(1)
        whole = _xlogx(np.maximum(ends[at] + sign * a, 0)) - _xlogx(ends[at]) + _xlogx(np.maximum(begins[at] + sign * b, 0)) - _xlogx(begins[at])
        return part.sum(1) - whole

    leave = change(own, -1.0)
    best, target = np.zeros(len(own)), own.copy()
    for k in range(tried.shape[1]):
        gain = np.where(tried[:, k] != own, leave + change(tried[:, k], 1.0), 0.0)
        better = gain > best
        best, target = np.where(better, gain, best), np.where(better, tried[:, k], target)
    return target, best


def exchanged(table: DataFrame, heads: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the end (0) and the heads, and the counts of class pairs. A round that loses likelihood is taken back and moves fewer."""
    classes = _seeded(table, heads)
    pairs = _pair_counts(table, classes)
    best, share = _likelihood(pairs), 2
    for k in range(rounds):
        now, known = classes, pairs

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in lexicon.each(batches, ROWS):
                words, left, right = _by_class(batch, now)
                target, gain = gains(known, now[words], left, right)
                pick = (gain > 0) & (words > 0)
                yield pa.RecordBatch.from_arrays([pa.array(words[pick]), pa.array(target[pick])], ["w", "target"])

        trial = classes.copy()
        # A row a head at most. Words move in turns, so that two that belong together do not pass each other.
        for r in table.mapInArrow(moved, "w long, target long").collect():
            if (r.w * 0x9E3779B1 >> 16) % share == k % share:
                trial[r.w] = r.target
        if (trial == classes).all():
            continue
        counts = _pair_counts(table, trial)
        value = _likelihood(counts)
        if value > best:
            classes, pairs, best = trial, counts, value
        else:
            share *= 2
    return classes, pairs


def placed(sliced: DataFrame, heads: pa.Array, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(word, class) of all training words that are no heads, by one exchange step."""
    affinity = _affinity(pairs)
    # Row c: evidence of a neighbour of class c to the left, row CLASSES + c: to the right. Ties go to the smallest class.
    evidence = np.concatenate([affinity, affinity.T])[:, 1:]
    prior = _log(pairs.sum(0) + 1)[1:] * 1e-6

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lexicon.each(batches):
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                of_word = _places(words, heads)
                tokens = _training(batch, i)
                kinds = _of_words(np.where(of_word < 0, -1, classes[of_word]), 0, tokens)
                own = np.flatnonzero(kinds < 0)
                if not len(own):
                    continue
                left = np.where(own > 0, kinds[own - 1], 0)
                right = kinds[own + 1]  # a text's end is never the word itself, so there is a next token
                word = np.concatenate([tokens[own], tokens[own]])
                code = np.concatenate([left, np.where(right < 0, -1, CLASSES + right)])
                order = np.argsort(word, kind="stable")
                word, code = word[order], code[order]
                held = np.unique(word)
                keep = code >= 0
                sizes = np.bincount(np.searchsorted(held, word[keep]), minlength=len(held))
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                codes = pa.BinaryArray.from_buffers(
                    pa.binary(), len(held), [None, pa.py_buffer(at), pa.py_buffer(code[keep].astype(np.uint8))]
                )
                yield pa.RecordBatch.from_arrays([words.take(pa.array(held)), codes], ["word", "codes"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, at = B.flat(_as_text(batch.column("codes")))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            counts = np.bincount(row * (2 * CLASSES) + raw, minlength=batch.num_rows * 2 * CLASSES)
            sums = counts.reshape(batch.num_rows, 2 * CLASSES) @ evidence
            words = batch.column("word")
            runs = words.dictionary_encode()
            number = runs.indices.to_numpy(zero_copy_only=False)
            totals = np.zeros((len(runs.dictionary), CLASSES - 1))
            np.add.at(totals, number, sums)
            names = runs.dictionary
            if last is not None:
                if names[0].as_py() == last:
                    totals[0] += held
                else:
                    yield _class_rows(pa.array([last]), held[None] + prior)
            last, held = names[-1].as_py(), totals[-1]
            if len(names) > 1:
                yield _class_rows(names[:-1], totals[:-1] + prior)
        if last is not None:
            yield _class_rows(pa.array([last]), held[None] + prior)

    seen = sliced.select("words", "held", "sizes", "ids").mapInArrow(beside, "word string, codes binary")
    return seen.repartition("word").sortWithinPartitions("word").mapInArrow(settled, "word string, class long")


def _as_text(codes: pa.Array) -> pa.Array:
    """The same bytes as a string array, whose buffers are read alike."""
    return pa.StringArray.from_buffers(len(codes), codes.buffers()[1], codes.buffers()[2], None, 0, codes.offset)


def _class_rows(words: pa.Array, totals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, pa.array(1 + totals.argmax(1))], ["word", "class"])


def _coded(sliced: DataFrame, words: DataFrame, id_type: str, facts: Facts) -> DataFrame:
    """A row a text: its numbers of tokens, sums of the base and of emissions, and a byte for the class of each token.

    ``words``: word, n, class, size (occurrences of the class).
    """
    found = lexicon.answered(
        sliced, lexicon.looked_up(sliced, words),
        F.collect_list(F.struct(lexicon.packed(F.col("place"), F.col("class")).alias("x"), "n", "size")).alias("found"),
    )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lexicon.each(batches):
            for i in range(batch.num_rows):
                ids, sizes = lexicon.of_bytes(batch.column("ids"), i), lexicon.of_bytes(batch.column("sizes"), i)
                width = int(ids.max()) + 1
                kind = np.full(width + 1, UNKNOWN, np.uint8)
                base_of, emitted = np.full(width + 1, math.log10(0.5)), np.zeros(width + 1)
                if batch.column("found")[i].is_valid:
                    x, n, size = (c.to_numpy() for c in batch.column("found")[i].values.flatten())
                    place, of_class = lexicon.unpacked(x)
                    kind[place], base_of[place], emitted[place] = of_class, np.log10(n + 0.5), np.log10(n / size)
                if facts.ends:  # the last stands for ends, whose number is -1
                    kind[-1], base_of[-1] = 0, math.log10(facts.ends + 0.5)
                first = np.cumsum(sizes) - sizes
                classes = kind[ids]
                unseen = classes == UNKNOWN
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[i].values, pa.array(lexicon.of_bytes(batch.column("held"), i, "?")),
                        pa.array(sizes.astype(np.int64)), pa.array(sizes - np.add.reduceat(unseen.astype(np.int64), first)),
                        pa.array(np.add.reduceat(base_of[ids] - facts.base, first)),
                        pa.array(np.add.reduceat(np.where(unseen, facts.unseen, emitted[ids] + facts.seen), first)),
                        pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(classes)]),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "classes"],
                )

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"
    return stored(found.select("doc_ids", "held", "sizes", "ids", "found").mapInArrow(coded, schema), "lm-coded")


def _contexts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(two classes before, class) of each known token as one number, and its text; a text begins behind two ends."""
    kinds, at = B.flat(_as_text(batch.column("classes")))
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    known = kinds != UNKNOWN
    kinds, row = kinds[known].astype(np.int64), row[known]
    before = []
    for back in (1, 2):
        b = np.zeros(len(kinds), np.int64)
        b[back:] = np.where(row[back:] == row[:-back], kinds[:-back], 0)
        before.append(b)
    return (before[1] * CLASSES + before[0]) * CLASSES + kinds, row


def transitions(coded: DataFrame) -> np.ndarray:
    """log10 P(class | two classes before), from the training texts' class trigrams; a table of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            total += np.bincount(_contexts(batch)[0], minlength=CLASSES**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = coded.where(~F.col("held_out")).select("classes").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES**3)
    for r in rows.collect():
        counts[r.cell] = r.n
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two = three.sum(0)
    one = (two.sum(0) + 0.5) / (two.sum() + 0.5 * CLASSES)
    return np.log10(_witten_bell(three, _witten_bell(two, np.broadcast_to(one, two.shape)))).ravel()


def _witten_bell(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Shares within the last axis; as many more as there are followers go to those of the shorter context."""
    kinds = np.maximum((counts > 0).sum(-1, keepdims=True), 1)
    return (counts + kinds * shorter) / (counts.sum(-1, keepdims=True) + kinds)


class Facts:
    """What is known of the training texts as a whole; logarithms to the base of 10."""

    def __init__(self, ends: int, words: int, types: int, once: int, twice: int) -> None:
        self.ends, self.tokens = ends, words + ends
        once, twice = once + (ends == 1), twice + (ends == 2)
        self.base = math.log10(self.tokens + 0.5 * (types + (ends > 0) + 1))
        share = (once + 0.5) / (self.tokens + 1)
        self.seen = math.log10(1 - share)
        self.unseen = math.log10(share / (1 + once * (once - 1) / (2 * (twice + 1)))) if self.tokens else 0.0


def scores(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text; texts held out teach nothing."""
    held_out = fold(column(docs, "doc_id")) if held_out is None else held_out
    sliced = _sliced(docs, held_out)
    words = stored(
        sliced.select(F.explode(F.arrays_zip("words", "n")).alias("x")).groupBy(F.col("x.words").alias("word"))
        .agg(F.sum("x.n").alias("n")).where("n > 0"), "lm-words",
    )
    met = words.agg(
        F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice"),
    ).first()
    facts = Facts(docs.where(~held_out).count(), met.n, met.types, met.once, met.twice)
    # Of bounded number and length.
    top = words.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.col("n").desc(), "word").limit(HEADS).collect()
    heads = pa.array([r.word for r in top], pa.string())
    table = neighbours(sliced, heads)
    classes, pairs = exchanged(table, len(heads))
    spark = docs.sparkSession
    of_heads = spark.createDataFrame([(r.word, int(c)) for r, c in zip(top, classes[1:], strict=True)], "word string, class long")
    of_all = stored(of_heads.union(placed(sliced, heads, classes, pairs)), "lm-classes")
    classed = words.join(of_all, "word")
    sizes = classed.groupBy("class").agg(F.sum("n").alias("size"))  # a row a class
    classed = stored(classed.join(F.broadcast(sizes), "class"), "lm-classed")
    coded = _coded(sliced, classed, dict(docs.select(column(docs, "doc_id").alias("d")).dtypes)["d"], facts)
    steps = transitions(coded)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, row = _contexts(batch)
            score = batch.column("emitted").to_numpy() + np.bincount(row, steps[cells], batch.num_rows)
            tokens = batch.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")),
                    pa.array(np.full(batch.num_rows, facts.tokens)), batch.column("base_score"), pa.array(score),
                    pa.array(10 ** (-score / tokens)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    id_type = dict(coded.dtypes)["doc_id"]
    return coded.mapInArrow(
        scored,
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double",
    )
