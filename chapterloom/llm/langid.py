"""Language spans of mixed-language text: script ranges, word scores, Viterbi.

Model: for each language the log probability of byte trigrams inside words (a blank on either
side), hashed to ``BUCKETS``, and for each script the languages that write at least ``SHARE`` of their
letters in it. It is fitted on about ``sample`` labelled documents at most, dealt out evenly over the languages: rare ones
give all they have. The counts are added up by Spark.

Labelling: a word's script, told by ranges of code points, narrows its candidate languages; its trigrams score each. The best
sequence of labels pays ``SWITCH`` for each change of language. For most documents one language
throughout is provably best (no other language gains more than half a switch on any stretch of
words), which is seen from running sums; the others go through Viterbi, a batch of documents at a time.

Defined results: a null text or one without a letter is ``und`` with score 0 and no spans; a word in a
script that no learned language uses counts for none; ties go to the first language by name. Rows are
judged one by one, so repeated rows, nulls and other columns do not matter. Without any labelled
document every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .frames import balanced, column

SAMPLE = 12_000
BUCKETS = 1 << 16
SWITCH = 30.0
SHARE = 0.001
UNKNOWN = "und"

#: Where scripts begin among the code points; each goes on to the next line. ``signs`` are no letters.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0080, "signs"), (0x00C0, "latin"), (0x00D7, "signs"), (0x00D8, "latin"), (0x00F7, "signs"), (0x00F8, "latin"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"),
    (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, "samaritan"), (0x08A0, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"),
    (0x1680, "ogham"), (0x16A0, "runic"), (0x1700, "philippine"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "canadian"),
    (0x1900, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"),
    (0x2000, "signs"), (0x2C00, "glagolitic"), (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "tifinagh"),
    (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "signs"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "signs"), (0x31F0, "kana"), (0x3200, "signs"), (0x3400, "han"), (0xA000, "yi"), (0xA4D0, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xAB30, "latin"), (0xAB70, "cherokee"),
    (0xABC0, "other"), (0xAC00, "hangul"), (0xD800, "signs"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "signs"), (0xFE70, "arabic"), (0xFEFF, "signs"), (0xFF21, "latin"), (0xFF5B, "signs"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "signs"), (0x10000, "other"), (0x1D000, "signs"), (0x1E000, "other"), (0x1F000, "signs"), (0x20000, "han"),
    (0xE0000, "signs"),
)
_STARTS = np.array([at for at, _ in SCRIPT_STARTS])
_NAMES = ["latin", *sorted({name for _, name in SCRIPT_STARTS} - {"latin", "signs"})]
SCRIPTS = len(_NAMES)
_NUMBERS = np.array([_NAMES.index(name) if name != "signs" else 0 for _, name in SCRIPT_STARTS], np.uint8)
_SIGNS = np.array([name == "signs" for _, name in SCRIPT_STARTS])
#: What a word costs in a language that is no candidate by its script: more than any switch, so it is never chosen.
BARRED = 1000.0


def letter_scripts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the script of the letter that begins there, 0 (Latin) for all others, and whether a letter does."""
    script, letter = np.zeros(len(raw), np.uint8), B.LETTER[raw] & (raw < 0x80)
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        first = raw[lead].astype(np.int64)
        padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
        one, two, three = padded[lead + 1], padded[lead + 2], padded[lead + 3]
        point = np.where(
            first < 0xE0, (first & 0x1F) << 6 | one,
            np.where(first < 0xF0, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three),
        )
        kind = np.searchsorted(_STARTS, point, "right") - 1
        script[lead], letter[lead] = _NUMBERS[kind], ~_SIGNS[kind]
    return script, letter


_SYMBOL = np.full(256, 0x20, np.uint32)
_SYMBOL[B.LETTER] = np.flatnonzero(B.LETTER)
_SYMBOL[0x41:0x5B] += 0x20


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte."""
    here = _SYMBOL[raw]
    left, right = np.full_like(here, 0x20), np.full_like(here, 0x20)
    left[1:], right[:-1] = here[:-1], here[1:]
    left[offsets[:-1][offsets[:-1] < len(raw)]] = 0x20
    right[offsets[1:][offsets[1:] > 0] - 1] = 0x20
    code = (left * np.uint32(0x9E3779B1)) ^ (here * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))
    code ^= code >> np.uint32(15)
    return (code * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def fit(docs: DataFrame, lang: Column, sample: int = SAMPLE) -> dict:
    """Model from rows whose ``lang`` is not null: names, trigram log probabilities, script candidates."""
    labelled = docs.select(
        column(docs, "text").cast("string").alias("text"), lang.cast("string").alias("lang"),
        F.xxhash64(column(docs, "doc_id")).alias("key"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    chosen = balanced(labelled, "lang", F.col("key"), sample)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for rows, raw, offsets in B.slices(batches, "text"):
            code, inside = trigrams(raw, offsets), B.LETTER[raw]
            script, letter = letter_scripts(raw)
            script = BUCKETS + script.astype(np.int64)
            for i, name in enumerate(rows.column("lang").to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                held = inside[a:b]
                sums = totals.setdefault(name, np.zeros(BUCKETS + SCRIPTS, np.int64))
                sums += np.bincount(code[a:b][held], minlength=BUCKETS + SCRIPTS)
                sums += np.bincount(script[a:b][letter[a:b]], minlength=BUCKETS + SCRIPTS)
        for name, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"]
            )

    # Of fixed size: at most BUCKETS + SCRIPTS rows a language, and no object for each of them on the driver.
    got = (
        chosen.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).toArrow().combine_chunks()
    found = got.column("lang").unique().to_pylist()
    names = sorted(found)
    counts = np.zeros((len(names), BUCKETS + SCRIPTS))
    place = np.array([names.index(name) for name in found], np.int64)
    at = pc.index_in(got.column("lang"), pa.array(found, got.schema.field("lang").type)).to_numpy()
    counts[place[at], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    grams, scripts = counts[:, :BUCKETS] + 0.1, counts[:, BUCKETS:]
    scores = np.log(grams / grams.sum(1, keepdims=True))
    allowed = scripts >= SHARE * scripts.sum(1, keepdims=True)
    return {"names": names, "scores": scores.astype(np.float32), "allowed": allowed}


def _viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, switch: float) -> list[np.ndarray]:
    """Best labels of several documents at once; ``scores`` [words, languages]."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best = scores[first].copy()
    stay = np.arange(scores.shape[1])
    back = []
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))
        top = best[:live].argmax(1)
        moved = best[np.arange(live), top] - switch
        keep = best[:live] >= moved[:, None]
        back.append(np.where(keep, stay, top[:, None]).astype(np.int32))
        best[:live] = np.where(keep, best[:live], moved[:, None]) + scores[first[:live] + t]
    out: list = [None] * len(order)
    for k, place in enumerate(order):
        path = np.empty(size[k], np.int64)
        path[-1] = best[k].argmax()
        for t in range(int(size[k]) - 1, 0, -1):
            path[t - 1] = back[t - 1][k, path[t]]
        out[place] = path
    return out


def label(model: dict, raw: np.ndarray, offsets: np.ndarray):
    """Label of every word of a slice: starts, ends, first word of each row, labels."""
    starts, ends, first = B.spans(raw, offsets, B.LETTER)
    count = len(model["names"])
    words = len(starts)
    if not words or not count:
        return starts, ends, first, np.zeros(0, np.int64)
    code = trigrams(raw, offsets)
    inside = B.LETTER[raw]
    code, length = code[inside], ends - starts
    at = np.cumsum(length) - length
    scores = np.empty((count, words), np.float64)
    for k in range(count):
        scores[k] = np.add.reduceat(model["scores"][k][code], at)
    script = np.maximum.reduceat(letter_scripts(raw)[0][inside], at)
    if script.any() or not model["allowed"][:, 0].all():
        # A word's script leaves the languages that write in it; one that nobody learned says nothing.
        fits = model["allowed"][:, script]
        scores = np.where(fits, scores, scores - BARRED)
        scores[:, ~fits.any(0)] = 0.0
    sums = np.zeros((count, words + 1))
    np.cumsum(scores, axis=1, out=sums[:, 1:])
    totals = (sums[:, first[1:]] - sums[:, first[:-1]]).T
    main = totals.argmax(1)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    labels = main[row]
    # A stretch on which another language gains more than half a switch needs the full search.
    odd = np.zeros(len(size), bool)
    own = scores[labels, np.arange(words)]
    lift = row * 1e10  # keeps rows apart in one running minimum
    for k in range(count):
        gain = np.cumsum(scores[k] - own)
        floor = np.minimum.accumulate((np.concatenate([[0.0], gain[:-1]])) - lift)
        over = gain - lift - floor > model.get("switch", SWITCH) / 2
        odd[row[over]] = True
    pick = np.flatnonzero(odd)
    if len(pick):
        paths = _viterbi(scores.T, first[:-1][pick], size[pick], model.get("switch", SWITCH))
        for i, path in zip(pick, paths, strict=True):
            labels[first[i] : first[i + 1]] = path
    return starts, ends, first, labels


SPANS = "array<struct<lang:string,start:int,stop:int>>"
_SPAN = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])


def identify(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and spans (bytes ``start`` to ``stop`` of the UTF-8 text).

    ``lang_pred`` is the language of most letters, ``score`` its share of them.
    """
    names = model["names"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array([*names, UNKNOWN])
        for rows, raw, offsets in B.slices(batches, "__text"):
            n = rows.num_rows
            starts, ends, first, labels = label(model, raw, offsets)
            pred, score = np.full(n, len(names)), np.zeros(n)
            lists, flat = np.zeros(n + 1, np.int64), [np.zeros(0, np.int64)] * 3
            if len(labels) and names:
                row = np.repeat(np.arange(n), np.diff(first))
                script, letter = letter_scripts(raw)
                of_word = np.add.reduceat(letter.astype(np.int64), starts)  # between words there are none
                letters = np.bincount(row * len(names) + labels, of_word, n * len(names)).reshape(n, len(names))
                pred = letters.argmax(1)
                every = letters.sum(1)
                score = letters.max(1) / np.maximum(every, 1)
                change = np.ones(len(labels), bool)
                change[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
                low = np.flatnonzero(change)
                high = np.append(low[1:], len(labels)) - 1
                flat = [labels[low], starts[low] - offsets[row[low]], ends[high] - offsets[row[low]]]
                lists = np.searchsorted(low, first)
                # No ASCII letter: what stands above 0x7F may be no letter, or one among the signs.
                plain = np.bincount(row, np.add.reduceat(((raw < 0x80) & B.LETTER[raw]).astype(np.int64), starts), n)
                unsure = np.flatnonzero((np.diff(first) > 0) & (plain == 0))
                none = every == 0
                if len(unsure):
                    texts = rows.column("__text").take(pa.array(unsure)).to_pylist()
                    none[unsure] = [not _has_letter(x) for x in texts]
                pred = np.where(none, len(names), pred)
                score = np.where(none, 0.0, score)
            spans = pa.ListArray.from_arrays(
                pa.array(lists.astype(np.int32)),
                pa.StructArray.from_arrays(
                    [listed.take(pa.array(flat[0])), *(pa.array(x.astype(np.int32)) for x in flat[1:])],
                    fields=list(_SPAN),
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), listed.take(pa.array(pred)), pa.array(score), spans],
                [*keep, "lang_pred", "score", "spans"],
            )

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    chosen = docs.select(*[column(docs, c) for c in keep], column(docs, "text").cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return chosen.mapInArrow(found, f"{schema}, lang_pred string, score double, spans {SPANS}")
