"""Class n-grams, collocations and source divergence against brute force, on odd rows and empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from chapterloom.llm import classlm, divergence, phrases, queries

from .helpers import DOCS, no_docs, odd_docs, odd_rows, prose, visible_words

SMALL = "/root/testdata/sf0.01"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def is_test(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def base_rows(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score of each row."""
    tokens = [[*visible_words(text), None] for _, text in rows]
    c = Counter(t for (doc_id, _), ts in zip(rows, tokens, strict=True) if not is_test(doc_id) for t in ts)
    total = sum(c.values())
    for (doc_id, _), ts in zip(rows, tokens, strict=True):
        base = sum(math.log10((c[t] + 0.5) / (total + 0.5 * (len(c) + 1))) for t in ts)
        yield doc_id, is_test(doc_id), len(ts), sum(c[t] > 0 for t in ts), total, base


def close(got, want):
    def order(r):
        return str(r[0]), r[2], round(r[5], 6)

    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


BASE = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def test_base_of_odd_rows(spark):
    got = classlm.scores(odd_docs(spark)).collect()
    close([tuple(r[c] for c in BASE) for r in got], list(base_rows([(r[0], r[1]) for r in odd_rows()])))
    assert all(r.score < 0 and r.perplexity > 1 for r in got)


def test_language_model_without_training_texts(spark):
    assert classlm.scores(no_docs(spark)).count() == 0
    ids = [i for i in range(100) if is_test(i)][:5]
    rows = classlm.scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(0, 0, 0.0, 0.0)] * 5
    blank = classlm.scores(spark.createDataFrame([(0, ""), (2, None), (3, " ")], "doc_id long, text string")).collect()
    assert all(r.n_tokens == r.n_known == 1 and -0.5 < r.score < 0 for r in blank)


def test_held_out_texts_teach_nothing_and_are_better_than_the_base(spark):
    docs = queries.table(spark, SMALL, "documents")
    held = classlm.fold(F.col("doc_id"))
    first = {r.doc_id: r for r in classlm.scores(docs).collect()}
    close([tuple(r[c] for c in BASE) for r in first.values()], list(base_rows([(r.doc_id, r.text) for r in docs.collect()])))
    test = [r for r in first.values() if r.held_out]
    assert sum(r.score for r in test) > 0.95 * sum(r.base_score for r in test) and len(test) > 150
    other = docs.withColumn("text", F.when(held, F.lit("the of and")).otherwise(F.col("text")))
    again = {r.doc_id: r for r in classlm.scores(other).collect()}
    assert all(first[i].score == pytest.approx(again[i].score) for i, r in first.items() if not r.held_out)


def test_all_tokens_of_a_context_have_probability_one():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (5, 5, 5))
    counts[2] = 0
    one = np.full(5, 0.2)
    two = classlm._witten_bell(counts.sum(0), np.broadcast_to(one, (5, 5)))
    assert np.allclose(classlm._witten_bell(counts, two).sum(-1), 1)
    facts = classlm.Facts(ends=10, words=990, types=300, once=150, twice=50)
    unseen_words = 1 + 150 * 149 / (2 * 51)
    assert 10**facts.seen + unseen_words * 10**facts.unseen == pytest.approx(1)


def test_gain_of_a_move_is_the_change_of_likelihood(monkeypatch):
    monkeypatch.setattr(classlm, "CLASSES", 4)
    monkeypatch.setattr(classlm, "TRIED", 4)
    rng = np.random.default_rng(3)
    pairs = rng.integers(5, 60, (4, 4)).astype(float)
    left, right = rng.integers(0, 3, (1, 4)).astype(float), rng.integers(0, 3, (1, 4)).astype(float)
    left[0, 1] = right[0, 1] = 0  # nothing between the classes left and joined
    own = np.array([1])
    target, gain = classlm.gains(pairs, own, left, right)
    best = 0.0
    for b in (2, 3):
        moved = pairs.copy()
        side_l, side_r = left.copy(), right.copy()
        side_l[0, b] = side_r[0, b] = 0
        moved[:, 1] -= side_l[0]
        moved[1] -= side_r[0]
        moved[:, b] += side_l[0]
        moved[b] += side_r[0]
        _, exact = classlm.gains(pairs, own, side_l, side_r)
        change = classlm._likelihood(moved) - classlm._likelihood(pairs)
        best = max(best, change) if change > 0 else best
        assert exact[0] >= change - 1e-6 or exact[0] == 0
    assert gain[0] >= 0 and (target[0] != 1) == (gain[0] > 0)


def test_words_of_one_kind_share_classes(spark):
    animals, verbs = [f"animal{i}" for i in range(12)], [f"verb{i}" for i in range(12)]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(x for _ in range(40) for x in (rng.choice(animals), rng.choice(verbs)))) for i in range(60)]
    sliced = classlm._sliced(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    import pyarrow as pa

    heads = pa.array([*animals, *verbs[:10]])
    table = classlm.neighbours(sliced, heads)
    classes, pairs = classlm.exchanged(table, len(heads))
    start = classlm._likelihood(classlm._pair_counts(table, classlm._seeded(table, len(heads))))
    assert classlm._likelihood(pairs) >= start
    assert not set(classes[1:13].tolist()) & set(classes[13:].tolist())
    rest = {r.word: r["class"] for r in classlm.placed(sliced, heads, classes, pairs).collect()}
    assert set(rest) == set(verbs[10:]) and not set(rest.values()) & set(classes[1:13].tolist())


def phrase_rows(rows, least, best, within):
    """Brute force by the letter of the contract."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for g in (1, 2, 3):
                f[lang].update(tuple(words[i : i + g]) for i in range(len(words) - g + 1))
    out = []
    for lang, counts in f.items():
        found = {}
        for p, a in counts.items():
            if len(p) > 1 and a >= least:
                found[p] = (a, *min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))))
        kept = [
            (-s, -a, " ".join(p).encode(), l, r) for p, (a, s, _, l, r) in found.items()
            if not any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * found[q][0] >= within * a for q in found)
        ]
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:best])]
    return sorted(out)


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrases_of_odd_rows(spark):
    for least, best in ((2, 50), (3, 5)):
        got = phrases.collocations(odd_docs(spark), least, best).collect()
        assert sorted(tuple(r[c] for c in PHRASE) for r in got) == phrase_rows([(r[1], r[2]) for r in odd_rows()], least, best, 50)
    assert phrases.collocations(no_docs(spark)).count() == 0


def test_phrases_of_pieces_ties_and_control_characters(spark):
    texts = ["A\x00b c, c a\x0bb b b b b", "x y.x y;x y!x y", "p q r p q r p q r", "r p q", "\x1f \x1f \x1f", "é é é É É", "a" * 9000 + " z z"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(product(texts, [None, "und", "l'\""]))] * 2
    got = phrases.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), 2, 9).collect()
    assert sorted(tuple(r[c] for c in PHRASE) for r in got) == phrase_rows([r[1:] for r in rows], 2, 9, 50)


def test_scores_past_64_bits(spark):
    rows = [(5_000_000_000, 6_000_000_000, 7_000_000_000), (9_999_999_999, 9_999_999_999, 9_999_999_999), (2, 1_000_000, 3)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases._score("l", "r").alias("s"))
    assert all(r.s == 1000000 * r.a * r.a // (r.l * r.r) for r in df.collect())


def divergence_rows(rows, least, best):
    docs = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for x, _, c in docs if x == lang for t in c)
        kept = {t for t, k in df.items() if k >= least}
        counts = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, c in docs:
            if x == lang:
                counts[s].update({t: k for t, k in c.items() if t in kept})
        whole = sum(counts.values(), Counter())

        def share(c, t, v=len(kept)):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * v)

        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), x.encode()) for x, o in counts.items() if x != s]
            terms = [(share(whole, t) - share(c, t), t.encode()) for t in kept if c[t] > 0 and share(c, t) > share(whole, t)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


DIVERGENCE = ("lang", "source", "part", "item", "value", "rank")


def some_sources():
    rows = [(prose(lang, 40, i), lang, f"s{i % 7}") for i, lang in enumerate(["en", "fr", "en"] * 15)]
    rows += [(None, "en", "s9"), ("", None, None), ("12 --", "xx", "b"), ("12 --", "xx", "a"), ("a-a-a A,a é'É", "en", None), ("wh the", None, "s1")]
    return rows + rows[:9]


@pytest.mark.parametrize("least,tile,block", [(2, 256, 100_000), (3, 2, 5), (30, 256, 1)])
def test_divergence_of_sources(spark, least, tile, block):
    rows = [(i, *r, "clash") for i, r in enumerate(some_sources())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string").repartition(4)
    got = divergence.divergence(docs, least, 6, tile, block).collect()
    assert sorted(tuple(r[c] for c in DIVERGENCE) for r in got) == divergence_rows(some_sources(), least, 6)


def test_divergence_of_odd_rows(spark):
    got = divergence.divergence(odd_docs(spark), 3).collect()
    assert sorted(tuple(r[c] for c in DIVERGENCE) for r in got) == divergence_rows([r[1:4] for r in odd_rows()], 3, 50)
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_slices_keep_rows_and_words():
    import pyarrow as pa

    from chapterloom.llm import lexicon, textbytes as B

    texts = ["A b", None, "", "c" * 50, "é A\tb", " ", "b" * 5] * 20
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 7)), pa.array(texts[i : i + 7], pa.string())], ["k", "text"]) for i in range(0, 140, 7)]
    for limit in (1, 60, 400, 1 << 20):
        parts = list(lexicon.slices(iter(batches), "text", limit))
        assert [k for rows, _, _ in parts for k in rows.column("k").to_pylist()] == list(range(140))
        found = []
        for rows, raw, offsets in parts:
            words = lexicon.Words(raw, offsets, B.VISIBLE)
            listed = words.listed.to_pylist()
            assert len(set(listed)) == len(listed) == len(words)
            found += [[listed[n] for n in words.numbers[a:b]] for a, b in zip(words.first[:-1], words.first[1:])]
        assert found == [visible_words(t) for t in texts]
    assert [b.num_rows for b in lexicon.each(iter(batches), 3)] == [3, 3, 1] * 20


def test_numbers_without_a_gap(spark):
    from chapterloom.llm import lexicon

    rows = lexicon.numbered(spark.range(1000).repartition(7).where("id % 3 > 0").withColumnRenamed("id", "n"), "numbers").collect()
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1)) and len({r.n for r in rows}) == len(rows) == 666
    assert lexicon.numbered(spark.range(0).withColumnRenamed("id", "n"), "numbers").count() == 0
