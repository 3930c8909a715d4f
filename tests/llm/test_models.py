"""Classifiers on held-out rows, archives, page texts and the pipeline on odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chapterloom.llm import extract, frames, langid, quality, queries, toxicity, warc
from chapterloom.llm.dom import Page
from chapterloom.llm.frames import held_out
from chapterloom.llm.trees import log_odds

from .helpers import DOCS, no_docs, odd_docs, odd_rows, prose

SMALL = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    got = queries.op4_langid(spark, SMALL).join(queries.table(spark, SMALL, "documents"), "doc_id").where("held_out")
    right, every = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert right / every > 0.97


def test_language_spans_of_mixed_text(spark):
    rows = [(i, prose(lang, 60, i), lang) for i, lang in enumerate(["en", "fr"] * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("lang"))
    mixed = prose("en", 40, 900) + " " + prose("fr", 40, 901)
    docs = spark.createDataFrame([(1, mixed), (2, "—— 12 «»"), (3, None), (4, ""), (5, "привет мир")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "fr"] and 0.3 < got[1].score < 0.8
    cut = len(prose("en", 40, 900).encode())
    assert abs(got[1].spans[1].start - cut) < 40 and got[1].spans[-1].stop <= len(mixed.encode())
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[5].score == 1.0  # a script of no learned language: a word, but no evidence
    none = langid.fit(no_docs(spark), F.col("lang"))
    assert {r.lang_pred for r in langid.identify(odd_docs(spark), none, ["doc_id"]).collect()} == {"und"}


def test_rare_language_is_learned_from_a_large_table(spark):
    rows = [(i, prose("en", 20, i), "en") for i in range(4000)] + [(5000 + i, prose("fr", 20, i), "fr") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("lang"), 40)
    assert model["names"] == ["en", "fr"]
    fresh = spark.createDataFrame([(1, prose("fr", 40, 77)), (2, prose("en", 40, 78))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(fresh, model, ["doc_id"]).collect()} == {1: "fr", 2: "en"}
    assert 10 < frames.balanced(docs, "lang", F.col("doc_id"), 40).count() < 80


def test_letters_are_counted_not_bytes(spark):
    russian = "привет мир как дела сегодня хорошо"
    rows = [(i, *pair) for i, pair in enumerate([(prose("en", 40, 1), "en"), (russian, "ru"), ("ᚠᚢᚦ ᚠᚢ", "runes"), ("これは テスト です", "ja"), ("สวัสดี ครับ", "th")] * 4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("lang"))
    mixed = "the ander wher thing erand whing theranding ingtheander " + "привет мир как дела сегодня хорошо"
    texts = [mixed, "“the” — ander’s", "กข", "テスト", "ªº", "漢字", "£€…", "ру the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    latin, cyrillic = sum(c.isascii() and c.isalpha() for c in mixed), sum("а" <= c <= "я" for c in mixed)
    assert latin > cyrillic and 2 * cyrillic > latin
    assert (got[0].lang_pred, got[0].score) == ("en", pytest.approx(latin / (latin + cyrillic)))
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["en", "th", "ja"] and got[1].score == 1.0
    assert got[4].score == 0.0 and got[5].score == 1.0 and got[6].lang_pred == "und"
    assert [s.lang for s in got[7].spans] == ["ru", "en"]  # a script bars the languages that do not write in it


def test_two_hundred_languages():
    rng = np.random.default_rng(8)
    import pyarrow as pa

    from chapterloom.llm import textbytes as B

    count = 200
    model = {"names": [f"l{k:03}" for k in range(count)], "allowed": np.ones((count, langid.SCRIPTS), bool), "switch": 2.0,
             "scores": rng.normal(0, 0.6, (count, langid.BUCKETS)).astype(np.float32)}
    texts = [" ".join("".join(rng.choice(list("abcdxyz"), 3)) for _ in range(12)) for _ in range(30)]
    raw, offsets = B.flat(pa.array(texts))
    starts, ends, first, labels = langid.label(model, raw, offsets)
    code = langid.trigrams(raw, offsets)
    assert labels.max() > 127
    for i in range(30):
        score = np.array([model["scores"][:, code[starts[w] : ends[w]]].sum(1) for w in range(first[i], first[i + 1])])
        best = score[0]
        for row in score[1:]:
            best = np.maximum(best, best.max() - 2.0) + row
        path = labels[first[i] : first[i + 1]]
        value = sum(score[t, k] for t, k in enumerate(path)) - 2.0 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(best.max(), abs=1e-3)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    model = {"names": ["a", "b", "c"], "allowed": np.ones((3, langid.SCRIPTS), bool), "switch": 3.0}
    from chapterloom.llm import textbytes as B
    import itertools

    import pyarrow as pa

    for _ in range(40):
        model["scores"] = rng.normal(0, 0.6, (3, langid.BUCKETS)).astype(np.float32)
        texts = ["".join(rng.choice(list("abcdé"), 2)) + " " + " ".join("".join(rng.choice(list("xyz"), 3)) for _ in range(int(rng.integers(0, 6)))) for _ in range(4)]
        raw, offsets = B.flat(pa.array(texts))
        starts, ends, first, labels = langid.label(model, raw, offsets)
        code = langid.trigrams(raw, offsets)
        for i in range(4):
            words = range(first[i], first[i + 1])
            score = np.array([[model["scores"][k][code[starts[w] : ends[w]]].sum() for k in range(3)] for w in words])

            def value(path):
                return sum(score[t, k] for t, k in enumerate(path)) - 3.0 * sum(x != y for x, y in zip(path, path[1:]))

            best = max(value(p) for p in itertools.product(range(3), repeat=len(words)))
            assert value(labels[first[i] : first[i + 1]].tolist()) == pytest.approx(best, abs=1e-4)


def _auc(rows):
    rows = sorted(rows)
    good = [i for i, (_, y) in enumerate(rows) if y]
    n1, n0 = len(good), len(rows) - len(good)
    return (sum(good) - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_quality_and_toxicity_of_held_out_rows(spark):
    labels = queries.table(spark, SMALL, "labels")
    for query, column, least in ((queries.op6_quality, "quality", 0.97), (queries.op1_toxicity, "toxic", 0.75)):
        got = query(spark, SMALL).join(labels, "doc_id").where("held_out").select("score", column).collect()
        assert _auc([(r[0], r[1]) for r in got]) > least
        assert all(0 <= r[0] <= 1 for r in got)


def test_models_without_anything_to_learn(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, grade int, toxic int")
    one = spark.createDataFrame([(1, 2, 1), (2, 2, 1), (None, 2, 1), (3, None, None), (777, 1, 0)], none.schema)
    for labels, expected in ((none, 0.0), (one, 2.0)):
        model = quality.fit(docs, labels)
        got = quality.grade(docs, model, ["doc_id"], above=0).collect()
        assert len(got) == len(odd_rows()) and {r.expected_grade for r in got} == {expected}
        scored = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()
        assert len(scored) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)


def test_one_model_a_round_comes_to_the_driver(spark, monkeypatch):
    """Before, each round brought the models of all shares, in rows of 2 MB."""
    frame, seen = type(spark.range(0)), []
    collect, to_arrow = frame.collect, frame.toArrow

    def collected(df):
        rows = collect(df)
        seen.append(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)))
        return rows

    def arrow(df):
        table = to_arrow(df)
        seen.append(table.nbytes)
        return table

    monkeypatch.setattr(frame, "collect", collected)
    monkeypatch.setattr(frame, "toArrow", arrow)
    docs = odd_docs(spark)
    ids = [r.doc_id for r in docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy("doc_id").collect()]
    model = quality.fit(docs, spark.createDataFrame([(i, k % 3) for k, i in enumerate(ids)], "doc_id long, grade int"))
    assert model["grades"] == [0, 1, 2] and len(model["weights"]) == quality.BUCKETS and len(model["thresholds"]) == 2
    assert max(seen) < 1.1 * 2 * quality.BUCKETS * 8


def test_windows_tile_every_text():
    import pyarrow as pa

    from chapterloom.llm import textbytes as B

    texts = [r[1] for r in odd_rows()]
    raw, offsets = B.flat(pa.array(texts, pa.string()))
    starts, ends, row = toxicity.windows(raw, offsets)
    for i, text in enumerate(texts):
        mine = row == i
        assert b"".join(raw[a:b].tobytes() for a, b in zip(starts[mine], ends[mine])) == (text or "").encode()
        assert all(b - a <= 3 * toxicity.WINDOW for a, b in zip(starts[mine], ends[mine]))


PAGES = "page_id long, url string, html string, salt int, value string, date string"


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 5)
    big = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 200
    pages = [(i, f"http://b.example/{i % 3}", big if i % 4 == 0 else f"<p>{i}", 1, "v", "d") for i in range(1, 30)]
    pages += [(40, None, None, 1, "v", "d"), (41, "http://a\r\nX: 1", "", 1, "v", "d"), (None, "http://c/", big, 1, "v", "d"), (4, "http://d/", big, 1, "v", "d"), (42, "HTTPS://WWW.B.example:80", "y" * 99, 1, "v", "d"), (43, "u", "y" * 99, 1, "v", "d")]
    got = warc.archive(spark.createDataFrame(pages, PAGES).repartition(4)).collect()
    assert len(got) == len(pages) and [warc.sort_key(tuple(r)) for r in got] == sorted(warc.sort_key(tuple(r)) for r in got)
    want = []
    for page_id, _, html, *_ in pages:
        body = (html or "").encode()
        first = 4 if html == big else None
        again = first is not None and page_id != first
        want.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: str(r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(1)
    for runs in (0, 1, 2, 3, 7):
        data = [sorted((rng.choice("abc"), str(rng.randint(0, 9)), i, "", 0, "", None, f"f{r}", i, 0) for i in range(rng.randint(0, 9))) for r in range(runs)]
        data = [sorted(d, key=warc.sort_key) for d in data]
        merged = list(warc.LoserTree([iter(d) for d in data]))
        assert merged == sorted((x for d in data for x in d), key=warc.sort_key)


def test_page_texts(spark):
    model = extract.fit(queries.table(spark, SMALL, "pages"))
    body = "".join(f"<p>{prose('en', 40, i).capitalize()}, and so on.</p>" for i in range(4))
    text = " ".join(f"{prose('en', 40, i).capitalize()}, and so on." for i in range(4))
    shells = [
        f"<header><a href=/>Home</a></header><main><h1>Title &amp; more</h1>{body}</main><aside>See also</aside>",
        f"<div class='navbar'><ul><li><a href=/>Home</a></ul></div><div class=content><h1>Title &amp; more</h1>{body}"
        "<div class='comments'><p>Nice one, thanks.</p></div></div><div id='footer'>Imprint</div>",
        f"<form>Search</form><article><h1>Title\n &amp;  more</h1>{body}<section class='comments'><p>I like it, a lot.</p></section>"
        "<div class='notice'>We use cookies.</div><!-- x > <p>no</p> --><script>var a='<p>no</p>'</script></article>",
    ]
    rows = [(i, "u", s, 1, "v", "d") for i, s in enumerate(shells)] + [
        (10, "u", None, 1, "v", "d"), (11, "u", "", 1, "v", "d"), (12, "u", "<<<p <![x[ <p class=\"", 1, "v", "d"),
        (13, None, "<article>" + "<div>" * 3000 + "deep", 1, "v", "d"),
    ]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, PAGES), model, ["page_id", "url"]).collect()}
    for i in range(3):
        assert got[i] == "Title & more " + " ".join(text.split())
    assert got[10] == "" and got[11] == "" and len(got) == len(rows)
    bare = extract.fit(spark.createDataFrame([], PAGES))
    assert extract.extract(spark.createDataFrame(rows, PAGES), bare, ["page_id"]).count() == len(rows)


def test_text_outside_of_blocks_is_kept(spark):
    model = extract.fit(queries.table(spark, SMALL, "pages"))
    lines = [f"{prose('en', 40, i).capitalize()}, and so on." for i in range(4)]
    plain, body = " ".join(lines), "".join(f"<p>{line}</p>" for line in lines)
    odd = "<p>So <math><mi>x</mi></math> is, <object>by a name</object>, <svg><text>a label</text></svg>, <noscript>plain</noscript>, <template>made</template>.</p>"
    rows = [
        (1, plain, plain), (2, f"{plain} <b>Bold, at the end.</b>", f"{plain} Bold, at the end."),
        (3, f"<html><head><title>t</title></head>{plain}", plain), (4, f"<head><title>t</title>{body}", plain),
        (5, f"<body><article>{body}</article></body>{plain}", f"{plain} {plain}"),
        (6, f"<article>{body}{odd}</article>", f"{plain} So x is, by a name, a label, plain, made."),
        (7, f"<article><p>Seen, <svg> and no end.</p>{body}</article>", f"Seen, and no end. {plain}"),
        (8, f"<article>{body}</article><script>var a = '{body}'", plain),
    ]
    pages = spark.createDataFrame([(i, html) for i, html, _ in rows], "page_id long, html string")
    got = {r.page_id: r.text for r in extract.extract(pages, model, ["page_id"]).collect()}
    assert got == {i: " ".join(text.split()) for i, _, text in rows}


def test_few_marked_pages_among_many_are_what_is_learned(spark):
    body = "".join(f"<p>{prose('en', 40, i).capitalize()}, and so on.</p>" for i in range(4))
    marked = [(i, f"<body><nav>Home</nav><{tag}>{body}</{tag}></body>") for i, tag in enumerate(["article", "MAIN", "article class='x'"])]
    other = [(100 + i, f"<body><nav>Home</nav><div>{body}</div></body>") for i in range(600)]
    few, all_ = (spark.createDataFrame(rows, "page_id long, html string") for rows in (marked, marked + other))
    got, want = ([r.text for r in extract.extract(few, extract.fit(t, 10), ["page_id"]).orderBy("page_id").collect()] for t in (all_, few))
    model, alike = extract.fit(all_, 10), extract.fit(few, 10)
    rows = np.vstack([Page(html).features() for _, html in marked + other[:3]])
    assert got == want and np.array_equal(log_odds(model, rows), log_odds(alike, rows))


def test_kept_elements_never_hang_below_dropped_ones():
    rng = np.random.default_rng(1)
    page = Page("<div><p>a<div><p>b<div>c</div></div></div><section><p>d</p><ul><li>e<li>f</ul></section>")
    for _ in range(50):
        kept = extract.decode(page, rng.normal(0, 3, len(page.tag)))
        assert all(kept[page.parent[i]] or not kept[i] for i in range(1, len(kept)))


def test_pipeline_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert out.exceptAll(docs).count() == 0, name
        assert stage(spark, no_docs(spark), SMALL).count() == 0, name
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {r[0] for r in odd_rows()} - {107}
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SMALL).collect()}.isdisjoint({100, 101, 102, 103})


def test_pipeline_keeps_and_drops_what_brute_force_does(spark):
    """Stage by stage on the small tables, against the operators' queries and plain Python."""
    docs = queries.table(spark, SMALL, "documents")
    leaks = {r.doc_id for r in queries.op2_decontamination(spark, SMALL).where("contaminated").collect()}
    left = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, SMALL).collect()}
    assert left == {r.doc_id for r in docs.collect()} - leaks and leaks
    pieces = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of"))
    rows = pieces.collect()
    assert rows and all(r.n == r.of for r in rows) and not {r.doc_id for r in rows} & leaks
    labels = queries.table(spark, SMALL, "labels").where(~held_out(F.col("doc_id"))).where("quality = 1 AND toxic = 0")
    clean = {r.doc_id for r in labels.collect()} - leaks
    assert len(clean & {r.doc_id for r in rows}) > 0.75 * len(clean)
