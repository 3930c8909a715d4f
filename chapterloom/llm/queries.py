"""The numbered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, decontam, divergence, extract, jaccard, langid, neardup, packing, phrases, quality, tokens, toxicity, warc
from .frames import held_out, ready, shared_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, folder: fn(ready(spark), folder)
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def learning(docs: DataFrame) -> DataFrame:
    """Rows outside the test fold."""
    return docs.where(~held_out(F.col("doc_id")))


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, learning(table(spark, folder, "labels")))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query(
    """
    WITH words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    tests AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    windows AS (
      SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
             lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase
      FROM tests WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    runs AS (
      SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM words, sizes WHERE len(w) >= n),
    hits AS (
      SELECT r.doc_id, r.i, r.n, t.item_id FROM
        (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM runs) r
        JOIN windows t ON t.n = r.n AND t.phrase = r.phrase),
    places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
    counts AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
    names AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN counts USING (doc_id) LEFT JOIN names USING (doc_id)
    """
)
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), known=1_200_000)


@query()
def op4_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(learning(docs), F.col("lang"))
    found = langid.identify(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def grades(spark: SparkSession, folder: str) -> DataFrame:
    """Graded ratings: 0 low quality, 1 good but toxic, 2 good; outside the test fold."""
    labels = learning(table(spark, folder, "labels"))
    good, clean = F.col("quality"), 1 - F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select("doc_id", (good * (1 + clean)).cast("int").alias("grade"))


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, grades(spark, folder))
    scored = quality.grade(docs, model, ["doc_id"], above=0)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", F.col("tail").alias("score"),
        (F.col("tail") >= 0.5).alias("selected"),
    )


@query()
def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "embeddings"))


@query(
    f"""
    WITH p AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    g AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= {warc.SAME} GROUP BY d)
    SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
           CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM p LEFT JOIN g ON p.d = g.d AND p.n >= {warc.SAME}
    """
)
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    merged = warc.archive(table(spark, folder, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, folder, "documents"))


@query(
    r"""
    WITH a AS (
      SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
    t AS (
      SELECT page_id, url, trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM a),
    d AS (
      SELECT page_id, url, regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
             '&amp;?', '&', 'g') AS text FROM t)
    SELECT page_id, url, text, length(text) AS n_chars FROM d
    """
)
def op9_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = extract.extract(pages, extract.fit(pages), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op10_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = shared_path(docs, "token-ids")
    tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), known=1_000_000)
    return tokens.digests(tokens.read_tokens(spark, path))


@query()
def op11_classlm(spark: SparkSession, folder: str) -> DataFrame:
    return classlm.scores(table(spark, folder, "documents"))


@query(
    r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (
      SELECT lang, g, unnest(list_transform(range(1, len(w) - g + 2), lambda i: array_to_string(w[i:i + g - 1], ' '))) AS phrase
      FROM words, (VALUES (1), (2), (3)) AS sizes(g) WHERE len(w) >= g),
    f AS (SELECT lang, g, phrase, count(*) AS a FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE g = 1 GROUP BY lang),
    candidates AS (SELECT lang, g, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE g > 1 AND a >= 10),
    cuts AS (
      SELECT lang, g, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
      FROM candidates, (VALUES (1), (2)) AS ks(k) WHERE k < g),
    valued AS (
      SELECT c.lang, c.g, c.phrase, c.a, k, x.a AS l, y.a AS r,
             (1000000 * c.a::HUGEINT * c.a::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest),
    scored AS (
      SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    held AS (
      SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS held_a
      FROM candidates, (VALUES (1), (2)) AS starts(i) WHERE g = 3 GROUP BY ALL),
    kept AS (
      SELECT s.* FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase AND s.g = 2
      WHERE h.held_a IS NULL OR 100 * h.held_a < 50 * s.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
           score::BIGINT AS score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """
)
def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query(
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
    groups AS (SELECT DISTINCT lang, source FROM d),
    size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
    ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
    lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
    p AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(gn.n, 0) + 5 * size.v) AS p
      FROM groups g JOIN kept k USING (lang) JOIN size USING (lang)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
    q AS (
      SELECT lang, term, 1 + (1000000000::HUGEINT * (lt.n + 5)) // (ln.n + 5 * size.v) AS q
      FROM lt JOIN ln USING (lang) JOIN size USING (lang)),
    pairs AS (
      SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    every AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM every QUALIFY part = 'pair' OR rank <= 50
    """
)
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))
