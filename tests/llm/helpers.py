"""Small tables with the odd rows that every operator must take."""

import random
import re

from pyspark.sql import types as T

SYLLABLES = {"en": ["the", "ing", "and", "wh", "er"], "fr": ["eau", "que", "é", "oi", "ment"]}


def prose(lang, words, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) + rng.choice(["", "", ",", "."]) for _ in range(words))


DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("score", T.StringType()),
        T.StructField("n_words", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("ids", T.StringType()),
    ]
)


def odd_rows():
    rows = [(i, prose(lang, 30 + i, i), lang) for i, lang in enumerate(["en", "fr"] * 10)]
    rows += [
        (100, None, "en"), (101, "", None), (102, " \n\t ", "fr"), (103, "12 --- 34", None), (None, prose("en", 25, 7), "en"),
        (104, prose("fr", 6000, 3), "fr"), (105, "x" * 30_000, None), (106, "a", "en"), (3, rows[3][1], "fr"), (107, rows[5][1], "fr"),
        (108, "the<|endoftext|>the ñandú 的的 d'été 😀", "en"),
    ]
    return [(*r, "src", "clash", "7", "clash", None) for r in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def alnum_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def visible_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)
