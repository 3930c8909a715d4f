import unicodedata
import re
import uuid
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from chapterloom.functions import text as T, urls as U


def model_slug(value, fallback="novel", limit=80):
    table = str.maketrans({**T.LETTERS_ONE, **T.LETTERS_MANY})
    plain = unicodedata.normalize("NFKD", value.translate(table)).encode("ascii", "ignore").decode()
    slug = re.sub("[^A-Za-z0-9]+", "-", plain).strip("-").lower()
    return slug[:limit].rstrip("-") or fallback


def test_slug_over_all_code_points(spark):
    chars = [chr(p) for p in range(1, 0x20000) if not 0xD800 <= p < 0xE000]
    values = [f"a{''.join(chars[i:i + 30])}b" for i in range(0, len(chars), 30)]
    values += ["", "  ", "漢字", "Zażółć gęślą jaźń", "Łódź — Straße / Æther", "x" * 79 + " yz", "½ ﬁ ㎏"]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    got = df.select("v", T.slugify(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in got if r.s != model_slug(r.v)] == []


def test_white_space(spark):
    odd = "\x1c  a \tb\x85\nc \x1f"
    row = spark.createDataFrame([(odd,)], "v string").select(
        T.collapse(F.col("v")), T.strip(F.col("v")), T.shorten(F.lit("abc  def"), 5), T.shorten(F.lit("abc"), 3)
    ).first()
    assert list(row) == [" ".join(odd.split()), odd.strip(), "abc…", "abc"]


def test_entry_ids(spark):
    urls = [f"https://h{i}.test/é/{i}?q={i}" for i in range(300)]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(U.entry_id(F.col("u"))).collect()] == [
        str(uuid.uuid5(uuid.NAMESPACE_URL, u)) for u in urls
    ]


def test_resolve_like_the_standard(spark):
    bases = ["http://h.test/a/b/c?x=1#f", "https://h.test", "https://u@h.test:80/a/", "http://h.test/a//b/../c"]
    links = ["", "x", "/x", "../x", "../../x", "../../../../x", "./", ".", "..", "../", "?q", "#f", "//o.test/p",
             "http://o.test/p", "https:x", "mailto:a@b", "x/./y/../z", "/a/../b", "a//b", " /lead", "x?y=../z#../w",
             "javascript:void(0)", "/é ü", "x\ny"]
    rows = [(b, k) for b in bases for k in links]
    df = spark.createDataFrame(rows, "b string, k string")
    got = [r[0] for r in df.select(U.resolve(F.col("b"), F.col("k"))).collect()]
    wrong = [(r, g, urljoin(*r)) for r, g in zip(rows, got) if g != urljoin(*r)]
    assert wrong == []


def test_hosts(spark):
    urls = ["http://A.Test/x", "https://u:p@b.test:80/", "ftp://c.test", "//d.test/x", "http://x_y.test/a", "nothing",
            "http:///x", "https://e.test?x#y"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(U.host(F.col("u"))).collect()] == [
        (urlparse(u).hostname or "") if "//" in u and ":" in u.split("/")[0] else "" for u in urls
    ]


def test_normal_forms(spark):
    df = spark.createDataFrame(
        [("http://h.test/novel/n/chapter-1?p=2#x", r"^(https?://[^/]+/novel/[^/?#]+)"), ("http://h.test/a//?x#y", None),
         ("http://h.test/other/?x", r"^(https?://[^/]+/novel/[^/?#]+)")],
        "u string, r string",
    )
    got = [r[0] for r in df.select(U.normalize_for_site(F.col("u"), F.col("r"))).collect()]
    assert got == ["http://h.test/novel/n", "http://h.test/a//?x", "http://h.test/other"]
