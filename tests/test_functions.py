from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvflow.functions import hashing, text, web
from kvflow.operators import crawl_clean, wordcount


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_tokens(spark):
    got = column(spark, ["café x1y AI大两", "hello world hello Go 分布式", "", None, "a\x0bb_c"], text.tokenize)
    assert got == [["caf", "x", "y", "AI大两"], ["hello", "world", "hello", "Go", "分布式"], [], None, ["a", "b", "c"]]


def test_clean_html(spark):
    got = column(spark, ["<p>测试 <b>HTML</b></p>", "a\x0bb", "x y　z​", "<p>t</p><script>ignore()</script>", "&amp; <a\nb>c", "", None], text.clean_html)
    assert got == ["测试 HTML", "ab", "xyz", "t ignore()", "&amp; c", "", None]


def test_domains(spark):
    urls = ["http://u:p@h.com:8080/x", "http://a_b.com/x", "//host/p", "host/p", "mailto:a@b.c", "HTTP://Ex.COM?q", "http://h:8x/", "http://h/\x01", "http://a%zz/", None, ""]
    assert column(spark, urls, web.extract_domain) == ["h.com:8080", "a_b.com", "host", "", "", "Ex.COM", "", "", "", "", ""]


def test_fnv(spark):
    known = {"hello": 1335831723, "": 2166136261, "分布式": 392456118, "news.example.cn": 2028316653, "mapreduce": 171473699, "go": 1109423947}
    assert column(spark, [*known, None], hashing.fnv1a32) == [*known.values(), None]
    assert [hashing.fnv1a32_bytes(k.encode()) for k in known] == list(known.values())


def test_hash_of_text(spark):
    assert column(spark, ["a", ""], hashing.sha256_hex) == [hashlib.sha256(x).hexdigest() for x in (b"a", b"")]


def test_integers(spark):
    got = column(spark, ["1", "+2", "-3", " 1", "1 ", "x", "", None, "1.0", "99999999999999999999", "٣", "1\n"], text.integer_or_skip)
    assert got == [1, 2, -3, None, None, None, None, None, None, None, None, None]


def test_json(spark):
    lines = ['{"url":"u","html":"h"}', '{"URL":"u"}', '{"url":1}', "{'url':'a'}", "null", "not json", '{"url":"u"} x', None]
    strict = column(spark, lines, web.parse_crawl_json_strict)
    assert [r and r.url for r in strict] == ["u", "u", None, None, "", None, None, None]
    native = column(spark, lines, web.parse_crawl_json)
    assert native[0].url == "u" and native[0].timestamp is None
    df = spark.createDataFrame([(2, "a<b>& ", 1)], "n int, m string, u int")
    out = df.select(web.emit_crawl_json(F.col("n"), F.col("m"), F.col("u"))).first()[0]
    assert out == '{"count":2,"merged_text":"a\\u003cb\\u003e\\u0026\\u2028","unique_count":1}' and json.loads(out)["merged_text"] == "a<b>& "


@given(st.integers(0, 1 << 62))
def test_human_bytes(n):
    got = text.human_bytes(n)
    value, unit = got.split()
    assert unit == "B" and int(value) == n or abs(float(value) * 1024 ** (1 + "KMGTPE".index(unit[0])) - n) <= n * 0.01


def test_reports(spark):
    assert text.human_bytes(1536) == "1.50 KB" and text.comma_list(" a, ,b,") == ["a", "b"]
    df = spark.createDataFrame([(100, 25), (0, 5)], "a int, b int")
    assert [r[0] for r in df.select(text.saved_percent(F.col("a"), F.col("b"))).collect()] == [75.0, 0.0]


def test_word_counts(spark, rows):
    df = spark.createDataFrame([(1, "Hello hello x"), (2, None), (3, ""), (1, "x")], "d int, t string")
    assert rows(wordcount.count_words(df, "t")) == [("hello", 2), ("x", 2)]
    assert rows(wordcount.count_words(df.limit(0), "t")) == []
    kv = spark.createDataFrame([("k", "1"), ("k", "x"), ("k", "2"), ("n", None), (None, "4")], "key string, value string")
    assert rows(wordcount.sum_values(kv, "key", "value")) == [("k", 3), ("n", 0), (None, 4)] or rows(wordcount.sum_values(kv, "key", "value")) == sorted([("k", 3), ("n", 0), (None, 4)], key=repr)


def test_crawl_clean(spark):
    records = [(1, "https://news.example.cn/a", "<p>x</p>"), (2, "https://news.example.cn/b", "<b>x</b>"), (3, "https://news.example.cn/c", "y"), (4, "nohost", "z"), (5, "//h", " <p> "), (6, None, None)]
    df = spark.createDataFrame(records, "id int, url string, html string")
    cleaned = crawl_clean.cleaned_rows(df, F.col("id"))
    assert [tuple(r) for r in crawl_clean.merged_per_domain(cleaned).collect()] == [("news.example.cn", 3, 2, "x\n---\ny")]
    assert [tuple(r) for r in crawl_clean.counts_per_domain(cleaned).collect()] == [("news.example.cn", 3, 2)]


@pytest.mark.parametrize("n", [1, 3])
def test_layout(spark, n):
    df = spark.createDataFrame([("b", "1"), ("a", "2"), ("c", "3")], "key string, value string")
    from kvflow.sources.outputs import laid_out

    got = laid_out(df, n).collect()
    assert all(r.reduce_id == hashing.fnv1a32_bytes(r.key.encode()) % n for r in got)
    assert [r.key for r in got] == [r.key for r in sorted(got, key=lambda r: (r.reduce_id, r.key))]
