from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvflow.llm import mixing, neardup, pages, percentiles, terms, tokens, truncation


@pytest.fixture(scope="module")
def machine():
    return tokens.transducer(tokens.vocabulary_file())


@pytest.fixture(scope="module")
def oracle():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokens.read_ranks(tokens.vocabulary_file())
    return tiktoken.Encoding("own", pat_str=tokens.PRETOKEN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(codec="utf-8"), max_size=80))
def test_tokens_of_any_text(machine, oracle, text):
    ids = machine.encode(text)
    assert ids == oracle.encode_ordinary(text) and machine.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 5000, "=-" * 3000, " " * 4000, "\n" * 999, "哈" * 2000, "ab" * 1000 + "c", "<|endoftext|>", "it's  we'll\t\n x", "é​😂"])
def test_tokens_of_odd_texts(machine, oracle, text):
    assert machine.encode(text) == oracle.encode_ordinary(text)
    assert list(machine.transduce(b"")) == []


def test_tokens_are_emitted_early(machine):
    states = {0: 0}
    state, out, longest = 0, 0, 0
    data = ("x" * 40 + "the" * 400).encode()
    for i, byte in enumerate(data):
        state, found = machine._move(state, byte)
        out += len(b"".join(machine.tokens[t] for t in found))
        longest = max(longest, i + 1 - out)
    assert longest < 260 and states


@given(data=st.binary(max_size=40), cuts=st.lists(st.integers(0, 40), max_size=4))
def test_streaming_decoder(data, cuts):
    edges = sorted({0, len(data), *(min(c, len(data)) for c in cuts)})
    machine = tokens.Utf8()
    got = "".join(machine.feed(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)) + machine.end()
    try:
        assert got == data.decode("utf-8")
    except UnicodeDecodeError:
        assert "�" in got


def test_encode_table(spark, rows, oracle):
    data = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (None, "a", "x"), (4, "z" * 200_000, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    expected = sorted(((i, oracle.encode_ordinary(t) if t else []) for i, t, _ in data), key=repr)
    assert rows(tokens.encode(df, "doc_id", "text")) == expected
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert rows(tokens.with_sizes(df.select("doc_id", "text"), "text")) == sorted(((i, len(x)) for i, x in expected), key=repr)


def brute_percentiles(data):
    groups = defaultdict(list)
    for row in {d for d in data if d[3] is not None and 0 <= d[3] < percentiles.LIMIT_MS}:
        kind = row[1].strip(" ").lower() if row[1] is not None else None
        for day in (row[2][:10] if row[2] else "", "all"):
            groups[kind, day].append(row[3])
    return sorted(((k, d, p, len(v), sorted(v)[max(1, math.ceil(len(v) * p / 1000)) - 1]) for (k, d), v in groups.items() for p in percentiles.PERMILLE), key=repr)


def tasks(spark, data):
    df = spark.createDataFrame([(*d, "x") for d in data], "row_id bigint, type string, at string, elapsed_ms bigint, n string")
    return df.selectExpr("row_id", "type", "cast(at as timestamp) snapshot_at", "elapsed_ms", "n", "n as value", "n as day")


@pytest.mark.parametrize("bits", [1, 5, 8])
def test_percentiles(spark, rows, bits):
    rng = random.Random(3)
    data = [(i, rng.choice(["map", " MAP", "Reduce", None, ""]), rng.choice(["2025-01-01 23:59:59", "2025-01-02 00:00:00", None]), rng.choice([0, 7, 7, 7, None, -1, 1 << 40, rng.randrange(10**9)])) for i in range(400)]
    data += data[:50]
    cells = percentiles.summary(percentiles.measurements(tasks(spark, data)))
    got = rows(percentiles.percentiles(cells, bits_a_pass=bits).drop("error_bound"))
    assert got == brute_percentiles(data)


def test_percentiles_combine_within_their_bound(spark):
    rng = random.Random(4)
    data = [(i, "map", rng.choice(["2025-01-01", "2025-01-02"]), rng.randrange(1 << rng.randrange(1, 31))) for i in range(300)]
    frame = percentiles.measurements(tasks(spark, data))
    days = [percentiles.summary(frame.where(f"day = '2025-01-0{d}'"), 6) for d in (1, 2)]
    true = {r[:3]: r[4] for r in brute_percentiles(data)}
    for r in percentiles.percentiles(days[0].union(days[1]), dropped_bits=6).collect():
        assert 0 <= true[r.type, r.day, r.permille] - r.value <= r.error_bound == 63
    assert percentiles.percentiles(days[0].limit(0)).count() == 0


def brute_terms(data):
    records = {(i, k, v) for i, k, v in data}
    occurrences, in_records = Counter(), Counter()
    for _, k, v in records:
        if k:
            occurrences["key", k] += 1
            in_records["key", k] += 1
        found = [w.lower() for w in re.findall(r"[a-zA-Z㐀-鿿]+", v or "")]
        occurrences.update(("value", w) for w in found)
        in_records.update({("value", w) for w in found})
    return sorted(((*t, n, in_records[t], len(records)) for t, n in occurrences.items()), key=repr)


@pytest.mark.parametrize("part_rows", [1_000_000, 40])
def test_terms(spark, rows, part_rows):
    rng = random.Random(6)
    words = ["The", "the", "a", "计算", "x1y", "é", "", "-"]
    data = [(i, rng.choice(["hot"] * 20 + ["K", "k", "k ", "", None, f"rare{i}"]), rng.choice([None, "", "1", " ".join(rng.choices(words, k=rng.randrange(6)))])) for i in range(600)]
    data += data[:80] + [(None, "n", "w w"), (None, "n", "w w"), (9999, "long", "z " * 50_000)]
    df = spark.createDataFrame([(*d, "x") for d in data], "kv_id bigint, key string, value string, term string")
    assert rows(terms.term_counts(df, part_rows=part_rows)) == brute_terms(data)


def test_parts_of_one_hash(tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array(["value"] * 90), pa.array([f"t{i % 3}" for i in range(90)]), pa.array([7] * 90, pa.int64()), pa.array([1] * 90, pa.int64()), pa.array([1] * 90, pa.int64())], schema=terms.SCHEMA)
    got = [r for b in terms.radix_sums(iter([batch] * 5), f"file://{tmp_path}", part_rows=20) for r in b.to_pylist()]
    assert sorted((r["term"], r["occ"]) for r in got) == [("t0", 150), ("t1", 150), ("t2", 150)]
    assert not list((tmp_path / "kvflow").iterdir())


def test_marks(spark):
    df = spark.createDataFrame([(2, 1000), (3, 1000), (20, 1000), (21, 1000), (2, 10)], "n_records bigint, n_all bigint")
    assert [r.mark for r in terms.marked(df).collect()] == ["rare", None, None, "common", "rare"]
    empty = spark.createDataFrame([], "kv_id bigint, key string, value string")
    assert terms.term_counts(empty).count() == 0


def brute_apportion(weights, seats, caps):
    held = [0] * len(weights)
    for _ in range(seats):
        best = max((i for i in range(len(weights)) if held[i] < caps[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * held[i] + 1), -i), default=None)
        if best is None:
            break
        held[best] += 1
    return held


@given(weights=st.lists(st.integers(0, 50), min_size=1, max_size=6), seats=st.integers(0, 120), data=st.data())
def test_apportionment(weights, seats, data):
    caps = data.draw(st.lists(st.integers(0, 60), min_size=len(weights), max_size=len(weights)))
    assert mixing.apportion(weights, seats, caps) == brute_apportion(weights, seats, caps)


def test_mix(spark):
    rng = random.Random(8)
    sizes = {"a": 900, "b": 150, "c": 60}
    data, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            data.append((i, source, " ".join(rng.choices(["lorem", "ipsum", "dolor"], k=rng.randrange(1, 60))), "x"))
            i += 1
    data += [(i, "other", "text", "x"), (i + 1, None, "text", "x"), (i + 2, "a", None, "x"), (i + 3, "a", "", "x"), (None, "a", "text", "x"), (i + 4, "a", "word " * 2_000, "x")]
    documents = spark.createDataFrame(data, "doc_id bigint, source string, text string, n_tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.3, 2.0), ("c", 0.2, 1.0), ("none", 0.0, 1.0)], "source string, target_share double, max_repeats double")
    mixed = mixing.mix(documents, targets, block_tokens=128, shard_tokens=4000).cache()
    found = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    used, have = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        used[r.source] += r.n_tokens * r.repeats
    for r in tokens.with_sizes(documents.select("source", "text"), "text").collect():
        have[r.source] += r.n_tokens
    for source, share, most in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)):
        assert abs(found[source].share_reached - share) < 0.06 and used[source] <= most * have[source] and found[source].most_used <= most
    assert found["none"].tokens_used == 0
    assert sorted(mixing.mix(documents, targets, 128, 4000).collect()) == sorted(mixed.collect())
    assert mixing.mix(documents.limit(0), targets).count() == 0 and mixing.mix(documents, targets.limit(0)).count() == 0


def test_mix_with_sources_that_have_nothing(spark):
    data = [(i, "ab"[i % 2], "lorem ipsum dolor " * 20) for i in range(200)]
    documents = spark.createDataFrame(data, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.4999, 1.0), ("b", 0.4999, 1.0), ("absent", 0.0001, 1.0), ("banned", 0.0001, 0.0)], "source string, target_share double, max_repeats double")
    found = {r.source: r for r in mixing.shares(mixing.mix(documents, targets, block_tokens=128), targets).collect()}
    assert found["absent"].tokens_used == found["banned"].tokens_used == 0
    assert abs(found["a"].share_reached - 0.5) < 0.03 and found["a"].n_docs > 80


def test_pairs_tried_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PAIRS", 50)
    machine = tokens.Transducer(tokens.read_ranks(tokens.vocabulary_file()))
    assert machine.decode(machine.encode("some words, many of them, quite different ones")) == "some words, many of them, quite different ones"
    assert len(machine.compatible) <= 50


def sentences(rng, n):
    nouns = [f"noun{c}" for c in "abcdefghijklmnop"]
    forms = ["The {} was put beside the {} in the morning.", "Nobody saw the {} when the {} came along.", "After {} hours we moved the {} again.", "Each {} needs a {} to work well."]
    return " ".join(rng.choice(forms).format(rng.choice(nouns), rng.choice(nouns)) for _ in range(n))


def test_truncation(spark):
    rng = random.Random(9)
    whole = [(i, rng.choice(["s", None]), sentences(rng, rng.randrange(2, 9)), "x") for i in range(700)]
    whole += [(1000 + i, "s", t, "x") for i, t in enumerate([None, "", "…", "ok then...", "[removed]"])]
    limited = [(2000 + i, "lim", sentences(rng, 12)[:200], "x") for i in range(60)]
    limited = [r for r in limited if r[2][-1] not in ".! "]
    broken = []
    for i in range(80):
        text = sentences(rng, 4)
        at = rng.randrange(60, len(text) - 20)
        if text[at - 1].isalpha() and text[at].isalpha():
            broken.append((3000 + i, "s", text[:at], "x"))
    copies = [(4000, "s", "Some quite unusual beginning, which goes", "x"), (4001, "s", "Some quite unusual beginning, which goes on until here.", "x"), (4002, "s", "Marked text of a feed [...]", "x")]
    data = whole + limited + broken + copies
    df = spark.createDataFrame(data + limited[:3], "doc_id bigint, source string, text string, evidence string")
    got = truncation.truncated(df).cache()
    found = {r.doc_id for r in got.collect()}
    assert {r[0] for r in limited} <= found
    assert {4000, 4002} <= found
    assert 4001 not in found
    assert len(found & {r[0] for r in broken}) >= 0.8 * len(broken)
    assert len(found & {r[0] for r in whole}) <= 0.02 * len(whole)
    rates = {r.source: r for r in truncation.rates(df, got).collect()}
    assert rates["lim"].share == 1.0 and set(rates) == {"s", "lim", None}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_limits_inside_a_character(spark):
    rng = random.Random(13)
    ascii_ones = [sentences(rng, 12)[:200] for _ in range(60)]
    split = [("abc"[: i % 3] + sentences(rng, 1) + "炉子终于修好了仓库昨天整理" * 20).encode()[:200] for i in range(30)]
    split = [x.decode("utf-8", "ignore") for x in split]
    made = [("api", t) for t in ascii_ones if t[-1] not in ".! "] + [("api", t) for t in split]
    made += [("api", "x" * 199), ("api", "é" + "x" * 196), ("api", "é" * 99 + "."), ("chars", "é" + "x" * 197)]
    made += [("chars", t) for t in ascii_ones if t[-1] not in ".! "] + [("chars", "ö" + t[:199]) for t in ascii_ones if t[198] not in ".! "]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "doc_id bigint, source string, text string")
    found = {r.doc_id for r in truncation.truncated(df).where("evidence = 'limit'").collect()}
    assert {len(t.encode()) for t in split} == {198, 199, 200}
    for i, (source, text) in enumerate(made):
        assert (i in found) == (text in split or len(text) == 200), (source, text)


def test_limits_near_a_larger_one(spark, rows):
    data = [("s", x, x, 1, i) for x, n in ((1000, 900), (1010, 80), (1015, 6), (400, 3)) for i in range(n)]
    df = spark.createDataFrame(data, "source string, chars int, bytes int, widest int, copy bigint")
    assert {r.length for r in truncation.field_limits(df).collect()} == {1000, 1010, 1015}


def test_prefixes(spark, monkeypatch):
    texts = ["a", "ab", "abc", "b", "ba", "c", "c", "d" * 1000, "d" * 1001, "", "zz", "b."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = sorted((truncation._hash(t), len(t), t.endswith(".")) for t in set(texts) if any(o != t and o.startswith(t) for o in texts))
    for partitions in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(map(tuple, truncation.prefixes_of_others(df).collect())) == expected
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tokens_of_ascii_texts():
    for text in ("it's a test, see http://x.y/z?a=1 or www.a.b", "a\r\nb\n\nc d_e 3.14", "<b>x</b> [url=http://a.b]l[/url] &amp; y", "", " \t"):
        plain = truncation._markup.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
        assert truncation.tokens(text) == ["\n" if t[0] == "\n" else t for t in truncation._token.findall(plain)]


def test_closings_of_any_script(spark):
    rng = random.Random(15)
    data = [(i, "s", sentences(rng, 4) + (f" {w}" if (w := ("tbc", "1,024.50", None, None)[i % 4]) else ""), "x") for i in range(600)]
    data += [(1000 + i, "s", "\u597d" * (20 + i) + "\u3002 tbc", "x") for i in range(3)]
    cut = [t[: t.index(" ", 70) + 3 + i % 3] for i, t in enumerate(sentences(rng, 5) for _ in range(40))]
    cut = [t for t in cut if t[-1].isalpha() and t[-2].isalpha()]
    data += [(2000 + i, "s", t, "x") for i, t in enumerate(cut)]
    found = {r.doc_id for r in truncation.truncated(spark.createDataFrame(data, "doc_id bigint, source string, text string, evidence string")).collect()}
    assert not {i for i in found if i < 2000} and len(found) >= 0.7 * len(cut) > 10


def test_shorter_limits_and_prefixes_by_parameter(spark):
    rng = random.Random(16)
    data = [(i, "s", sentences(rng, 3)) for i in range(300)] + [(1000 + i, "short", "".join(rng.choices("abcdefgh", k=12))) for i in range(40)]
    data += [(2000 + i, "short", "".join(rng.choices("abcdefgh", k=rng.randrange(6, 25))) + ".") for i in range(60)] + [(3000, "p", "Fine words"), (3001, "p", "Fine words and more.")]
    df = spark.createDataFrame(data, "doc_id bigint, source string, text string")
    found = {r.doc_id: r.evidence for r in truncation.truncated(df, prefix_chars=1, least_limit=1).collect()}
    assert all(found.get(1000 + i) in ("limit", "goes on") for i in range(40)) and sum(found[1000 + i] == "limit" for i in range(40)) == 40 and found[3000] == "prefix"
    assert "prefix" not in {r.evidence for r in truncation.truncated(df).collect()}


def test_ends_are_learned_from_all_of_every_text(spark):
    rng = random.Random(17)
    line = lambda: sentences(rng, 3).replace(". ", " and ").rstrip(".")
    texts = ["\n".join(line() for _ in range(200)) for _ in range(40)]
    cut = [t[: t.rindex(" ", 0, len(t) - 20 - i) + 3] for i, t in enumerate(texts[:12])]
    data = [(i, "s", t) for i, t in enumerate(cut + texts[12:])]
    assert min(len(t) for _, _, t in data) > 20_000
    df = spark.createDataFrame(data, "doc_id bigint, source string, text string")
    found = {r.doc_id for r in truncation.truncated(df).collect()}
    assert len(found) >= 10 and found <= set(range(12))


def test_all_examples_count_in_any_order(spark):
    rng = random.Random(18)
    texts = [sentences(rng, 30) for _ in range(50)] + [sentences(rng, 30)[:-1] for _ in range(50)]
    ends = truncation.Ends(sorted({t.lower() for x in texts for t in truncation.tokens(x)}))
    assert [len(ends.examples(x, frozenset())[0]) // truncation.SEEN for x in texts] == [30] * 50 + [29] * 50
    assert all(len(ends.examples(x, frozenset())[3]) == (0 if x[-1] == "." else truncation.SEEN) for x in texts)
    packed = [list(m.to_pydict()["packed"]) for m in truncation._made(SimpleNamespace(value=(ends, frozenset())), iter(pa.RecordBatch.from_arrays([pa.array([x])], names=["text"]) for x in texts))]
    df = spark.createDataFrame([(bytearray(m[0]),) for m in packed], "packed binary")
    first, other = truncation.learned(df.repartition(1)), truncation.learned(df.orderBy(F.hash("packed")).repartition(5))
    assert first.any() and (first == other).all()


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.sampled_from([*"<>/ab p\n\t!-", "<p>", "</p>", "<div class='x'>", "</div>", "<li>", "<table><tr><td>", "<!--", "-->", "<script>", "</script>", "<a href=#>", "text. "]), max_size=60))
def test_every_piece_is_in_one_block(parts):
    html = "".join(parts)
    numbers = [n for b in pages.blocks(html) for n in b.pieces]
    assert numbers == list(range(len(pages.pieces(html))))


def test_wrappers_align():
    assert pages.infer([("nav", "side", "foot"), ("nav", "foot"), ("note", "nav", "foot"), ("nav", "side", "foot", "note")]) == ["note", "nav", "side", "foot", "note"]


def page(rng, i):
    nav = "".join(f"<li><a href='/{rng.random()}'>{w}</a></li>" for w in ("Home", "News", "Help"))
    body = "".join(f"<p>{sentences(rng, 3)} <b>bold</b> words</p>" if rng.random() < 0.7 else f"<ul><li>{sentences(rng, 1)}</li><li>item {i}</li></ul>" for _ in range(4))
    share = "<div class='share'>Share this</div>" if rng.random() < 0.5 else ""
    side = f"<aside><h4>More</h4><a href=#>Other {i}</a> | <a href=#>Again {i}</a></aside>" if rng.random() < 0.6 else ""
    return f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><div class=main><h1>Head {i}</h1>{share}{body}</div><script>var x={i};</script>{side}<footer>Imprint<br>Privacy<br></footer><!-- {i} --></body></html>"


def expected_pieces(html):
    main = html[html.index("<h1>") : html.index("</div><script>")].replace("<div class='share'>Share this</div>", "")
    wanted = Counter(pages.pieces(main))
    return sorted(wanted.elements())


@pytest.fixture(scope="module")
def crawl():
    rng = random.Random(10)
    return [(i, f"https://{'www.' if i % 3 else ''}s{i % 2}.example/{i}", page(rng, i)) for i in range(80)]


def test_main_pieces(spark, crawl):
    odd = [(1000, None, crawl[0][2]), (1001, "x", None), (1002, "https://s0.example/", ""), (1003, "https://s0.example/", "<br>"), (1004, "https://s1.example/q", crawl[1][2]), (None, "https://s1.example/q", crawl[1][2]), (1005, "https://s1.example/l", "<p>" + "long text. " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in crawl + odd], "rec_id bigint, url string, html string, site string")
    found = defaultdict(list)
    for r in pages.main_pieces(df).collect():
        found[r.rec_id].append(r.piece_no)
    for i, _, html in crawl:
        cut = pages.pieces(html)
        assert sorted(cut[n] for n in found[i]) == expected_pieces(html)
    assert found[1004] == found[1] == found[None] and not found.keys() & {1001, 1002, 1003}
    assert pages.main_pieces(df.limit(0)).count() == 0


def test_small_sites_share_paths_with_a_large_one(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    teasers = lambda: "".join(f"<div>{word()} {word()} {word()}</div>" for _ in range(3))
    large = lambda: f"<div class=top><a href=#>Home</a></div><main><h1>{word()}</h1><p>{sentences(rng, 3)}</p></main><section><h4>More</h4></section>{teasers()}<div class=foot><a href=#>Imprint</a></div>"
    small = lambda: f"<nav><a href=#>Home</a></nav><h1>{word()}</h1><div>{sentences(rng, 3)}</div><div>{sentences(rng, 2)}</div><aside><h4>Read on</h4></aside>{teasers()}<footer><a href=#>Terms</a></footer>"
    made = [("large", large()) for _ in range(300)] + [(f"small{i % 2}", small()) for i in range(28)] + [("small0", large())]
    data = [(i, f"https://{host}.example/{i}", html) for i, (host, html) in enumerate(made)]
    found = defaultdict(list)
    for r in pages.main_pieces(spark.createDataFrame(data, "rec_id bigint, url string, html string")).collect():
        found[r.rec_id].append(r.piece_no)
    for i, (_, html) in enumerate(made):
        assert sorted(found[i]) == ([1, 2, 3] if html.startswith("<nav>") else [1, 2])


def test_long_texts_recur_too(spark):
    rng = random.Random(14)
    about = "<h4>About</h4><div>" + " ".join(f"we{c} write here about gardens" for c in "abcdefg") + " and more.</div>"
    made = [f"<nav><a href=#>Home</a></nav><h1>Head {i}</h1><div>{sentences(rng, 5)}<br>{sentences(rng, 5)}</div>{about if i % 3 else ''}<footer><a href=#>Terms</a></footer>" for i in range(60)]
    data = [(i, f"https://s.example/{i}", html) for i, html in enumerate(made)]
    found = defaultdict(list)
    for r in pages.main_pieces(spark.createDataFrame(data, "rec_id bigint, url string, html string")).collect():
        found[r.rec_id].append(r.piece_no)
    assert all(sorted(found[i]) == [1, 2, 3] for i in range(len(made)))


def test_models_too_large_to_broadcast(spark, rows, crawl, monkeypatch):
    df = spark.createDataFrame(crawl, "rec_id bigint, url string, html string")
    small, classes = rows(pages.main_pieces(df)), rows(neardup.class_links(df))
    monkeypatch.setattr(pages, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(neardup, "SHIPPED_KEYS", 0)
    assert rows(pages.main_pieces(df)) == small and rows(neardup.class_links(df)) == classes


def test_landmarks_among_paragraphs_are_body(spark):
    rng = random.Random(17)
    made = []
    for i in range(60):
        inner = f"<h1>Head {i}</h1><p>{sentences(rng, 2)}</p><h4>Part {i}</h4><p>{sentences(rng, 2)}</p><p><a href=#>See also the noun {rng.random()}</a></p><p>{sentences(rng, 2)}</p>"
        made.append(f"<nav><a href=#>Home</a></nav><div class=main>{inner}</div><aside><h4>More of it</h4><p>{rng.random()} teaser</p><h4>Read on {i}</h4></aside><footer><a href=#>Terms</a></footer>")
    found = defaultdict(list)
    for r in pages.main_pieces(spark.createDataFrame([(i, "https://s.example/x", h) for i, h in enumerate(made)], "rec_id bigint, url string, html string")).collect():
        found[r.rec_id].append(r.piece_no)
    assert all(sorted(found[i]) == [1, 2, 3, 4, 5, 6] for i in range(60))


def test_every_page_with_landmarks_of_its_own(spark):
    rng = random.Random(18)
    name = lambda: "".join(rng.choices("ghijklmnop", k=8))
    made = [f"<nav id=post-{i + 1000}><a href=#>Home</a></nav><h1>Head {i}</h1><p>{sentences(rng, 3)}</p><div class={name()}><a href=#>{name()}</a></div><p>{sentences(rng, 2)}</p><div class={name()}><a href=#>Link</a></div><footer><h4>End</h4>{name()} {name()}</footer>" for i in range(400)]
    found = defaultdict(list)
    for r in pages.main_pieces(spark.createDataFrame([(i, "https://s.example/x", h) for i, h in enumerate(made)], "rec_id bigint, url string, html string")).collect():
        found[r.rec_id].append(r.piece_no)
    assert sum(set(found[i]) >= {1, 2, 4} for i in range(400)) >= 398


def test_many_different_streams_of_one_site():
    import time

    rng = random.Random(19)
    marks = [f"div.{c}{i}~" for c in "ab" for i in range(20)]
    streams = {tuple(m for m in marks if rng.random() < 0.6) for _ in range(100_000)}
    assert len(streams) > 99_000
    rows = pa.RecordBatch.from_arrays([pa.array(["s"] * len(streams)), pa.array([list(x) for x in streams]), pa.array([1] * len(streams), pa.int64())], names=["site", "wrapper", "a"])
    began = time.process_time()
    (made,) = pages._range_wrappers(iter([rows]))
    wrapper = made.column(2)[0].as_py()
    assert set(wrapper) == set(marks) and len(wrapper) < 2 * len(marks) and time.process_time() - began < 90
    assert all(len(pages.align(wrapper, x)) == len(x) for x in list(streams)[:500])


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(20)
    for _ in range(200):
        x, y = (rng.choices("abcd", k=rng.randrange(12)) for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        pairs = pages.align(x, y)
        assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs) and pairs == sorted(set(pairs))


def test_candidates_of_unplaced_landmarks():
    assert pages.candidates(["a", "b", "c"], ["a", "x", "c"], [True, False, True]) == [(0, 0), (1, 2), (1, 2), (3, 3)]
    assert pages.candidates([], ["x"], [False]) == [(0, 0), (0, 0)]


def test_near_duplicates(spark, rows):
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = [rng.choice([f"w{j}" for j in range(400)]) for _ in range(120)]
        texts.append(base)
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(120)] = "new"
            texts.append(copy)
    texts += [texts[0]] * 3 + [["one", "two"], ["a", "b", "c"], ["a", "b", "c"]]
    data = [(i, f"https://h.example/{i}", f"<div><h1>{' '.join(t[:3])}</h1><p>{' '.join(t[3:])}.</p></div>") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "")]
    df = spark.createDataFrame([(*d, "x") for d in data], "rec_id bigint, url string, html string, cls string")
    sets = {i: {tuple(t[k : k + 3]) for k in range(len(t) - 2)} for i, t in enumerate(texts)}
    expected = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5]
    assert rows(neardup.duplicate_pairs(df)) == sorted(expected, key=repr)
    classes = {r.rec_id: r for r in neardup.class_links(df).collect()}
    assert len({classes[i].class_id for i, t in enumerate(texts) if t == texts[0]}) == 1 and classes[0].n_records == 4
    assert neardup.duplicate_pairs(df.limit(0)).count() == 0


def sketch(sets):
    """Sketches of sets of runs."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return neardup.sketches(owner, np.concatenate(sets).astype(np.uint32), len(sets))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (40, 300, 3000):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 1 << 32, size, np.uint32)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 32, size // 2, np.uint32)])) for _ in range(2))
            table = sketch([a, b])
            errors.append((table[0] == table[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.04
    assert (sketch([np.array([5])]) == sketch([np.array([5])])).all()


def test_run_hashes_of_lists():
    found = [["a", "b", "c", "d"], [], ["a", "b"], ["b", "c", "d"], ["a", "b", "c"] * 2]
    owner, runs = neardup.run_hashes(found)
    sets = [set(runs[owner == i].tolist()) for i in range(len(found))]
    assert [len(x) for x in sets] == [2, 0, 0, 1, 3] and sets[3] < sets[0] and len(sets[4] & sets[0]) == 1
    assert [len(x) for x in neardup.run_hashes([])] == [0, 0]


def table_of_sets(spark, sets):
    bands = neardup.band_keys(sketch(sets))
    rows = [(i, i, x.view(np.int32).tolist(), bands[i].tolist()) for i, x in enumerate(sets)]
    return spark.createDataFrame(rows, neardup.SETS)


def test_a_chain_of_ten_thousand_classes(spark):
    runs = np.random.default_rng(2).permutation(np.unique(np.random.default_rng(3).integers(0, 1 << 32, 90_000, np.uint32)))
    sets = [np.sort(runs[8 * i : 8 * i + 40]) for i in range(10_000)]
    got = {tuple(r) for r in neardup.similar_classes(table_of_sets(spark, sets)).collect()}
    assert got == {(i, i + 1) for i in range(9_999)}


def test_a_bucket_over_many_partitions(spark, rows):
    # Copies with one run less each: all similar, so most buckets hold nearly all classes and go over many partitions.
    runs = np.unique(np.random.default_rng(4).integers(0, 1 << 32, 300, np.uint32))
    sets = [np.delete(runs, i) for i in range(120)] + [np.unique(np.random.default_rng(5).integers(0, 1 << 32, 50, np.uint32))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    edges = neardup.candidates(table_of_sets(spark, sets))
    assert edges.count() < 121 * 64 and edges.where("hub = cls").count() == 0
    got = rows(neardup.similar_classes(table_of_sets(spark, sets)))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(((i, j) for i in range(120) for j in range(i + 1, 120)), key=repr)


def test_pages_without_main_text(spark):
    data = [(i, "https://h.example/1", html) for i, html in enumerate(["<nav><a href=#>Home</a></nav>", "<p></p>", "<!-- a -->", "<script>x</script>", "<br>"])]
    df = spark.createDataFrame(data, "rec_id bigint, url string, html string")
    assert neardup.duplicate_pairs(df).count() == 0 and neardup.class_links(df).count() == 0 and neardup.groups(df).count() == 0
    none = neardup._sets(pa.array([1, 2]), ["", "two words"], set())
    assert none.num_rows == 0 and neardup._sets(pa.array([], pa.int64()), [], set()).num_rows == 0
    one = neardup._sets(pa.array([1, 2, 3]), ["", "three words here", "three words here"], set()).to_pylist()
    assert [r["id"] for r in one] == [2, 3] and one[0]["cls"] == one[1]["cls"] and len(one[0]["runs"]) == 1 and one[1]["runs"] == []


def test_groups(spark):
    words = [f"w{j}" for j in range(60)]
    texts = [words[:40], words[4:44], words[8:48], ["x", "y", "z"]]
    data = [(i, "https://h.example/1", f"<p>{' '.join(t)}.</p>") for i, t in enumerate(texts)]
    got = {r.rec_id: r.group_id for r in neardup.groups(spark.createDataFrame(data, "rec_id bigint, url string, html string")).collect()}
    assert got[0] == got[1] == got[2] != got[3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}
