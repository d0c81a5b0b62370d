from __future__ import annotations

import json
import random
from collections import defaultdict
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from kvflow.operators import nested, skew, timestamps

CRAWLERS = [("b", "Europe/Berlin", "dmy"), ("n", "America/New_York", "mdy"), ("s", "Asia/Shanghai", "ymd"), ("k", "Asia/Kolkata", "dmy"), ("c", "America/Chicago", "mdy"), ("bad", "No/Where", "dmy"), (None, "UTC", "ymd"), ("l", "Australia/Lord_Howe", "dmy")]


def micros(*when, us=0):
    return int(datetime(*when, tzinfo=UTC).timestamp()) * 1_000_000 + us


CASES = [
    ("2024-02-10T08:58:40.194645", "n", micros(2024, 2, 10, 13, 58, 40, us=194645)),
    ("2024-02-10T08:58:40.1946459", None, None),
    ("2024-02-10t08:58:40.1234567z", None, micros(2024, 2, 10, 8, 58, 40, us=123456)),
    ("  2024-02-10T08:58:40Z\t", None, micros(2024, 2, 10, 8, 58, 40)),
    ("2024-02-10T08:58:40+05:30[Asia/Tokyo]", None, micros(2024, 2, 10, 3, 28, 40)),
    ("2024-02-10T08:58:40-00", None, micros(2024, 2, 10, 8, 58, 40)),
    ("2024-02-10 08:58:40.5 +0530", None, micros(2024, 2, 10, 3, 28, 40, us=500000)),
    ("2024-02-10T08:58:40+25:00", None, None),
    ("2024-02-10 08:58:40 america/new_york", None, micros(2024, 2, 10, 13, 58, 40)),
    ("2024-02-10 08:58:40 Nowhere/City", "n", None),
    ("2024-02-10 08:58:40 CST", "s", micros(2024, 2, 10, 0, 58, 40)),
    ("2024-02-10 08:58:40 CST", "c", micros(2024, 2, 10, 14, 58, 40)),
    ("2024-02-10 08:58:40 CST", "b", None),
    ("2024-02-10 08:58:40 IST", "k", micros(2024, 2, 10, 3, 28, 40)),
    ("2024-11-03 01:30:00 EST", "n", micros(2024, 11, 3, 6, 30)),
    ("2024-11-03 01:30:00", "n", micros(2024, 11, 3, 5, 30)),
    ("2024-03-10 02:30:00", "n", micros(2024, 3, 10, 7, 30)),
    ("2024-10-06 02:10:00", "l", micros(2024, 10, 5, 15, 40)),
    ("02/03/2024 10:00:00", "n", micros(2024, 2, 3, 15)),
    ("02/03/2024 10:00:00", "b", micros(2024, 3, 2, 9)),
    ("02/03/2024 10:00:00", "s", None),
    ("13.02.2024 10:00:00", "b", micros(2024, 2, 13, 9)),
    ("02/13/2024 1:00:05 PM", "n", micros(2024, 2, 13, 18, 0, 5)),
    ("02/13/2024 13:00:05 PM", "n", None),
    ("13/02/2024 10:00:00", "n", None),
    ("2024/02/13 10:00", "b", micros(2024, 2, 13, 9)),
    ("2024.02.13 10:00:00", "b", micros(2024, 2, 13, 9)),
    ("20240213T100000", "b", micros(2024, 2, 13, 9)),
    ("20240213100000", "b", micros(2024, 2, 13, 9)),
    ("10-Aug-2025 01:26:16", "b", micros(2025, 8, 9, 23, 26, 16)),
    ("Fri, 02 Aug 2024 10:52:16 GMT", None, micros(2024, 8, 2, 10, 52, 16)),
    ("Fri, 2 Aug 2024 10:52:16 -0400", None, micros(2024, 8, 2, 14, 52, 16)),
    ("April 17, 2025 at 12:26am", "b", micros(2025, 4, 16, 22, 26)),
    ("April 17, 2025 at 12:26pm", "b", micros(2025, 4, 17, 10, 26)),
    ("Sep 22, 2025 2:29:33 AM CEST", "b", micros(2025, 9, 22, 0, 29, 33)),
    ("2024年2月3日 04:05:06", "s", micros(2024, 2, 2, 20, 5, 6)),
    ("1707681865", None, micros(2024, 2, 11, 20, 4, 25)),
    ("1707681865123", None, micros(2024, 2, 11, 20, 4, 25, us=123000)),
    ("1707681865123456", None, micros(2024, 2, 11, 20, 4, 25, us=123456)),
    ("1707681865.50", None, micros(2024, 2, 11, 20, 4, 25, us=500000)),
    ("1407681865", None, None),
    ("2024-02-30 10:00:00", "b", None),
    ("2024-02-10 24:00:00", "b", None),
    ("2024-02-10 10:00:60", "b", None),
    ("0000-00-00 00:00:00", "b", None),
    ("2024-02-10", "b", None),
    ("10:00:00", "b", None),
    ("2024-02-10 10:00:00", "bad", None),
    ("2024-02-10 10:00:00", None, None),
    ("now", "b", None),
    ("", "b", None),
    (None, "b", None),
    ("x" * 100_000, "b", None),
]


def test_timestamps(spark):
    data = [(i, t, c, "x", "y") for i, (t, c, _) in enumerate(CASES)]
    df = spark.createDataFrame(data, "rec_id int, timestamp string, crawler_id string, utc_micros string, _text string")
    crawlers = spark.createDataFrame(CRAWLERS, "crawler_id string, tz_name string, date_order string")
    got = {r.rec_id: r.utc_micros for r in timestamps.normalise(df, crawlers, ["rec_id"]).collect()}
    wrong = [(CASES[i], v) for i, v in sorted(got.items()) if v != CASES[i][2]]
    assert not wrong and len(got) == len(CASES)
    assert timestamps.normalise(df.limit(0), crawlers.limit(0), ["rec_id"]).count() == 0
    assert timestamps.normalise(df.union(df), crawlers.union(crawlers), ["rec_id"]).count() == 2 * len(CASES)


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(1, "2024-02-10 08:00:00", "b")], "rec_id int, timestamp string, crawler_id string")
    crawlers = spark.createDataFrame(CRAWLERS, "crawler_id string, tz_name string, date_order string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert timestamps.normalise(df, crawlers, ["rec_id"]).first().utc_micros == micros(2024, 2, 10, 7)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_plain_timestamps(spark):
    df = spark.createDataFrame([("2024-02-10T08:58:40Z",), ("2024-02-10t08:58:40Z",), (" 2024-02-10T08:58:40Z",), ("2024-02-10T08:58:40Z\n",)], "t string")
    assert [r[0] for r in df.select(timestamps.is_plain(F.col("t"))).collect()] == [True, False, False, False]


def brute_lists(key, body):
    text = (body or "").strip("﻿ \t\r\n")
    try:
        doc = json.loads(text)
        doc = json.loads(doc) if isinstance(doc, str) else doc
    except ValueError:
        return
    if not isinstance(doc, dict):
        return
    for child, field in nested.CHECKPOINT_LISTS.items():
        for i, x in positions(doc.get(child)):
            if x is None:
                continue
            if field is None:
                for j, y in positions(x):
                    if y is not None:
                        yield key, child, i, j, {True: "true", False: "false", 1: "true", 0: "false"}.get(y, str(y))
            else:
                value = x.get(field) if isinstance(x, dict) else None
                yield key, child, i, -1, "" if value is None else value


def positions(value):
    if isinstance(value, list):
        yield from enumerate(value)
    elif isinstance(value, dict):
        if all(k.isdigit() for k in value):
            yield from ((int(k), v) for k, v in value.items())
        else:
            yield 0, value


BODIES = [
    json.dumps({"map_tasks": [{"state": "a\"]}[{\\", "x": {"state": "inner", "map_tasks": [1]}}, None, {"id": 1}, {"state": None}], "decisions": None}),
    json.dumps({"a": {"map_tasks": [{"state": "no"}]}, "reduce_tasks": {"state": "one", "id": 0}}, indent=3),
    "﻿ \t" + json.dumps({"decisions": {"3": {"type": "t3"}, "0": {"type": "任务"}}}) + "\r\n",
    json.dumps(json.dumps({"map_done_for_reduce": [[True, None, 0, 1], None, [], {"1": False}]}, indent=1)),
    json.dumps({"map_tasks": {}, "reduce_tasks": [], "map_done_for_reduce": [[]]}),
    '{"map_tasks":[{"state":"a"}],"map_tasks":[{"state":"last"}]}',
    '{"map_tasks":[{"state":"a"}]',
    '{"map_tasks":[{"state":"a"]}}',
    '{"map_tasks":[{"state":"a"}]}}',
    '{"map_tasks":[{"state":"a}]}',
    "[]", "{}", "", "   ", "EOF", "null", '"', '"{', "[{\"map_tasks\":[{\"state\":\"a\"}]}]",
    json.dumps({"map_tasks": [{"state": f"s{i}", "pad": "[{\\\"" * 50} for i in range(3000)]}),
]


def test_nested(spark, rows):
    data = [(i, b, "x") for i, b in enumerate(BODIES)] + [(1, BODIES[1], "x"), (99, None, "x"), (None, BODIES[2], "x")]
    df = spark.createDataFrame(data, "ckpt_id bigint, body string, val string")
    expected = sorted((r for i, b, _ in data for r in brute_lists(i, b)), key=repr)
    assert rows(nested.flatten_lists(df, "ckpt_id", "body", nested.CHECKPOINT_LISTS)) == expected
    assert nested.flatten_lists(df.limit(0), "ckpt_id", "body", nested.CHECKPOINT_LISTS).count() == 0


def test_nested_random(spark, rows):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return [None, True, rng.randrange(9), rng.choice(['a"b', "\\", "{[", "é大", "x" * 40, ""])][kind]
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["state", "type", "k", 'q"', "0"]): value(depth - 1) for _ in range(rng.randrange(4))}

    def item():
        return {"state": rng.choice(["idle", "done"]), "more": value(3)} if rng.random() < 0.8 else None

    docs = [json.dumps({"noise": value(4), "map_tasks": [item() for _ in range(5)], "z": value(2)}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(200)]
    docs += [d[: rng.randrange(len(d))] for d in docs[:50]]
    df = spark.createDataFrame(list(enumerate(docs)), "ckpt_id bigint, body string")
    lists = {"map_tasks": "state"}
    expected = sorted((r for i, b in enumerate(docs) for r in brute_lists(i, b)), key=repr)
    assert rows(nested.flatten_lists(df, "ckpt_id", "body", lists)) == expected


def brute_totals(data):
    seen, out = set(), defaultdict(lambda: [0, 0])
    for i, k, v in data:
        if not k or (i, k, v) in seen:
            continue
        seen.add((i, k, v))
        out[k][0] += 1
        if v and v.lstrip("+-").isdecimal() and v.isascii() and len(v) - len(v.lstrip("+-")) < 2:
            out[k][1] += int(v)
    return sorted(((k, *n) for k, n in out.items()), key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_key_totals(spark, rows, partitions):
    rng = random.Random(2)
    values = ["1", "+2", "-3", "--3", "1 ", " 1", "", None, "x", "1.0", "１", "+", "12abc"]
    keys = ["hot"] * 60 + ["a", "A", "a ", "", None, "é", "é", "k" * 5000]
    data = [(i, rng.choice(keys), rng.choice(values)) for i in range(3000)]
    data += rng.sample(data, 300) + [(None, "a", "1"), (None, "a", "1"), (None, "a", "2")]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], "kv_id bigint, key string, value string, n_records string, _record int")
    assert rows(skew.key_totals(df, partitions=partitions)) == brute_totals(data)
    assert skew.key_totals(df.limit(0)).count() == 0


def test_heavy_key_is_split(spark):
    df = spark.range(20_000).select(F.when(F.col("id") >= 0, F.col("id")).alias("kv_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    sizes = skew.spread(df, ["key"], ["kv_id"], 10).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 4_000
    plan = skew.key_totals(df.withColumn("value", F.concat(F.lit("x"), "key")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1
