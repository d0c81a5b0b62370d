from __future__ import annotations

import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from kvflow.__main__ import follow, main, summary
from kvflow.plans import failures, jobs, sizes
from kvflow.plans.jobs import Job, JobAlreadyRunning, JobConfig, JobManager, JobState, job_logs
from kvflow.plans.registry import ConfigError, builtin
from kvflow.plans.service import routes, server
from kvflow.sources import lines
from kvflow.streaming.words import windowed_counts

WORDS = "Hello world hello MapReduce\n分布式 计算 框架 MapReduce\nGo 语言 实现 分布式 MapReduce\nhello Go 分布式\n"
GOLDEN = ["hello\t3\nworld\t1\n分布式\t3\n", "go\t2\n框架\t1\n语言\t1\n", "mapreduce\t3\n实现\t1\n计算\t1\n"]


@pytest.fixture
def words(tmp_path):
    path = tmp_path / "input.txt"
    path.write_text(WORDS, encoding="utf-8")
    return str(path)


def read(paths):
    return [open(p, encoding="utf-8").read() for p in paths]


def test_splits(tmp_path, words):
    assert [s.length for s in lines.split_plan([words], 10)] == [28, 34, 37, 19]
    path = tmp_path / "a"
    path.write_bytes(b"hello world\n" * 100)
    assert [s.length for s in lines.split_plan([str(path)], 200)] == [204] * 5 + [180]
    assert {s.length for s in lines.split_plan([str(path)], 12)} == {24}
    path.write_bytes(b"")
    assert lines.split_plan([str(path)]) == [lines.Split(0, str(path), 0, 0)]
    path.write_bytes(b"x" * ((4 << 20) + 2))
    with pytest.raises(ValueError, match="LINE_TOO_LONG"):
        lines.split_plan([str(path)], 1)
    assert len(lines.split_plan([str(path)])) == 1
    path.write_bytes(b"x" * (3 << 20) + b"\n" + b"y\n")
    assert [s.length for s in lines.split_plan([str(path)], 1)] == [(3 << 20) + 1, 2]
    with pytest.raises(ValueError):
        lines.split_plan([])
    with pytest.raises(OSError):
        lines.split_plan([str(tmp_path / "none")])


def test_word_count_job(spark, tmp_path, words):
    manager = JobManager(spark, str(tmp_path / "work"))
    job = manager.submit(JobConfig.preset("wordcount", [words], work_dir=str(tmp_path / "work")))
    assert job.state is JobState.COMPLETED and read(job.outputs) == GOLDEN and job.metrics["ReduceOutputKeys"] == 9
    assert [r.kind for r in job_logs(spark, str(tmp_path / "work")).orderBy("time").collect()] == ["start", "finish"]
    again = JobManager(spark, str(tmp_path / "work"))
    assert again.find(job.id).outputs == job.outputs and not again.recoverable() and again.history()[0].id == job.id


def test_python_functions_agree(spark, tmp_path, words):
    plugin = tmp_path / "plug.py"
    plugin.write_text("import re\n\n\ndef Map(file, contents):\n    return [(w.lower(), '1') for w in re.findall(r'[a-zA-Z\\u4e00-\\u9fff]+', contents)]\n\n\ndef Reduce(key, values):\n    return str(sum(map(int, values)))\n\n\nCombine = Reduce\n")
    registry = builtin()
    assert registry.load_plugin(str(plugin), "p") == ["p_map", "p_reduce", "p_combine"]
    manager = JobManager(spark, str(tmp_path / "work"), registry)
    job = manager.submit(JobConfig((words,), "p_map", "p_reduce", "p_combine", work_dir=str(tmp_path / "work")))
    assert not job.error and read(job.outputs) == GOLDEN


def test_wrong_functions(spark, tmp_path):
    registry = builtin()
    with pytest.raises(ConfigError):
        registry.resolve("nope", "wordcount_reduce")
    with pytest.raises(ConfigError):
        registry.resolve("wordcount_map", "nope")
    with pytest.raises(ConfigError):
        registry.resolve("crawl_clean_map", "crawl_clean_reduce", "wordcount_combine")
    assert registry.resolve("wordcount_map", "wordcount_reduce", "nope")[2] is None
    path = tmp_path / "bad.py"
    path.write_text("Map = 3\n")
    with pytest.raises(ConfigError):
        registry.load_plugin(str(path))


def test_crawl_job(spark, tmp_path):
    path = tmp_path / "data.jsonl"
    records = [{"url": "https://n.cn/1", "html": "<p>a</p>"}, {"url": "https://n.cn/2", "html": "a"}, {"url": "x", "html": "b"}, {"url": "//h", "html": "<p></p>"}]
    path.write_text("\n \nnot json\n" + "\r\n".join(map(json.dumps, records)) + "\n")
    job = JobManager(spark, str(tmp_path / "w")).submit(JobConfig.preset("crawl_clean", [str(path)], work_dir=str(tmp_path / "w"), n_reduce=2))
    assert "".join(read(job.outputs)) == 'n.cn\t{"count":2,"merged_text":"a","unique_count":1}\n' and len(job.outputs) == 2


def test_empty_and_missing_input(spark, tmp_path):
    manager = JobManager(spark, str(tmp_path / "w"))
    (tmp_path / "empty").write_text("")
    job = manager.submit(JobConfig.preset("wordcount", [str(tmp_path / "empty")], work_dir=str(tmp_path / "w")))
    assert read(job.outputs) == ["", "", ""]
    job = manager.submit(JobConfig.preset("wordcount", [str(tmp_path / "none")], work_dir=str(tmp_path / "w")))
    assert job.state is JobState.FAILED and "could not be read" in job.error and job.decisions[-1]["type"] == "job_aborted"
    with pytest.raises(ConfigError):
        manager.submit(JobConfig((), "wordcount_map", "wordcount_reduce"))


def test_recovery(spark, tmp_path, words):
    work = tmp_path / "w"
    broken = Job("abc", JobConfig.preset("wordcount", [words], work_dir=str(work)), JobState.RUNNING, created_at="2024-01-01T00:00:00Z")
    (work / "abc").mkdir(parents=True)
    (work / "abc" / "manifest.json").write_text(json.dumps(broken.manifest()))
    (work / "other").mkdir()
    (work / "other" / "manifest.json").write_text("{")
    manager = JobManager(spark, str(work))
    assert [j.id for j in manager.recoverable()] == ["abc"]
    assert read(manager.recover("abc").outputs) == GOLDEN and not manager.recoverable()
    with pytest.raises(ConfigError):
        manager.recover("abc")


def test_recovery_goes_on_with_the_reduce_stage(spark, tmp_path, words, monkeypatch):
    work = str(tmp_path / "w")
    manager = JobManager(spark, work)
    config = JobConfig.preset("wordcount", [words], work_dir=work)
    with monkeypatch.context() as patch:
        patch.setattr(JobManager, "_reduce", lambda self, job: (_ for _ in ()).throw(KeyboardInterrupt))
        patch.setattr(threading, "excepthook", lambda *_: None)
        job = manager.submit(config)
    assert job.state is JobState.RUNNING and job.stages == ["map"] and job.metrics["MapOutputRecords"] == 16 and job.metrics["CombineOutputRecords"] == 9
    again = JobManager(spark, work)
    assert again.shown_state(again.find(job.id)) == "recoverable" and again.counts(again.find(job.id))["map_completed"] == 1
    monkeypatch.setattr(JobManager, "_map", lambda self, job: (_ for _ in ()).throw(AssertionError("mapped again")))
    done = again.recover(job.id)
    assert read(done.outputs) == GOLDEN and done.attempt == 2 and done.decisions[-1]["type"] == "job_recovered"
    assert (tmp_path / "w" / job.id / f"mr-out-0.{job.id}.ready").read_text() == "attempt=2\n" and not (tmp_path / "w" / job.id / "pairs").exists()


def test_polling_recovers(spark, tmp_path, words):
    work = tmp_path / "w"
    broken = Job("abc", JobConfig.preset("wordcount", [words], work_dir=str(work)), JobState.RUNNING, created_at="2024-01-01T00:00:00Z")
    (work / "abc").mkdir(parents=True)
    (work / "abc" / "manifest.json").write_text(json.dumps(broken.manifest()))
    manager = JobManager(spark, str(work))
    assert routes(manager, "GET", "/api/recoverable", {}, {})[1]["jobs"][0]["id"] == "abc"
    assert routes(manager, "GET", "/api/status", {"job": "abc"}, {})[1]["state"] == "running"
    with pytest.raises(JobAlreadyRunning):
        manager.recover("abc")
    assert routes(manager, "POST", "/api/recover", {}, {"job_id": "abc"})[0] == 409
    import time

    while routes(manager, "GET", "/api/status", {"job": "abc"}, {})[1]["state"] == "running":
        time.sleep(0.2)
    assert read(manager.find("abc").outputs) == GOLDEN


def test_jobs_with_a_folder_of_their_own_are_found_again(spark, tmp_path, words):
    job = JobManager(spark, str(tmp_path / "manager")).submit(JobConfig.preset("wordcount", [words], work_dir=str(tmp_path / "data")))
    assert read(job.outputs) == GOLDEN and job.outputs[0].startswith(str(tmp_path / "data"))
    assert JobManager(spark, str(tmp_path / "manager")).find(job.id).state is JobState.COMPLETED


def test_split_size_holds_for_one_scan(spark, tmp_path, words):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert lines.read_lines(spark, [words], 10).rdd.getNumPartitions() > 3
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before and lines.read_lines(spark, [words]).rdd.getNumPartitions() == 1


def test_over_long_lines_fail_a_job(spark, tmp_path):
    path = tmp_path / "long"
    path.write_bytes(b"x" * ((4 << 20) + 100) + b"\n")
    job = JobManager(spark, str(tmp_path / "w")).submit(JobConfig.preset("wordcount", [str(path)], work_dir=str(tmp_path / "w"), split_size=10))
    assert job.state is JobState.FAILED and "could not be read" in job.error
    with pytest.raises(Exception, match="LINE_TOO_LONG"):
        lines.read_lines(spark, [str(path)], longest=1000).collect()


def test_failures_by_their_place(spark, tmp_path, words, monkeypatch):
    def full(*_, **__):
        raise OSError("no space left on device")

    monkeypatch.setattr(jobs, "write_partitions", full)
    job = JobManager(spark, str(tmp_path / "w")).submit(JobConfig.preset("wordcount", [words], work_dir=str(tmp_path / "w")))
    assert "intermediate, after all retries: output_write" in job.decisions[-1]["message"] and "job's own" in job.error
    registry = builtin()
    registry.register_map("bad_map", lambda file, contents: [("a", 1 / 0)])
    job = JobManager(spark, str(tmp_path / "w"), registry).submit(JobConfig((words,), "bad_map", "wordcount_reduce", work_dir=str(tmp_path / "w")))
    assert job.state is JobState.FAILED and "worker, after all retries" in job.decisions[-1]["message"]


def test_time_out(spark, tmp_path, words):
    import time

    registry = builtin()
    registry.register_map("slow_map", lambda file, contents: time.sleep(60) or [])
    began = time.time()
    job = JobManager(spark, str(tmp_path / "w"), registry).submit(JobConfig((words,), "slow_map", "wordcount_reduce", work_dir=str(tmp_path / "w"), timeout_s=2))
    assert job.state is JobState.FAILED and "stopped after 2 s" in job.error and job.decisions[-1]["type"] == "job_timeout" and time.time() - began < 40


def test_combine_and_reduce_skip_the_same_values(spark, rows):
    registry = builtin()
    _, reducer, combine = registry.resolve("wordcount_map", "wordcount_reduce", "wordcount_combine")
    pairs = spark.createDataFrame([("a", v) for v in ("1", "+2", "+-5", "\u0663", "x", "", "9" * 30, None)] + [("b", "x")], "key string, value string")
    assert rows(combine.function(pairs)) == rows(reducer.function(combine.function(pairs))) == [("a", "3"), ("b", "0")]


def test_command_line(spark, tmp_path, words, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    plugin = tmp_path / "plug.py"
    plugin.write_text("def Map(file, contents):\n    return [(w.lower(), '1') for w in contents.split()]\n\n\ndef Reduce(key, values):\n    return str(len(values))\n")
    assert main(["local", "--input", words, "--udf", "mine", "--plugin", str(plugin), "--plugin-name", "mine", "--work-dir", str(tmp_path / "w")]) == 0
    out = capsys.readouterr().out
    assert "completed" in out and "16 pairs mapped" in out and "mr-out-2" in out
    assert main(["local", "--input", "none", "--work-dir", str(tmp_path / "w")]) == 1
    assert main(["sizes", "--input", words, "--work-dir", "mr-bench-x"]) == 0 and "binary" in capsys.readouterr().out and not (tmp_path / "mr-bench-x").exists()


def test_command_line_with_a_session_of_its_own(tmp_path, words):
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(jobs.__file__).resolve().parents[2])
    command = [sys.executable, "-m", "kvflow", "local", "--input", words, "--work-dir", str(tmp_path / "w")]
    done = subprocess.run(command, capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYTHONPATH": root})
    assert done.returncode == 0 and "9 keys" in done.stdout, done.stderr[-2000:]


def test_bench_folders(spark, tmp_path, words, monkeypatch):
    for folder in ("/tmp/mr-bench-x", "data", "../mr-bench-x", ""):
        with pytest.raises(ValueError):
            sizes.checked_work_dir(folder)
    assert sizes.checked_work_dir("a/mr-bench-x") == "a/mr-bench-x"
    assert sizes.sample(spark, [words], 12).collect()[0].value == "Hello world " and sizes.sample(spark, [words], 0).count() == 4


def test_windows_of_a_stream_leave_out_late_rows(spark, tmp_path):
    source = tmp_path / "events"
    schema = "ts timestamp, event_type string"
    rows = [[("2024-01-01 00:10:00", "x"), ("2024-01-01 02:30:00", "x")], [("2024-01-01 00:20:00", "late"), ("2024-01-01 02:25:00", "y"), ("2024-01-01 05:00:00", "x")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type").coalesce(1).write.mode("append").json(str(source))
        stream = windowed_counts(spark.readStream.schema(schema).json(str(source))).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        stream.trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(r.start), r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01 00:00:00", "x", 1), ("2024-01-01 02:00:00", "x", 1), ("2024-01-01 02:00:00", "y", 1)]


def test_one_job_at_a_time(spark, tmp_path, words):
    manager = JobManager(spark, str(tmp_path / "w"))
    manager.jobs["x"], manager.current = Job("x", JobConfig.preset("wordcount", [words]), JobState.RUNNING), "x"
    with pytest.raises(JobAlreadyRunning):
        manager.submit(JobConfig.preset("wordcount", [words], work_dir=str(tmp_path / "w")))


def test_defaults():
    config = JobConfig(["a"], "m", "r", n_reduce=0, reduce_slow_start=3, work_dir="")
    assert (config.n_reduce, config.reduce_slow_start, config.work_dir) == (3, 0.8, "mr-work")
    assert JobState.read("odd") is JobState.RUNNING


@pytest.mark.parametrize(
    ("reason", "category", "fault"),
    [("input_read: x", "input", False), ("config: x", "config", False), ("intermediate_x", "intermediate", False), ("shuffle_x", "intermediate", False), ("output_x", "intermediate", False), ("", "worker", True), ("boom", "worker", True)],
)
def test_failures(reason, category, fault):
    got = failures.classify(reason)
    assert got == category and failures.is_worker_fault(got) is fault


def test_service(spark, tmp_path, words):
    manager = JobManager(spark, str(tmp_path / "w"))
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "index.html").write_text("<p>here</p>")
    (tmp_path / "secret").write_text("no")
    http = server(manager, 0, static=str(tmp_path / "web"))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode())) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    assert call("/api/status")[0] == 400 and call("/api/result")[0] == 404 and call("/api/job", {"input_files": []})[0] == 400
    status, payload = call("/api/job", {"input_files": [words], "map_func": "wordcount_map", "reduce_func": "wordcount_reduce", "work_dir": str(tmp_path / "w")})
    assert status == 200
    import time

    assert payload["state"] == "running" and call("/api/job", {"input_files": [words], "map_func": "wordcount_map", "reduce_func": "wordcount_reduce"})[0] == 409
    while (status := call(f"/api/status?job={payload['job_id']}")[1])["state"] == "running":
        time.sleep(0.2)
    assert status == {"job_id": payload["job_id"], "state": "completed", "map_completed": 1, "map_total": 1, "reduce_completed": 3, "reduce_total": 3}
    result = call("/api/result")[1]
    assert read(result["output_files"]) == GOLDEN and result["state"] == "completed"
    board = call("/api/dashboard")[1]
    assert board["job"]["state"] == "completed" and call("/api/recoverable")[1] == {"jobs": []}
    assert board["progress"]["map_ratio"] == 1.0 and board["workers"][0]["alive"] and {t["state"] for t in board["map_tasks"]} == {"completed"} and board["optimizations"]["shuffle"]["records"] == 16
    assert call("/api/cancel", {})[0] == 400
    request = urllib.request.Request(base + "/api/job", method="OPTIONS")
    with urllib.request.urlopen(request) as answer:
        assert answer.status == 204 and "POST" in answer.headers["Access-Control-Allow-Methods"]
    assert follow(base, payload["job_id"], 0.1)["state"] == "completed"
    with urllib.request.urlopen(base + "/") as answer:
        assert answer.read() == b"<p>here</p>" and answer.headers["Content-Type"] == "text/html"
    assert call("/../secret")[0] == 404
    assert call("/api/recover", {"job_id": "none"})[0] == 400 and routes(manager, "GET", "/x", {}, {})[0] == 404
    http.shutdown()


def test_streams(spark, tmp_path):
    from kvflow.streaming.words import running_word_counts

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("a b\n")
    (source / "b.txt").write_text("b\n")
    stream = running_word_counts(spark.readStream.text(str(source))).writeStream.format("memory").queryName("words").outputMode("complete")
    stream.trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("words").collect()} == {("a", 1), ("b", 2)}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y")], "t string, event_type string").selectExpr("cast(t as timestamp) ts", "event_type")
    assert sorted((str(r.start), r.kind, r.n) for r in windowed_counts(events).collect()) == [("2024-01-01 00:00:00", "x", 2), ("2024-01-01 01:00:00", "y", 1)]
