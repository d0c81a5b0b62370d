"""Jobs: configuration, execution as two Spark plans, logs and manifests, one running job at a time.

The map stage writes the combined pairs as a table into the job's folder, the reduce stage reads it and publishes the files. A
job that was interrupted goes on with the stage that is not complete.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from enum import StrEnum
from itertools import groupby
from pathlib import Path
from statistics import median
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvflow.functions import text
from kvflow.plans import failures
from kvflow.plans.registry import REGISTRY, ConfigError, Entry, Registry
from kvflow.sources.lines import SCAN_BYTES, SPLIT_BYTES, read_lines, split_plan
from kvflow.sources.outputs import Files, write_partitions

# Defaults of a job; kept decisions; the version of a manifest; when a task counts as slow.
WORK_DIR, N_REDUCE, SLOW_START, KEPT_EVENTS, VERSION = "mr-work", 3, 0.8, 2000, 1
SLOW_TIMES, SLOW_SAMPLES = 1.5, 3
#: Tasks of a stage that a snapshot lists.
LISTED_TASKS = 1_000
MAP, REDUCE = "map", "reduce"
PAIRS = "key string, value string"
LOG = T.StructType(
    [T.StructField("time", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("kind", "job_id", "state", "error", "message", "type", "worker_id", "task_type")]
    + [T.StructField(n, T.IntegerType()) for n in ("task_id", "attempt_id", "n_map", "n_reduce")]
    + [T.StructField("input_files", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("map_func", "reduce_func", "combine_func", "work_dir")]
)


class JobState(StrEnum):
    PENDING = "pending"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"

    @classmethod
    def read(cls, text: str) -> JobState:
        """Unknown states count as running."""
        return cls(text) if text in cls._value2member_map_ else cls.RUNNING


class TaskType(StrEnum):
    MAP = "map"
    REDUCE = "reduce"
    WAIT = "wait"
    EXIT = "exit"


class TaskState(StrEnum):
    IDLE = "idle"
    IN_PROGRESS = "in_progress"
    COMPLETED = "completed"
    FAILED = "failed"

    @classmethod
    def read(cls, text: str) -> TaskState:
        """Unknown states count as idle."""
        return cls(text) if text in cls._value2member_map_ else cls.IDLE


#: Spark's names of task states.
SPARK_STATES = {"RUNNING": TaskState.IN_PROGRESS, "SUCCESS": TaskState.COMPLETED, "FAILED": TaskState.FAILED, "KILLED": TaskState.FAILED}


class JobAlreadyRunning(RuntimeError):
    pass


@dataclass(frozen=True)
class JobConfig:
    input_files: tuple[str, ...]
    map_func: str
    reduce_func: str
    combine_func: str = ""
    n_reduce: int = N_REDUCE
    split_size: int = 0
    work_dir: str = WORK_DIR
    #: Spark begins a stage when the one before is complete, so this is kept and reported only.
    reduce_slow_start: float = SLOW_START
    #: Seconds after which a job is stopped and fails; 0: never.
    timeout_s: float = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "input_files", tuple(self.input_files))
        if self.n_reduce <= 0:
            object.__setattr__(self, "n_reduce", N_REDUCE)
        if not self.work_dir:
            object.__setattr__(self, "work_dir", WORK_DIR)
        if not 0 < self.reduce_slow_start <= 1:
            object.__setattr__(self, "reduce_slow_start", SLOW_START)

    @classmethod
    def preset(cls, name: str, input_files: list[str], **more: Any) -> JobConfig:
        """'crawl_clean' without combine function; anything else is word count."""
        if name == "crawl_clean":
            return cls(tuple(input_files), "crawl_clean_map", "crawl_clean_reduce", "", **more)
        return cls(tuple(input_files), "wordcount_map", "wordcount_reduce", "wordcount_combine", **more)


@dataclass
class Job:
    id: str
    config: JobConfig
    state: JobState = JobState.PENDING
    created_at: str = ""
    completed_at: str = ""
    error: str = ""
    outputs: list[str] = field(default_factory=list)
    metrics: dict[str, int] = field(default_factory=dict)
    decisions: list[dict[str, Any]] = field(default_factory=list)
    n_map: int = 0
    #: Stages that are complete.
    stages: list[str] = field(default_factory=list)
    attempt: int = 0

    @property
    def folder(self) -> str:
        """Where the job's data lie, in any file system."""
        return f"{self.config.work_dir.rstrip('/')}/{self.id}"

    @property
    def recoverable(self) -> bool:
        return self.state in (JobState.RUNNING, JobState.PENDING) and len(self.outputs) < self.config.n_reduce

    @property
    def expected_outputs(self) -> list[str]:
        """The files that the job has published or will publish."""
        return self.outputs or [f"{self.folder}/mr-out-{r}" for r in range(self.config.n_reduce)]

    def manifest(self) -> dict[str, Any]:
        return {"version": VERSION, "saved_at": _now()} | asdict(self)

    @classmethod
    def read(cls, path: Path) -> Job:
        data = json.loads(path.read_text())
        if data.pop("version") != VERSION:
            raise ValueError(f"unknown manifest version in {path}")
        data.pop("saved_at")
        return cls(**data | {"config": JobConfig(**data["config"]), "state": JobState.read(data["state"])})


def _now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


def _observed(seen: Observation) -> dict[str, int]:
    """What was counted; nothing where the plan was found to be empty before it ran."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return {}


def _python_map(function: Any):
    """Runs map(file, contents) on the lines of a batch that lie in one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield _pairs([pair for file, own in groupby(rows, key=lambda r: r[0]) for pair in function(file, "".join(f"{line}\n" for _, line in own))])

    return run


def _python_combine(function: Any):
    """Runs combine(key, values) on the values that a key has in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda p: p[0])
            yield _pairs([(key, function(key, [v for _, v in own])) for key, own in groupby(rows, key=lambda p: p[0])])

    return run


def _pairs(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    keys, values = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])


def _python_reduce(function: Any):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        return pa.table({"key": [key], "value": [function(key, sorted(table.column("value").to_pylist()))]}, schema=pa.schema([("key", pa.string()), ("value", pa.string())]))

    return run


def mapped(lines: DataFrame, mapper: Entry, combine: Entry | None = None, seen: Observation | None = None) -> DataFrame:
    """(key, value) of lines (file, value), combined before any shuffle where there is a combine function. seen: counts what the
    map function gives."""
    pairs = mapper.function(lines) if mapper.native else lines.mapInArrow(_python_map(mapper.function), PAIRS)
    if seen is not None:
        pairs = pairs.observe(seen, F.count("*").alias("records"))
    if combine is None:
        return pairs
    return combine.function(pairs) if combine.native else pairs.mapInArrow(_python_combine(combine.function), PAIRS)


def reduced(pairs: DataFrame, reducer: Entry) -> DataFrame:
    """One row per key. A Python reduce gets all values of a key at once, in their own order, so the key's values must fit
    into a worker; native reduces have no such bound."""
    return reducer.function(pairs) if reducer.native else pairs.groupBy("key").applyInArrow(_python_reduce(reducer.function), PAIRS)


def plan(spark: SparkSession, config: JobConfig, registry: Registry = REGISTRY, seen: Observation | None = None) -> DataFrame:
    """The job's combined pairs (key, value), not yet computed."""
    mapper, _, combine = registry.resolve(config.map_func, config.reduce_func, config.combine_func)
    size = config.split_size if config.split_size > 0 else SPLIT_BYTES
    # A line that covers a whole split and more than may be scanned behind it is over-long wherever it begins.
    lines = read_lines(spark, list(config.input_files), size, size + SCAN_BYTES)
    return mapped(lines, mapper, combine, seen)


class JobManager:
    """Runs one job at a time. Manifests and logs of all jobs lie in the manager's own folder, the data of a job in that job's."""

    def __init__(self, spark: SparkSession, work_dir: str = WORK_DIR, registry: Registry = REGISTRY):
        self.spark, self.work_dir, self.registry = spark, work_dir, registry
        self.lock = threading.Lock()
        self.jobs: dict[str, Job] = {}
        self.current: str | None = None
        for path in sorted(Path(work_dir).glob("*/manifest.json")):
            try:
                job = Job.read(path)
            except (ValueError, KeyError, TypeError):
                continue
            self.jobs[job.id] = job

    def submit(self, config: JobConfig, wait: bool = True) -> Job:
        self.registry.resolve(config.map_func, config.reduce_func, config.combine_func)
        if not config.input_files:
            raise ConfigError("no input files")
        return self._start(Job(uuid.uuid4().hex[:16], config, created_at=_now()), wait)

    def recover(self, job_id: str, wait: bool = True) -> Job:
        """Goes on with an interrupted job: a complete map stage is not run again, and outputs are published last."""
        job = self.jobs.get(job_id)
        if self.running() is job is not None:
            raise JobAlreadyRunning(job_id)
        if job is None or not job.recoverable:
            raise ConfigError(f"job {job_id} is not recoverable")
        return self._start(job, wait, "job_recovered")

    def running(self) -> Job | None:
        """The job that this manager is running now."""
        job = self.jobs.get(self.current or "")
        return job if job and job.state is JobState.RUNNING else None

    def _start(self, job: Job, wait: bool, decision: str = "") -> Job:
        with self.lock:
            if running := self.running():
                raise JobAlreadyRunning(running.id)
            self.jobs[job.id], self.current = job, job.id
            job.state, job.attempt = JobState.RUNNING, job.attempt + 1
        if decision:
            self._decide(job, decision, f"attempt {job.attempt}, complete stages: {', '.join(job.stages) or 'none'}")
        self._log(job, "start", input_files=list(job.config.input_files), n_reduce=job.config.n_reduce, map_func=job.config.map_func, reduce_func=job.config.reduce_func, combine_func=job.config.combine_func, work_dir=job.config.work_dir)
        self._save(job)
        thread = threading.Thread(target=self._run, args=(job,))
        thread.start()
        if wait:
            thread.join()
        return job

    def _run(self, job: Job) -> None:
        expired = threading.Event()

        def stop() -> None:
            expired.set()
            self.cancel(job.id)

        timer = threading.Timer(job.config.timeout_s, stop) if job.config.timeout_s > 0 else None
        if timer:
            timer.start()
        began = time.time()
        try:
            with failures.raised_in("input_read"):
                self._plan_splits(job)
            if MAP not in job.stages or not Files(self.spark, job.folder).exists(f"{self._pairs_of(job)}/_SUCCESS"):
                self._map(job)
            with failures.raised_in("output_write"):
                self._reduce(job)
            job.metrics["WallMs"] = int((time.time() - began) * 1000)
            job.state = JobState.COMPLETED
        except Exception as error:
            reason = f"job was stopped after {job.config.timeout_s} s" if expired.is_set() else failures.reason_of(error)
            category = failures.classify(reason)
            job.state, job.error = JobState.FAILED, failures.message(reason, "job failed")
            self.cancel(job.id)
            self._decide(job, "job_timeout" if expired.is_set() else "job_aborted", f"{category}, {'after all retries' if failures.is_retried(category) else 'not retried'}: {reason[:500]}")
        finally:
            if timer:
                timer.cancel()
        job.completed_at = _now()
        self._log(job, "finish", state=str(job.state), error=job.error, message=f"job {job.id} {job.state}: {job.metrics.get('ReduceOutputKeys', 0)} keys in {len(job.outputs)} files")
        self._save(job)

    def _plan_splits(self, job: Job) -> None:
        """Fails for missing files and, where ordinary calls reach the files, for over-long lines."""
        local = [f.removeprefix("file://") for f in job.config.input_files if "://" not in f or f.startswith("file:///")]
        try:
            job.n_map = len(split_plan(local, job.config.split_size)) if local else 0
        except ValueError as error:
            raise failures.StageError(f"input_read: {error}") from error
        job.n_map += len(job.config.input_files) - len(local)

    def _pairs_of(self, job: Job) -> str:
        return f"{job.folder}/pairs"

    def _group(self, job: Job, stage: str) -> None:
        self.spark.sparkContext.setJobGroup(f"{job.id}/{stage}", f"{stage} of {job.config.map_func} / {job.config.reduce_func}", interruptOnCancel=True)

    def _map(self, job: Job) -> None:
        began, seen, kept = time.time(), Observation(), Observation()
        self._group(job, MAP)
        pairs = plan(self.spark, job.config, self.registry, seen)
        size = F.octet_length("key") + F.octet_length("value")
        counted = pairs.observe(
            kept, F.count("*").alias("records"), F.coalesce(F.sum(22 + text.json_string_bytes(F.col("key")) + text.json_string_bytes(F.col("value"))), F.lit(0)).alias("json"), F.coalesce(F.sum(8 + size), F.lit(0)).alias("binary")
        )
        counted.write.mode("overwrite").option("compression", "gzip").parquet(self._pairs_of(job))
        files = Files(self.spark, self._pairs_of(job))
        parts = [p for p in files.names(self._pairs_of(job)) if p.startswith("part-")]
        packed = sum(files.system.getFileStatus(files.path(f"{self._pairs_of(job)}/{p}")).getLen() for p in parts)
        counts = _observed(kept)
        job.metrics |= {
            "MapOutputRecords": _observed(seen).get("records", 0), "CombineOutputRecords": counts.get("records", 0), "ShuffleJSONBytes": counts.get("json", 0), "ShuffleBinaryBytes": counts.get("binary", 0),
            "ShuffleCompressedBytes": packed, "ShuffleFiles": len(parts), "MapMs": int((time.time() - began) * 1000),
        }
        job.stages = [*job.stages, MAP]
        self._save(job)

    def _reduce(self, job: Job) -> None:
        began, seen = time.time(), Observation()
        self._group(job, REDUCE)
        reducer = self.registry.resolve(job.config.map_func, job.config.reduce_func, job.config.combine_func)[1]
        pairs = self.spark.read.schema(PAIRS).parquet(self._pairs_of(job))
        result = reduced(pairs, reducer).observe(seen, F.count("*").alias("keys"))
        job.outputs = write_partitions(result, job.config.n_reduce, job.folder, job=job.id, attempt=job.attempt)
        job.metrics |= {"ReduceOutputKeys": _observed(seen).get("keys", 0), "ReduceMs": int((time.time() - began) * 1000)}
        job.stages = [*job.stages, REDUCE]
        Files(self.spark, job.folder).delete(self._pairs_of(job))

    def cancel(self, job_id: str) -> None:
        for stage in (MAP, REDUCE):
            self.spark.sparkContext.cancelJobGroup(f"{job_id}/{stage}")

    def _decide(self, job: Job, kind: str, message: str) -> None:
        job.decisions = [*job.decisions, {"time": _now(), "type": kind, "message": message}][-KEPT_EVENTS:]
        self._log(job, "decision", type=kind, message=message)

    def _log(self, job: Job, kind: str, **values: Any) -> None:
        own = self._own(job)
        with (own / "job.log").open("a") as f:
            f.write(json.dumps({"time": _now(), "kind": kind, "job_id": job.id} | values) + "\n")

    def _own(self, job: Job) -> Path:
        """The manager's folder of the job's log and manifest, wherever the job's data lie."""
        path = Path(self.work_dir) / job.id
        path.mkdir(parents=True, exist_ok=True)
        return path

    def _save(self, job: Job) -> None:
        path = self._own(job) / "manifest.json"
        part = path.with_suffix(".part")
        part.write_text(json.dumps(job.manifest()))
        os.replace(part, path)

    def history(self) -> list[Job]:
        """The newest first; of those created at once, the greatest id first."""
        return sorted(self.jobs.values(), key=lambda j: (j.created_at, j.id), reverse=True)

    def recoverable(self) -> list[Job]:
        return [j for j in self.history() if j.recoverable and j is not self.running()]

    def find(self, job_id: str = "") -> Job | None:
        return self.jobs.get(job_id or self.current or "")

    def polled(self, job_id: str) -> Job | None:
        """The job; one that was interrupted goes on if no other is running."""
        job = self.find(job_id)
        if job and job.recoverable and self.running() is None:
            try:
                self.recover(job.id, wait=False)
            except (JobAlreadyRunning, ConfigError):
                pass
        return job

    def shown_state(self, job: Job) -> str:
        return "recoverable" if job.recoverable and job is not self.running() else str(job.state)

    def counts(self, job: Job) -> dict[str, int]:
        """Completed and all map and reduce tasks: of a running stage Spark's progress in the job's own units."""
        done = {stage: 1.0 if stage in job.stages or job.state is JobState.COMPLETED else self._progress(job, stage) for stage in (MAP, REDUCE)}
        return {
            "map_completed": int(done[MAP] * job.n_map), "map_total": job.n_map,
            "reduce_completed": int(done[REDUCE] * job.config.n_reduce), "reduce_total": job.config.n_reduce,
        }

    def _stages(self, job: Job, stage: str) -> list[Any]:
        tracker = self.spark.sparkContext.statusTracker()
        infos = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"{job.id}/{stage}")]
        return [s for i in infos if i for n in sorted(i.stageIds) if (s := tracker.getStageInfo(n))]

    def _progress(self, job: Job, stage: str) -> float:
        stages = self._stages(job, stage)
        total = sum(s.numTasks for s in stages)
        return sum(s.numCompletedTasks for s in stages) / total if total else 0.0

    def tasks(self, job: Job, stage: str) -> list[dict[str, Any]]:
        """Spark's tasks of a stage of the job, at most LISTED_TASKS of each of its own stages."""
        store = self.spark._jsc.sc().statusStore()
        out: list[dict[str, Any]] = []
        for info in self._stages(job, stage):
            found = store.taskList(info.stageId, info.currentAttemptId, LISTED_TASKS)
            rows = [found.apply(i) for i in range(found.size())]
            taken = [int(r.duration().get()) if r.duration().isDefined() else int(time.time() * 1000) - r.launchTime().getTime() for r in rows]
            done = [t for t, r in zip(taken, rows, strict=True) if r.status() == "SUCCESS"]
            slow = SLOW_TIMES * median(done) if len(done) >= SLOW_SAMPLES else float("inf")
            out += [
                {
                    "id": r.index(), "type": stage, "state": str(SPARK_STATES.get(r.status(), TaskState.IDLE)), "worker_id": r.executorId(), "attempt_id": r.attempt(),
                    "retry_count": r.attempt(), "elapsed_ms": t, "speculative_risk": r.status() == "RUNNING" and t > slow,
                }
                for t, r in zip(taken, rows, strict=True)
            ]
        return out

    def workers(self) -> list[dict[str, Any]]:
        found = self.spark._jsc.sc().statusStore().executorList(False)
        rows = [found.apply(i) for i in range(found.size())]
        return [{"id": r.id(), "alive": r.isActive() and not r.isExcluded(), "blacklisted": r.isExcluded(), "failure_count": r.failedTasks(), "current_task": r.activeTasks()} for r in rows]

    def snapshot(self, job_id: str = "") -> dict[str, Any]:
        """What a dashboard shows of a job; of ended ones the decisions that were kept with it."""
        job = self.polled(job_id)
        listed = [
            {"id": j.id, "state": self.shown_state(j), "created_at": j.created_at, "completed_at": j.completed_at, "input_files": list(j.config.input_files), "n_map": j.n_map, "n_reduce": j.config.n_reduce,
             "work_dir": j.config.work_dir, "is_current": j.id == self.current, "is_selected": job is j} | self.counts(j)
            for j in self.history()
        ]
        workers = self.workers()
        base = {"job": None, "job_history": listed, "workers": workers, "decisions": [], "server_time": _now()}
        if job is None:
            return base
        counts = self.counts(job)
        map_tasks, reduce_tasks = self.tasks(job, MAP), self.tasks(job, REDUCE)
        ratio = counts["map_completed"] / counts["map_total"] if counts["map_total"] else 0.0
        done = lambda rows: [r["elapsed_ms"] for r in rows if r["state"] == "completed"]
        middle = lambda values: median(values) if values else 0
        # A reduce task begins when all map tasks are complete, so all partitions are ready at once.
        partitions = [{"reduce_id": r, "maps_ready": counts["map_completed"], "maps_total": counts["map_total"], "ready": counts["map_completed"] == counts["map_total"]} for r in range(job.config.n_reduce)]
        return base | {
            "job": job.manifest() | {"state": self.shown_state(job)},
            "progress": counts | {"map_ratio": ratio, "reduce_slow_start_threshold": job.config.reduce_slow_start, "reduce_scheduling_unlocked": MAP in job.stages},
            "map_tasks": map_tasks, "reduce_tasks": reduce_tasks, "reduce_partitions": partitions,
            "scheduling": {
                "map_median_ms": middle(done(map_tasks)), "reduce_median_ms": middle(done(reduce_tasks)), "speculative_multiplier": SLOW_TIMES, "speculative_min_completed": SLOW_SAMPLES,
                "map_completed_samples": len(done(map_tasks)), "reduce_completed_samples": len(done(reduce_tasks)),
            },
            "optimizations": self._optimizations(job, ratio, map_tasks + reduce_tasks, workers),
            "decisions": job.decisions,
        }

    def _optimizations(self, job: Job, ratio: float, tasks: list[dict[str, Any]], workers: list[dict[str, Any]]) -> dict[str, Any]:
        m = job.metrics
        before, after, packed = (m.get(f"Shuffle{name}Bytes", 0) for name in ("JSON", "Binary", "Compressed"))
        saved = lambda x: (1 - x / before) * 100 if before > 0 else 0.0
        failed = [t for t in tasks if t["state"] == "failed"]
        return {
            "slow_start": {"enabled": False, "threshold": job.config.reduce_slow_start, "map_ratio": ratio, "unlocked": MAP in job.stages},
            "shuffle": {
                "records": m.get("CombineOutputRecords", 0), "files": m.get("ShuffleFiles", 0), "json_bytes": before, "binary_bytes": after, "compressed_bytes": packed,
                "binary_saved_percent": saved(after), "compressed_saved_percent": saved(packed), "compressed_to_json_percent": packed / before * 100 if before > 0 else 0.0, "write_ms": m.get("MapMs", 0),
            },
            "streaming": {"streamed_records": m.get("CombineOutputRecords", 0), "output_keys": m.get("ReduceOutputKeys", 0), "write_ms": m.get("ReduceMs", 0)},
            "fault_tolerance": {
                "workers_total": len(workers), "workers_alive": sum(w["alive"] for w in workers), "blacklisted_workers": sum(w["blacklisted"] for w in workers),
                "task_failures": len(failed), "retries": sum(t["retry_count"] for t in tasks), "speculative_requeues": sum(t["speculative_risk"] for t in tasks),
            },
        }


def job_logs(spark: SparkSession, work_dir: str) -> DataFrame:
    """All log records below a work folder."""
    return spark.read.schema(LOG).json(f"{work_dir}/*/job.log")
