"""Command line: run a job here, serve the job API, submit to a server and wait, or measure the sizes of pair formats."""

from __future__ import annotations

import argparse
import json
import sys
import time
import urllib.error
import urllib.request
from typing import Any

from kvflow.functions.text import comma_list, human_bytes


def _call(base: str, path: str, body: dict | None = None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(base + path, data, {"Content-Type": "application/json"})) as answer:
        return json.load(answer)


def follow(base: str, job_id: str, pause: float = 2.0) -> dict:
    """Polls a job until it ends, asks for its recovery when it was interrupted, and returns its last status."""
    while (status := _call(base, f"/api/status?job={job_id}"))["state"] not in ("completed", "failed"):
        if status["state"] == "recoverable":
            try:
                _call(base, "/api/recover", {"job_id": job_id})
            except urllib.error.HTTPError as error:
                if error.code != 409:
                    raise
        time.sleep(pause)
    return status


def summary(job: Any) -> str:
    """What a finished local job has to say."""
    m = job.metrics
    lines = [f"job {job.id}: {job.state}" + (f", {job.error}" if job.error else "")]
    if job.outputs:
        lines += [f"{m['MapOutputRecords']} pairs mapped, {m['CombineOutputRecords']} after combining ({human_bytes(m['ShuffleCompressedBytes'])}), {m['ReduceOutputKeys']} keys", *job.outputs]
    return "\n".join(lines)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kvflow")
    commands = parser.add_subparsers(dest="command", required=True)
    plugins = argparse.ArgumentParser(add_help=False)
    plugins.add_argument("--plugin", default="", help="Python file with Map, Reduce and Combine")
    plugins.add_argument("--plugin-name", default="plugin", help="prefix of the names under which they are registered")
    plugins.add_argument("--work-dir", default="mr-work")
    job = argparse.ArgumentParser(add_help=False)
    job.add_argument("--input", default="", help="files, separated by commas")
    job.add_argument("--udf", default="wordcount", help="wordcount, crawl_clean, or the prefix of a plugin")
    job.add_argument("--nreduce", type=int, default=3)
    job.add_argument("--split", type=int, default=0)
    job.add_argument("--timeout", type=float, default=0)
    commands.add_parser("local", parents=[job, plugins])
    p = commands.add_parser("submit", parents=[job])
    p.add_argument("--work-dir", default="mr-work")
    p.add_argument("--master", default="http://127.0.0.1:8080")
    p.add_argument("--recover", default="", help="id of an interrupted job to go on with")
    p = commands.add_parser("serve", parents=[plugins])
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--static", default="", help="folder served beside the API")
    p = commands.add_parser("sizes")
    p.add_argument("--input", required=True)
    p.add_argument("--bytes", type=int, default=50 << 20)
    p.add_argument("--nreduce", type=int, default=3)
    p.add_argument("--work-dir", default="mr-bench-sizes")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)

    from kvflow.plans.jobs import JobConfig, JobManager, JobState
    from kvflow.plans.registry import REGISTRY
    from kvflow.session import fault_tolerant_session

    if getattr(args, "plugin", ""):
        REGISTRY.load_plugin(args.plugin, args.plugin_name)
    if args.command == "serve":
        from kvflow.plans.service import server

        server(JobManager(fault_tolerant_session(), args.work_dir), args.port, static=args.static).serve_forever()
        return 0
    if args.command == "sizes":
        from kvflow.plans.sizes import format_sizes

        for row in format_sizes(fault_tolerant_session(), comma_list(args.input), args.bytes, args.nreduce, args.work_dir):
            print(f"{row.format:12} {row.bytes:14,} {human_bytes(row.bytes):>10}  saved {row.saved_percent:.2f} %")
        return 0
    more = {"n_reduce": args.nreduce, "split_size": args.split, "work_dir": args.work_dir, "timeout_s": args.timeout}
    files = comma_list(args.input)
    if args.udf in ("wordcount", "crawl_clean"):
        config = JobConfig.preset(args.udf, files, **more)
    else:
        config = JobConfig(tuple(files), f"{args.udf}_map", f"{args.udf}_reduce", f"{args.udf}_combine", **more)
    if args.command == "local":
        job = JobManager(fault_tolerant_session(), args.work_dir).submit(config)
        print(summary(job))
        return int(job.state is not JobState.COMPLETED)
    if args.recover:
        job_id = _call(args.master, "/api/recover", {"job_id": args.recover})["job_id"]
    else:
        job_id = _call(args.master, "/api/job", {k: list(v) if isinstance(v, tuple) else v for k, v in vars(config).items()})["job_id"]
    status = follow(args.master, job_id)
    print(status.get("error") or "\n".join(_call(args.master, f"/api/result?job={job_id}")["output_files"]))
    return int(status["state"] == "failed")


if __name__ == "__main__":
    sys.exit(main())
