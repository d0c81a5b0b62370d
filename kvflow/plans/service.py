"""HTTP facade of the job manager."""

from __future__ import annotations

import json
import mimetypes
from dataclasses import fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any
from urllib.parse import parse_qs, urlparse

from kvflow.plans.jobs import JobAlreadyRunning, JobConfig, JobManager
from kvflow.plans.registry import ConfigError


def routes(manager: JobManager, method: str, path: str, query: dict[str, str], body: dict[str, Any]) -> tuple[int, Any]:
    """(status, payload) of a request."""
    job_id = query.get("job", "")
    started = lambda job: (200, {"job_id": job.id, "state": str(job.state)})
    try:
        match method, path:
            case "OPTIONS", _:
                return 204, None
            case "POST", "/api/job":
                names = {f.name for f in fields(JobConfig)}
                return started(manager.submit(JobConfig(**{k: v for k, v in body.items() if k in names}), wait=False))
            case "POST", "/api/recover":
                return started(manager.recover(body.get("job_id", job_id), wait=False))
            case "POST", "/api/cancel":
                if (job := manager.running()) is None or job.id != body.get("job_id", job.id):
                    return 400, {"error": "the job is not running"}
                manager.cancel(job.id)
                return started(job)
            case "GET", "/api/status":
                if not job_id:
                    return 400, {"error": "which job? its id is missing"}
                job = manager.polled(job_id)
                if job is None:
                    return 404, {"error": "no such job", "job_id": job_id}
                return 200, {"job_id": job.id, "state": manager.shown_state(job)} | manager.counts(job) | ({"error": job.error} if job.error else {})
            case "GET", "/api/result":
                job = manager.find(job_id)
                if job is None:
                    return 404, {"error": "no such job"}
                return 200, {"job_id": job.id, "state": manager.shown_state(job), "output_files": job.expected_outputs, "work_dir": job.config.work_dir, "job_work_dir": job.folder}
            case "GET", "/api/dashboard":
                return 200, manager.snapshot(job_id)
            case "GET", "/api/recoverable":
                return 200, {"jobs": [{"id": j.id, "state": "recoverable", "created_at": j.created_at, "input_files": list(j.config.input_files), "stages": j.stages} for j in manager.recoverable()]}
    except JobAlreadyRunning as error:
        return 409, {"error": f"job {error} is running"}
    except (ConfigError, TypeError) as error:
        return 400, {"error": str(error)}
    return 404, {"error": "no such route"}


def _static(folder: str, path: str) -> tuple[bytes, str] | None:
    """A file of the folder, or its index.html for /; never one outside."""
    root = Path(folder).resolve()
    file = (root / (path.lstrip("/") or "index.html")).resolve()
    if not file.is_relative_to(root) or not file.is_file():
        return None
    return file.read_bytes(), mimetypes.guess_type(file.name)[0] or "application/octet-stream"


def server(manager: JobManager, port: int = 8080, host: str = "127.0.0.1", static: str = "") -> ThreadingHTTPServer:
    """static: a folder whose files are served beside the API."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url = urlparse(self.path)
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else {}
                status, payload = routes(manager, self.command, url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}, body)
            except ValueError as error:
                status, payload = 400, {"error": str(error)}
            data, kind = b"" if payload is None else json.dumps(payload).encode(), "application/json"
            if static and status == 404 and self.command == "GET" and not url.path.startswith("/api/") and (found := _static(static, url.path)):
                status, (data, kind) = 200, found
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
            self.send_header("Access-Control-Allow-Headers", "Content-Type")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_OPTIONS = _answer  # noqa: N815

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
