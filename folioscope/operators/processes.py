"""Adapters that are programs: one cold child per file, or a warm session that serves many.

A child gets a work folder of its own inside the task and is killed with its whole process
group when its time is over.  A session reads a line per file (extension, package and edit in
Base64, tab-separated) and answers with lines of JSON up to ``done``; it is started again
after an error or a timeout.
"""

from __future__ import annotations

import base64
import json
import os
import selectors
import shutil
import signal
import subprocess
import tempfile
import time

from pyspark.sql import DataFrame

from folioscope.sources import packages

_RUNS = "pkg string, format string, opened boolean, saved boolean, output binary, phase string, error string, elapsed_ms double"


def _kill(child: subprocess.Popen) -> None:
    try:
        os.killpg(child.pid, signal.SIGKILL)
    except ProcessLookupError:
        pass
    child.wait()


def cold(command: list[str], kind: str, content: bytes, edit: str, timeout: float) -> tuple[list[dict], bytes | None, str | None]:
    """Events, output and error of ``command INPUT OUTPUT EDIT``."""
    with tempfile.TemporaryDirectory() as folder:
        given, made = os.path.join(folder, f"in.{kind}"), os.path.join(folder, f"out.{kind}")
        with open(given, "wb") as f:
            f.write(content)
        child = subprocess.Popen([*command, given, made, edit], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
        try:
            out, _ = child.communicate(timeout=timeout)
        except subprocess.TimeoutExpired:
            _kill(child)
            return [], None, "timeout"
        events = _events(out.decode("utf-8", "replace").splitlines())
        data = open(made, "rb").read() if os.path.exists(made) else None
        return events, data, None if child.returncode == 0 else f"exit {child.returncode}"


def _events(lines: list[str]) -> list[dict]:
    out = []
    for line in lines:
        if line.startswith("{"):
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
    return out


class Session:
    """A warm child that answers one request at a time."""

    def __init__(self, command: list[str]):
        self.command, self.child = command, None

    def close(self) -> None:
        if self.child is not None:
            _kill(self.child)
            self.child = None

    def request(self, kind: str, content: bytes, edit: str, timeout: float) -> tuple[list[dict], bytes | None, str | None]:
        if self.child is None or self.child.poll() is not None:
            self.child = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
        line = "\t".join([kind, base64.b64encode(content).decode(), base64.b64encode(edit.encode()).decode()]) + "\n"
        events, buffer, end = [], b"", time.monotonic() + timeout
        try:
            self.child.stdin.write(line.encode())
            self.child.stdin.flush()
            with selectors.DefaultSelector() as ready:
                ready.register(self.child.stdout, selectors.EVENT_READ)
                while not events or events[-1].get("event") != "done":
                    if not ready.select(max(0, end - time.monotonic())):
                        self.close()
                        return events, None, "timeout"
                    chunk = os.read(self.child.stdout.fileno(), 1 << 16)
                    if not chunk:
                        self.close()
                        return events, None, "ended"
                    *lines, buffer = (buffer + chunk).split(b"\n")
                    events += _events([x.decode("utf-8", "replace") for x in lines])
        except BrokenPipeError:
            self.close()
            return events, None, "ended"
        output = events[-1].get("output")
        error = next((e.get("message", "error") for e in events if e.get("event") == "error"), None)
        return events, base64.b64decode(output) if output else None, error


def prepared(programs: dict[str, list[str]]) -> dict[str, str | None]:
    """Why each program can't run here; null if it can.  A program that is missing stops none of the others."""
    out: dict[str, str | None] = {}
    for name, command in programs.items():
        try:
            out[name] = None if command and shutil.which(command[0]) else f"{' '.join(command[:1]) or 'no command'}: not found"
        except OSError as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out


def run_program(todo: DataFrame, command: list[str], timeout: float = 120.0, warm: bool = False) -> DataFrame:
    """The runs of a program on ``todo`` (pkg, format, content, target), a child per task at a time."""

    def run(batches):
        session = Session(command) if warm else None
        try:
            for batch in batches:
                for pkg, kind, content, target in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    began = time.perf_counter()
                    events, output, error = session.request(kind, content, target, timeout) if warm else cold(command, kind, content, target, timeout)
                    took = round((time.perf_counter() - began) * 1000, 3)
                    names = {e.get("event") for e in events}
                    saved = "saved" in names and bool(output) and error != "timeout"
                    told = next((e.get("phase") for e in events if e.get("event") == "error"), None)
                    phase = "timeout" if error == "timeout" else None if saved else told or ("save" if "opened" in names else "open")
                    yield packages.batch_of(_RUNS, [(pkg, kind, "opened" in names, saved, output, phase, error, took)])
        finally:
            if session is not None:
                session.close()

    return todo.select("pkg", "format", "content", "target").mapInArrow(run, _RUNS)
