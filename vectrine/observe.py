"""Timings and events of operations, kept on the driver and told as a table."""

from __future__ import annotations

import csv
import html
import io
import json
import logging
import time
from collections import deque
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from vectrine.errors import redacted

log = logging.getLogger("vectrine")


class Journal:
    """The latest ``most`` entries ``(at, kind, name, ms, ok, about)``; listeners are told each one."""

    def __init__(self, most: int = 10_000):
        self.entries: deque = deque(maxlen=most)
        self.listeners: list = []

    def note(self, kind: str, name: str, ms: float = 0.0, ok: bool = True, **about) -> None:
        entry = {"at": time.time(), "kind": kind, "name": name, "ms": ms, "ok": ok, "about": json.dumps(redacted(about), default=str)}
        self.entries.append(entry)
        for tell in self.listeners:
            try:
                tell(entry)
            except Exception:  # noqa: BLE001  a listener never breaks an operation
                log.exception("a listener failed")

    @contextmanager
    def timed(self, kind: str, name: str, **about):
        """Times a block; an error is noted and goes on."""
        began, ok = time.perf_counter(), False
        try:
            yield
            ok = True
        finally:
            self.note(kind, name, (time.perf_counter() - began) * 1000, ok, **about)

    def select(self, kind: str | None = None, name: str | None = None, since: float = 0.0) -> list[dict]:
        return [e for e in self.entries if (kind is None or e["kind"] == kind) and (name is None or e["name"] == name) and e["at"] >= since]

    def table(self, spark: SparkSession) -> DataFrame:
        """The entries as rows; ``aggregates.profile`` gives their percentiles."""
        rows = [tuple(e.values()) for e in self.entries]
        return spark.createDataFrame(rows, "at double, kind string, name string, ms double, ok boolean, about string")

    def export(self, form: str = "json") -> str:
        if form == "json":
            return json.dumps(list(self.entries))
        if form == "csv":
            out = io.StringIO()
            w = csv.DictWriter(out, ["at", "kind", "name", "ms", "ok", "about"])
            w.writeheader()
            w.writerows(self.entries)
            return out.getvalue()
        if form == "trace":  # read by the tracing pages of browsers
            events = [{"name": f"{e['kind']}: {e['name']}", "ph": "X", "ts": (e["at"] * 1000 - e["ms"]) * 1000, "dur": e["ms"] * 1000, "pid": 0, "tid": 0, "args": {"ok": e["ok"], "about": e["about"]}} for e in self.entries]
            return json.dumps({"traceEvents": events})
        if form == "html":
            names = ["at", "kind", "name", "ms", "ok", "about"]
            rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(e[n]))}</td>" for n in names) + "</tr>" for e in self.entries)
            return f"<table><tr>{''.join(f'<th>{n}</th>' for n in names)}</tr>{rows}</table>"
        raise ValueError(f"unknown form {form!r}")
