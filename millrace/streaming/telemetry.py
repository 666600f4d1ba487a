"""Progress events, stage statistics and a metrics endpoint."""

from __future__ import annotations

import ipaddress
import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..errors import ConfigError

log = logging.getLogger("millrace")


@dataclass(frozen=True)
class Event:
    kind: str  # source_batch, stage_batch, sink_batch or done
    stage: str
    rows_in: int
    rows_out: int


@dataclass(frozen=True)
class StageStats:
    """``elapsed`` is that of the whole job: Spark runs the stages of a plan as one."""

    name: str
    rows_in: int
    rows_out: int
    batches: int
    elapsed: float

    @property
    def rows_per_second(self) -> float:
        return self.rows_in / self.elapsed if self.elapsed else 0.0


def notify(callback: Callable[[Event], None] | None, event: Event) -> None:
    """A callback that raises is logged, not fatal."""
    log.debug("%s %s %d %d", event.kind, event.stage, event.rows_in, event.rows_out)
    if callback is not None:
        try:
            callback(event)
        except Exception:
            log.exception("progress callback failed")


class Metrics:
    """Counters in the Prometheus text format, fed by events, served over HTTP while it is open."""

    def __init__(self, address: str = "127.0.0.1:0", name: str = "millrace", allow_remote: bool = False) -> None:
        host, _, port = address.rpartition(":")
        try:
            loopback = host == "localhost" or ipaddress.ip_address(host.strip("[]")).is_loopback
        except ValueError:
            loopback = False
        if not loopback and not allow_remote:
            raise ConfigError(f"metrics: {address} can be reached by others; allow it explicitly")
        self.name, self.lock = name, threading.Lock()
        self.values: dict[str, int] = {f"{name}_rows": 0, f"{name}_batches": 0, f"{name}_dead_letter_rows": 0, f"{name}_running": 1}
        metrics = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                body = metrics.text().encode()
                self.send_response(200 if self.path == "/metrics" else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.end_headers()
                self.wfile.write(body if self.path == "/metrics" else b"")

            def log_message(self, *_: object) -> None:
                pass

        self.server = ThreadingHTTPServer((host.strip("[]"), int(port)), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    @property
    def port(self) -> int:
        return self.server.server_address[1]

    def __call__(self, event: Event) -> None:
        with self.lock:
            if event.kind == "source_batch":
                self.values[f"{self.name}_rows"] += event.rows_in
                self.values[f"{self.name}_batches"] += 1
            elif event.kind == "stage_batch":
                for way, n in (("in", event.rows_in), ("out", event.rows_out)):
                    key = f'{self.name}_stage_rows{{stage="{event.stage}",dir="{way}"}}'
                    self.values[key] = self.values.get(key, 0) + n

    def finish(self, dead_letter_rows: int = 0) -> None:
        with self.lock:
            self.values[f"{self.name}_dead_letter_rows"] = dead_letter_rows
            self.values[f"{self.name}_running"] = 0

    def text(self) -> str:
        with self.lock:
            return "".join(f"{k} {v}\n" for k, v in sorted(self.values.items()))

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
