"""The five lookups of the service as a function of method, path and body, and a small HTTP server around it."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaria.errors import ContractError
from zonaria.operators.scenario import Model, Scenario


@dataclass
class Service:
    """``zones`` and ``communities`` are profile tables, None where they aren't available."""

    model: Model | None
    zones: DataFrame | None = None
    communities: DataFrame | None = None

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, Any]:
        parts = [p for p in path.split("?")[0].split("/") if p]
        if (method, parts) == ("GET", ["health"]):
            have = {"model": self.model is not None, "zones": self.zones is not None, "communities": self.communities is not None}
            return (200 if all(have.values()) else 503), have
        if (method, parts) == ("GET", ["catalog"]):
            return (200, self.model.catalog()) if self.model else (503, {"error": "no model"})
        if (method, parts) == ("POST", ["simulate"]):
            return self._simulate(body or {})
        if method == "GET" and len(parts) == 3 and parts[:2] == ["decision-support", "ageb"]:
            return self._profile(self.zones, "cvegeo", parts[2])
        if method == "GET" and len(parts) == 3 and parts[:2] == ["decision-support", "community"]:
            return self._profile(self.communities, "cluster_id", parts[2])
        return 404, {"error": "unknown path"}

    def _simulate(self, body: dict) -> tuple[int, Any]:
        try:
            state, sector, amount, rho = str(body["estado"]), str(body["sector"]), float(body["monto"]), float(body.get("rho", 0.35))
        except (KeyError, TypeError, ValueError) as e:
            return 400, {"error": f"bad field: {e}"}
        if self.model is None:
            return 503, {"error": "no model"}
        try:
            return 200, Scenario(state, {sector: amount}, rho).run(self.model).report.to_dict()
        except ContractError as e:
            return 400, {"error": str(e)}

    def _profile(self, table: DataFrame | None, key: str, value: str) -> tuple[int, Any]:
        if table is None:
            return 503, {"error": "no profiles"}
        row = table.filter(F.col(key).cast("string") == value).limit(1).collect()
        return (200, row[0].asDict(recursive=True)) if row else (404, {"error": f"unknown {key}"})


def _clean(v: Any) -> Any:
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, dict):
        return {k: _clean(x) for k, x in v.items()}
    return [_clean(x) for x in v] if isinstance(v, list | tuple) else v


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for ``service``; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            try:
                n = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(n)) if n else None
                code, out = service.handle(self.command, self.path, body)
            except json.JSONDecodeError:
                code, out = 400, {"error": "no JSON"}
            data = json.dumps(_clean(out), default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
