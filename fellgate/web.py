"""POST /query: a query's text in, GeoJSON out, piece by piece; 400 for mistakes in the text, 500 for failures while it runs.
GET /app: a page to write queries on and to see what they find."""

from __future__ import annotations

import json
import ssl
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain

from fellgate.engine import Engine
from fellgate.lang.errors import QueryError

#: Characters of a result that are sent together.
PIECE = 1 << 16
PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Queries</title>
<style>body{font-family:sans-serif;margin:1em;display:grid;grid-template-columns:24em 1fr;gap:1em}textarea{width:100%;height:12em}
svg{width:100%;height:85vh;border:1px solid #999}#said{white-space:pre-wrap}</style></head>
<body><form id="ask">
<p>{{bbox}} stands for the box: <input id="box" size="36" value="9.9, 53.5, 10.1, 53.6"></p>
<textarea id="text">bbox({{bbox}}).nodes{ amenity=bench }</textarea>
<p><button>Run</button></p><p id="said"></p></form><svg id="map" preserveAspectRatio="xMidYMid meet"></svg>
<script>
const at = id => document.getElementById(id), SVG = "http://www.w3.org/2000/svg";
function draw(found) {
  const box = at("box").value.split(",").map(Number), map = at("map"), size = Math.max(box[2] - box[0], box[3] - box[1]);
  map.setAttribute("viewBox", `${box[0]} ${-box[3]} ${box[2] - box[0]} ${box[3] - box[1]}`);
  map.replaceChildren();
  for (const f of found.features) {
    const g = f.geometry, point = g.type === "Point", shape = document.createElementNS(SVG, point ? "circle" : "path");
    if (point) { shape.setAttribute("cx", g.coordinates[0]); shape.setAttribute("cy", -g.coordinates[1]); shape.setAttribute("r", size / 250); }
    else shape.setAttribute("d", "M" + (g.type === "Polygon" ? g.coordinates[0] : g.coordinates).map(c => `${c[0]} ${-c[1]}`).join("L"));
    shape.setAttribute("fill", point ? "#c33" : "none");
    shape.setAttribute("stroke", g.type === "Polygon" ? "#393" : "#36c");
    shape.setAttribute("stroke-width", point ? 0 : size / 500);
    const title = document.createElementNS(SVG, "title");
    title.textContent = Object.entries(f.properties).map(e => e.join(" = ")).join("\\n");
    shape.append(title);
    map.append(shape);
  }
}
at("ask").onsubmit = async event => {
  event.preventDefault();
  at("said").textContent = "...";
  const answer = await fetch("query", {method: "POST", body: at("text").value.replaceAll("{{bbox}}", at("box").value)}), got = await answer.json();
  at("said").textContent = answer.ok ? `${got.features.length} objects` : got.error;
  if (answer.ok) draw(got);
};
</script></body></html>
"""


def _joined(pieces: Iterable[str]) -> Iterator[bytes]:
    """The pieces in UTF-8, some of them together."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= PIECE:
            yield "".join(held).encode()
            held, size = [], 0
    if held:
        yield "".join(held).encode()


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _head(self, status: int, kind: str, *more: tuple[str, str]) -> None:
            self.send_response(status)
            for name, value in (("Access-Control-Allow-Origin", "*"), ("Content-Type", kind), *more):
                self.send_header(name, value)
            self.end_headers()

        def _send(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self._head(status, kind, ("Content-Length", str(len(data))))
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802 - the name that the library calls
            if self.path == "/app":
                self._send(200, PAGE, "text/html; charset=utf-8")
            else:
                self._send(404, json.dumps({"error": "not found", "details": None}))

        def do_POST(self) -> None:  # noqa: N802
            text = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            if self.path != "/query":
                return self._send(404, json.dumps({"error": "not found", "details": None}))
            try:
                pieces = _joined(engine.geojson(text))
                first = next(pieces)  # what fails at once is told by the status; later failures break the connection off
            except QueryError as e:
                return self._send(400, json.dumps({"error": f"Error parsing query: {e.message}", "details": e.as_json()}))
            except Exception as e:  # noqa: BLE001 - whatever fails while Spark runs is the server's fault
                return self._send(500, json.dumps({"error": f"Error executing query: {e}", "details": None}))
            self._head(200, "application/json", ("Transfer-Encoding", "chunked"))
            for data in chain([first], pieces):
                self.wfile.write(b"%x\r\n%b\r\n" % (len(data), data))
            self.wfile.write(b"0\r\n\r\n")

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int = 8080, certificate: str | None = None, key: str | None = None) -> None:
    """certificate, key: files for TLS."""
    server = ThreadingHTTPServer(("", port), handler(engine))
    if certificate:
        context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
        context.load_cert_chain(certificate, key)
        server.socket = context.wrap_socket(server.socket, server_side=True)
    server.serve_forever()
