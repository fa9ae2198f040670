"""A code forge in a thread: pull requests in pages, diffs, snapshots and comments, with faults to order."""

import gzip
import io
import json
import re
import tarfile
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from time import monotonic
from urllib.parse import parse_qs, urlparse


class FakeForge:
    """pulls: repository -> id -> pull request; comments: pull request id -> list. `lose` POSTs take effect without an answer, `refuse` gives every call a status;
    `between(self)` is called once after each page."""

    def __init__(self, page=2):
        self.pulls, self.comments, self.trees, self.diffs = {}, {}, {}, {}
        self.asked, self.times, self.lock = [], [], threading.RLock()
        self.lose, self.refuse, self.between, self.next_id, self.page = 0, None, None, 1, page
        fake = self

        class Handler(BaseHTTPRequestHandler):
            def _do(h):
                size = int(h.headers.get("Content-Length") or 0)
                body = json.loads(h.rfile.read(size) or "null")
                with fake.lock:
                    fake.asked.append((h.command, h.path))
                    fake.times.append(monotonic())
                    got = (fake.refuse, {}) if fake.refuse else fake.answer(h.command, h.path, body)
                if got is None:
                    h.close_connection = True
                    return
                status, value = got
                data = value if isinstance(value, bytes) else json.dumps(value).encode()
                h.send_response(status)
                h.send_header("Content-Length", str(len(data)))
                h.end_headers()
                h.wfile.write(data)

            do_GET = do_POST = do_PUT = do_DELETE = _do

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.http.shutdown()

    def pull(self, repository, n, at, commit=None, files=None, diff=""):
        """A pull request that is new or has moved at the time (seconds)."""
        commit = commit or f"c{n}"
        self.pulls.setdefault(repository, {})[n] = {
            "id": n, "title": f"T{n} at {at}", "updated_on": f"2024-05-01T10:{at // 60:02d}:{at % 60:02d}.000000+00:00", "links": {"html": {"href": "u"}},
            "source": {"commit": {"hash": commit}, "branch": {"name": "b"}}, "destination": {"commit": {"hash": f"d{n}"}, "branch": {"name": "m"}},
        }
        self.diffs[n] = diff
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, text in (files or {}).items():
                info = tarfile.TarInfo(f"top/{name}")
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
        self.trees[commit] = gzip.compress(out.getvalue())

    def answer(self, method, path, body):
        url = urlparse(path)
        asked = parse_qs(url.query)
        if found := re.fullmatch(r"/w/[^/]+/get/(.+)\.tar\.gz", url.path):
            return 200, self.trees[found[1]]
        repository, n, what, which = re.fullmatch(r"/repositories/w/([^/]+)/pullrequests(?:/(\d+)(?:/(\w+)(?:/(\d+))?)?)?", url.path).groups()
        if n is None:
            rows = sorted(self.pulls.get(repository, {}).values(), key=lambda p: (p["updated_on"], p["id"]))
            if "q" in asked:
                least = asked["q"][0].removeprefix("updated_on >= ")
                rows = [p for p in rows if p["updated_on"][:19] >= least[:19]]
            k = int(asked.get("page", ["0"])[0])
            page = {"values": json.loads(json.dumps(rows[k * self.page : (k + 1) * self.page]))}
            if len(rows) > (k + 1) * self.page:
                page["next"] = f"{self.url}{url.path}?{url.query.split('&page=')[0]}&page={k + 1}"
            if self.between:
                between, self.between = self.between, None
                between(self)
            return 200, page
        n = int(n)
        if what is None:
            return 200, self.pulls[repository][n]
        if what == "diff":
            return 200, self.diffs[n].encode()
        there = self.comments.setdefault(n, [])
        if method == "GET":
            return 200, {"values": there}
        if method == "POST":
            there.append({"id": self.next_id, "content": body["content"]})
            self.next_id += 1
            if self.lose:
                self.lose -= 1
                return None
            return 201, there[-1]
        old = next(c for c in there if c["id"] == int(which))
        if method == "DELETE":
            there.remove(old)
            return 200, {}
        old["content"] = body["content"]
        return 200, old
