"""Snapshots that are read while they come in, over connections that drop."""

import gzip
import io
import random
import socket
import tarfile
import threading
import tracemalloc
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from revlens.sources import forge, trees, web


def _packed(files, kind=tarfile.GNU_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=kind) as t:
        for name, data in files:
            info = tarfile.TarInfo(f"top/{name}")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return gzip.compress(out.getvalue(), 1)


class Broken:
    """A server of one body, which hangs up after every `piece` bytes; with or without ranges and validators; `turns` gives the body of the n-th answer."""

    def __init__(self, body, piece, ranges=True, tag=True, turns=None, failing=()):
        self.asked, failing = [], list(failing)

        class Handler(BaseHTTPRequestHandler):
            def do_GET(h):
                self.asked.append(h.headers.get("Range"))
                if failing:
                    h.send_response(failing.pop(0))
                    h.send_header("Content-Length", "0")
                    h.end_headers()
                    return
                data = turns(len(self.asked)) if turns else body
                start = int(h.headers["Range"][6:-1]) if ranges and h.headers.get("Range") else 0
                h.send_response(206 if start else 200)
                h.send_header("Content-Length", str(len(data) - start))
                if tag:
                    h.send_header("ETag", f'"{hash(data)}"')
                h.end_headers()
                # without ranges each answer has to get further than the one before
                h.wfile.write(memoryview(data)[start : start + piece * (1 if ranges else len(self.asked))])
                h.wfile.flush()
                h.connection.shutdown(socket.SHUT_RDWR)

            def log_message(h, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.http.shutdown()


FILES = [(f"d/f{k}.py", random.Random(k).randbytes(3000).hex().encode()) for k in range(40)] + [("n" * 300 + ".py", b"long name"), ("bin", b"\xff\xfe"), ("empty", b"")]
TEXTS = {name: data.decode() for name, data in FILES if name != "bin"}


@pytest.mark.parametrize("ranges,tag", [(True, True), (True, False), (False, False), (False, True)])
@pytest.mark.parametrize("kind", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_a_dropped_snapshot_is_taken_up(ranges, tag, kind, tmp_path):
    body = _packed(FILES, kind)
    with Broken(body, len(body) // 5, ranges, tag, failing=[503]) as server:
        assert forge.ForgeClient(server.url, "u", "s", wait=0.001).tree("w", "r", "c") == TEXTS
        assert len(server.asked) >= 5 and server.asked[:2] == [None, None] and server.asked[2] is not None
        cached = forge.ForgeClient(server.url, "u", "s", str(tmp_path), wait=0.001)
        assert cached.tree("w", "r", "c") == TEXTS
        asked = len(server.asked)
        assert cached.tree("w", "r", "c") == TEXTS and len(server.asked) == asked


@pytest.mark.parametrize("ranges,tag", [(True, True), (False, False)])
def test_another_body_is_noticed(ranges, tag):
    one, other = _packed(FILES), _packed(FILES[::-1])
    with Broken(None, len(one) // 3, ranges, tag, turns=lambda n: one if n == 1 else other) as server:
        with pytest.raises(forge.ForgeError, match="has changed while it was read"):
            forge.ForgeClient(server.url, "u", "s", wait=0.001).tree("w", "r", "c")


def test_what_does_not_come_fails():
    with Broken(b"", 0, failing=[404]) as server, pytest.raises(forge.ForgeError) as e:
        forge.ForgeClient(server.url, "u", "s", wait=0.001).tree("w", "r", "c")
    assert e.value.status == 404 and len(server.asked) == 1
    with Broken(b"x" * 100, 0) as server, pytest.raises(forge.ForgeError, match="IncompleteRead"):
        forge.ForgeClient(server.url, "u", "s", wait=0.001, attempts=3).tree("w", "r", "c")
    assert len(server.asked) == 3
    body = _packed(FILES)
    for cut in (len(body) // 2, len(body) - 4):
        with pytest.raises(Exception, match="end|truncated|unexpected"):
            list(trees.tar_members(io.BytesIO(body[:cut])))
    broken = bytearray(body)
    broken[-6] ^= 1  # the checksum
    with pytest.raises(gzip.BadGzipFile):
        list(trees.tar_members(io.BytesIO(bytes(broken))))


def test_memory_does_not_grow_with_the_archive():
    text = random.Random(1).randbytes(1 << 19).hex().encode()

    def peak(n):
        body = _packed([(f"f{k}.py", text) for k in range(n)])
        with Broken(body, len(body) // 3) as server:
            tracemalloc.start()
            base = tracemalloc.get_traced_memory()[0]
            stream = web.Stream(web.Call(server.url), web.Policy(4, 0.001, 10))
            assert sum(len(t) for _, t in trees.tar_members(io.BufferedReader(stream, trees.BUFFER))) == n << 20
            found = tracemalloc.get_traced_memory()[1] - base
            tracemalloc.stop()
        return found

    assert peak(60) < peak(6) + (2 << 20)


def test_trees_of_a_folder(spark, tmp_path):
    for commit, files in (("a1", FILES), ("b2", [])):
        (tmp_path / f"{commit}.tar.gz").write_bytes(_packed(files))
    rows = trees.read_trees(spark, str(tmp_path)).collect()
    assert {(r["commit"], r["path"]): r["text"] for r in rows} == {("a1", k): v for k, v in TEXTS.items()} and len(rows) == len(TEXTS)
