"""Repositories and files from a service, against a local one that counts what it is asked."""

from __future__ import annotations

import base64
import json
import threading
import time
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from patternmill.operators import repos
from patternmill.sources import service

RAW = ["full_name", "name", "description", "language", "private", "default_branch", "html_url", "owner"]


def repo(k):
    return {
        "full_name": f"me/r{k}", "name": f"r{k}", "description": None if k % 3 else f"No {k}", "language": "Go", "private": k % 2 == 0, "default_branch": "main" if k % 5 else None, "html_url": f"http://x/{k}", "owner": {"login": "me", "id": k}, "stars": k,
    }


class Fake:
    """Lists repos in pages, with trees and contents. broken: pages that always fail; busy: paths that are refused so many times first."""

    def __init__(self, n):
        self.repos, self.asked, self.broken, self.busy, self.lock = [repo(k) for k in range(n)], Counter(), set(), Counter(), threading.Lock()
        self.files = {"me/r0": {"a.py": b"x = 1\n", "src/b c.go": "é\n".encode(), "bin.py": b"\xff", "README.md": b"# r"}, "me/r1": {"gone.js": None}}
        fake = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                with fake.lock:
                    code, body, headers = fake.answer(self.path, f"http://127.0.0.1:{self.server.server_address[1]}")
                data = json.dumps(body).encode()
                self.send_response(code)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, path, base):
        self.asked[path] += 1
        if self.busy[path] > 0:
            self.busy[path] -= 1
            return 403, {}, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": str(int(time.time()) + 1)}
        url = urllib.parse.urlparse(path)
        asked = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        parts = urllib.parse.unquote(url.path).strip("/").split("/")
        if parts == ["list"]:
            page, n = int(asked["page"]), int(asked["per_page"])
            if page in self.broken:
                return 404, {}, {}
            last = max(1, -(-len(self.repos) // n))
            return 200, self.repos[(page - 1) * n : page * n], {"Link": f'<{base}/list?page=1>; rel="first", <{base}/list?per_page={n}&page={last}>; rel="last"'} if last > 1 else {}
        held = self.files.get("/".join(parts[1:3]))
        if held is None:
            return 404, {}, {}
        if parts[3:5] == ["git", "trees"]:
            return 200, {"tree": [{"path": "src", "type": "tree"}, *({"path": p, "type": "blob", "size": len(d or b"")} for p, d in held.items())]}, {}
        data = held.get("/".join(parts[4:]))
        return (200, {"content": base64.encodebytes(data).decode()}, {}) if data is not None else (404, {}, {})


@pytest.fixture
def fake():
    f = Fake(23)
    yield f
    f.server.shutdown()


def test_rows_equal_the_dump_and_pages_are_fetched_once(spark, fake, tmp_path):
    (tmp_path / "dump.json").write_text("\n".join(json.dumps(r) for r in fake.repos))
    found, failed = service.repositories(spark, f"{fake.url}/list", page_size="5")
    want = repos.repo_listing(spark, f"file://{tmp_path}/dump.json")
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert fake.asked == {f"/list?page={k}&per_page=5": 1 for k in range(1, 6)} and failed.count() == 0


def test_pages_that_fail_are_rows_and_quotas_are_waited_for(spark, fake):
    fake.broken, fake.busy["/list?page=2&per_page=5"] = {4}, 1
    began = time.time()
    service.register(spark)
    rows = spark.read.format("repository_service").option("url", f"{fake.url}/list").option("page_size", "5").load().collect()
    assert [(r["page"], r["error"][:3]) for r in rows if r["error"]] == [(4, "404")] and len([r for r in rows if not r["error"]]) == 18
    assert fake.asked["/list?page=2&per_page=5"] == 2 and fake.asked["/list?page=4&per_page=5"] == 1 and time.time() - began > 0.3


def test_nothing_listed_and_no_service(spark, fake):
    fake.repos = []
    assert service.repositories(spark, f"{fake.url}/list")[0].count() == 0
    _, failed = service.repositories(spark, "http://127.0.0.1:9/list", attempts="2", most_wait="0.01")
    assert [r["page"] for r in failed.collect()] == [1]


def test_stream_takes_what_is_new(spark, fake, tmp_path):
    service.register(spark)

    def run():
        stream = spark.readStream.format("repository_service").option("url", f"{fake.url}/list").option("page_size", "5").load()
        stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r["name"][1:]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    assert run() == list(range(23))
    fake.repos += [repo(k) for k in range(23, 31)]
    fake.asked.clear()
    assert run() == list(range(31))
    assert fake.asked["/list?page=2&per_page=5"] == 0 and run() == list(range(31))


def test_files(spark, fake):
    listed = spark.createDataFrame([("me/r0", "main"), ("me/r1", None), ("me/r2", "main")], "full_name string, default_branch string")
    got = {(r["repo"], r["file_path"]): (r["content"], r["language"], (r["error"] or "")[:3]) for r in service.repository_files(listed, fake.url, attempts=2, most_wait=0.01).collect()}
    assert got == {("me/r0", "a.py"): ("x = 1\n", "python", ""), ("me/r0", "src/b c.go"): ("é\n", "go", ""), ("me/r0", "bin.py"): (None, "python", ""), ("me/r1", "gone.js"): (None, "javascript", "404"), ("me/r2", None): (None, "unknown", "404")}
    assert max(fake.asked.values()) == 1
    assert service.repository_files(listed.where("full_name = 'me/r0'"), fake.url, known_only=False).count() == 4


def test_waiting(monkeypatch):
    from email.message import Message

    told = Message()
    told["Retry-After"] = "7"
    assert service._wait(told, 0, 900) == 7 and service._wait(None, 3, 900) == 8 and service._wait(None, 30, 900) == 900
    waits: list = []
    with pytest.raises(service.Failed):
        service.ask("http://127.0.0.1:9/", attempts=4, sleep=waits.append)
    assert waits == [1, 2, 4]
