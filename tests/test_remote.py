"""Calls to a service: several under way, no more than its quota, in order."""

from __future__ import annotations

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from patternmill.operators import remote


class Counting:
    """A service that takes 50 ms a call and notes when each began, and how many were under way."""

    def __init__(self):
        self.began, self.refused, self.now, self.most, lock = [], set(), 0, 0, threading.Lock()
        own = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                with lock:
                    own.began.append(time.time())
                    own.now += 1
                    own.most = max(own.most, own.now)
                asked = self.rfile.read(int(self.headers["Content-Length"])).decode()
                time.sleep(0.05)
                with lock:
                    own.now -= 1
                data = ('{"title": "' + asked + '", "category": "testing"}').encode()
                refuse = asked.endswith("7") and asked not in own.refused
                own.refused |= {asked} if refuse else set()
                self.send_response(429 if refuse else 200)
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def caller(url):
    def call(prompt):
        import urllib.error
        import urllib.request

        try:
            return urllib.request.urlopen(urllib.request.Request(url, prompt.encode()), timeout=30).read().decode()
        except urllib.error.HTTPError as e:
            raise remote.RateLimited(str(e.code)) from e

    return call


@pytest.fixture
def service():
    s = Counting()
    yield s, f"http://127.0.0.1:{s.server.server_address[1]}"
    s.server.shutdown()


def chunks(spark, n):
    return spark.createDataFrame([(k, "go", "f.go", "", f"c{k}") for k in range(n)], "k int, language string, file_path string, context string, content string").coalesce(1)


def test_concurrency_raises_throughput_and_keeps_order(spark, service):
    s, url = service
    took = []
    for n in (1, 8):
        began = time.time()
        rows = remote.analyzed(chunks(spark, 40), "{code}", caller(url), concurrency=n, first=0.05).collect()
        took.append(time.time() - began)
        assert [(r["k"], r["analysis"]["title"]) for r in rows] == [(k, f"c{k}") for k in range(40)] and {r["error"] for r in rows} == {None}
        assert s.most <= n
    assert took[1] < took[0] / 2


def test_quota_of_all_tasks_together(spark, service):
    """Over any time no more calls than the rate allows, though four tasks have four calls each under way; refused calls count."""
    s, url = service
    rows = remote.analyzed(chunks(spark, 80).repartition(4), "{code}", caller(url), concurrency=4, rate=40.0, first=0.05).collect()
    assert len(rows) == 80 and {r["error"] for r in rows} == {None}
    began = sorted(s.began)
    for low in range(len(began)):
        for high in range(low + 20, len(began), 7):
            assert (high - low) / (began[high] - began[low]) < 40 * 1.35, (low, high)


def test_quota_alone():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(round(seconds, 6))
        now[0] += seconds

    q = remote.Quota(4.0, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        q.take()
    now[0] += 10
    q.take()
    q.take()
    assert slept == [0.25, 0.25, 0.25, 0.25]
