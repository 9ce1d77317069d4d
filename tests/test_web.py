"""Entities and pages from a server of this test: batches, retries, failures as rows, what is known isn't asked for again."""

from __future__ import annotations

import collections
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodestar.sources import web


@pytest.fixture(scope="module")
def server():
    seen = collections.Counter()
    asked: list[dict] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append(q)
            key = q.get("ids") or q.get("titles")
            seen[key] += 1
            body, code = "{}", 200
            if q["action"] == "wbgetentities":
                ids = q["ids"].split("|")
                if "Q13" in ids:
                    body = "not json"
                else:
                    body = json.dumps({"entities": {i: {"missing": ""} if i == "Q404" else {"sitelinks": {"enwiki": {"title": f"T{i[1:]}"}}} for i in ids}})
            elif key == "T2" and seen[key] < 3:
                code = 503
            elif key == "T5":
                code = 404
            elif key == "T6":
                body = json.dumps({"query": {"pages": {"-1": {}}}})
            else:
                body = json.dumps({"query": {"pages": {"7": {"extract": f"page of {key}"}}}})
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/api", seen, asked
    s.shutdown()


def test_titles_in_batches(spark, server):
    url, _, asked = server
    ids = spark.createDataFrame([(f"Q{i}",) for i in (*range(1, 8), 404, 1, 1)] + [(None,)], "qid string").coalesce(1)
    asked.clear()
    got = {r.qid: (r.title, r.error) for r in web.titles(ids, web.Service(url, batch=3, pause=0)).collect()}
    assert got == {**{f"Q{i}": (f"T{i}", None) for i in range(1, 8)}, "Q404": (None, None)}
    assert all(len(q["ids"].split("|")) <= 3 for q in asked)
    bad = web.titles(spark.createDataFrame([("Q13",), ("Q14",)], "qid string").coalesce(1), web.Service(url, batch=1, pause=0))
    got = {r.qid: r for r in bad.collect()}
    assert "JSONDecodeError" in got["Q13"].error
    assert got["Q14"].title == "T14"


def test_enriched_rows_keep_failures(spark, server):
    url, seen, asked = server
    u = lambda i: f"http://x/entity/Q{i}"
    rows = [(1, u(2), u(5), None, "old"), (2, u(404), "none", "T9", None), (3, u(6), u(2), None, None), (4, None, u(404), None, None)]
    qa = spark.createDataFrame(rows, "id int, s_uri string, o_uri string, s_wiki_title string, o_wiki_title string")
    service = web.Service(url, pause=0.001, tries=4)
    seen.clear()
    out = web.enriched(qa, service, service)
    got = {r.id: r for r in out.collect()}
    assert got[1].s_wiki_content == "page of T2"  # after two answers 503
    assert seen["T2"] == 3
    assert got[1].o_wiki_title == "T5"
    assert "404" in got[1].o_error
    assert got[1].o_wiki_content is None
    assert (got[2].s_wiki_title, got[2].s_wiki_content, got[2].o_wiki_title) == ("T9", "page of T9", None)
    assert (got[3].s_wiki_content, got[3].s_error) == (None, None)  # no such page
    assert got[4].s_wiki_title is None
    names = spark.createDataFrame([("T2",), ("T5",), ("T10",)], "title string")
    known = web.pages(names, service)
    asked.clear()
    assert {r.title: r.page for r in web.pages(names, service, known).collect()} == {"T2": "page of T2", "T5": None, "T10": "page of T10"}
    assert [q["titles"] for q in asked] == ["T5"]  # only the failed one is asked for again


def test_a_service_that_is_not_there(spark):
    dead = web.Service("http://127.0.0.1:9/none", tries=2, pause=0)
    (row,) = web.pages(spark.createDataFrame([("T",)], "title string"), dead).collect()
    assert row.page is None
    assert row.error
