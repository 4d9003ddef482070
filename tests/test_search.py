"""The search source and the bulk sink against a small HTTP server."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sparkquill.sources import files, search


@pytest.fixture
def engine():
    """A server that keeps bulk documents, answers searches for a word with those that have it, fails each topic's first request, and the one
    for `broken` always. .kept: documents by id; .asked: requests by path."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            path = self.path.rpartition("/")[2]
            server.asked[path] += 1
            status, answer = 200, {}
            if path == "_search":
                query = json.loads(body)
                text = query["query"]["match"]["text"]
                server.tries[text] += 1
                if text == "broken" or server.tries[text] == 1:
                    status = 503
                hits = [{"_id": i, "_score": 1.0, "_source": d} for i, d in sorted(server.kept.items()) if text in d["text"].split()]
                answer = {"hits": {"hits": hits[: query["size"]]}}
            elif path == "_bulk":
                lines = [json.loads(x) for x in body.splitlines()]
                server.kept |= {a["index"]["_id"]: d for a, d in zip(lines[::2], lines[1::2], strict=True)}
                answer = {"errors": any("refuse" in d["text"] for d in lines[1::2])}
            elif path == "_delete_by_query":
                mark = json.loads(body)["query"]["term"]["load"]
                server.kept = {i: d for i, d in server.kept.items() if d["load"] != mark}
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.kept, server.asked, server.tries = {}, Counter(), Counter()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server, f"http://127.0.0.1:{server.server_port}/docs"
    server.shutdown()


def test_bulk_and_search(spark, engine):
    server, url = engine
    search.register(spark)
    docs = spark.createDataFrame([(i, f"D-{i}", f"river {'old' if i % 3 else 'new'}") for i in range(40)], "doc_id long, doc_name string, text string").repartition(3)
    docs.write.format("quill_bulk").options(url=url, rows="7").mode("append").save()
    assert len(server.kept) == 40 and server.asked["_refresh"] == 1 and server.asked["_bulk"] >= 6
    topics = spark.createDataFrame([(1, "new"), (2, "broken"), (3, "nothing"), (4, None)], "qid int, title string")
    got = spark.read.format("quill_search").options(url=f"{url}/_search", topics=search.topics_option(topics), size="5", attempts="2", pause="0.01", partitions="3").load()
    rows = {r.qid: r for r in got.collect()}
    assert sorted(rows) == [1, 2, 3, 4] and "503" in rows[2].error and rows[2].body is None and rows[1].error is None
    run = files.parse_hits(spark.createDataFrame([(r.qid, r.body) for r in rows.values()], "qid int, body string")).collect()
    assert sorted((r.qid, r["rank"], r.doc_name) for r in run) == [(1, k, d) for k, d in enumerate(["D-0", "D-12", "D-15", "D-18", "D-21"])]
    assert search.fetch_hits(topics.where("qid = 3"), f"{url}/_search").first().error is None


def test_a_failed_write_is_taken_back(spark, engine):
    server, url = engine
    search.register(spark)
    docs = spark.createDataFrame([(1, "a", "fine"), (2, "b", "refuse this")], "doc_id long, doc_name string, text string").coalesce(1)
    with pytest.raises(Exception, match="refused"):
        docs.write.format("quill_bulk").options(url=url, rows="1").mode("append").save()
    assert server.kept == {} and not server.asked["_refresh"]
