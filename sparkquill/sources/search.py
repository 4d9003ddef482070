"""A live search engine as a Spark data source: reads the answers to topics, writes documents in bulk.

    register(spark)
    spark.read.format("quill_search").option("url", ".../_search").option("topics", topics_option(topics)).load()   # qid, body, error
    docs.write.format("quill_bulk").option("url", "http://host/index").mode("append").save()                         # doc_id, doc_name, text

Requests are tried again after a pause that doubles; reading, a topic whose requests all fail gives a row with the error, and its fellows
are not asked again. Writing, a task that fails fails the write, and what this write has sent is deleted by its mark.
"""

from __future__ import annotations

import json
import time
import urllib.request
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def search_request(text: str, size: int = 100) -> dict:
    """The body of a full-text search for the text over the field ``text``. Its answers are read by files.parse_hits."""
    return {"query": {"match": {"text": text}}, "size": size}


def post(url: str, body: bytes, kind: str = "application/json", attempts: int = 4, pause: float = 0.5, timeout: float = 30.0) -> str:
    """The answer to a request, which is tried so many times at most."""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": kind}), timeout=timeout) as answer:
                return answer.read().decode()
        except OSError:  # HTTP errors and broken connections
            if k == attempts - 1:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("attempts must be 1 or more")


def topics_option(topics: DataFrame) -> str:
    """Topics (qid, title) as the option that the source takes. They are queries that people have written, so they are few."""
    return json.dumps([[r.qid, r.title or ""] for r in topics.select("qid", "title").collect()])


def _patience(options: dict) -> dict:
    return {"attempts": int(options.get("attempts", 4)), "pause": float(options.get("pause", 0.5)), "timeout": float(options.get("timeout", 30))}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        topics = json.loads(self.options["topics"])
        n = max(1, min(int(self.options.get("partitions", 8)), len(topics)))
        return [InputPartition(topics[k::n]) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for qid, title in partition.value:
            body = json.dumps(search_request(title, int(self.options.get("size", 100)))).encode()
            try:
                yield qid, post(self.options["url"], body, **_patience(self.options)), None
            except (OSError, UnicodeDecodeError) as e:
                yield qid, None, str(e)


class SearchSource(DataSource):
    """Options: url, topics (topics_option), size, partitions, attempts, pause, timeout."""

    @classmethod
    def name(cls) -> str:
        return "quill_search"

    def schema(self) -> str:
        return "qid int, body string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options
        self.mark = uuid.uuid4().hex

    def _send(self, lines: list[str]) -> None:
        answer = json.loads(post(f"{self.options['url']}/_bulk", ("\n".join(lines) + "\n").encode(), "application/x-ndjson", **_patience(self.options)))
        if answer.get("errors"):
            raise ValueError("the engine refused some documents")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        lines: list[str] = []
        for row in rows:
            lines += [json.dumps({"index": {"_id": str(row.doc_id)}}), json.dumps({"doc_name": row.doc_name, "text": row.text, "load": self.mark})]
            if len(lines) >= 2 * int(self.options.get("rows", 500)):
                self._send(lines)
                lines = []
        if lines:
            self._send(lines)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        post(f"{self.options['url']}/_refresh", b"", **_patience(self.options))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        post(f"{self.options['url']}/_delete_by_query", json.dumps({"query": {"term": {"load": self.mark}}}).encode(), **_patience(self.options))


class BulkSink(DataSource):
    """Options: url (of the engine's index), rows (a request), attempts, pause, timeout. A document of an id replaces an older one, so a task
    that Spark runs again writes the same."""

    @classmethod
    def name(cls) -> str:
        return "quill_bulk"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)
    spark.dataSource.register(BulkSink)


def fetch_hits(topics: DataFrame, url: str, size: int = 100, timeout: float = 30.0, attempts: int = 4) -> DataFrame:
    """(qid, body, error): each topic's search answer from a live search endpoint (its _search address)."""
    spark = topics.sparkSession
    register(spark)
    options = {"url": url, "topics": topics_option(topics), "size": str(size), "timeout": str(timeout), "attempts": str(attempts)}
    return spark.read.format("quill_search").options(**options).load()
