"""An index that grows: segments, each a saved index of the documents that came together, and a manifest of those that count.

A change writes new folders first and a new version of the manifest last, under a name that must not exist, so readers see a whole state
and of two writers at once one fails. A document that comes again replaces the older one: its id is dead in the segments before, and what it
adds to their lexicons is written beside them, so that merged statistics are sums of small tables and never a second pass over the postings.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkquill.operators.analysis import Analyser
from sparkquill.operators.index import Index, bucket_of, frequent_terms, index_of
from sparkquill.operators.tables import file_names, read_text, remove_path, settled, write_text

_DEAD_TERMS = "segment string, term string, df long, ctf long, bucket int"


@dataclass
class Segments:
    """The segments under a path. An index of phrases keeps all of them in its segments and leaves out the rare ones when it is read."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(spark: SparkSession, path: str, analyser: Analyser, buckets: int = 64) -> Segments:
        """An index without documents. buckets: of the terms' hashes, for all of its segments."""
        own = Segments(spark, path)
        own._commit(0, {"analyser": json.loads(analyser.to_json()), "buckets": buckets, "segments": [], "dead": [], "batches": []})
        return own

    def manifest(self) -> dict:
        names = file_names(self.spark, f"{self.path}/manifest")
        if not names:
            raise ValueError(f"no index at {self.path}")
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{names[-1]}")) | {"version": int(names[-1].split(".")[0])}

    def _commit(self, version: int, content: dict) -> None:
        write_text(self.spark, f"{self.path}/manifest/{version:012d}.json", json.dumps({k: v for k, v in content.items() if k != "version"}), once=True)

    @property
    def analyser(self) -> Analyser:
        return Analyser.from_json(json.dumps(self.manifest()["analyser"]))

    def _kept(self, own: dict) -> Analyser:
        return Analyser.from_json(json.dumps(own["analyser"] | {"phrase_df": 1}))

    def add(self, docs: DataFrame, batch: str | None = None) -> None:
        """Documents (doc_id, text) become a segment, and those of them that the index has are replaced. batch: a name of what is added; what was
        added under this name before isn't added again. An id that comes twice at once, or null, is an error."""
        own = self.manifest()
        if batch is not None and batch in own["batches"]:
            return
        docs = settled(docs.select("doc_id", "text"))
        if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
            raise ValueError("a document's id is null or comes twice")
        name = f"segment-{uuid.uuid4().hex}"
        index_of(docs, self._kept(own)).save(f"{self.path}/{name}", own["buckets"])
        self._commit(own["version"] + 1, own | self._without(own, docs.select("doc_id")) | {"segments": [*own["segments"], name], "batches": [*own["batches"], *([batch] if batch is not None else [])]})

    def delete(self, ids: DataFrame) -> None:
        """The documents with these ids (doc_id) go."""
        own = self.manifest()
        self._commit(own["version"] + 1, own | self._without(own, settled(ids.select("doc_id").distinct())))

    def _without(self, own: dict, ids: DataFrame) -> dict:
        """What a manifest has of the dead after these ids (a written table) went from its segments."""
        if not own["segments"]:
            return {}
        dead = self._dead(own, "ids", "segment string, doc_id long")
        live = functools.reduce(DataFrame.unionByName, [self._segment(x).doc_stats.select(F.lit(x).alias("segment"), "doc_id") for x in own["segments"]])
        gone = settled(live.join(ids, "doc_id", "left_semi").join(dead, ["segment", "doc_id"], "left_anti").select("segment", "doc_id"))
        if gone.isEmpty():
            return {}
        name = f"dead-{uuid.uuid4().hex}"
        gone.write.parquet(f"{self.path}/{name}/ids")
        rows = functools.reduce(DataFrame.unionByName, [self._segment(x).postings.select(F.lit(x).alias("segment"), "doc_id", "term", "tf") for x in own["segments"]])
        less = rows.join(gone, ["segment", "doc_id"], "left_semi").groupBy("segment", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        less.withColumn("bucket", bucket_of(F.col("term"), own["buckets"])).write.parquet(f"{self.path}/{name}/terms")
        return {"dead": [*own["dead"], name]}

    def _segment(self, name: str) -> Index:
        return Index.load(self.spark, f"{self.path}/{name}")

    def _dead(self, own: dict, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}/{what}" for x in own["dead"]]) if own["dead"] else self.spark.createDataFrame([], schema)

    def index(self) -> Index:
        """All live documents as one index, whose statistics are those of an index built at once."""
        own = self.manifest()
        analyser = Analyser.from_json(json.dumps(own["analyser"]))
        if not own["segments"]:
            return index_of(self.spark.createDataFrame([], "doc_id long, text string"), analyser)
        parts = {x: self._segment(x) for x in own["segments"]}
        if len(parts) == 1 and not own["dead"] and analyser.kind != "phrase":
            return next(iter(parts.values()))
        dead = self._dead(own, "ids", "segment string, doc_id long")

        def live(name: str, columns: list[str]) -> DataFrame:
            rows = [(p.postings if name == "postings" else p.tables[name]).select(F.lit(x).alias("segment"), *columns) for x, p in parts.items()]
            rows = functools.reduce(DataFrame.unionByName, rows)
            return (rows.join(dead, ["segment", "doc_id"], "left_anti") if own["dead"] else rows).select(*columns)

        rows = live("postings", ["term", "doc_id", "tf", "dl", *(["positions"] if analyser.positions else []), "bucket"])
        if analyser.kind == "phrase":
            return Index(frequent_terms(rows.select("term", "doc_id", "tf"), analyser.phrase_df), analyser=analyser)
        words = functools.reduce(DataFrame.unionByName, [p.tables["lexicon"].select("bucket", "term", "df", "ctf") for p in parts.values()])
        less = self._dead(own, "terms", _DEAD_TERMS).select("bucket", "term", (-F.col("df")).alias("df"), (-F.col("ctf")).alias("ctf"))
        lexicon = words.unionByName(less).groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")).where("df > 0")
        return Index(rows, {"lexicon": lexicon, "doc_stats": live("doc_stats", ["doc_id", "dl", "n_terms"])}, analyser, own["buckets"])

    def compact(self) -> None:
        """All live postings become one segment, without tokenizing any text again. Folders that no longer count stay for readers until vacuum()."""
        own = self.manifest()
        if not own["segments"]:
            return
        name = f"segment-{uuid.uuid4().hex}"
        whole = Segments._whole(self, own)
        Index(whole, analyser=self._kept(own)).save(f"{self.path}/{name}", own["buckets"])
        self._commit(own["version"] + 1, own | {"segments": [name], "dead": []})

    def _whole(self, own: dict) -> DataFrame:
        dead = self._dead(own, "ids", "segment string, doc_id long")
        rows = [self._segment(x).postings.drop("bucket").withColumn("segment", F.lit(x)) for x in own["segments"]]
        return functools.reduce(DataFrame.unionByName, rows).join(dead, ["segment", "doc_id"], "left_anti").drop("segment")

    def vacuum(self) -> None:
        """Deletes the segments and tables of the dead that the manifest doesn't have. Only when no reader or writer is at work."""
        own = self.manifest()
        for name in file_names(self.spark, self.path):
            if name.startswith(("segment-", "dead-")) and name not in own["segments"] + own["dead"]:
                remove_path(self.spark, f"{self.path}/{name}")
