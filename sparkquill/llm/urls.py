"""URL filter lists: host-suffix and path-prefix expressions, met by short hash prefixes and confirmed by full digests.

Only DataFrame and SQL functions are used. Each distinct URL is judged once for each salt among its rows' ids, and the verdicts are joined
back by URL and salt: a URL that fills a third of the table costs SALTS judgements at most and its rows are spread over as many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rules up to which their table is broadcast; beyond it the same equi-join shuffles both sides.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8
#: Keys over which the rows of one URL are spread by their ids.
SALTS = 256


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased) and path (then up to ``?``, ``#`` or the
    end). Both are empty for a null or a text without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict of the longest rule that fits each URL.

    rules has verdict (allow or block), host and path. A rule fits its host and all subdomains if the URL's path starts with the
    rule's path. The longest rule (characters of host and path) wins; among equally long ones the longer host, then block. Rules with a
    null in any column are ignored.

    Returns a row per row of pages: page_id, host, path, rule (host and path of the rule that decides, else null) and verdict (the
    rule's, else `default`). Null ids stay; null URLs and those without ``://`` have an empty host and path, which no rule with a host
    fits. Repeated rows get equal verdicts; an empty table gives an empty table; other columns are not read.
    """
    rules = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).dropna()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    key = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    rules = rules.select(key.alias("rule_digest"), F.substring(key, 1, PREFIX_HEX).alias("short"), "rule_host", "rule_path", "verdict")
    bounds = rules.agg(F.max(F.length("rule_host")).alias("max_host"), F.max(F.length("rule_path")).alias("max_path"), F.count("*").alias("n"), F.collect_set(F.when(~F.col("rule_path").endswith("/") & (F.col("rule_path") != ""), F.length("rule_path"))).alias("cuts")).first()
    cuts = sorted(bounds.cuts)  # at most as many as the longest rule path has characters

    host, path = split_url(F.col("url"))
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).alias("salt")
    urls = pages.select(F.col(url_col).alias("url"), salt).distinct().select("url", "salt", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.filter(suffixes, lambda x: F.length(x) <= (bounds.max_host or 0))
    short_path = F.substring("path", 1, bounds.max_path or 0)  # no rule's path is longer
    parts = F.split(short_path, "/")
    slashes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i - 1), "/"), F.lit("/"))))
    if cuts:
        others = F.transform(F.filter(F.array(*map(F.lit, cuts)), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
        slashes = F.array_union(slashes, others)
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(F.array_distinct(slashes), lambda p: F.concat_ws("\n", h, p))))
    found = urls.where("url is not null").select("url", "salt", F.explode(F.transform(expressions, lambda e: F.sha2(e, 256))).alias("digest"))
    found = found.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    found = found.join(F.broadcast(rules) if bounds.n <= BROADCAST_RULES else rules, "short").where("digest = rule_digest")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "verdict")
    best = found.groupBy("url", "salt").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    host, path = split_url(F.col("p.url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), salt).alias("p")
    rows = rows.join(best.alias("b"), (F.col("p.url") == F.col("b.url")) & (F.col("p.salt") == F.col("b.salt")), "left")
    return rows.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
