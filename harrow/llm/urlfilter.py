"""URL filter: longest match in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Above this many rules the rule set is joined instead of broadcast.
MAX_BROADCAST_RULES = 2_000_000


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Host labels from the last to the first; below each host, path segments.

    A host node has children by label and a path node; a path node has children by whole segment,
    the rule that ends there, and the rules whose last segment is not closed by `/`.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"labels": {}}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["labels"].setdefault(label, {"labels": {}})
            node = node.setdefault("path", {"segments": {}, "open": {}})
            *whole, last = path.split("/")
            for segment in whole:
                node = node["segments"].setdefault(segment, {"segments": {}, "open": {}})
            # of rules with the same pattern the blocking one holds
            if node["open"].get(last, ("", ""))[1] != "block":
                node["open"][last] = (host + path, verdict)

    @staticmethod
    def _below(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for open_, rule in node["open"].items():
                if segment.startswith(open_) and (best is None or len(rule[0]) > len(best[0])):
                    best = rule
            node = node["segments"].get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest match: most host labels first, then the longest path."""
        best, node, segments = None, self.root, path.split("/")
        if "path" in node:
            best = self._below(node["path"], segments)
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            if "path" in node:
                best = self._below(node["path"], segments) or best
        return best or (None, None)


def _parts(df: DataFrame, url: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))


def _by_trie(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            found = [trie.match(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parts.mapInArrow(judge, schema)


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same matches by an equi-join of every host suffix with the rules' hosts."""
    rules = rules.select(
        "verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.concat(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
        F.array(F.lit("")),
    )
    keyed = parts.select("*", F.xxhash64("host", "path").alias("part"))
    sites = keyed.select("host", "path").distinct()
    hits = (
        sites.withColumn("rule_host", F.explode(F.array_distinct(suffixes))).join(rules, "rule_host")
        .filter(F.col("path").startswith(F.col("rule_path")))
    )
    depth = F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\.")))
    order = F.struct(depth, F.length("rule_path"), F.col("verdict") == "block")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order).alias("best"))
    return keyed.join(best, ["host", "path"], "left").select("row", "host", "path", "best.rule", "best.verdict")


def filter_urls(
    df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """Judge every url: columns `row` (the input), `host`, `path`, `rule`, `verdict`.

    `rules` has verdict (allow or block), host and path; a rule fits its host and all subdomains
    if the url's path starts with the rule's. The longest match wins: more host labels, then the
    longer path; of equal patterns the blocking one. Up to `max_rules` rules are broadcast as
    a trie, more are joined by host suffix; both give the same rows.

    Null urls and urls without `://` have empty host and path and get `default`, unless a rule has
    an empty host and path. Null rule fields count as empty, rules with a null verdict are left
    out. Repeated rows are judged each; an empty table gives no rows.
    """
    if default not in ("allow", "block"):
        raise ValueError("default must be allow or block")
    rules = rules.filter("verdict is not null").select("verdict", *[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")])
    parts = _parts(df, url)
    few = rules.limit(max_rules + 1).collect()
    judged = _by_trie(parts, [tuple(r) for r in few]) if len(few) <= max_rules else _by_join(parts, rules)
    return judged.select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
