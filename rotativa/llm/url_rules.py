"""URL filtering with a trie over reversed host labels and path pieces.

A rule is written ``host/path``. It fits its host and all hosts below it if the URL's path starts
with the rule's path. The deepest host wins, then the longest path; between an allow and a block
rule of the same host and path, block wins. A URL without a rule, also a null or one without
``://``, gets the default verdict. Columns called host, path, rule or verdict are replaced, others pass
through. Repeated rows are judged each, URLs of any length are read whole, an empty table gives an empty result.

The trie goes to every task, so the rules must be few: more than ``MAX_RULES`` are refused. Whoever has longer
lists calls ``judge_by_join``, which gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 200_000

Rule = tuple[str, str]


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def pieces(path: str) -> list[str]:
    """``/en/25`` becomes ``/``, ``en/``, ``25``."""
    return [p for p in path.replace("/", "/\n").split("\n") if p]


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dictionaries: host labels from the right, then below ``/`` the pieces of the path.

    Verdicts stand under ``""``. A rule path that ends inside a piece stands under ``"*"`` of the
    node before.
    """
    root: dict = {}
    for verdict, rule in rules:
        host, path = split_rule(rule)
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        parts = pieces(path)
        partial = parts.pop() if parts and not parts[-1].endswith("/") else None
        for part in parts:
            node = node.setdefault(part, {})
        if partial is not None:
            node = node.setdefault("*", {}).setdefault(partial, {})
        if node.get("", ("", ""))[1] != "block":
            node[""] = (rule, verdict)
    return root


def longest_path(node: dict, parts: list[str]) -> tuple[str, str] | None:
    best = node.get("")
    for part in parts:
        fitting = [k for k in node.get("*", ()) if part.startswith(k)]
        if fitting:
            best = node["*"][max(fitting, key=len)][""]
        node = node.get(part)
        if node is None:
            break
        best = node.get("", best)
    return best


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the deepest host with a fitting path."""
    best, node, parts = None, trie, pieces(path)
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None or label == "/":
            break
        best = (longest_path(node["/"], parts) if "/" in node else None) or best
    return best


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null or a URL without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are too many for every task to hold; see judge_by_join")
    host, path = url_parts(url)
    kept = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batches):
        for batch in batches:
            hosts, paths = (batch.column(n).to_pylist() for n in ("host", "path"))
            found = [lookup(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "rule", "verdict"])

    return kept.mapInArrow(judge, T.StructType([*kept.schema.fields]).add("rule", "string").add("verdict", "string"))


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The same for a table of rules (verdict, rule) of any length.

    Every host suffix of a distinct (host, path) meets the rules of that host in a join; one row per
    (host, path) comes back. Rules of one host must be few compared with the table.
    """
    host, path = url_parts(url)
    kept = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    asked = kept.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    cut = rules.select(
        F.lower(F.substring_index("rule", "/", 1)).alias("suffix"),
        F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("start"),
        "rule",
        "verdict",
    )
    rank = F.struct(F.length("suffix"), F.length("start"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    best = asked.join(cut, "suffix").filter(F.col("path").startswith(F.col("start")))
    best = best.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_best"))
    out = kept.join(best, ["host", "path"], "left")
    verdict = F.coalesce("_best.verdict", F.lit(default))
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": verdict}).drop("_best").select(*kept.columns, "rule", "verdict")
