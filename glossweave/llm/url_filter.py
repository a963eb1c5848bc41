"""URL filter: allow and block rules in a trie, the longest match decides.

A rule is (host, path, verdict). It fits its host and all subdomains when the
path of the url starts with the rule's. The trie goes down the host's labels
from the right, then down the path: "/", then each segment with its slash; what
a rule has after its last slash may be a part of a segment. Among the rules
that fit, the one with most labels and segments wins, then the longer one; on a
tie block wins.

The trie is broadcast while the rules are few (`MAX_TRIE_RULES`, counted
first). More rules are joined by (host suffix, path prefix) instead, with the
same results.

Null and malformed urls (no "://") have an empty host and path; only a rule of
empty host and path can fit them. Repeated rows are judged each. Extra columns
stay; columns named like a result (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.columns import guarded

#: Rules that may travel with the tasks: some hundred bytes each in a worker.
MAX_TRIE_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first "://": the host up to "/", "?", "#", A-Z lower-cased; the
    path from there up to "?" or "#"."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def path_steps(path: str) -> list[str]:
    """"/en/825" gives "/", "en/", "825"."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def labels(host: str) -> list[str]:
    return host.split(".")[::-1] if host else []


def rank(host: str, path: str, verdict: str) -> tuple[int, int, bool]:
    return (
        len(labels(host)) + len(path_steps(path)),
        len(host) + len(path),
        verdict == "block",
    )


class UrlTrie:
    """Nested dictionaries: hosts, then paths. A step without a slash is kept
    with its node as a beginning of the next segment."""

    def __init__(self, rules):
        self.root: dict = {"hosts": {}, "steps": {}}
        for host, path, verdict in rules:
            node = self.root
            for label in labels(host):
                node = node["hosts"].setdefault(label, {"hosts": {}, "steps": {}})
            for step in path_steps(path):
                node = node["steps"].setdefault(step, {"steps": {}})
            entry = (rank(host, path, verdict), host + path, verdict)
            node["rule"] = max(node.get("rule", entry), entry)

    def match(self, host: str, path: str):
        """(rule, verdict) of the best rule, or None."""
        steps = path_steps(path)
        best, node = self._along(self.root, steps, None), self.root
        for label in labels(host):
            node = node["hosts"].get(label)
            if node is None:
                break
            best = self._along(node, steps, best)
        return best and best[1:]

    @staticmethod
    def _along(node, steps, best):
        for step in [*steps, ""]:
            if "rule" in node and (best is None or node["rule"] > best):
                best = node["rule"]
            children = node["steps"]
            if not step or not children:
                break
            for n in range(1, len(step) + (not step.endswith("/"))):
                part = children.get(step[:n])
                if part and "rule" in part and not step[:n].endswith("/"):
                    best = part["rule"] if best is None else max(best, part["rule"])
            node = children.get(step)
            if node is None or not step.endswith("/"):
                break
        return best


def judge(
    urls: DataFrame,
    rules: DataFrame,
    url_column: str = "url",
    default: str = "allow",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """`urls` with host, path, rule (null if none fits) and verdict."""
    rules = rules.select("host", "path", "verdict").distinct()
    few = rules.limit(max_trie_rules + 1).collect()

    def judged(given: DataFrame) -> DataFrame:
        # the url is read from a copy: its own column may be named like a result
        copied = given.withColumn("_url", F.col(url_column))
        host, path = host_and_path(F.col("_url"))
        found = copied.withColumns({"host": host, "path": path})
        if len(few) <= max_trie_rules:
            found = _by_trie(found, [tuple(r) for r in few])
        else:
            found = _by_join(found, rules)
        return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))

    return guarded(urls, [url_column], judged, ["host", "path", "rule", "verdict"])


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(RESULT)
    def best(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = shared.value
        rows = [trie.match(h, p) or (None, None) for h, p in zip(host, path)]
        return pd.DataFrame(rows, columns=["rule", "verdict"], dtype=object)

    found = urls.withColumn("_best", best("host", "path"))
    return found.withColumns(
        {"rule": F.col("_best.rule"), "verdict": F.col("_best.verdict")}
    ).drop("_best")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Every distinct (host, path) gives one key for each host suffix and each
    length that a rule's path has; the keys meet the rules in an equi-join."""
    parts = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.split("host", r"\.")
    )
    ranked = rules.withColumn(
        "_rank",
        F.struct(
            F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))
            + F.size(F.filter(F.split("path", "(?<=/)"), lambda s: s != "")),
            F.length("host") + F.length("path"),
            F.col("verdict") == "block",
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
        ),
    ).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "_rank")
    sizes = rules.agg(F.array_sort(F.collect_set(F.length("path"))).alias("_sizes"))
    distinct = urls.select("host", "path").distinct()
    keys = (
        distinct.crossJoin(F.broadcast(sizes))  # one row: the lengths of paths
        .withColumn("_parts", parts)
        .withColumn("_from", F.explode(F.sequence(F.lit(0), F.size("_parts"))))
        .withColumn("_size", F.explode("_sizes"))
        .where(F.col("_size") <= F.length("path"))
        .select(
            "host",
            "path",
            F.array_join(F.slice("_parts", F.col("_from") + 1, F.size("_parts")), ".").alias("_host"),
            F.substring(F.col("path"), F.lit(1), F.col("_size")).alias("_path"),
        )
    )
    best = (
        keys.join(ranked, ["_host", "_path"])
        .groupBy("host", "path")
        .agg(F.max("_rank").alias("_best"))
        .select("host", "path", F.col("_best.rule").alias("_rule"), F.col("_best.verdict").alias("_verdict"))
    )
    return (
        urls.drop("rule", "verdict")
        .join(best, ["host", "path"], "left")
        .withColumnsRenamed({"_rule": "rule", "_verdict": "verdict"})
    )


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
