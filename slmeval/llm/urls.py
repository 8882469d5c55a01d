"""URL allow and block rules: a trie over reversed host labels, then path segments.

A rule is (verdict, host, path). It fits its host and every subdomain when the url's path starts
with the rule's path (a plain string prefix, so ``/en/1`` also fits ``/en/123``). Of the rules
that fit, the one with the most host labels wins, then the longest path: the match that is the
longest in ``host + path``. A url without a fitting rule gets the default verdict.

The trie is broadcast while it has at most ``MAX_RULES`` rules (checked); beyond that the urls'
host suffixes are joined with the rule table instead (same results, skew left to the adaptive
planner). Both are maps over the url column but for that join.

Results: a null url or one without ``://`` has empty host and path (only a rule with an empty
host fits it). Of rules with the same host and path, a block wins over an allow. Host labels are
compared as written after A-Z are lower-cased; a port or user part belongs to the host.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, put

MAX_RULES = 100_000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Node:
    """A trie node: child labels or segments, and the rules that end inside this node.

    A rule path is whole segments and an unfinished last one; ``tails`` holds the rules by that
    last part, and ``bare`` the rule without a path.
    """

    __slots__ = ("children", "segments", "tails", "bare")

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.tails: dict[str, Rule] = {}
        self.bare: Rule | None = None


def build_trie(rules: Sequence[Rule]) -> Node:
    root = Node()
    for rule in sorted(rules, key=lambda r: r.verdict == "block"):  # block after allow: it stays
        rule = Rule(rule.verdict, rule.host.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER)), rule.path)
        node = root
        for label in reversed(rule.host.split(".") if rule.host else []):
            node = node.children.setdefault(label, Node())
        if not rule.path:
            node.bare = rule
            continue
        *whole, tail = rule.path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.tails[tail] = rule
    return root


def _path_match(node: Node, path: str) -> Rule | None:
    """The longest rule path below one host node."""
    found, segments = node.bare, path.split("/")
    for segment in segments:
        if node.tails:
            for n in range(len(segment), -1, -1):
                if segment[:n] in node.tails:
                    found = node.tails[segment[:n]]
                    break
        node = node.segments.get(segment)
        if node is None:
            break
    return found


def match(trie: Node, host: str, path: str) -> Rule | None:
    """The longest match: the deepest host node with a fitting path."""
    found, node = _path_match(trie, path), trie
    for label in reversed(host.split(".")):
        node = node.children.get(label)
        if node is None:
            break
        found = _path_match(node, path) or found
    return found


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_trie(df: DataFrame, rules: Sequence[Rule], host: Column, path: Column) -> Column:
    trie = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rules])

    @F.arrow_udf("struct<verdict:string,rule:string>")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        root = build_trie([Rule(*r) for r in trie.value])
        for hosts, paths in batches:
            found = [match(root, h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            yield pa.StructArray.from_arrays(
                [pa.array([r and r.verdict for r in found], type=pa.string()),
                 pa.array([r and r.name for r in found], type=pa.string())], names=["verdict", "rule"])

    return judge(host, path)


def _by_join(df: DataFrame, rules: DataFrame, host: str, path: str, hit: str) -> DataFrame:
    """Join each url's host suffixes with the rules' hosts; the longest fitting rule per row."""
    suffix, labels = fresh_names(df, "suffix", "labels")
    urls = df.select(host, path).distinct()
    parts = F.split(F.col(host), r"\.")
    suffixes = urls.withColumn(labels, parts).withColumn(suffix, F.explode(F.concat(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")),
        F.array(F.lit("")))))
    suffixes = suffixes.select(host, path, suffix).distinct()
    r = rules.select(F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict")
    fits = suffixes.join(r, F.col(suffix) == F.col("r_host")).filter(F.col(path).startswith(F.col("r_path")))
    depth = F.when(F.col("r_host") == "", 0).otherwise(F.size(F.split("r_host", r"\.")))
    best = fits.groupBy(host, path).agg(F.max_by(
        F.struct("verdict", F.concat("r_host", "r_path").alias("rule")),
        F.struct(depth, F.length("r_path"), F.col("verdict") == "block")).alias(hit))
    return df.join(best, [host, path], "left")


def judge_urls(df: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Append ``host``, ``path``, ``rule`` (``host + path`` of the winning rule, else null) and
    ``verdict`` (the rule's, else ``default``). ``rules``: Rule tuples, or a table (verdict, host,
    path) of any size."""
    hit, host, path = fresh_names(df, "hit", "host", "path")
    base = df.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    table = rules if isinstance(rules, DataFrame) else None
    if table is not None:
        rows = table.select("verdict", "host", "path").limit(MAX_RULES + 1).collect()
        rules = [Rule(*r) for r in rows] if len(rows) <= MAX_RULES else None
    elif len(rules) > MAX_RULES:
        table = df.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
        rules = None
    if rules is None:
        judged = _by_join(base, table, host, path, hit)
    else:
        judged = base.withColumn(hit, _by_trie(df, rules, F.col(host), F.col(path)))
    out = put(judged, host=F.col(host), path=F.col(path), rule=F.col(f"{hit}.rule"),
              verdict=F.coalesce(F.col(f"{hit}.verdict"), F.lit(default)))
    return out.drop(hit, host, path)
