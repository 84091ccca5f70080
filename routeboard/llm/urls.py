"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's.  The longest fitting rule decides
(characters of host and path; then the longer host; a block entry before an
equal allow entry), else ``default``.

The trie is broadcast; its rules come from the caller and their size is
checked against ``MAX_RULE_BYTES`` first.  Nothing is shuffled.  NULL URLs and
URLs without ``://`` have an empty host and path, which only a rule with an
empty host and path fits.  Repeated rows are judged row by row, a very long URL
takes time in proportion to its segments, and an empty table gives none.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeboard.llm.words import unused

MAX_RULE_BYTES = 64 << 20
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


class _Node:
    __slots__ = ("below", "ends", "lengths", "paths")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.paths: _Node | None = None   # on a host node: the trie of its rules' paths
        self.ends: dict[str, tuple[str, str]] = {}  # on a path node: begun segment -> (rule, verdict)
        self.lengths: list[int] = []   # of the begun segments, longest first


class UrlTrie:
    """``rules``: (verdict, host, path) with verdict ``allow`` or ``block``."""

    def __init__(self, rules):
        rules = list(rules)
        if sum(len(h) + len(p) for _, h, p in rules) > MAX_RULE_BYTES:
            raise ValueError(f"rules of more than {MAX_RULE_BYTES} characters")
        self.root = _Node()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node.below.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, begun = path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            if node.ends.get(begun, ("", ""))[1] != "block":
                node.ends[begun] = (host.translate(_LOWER) + path, verdict)
                if len(begun) not in node.lengths:
                    node.lengths = sorted([*node.lengths, len(begun)], reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        best, depth_best = None, -1
        node, labels = self.root, host.split(".")[::-1] if host else []
        segments = path.split("/")
        for depth in range(len(labels) + 1):
            if node.paths:
                at = node.paths
                for segment in segments:
                    # a begun segment is looked up by its length; the longest is the longest rule of this node
                    begun = next((segment[:n] for n in at.lengths if segment[:n] in at.ends), None)
                    end = at.ends.get(begun)
                    if end and (best is None or (len(end[0]), depth) > (len(best[0]), depth_best)):
                        best, depth_best = end, depth
                    at = at.below.get(segment)
                    if at is None:
                        break
            node = node.below.get(labels[depth]) if depth < len(labels) else None
            if node is None:
                break
        return best


def judge(df: DataFrame, rules, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (NULL: none fits) and verdict; columns of those names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        trie, rows = shared.value, []
        for host, path in map(split_url, urls):
            rule, verdict = trie.find(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    keep = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    made = unused("judged", df.columns)
    return df.select(*keep, judged(F.col(url)).alias(made)).select(*keep, f"{made}.*")
