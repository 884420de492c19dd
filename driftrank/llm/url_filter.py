"""URL filters (2): a trie over reversed host labels and path segments, longest match first.

A rule names a host and a path.  It fits that host and all its subdomains if
the url's path starts with the rule's; of several fitting rules the one with
the most host labels wins, then the one with the longest path, then block
over allow.  Urls without a fitting rule get the default verdict.

The trie's nodes are host labels from the right; a node holds the path trie
of the rules that end there: nodes by whole segments, and at the last one
the beginnings of a segment.  Rules are broadcast up to ``max_rules``; more
are dealt into several tries of that size, and each url passes one trie
after another and keeps its best rule.

Host and path are taken with Spark functions: the host is what follows the
first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
the path goes on to ``?``, ``#`` or the end.

Cases: null urls and urls without ``://`` have an empty host and path and
get the default verdict; an empty table gives no rows; repeated rows are
judged each for itself; in a very long segment only the lengths that rules
have there are tried; without rules all get the default; a rule is given
once or more often with the same effect; extra columns named in ``keep``
are carried along.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

MAX_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Rules (host, path, verdict) for longest-match lookup."""

    def __init__(self, rules):
        self.hosts: dict = {}
        for host, path, verdict in rules:
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            # path "/a/b" is the segments "", "a" and the beginning "b" of the next
            *whole, last = path.split("/")
            at = node.setdefault("", {})            # no host label is empty inside a rule
            for segment in whole:
                at = at.setdefault(segment, {})
            lengths, ends = at.setdefault(None, ([], {}))   # beginnings of the next segment, their lengths falling
            if len(last) not in lengths:
                lengths.append(len(last))
                lengths.sort(reverse=True)
            if ends.get(last, (0, 0, "allow"))[2] != "block":
                ends[last] = (host, path, verdict)

    def _paths(self, at: dict, path: str):
        best = None
        parts = path.split("/")
        for segment in parts:
            if None in at:
                lengths, ends = at[None]
                for n in lengths:
                    found = ends.get(segment[:n]) if n <= len(segment) else None
                    if found:
                        best = found
                        break
            at = at.get(segment)
            if at is None:
                break
        return best

    def find(self, host: str, path: str):
        """The rule that wins for a host and path, or None."""
        best, node = None, self.hosts
        if not host:
            return None
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            if "" in node:
                best = self._paths(node[""], path) or best
        return best


def split_url(url: str):
    """Columns host and path of a url column."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _stage(sent, key: str):
    def run(batches):
        from driftrank.llm import url_filter, worker_cache
        trie = worker_cache.once(key, lambda: url_filter.Trie(sent.value))
        for batch in batches:
            get = batch.schema.get_field_index
            out = []
            for host, path, old in zip(batch.column(get("host")).to_pylist(), batch.column(get("path")).to_pylist(),
                                       batch.column(get("best")).to_pylist()):
                new = trie.find(host, path)
                if old and (not new or _rank(old["host"], old["path"], old["verdict"]) >= _rank(*new)):
                    out.append(old)
                else:
                    out.append(dict(zip(("host", "path", "verdict"), new)) if new else None)
            columns = list(batch.columns)
            columns[get("best")] = pa.array(out, type=batch.schema.field("best").type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return run


def _rank(host: str, path: str, verdict: str):
    return host.count("."), len(path), verdict == "block"


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url", keep: list[str] | None = None,
               default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Columns ``keep`` (default: page_id) and host, path, rule, verdict of every url.

    ``rules`` are (host, path, verdict) with the path from its first slash on.
    """
    keep = ["page_id"] if keep is None else keep
    host, path = split_url(url)
    best = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")])
    df = pages.select(F.struct(*keep).alias("kept"), host.alias("host"), path.alias("path"),
                      F.lit(None).cast(best).alias("best"))
    for at in range(0, len(rules), max_rules):
        sent = pages.sparkSession.sparkContext.broadcast(rules[at:at + max_rules])
        df = df.mapInArrow(_stage(sent, uuid.uuid4().hex), df.schema)
    return df.select("kept.*", "host", "path", F.concat("best.host", "best.path").alias("rule"),
                     F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
