"""Benchmark decontamination (9): an Aho-Corasick automaton over normalised benchmark text.

Text is normalised to words: A-Z count as a-z, every other ASCII character
than a letter or digit separates, all other characters belong to words.
Each run of ``window`` words of an item is a window (an item of fewer words
is one), and each text is scanned once.  A word inside any occurrence is hit;
hit runs are mapped back to character offsets of the original text.

The automaton holds, of each item, every ``anchor``-th run of as many words,
where ``anchor`` is half a window: any window has one of them inside.  Where
one occurs, the windows around it are looked up by their 128-bit hash.  That
needs about a tenth of the nodes of all windows: one MB of item text takes
some 65 MB, hashes included, and ``MAX_BYTES`` bounds the broadcast part.  A
larger benchmark is dealt into parts; the text is written between them, so a
worker holds one automaton at a time.

Cases: null text has no words; an item that is null or without words matches
nothing; equal items are all reported; a null item id is reported as
``null``; rows that repeat an item id add up to one item; an empty benchmark
leaves every text clean; very long texts are a slice of their own; extra
columns are kept only when named in ``keep``.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow_text import slices, text_column, utf8
from .tables import fresh, written

MAX_BYTES = 4 << 20

# A-Z to a-z, ASCII separators to a blank, all else as it is
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                for c in range(256))
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _hash(run: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(run), digest_size=16).digest()


class Passages:
    """The windows of some items by hash, and the automaton that finds where to look them up."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick
        self.window, self.anchor = window, (window + 1) // 2
        self.owners: dict[bytes, tuple] = {}
        short: dict[bytes, set] = {}
        anchors: set[bytes] = set()
        for item, text in items:
            w = words(text)
            if 0 < len(w) < window:
                short.setdefault(b" " + b" ".join(w) + b" ", set()).add(item)
            for i in range(len(w) - window + 1):
                key = _hash(w[i:i + window])
                have = self.owners.get(key, ())
                if item not in have:
                    self.owners[key] = (*have, item)
            if len(w) >= window:
                for i in range(0, len(w) - self.anchor + 1, self.anchor):
                    anchors.add(b" " + b" ".join(w[i:i + self.anchor]) + b" ")
        self.automaton = None
        if short or anchors:
            self.automaton = ahocorasick.Automaton()
            for pattern in anchors | set(short):
                self.automaton.add_word(pattern.decode("latin-1"), (len(pattern), pattern in anchors, tuple(short.get(pattern, ()))))
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, set, set]:
        """(number of words, item ids, (first, last) words) of all windows that occur."""
        w = words(text)
        items: set = set()
        spans: set = set()
        if self.automaton is None or not w:
            return len(w), items, spans
        normal = (b" " + b" ".join(w) + b" ").decode("latin-1")
        gaps, tried = None, set()
        for end, (length, is_anchor, ids) in self.automaton.iter(normal):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
            at = int(np.searchsorted(gaps, end - length + 1))
            if ids:
                items.update(ids)
                spans.add((at, int(np.searchsorted(gaps, end)) - 1))
            if is_anchor:
                for i in range(max(0, at - self.anchor + 1), min(at, len(w) - self.window) + 1):
                    if i not in tried:
                        tried.add(i)
                        found = self.owners.get(_hash(w[i:i + self.window]))
                        if found:
                            items.update(found)
                            spans.add((i, i + self.window - 1))
        return len(w), items, spans


def _runs(raw: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text that runs of hit words span."""
    solid = np.frombuffer(_NORMAL, np.uint8)[raw] != 32
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(chars[starts[i]]), int(chars[ends[j - 1]]))
            for i, j in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]


def _parts(benchmark: DataFrame, item_id: str, text: str, max_bytes: int) -> list:
    """Item lists of bounded size, each of them broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                             F.col(text).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // max_bytes) or 1
    out = []
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        rows = part.toArrow()
        out.append(spark.sparkContext.broadcast(
            [(i, t.encode()) for i, t in zip(rows["item"].to_pylist(), rows["text"].to_pylist())]))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, keep: list[str] | None = None,
                  found: str = "found", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) and a struct ``found``.

    ``found`` has n_words, n_hit, items (sorted distinct ids as text) and
    runs (start and end characters of the hit passages).
    """
    keep = docs.columns if keep is None else keep
    parts = _parts(benchmark, item_id, item_text, max_bytes)
    fields = [docs.schema[c] for c in keep]
    result = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", _RUNS)])
    carried = [docs[c].alias(f"c{i}") for i, c in enumerate(keep)]
    df = docs.select(*carried, docs[text].alias("scanned"))
    names = [f"c{i}" for i in range(len(keep))]
    base = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    for k, sent in enumerate(parts):
        last = k + 1 == len(parts)
        kept = [T.StructField("found", result)] if last else [
            T.StructField("scanned", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", _SPANS)]
        df = df.mapInArrow(_stage(sent, uuid.uuid4().hex, window, names, k > 0, last), T.StructType([*base.fields, *kept]))
        if not last:
            df = written(df, "scanned")
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("found").alias(found))


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns as they are."""
    name = fresh(docs, "found")
    marked = decontaminate(docs, benchmark, found=name, **kw)
    return marked.filter(F.col(f"{name}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def _stage(sent, key: str, window: int, names: list[str], more: bool, last: bool):
    """One automaton over the batches; the last one makes the result."""
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    found_type = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                            ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        from driftrank.llm import decontaminate, worker_cache
        passages = worker_cache.once(key, lambda: decontaminate.Passages(sent.value, window))
        for batch in batches:
            for part in slices(batch, "scanned"):
                off, raw = utf8(text_column(part, "scanned"))
                data = raw.tobytes()
                column = lambda c: part.column(part.schema.get_field_index(c))
                before = list(zip(column("items").to_pylist(), column("spans").to_pylist())) if more else None
                out = []
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    n, items, spans = passages.scan(data[lo:hi])
                    if more:
                        items.update(before[i][0])
                        spans.update((x["first"], x["last"]) for x in before[i][1])
                    if not last:
                        out.append((sorted(items), [{"first": f, "last": t} for f, t in sorted(spans)]))
                    elif spans:
                        hit = np.zeros(n + 1, dtype=np.int64)
                        for f, t in spans:
                            hit[f] += 1
                            hit[t + 1] -= 1
                        hit = np.cumsum(hit[:-1]) > 0
                        out.append({"n_words": n, "n_hit": int(hit.sum()), "items": sorted(items),
                                    "runs": [{"start": s, "end": e} for s, e in _runs(raw[lo:hi], hit)]})
                    else:
                        out.append({"n_words": n, "n_hit": 0, "items": [], "runs": []})
                carried = [column(c) for c in names]
                if last:
                    yield pa.RecordBatch.from_arrays([*carried, pa.array(out, type=found_type)], [*names, "found"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*carried, column("scanned"), pa.array([x for x, _ in out], type=pa.list_(pa.string())),
                         pa.array([x for _, x in out], type=spans_type)], [*names, "scanned", "items", "spans"])

    return run
