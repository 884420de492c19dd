"""Token counts (1): whole texts encoded once, tokens attributed to sections by their offsets.

A text is encoded as a whole, so counts per section add up to the text's
count, which separate encoding of sections would not.  Token spans are
joined to the sections' spans by binary search within the text.  A token
that reaches into several sections goes by an explicit rule:

- ``majority``: to the section that holds most of its bytes, the earlier one
  if equal (default);
- ``start``: to the section that holds its first byte;
- ``split``: to each section by its share of the token's bytes.

Sections are character ranges, given as an array column of (start, end), or
the lines of the text, each with its line end.  A section that begins before
the one before it ends is cut to begin there; ranges beyond the text are cut
to it; empty ranges hold no tokens.  Tokens outside all sections are counted
under section -1.

Cases: null and empty texts give one row, section 0 without tokens, when
sections are lines, and their own (empty) sections otherwise; a null section
array counts as no sections; repeated rows count each for itself; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow_text import slices, text_column, utf8

RULES = ("majority", "start", "split")


class Encoder:
    """Whole-text encoding from a rank file, with the byte length of every token."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)


def line_ranges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the lines, each with its line end; an empty text is one empty line."""
    ends = np.flatnonzero(raw == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    return np.concatenate([[0], ends[:-1]]), ends


def given_ranges(sections: list | None, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the given array, byte starts, byte ends), sorted and without overlap."""
    rows = sorted(((max(0, s["start"] or 0), max(0, s["end"] or 0), i) for i, s in enumerate(sections or []) if s),
                  key=lambda x: (x[0], x[1], x[2]))
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))   # byte of each character
    start, end, place, last = [], [], [], 0
    for s, e, i in rows:
        s, e = max(last, int(at[min(s, len(at) - 1)])), int(at[min(e, len(at) - 1)])
        e = max(s, e)
        start.append(s)
        end.append(e)
        place.append(i)
        last = e
    return np.array(place, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def attribute(lengths: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens per section, tokens that cross into or out of it, tokens outside) of one text."""
    stop = np.cumsum(lengths)
    begin = stop - lengths
    count, crossing = np.zeros(len(start)), np.zeros(len(start), dtype=np.int64)
    if not len(start):
        return count, crossing, float(len(lengths))
    full = np.flatnonzero(end > start)      # empty ranges hold nothing
    s, e = start[full], end[full]
    first = np.searchsorted(e, begin, side="right")
    last = np.searchsorted(s, stop, side="left") - 1
    inside = np.minimum(first, len(s) - 1) if len(s) else first
    whole = (first == last) & (begin >= s[inside]) & (stop <= e[inside]) if len(s) else np.zeros(len(begin), bool)
    np.add.at(count, full[first[whole]], 1)
    out = float((last < first).sum())
    for t in np.flatnonzero((last >= first) & ~whole).tolist():
        touched = np.arange(first[t], last[t] + 1)
        part = np.minimum(e[touched], stop[t]) - np.maximum(s[touched], begin[t])
        crossing[full[touched]] += 1
        free = int(lengths[t] - part.sum())
        if rule == "split":
            count[full[touched]] += part / lengths[t]
            out += free / lengths[t]
        elif rule == "start":
            if s[touched[0]] <= begin[t]:
                count[full[touched[0]]] += 1
            else:
                out += 1
        elif part.max() >= free:
            count[full[touched[int(part.argmax())]]] += 1
        else:
            out += 1
    return count, crossing, out


def token_counts(docs: DataFrame, ranks: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text",
                 sections: str | None = None, rule: str = "majority") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), offsets in bytes of the UTF-8 text.

    ``ranks`` is the path of a rank file on the driver, ``pattern`` its split
    pattern; ``sections`` names an array column of (start, end) characters.
    ``n_tokens`` is a double, whole unless the rule is ``split``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    key, id_type = uuid.uuid4().hex, docs.schema[doc_id].dataType

    def run(batches):
        from driftrank.llm import token_counts as module, worker_cache
        encoder = worker_cache.once(key, lambda: module.Encoder(*sent.value))
        for batch in batches:
            for part in slices(batch, "text"):
                col = text_column(part, "text")
                off, raw = utf8(col)
                given = part.column(2).to_pylist() if part.num_columns > 2 else None
                rows, out = [], [[] for _ in range(5)]
                for i, t in enumerate(col.to_pylist()):
                    data = raw[off[i]:off[i + 1]]
                    if given is None:
                        start, end = module.line_ranges(data)
                        place = np.arange(len(start))
                    else:
                        place, start, end = module.given_ranges(given[i], data)
                    lengths = encoder.length[np.array(encoder.encode(t), dtype=np.int64)]
                    count, crossing, outside = module.attribute(lengths, start, end, rule)
                    if outside:
                        place, start, end = np.append(place, -1), np.append(start, 0), np.append(end, len(data))
                        count, crossing = np.append(count, outside), np.append(crossing, 0)
                    rows.append(np.full(len(place), i))
                    for o, x in zip(out, (place, start, end, count, crossing)):
                        o.append(x)
                take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                kinds = (np.int64, np.int64, np.int64, np.float64, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), *[pa.array(np.concatenate(o).astype(k) if o else np.zeros(0, k))
                                                  for o, k in zip(out, kinds)]],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    columns = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    if sections:
        columns.append(F.col(sections).alias("sections"))
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, T.LongType()) for n in ("section", "start", "end")],
                           T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType())])
    return docs.select(*columns).mapInArrow(run, schema)
