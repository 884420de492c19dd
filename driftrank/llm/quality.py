"""Quality classifier (3): supervised subword embeddings, trained by numpy SGD.

A word is a white-space chunk as written.  Its features are the chunk itself
and its runs of three and four bytes, one boundary mark on each side
included, each hashed to a row of an embedding table; a word that repeats the
one before adds one more feature.  A word's vector is the mean of its
features' vectors, a text's vector the mean of its words', and a softmax layer
over two classes gives the score.

Because everything before the softmax is an average, the difference of the
two outputs is the mean of one number per feature row.  Scoring hashes all
byte runs of a slice at once and adds up those numbers, per word and per
text; each text is read once, whole.

Training uses at most ``per_class`` labelled texts of each class, the first
by hash of the id, of at most ``max_chars`` characters; the class shares of
all training labels correct the bias afterwards.  Labels of held-out ids
(crc32 of the id as text divisible by 5) are never used.  Labels, language,
source and id are no inputs of a score.

Cases: null and empty texts get the score of the class shares alone; rows
that repeat an id are scored each for itself; with labels of one class or
none the score is the share of label 1 (one half without labels); null
labels and labels of unknown ids are ignored; a very long text is a slice of
its own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow_text import slices, text_column, utf8, word_hashes, word_spans
from .tables import held_out

BITS = 17
BUCKETS = 1 << BITS
REPEAT = BUCKETS            # one row more, of repeated words
DIM = 16
THRESHOLD = 0.3
_SALT3, _SALT4 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_MARK = 0x20


def _rows_of_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the three and four bytes from every place."""
    x = data.astype(np.uint32)
    three = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    four = three[:-1] | (x[3:] << np.uint32(24))
    shift = np.uint32(32 - BITS)

    def place(v, salt):
        v = (v ^ (v >> np.uint32(15))) * salt
        return ((v ^ (v >> np.uint32(13))) * salt) >> shift
    return place(three, _SALT3), place(four, _SALT4)


@dataclass
class Words:
    """Features of the words of some texts; ``at`` has the range of words of each text."""
    at: np.ndarray
    starts: np.ndarray
    size: np.ndarray
    whole: np.ndarray
    three: np.ndarray
    four: np.ndarray
    again: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        off, raw = utf8(texts)
        data = np.insert(raw, off, _MARK)                  # a mark before each text and at the end
        starts, ends, at = word_spans(off + np.arange(len(off)), data)
        hashes = word_hashes(data, starts, ends)
        cover = np.zeros(len(data) + 1, dtype=np.int32)
        cover[starts] += 1
        cover[ends] -= 1
        data[np.cumsum(cover[:-1]) == 0] = _MARK             # white space of any kind
        three, four = _rows_of_runs(np.concatenate([data, np.full(3, _MARK, np.uint8)]))
        again = np.zeros(len(starts), dtype=bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[at[:-1][at[:-1] < len(starts)]] = False
        return cls(at, starts - 1, ends - starts, (hashes >> np.uint64(64 - BITS)).astype(np.int64), three, four, again)

    def means(self, row: np.ndarray) -> np.ndarray:
        """Per word the mean of ``row`` over its features: itself, ``size`` runs of three, one run of four less."""
        if not len(self.size):
            return np.zeros(0)
        return (row[self.whole] + _added(row[self.three], self.starts, self.size)
                + _added(row[self.four], self.starts, self.size - 1)) / (2 * self.size)

    def difference(self, row: np.ndarray) -> np.ndarray:
        """Per text the mean of its words' means and of the row of repeats; 0 without words."""
        n = np.diff(self.at)
        again = _added(self.again.astype(np.float64), self.at[:-1], n)
        total = _added(self.means(row), self.at[:-1], n) + again * float(row[REPEAT])
        return total / np.maximum(n + again, 1)


def _added(values: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of ``count`` values from each start; starts rise."""
    if not len(values):
        return np.zeros(len(starts))
    edges = np.empty(2 * len(starts), dtype=np.int64)
    edges[0::2], edges[1::2] = starts, starts + count
    padded = np.append(values.astype(np.float64), 0.0)
    out = np.add.reduceat(padded, np.minimum(edges, len(values)))[0::2]
    return np.where(count > 0, out, 0.0)


@dataclass
class Model:
    """Per row the part of the class difference, and the bias."""
    row: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = Words.of(texts).difference(self.row) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Network:
    """The trained table and the softmax layer."""
    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def collapsed(self, shift: float) -> Model:
        """The class difference as one number per row; ``shift`` corrects the bias."""
        return Model((self.table @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32),
                     float(self.bias[1] - self.bias[0]) + shift)


def text_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of a text's average; weights add up to 1."""
    w = Words.of(pa.array([text], pa.string()))
    n, again = len(w.size), int(w.again.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    each = 1.0 / (2 * w.size * (n + again))

    def runs(rows, count):
        first = np.repeat(w.starts, count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return rows[first + place], np.repeat(each, count)
    r3, w3 = runs(w.three, w.size)
    r4, w4 = runs(w.four, w.size - 1)
    at, back = np.unique(np.concatenate([w.whole, r3, r4, [REPEAT]]), return_inverse=True)
    weights = np.concatenate([each, w3, w4, [again / (n + again)]])
    return at.astype(np.int64), np.bincount(back, weights=weights).astype(np.float32)


def train(texts: list[str], labels: list[int], *, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Network:
    """SGD over single texts."""
    docs = [text_vector(t) for t in texts]
    rng = np.random.default_rng(seed)
    table = (rng.random((BUCKETS + 1, DIM), dtype=np.float32) - 0.5) / DIM
    out = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1 - done / steps)
            done += 1
            at, w = docs[i]
            vectors = table[at]
            h = w @ vectors if len(at) else np.zeros(DIM, np.float32)
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            if len(at):
                # normalised step: the text's vector moves by the rate, however many rows it averages
                table[at] = vectors - (lr / max(float(w @ w), 1e-6)) * np.outer(w, back)
    return Network(table, out, bias)


def model_of(texts: list[str], labels: list[int], share: float) -> Model:
    """The model; ``share`` is the share of label 1 among all training labels."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS + 1, np.float32), 12.0 if share >= 1 and labels else -12.0 if labels else 0.0)
    prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    mean = sum(labels) / len(labels)
    balance = float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9)))
    return train(texts, labels).collapsed(prior - balance)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = 1000, max_chars: int = 1 << 16) -> Model:
    """A model of the labels outside the held-out fifth."""
    known = (labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
             .filter("y in (0, 1) and id is not null").filter(~held_out("id")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    drawn = None
    for y in (0, 1):
        some = known.filter(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    drawn = drawn.groupBy("id").agg(F.min("y").alias("y"))  # at most two per_class rows: broadcast
    rows = (docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
            .join(F.broadcast(drawn), "id").filter(F.length("t") <= max_chars)
            .orderBy(F.xxhash64("id"), "id", F.xxhash64("t")).limit(2 * per_class).toArrow())
    return model_of(rows["t"].to_pylist(), rows["y"].to_pylist(), share)


def _scores(model: Model, docs: DataFrame, text: str, emit, schema):
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield emit(part, sent.value.scores(text_column(part, text)))

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    def emit(part: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
            ["doc_id", "score", "predicted"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    out = _scores(model, docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", emit, schema)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are."""
    def emit(part: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(score >= threshold))

    return _scores(model, docs, text, emit, docs.schema)
