"""Language identification (12) by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` entries of 1 and -1, drawn from
its code point.  A trigram's vector binds (multiplies) its letters' vectors,
the first rotated by two places, the second by one; a text's vector bundles
(adds) those of all its trigrams.  A language's prototype bundles the
trigrams of all its training texts, each by the square root of its count, so
that one text with very many copies does not fill it.  A text belongs to the
language whose prototype has the largest cosine with its vector; that
cosine, at least 0, is the score.

Letters are lower-cased; a combining mark counts as a letter of its own, all
other characters between letters as one gap, with a gap before and after the text.

Training counts trigrams per language as one Spark aggregate over all
training texts, then bundles them by partial sums; nothing but the
prototypes (languages by ``DIM`` doubles, at most ``max_languages``) reaches
the driver.  Scanning is one pass without a shuffle over byte-bounded slices.
Held-out ids (crc32 of the id as text modulo ``folds`` equal to ``held``)
never train.  Language, source and id are no inputs of a prediction.

Cases: null texts and texts without a letter are ``und`` with score 0, and so
is every text when nothing was learned; equal cosines go to the language
first in order; null languages do not train; rows that repeat an id count and
are scored each for itself; very long texts are read whole; an empty table
gives no rows; a null id is not held out; extra columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import slices, text_column
from .tables import written

DIM = 1024
SEED = 12
GAP = 32
UNKNOWN = "und"
KEEP = 1 << 14
ENTRIES = 1 << 22


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Per code point: 2 a letter, 1 a combining mark, 0 anything else."""
    return np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8)


@dataclass
class Profiles:
    """Languages in order, and their prototypes, of length 1 each."""
    languages: list[str]
    prototypes: np.ndarray


class Letters:
    """Code point -> vector; the latest ``KEEP`` stay."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed, self.held = dim, seed, {}

    def vectors(self, points: np.ndarray) -> np.ndarray:
        if len(self.held) + len(points) > KEEP:
            self.held = {}
        out = np.empty((len(points), self.dim), dtype=np.int8)
        for i, p in enumerate(points.tolist()):
            v = self.held.get(p)
            if v is None:
                v = self.held[p] = np.random.default_rng([self.seed, p]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
            out[i] = v
        return out

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of packed trigrams."""
        letters = [(grams >> 42), (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]
        out = None
        for turn, l in zip((2, 1, 0), letters):
            points, back = np.unique(l, return_inverse=True)
            v = np.roll(self.vectors(points), turn, axis=1)[back]
            out = v if out is None else out * v
        return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram) of every trigram occurrence, in order, and whether each text has a letter."""
    joined = "\0".join(t.lower() for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    ends = points == 0
    if int(ends.sum()) != len(texts):           # a text has a zero character itself: it is no letter
        return trigrams([t.replace("\0", " ") for t in texts])
    kind = _kinds()[points]
    text = np.cumsum(ends) - ends
    has = np.bincount(text[kind == 2], minlength=len(texts)) > 0
    # the first character of a run without letters is a gap, unless a text starts or ends there; each end is one
    other = kind == 0
    keep = ~other
    keep[1:-1] |= other[1:-1] & ~other[:-2]
    keep[:-1] &= ~(other[:-1] & _until_end(other, ends))
    keep |= ends
    symbol, owner = np.where(other, GAP, points)[keep], text[keep]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    at = np.flatnonzero(first)
    symbol, owner = np.insert(symbol, at, GAP), np.insert(owner, at, owner[at])
    gram = (symbol[:-2] << 42) | (symbol[1:-1] << 21) | symbol[2:]
    same = owner[:-2] == owner[2:]
    return owner[:-2][same], gram[same], has


def _until_end(other: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For all characters but the last: whether only characters without letters follow up to the text's end."""
    letters = np.concatenate([[0], np.cumsum(~other)])
    place = np.flatnonzero(ends)
    own_end = place[np.cumsum(ends) - ends]
    at = np.arange(len(other))
    return (letters[own_end] == letters[at])[:-1]


def _numbered(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams, and the number of each occurrence's one."""
    lo, hi = (1 << 21) - 1, 1 << 21
    letters = np.flatnonzero(np.bincount(np.concatenate([gram & lo, (gram >> 21) & lo, gram >> 42]), minlength=hi))
    if len(letters) > 128:
        return np.unique(gram, return_inverse=True)
    place = np.zeros(hi, dtype=np.int64)
    place[letters] = np.arange(len(letters))
    n = len(letters)
    code = (place[gram >> 42] * n + place[(gram >> 21) & lo]) * n + place[gram & lo]
    used = np.flatnonzero(np.bincount(code, minlength=n ** 3))
    back = np.zeros(n ** 3, dtype=np.int64)
    back[used] = np.arange(len(used))
    a, rest = np.divmod(used, n * n)
    b, c = np.divmod(rest, n)
    return (letters[a] << 42) | (letters[b] << 21) | letters[c], back[code]


def text_vectors(texts: list[str], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, has): the bundled vector of each text, and whether it has a letter."""
    owner, gram, has = trigrams(texts)
    out = np.zeros((len(texts), letters.dim), dtype=np.float32)
    if not len(gram):
        return out, has
    distinct, number = _numbered(gram)
    table = letters.bound(distinct).astype(np.float32)
    u = len(distinct)
    if len(texts) * u <= 8 * len(gram):         # long texts: counts times vectors, rows of counts bounded
        step = max(1, ENTRIES // u)
        for at in range(0, len(texts), step):
            to = min(len(texts), at + step)
            lo, hi = np.searchsorted(owner, [at, to])
            counts = np.bincount((owner[lo:hi] - at) * u + number[lo:hi], minlength=(to - at) * u)
            out[at:to] = counts.reshape(to - at, u).astype(np.float32) @ table
    else:                                       # short texts: their trigrams' vectors added up
        step = max(1, ENTRIES // letters.dim)
        for at in range(0, len(gram), step):
            own = owner[at:at + step]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[starts]] += np.add.reduceat(table[number[at:at + step]], starts, axis=0)
    return out, has


def _counts(batches, text: str):
    """(lang, gram, n) of batches (lang, text), added up per slice."""
    for batch in batches:
        for part in slices(batch, text):
            lang = part.column(0).to_numpy(zero_copy_only=False)
            texts = text_column(part, text).to_pylist()
            names, code = np.unique(lang.astype(str), return_inverse=True)
            owner, gram, has = trigrams(texts)
            known = has[owner]
            owner, gram = owner[known], gram[known]
            if not len(gram):
                continue
            distinct, number = _numbered(gram)
            n = np.bincount(code[owner] * len(distinct) + number, minlength=len(names) * len(distinct))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at // len(distinct)].astype(object), pa.string()), pa.array(distinct[at % len(distinct)]),
                 pa.array(n[at])], ["lang", "gram", "n"])


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2,
        max_languages: int = 8192) -> Profiles:
    """Prototypes of the languages of all texts outside the held-out part."""
    own = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
                      is_held(doc_id, folds, held).alias("held"))
    train = own.filter("lang is not null and text is not null and not held").select("lang", "text")
    counted = written(train.mapInArrow(lambda b: _counts(b, "text"), "lang string, gram long, n long")
                      .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    languages = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").limit(max_languages + 1).collect()]
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    place = {name: i for i, name in enumerate(languages)}

    def bundle(batches):
        letters = Letters()
        sums: dict = {}
        for batch in batches:
            names, gram, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at in range(0, len(gram), 4096):
                v = letters.bound(gram[at:at + 4096]).astype(np.float64) * np.sqrt(n[at:at + 4096])[:, None]
                code = np.array([place[x] for x in names[at:at + 4096]])
                for i in np.unique(code):
                    sums[i] = sums.get(i, 0.0) + v[code == i].sum(axis=0)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k] for k in keys], pa.list_(pa.float64()))],
                                         ["k", "v"])

    made = (counted.mapInArrow(bundle, "k int, v array<double>").select("k", F.posexplode("v").alias("pos", "v"))
            .groupBy("k", "pos").agg(F.sum("v").alias("v")).groupBy("k")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v")).collect())
    table = np.zeros((len(languages), DIM), dtype=np.float64)
    for r in made:
        v = np.array(r["v"])
        table[r["k"]] = v / max(float(np.linalg.norm(v)), 1e-300)
    return Profiles(languages, table.astype(np.float32))


def is_held(doc_id: str, folds: int, held: int):
    """True for ids whose crc32 (of the decimal text) has the remainder ``held``; null id: False."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == held, F.lit(False))


def predicted(docs: DataFrame, profiles: Profiles, *, doc_id: str = "doc_id", text: str = "text", folds: int = 4,
              held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row."""
    sent, key = docs.sparkSession.sparkContext.broadcast(profiles), uuid.uuid4().hex
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        from driftrank.llm import language_id, worker_cache
        letters = worker_cache.once(key, language_id.Letters)
        known = sent.value
        names = np.array([*known.languages, language_id.UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, "text"):
                vectors, has = language_id.text_vectors(text_column(part, "text").to_pylist(), letters)
                best, top = np.full(len(has), len(names) - 1), np.zeros(len(has))
                if len(known.languages):
                    cosine = (vectors @ known.prototypes.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-30)[:, None]
                    best = np.where(has, cosine.argmax(axis=1), best)
                    top = np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(top.astype(np.float64))],
                                                 ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", is_held("doc_id", folds, held).alias("held_out"), "lang_pred", "score")
