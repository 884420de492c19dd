"""Secret scans (6): pattern candidates, false positives removed by a random forest.

Candidates come from wide patterns: values assigned to names that hold a
credential name (``DB_PASSWORD``, ``client_secret``, ``secret_key``), known
key shapes, private key blocks, and long runs of key characters with a digit.  The forest scores each by its length, character mix and transitions
(bigram log-probability under ordinary text), the share that dictionary
words cover, the path of the text and the neighbouring words.

It is trained on labelled findings (path, text, start, end, label).  Without
given ones they are made by rule from a fixed seed: credentials of common
shapes, and harmless look-alikes such as placeholders, checksums, card and
phone numbers, ids, versions and long words, set into sentences.  Dictionary
and transitions are counted over all texts: tasks give partial counts of
words and byte pairs, Spark adds them up, and the model keeps all pairs
(65,536 at most) and the most frequent words, 20,000 of them.

The scan itself reads every text whole and needs no shuffle; only texts with
a digit, a credential name or the start of a known key are matched.

Cases: null and empty texts have no findings and stay as they are; a null
path counts as empty; overlapping candidates: the one that starts first,
then the longer, then the more specific; repeated rows give their findings once per row; an
empty table gives no rows (training then has an empty dictionary); extra
columns stay untouched in ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import slices, text_column, utf8
from .forest import Forest, grow
from .tables import written

THRESHOLD = 0.5
COUNT_ROWS = 1 << 18

# fixed values: names and shapes of credentials
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "auth_key",
         "private_key", "credential")
BENIGN = ("example", "sample", "placeholder", "dummy", "test", "commit", "sha", "checksum", "md5", "hash", "uuid", "guid",
          "isbn", "card", "phone", "version", "id", "order", "invoice", "serial")
TEST_PATHS = ("test", "example", "sample", "fixture", "mock", "docs")
SHAPES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("assigned", r"[^\s\"',;<>]{6,}"),
    ("long", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])"),
)
CANDIDATE = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SHAPES if k not in ("assigned", "long")))
LONG, VALUE = re.compile(dict(SHAPES)["long"]), re.compile(dict(SHAPES)["assigned"])
# a whole name and its sign; the name is taken once, so that long runs cost no second look
ASSIGNED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)[\"']?\s{0,3}(?:=>?|:)\s{0,3}[\"']?")
NAMED = re.compile("(?i:" + "|".join(NAMES) + ")")
KINDS = [k for k, _ in SHAPES]
_CUES = [n.encode() for n in NAMES] + [b"-----begin"]
_STARTS = [b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xox", b"AIza", b"_live_", b"_test_", b"eyJ"]
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Finding:
    start: int
    end: int
    kind: str


def _assigned(text: str) -> list[Finding]:
    """Values of names that hold a credential name."""
    out, last = [], 0
    for m in ASSIGNED.finditer(text):
        if m.start() >= last and NAMED.search(m.group(1)):
            value = VALUE.match(text, m.end())
            if value:
                last = value.end()
                out.append(Finding(m.end(), last, "assigned"))
    return out


def candidates(text: str) -> list[Finding]:
    every = _assigned(text)
    every += [Finding(m.start(), m.end(), m.lastgroup) for m in CANDIDATE.finditer(text)]
    every += [Finding(m.start(), m.end(), "long") for m in LONG.finditer(text)]
    out, last = [], 0
    for f in sorted(every, key=lambda f: (f.start, -f.end, KINDS.index(f.kind))):
        if f.start >= last:
            out.append(f)
            last = f.end
    return out


@dataclass
class Language:
    """What ordinary text looks like: its words, and log-probabilities of character bigrams."""
    words: frozenset
    bigram: np.ndarray

    def transitions(self, value: str) -> float:
        b = np.frombuffer(value.lower().encode(), np.uint8)
        return float(self.bigram[b[:-1], b[1:]].mean()) if len(b) > 1 else 0.0

    def coverage(self, value: str) -> float:
        low = value.lower()
        return sum(len(w) for w in _WORD.findall(low) if w in self.words) / max(1, len(low))


def learn_language(docs: DataFrame, text: str = "text", words: int = 20_000) -> Language:
    """The most frequent words (of equal ones the first by name) and the byte pairs of all texts."""
    def count(batches):
        held, pairs = Counter(), np.zeros(1 << 16, dtype=np.int64)

        def partial(found, at=()):
            return pa.RecordBatch.from_arrays(
                [pa.array([*found, *[None] * len(at)], type=pa.string()),
                 pa.array([*[-1] * len(found), *at], type=pa.int32()),
                 pa.array([*found.values(), *[int(pairs[k]) for k in at]], type=pa.int64())], ["word", "pair", "n"])

        for batch in batches:
            for part in slices(batch, text):
                lows = [t.lower() for t in text_column(part, text).to_pylist()]
                for low in lows:
                    held.update([w for w in _WORD.findall(low) if len(w) > 2])
                off, raw = utf8(pa.array(lows, type=pa.string()))
                inside = np.ones(len(raw), dtype=bool)
                inside[off[1:][off[1:] > 0] - 1] = False            # no pair runs into the next text
                for lo in range(0, len(raw) - 1, 1 << 20):
                    b = raw[lo:lo + (1 << 20) + 1].astype(np.int64)
                    pairs += np.bincount((b[:-1] * 256 + b[1:])[inside[lo:lo + len(b) - 1]], minlength=1 << 16)
                if len(held) >= COUNT_ROWS:
                    yield partial(held)
                    held = Counter()
        yield partial(held, np.flatnonzero(pairs).tolist())

    counts = written(docs.select(text).mapInArrow(count, "word string, pair int, n long")
                     .groupBy("word", "pair").agg(F.sum("n").alias("n")), "language")
    top = counts.filter("pair < 0").orderBy(F.desc("n"), "word").limit(words).toArrow()
    found = counts.filter("pair >= 0").select("pair", "n").toArrow()
    pairs = np.ones(1 << 16)
    pairs[found["pair"].to_numpy()] += found["n"].to_numpy()
    pairs = pairs.reshape(256, 256)
    return Language(frozenset(top["word"].to_pylist()),
                    np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32))


def features(path: str, text: str, f: Finding, language: Language) -> list[float]:
    """The forest's inputs for one candidate."""
    v = text[f.start:f.end]
    n = max(1, len(v))
    before, after = text[max(0, f.start - 60):f.start].lower(), text[f.end:f.end + 40].lower()
    near = _WORD.findall(before)[-4:]
    around = near + _WORD.findall(after)[:3]
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in v]
    share = np.bincount(kinds, minlength=4) / n if v else np.zeros(4)
    p = np.array(list(Counter(v).values()), dtype=float) / n
    names = [x for name in NAMES for x in re.split("[_-]", name)]
    low = path.lower()
    return [len(v), *share, float(-(p * np.log2(p)).sum()) if v else 0.0, len(set(v)) / n,
            sum(a != b for a, b in zip(kinds, kinds[1:])) / n, language.transitions(v), language.coverage(v),
            float(all(c in "0123456789abcdefABCDEF" for c in v)), KINDS.index(f.kind),
            sum(w in names for w in near), sum(w in BENIGN for w in around), float(before.rstrip(" \"'")[-1:] in ("=", ":")),
            sum(x in low for x in TEST_PATHS), low.count("/")]


def made_findings(language: Language, per_kind: int = 60, seed: int = 5) -> list[tuple[str, str, int, int, int]]:
    """Labelled findings by rule: (path, text, start, end, label)."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array(sorted(language.words) or ["the", "value", "of", "this"], dtype=object)

    def pick(chars: str, n: int) -> str:
        return "".join(rng.choice(list(chars), n))

    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexa, word = digits + "abcdef", digits + lower + upper

    def some(n: int) -> str:
        return " ".join(rng.choice(vocabulary, n))

    def named() -> str:
        name = str(rng.choice(["db_password", "aws_secret_access_key", "client_secret", "secret_key", "app.auth_token",
                               "smtp-passwd", "api_key_live", "redis_pwd", "token_2"]))
        return name.upper() if rng.random() < 0.5 else name

    real = [
        lambda: ("", "AKIA" + pick(digits + upper, 16)),
        lambda: ("token = \"", pick(hexa, 40)),
        lambda: ("password=", pick(hexa, int(rng.integers(12, 25)))),
        lambda: ("password: ", pick(word + "!#%_", int(rng.integers(8, 20))) + pick(digits, 2)),
        lambda: ("secret = '", pick(word + "+/", int(rng.integers(24, 48)))),
        lambda: ("api_key=", pick(word, int(rng.integers(20, 44)))),
        lambda: ("", "gh" + pick("pousr", 1) + "_" + pick(word, 36)),
        lambda: ("", "xoxb-" + pick(digits, 12) + "-" + pick(word, 24)),
        lambda: ("", "AIza" + pick(word + "_-", 35)),
        lambda: ("", "sk_live_" + pick(word, 24)),
        lambda: ("", f"eyJ{pick(word, 20)}.{pick(word, 40)}.{pick(word + '_-', 43)}"),
        lambda: ("", f"-----BEGIN PRIVATE KEY-----\n{pick(word + '+/', 64)}\n-----END PRIVATE KEY-----"),
        lambda: ("access_key ", pick(word + "+/", 40)),
        lambda: (named() + rng.choice(["=", ": ", " = "]), pick(word, int(rng.integers(10, 25)))),
        lambda: (named() + "=", pick(word + "+/", int(rng.integers(32, 48)))),
        lambda: ("SIGNING_" + pick(upper, 3) + "=", pick(word, int(rng.integers(20, 44)))),
        lambda: ("", str(rng.choice(["AKIA", "ASIA"])) + pick(upper, 16)),
        lambda: ("", "gh" + pick("pousr", 1) + "_" + pick(lower + upper, 36)),
    ]
    benign = [
        lambda: ("password=", rng.choice(["changeme", "password", "your_password", "xxxxxxxx", "********", "${PASSWORD}",
                                          "<password>", "example123"])),
        lambda: ("token: ", "your_" + str(rng.choice(["token", "api_key", "secret"])) + "_here"),
        lambda: ("token = ", "_".join(rng.choice(vocabulary, 2))),
        lambda: ("the secret: ", str(rng.choice(vocabulary)) + str(rng.choice(vocabulary))),
        lambda: ("", pick("4", 1) + pick(digits, 15)),
        lambda: ("card ", pick(digits, 16)),
        lambda: ("commit ", pick(hexa, 40)),
        lambda: ("checksum md5 ", pick(hexa, 32)),
        lambda: ("sha ", pick(hexa, 64)),
        lambda: ("", "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12))),
        lambda: ("invoice ", "INV-" + "-".join(pick(digits, n) for n in (4, 2, 2, 6))),
        lambda: ("", "/".join(rng.choice(vocabulary, 4)) + "/" + pick(digits, 4)),
        lambda: ("", "-".join(rng.choice(vocabulary, 4)) + "-" + pick(digits, 3)),
        lambda: ("", "_".join(rng.choice(vocabulary, 3)) + pick(digits, 2)),
        lambda: ("phone ", "-".join(pick(digits, n) for n in (3, 4, 4, 6))),
        lambda: ("version ", "-".join(pick(digits, 4) for _ in range(5))),
        lambda: ("", pick(digits, int(rng.integers(17, 24)))),
        lambda: (named() + "=", str(rng.choice(["changeme", "password", "your_password", "xxxxxxxx", "********", "${SECRET}",
                                                "<password>", "example123", "REDACTED"]))),
        lambda: (str(rng.choice(["tokenizer", "secretary", "max_tokens", "password_hint"])) + rng.choice(["=", ": "]),
                 str(rng.choice(vocabulary)) + str(rng.choice(["_", "-", ""])) + str(rng.choice(vocabulary))),
        lambda: (str(rng.choice(["md5", "sha", "commit", "checksum"])) + "=", pick(hexa, int(rng.choice([32, 40, 64])))),
        lambda: (str(rng.choice(["id", "uuid", "order"])) + "=", "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12))),
        lambda: (str(rng.choice(["path", "ref", "name"])) + "=", "/".join(rng.choice(vocabulary, 4)) + "/" + pick(digits, 4)),
    ]
    out = []
    for label, rules in ((1, real), (0, benign)):
        for rule in rules:
            for _ in range(per_kind):
                cue, value = rule()
                head = some(int(rng.integers(2, 9))) + str(rng.choice([" ", ".\n", ", "])) + cue
                text = head + str(value) + ("" if not cue or cue[-1] not in "\"'" else cue[-1]) + " " + some(5)
                path = str(rng.choice(["", "src0", "data/readme.md", "conf/app.ini", "tests/fixture.py"]))
                out.append((path, text, len(head), len(head) + len(str(value)), label))
    return out


@dataclass
class Scanner:
    forest: Forest
    language: Language
    threshold: float

    def scores(self, path: str, text: str, found: list[Finding]) -> np.ndarray:
        return self.forest.predict(np.array([features(path, text, f, self.language) for f in found]))


def fit(docs: DataFrame, *, text: str = "text", findings: list | None = None,
        threshold: float = THRESHOLD) -> Scanner:
    """Dictionary and transitions of all texts, the forest from labelled findings."""
    language = learn_language(docs, text)
    labelled = made_findings(language) if findings is None else findings
    x, y = [], []
    for path, t, start, end, label in labelled:
        kind = next((c.kind for c in candidates(t) if c.start < end and start < c.end), "long")
        x.append(features(path, t, Finding(start, end, kind), language))
        y.append(label)
    return Scanner(grow(np.array(x, dtype=float), np.array(y)), language, threshold)


def _worth(part: pa.RecordBatch, name: str) -> np.ndarray:
    """Rows with a digit, a credential name or the start of a known key."""
    off, raw = utf8(text_column(part, name))
    has = np.zeros(len(off) - 1, dtype=bool)
    at = np.flatnonzero((raw >= 48) & (raw <= 57))
    has[np.searchsorted(off, at, side="right") - 1] = True
    plain = raw.tobytes()
    low = plain.lower()
    for held, cue in [(low, c) for c in _CUES] + [(plain, c) for c in _STARTS]:
        k = held.find(cue)
        while k >= 0:
            row = int(np.searchsorted(off, k, side="right")) - 1
            has[row] = True
            k = held.find(cue, int(off[row + 1]))
    return has


def _each(scanner: Scanner, docs: DataFrame, text: str, path: str | None, emit, schema) -> DataFrame:
    sent, key = docs.sparkSession.sparkContext.broadcast(scanner), uuid.uuid4().hex

    def run(batches):
        from driftrank.llm import worker_cache
        model = worker_cache.once(key, lambda: sent.value)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text))
                paths = part.column(part.schema.get_field_index(path)) if path else None
                found = {}
                for i in np.flatnonzero(_worth(part, text)).tolist():
                    t = texts[i].as_py()
                    some = candidates(t)
                    if some:
                        where = str(paths[i].as_py() or "") if path else ""
                        found[i] = (t, some, model.scores(where, t, some))
                yield emit(part, found, model.threshold)

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, scanner: Scanner, *, doc_id: str = "doc_id", text: str = "text",
         path: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, start, length, kind, score, is_secret, value_sha256."""
    def emit(part, found, threshold):
        rows, start, length, kind, score, digest = [], [], [], [], [], []
        for i, (t, some, scores) in found.items():
            for f, s in zip(some, scores):
                rows.append(i)
                start.append(f.start)
                length.append(f.end - f.start)
                kind.append(f.kind)
                score.append(float(s))
                digest.append(hashlib.sha256(t[f.start:f.end].encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(rows, type=pa.int64())), pa.array(start, type=pa.int64()),
             pa.array(length, type=pa.int64()), pa.array(kind, type=pa.string()), pa.array(score, type=pa.float64()),
             pa.array([s >= threshold for s in score], type=pa.bool_()), pa.array(digest, type=pa.string())],
            ["doc_id", "start", "length", "kind", "score", "is_secret", "value_sha256"])

    columns = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    if path:
        columns.append(F.col(path).cast("string").alias("path"))
    return _each(scanner, docs.select(*columns), "text", "path" if path else None, emit,
                 f"doc_id {docs.schema[doc_id].dataType.simpleString()}, start long, length long, kind string, "
                 "score double, is_secret boolean, value_sha256 string")


def redacted(docs: DataFrame, scanner: Scanner, *, text: str = "text", path: str | None = "source",
             n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``[secret]``; the length column follows the new text."""
    size = docs.schema.fieldNames().index(n_chars) if n_chars in docs.columns else None

    def emit(part, found, threshold):
        at = part.schema.get_field_index(text)
        changed = {}
        for i, (t, some, scores) in found.items():
            out, last = [], 0
            for f, s in zip(some, scores):
                if s >= threshold:
                    out += [t[last:f.start], "[secret]"]
                    last = f.end
            if out:
                changed[i] = "".join(out) + t[last:]
        if not changed:
            return part
        values, columns = part.column(at).to_pylist(), list(part.columns)
        for i, t in changed.items():
            values[i] = t
        columns[at] = pa.array(values, type=part.column(at).type)
        if size is not None:
            sizes = part.column(size).to_pylist()
            for i, t in changed.items():
                sizes[i] = len(t)
            columns[size] = pa.array(sizes, type=part.column(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return _each(scanner, docs, text, path if path in docs.columns else None, emit, docs.schema)
