"""Token ids of whole texts through a table of the white-space chunks seen so far.

The tokenizer file drops white space and never merges across it, so the ids
of a text are those of its chunks in order.  Most chunks recur: each is
encoded once per worker and kept in a bounded table.  Chunks of plain Latin
characters are split by the file's own pattern and merged from the file's
ranks; any other chunk, and any text with control separators or special
tokens, goes through the library's full ``encode``.

Merging by the rank of the joined bytes equals merging listed pairs if no
two pairs join to the same token and every token's own bytes merge to that
token through its listed pair.  ``mergeable`` checks both once, on the
driver; a file that fails is merged by the library's model instead.
"""

from __future__ import annotations

import json

import numpy as np

CHUNKS = 300_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the file's split pattern
PLAIN_BELOW = "ɐ"  # Latin letters that are NFC already and lower-case one by one
WORD_END = b"\xff"      # a byte that UTF-8 never has


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def _ranks(model: dict) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], list[int]]:
    """(bytes -> rank, pair per merge, id per rank); a word end is one byte more."""
    back = {c: b for b, c in _byte_letters().items()}
    end = model["end_of_word_suffix"]

    def raw(s: str) -> bytes:
        last = s.endswith(end)
        return bytes(back.get(c, ord(c)) for c in (s[:-len(end)] if last else s)) + WORD_END * last

    ranks = {bytes([b]): b for b in range(256)}
    for b in range(255):
        ranks[bytes([b]) + WORD_END] = len(ranks)
    pairs = []
    for m in model["merges"]:
        x, y = m if isinstance(m, list) else m.split(" ")
        pairs.append((raw(x), raw(y)))
        ranks.setdefault(pairs[-1][0] + pairs[-1][1], len(ranks))
    ids = [0] * len(ranks)
    for s, i in model["vocab"].items():
        r = ranks.get(raw(s))
        if r is not None:
            ids[r] = i
    return ranks, pairs, ids


def mergeable(tokenizer_json: str) -> bool:
    """Whether ranks of joined bytes give the file's merges (see the module text)."""
    model = json.loads(tokenizer_json)["model"]
    if model["end_of_word_suffix"] != "</w>" or model.get("ignore_merges") or model.get("dropout"):
        return False
    ranks, pairs, _ = _ranks(model)
    if len(ranks) != 511 + len(pairs):
        return False
    for x, y in pairs:
        own = ranks[x + y]
        parts = [bytes([b]) for b in x + y]
        while len(parts) > 2:
            r, i = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if r >= own:
                return False
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if tuple(parts) != (x, y):
            return False
    return True


class _Merged(dict):
    """Piece -> ids by the ranks of joined bytes."""

    def __init__(self, model: dict):
        super().__init__()
        import tiktoken
        ranks, _, ids = _ranks(model)
        self.encode = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks,
                                        special_tokens={})._core_bpe.encode_single_piece
        self.ids = [np.uint32(i).astype("<u4").tobytes() for i in ids]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CHUNKS:
            self.clear()
        ids = self.ids
        out = self[piece] = b"".join([ids[r] for r in self.encode(piece.encode() + WORD_END)])
        return out


class _Modelled(dict):
    """Piece -> ids by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CHUNKS:
            self.clear()
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        out = self[piece] = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        return out


class WordIds(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str, by_rank: bool):
        super().__init__()
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPLIT).findall
        self.pieces = _Merged(json.loads(tokenizer_json)["model"]) if by_rank else _Modelled(self.tokenizer.model)

    def full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CHUNKS:
            self.clear()
        if max(chunk) < PLAIN_BELOW:
            low, pieces = chunk.lower(), self.pieces
            ids = pieces[low] if low.isalpha() else b"".join([pieces[p] for p in self.split(low)])
        else:
            ids = self.full(chunk)
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of ``text``."""
        if any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.full(text)
        get = self.__getitem__
        return b"".join([get(c) for c in text.split()])
