import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftrank.llm.packing import pack, sum_of_squares
from driftrank.llm.tables import vocabulary
from driftrank.llm.word_ids import WordIds, mergeable

FILE = vocabulary("word_bpe_49k.json")
HARD = ["", "a\x1cb !\x1c!", "<|endoftext|>hi <|startoftext|>", "ΑΣ ΣΑΣ", "é é ﬁ İstanbul ıI", "don't can'T 'S we'll 'Re x's",
        "日本語 テスト 12 345 ½ ²", "a b\u0085c ​ z", "''s!!'ll..", "💩👍🏽 x💩y", "ß ẞ ǅ ŉ", "ÿ þÿ ÿ!", "x" * 5000]


@pytest.mark.parametrize("by_rank", [True, False])
def test_ids_equal_the_library(by_rank):
    with open(FILE, encoding="utf-8") as f:
        table = WordIds(f.read(), by_rank)
    rng = random.Random(4)
    texts = HARD + ["".join(rng.choice("abcdeéß '.,!12 \nABÇ") for _ in range(200)) for _ in range(100)]
    for t in texts:
        assert np.frombuffer(table.encode(t), "<u4").tolist() == table.tokenizer.encode(t, add_special_tokens=False).ids


def test_rank_merging_is_checked():
    with open(FILE, encoding="utf-8") as f:
        content = f.read()
    assert mergeable(content)
    broken = json.loads(content)
    broken["model"]["merges"] = broken["model"]["merges"][::-1]
    assert not mergeable(json.dumps(broken))


def test_pieces_and_sequences(spark):
    rows = [(i, t, 1) for i, t in enumerate(HARD)] + [(99, None, 2), (0, "", 3), (0, "", 3), (50, "w " * 9001, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = pack(df, FILE, capacity=512, with_ids=True, group_rows=7).collect()
    tok = Tokenizer.from_file(FILE)
    expected = []
    for i, t, _ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        expected += [(i, k, a, len(ids[a:a + 512]), zlib.crc32(ids[a:a + 512].tobytes()))
                     for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in got)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, FILE).count() == 0


def test_every_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    capacity = 40
    sizes = rng.integers(1, capacity + 1, 300)
    where, offset = sum_of_squares(sizes, capacity)
    level = {}

    def cost(levels):
        gaps = [capacity - x for x in levels.values() if x < capacity]
        return sum(gaps.count(g) ** 2 for g in set(gaps))
    for s, w, o in zip(sizes.tolist(), where.tolist(), offset.tolist()):
        options = [k for k, x in level.items() if x + s <= capacity] + [max(level, default=-1) + 1]
        best = min(cost({**level, k: level.get(k, 0) + s}) for k in options)
        assert o == level.get(w, 0)
        level[w] = o + s
        assert level[w] <= capacity and cost(level) == best


def test_close_to_the_lower_bound(spark):
    from driftrank.llm.queries import QUERIES
    rows = QUERIES["op5_packing"](spark, "/root/testdata/sf0.01").collect()
    bound = -(-sum(r["length"] for r in rows) // 4096)
    assert len({r["sequence_id"] for r in rows}) <= bound * 1.02
