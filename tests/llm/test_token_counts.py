import random

import numpy as np
import public_tokenizers
import pytest

from driftrank.llm import token_counts as M
from driftrank.llm.tables import vocabulary

RANKS = vocabulary("byte_bpe_50k.tiktoken")


def counts(df, **kw):
    return M.token_counts(df, RANKS, public_tokenizers.PATTERN, **kw)


def brute(lengths, start, end, rule):
    """Each token against each section."""
    at, count, crossing, outside = 0, [0.0] * len(start), [0] * len(start), 0.0
    for n in lengths:
        parts = [max(0, min(e, at + n) - max(s, at)) for s, e in zip(start, end)]
        touched = [i for i, p in enumerate(parts) if p]
        free = n - sum(parts)
        if not touched:
            outside += 1
        elif len(touched) == 1 and not free:
            count[touched[0]] += 1
        else:
            for i in touched:
                crossing[i] += 1
            if rule == "split":
                for i in touched:
                    count[i] += parts[i] / n
                outside += free / n
            elif rule == "start" and start[touched[0]] <= at:
                count[touched[0]] += 1
            elif rule == "majority" and max(parts) >= free:
                count[parts.index(max(parts))] += 1
            else:
                outside += 1
        at += n
    return count, crossing, outside


@pytest.mark.parametrize("rule", M.RULES)
def test_attribution_equals_brute_force(rule):
    rng = random.Random(1)
    for _ in range(400):
        lengths = np.array([rng.randint(1, 6) for _ in range(rng.randint(0, 12))], dtype=np.int64)
        cuts = sorted(rng.randint(0, int(lengths.sum())) for _ in range(2 * rng.randint(0, 5)))
        start, end = np.array(cuts[::2], np.int64), np.array(cuts[1::2], np.int64)
        count, crossing, outside = M.attribute(lengths, start, end, rule)
        want = brute(lengths.tolist(), start.tolist(), end.tolist(), rule)
        assert np.allclose(count, want[0]) and crossing.tolist() == want[1] and outside == pytest.approx(want[2])


def test_lines_add_up_to_the_whole_text(spark):
    texts = ["one line", "a\n\n\nb  c\n", "\n", "", None, "é日本\nx y z\n💩 💩", "word " * 3000 + "\n" + "x" * 4000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(1, texts[1], 0)], "doc_id long, text string, section int")
    with open(RANKS, "rb") as f:
        encode = M.Encoder(f.read(), public_tokenizers.PATTERN).encode
    rows = counts(df).collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r["doc_id"] == i]
        times = 2 if i == 1 else 1
        assert sum(r["n_tokens"] for r in own) == times * len(encode(t or ""))
        assert len(own) == times * max(1, len((t or "").split("\n")) - (t or "").endswith("\n"))
        assert max(r["end"] for r in own) == len((t or "").encode())


def test_given_sections(spark):
    text = "héllo wörld again"
    sections = [(6, 11), (0, 6), (8, 40), (30, 20), None]
    df = spark.createDataFrame([(1, text, sections), (2, text, None), (3, None, [(0, 5)])],
                               "doc_id long, text string, s array<struct<start:int,end:int>>")
    rows = counts(df, sections="s", rule="split").collect()
    got = {r["section"]: (text.encode()[r["start"]:r["end"]].decode(), r["n_tokens"]) for r in rows if r["doc_id"] == 1}
    assert got[1][0] == "héllo " and got[0][0] == "wörld" and got[2][0] == " again" and got[3][0] == ""
    with open(RANKS, "rb") as f:
        n = len(M.Encoder(f.read(), public_tokenizers.PATTERN).encode(text))
    assert sum(x for _, x in got.values()) == pytest.approx(n)
    assert [(r["section"], r["n_tokens"]) for r in rows if r["doc_id"] == 2] == [(-1, n)]
    assert [(r["section"], r["n_tokens"]) for r in rows if r["doc_id"] == 3] == [(0, 0)]


def test_empty_table_and_unknown_rule(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert counts(df).count() == 0
    with pytest.raises(ValueError):
        counts(df, rule="most")
