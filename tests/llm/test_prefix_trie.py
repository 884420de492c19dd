import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftrank.llm.prefix_trie import _splice, list_ranks, ordered_turns, prefix_trie, with_shared_start

from .helpers import words

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Per node: the report's row, by walking a dictionary of prefixes."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 * (1 if c >= 0 else -1))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        kids = {k: [x for x in nodes if len(x) == len(k) + 1 and x[:len(k)] == k] for k in below}
        ends = sorted(c for c in members if len(built[c]) == len(key))
        out[(min(members), len(key))] = (
            min(nodes[key[:-1]]) if key else None, len(members), len(kids[key]), sum(not kids[k] for k in below),
            sum((len(nodes[k]) - 1) * len(words(k[-1][1])) for k in below if k),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def trie(spark, rows, bound=1 << 19):
    table = spark.createDataFrame(rows, SCHEMA)
    ids = table.select("conv_id").filter("conv_id is not null").distinct()
    got = prefix_trie(with_shared_start(ordered_turns(table)), ids, bound).collect()
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}, len(got)


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 200), n):
        turns = rng.randrange(1, 7)
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "", None, "b  c"])) for t in range(turns)]
    return rows


def test_equals_brute_force_with_nulls_and_repeats(spark):
    rows = made(1, 60) + [(None, 1, "user", "x"), (7, None, "user", "first"), (7, 3, "user", "again"), (7, 3, "user", "again"),
                          (500, 0, "user", "long " * 60_000), (501, 0, "user", "long " * 60_000)]
    got, n = trie(spark, rows)
    want = brute(rows)
    assert n == len(want) and got == want


def test_one_conversation_with_most_turns_and_a_short_list_bound(spark):
    rows = [(3, t, "user", f"w{t % 7} x") for t in range(300)] + [(c, 0, "user", "hello") for c in range(300, 360)]
    rows += [r for r in made(2, 40) if r[0] != 3]
    got, n = trie(spark, rows, bound=64)
    want = brute(rows)
    assert n == len(want) and got == want


def test_empty_table_has_no_nodes(spark):
    assert trie(spark, [])[1] == 0


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_list_ranks_of_a_shuffled_list(spark, n):
    ids = list(range(0, 3 * n, 3))
    random.Random(n).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, [*ids[1:], None])), "arc long, next long")
    got = {r["arc"]: r["rank"] for r in list_ranks(links, 50).collect()}
    assert got == {a: i for i, a in enumerate(ids)}


def test_splice_keeps_the_list(spark):
    n = 400
    rows = [(i, i + 1 if i + 1 < n else -1, 1) for i in range(n)]
    level = _splice(spark.createDataFrame(rows, "arc long, next long, w long"), 5).collect()
    kept = {r["arc"]: (r["next"], r["w"]) for r in level if r["arc"] == r["head"]}
    assert n / 2 < len(kept) < 0.9 * n and len(level) == n
    at, place, ranks = 0, 0, {}
    while at != -1:
        ranks[at] = place
        place += kept[at][1]
        at = kept[at][0]
    assert place == n and all(ranks[r["head"]] + r["off"] == r["arc"] for r in level)
