import hashlib
import random

import pytest

from driftrank.llm.decontaminate import clean, decontaminate

from . import helpers


def tables(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)] + ["été", "日本", "x9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((25, 12, 10, 7, 3, 1))]
    items += [(6, None), (7, " .,! "), (3, "second text of item three"), (8, items[1][1].upper() + "!")]
    docs = []
    for i in range(40):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 200]))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            piece = rng.choice(items)[1] or ""
            w[at:at] = helpers.bench_words(piece)[:rng.choice([9, 10, 11, 25])]
        docs.append((i, rng.choice([" ", ", ", "\n-"]).join(w).capitalize(), "x"))
    docs += [(40, None, "x"), (41, "", "x"), (5, docs[5][1], "x")]
    return (docs, items, spark.createDataFrame(docs, "doc_id long, text string, found string"),
            spark.createDataFrame(items, "item_id long, text string"))


def brute(text, items):
    w = helpers.bench_words(text)
    hit, found = set(), set()
    for item, t in items:
        for win in helpers.windows(t):
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, max_bytes):
    docs, items, df, bench = tables(spark)
    rows = decontaminate(df, bench, max_bytes=max_bytes).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, n_hit, ids = brute(r["text"], items)
        f = r[3]
        assert (f["n_words"], f["n_hit"], f["items"]) == (n, n_hit, ids)
        inside = sum(len(helpers.bench_words(r["text"][x["start"]:x["end"]])) for x in f["runs"])
        assert inside == n_hit


def test_clean_keeps_rows_and_columns(spark):
    docs, items, df, bench = tables(spark)
    got = clean(df, bench)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, t, _ in docs if not brute(t, items)[1])


def test_empty_tables(spark):
    _, _, df, bench = tables(spark)
    assert decontaminate(df.limit(0), bench).count() == 0
    assert clean(df, bench.limit(0)).count() == df.count()


def test_query_digest(spark):
    from driftrank.llm.queries import QUERIES
    rows = QUERIES["op9_decontaminate"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)
    none = hashlib.sha256(b"").hexdigest()
    assert all((r["items_sha256"] == none) == (r["n_items"] == 0) for r in rows)


def test_nodes_stay_under_a_seventh_of_those_of_all_windows():
    import ahocorasick
    from driftrank.llm.decontaminate import Passages
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    words = [rng.choice(vocabulary) for _ in range(20_000)]
    items = [(str(i), " ".join(words[i:i + 50]).encode()) for i in range(0, 20_000, 50)]
    whole = ahocorasick.Automaton()
    for _, t in items:
        w = t.decode().split()
        for i in range(len(w) - 9):
            whole.add_word(" " + " ".join(w[i:i + 10]) + " ", 1)
    small = Passages(items, 10)
    assert small.automaton.get_stats()["nodes_count"] * 7 < whole.get_stats()["nodes_count"]
    text = " ".join(["zz"] * 30_000 + words[5:45] + ["zz"] * 30_000 + words[103:112] + words[993:1007])
    n, found, spans = small.scan(text.encode())
    assert n == 60_063 and found == {"0"}     # nine words, or seven each of two items, are no window
    assert {k for a, b in spans for k in range(a, b + 1)} == set(range(30_000, 30_040))


@pytest.mark.parametrize("window", [1, 2, 3, 7, 10])
def test_windows_of_any_length_are_found(window):
    from driftrank.llm.decontaminate import Passages
    rng = random.Random(window)
    word = lambda: rng.choice("abc")
    for _ in range(200):
        items = [(str(i), " ".join(word() for _ in range(rng.randint(0, 14))).encode()) for i in range(3)]
        text = [word() for _ in range(rng.randint(0, 30))]
        hit, owners = set(), set()
        for item, t in items:
            w = t.decode().split()
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                for j in range(len(text) - size + 1):
                    if text[j:j + size] == w[i:i + size]:
                        hit |= set(range(j, j + size))
                        owners.add(item)
        n, found, spans = Passages(items, window).scan(" ".join(text).encode())
        assert (n, found) == (len(text), owners) and {k for a, b in spans for k in range(a, b + 1)} == hit
