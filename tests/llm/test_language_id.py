import numpy as np
import pytest

from driftrank.llm import language_id as L

SF = "/root/testdata/sf0.01"


def slow_grams(text):
    """Trigrams of a text, letter by letter."""
    out, gap = [" "], True
    for ch in text.lower():
        if L._kinds()[ord(ch)]:
            out.append(ch)
            gap = False
        elif not gap:
            out.append(" ")
            gap = True
    if not gap:
        out.append(" ")
    return ["".join(out[i:i + 3]) for i in range(len(out) - 2)] if len(out) > 2 else []


TEXTS = ["Hello, World", "", "  ab!!", "123", "é\0x", "Ünïcode … ñ", "a", ".a.b.", "ét", "日本語テキスト", "\n", "x" * 50]


def test_trigrams_equal_a_loop():
    owner, gram, has = L.trigrams(TEXTS)
    got = [[] for _ in TEXTS]
    for o, g in zip(owner.tolist(), gram.tolist()):
        got[o].append(chr(g >> 42) + chr((g >> 21) & 0x1FFFFF) + chr(g & 0x1FFFFF))
    assert got == [slow_grams(t) for t in TEXTS]
    assert has.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]


@pytest.mark.parametrize("texts", [TEXTS, ["the quick brown fox " * 500, "das ist ein haus " * 300], ["ab cd"] * 2000 + TEXTS])
def test_text_vectors_bind_and_bundle(texts):
    letters = L.Letters()
    got, _ = L.text_vectors(texts, letters)
    one = lambda ch: letters.vectors(np.array([ord(ch)]))[0].astype(int)
    for k in {0, 1, len(texts) - 1, len(texts) // 2}:
        want = np.zeros(L.DIM)
        for a, b, c in slow_grams(texts[k]):
            want += np.roll(one(a), 2) * np.roll(one(b), 1) * one(c)
        assert np.array_equal(got[k], want)


def test_many_letters_take_the_sorted_way():
    gram = np.array([(i << 42) | ((i + 1) << 21) | (i % 7) for i in range(300, 900)] * 2)
    distinct, number = L._numbered(gram)
    assert np.array_equal(distinct[number], gram) and len(distinct) == 600


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.predicted(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 150 and (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_cases(spark):
    schema = "doc_id long, text string, lang string, extra int, score double"
    rows = [(1, "the house and the garden " * 20, "en", 1, 0.0), (3, "das haus und der garten " * 20, "de", 1, 0.0),
            (4, "nothing to learn", None, 1, 0.0), (5, None, "en", 1, 0.0), (6, "12 %% 3", "fr", 1, 0.0),
            (7, "", "en", None, None), (None, "the house", "en", 1, 0.0), (1, "the garden", "en", 1, 0.0),
            (9, "und das haus der " * 100_000, "de", 1, 0.0)]
    table = spark.createDataFrame(rows, schema)
    made = L.fit(table, folds=1, held=1)
    assert made.languages == ["de", "en"]
    got = sorted(L.predicted(table, made).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"]))
    found = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert found == [(1, "en"), (1, "en"), (3, "de"), (4, "en"), (5, "und"), (6, "und"), (7, "und"), (9, "de"), (None, "en")]
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert got[-1]["held_out"] is False
    # equal texts in two languages: the first in order; and nothing learned
    same = spark.createDataFrame([(1, "abc def", "xx", 1, 0.0), (3, "abc def", "aa", 1, 0.0)], schema)
    assert {r["lang_pred"] for r in L.predicted(same, L.fit(same, folds=1, held=1)).collect()} == {"aa"}
    none = table.filter("doc_id < 0")
    assert L.predicted(none, made).isEmpty()
    assert {r["lang_pred"] for r in L.predicted(table, L.fit(none)).collect()} == {"und"}
    with pytest.raises(ValueError):
        L.fit(table, folds=1, held=1, max_languages=1)
