import random

import pytest

from tests.conftest import rows

encode = pytest.importorskip("trackloom.llm.encode")
from trackloom.llm import bytepairs, mixing, truncation  # noqa: E402
from trackloom.llm.bytepairs import BytePairs, load  # noqa: E402

DOCS = "doc_id bigint, text string, source string, ids string"


@pytest.fixture(scope="module")
def ranks():
    with open(encode.VOCABULARY, "rb") as f:
        return f.read()


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def odd_texts(n=400, seed=1):
    rng = random.Random(seed)
    signs = ["a", "b", " ", "  ", "\n", "'s", "'ll", "1", "\u00b2", "\u00e9", "\u4e2d", "\U0001f600", "\u200b", "\x1c", "_", "-", "\t", "ing", "the", "\u2167", "\u3000", "\x85", "<|endoftext|>", "\r\n", "\\frac{", "aaaaaaa", "zqx"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_same_as_the_public_library(ranks):
    texts = [*odd_texts(), None, "", "word " * 3000, "x" * 5000]
    at, ids = load(ranks).encode(texts)
    want = reference()
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == (want(t) if t else [])
    assert load(ranks).counts(texts).tolist() == [b - a for a, b in zip(at, at[1:])]


def test_verified_pieces_equal_exact_merging(ranks):
    b = load(ranks)
    rng = random.Random(2)
    for _ in range(2000):
        w = bytes(rng.choice(b"etaoin shrdlu019.\xc3\xa9") for _ in range(rng.randint(1, 12)))
        guess, exact = b.longest(w), b.merge(w)
        import numpy as np

        ok = b.compatible(np.array(guess[:-1], dtype=np.int64), np.array(guess[1:], dtype=np.int64)).all()
        assert ok == (guess == exact)


def test_long_words_are_merged_fast(ranks):
    import time

    b, rng = load(ranks), random.Random(4)
    for n in (60, 200, 1000):
        w = bytes(rng.choice(b"etaoinshrdlu") for _ in range(n))
        b_few, bytepairs.FEW = bytepairs.FEW, 10**9
        want = b.merge(w)
        bytepairs.FEW = b_few
        assert b.merge(w) == want
    began = time.time()
    text = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(1_000_000))
    at, ids = b.encode([text])
    assert time.time() - began < 30 and at[1] == len(ids) and at[1] < 600_000
    assert b.encode(["aa" * 3000])[1].tolist() == reference()("aa" * 3000)


def test_ids_of_a_table(spark):
    df = spark.createDataFrame([(1, "Hello world", "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (1, "Hello world", "a", "x")], DOCS)
    got = rows(encode.token_ids(df))
    want = reference()("Hello world")
    assert sorted(got, key=repr) == sorted([(1, want), (1, want), (2, []), (3, [])], key=repr)
    assert not encode.token_ids(df.limit(0)).collect()
    assert [r["n_tokens"] for r in encode.token_counts(df).orderBy("doc_id").collect()] == [2, 2, 0, 0]


def test_long_texts_in_parts(ranks, monkeypatch):
    texts = ["some words of text, " * 50, "short", "", "caf\u00e9 " * 70]
    want = load(ranks).encode(texts)
    monkeypatch.setattr(bytepairs, "PIECES", 7)
    got = BytePairs(ranks).encode(texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_water_filling():
    s = mixing.water_fill({"a": 100, "b": 100, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 3, "c": 9}, 250)
    assert (s["a"].wanted, s["b"].wanted, s["c"].wanted) == (100, 150, 0)
    s = mixing.water_fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    assert s["a"].wanted == s["b"].wanted == 100
    # the abundant source is gone through once, the scarce ones are repeated or clamped
    s = mixing.water_fill({"a": 1000, "b": 100, "c": 100}, {"a": 0.5, "b": 0.2, "c": 0.3}, {"a": 1, "b": 2, "c": 9})
    assert [round(s[k].wanted) for k in "abc"] == [1000, 200, 600]
    s = mixing.water_fill({"a": 10}, {"a": 1.0}, {"a": 2}, 1000)
    assert s["a"].wanted == 20 and mixing.water_fill({}, {"a": 1.0}, {"a": 1})["a"].wanted == 0


def test_mixture(spark):
    rng = random.Random(0)
    data = [(i, "word " * rng.randint(1, 20), rng.choice(["a", " A", "b", None, "other"]), "x") for i in range(900)] + [(-1, None, "a", "x"), (-2, "", "b", "x")]
    docs = spark.createDataFrame(data, DOCS)
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 4), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets)
    got = m.collect()
    assert {r["source"] for r in got} == {"a", "b"} and max(r["repeats"] for r in got if r["source"] == "a") <= 2 and max(r["repeats"] for r in got if r["source"] == "b") <= 4
    share = {r["source"]: r["share"] for r in mixing.shares(m, targets).collect()}
    assert abs(share["a"] - 1 / 3) < 0.01 and abs(share["b"] - 2 / 3) < 0.01 and share["gone"] == 0
    assert rows(mixing.mix(docs, targets)) == rows(m) and not mixing.mix(docs.limit(0), targets).collect() and not mixing.mix(docs, targets.limit(0)).collect()


def test_scarce_feed_is_clamped(spark, tmp_path):
    from trackloom.llm.registry import QUERIES

    data = [(0, "word", "small", "x")] + [(1 + k, "word " * 20, "big", "x") for k in range(300)] + [(400 + k, "word " * 20, "middle", "x") for k in range(100)]
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("small", 0.05, 4), ("big", 0.75, 2), ("middle", 0.2, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = QUERIES["p8_mix"](spark, str(tmp_path)).collect()
    assert [r["repeats"] for r in got if r["source"] == "small"] == [4]
    assert sum(r["source"] == "big" for r in got) == 300 and sum(r["source"] == "middle" for r in got) >= 80
    share = {r["source"]: r["share"] for r in QUERIES["p8_shares"](spark, str(tmp_path)).collect()}
    assert abs(share["big"] / share["middle"] - 0.75 / 0.2) < 0.1 and 0 < share["small"] < 0.01


CUT = {
    "\\documentclass{article}\n\\begin{document}\nSome text that": True,
    "\\documentclass{article}\n\\begin{document}\nText.\n\\end{document}\n% a draft that breaks": False,
    "\\documentclass{article}\n\\begin{document}\nText.\n% \\end{document}\nmore": True,
    "\\magnification=1200\nText.\n\\bye": False,
    "\\section{Data}\nA sentence that is whole.": False,
    "\\section{Data}\nA sentence that is wh": True,
    "\\section{Data}\nA formula $x + \\frac{1}{2": True,
    "\\section{Data}\n\\begin{itemize}\n\\item Whole sentence.": True,
    "\\section{Data}\nAll said \\ldots\n": False,
    "\\section{Data}\nDone.\n\n\\input{tables/last}\n": False,
    "\\section{Data}\nDone.\n% draft that breaks off in": False,
    "Ends with a mark of omission and…": True,
    "50\\% of cases, as in $a_{1}$ (see Section~\\ref{x}).": False,
    "\\documentclass{a}\n\\begin{document}\n\\verb|\\end{document}| tells that": True,
    "\\documentclass{a}\n\\begin{document}\n\\begin{verbatim}\n\\bye\n\\end{verbatim}\nText": True,
    "\\documentclass{a}\n\\begin{document}\nText (open {.\n\\end { document }\nleft (over": False,
    "A line that ends in an escape \\": True, "An entity is cut &am": True, "Half a letter \ufffd": True,
    "Withdrawn.": False, "% empty\n": False, "": False, "  \n": False,
}


def test_cut_texts(spark):
    # a feed whose own texts end well, with the cases in between
    data = [(i, "\\documentclass{a}\nText.\n\\end{document}\n", "f", "x") for i in range(60)] + [(100 + i, "\\section{A}\nWhole.", "f", "x") for i in range(60)]
    cases = list(enumerate(CUT.items(), 1000))
    data += [(i, t, " F", "x") for i, (t, _) in cases] + [(2000, None, "f", "x")]
    docs = spark.createDataFrame(data, DOCS)
    assert {r["doc_id"] for r in truncation.truncated(docs).collect()} == {i for i, (_, cut) in cases if cut}
    rate = {r["source"]: (r["docs"], r["truncated"]) for r in truncation.truncation_rates(docs).collect()}
    assert rate == {"f": (len(data), sum(CUT.values()))}
    assert not truncation.truncated(docs.limit(0)).collect()


def test_stamps_of_any_length(spark):
    long = "received through a very long chain of mirrors, " * 20
    data = [(i, f"\\section{{A}}\nWhole.\n[{long}{10000 + i}]", "f", "x") for i in range(80)]
    data += [(100 + i, f"\\section{{A}}\nCut in the mid\n[{long}{20000 + i}]", "f", "x") for i in range(10)]
    assert {r["doc_id"] for r in truncation.truncated(spark.createDataFrame(data, DOCS)).collect()} == set(range(100, 110))


def test_stamps_and_limits(spark):
    data = [(i, f"\\section{{A}}\nWhole sentence number {'x' * (i % 7)}.\n%% record {10000 + i} --", "f", "x") for i in range(80)]
    data += [(100 + i, f"\\section{{A}}\n{'y' * 60}\n%% record {20000 + i} --", "f", "x") for i in range(10)]
    data += [(200, "\\section{A}\nSaid.\n% " + "z" * 53, "f", "x")]
    got = {r["doc_id"]: r["reason"] for r in truncation.truncated(spark.createDataFrame(data, DOCS)).collect()}
    assert set(got) - {200} == set(range(100, 110))


def held(text):
    return truncation.scan(text)[0]


def test_nested_markup():
    assert held("\\begin{a}{$x$}\\end{a} \\{ \\% $$y$$") == []
    assert held("\\begin{a}\\begin{b}\\end{a}") == []
    assert held("lost } brace { and\n\nnext paragraph") == []
    assert held("\\begin{verbatim}$ { \\end{verbatim}") == []
    assert held("$a {b") == ["$", "{"]


def test_brackets_and_quotes_of_prose_are_held():
    assert held("A sentence (see Fig.") == ["("] and held("He says “so it is.") == ["“"] and held("He says ``so.") == ["``"]
    assert held("Open [1, 2) it is, ``so\" and „so“.") == [] and held("On $[0, 1)$ and \\([0, 1)\\), (a).") == [] and held("Lost (here\n\nA new paragraph.") == []
    assert held("\\emph{lost ( here} and on.") == [] and held("1) first, 2) second.") == []
    assert held("\\begin{align} (x \\end{align} whole.") == []
