"""Whitening, ranked search and repetition against brute force, and their edge cases."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkweave.llm import ranking, repetition, whitening

SF = "/root/testdata/sf0.001"


def whole(v):
    return tuple(math.floor(64 * c) + 1_000_000 for c in v)


def plain_whitening(rows):
    """{vec_id: [(deviation, projections)]} by a dense eigendecomposition of the whole covariance."""
    x = [(i, whole(v)) for i, v in rows]
    points = np.array(sorted({v for _, v in x}))
    n, total = len(points), points.sum(axis=0)
    c = (n * points - total) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, values, [(i, int(((n * np.array(v) - total) ** 2).sum()), ((n * np.array(v) - total) / n) @ vectors / np.sqrt(values)) for i, v in x]


def compare_whitening(got, rows, components):
    n, values, want = plain_whitening(rows)
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert len(got) == len(rows) * components
    for k in range(1, components + 1):
        mine = got[got.component == k].sort_values("vec_id", kind="stable")
        assert np.allclose(mine.explained, values[k - 1] / values.sum(), rtol=1e-9)
        theirs = np.array([y[k - 1] for _, _, y in sorted(want, key=lambda r: r[0])])
        sign = np.sign((theirs * mine.whitened).sum())
        assert np.abs(theirs * sign - mine.whitened).max() < 1e-8
        assert mine.deviation.tolist() == [d for _, d, _ in sorted(want, key=lambda r: r[0])]


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    compare_whitening(whitening.whiten(rows).toPandas(), [(r.vec_id, r.embedding) for r in rows.collect()], 16)


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(0)
    good = [(i, (rng.standard_normal(5) * [5, 4, 3, 2, 1]).tolist(), "x") for i in range(60)]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0, 2.0], "x"), (103, [1.0, None, 0.0, 0.0, 0.0], "x"), (104, [float("nan"), 0.0, 0.0, 0.0, 0.0], "x"), (105, [0.0, float("inf"), 0.0, 0.0, 0.0], "x")]
    rows = spark.createDataFrame(good + good[:3] + odd, "vec_id long, embedding array<double>, x string").repartition(3)
    compare_whitening(whitening.whiten(rows).toPandas(), [(i, v) for i, v, _ in good + good[:3]], 5)
    assert whitening.whiten(rows.limit(0)).count() == 0
    assert whitening.whiten(rows.where("vec_id = 1")).count() == 0  # one vector: no component has any spread
    flat = spark.createDataFrame([(i, [float(i % 7), 3.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_eigenpairs_of_a_large_operator():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 400)) * np.linspace(1, 2, 400)
    v = a.T @ a / 2000
    values, vectors, residuals = whitening.eigenpairs(lambda b: v @ b, 400, 16)
    want, exact = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:16], rtol=1e-12) and residuals.max() <= 1e-13 * values[0]
    assert np.abs(np.abs((vectors * exact[:, ::-1][:, :16]).sum(axis=0)) - 1).max() < 1e-10


def test_deviations_beyond_doubles_and_longs():
    x = np.array([[1 << 20, 5], [3, 1 << 40]])
    sums = [7, 11]
    got = whitening.deviations(x, 1 << 30, sums)
    want = [sum(((1 << 30) * c - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
    assert got == [w if w < 1 << 63 else None for w in want]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranking(docs, items, k=10):
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = collections.Counter(w for _, t in held for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for w, c in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, t in held:
            tf, m = collections.Counter(t), 10 + 90 * len(t) * n // total
            score = sum(weight[w] * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in set(terms_of(text)) if tf[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def ranked(docs, items, **more):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranking.search(docs, items, **more).collect()), key=repr)


def test_ranked_search_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain_ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ranked(docs, items) == want
    assert ranked(docs, items, lot=1000) == want  # several lots


def test_ranked_search_reads_lists_to_their_ends(spark, monkeypatch):
    """Many ties, copies, common words and items without rare words: bands beyond the heads."""
    monkeypatch.setattr(ranking, "FIRST", 4)
    monkeypatch.setattr(ranking, "GROWTH", 4)
    monkeypatch.setattr(ranking, "AT_ONCE", 1)
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "délta", "日本", "x1"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 6)))) for i in range(150)]
    docs += [(1000 + i, "Alpha, BETA!") for i in range(40)] + [(None, "alpha beta"), (None, None), (7, "alpha"), (2000, ""), (2001, "gamma " * 3000), (2002, "Éclair É")]
    items = [(1, "alpha beta"), (2, "gamma Gamma délta"), (2, "x1"), (None, "日本 nothing"), (3, None), (4, "--"), (5, "absent words"), (6, " ".join(words))]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, entry string").repartition(5)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, item int")
    assert ranked(d, b) == plain_ranking(docs, items)
    assert ranked(d.limit(0), b) == [] and ranked(d, b.limit(0)) == []


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    again = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    places = collections.defaultdict(list)  # brute force: all substrings of LEAST and more words, repeated ones
    for i in range(len(words) - repetition.LEAST + 1):
        places[tuple(words[i : i + repetition.LEAST])].append(i)
    longest, spans, repeats = 0, set(), set()
    for group in places.values():
        for a in group:
            for b in group:
                if a < b:
                    size = 0
                    while b + size < len(words) and words[a + size] == words[b + size]:
                        size += 1
                    longest = max(longest, size)
                    spans |= {*range(a, a + size), *range(b, b + size)}
                    lead = 0
                    while a - lead > 0 and words[a - lead - 1] == words[b - lead - 1]:
                        lead += 1
                    repeats.add(tuple(words[a - lead : a + size]))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(repeats), len(spans), longest


def test_repetition(spark):
    rng = np.random.default_rng(5)
    some = [w for w in "der die das und oder é日 # a|b <p>".split()]
    texts = [None, "", " \n\t ", "one two", "la " * 300, "a\x1cb\x85c\xa0d e", "x\x00y z\x0b\x0cw"]
    texts += [" ".join(rng.choice(some[: rng.integers(1, 9)], rng.integers(1, 120))) for _ in range(60)]
    passage = [f"p{i}" for i in range(70)]
    texts += [" ".join(passage + [f"q{i}" for i in range(k)] + passage) for k in (1, 50, 400)]
    texts += ["same line here\n" * 4 + "\n\n  \nsame line here \n" + " ".join(map(str, range(100)))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int").repartition(3)
    got = {r.doc_id: r for r in repetition.judge(docs).collect()}
    for i, t in enumerate(texts):
        want, r = plain_counts(t), got[i]
        assert tuple(r[c] for c in repetition.COUNTS) == want, (i, t)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        bad = want[6] > repetition.COVERED * want[0] or want[7] > repetition.LONGEST * want[0] and want[7] > repetition.LONGEST_WORDS
        assert r.base_failed == failed and r.kept == (not failed and not bad)
    assert got[len(texts) - 4].kept is False and got[len(texts) - 2].kept is True  # half of it repeated; 70 of 540 words twice
    kept = repetition.reject_repetitive(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert repetition.judge(docs.limit(0)).count() == 0 and repetition.reject_repetitive(docs.limit(0)).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(6)
    for _ in range(100):
        n = int(rng.integers(0, 60))
        word, text = rng.integers(0, rng.integers(1, 4) + 1, n), np.sort(rng.integers(0, 3, n))
        suffix = [tuple(word[i : np.searchsorted(text, text[i], side="right")]) for i in range(n)]
        s = repetition.suffix_array(word, text)
        assert s.order.tolist() == sorted(range(n), key=lambda i: (text[i], suffix[i]))
        for k in range(1, n):
            a, b = s.order[k - 1], s.order[k]
            same = 0
            while text[a] == text[b] and same < min(len(suffix[a]), len(suffix[b])) and suffix[a][same] == suffix[b][same]:
                same += 1
            assert s.common[k] == same


@pytest.mark.parametrize("period", [1, 3, 1000])
def test_a_very_long_repetitive_text(period):
    words = " ".join(f"w{i % period}" for i in range(300_000))
    m = repetition.measured(pa.array([words, "short text", None]))
    assert m["n_words"].tolist() == [300_000, 2, 0] and m["longest_repeat"].tolist() == [300_000 - period, 0, 0]
    assert m["covered_words"].tolist() == [300_000, 0, 0]
