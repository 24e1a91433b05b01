"""Periodic runs: against a plain search over all periods, and the whole query against its contract written out."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from filetide.llm import runs

from .corpora import EMPTY, crc, folder, frame, prose


def plain_runs(w: list, least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """All maximal repetitions with their smallest period, by start, then period."""
    n, out = len(w), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                part = w[i : j + q]
                if len(part) >= max(least, repeats * q) and not any(all(x == y for x, y in zip(part, part[r:])) for r in range(1, q)):
                    out.add((i, len(part), q))
            i = j + 1
    return sorted(out)


def plain_row(doc_id, text) -> tuple:
    w = (text or "").encode().split()
    h, n = crc(doc_id), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    digest = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), b" ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digest)


def test_trees_find_all_runs():
    draw = random.Random(5)
    for _ in range(400):
        letters = draw.choice([1, 2, 3, 6])
        docs = [[draw.randrange(letters) for _ in range(draw.randrange(60))] for _ in range(draw.randrange(1, 4))]
        for d in docs:
            if len(d) > 8 and draw.random() < 0.5:
                a, p = draw.randrange(len(d)), draw.randrange(1, 5)
                d[a:] = [d[a + i % p] for i in range(len(d) - a)]
            if d:  # also those of two repeats, which the search for stretches leaves to the trees
                assert sorted(map(tuple, runs.tree_runs([np.array(d)], 2, 2).tolist())) == plain_runs(d, 2, 2)
        first = np.cumsum([0, *map(len, docs)])
        got = runs.find_runs(np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(len(docs)), list(map(len, docs))))
        assert [tuple(r) for r in got.tolist()] == [(k, first[k] + s, n, q) for k, d in enumerate(docs) for s, n, q in plain_runs(d)]


def test_agreement_equals_comparison():
    draw = random.Random(3)
    for n in (1, 2, 15, 16, 17, 400):
        s = [draw.randrange(1, 3) for _ in range(n)] + [0]
        rank, agree = runs.SuffixTree(s, 3).tour()
        assert sorted(range(n + 1), key=lambda i: s[i:]) == np.argsort(rank).tolist()
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j and draw.random() < 0.2]
        i, j = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
        want = [next(k for k in range(n + 1) if s[a + k] != s[b + k]) for a, b in zip(i, j)]
        assert agree(i, j).tolist() == want


CASES = [
    "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a b y", "a b a b a b a", "A a A a A a A a", "a a a\x0ba\x0ca\x1fa a a a a",
    "a a a a a a b a a a a a a b a a a a a a b a a a a a a b", "é é é é é é é", "one two three four " * 4, "q " * 500 + "r " * 500,
]


def test_query_equals_contract(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, t) for i, t in enumerate(CASES)] + EMPTY + [(7003, " \n\t ")]
    for i in range(100, 220):
        vocabulary = draw.choice([2, 5, 40])
        rows.append((i, " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(draw.randrange(1, 150)))))
    rows += [(i, CASES[7]) for i in range(300, 340)]
    got = runs.query(spark, folder(spark, tmp_path / "in", rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {d for _, d in got.dtypes[:6]} == {"bigint"}
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_row(i, t) for i, t in rows), key=key)


def test_long_text_and_short_ones(spark):
    """200,000 words with a period of 40,000, wholly in one tree, beside texts that share one."""
    base = prose(4, 40_000, 3_000).split()
    long = base * 5
    rows = [(1, " ".join(long)), (2, "v " * 70_000), *((i, "a b " * 9) for i in range(3, 200))]
    got = {r["doc_id"]: r for r in runs.periodic_runs(frame(spark, rows)).select("doc_id", "runs", "collapsed").collect()}
    assert [tuple(r) for r in got[1]["runs"] if r["period"] == 40_000] == [(0, 200_000, 40_000)]
    assert got[1]["collapsed"] == " ".join(base)
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 70_000, 1)] and got[2]["collapsed"] == "v"
    assert all([tuple(r) for r in got[i]["runs"]] == [(0, 18, 2)] and got[i]["collapsed"] == "a b" for i in range(3, 200))


@pytest.mark.parametrize("column", ["text", "runs"])
def test_columns_and_empty_tables(spark, column):
    rows = spark.createDataFrame([(1, "a a a a a a", "kept", 2)], f"doc_id long, {column} string, collapsed string, length int")
    got = runs.periodic_runs(rows, column).first()
    assert got["collapsed"] == "a" and got["length"] == 2 and [tuple(r) for r in got["runs"]] == [(0, 6, 1)]
    assert runs.periodic_runs(rows.limit(0), column).collect() == []


def test_empty_documents(spark, tmp_path):
    assert runs.query(spark, folder(spark, tmp_path / "in", [])).collect() == []
