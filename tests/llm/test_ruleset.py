"""Rule ensemble: statistics and scores against plain Python, rules against the trees they come from, held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from filetide.llm import ruleset

from .corpora import EMPTY, crc, folder, frame, prose

PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_statistics(text: str | None) -> dict[str, float]:
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    n = len(text)
    kinds = {
        "upper": lambda c: unicodedata.category(c) == "Lu", "digit": lambda c: unicodedata.category(c) == "Nd", "stop": lambda c: c in ".,;:",
        "call": lambda c: c in "!?", "bar": lambda c: c == "|", "symbol": lambda c: c in "#$%&*+/<=>@\\^_~", "bracket": lambda c: c in "(){}[]",
        "odd": lambda c: not (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" or c in " \t\n\x0b\f\r" or c in PUNCT),
    }
    out = {
        "characters": n, "words": len(w), "lines": len(lines), "word_length": (n - len(w) + 1) / len(w) if w else 0, "longest_word": max(map(len, w), default=0),
        "words_a_line": len(w) / len(lines) if lines else 0, "distinct_words": len(set(w)) / len(w) if w else 0,
        "distinct_lines": len(set(lines)) / len(lines) if lines else 0, "repeated_words": sum(a == b for a, b in zip(w, w[1:])) / len(w) if w else 0,
    }
    return out | {f"{k}_share": sum(map(f, text)) / n if n else 0 for k, f in kinds.items()}


TEXTS = [None, "", " \n\t ", "word", "a a b", "Größe ÄÖ 12 — (x) {y} | p#q!\n\nline line\nline line", "٣ ready? 100% «quoted» \U0001f600", "one\x0btwo\x0cthree\r\nfour", prose(1, 3_000)]


def test_statistics(spark):
    rows = frame(spark, list(enumerate(TEXTS))).select("doc_id", ruleset.statistics(F.col("text")).alias("s")).collect()
    for r in rows:
        assert tuple(r["s"].asDict()) == ruleset.STATISTICS
        for name, value in plain_statistics(TEXTS[r["doc_id"]]).items():
            assert r["s"][name] == pytest.approx(value), (r["doc_id"], name)


TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 1 <= 2.5)
   If (feature 1 <= 1.0E-4)
    Predict: 0.0
   Else (feature 1 > 1.0E-4)
    Predict: 1.0
  Else (feature 1 > 2.5)
   Predict: 1.0
"""


def test_rules_of_a_tree():
    rules = ruleset.tree_rules(TREE, ("a", "b"))
    inf = math.inf
    assert [r.bounds for r in rules] == [(("b", -inf, 2.5),), (("b", -inf, 1e-4),), (("b", 1e-4, 2.5),), (("b", 2.5, inf),)]
    assert str(rules[2]) == "0.0001 < b <= 2.5"


def junk(i: int) -> str:
    words = prose(i, 60).split()
    kind = i % 3
    return " | ".join(words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(w for w in words[:9] for _ in range(7))


def corpus(n: int) -> tuple[list, list]:
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = draw.random() < 0.3
        rows.append((i, junk(i) if bad else prose(i, draw.randrange(20, 200))))
        labels.append((i, int(not bad), 0))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    rows, labels = corpus(500)
    more = [*labels, (1, 1 - labels[1][1], 0), (None, 1, 0), (2, None, 0), (99_999, 0, 0)]
    got = ruleset.query(spark, folder(spark, tmp_path_factory.mktemp("quality") / "in", rows + EMPTY + rows[:1], more))
    return rows, labels, got


def test_held_out_accuracy(scored):
    rows, labels, got = scored
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    out = got.collect()
    assert len(out) == len(rows) + len(EMPTY) + 1
    truth = {i: quality for i, quality, _ in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and all(crc(r["doc_id"]) % 5 == 0 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_score_equals_plain_rules(spark):
    """The column against weights summed by hand."""
    rules = [
        (ruleset.Rule((("words", -math.inf, 3.0),)), 0.75), (ruleset.Rule((("upper_share", 0.05, math.inf), ("words", 1.0, 9.0))), -2.0),
        (ruleset.Rule((("bar_share", 0.0, 0.5),)), 1.5),
    ]
    ensemble = ruleset.Ensemble(tuple(rules), -0.25)
    got = frame(spark, list(enumerate(TEXTS))).select("doc_id", ensemble.score(ruleset.statistics(F.col("text"))).alias("p")).collect()
    for r in got:
        s = plain_statistics(TEXTS[r["doc_id"]])
        total = -0.25 + sum(w for rule, w in rules if all(low < s[name] <= high for name, low, high in rule.bounds))
        assert r["p"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_learned_rules_are_sparse_paths(spark, tmp_path):
    rows, labels = corpus(300)
    docs = ruleset.described(frame(spark, rows))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ensemble = ruleset.learn(docs, marked, sample_rows=200)
    assert 0 < len(ensemble.rules) <= ruleset.TREES * (2 ** (ruleset.DEPTH + 1) - 2) / 4
    assert all(name in ruleset.STATISTICS and low < high for rule, _ in ensemble.rules for name, low, high in rule.bounds)
    kept = {r["doc_id"] for r in ruleset.keep_good(frame(spark, rows), ensemble).collect()}
    good = {i for i, quality, _ in labels if quality}
    assert len(good - kept) <= 3 and len(kept - good) <= 6
    assert ruleset.keep_good(frame(spark, rows), ensemble).columns == frame(spark, []).columns


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (2, 0, 0)]])
def test_labels_of_one_kind(spark, tmp_path, labels):
    got = ruleset.query(spark, folder(spark, tmp_path / "in", [(1, "a b"), (2, None)], labels)).collect()
    share = (sum(q for i, q, _ in labels if crc(i) % 5) + 0.5) / (sum(1 for i, _, _ in labels if crc(i) % 5) + 1)
    assert [r["score"] for r in got] == pytest.approx([share] * 2)


def test_no_documents(spark, tmp_path):
    assert ruleset.query(spark, folder(spark, tmp_path / "in", [], [(1, 1, 0), (2, 0, 0)])).collect() == []
