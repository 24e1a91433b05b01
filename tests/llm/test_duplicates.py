"""Line templates, near duplicates and benchmark items against plain versions."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from filetide.llm import decontaminate, superminhash, templates

from .corpora import EMPTY, edited, folder, frame, prose, shingles, words


def near_groups(rows):
    """Smallest doc_id reachable over all pairs of documents, by comparing every pair."""
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_rows():
    rows = [r for r in EMPTY]
    for g in range(6):
        text = prose(100 + g, 60 + 30 * g)
        rows += [(1000 * g + 10 + k, edited(text, 31 * g + k, k % 6)) for k in range(25)]
    chain = prose(500, 120)
    for k in range(12):  # each like the one before, the ends unlike each other
        rows.append((9000 + k, chain))
        chain = edited(chain, 900 + k, 2)
    return rows + [(20, rows[20][1]), (8000, "one two three"), (8001, "ONE two\tthree"), (8002, "one two four")]


def test_groups_equal_all_pairs(spark):
    rows = [r for i, r in enumerate(near_rows()) if r[0] != 20] + [(20, prose(77, 50)), (20, prose(77, 50))]
    out = superminhash.grouped(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    expected = near_groups(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_one_id_with_two_texts(spark):
    out = superminhash.grouped(frame(spark, [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(2, 50))])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_no_documents(spark, tmp_path):
    path = folder(spark, tmp_path / "none", [])
    assert superminhash.query(spark, path).count() == 0
    assert templates.query(spark, path).count() == 0
    assert decontaminate.query(spark, path).count() == 0


def test_stage_keeps_columns(spark):
    docs = frame(spark, near_rows())
    kept = superminhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    groups = near_groups([r for r in near_rows() if r[0] != 20])
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {d for d, (_, c) in groups.items() if d == c}


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    common, one, two = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 100, 100))
    sets = [np.concatenate([common, one]), np.concatenate([common, two]), common[:3]]
    sig = superminhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    alone = superminhash.signatures(sets[0], np.array([0, len(sets[0])]))
    assert (alone[0] == sig[0]).all()  # a set's signature does not depend on its neighbours


LICENSE = "Licensed under the Free Sharing Terms, Version 2.0."


def line_corpus():
    passage = prose(900, 60).replace("\n", " ")
    rows = []
    for d in range(8):
        own = [prose(10 * d + k, 25).replace("\n", " ") for k in range(4)]
        rows.append((d, "\n".join([own[0], LICENSE.replace("2.0", f"{d}.0"), own[1], passage, own[2], own[3]])))
    copy = "\n".join(prose(800 + k, 25).replace("\n", " ") for k in range(4))
    rows += [(100 + k, copy) for k in range(5)]  # a copied document is left to near dedup
    return rows, passage


def test_recurring_templates_go_but_for_the_first(spark):
    rows, passage = line_corpus()
    docs = frame(spark, [*EMPTY, *rows])
    out = {r["doc_id"]: r for r in templates.drop_recurring(docs, counts=True).collect()}
    for d, text in rows:
        lines = text.split("\n")
        if 0 < d < 100:
            lines = [x for x in lines if x != passage and not x.startswith("Licensed")]
        assert out[d]["text"] == "\n".join(lines) and out[d]["n_chars"] == len(out[d]["text"])
    for d, text in EMPTY:
        assert out[d]["text"] == text and out[d]["n_dropped"] == 0
    assert templates.stage(spark, docs, "").columns == docs.columns


def test_a_varying_part_is_generalised(spark):
    head, tail = prose(1, 12).replace("\n", " "), prose(2, 12).replace("\n", " ")
    rows = [(d, f"{prose(50 + d, 30)}\n{head} {prose(70 + d, 3, 3000).replace(chr(10), ' ')} {tail}") for d in range(6)]
    out = templates.drop_recurring(frame(spark, rows), counts=True).collect()
    assert sum(r["n_dropped"] for r in out) >= 3


def test_contained_items(spark, tmp_path):
    items = [(1, prose(1, 30)), (2, prose(2, 59)), (3, prose(1, 30).upper()), (4, "short item"), (5, ""), (6, None), (None, prose(3, 14))]
    rows = [*EMPTY, (1, prose(50, 3000) + " " + prose(1, 30) + "\n" + prose(51, 200)), (2, prose(52, 40) + " " + edited(prose(2, 59), 1, 2)),
            (3, "a Short  ITEM here"), (4, prose(53, 100)), (5, prose(3, 14)), (5, prose(3, 14)), (6, " ".join(prose(2, 59).split()[:35]))]
    path = folder(spark, tmp_path / "items", rows, benchmark=items)
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in decontaminate.query(spark, path).collect()}
    expected = {}
    for i, item in items:
        width = min(5, len(words(item)))
        own = shingles(item, width) if width else frozenset()
        for d, text in rows:
            both = len(own & shingles(text, width)) if own and len(words(text)) >= width else 0
            if own and both >= 0.75 * len(own):
                expected[d, i] = (len(own), both)
    assert got == expected and (1, 1) in got and (1, 3) in got and (3, 4) in got and (5, None) in got
    docs = frame(spark, rows)
    kept = decontaminate.stage(spark, docs, path)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in {x for x, _ in got})


@pytest.mark.parametrize("broadcast", [True, False])
def test_both_ways_to_join(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 10**6 if broadcast else 0)
    path = folder(spark, tmp_path / "join", [(1, prose(1, 80)), (2, prose(2, 80))], benchmark=[(9, " ".join(prose(1, 80).split()[:30]))])
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.query(spark, path).collect()] == [(1, 9)]


def lines_of(seed: int, n: int) -> list[str]:
    w = prose(seed, 12 * n).split()
    return [" ".join(w[12 * i : 12 * i + 12]) for i in range(n)]


def near_copy(lines: list[str], seed: int) -> list[str]:
    """One line in twenty edited, at its start, so that its leaf changes."""
    draw = np.random.default_rng(seed)
    return [f"edit{chr(97 + seed % 26)} {x}" if draw.random() < 0.05 else x for x in lines]


def test_copies_do_not_keep_a_passage_in_unrelated_documents(spark):
    """A line in 12 unrelated documents goes from 11 of them, also when 40 near copies hold it."""
    shared = " ".join(lines_of(900, 3))
    base = lines_of(901, 24)
    rows = [(i, "\n".join([*lines_of(i, 6), shared, *lines_of(500 + i, 3)])) for i in range(12)]
    rows += [(100 + i, "\n".join([*near_copy(base, i), shared])) for i in range(40)]
    for chosen in (rows[:12], rows):
        out = {r["doc_id"]: r for r in templates.drop_recurring(frame(spark, chosen), counts=True).collect()}
        assert [i for i in range(12) if shared in out[i]["text"].split("\n")] == [0]
        assert all(out[i]["n_dropped"] == (i > 0) for i in range(12))
        assert all(out[i]["n_dropped"] <= 1 for i in out)  # the copies lose the shared line at most, never their own


def test_near_copies_alone_stay_whole(spark):
    base = lines_of(902, 24)
    rows = [(i, "\n".join(near_copy(base, i))) for i in range(60)]
    assert all(r["n_dropped"] == 0 for r in templates.drop_recurring(frame(spark, rows), counts=True).collect())


@pytest.mark.parametrize("trial", range(4))
def test_two_shared_lines_do_not_make_documents_related(spark, trial):
    first, second = lines_of(1000 + trial, 2)
    rows = [(i, "\n".join([first, *lines_of(2000 + 50 * trial + i, 5), second])) for i in range(20)]
    out = {r["doc_id"]: r for r in templates.drop_recurring(frame(spark, rows), counts=True).collect()}
    assert [r["n_dropped"] for _, r in sorted(out.items())] == [0] + [2] * 19


def test_lines_below_the_least_tokens_stay(spark):
    rows = [(i, "\n".join(["the end now", *lines_of(3000 + i, 4)])) for i in range(40)]
    assert all(r["n_dropped"] == 0 for r in templates.drop_recurring(frame(spark, rows), counts=True).collect())


def test_a_text_is_parsed_once(spark):
    plan = templates.parsed(frame(spark, [(1, "x")]).select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_tokens_of_odd_lines(spark):
    rows = [(1, "  a\t\tb \x0bc\x0c d\r"), (2, ""), (3, " \t "), (4, "see http://x.y a1 me@here 10:30 \xa0 e:/f")]
    got = {r["doc_id"]: r["t"] for r in frame(spark, rows).select("doc_id", templates.tokens(F.col("text")).alias("t")).collect()}
    assert got == {1: ["a", "b", "c", "d"], 2: [], 3: [], 4: ["see", "<*>", "<*>", "<*>", "<*>", "\xa0", "e:/f"]}
