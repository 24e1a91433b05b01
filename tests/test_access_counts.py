"""Counts of an access report by class of accounts equal those of its rows."""

from __future__ import annotations

import random

from filetide.plans.access import access_counts, effective_access


def estate(spark):
    draw = random.Random(11)
    folders = [("/r", "/r", None, "r", 0, False, True)]
    folders += [("/r", f"/r/d{i}", "/r", f"d{i}", 1, False, i % 7 != 3) for i in range(12)]
    folders += [("/r", f"/r/d{i}/s{j}", f"/r/d{i}", f"s{j}", 2, False, (i + j) % 9 != 5) for i in range(12) for j in range(4)]
    people = [f"u{i}" for i in range(20)]
    names = people + ["g0", "g1", "g2"]
    aces = []
    for _, path, *_rest in folders:
        for order in range(draw.randrange(0, 5)):
            who = draw.choice([*names, *names[-3:] * 4, "Everyone"])
            account = who if who == "Everyone" else f"CORP\\{who}"
            sid = None if draw.random() < 0.2 else f"S-{who}"
            aces.append((path, order, sid, account, draw.choice([2032127, 197055, 131241, 131209, 278, 1]), draw.choice(["Allow", "Allow", "Deny"]),
                         draw.random() < 0.5, 3, draw.choice([0, 0, 2])))
    members = [(f"S-{p}", f"S-g{i % 2}") for i, p in enumerate(people[:16])] + [("S-g0", "S-g2")]
    accounts = [(n, n if i % 5 == 0 else f"CORP\\{n}", f"S-{n}", "/r") for i, n in enumerate(names)]
    make = spark.createDataFrame
    return (
        make(folders, "root_key string, path_key string, parent_key string, folder_name string, depth int, protected boolean, readable boolean"),
        make(aces, "path_key string, ace_order int, sid string, account string, rights int, access_type string, is_inherited boolean, inherit_flags int, prop_flags int"),
        make(members, "member_sid string, group_sid string"),
        make([(f"S-{n}", f"CORP\\{n}") for n in names], "sid string, account string"),
        make(accounts, "target string, account string, sid string, root_key string"),
    )


def test_counts_by_class_equal_counts_of_rows(spark):
    tables = estate(spark)
    rows = effective_access(*tables)["counts"]
    counted = access_counts(*tables).select(*rows.columns)
    assert rows.count() == 23
    assert sorted(map(str, counted.collect())) == sorted(map(str, rows.collect()))
