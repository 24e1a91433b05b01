"""Every SQL function equals the expression it comes from, on awkward values; none runs Python."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from filetide.functions import sql

VALUES = {
    "string": ["", None, "C:\\A\\b c.TXT", "\\\\srv\\Share\\x - Copy (2).docx", "//?/UNC/S/h/", "c:/a/b", "/estate", "it's\\'q", "Backup_old.zip", "formula", "'D:\\[B.xlsx]S'!A1", "https://x.y/z"],
    "int": [0, 1, -1, 2032127, 1179817, 131209, 197055, 278, 3, 2, None],
    "bigint": [0, 1, 1023, 1024, 1536, 10**6, 5 * 10**12, -2048, None],
    "double": [0.0, 0.4, 59.9, 60.0, 3_600.0, 90_061.0, None],
}


@pytest.fixture(scope="module")
def registered(spark):
    return sql.register(spark, "t_")


@pytest.mark.parametrize("family", ["path", "name", "format", "rights", "link"])
def test_functions_equal_expressions(spark, registered, family):
    member = lambda n: ("path" in n or n in ("canonical_path", "parent_key", "volume_root", "is_below")) if family == "path" else n.startswith("format") if family == "format" else \
        ("rights" in n or "synchronize" in n) if family == "rights" else "link" in n if family == "link" else "word" in n or n == "archive_base"
    chosen = {n: f for n, f in sql.FUNCTIONS.items() if member(n)}
    assert chosen and {f"t_{n}" for n in chosen} <= set(registered)
    for name, function in chosen.items():
        frame = spark.range(1)
        for parameter, kind in function.parameters:
            frame = frame.join(spark.createDataFrame([(v,) for v in VALUES[kind]], f"{parameter} {kind}"))
        names = [p for p, _ in function.parameters]
        out = frame.select(function.body(*[F.col(n) for n in names]).alias("a"), F.expr(f"t_{name}({', '.join(names)})").alias("b"))
        assert out.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == [], name


def test_calls_become_expressions(spark, registered):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        spark.sql("SELECT t_path_key(concat('C:/', id)) AS k FROM range(3) WHERE t_rights_level(int(id)) = 'None'").explain()
    assert "Python" not in shown.getvalue() and "t_path_key" not in shown.getvalue()
