"""The whole pipeline on a small corpus with planted rows."""

import corpus_pipeline

from .corpora import EMPTY, folder, prose
from .test_models import toxic_rows


def test_stages_take_out_what_is_planted(spark, tmp_path):
    rows, labels = toxic_rows()
    item = prose(5555, 40)
    rows += [*EMPTY, (900, prose(1, 60)), (901, prose(7777, 300) + " " + item), (902, rows[1][1])]
    path = folder(spark, tmp_path / "corpus", rows, labels, [(1, item)])
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    clean = {i for i, _ in rows if i is not None and i < 400 and i % 5} | {d for d, _ in EMPTY}
    assert set(out) == clean
    assert all(out[d]["ids"] or not out[d]["text"] for d in out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "encoding"]
