"""Token blocks and piece encoding: exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from filetide.llm import pieces, rans
from filetide.session import scratch_path

from .corpora import EMPTY, folder, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = ["a", "the", "\n", " ", "  ", "é", "don't", "1234", "...", "　", "\xa0", "\t", "日本", "!", "X9y", "'s", "\r\n", "<|endoftext|>", "\x1c", "\x85"]


def reference_ids(text):
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return [*whole.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_are_encoded_as_the_tokenizer_does():
    coder, draw = rans.Encoder(PATH), random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choice(AWKWARD) for _ in range(draw.randrange(14)))
        assert coder.encode(pa.array([text]))[0].tobytes() == coder._whole(text), repr(text)


def test_each_distinct_split_is_merged_once(monkeypatch):
    coder, merged = rans.Encoder(PATH), []
    merge = coder._merge
    monkeypatch.setattr(coder, "_merge", lambda splits: merged.extend(map(str, splits)) or merge(splits))
    texts = ["x omega, omega$$ omega\nomega", None, "y omega. omega##\n"]
    for got, text in zip(coder.encode(pa.array(texts)), texts):
        assert got.tobytes() == coder._whole(text or "")
    assert sum(m.replace(" ", "\u0120") == "\u0120omega" for m in merged) == 1


def test_a_full_memory_keeps_what_is_needed(monkeypatch):
    monkeypatch.setattr(rans, "CACHE", 3)
    coder, draw = rans.Encoder(PATH), random.Random(6)
    signs = [*AWKWARD, "n't", "'", "\U00020000", "\U0001f600", "e\u0301", "\u0661", "\x00", "ab", "\u200b", "\ufeff"]
    for _ in range(200):
        texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(9))) for _ in range(5)]
        assert [x.tobytes() for x in coder.encode(pa.array(texts))] == [coder._whole(t) for t in texts], texts
    assert len(coder.known) < 100


@pytest.mark.parametrize("n", [0, 1, 5, 64, 1000, (1 << 17) + 77])
def test_blocks_decode_and_checks_catch_damage(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 5000
    tokens, freq = rans.scaled({int(a): int(b) for a, b in zip(*np.unique(ids, return_counts=True))})
    coder = rans.Coder(tokens, freq)
    made = coder.encode(ids)
    assert (coder.decode(**made) == ids).all()
    if n >= 64:
        spoiled = bytearray(made["words"])
        spoiled[len(spoiled) // 2] ^= 1
        with pytest.raises(ValueError):
            coder.decode(**{**made, "words": bytes(spoiled)})


def test_table_sums_to_a_power_of_two():
    tokens, freq = rans.scaled({i: 1 for i in range(50_000)} | {60_000: 10**12})
    assert freq.sum() == 1 << rans.BITS and freq.min() == 1 and len(tokens) == 50_001


def test_files_give_every_document_back(spark):
    rows = [*EMPTY, (3, "same"), (3, "same"), *[(i, prose(i, 40 + i)) for i in range(10, 40)]]
    path = scratch_path(spark, "rans-test")
    rans.write(frame(spark, rows).repartition(3), path, PATH, block=500)  # documents straddle blocks
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in rans.digests(spark, path).collect())
    start, expected = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(reference_ids(text), "<u4")
        expected.append((doc is not None, doc or 0, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    assert sum(len(r["ids"]) for r in rans.decoded(spark, path).collect()) == start


def test_empty_table(spark, tmp_path):
    path = folder(spark, tmp_path / "none", [])
    assert rans.query(spark, path).count() == 0
    assert pieces.query(spark, path).count() == 0


def test_scan_equals_one_pass():
    model, draw = pieces.loaded(pieces.model_file()), random.Random(3)
    for trial in range(200):
        text = "".join(draw.choice(["a", "the ", "  ", "é", "\n", "zz", "▁", "日", "lyer", "tion", " ", "ing"]) for _ in range(draw.randint(1, 60)))
        if trial % 3 == 0:
            text = text.replace(" ", "x").replace("▁", "y")  # no certain cut anywhere
        s, size = pieces.marked(text), draw.choice([1, 2, 5, 9, 20, 33])
        matrices = [model.transfer(s[i : i + size], s[i + size : i + size + model.longest - 1]) for i in range(0, len(s), size)]
        total = matrices[0]
        for m in matrices[1:]:
            total = pieces.combine(total, m)
        assert total[0, 0] == model._forward(s)[-1] == model.score(s)
        ways = pieces.states(matrices, 0, 0)
        ids = b"".join(model.encode(s[i * size + a : min(len(s), (i + 1) * size + b)]) for i, (a, b) in enumerate(ways))
        assert model.decode(np.frombuffer(ids, "<i4")) == text


def test_best_is_best():
    """Against all segmentations of short words."""
    model = pieces.loaded(pieces.model_file())

    def every(word):
        if not word:
            return 0
        return max(model.ids[word[:j]][1] + every(word[j:]) for j in range(1, len(word) + 1) if word[:j] in model.ids)

    for word in ["▁the", "▁nation", "▁blester", "lyer"]:
        assert model.best(word)[1] == every(word)


def test_giants_and_others_round_trip(spark):
    rows = [*EMPTY, (1, prose(1, 900)), (1, prose(1, 900)), (2, "x" * 5000), (None, prose(2, 700))]
    out = pieces.encode(frame(spark, rows).drop("ids"), giant=600, chunk=200)
    out = out.withColumn("back", pieces.decode_column(out["ids"], pieces.model_file())).collect()
    assert sorted(str((r["doc_id"], r["back"])) for r in out) == sorted(str((d, t or "")) for d, t in rows)
    assert {len(r["ids"]) for r in out if not r["text"]} == {0}
