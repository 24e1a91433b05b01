"""SentencePiece encoding and decoding by a max-plus parallel scan (operator 5).

The vocabulary and its scores come from a model file. A text is encoded as the
segmentation with the greatest sum of scores; a character no piece covers falls
back to byte pieces. Scores are whole numbers, so sums do not depend on order.

A giant text is cut into chunks of ``CHUNK`` characters wherever the cut falls.
A piece may cross a cut by fewer characters than the longest piece has, ``K``.
For each chunk a ``K x K`` transfer matrix says, in max-plus algebra, what the
best segmentation is worth from ``a`` characters after its start to ``b``
characters after its end. Matrices combine associatively, in spans of ``SPAN``
chunks and then along the text; that fixes ``(a, b)`` of every chunk, and each
chunk is then encoded on its own.

Decoding joins the pieces and is exact for every text: a blank is written as the
blank sign, and a blank sign that stands in the text itself goes by its bytes.

Defined results: null and empty texts have no ids and decode to an empty text;
repeated rows get equal ids; all other columns stay. The model file given here
holds merge ranks as scores; this operator maximises their sum, it does not
replay merges, so ids differ from those of greedy merging.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

BLANK = "▁"
LITERAL = "\udc81"  # stands for a blank sign of the text itself; no text can hold a lone surrogate
CHUNK = 16_384
GIANT = 4 * CHUNK
SPAN = 256
CACHE = 200_000  # words in each of two generations that a Python worker remembers
NEVER = -(1 << 60)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary with the best segmentation of single strings."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scale = 1 if all(float(model.get_score(i)).is_integer() for i in plain) else 1 << 20
        self.ids = {model.id_to_piece(i): (i, round(model.get_score(i) * scale)) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.penalty = min(s for _, s in self.ids.values()) - 10 * scale
        self.texts = [b""] * n
        for piece, (i, _) in self.ids.items():
            self.texts[i] = piece.replace(BLANK, " ").encode()
        for value, i in self.bytes.items():
            self.texts[i] = bytes([value])
        # A cut is certain before a blank sign that follows another character, unless a piece crosses one; and around
        # a line end, unless a piece holds one.
        crosses = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        lines = any("\n" in p for p in self.ids)
        self.words = re.compile("(?s).+" if crosses or lines else f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
        # A tree of the pieces by character: the branches below, and id and score of the piece that ends there (id -1: none does).
        self.tree: dict[str, list] = {}
        for piece, (i, score) in self.ids.items():
            branch = self.tree
            for character in piece:
                node = branch.setdefault(character, [{}, -1, 0])
                branch = node[0]
            node[1:] = i, score
        self.known = _Known(self)

    def _values(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """Best score up to each place, and the start and id of its last piece (-1: byte pieces)."""
        n, tree, penalty, ids = len(word), self.tree, self.penalty, self.ids
        value, start, last = [0] + [NEVER] * n, [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            here, branch, j = value[i], tree, i
            while j < n:
                node = branch.get(word[j])
                if node is None:
                    break
                j += 1
                branch, piece, score = node
                if piece >= 0 and here + score > value[j]:
                    value[j], start[j], last[j] = here + score, i, piece
            if here + penalty > value[i + 1] and word[i] not in ids:
                value[i + 1], start[i + 1], last[i + 1] = here + penalty, i, -1
        return value, start, last

    def best(self, word: str) -> tuple[bytes, int]:
        """Ids (32-bit little-endian) and score of the best segmentation; of equals, the one with longer last pieces."""
        value, start, last = self._values(word)
        out: list[int] = []
        j = len(word)
        while j:
            i = start[j]
            if last[j] >= 0:
                out.append(last[j])
            else:
                raw = (BLANK if word[i] == LITERAL else word[i]).encode()
                out.extend(self.bytes[x] for x in reversed(raw))
            j = i
        return struct.pack(f"<{len(out)}i", *out[::-1]), value[len(word)]

    def encode(self, marked: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.words.findall(marked)))

    def score(self, marked: str) -> int:
        return sum(self._values(w)[0][-1] for w in self.words.findall(marked))

    def decode(self, ids: np.ndarray) -> str:
        joined = b"".join([self.texts[i] for i in ids.tolist()])
        return joined[1:].decode("utf-8", "replace")

    def transfer(self, chunk: str, ahead: str) -> np.ndarray:
        """Scores from ``a`` after the start to ``b`` after the end of ``chunk``; ``ahead`` is what follows it."""
        k, n = self.longest, len(chunk)
        out = np.full((k, k), NEVER, np.int64)
        whole = chunk + ahead
        cuts = [m.start() for m in self.words.finditer(whole)]
        inner = [c for c in cuts if k <= c <= n]
        reach = min(k, len(ahead) + 1)
        if inner:
            first, last = inner[0], inner[-1]
            head = np.array([self.score(whole[a:first]) for a in range(k)])
            tail = np.array([self.score(whole[last : n + b]) for b in range(reach)])
            out[:, :reach] = head[:, None] + self.score(whole[first:last]) + tail[None, :]
            return out
        for a in range(min(k, n + reach)):
            value = self._forward(whole[a:])
            for b in range(reach):
                if n + b >= a:
                    out[a, b] = value[n + b - a]
        return out

    def _forward(self, text: str) -> list[int]:
        return self._values(text)[0]


class _Known(dict):
    """Ids of words met lately. When it is full, the words of the generation before are given up."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces, self.older = pieces, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.pieces.best(word)[0]
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    """The text with a blank in front and blanks as blank signs; empty stays empty."""
    return BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK) if text else ""


def combine(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Max-plus product: associative, so spans can be combined in any grouping."""
    return np.maximum((one[:, :, None] + two[None, :, :]).max(axis=1), NEVER)


def states(matrices: list[np.ndarray], enter: int, leave: int) -> list[tuple[int, int]]:
    """The ``(a, b)`` of each chunk on the best way from ``enter`` to ``leave``."""
    value, ways = np.full(len(matrices[0]), NEVER, np.int64), []
    value[enter] = 0
    for m in matrices:
        total = value[:, None] + m
        ways.append(total.argmax(axis=0))
        value = np.maximum(total.max(axis=0), NEVER)
    out, b = [], leave
    for way in reversed(ways):
        a = int(way[b])
        out.append((a, b))
        b = a
    return out[::-1]


def _id_lists(raw: list[bytes]) -> pa.ListArray:
    sizes = np.array([len(x) // 4 for x in raw], np.int64)
    borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode_column(text: Column, path: str) -> Column:
    """Ids of each text in one piece of work; for giants use ``encode``."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = loaded(path)
        for texts in batches:
            raw = [pieces.encode(marked(t or "")) for a in range(0, len(texts), 256) for t in texts.slice(a, 256).to_pylist()]
            yield _id_lists(raw)

    return ids(text)


def decode_column(ids: Column, path: str) -> Column:
    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = loaded(path)
        for lists in batches:
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(sizes)
            yield pa.array([pieces.decode(flat[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist())], pa.string())

    return text(ids)


def encode_giants(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``(doc, body, ids)`` of ``(doc, body, text)`` rows, each text cut into chunks worked on apart."""
    k = loaded(path).longest
    texts = docs.dropDuplicates(["doc", "body"])
    # One row per chunk, dealt out anew so that one giant keeps many tasks busy.
    n = F.length("text") + 1
    cut = texts.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))))
    piece = F.expr(f"substring(concat(' ', text), at * {chunk} + 1, {chunk + k - 1})")
    chunks = stored(cut.select("doc", "body", "at", piece.alias("piece"), (F.col("at") == F.floor((n - 1) / chunk)).alias("last")).repartition("doc", "body", "at"), "chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(path)
        for batch in batches:
            found = []
            for text in batch["piece"]:
                text = text.replace(BLANK, LITERAL).replace(" ", BLANK)
                found.append(pieces.transfer(text[:chunk], text[chunk:]).tobytes())
            yield batch[["doc", "body", "at"]].assign(m=found)

    transfers = stored(chunks.mapInPandas(matrices, "doc long, body long, at int, m binary").withColumn("span", F.floor(F.col("at") / SPAN).cast("int")), "transfers")

    def read(raw: pd.Series) -> list[np.ndarray]:
        return [np.frombuffer(x, np.int64).reshape(k, k) for x in raw]

    def span_product(frame: pd.DataFrame) -> pd.DataFrame:
        ms = read(frame.sort_values("at")["m"])
        total = ms[0]
        for m in ms[1:]:
            total = combine(total, m)
        return frame.iloc[:1][["doc", "body", "span"]].assign(m=total.tobytes())

    def along(frame: pd.DataFrame, name: str) -> pd.DataFrame:
        frame = frame.sort_values(name)
        ab = states(read(frame["m"]), int(frame["enter"].iloc[0]), int(frame["leave"].iloc[0]))
        return frame[["doc", "body", name]].assign(a=[x for x, _ in ab], b=[x for _, x in ab])

    spans = transfers.groupBy("doc", "body", "span").applyInPandas(span_product, "doc long, body long, span int, m binary")
    ends = F.lit(0).alias("enter"), F.lit(0).alias("leave")
    whole = spans.select("*", *ends).groupBy("doc", "body").applyInPandas(lambda f: along(f, "span"), "doc long, body long, span int, a int, b int")
    inside = transfers.join(whole.withColumnsRenamed({"a": "enter", "b": "leave"}), ["doc", "body", "span"])
    ways = inside.groupBy("doc", "body", "span").applyInPandas(lambda f: along(f, "at"), "doc long, body long, at int, a int, b int")

    def backtrace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(path)
        for batch in batches:
            ids = []
            for text, a, b, last in zip(batch["piece"], batch["a"], batch["b"], batch["last"]):
                text = text.replace(BLANK, LITERAL).replace(" ", BLANK)
                end = len(text) if last else chunk + b
                ids.append(np.frombuffer(pieces.encode(text[a:end]), "<i4"))
            yield batch[["doc", "body", "at"]].assign(ids=ids)

    parts = chunks.join(ways, ["doc", "body", "at"]).mapInPandas(backtrace, "doc long, body long, at int, ids array<int>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"]))
    return parts.groupBy("doc", "body").agg(joined.alias("ids"))


def encode(docs: DataFrame, path: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``ids``; texts longer than ``giant`` characters go through the scan."""
    path = path or model_file()
    size = F.coalesce(F.length("text"), F.lit(0))
    small = docs.where(size <= giant)
    small = small.withColumn("ids", encode_column(F.col("text"), path))
    # Rows with a null key keep theirs: -1 and a hash of the text tell texts apart.
    doc, body = fresh("doc"), fresh("body")
    large = docs.where(size > giant).withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(body, F.xxhash64("text"))
    found = encode_giants(large.select(F.col(doc).alias("doc"), F.col(body).alias("body"), "text"), path, chunk)
    found = found.select(F.col("doc").alias(doc), F.col("body").alias(body), "ids")
    return small.unionByName(large.drop("ids").join(found, [doc, body]).drop(doc, body))


def small_batches(spark: SparkSession) -> None:
    """Id lists are several times as large as texts: fewer rows travel to a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = model_file()
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    same = decode_column(F.col("ids"), path) == F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), same.alias("round_trip"), "ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts in a column ``ids``."""
    small_batches(spark)
    return encode(docs)
