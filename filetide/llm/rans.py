"""Token ids as range-asymmetric-numeral-system blocks (operator 1).

File format, below one folder:

* ``table``: ``token, freq``; frequencies of all tokens of the corpus, scaled to
  sum to ``2**BITS``, at least 1 for each token that occurs. All blocks share it.
* ``blocks``, in folders ``shard=<n>``: shards ascend by ``doc_id``, blocks of a
  shard by ``block``. A block holds up to ``BLOCK`` ids of whole documents or
  parts of them: ``doc_ids`` and ``doc_tokens`` list them, ``first_doc`` numbers
  the first within the shard, ``first_offset`` is how many of its ids stand in
  earlier blocks, ``open_end`` tells that the last one goes on. ``words`` is the
  stream of 32-bit words of ``lanes`` interleaved coders: id ``t`` belongs to
  lane ``t % lanes``. Every ``SEGMENT`` ids ``states`` and ``places`` give the
  coders' states and the place in the stream, so segments decode in parallel;
  ``checks`` has the crc32 of each segment's ids as 32-bit little-endian numbers.

Blocks depend on the table only. Reading verifies every checksum.

Defined results: a null or empty text is its end id alone; a null ``doc_id``
comes first; rows with equal ``doc_id`` follow one another, each a document of
its own; an empty table gives no blocks and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filetide.session import scratch_path

from .common import slices, stored, table, utf8

BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
SEGMENT = 1 << 18
BLOCK = 1 << 20
END = 0
CACHE = 400_000  # splits after which a Python worker forgets those it does not need at the moment


# ---- tokens -----------------------------------------------------------------

SPACE = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # but for blank and line feed


class Encoder:
    """The tokenizer over distinct splits, with a memory of them.

    The tokenizer's own rule cuts a text into splits before it merges bytes. It
    cuts at most two letters of white space between words into single ones, of
    which a last blank joins the word behind it. So a text is its pieces, each
    led by a blank or a line feed, and a piece is cut into splits where letters,
    numbers and other signs meet. Each distinct piece of a batch is cut once,
    and each distinct split merged once by the tokenizer. Texts with longer runs
    of white space, or two such letters at the end, are left to it whole.
    """

    def __init__(self, path: str) -> None:
        import os

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        # The same model over splits, spelled in its byte letters.
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        odd, any_space = f"[{SPACE}]", f"[ \\n{SPACE}]"
        self.risky = rf"{any_space}{{3}}|{any_space}{{2}}\z|\A{odd}"
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        spelled = {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(other)}, 10: 10}
        self.letters = np.array([spelled[b] for b in range(256)], "<u4")  # line feeds part the splits
        # 0 blank or line feed, 1 letter, 2 number, 3 other sign, 4 left to the expression above.
        self.kinds = np.full(1 << 16, 3, np.uint8)
        every = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
        for kind, which in ((1, r"\p{L}"), (2, r"\p{N}"), (4, r"[\s']")):
            self.kinds[[ord(c) for c in regex.findall(which, every)]] = kind
        self.kinds[[10, 32]] = 0
        self.known = pa.array([" ", "\n"])
        self.ids = np.concatenate([np.frombuffer(self._whole(c), "<u4") for c in (" ", "\n")])
        self.sizes = np.ones(2, np.int64)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merge(self, splits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of splits other than a line feed, end to end, and how many each has."""
        ids = [np.zeros(0, "<u4")]
        for a in range(0, len(splits), 500):
            joined = np.frombuffer("\n".join(splits[a : a + 500].to_pylist()).encode(), np.uint8)
            spelled = self.letters[joined].tobytes().decode("utf-32-le")
            ids.append(np.array(self.bare.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(ids)
        # No token reaches over a split, so their bytes tell where each split ends.
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(splits).to_numpy()), "right")
        return ids, np.diff(ends, prepend=0)

    def _cut(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The splits of all pieces, and where those of each piece begin."""
        data, borders = utf8(pieces)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each letter
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        kinds = np.where(points < 1 << 16, self.kinds[np.minimum(points, 0xFFFF)], 4)
        new = np.ones(len(points), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) & (points[:-1] != 32)
        begins = np.zeros(len(data) + 1, bool)
        begins[first[new]] = True
        for i in np.unique(np.searchsorted(borders, first[kinds == 4], "right") - 1).tolist():
            begins[borders[i] : borders[i + 1]] = False
            sizes = [len(p.encode()) for p in self.split.findall(pieces[i].as_py())]
            begins[borders[i] + np.cumsum([0, *sizes[:-1]])] = True
        begins[borders] = True
        at = np.flatnonzero(begins)
        splits = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
        return splits, np.searchsorted(at, borders)

    def _looked_up(self, splits: pa.Array) -> np.ndarray:
        """Places of distinct splits in the memory, which learns those it lacks."""
        if len(self.known) > CACHE:  # of a full memory what is asked for now stays
            stay = np.union1d(pc.index_in(self.known.take(pa.array([0, 1])), self.known).to_numpy(), pc.drop_null(pc.index_in(splits, self.known)).to_numpy())
            self.ids, _ = _laid(self.ids, self.sizes, stay)
            self.known, self.sizes = self.known.take(pa.array(stay)), self.sizes[stay]
        found = pc.index_in(splits, self.known)
        lacking = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        places = found.fill_null(0).to_numpy().astype(np.int64)
        if len(lacking):
            places[lacking] = len(self.known) + np.arange(len(lacking))
            missing = splits.take(pa.array(lacking))
            ids, sizes = self._merge(missing)
            self.known = pa.concat_arrays([self.known, missing])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return places

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Distinct pieces are encoded once for all texts, then laid out text by text."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.risky).to_numpy(zero_copy_only=False)
        led = pc.binary_join_element_wise("\n", texts.filter(pa.array(~whole)), "")
        lists = pc.split_pattern(pc.replace_substring(led, "\n", " \n"), " ")
        borders = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        ids, ends = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if len(coded):
            words = coded.dictionary
            pieces = pc.binary_join_element_wise(pc.if_else(pc.starts_with(words, "\n"), "", " "), words, "")
            splits, begins = self._cut(pieces)
            splits = splits.dictionary_encode()
            places = self._looked_up(splits.dictionary)[splits.indices.to_numpy()]
            blob, filled = _laid(self.ids, self.sizes, places)
            sizes = np.diff(np.concatenate([[0], filled])[begins])
            ids, ends = _laid(blob, sizes, coded.indices.to_numpy())
        ends = np.concatenate([[0], ends])[borders].tolist()
        # Two ids stand for the line feed put before each text and the blank before that.
        laid = iter(zip(ends[:-1], ends[1:]))
        return [np.frombuffer(self._whole(texts[i].as_py()), "<u4") if w else ids[slice(*next(laid))][2:] for i, w in enumerate(whole.tolist())]


def _laid(blob: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of a blob of stretches of these sizes, end to end, and their ends."""
    starts, long = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(long)
    return blob[np.repeat(starts[at] - (ends - long), long) + np.arange(int(long.sum()))], ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


TOKENS = "shard int, block int, first_doc long, first_offset long, open_end boolean, doc_ids array<long>, doc_tokens array<long>, ids binary"


def token_blocks(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Ids in ascending ``doc_id`` order, packed into blocks; ``ids`` are 16-bit numbers where the vocabulary allows."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        shard, number, doc_no = TaskContext.get().partitionId(), 0, 0
        docs_here: list[tuple[int | None, int]] = []
        held: list[np.ndarray] = []
        size, first_doc, first_offset = 0, 0, 0

        def row(open_end: bool) -> pa.RecordBatch:
            ids = np.concatenate(held).astype(kind).tobytes()
            values = [shard, number, first_doc, first_offset, open_end, [d for d, _ in docs_here], [n for _, n in docs_here], ids]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "block", "first_doc", "first_offset", "open_end", "doc_ids", "doc_tokens", "ids"]
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for part in slices(batch, np.diff(utf8(batch.column("text"))[1]), 16 << 20):
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.encode(part.column("text"))):
                    left = np.append(ids, np.uint32(END))
                    done = 0
                    while done < len(left):
                        take = min(len(left) - done, block - size)
                        if not docs_here:
                            first_doc, first_offset = doc_no, done
                        docs_here.append((doc, take))
                        held.append(left[done : done + take])
                        size, done = size + take, done + take
                        if size == block:
                            yield row(done < len(left))
                            number, size, docs_here, held = number + 1, 0, [], []
                    doc_no += 1
        if docs_here:
            yield row(False)

    # The second key deals out rows of one hot doc_id; ties in both are equal rows.
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("body"))
    ordered = keyed.repartitionByRange("doc_id", "body").sortWithinPartitions("doc_id", "body").select("doc_id", "text")
    return ordered.mapInArrow(work, TOKENS)


def _kind(ids: bytes, n: int) -> str:
    return "<u2" if len(ids) == 2 * n else "<u4"


def frequencies(blocks: DataFrame) -> dict[int, int]:
    """Counts of all tokens: one number per word of the vocabulary, whatever the size of the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, ids in zip(batch["n"], batch["ids"]):
                here = np.bincount(np.frombuffer(ids, _kind(ids, n)))
                if len(here) > len(total):
                    here, total = total, here.astype(np.int64)
                total[: len(here)] += here
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"token": seen, "n": total[seen]})

    sized = blocks.select(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), "ids")
    rows = sized.mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def scaled(counts: dict[int, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their frequencies, at least 1 each, that sum to ``2**bits``."""
    tokens = np.array(sorted(counts), np.int64)
    n = np.array([counts[t] for t in tokens.tolist()], float)
    total = 1 << bits
    if len(tokens) > total:
        raise ValueError("more kinds of token than the table has places")
    freq = np.maximum(1, np.floor(n / n.sum() * total)).astype(np.int64) if len(tokens) else np.zeros(0, np.int64)
    while len(freq) and freq.sum() != total:
        gap = total - int(freq.sum())
        if gap > 0:
            freq[n.argmax()] += gap
        else:
            order = np.argsort(-freq, kind="stable")
            for i in order[: max(1, -gap)]:
                if gap == 0:
                    break
                step = min(-gap, max(1, int(freq[i]) // 16), int(freq[i]) - 1)
                freq[i] -= step
                gap += step
    return tokens, freq


class Coder:
    """Both directions for one table."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray) -> None:
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[tokens] = freq
        self.cum[tokens] = np.concatenate([[0], np.cumsum(freq)])[:-1] if len(tokens) else 0
        self.at = np.repeat(tokens, freq).astype(np.uint32)

    def encode(self, ids: np.ndarray, lanes: int = LANES, segment: int = SEGMENT) -> dict:
        n = len(ids)
        while lanes > 1 and lanes * 64 > n:
            lanes //= 2
        x = np.full(lanes, LOW, np.uint64)
        out: list[np.ndarray] = []
        steps = -(-n // lanes)
        per = segment // lanes
        states, emitted, total = [], [], 0
        b, m32 = np.uint64(BITS), np.uint64(32)
        for step in range(steps - 1, -1, -1):
            s = ids[step * lanes : (step + 1) * lanes]
            m = len(s)
            f, here = self.freq[s], x[:m]
            full = here >= (f << np.uint64(63 - BITS))
            if full.any():
                gone = here[full]
                out.append((gone & np.uint64(0xFFFFFFFF)).astype("<u4"))
                total += len(gone)
                here[full] = gone >> m32
            q = here // f
            x[:m] = (q << b) + (here - q * f) + self.cum[s]
            if step % per == 0:
                states.append(x.copy())
                emitted.append(total)
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        places = [total - e for e in emitted[::-1]]
        checks = [zlib.crc32(ids[a : a + segment].astype("<u4").tobytes()) for a in range(0, n, segment)]
        return {"n_tokens": n, "lanes": lanes, "words": words.tobytes(), "states": b"".join(s.astype("<u8").tobytes() for s in states[::-1]), "places": places, "checks": checks}

    def decode(self, n_tokens: int, lanes: int, words: bytes, states: bytes, places: list[int], checks: list[int], segment: int = SEGMENT) -> np.ndarray:
        """All segments side by side; raises where a checksum does not fit."""
        n = n_tokens
        if not n:
            return np.zeros(0, np.uint32)
        stream = np.append(np.frombuffer(words, "<u4").astype(np.uint64), np.zeros(1, np.uint64))
        x = np.frombuffer(states, "<u8").astype(np.uint64).reshape(-1, lanes).copy()
        pos = np.array(places, np.int64)
        sizes = np.minimum(segment, n - np.arange(len(x)) * segment)
        steps = -(-int(sizes.max()) // lanes)
        out = np.zeros((len(x), steps * lanes), np.uint32)
        lane, mask, b = np.arange(lanes), np.uint64((1 << BITS) - 1), np.uint64(BITS)
        for step in range(steps):
            slot = x & mask
            s = self.at[slot]
            moved = self.freq[s] * (x >> b) + slot - self.cum[s]
            live = step * lanes + lane[None, :] < sizes[:, None]
            need = live & (moved < LOW)
            at = pos[:, None] + np.cumsum(need, axis=1) - 1
            fill = (moved << np.uint64(32)) | stream[np.minimum(np.maximum(at, 0), len(stream) - 1)]
            x = np.where(live, np.where(need, fill, moved), x)
            pos += need.sum(axis=1)
            out[:, step * lanes : (step + 1) * lanes] = s
        ids = np.concatenate([row[:k] for row, k in zip(out, sizes)])
        for i, check in enumerate(checks):
            if zlib.crc32(ids[i * segment : (i + 1) * segment].astype("<u4").tobytes()) != check:
                raise ValueError(f"segment {i} does not match its checksum")
        return ids


BLOCKS = (
    "shard int, block int, first_doc long, first_offset long, open_end boolean, doc_ids array<long>, doc_tokens array<long>,"
    " n_tokens long, lanes int, words binary, states binary, places array<long>, checks array<long>"
)


def write(docs: DataFrame, folder: str, path: str, block: int = BLOCK) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) with the tokenizer at ``path`` into ``folder``."""
    spark = docs.sparkSession
    blocks = stored(token_blocks(docs, path, block), "tokens")
    tokens, freq = scaled(frequencies(blocks))
    spark.createDataFrame([(int(t), int(f)) for t, f in zip(tokens, freq)], "token long, freq long").coalesce(1).write.parquet(f"{folder}/table")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(tokens, freq)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                raw, n = row["ids"].iloc[0], int(sum(row["doc_tokens"].iloc[0]))
                made = coder.encode(np.frombuffer(raw, _kind(raw, n)).astype(np.int64))
                yield row.drop(columns="ids").assign(**{k: [v] for k, v in made.items()})

    blocks.mapInPandas(work, BLOCKS).write.option("compression", "uncompressed").partitionBy("shard").parquet(f"{folder}/blocks")


def combine_crc(first: int, second: int, size: int) -> int:
    """crc32 of two texts laid end to end, from the crc32 of each and the second's size."""
    zeros = bytes(min(size, 1 << 20))
    one, none = first, 0
    while size:
        part = zeros[: min(size, len(zeros))]
        one, none, size = zlib.crc32(part, one), zlib.crc32(part, none), size - len(part)
    return one ^ none ^ second


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """One row per block with its ids: ``shard, block, first_doc, first_offset, open_end, doc_ids, doc_tokens, ids array<int>``."""
    coder_of = _reader(spark, folder)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of()
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = coder.decode(r.n_tokens, r.lanes, r.words, r.states, list(r.places), list(r.checks))
                yield pd.DataFrame([{**{k: getattr(r, k) for k in ("shard", "block", "first_doc", "first_offset", "open_end", "doc_ids", "doc_tokens")}, "ids": ids.astype(np.int32)}])

    return _blocks(spark, folder).mapInPandas(work, TOKENS.replace("ids binary", "ids array<int>"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")


def _reader(spark: SparkSession, folder: str):
    rows = spark.read.parquet(f"{folder}/table").orderBy("token").collect()  # at most the vocabulary
    tokens, freq = np.array([r["token"] for r in rows], np.int64), np.array([r["freq"] for r in rows], np.int64)
    return lambda: Coder(tokens, freq)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""
    coder_of = _reader(spark, folder)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of()
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = coder.decode(r.n_tokens, r.lanes, r.words, r.states, list(r.places), list(r.checks)).astype("<u4")
                sizes = np.array(r.doc_tokens, np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                part = np.zeros(len(sizes), bool)
                part[0] |= r.first_offset > 0
                part[-1] |= r.open_end
                yield pd.DataFrame({"shard": r.shard, "block": r.block, "doc_no": r.first_doc + np.arange(len(sizes)), "doc_id": pd.array(list(r.doc_ids), "Int64"), "inside": ends - sizes, "n_tokens": sizes, "ids_crc32": crc, "part": part})

    blocks = _blocks(spark, folder)
    pieces = blocks.mapInPandas(work, "shard int, block int, doc_no long, doc_id long, inside long, n_tokens long, ids_crc32 long, part boolean")
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per shard: a small table for one task.
    shards = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inner = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("block_start")).join(F.broadcast(shards), "shard")
    placed = stored(pieces, "pieces").join(starts.select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("at")), ["shard", "block"])
    placed = placed.withColumn("start", F.col("at") + F.col("inside"))

    def join_parts(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        crc, total = 0, 0
        for c, n in zip(frame["ids_crc32"], frame["n_tokens"]):
            crc, total = combine_crc(crc, int(c), 4 * int(n)), total + int(n)
        return frame.iloc[:1][["doc_id", "start"]].assign(n_tokens=total, ids_crc32=crc)

    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = placed.where("NOT part").select(*columns)
    joined = placed.where("part").groupBy("shard", "doc_no").applyInPandas(join_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return whole.unionByName(joined.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "rans")
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, folder)
