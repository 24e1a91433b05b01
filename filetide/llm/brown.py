"""Language-model scoring with Brown classes (operator 4).

Words are ASCII-lower-cased runs without white space, then one end per text.

* Counts: every word of the training texts is counted.
* Units: the ``EXCHANGED`` most frequent words are units of their own; all other
  words, also unseen ones, are grouped into ``SUFFIXES`` units by their last
  three bytes. So each word has a unit, and there are few of them.
* Exchange clustering of units: they start dealt round; each sweep sums the corpus's
  unit bigrams by class and moves the units, one after the other, to the class
  in which the class bigram likelihood gains most. It ends when that stops rising.
* Exchange of all other words: each word seen at least twice, however rare, leaves the
  class of its unit for the class in which the likelihood gains most by its own bigrams.
  Words move independently of each other, in Spark tasks, by the class counts the units
  ended with; their neighbours have the class of their units meanwhile. A word seen once
  is, with its only place left out, an unseen word; both keep the class of their unit.
* Model: ``p(w | before) = p(class | class before) p(w | class)``. Transitions
  are smoothed with class frequencies. Emissions take an absolute discount off
  every seen word of a class and give it to the class's unseen word, so that the
  probabilities of all seen words and the unseen ones of all classes sum to 1.

Scoring reads counts and classes of the ``HEAD`` most frequent words from a broadcast
of that fixed size; all rarer words are joined with the table of words. Transitions are
counted from the classes all words ended with, on the same coded texts.

Defined results: a null, empty or blank text is one end; repeated rows score
alike; a null ``doc_id`` counts as an empty key (a training row); without
training texts all counts are 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, slices, stored, table, utf8

EXCHANGED = 4_096
SUFFIXES = 1_024
HEAD = 1 << 17
CLASSES = 64
SWEEPS = 6
FLUSH = 400_000  # distinct words counted in a task before they are passed on
PAIRS = 2_000_000  # bigrams gathered in a task before they are passed on
PART = 1 << 20  # bytes of texts worked on at once: a word costs some 150 bytes while it is counted or scored
PULL = 5.0  # weight of class frequencies in a transition
EXTRA = 0.5  # added to the unseen word's share of each class
GROUPS = 512  # words whose gains are worked out at once
UNITS = EXCHANGED + SUFFIXES + 1
END_UNIT = UNITS - 1
END = CLASSES  # class of the ends
TAIL = 255  # in coded texts: the class stands in the table of words


def words_of(text: str | None) -> list[bytes]:
    """``bytes`` methods lower and split exactly the ASCII letters and white space."""
    return (text or "").encode().lower().split()


def suffix_unit(word: bytes) -> int:
    return EXCHANGED + zlib.crc32(word[-3:]) % SUFFIXES


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, np.diff(utf8(batch.column("text"))[1]), PART)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word binary, n)`` over all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for part in _parts(batches):
            for text in part.column("text").to_pylist():
                seen.update(words_of(text))
            if len(seen) > FLUSH:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    return texts.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def unit_bigrams(texts: DataFrame, units: dict[bytes, int]) -> DataFrame:
    """``(u, v, n)``: how often unit ``v`` follows unit ``u``; an end stands before each text."""
    known = texts.sparkSession.sparkContext.broadcast(units)  # EXCHANGED words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        held: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array((code // UNITS).astype(np.int32)), pa.array((code % UNITS).astype(np.int32)), pa.array(n.astype(np.int64))], ["u", "v", "n"])

        for part in _parts(batches):
            seq = [END_UNIT]
            for text in part.column("text").to_pylist():
                seq += [u if (u := get(w)) is not None else suffix_unit(w) for w in words_of(text)]
                seq.append(END_UNIT)
            at = np.array(seq, np.int64)
            held.append(at[:-1] * UNITS + at[1:])
            size += len(at)
            if size > PAIRS:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return texts.select("text").mapInArrow(work, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _neighbours(bigrams: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each unit with the classes before it and after it: units times classes numbers, whatever the corpus."""
    spark = bigrams.sparkSession
    of = F.broadcast(spark.createDataFrame(pd.DataFrame({"unit": np.arange(UNITS, dtype=np.int32), "class": classes.astype(np.int32)})))
    out = []
    for unit, other in (("v", "u"), ("u", "v")):
        rows = bigrams.join(of, F.col(other) == F.col("unit")).groupBy(F.col(unit).alias("x"), "class").agg(F.sum("n").alias("n")).toArrow()
        m = np.zeros((UNITS, CLASSES + 1))
        m[rows["x"].to_numpy(), rows["class"].to_numpy()] = rows["n"].to_numpy()
        out.append(m)
    return out[0], out[1]


def _by_class(m: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.zeros((CLASSES + 1, m.shape[1]))
    np.add.at(out, classes, m)
    return out


def _plogp(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)


def _moved(before: np.ndarray, after: np.ndarray, classes: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One sweep: each unit in turn goes where the likelihood gains most, given the moves before it."""
    classes, counts = classes.copy(), _by_class(after, classes)  # counts[c, d]: class d follows class c
    size = counts.sum(axis=0)
    for w in order:
        old, left, right = classes[w], before[w], after[w]
        counts[:, old] -= left
        counts[old] -= right
        np.maximum(counts, 0, out=counts)
        size[old] -= n[w]
        now = _plogp(counts)
        gain = (_plogp(counts + left[:, None]) - now).sum(axis=0) + (_plogp(counts + right[None, :]) - now).sum(axis=1)
        gain -= 2 * (_plogp(np.maximum(size, 0) + n[w]) - _plogp(size))
        best = int(gain[:CLASSES].argmax())
        classes[w] = best
        counts[:, best] += left
        counts[best] += right
        size[best] += n[w]
    return classes


def exchange(bigrams: DataFrame, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit (ends have the last class to themselves) and the class bigram counts.

    A sweep reads, for each unit, how often it stands after and before each class
    (units times classes numbers); the classes with the best likelihood stay.
    """
    totals = bigrams.groupBy("v").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(UNITS)
    n[totals["v"].to_numpy()] = totals["n"].to_numpy()
    classes = np.full(UNITS, CLASSES, np.int64)
    order = np.argsort(-n[:END_UNIT], kind="stable")
    classes[order] = np.arange(len(order)) % CLASSES
    order = order[n[order] > 0]
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for sweep in range(sweeps + 1):
        before, after = _neighbours(bigrams, classes)
        counts = _by_class(after, classes)
        likelihood = float(_plogp(counts).sum() - 2 * _plogp(counts.sum(axis=0)).sum())
        if best is not None and likelihood <= best[0]:
            break
        best = (likelihood, classes, counts)
        if sweep < sweeps:
            classes = _moved(before, after, classes, n, order)
    return best[1], best[2]


def _binaries(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def neighbours(texts: DataFrame, head: list[bytes], classes: np.ndarray) -> DataFrame:
    """``(word, around)`` of all words that are no unit of their own: the classes before and after each place, two bytes.

    A task sends the places of a word in some ``PAIRS`` tokens as one row.
    """
    known = texts.sparkSession.sparkContext.broadcast((head, classes))  # HEAD words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes = known.value
        at = {w: i for i, w in enumerate(head)}
        get, end, first = at.get, len(head), len(head) + 1
        fixed = np.append(classes[[i if i < EXCHANGED else suffix_unit(w) for i, w in enumerate(head)]], END).astype(np.uint8)
        seq: list[int] = [end]
        own: dict[bytes, int] = {}
        put = own.setdefault

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(own)
            of = np.concatenate([fixed, classes[[suffix_unit(w) for w in words]].astype(np.uint8) if words else np.zeros(0, np.uint8)])
            ids = np.array(seq, np.int64)
            spots = np.flatnonzero((ids >= min(EXCHANGED, end)) & (ids != end))
            spots = spots[np.argsort(ids[spots], kind="stable")]
            if not len(spots):
                return
            cls = of[ids]
            around = np.stack([cls[spots - 1], cls[spots + 1]], axis=1).ravel()
            starts = np.flatnonzero(np.diff(ids[spots], prepend=-1))
            named = [head[i] if i < end else words[i - first] for i in ids[spots[starts]].tolist()]
            yield pa.record_batch([pa.array(named, pa.binary()), _binaries(around, 2 * np.append(starts, len(spots)))], ["word", "around"])

        for part in _parts(batches):
            for text in part.column("text").to_pylist():
                seq += [i if (i := get(w)) is not None else put(w, first + len(own)) for w in words_of(text)]
                seq.append(end)
            if len(seq) > PAIRS:
                yield from rows()
                seq, own = [end], {}
                put = own.setdefault
        yield from rows()

    return texts.select("text").mapInArrow(work, "word binary, around binary")


def best_classes(around: np.ndarray, old: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class in which the likelihood gains most for each word, given all other words' classes.

    ``around[w]`` counts the classes before ``w`` and, behind them, those after it;
    ``pairs`` are the class bigrams with ``w`` in the class ``old[w]``.
    """
    beside = np.concatenate([pairs, pairs.T])[:, :CLASSES]  # by neighbour and own class
    size = pairs.sum(axis=0)[:CLASSES]
    now, size_now = _plogp(beside), _plogp(size)
    word, code = np.nonzero(around)
    n = around[word, code][:, None].astype(float)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    gain = np.add.reduceat(_plogp(beside[code] + n) - now[code], starts)
    total = around.sum(axis=1)[:, None] / 2.0
    gain -= 2 * (_plogp(size + total) - size_now)
    # The class it is in, as it is without the word.
    mine = old[word]
    stay = np.add.reduceat(now[code, mine] - _plogp(np.maximum(beside[code, mine] - n[:, 0], 0)), starts)
    stay -= 2 * (size_now[old] - _plogp(np.maximum(size[old] - total[:, 0], 0)))
    gain[np.arange(len(old)), old] = stay
    return gain.argmax(axis=1)


def moved_words(around: DataFrame, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """``(word, class)`` of every word of ``around``: the rows of a word come one after the other."""
    known = around.sparkSession.sparkContext.broadcast((classes, pairs))  # units and classes
    width = CLASSES + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pairs = known.value
        words: list[bytes] = []
        sums = np.zeros((GROUPS + 1, 2 * width), np.int64)

        def rows() -> pa.RecordBatch:
            old = classes[[suffix_unit(w) for w in words]]
            best = best_classes(sums[: len(words)], old, pairs)
            best = np.where(sums[: len(words)].sum(axis=1) == 2, old, best)  # seen once: no bigram but the one left out
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(best.astype(np.int32))], ["word", "class"])

        for batch in batches:
            named = batch.column("word").to_pylist()
            data, borders = utf8(batch.column("around"))
            fresh = np.array([w != v for w, v in zip(named, [words[-1] if words else None, *named])])
            at = np.cumsum(fresh)  # 0: the last word of the batch before
            for block in range(0, int(at[-1]) + 1, GROUPS):
                inside = np.flatnonzero((at >= block) & (at < block + GROUPS))
                if not len(inside):
                    continue
                begins, ends = inside[0], inside[-1] + 1
                if block or fresh[begins]:
                    if words:
                        yield rows()
                    base = int(at[begins])
                    words, sums = [], np.zeros((GROUPS + 1, 2 * width), np.int64)
                else:
                    base = 0
                    if len(words) > 1:  # all but the last are whole
                        last, kept = words[-1:], sums[len(words) - 1].copy()
                        words = words[:-1]
                        yield rows()
                        words, sums = last, np.zeros((GROUPS + 1, 2 * width), np.int64)
                        sums[0] = kept
                words = words + [named[i] for i in range(begins, ends) if fresh[i]]
                places = data[borders[begins] : borders[ends]].reshape(-1, 2).astype(np.int64)
                of = np.repeat(at[begins:ends] - base, np.diff(borders[begins : ends + 1]) // 2) * 2 * width
                cells = np.concatenate([of + places[:, 0], of + width + places[:, 1]])
                sums += np.bincount(cells, minlength=sums.size).reshape(sums.shape)
        if words:
            yield rows()

    return around.repartition("word").sortWithinPartitions("word").mapInArrow(work, "word binary, class int")


class Words:
    """Counts and classes of the ``HEAD`` words, and what the classes emit."""

    def __init__(self, head: list[tuple[bytes, int]], class_of: list[int], units: np.ndarray, size: np.ndarray, types: np.ndarray, ends: int, discount: float, tokens: int, kinds: int) -> None:
        self.at: dict[bytes | None, int] = {w: i for i, (w, _) in enumerate(head)}
        self.at[None] = len(head)
        self.count = np.array([n for _, n in head] + [ends], np.int64)
        self.unit_class = units
        self.class_of = np.array([*class_of, END], np.int64)
        self.size = size
        self.room = np.log10(size + EXTRA)  # denominator of a class's emissions
        self.unseen = np.log10(discount * types + EXTRA)
        self.discount, self.tokens, self.kinds = discount, tokens, kinds
        self.base_room = np.log10(tokens + 0.5 * (kinds + 1))
        shown = np.maximum(self.count - discount, 1e-9)
        self.emit = np.where(self.count > 0, np.log10(shown), self.unseen[self.class_of]) - self.room[self.class_of]
        self.base = np.log10(self.count + 0.5) - self.base_room


class Model(Words):
    """Words and the transitions between classes: everything scoring needs but the rarer words."""

    def __init__(self, words: Words, pairs: np.ndarray) -> None:
        self.__dict__.update(words.__dict__)
        share = (self.size + 0.5) / (self.size.sum() + 0.5 * len(self.size))
        self.step = np.log10((pairs + PULL * share[None, :]) / (pairs.sum(axis=1, keepdims=True) + PULL))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``, in order of count.

    A histogram of counts (at most some 16,000 steps) gives the count from which
    they fit, so no task gathers candidates of all others.
    """
    step = F.floor(F.log2("n") * 256).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).toArrow().to_pydict()
    total, least = 0, None
    for at, words in sorted(zip(sizes["step"], sizes["words"]), reverse=True):
        total += words
        if total > most:
            break
        least = at
    if least is None:
        return []
    rows = counts.where(step >= least).toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist()), key=lambda r: (-r[1], r[0]))


def learned(texts: DataFrame) -> tuple[Words, DataFrame]:
    """Classes and counts of the words of ``texts``: of the most frequent, and ``(word, n, class)`` of all."""
    spark = texts.sparkSession
    counts = stored(word_counts(texts), "counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    ends = texts.count()
    head = frequent(counts, HEAD)
    own = [w for w, _ in head[:EXCHANGED]]
    classes, pairs = exchange(stored(unit_bigrams(texts, {w: i for i, w in enumerate(own)}), "bigrams"))
    fixed = spark.createDataFrame(pd.DataFrame({"word": own, "class": classes[: len(own)].astype(np.int32)}), "word binary, class int")
    moved = moved_words(neighbours(texts, [w for w, _ in head], classes), classes, pairs)
    words = stored(counts.join(moved.unionByName(fixed), "word"), "words")
    size, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        size[r["class"]], types[r["class"]] = r["n"], r["types"]
    size[END], types[END] = ends, ends > 0
    rows = words.where(F.col("n") >= (head[-1][1] if head else 1)).toArrow()  # the words of ``head``
    of = dict(zip(rows["word"].to_pylist(), rows["class"].to_pylist()))
    once, twice = sums["once"] or 0, sums["twice"] or 0
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    return Words(head, [of[w] for w, _ in head], classes, size, types, ends, discount, (sums["n"] or 0) + ends, sums["v"] + (ends > 0)), words


def coded(docs: DataFrame, model: Words, words: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, emitted, classes)`` and ``keep`` of every row of ``docs``, written.

    ``classes`` has a byte per token; ``emitted`` lacks the transitions of the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # HEAD words and class tables

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        get, end = m.at.get, m.at[None]
        for part in _parts(batches):
            per_doc = [words_of(t) for t in part.column("text").to_pylist()]
            at = np.array([i for ws in per_doc for i in (*[get(w, -1) for w in ws], end)], np.int64)
            sizes = np.array([len(ws) + 1 for ws in per_doc], np.int64)
            borders = np.concatenate([[0], np.cumsum(sizes)])
            begins = borders[:-1]
            rare = at < 0
            owner = np.repeat(np.arange(len(sizes)), sizes)
            spots = np.flatnonzero(rare)
            places = spots - begins[owner[spots]]
            names = [per_doc[d][i] for d, i in zip(owner[spots].tolist(), places.tolist())]
            units = m.unit_class[[suffix_unit(w) for w in names]] if names else np.zeros(0)
            sums = [np.add.reduceat(np.where(rare, 0, x[at]), begins) for x in ((m.count > 0).astype(np.int64), m.base, m.emit)]
            tails = np.concatenate([[0], np.cumsum(np.bincount(owner[spots], minlength=len(sizes)))]).astype(np.int32)
            tail = pa.StructArray.from_arrays([pa.array(places.astype(np.int32)), pa.array(names, pa.binary()), pa.array(units.astype(np.int32))], ["place", "word", "unit"])
            yield pa.record_batch(
                [*[part.column(c) for c in ("doc_id", *keep)], pa.array(sizes), *map(pa.array, sums), _binaries(np.where(rare, TAIL, m.class_of[at]).astype(np.uint8), borders), pa.ListArray.from_arrays(pa.array(tails), tail)],
                ["doc_id", *keep, "n_tokens", "n_known", "base_score", "emitted", "classes", "tail"],
            )

    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"doc_id long, {kept}n_tokens long, n_known long, base_score double, emitted double, classes binary, tail array<struct<place: int, word: binary, unit: int>>"
    rows = docs.select(F.col("doc_id").cast("long"), *keep, "text").mapInArrow(work, schema)
    # Row numbers are read back from the written table, so they never change.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "coded")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    n, cls = F.coalesce("n", F.lit(0)), F.coalesce("class", "unit")
    pick = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), cls)
    emit = F.when(n > 0, F.log10(F.greatest(n - F.lit(model.discount), F.lit(1e-9)))).otherwise(pick(model.unseen)) - pick(model.room)
    found = tail.join(words, "word", "left").groupBy("row").agg(
        F.count_if(n > 0).alias("tail_known"), F.sum(F.log10(n + 0.5) - F.lit(float(model.base_room))).alias("tail_base"), F.sum(emit).alias("tail_emitted"),
        F.collect_list(F.struct("place", cls.cast("int").alias("class"))).alias("places"),
    )
    joined = rows.drop("tail").join(found, "row", "left")
    total = {a: F.col(a) + F.coalesce(b, F.lit(0)) for a, b in (("n_known", "tail_known"), ("base_score", "tail_base"), ("emitted", "tail_emitted"))}
    return stored(joined.select("doc_id", *keep, "n_tokens", *[v.alias(k) for k, v in total.items()], "classes", "places"), "classed")


def _steps(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before and class of every token of a coded batch, and the begins of its rows."""
    data, borders = utf8(batch.column("classes"))
    cls, places = data.astype(np.int64), batch.column("places")
    if isinstance(places, pa.ChunkedArray):
        places = places.combine_chunks()
    flat = places.flatten()  # without the lists that are null
    lengths = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cls[np.repeat(borders[:-1], lengths) + flat.field("place").to_numpy().astype(np.int64)] = flat.field("class").to_numpy()
    before = np.concatenate([[END], cls[:-1]])  # a text ends before the next
    return before, cls, borders[:-1]


def transitions(rows: DataFrame) -> np.ndarray:
    """How often each class follows each, over coded rows."""
    width = CLASSES + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            if batch.num_rows:
                before, cls, _ = _steps(batch)
                total += np.bincount(before * width + cls, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    pairs = np.zeros(width * width)
    for r in rows.select("classes", "places").mapInArrow(work, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    return pairs.reshape(width, width)


def finished(rows: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` and ``keep`` of coded rows."""
    step = model.step

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                before, cls, begins = _steps(batch)
                score = np.add.reduceat(step[before, cls], begins) + batch.column("emitted").to_numpy()
                names = ["doc_id", *keep, "n_tokens", "n_known", "base_score"]
                yield pa.record_batch([*map(batch.column, names), pa.array(score)], [*names, "score"])

    kept = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(work, f"doc_id long, {kept}n_tokens long, n_known long, base_score double, score double")


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of ``texts`` and the table of all its words."""
    known, words = learned(texts)
    return Model(known, transitions(coded(texts.select(F.lit(None).alias("doc_id"), "text"), known, words))), words


def scored(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` of every row of ``docs`` (``doc_id``, ``text``)."""
    return finished(coded(docs, model, words), model)


def held_out(key: Column) -> Column:
    return remainder(key, 5) == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    known, words = learned(docs.where(~F.col("held_out")))
    rows = coded(docs, known, words, ("held_out",))  # once for the transitions and the scores
    model = Model(known, transitions(rows.where(~F.col("held_out"))))
    return finished(rows, model, ("held_out",)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
