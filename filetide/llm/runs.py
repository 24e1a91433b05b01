"""Periodic runs of words by suffix trees (operator 11).

A run is a stretch of consecutive words that repeats itself with smallest
period q at least ``repeats`` times, holds at least ``least`` words, and cannot be
extended by a neighbouring word.

Method: words become numbers. Words that occur fewer than ``repeats`` times in
their stretch of a document lie in no run, so documents are cut there until
nothing changes; only the stretches left go on. For each, Ukkonen's suffix tree
of the stretch and of its reversal are built; an Euler tour of each tree with a
table of range minima answers, in constant time, how far two places agree to the
right and to the left (the depth of the lowest common ancestor of two leaves).
Every run has a Lyndon root under the order of the words or under the reversed
order: the longest Lyndon word at each place under either order, read off the
ranks of the suffixes, is a candidate period, extended both ways by those
queries. So all runs are found among two candidates a place, in linear time.

A document is worked on whole, in one row: nothing is shuffled. Memory is about
600 bytes for each word of a stretch that is left, so some 2 million such words
of one document fit a Python worker of 1.2 GB. Short stretches of several documents share a tree.

Defined results: a null or blank text has no words, no run and an empty collapsed
text; repeated rows get equal results; runs come by start, then period; columns
of the input are carried through, but for those named ``runs`` and ``collapsed``,
which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, fresh, let, slices, table, utf8

LEAST, REPEATS = 6, 4
TOGETHER = 1 << 15  # words of short stretches that share a tree
SLICE = 4 << 20  # bytes of text worked on at a time
RUNS = "array<struct<start:long,length:long,period:long>>"


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers below ``width`` whose last one occurs nowhere else.

    ``go`` maps ``node * width + symbol`` to the child, ``start`` and ``stop`` are
    the borders of the edge into a node, ``depth`` counts the symbols from the root
    to it, and ``leaves`` holds the leaf of each suffix.
    """

    def __init__(self, s: list[int], width: int):
        n = len(s)
        start, stop, link, depth, leaves, go = [0], [0], [0], [0], [], {}
        node = edge = length = left = 0
        for i, c in enumerate(s):
            left += 1
            open_node = 0
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    stop.append(n)
                    depth.append(n - i + left - 1)
                    link.append(0)
                    if open_node:
                        link[open_node] = node
                        open_node = 0
                else:
                    a = start[child]
                    size = stop[child] - a
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[a + length] == c:
                        length += 1
                        if open_node:
                            link[open_node] = node
                        break
                    middle = len(start)
                    go[key] = middle
                    go[middle * width + s[a + length]] = child
                    go[middle * width + c] = middle + 1
                    leaves.append(middle + 1)
                    start += (a, i)
                    stop += (a + length, n)
                    # The part of the suffix that was there already ends at the new node.
                    depth += (left - 1, n - i + left - 1)
                    link += (0, 0)
                    start[child] = a + length
                    if open_node:
                        link[open_node] = middle
                    open_node = middle
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.depth, self.leaves = np.array(depth, np.int32), np.array(leaves)
        parent, symbol = np.divmod(np.fromiter(go.keys(), np.int64, len(go)), width)
        ends = np.fromiter(go.values(), np.int64, len(go))
        by = np.lexsort((symbol, parent))
        self.kids, self.border = ends[by], np.searchsorted(parent[by], np.arange(len(depth) + 1))
        self.parent = np.zeros(len(depth), np.int64)
        self.parent[ends] = parent

    def tour(self) -> tuple[np.ndarray, Agreement]:
        """Rank of every suffix, and the agreement of suffixes read off the Euler tour.

        Of the tour, the visits that return to a node before its next child is
        entered are kept: one for each child, with the depth of the node.
        """
        kids, border, seen, stack = self.kids[::-1].tolist(), (len(self.kids) - self.border).tolist(), [], [0]
        while stack:
            node = stack.pop()
            seen.append(node)
            a, b = border[node + 1], border[node]
            if a < b:
                stack += kids[a:b]
        place = np.empty(len(seen), np.int64)
        place[seen] = np.arange(len(seen))
        first = place[self.leaves]
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        return rank, Agreement(self.depth[self.parent[seen]], first)


class Agreement:
    """How many symbols two suffixes share: the depth of their lowest common ancestor, the least of the tour between their leaves.

    Minima of blocks of ``BLOCK`` places are held for every power of two of
    blocks, minima from a block's borders inside it; what lies within one block is
    read place by place, at most ``BLOCK`` of them.
    """

    BLOCK = 16

    def __init__(self, tour: np.ndarray, first: np.ndarray):
        self.first, b = first, self.BLOCK
        padded = np.full(-(-len(tour) // b) * b, np.iinfo(np.int32).max, np.int32)
        padded[: len(tour)] = tour
        self.tour, grid = padded, padded.reshape(-1, b)
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= len(grid):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        b = self.BLOCK
        a, z = self.first[i], self.first[j]
        a, z = np.minimum(a, z) + 1, np.maximum(a, z)
        out = np.minimum(self.behind[a], self.ahead[z])
        lo, hi = a // b + 1, z // b
        inner = np.flatnonzero(lo < hi)
        span = hi[inner] - lo[inner]
        level = np.frexp(span)[1] - 1
        for k in np.unique(level):
            these = inner[level == k]
            row = self.levels[k]
            out[these] = np.minimum(out[these], np.minimum(row[lo[these]], row[hi[these] - (1 << int(k))]))
        same = np.flatnonzero(lo > hi)
        if len(same):
            best = np.full(len(same), np.iinfo(np.int32).max, np.int32)
            for k in range(b):
                at = a[same] + k
                best = np.minimum(best, np.where(at <= z[same], self.tour[np.minimum(at, z[same])], best))
            out[same] = best
        return out.astype(np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place whose suffix ranks lower: the longest Lyndon word at a place ends there."""
    r, out, stack = rank.tolist(), [0] * len(rank), []
    for i in range(len(r) - 1, -1, -1):
        mine = r[i]
        while stack and r[stack[-1]] > mine:
            stack.pop()
        out[i] = stack[-1] if stack else len(r)
        stack.append(i)
    return np.array(out, np.int64)


def tree_runs(parts: list[np.ndarray], least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (place, length, period) of all runs of stretches laid end to end, each followed by one separator."""
    words = np.concatenate(parts)
    distinct, ids = np.unique(words, return_inverse=True)
    m, width = len(parts), len(parts) + len(distinct)
    # Separators are all different, and smaller than every word.
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    s = np.empty(len(words) + m, np.int64)
    is_word = np.ones(len(s), bool)
    is_word[ends] = False
    s[ends], s[is_word] = np.arange(m), ids + m
    rank, right = SuffixTree(s.tolist(), width).tour()
    # The separator at the end stays at the end of the reversal, so that this too ends in a symbol of its own.
    _, left = SuffixTree(np.append(s[-2::-1], s[-1]).tolist(), width).tour()
    n, found = len(s), []
    # The reversed order ranks suffixes the other way round, separators included.
    for ranks in (rank, -rank):
        stop = next_smaller(ranks)
        at = np.flatnonzero(is_word & (stop < n))
        period = stop[at] - at
        ahead = right(at, at + period)
        back = np.zeros(len(at), np.int64)
        inside = at > 0
        back[inside] = left(n - 1 - at[inside], n - 1 - (at + period)[inside])
        length = back + period + ahead
        good = length >= np.maximum(least, repeats * period)
        found.append(np.column_stack([at - back, length, period])[good])
    return np.unique(np.concatenate(found), axis=0)


def stretches(ids: np.ndarray, owner: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that may lie in a run, and the number of the stretch of each: every word of a run occurs ``repeats`` times in it."""
    at, part = np.arange(len(ids)), owner
    while len(at):
        by = np.lexsort((part, ids[at]))
        word, where = ids[at][by], part[by]
        fresh_one = np.ones(len(by), bool)
        fresh_one[1:] = (word[1:] != word[:-1]) | (where[1:] != where[:-1])
        group = np.cumsum(fresh_one) - 1
        often = np.empty(len(by), bool)
        often[by] = np.bincount(group)[group] >= repeats
        kept, owners = at[often], part[often]
        border = np.ones(len(kept), bool)
        border[1:] = (np.diff(kept) != 1) | (owners[1:] != owners[:-1])
        number = np.cumsum(border) - 1
        long_enough = np.bincount(number, minlength=1)[number] >= least if len(kept) else border
        kept, number = kept[long_enough], number[long_enough]
        if len(kept) == len(at):
            return kept, number
        at, part = kept, number
    return at, part


def find_runs(ids: np.ndarray, owner: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (owner, place in all, length, period) of all runs of texts laid end to end."""
    at, part = stretches(ids, owner, least, repeats)
    if not len(at):
        return np.zeros((0, 4), np.int64)
    border = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    sizes = np.diff(np.append(border, len(at)))
    batch, total = np.empty(len(sizes), np.int64), 0
    for k, size in enumerate(sizes.tolist()):
        # A new tree begins where a stretch would overfill the last; a longer stretch stays whole.
        total = total + size if k and total + size <= TOGETHER else size
        batch[k] = batch[k - 1] + (total == size) if k else 0
    out = []
    for b in range(int(batch[-1]) + 1):
        mine = np.flatnonzero(batch == b)
        begins = np.concatenate([[0], np.cumsum(sizes[mine] + 1)])
        rows = tree_runs([ids[at[border[k] : border[k] + sizes[k]]] for k in mine], least, repeats)
        k = np.searchsorted(begins, rows[:, 0], "right") - 1
        place = at[border[mine[k]]] + rows[:, 0] - begins[k]
        out.append(np.column_stack([owner[place], place, rows[:, 1], rows[:, 2]]))
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 3], rows[:, 1]))]


def _worked(batch: pa.RecordBatch, column: str, least: int, repeats: int) -> pa.RecordBatch:
    """The batch with its runs and collapsed texts."""
    data, borders = utf8(batch.column(column))
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    texts = [raw[a:z].split() for a, z in zip(borders[:-1].tolist(), borders[1:].tolist())]
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    counts = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    rows = find_runs(ids, np.repeat(np.arange(len(texts)), counts), least, repeats)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, rows[:, 1] + rows[:, 3], 1)
    np.add.at(change, rows[:, 1] + rows[:, 2], -1)
    kept = np.cumsum(change[:-1]) == 0
    collapsed = [
        b" ".join(t if kept[a:z].all() else [w for w, k in zip(t, kept[a:z].tolist()) if k])
        for t, a, z in zip(texts, first[:-1].tolist(), first[1:].tolist())
    ]
    struct = pa.StructArray.from_arrays(
        [pa.array(rows[:, 1] - first[rows[:, 0]], pa.int64()), pa.array(rows[:, 2], pa.int64()), pa.array(rows[:, 3], pa.int64())],
        ["start", "length", "period"],
    )
    offsets = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
    return pa.RecordBatch.from_arrays(
        [*batch.columns, runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "runs", "collapsed"]
    )


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words) and ``collapsed``, the text without repeats of a period.

    A word is left out of ``collapsed`` if some run contains it after that run's
    first period; kept words are joined by one blank.
    """
    # The text travels under a name of its own, for it may itself be called like a result.
    name = fresh("text")
    carried = docs.withColumn(name, F.col(text).cast("string")).drop("runs", "collapsed")
    schema = T.StructType([*carried.schema.fields, *T._parse_datatype_string(f"runs {RUNS}, collapsed string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(utf8(batch.column(name))[1])
            for part in slices(batch, sizes, SLICE):
                yield _worked(part, name, least, repeats)

    return carried.mapInArrow(work, schema).drop(name)


def planted(key: Column, text: Column) -> Column:
    """The text, with a periodic ending in the tenth of documents that the crc32 of their key picks.

    A null key picks nothing.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        ends = let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda e: F.transform(
            places, lambda i: F.get(e["w"], F.when(i < e["a"], i).otherwise(e["a"] + F.pmod(i - e["a"], e["p"])).cast("int"))))
        return F.when(n > 0, F.array_join(ends, " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, repeated)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    # Runs come by start, then period: a strictly greater exponent alone takes the lead.
    best = F.aggregate(
        "runs", F.expr("cast(null as struct<start:long,length:long,period:long>)"),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    runs_text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), let(best, lambda b: b).alias("best"),
        F.sha2(runs_text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
