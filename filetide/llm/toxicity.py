"""Toxicity from a weighted lexicon (operator 10).

Texts are folded (case, accents, look-alike letters, digits standing for
letters), an Aho-Corasick automaton finds every lexicon term at the start of a
word, hits inside exception phrases are dropped, and the weights of the rest are
summed and divided by the square root of the number of words. Two parameters
turn that into a probability.

Terms and weights are learned from labelled rows: whole words and word
beginnings, so that a family of derived words needs one entry.

Defined results: a null or empty text has no hit and scores like one; repeated
rows score alike; without labels of both kinds there is no lexicon and every
text scores the share of toxic labels (0.5 of one row added to each kind).
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, remainder, stored, table

# Characters read as the letter they look like. l, 1 and | share one class.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ß": "ss",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i",
}
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof", "pond scum", "sore loser rule",
    "worthless check", "pathetic fallacy",
)
SAMPLE_ROWS = 12_000  # bound on the labelled rows the lexicon is learned from
CANDIDATES = 4_096  # bound on the terms that are weighed together
PREFIX = range(4, 9)
EVIDENCE = 16.0  # one chance in ten million, as so many terms are looked at
DEMAND = 5  # each toxic row asks to be hit by so many terms
THRESHOLD = 0.3


class _Fold(dict):
    """Translation table that works out a character when it first meets it."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        out = "".join(LOOK_ALIKE.get(x, x if x.isalnum() else " ") for x in plain)
        if len(self) < 70_000:
            self[code] = out
        return out


_FOLD = _Fold({ord(a): a for a in ""})


def fold(text: str | None) -> str:
    """Folded words, each after one blank, with a blank at the end."""
    return " " + " ".join((text or "").translate(_FOLD).split()) + " "


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 0.0
    offset: float = 0.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(found):
            found.make_automaton()
        return found


def hit_weight(text: str, automaton) -> float:
    """Summed weight of the longest hit at each place, without those an exception phrase covers, by root of length."""
    if not len(automaton):
        return 0.0
    hits: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if weight is None:
            free.append((start, end))
        elif start not in hits or hits[start][0] < size:
            hits[start] = (size, weight)
    total = sum(w for start, (size, w) in hits.items() if not any(a <= start and start + size - 1 <= b for a, b in free))
    return total / math.sqrt(max(1, text.count(" ") - 1)) if total else 0.0


def _evidence(share: float) -> Column:
    """How unlikely so toxic a term is by chance, as a log likelihood ratio against the toxic share of rows."""
    b, g = F.col("bad"), F.col("good")
    return b * F.log(b / (b + g) / share) + F.when(g > 0, g * F.log(g / (b + g) / (1 - share))).otherwise(0.0)


def _terms(text: str) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIX if len(w) >= n}


def learn(documents: DataFrame, labels: DataFrame, train: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Lexicon from at most about ``sample_rows`` labelled rows, chosen by a hash of their key.

    ``train`` is a condition on ``doc_id``; rows that fail it are not read. A
    document labelled more than once counts as toxic if any label says so.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if train is not None:
        marked = marked.where(train)
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marked.count()
    share = int(min(1.0, sample_rows / max(n, 1)) * (1 << 20))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    # At most about sample_rows narrow rows: safe to broadcast at any input size.
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sample = stored(rows.select("text", "toxic").distinct(), "toxic-sample")

    def term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [Counter(), Counter()]
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[int(toxic > 0)].update(_terms(fold(text)))
            for kind, counts in enumerate(seen):
                if counts:
                    yield pd.DataFrame({"term": list(counts), "kind": kind, "n": list(counts.values())})

    of_kind = {r["k"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    good, bad = of_kind.get(0, 0), of_kind.get(1, 0)
    prior = math.log((bad + 0.5) / (good + 0.5))
    if not good or not bad:
        return Lexicon(offset=prior)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    counted = (
        sample.mapInPandas(term_counts, "term string, kind int, n long").groupBy("term")
        .agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("good"))
        .where((F.col("bad") >= max(3, bad // 100)) & (F.col("bad") * good > 4 * F.col("good") * bad) & (_evidence(bad / (bad + good)) >= EVIDENCE))
        .withColumn("odds", odds)
        .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(CANDIDATES).collect()
    )
    weight = {r["term"]: float(r["odds"]) for r in counted}

    def incidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folded = [fold(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"] > 0, "terms": [sorted(_terms(f) & weight.keys()) for f in folded]})

    rows = sample.where("toxic > 0").mapInPandas(incidence, "toxic boolean, terms array<string>").collect()  # at most sample_rows rows
    picked = _cover([list(r["terms"]) for r in rows], weight, {r["term"]: r["good"] for r in counted})
    lexicon = Lexicon({t: weight[t] for t in picked})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"] > 0, "x": [hit_weight(fold(t), automaton) for t in batch["text"]]})

    points = sample.mapInPandas(sums, "toxic boolean, x double").collect()  # at most sample_rows pairs
    slope, offset = _logistic(np.array([p["x"] for p in points]), np.array([p["toxic"] for p in points], float))
    return Lexicon(lexicon.weights, slope=slope, offset=offset)


def _cover(rows: list[list[str]], weight: dict[str, float], good: dict[str, int]) -> list[str]:
    """Terms that explain the toxic rows: each pick serves the rows still asking for hits."""
    holders: dict[str, list[int]] = {}
    for i, terms in enumerate(rows):
        for t in terms:
            holders.setdefault(t, []).append(i)
    asks = np.full(len(rows), DEMAND)
    spans = {t: np.array(x) for t, x in holders.items()}
    picked: list[str] = []
    while spans:
        gain = {t: int((asks[x] > 0).sum()) - 2 * good[t] for t, x in spans.items()}
        best = max(gain, key=lambda t: (gain[t], len(t), t))
        if gain[best] < 2:
            return picked
        picked.append(best)
        # Shorter and longer forms of one term would count one hit twice.
        asks[spans.pop(best)] -= 1
        spans = {t: x for t, x in spans.items() if gain[t] >= 2 and not t.startswith(best.rstrip()) and not best.startswith(t.rstrip())}
    return picked


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge, so that separable rows end too."""
    design, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        ridge = np.diag([1e-3, 1e-3])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score(text: Column, lexicon: Lexicon) -> Column:
    """Probability that a text is toxic; the lexicon (at most ``CANDIDATES`` terms) travels with the function."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in batches:
            x = np.array([hit_weight(fold(t), automaton) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.offset, -50, 50))))

    return toxicity(text)


def in_training(key: Column) -> Column:
    return remainder(key, 4) != 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lexicon = learn(documents, table(spark, sf_dir, "labels"), in_training(F.col("doc_id")))
    scored = documents.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), score(F.col("text"), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, with the columns they came with."""
    lexicon = learn(docs, table(spark, sf_dir, "labels"), in_training(F.col("doc_id")))
    name = fresh("toxic")
    return docs.withColumn(name, score(F.col("text"), lexicon)).where(F.col(name) < THRESHOLD).drop(name)
