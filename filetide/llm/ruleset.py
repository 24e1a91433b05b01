"""Quality from a sparse rule ensemble (operator 13).

Texts are described by statistics that Spark computes in one pass
(``STATISTICS``). A forest of shallow trees is grown on labelled rows; the way
to each of its nodes is a rule, a conjunction of bounds on statistics. Logistic
regression with an L1 penalty weighs the rules and drops most; the penalty is the
strongest whose loss on rows kept back stays within one standard error of the best. Rules and weights become one Spark
column expression over the statistics: scoring runs no Python.

Forest and regression are fitted by Spark on narrow rows (two dozen doubles), at
most about ``SAMPLE_ROWS`` of them, chosen by a hash of their key; texts are read
once, never shuffled.

Defined results: a null or blank text has all statistics 0 and is scored like any
other; repeated rows score alike; a document labelled more than once counts as
low if any label says so; labels without key or value, or without document, are
not read; without labels of both kinds there are no rules and every text scores the share of
high labels (0.5 of one row added to each kind).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, fresh, let, remainder, stored, table

SAMPLE_ROWS = 40_000  # bound on the labelled rows that trees and weights are fitted on
TREES, DEPTH = 30, 3
PENALTIES = (0.01, 0.003, 0.001)
STEPS = 60  # of the regression, at most
KEPT_BACK = 5  # one row in so many judges the penalty
THRESHOLD = 0.3
SEED = 13

# Characters that count towards a share, as classes of a regular expression.
CLASSES = {
    "upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:]", "call": r"[!?]", "bar": r"\|", "symbol": r"[#$%&*+/<=>@\\^_~]",
    "bracket": r"[(){}\[\]]", "odd": r"[^\p{L}\p{Nd}\s\p{Punct}]",
}


def statistics(text: Column) -> Column:
    """All statistics of a text as one struct of doubles."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    def described(t: Column) -> Column:
        n, k, size = F.size(t["words"]), F.size(t["lines"]), F.length(t["text"])
        repeats = F.size(F.filter(F.zip_with(t["words"], F.slice(t["words"], 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))
        shares = {f"{name}_share": ratio(F.regexp_count(t["text"], F.lit(pattern)), size) for name, pattern in CLASSES.items()}
        return F.struct(*[
            value.cast("double").alias(name)
            for name, value in {
                "characters": size, "words": n, "lines": k,
                "word_length": ratio(size - n + 1, n), "longest_word": F.coalesce(F.array_max(F.transform(t["words"], F.length)), F.lit(0)),
                "words_a_line": ratio(n, k), "distinct_words": ratio(F.size(F.array_distinct(t["words"])), n),
                "distinct_lines": ratio(F.size(F.array_distinct(t["lines"])), k), "repeated_words": ratio(repeats, n), **shares,
            }.items()
        ])

    return let(F.struct(text.alias("text"), words.alias("words"), lines.alias("lines")), described)


STATISTICS = (
    "characters", "words", "lines", "word_length", "longest_word", "words_a_line", "distinct_words", "distinct_lines", "repeated_words",
    *[f"{name}_share" for name in CLASSES],
)


@dataclass(frozen=True, order=True)
class Rule:
    """Bounds that all hold: ``(statistic, above, at most)``, with infinities where a side is open."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, of: Column) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out = out & (of[name] > low)
            if high < math.inf:
                out = out & (of[name] <= high)
        return out

    def __str__(self) -> str:
        parts = [f"{name} > {low:g}" if high == math.inf else f"{name} <= {high:g}" if low == -math.inf else f"{low:g} < {name} <= {high:g}" for name, low, high in self.bounds]
        return " and ".join(parts)


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...] = ()
    offset: float = 0.0

    def score(self, of: Column) -> Column:
        """Probability of a high label from a struct of statistics."""
        total = F.lit(self.offset)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


_STEP = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def tree_rules(description: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The way to every node but the root, from a tree's printed form; bounds on one statistic are merged."""
    out, way = [], []
    for line in description.splitlines():
        step = _STEP.match(line)
        if not step:
            continue
        depth, name, sign, bound = len(step[1]), names[int(step[3])], step[4], float(step[5])
        way = [w for w in way if w[0] < depth] + [(depth, name, sign, bound)]
        merged: dict[str, tuple[float, float]] = {}
        for _, name, sign, bound in way:
            low, high = merged.get(name, (-math.inf, math.inf))
            merged[name] = (max(low, bound), high) if sign == ">" else (low, min(high, bound))
        out.append(Rule(tuple(sorted((n, a, b) for n, (a, b) in merged.items()))))
    return out


def training_rows(described: DataFrame, labels: DataFrame, train: Column | None, sample_rows: int) -> DataFrame:
    """``(stats, high, back)`` of at most about ``sample_rows`` labelled documents."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if train is not None:
        marked = marked.where(train)
    marked = marked.groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("high"))
    share = int(min(1.0, sample_rows / max(marked.count(), 1)) * (1 << 20))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    # Copies of one row would weigh as often as they are repeated.
    rows = described.select("doc_id", "stats").distinct().join(chosen, "doc_id")
    return rows.select("stats", "high", (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(KEPT_BACK)) == 0).alias("back"))


def learn(described: DataFrame, labels: DataFrame, train: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Rules and weights from ``described`` (``doc_id``, ``stats``) and ``labels``; ``train`` is a condition on ``doc_id``."""
    rows = stored(training_rows(described, labels, train, sample_rows), "quality-rows")
    of_kind = {r["high"]: r["n"] for r in rows.groupBy("high").agg(F.count("*").alias("n")).collect()}
    low, high = of_kind.get(0.0, 0), of_kind.get(1.0, 0)
    if not low or not high:
        return Ensemble(offset=math.log((high + 0.5) / (low + 0.5)))
    vectors = rows.select("high", array_to_vector(F.array(*[F.col("stats")[name] for name in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(
        labelCol="high", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=max(1, min(20, low // 20)), seed=SEED,
    ).fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString)})
    if not rules:
        return Ensemble(offset=math.log((high + 0.5) / (low + 0.5)))
    # Rows that obey the same rules weigh together: the regression runs over few of them.
    held = F.array(*[F.when(rule.column(F.col("stats")), 1.0).otherwise(0.0) for rule in rules])
    facts = rows.select("high", "back", held.alias("held")).groupBy("high", "back", "held").agg(F.count("*").cast("double").alias("n"))
    facts = stored(facts.select("high", "back", "n", array_to_vector("held").alias("features")), "quality-facts")

    def lasso(part: DataFrame, penalty: float):
        return LogisticRegression(
            labelCol="high", featuresCol="features", weightCol="n", regParam=penalty, elasticNetParam=1.0, maxIter=STEPS, tol=1e-5, standardization=False,
        ).fit(part)

    def loss(model) -> tuple[float, float]:
        p = vector_to_array("probability")[1]
        one = -F.log(F.greatest(F.when(F.col("high") > 0, p).otherwise(1 - p), F.lit(1e-15)))
        r = model.transform(facts.where("back")).agg(F.sum("n").alias("n"), F.sum(one * F.col("n")).alias("s"), F.sum(one * one * F.col("n")).alias("q")).first()
        if not r["n"]:
            return 0.0, 0.0
        mean = r["s"] / r["n"]
        return mean, math.sqrt(max(r["q"] / r["n"] - mean * mean, 0.0) / r["n"])

    tried = [(penalty, *loss(lasso(facts.where("not back"), penalty))) for penalty in PENALTIES]
    best, error = min((mean, error) for _, mean, error in tried)
    model = lasso(facts, next(penalty for penalty, mean, _ in tried if mean <= best + error))
    weighed = [(rule, float(w)) for rule, w in zip(rules, model.coefficients) if w]
    return Ensemble(tuple(weighed), float(model.intercept))


def described(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` of all rows, written once for training and scoring."""
    return stored(documents.select("doc_id", statistics(F.col("text")).alias("stats")), "quality-statistics")


def keep_good(docs: DataFrame, ensemble: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score at least ``threshold``, with the columns they came with."""
    name = fresh("stats")
    return docs.withColumn(name, statistics(F.col("text"))).where(ensemble.score(F.col(name)) >= threshold).drop(name)


def in_training(key: Column) -> Column:
    return remainder(key, 5) != 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = described(table(spark, sf_dir, "documents"))
    ensemble = learn(documents, table(spark, sf_dir, "labels"), in_training(F.col("doc_id")))
    scored = documents.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), ensemble.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
