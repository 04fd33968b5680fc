"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Shallow trees of a random forest are fitted on a bounded sample of labelled rows; every path to a node becomes
a conjunctive rule over statistics of the text; a logistic regression under a lasso penalty weighs the rules
and drops most. The rules left are compiled into column expressions, so that scoring is one scan without
Python or a shuffle. Labels, language, source and document id are never inputs of a score.

The sample: at most ``SAMPLE_ROWS`` labelled rows in the order of a hash of their id, never held-out ones
(crc32 of the id as text, modulo 3, is 1).

Defined results: null and empty texts have statistics 0 and are scored; with no labelled row the score is 0.5,
with labels of one class only it is that class; documents labelled twice count once with their lower label;
null labels and null ids aren't learnt from, and null ids aren't held out; repeated rows get equal scores, and ties
of a score at 0.5 predict 1; a very long text is scored whole by built-in functions, in memory proportional to its
length; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

SAMPLE_ROWS = 20_000
N_TREES, DEPTH, PENALTY, SEED = 24, 3, 0.001, 7
SYMBOLS = "#*$%&|<>{}[]\\^~_=+@"


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, whether above, bound) each."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.col(name) > bound if above else F.col(name) <= bound for name, above, bound in self.terms]
        return F.when(reduce(lambda a, b: a & b, parts), 1.0).otherwise(0.0)


def _without(text: Column, letters: str) -> Column:
    """Characters of the text that are among letters."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("double")


def statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id and statistics of the whole texts, built-in functions only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(
        "doc_id",
        F.length(text).cast("double").alias("chars"),
        F.regexp_count(text, F.lit(r"\S+")).cast("double").alias("words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double").alias("upper"),
        _without(text, SYMBOLS).alias("symbols"),
        _without(text, "0123456789").alias("digits"),
        _without(text, ".,;:!?").alias("marks"),
        _without(text, "!").alias("bangs"),
        _without(text, "|").alias("bars"),
        F.size(F.split(text, "\n", -1)).cast("double").alias("lines"),
        F.size(F.array_distinct(F.split(text, "\n", -1))).cast("double").alias("own_lines"),
        F.size(F.array_distinct(F.split(F.lower(text), r"\s+", -1))).cast("double").alias("own_words"),
    )
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1.0))
    columns = {
        "log_words": F.log1p("words"),
        "word_length": share("chars", "words"),
        "upper_share": share("upper", "chars"),
        "symbol_share": share("symbols", "chars"),
        "digit_share": share("digits", "chars"),
        "mark_share": share("marks", "words"),
        "bang_share": share("bangs", "words"),
        "bar_share": share("bars", "words"),
        "line_words": share("words", "lines"),
        "own_line_share": share("own_lines", "lines"),
        "own_word_share": share("own_words", "words"),
    }
    return counted.select("doc_id", *(c.alias(k) for k, c in columns.items())), list(columns)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Statistics and label of the sample. Its ids are at most ``rows``, so they are broadcast and texts aren't moved."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    sample = usable.groupBy("doc_id").agg(F.min(label).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = stored(sample, "labelled")
    return statistics(docs.join(F.broadcast(sample), "doc_id", "left_semi"))[0].join(F.broadcast(sample), "doc_id")


def tree_rules(node, names: list[str], path: tuple = ()) -> set[Rule]:
    """A rule for each node below the root: the bounds on the way to it, the tightest of each statistic and side."""
    out = set()
    if path:
        tightest: dict[tuple[str, bool], float] = {}
        for name, above, bound in path:
            pick = max if above else min
            tightest[name, above] = pick(bound, tightest.get((name, above), bound))
        out.add(Rule(tuple(sorted((n, a, b) for (n, a), b in tightest.items()))))
    if node.subtreeDepth() > 0:
        split = node.split()
        name, bound = names[split.featureIndex()], float(split.threshold())
        out |= tree_rules(node.leftChild(), names, (*path, (name, False, bound)))
        out |= tree_rules(node.rightChild(), names, (*path, (name, True, bound)))
    return out


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, (r.column() * F.lit(w) for r, w in self.rules), F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Ensemble:
    names = statistics(docs.limit(0))[1]
    train = stored(training_rows(docs, labels, label, rows), "training")
    n, positive = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or positive in (0, n):
        return Ensemble((), 0.0 if not n else 40.0 if positive else -40.0)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train)
    forest = RandomForestClassifier(numTrees=N_TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.6, minInstancesPerNode=5, seed=SEED).fit(vectors)
    rules = sorted(set().union(*(tree_rules(t._call_java("rootNode"), names) for t in forest.trees)), key=lambda r: r.terms)
    if not rules:
        return Ensemble((), 0.0)
    coded = train.select("label", *(r.column().alias(f"r{i}") for i, r in enumerate(rules)))
    coded = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(coded).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(coded)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w]
    return Ensemble(tuple(weights), float(lasso.intercept))


def score(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""
    scored = statistics(docs)[0].select("doc_id", held_out().alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
