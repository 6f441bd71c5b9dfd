"""Quality classifier: a sparse rule ensemble over text statistics, scored by Spark column expressions.

A random forest is fitted on statistics of labelled documents; every path from a root to a node becomes a rule, the
conjunction of its threshold tests. Logistic regression with an L1 penalty gives most rules the weight zero; the others
are compiled to one column expression: sigmoid(bias + sum of the weights of the rules that hold). Scoring is a
projection, without Python, a model object or a join.

Fitting uses at most ``FIT_ROWS`` labelled rows, chosen by a hash of the id (documented bound: forests gain nothing from
more, and the driver holds only the trees). Rows whose crc32(id as text) mod 4 is 2 are held out and never fitted on;
labels, language, source and id are never inputs.

Defined cases: null and empty texts have all statistics zero and get a score like any other; a text of any length is
read whole; rows without an id are scored and never fitted on; duplicate labels of an id count one by one, null labels
and labels other than 0 and 1 not at all; without labels of both kinds every document scores 1.0 (nothing is rejected); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

THRESHOLD = 0.7
HELD_OUT = 2
FIT_ROWS = 50_000
TREES = 16
DEPTH = 4
PENALTY = 0.002
SEED = 7

_SYMBOLS = "[#$%&*|<>{}\\[\\]=_~^@\\\\/+]+"
_DIGITS = "[0-9]+"
_MARKS = "[.,;:!?]+"

STATISTICS = (
    "chars", "words", "word_length", "symbol_share", "bar_share", "digit_share", "upper_share", "mark_share", "shout_share",
    "space_share", "distinct_words", "line_length", "distinct_lines", "symbol_words", "longest_word", "odd_lines",
)


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, all finite; ``text`` should be a plain column."""
    body = F.coalesce(text, F.lit(""))
    n = F.char_length(body)
    share = lambda part: F.coalesce(F.try_divide(part.cast("double"), n.cast("double")), F.lit(0.0))
    count = lambda pattern: n - F.char_length(F.regexp_replace(body, pattern, ""))
    single = lambda char: n - F.char_length(F.replace(body, F.lit(char), F.lit("")))
    words = F.filter(F.split(body, "\\s+", -1), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x != "")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    spaces = count("[ \n\t\r]+")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "chars": F.log1p(n.cast("double")),
        "words": F.log1p(n_words),
        "word_length": ratio(n - spaces, n_words),
        "symbol_share": share(count(_SYMBOLS)),
        "bar_share": share(single("|")),
        "digit_share": share(count(_DIGITS)),
        "upper_share": share(count("\\p{Lu}+")),
        "mark_share": share(count(_MARKS)),
        "shout_share": share(single("!")),
        "space_share": share(spaces),
        "distinct_words": ratio(F.size(F.array_distinct(words)), F.sqrt(n_words)),
        "line_length": ratio(n, n_lines),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), n_lines),
        "symbol_words": ratio(F.regexp_count(body, F.lit("[#$%&*]{3}(?:\\s|$)")), n_words),
        "longest_word": F.coalesce(F.array_max(F.transform(words, lambda w: F.char_length(w))), F.lit(0)).cast("double"),
        "odd_lines": ratio(F.size(F.filter(lines, lambda x: ~x.rlike("[.!?:\"')]\\s*$"))), n_lines),
    }


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(debug: str) -> list[Rule]:
    """The rules of a printed forest: the tests on the way to every node, simplified, each set of tests once."""
    out: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if line.lstrip().startswith("Tree"):
                path = []
            continue
        depth = len(m.group(1))
        path = [p for p in path if p[0] < depth]
        path.append((depth, (STATISTICS[int(m.group(3))], m.group(4), float(m.group(5)))))
        bounds: dict[tuple[str, str], float] = {}
        for _, (name, op, x) in path:
            old = bounds.get((name, op))
            bounds[name, op] = x if old is None else min(old, x) if op == "<=" else max(old, x)
        out[tuple(sorted((name, op, x) for (name, op), x in bounds.items()))] = None
    return list(out)


def holds(rule: Rule) -> Column:
    test = F.lit(True)
    for name, op, x in rule:
        test = test & ((F.col(name) <= x) if op == "<=" else (F.col(name) > x))
    return test


def compiled(bias: float, weights: dict[Rule, float]) -> Column:
    """The score of a row that has the columns STATISTICS."""
    total = F.lit(bias)
    for rule, w in weights.items():
        total = total + F.when(holds(rule), w).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(train: DataFrame) -> Column:
    """From rows with STATISTICS and ``label`` (0 or 1): the score expression."""
    if train.select("label").distinct().count() < 2:
        return F.lit(1.0)
    table = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(train)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED
    ).fit(table)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return F.lit(1.0)
    held = train.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("rules"))
    model = LogisticRegression(
        featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=100
    ).fit(held)
    weights = {r: w for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if abs(w) > 1e-9}
    return compiled(model.intercept, weights)


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT


def _facts(docs: DataFrame, text: Column, *others: Column) -> DataFrame:
    body = docs.select(*others, F.coalesce(text.cast("string"), F.lit("")).alias("_text"))
    return body.select(*[c for c in body.columns if c != "_text"], *[c.alias(k) for k, c in statistics(F.col("_text")).items()])


def training_marks(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """_id and label (0.0 or 1.0) of the rows to fit on: about ``FIT_ROWS`` at most, none of them held out."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
    marks = marks.filter(F.col("_id").isNotNull() & F.col("label").isin(0.0, 1.0) & ~is_held_out("_id"))
    n = marks.count()
    if n > FIT_ROWS:  # the same rows whatever the partitioning
        marks = marks.filter(F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / n))
    return written(marks, "training-marks")


def fitted(facts: DataFrame) -> Column:
    """The score expression, fitted on ``facts`` (_id, label and STATISTICS)."""
    train = written(facts.repartition(4, "_id").sortWithinPartitions("_id", "chars"), "training-rows")
    return fit(train).cast("double")


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: id, held_out, score (0 to 1, higher: better), predicted (1 if score >= THRESHOLD)."""
    facts = written(_facts(docs, F.col(text_col), F.col(id_col).alias("_id")), "statistics")
    score = fitted(facts.join(training_marks(labels, id_col, label_col), "_id"))
    out = facts.select(F.col("_id").alias(id_col), F.coalesce(is_held_out("_id"), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns. The scores are computed where
    the rows are; statistics for the fit are taken of the labelled rows alone."""
    marks = training_marks(labels, id_col, label_col).select(F.col("_id").alias("_mark"), F.col("label").alias("_label"))
    marked = docs.join(marks, docs[id_col] == marks["_mark"])
    score = fitted(_facts(marked, docs[text_col], F.col("_mark").alias("_id"), F.col("_label").alias("label")))
    rows = _facts(docs, F.col(text_col), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    # the generator keeps the planner from writing each statistic out once for every test of a rule
    facts = rows.select("_row", F.explode(F.array(F.struct(*STATISTICS))).alias("_s")).select("_row", "_s.*")
    return facts.filter(score >= THRESHOLD).select("_row.*")
