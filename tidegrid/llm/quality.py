"""Quality by a sparse ensemble of rules over text statistics.

A forest of shallow trees is fitted on statistics of labelled texts; every path from a root to a node
is a conjunction of bounds on statistics, a rule.  A lasso logistic regression over the rules' truth
values keeps few of them.  Those rules and their weights are compiled into one Spark expression over
the statistics, which are built-in functions too: scoring is a scan in the JVM, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import drawn, materialize, release, table
from tidegrid.llm.language_id import held_out

ROWS_PER_CLASS = 4000  # labelled rows that are fitted for each class, about
FIT_FILES = 8
TRUTH_FILES = 2  # of the rules' truth values, a few megabytes that many short jobs read
TREES, DEPTH, SEED = 24, 3, 11
PENALTIES = (0.01, 0.003, 0.001)  # of which the one with the least loss on rows left out is taken
FOLDS, LEFT_OUT = 10, 3
WINDOW = 200  # words and lines are distinct among so many, so that the share does not fall with a text's length

Rule = tuple[tuple[str, float, float], ...]  # (statistic, above, at most)

# Characters counted, and runs of characters counted: a share of all characters each.  All of them are
# rare in prose, as a match costs far more than a character that is passed over.
RARE = {
    "capitals": r"\p{Lu}",
    "digits": r"\p{Nd}",
    "stops": r"[.,;:]",
    "bangs": r"[!?]",
    "bars": r"[|]",
    "symbols": r"[#$%&*@^~+=<>_{}\[\]\\/]",
    "others": r"[^\p{L}\s]",
    "breaks": r"\n",
    "loud_runs": r"\p{Lu}{4,}",
    "marked_runs": r"[^\p{L}\p{Nd}\s.,;:'\")]{2,}",
}


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; all 0 for a text without characters."""
    size = F.length(text)
    starts = lambda parts: F.sequence(F.lit(1), F.size(parts), F.lit(WINDOW))
    fresh = lambda parts: F.aggregate(starts(parts), F.lit(0), lambda n, at: n + F.size(F.array_distinct(F.slice(parts, at, WINDOW))))
    both = lambda parts: F.struct(F.size(parts).alias("all"), fresh(parts).alias("distinct"))
    # the one-element transform splits the text once and names the parts for both counts
    parted = lambda by: F.transform(F.array(F.split(text, by)), both)[0]
    words, lines = parted(" "), parted("\n")
    out = {"log_words": F.log1p(words["all"].cast("double")), "word_length": size / words["all"]}
    out |= {name: F.regexp_count(text, F.lit(pattern)) / size for name, pattern in RARE.items()}
    out |= {"distinct_words": words["distinct"] / words["all"], "distinct_lines": lines["distinct"] / lines["all"]}
    return {name: F.when(size > 0, c).otherwise(0.0).cast("double") for name, c in out.items()}


NAMES = ["log_words", "word_length", *RARE, "distinct_words", "distinct_lines"]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def paths(node, bounds: dict[str, tuple[float, float]] | None = None) -> list[Rule]:
    """The rules of a fitted tree's nodes below ``node``: bounds of one statistic along a path are merged."""
    bounds = bounds or {}
    out = [tuple((name, *bounds[name]) for name in sorted(bounds))] if bounds else []
    if node.getClass().getSimpleName() == "InternalNode":
        name, cut = NAMES[node.split().featureIndex()], float(node.split().threshold())
        low, high = bounds.get(name, (-math.inf, math.inf))
        out += paths(node.leftChild(), bounds | {name: (low, min(high, cut))})
        out += paths(node.rightChild(), bounds | {name: (max(low, cut), high)})
    return out


def holds(rule: Rule, of: str = "_s.") -> Column:
    """Whether a row's statistics, columns that begin with ``of``, meet a rule."""
    parts = []
    for name, low, high in rule:
        c = F.col(f"{of}{name}")
        parts += [c > low] if low > -math.inf else []
        parts += [c <= high] if high < math.inf else []
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> tuple[DataFrame, float]:
    """_s (statistics), label, weight, fold of drawn labelled rows, materialized; and the share of label 1 among all labels."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    share = lambda n: min(1.0, rows_per_class / max(1, n))
    taken = F.when(F.col("label") == 1, share(good)).otherwise(share(bad))
    chosen = known.where(drawn(taken, "doc_id")).withColumn("weight", 1.0 / taken)
    rows = docs.select("doc_id", _text().alias("text")).join(F.broadcast(chosen), "doc_id")  # about rows_per_class ids of each class
    rows = rows.select(
        F.struct(*[c.alias(name) for name, c in statistics(F.col("text")).items()]).alias("_s"), F.col("label").cast("double").alias("label"), "weight",
        F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"), F.xxhash64("doc_id", "text").alias("key"),
    )
    return materialize(rows, FIT_FILES, "key"), good / (good + bad) if good + bad else 0.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> dict:
    """Rules with weights and an intercept, from the texts of ``docs`` that ``labels`` marks 0 or 1.

    About ``rows_per_class`` rows of each class are drawn by a hash of doc_id, any run draws the
    same; they count as often as there are labels of their class for each drawn one.  Rows with equal
    texts are in the same fold, so the penalty is chosen on texts that its fit has not seen.  Where
    rows of either class are missing, there are no rules and the chance is the share of label 1.
    """
    rows, chance = _sample(docs, labels, label, rows_per_class)
    vector = lambda columns: array_to_vector(F.array(*columns)).alias("features")
    both = lambda df: len(df.groupBy("label").count().collect()) == 2
    if not both(rows):
        release(rows)
        held = min(max(chance, 1e-6), 1 - 1e-6)
        return {"rules": [], "intercept": math.log(held / (1 - held))}
    stats = rows.select(vector([F.col(f"_s.{n}") for n in NAMES]), "label", "weight")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", featureSubsetStrategy="onethird", minInstancesPerNode=3)
    rules = sorted({rule for tree in forest.fit(stats)._java_obj.trees() for rule in paths(tree.rootNode())})
    if not rules:
        release(rows)
        held = min(max(chance, 1e-6), 1 - 1e-6)
        return {"rules": [], "intercept": math.log(held / (1 - held))}
    truth = materialize(rows.select(vector([holds(r).cast("double") for r in rules]), "label", "weight", "fold", "key"), TRUTH_FILES, "key")
    lasso = lambda penalty: LogisticRegression(elasticNetParam=1.0, regParam=penalty, weightCol="weight", maxIter=50)
    seen, unseen = truth.where(F.col("fold") >= LEFT_OUT), truth.where(F.col("fold") < LEFT_OUT)
    best = PENALTIES[-1]
    if both(seen) and unseen.limit(1).count():
        said = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), vector_to_array("probability")[1]))
        loss = F.sum(-F.col("weight") * F.log(F.when(F.col("label") == 1.0, said).otherwise(1.0 - said))) / F.sum("weight")
        best = min(PENALTIES, key=lambda p: lasso(p).fit(seen).transform(unseen).agg(loss.alias("loss")).first().loss)
    model = lasso(best).fit(truth)
    live = [(rule, float(w)) for rule, w in zip(rules, model.coefficients.toArray()) if w]
    release(rows, truth)
    return {"rules": live, "intercept": float(model.intercept)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score is 0.5 or more).

    Only the text is used, whole, however long; null and empty texts have statistics of 0 and are
    scored by them.  Equal texts get equal scores and repeated rows a row each; an empty table gives
    no rows.  Other columns are passed on; clashing columns named score or predicted are replaced.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    used = {name for rule, _ in model["rules"] for name, _, _ in rule}
    total = F.lit(model["intercept"])
    of = "_s"
    while any(c.lower().startswith(of) for c in docs.columns):
        of += "_"
    rows = docs
    if used:
        # columns, as fields of a struct would be evaluated anew for each rule
        rows = docs.select("*", *[c.alias(f"{of}{n}") for n, c in statistics(_text()).items() if n in used])
        for rule, weight in model["rules"]:
            total = total + F.when(holds(rule, of), weight).otherwise(0.0)
    out = rows.select(*keep, (1.0 / (1.0 + F.exp(-total))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    rows = docs.select("doc_id", held_out(3, 1).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
