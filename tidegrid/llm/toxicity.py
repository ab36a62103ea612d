"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of the whole text: densities of a fixed lexicon and of a lexicon learned from labelled
rows (words and word beginnings that mark toxic rows), lexicon hits near second-person words,
capitals, punctuation and obfuscation rates.  Lexicon, trees and calibration are fitted on a
bounded sample of labelled rows with Spark ML; scoring is a scan with no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import bound_batches, drawn, give_back, materialize, release, table
from tidegrid.llm.language_id import held_out

ROWS_PER_CLASS = 4000  # labelled rows that are fitted for each class, about
FIT_FILES = 8
STEMS = (4, 5)
NEAR = 5

# Common English insults, and second-person words of some languages.
INSULTS = """idiot idiots stupid moron morons loser losers clown clowns trash scum scumbag worthless
pathetic disgusting dumb fool fools jerk jerks creep freak pig pigs garbage filthy vile hate hateful
imbecile cretin coward liar ugly useless vermin""".split()
SECOND_PERSON = """you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein
deine euch euer ihr sie ihnen usted ustedes vosotros tus ti vuestro""".split()

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][\d@$!*#%&^~+=.]+[^\W\d_]")
_SYMBOLS = "@$*#%&^~+=|<>\\"


def _classes() -> np.ndarray:
    """Class of each code point below 256: 1 capital, 2 punctuation, 3 symbol, 4 digit, 5 bang."""
    table = np.zeros(257, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        if c.isupper():
            table[i] = 1
        elif c in "!?":
            table[i] = 5
        elif c in _SYMBOLS:
            table[i] = 3
        elif c.isdigit():
            table[i] = 4
        elif not c.isalnum() and not c.isspace():
            table[i] = 2
    return table


CLASSES = _classes()
NAMES = [
    "fixed_density", "learned_density", "stem_density", "fixed_hits", "learned_hits", "stem_hits",
    "second_person_near", "capitals", "punctuation", "symbols", "digits", "bangs", "mixed_words", "log_words",
]


def features(text: str | None, learned: frozenset, stems: frozenset) -> list[float]:
    text = text or ""
    words = _WORD.findall(text.lower())
    n = len(words)
    fixed_words = FIXED
    hits = [w in learned for w in words]
    fixed = [w in fixed_words for w in words]
    n_learned, n_fixed = sum(hits), sum(fixed)
    n_stems = sum([w[: STEMS[0]] in stems or w[: STEMS[1]] in stems for w in words]) if stems else 0
    near = 0
    if n_learned or n_fixed:
        at = np.flatnonzero(np.array(hits) | np.array(fixed))
        said = np.flatnonzero(np.array([w in PERSON for w in words]))
        if len(said):
            i = np.searchsorted(said, at)
            gaps = np.minimum(np.abs(said[np.minimum(i, len(said) - 1)] - at), np.abs(said[np.maximum(i - 1, 0)] - at))
            near = int((gaps <= NEAR).sum())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(CLASSES[np.minimum(codes, 256)], minlength=6) / max(1, len(codes))
    mixed = len(_MIXED.findall(text)) / max(1, n)
    per = max(1, n)
    return [
        n_fixed / per, n_learned / per, n_stems / per, np.log1p(n_fixed), np.log1p(n_learned), np.log1p(n_stems),
        near / per, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], mixed, np.log1p(n),
    ]


FIXED, PERSON = frozenset(INSULTS), frozenset(SECOND_PERSON)


def _vectors(docs: DataFrame, lexicon: tuple[list[str], list[str]]) -> DataFrame:
    """``docs`` with a column _features; the text's features as an array."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learned, stems = frozenset(lexicon[0]), frozenset(lexicon[1])
        for texts in batches:
            yield pd.Series([features(t if isinstance(t, str) else None, learned, stems) for t in texts])
        give_back()

    return docs.withColumn("_features", of(F.col("text").cast("string")))


def learn_lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words and word beginnings whose share of toxic texts far exceeds that of clean ones.

    A unit needs to occur in 3 toxic texts and in 1 % of them, at a smoothed ratio of 12 or more, so
    the drawn rows bound how many there are.  Copies and near copies count as one text, told by the
    least hash of their words: else the words of one text with many copies would pass for toxic ones.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    units = F.array_union(
        F.transform(words, lambda w: F.concat(F.lit("="), w)),
        F.flatten(
            F.array(*[
                F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.substring(w, 1, k))
                for k in STEMS
            ])
        ),
    )
    text = F.array_min(F.transform(words, lambda w: F.xxhash64(w)))
    held = rows.select("toxic", text.alias("text"), units.alias("units")).where("text IS NOT NULL")
    totals = {r.toxic: r.n for r in held.groupBy("toxic").agg(F.count_distinct("text").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    counted = (
        held.select("toxic", "text", F.explode("units").alias("unit"))
        .distinct()
        .groupBy("unit")
        .agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
        .where(F.col("bad") >= max(3, n_toxic // 100))
    )
    ratio = ((F.col("bad") + 0.5) / (n_toxic + 1.0)) / ((F.col("good") + 0.5) / (n_clean + 1.0))
    units = [r.unit for r in counted.where(ratio >= 12.0).select("unit").orderBy("unit").collect()]
    return [u[1:] for u in units if u[0] == "="], [u for u in units if u[0] != "="]


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> dict:
    """Lexicon, trees and calibration from the texts of ``docs`` that ``labels`` marks 0 or 1.

    About ``rows_per_class`` rows of each class are drawn by a hash of doc_id before texts are
    looked up, so the ids that are broadcast and the texts that are fitted are bounded, and any run
    draws the same.  A drawn row counts as often in trees and calibration as there are labels of its
    class for each drawn one, so a score is the chance among all labelled rows at any size.  Where
    rows of either class are missing, the model is the share of toxic rows.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    labelled = dict(counts)
    constant = {"constant": (bad / (bad + good)) if bad + good else 0.0}
    if not bad or not good:
        return constant
    share = F.when(F.col("toxic") == 1, min(1.0, rows_per_class / bad)).otherwise(min(1.0, rows_per_class / good))
    chosen = known.where(drawn(share, "doc_id"))
    rows = materialize(
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # about rows_per_class ids of each class
        .select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(10)).alias("fold"), F.xxhash64("doc_id", "text").alias("key")),
        FIT_FILES, "key",
    )
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not bad or not good:
        release(rows)
        return constant
    lexicon = learn_lexicon(rows)
    taken = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    weight = F.when(F.col("toxic") == 1, labelled[1] / taken[1]).otherwise(labelled[0] / taken[0]).alias("weight")
    data = materialize(_vectors(rows, lexicon).select("_features", F.col("toxic").cast("double").alias("label"), weight, "fold", "key"), 1, "key")
    train = data.select(array_to_vector("_features").alias("features"), "label", "weight", "fold")
    fitted = train.where("fold >= 3")
    if len(fitted.groupBy("label").count().collect()) < 2:
        fitted = train
    trees = GBTClassifier(maxIter=12, maxDepth=3, maxBins=32, stepSize=0.3, seed=3, weightCol="weight").fit(fitted)
    chance = lambda d: trees.transform(d).select("label", "weight", vector_to_array("probability")[1].alias("chance"))
    held = chance(train.where("fold < 3"))
    calibration = None
    if len(held.groupBy("label").count().collect()) == 2:
        calibration = _calibrate(held, labelled[1] / taken[1], labelled[0] / taken[0])
    release(rows, data)
    return {"lexicon": lexicon, "trees": trees, "calibration": calibration}


def _calibrate(held: DataFrame, toxic_weight: float, clean_weight: float):
    """Isotonic steps from chance to label, each with one more row of either class.

    Without those rows a step that a few drawn rows make would claim certainty.  A step reaches up
    to the next one: where no drawn row lies between them, nothing speaks for more.
    """
    isotonic = IsotonicRegression(featuresCol="chance", labelCol="label", weightCol="weight")
    steps = isotonic.fit(held).transform(held).groupBy("prediction").agg(
        F.sum("weight").alias("w"), F.min("chance").alias("low"), F.max("chance").alias("high")
    )
    smooth = (F.col("prediction") * F.col("w") + toxic_weight) / (F.col("w") + toxic_weight + clean_weight)
    upper = F.coalesce(F.lead("low").over(Window.orderBy("low")) - 1e-9, F.col("high"))  # a row a step
    ends = steps.select(smooth.alias("label"), (F.col("w") / 2).alias("weight"), "low", upper.alias("upper"))
    ends = ends.select("label", "weight", F.explode(F.array("low", "upper")).alias("chance"))
    return isotonic.fit(ends)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score is 0.5 or more).

    Only the text is used, whole, however long; null and empty texts are scored like any other, by
    their zero features.  Equal texts get equal scores and repeated rows a row each; an empty table
    gives no rows.  Other columns are passed on; clashing columns named score or predicted are
    replaced, and so is whatever Spark's models would add.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    if "constant" in model:
        rows = rows.withColumn("score", F.lit(float(model["constant"])))
    else:
        raw, chance, calibrated = "_raw", "_chance", "_calibrated"
        trees = model["trees"].setFeaturesCol("_vector").setRawPredictionCol(raw).setProbabilityCol("_both").setPredictionCol("_side")
        rows = trees.transform(_vectors(rows, model["lexicon"]).withColumn("_vector", array_to_vector("_features")))
        rows = rows.withColumn(chance, vector_to_array("_both")[1])
        if model["calibration"] is not None:
            rows = model["calibration"].setFeaturesCol(chance).setPredictionCol(calibrated).transform(rows)
            # the raw chance breaks the ties of the calibration's steps and never crosses them
            mixed = F.col(calibrated) * 0.98 + F.col(chance) * 0.02
            said = F.when(F.col(calibrated) >= 0.5, F.greatest(mixed, F.lit(0.5))).otherwise(F.least(mixed, F.lit(0.4999)))
        else:
            said = F.col(chance)
        rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), said)))
    return rows.select(*[F.col(f"`{c}`") for c in keep], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(5, 0))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
