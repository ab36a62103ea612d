"""Language identification by hierarchical discrimination.

A text's hashed byte 2- and 3-gram profile first goes to a language family, then one-versus-one
linear support vector machines separate the languages inside that family.  Families are told apart
by one-versus-one machines as well.  All machines are fitted by one job on a bounded sample of labelled
rows, a family's together, by dual coordinate descent; languages of no known family are put
together by likeness, so that families stay small however many there are.  Prediction is a dot product for each machine inside a vectorised function, with no
shuffle, so it runs at scan speed whatever the size of the table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import bound_batches, drawn, give_back, materialize, release, table

DIM = 1024
ROWS_PER_LANGUAGE = 1200  # labelled rows that are fitted for each language, about
PENALTY, EPOCHS, SLACK = 1.0, 30, 0.01  # of a machine: weight of a row's loss, passes at most, gradient that ends them
RARE = 0.02  # multiple of chance that an n-gram never seen counts as
#: Least likeness of text in its language, and what short texts may lack besides, over the root of their bytes.
LEAST_LIKENESS, SHORT = -0.2, 2.0
FIT_FILES = 4
SEGMENT = 1 << 20
SLICE = 256  # rows whose profiles are held at once
UNDETERMINED = "und"

# Families of common languages by their ISO 639-1 codes.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["ar", "he", "mt"],
    "indic": ["bn", "hi", "mr", "ne", "pa", "ur"],
}


def families_of(means: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """Languages by family, from each one's mean n-gram shares.

    Languages that the table lacks are put in about the root of their number of families by Lloyd's
    iterations on the roots of their shares, from languages that lie farthest from each other.
    """
    known = {lang: name for name, members in FAMILIES.items() for lang in members}
    out: dict[str, list[str]] = {}
    others = sorted(lang for lang in means if lang not in known)
    for lang in sorted(means):
        if lang in known:
            out.setdefault(known[lang], []).append(lang)
    if others:
        x = np.sqrt(np.stack([means[lang] / max(means[lang].sum(), 1e-12) for lang in others]))
        picked = [0]
        while len(picked) < math.ceil(math.sqrt(len(others))):
            picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
        centers = x[picked]
        for _ in range(10):
            near = (x @ centers.T).argmax(axis=1)
            sums = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
            centers = sums / np.linalg.norm(sums, axis=1, keepdims=True).clip(1e-12)
        for c in range(len(centers)):
            if members := [lang for lang, own in zip(others, near) if own == c]:
                out[f"like {members[0]}"] = members
    return out


def profile(text: str | None) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte 2- and 3-grams of the whole text."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(DIM)
    half = DIM // 2
    for at in range(0, max(len(data) - 1, 0), SEGMENT):  # segments overlap by two bytes
        x = data[at : at + SEGMENT + 2].astype(np.uint32)
        pairs = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
        counts[:half] += np.bincount(pairs[:SEGMENT] >> np.uint32(23), minlength=half)
        if len(x) > 2:
            triples = pairs[:-1] * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0xC2B2AE35)
            counts[half:] += np.bincount(triples >> np.uint32(23), minlength=half)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear machine with squared hinge loss, for labels 1 and -1."""
    rng = np.random.default_rng(1)
    w, c, alpha, own = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), 1.0 / (2.0 * PENALTY)
    curve = np.einsum("ij,ij->i", x, x) + 1.0 + own
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(x)).tolist():
            slope = y[i] * (float(w @ x[i]) + c) - 1.0 + own * alpha[i]
            if alpha[i] == 0.0 and slope > 0.0:
                continue
            worst = max(worst, abs(slope))
            moved = max(0.0, alpha[i] - slope / curve[i]) - alpha[i]
            alpha[i] += moved
            w += (moved * y[i]) * x[i]
            c += moved * y[i]
        if worst < SLACK:
            break
    return w, c


def _machines(pdf: pd.DataFrame) -> pd.DataFrame:
    """A machine for every pair of labels of a group's rows (group, label, profile, key)."""
    pdf = pdf.sort_values(["key", "label"])
    x, label, out = np.stack(pdf["profile"].to_numpy()).astype(float), pdf["label"].to_numpy(), []
    for a, b in itertools.combinations(sorted(set(label)), 2):
        both = (label == a) | (label == b)
        w, c = machine(x[both], np.where(label[both] == a, 1.0, -1.0))
        out.append((pdf["group"].iloc[0], a, b, w.tolist(), c))
    give_back()
    return pd.DataFrame(out, columns=["group", "a", "b", "weights", "intercept"])


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """Machines for the families and within each family, from (text, lang) rows, with doc_id if there is one.

    Rows without a language or a text are left out; every language is learned.  About
    ``rows_per_language`` rows of each are drawn by a hash of the row: the bound on what is fitted,
    whatever the input's size, and the same rows in any run; families are told apart on about as many
    rows of each.  The model also holds, for each language, how much commoner than by chance its
    n-grams are.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    known = labelled.where(F.col("lang").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    model = {"families": {}, "between": [], "within": {}, "logs": {}}
    if not counts:
        return model

    @F.pandas_udf("array<float>")
    def profiles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([profile(t) for t in texts])
        give_back()

    named = lambda rows, of: F.broadcast(spark.createDataFrame(rows, of))  # noqa: E731  a row a language
    own = [c for c in ("doc_id", "text") if c in labelled.columns]
    shares = named([(lang, min(1.0, rows_per_language / n)) for lang, n in sorted(counts.items())], "lang string, _share double")
    chosen = known.join(shares, "lang").where(drawn(F.col("_share"), *own))
    chosen = chosen.withColumn("key", F.xxhash64(*own)).dropDuplicates(["key"])  # a row that is repeated is drawn once
    data = materialize(chosen.select("lang", profiles("text").alias("profile"), "key"), FIT_FILES, "key")
    norms = data.select("lang", array_to_vector("profile").alias("features")).groupBy("lang")
    means = {}
    for r in norms.agg(Summarizer.normL2(F.col("features")).alias("norm"), F.count("*").alias("n")).collect():
        means[r.lang] = r["norm"].toArray() ** 2  # sums of the n-grams' shares
        model["logs"][r.lang] = np.log(means[r.lang] / max(means[r.lang].sum(), 1e-12) * DIM + RARE)
        counts[r.lang] = r.n
    model["families"] = families_of(means)
    placed = [(lang, name, min(1.0, rows_per_language / sum(counts[x] for x in langs))) for name, langs in model["families"].items() for lang in langs]
    rows = data.join(named(placed, "lang string, family string, _share double"), "lang")
    inside = rows.select(F.concat(F.lit("="), "family").alias("group"), F.col("lang").alias("label"), "profile", "key")
    across = rows.where(drawn(F.col("_share"), "key")).select(F.lit("").alias("group"), F.col("family").alias("label"), "profile", "key")
    fitted = inside.unionByName(across).groupBy("group").applyInPandas(_machines, "group string, a string, b string, weights array<double>, intercept double")
    model["within"] = {name: [] for name in model["families"]}
    for r in fitted.orderBy("group", "a", "b").collect():  # a row a pair
        own_list = model["within"][r.group[1:]] if r.group else model["between"]
        own_list.append((r.a, r.b, np.array(r.weights), r.intercept))
    release(data)
    return model


def _vote(x: np.ndarray, classes: list[str], machines) -> tuple[np.ndarray, np.ndarray]:
    """(index of the class with most wins, its mean win probability) for every row of ``x``."""
    wins, margins = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
    sure = np.zeros((len(x), len(classes)))
    at = {c: i for i, c in enumerate(classes)}
    for a, b, weights, intercept in machines:
        m = x @ weights + intercept
        p = 1.0 / (1.0 + np.exp(-np.clip(3.0 * m, -50, 50)))
        wins[:, at[a]] += m > 0
        wins[:, at[b]] += m <= 0
        margins[:, at[a]] += np.tanh(m)
        margins[:, at[b]] -= np.tanh(m)
        sure[:, at[a]] += p
        sure[:, at[b]] += 1.0 - p
    best = (wins + 1e-3 * margins).argmax(axis=1)
    if len(classes) == 1:
        return best, np.ones(len(x))
    return best, sure[np.arange(len(x)), best] / (len(classes) - 1)


def predict_rows(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and likeness of every text."""
    x = np.stack([profile(t) for t in texts]) if texts else np.zeros((0, DIM))
    out, score, likeness = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts)), np.zeros(len(texts))
    families = sorted(model["families"])
    if families and len(texts):
        chosen, sure = _vote(x, families, model["between"])
        for i, family in enumerate(families):
            own = np.flatnonzero(chosen == i)
            langs = model["families"][family]
            inner, inner_sure = _vote(x[own], langs, model["within"].get(family, []))
            out[own] = np.array(langs, dtype=object)[inner]
            score[own] = sure[own] * inner_sure
        for lang, logs in model["logs"].items():
            own = np.flatnonzero(out == lang)
            likeness[own] = (x[own] ** 2) @ logs
        lettered = np.array([has_letter(t) for t in texts])
        out[~lettered] = UNDETERMINED
        score[~lettered] = likeness[~lettered] = 0.0
    return out.tolist(), score, likeness


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and likeness.

    lang_pred is a learned language, or ``und`` with score 0 if the text is null, empty or has no
    letter, or nothing was learned.  likeness is the mean over the text's n-grams of the logarithm of
    how much commoner than by chance they are in that language: above 0 for text of the language,
    whatever its length, and below for text of none (``is_known``).  Only the text is used, whole, however long.  Equal texts get equal
    results and repeated rows a row each; an empty table gives no rows.  Every other column is passed
    on, but for clashing columns named lang_pred, score or likeness, which are replaced.
    """
    made = ["lang_pred", "score", "likeness"]

    @F.pandas_udf("struct<lang_pred: string, score: double, likeness: double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [
                predict_rows([t if isinstance(t, str) else None for t in texts.iloc[at : at + SLICE]], model)
                for at in range(0, len(texts), SLICE)
            ] or [([], np.zeros(0), np.zeros(0))]
            langs, scores, likeness = zip(*parts)
            yield pd.DataFrame({"lang_pred": sum(langs, []), "score": np.concatenate(scores), "likeness": np.concatenate(likeness)})
        give_back()

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return docs.select(*keep, of(F.col("text").cast("string")).alias("_said")).select(*keep, *[F.col("_said")[c].alias(c) for c in made])


def is_known(lang_pred, likeness, text) -> F.Column:
    """Whether a predicted language is one that the text is really written in."""
    lack = F.lit(SHORT) / F.sqrt(F.greatest(F.octet_length(text), F.lit(1)).cast("double"))
    return (lang_pred != UNDETERMINED) & (likeness >= F.lit(LEAST_LIKENESS) - lack)


def held_out(modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of doc_id as text (null: empty) has the remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out(4, 2).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
