"""Mixing documents to target weights by soft domain membership.

A classifier learned from a labelled table predicts a posterior over domains for every document.
Distributed projected gradient descent then fits a nonnegative rate for every document so that the
expected token totals of the domains, the sum of rate * tokens * posterior, match the targets in
the least-squares sense.  DataFrame functions only: each gradient step is one aggregation, and only
a few numbers for each pair of domains reach the driver.

The gradient is preconditioned.  Changes of a rate count by the row's tokens, so a step moves rate
times tokens and a long document moves like a short one; the domains' misses are whitened by the
Gram matrix of the posteriors, so a step of 1 never overshoots, and where no rate falls to 0 one
step ends the work.  A rate depends on its own posterior and the misses alone: it is a function of
the short history of misses, and no step rewrites the table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import materialize, release, table

#: Largest relative miss of a domain's target that ends the steps, and most steps, where no rates meet the targets.
TOLERANCE, MOST_STEPS = 1e-4, 50
RIDGE = 1e-9  # share of the Gram matrix's trace added to its diagonal: domains may coincide or be empty
VARIANCE_FLOOR = 1e-3
#: Wanted weight of each domain among the tokens that the rates give.
TARGETS = {"high": 0.97, "low": 0.03}
#: Features that more text of the same kind leaves as they are; fresh is counted in windows of so many words.
FEATURES = ("word_chars", "capitals", "digits", "marks", "wide", "lines", "fresh")
WINDOW = 50


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once a row, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def _distinct_in_windows(words: Column) -> Column:
    """Distinct words of each window of WINDOW words, added up over the whole text."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(WINDOW))
    return F.aggregate(starts, F.lit(0), lambda n, at: n + F.size(F.array_distinct(F.slice(words, at, WINDOW))))


def counts(text: Column) -> Column:
    """What the features of a text are made of, all 0 for an empty one; words lie between blanks."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0))
    both = _once(words, lambda w: F.struct(F.size(w).alias("size"), _distinct_in_windows(w).alias("distinct")))
    size, distinct = both["size"], both["distinct"]
    return F.struct(
        size.cast("double").alias("words"),
        distinct.cast("double").alias("distinct"),
        F.length(text).cast("double").alias("chars"),
        F.octet_length(text).cast("double").alias("bytes"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("double").alias("capitals"),
        F.regexp_count(text, F.lit("[0-9]")).cast("double").alias("digits"),
        F.regexp_count(text, F.lit("[!-/:-@\\[-`{-~]")).cast("double").alias("marks"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("double").alias("lines"),
    )


def dense(raw: Column) -> Column:
    """tokens and the dense features."""
    per_char = lambda name: F.sqrt(raw[name] / F.greatest(raw["chars"], F.lit(1.0)))
    per_word = lambda name: raw[name] / F.greatest(raw["words"], F.lit(1.0))
    return F.struct(
        raw["words"].alias("tokens"),
        F.log1p(per_word("chars")).alias("word_chars"),
        per_char("capitals").alias("capitals"),
        per_char("digits").alias("digits"),
        per_char("marks").alias("marks"),
        F.sqrt((raw["bytes"] - raw["chars"]) / F.greatest(raw["chars"], F.lit(1.0))).alias("wide"),
        per_char("lines").alias("lines"),
        per_word("distinct").alias("fresh"),
    )


def fit_domains(measured: DataFrame, labels: DataFrame) -> dict[str, dict]:
    """Gaussian class model of every domain: prior, and mean and variance of each feature.

    ``labels`` has doc_id and domain; a doc_id with several domains counts for the smallest name.
    One aggregation over all labelled rows; a row for each domain reaches the driver.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    stats = [f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("mean", F.avg), ("var", F.var_pop))]
    rows = measured.join(marks, "doc_id").groupBy("domain").agg(F.count("*").alias("n"), *stats).collect()
    total = sum(r.n for r in rows)
    return {
        r.domain: {
            "prior": r.n / total,
            "mean": [r[f"mean_{c}"] for c in FEATURES],
            "var": [r[f"var_{c}"] + VARIANCE_FLOOR for c in FEATURES],
        }
        for r in sorted(rows, key=lambda r: r.domain)
    }


def posteriors(model: dict[str, dict], row) -> Column:
    """Posterior of every domain, in the order of names, as an array that sums to one.

    ``row`` gives the column of a feature's name.
    """
    logs = []
    for m in model.values():
        start = math.log(m["prior"]) - 0.5 * sum(math.log(v) for v in m["var"])
        terms = [(row(c) - F.lit(mu)) * (row(c) - F.lit(mu)) * F.lit(-0.5 / v) for c, mu, v in zip(FEATURES, m["mean"], m["var"])]
        logs.append(sum(terms, F.lit(start)))
    shifted = _once(F.array(*logs), lambda scores: F.transform(scores, lambda x: F.exp(x - F.array_max(scores))))
    return _once(shifted, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y)))


def fit_rates(soft: DataFrame, targets: list[float]):
    """A function from columns of tokens and posterior to the column of nonnegative rates.

    Projected gradient steps from rates of 1 on the squared misses of the domains' expected token
    totals, whitened by the Gram matrix sum of tokens * posterior * posterior', in the metric that
    weighs a rate's change by its tokens.  In it the whole curvature is at most 1, so steps are of
    length 1: a step takes the whitened misses, weighted by its posterior, from every rate, and 0
    where that is negative.  Steps end when every domain's total is within TOLERANCE of its target (of
    all tokens for a target of 0), or after MOST_STEPS: targets that no rates meet are then missed by
    what is left.  Rows without tokens keep rate 1.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = [F.col("posterior")[i] for i in range(k)]
    sums = soft.agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    everything = float(sums.tokens or 0.0)
    if not everything:
        return lambda tokens, posterior: F.lit(1.0)
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    gram += np.eye(k) * RIDGE * np.trace(gram)
    goal, size = np.array(targets), np.array([t if t > 0 else everything for t in targets])
    history: list[list[float]] = []

    def rate(tokens: Column, posterior: Column) -> Column:
        if not history:
            return F.lit(1.0)
        pulls = F.array(*[F.array(*[F.lit(x) for x in h]) for h in history])
        pull = lambda h: sum((posterior[i] * h[i] for i in range(1, k)), posterior[0] * h[0])
        moved = F.aggregate(pulls, F.lit(1.0), lambda r, h: F.greatest(F.lit(0.0), r - pull(h)))
        return F.when(tokens > 0, moved).otherwise(F.lit(1.0))

    for _ in range(MOST_STEPS):
        rates = soft.select("tokens", "posterior", rate(F.col("tokens"), F.col("posterior")).alias("rate"))
        totals = rates.agg(*[F.sum(F.col("rate") * F.col("tokens") * p[i]).alias(f"t{i}") for i in range(k)]).first()
        miss = np.array([totals[i] for i in range(k)]) - goal
        if max(abs(miss) / size) <= TOLERANCE:
            break
        history.append(np.linalg.solve(gram, miss).tolist())
    return rate


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies whose mean over documents is the rate: its floor, and one more by a fixed draw of the id."""
    drawn = F.pmod(F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(2147483647)) * F.lit(1103515245) + F.lit(12345), F.lit(2147483647))
    return (F.floor(rate) + F.when(drawn / F.lit(2147483647.0) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain from the labelled table: high or low quality."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def token_targets(soft: DataFrame, domains: list[str], weights: dict[str, float]) -> list[float]:
    """Token totals at these weights that leave the heaviest domain's expected total as it is.

    A domain without a weight gets 0; a weight whose domain is not there is left out.  Where no
    domain has a weight, the targets are what there is.
    """
    held = [weights.get(d, 0.0) for d in domains]
    if not sum(held):  # nothing is wanted of any labelled domain, so nothing changes
        totals = soft.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in range(len(domains))]).first()
        return [t or 0.0 for t in totals]
    at = max(range(len(held)), key=lambda i: held[i])
    own = soft.agg(F.sum(F.col("tokens") * F.col("posterior")[at]).alias("t")).first().t or 0.0
    return [w * own / held[at] for w in held]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, tokens, posterior, rate, copies for every row of ``docs``.

    ``labels`` has doc_id, domain.  ``targets`` are the domains' wanted weights, turned into token
    totals by ``token_targets``.  posterior is in the order of the domains' names.  Texts without words
    (null ones too) have no tokens and keep rate 1; without labels every rate is 1 and posterior is empty, and where no
    labelled domain has a weight rates stay 1.  Very long texts are measured whole; repeated rows keep a
    row each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    soft, model, fitted, measured = _fit(docs, labels, targets)
    if model:
        release(measured)
    rated = soft.withColumn("rate", fitted(F.col("tokens"), F.col("posterior")))
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def _fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], whole: bool = False):
    """(doc_id, tokens and posterior of every row; the domains' model; the rates' function; what was measured).

    With ``whole`` the measured table also carries the rows themselves, as ``_row``.
    """
    made = _once(counts(F.col("text")), dense).alias("_made")
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []
    measured = docs.select(*rows, F.col("doc_id").cast("long").alias("doc_id"), made)
    measured = materialize(measured.select(*(["_row"] if whole else []), "doc_id", "_made.*"))
    model = fit_domains(measured, labels)
    if not model:
        return measured.select("doc_id", "tokens", F.array().cast("array<double>").alias("posterior")), model, lambda t, p: F.lit(1.0), measured
    soft = materialize(measured.select("doc_id", "tokens", posteriors(model, F.col).alias("posterior")))
    return soft, model, fit_rates(soft, token_targets(soft, list(model), targets)), measured


def mix_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its ``copies`` says; nothing is shuffled.

    Cases are those of ``mix``.  Texts are measured once: the rows are written with their features,
    from which posteriors and rates follow.
    """
    soft, model, fitted, measured = _fit(docs, labels, targets, whole=True)
    if not model:
        return measured.select("_row.*")
    release(soft)
    rate = _once(posteriors(model, F.col), lambda p: fitted(F.col("tokens"), p))
    times = _once(rate, lambda r: copies(r, F.col("doc_id")))
    return measured.select("_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("_row.*")


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents; rate and the posteriors are rounded to 6 places."""
    mixed = mix(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")))
    share = lambda i: F.round(F.get("posterior", F.lit(i)), 6)
    return mixed.select(
        "doc_id",
        F.col("tokens").cast("long").alias("tokens"),
        share(0).alias("p_high"),
        share(1).alias("p_low"),
        F.round("rate", 6).alias("rate"),
        "copies",
    )


def _op5_sql() -> str:
    """The same model and steps as one recursive query over the whole table."""
    names = ("high", "low")
    stats = ", ".join(f"avg({c}) AS mean_{c}, var_pop({c}) + {VARIANCE_FLOOR} AS var_{c}" for c in FEATURES)
    score = " + ".join(f"-0.5 * (ln(var_{c}) + (f.{c} - mean_{c}) * (f.{c} - mean_{c}) / var_{c})" for c in FEATURES)
    goal = {n: f"({TARGETS[n]}::DOUBLE * own / {TARGETS['high']}::DOUBLE)" for n in names}
    sums = ", ".join(f"sum(tokens * p_{a} * p_{b}) AS g_{a}_{b}" for a in names for b in names)
    miss = {n: f"(t_{n} - {goal[n]})" for n in names}
    pull = "p_high * (g_low_low * {h} - g_high_low * {l}) / det + p_low * (g_high_high * {l} - g_high_low * {h}) / det".format(h=miss["high"], l=miss["low"])
    totals = ", ".join(f"sum(rate * tokens * p_{n}) OVER () AS t_{n}" for n in names)
    off = "greatest(" + ", ".join(f"abs({miss[n]}) / {goal[n]}" for n in names) + ")"
    return f"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS words FROM documents
),
said AS (SELECT row, unnest(words) AS word, (generate_subscripts(words, 1) - 1) // {WINDOW} AS part FROM raw),
new AS (SELECT row, count(*) AS fresh FROM (SELECT DISTINCT row, part, word FROM said) d GROUP BY row),
counted AS (
  SELECT doc_id, len(words)::DOUBLE AS words, coalesce(fresh, 0)::DOUBLE AS fresh, length(t)::DOUBLE AS chars,
         strlen(t)::DOUBLE AS bytes,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::DOUBLE AS capitals,
         (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::DOUBLE AS digits,
         (length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g')))::DOUBLE AS marks,
         (length(t) - length(replace(t, chr(10), '')))::DOUBLE AS lines
  FROM raw LEFT JOIN new USING (row)
),
feats AS (
  SELECT doc_id, words AS tokens, ln(1 + chars / greatest(words, 1)) AS word_chars,
         sqrt(capitals / greatest(chars, 1)) AS capitals, sqrt(digits / greatest(chars, 1)) AS digits,
         sqrt(marks / greatest(chars, 1)) AS marks, sqrt((bytes - chars) / greatest(chars, 1)) AS wide,
         sqrt(lines / greatest(chars, 1)) AS lines, fresh / greatest(words, 1) AS fresh
  FROM counted
),
marks AS (
  SELECT doc_id, min(CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END) AS domain
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
model AS (
  SELECT domain, ln(count(*) / sum(count(*)) OVER ()) AS start, {stats}
  FROM feats JOIN marks USING (doc_id) WHERE domain IS NOT NULL GROUP BY domain
),
scored AS (SELECT row, doc_id, tokens, domain, start + {score} AS s FROM (SELECT row_number() OVER () AS row, * FROM feats) f, model),
peaked AS (SELECT *, exp(s - max(s) OVER (PARTITION BY row)) AS e FROM scored),
parted AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(tokens) AS tokens,
         {", ".join(f"sum(e) FILTER (domain = '{n}') / sum(e) AS p_{n}" for n in names)}
  FROM peaked GROUP BY row
),
soft AS (SELECT *, sum(tokens * p_high) OVER () AS own FROM parted),
sums AS (SELECT {sums} FROM soft),
ridged AS (SELECT g_high_high + {RIDGE} * (g_high_high + g_low_low) AS g_high_high, g_high_low, g_low_low + {RIDGE} * (g_high_high + g_low_low) AS g_low_low FROM sums),
gram AS (SELECT *, g_high_high * g_low_low - g_high_low * g_high_low AS det FROM ridged),
descent AS (
  SELECT 0 AS it, row, doc_id, tokens, p_high, p_low, own, g_high_high, g_high_low, g_low_low, det, 1.0::DOUBLE AS rate FROM soft, gram
  UNION ALL
  SELECT it + 1, row, doc_id, tokens, p_high, p_low, own, g_high_high, g_high_low, g_low_low, det,
         CASE WHEN tokens > 0 THEN greatest(0.0, rate - ({pull})) ELSE 1.0 END
  FROM (SELECT *, {totals} FROM descent WHERE it < {MOST_STEPS}) d WHERE {off} > {TOLERANCE}
)
SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, {", ".join(f"round(p_{n}, 6) AS p_{n}" for n in names)}, round(rate, 6) AS rate,
  CAST(floor(rate) + CASE WHEN ((coalesce(doc_id, 0) % 2147483647 * 1103515245 + 12345) % 2147483647) / 2147483647.0 < rate - floor(rate)
    THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM descent WHERE it = (SELECT max(it) FROM descent)
"""


OP5_SQL = _op5_sql()
