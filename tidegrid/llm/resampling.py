"""Importance resampling of documents towards a target corpus.

Equal texts are collapsed first: one grouping by the full text leaves each distinct text with its
number of copies.  Features (runs of one and two words, hashed into buckets) are counted on distinct
texts, once each, and multiplied by the copies; a bucket's gain is the logarithm of its share in the
target over its share in the corpus.  A distinct text is weighed once, its weight joined back to all
of its documents, and only then each document gets its own noise.  The highest sums are drawn.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import bound_batches, give_back, materialize, release, table, tidy

BUCKETS = 10_000
SHARE = 25  # per cent of the eligible documents that are drawn
LEAST_WORDS = 20
SEED = 7
HOT_SHARE = 1024  # a text with over a 1,024th of all rows is looked up apart: at most 1,024 are
RANK_ROWS = 250_000  # rows of a sorted run, about

# Bytes of words once A-Z are lower-cased: digits, letters and all of any character above U+007F.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def feature_codes(text: str | None) -> tuple[np.ndarray, int]:
    """CRC-32 of every feature of a text, repeats included, and its number of words."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    crc32 = zlib.crc32
    single = [crc32(w) for w in words]
    double = [crc32(w, crc32(b" ", c)) for c, w in zip(single, words[1:])]
    return np.array(single + double, dtype=np.int64), len(words)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """digest, copies, text: every distinct text of ``docs``; null is the empty text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select(F.sha2("text", 256).alias("digest"), "copies", "text")


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over texts (copies, text); a task adds its own up before anything is sent."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            for text, copies in zip(pdf["text"], pdf["copies"]):
                codes, _ = feature_codes(text)
                total += np.bincount(codes % buckets, minlength=buckets) * copies
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    counted = texts.select("copies", "text").mapInPandas(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the logarithm of target share over corpus share, each bucket counted once more."""
    n, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n)))).astype(np.int64)


def weigh(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, copies, n_words, n_features, weight of texts (digest, copies, text)."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for text in part:
                codes, n = feature_codes(text)
                rows.append((n, len(codes), int(gain[codes % len(gain)].sum()) // len(codes) if len(codes) else 0))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])
        give_back()

    return texts.select("digest", "copies", of("text").alias("w")).select("digest", "copies", "w.*")


def _ranked(rows: DataFrame, draw: int) -> DataFrame:
    """``rows`` with rank: 1 to ``draw`` for eligible rows by falling score, doc_id and digest; else null.

    Rows are dealt into sorted runs by all of these columns, so one score or one doc_id on very many
    rows is cut too; runs are numbered inside their task and their sizes (a number a run) added up.
    """
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("digest")]
    eligible = rows.where("_eligible")
    runs = max(1, eligible.count() // RANK_ROWS)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        run, at = TaskContext.get().partitionId(), 0
        for pdf in batches:
            pdf["_run"], pdf["_at"] = run, np.arange(at + 1, at + len(pdf) + 1)
            at += len(pdf)
            yield pdf

    kept = eligible.drop("_eligible")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), "_run int, _at long"])
    numbered = materialize(kept.repartitionByRange(runs, *order).sortWithinPartitions(*order).mapInPandas(number, schema))
    sizes = numbered.groupBy("_run").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    offsets = sizes.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_at") + F.col("_before")
    drawn = numbered.join(F.broadcast(offsets), "_run").withColumn("rank", F.when(rank <= draw, rank)).drop("_run", "_at", "_before")
    return drawn.unionByName(rows.where(~F.col("_eligible")).drop("_eligible").withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``.

    ``docs`` has doc_id and text, ``target`` has text.  A null text is the empty one: no features,
    weight 0, never drawn.  Null doc_ids are numbered like an empty id and come first among ties;
    repeated rows are scored alike and each has a rank of its own; with no target rows, all of a
    bucket's gain comes from the corpus.  Texts are read whole.  An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    texts = materialize(distinct_texts(docs))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(distinct_texts(target), buckets))
    weights = materialize(weigh(texts, gain))
    release(texts)
    sums = weights.agg(F.sum("copies").alias("rows"), F.sum(F.when(F.col("n_words") >= least_words, F.col("copies"))).alias("eligible")).first()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"))
    # Texts with very many copies are few, and looked up by a broadcast of at most HOT_SHARE rows; their documents
    # have keys of their own in the other lookup, so no task of it gathers them.
    hot = F.col("copies") > (sums.rows or 0) / HOT_SHARE
    measures = F.struct("n_words", "n_features", "weight")
    rows = rows.join(F.broadcast(weights.where(hot).select("digest", measures.alias("_hot"))), "digest", "left")
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id"))))
    rows = rows.join(weights.where(~hot).select(F.col("digest").alias("_key"), measures.alias("_cold")), "_key", "left")
    rows = rows.select("doc_id", "digest", F.coalesce("_hot", "_cold").alias("_m")).select("doc_id", "digest", "_m.*")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = rows.select(
        "doc_id", "digest", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("_eligible")
    )
    scored = materialize(scored)
    return _ranked(scored, share * (sums.eligible or 0) // 100).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Every document on its own, CRC-32 by its definition over every byte.
OP11_SQL = r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
           lambda c, r: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
lut AS (SELECT list(v ORDER BY i) AS l FROM bits),
worded AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
targeted AS MATERIALIZED (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
used AS MATERIALIZED (
  SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM worded),
wanted AS MATERIALIZED (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM targeted),
coded AS MATERIALIZED (
  SELECT feature, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, x: xor(c // 256, lut.l[(xor(c, x) % 256) + 1]))) % 10000 AS bucket
  FROM (SELECT feature FROM used UNION SELECT feature FROM wanted) f, lut),
corpus AS (SELECT bucket, count(*) AS n FROM used JOIN coded USING (feature) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM wanted JOIN coded USING (feature) GROUP BY bucket),
gained AS MATERIALIZED (
  SELECT b.bucket, floor(1000.0::DOUBLE * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM corpus) + 10000)::DOUBLE
         / ((coalesce(c.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM target) + 10000)::DOUBLE))) AS gain
  FROM range(10000) b(bucket) LEFT JOIN corpus c USING (bucket) LEFT JOIN target t USING (bucket)),
weighed AS (SELECT row, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM used JOIN coded USING (feature) JOIN gained USING (bucket) GROUP BY row),
scored AS (
  SELECT d.row, d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(d.w) >= 20 AS eligible,
         coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM worded d LEFT JOIN weighed USING (row)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (eligible) OVER () AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN eligible AND place <= 25 * n // 100 THEN place END AS BIGINT) AS rank
FROM ordered
"""
