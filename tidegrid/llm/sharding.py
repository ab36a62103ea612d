"""Jump consistent hashing: stable keys to shards without a ring table.

DataFrame functions only.  The 64-bit generator of the published jump hash is kept as two 32-bit
halves in LONG columns, so no product leaves the signed range and ANSI arithmetic never overflows.
Every row first takes ``FAST_STEPS`` jumps; the rare rows that are not done by then go on for as
many steps as there are shards, which always suffices, so no row is cut short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import crc_text, sorted_runs, table

# Fixed value: the multiplier of the published jump consistent hash generator.
MULTIPLIER = 2862933555777941757
MULT_HIGH, MULT_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK32 = 0xFFFFFFFF
FAST_STEPS = 12
SHARDS = 40
ROWS_PER_CHUNK = 2_000_000


def _low32_product(a: Column, factor: int) -> Column:
    """(a * factor) mod 2**32 for 32-bit a and factor."""
    low, high = factor & 0xFFFF, factor >> 16
    return (a * F.lit(low) + F.shiftleft((a * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK32))


def _jump(state: Column, n: int) -> Column:
    """One jump of the generator; a no-op once the state has passed the last shard."""
    hi, lo, j = state["hi"], state["lo"], state["j"]
    part0 = lo * F.lit(MULT_LOW & 0xFFFF)
    part1 = lo * F.lit(MULT_LOW >> 16)
    low_sum = part0 + F.shiftleft(part1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    new_lo = low_sum.bitwiseAND(F.lit(MASK32))
    carry = F.shiftrightunsigned(low_sum, 32) + F.shiftrightunsigned(part1, 16)
    new_hi = (carry + _low32_product(hi, MULT_LOW) + _low32_product(lo, MULT_HIGH)).bitwiseAND(F.lit(MASK32))
    top31 = F.shiftrightunsigned(new_hi, 1).cast("double")
    step = F.floor((j.cast("double") + F.lit(1.0)) * (F.lit(float(1 << 31)) / (top31 + F.lit(1.0))))
    moved = F.struct(
        new_hi.alias("hi"), new_lo.alias("lo"), j.alias("b"), F.least(step, F.lit(n + 1).cast("long")).alias("j")
    )
    return F.when(j < F.lit(n), moved).otherwise(state)


def jump_hash(key: Column, n: int) -> Column:
    """Shard in [0, n) of a LONG key; null keys count as key 0."""
    if n < 1:
        raise ValueError("n must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(MASK32)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    begun = F.reduce(F.sequence(F.lit(1), F.lit(min(n, FAST_STEPS))), start, lambda s, _: _jump(s, n))
    if n <= FAST_STEPS:
        return begun["b"].cast("int")
    rest = lambda s: F.when(
        s["j"] >= F.lit(n), F.array().cast("array<int>")
    ).otherwise(F.sequence(F.lit(1), F.lit(n)))
    # the one-element transform evaluates the first steps once and names them for the rest
    done = F.transform(F.array(begun), lambda s: F.reduce(rest(s), s, lambda t, _: _jump(t, n))["b"])
    return done[0].cast("int")


def shard_documents(docs: DataFrame, shards: int, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``key``: doc_id and the shard count alone decide.  ``size`` is the text's UTF-8
    bytes plus 16 (16 for null texts).  ``slot`` numbers each shard's rows from 0 in the order
    (doc_id, text_crc32, size), nulls first; repeated rows get a slot each.  A shard is never
    sorted as a whole: doc_id quantiles cut it into runs, and text_crc32 those of a doc_id (or of no
    doc_id) on very many rows; run sizes are counted first and their running totals (one number per
    shard and run) offset the numbering inside each run.  Very long texts are read whole.  Null
    doc_ids hash as key 0.  An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    runs = sorted_runs(ids, "doc_id", rows_per_chunk)
    # texts are read for the count too only where their hashes cut a run
    run_of = lambda tie: runs.of(F.col("doc_id").cast("long"), tie if runs.tied else F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(16)).alias("size"),
        crc_text(F.col("text")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        run_of(crc_text(F.col("text"))).alias("_run"),
    )
    run = Window.partitionBy("shard", "_run").orderBy(
        F.asc_nulls_first("doc_id"), F.asc("text_crc32"), F.asc("size")
    )
    rows = rows.withColumn("_at", F.row_number().over(run).cast("long") - F.lit(1))
    if runs.bounds or runs.tied:
        counted = (
            docs.select(jump_hash(F.col("doc_id"), shards).alias("shard"), run_of(crc_text(F.col("text"))).alias("_run"))
            .groupBy("shard", "_run")
            .agg(F.count("*").alias("_n"))
        )
        before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counted.select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        rows = rows.join(offsets, ["shard", "_run"])  # Spark broadcasts it only while it is small
    else:
        rows = rows.withColumn("_before", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_at") + F.col("_before")).alias("slot"), "grown_shard"
    )


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


# CRC-32 by its definition over every byte, jump hash as a recursion in HUGEINT arithmetic.
OP2_SQL = """
WITH RECURSIVE ns(n) AS (VALUES (40), (41)),
ids AS (SELECT DISTINCT doc_id FROM documents),
jump(doc_id, n, k, b, j) AS (
  SELECT doc_id, n, CAST(coalesce(doc_id, 0) AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM ids, ns
  UNION ALL
  SELECT doc_id, n, k2, j,
         CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS k2 FROM jump WHERE j < n) s
),
placed AS (SELECT doc_id, max(b) FILTER (n = 40) AS shard, max(b) FILTER (n = 41) AS grown FROM jump GROUP BY doc_id),
bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
           lambda c, r: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
lut AS (SELECT list(v ORDER BY i) AS l FROM bits),
hexed AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, hex(encode(coalesce(text, ''))) AS h FROM documents
),
crc AS (
  SELECT doc_id, bytes + 16 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, x: xor(c // 256, lut.l[(xor(c, x) % 256) + 1]))) AS crc
  FROM hexed, lut
)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, CAST(c.crc AS BIGINT) AS text_crc32, 'key' AS law,
       CAST(p.shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY p.shard ORDER BY c.doc_id NULLS FIRST, c.crc, c.size) - 1 AS BIGINT) AS slot,
       CAST(p.grown AS INTEGER) AS grown_shard
FROM crc c JOIN placed p ON c.doc_id IS NOT DISTINCT FROM p.doc_id
"""
