"""Homomorphic multiset hash of documents.

Every paragraph (the text between line feeds) hashes to a vector of ``LANES`` small odd numbers;
a document's fingerprint is the sum of its paragraphs' vectors modulo 2**32.  The sum does not
depend on the order of paragraphs, and a paragraph is inserted or deleted by adding or subtracting
its vector.  A long paragraph's vector also holds those of its pieces, which are cut where the words
themselves say so: an edit inside it changes the pieces that it touches and the paragraph's own
vector, and leaves the other pieces.  As the entries have mean zero, the cosine of two fingerprints
estimates the cosine of the two multisets, which serves as their likeness.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import RUN_PARTS, bound_batches, sorted_runs, table, tidy

LANES = 96
PIECE_WORDS = 8  # words of a piece of a long paragraph, about
MOST_PIECE = 64  # and words at most
MOST_WORD = 64  # bytes of a word; longer runs without a blank are cut into such words
ROWS_PER_RUN = 3_000
HELD = 4096  # units that are hashed at once


_WORD = re.compile(rb"\S{1,%d}" % MOST_WORD)
_STEP = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(LANES // 8)], dtype=np.uint64)


def _summed(parts: list[bytes]) -> np.ndarray:
    """Sum of one row of ``LANES`` odd numbers in -255..255 for each part.

    A part's 128-bit hash, two numbers a and b, is spread over the lanes: the bytes of the finalised
    sums a + b * step.
    """
    keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in parts]), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    x = keys[:, :1] + keys[:, 1:] * _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x.astype("<u8").view(np.int8).reshape(-1, LANES).sum(axis=0, dtype=np.int64) * 2 + len(parts)


def pieces(paragraph: bytes) -> list[bytes]:
    """Pieces of a paragraph of more than ``PIECE_WORDS`` words; none of a shorter one.

    A piece ends behind a word whose CRC-32 is a multiple of ``PIECE_WORDS``, or after ``MOST_PIECE``
    words.  The leading byte keeps pieces apart from paragraphs.
    """
    words = _WORD.findall(paragraph)
    if len(words) <= PIECE_WORDS:
        return []
    out, start = [], 0
    ends = [at for at, word in enumerate(words, 1) if crc32(word) % PIECE_WORDS == 0]
    for end in [*ends, len(words)]:
        while start < end:
            stop = min(end, start + MOST_PIECE)
            out.append(b"\n" + b" ".join(words[start:stop]))
            start = stop
    return out


def total(paragraphs: list[bytes]) -> np.ndarray:
    """Sum of the paragraphs' vectors, taken a bounded number of rows at a time."""
    out, held = np.zeros(LANES, dtype=np.int64), []
    for paragraph in paragraphs:
        held.append(paragraph)
        held += pieces(paragraph)
        if len(held) >= HELD:
            out += _summed(held)
            held = []
    return out + _summed(held) if held else out


def _encoded(paragraphs: list[str]) -> list[bytes]:
    return [p.encode("utf-8", "surrogatepass") for p in paragraphs]


def fingerprint(text: str | None) -> np.ndarray:
    """Lanes modulo 2**32; null counts as the empty text, which is one empty paragraph."""
    return (total((text or "").encode("utf-8", "surrogatepass").split(b"\n")) % (1 << 32)).astype(np.uint32)


def insert(lanes: np.ndarray, paragraphs: list[str]) -> np.ndarray:
    return ((lanes.astype(np.int64) + total(_encoded(paragraphs))) % (1 << 32)).astype(np.uint32)


def delete(lanes: np.ndarray, paragraphs: list[str]) -> np.ndarray:
    return ((lanes.astype(np.int64) - total(_encoded(paragraphs))) % (1 << 32)).astype(np.uint32)


def to_hex(lanes: np.ndarray) -> str:
    return lanes.astype(">u4").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of the signed lanes, cut at 0; exactly 1 for equal fingerprints."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a.astype(np.int32).astype(np.float64), b.astype(np.int32).astype(np.float64)
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, (x @ y) / size))) if size else 0.0


def fingerprint_column(text) -> F.Column:
    """Hex fingerprint of a text column."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([to_hex(fingerprint(t)) for t in texts])

    return of(text)


def with_next(docs: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """doc_id, text, next_text: the text of the document that follows in descending doc_id.

    Nulls sort last, equal doc_ids by the texts' CRC-32 and length, and the last document is
    followed by the first.  doc_id quantiles cut the table into runs that are sorted apart, and the
    texts' CRC-32 those of a doc_id, or of none, on very many rows; the first document of a run goes
    to the run before it as well, as a marker behind its last row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = sorted_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", rows_per_run)
    crc = F.crc32(F.col("text").cast("binary"))
    # runs in the order of documents: doc_ids descend, nulls come last, hashes ascend
    run = runs.of(F.col("doc_id"), crc if runs.tied else F.lit(0))
    rank = F.floor(run / RUN_PARTS)
    place = (F.lit(len(runs.bounds) + 2) - rank) * RUN_PARTS + F.pmod(run, F.lit(RUN_PARTS))
    rows = rows.withColumn("_run", place.cast("long"))
    # the smallest of this key is a run's first document; texts are read for it only where they cut a run
    first = F.struct(F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"), *([crc.alias("crc"), F.length("text").alias("size")] if runs.tied else []))
    firsts = rows.groupBy("_run").agg(F.min(first).alias("_first"))  # a row a run
    around = Window.orderBy("_run")
    before = F.coalesce(F.lag("_run").over(around), F.max("_run").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.join(F.broadcast(firsts.select("_run", "_first", before.alias("_before"))), "_run")  # a few numbers a run
    places = F.array(F.struct(F.col("_run").alias("run"), F.lit(0).alias("marker")))
    marker = F.array(F.struct(F.col("_before").alias("run"), F.lit(1).alias("marker")))
    rows = rows.withColumn("_at", F.explode(F.when(first == F.col("_first"), F.concat(places, marker)).otherwise(places)))
    order = Window.partitionBy("_at.run").orderBy("_at.marker", F.desc_nulls_last("doc_id"), crc, F.length("text"))
    rows = rows.select("doc_id", "text", "_at", F.lead("text").over(order).alias("next_text"))
    return rows.where("_at.marker = 0").select("doc_id", "text", "next_text")


def _prints(batches):
    seen, known = None, None  # rows are in order, so a document is the next one of the row before it
    for pdf in batches:
        out = []
        for text, edited, following in zip(pdf["text"], pdf["edited"], pdf["next_text"]):
            own = known if text == seen and known is not None else fingerprint(text)
            other, after = fingerprint(edited), fingerprint(following)
            seen, known = following, after
            out.append((to_hex(own), to_hex(other), likeness(own, other), likeness(own, after)))
        done = pd.DataFrame(out, columns=["fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield pd.concat([pdf[["doc_id", "n_chars", "edited_sha256"]].reset_index(drop=True), done], axis=1)


def fingerprint_edits(docs: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document.  Null texts are empty; texts are read whole, however long; repeated
    rows keep a row each; an only document follows itself; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    rows = with_next(docs, rows_per_run).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / F.lit(2)).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return rows.select("doc_id", "n_chars", "edited_sha256", "text", "edited", "next_text").mapInPandas(
        tidy(_prints),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
