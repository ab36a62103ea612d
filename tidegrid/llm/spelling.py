"""Spelling variants: words one edit apart, found by range reporting in two orders.

Each word is a point: its place in forward order and its place in the order of reversed words.  Words
that differ from it at edit position i share its prefix before i and its suffix behind i, so they lie
in a rectangle: the prefix's interval in forward order by the suffix's interval in reverse order.  A
wavelet tree over the reverse places, in forward order, reports what is in it.

Lexicons are cut into blocks that hold whole answers: an edit in the second half of a word leaves its
first half, one in the first half leaves its second half, so words meet at the hash of either half.  A
half that very many words share is cut further, by each edit position and all that is around it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import bound_batches, give_back, materialize, release, table, tidy

LEAST_LENGTH, LEAST_ROWS, NOISE = 5, 3, 97
BLOCK_ROWS = 32_768  # entries of a block, about
HOT_ROWS = BLOCK_ROWS // 4  # entries of one half from which it is cut by edit position
QUERIES_AT_ONCE = 65_536

# Bytes of a run in Latin-1, A-Z lower-cased; characters beyond Latin-1 end a run.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def word_counts(text: str | None, doc_id: int | None) -> Counter:
    """Words of a text with their counts; a run whose hash with doc_id is divisible by NOISE loses a character."""
    runs = Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower()))
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def lexicon(docs: DataFrame, least_length: int = LEAST_LENGTH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """word, n: words of at least so many characters and occurrences over all ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: Counter = Counter()
            for text, doc_id in zip(pdf["text"], pdf["doc_id"]):
                total.update(word_counts(text, None if pd.isna(doc_id) else doc_id))
            long = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= least_length]
            yield pd.DataFrame(long, columns=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInPandas(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_rows)


class WaveletTree:
    """Numbers below ``2 ** bits`` in a fixed order; reports those of a rectangle of places and values."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for level in range(bits):
            one = (values >> (bits - 1 - level)) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every value in [low, high) at a place in [lo, hi), for many queries at once."""
        query, node = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            left, right = zeros[lo], zeros[hi]
            lo = np.concatenate([left, zeros[-1] + lo - left])
            hi = np.concatenate([right, zeros[-1] + hi - right])
            query, node = np.tile(query, 2), np.concatenate([2 * node, 2 * node + 1])
            rest = self.bits - 1 - level
            held = (lo < hi) & (node << rest < high[query]) & ((node + 1) << rest > low[query])
            query, node, lo, hi = query[held], node[held], lo[held], hi[held]
        return query, node


def _sorted_order(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``words``, their characters in that order (0 behind the end), and each one's common prefix with the one before."""
    array = np.array(words, dtype=f"S{width}")
    order = np.argsort(array, kind="stable")
    chars = array[order].view(np.uint8).reshape(len(words), width)
    common = np.zeros(len(words), dtype=np.int64)
    common[1:] = (chars[1:] != chars[:-1]).argmax(axis=1)
    return order, chars, common


def _intervals(common: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interval of the words that share the first ``length`` characters with the word at each place ``at``."""
    starts = np.flatnonzero(common < length) if length else np.zeros(1, dtype=np.int64)
    mine = np.searchsorted(starts, at, side="right") - 1
    return starts[mine], np.append(starts, len(common))[mine + 1]


def near_words(entries: pd.DataFrame, length: int) -> pd.DataFrame:
    """word, n_near, near, near_n from entries (word, n, longer, first, last, replaced, inserted) of one block.

    Entries of ``length`` characters ask for edit positions ``first`` to ``last`` - 1; they are near
    each other by one replaced character, and near ``longer`` entries by one inserted.  ``near`` is the
    near word with the largest n, the smallest of equals.
    """
    words = [w.encode("latin-1") for w in entries["word"]]
    known = dict(zip(words, entries["n"]))
    order, chars, common = _sorted_order(list(known), length + 1)
    n = np.fromiter(known.values(), dtype=np.int64)[order]
    names = list(known)
    names = [names[i] for i in order]
    back, _, common_back = _sorted_order([w[::-1] for w in names], length + 1)
    back_place = np.empty(len(n), dtype=np.int64)
    back_place[back] = np.arange(len(n))
    longer = chars[:, length] != 0
    place = dict(zip(names, range(len(n))))
    asks = entries[~entries["longer"].to_numpy()]
    ask_at = np.array([place[w.encode("latin-1")] for w in asks["word"]], dtype=np.int64)
    first, last = asks["first"].to_numpy(), asks["last"].to_numpy()
    bits = max(1, int(len(n) - 1).bit_length())
    found_a, found_b = [], []
    for kind, targets, shared in (("replaced", ~longer, length - 1), ("inserted", longer, length)):
        before = np.concatenate([[0], np.cumsum(targets)])
        tree = WaveletTree(back_place[targets], bits)
        # two words' common prefix is that of some neighbours in order, so no other edit position has an answer
        for i in np.unique(common):
            if i > shared:
                continue
            who = ask_at[(first <= i) & (i < last) & asks[kind].to_numpy()]
            lo, hi = _intervals(common, who, i)
            low, high = _intervals(common_back, back_place[who], shared - i)
            lo, hi = before[lo], before[hi]
            use = (hi > lo) & (high > low + 1)  # more in reverse order than the word itself
            who, lo, hi, low, high = who[use], lo[use], hi[use], low[use], high[use]
            for at in range(0, len(who), QUERIES_AT_ONCE):
                part = slice(at, at + QUERIES_AT_ONCE)
                query, value = tree.report(lo[part], hi[part], low[part], high[part])
                a, b = who[part][query], back[value]
                new = chars[a, i] != chars[b, i]  # not the word itself; a repeated letter inserted counts at its last place only
                a, b = a[new], b[new]
                found_a += [a] if kind == "replaced" else [a, b]
                found_b += [b] if kind == "replaced" else [b, a]
    if not found_a:
        return pd.DataFrame({"word": [], "n_near": [], "near": [], "near_n": []})
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    liked = np.empty(len(n), dtype=np.int64)
    by_n = np.lexsort((np.arange(len(n)), -n))
    liked[by_n] = np.arange(len(n))
    best = np.full(len(n), len(n), dtype=np.int64)
    np.minimum.at(best, a, liked[b])
    counts = np.bincount(a, minlength=len(n))
    held = np.flatnonzero(counts)
    near = by_n[best[held]]
    text = lambda places: [names[i].decode("latin-1") for i in places]
    return pd.DataFrame({"word": text(held), "n_near": counts[held], "near": text(near), "near_n": n[near]})


def _entries(words: DataFrame) -> DataFrame:
    """Entries of ``words`` (word, n), one for either half as a word of its length and as one with a letter too many."""
    size = F.length("word")
    entry = lambda side, length, longer: F.struct(
        F.lit(side).alias("side"), length.alias("length"), F.lit(longer).alias("longer"),
        (F.left("word", (length / 2).cast("int")) if side == "front" else F.right("word", length - (length / 2).cast("int"))).alias("half"),
    )
    four = F.array(*[entry(side, length, longer) for side in ("front", "back") for length, longer in ((size, False), (size - 1, True))])
    return words.select("word", "n", F.explode(four).alias("e")).select("word", "n", "e.*")


def _blocks(words: DataFrame, block_rows: int, hot_rows: int) -> DataFrame:
    """Entries with their block: by the half, or where over ``hot_rows`` entries share it by what is around each edit position."""
    entries = _entries(words)
    blocks = max(1, 4 * words.count() // block_rows)
    half = ["side", "length", "half"]
    # at most one half for every ``hot_rows`` entries
    hot = entries.groupBy(*half).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*half, F.lit(True).alias("_hot"))
    entries = entries.join(F.broadcast(hot), half, "left")
    middle = (F.col("length") / 2).cast("int")
    front = F.col("side") == "front"
    first, last = F.when(front, middle).otherwise(0), F.when(front, F.col("length") + 1).otherwise(middle)
    dealt = lambda *key: F.pmod(F.xxhash64("side", "length", *key), F.lit(blocks)).cast("int")
    fields = ["word", "n", "length", "longer"]
    cold = entries.where("_hot IS NULL").select(
        dealt("half").alias("block"), *fields, first.alias("first"), last.alias("last"), (~F.col("longer")).alias("replaced"), (~F.col("longer")).alias("inserted")
    )
    at = entries.where("_hot").withColumn("i", F.explode(F.sequence(first, last - 1)))
    head, tail = F.left("word", F.col("i")), lambda skip: F.substring("word", F.col("i") + 1 + skip, F.length("word"))
    around = lambda skip, kind: dealt(F.lit(kind), "i", head, F.lit("|"), tail(skip))
    ways = F.when(F.col("longer"), F.array(F.struct(around(1, "i").alias("block"), F.lit(False).alias("replaced"), F.lit(False).alias("inserted")))).otherwise(
        F.array(
            F.struct(around(1, "r").alias("block"), F.lit(True).alias("replaced"), F.lit(False).alias("inserted")),
            F.struct(around(0, "i").alias("block"), F.lit(False).alias("replaced"), F.lit(True).alias("inserted")),
        )
    )
    split = at.withColumn("w", F.explode(ways)).select(
        "w.block", *fields, F.col("i").alias("first"), (F.col("i") + 1).alias("last"), "w.replaced", "w.inserted"
    )
    return cold.unionByName(split)


def nearest_spellings(words: DataFrame, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, n_near, near, near_n of the words of ``words`` (word, n; each once) that have a near word."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [near_words(part, int(length)) for length, part in pdf.groupby("length") if not part["longer"].all()]
        give_back()
        out = pd.concat(parts) if parts else pd.DataFrame({"word": [], "n_near": [], "near": [], "near_n": []})
        return out.astype({"word": object, "near": object, "n_near": "int64", "near_n": "int64"})

    found = _blocks(words, block_rows, hot_rows).groupBy("block").applyInPandas(work, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near", (-F.col("b.m")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): forms followed to the last, twice as far in every round.

    A form has at least twice its word's n, so chains are short and never run in circles.
    """
    roots = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        farther = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = farther.where("_moved").limit(1).count()
        release(roots)
        roots = farther.select("word", "root")
        roots._tidegrid_path = farther._tidegrid_path
        if not moved:
            return roots


def group_spellings(docs: DataFrame, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the whole texts of ``docs`` (doc_id, text).

    Null and empty texts have no words; a null doc_id hashes as an empty one.  Repeated rows count
    again.  Among near words of equal n the smallest in code-point order is the form.  Words are taken
    whole, however long: edit positions are tried only where some word of the block branches off.  A
    table without words gives no rows; other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    words = materialize(lexicon(docs))
    near = nearest_spellings(words, block_rows, hot_rows)
    is_form = F.col("near_n") >= 2 * F.col("n")
    known = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
        )
    )
    release(words)
    roots = _roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


# Near words by what is left when a position is taken out; CRC-32 by its definition over every byte.
OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
           lambda c, r: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
lut AS (SELECT list(v ORDER BY i) AS l FROM bits),
said AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
runs AS MATERIALIZED (SELECT id, run, count(*) AS n FROM said GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, x: xor(c // 256, lut.l[(xor(c, x) % 256) + 1]))) AS h
  FROM runs, lut),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) r
  GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM words, LATERAL (SELECT unnest(range(length(word))) AS i) p),
shorter AS MATERIALIZED (SELECT DISTINCT c.word AS longer, c.n AS longer_n, w.word AS short, w.n AS short_n FROM cut c JOIN words w ON w.word = c.head || c.tail),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT longer, short, short_n FROM shorter
  UNION ALL SELECT short, longer, longer_n FROM shorter),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (word)),
walk(word, reached) AS (SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.reached WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.reached AS root FROM walk w JOIN formed f ON f.word = w.reached WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN ends USING (word)
"""
