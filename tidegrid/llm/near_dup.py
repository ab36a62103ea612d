"""Near-duplicate documents by banded MinHash, verified through odd sketches and on full sets.

A document's set holds its distinct word shingles.  ``SAMPLES`` MinHash samples serve twice: rows
of them form the band keys that propose candidates, and all of them are folded into an odd sketch,
a parity bitmap whose XOR with another one has a population count that tells the similarity.  Pairs
that pass the sketch are confirmed on full sets.

Documents with equal sets count as one class from the start.  Links between classes are found in
two sweeps, so that no group emits all its pairs:

1. every class meets the smallest class of each of its band buckets; the confirmed links give
   components;
2. a bucket that still holds several components compares the classes outside its largest component
   with the whole bucket, block against block inside tasks.  Where that would be more than
   ``BUCKET_PAIRS`` pairs, the classes of such buckets meet by prefix instead: with shingles that many of
   them hold put last, two sets that are similar enough share one of their first few, so classes with
   equal such shingles are compared.  Pairs that are in one component already, or that an earlier band
   compares, are passed over; only links that join two components leave the task.

Afterwards every proposed pair is either inside one component or was refuted, so the components are
those of the full link graph.  At similarity 0.8 the bands miss a pair with a chance of 5e-8, whatever
the size of its buckets: a prefix misses none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import bound_batches, materialize, release, table, tidy

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
SLACK = 0.24  # sketch estimates this far below the threshold still go on: over 6 standard deviations
BLOCK = 1024  # classes of a block in the second sweep, about
BLOCK_SHINGLES = 2_000_000  # and shingles of a block, about
BUCKET_PAIRS = 1 << 24  # pairs above which a bucket's classes meet by prefix
MOST_COMMON = 20  # common shingles are at most 2 to the power of this: those of over that share of all
HUB_ROWS = 1_000_000  # edges from which a step's minima are written first, so that Spark can split a hub's join
SLICE = 1 << 17  # bytes of text hashed at once

_M64 = (1 << 64) - 1
_PRIME = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240817)
_BYTE = _RNG.integers(0, _M64, size=256, dtype=np.uint64, endpoint=True)
_PLACE = _RNG.integers(0, _M64, size=64, dtype=np.uint64, endpoint=True) | np.uint64(1)
_SCALE = _RNG.integers(0, 1 << 32, size=SAMPLES, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, size=SAMPLES, dtype=np.uint32)
_SALT = _RNG.integers(0, _M64, size=SAMPLES, dtype=np.uint64, endpoint=True)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = _BYTE[_LOWER]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as was asked for."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = np.full(n, _PRIME, dtype=np.uint64)
            made[0] = 1
            self.up = np.cumprod(made)
            made[1:] = pow(_PRIME, -1, 1 << 64)
            self.down = np.cumprod(made)
        return self.up, self.down


_POWERS = _Powers()


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, raw hashes) of the words in a run of bytes."""
    word = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.get(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[: len(data)])])
    return starts, ends, (sums[ends] - sums[starts]) * down[starts]


def _finish(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return _mix(raw + lengths.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, ``SLICE`` bytes at a time; a word may span several slices."""
    out = []
    open_raw, open_len = 0, 0
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        starts, ends, raw = _spans(part)
        lengths = ends - starts
        if open_len and not (len(starts) and starts[0] == 0):
            out.append(_finish(np.array([open_raw], np.uint64), np.array([open_len])))
            open_raw = open_len = 0
        if len(starts) and open_len:
            raw[0] = (open_raw + pow(_PRIME, open_len, 1 << 64) * int(raw[0])) & _M64
            lengths[0] += open_len
            open_raw = open_len = 0
        if len(ends) and ends[-1] == len(part):
            open_raw, open_len = int(raw[-1]), int(lengths[-1])
            raw, lengths = raw[:-1], lengths[:-1]
        out.append(_finish(raw, lengths))
    if open_len:
        out.append(_finish(np.array([open_raw], np.uint64), np.array([open_len])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets_of_words(words: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of consecutive documents with ``counts`` words each."""
    n = len(words) - width + 1
    flat = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        flat += words[k : k + n] * _PLACE[k]
    flat = _mix(flat)
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(flat[at : at + count - width + 1]))
        elif count:
            whole = (words[at : at + count] * _PLACE[:count]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(whole + np.array([count], dtype=np.uint64) * _PLACE[63]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += count
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of every text.

    A text with fewer words has its whole sequence as the only shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush():
        nonlocal held, size
        if held:
            data = np.frombuffer(b" ".join(held) + b" ", dtype=np.uint8)
            starts, ends, raw = _spans(data)
            tops = np.cumsum([len(b) + 1 for b in held])
            counts = np.diff(np.searchsorted(starts, np.concatenate([[0], tops])))
            out.extend(_sets_of_words(_finish(raw, ends - starts), counts, width))
        held, size = [], 0

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > SLICE:
            flush()
            words = _long_words(np.frombuffer(data, dtype=np.uint8))
            out.extend(_sets_of_words(words, np.array([len(words)]), width))
            continue
        held.append(data)
        size += len(data) + 1
        if size >= SLICE:
            flush()
    flush()
    return out


def set_identity(shingles: np.ndarray) -> int | None:
    """Signed 64-bit identity of a set; None for the empty set."""
    if not len(shingles):
        return None
    total = _mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(_mix(total + np.array([len(shingles)], dtype=np.uint64)).view(np.int64)[0])


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima under as many permutations of 32-bit numbers."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(best, (x[at : at + 512, None] * _SCALE + _SHIFT).min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(documents, BANDS) signed keys from (documents, SAMPLES) minima; keys of bands differ."""
    rows = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(_SALT[:BANDS], rows.shape[:2])
    for k in range(ROWS):
        key = _mix(key + rows[:, :, k] * _PLACE[k])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(documents, SKETCH_BITS / 64) words: the parity of the samples that hash to each bit."""
    at = _mix(samples.astype(np.uint64) + _SALT) % np.uint64(SKETCH_BITS)
    flat = (at + (np.arange(len(samples), dtype=np.uint64) * np.uint64(SKETCH_BITS))[:, None]).ravel().astype(np.int64)
    odd = np.bincount(flat, minlength=len(samples) * SKETCH_BITS).reshape(len(samples), SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def similarity_from_bits(differing: float) -> float:
    """Similarity that ``differing`` XOR bits of two odd sketches speak for."""
    inner = 1.0 - 2.0 * differing / SKETCH_BITS
    if inner <= 0:
        return 0.0
    return 1.0 - math.log(inner) / math.log(1.0 - 2.0 / SKETCH_BITS) / 2.0 / SAMPLES


def most_bits(least_similarity: float) -> int:
    """Differing bits that pairs of at least this similarity are expected to have at most."""
    return next(x for x in range(SKETCH_BITS) if similarity_from_bits(x + 1) < least_similarity)


# ---------------------------------------------------------------- per-document scan


def _list_column(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.int64()))


def _signing(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(2).to_pylist(), width)
                samples = np.stack([minhash(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_identity(s) for s in sets], pa.int64()),
                        _list_column(band_keys(samples)),
                        _list_column(odd_sketches(samples)),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"],
                )

    return run


def sign(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (identity of the set; null if empty), bands, sketch."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        tidy(_signing(width)),
        "doc_id long, text_hash long, n_shingles long, node long, bands array<long>, sketch array<long>",
    )


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _full_sets(width: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, blobs = [], []
                for node, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), width)):
                    if node not in seen:  # rows that repeat a document give one set a task
                        seen.add(node)
                        nodes.append(node)
                        blobs.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    return run


# ---------------------------------------------------------------- links


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _set(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint64)


def _confirming(percent: int):
    def run(batches):
        for batch in batches:
            keep = [
                linked(_set(x.as_buffer()), _set(y.as_buffer()), percent)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _groups(batches, keys: int):
    """Runs of rows with equal leading ``keys`` columns, as record batches; runs may span batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(columns[:, start].tolist())
            if key != current and held:
                yield current, pa.Table.from_batches(held).combine_chunks()
                held = []
            current = key
            held.append(batch.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _comparing(bits: int, percent: int):
    """Sketch-compare the left with the right rows of each block; tell who has partners left."""

    def run(batches):
        rows: list[tuple] = []
        for (key, i, j), t in _groups(batches, 3):
            left = np.array(t.column("left").to_pylist())
            if not left.any() or left.all():
                continue
            node, comp, size = (t.column(c).to_numpy() for c in ("node", "comp", "n_shingles"))
            other = np.array(t.column("other").to_pylist())
            path = np.array(t.column("path")[0].as_py(), dtype=np.int64)  # the band keys that all of the block share
            sketch, bands = _matrix(t.column("sketch")).view(np.uint64), _matrix(t.column("bands"))
            lefts, rights = np.flatnonzero(left), np.flatnonzero(~left)
            partners: dict[int, list[int]] = {}
            wanted: set[int] = set()
            for at in range(0, len(lefts), 64):
                own = lefts[at : at + 64]
                fits = comp[own][:, None] != comp[rights][None, :]
                # of two rows outside the main component, the smaller looks for the larger
                fits &= ~other[rights][None, :] | (node[own][:, None] < node[rights][None, :])
                low = np.minimum(size[own][:, None], size[rights][None, :])
                fits &= 100 * low >= percent * np.maximum(size[own][:, None], size[rights][None, :])
                a, b = np.nonzero(fits)
                for cut in range(0, len(a), 65536):
                    x, y = own[a[cut : cut + 65536]], rights[b[cut : cut + 65536]]
                    near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1) <= bits
                    x, y = x[near], y[near]
                    same = bands[x] == bands[y]
                    met = np.ones(len(x), dtype=bool)  # earlier shared bands have the others
                    for step in path:
                        first = same.argmax(axis=1)
                        met &= bands[x, first] == step
                        same[np.arange(len(x)), first] = False
                    for p, q in zip(x[met].tolist(), y[met].tolist()):
                        partners.setdefault(p, []).append(int(node[q]))
                        wanted.add(q)
            rows += [(key, i, j, 1, int(node[p]), int(comp[p]), found) for p, found in partners.items()]
            rows += [(key, i, j, 0, int(node[q]), int(comp[q]), []) for q in wanted]
            if len(rows) > 5000:
                yield _flagged(rows)
                rows = []
        if rows:
            yield _flagged(rows)

    return run


_FLAGGED = "key long, i int, j int, side int, node long, comp long, partners array<long>"


def _flagged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["key", "i", "j", "side", "node", "comp", "partners"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _joining(percent: int):
    """Confirm the partners of each block on full sets; emit links that join two components."""

    def run(batches):
        for _, t in _groups(batches, 3):
            parent: dict[int, int] = {}

            def find(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            rights: dict[int, tuple[int, np.ndarray]] = {}
            links = []
            for side, node, comp, partners, blob in zip(*(t.column(c) for c in ("side", "node", "comp", "partners", "shingles"))):
                node, comp, own = node.as_py(), comp.as_py(), _set(blob.as_buffer())
                if side.as_py() == 0:
                    rights[node] = (comp, own)
                    continue
                for partner in partners.as_py():
                    other, full = rights[partner]
                    if find(comp) != find(other) and linked(own, full, percent):
                        parent[find(comp)] = find(other)
                        links.append((node, partner))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of ``edges`` (a, b) is connected with, if another.

    Alternates the large-star and small-star steps until the edges are stars; the tables stay in
    the shared folder and only counts reach the driver.  The result is such a table.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        facts = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark == (facts.n, facts.h) or not facts.n:
            done = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("comp")))
            release(now)
            return done
        mark = (facts.n, facts.h)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        held = [now]
        if facts.n > HUB_ROWS:
            low = materialize(low)
            held.append(low)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select("a", F.col("low").alias("b")).unionByName(
            small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        now = materialize(small.distinct())
        release(*held)


def _shingles(batches):
    """Every shingle of (node, comp, shingles)."""
    for batch in batches:
        for blob in batch.column(2):
            yield pa.RecordBatch.from_arrays([pa.array(_set(blob.as_buffer()).view(np.int64))], names=["shingle"])


def _prefixes(percent: int, common: np.ndarray):
    """(key, node, comp) for the shingles of each set that come first; ``common`` ones, sorted, come last.

    Similar sets share ``percent`` of either one's shingles, so they cannot differ in all of these.
    """

    def run(batches):
        for batch in batches:
            for node, comp, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = _set(blob.as_buffer())
                late = np.isin(own, common, assume_unique=True)
                first = np.concatenate([own[~late], own[late]])[: len(own) - (percent * len(own) + 99) // 100 + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(np.full(len(first), node)), pa.array(np.full(len(first), comp))], names=["key", "node", "comp"]
                )

    return run


def _by_prefix(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, node, comp, path: the classes (node, comp) of large buckets in one group for each of their first shingles."""
    full = materialize(classes.join(sets, "node").select("node", "comp", "shingles"))
    total = full.agg(F.sum(F.octet_length("shingles") / 8).cast("long").alias("n")).first().n or 0
    counted = full.mapInArrow(tidy(_shingles), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    # at most 2 ** MOST_COMMON of them can be so common
    common = counted.where(F.col("n") > max(BLOCK, total >> MOST_COMMON)).select("shingle").toArrow().column(0).to_numpy()
    common = np.sort(common.astype(np.int64).view(np.uint64))
    keyed = full.mapInArrow(tidy(_prefixes(percent, common)), "key long, node long, comp long")
    several = keyed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    out = materialize(keyed.join(several.select("key"), "key").withColumn("path", F.array().cast("array<long>")))
    release(full)
    return out


def _candidates(known: DataFrame, members: DataFrame, stars: DataFrame, sets: DataFrame, bits: int, percent: int) -> list[DataFrame]:
    """Tables of the blocks' nodes that the sketches could not refute in the second sweep.

    ``members`` has key, node: the band buckets.  Buckets that hold at most ``BUCKET_PAIRS`` pairs are
    compared in blocks; the classes of the others once more, together, grouped by prefix.
    """
    facts = known.select("node", "n_shingles", "sketch", "bands")
    placed = members.join(stars, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), F.array("key").alias("path"))
    out, held = [], []
    for last in (False, True):
        sized = placed.join(known.select("node", "n_shingles"), "node")
        per_comp = sized.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
        mixed = per_comp.groupBy("key").agg(
            F.max(F.struct("n", "size", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("comps")
        ).where("comps > 1")
        blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
        mixed = materialize(
            mixed.select(
                "key",
                F.col("main.comp").alias("main"),
                blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("rows"),
                blocks(F.col("n"), F.col("size")).alias("columns"),
                (F.lit(not last) & ((F.col("n") - F.col("main.n")) * F.col("n") > BUCKET_PAIRS)).alias("large"),
            )
        )
        own = placed.join(mixed.where("NOT large"), "key").withColumn("other", F.col("comp") != F.col("main"))
        spread = F.xxhash64("node")
        row, column = F.pmod(spread, F.col("rows")).cast("int"), F.pmod(spread, F.col("columns")).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        seat = ["node", "comp", "other", "path"]
        seats = (
            own.where("other").select("key", row.alias("i"), all_of("columns").alias("j"), F.lit(True).alias("left"), *seat)
        ).unionByName(own.select("key", all_of("rows").alias("i"), column.alias("j"), F.lit(False).alias("left"), *seat))
        keys = ["key", "i", "j"]
        out.append(
            materialize(
                seats.join(facts, "node")
                .repartition(*keys)
                .sortWithinPartitions(*keys)
                .select(*keys, "left", "node", "comp", "other", "n_shingles", "sketch", "bands", "path")
                .mapInArrow(tidy(_comparing(bits, percent)), _FLAGGED)
            )
        )
        held.append(mixed)
        if not mixed.where("large").limit(1).count():
            break
        placed = _by_prefix(placed.join(mixed.where("large").select("key"), "key").select("node", "comp").distinct(), sets, percent)
        held.append(placed)
    release(*held)
    return out


def cluster(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, group for every row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest doc_id that a row reaches over links, itself included; kept says
    whether that is its own.  Null texts are empty; texts without words have no shingles and are
    linked with nothing (group is null).  Null doc_ids take part in links but are never a
    component_id unless nothing else is there.  Rows that share a doc_id share its fate only where
    their texts are linked.  Sets are told apart by 64-bit hashes.  Very long texts are hashed in
    slices, whole.  An empty table gives no rows; other columns are ignored, whatever their names.

    The result is a table in the shared folder; those it was made from are deleted.
    """
    bound_batches(docs.sparkSession)
    base = materialize(sign(docs, width))
    classes = materialize(
        base.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
            F.min(F.struct("doc_id", "text_hash")).alias("at"),
            F.min("doc_id").alias("first_id"),
            F.count("*").alias("copies"),
        )
    )
    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("top")).where("rep < top")
    buckets = materialize(buckets.select("key", "rep"))  # a table, so that Spark can split a key's join
    members = materialize(keyed.join(buckets, "key"))
    known = materialize(classes.join(members.select("node").distinct(), "node", "left_semi"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    wanted = known.select("node", F.col("at.doc_id").alias("w_id"), F.col("at.text_hash").alias("w_hash"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
    sets = materialize(texts.select("node", "text").mapInArrow(tidy(_full_sets(width)), "node long, shingles binary"))

    bits = most_bits(percent / 100 - SLACK)
    pairs = unrefuted(members, known, bits, percent)
    proposed = pairs.join(sets, "node").join(sets.toDF("rep", "rep_shingles"), "rep").select(
        F.col("node").alias("a"), F.col("rep").alias("b"), "shingles", "rep_shingles"
    )
    stars = components(proposed.mapInArrow(tidy(_confirming(percent)), "a long, b long"))

    flagged = _candidates(known, members.select("key", "node"), stars, sets, bits, percent)
    links = stars.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    keys = ["key", "i", "j"]
    for table_ in flagged:
        late = (
            table_.join(sets, "node")
            .repartition(*keys)
            .sortWithinPartitions(*keys, "side")
            .select(*keys, "side", "node", "comp", "partners", "shingles")
            .mapInArrow(tidy(_joining(percent)), "a long, b long")
        )
        links = links.unionByName(late)
    whole = components(links)
    release(buckets, members, known, sets, stars, *flagged)

    both = whole.unionByName(whole.select(F.col("comp").alias("node"), "comp").distinct())
    linked = both.join(classes.select("node", "first_id"), "node")
    heads = materialize(linked.groupBy("comp").agg(F.min("first_id").alias("head")))
    named = linked.join(heads, "comp").select("node", F.col("comp").alias("group"), "head")
    copied = classes.where("copies > 1").select("node", F.col("node").alias("group"), F.col("first_id").alias("head"))
    named = materialize(named.unionByName(copied.join(both.select("node"), "node", "left_anti")))
    # a row of neither a component nor a group of copies is its own head
    rows = base.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("head"))
    out = materialize(
        rows.select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
            "text_hash",
            F.coalesce("group", "node").alias("group"),
        )
    )
    release(base, classes, whole, heads, named)
    return out


def proposals(members: DataFrame) -> DataFrame:
    """rep, node: the pairs of the first sweep."""
    return members.where("node <> rep").select("rep", "node").distinct()


def unrefuted(members: DataFrame, known: DataFrame, bits: int, percent: int) -> DataFrame:
    """Proposed pairs whose sizes and odd sketches allow a link."""
    about = known.select("node", "n_shingles", "sketch")
    pairs = proposals(members).join(about, "node").join(about.toDF("rep", "rep_n", "rep_sketch"), "rep")
    apart = F.aggregate(
        F.zip_with("sketch", "rep_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    fits = F.least("n_shingles", "rep_n") * 100 >= F.greatest("n_shingles", "rep_n") * percent
    return pairs.where(fits & (apart <= bits)).select("rep", "node")


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: one row of each component stays.

    It is one with the smallest doc_id (of several texts with that doc_id, the one of the smallest
    hash; of equal rows, any).  Rows without words all stay.  Other cases as in ``cluster``; columns
    keep their names, order and values, whatever they are called.
    """
    found = cluster(docs, width, percent)
    chosen = found.where(F.col("group").isNotNull() & F.col("kept")).groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
    keys = chosen.select(F.col("at.doc_id").alias("_kept_id"), F.col("at.text_hash").alias("_kept_hash"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    worded = _text().rlike(r"[^ \t-\r]")
    rows = docs.where(worded).select(row, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(_text()).alias("_hash"))
    rows = rows.join(keys, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash")))
    once = Window.partitionBy("_kept_id", "_kept_hash").orderBy("_kept_hash")  # rows that repeat a document whole
    rows = rows.withColumn("_turn", F.row_number().over(once)).where("_turn = 1")
    return rows.select("_row.*").unionByName(docs.where(~worded))


def op1_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"), width=2).drop("text_hash", "group")
