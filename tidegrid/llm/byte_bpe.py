"""Byte-level BPE over a global shuffle of distinct words.

Encoding takes three steps joined by two shuffles:

1. split: texts are cut into pre-tokens; a block of documents keeps each distinct pre-token once and
   explodes every document into the positions' word numbers;
2. merge: distinct words meet at the partition of their hash, where each is encoded once, whatever
   the number of blocks that asked for it, and its ids go back to the blocks;
3. assemble: a block joins the ids to its word numbers and puts them back in position order.

Rows are (block, word slice) and (block, position numbers) with packed payloads, so a word that
occurs everywhere costs one entry a block and the shuffles stay well below the size of the input.
Decoding looks ids up in the token-byte table, which is bounded by the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import bound_batches, table, tidy

BLOCK_CHARS = 12_000_000
OUT_IDS = 1_000_000
PART_CHARS = 16_000_000  # characters of text for each part that words are dealt to: a part's distinct words have fewer
# Unicode's White_Space, as the tokenizer library's pattern engine reads \s.
SPACES = "\t-\r \x85\xa0  -     　"
COMMON = 0x250  # texts below this code point use the standard library's faster engine


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """A function that cuts a text into the matches of ``pattern``."""
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}\\p{{L}}\\p{{N}}]").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
    general = regex.compile(spelled)
    kinds = {"L": "", "N": ""}
    for i in range(COMMON):
        kind = unicodedata.category(chr(i))[0]
        if kind in kinds:
            kinds[kind] += re.escape(chr(i))
    quick = spelled.replace(r"\p{L}\p{N}]", kinds["L"] + kinds["N"] + "]")
    quick = quick.replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]")
    if r"\p" in quick:
        return general.findall
    quick_split, rare = re.compile(quick).findall, re.compile(f"[^\\x00-{chr(COMMON - 1)}]").search
    return lambda text: general.findall(text) if rare(text) else quick_split(text)


# ---------------------------------------------------------------- packed payloads


def pack(*arrays: np.ndarray, blob: bytes = b"") -> bytes:
    """Unsigned numbers as byte planes and a blob, compressed together."""
    head, body = [np.uint64(len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype=np.uint64)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head += [np.uint64(len(a)), np.uint64(width)]
        body.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, dtype=np.uint64).tobytes() + b"".join(body) + blob)


def unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    head = np.frombuffer(raw, np.uint64, 2 * n, 8).astype(np.int64)
    at, arrays = 8 + 16 * n, []
    for length, width in zip(head[::2], head[1::2]):
        planes = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        full = np.zeros((length, 8), dtype=np.uint8)
        full[:, :width] = planes.T
        arrays.append(full.view(np.uint64).ravel().astype(np.int64))
        at += length * width
    return arrays, raw[at:]


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


# ---------------------------------------------------------------- the three steps

STEP_SCHEMA = "dest int, block string, kind int, part int, payload binary"
_STEP_ARROW = pa.schema(
    [("dest", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())]
)


def _step_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STEP_ARROW)], schema=_STEP_ARROW)


def _split_block(block: str, ids: list, texts: list[str], split, parts: int):
    """Rows of one block: word slices by hash, then the documents as word numbers."""
    numbered = _Numbered()
    seqs = [np.fromiter(map(numbered.__getitem__, split(t)), dtype=np.int64) for t in texts]
    lengths = np.array([len(s) for s in seqs], dtype=np.int64)
    flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
    words = [w.encode("utf-8", "surrogatepass") for w in numbered]
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words get small numbers
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    words = [words[i] for i in order]
    homes = np.fromiter((zlib.crc32(w) % parts for w in words), dtype=np.int64, count=len(words))
    for part in np.unique(homes):
        own = [words[i] for i in np.flatnonzero(homes == part)]
        yield int(part), block, 0, int(part), pack(np.array([len(w) for w in own]), blob=b"".join(own))
    known = np.array([i is not None for i in ids], dtype=np.int64)
    doc_ids = np.array([i if i is not None else 0 for i in ids], dtype=np.int64).view(np.uint64)
    yield zlib.crc32(block.encode()) % parts, block, 1, -1, pack(homes, lengths, rank[flat], doc_ids, known)


def _splitting(pattern: str, parts: int, block_chars: int):
    def run(batches):
        from pyspark import TaskContext

        split, task = splitter(pattern), TaskContext.get().partitionId()
        blocks = itertools.count()
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= block_chars:
                    yield _step_batch(list(_split_block(f"{task}-{next(blocks)}", ids, texts, split, parts)))
                    ids, texts, size = [], [], 0
        if ids:
            yield _step_batch(list(_split_block(f"{task}-{next(blocks)}", ids, texts, split, parts)))

    return run


def _merging(ranks, pattern: str):
    def run(batches):
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        encode, done = encoder.encode_ordinary, {}
        for batch in batches:
            rows = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                dest, block, kind, part, payload = row
                if kind == 0:
                    (lengths,), blob = unpack(payload)
                    ends = np.cumsum(lengths).tolist()
                    ids = []
                    for start, end in zip([0, *ends], ends):
                        word = blob[start:end]
                        got = done.get(word)
                        if got is None:
                            got = done[word] = encode(word.decode("utf-8", "surrogatepass"))
                        ids.append(got)
                    counts = np.array([len(x) for x in ids], dtype=np.int64)
                    flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64, count=int(counts.sum()))
                    payload = pack(counts, flat)
                rows.append((dest, block, kind, part, payload))
            if rows:
                yield _step_batch(rows)

    return run


def _id_batch(doc_ids, lengths, flat):
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], names=["doc_id", "ids"])


def _assembling(out_ids: int, finish):
    """``finish`` (doc_ids, numbers of ids, all ids) makes the batches of the documents put together."""

    def run(batches):
        counts, flat = [], []  # of the block's words, in part order
        for batch in batches:
            for kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if kind == 0:
                    (c, f), _ = unpack(payload)
                    counts.append(c)
                    flat.append(f)
                    continue
                (homes, lengths, seq, doc_ids, known), _ = unpack(payload)
                count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
                starts = np.concatenate([[0], np.cumsum(count)])[:-1] if len(count) else count
                placed = np.argsort(homes, kind="stable")  # word number of each entry in part order
                start, n = np.empty_like(starts), np.empty_like(count)
                start[placed], n[placed] = starts, count
                ends = np.cumsum(lengths)
                first = 0
                while first < len(lengths):  # as many documents at a time as give about out_ids ids
                    base = ends[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, base + out_ids // 3, side="right")))
                    own = seq[base : ends[last - 1]]
                    widths = n[own]
                    at = np.cumsum(widths) - widths
                    total = int(widths.sum())
                    spots = np.repeat(start[own] - at, widths) + np.arange(total)
                    bounds = np.concatenate([[0], np.cumsum(widths)])
                    cut = bounds[ends[first:last] - base]
                    sizes = np.diff(np.concatenate([[0], cut]))
                    named = [int(i) if k else None for i, k in zip(doc_ids[first:last], known[first:last])]
                    yield finish(named, sizes, ids[spots])
                    first = last
                counts, flat = [], []

    return run


def _encoded(docs: DataFrame, ranks, pattern: str, parts: int | None, block_chars: int, out_ids: int, finish, schema: str) -> DataFrame:
    """The three steps; ``ranks`` is a broadcast of the rank table, bounded by the vocabulary."""
    spark = docs.sparkSession
    bound_batches(spark)
    if parts is None:
        chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # blocks are cut in this order: a task that runs again makes the same blocks under the same names
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    split = rows.mapInArrow(tidy(_splitting(pattern, parts, block_chars)), STEP_SCHEMA)
    merged = split.repartition(parts, "dest").mapInArrow(tidy(_merging(ranks, pattern)), STEP_SCHEMA)
    blocks = merged.repartition(parts, "block").sortWithinPartitions("block", "kind", "part").select("kind", "payload")
    return blocks.mapInArrow(tidy(_assembling(out_ids, finish)), schema)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, parts: int | None = None, block_chars: int = BLOCK_CHARS, out_ids: int = OUT_IDS
) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, as the tokenizer library gives them.

    Null texts are empty and have no ids; repeated rows keep a row each; an empty table gives no
    rows; other columns are ignored, whatever their names.  A very long text is a block of its own.
    Special tokens are ordinary text.  Words are dealt to ``parts`` by their hash; the number
    follows from the input's characters, so that a part's distinct words are bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return _encoded(docs, shared, pattern, parts, block_chars, out_ids, _id_batch, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (doc_id, ids) with decoded: the bytes of the ids, by the token-byte table."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    def run(batches):
        token = shared.value.__getitem__
        for batch in batches:
            whole = [b"".join(map(token, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(whole, pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded binary")


def _digesting(ranks):
    """Digests of documents as they are put together: ids as text, and bytes by the token-byte table."""
    token, name = [], []

    def finish(doc_ids, lengths, flat):
        if not token:  # once a task
            known = {i: t for t, i in ranks.value.items()}
            token.extend(known.get(i, b"") for i in range(max(known, default=-1) + 1))
            name.extend(map(str, range(len(token))))
        rows, at = [], 0
        for doc_id, n in zip(doc_ids, lengths.tolist()):
            ids = flat[at : at + n].tolist()
            at += n
            listed = " ".join(map(name.__getitem__, ids)).encode()
            whole = b"".join(map(token.__getitem__, ids))
            rows.append((doc_id, n, hashlib.sha256(listed).hexdigest(), hashlib.sha256(whole).hexdigest()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return finish


def encode_digests(docs: DataFrame, rank_path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; cases as in ``encode``.

    Ids are decoded and digested where they are put together, so no second worker holds them.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, ranks, pattern, None, block_chars, OUT_IDS, _digesting(ranks), schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
