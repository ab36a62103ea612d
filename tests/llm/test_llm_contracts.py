"""Registered training-data queries against plain Python, and odd rows through operators and pipeline stages."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_shared import ODD_STAGE, SF, rows_of
from tidegrid.llm import byte_bpe, chat_template, language_id, multiset_fp, near_dup, onebit_ann, registry, toxicity
from tidegrid.llm.common import materialize


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def test_op1_as_registered(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", t.translate(lower))
        sets[i] = {tuple(w)} if len(w) == 1 else set(itertools.pairwise(w))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    got = registry.QUERIES["op1_minhash_near_dup"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_dup_large_buckets_meet_by_prefix(spark, docs, monkeypatch):
    """Every mixed bucket counts as large, so links of the second sweep are found over prefixes."""
    words = [f"w{i}" for i in range(400)]
    chain = [(10_000 + n, " ".join(words[n * 6 : n * 6 + 80])) for n in range(30)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(chain, "doc_id long, text string"))
    want = {r.doc_id: r.component_id for r in near_dup.cluster(rows, 2).collect()}
    monkeypatch.setattr(near_dup, "BUCKET_PAIRS", 0)
    assert {r.doc_id: r.component_id for r in near_dup.cluster(rows, 2).collect()} == want


@pytest.mark.parametrize("common", [1024, 5])
def test_near_dup_finds_one_band_links_of_large_buckets(spark, monkeypatch, common):
    """Pairs at the threshold that mostly share one band only; all buckets are large, shared words common or not."""
    rows = [(10 * f + n, " ".join([f"f{f}w{i}" for i in range(60)] + [f"d{f}x{n}x{i}" for i in range(70)])) for f in range(30) for n in range(10)]
    sets = near_dup.shingle_sets([t for _, t in rows], 1)
    bands = near_dup.band_keys(np.stack([near_dup.minhash(x) for x in sets]))
    parent, met = list(range(len(rows))), []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (shared := int((bands[a] == bands[b]).sum())) and near_dup.linked(sets[a], sets[b], 30):
            met.append(shared)
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert met.count(1) > 100
    monkeypatch.setattr(near_dup, "BUCKET_PAIRS", 0)
    monkeypatch.setattr(near_dup, "BLOCK", common)
    got = {r.doc_id: r.component_id for r in near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 1, 30).collect()}
    want = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    # prefixes also find links that share no band, so components may be larger, never smaller
    assert all(got[rows[i][0]] == got[want[rows[i][0]]] for i in range(len(rows)))
    assert all(got[i] // 10 == i // 10 for i in got)


def test_near_dup_hot_bucket(spark):
    """Thousands of copies, of near copies and of unlike texts around one common passage."""
    passage = " ".join(f"common{i}" for i in range(40))
    own = lambda n, size: " ".join(f"x{n}y{i}" for i in range(size))
    rows = [(n, passage + " the same end") for n in range(0, 2000)]
    rows += [(n, passage + f" near {n}") for n in range(2000, 4000)]
    rows += [(n, passage + " " + own(n, 40)) for n in range(4000, 5500)]
    got = {r.doc_id: r.component_id for r in near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert all(got[n] == 0 for n in range(4000)) and all(got[n] == n for n in range(4000, 5500))


def test_op3_features_and_query(spark, texts):
    text = "You IDIOT!! y0u stup1d f$ol, nice day; you are a loser and trash"
    words = re.findall(r"[^\W\d_]+", text.lower())
    learned, stems = frozenset({"nice"}), frozenset({"tras"})
    fixed = [w in toxicity.FIXED for w in words]
    hit = [a or w in learned for a, w in zip(fixed, words)]
    said = [n for n, w in enumerate(words) if w in toxicity.PERSON]
    near = sum(min(abs(n - s) for s in said) <= toxicity.NEAR for n, h in enumerate(hit) if h)
    got = dict(zip(toxicity.NAMES, toxicity.features(text, learned, stems)))
    n, size = len(words), len(text)
    assert got["fixed_density"] == sum(fixed) / n and got["learned_density"] == words.count("nice") / n
    assert got["stem_density"] == sum(w[:4] in stems or w[:5] in stems for w in words) / n
    assert got["second_person_near"] == near / n and got["log_words"] == np.log1p(n)
    assert got["capitals"] == sum(c.isupper() for c in text) / size and got["digits"] == sum(c.isdigit() for c in text) / size
    assert got["bangs"] == sum(c in "!?" for c in text) / size and got["symbols"] == text.count("$") / size
    assert got["mixed_words"] == len(re.findall(r"[^\W\d_][\d@$!*#%&^~+=.]+[^\W\d_]", text)) / n
    rows = registry.QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(rows) == len(texts) and all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_fits_do_not_hang_on_settings(spark):
    """The same rows are drawn and the same scores come out under other shuffle settings."""
    sf, said = "/root/testdata/sf0.01", []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    try:
        for parts in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            tox = toxicity.score(docs, toxicity.fit(docs, toxicity.training_labels(labels), 40)).orderBy("doc_id").select("score").collect()
            lang = language_id.predict(docs, language_id.fit(docs.select("doc_id", "text", "lang"), 30)).orderBy("doc_id").select("lang_pred", "score").collect()
            said.append(([r.score for r in tox], [r.lang_pred for r in lang], [r.score for r in lang]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert said[0][0] == pytest.approx(said[1][0], abs=1e-6)
    assert said[0][1] == said[1][1] and said[0][2] == pytest.approx(said[1][2], abs=1e-6)


def test_op6_as_registered(spark, texts):
    """All columns by a second way of cutting, hashing and comparing."""

    def lanes(text):
        total = [0] * 96
        for paragraph in text.encode().split(b"\n"):
            words, pieces, open_ = re.findall(rb"\S{1,64}", paragraph), [], []
            for w in words:
                open_.append(w)
                if zlib.crc32(w) % 8 == 0 or len(open_) == 64:
                    pieces, open_ = [*pieces, open_], []
            pieces += [open_] if open_ else []
            units = [paragraph] + ([b"\n" + b" ".join(p) for p in pieces] if len(words) > 8 else [])
            for unit in units:
                whole = xxhash.xxh3_128_intdigest(unit)
                for k in range(12):
                    x = ((whole >> 64) + whole * ((2 * k + 1) * 0x9E3779B97F4A7C15)) % 2**64
                    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                    for n, byte in enumerate((x ^ x >> 31).to_bytes(8, "little")):
                        total[8 * k + n] += 2 * (byte - 256 if byte > 127 else byte) + 1
        return total

    def alike(a, b):
        if a == b:
            return 1.0
        size = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return min(1.0, max(0.0, sum(x * y for x, y in zip(a, b)) / size)) if size else 0.0

    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in registry.QUERIES["op6_multiset_fingerprints"](spark, SF).collect()}
    hexed = lambda v: "".join(f"{x % 2**32:08x}" for x in v)
    single, above = 0, 0
    for n, i in enumerate(ids):
        own, after = texts[i], texts[ids[(n + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c, r = lanes(own), lanes(edited), lanes(after), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(a), hexed(b))
        assert r.near_edited == pytest.approx(alike(a, b), abs=1e-9) and r.near_next == pytest.approx(alike(a, c), abs=1e-9)
        if "\n" not in own and len(own.split()) > 40 and own != after:
            single, above = single + 1, above + (r.near_edited > r.near_next)
    assert single and above >= 0.9 * single  # half of a long paragraph stays recognisable


def test_op6_insert_and_delete_long_paragraphs():
    long = " ".join(f"word{i}" for i in range(300))
    whole = multiset_fp.fingerprint(f"a\n{long}\nb")
    assert (multiset_fp.insert(multiset_fp.fingerprint("b\na"), [long]) == whole).all()
    assert (multiset_fp.delete(whole, [long]) == multiset_fp.fingerprint("a\nb")).all()


def test_op7_as_registered(spark):
    turns: dict = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in registry.QUERIES["op7_chat_template"](spark, SF).collect()}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        own, r = sorted(own), got[conv]
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op7_parts_ties_and_long_turns(spark):
    """Parts of any size read back alike; equal (turn, role) go by text, repeated turns count each."""
    said = "a \\ <b> </turn>\n\\" * 50
    rows = [(1, 0, "user", "z"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 1, "assistant", said * 200), (1, 1, None, None), (None, 0, "assistant", "<"), (2, None, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    order = lambda rows: sorted(rows, key=lambda r: [(v is not None, v) for v in r])
    for part_chars in (1, 7, 1000, 1 << 20):
        formatted = chat_template.format_conversations(turns, part_chars=part_chars)
        sizes = {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
        for r in chat_template.read_back(formatted).collect():
            own = [(x[2] or "", x[3] or "") for x in order([x for x in rows if x[0] == r.conv_id])]
            loss = "".join(t for role, t in own if role == "assistant")
            assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(own), len(loss), sizes[r.conv_id])
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op8_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.QUERIES["op8_onebit_ann"](spark, sf).toPandas()
    own = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(own.embedding.tolist(), dtype=np.float64), own.vec_id.to_numpy()
    asked, hits = ids[ids % onebit_ann.QUERY_STEP == 0], 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        nearest = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(nearest) & set(got[got.query_id == q].vec_id))
    assert len(asked) >= 20 and hits >= 0.9 * 10 * len(asked)


def test_op8_estimates_are_bounded():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    about, lack = onebit_ann.estimate(*onebit_ann.encode(x), q)
    true = ((x - q) ** 2).sum(axis=1)
    assert (about - lack <= true).mean() > 0.98 and abs((about - true).mean()) < 2.0


def test_op8_odd_rows(spark):
    """Ties, repeated rows and ids, few candidates, other lengths, clashing names."""
    e = [1.0, 0.0]
    rows = [(100, e, 1), (100, e, 1), (100, [5.0, 0.0], 1), (7, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (200, [1.0, 1.0, 1.0], 1), (5, [1.0, 1.0, 2.0], 1), (6, [float("inf"), 0.0], 1)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int").withColumn("rank", F.lit(0))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in onebit_ann.search(made, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    # three rows are asked as 100, two of them equal
    first, second = [(100, 1, 100, 0.0), (100, 2, 3, 1.0), (100, 3, 7, 1.0), (100, 4, 100, 4.0)], [(100, 1, 3, 3.0), (100, 2, 7, 3.0), (100, 3, 100, 4.0), (100, 4, 100, 4.0)]
    assert sorted(got) == sorted([*first, *first, *second, (200, 1, 5, 1.0)])


def test_op9_votes_and_query(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out(4, 2)).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in registry.QUERIES["op9_language_id"](spark, SF).collect()}
    assert set(got) == set(texts)

    def winner(x, classes, machines):
        wins = {c: 0.0 for c in classes}
        for a, b, w, c in machines:
            m = float(sum(u * v for u, v in zip(x, w))) + c
            wins[a if m > 0 else b] += 1
            wins[a] += 1e-3 * np.tanh(m)
            wins[b] -= 1e-3 * np.tanh(m)
        return max(classes, key=wins.get)

    for i, t in texts.items():
        r = got[i]
        assert r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1
        if any(map(str.isalpha, t)):
            data, grams = t.lower().encode(), np.zeros(language_id.DIM)
            for k in range(len(data) - 1):
                pair = (data[k] * 0x9E3779B1 + data[k + 1] * 0x85EBCA6B) % 2**32
                grams[pair >> 23] += 1
                if k + 2 < len(data):
                    grams[512 + ((pair * 0x27D4EB2F + data[k + 2] * 0xC2B2AE35) % 2**32 >> 23)] += 1
            x = np.sqrt(grams / grams.sum())
            family = winner(x, sorted(model["families"]), model["between"])
            assert r.lang_pred == winner(x, model["families"][family], model["within"][family])
        else:
            assert r.lang_pred == "und"


def test_language_likeness_tells_unknown_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    known = language_id.is_known(F.col("lang_pred"), F.col("likeness"), F.col("text"))
    said = language_id.predict(docs, model)
    assert said.where(~known & F.col("lang").isNotNull() & (F.length("text") > 300)).count() <= 0.005 * docs.count()
    strange = ["Быстрая бурая лиса прыгает через собаку. " * 9, "これは日本語の文章です。今日は良い天気ですね。" * 9, "Nopea ruskea kettu hyppää laiskan koiran yli. " * 9, "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ=" * 9]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(strange)], "doc_id long, text string, lang_pred int")
    assert language_id.predict(rows, model).where(known).count() == 0


def test_op10_by_a_plain_merge_loop(spark, texts):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern = regex.compile(public_tokenizers.PATTERN)

    def merged(word: bytes) -> list[int]:
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    got = {r.doc_id: r for r in registry.QUERIES["op10_byte_bpe"](spark, SF).collect()}
    known: dict = {}
    for i in sorted(texts)[::4]:
        ids = []
        for word in pattern.findall(texts[i]):
            if word not in known:
                known[word] = merged(word.encode())
            ids += known[word]
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()) and len(got) == len(texts)


def test_bpe_parts_and_clashing_names(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, 5, "x")], "doc_id long, text string, ids int, block string")
    for parts in (1, 5):
        got = sorted((r.doc_id or 0, len(r.ids)) for r in byte_bpe.encode(rows, ranks, public_tokenizers.PATTERN, parts=parts).collect())
        assert got == [(0, 0), (1, 2), (1, 2)]


@pytest.fixture(scope="module")
def odd_docs(spark, docs):
    """The documents with odd rows and columns whose names clash with the stages' own."""
    odd = spark.createDataFrame(ODD_STAGE, docs.schema)
    return docs.unionByName(odd).withColumns({c: F.lit(1) for c in ("_row", "score", "node", "tokens", "_copy", "likeness")})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_odd_rows(spark, odd_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd_docs = materialize(odd_docs)
    got = materialize(stage(spark, odd_docs, SF))
    ids = [r.doc_id for r in got.where("doc_id >= 900000 OR doc_id IS NULL").collect()]
    count = lambda i: ids.count(i)
    # 900000 null text, 900001 empty, 900002 no letter, 900003 twice, 900004 very long, null id
    want = {
        "language_id": {900000: 0, 900001: 0, 900002: 0, 900003: 2, 900004: 1, None: 1},
        "toxicity": {900000: 1, 900001: 1, 900003: 2, 900004: 1, None: 1},
        "near_dedup": {900000: 1, 900001: 1, 900002: 1, 900003: 1, 900004: 1, None: 1},
        "mixing": {900000: 1, 900001: 1},
        "byte_bpe": {900000: 1, 900001: 1, 900002: 1, 900003: 2, 900004: 1, None: 1},
    }[name]
    assert {i: count(i) for i in want} == want
    if name != "byte_bpe":
        assert got.columns == odd_docs.columns
        text = {r.doc_id: r.text for r in got.where("doc_id = 900004").collect()}
        assert all(t == dict((r[0], r[1]) for r in ODD_STAGE)[i] for i, t in text.items())
    none = materialize(odd_docs.where("false"))
    assert stage(spark, none, SF).count() == 0


def test_pipeline_leaves_one_table(spark):
    from tidegrid.llm.common import live

    before = set(live)
    out = corpus_pipeline.run(spark, SF)
    assert set(live) - before == {out._tidegrid_path} and rows_of(out) > 100


def test_every_language_is_learned_in_one_job(spark):
    """Sixty made-up languages of no known family, a dozen rows each; families stay small."""
    rng = np.random.default_rng(8)
    rows = []
    for lang in range(60):
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:9]
        words = ["".join(rng.choice(letters, rng.integers(2, 7))) for _ in range(40)]
        rows += [(100 * lang + n, " ".join(rng.choice(words, 60)), f"x{lang:02d}") for n in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 100 < 12"))
    assert sorted(x for langs in model["families"].values() for x in langs) == sorted({r[2] for r in rows})
    assert len(model["families"]) <= 8 and set(model["logs"]) == {r[2] for r in rows}
    said = language_id.predict(docs.where("doc_id % 100 >= 12"), model)
    assert said.where("lang_pred = lang").count() >= 0.95 * said.count()


def test_op8_recall_with_few_visits(spark, monkeypatch):
    """Eighty lists of which ten are visited, on vectors that cluster; visits do not grow with the lists."""
    monkeypatch.setattr(onebit_ann, "LIST_ROWS", 50)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 24))[rng.integers(0, 60, 4000)] * 3 + rng.standard_normal((4000, 24))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = onebit_ann.search(vectors, F.col("vec_id") % 50 == 0, probes=10).toPandas()
    hits = 0
    for q in range(0, 4000, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.9 * 10 * 80
