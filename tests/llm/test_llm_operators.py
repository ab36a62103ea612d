"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidegrid.llm import byte_bpe, chat_template, language_id, mixing, multiset_fp, near_dup, onebit_ann, sharding, toxicity, url_rules

SF = "/root/testdata/sf0.001"
ODD = [(1, "", "en", "s"), (2, None, None, None), (None, "Hello there you", "en", "s"), (3, "one", "en", "s"), (3, "one", "en", "s"), (4, "ONE", "fr", "s"), (5, "x " * 200_000, "fr", "s"), (6, "été 123 \U0001f600\n\n  end ", "fr", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty text, a very long one, ties, a repeated row, and columns whose names clash."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns(
        {c: F.lit(0) for c in ("score", "node", "key", "tokens", "rate", "group", "shard", "_row", "ids")}
    )


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def brute_sets(texts, width):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(lower))
        yield {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(ids, texts, width):
    sets, parent = list(brute_sets(texts, width)), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return {k: min(ids[m] for m in range(len(ids)) if find(m) == find(n)) for n, k in enumerate(ids)}, dict(zip(ids, map(len, sets)))


@pytest.mark.parametrize("width", [2, 5])
def test_near_dup_is_brute_force(spark, docs, width):
    found, own = near_dup.cluster(docs, width).toPandas(), docs.toPandas()
    want, sizes = brute_components(own.doc_id.tolist(), own.text.tolist(), width)
    assert dict(zip(found.doc_id, found.component_id)) == want
    assert dict(zip(found.doc_id, found.n_shingles)) == sizes
    assert (found.kept == (found.doc_id == found.component_id)).all()
    kept = near_dup.dedup(docs, width)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_near_dup_second_sweep(spark):
    """A chain whose ends are unlike, and rows that only link through members other than the smallest."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[i * 6 : i * 6 + 80]) for i in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_components(list(range(20)), texts, 2)
    found = near_dup.cluster(rows, 2).toPandas()
    assert dict(zip(found.doc_id, found.component_id)) == want


def test_near_dup_odd(spark, odd, nothing):
    got = near_dup.cluster(odd, 2).orderBy("doc_id").collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, None: None, 3: 3, 4: 3, 5: 5, 6: 6}
    assert near_dup.dedup(odd, 2).count() == 6 and near_dup.dedup(odd, 2).columns == odd.columns
    assert near_dup.cluster(nothing, 2).count() == 0 and near_dup.dedup(nothing, 2).count() == 0


def test_long_words_match_short_path(monkeypatch):
    text = "alpha beta " * 50 + "y" * 700 + " gamma"
    whole = near_dup.shingle_sets([text], 2)[0]
    monkeypatch.setattr(near_dup, "SLICE", 64)
    assert (near_dup.shingle_sets([text], 2)[0] == whole).all()


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, odd, nothing):
    got = sharding.shard_documents(docs, 40, rows_per_chunk=30).toPandas()
    assert (got.shard == [jump(k, 40) for k in got.doc_id]).all() and (got.grown_shard == [jump(k, 41) for k in got.doc_id]).all()
    assert ((got.shard == got.grown_shard) | (got.grown_shard == 40)).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard_documents(odd, 7).count() == len(ODD) and sharding.shard_documents(nothing, 7).count() == 0


def test_url_rules(spark):
    urls = ["http://example.com/en/7x?q", "http://a.EXAMPLE.com/en/8", "http://badexample.com/en/7", "http://example.net/de/8", "http://org/es/", "nourl", None, "x://", "http://com#f"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1), (None, urls[0], 1)], "page_id long, url string, rule int")
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got[0] == ("example.com", "/en/7x", "example.com/en/7", "allow") and got[None] == got[0]
    assert got[1] == ("a.example.com", "/en/8", "com/en/", "block") and got[2][2] == "com/en/"
    assert got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow") and got[8] == ("com", "", None, "allow")
    assert url_rules.judge_urls(pages.where("false"), rules).count() == 0


def test_fingerprints(spark, docs, odd, nothing):
    a, b = multiset_fp.fingerprint("p\nq\nr"), multiset_fp.fingerprint("r\np\nq")
    assert (a == b).all() and (multiset_fp.insert(multiset_fp.delete(a, ["q"]), ["q"]) == a).all()
    got = multiset_fp.fingerprint_edits(docs, rows_per_run=30).toPandas().set_index("doc_id")
    own = docs.toPandas().sort_values("doc_id", ascending=False)
    texts, ids = own.text.tolist(), own.doc_id.tolist()
    for n, (i, t) in enumerate(zip(ids, texts)):
        after, half = texts[(n + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.fingerprint[i] == multiset_fp.to_hex(multiset_fp.fingerprint(t))
    assert multiset_fp.fingerprint_edits(odd).count() == len(ODD) and multiset_fp.fingerprint_edits(nothing).count() == 0


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(1, 1, "assistant", said), (1, 0, "user", None), (2, 0, "assistant", "<turn x>\\"), (2, 1, "assistant", ""), (None, 0, "user", "hi"), (3, 0, None, "t" * 50)]
    rows = spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, marks int")
    got = {r.conv_id: r for r in chat_template.read_back(chat_template.format_conversations(rows, part_chars=10)).collect()}
    for conv, own in {1: [("user", ""), ("assistant", said)], 2: [("assistant", "<turn x>\\"), ("assistant", "")], None: [("user", "hi")], 3: [("", "t" * 50)]}.items():
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_template.format_conversations(rows.where("false")).count() == 0
    assert chat_template.fold(chat_template.parse("{{ 'a' ~ 'b' }}{% if 1 == 2 %}x{% endif %}c")) == [("text", "abc")]
    with pytest.raises(chat_template.TemplateError):
        chat_template.compile_template("{{ message.__class__ | evil }}")


def test_neighbours(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(9001, None, 0), (9002, [0.0] * 64, 0), (9003, [float("nan")] + [1.0] * 63, 0), (9004, [None] + [1.0] * 63, 0), (None, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int")
    got = onebit_ann.search(vectors.unionByName(odd), F.col("vec_id") % 100 == 0).toPandas()
    own = vectors.toPandas()
    x, ids = np.array(own.embedding.tolist(), dtype=np.float64), own.vec_id.to_numpy()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        want = [(ids[i], d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        hits += len({i for i, _ in want} & set(mine.vec_id))
        exact = dict(zip(ids, d))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in zip(mine.vec_id, mine.score))
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()
    assert onebit_ann.search(odd.where("vec_id > 9000"), F.col("vec_id") % 100 == 0).count() == 0


def test_language_id(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out(4, 2)).select("text", "lang"))
    held = language_id.predict(docs.where(language_id.held_out(4, 2)), model).toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()
    said = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert said[1].lang_pred == said[2].lang_pred == "und" and said[6].lang_pred in {"en", "de", "fr", "es"}
    assert language_id.predict(nothing, model).count() == 0
    assert language_id.predict(odd, language_id.fit(nothing)).where("lang_pred = 'und'").count() == len(ODD)


def test_toxicity(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    held = toxicity.score(docs, model).join(labels.where(language_id.held_out(5, 0)), "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.95
    assert (held.predicted == (held.score >= 0.5)).all() and held.score.between(0, 1).all()
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(nothing, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(nothing, labels.where("false"))).count() == len(ODD)


def test_toxicity_scores_are_chances_at_any_sample_size(spark):
    """One row in twenty is toxic, and one in five of the borderline texts: 0.2 however few clean rows are drawn."""
    rng = np.random.default_rng(11)
    plain = "river stone window garden paper winter letter market bridge music forest table".split()
    rows = []
    for n in range(6000):
        text = " ".join(rng.choice(plain, 12)) + f" {n}"
        border = n % 10 == 0
        toxic = n % 50 == 0 or n % 33 == 1 and not border
        rows.append((n, ("idiot " if border else "you idiot moron scum " if toxic else "") + text, int(toxic), border))
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int, border boolean")
    for most in (10_000, 600):
        scored = toxicity.score(made.where("border"), toxicity.fit(made.select("doc_id", "text"), made.select("doc_id", "toxic"), most))
        at = scored.agg(F.avg("score").alias("score"), F.avg("predicted").alias("predicted")).first()
        assert at.score == pytest.approx(0.2, abs=0.15) and at.predicted == 0


def test_mixing(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, mixing.domains_of(labels)).toPandas()
    p = np.array(got.posterior.tolist())
    totals = (got.rate.to_numpy() * got.tokens.to_numpy()) @ p
    assert p.sum(axis=1) == pytest.approx(np.ones(len(p))) and (got.rate >= 0).all()
    assert totals / totals.sum() == pytest.approx([0.97, 0.03], abs=0.005)
    kept = mixing.mix_rows(docs, mixing.domains_of(labels))
    assert kept.columns == docs.columns and kept.count() == got.copies.sum()
    few = spark.createDataFrame([(1, "high"), (4, "high"), (5, "low")], "doc_id long, domain string")
    assert mixing.mix(odd, few).count() == len(ODD) and mixing.mix_rows(odd, few).columns == odd.columns
    assert mixing.mix(nothing, few).count() == 0 and mixing.mix_rows(odd, few.where("false")).count() == len(ODD)


def test_mixing_meets_targets_beside_very_long_texts(spark):
    """op5: five texts of a million words; the exact nonnegative solution has no misses."""
    rng = np.random.default_rng(7)
    tokens = np.concatenate([np.full(5, 1e6), rng.integers(50, 2_000, 400)])
    low = np.concatenate([np.full(5, 0.02), np.where(rng.random(400) < 0.4, 0.97, 0.03)])
    rows = [(float(t), [1 - float(p), float(p)]) for t, p in zip(tokens, low)]
    soft = spark.createDataFrame(rows, "tokens double, posterior array<double>")
    own = float(tokens @ (1 - low))
    targets = [own, own * 0.03 / 0.97]
    rate = mixing.fit_rates(soft, targets)
    got = np.array([r.rate for r in soft.select(rate(F.col("tokens"), F.col("posterior")).alias("rate")).collect()])
    assert (got >= 0).all()
    assert (got * tokens) @ np.stack([1 - low, low], axis=1) == pytest.approx(targets, rel=mixing.TOLERANCE)
    out = mixing.fit_rates(soft, [own, 0.0])  # no rates meet this: any row has a part in both domains
    assert soft.select(F.min(out(F.col("tokens"), F.col("posterior")))).first()[0] >= 0


def test_mixing_keeps_very_long_clean_texts(spark):
    """Texts joined from high-labelled ones of one language keep a rate near 1 at any length."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    clean = docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").toPandas().text
    words = " ".join(clean).split(" ")
    long = [(10**6 + n, " ".join((words * (1 + n // len(words)))[:n])) for n in (20_000, 100_000, 500_000)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    got = mixing.mix(both, mixing.domains_of(labels)).where(f"doc_id > {10**6}").toPandas()
    assert len(got) == 3 and got.rate.between(0.8, 1.25).all()
    low = np.array(got.posterior.tolist())[:, 1]
    assert (low < 0.3).all() and low.max() - low.min() < 0.05


def test_bpe(spark, docs, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted((-1 if r.doc_id is None else r.doc_id, tuple(known.encode_ordinary(r.text or ""))) for r in both.collect())
    got = byte_bpe.encode(both, ranks, public_tokenizers.PATTERN, block_chars=20_000, out_ids=5_000)
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(got, ranks).collect()}
    assert back[6] == ODD[-1][1].encode() and back[1] == b""
    assert byte_bpe.encode_digests(nothing, path, public_tokenizers.PATTERN).count() == 0
