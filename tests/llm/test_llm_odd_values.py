"""Values, not counts, of odd rows: scores, rates, shards and fingerprints of null, empty, long, tied and repeated rows."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_shared import ODD_STAGE, SF
from tidegrid.llm import mixing, multiset_fp, sharding, toxicity
from tidegrid.llm.common import sorted_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_STAGE, SCHEMA)


@pytest.fixture(scope="module")
def both(spark, odd):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*odd.columns).unionByName(odd)


def test_toxicity_scores_of_odd_rows(spark, both):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(both.withColumn("score", F.lit("x")), toxicity.fit(both, labels)).collect()
    by_text = {}
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert by_text.setdefault(r.text or "", r.score) == r.score  # null is the empty text; repeats and copies tie
    assert len(scored) == both.count() and by_text[""] < 0.5
    long = next(r for r in scored if r.doc_id == 900004)
    assert long.predicted == 0  # two thousand clean sentences
    insults = spark.createDataFrame([(1, long.text + " you idiot, you worthless moron." * 4000)], "doc_id long, text string")
    worse = toxicity.score(insults, toxicity.fit(both, labels)).first().score
    assert worse > long.score


def test_mixing_rates_of_odd_rows(spark, both):
    labels = mixing.domains_of(spark.read.parquet(f"{SF}/labels.parquet"))
    rated = mixing.mix(both.withColumn("rate", F.lit("x")), labels).collect()
    words = {(r.doc_id, r.text): len((r.text or "").split()) for r in both.collect()}
    assert len(rated) == both.count()
    for r in rated:
        assert r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1)
        if r.tokens == 0:
            assert r.rate == 1.0 and r.copies == 1
    twice = [r for r in rated if r.doc_id == 900003]
    assert len(twice) == 2 and twice[0].rate == twice[1].rate and twice[0].copies == twice[1].copies
    assert {r.tokens for r in rated if r.doc_id == 900004} == {float(n) for (i, _), n in words.items() if i == 900004}
    kept = mixing.mix_rows(both, labels).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text) for r in kept if r.doc_id in (900000, 900001)} == {(900000, None), (900001, "")}
    assert sum(r["count"] for r in kept) == sum(r.copies for r in rated)


def test_million_word_texts_follow_the_sql(spark, tmp_path):
    """Three texts of a million words beside the others: the query's rates are those of its SQL, near 1."""
    clean = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id")
    words = " ".join(r.text for r in clean.collect()).split(" ")
    long = [(10**6 + n, " ".join((words * (1 + 1_000_000 // len(words)))[n : n + 1_000_000])) for n in range(3)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = mixing.op5_soft_mixing(spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(mixing.OP5_SQL).df()[list(got.columns)].sort_values("doc_id").reset_index(drop=True)
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), atol=2e-6)
    assert got[got.doc_id >= 10**6].rate.between(0.8, 1.25).all()


def test_shards_and_fingerprints_of_odd_rows(spark, odd):
    rows = sharding.shard_documents(odd, 4, rows_per_chunk=2).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, k) for s in range(4) for k in range(sum(r.shard == s for r in rows)))
    sizes = {(i, len((t or "").encode()) + 16) for i, t, *_ in ODD_STAGE}
    assert {(r.doc_id, r.size) for r in rows} == sizes and all(r.grown_shard in (r.shard, 4) for r in rows)
    prints = multiset_fp.fingerprint_edits(odd, rows_per_run=2).collect()
    by_id = {}
    for r in prints:
        by_id.setdefault(r.doc_id, set()).add((r.n_chars, r.fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(prints) == len(ODD_STAGE) and all(len(v) == 1 for v in by_id.values())
    assert {f for _, f in by_id[900000]} == {f for _, f in by_id[900001]} == {multiset_fp.to_hex(multiset_fp.fingerprint(""))}
    assert by_id[900004] == {(len(ODD_STAGE[5][1]), multiset_fp.to_hex(multiset_fp.fingerprint(ODD_STAGE[5][1])))}


def test_repeated_and_missing_ids_are_cut_by_their_texts(spark):
    """A third of the rows has no id, a third one id: their runs are parts, and slots and followers stay those of one sort."""
    rng = np.random.default_rng(2)
    ids = [None] * 70 + [5] * 70 + list(range(-30, 40))
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in ids]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string").repartition(7)
    runs = sorted_runs(docs, "doc_id", 10)
    sizes = [r["count"] for r in docs.groupBy(runs.of(F.col("doc_id"), F.crc32(F.col("text").cast("binary")))).count().collect()]
    assert runs.tied and max(sizes) <= 30 and len(sizes) > 15
    rows = [(i, zlib.crc32(t.encode()), len(t), t) for i, t in zip(ids, texts)]
    up = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    at, want = {}, []
    shard = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 3).collect()}
    for i, crc, n, _ in up:
        want.append((i, crc, n + 16, shard[i], at.setdefault(shard[i], 0)))
        at[shard[i]] += 1
    got = sharding.shard_documents(docs, 3, rows_per_chunk=10).collect()
    order = lambda rows: sorted(rows, key=lambda r: [(v is not None, v) for v in r])
    assert order((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in got) == order(want)
    down = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))
    following = [(r[0], r[3], down[(n + 1) % len(down)][3]) for n, r in enumerate(down)]
    assert order(tuple(r) for r in multiset_fp.with_next(docs, 10).collect()) == order(following)


def test_op3_scores_by_a_plain_walk_of_trees_and_calibration(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    weights = list(model["trees"].treeWeights)

    def walk(node, x):
        while node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    learned, stems = frozenset(model["lexicon"][0]), frozenset(model["lexicon"][1])
    steps = (list(model["calibration"].boundaries), list(model["calibration"].predictions)) if model["calibration"] is not None else None
    roots = [t.rootNode() for t in model["trees"]._java_obj.trees()]
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 60").collect()}
    got = {r.doc_id: r for r in toxicity.score(docs.where("doc_id < 60"), model).collect()}
    for i, t in texts.items():
        x = toxicity.features(t, learned, stems)
        chance = 1 / (1 + np.exp(-2 * sum(w * walk(r, x) for w, r in zip(weights, roots))))
        want = chance
        if steps is not None:
            calibrated = float(np.interp(chance, *steps))
            mixed = 0.98 * calibrated + 0.02 * chance
            want = max(mixed, 0.5) if calibrated >= 0.5 else min(mixed, 0.4999)
        # steps end 1e-9 before the next one begins, which widens the last digits of a chance
        assert got[i].score == pytest.approx(min(1.0, max(0.0, want)), abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5)
