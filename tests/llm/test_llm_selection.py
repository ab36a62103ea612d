"""Resampling, quality rules and spelling variants against plain Python, and odd rows through them."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests_llm_shared import ODD_STAGE, SF
from tidegrid.llm import quality, registry, resampling, spelling

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_STAGE, ODD_SCHEMA)


def plain_resample(rows, target):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, by the definition."""
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{x} {y}" for x, y in itertools.pairwise(w)]]

    got = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in got for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out = []
    for i, w, f in got:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] if r[0] is not None else -math.inf))
    rank = {id(r): at for at, r in enumerate(fit[: 25 * len(fit) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_resampling_with_a_hot_text_and_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(resampling, "RANK_ROWS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    hot = docs.where("doc_id = 3").first().text
    copies = spark.createDataFrame([(10_000 + i if i % 3 else None, hot) for i in range(300)], "doc_id long, text string")
    rows = docs.unionByName(copies).unionByName(odd.select("doc_id", "text"))
    rows = rows.selectExpr("*", "1 AS digest", "'x' AS copies", "2 AS weight", "3 AS score", "4 AS rank")
    target = spark.read.parquet(f"{SF}/benchmark.parquet").select("text")
    want = plain_resample([(r.doc_id, r.text) for r in rows.collect()], [r.text for r in target.collect()])
    assert as_rows(resampling.resample(rows, target)) == sorted(want, key=repr)


def test_resampling_of_nothing(spark, odd):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(odd.where("false"), target).count() == 0
    got = {(r.doc_id, r.n_features, r.weight, r.rank) for r in resampling.resample(odd.where("doc_id < 900002"), target).collect()}
    assert got == {(900000, 0, 0, None), (900001, 0, 0, None)}


def plain_statistics(text):
    """The statistics of a text by loops over its characters, words and lines."""
    words, lines, n = text.split(" "), text.split("\n"), len(text)
    share = lambda hit: sum(map(hit, text)) / n
    runs = lambda hit, least: sum(len(list(g)) >= least for k, g in itertools.groupby(text, hit) if k) / n
    fresh = lambda parts: sum(len(set(parts[at : at + quality.WINDOW])) for at in range(0, len(parts), quality.WINDOW)) / len(parts)
    return {
        "log_words": math.log1p(len(words)), "word_length": n / len(words),
        "capitals": share(str.isupper), "digits": share(str.isdigit), "stops": share(lambda c: c in ".,;:"), "bangs": share(lambda c: c in "!?"),
        "bars": share(lambda c: c == "|"), "symbols": share(lambda c: c in "#$%&*@^~+=<>_{}[]\\/"), "others": share(lambda c: not c.isalpha() and not c.isspace()),
        "breaks": share(lambda c: c == "\n"), "loud_runs": runs(str.isupper, 4), "marked_runs": runs(lambda c: not (c.isalnum() or c.isspace() or c in ".,;:'\")"), 2),
        "distinct_words": fresh(words), "distinct_lines": fresh(lines),
    }


def test_quality_statistics_are_those_of_plain_loops(spark):
    texts = ["One two two TWO three, four!!\nOne two $$$ x### 12 | end", "Über WORDS and the the the &&& end", "a", " ".join(f"w{n % 230} ÄÖÜSS" for n in range(900))]
    row = lambda t: [float(x) for x in spark.createDataFrame([(t,)], "t string").select(*[c.alias(n) for n, c in quality.statistics(quality.F.col("t")).items()]).first()]
    for t in texts:
        assert dict(zip(quality.NAMES, row(t))) == pytest.approx(plain_statistics(t)), t


def test_quality_scores_are_sums_of_rules_and_tell_held_out_rows(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out(3, 1)))
    assert 0 < len(model["rules"]) < 200
    # the same rules, by hand, over Spark's statistics of each text
    stats = docs.select("doc_id", quality.F.struct(*[c.alias(n) for n, c in quality.statistics(quality._text()).items()]).alias("s")).collect()
    want = {}
    for r in stats:
        total = model["intercept"] + sum(w for rule, w in model["rules"] if all(low < r.s[n] <= high for n, low, high in rule))
        want[r.doc_id] = 1 / (1 + math.exp(-total))
    got = {r.doc_id: r.score for r in quality.score(docs, model).select("doc_id", "score").collect()}
    assert got == pytest.approx(want)
    query = registry.QUERIES["op12_quality_rules"](spark, SF).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert (query["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in query["doc_id"]]).all()
    held = query[query["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9 and ((query["score"] >= 0.5) == query["predicted"]).all()
    scored = quality.score(odd.selectExpr("*", "'x' AS score", "'y' AS predicted", "1 AS _s"), model)
    assert scored.columns == [*odd.columns, "_s", "score", "predicted"] and scored.count() == len(ODD_STAGE)
    by_text = {}
    for r in scored.collect():
        assert 0 <= r.score <= 1 and by_text.setdefault(r.text or "", r.score) == r.score
    assert quality.score(odd.where("false"), model).count() == 0
    for some in (labels.where("quality = 1"), labels.where("false")):
        constant = quality.fit(docs, some)
        assert constant["rules"] == [] and {r.predicted for r in quality.score(odd, constant).collect()} == {int(some.count() > 0)}


def plain_spellings(rows):
    """(word, form, root, n, n_near, form_n) by comparing all words of equal or neighbouring length."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[p:] == b[p + 1 :]

    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        close = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if x != w and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, len(close))

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return [(w, out[w][0], root(w), n, out[w][1], words.get(out[w][0])) for w, n in words.items()]


@pytest.mark.parametrize("blocks", [(32_768, 8_192), (64, 6)])
def test_spelling_in_whole_and_cut_blocks(spark, odd, blocks):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    long = "ab" * 40_000
    extra = [
        (2_000_000, "colour colour colour colour colour colour color color color colours colours colours coluor coluor coluor"),
        (2_000_001, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaab aaaaab aaaaab baaaaa baaaaa baaaaa " * 2),
        (2_000_002, " ".join(f"prefix{a}{b}suffix " * 3 for a in "abcdef" for b in "abcdef")),
        (2_000_003, f"{long} {long} {long} {long[:50_000]}x{long[50_001:]} " * 3),
        (None, "Ünter Ünter Ünter ünter ünter ünter ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿāÿÿÿÿÿ"),
    ]
    rows = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).unionByName(odd.select("doc_id", "text"))
    want = plain_spellings([(r.doc_id, r.text) for r in rows.collect()])
    got = spelling.group_spellings(rows.selectExpr("*", "1 AS word", "2 AS n"), *blocks)
    assert as_rows(got) == sorted(want, key=repr)
    assert spelling.group_spellings(odd.where("false")).count() == 0


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(5)
    values = rng.permutation(500)
    tree = spelling.WaveletTree(values, 9)
    lo, low = rng.integers(0, 500, 200), rng.integers(0, 500, 200)
    hi, high = np.minimum(500, lo + rng.integers(0, 90, 200)), np.minimum(500, low + rng.integers(0, 90, 200))
    query, found = tree.report(lo, hi, low, high)
    want = {(q, v) for q in range(200) for v in values[lo[q] : hi[q]] if low[q] <= v < high[q]}
    assert set(zip(query.tolist(), found.tolist())) == want and len(query) == len(want)
