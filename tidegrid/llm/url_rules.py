"""URL filtering as a sort-merge range join with a sweep over nested rules.

A host turns into its canonical key, the labels reversed and closed by a dot
(``www.example.com`` -> ``com.example.www.``), so that "this host and all its subdomains" is the
interval of keys that start with the rule's key.  Pages and rules are dealt to ranges of keys,
sorted, and swept once: a rule is pushed when the sweep reaches its interval and popped when the
sweep leaves it, so the stack holds exactly the nested rules that are active.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import bound_batches, chunk_of, drawn, table, tidy

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT_VERDICT = "allow"
BOUND_SAMPLE = 20_000
ROWS_PER_RANGE = 500_000
MOST_RANGES = 4096
MOST_BOUND = 300  # characters of a bound
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path) of a url; both empty for null or where there is no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + F.lit(3), F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(default: str):
    """Sweep sorted rows; every stack entry is (end key, {path: (rule, verdict)}, path lengths)."""

    def run(batches):
        stack: list = []
        part = key = None
        for pdf in batches:
            out = []
            for range_id, pos, end, path, rule, verdict, page_id, host in zip(
                pdf["range_id"], pdf["pos"], pdf["end"], pdf["path"], pdf["rule"], pdf["verdict"], pdf["page_id"], pdf["host"]
            ):
                if range_id != part:
                    stack, part, key = [], range_id, None
                while stack and pos >= stack[-1][0]:
                    stack.pop()
                    key = None
                if end is not None:  # a rule
                    if key != pos:
                        stack.append((end, {}, []))
                        key = pos
                    _, rules, lengths = stack[-1]
                    if path not in rules or verdict == "block":
                        rules[path] = (rule, verdict)
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, rules, lengths in stack:
                    for n in lengths:
                        hit = rules.get(path[:n]) if n <= len(path) else None
                        if hit:
                            if best is None or len(hit[0]) >= len(best[0]):
                                best = hit
                            break
                out.append((page_id, host, path, *(best or (None, default))))
            if out:
                yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``rules`` has host, path, verdict.  A rule fits its host and all subdomains if the url's path
    starts with the rule's path; the longest rule (host and path together) wins, then the more
    specific host; of equal rules ``block`` wins.  Rules without a host fit nothing.  A null url or
    one without ``://`` has an empty host and path and gets the default verdict.  Repeated pages
    are judged each; very long urls are judged whole; an empty table gives an empty result; other
    columns are ignored, whatever their names.

    Ranges are cut at quantiles of a bounded sample of positions (at most about ``BOUND_SAMPLE``;
    the cuts only decide where rows are swept).  A position is the host key and a hash of the page
    and its path, so a host or url that holds a third of all rows is spread over many ranges.  A rule
    goes to every range that its interval meets.
    """
    bound_batches(pages.sparkSession)
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    # no key holds U+0001 unless the url does, and prefixes of keys compare alike either way
    rows = rows.withColumn(
        "pos", F.concat("key", F.lit("\u0001"), F.hex(F.xxhash64("page_id", "path")))
    )
    n = pages.count()
    ranges = min(MOST_RANGES, max(8, n // ROWS_PER_RANGE))
    # a beginning of a position cuts as well as the whole, whatever the length of a host
    cuts = rows.where(drawn(min(1.0, BOUND_SAMPLE / max(n, 1)), "page_id", "path")).select(F.substring("pos", 1, MOST_BOUND).alias("cut"))
    seen = sorted(r.cut for r in cuts.limit(2 * BOUND_SAMPLE).collect())
    bounds = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    range_of = lambda c: chunk_of(c, bounds, inclusive=True)

    known = rules.where((F.col("host") != "") & F.col("path").isNotNull()).select(
        host_key(F.col("host")).alias("pos"), "path", F.concat("host", "path").alias("rule"), "verdict"
    )
    known = known.withColumn("end", F.concat(F.expr("substring(pos, 1, length(pos) - 1)"), F.lit("/")))
    known = known.withColumn(
        "range_id", F.explode(F.sequence(range_of(F.col("pos")), range_of(F.col("end"))))
    ).select(
        "range_id", "pos", "end", "path", "rule", "verdict", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host")
    )
    none = F.lit(None).cast("string")
    events = rows.select(
        range_of(F.col("pos")).alias("range_id"), "pos", none.alias("end"), "path", none.alias("rule"), none.alias("verdict"), "page_id", "host"
    ).unionByName(known)
    swept = events.repartition(max(ranges, 8), "range_id").sortWithinPartitions("range_id", "pos", F.desc_nulls_last("end"))
    return swept.mapInPandas(
        tidy(_sweep(default)), "page_id long, host string, path string, rule string, verdict string"
    )


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
