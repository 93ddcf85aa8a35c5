"""Secret scanning through an incremental blob ledger, with DataFrame functions only.

Every version of every text is addressed by the SHA-256 of its content. The ledger, a table
in a folder that outlives the session, has for each blob what was scanned for (rule and
version of the rule) and what was found. Only pairs of blob and rule version that it lacks are
scanned, each blob once however many paths and rows hold it: a new rule, or a rule's new
version, is the only one that known blobs are scanned for. Each call appends one set of files
when its scan is complete, so a call that fails leaves the ledger as it was. Findings are
joined back to all paths. Matches are found by Java regular expressions in the scan stage;
their offsets follow from the lengths of the matches and of the parts between them.

Rules: the three base kinds of the contract, and four more that the method adds (private
key headers, JSON web tokens, two vendors' token forms).

Skew: a text that makes up a third of the corpus is folded where it is scanned, before any
shuffle, and leaves each task once; joining findings back is a plain equi-join of digests
whose skewed side AQE splits.

Defined results: null text counts as empty; repeated rows keep their rows; a null id is a path
of its own; an empty table gives an empty result; two calls that append at a time may scan
a blob twice, and its findings count once. Only the named columns are looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.shared import shared_dir

#: raise a rule's number when its pattern changes
VERSIONS = {"assign": 1, "access": 1, "hex": 1, "pem": 1, "jwt": 1, "forge": 1, "chat": 1}
LEDGER = "blob_id binary, scanned array<string>, found array<struct<start:int,end:int,rule:string>>"
KEYWORD = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
#: kind, pattern, least length of the whole match (of group 2 for assign), cheap test
BASE = [
    ("assign", KEYWORD + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, None),
    ("access", r"AKIA[A-Z0-9]+", 16, "AKIA"),
    # a run of 32 or more is found from its start; shorter runs fail anyway
    ("hex", r"[0-9a-f]{32,}", 32, None),
]
EXTRA = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, "eyJ"),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, "gh"),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, "xox"),
]


def _spans(text: Column, number: int, kind: str, pattern: str, least: int, hint: str | None) -> Column:
    """array<struct<start, number, end, kind>> of the matches that pass."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else matches
    parts = F.split(text, pattern, -1)
    items = F.zip_with(F.zip_with(parts, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"))), values, lambda s, v: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), F.length(v).alias("val")))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    empty = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        hit = F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("pos"), F.when(x["val"] >= least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(items, empty, step, lambda acc: acc["out"])
    test = text.rlike(pattern) if hint is None else text.contains(hint) & text.rlike(pattern)
    return F.when(test, found).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def rule_names() -> list[str]:
    return [f"{r[0]}@{VERSIONS[r[0]]}" for r in [*BASE, *EXTRA]]


def scan(blobs: DataFrame) -> DataFrame:
    """blobs: blob_id, text, missing (rules to scan for) -> ledger rows."""


    def found(k: int, rule: tuple, name: str) -> Column:
        spans = F.when(F.array_contains("missing", name), _spans(F.col("text"), k, *rule))
        named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("rule")))
        return F.coalesce(named, F.array().cast("array<struct<start:int,end:int,rule:string>>"))

    parts = [found(k, rule, name) for k, (rule, name) in enumerate(zip([*BASE, *EXTRA], rule_names()))]
    return blobs.select("blob_id", F.col("missing").alias("scanned"), F.concat(*parts).alias("found"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger, without rows where nothing has been written yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def scan_versions(versions: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger in `folder` lacks, append it there, and return the findings for every row of versions."""
    spark = versions.sparkSession
    own = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("blob_id", F.unhex(F.sha2("text", 256)))
    rules = F.array(*[F.lit(x) for x in rule_names()])
    seen = read_ledger(spark, folder).groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))  # a row for each scan of the blob
    blobs = own.groupBy("blob_id").agg(F.first("text").alias("text"))
    missing = F.array_except(rules, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = blobs.join(seen, "blob_id", "left").select("blob_id", "text", missing.alias("missing")).filter(F.size("missing") > 0)
    scan(unseen).write.mode("append").option("compression", "zstd").parquet(folder)
    order = F.create_map(*[x for k, name in enumerate(rule_names()) for x in (F.lit(name), F.lit(k))])
    # rules in force, once each, in the order of starts and rules
    current = F.transform(F.array_distinct(F.flatten(F.collect_list("found"))), lambda s: F.struct(s["start"].alias("start"), order[s["rule"]].alias("number"), s["end"].alias("end"), F.substring_index(s["rule"], "@", 1).alias("kind")))
    now = read_ledger(spark, folder).groupBy("blob_id").agg(F.array_sort(F.filter(current, lambda s: s["number"].isNotNull())).alias("every"))
    base = F.filter("every", lambda s: s["number"] < len(BASE))
    count = lambda k: F.size(F.filter("every", lambda s: s["number"] == k)).cast("long")
    counts = [count(k).alias(f"n_{r[0]}") for k, r in enumerate(BASE)]
    now = now.select("blob_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))
    return own.select("id", "blob_id").join(now, "blob_id").select(F.col("id").alias(id_col), *[f"n_{r[0]}" for r in BASE], "base_sha256", "spans")


def new_ledger(spark: SparkSession) -> str:
    """A folder for a ledger that no call has used."""
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/secret-ledger-{uuid.uuid4().hex}"


def oracle_sql() -> str:
    """DuckDB SQL for scan_versions(documents)."""
    def kind(number: int, name: str, pattern: str, least: int, _: str | None) -> str:
        p = pattern.replace("'", "''")
        value = f"regexp_extract_all(text, '{p}', 2)" if name == "assign" else f"regexp_extract_all(text, '{p}')"
        return f"SELECT doc, {number} AS number, '{name}' AS kind, {least} AS least, regexp_extract_all(text, '{p}') AS ms, {value} AS vs, string_split_regex(text, '{p}') AS ps FROM d"

    union = " UNION ALL ".join(kind(k, *r) for k, r in enumerate([*BASE, *EXTRA]))
    counts = ", ".join(f"count(*) FILTER (kind = '{r[0]}') AS n_{r[0]}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({union}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc, number, kind, len(ms[i]) AS width, len(vs[i]) AS val, least,
        list_sum(list_transform(ps[1:i], lambda x: len(x)))
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS start FROM i),
t AS (SELECT doc, number, kind, start::BIGINT AS start, kind || ':' || start::BIGINT || ':' || (start + width)::BIGINT AS span FROM s WHERE val >= least),
g AS (SELECT doc, {counts},
        string_agg(span, ',' ORDER BY start, number) FILTER (number < {len(BASE)}) AS base,
        string_agg(span, ',' ORDER BY start, number) AS spans FROM t GROUP BY doc)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r[0]}, 0) AS n_{r[0]}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc = g.doc"""
