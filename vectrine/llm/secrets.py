"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by its SHA-256. The ledger holds, for each blob, the rule versions it has been
scanned with and the spans they found; a run scans only the pairs of blob and rule version it has not seen, appends
them, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.llm.common import ID, TEXT, documents, tasks_for, work_path
from vectrine.llm.graph import spread_join


@dataclass(frozen=True)
class Rule:
    """A pattern in Java syntax; group `group` of a match must have at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Where a pattern is one run of characters, the least length stands in it: shorter runs fail either way.
BASE_RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", least=20),
    Rule("hex", 1, r"[0-9a-f]{24,}", least=24),
)
ADDED_RULES = (
    Rule("pem", 1, r"-----BEGIN(?: [A-Z0-9]+)* PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE_RULES + ADDED_RULES
SPAN = "array<struct<start:int,kind:int,end:int,rule:string>>"
_SPAN = T.StructType().add("start", T.IntegerType()).add("kind", T.IntegerType()).add("end", T.IntegerType()).add("rule", T.StringType())
LEDGER = T.StructType().add("blob", T.BinaryType()).add("scanned", T.ArrayType(T.StringType())).add("spans", T.ArrayType(_SPAN))


def _spans(rule: Rule, order: int, text: Column, matches: Column) -> Column:
    """Spans of the matches by place: the text between matches and the matches themselves add up to the places."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    step = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), matches.alias("value"))
    start = lambda acc, x: acc["at"] + F.length(x["gap"])
    end = lambda acc, x: acc["at"] + F.length(x["gap"]) + F.length(x["whole"])
    one = lambda acc, x: F.array(F.struct(start(acc, x).alias("start"), F.lit(order).alias("kind"), end(acc, x).alias("end"), F.lit(rule.key).alias("rule")))
    fold = F.aggregate(
        step,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(end(acc, x).alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(acc["out"], one(acc, x))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(F.size(matches) > 0, fold).otherwise(F.array().cast(SPAN))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, scanned, spans) of (blob, text, done): each rule runs unless `done` holds its version."""
    todo = lambda r: ~F.array_contains("done", r.key)
    matched = blobs.select("blob", TEXT, "done", *[F.when(todo(r), F.regexp_extract_all(TEXT, F.lit(r.pattern), r.group)).otherwise(F.array().cast("array<string>")).alias(f"m{k}") for k, r in enumerate(rules)])
    spans = [_spans(r, k, F.col(TEXT), F.col(f"m{k}")) for k, r in enumerate(rules)]
    return matched.select("blob", F.array_except(F.array(*[F.lit(r.key) for r in rules]), "done").alias("scanned"), F.concat(*spans).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; a ledger that does not exist yet is empty."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(df: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, blob, spans) for every row: spans by start, then kind, as struct(start, kind, end, rule).

    kind is the rule's place in `rules`; places count code points, end exclusive. ledger is a folder all executors
    see and is appended to; without one a fresh ledger is kept for this run. Null texts are the empty blob. Equal
    texts are scanned once and every path gets the findings; repeated rows and null ids each keep their row. An
    empty table gives an empty table.
    """
    versions = documents(df, id_col, text_col).withColumn("blob", _blob(TEXT))
    found = _findings(versions.select("blob", TEXT), ledger, rules)
    return spread_join(versions.select(ID, "blob"), found, ["blob"], "left").select(ID, F.hex("blob").alias("blob"), F.coalesce("spans", F.array().cast(SPAN)).alias("spans")).coalesce(tasks_for(df))


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def _findings(blobs: DataFrame, ledger: str | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of the blobs with findings, after the unseen pairs of (blob, text) were scanned and recorded."""
    spark = blobs.sparkSession
    path = ledger or work_path(spark, "ledger")
    keys = [r.key for r in rules]
    if ledger is None:
        unseen = blobs.dropDuplicates(["blob"]).withColumn("done", F.array().cast("array<string>"))
    else:
        done = read_ledger(spark, path).select("blob", F.explode("scanned").alias("key")).where(F.col("key").isin(keys)).groupBy("blob").agg(F.collect_set("key").alias("done"))
        unseen = blobs.dropDuplicates(["blob"]).join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>"))).where(F.size("done") < len(keys))
    scan_blobs(unseen, rules).coalesce(tasks_for(blobs)).write.mode("append").parquet(path)
    wanted = F.filter("spans", lambda s: s["rule"].isin(keys))
    found = spark.read.schema(LEDGER).parquet(path).select("blob", wanted.alias("spans")).where(F.size("spans") > 0)
    return found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def mask_documents(df: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = TEXT) -> DataFrame:
    """df with every finding of its texts masked; all rows and columns stay, whatever their names, null texts stay null."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.unhex(F.sha2(text, 256)).alias("blob"))
    found = _findings(df.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias(TEXT)), ledger, rules)
    joined = spread_join(whole, found, ["blob"], "left")
    old = F.col("row")[text_col]
    clean = F.when(F.col("spans").isNull(), old).otherwise(masked(old, F.col("spans")))
    return joined.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]).coalesce(tasks_for(df))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans are replaced once."""
    fold = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out")))
        .when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out")))
        .otherwise(acc),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, fold).otherwise(text)


def union_of(tables: list[DataFrame]) -> DataFrame:
    """One table of all historical versions, each (doc_id, text)."""
    return reduce(DataFrame.unionByName, tables)
