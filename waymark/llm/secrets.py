"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of a file is a row (a path key and its text). A text's SHA-256 is its blob; copies of a text on
any number of paths share one blob. The ledger holds which (blob, rule, rule version) pairs have been scanned
and what was found; only pairs missing there are scanned, once per blob, and findings are joined back to all
paths. Raising a rule's version makes its pairs unseen again; findings of older versions are then left aside.

Defined cases: null text is the empty text (no findings); rows may repeat (each gets its row); a null key is
kept; extra columns are ignored; an empty table gives an empty result. Positions count code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import free, fresh_path, text_column


@dataclass(frozen=True)
class Rule:
    """pattern finds leftmost non-overlapping matches; one counts if the given group has least_chars. hint is a
    necessary condition, cheap to test, in the texts that hold a match."""

    name: str
    version: int
    pattern: str
    group: int
    least_chars: int
    hint: str


#: Fixed values of the contract: kinds in their listed order, with their patterns and least lengths.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:passw|secret|token|api_?key)[a-zA-Z]{0,3}["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)

PAIRS = "blob binary, rule string, version int"
FINDINGS = "blob binary, rule string, version int, start long, end long"


def hinted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether any rule can match; a text without a hint has no findings."""
    said = F.lit(False)
    for rule in rules:
        said = said | (F.contains(text, F.lit(rule.hint)) if rule.hint.isalnum() else text.rlike(rule.hint))
    return said


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def ledger_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger's table; empty where none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def match_spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (blob, rule, version, start, end) for the rules named in the column `rules` of (blob, text, rules).

    split() leaves the gaps between the matches that regexp_extract_all() returns, so running sums of the two
    lengths are the positions.
    """
    found = None
    for rule in rules:
        pattern = F.lit(rule.pattern)
        part = blobs.filter(F.array_contains("rules", rule.name)).select(
            "blob",
            F.posexplode(
                F.arrays_zip(
                    F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"),
                    F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length).alias("size"),
                    F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length).alias("value"),
                )
            ).alias("pos", "m"),
        )
        before = Window.partitionBy("blob").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        part = (
            part.withColumn("end", F.sum(F.col("m.gap") + F.coalesce(F.col("m.size"), F.lit(0))).over(before))
            .filter(F.col("m.size").isNotNull() & (F.col("m.value") >= rule.least_chars))
            .select("blob", F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), (F.col("end") - F.col("m.size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        )
        found = part if found is None else found.unionByName(part)
    return found


def scan_versions(versions: DataFrame, key: str, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Bring the ledger up to date with these versions. Returns (key, blob) of every path; findings are in the ledger."""
    spark = versions.sparkSession
    paths_at = fresh_path(spark, "paths")
    body = text_column(text)
    rows = versions.select(F.col(key).alias("key"), body.alias("text"))
    rows.select("key", blob_of(F.col("text")).alias("blob"), hinted(F.col("text"), rules).alias("hint")).write.parquet(paths_at)
    paths = spark.read.schema(rows.select("key", F.lit(b"").alias("blob"), F.lit(True).alias("hint")).schema).parquet(paths_at)

    seen = ledger_table(spark, f"{ledger}/pairs", PAIRS)
    blobs = paths.groupBy("blob").agg(F.min("key").alias("key"), F.max("hint").alias("hint"))
    wanted = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    unseen = blobs.select("blob", "key", "hint", F.inline(wanted)).join(seen, ["blob", "rule", "version"], "left_anti")
    unseen_at = fresh_path(spark, "unseen")
    unseen.write.parquet(unseen_at)
    unseen = spark.read.schema(unseen.schema).parquet(unseen_at)

    todo = unseen.filter("hint").groupBy("blob").agg(F.first("key").alias("key"), F.collect_list("rule").alias("rules"))
    texts = rows.filter(hinted(F.col("text"), rules)).withColumn("blob", blob_of(F.col("text")))
    one = texts.alias("t").join(todo.alias("d"), F.col("t.key").eqNullSafe(F.col("d.key")) & (F.col("t.blob") == F.col("d.blob")))
    found = match_spans(one.select(F.col("d.blob").alias("blob"), "text", "rules").dropDuplicates(["blob"]), rules)
    found.write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", "rule", "version").write.mode("append").parquet(f"{ledger}/pairs")
    return paths.select("key", "blob")


def findings_by_blob(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): a blob's findings by the rules' present versions, by start, then by the rules' order."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    found = ledger_table(spark, f"{ledger}/findings", FINDINGS)
    current = None
    for r in rules:
        this = (F.col("rule") == r.name) & (F.col("version") == r.version)
        current = this if current is None else current | this
    found = found.filter(current).dropDuplicates()
    return found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", order[F.col("rule")].alias("nth"), "end", F.col("rule").alias("kind")))).alias("found"))


def new_ledger(spark: SparkSession) -> str:
    return fresh_path(spark, "ledger")


def spans_string(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(versions: DataFrame, key: str, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, blob, found) for every row of versions: all findings of its blob, from this scan or earlier ones."""
    spark = versions.sparkSession
    ledger = ledger or new_ledger(spark)
    paths = scan_versions(versions, key, ledger, rules)
    joined = paths.join(findings_by_blob(spark, ledger, rules), "blob", "left")
    nothing = F.array().cast("array<struct<start:bigint,nth:int,end:bigint,kind:string>>")
    return joined.select("key", "blob", F.coalesce("found", nothing).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of scan()."""
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        F.col("key").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(spans_string(F.col("found")), 256).alias("base_sha256"), spans_string(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every finding in text replaced by the mask (overlapping ones by one mask)
    and n_chars, where there is such a column, set anew. Rows without a hint pass without an exchange."""
    spark = docs.sparkSession
    ledger = ledger or new_ledger(spark)
    body = text_column()
    maybe = docs.filter(hinted(body, rules))
    scan_versions(docs, "doc_id", ledger, rules)
    blob, found = free(docs, "_blob"), free(docs, "_found")
    with_blob = maybe.withColumn(blob, blob_of(body))
    joined = with_blob.join(findings_by_blob(spark, ledger, rules).withColumnsRenamed({"blob": blob, "found": found}), blob, "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, x: F.struct(
        F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], x["end"]).alias("at"),
    )
    end = lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    clean = joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(F.aggregate(found, start, step, end)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return docs.filter(~hinted(body, rules)).unionByName(clean.select(docs.columns))


def oracle_sql(rules: tuple[Rule, ...] = RULES, docs: str = "documents") -> str:
    """digest(scan()) in DuckDB's SQL, every text scanned by every rule."""
    part = "SELECT doc_id, '{name}' AS kind, {nth} AS nth, {least} AS least, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS s, regexp_extract_all(t, '{p}', {group}) AS v FROM d"
    parts = " UNION ALL ".join(part.format(name=r.name, nth=i, least=r.least_chars, group=r.group, p=r.pattern.replace("'", "''")) for i, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in rules)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}), m AS ({parts}), x AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM m WHERE len(s) > 0),
f AS (SELECT doc_id, kind, nth, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(s[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS a, length(s[i]) AS n FROM x WHERE length(v[i]) >= least),
r AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, nth) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in rules)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""
