"""Graphs from tables and files: packing, checks, and the driver tables' own graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.session import table
from waymark.staging import dealt, stage


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs both ways between customers (2 * key) and suppliers (2 * key + 1), by the least quantity bought."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    pairs = joined.groupBy((2 * F.col("o_custkey")).alias("c"), (2 * F.col("l_suppkey") + 1).alias("s")).agg(F.min("l_quantity").cast("long").alias("w"))
    return pairs.select(F.col("c").alias("src"), F.col("s").alias("dst"), "w").union(pairs.select("s", "c", "w"))


PURCHASES_SQL = """pairs AS (SELECT 2 * o_custkey AS c, 2 * l_suppkey + 1 AS s, CAST(min(l_quantity) AS BIGINT) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
ed AS (SELECT c AS src, s AS dst, w FROM pairs UNION ALL SELECT s, c, w FROM pairs)"""


def successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs between users of consecutive events, by the least of the later event's rounded value; no loops."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    after = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"), "value")
    met = events.select("event_id", F.col("user_id").alias("src")).join(dealt(after), "event_id").filter("src != dst")
    return met.groupBy("src", "dst").agg(F.min(F.floor("value")).cast("long").alias("w"))


SUCCESSIONS_SQL = """ed AS (SELECT a.user_id AS src, b.user_id AS dst, CAST(min(floor(b.value)) AS BIGINT) AS w FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id GROUP BY ALL)"""


def ordered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with `name`, dense from 0 in the order of `by`: dealt by range and sorted, a row's number is its place in
    its part behind the parts before. No key gathers in a task, and one number a part reaches the driver."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = "_place"
    while own.lower() in {c.lower() for c in rows.columns}:
        own = f"_{own}"
    place = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(own, F.monotonically_increasing_id())
    placed = stage(place, "ordered")
    part = F.shiftright(own, 33)
    before, total = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before[r["part"]], total = total, total + r["n"]
    if not before:
        return placed.select(*rows.columns, F.col(own).alias(name))
    firsts = F.create_map(*(F.lit(int(x)).cast("long") for pair in before.items() for x in pair))
    return placed.select(*rows.columns, (firsts[part] + F.col(own).bitwiseAND(F.lit(2**33 - 1))).alias(name))


def packed(edges: DataFrame) -> DataFrame:
    """Adds e, dense from 0 in (src, dst) order."""
    return ordered(edges.select("src", "dst", "w"), ["src", "dst"], "e").select("e", "src", "dst", "w")


def prefix_sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `before`: the sum of value over smaller keys (each key once). Rows are dealt by ranges of the keys that are
    there, however sparse; sums run inside a range, behind those of the ranges before."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    cut = stage(dealt, "ranges")
    sums, total = {}, 0
    for r in sorted(cut.groupBy("_part").agg(F.sum(value).alias("s")).collect()):
        sums[r["_part"]], total = total, total + r["s"]
    if not sums:
        return cut.select(*rows.columns, F.lit(0).cast("long").alias("before"))
    base = F.create_map(*(F.lit(int(x)).cast("long") for pair in sums.items() for x in pair))
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("before", base[F.col("_part")] + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part")


def offsets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """v, first (its first arc's number), degree, for every vertex."""
    degrees = vertices.select("v").join(edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree")), "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))
    return prefix_sums(degrees, "v", "degree").select("v", F.col("before").alias("first"), "degree")


def violations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many arcs or vertices break each rule of a graph; vertices may have places x and y.

    One plan: arcs are counted by their two ends with what is wrong about them, pairs meet the vertices, and one last
    aggregate adds what was found."""
    infinite = F.lit(float("inf"))
    w = F.col("w").cast("double")
    bad = F.col("w").isNull() | F.isnan(w) | (w < 0) | (w == infinite)
    nowhere = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == infinite) for c in ("x", "y") if c in vertices.columns]
    unplaced = F.count_if(nowhere[0] | nowhere[1]) if len(nowhere) == 2 else F.lit(0).cast("long")
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    known = vertices.select("v").distinct()
    for end in ("src", "dst"):
        pairs = pairs.join(known.select(F.col("v").alias(end), F.lit(True).alias(f"{end}_known")), end, "left")
    loose = F.when(F.col("src_known").isNull(), F.col("n")).otherwise(0) + F.when(F.col("dst_known").isNull(), F.col("n")).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = pairs.agg(
        total(F.col("n")).alias("arcs"), total(F.when(F.col("src") == F.col("dst"), F.col("n"))).alias("loops"), total(F.col("bad")).alias("bad_weights"), total(loose).alias("loose_ends"), F.count_if(F.col("n") > 1).alias("doubled"),
    )
    return found.join(F.broadcast(vertices.agg(unplaced.alias("unplaced"))), F.lit(True))  # one row each


def checked(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The arcs, packed; raises where a rule is broken."""
    found = violations(vertices, edges).first()
    broken = {k: found[k] for k in ("loops", "bad_weights", "loose_ends", "doubled", "unplaced") if found[k]}
    if broken:
        raise ValueError(f"not a graph: {broken}")
    return packed(edges)


def read_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(arcs, expected distances) of JSON files {name, n, edges, source, distances}; null stands for unreachable."""
    schema = "name string, n long, edges array<struct<`from`:long,`to`:long,weight:double>>, source long, distances array<double>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    arcs = rows.select("name", "source", F.inline("edges")).withColumnsRenamed({"from": "src", "to": "dst", "weight": "w"})
    return arcs, rows.select("name", "source", F.posexplode("distances").alias("v", "dist"))
