"""Target-distribution importance resampling: documents whose words look like a target's are drawn first.

Position-table n-grams. The words of every text are exploded with their positions; for orders above one, lead() over a
document's positions joins the words that follow. Each feature hashes to a bucket; the buckets of the corpus and of the
target are counted (partial counts before the exchange, at most `buckets` rows a task), a bucket's gain is the
floored log of the ratio of its smoothed shares, and gains come back to the features by a join with a table of at most
`buckets` rows, which is broadcast: its size is a parameter and does not grow with the data. Sums of a document are
partial before the exchange too, so that a row a document travels. The draw adds Gumbel noise from a seeded hash of the
doc_id; ranks come from a sort by range (sources.graphs.ordered), never from one task's window.

With order 1 no window is needed and no word is exchanged. With higher orders a document's words are dealt by the
document, one exchange for the counts and one for the sums; no document's words meet another's in a group.

Defined cases: a null text is an empty one: no features, weight 0; a null doc_id is drawn with the noise of the empty
string and stands before all others in ties; rows that repeat are each scored, and drawn one after the other; an empty target gives gains by the
corpus alone, an empty corpus an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import drop_staged, stage, text_column
from waymark.sources.graphs import ordered

BUCKETS, ORDERS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a lower-cased text: letters and digits of ASCII, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(rows: DataFrame, by: list[str], orders: int = ORDERS) -> DataFrame:
    """by, feature, size: every run of 1 to `orders` consecutive words of rows(by, text), joined by one space, and how
    many words it has; a text without words keeps one row, without a feature."""
    table = rows.select(*by, F.posexplode_outer(words_of(text_column())).alias("position", "feature"))
    if orders == 1:
        return table.select(*by, "feature", F.lit(1).alias("size"))
    following = Window.partitionBy(*by).orderBy("position")
    runs = [F.col("feature")]
    for n in range(1, orders):  # concat with the null behind the last word is null
        runs.append(F.concat(runs[-1], F.lit(" "), F.lead("feature", n).over(following)))
    joined = table.select(*by, *(run.alias(f"run{n}") for n, run in enumerate(runs, 1)))
    sized = [F.struct(F.col(f"run{n}").alias("feature"), F.lit(n).alias("size")) for n in range(1, orders + 1)]
    found = joined.select(*by, F.inline(F.array(*sized)))
    return found.filter("feature is not null or size = 1")


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number of their own: doc_ids may repeat or be null."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def counts(rows: DataFrame, name: str, orders: int, buckets: int) -> DataFrame:
    keyed = numbered(rows.select("text")) if orders > 1 else rows.select("text")
    found = features(keyed, ["row"] if orders > 1 else [], orders).filter("feature is not null")
    return found.groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: 1000 times the log of the target's smoothed share over the corpus's, floored; all buckets there are."""
    spark = docs.sparkSession
    s, t = (stage(counts(rows, name, orders, buckets), f"counts-{name}") for rows, name in ((docs, "s"), (target, "t")))
    all_s, all_t = (df.agg(F.coalesce(F.sum(name), F.lit(0)).cast("double")).first()[0] for df, name in ((s, "s"), (t, "t")))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(s), "bucket", "left").join(F.broadcast(t), "bucket", "left")  # `buckets` rows each at most
    share = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1
    gain = F.floor(1000 * F.log((share("t") * F.lit(all_s + buckets)) / (share("s") * F.lit(all_t + buckets))))
    out = stage(both.select("bucket", gain.cast("long").alias("gain")), "gains")
    drop_staged(s), drop_staged(t)
    return out


def weights(docs: DataFrame, found: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of docs. found(bucket, gain)."""
    by = ["row", "doc_id"]
    hashed = features(numbered(docs.select("doc_id", "text")), by, orders).withColumn("bucket", bucket_of(F.col("feature"), buckets))
    met = hashed.join(F.broadcast(found), "bucket", "left")  # `buckets` rows
    words = F.count_if((F.col("size") == 1) & F.col("feature").isNotNull()).alias("n_words")
    return met.groupBy(*by).agg(words, F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")).drop("row")


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel draw times 1000, floored, from the first 32 bits of sha256("seed:doc_id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    found = weights(docs, gains(docs, target, orders, buckets), orders, buckets)
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs: of the N with `least_words` words or more the
    floor(percent * N / 100) of highest score have ranks from 1 (ties to the smaller doc_id), the others null."""
    rows = stage(scored(docs, target, orders, buckets, seed), "scored")
    able = F.col("n_words") >= least_words
    drawn = percent * rows.filter(able).count() // 100
    placed = ordered(rows.filter(able).withColumn("_down", -F.col("score")), ["_down", "doc_id"], "_nth")
    rank = F.when(F.col("_nth") < drawn, F.col("_nth") + 1).cast("long").alias("rank")
    names = ("doc_id", "n_features", "weight", "score")
    return placed.select(*names, rank).unionByName(rows.filter(~able).select(*names, F.lit(None).cast("long").alias("rank")))


def oracle_sql(percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """resample() of documents towards benchmark, single words, in DuckDB's SQL: crc32 by its table, byte by byte."""
    word = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '{}')".format(UPPER, LOWER, WORD)
    step = "c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END"
    return f"""WITH RECURSIVE bits(i, c, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) AS r(i) UNION ALL SELECT i, xor({step}), k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, {word} AS words, row_number() OVER () AS uid FROM documents), b AS (SELECT {word} AS words FROM benchmark),
w AS (SELECT uid, unnest(words) AS w FROM d), v AS (SELECT unnest(words) AS w FROM b),
hex AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM w UNION SELECT w FROM v)),
bytes AS (SELECT w, [CAST(('0x' || x[2 * i - 1 : 2 * i]) AS BIGINT) FOR i IN range(1, len(x) // 2 + 1)] AS bytes FROM hex),
h AS (SELECT w, xor(list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM w JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM v JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) + {buckets})) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) + {buckets})))) AS BIGINT) AS gain
 FROM (SELECT i AS bucket FROM range({buckets}) AS r(i)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT uid, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN h USING (w) JOIN g USING (bucket) GROUP BY uid),
y AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, uid,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN x USING (uid)),
r AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS n FROM y WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN n <= {percent} * (SELECT count(*) FROM r) // 100 THEN n END AS rank FROM y LEFT JOIN r USING (uid)"""
