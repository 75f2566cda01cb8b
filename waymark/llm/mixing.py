"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The tree is domain > language > source. A node's token budget is dealt to its children by weight; a child cannot
take more than its subtree can give (tokens there times max_epochs), and what it leaves is dealt among its
siblings first. Only if a whole subtree is short does its parent's level, and so on up, make up for it: capped
proportional dealing from the root down does just that. A leaf then takes whole epochs and a token-prefix of the
next epoch; each epoch orders the leaf's documents by md5 of "seed-epoch-doc_id".

Nothing gathers a leaf: the prefix's end is found from sums over PREFIX_DIGITS-digit ranges of the key, then
inside the one range where the budget ends. Rows of the same key (repeated rows) go in or out together.

Defined cases: null text has 0 tokens and is chosen whenever its place in the order is; null lang, source or
domain count as '?'; names without a stated weight weigh 1; weight 0 gets nothing; an empty table gives an empty
result; extra columns pass through mix() and are ignored by mixture().
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import free, stage, text_column, word_count

PREFIX_DIGITS = 3
#: Leaves up to this number are broadcast (about 100 bytes each); more are joined by an exchange.
MOST_BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Plan:
    """Integer weights of the children at each level, the budget as a percentage of all tokens, and the epochs."""

    domain: Mapping[str, int] = field(default_factory=lambda: {"web": 4, "books": 3, "code": 2, "forum": 1})
    lang: Mapping[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 1, "es": 1})
    source: Mapping[str, int] = field(default_factory=dict)
    percent: int = 60
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source named src<number>: five sources each in web, books, code and forum."""
    n = F.try_to_number(F.regexp_extract(source, r"^src(\d{1,9})$", 1), F.lit("999999999")).cast("int")
    return F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "code").when(n < 20, "forum").otherwise("other")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), F.coalesce(doc_id.cast("string"), F.lit("?"))))


def weight_of(level: str, plan: Plan) -> Column:
    stated = getattr(plan, level)
    if not stated:
        return F.lit(1).cast("long")
    listed = F.create_map(*(x for name, w in stated.items() for x in (F.lit(name), F.lit(int(w)))))
    return F.coalesce(listed[F.col(level)], F.lit(1)).cast("long")


def deal(nodes: DataFrame, parents: list[str], level: str, plan: Plan) -> DataFrame:
    """nodes: parents' names, the level's name, cap, and the parents' budget. Adds `got`, each child's share.

    In ascending cap by weight, children whose cap lies below their share of what is left take their cap; from
    the first that doesn't, all share the rest by weight, rounded down.
    """
    nodes = nodes.withColumn("w", weight_of(level, plan)).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
    by = Window.partitionBy(*parents).orderBy(F.col("ratio").asc_nulls_last(), level)
    up = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0))
    nodes = nodes.withColumn("rest", F.col("budget") - (F.sum(live).over(up) - live)).withColumn("weights", F.sum("w").over(down))
    full = (F.col("w") > 0) & (F.col("cap") * F.col("weights") <= F.col("rest") * F.col("w"))
    nodes = nodes.withColumn("full", full)
    open_rest = F.max(F.when(~F.col("full") & (F.col("w") > 0), F.struct(F.col("weights"), F.col("rest")))).over(all_rows)
    share = F.expr("cast(o.rest * w div o.weights as bigint)")
    got = F.when(F.col("w") == 0, F.lit(0)).when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), share))
    return nodes.withColumn("o", open_rest).withColumn("got", got.cast("long")).drop("w", "ratio", "rest", "weights", "full", "o")


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves(domain, lang, source, avail) with `got`: each leaf's tokens."""
    leaves = leaves.withColumn("cap", F.col("avail") * plan.max_epochs)
    total = F.expr(f"cast(sum(avail) over () * {plan.percent} div 100 as bigint)")  # over leaves, not rows
    budgets, above = None, []
    for level in LEVELS:
        if budgets is None:
            nodes = leaves.withColumn("budget", total).groupBy(level).agg(F.sum("cap").cast("long").alias("cap"), F.first("budget").alias("budget"))
        else:
            nodes = leaves.groupBy(*above, level).agg(F.sum("cap").cast("long").alias("cap")).join(budgets, above)
        nodes = deal(nodes, above, level, plan)
        above = [*above, level]
        budgets = nodes.select(*above, F.col("got").alias("budget"))
    return leaves.join(budgets, list(LEVELS)).select(*LEVELS, "avail", F.col("budget").alias("got"))


def leaf_columns() -> dict[str, Column]:
    """The leaf of a document, by level."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return {"domain": domain_of(name("source")), "lang": name("lang"), "source": name("source")}


def cutoffs(sizes: DataFrame, plan: Plan) -> DataFrame:
    """sizes(doc_id, domain, lang, source, tokens), staged. A row per leaf: the epochs taken whole and the last
    key of the next epoch's prefix (compared as text; a bare range's name ends before that range)."""
    leaf = list(LEVELS)
    leaves = sizes.groupBy(*leaf).agg(F.sum("tokens").cast("long").alias("avail"))
    budgets = stage(leaf_budgets(leaves, plan), "budgets")
    budgets = budgets.withColumn("whole", F.when(F.col("avail") > 0, F.expr("cast(got div avail as int)")).otherwise(F.when(F.col("got") >= 0, 0)))
    budgets = budgets.withColumn("part", F.col("got") - F.col("whole") * F.col("avail"))
    if budgets.count() <= MOST_BROADCAST_LEAVES:
        budgets = F.broadcast(budgets)
    keyed = sizes.join(budgets.select(*leaf, "whole", "part"), leaf).filter("part > 0")
    keyed = keyed.withColumn("key", order_key(plan.seed, F.col("whole"), F.col("doc_id"))).withColumn("range", F.substring("key", 1, PREFIX_DIGITS))
    ranges = keyed.groupBy(*leaf, "range", "part").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumn("upto", F.sum("tokens").over(run))
    ends = ranges.filter(F.col("upto") > F.col("part")).groupBy(*leaf).agg(F.min(F.struct("range", (F.col("upto") - F.col("tokens")).alias("base"))).alias("e"))
    ends = stage(ends.select(*leaf, F.col("e.range").alias("range"), F.col("e.base").alias("base")), "ends")
    inside = keyed.join(F.broadcast(ends) if ends.count() <= MOST_BROADCAST_LEAVES else ends, [*leaf, "range"])
    peers = Window.partitionBy(*leaf).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("cum", F.col("base") + F.sum("tokens").over(peers)).filter(F.col("cum") <= F.col("part"))
    last = inside.groupBy(*leaf).agg(F.max("key").alias("last"))
    found = ends.select(*leaf, "range").join(last, leaf, "left").select(*leaf, F.coalesce("last", "range").alias("cut"))
    return stage(budgets.select(*leaf, "whole").join(found, leaf, "left"), "cutoffs")


def chosen_epochs(cut: Column, whole: Column, doc_id: Column, plan: Plan) -> Column:
    """The epochs in which a document is taken."""
    epochs = F.array(*(F.lit(e) for e in range(plan.max_epochs)))
    return F.filter(epochs, lambda e: (e < whole) | ((e == whole) & cut.isNotNull() & (order_key(plan.seed, e, doc_id) <= cut)))


def measured(docs: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    sizes = stage(docs.select("doc_id", *(c.alias(k) for k, c in leaf_columns().items()), word_count(text_column()).alias("tokens")), "sizes")
    return sizes, cutoffs(sizes, plan)


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST_LEAVES else df


def mixture(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """A row for each document and epoch taken: doc_id, domain, lang, source, epoch, tokens."""
    sizes, cuts = measured(docs, plan)
    joined = sizes.join(small(cuts), list(LEVELS))
    return joined.select("doc_id", *LEVELS, F.explode(chosen_epochs(F.col("cut"), F.col("whole"), F.col("doc_id"), plan)).alias("epoch"), "tokens")


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of docs in the mixture, once per epoch taken; the cut is a key, so texts are not exchanged."""
    _, cuts = measured(docs, plan)
    own = {c: free(docs, f"_{c}") for c in (*LEVELS, "whole", "cut", "epoch")}
    leafed = docs.withColumns({own[k]: c for k, c in leaf_columns().items()})
    joined = leafed.join(small(cuts.withColumnsRenamed(own)), [own[c] for c in LEVELS])
    taken = joined.withColumn(own["epoch"], F.explode(chosen_epochs(F.col(own["cut"]), F.col(own["whole"]), F.col("doc_id"), plan)))
    return taken.select(*docs.columns)


def names_sql(level: str, plan: Plan) -> str:
    stated = getattr(plan, level)
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in stated.items()) + " ELSE 1 END" if stated else "1"


def oracle_sql(plan: Plan = Plan(), docs: str = "documents") -> str:
    """The same mixture in DuckDB's SQL, by running sums over whole leaves."""
    space = r"[^ \t\n\x0B\f\r]+"
    steps, above = [], []
    budgets = "total"
    for level in LEVELS:
        cols = "".join(f"{c}, " for c in above)
        part = f"PARTITION BY {', '.join(above)} " if above else ""
        using = f"JOIN {budgets} USING ({', '.join(above)})" if above else f"CROSS JOIN {budgets}"
        order = f"{part}ORDER BY ratio NULLS LAST, {level}"
        steps.append(f"""n_{level} AS (SELECT *, CASE WHEN w > 0 THEN cap / w END AS ratio FROM (SELECT {cols}{level}, cap, budget, CAST({names_sql(level, plan)} AS BIGINT) AS w FROM (SELECT {cols}{level}, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY ALL) {using})),
r_{level} AS (SELECT *, budget - (sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) - CASE WHEN w > 0 THEN cap ELSE 0 END) AS rest, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM n_{level}),
f_{level} AS (SELECT *, w > 0 AND cap * ws <= rest * w AS is_full FROM r_{level}),
o_{level} AS (SELECT *, max(CASE WHEN NOT is_full AND w > 0 THEN ws END) OVER ({part}) AS ows, arg_max(rest, CASE WHEN NOT is_full AND w > 0 THEN ws END) OVER ({part}) AS orest FROM f_{level}),
b_{level} AS (SELECT {cols}{level}, CAST(CASE WHEN w = 0 THEN 0 WHEN is_full THEN cap ELSE least(cap, (orest * w) // ows) END AS BIGINT) AS budget FROM o_{level})""")
        budgets, above = f"b_{level}", [*above, level]
    return f"""WITH sized AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{space}')) AS BIGINT) AS tokens, TRY_CAST(regexp_extract(coalesce(source, '?'), '^src(\\d{{1,9}})$', 1) AS INTEGER) AS n FROM {docs}),
sizes AS (SELECT doc_id, CASE WHEN n < 5 THEN 'web' WHEN n < 10 THEN 'books' WHEN n < 15 THEN 'code' WHEN n < 20 THEN 'forum' ELSE 'other' END AS domain, lang, source, tokens FROM sized),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS avail, CAST(sum(tokens) * {plan.max_epochs} AS BIGINT) AS cap FROM sizes GROUP BY ALL),
total AS (SELECT CAST(coalesce(sum(avail), 0) * {plan.percent} // 100 AS BIGINT) AS budget FROM leaves),
{', '.join(steps)},
epochs AS (SELECT s.*, CAST(e AS INTEGER) AS epoch, least(l.avail, b.budget - e * l.avail) AS part, l.avail, b.budget FROM sizes s JOIN leaves l USING (domain, lang, source) JOIN b_source b USING (domain, lang, source) CROSS JOIN range(0, {plan.max_epochs}) AS r(e)),
keyed AS (SELECT *, md5('{plan.seed}-' || epoch || '-' || coalesce(CAST(doc_id AS VARCHAR), '?')) AS key FROM epochs WHERE part > 0),
cums AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key) AS cum FROM keyed)
SELECT doc_id, domain, lang, source, epoch, tokens FROM cums WHERE cum <= part"""
