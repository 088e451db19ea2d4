"""Chat formatting: cumulative-snapshot collapse, then rendering of maximal conversations.

Turns of a conversation are ordered by (turn, role, text), nulls first; identical rows count
once. Turns are hashed where they are read, and two position-keyed 64-bit hashes
are rolled over them, so equal prefixes have equal hashes. A conversation whose whole is a
proper prefix of another's, or equals one of a smaller id, is removed by an anti
join; only the texts of the rest are shuffled, once, and rendered. Texts order turns of one
place and role only where there are several, so only those are shuffled for that.

Null role or text renders as empty but differs from "" in comparison. A row with a null conv_id
is a conversation of its own (equal ones are one), the first of its copies if there are any. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_PLACE = ["key", "turn", "role"]


def _hashed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, a and b (hashes of role and text), key (the conversation: its id, or the row's hash where that is null)."""
    missing = F.when(F.col("role").isNull(), 1).otherwise(0) + F.when(F.col("text").isNull(), 2).otherwise(0)
    rows = turns.select("conv_id", "turn", "role", "text", F.xxhash64(missing, "role", F.lit(0), "text").alias("a"),
        F.xxhash64("text", F.lit(1), "role", missing).alias("b"))
    own = F.concat(F.lit("\0row "), F.xxhash64("turn", "a", "b").cast("string"))
    return rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), own))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = left["key"] == right["key"]
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def rolling(turns: DataFrame) -> DataFrame:
    """key, conv_id, pos (from 1), n (turns), h1, h2 (of the prefix that ends here)."""
    hashed = _hashed(turns)
    rows = hashed.select("conv_id", *_PLACE, "a", "b").distinct()
    ties = rows.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("several")).filter("several > 1")
    texts = hashed.join(ties, _same(hashed, ties, ["turn", "role"]), "left_semi").select(*_PLACE, "a", "b", "text").distinct()
    ranks = texts.select(*_PLACE, "a", "b", F.row_number().over(Window.partitionBy(*_PLACE).orderBy(F.col("text").asc_nulls_first())).alias("k"))
    ranked = rows.join(ranks, _same(rows, ranks, ["turn", "role", "a", "b"]), "left").select(*[rows[c] for c in ("conv_id", *_PLACE, "a", "b")],
        F.coalesce(ranks["k"], F.lit(0)).alias("k"))
    whole = Window.partitionBy("key")
    upto = whole.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "k").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("pos", F.count(F.lit(1)).over(upto)).withColumn("x", F.xxhash64("pos", "a")).withColumn("y", F.xxhash64("b", "pos"))
        .select("key", "conv_id", "pos", F.count(F.lit(1)).over(whole).alias("n"), F.bit_xor("x").over(upto).alias("h1"), F.bit_xor("y").over(upto).alias("h2"))
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """key of conversations that are no proper prefix of another and the first of their copies."""
    first = F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id", "key")).alias("first")
    whole = rolled.filter("pos = n").groupBy("n", "h1", "h2").agg(first)
    proper = rolled.filter("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select(F.col("first.key").alias("key"))


def collapse(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, rendered. Texts are dealt by conversation once, for the join and the rendering."""
    rows = _hashed(turns).select("key", "conv_id", "turn", "role", "text")
    own = rows.join(maximal(rolling(turns)), "key", "left_semi")
    said = F.array_sort(F.collect_set(F.struct("turn", "role", "text")))
    blank = F.lit("")
    text = F.transform(said, lambda x: F.concat(F.lit(OPEN), F.coalesce(x["role"], blank), F.lit("\n"), F.coalesce(x["text"], blank), F.lit(CLOSE)))
    return own.groupBy("key").agg(F.max("conv_id").alias("conv_id"), F.size(said).cast("long").alias("n_turns"),
        F.array_join(text, "").alias("rendered")).drop("key")


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


ORACLE_OP7 = f"""
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
  {{'r': role, 't': text}} AS x, '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said FROM r),
c AS (SELECT conv_id, count(*) AS n_turns, list(x ORDER BY pos) AS xs, string_agg(said, '' ORDER BY pos) AS rendered FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, rendered FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.xs[1] IS NOT DISTINCT FROM c.xs[1] AND d.n_turns >= c.n_turns
  AND d.xs[1:c.n_turns] = c.xs AND (d.n_turns > c.n_turns OR d.conv_id < c.conv_id))"""
