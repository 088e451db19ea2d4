"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Targets: sources in order of code point (null last) weigh 1, 2, 3, repeating; they
share the words of the whole corpus, no source above CAP times its own size, what is
cut off being shared by weight among the others.

Curriculum: source s draws words at the rate weight * (1 + slope * (2t - 1)) over
training time t in [0, 1]; slope is SLOPES[rank % 3], so some sources come early and
others late. The integral of the rate over [0, 1] is the target. A source's documents
stand in hash order, repeated up to CAP times; a copy is taken while the middle of its
words lies below the target, and its training position is the time at which cumulative
demand reaches that middle (the inverse of the integral, a quadratic).

Sizes before a document within its source come from sums per hash bucket and per run of
buckets, and places in training order from counts per range of positions, so neither a hot
source nor the whole order is ever summed by one task. Texts are counted where they are
read; only their hashes are shuffled to tell rows of one id apart.

Nulls: a null text has size 0, a null source is a source of its own (the last), a null id is hashed by its text.
Documents without words take no words and have no position. Repeated ids are documents of their
own, told apart by a hash of their text; fully equal rows are each a document. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

CAP = 3
#: Weights and schedule slopes, both repeating along the sources.
WEIGHTS = (1, 2, 3)
SLOPES = (0.0, -0.5, 0.5)
ROWS_A_BUCKET = 400
RUN = 1024
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _pick(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def targets(by_source: DataFrame) -> DataFrame:
    """source, source_size, target, rank of each row (source, source_size): weighted sharing up to a cap.

    The capped sources are those of least size to weight: with cumulative sums in
    that order, a source is capped if the share left to it and the later ones,
    by weight, is at least its cap.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("rank"))
    later = ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = by_source.withColumn("rank", F.row_number().over(named) - 1).withColumn("weight", _pick(WEIGHTS, F.col("rank")).cast("long"))
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("left_weight", F.sum("weight").over(later))
    t = t.withColumn("spent", F.lit(CAP) * (F.sum("source_size").over(ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size")))
    t = t.withColumn("capped", F.lit(CAP) * F.col("source_size") * F.col("left_weight") <= F.col("weight") * (F.col("total") - F.col("spent")))
    t = t.withColumn("free_words", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.lit(CAP) * F.col("source_size"))).over(everything), F.lit(0)))
    t = t.withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    target = F.when(F.col("capped"),
        (F.lit(CAP) * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("free_words")).cast("double") / F.col("free_weight").cast("double"))
    return t.select("source", "source_size", target.alias("target"), "rank")


def training_time(share: Column, slope: Column) -> Column:
    """t in [0, 1] at which the integral of 1 + slope * (2t - 1) reaches share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def _measured(docs: DataFrame) -> DataFrame:
    """docs with __size (words), __tie (hash of the text), __h (hash of the id) and __s (source)."""
    source = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    return docs.withColumns({"__size": size_of(), "__tie": F.xxhash64("text"),
        "__h": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("text").cast("string")))), "__s": source})


def _prefix_sums(parts: DataFrame, run: int = RUN) -> DataFrame:
    """parts (__s, __b, __words) with __before: words of the source in smaller buckets; `run` buckets are summed together first."""
    inside = Window.partitionBy("__s", "__run").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    runs = Window.partitionBy("__s").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__run", F.floor(F.col("__b") / run))
    lead = parts.groupBy("__s", "__run").agg(F.sum("__words").alias("__of_run")).withColumn("__lead", F.coalesce(F.sum("__of_run").over(runs), F.lit(0)))
    parts = parts.withColumn("__inside", F.coalesce(F.sum("__words").over(inside), F.lit(0)))
    return parts.join(lead, ["__s", "__run"]).select("__s", "__b", "__words", (F.col("__lead") + F.col("__inside")).alias("__before"))


def assign_positions(measured: DataFrame, buckets: int, keep: list[str]) -> DataFrame:
    """Columns `keep` of _measured() documents, and __mix: struct of size, source_size, target and positions (training times of the copies taken)."""
    # buckets are ranges of the hash, so hash order is bucket order
    bucket = F.shiftright(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * F.lit(buckets), 32)
    d = measured.withColumn("__b", bucket)
    parts = _prefix_sums(d.groupBy("__s", "__b").agg(F.sum("__size").alias("__words")))
    sums = parts.groupBy("__s").agg(F.sum("__words").alias("source_size")).withColumn("source", F.when(~F.col("__s.missing"), F.col("__s.name")))
    source = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    t = targets(sums.select("source", "source_size")).select(source.alias("__s"), "source_size", "target", "rank")
    small = parts.join(t, "__s").select("__s", "__b", "__before", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("rank").alias("__rank"))
    inside = Window.partitionBy("__s", "__b").orderBy("__h", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__upto", F.sum("__size").over(inside)).join(small, ["__s", "__b"], "left")
    middle = F.col("__before") + F.col("__upto") - F.col("__size") / 2
    copies = F.transform(F.array(*[F.lit(i) for i in range(CAP)]), lambda i: i * F.col("__source_size") + middle)
    slope = _pick(SLOPES, F.col("__rank"))
    taken = F.filter(copies, lambda x: (F.col("__size") > 0) & (x < F.col("__target")))
    positions = F.transform(taken, lambda x: training_time(x / F.col("__target"), slope))
    mix = F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), positions.alias("positions"))
    return d.select(*[F.col(f"`{c}`") for c in keep], mix.alias("__mix"))


def _buckets(docs: DataFrame, rows_a_bucket: int) -> int:
    return max(1, docs.count() // rows_a_bucket)


def positions(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """docs with the column __mix of assign_positions()."""
    return assign_positions(_measured(docs), _buckets(docs, rows_a_bucket), docs.columns)


def curriculum(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """The taken copies of docs, in order of training position (range-partitioned and sorted)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = assign_positions(_measured(docs), _buckets(docs, rows_a_bucket), [*docs.columns, "__h", "__tie"])
    out = out.select(*own, "__h", "__tie", F.explode("__mix.positions").alias("__position"))
    order = ["__position", "__h", "__tie"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*own)


def training_order(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, first_position and first_place (of its first copy among all copies, from 0), last_position.

    Copies are dealt into ranges of positions; a copy's place is the count of copies in the ranges before its own and its rank there.
    """
    buckets = _buckets(docs, rows_a_bucket)
    # texts are read once: what follows reads some 70 bytes a row
    slim = stored(_measured(docs.select("doc_id", "source", "text")).drop("text", "source"), "sizes")
    placed = assign_positions(slim, buckets, ["doc_id", "__h", "__tie"])
    copies = placed.select("*", F.posexplode_outer("__mix.positions").alias("__copy", "__position")).withColumn("__range",
        F.floor(F.col("__position") * buckets))
    counts = copies.filter("__position IS NOT NULL").groupBy("__range").agg(F.count(F.lit(1)).alias("__words")).select(F.lit(0).alias("__s"),
        F.col("__range").alias("__b"), "__words")
    lead = _prefix_sums(counts).select(F.col("__b").alias("__range"), F.col("__before").alias("__lead"))
    # copies without a position are dealt out by id: null would be one range
    own_range = F.coalesce("__range", -1 - F.pmod(F.xxhash64("__h"), F.lit(buckets)))
    inside = Window.partitionBy("__range").orderBy("__position", "__h", "__tie")
    ranked = copies.withColumn("__range", own_range).withColumn("__rank", F.row_number().over(inside) - 1)
    ranked = ranked.filter("__copy IS NULL OR __copy = 0").join(lead, "__range", "left")
    mix = F.col("__mix")
    return ranked.select(
        "doc_id", mix["size"].alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"),
        (mix["size"] * F.size(mix["positions"])).cast("long").alias("taken"), F.col("__position").alias("first_position"),
        F.try_element_at(mix["positions"], F.lit(-1)).alias("last_position"),
        F.when(F.col("__copy").isNotNull(), F.col("__lead") + F.col("__rank")).cast("long").alias("first_place"),
    )


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"))


ORACLE_OP6 = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, (k % 3 + 1)::BIGINT AS weight, sum(source_size) OVER ()::BIGINT AS total FROM s),
o AS (SELECT *, sum(weight) OVER later::BIGINT AS left_weight, 3 * (sum(source_size) OVER upto - source_size)::BIGINT AS spent FROM w
  WINDOW later AS (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), upto AS (ORDER BY source_size / weight, k ROWS
  UNBOUNDED PRECEDING)),
c AS (SELECT *, 3 * source_size * left_weight <= weight * (total - spent) AS capped FROM o),
t AS (SELECT source, source_size, k, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (weight * (total - coalesce(sum(3 * source_size) FILTER
    (capped) OVER (), 0)))::BIGINT::DOUBLE
  / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM c),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, [0.0, -0.5, 0.5][t.k % 3 + 1]::DOUBLE AS slope, md5(d.doc_id::VARCHAR) AS h,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR) ROWS UNBOUNDED PRECEDING)::BIGINT - d.size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT m.*, i, (mid + i * source_size) / target AS share, 1 - slope AS b FROM m, (VALUES (0), (1), (2)) v(i) WHERE size > 0 AND mid + i *
    source_size < target),
p AS (SELECT *, CASE WHEN slope = 0 THEN share ELSE (sqrt(b * b + 4 * slope * share) - b) / (2 * slope) END AS position FROM y),
n AS (SELECT *, row_number() OVER (ORDER BY position, h) - 1 AS place FROM p),
g AS (SELECT doc_id, count(*) AS copies, min(position) AS first_position, max(position) AS last_position, min(place)::BIGINT AS first_place FROM n
    GROUP BY doc_id)
SELECT m.doc_id, m.size, m.source_size, m.target, (m.size * coalesce(g.copies, 0))::BIGINT AS taken, g.first_position, g.last_position, g.first_place
FROM m LEFT JOIN g ON g.doc_id = m.doc_id"""
