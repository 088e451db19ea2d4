"""Embedding near-dedup: int8 tile products with error bounds, then full precision where a pair may pass.

A unit vector u is rounded to u = s*q + e with q in int8. For two vectors
|u.v - s_u*s_v*(q_u.q_v)| <= |s_u*q_u|*|e_v| + |e_u|, with exact norms of each vector's
own rounding error. So a tile's int8 products tell links for certain, pairs out of
reach for certain, and the few in doubt. Integer products are exact in
float32 (64k dimensions at most are summed at once in slices).

Equal vectors are one class. Classes are dealt into blocks; each pair of blocks is one
task's tile, to which only the int8 rows, their scales and norms are sent. A tile returns a row
per vector with links: how many vectors it links with there, and the smallest of its tile
component; and it names the vectors in doubt, whose full vectors alone are
then sent to that tile and settled in double precision. No pairs leave a tile. The work
is that of all block pairs, in bounded tasks: the method compares all rows.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing; components of any finite size count (each vector is scaled by its largest first). Vectors of different
lengths do not link. Rows of one id with different vectors join their
classes into one component (the id is the node); rows with a null id have no links and no
component. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, least_labels, stored, table, tidy
from .components import components

THRESHOLD = 0.95
BLOCK = 4096
LEAST_BLOCKS = 8
_EXACT_DIMS = 1024  # 1024 * 127 * 127 < 2**24
_SLACK = 1e-9


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that no square over- or underflows."""
    x = vectors / np.abs(vectors).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q as int8, scale, norm of scale*q, norm of the rounding error), norms rounded up."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    back = q * scale[:, None]
    up = 1 + 1e-9
    return q.astype(np.int8), scale, np.linalg.norm(back, axis=1) * up, np.linalg.norm(unit - back, axis=1) * up + 1e-12


def _integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """q.q of float32 copies of int8 rows, exact."""
    if a.shape[1] <= _EXACT_DIMS:
        return a @ b.T
    return sum((a[:, k : k + _EXACT_DIMS] @ b[:, k : k + _EXACT_DIMS].T).astype(np.float64) for k in range(0, a.shape[1], _EXACT_DIMS))


def judged(a: tuple, b: tuple, same: bool, threshold: float, rows: int = 512):
    """Yields (i, j, certain) of pairs of rows of a and b, as quantised() gives them, that may reach the threshold; i < j if same."""
    qa, sa, la, ea = a
    qb, sb, _, eb = b
    qa, qb = qa.astype(np.float32), qb.astype(np.float32)
    for k in range(0, len(qa), rows):
        part = slice(k, k + rows)
        reach = la[part].max() * eb[None, :] + ea[part][:, None] + _SLACK
        unit = sa[part][:, None] * sb[None, :]
        i, j = np.nonzero(_integer_products(qa[part], qb) * unit >= threshold - reach)
        if same:
            ahead = i + k < j
            i, j = i[ahead], j[ahead]
        for m in range(0, len(i), 1 << 16):
            x, y = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
            product = np.einsum("ij,ij->i", qa[part][x], qb[y], dtype=np.float64) * unit[x, y]
            yield x + k, y, product - (la[part][x] * eb[y] + ea[part][x] + _SLACK) >= threshold


def _columns(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [group[c].to_numpy() for c in names]


class _Links:
    """Links of one tile's vectors, as counts and components."""

    def __init__(self, rep: np.ndarray, n: np.ndarray):
        self.rep, self.n, self.links, self.label = rep, n, np.zeros(len(rep), np.int64), np.arange(len(rep))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.links, x, self.n[y])
        np.add.at(self.links, y, self.n[x])
        self.label = self.label[least_labels(len(self.rep), self.label[x], self.label[y])[self.label]]

    def table(self, key: tuple, unsure: np.ndarray) -> pa.Table:
        some = np.flatnonzero((self.links > 0) | unsure)
        a, b, dims = (np.full(len(some), k.as_py()) for k in key)
        return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "dims": pa.array(dims, pa.int32()), "rep": self.rep[some],
            "links": self.links[some], "root": self.rep[self.label[some]], "unsure": unsure[some]})


MET = "a int, b int, dims int, rep long, links long, root long, unsure boolean"


def _sides(key: tuple, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    left, right = np.flatnonzero(block == key[0].as_py()), np.flatnonzero(block == key[1].as_py())
    return left, right, key[0].as_py() == key[1].as_py()


def _tile(threshold: float):
    """Certain links of one pair of blocks from int8 rows, and which vectors have pairs in doubt."""

    def run(key, group):
        group = group.combine_chunks().sort_by("rep")
        block, rep, n, scale, length, error = _columns(group, "block", "rep", "n", "scale", "length", "error")
        q = np.frombuffer(b"".join(group["q"].to_pylist()), np.int8).reshape(len(rep), -1)
        found, unsure = _Links(rep, n), np.zeros(len(rep), bool)
        left, right, same = _sides(key, block)
        for i, j, certain in judged(*((q[x], scale[x], length[x], error[x]) for x in (left, right)), same, threshold):
            found.add(left[i[certain]], right[j[certain]])
            unsure[left[i[~certain]]] = unsure[right[j[~certain]]] = True
        return found.table(key, unsure)

    return run


def _settle(threshold: float):
    """Links of one pair of blocks among its vectors in doubt, in double precision; those certain from int8 have been counted."""

    def run(key, group):
        group = group.combine_chunks().sort_by("rep")
        block, rep, n = _columns(group, "block", "rep", "n")
        u = units(group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rep), -1))
        parts = quantised(u)
        found = _Links(rep, n)
        left, right, same = _sides(key, block)
        for i, j, certain in judged(*(tuple(v[x] for v in parts) for x in (left, right)), same, threshold):
            x, y = left[i[~certain]], right[j[~certain]]
            link = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
            found.add(x[link], y[link])
        return found.table(key, np.zeros(len(rep), bool))

    return run


def _quantise(batches):
    for batch in batches:
        rep, n, block, dims = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        flat, ends = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
        for d in np.unique(dims).tolist():
            row = np.flatnonzero(dims == d)
            for k in range(0, len(row), 1024):
                some = row[k : k + 1024]
                q, scale, length, error = quantised(units(np.stack([flat[e - d : e] for e in ends[some].tolist()]).astype(np.float64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[some]), pa.array(n[some]), pa.array(block[some]), pa.array(dims[some]),
                    pa.array([x.tobytes() for x in q], pa.binary()), *map(pa.array, (scale, length, error))],
                    ["rep", "n", "block", "dims", "q", "scale", "length", "error"],
                )


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of embeddings (vec_id, embedding)."""
    usable = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < "
        "double('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = embeddings.select("vec_id", "embedding", F.coalesce(usable, F.lit(False)).alias("usable")).withColumn("h", F.xxhash64("embedding"))
    some = rows.filter("usable AND vec_id IS NOT NULL")
    classes = stored(some.groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    blocks = max(least_blocks, -(-classes.count() // block))
    dealt = classes.select("rep", "n", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"), F.size("embedding").alias("dims"), "embedding")
    small = stored(dealt.mapInArrow(tidy(_quantise), "rep long, n long, block int, dims int, q binary, scale double, length double, error double"), "quantised")
    tiles = small.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("*", F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b")).drop("other")
    met = stored(tiles.groupBy("a", "b", "dims").applyInArrow(_tile(threshold), MET), "met")
    doubt = met.filter("unsure").select("a", "b", "rep").join(dealt, "rep")
    settled = stored(doubt.groupBy("a", "b", "dims").applyInArrow(_settle(threshold), MET), "settled")
    both = met.filter("links > 0").unionByName(settled)
    links = both.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(both.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    labels = classes.select("h", "embedding", "rep", "n").join(links, "rep", "left").join(comps, F.col("node") == F.col("rep"), "left")
    labels = stored(labels.select("h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("component", "rep").alias("component")), "labels")
    drop_stored(classes, small, met, settled, comps)
    out = rows.select("vec_id", F.when(F.col("usable"), F.col("h")).alias("h"),
        F.when(F.col("usable"), F.col("embedding")).alias("embedding")).join(labels, ["h", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    own = F.col("vec_id").isNotNull()
    return out.select(
        "vec_id", F.when(own, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(own, component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op4_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND
    len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN (SELECT i, count(*) AS n FROM l GROUP BY i) n ON n.i = v.vec_id"""
