"""Exact top-k inner-product search over norm-sorted blocks.

Vectors are range-sorted by descending length and cut into blocks.  The first
block gives every query a threshold (its k-th best score so far).  Every other
block is then searched with two Cauchy-Schwarz bounds: |q|*|v| drops whole
blocks and single vectors; a partial inner product over the first axes of an
SVD rotation plus the product of the two residual lengths drops most of the
rest.  What is left is scored exactly in integers.  No bound is approximate:
results are those of a full scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoq.llm.common import batch_of, materialise

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
_BLOCK = "block bigint, n int, max_norm double, ids binary, vectors binary"
_BEST = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(scale * component) as integers.  A vector that is
    null, or holds a null, NaN or infinite component, is left out."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("bigint").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, zero-padded to ``dim``."""
    flat, edges = column.values.to_numpy(), column.offsets.to_numpy()
    width = np.diff(edges)
    if len(width) and (width == dim).all():
        return flat[edges[0]:edges[-1]].reshape(-1, dim)
    out = np.zeros((len(width), dim), np.int64)
    inside = np.arange(dim) < width[:, None]
    out[inside] = flat[edges[0]:edges[-1]]
    return out


def _blocks(dim: int, rows: int):
    """Packs consecutive rows of ``(key, vec_id, v)`` into block rows."""
    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("max_norm", pa.float64()),
                        ("ids", pa.binary()), ("vectors", pa.binary())])

    def pack(batches):
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), 0
        held_ids, held = np.zeros(0, np.int64), np.zeros((0, dim), np.int64)

        def block(ids, m):
            nonlocal made
            made += 1
            norm = float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max()))
            return batch_of(schema, [(part << 32) + made - 1], [len(ids)], [norm], [ids.tobytes()], [np.ascontiguousarray(m).tobytes()])

        for b in batches:
            held_ids = np.concatenate([held_ids, b.column(0).to_numpy()])
            held = np.concatenate([held, _matrix(b.column(1), dim)])
            while len(held_ids) >= rows:
                yield block(held_ids[:rows], held[:rows])
                held_ids, held = held_ids[rows:], held[rows:]
        if len(held_ids):
            yield block(held_ids, held)

    return pack


def _rotation(ints: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors: eigenvectors of the dim x dim
    matrix of component products, which the tasks sum up."""
    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(1), dim).astype(np.float64)
            total += m.T @ m
        yield batch_of(schema, np.arange(dim, dtype=np.int32), total.tolist())

    sums = (ints.mapInArrow(moments, "i int, row array<double>")
            .select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")))
    gram = np.zeros((dim, dim))
    for r in sums.collect():  # dim * dim numbers
        gram[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _search(rotation: np.ndarray, axes: int, k: int, pairs_at_once: int = 50_000):
    """Best ``k`` of a block for each query of a query block, above the
    queries' thresholds.  Input rows: ids, vectors, query ids, query vectors,
    thresholds (of the query block)."""
    dim = len(rotation)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def parts(m):
        f = m.astype(np.float64)
        turned = f @ rotation
        return turned[:, :axes], np.sqrt((turned[:, axes:] ** 2).sum(1)), np.sqrt((f ** 2).sum(1))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, m = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, dim)
                q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"], np.int64).reshape(-1, dim)
                floor = np.frombuffer(r["thresholds"], np.float64)
                head, rest, norm = parts(m)
                q_head, q_rest, q_norm = parts(q)
                # rounding of the float bounds is far below 1e-9 of |q|*|v|
                slack = 1e-9 * q_norm * (norm.max() if len(norm) else 0) + 1e-6
                alive = np.flatnonzero(q_norm * norm.max() + slack >= floor)
                for at in range(0, len(alive), 256):
                    some = alive[at:at + 256]
                    bound = q_head[some] @ head.T + np.outer(q_rest[some], rest)
                    qi, vi = np.nonzero(bound + slack[some, None] >= floor[some, None])
                    keep = q_ids[some[qi]] != ids[vi]
                    qi, vi = some[qi[keep]], vi[keep]
                    score = np.empty(len(qi), np.int64)
                    for p in range(0, len(qi), pairs_at_once):
                        s = slice(p, p + pairs_at_once)
                        score[s] = (q[qi[s]] * m[vi[s]]).sum(1)
                    order = np.lexsort((ids[vi], -score, qi))
                    qi, vi, score = qi[order], vi[order], score[order]
                    first = np.searchsorted(qi, qi, "left")
                    best = np.arange(len(qi)) - first < k
                    yield batch_of(schema, q_ids[qi[best]], ids[vi[best]], score[best])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_inner_product(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, axes: int | None = None,
                        id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS,
                        query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner
    products of every query (rows for which ``is_query``, a condition on
    ``vec_id``, holds) with all other rows; ties to the smaller id.

    Vectors that are null or hold a null or non-finite component take no part.
    Vectors of different lengths count as padded with zeros.  Rows that share
    an id share its self-exclusion; repeated vectors under other ids are all
    candidates.  Fewer than ``k`` candidates: all of them.  Empty table: no
    rows.  Other columns are ignored."""
    spark = vectors.sparkSession
    ints = materialise(integer_vectors(vectors, scale, id_col, vec_col), "vectors")
    size = ints.agg(F.max(F.size("v")).alias("dim"), F.count(F.when(is_query, 1)).alias("queries")).first()
    dim = size["dim"] or 0
    if not dim or not size["queries"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    rotation = _rotation(ints, dim)
    axes = axes or max(1, dim // 4)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    blocks = materialise(ints.withColumn("norm", norm).repartitionByRange(F.desc("norm"), "vec_id")
                         .sortWithinPartitions(F.desc("norm"), "vec_id").select("vec_id", "v")
                         .mapInArrow(_blocks(dim, block_rows), _BLOCK), "norm-blocks")
    groups = math.ceil(size["queries"] / query_rows)
    queries = materialise(ints.where(is_query).repartition(groups, F.xxhash64("vec_id")).select("vec_id", "v")
                          .mapInArrow(_blocks(dim, query_rows), _BLOCK)
                          .select(F.col("block").alias("q_block"), F.col("n").alias("q_n"),
                                  F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "query-blocks")
    run = _search(rotation, axes, k)
    longest = blocks.orderBy(F.desc("max_norm"), "block").select("block").first()["block"]

    q_blocks = [r["q_block"] for r in queries.select("q_block").collect()]
    keys = F.array(*[F.lit(b) for b in q_blocks])  # one number per QUERY_ROWS queries

    # thresholds from the block of the longest vectors
    first = blocks.where(F.col("block") == longest).withColumn("q_block", F.explode(keys))
    none = F.expr("unhex(repeat('000000000000F0FF', q_n))")  # -infinity as a little-endian double
    seeds = materialise(queries.withColumn("thresholds", none).join(first, "q_block")
                        .select("ids", "vectors", "q_ids", "q_vectors", "thresholds").mapInArrow(run, _BEST), "seeds")
    kth = _top(seeds, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))

    # every other block against every query block, dealt out over a grid
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with_floor = _attach_thresholds(queries, kth)
    cells = (blocks.where(F.col("block") != longest)
             .withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(spread)))
             .withColumn("q_block", F.explode(keys)))
    asked = with_floor.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>")))
    found = (cells.join(asked, ["q_block", "cell"]).select("ids", "vectors", "q_ids", "q_vectors", "thresholds")
             .mapInArrow(run, _BEST))
    best = _top(seeds.unionByName(found), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _attach_thresholds(queries: DataFrame, kth: DataFrame) -> DataFrame:
    """The query blocks with their queries' k-th best scores so far."""
    schema = pa.schema([("q_block", pa.int64()), ("query_id", pa.int64()), ("place", pa.int32())])

    def places(batches):
        for b in batches:
            for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(ids, np.int64)
                yield batch_of(schema, np.full(len(own), block), own, np.arange(len(own), dtype=np.int32))

    listed = queries.select("q_block", "q_ids").mapInArrow(places, "q_block bigint, query_id bigint, place int")
    # at most QUERY_ROWS numbers a block
    floors = (listed.join(kth, "query_id", "left")
              .groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("place", F.col("kth").cast("double").alias("kth")))).alias("f"))
              .select("q_block", F.transform("f", lambda s: F.coalesce(s["kth"], F.lit(float("-inf")))).alias("floors")))
    out = pa.schema([("q_block", pa.int64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("thresholds", pa.binary())])

    def as_bytes(batches):
        for b in batches:
            yield batch_of(out, *b.columns[:3], [np.array(x, np.float64).tobytes() for x in b.column(3).to_pylist()])

    return queries.join(floors, "q_block").select("q_block", "q_ids", "q_vectors", "floors").mapInArrow(
        as_bytes, "q_block bigint, q_ids binary, q_vectors binary, thresholds binary")
