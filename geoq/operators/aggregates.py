"""Aggregation operators (D-series) built from Spark aggregates and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_scalars(*aggs: DataFrame) -> DataFrame:
    """Put several one-row global aggregates side by side (scalar
    subqueries) without any join: the rows are padded with NULLs, unioned
    and collapsed with ``first(ignorenulls)``."""
    cols = [c for a in aggs for c in a.columns]
    types = {c: a.schema[c].dataType for a in aggs for c in a.columns}
    padded = [a.select(*[F.col(c) if c in a.columns else F.lit(None).cast(types[c]).alias(c) for c in cols])
              for a in aggs]
    u = reduce(lambda x, y: x.unionByName(y), padded)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def with_row_id(df: DataFrame, order_cols, name: str = "row_id", num_partitions: int | None = None) -> DataFrame:
    """Dense 1-based row numbers in a total order, without a
    single-partition window.  Rows are range-partitioned on the order
    columns and sorted within partitions; that layout is materialised once
    with a reliable checkpoint (range bounds come from random sampling, so
    recomputing the exchange could move rows between partitions).  Rows are
    counted per partition, and each row gets ``offset(partition) + position``
    through a join with that table of one row per partition.
    ``order_cols`` must form a unique key so that the ids are deterministic."""
    from geoq.session import cut_lineage
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols))
    ranged = (ranged.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # one row per partition: its rows, and those of the partitions before
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return ranged.join(offsets, "_pid").withColumn(name, F.col("_before") + local + 1).drop("_pid", "_mid", "_before")


#: Bins of a refining pass; values of a bin that are sorted in the end.
RANK_BINS, RANK_SORTED = 1024, 4096


def values_at_ranks(df: DataFrame, col: str, ranks) -> dict[int, object]:
    """Values at 0-based ranks of a number column in ascending order, nulls and
    NaN left out; ranks beyond the values are None.

    No full sort: a pass counts the values of every interval still open in
    ``RANK_BINS`` bins (an aggregate with partial sums, a bounded table) and
    keeps the bin that holds the rank, with its least and greatest value as the
    next interval.  An interval of one value is done, one of few values is
    sorted.  Passes narrow by the factor ``RANK_BINS``, whatever the values."""
    v = F.col(col)
    rows = df.select(v.alias("v")).where("v is not null and not isnan(v)")
    first = rows.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    found = {r: None for r in ranks if not 0 <= r < first["n"]}
    # interval -> ranks in it, as offsets: (lo, hi) -> (values before, values inside)
    open_ = {(first["lo"], first["hi"]): (0, first["n"], sorted({r for r in ranks if 0 <= r < first["n"]}))} if first["n"] else {}
    while open_:
        wide = {}
        for (lo, hi), (before, n, wanted) in open_.items():
            if lo == hi:
                found.update({r: lo for r in wanted})
            elif n <= RANK_SORTED:
                values = [r["v"] for r in rows.where(F.col("v").between(lo, hi)).sort("v").limit(n).collect()]
                found.update({r: values[r - before] for r in wanted})
            elif wanted:
                wide[lo, hi] = before, wanted
        if not wide:
            break
        spans = list(wide)

        def bin_of(lo, hi):
            # floor of a rising function: bins are intervals of the order
            share = (F.col("v").cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
            return F.least(F.floor(share * RANK_BINS), F.lit(RANK_BINS - 1))
        which = F.array_compact(F.array(*[F.when(F.col("v").between(lo, hi), F.struct(F.lit(k).alias("k"), bin_of(lo, hi).alias("bin")))
                                          for k, (lo, hi) in enumerate(spans)]))
        counts = (rows.select("v", F.explode(which).alias("w")).groupBy("w.k", "w.bin")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "bin").collect())
        open_ = {}
        for k, span in enumerate(spans):
            before, wanted = wide[span]
            for c in (c for c in counts if c["k"] == k):
                inside = [r for r in wanted if before <= r < before + c["n"]]
                if inside:
                    if (c["lo"], c["hi"]) == span:  # one bin holds all: neighbouring doubles, nothing left to divide
                        raise ValueError(f"cannot divide {span}")
                    open_[c["lo"], c["hi"]] = (before, c["n"], inside)
                before += c["n"]
    return found


def exact_quantiles(df: DataFrame, col: str, qs, order_key: str | None = None, prefix: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation (pandas ``quantile`` /
    ``quantile_cont``), one row; NULL without values.  The neighbouring ranks
    of each fraction come from ``values_at_ranks``."""
    n = df.where(F.col(col).isNotNull() & ~F.isnan(col)).count()
    at = [(q, (n - 1) * float(q)) for q in qs]
    got = values_at_ranks(df, col, {r for _, h in at for r in (int(h // 1), int(-(-h // 1)))}) if n else {}
    row = []
    for _, h in at:
        lo, hi = (got[int(h // 1)], got[int(-(-h // 1))]) if n else (None, None)
        row.append(None if lo is None else float(lo) + (float(hi) - float(lo)) * (h - int(h // 1)))
    names = [f"{prefix}{int(round(q * 100))}" for q in qs]
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{c} double" for c in names))


def smallest_rows(df: DataFrame, col: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows that come first by (col, tie), two number columns of
    which the second tells equal ones apart: a filter by the value at the last
    rank, and by the tie's value among the rows that share it."""
    if k <= 0:
        return df.limit(0)
    last = values_at_ranks(df, col, [k - 1])[k - 1]
    if last is None:
        return df.where(F.col(col).isNotNull())
    left = k - df.where(F.col(col) < F.lit(last)).count()
    same = df.where(F.col(col) == F.lit(last))
    cut = values_at_ranks(same, tie, [left - 1])[left - 1]
    return df.where((F.col(col) < F.lit(last)) | ((F.col(col) == F.lit(last)) & (F.col(tie) <= F.lit(cut))))


def histogram(df: DataFrame, col: str, bins: int, lo=None, hi=None) -> DataFrame:
    """Equal-width histogram, the maximum falls in the last bin (numpy
    semantics), empty bins reported with 0.  Values outside a given range,
    NULL and NaN are not counted; a constant column gets the range numpy gives
    it (half a unit on either side), an empty one the range 0 to 1.  Min/max
    come from one global aggregate (two numbers reach the driver); bin counts
    are a partial (map-side combined) aggregation."""
    spark = df.sparkSession
    if lo is None or hi is None:
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        lo, hi = r["lo"], r["hi"]
    lo, hi = (0.0, 1.0) if lo is None or hi is None else (float(lo), float(hi))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = F.lit(hi) - F.lit(lo)
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / width * bins), F.lit(bins - 1)).cast("bigint")
    inside = (F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi))
    counted = df.where(inside).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = spark.range(bins).select(F.col("id").alias("bin"))   # the bin axis itself (reindex)
    return (all_bins.join(counted, "bin", "left")
            .select("bin", F.round(F.lit(lo) + F.col("bin") * width / bins, 6).alias("bin_lo"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * width / bins, 6).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("count")))


def extent(df: DataFrame, bbox_col: str = "bbox", by=None) -> DataFrame:
    """Total bounds (min/max of the bbox fields), optionally per group."""
    b = F.col(bbox_col)
    aggs = [F.min(b.minx).alias("minx"), F.min(b.miny).alias("miny"),
            F.max(b.maxx).alias("maxx"), F.max(b.maxy).alias("maxy")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def percent_of_total(df: DataFrame, key: str, name: str = "pct") -> DataFrame:
    """Count per class and its share of the total, a scalar subquery."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn(name, F.round(F.col("n") * 100.0 / total, 6))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pairwise Pearson correlations in one aggregation, unpivoted."""
    aggs, names = [], []
    for a in cols:
        for b in cols:
            nm = f"{a}__{b}"
            names.append((a, b, nm))
            aggs.append((F.lit(1.0) if a == b else F.corr(a, b)).alias(nm))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{a}', '{b}', `{nm}`" for a, b, nm in names)
    return wide.selectExpr(f"stack({len(names)}, {stack}) as (var1, var2, corr)") \
        .withColumn("corr", F.round("corr", 6))


def runtime_stats(log: DataFrame, hot_only: bool = True) -> DataFrame:
    """Per (use case, technology, operation, dataset) the mean of the
    hot runs and the number of runs from a benchmark result log (columns
    ``use_case, technology, operation_description, test_dataset,
    execution_time_s, run``; run 0 is the cold run)."""
    keys = ["use_case", "technology", "operation_description", "test_dataset"]
    src = log.where(F.col("run") > 0) if hot_only and "run" in log.columns else log
    return src.groupBy(*keys).agg(F.avg("execution_time_s").alias("avg_execution_time_s"),
                                  F.count(F.lit(1)).alias("num_runs"))
