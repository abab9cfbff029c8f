"""Run-metrics analytics: the table every experiment run appends to.

Schema: run_id long, algorithm string, matrix_size long, density double,
wall_cs long (centiseconds), stage_count long, status string.  Failed runs
keep NULL-free rows with a status, so analyses filter on status first.

``runs_view`` derives a stand-in run table from ``events`` so the analytics
scale with the provided data; real runs come from ``bench.py`` records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import materialize

# Algorithm names, size grid and density grid of the experiments.
ALGORITHMS = ["coo", "coo_broadcast", "block", "block_broadcast", "rows_broadcast", "auto"]
SIZES = [1000, 3000, 5000]
DENSITIES = [0.01, 0.1, 1.0]
# Fixed value: block size rule of the experiment grid (500 for the smallest size).
SMALL_BLOCK, LARGE_BLOCK = 500, 1000


def runs_view(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    alg = F.element_at(F.array(*[F.lit(a) for a in ALGORITHMS]), (F.pmod(uid, F.lit(6)) + 1).cast("int"))
    size = (F.when(F.pmod(eid, F.lit(9)) < 3, F.lit(SIZES[0]))
             .when(F.pmod(eid, F.lit(9)) < 6, F.lit(SIZES[1])).otherwise(F.lit(SIZES[2])))
    dens = F.element_at(F.array(*[F.lit(d) for d in DENSITIES]), (F.pmod(eid, F.lit(3)) + 1).cast("int"))
    return events.select(
        eid.alias("run_id"), alg.alias("algorithm"), size.cast("bigint").alias("matrix_size"),
        dens.cast("double").alias("density"),
        F.round(F.col("value") * 100).cast("bigint").alias("wall_cs"),
        (F.lit(2) + F.pmod(eid, F.lit(4))).cast("bigint").alias("stage_count"),
        F.when(F.col("event_type") == "error", "Failed").otherwise("Success").alias("status"),
        F.col("props"))


def success(runs: DataFrame) -> DataFrame:
    """successful runs only."""
    return runs.where(F.col("status") == "Success")


def slice_eq(runs: DataFrame, **eq) -> DataFrame:
    """equality slice, e.g. ``slice_eq(runs, density=0.1)``."""
    cond: Column = F.lit(True)
    for k, v in eq.items():
        cond = cond & (F.col(k) == F.lit(v))
    return runs.where(cond)


def mean_by_size(runs: DataFrame) -> DataFrame:
    """A9: mean wall time per matrix size (successful runs)."""
    m = F.avg("wall_cs")
    return (success(runs).groupBy("matrix_size")
            .agg(m.alias("mean_wall_cs"), (m / 100).alias("mean_wall_s"), F.count(F.lit(1)).alias("runs")))


def stage_histogram(runs: DataFrame) -> DataFrame:
    """A10: number of runs per distinct stage count."""
    return success(runs).groupBy("stage_count").agg(F.count(F.lit(1)).alias("runs"))


def distinct_axes(runs: DataFrame) -> DataFrame:
    """A11: distinct sizes and densities, one (axis, value) row each, sorted."""
    s = runs.select(F.lit("matrix_size").alias("axis"), F.col("matrix_size").cast("double").alias("value"))
    d = runs.select(F.lit("density").alias("axis"), F.col("density").alias("value"))
    return s.unionByName(d).distinct().orderBy("axis", "value")


def first_per_group(runs: DataFrame) -> DataFrame:
    """A12: the first run's wall time per (algorithm, density, size) — first by run_id."""
    return (success(runs).groupBy("algorithm", "density", "matrix_size")
            .agg(F.min_by("wall_cs", "run_id").alias("first_wall_cs"), F.min("run_id").alias("first_run")))


def pivot_size_density(runs: DataFrame) -> DataFrame:
    """A13: first wall time of every size x density of an algorithm, in long
    form, missing points 0.  The densities are those the runs have."""
    first = (success(runs).groupBy("algorithm", "matrix_size", "density")
             .agg(F.min_by("wall_cs", "run_id").alias("w")))
    # The axis of a grid is short: one entry per density that was run.
    axis = sorted(r.density for r in first.select("density").distinct().collect())
    held = (first.groupBy("algorithm", "matrix_size")
            .agg(F.map_from_entries(F.collect_list(F.struct("density", "w"))).alias("by")))
    grid = held.select("algorithm", "matrix_size", F.explode(F.lit(axis).cast("array<double>")).alias("density"), "by")
    return grid.select("algorithm", "matrix_size", "density",
                       F.coalesce(F.element_at("by", F.col("density")), F.lit(0).cast("bigint")).alias("first_wall_cs"))


def consecutive_delta(runs: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """E6: change of each run's metrics against the run logged just before it,
    whatever gaps run_id has.

    Runs are dealt into ranges of run_id between approximate quantiles, which
    Spark's range partitioning samples, so a lone id far away does not empty
    them; a lag inside each range and the ranges' last runs, one row a range,
    give every run its predecessor, so no task sees more than its range.  The
    ranges are written once, so that both uses see the same ones."""
    cols = ["run_id", "wall_cs", "stage_count"]
    r = runs.select(*cols)
    parts = max(1, -(-r.count() // rows_per_task))
    r = materialize(r.repartitionByRange(parts, "run_id").withColumn("_part", F.spark_partition_id()), "run-ranges")
    last = r.groupBy("_part").agg(F.max(F.struct(*cols)).alias("l"))
    before = last.select("_part", F.lag("l").over(Window.orderBy("_part")).alias("_before"))
    w = Window.partitionBy("_part").orderBy("run_id")
    own = r.withColumn("_own", F.lag(F.struct(*cols)).over(w)).join(before, "_part")
    p = F.coalesce("_own", "_before")
    return own.select("run_id", (F.col("wall_cs") - p["wall_cs"]).alias("delta_wall_cs"),
                      (F.col("stage_count") - p["stage_count"]).alias("delta_stages"),
                      ((F.col("wall_cs") - p["wall_cs"]) / 100).alias("delta_wall_s"))


def mode_ratio(runs: DataFrame, slow: str = "coo", fast: str = "auto",
               verdict_above: float = 5.0) -> DataFrame:
    """E7: mean wall of one algorithm over another per grid point; NULL when the
    divisor is zero or missing; verdict when the ratio exceeds the limit."""
    ok = success(runs)
    ms = F.avg(F.when(F.col("algorithm") == slow, F.col("wall_cs")))
    mf = F.avg(F.when(F.col("algorithm") == fast, F.col("wall_cs")))
    g = ok.groupBy("matrix_size", "density").agg(ms.alias("slow_cs"), mf.alias("fast_cs"))
    ratio = F.try_divide(F.col("slow_cs"), F.when(F.col("fast_cs") != 0, F.col("fast_cs")))
    return g.select("matrix_size", "density", ratio.alias("ratio"),
                    F.coalesce(ratio > F.lit(verdict_above), F.lit(False)).alias("fast_wins"))


def labels(runs: DataFrame) -> DataFrame:
    """E8: experiment label, seconds rounded to tenths, mean seconds per stage
    and the 50-character error note."""
    pct = F.floor(F.col("density") * 100).cast("int")
    label = F.concat(F.col("algorithm"), F.lit("_Exp_"), F.col("matrix_size").cast("string"), F.lit("x"),
                     F.col("matrix_size").cast("string"), F.lit("_D"), pct.cast("string"))
    note = F.when(F.col("status") == "Success", F.lit("Success")).otherwise(
        F.concat(F.lit("Failed: "), F.substring("props", 1, 50), F.lit("...")))
    return runs.select("run_id", label.alias("label"), (F.floor((F.col("wall_cs") + 5) / 10) / 10).alias("wall_s"),
                       (F.floor(F.col("wall_cs") / F.col("stage_count") + 0.5) / 100).alias("stage_mean_s"),
                       note.alias("note"))


def sorted_runs(runs: DataFrame) -> DataFrame:
    """O1: runs ordered by matrix size (then run id)."""
    return runs.orderBy("matrix_size", "run_id")


def experiment_grid(runs: DataFrame) -> DataFrame:
    """S8: the (size, density) points present, their block size and requested nnz."""
    g = runs.groupBy("matrix_size", "density").agg(F.count(F.lit(1)).alias("runs"))
    bs = F.when(F.col("matrix_size") <= SIZES[0], SMALL_BLOCK).otherwise(LARGE_BLOCK)
    nnz = F.floor(F.col("matrix_size") * F.col("matrix_size") * F.col("density")).cast("bigint")
    return g.select("matrix_size", "density", bs.alias("block_size"), nnz.alias("requested_nnz"), "runs")
