"""Threshold products: the cells of A·Bᵀ with |v| > eps, without the others.

``matmul_abt(..., eps)`` sums every cell and then filters.  Here rows that cannot
pass are never multiplied:

1. Columns have one order, by the pairs they would make, rare ones first, kept
   as at most LEVELS levels.  The tail of a row is its largest run of last
   levels whose norm times the largest norm of the other side is at most eps.
   Two rows that share no column before the tail of either cannot pass
   (Cauchy-Schwarz), so only the cells before the tails meet.  Frequent columns,
   which make most pairs, go first into the tails.
2. What two rows share there is their partial sum, made in the task of one of
   them (:func:`_sums`).  The rest of their product
   is at most the norm of one's tail times the norm of the other; pairs whose
   sum cannot pass with it are dropped.
3. The pairs left multiply the levels not yet counted, and the complete sums
   are compared with eps.

Whole numbers give the same cells as filtering the product.  With doubles the
bounds leave room for rounding (SLACK), and a cell may differ from the filtered
product only where the order of a sum decides.  NaN counts as larger than
every number, as in Spark's comparisons; null values add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans import guard, skew
from tessera.plans.partitions import COO_ROW_BYTES, pinned_partitions
from tessera.sources.files import materialize

SLACK = 1e-9
# Columns of about the same number of pairs (half a power of two) share OF levels, dealt by a hash.
OF = 16
LEVELS = 127 * OF
# Cells of a list that travels to a row's task.
LIST = 1024
# Pairs of cells that one task multiplies.
PAIRS = 2_000_000


def _rows(df: DataFrame, row: str, value: str) -> DataFrame:
    return df.select(F.col("i").alias(row), F.col("j").alias("k"), F.col("v").alias(value)).where(F.col("v").isNotNull())


def _levels(left: DataFrame, right: DataFrame) -> DataFrame:
    """(k, lv) of each shared column: its place in the common order."""
    kp = skew.key_pairs(left, right, "k")
    half = F.floor(2 * F.log2(F.col("pairs").cast("double"))).cast("int")
    return kp.where("pairs > 0").select("k", (half * OF + F.pmod(F.xxhash64("k"), F.lit(OF)).cast("int")).alias("lv"))


def _square(value: str) -> Column:
    return F.col(value).cast("double") * F.col(value).cast("double")


def _cuts(cells: DataFrame, row: str, value: str, other_norm: float, eps: float) -> DataFrame:
    """(row, cut, tail, norm): the row's first level of the tail (LEVELS, if
    none), the tail's norm and the row's.  A window holds a row's levels, at
    most LEVELS of them, however many cells the row has."""
    per = cells.groupBy(row, "lv").agg(F.sum(_square(value)).alias("q"))
    w = W.partitionBy(row).orderBy(F.col("lv").desc()).rowsBetween(W.unboundedPreceding, 0)
    after = per.withColumn("tq", F.sum("q").over(w))
    # Squares are not negative, so the levels that fit are the last ones.
    fits = F.sqrt("tq") * (other_norm * (1 + SLACK)) <= F.lit(float(eps))
    return after.groupBy(row).agg(
        F.coalesce(F.min(F.when(fits, F.col("lv"))), F.lit(LEVELS)).alias("cut"),
        F.sqrt(F.coalesce(F.max(F.when(fits, F.col("tq"))), F.lit(0.0))).alias("tail"),
        F.sqrt(F.max("tq")).alias("norm"))


def _largest_norm(cells: DataFrame, row: str, value: str) -> float:
    r = cells.groupBy(row).agg(F.sum(_square(value)).alias("q")).agg(F.sqrt(F.max("q")).alias("n")).first()
    return float(r.n) if r.n is not None else 0.0


def _with_levels(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Columns that only one side has make no pair and count in no norm."""
    return materialize(cells.join(levels, "k"), "leveled")


def _with_cuts(cells: DataFrame, row: str, value: str, other_norm: float, eps: float, p: str) -> DataFrame:
    c = _cuts(cells, row, value, other_norm, eps)
    named = c.select(row, *[F.col(x).alias(f"{p}_{x}") for x in ("cut", "tail", "norm")])
    return materialize(cells.join(named, row), "cuts")


def sides(a: DataFrame, b: DataFrame | None, eps: float) -> tuple[DataFrame, DataFrame]:
    """Both sides (``b=None``: A is both) with the level of each cell's column
    and the row's cut, tail and norm, written once: ``(i, k, av, lv, a_cut,
    a_tail, a_norm)`` and ``(j, k, bv, lv, b_cut, b_tail, b_norm)``."""
    left = _rows(a, "i", "av")
    right = _rows(a if b is None else b, "j", "bv")
    levels = materialize(_levels(left, right), "levels")
    left = _with_levels(left, levels)
    na = _largest_norm(left, "i", "av")
    if b is None:
        left = _with_cuts(left, "i", "av", na, eps, "a")
        return left, left.select(F.col("i").alias("j"), "k", F.col("av").alias("bv"), "lv",
                                 *[F.col(f"a_{x}").alias(f"b_{x}") for x in ("cut", "tail", "norm")])
    right = _with_levels(right, levels)
    nb = _largest_norm(right, "j", "bv")
    return _with_cuts(left, "i", "av", nb, eps, "a"), _with_cuts(right, "j", "bv", na, eps, "b")


def heads(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells before the tails: all that meet in the first product."""
    x = left.where("lv < a_cut").select("i", "k", "av", "a_cut", "a_tail", "a_norm")
    y = right.where("lv < b_cut").select("j", "k", "bv", "b_cut", "b_tail", "b_norm")
    return x, y


def _narrow(y: DataFrame) -> tuple[str, str]:
    """Smallest types that hold every j and bv of ``y`` exactly."""
    kinds = {c: y.schema[c].dataType.simpleString() for c in ("j", "bv")}
    size = F.abs(F.col("bv").cast("double"))
    r = y.agg(F.max(F.abs("j")).alias("j"), F.max(size).alias("v"), F.max(size != F.rint(size)).alias("part")).first()
    if r.j is not None and r.j < 1 << 31:
        kinds["j"] = "int"
    # NaN and infinities are larger than any bound.
    if kinds["bv"] in ("bigint", "double") and r.v is not None and not r.part and r.v < 1 << 31:
        kinds["bv"] = "smallint" if r.v < 1 << 15 else "int"
    return kinds["j"], kinds["bv"]


def _lists(y: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, js, bvs): the cells of a key as lists of at most LIST of them,
    by ascending j."""
    jtype, vtype = _narrow(y)
    place = F.row_number().over(W.partitionBy(*keys).orderBy("j")) - 1
    cell = F.struct(F.col("j").cast(jtype).alias("j"), F.col("bv").cast(vtype).alias("bv"))
    per = (y.select(*keys, "j", "bv").withColumn("part", F.floor(place / LIST))
           .groupBy(*keys, "part").agg(F.sort_array(F.collect_list(cell)).alias("cells")))
    return per.select(*keys, F.col("cells.j").alias("js"), F.col("cells.bv").alias("bvs"))


def _sums(x: DataFrame, y: DataFrame, upper: bool) -> DataFrame:
    """(i, j, v): the sums of all pairs of cells that meet.

    Each cell of ``x`` takes the lists of its column to the task of its row,
    where the row's products are made and summed: what is shuffled is a list's
    few bytes a pair, and no partial sum.  Tasks are as many as the pairs need;
    a row with more than PAIRS of them is dealt to several by j."""
    kp = materialize(skew.key_pairs(x, y, "k"), "pairs")
    zero = F.lit(0).cast("bigint")
    r = kp.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("pairs", "ca", "cb")]).first()
    spark = x.sparkSession
    parts = max(pinned_partitions(spark), -(-r.pairs // PAIRS))
    few = pinned_partitions(spark, (r.ca + r.cb) * COO_ROW_BYTES)
    per_row = x.join(kp, "k").groupBy("i").agg(F.sum("cb").alias("n")).where(F.col("n") > PAIRS)
    # At most pairs / PAIRS rows.
    split = per_row.select("i", F.ceil(F.col("n") / PAIRS).cast("int").alias("of"))
    vtype = y.schema["bv"].dataType
    left, right, keys = skew.salt_join(x.select("i", "k", "av"), y.select("j", "k", "bv"), "k", ["i"], ["j"])
    if keys == ["k"]:
        left, right = left.repartition(few, "k"), right.repartition(few, "k")
    met = left.join(_lists(right, keys).hint("merge"), keys).join(F.broadcast(split), "i", "left")
    if upper:
        # js ascend: from the first j >= i on.
        skip = F.size(F.filter("js", lambda j: j < F.col("i")))
        met = met.withColumns({c: F.slice(c, skip + 1, F.size("js")) for c in ("js", "bvs")}).where(F.size("js") > 0)
    met = met.withColumn("t", F.explode(F.when(F.col("of").isNull(), F.array(F.lit(0)))
                                        .otherwise(F.sequence(F.lit(0), F.col("of") - 1))))
    dealt = met.select("i", "av", "js", "bvs", "of", "t").repartition(parts, "i", "t")
    pair = dealt.select("i", "av", "bvs", "of", "t", F.posexplode("js").alias("at", "j"))
    pair = pair.where(F.col("of").isNull() | (F.pmod(F.xxhash64("j"), F.col("of")) == F.col("t")))
    bv = F.get(F.col("bvs"), F.col("at")).cast(vtype)
    return (pair.select("i", "t", F.col("j").cast("bigint").alias("j"), (F.col("av") * bv).alias("p"))
            .groupBy("i", "t", "j").agg(F.sum("p").alias("v")).drop("t"))


def candidates(left: DataFrame, right: DataFrame, eps: float, upper: bool = False) -> DataFrame:
    """(i, j, v, cut): pairs that may pass, with their sum over the levels
    before ``cut``.  ``upper`` keeps i <= j only."""
    x, y = heads(left, right)
    rows = x.groupBy("i").agg(*[F.max(f"a_{c}").alias(f"a_{c}") for c in ("cut", "tail", "norm")])
    cols = y.groupBy("j").agg(*[F.max(f"b_{c}").alias(f"b_{c}") for c in ("cut", "tail", "norm")])
    cols = materialize(cols, "rows")
    sums = _sums(x, y, upper).join(materialize(rows, "rows"), "i").join(guard.checked_broadcast(cols)[0], "j")
    # What is left begins at the smaller cut: a tail there, at most the whole row on the other side.
    rest = (F.when(F.col("a_cut") < F.col("b_cut"), F.col("a_tail") * F.col("b_norm"))
            .when(F.col("a_cut") > F.col("b_cut"), F.col("a_norm") * F.col("b_tail"))
            .otherwise(F.col("a_tail") * F.col("b_tail")))
    bound = rest * (1 + SLACK) + F.col("a_norm") * F.col("b_norm") * SLACK
    return sums.where(F.abs("v") + bound > F.lit(float(eps))).select("i", "j", "v", F.least("a_cut", "b_cut").alias("cut"))


def rest_products(left: DataFrame, right: DataFrame, found: DataFrame) -> DataFrame:
    """(i, j, v) of the candidates' cells from their cut on.  Rows with very
    many candidates or cells are split like any hot key."""
    found = found.where(F.col("cut") < LEVELS)        # the others have no tail
    c, x, keys = skew.salt_join(found.select("i", "j", "cut"), left.select("i", "k", "av", "lv"), "i", ["j"], ["k"])
    wanted = c.join(x, keys).where("lv >= cut").select("i", "j", "k", "av")
    return (wanted.join(right.select("j", "k", "bv"), ["j", "k"])
            .select("i", "j", (F.col("av") * F.col("bv")).alias("v")))


def _above(a: DataFrame, b: DataFrame | None, eps: float) -> DataFrame:
    if not eps >= 0:
        raise ValueError("eps must be 0 or more")
    left, right = sides(a, b, eps)
    found = materialize(candidates(left, right, eps, upper=b is None), "candidates")
    rest = rest_products(left, right, found)
    done = found.select("i", "j", "v").unionByName(rest).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return done.where(F.abs("v") > F.lit(eps))


def matmul_abt_above(a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    """Cells of A·Bᵀ with |v| > eps >= 0; coordinates are stored once each."""
    return _above(a, b, eps)


def gram_above(a: DataFrame, eps: float) -> DataFrame:
    """Cells of A·Aᵀ with |v| > eps >= 0: pairs with i <= j are compared, the
    others are their mirror."""
    half = _above(a, None, eps)
    me = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("v").alias("v"))
    mirror = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("v"))
    both = F.when(F.col("i") < F.col("j"), F.array(me, mirror)).otherwise(F.array(me))
    return half.select(F.explode(both).alias("c")).select("c.i", "c.j", "c.v")
