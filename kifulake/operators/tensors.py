"""Weight-table analytics over ``(name, idx, v)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import with_unit24
from . import dims
from .ordering import select_ranks


def weight_saturation(df: DataFrame, bound: float) -> DataFrame:
    """Per tensor: n, max, p99, p99.9 (floor rank) of abs(v), percent near and at the bound."""
    a = df.groupBy("name", F.abs("v").alias("a")).agg(F.count(F.lit(1)).alias("c"))
    ranks = select_ranks(
        a, "name", "a",
        {
            "p99": F.floor((F.col("n") - 1) * F.lit(0.99)),
            "p999": F.floor((F.col("n") - 1) * F.lit(0.999)),
        },
        count="c",
    )
    above = lambda limit: F.sum(F.when(F.col("a") >= limit, F.col("c")).otherwise(0)) * 100.0 / F.sum("c")
    shares = a.groupBy("name").agg(
        F.max("a").alias("max"), above(bound * 0.9).alias("near_pct"), above(bound - bound * 1e-5).alias("at_pct")
    )
    return ranks.join(shares, "name").select("name", "n", "max", "p99", "p999", "near_pct", "at_pct")


def quantise(v: Column, scale: float, low: int, high: int) -> Column:
    """Round half away from zero, then saturate."""
    return F.greatest(F.least(F.round(v * F.lit(scale)), F.lit(high)), F.lit(low)).cast("int")


def quantised_endpoint_stats(df: DataFrame, scale: float = 64.0) -> DataFrame:
    """How often 8-bit quantisation lands on its end points, per tensor."""
    q = df.select("name", quantise(F.col("v"), scale, -128, 127).alias("q"))
    out = q.groupBy("name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("q") == 127).alias("positive_127"),
        F.count_if(F.col("q") == -127).alias("negative_127"),
        F.count_if(F.col("q") == -128).alias("negative_128"),
    )
    pinned = F.col("positive_127") + F.col("negative_127")
    return out.withColumns(
        {
            "pinned_pct": pinned * 100.0 / F.col("total"),
            "saturated_pct": (pinned + F.col("negative_128")) * 100.0 / F.col("total"),
        }
    )


def tensor_diff(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """Element-wise comparison of two versions, per tensor.

    Elements missing on one side are a length mismatch: an error when ``strict``, else counted.
    """
    x = a.select("name", "idx", F.col("v").cast("double").alias("_a"))
    y = b.select("name", "idx", F.col("v").cast("double").alias("_b"))
    both = x.join(y, ["name", "idx"], "full_outer")
    d = F.abs(F.col("_a") - F.col("_b"))
    sums = both.groupBy("name").agg(
        F.count("_a").alias("n_a"),
        F.count("_b").alias("n_b"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_unmatched"),
        F.count_if(d > 1e-9).alias("_diff"),
        F.count(d).alias("_n"),
        F.max(d).alias("max_abs"),
        F.avg(d).alias("mean_abs"),
        F.avg(d * d).alias("_mse"),
        F.sum(F.col("_a") * F.col("_a")).alias("_aa"),
        F.sum(F.col("_b") * F.col("_b")).alias("_bb"),
        F.sum(F.col("_a") * F.col("_b")).alias("_ab"),
    )
    zero_a, zero_b = F.col("_aa") == 0, F.col("_bb") == 0
    cosine = F.when(zero_a & zero_b, 1.0).when(zero_a | zero_b, 0.0).otherwise(
        F.col("_ab") / (F.sqrt("_aa") * F.sqrt("_bb"))
    )
    n = F.col("_n")
    if strict:
        bad = F.raise_error(F.concat(F.lit("length mismatch in tensor "), F.col("name"))).cast("bigint")
        n = F.when(F.col("n_unmatched") > 0, bad).otherwise(n)
    return sums.select(
        "name", "n_a", "n_b", "n_unmatched",
        (F.col("_diff") * 100.0 / n).alias("diff_pct"),
        "max_abs", "mean_abs",
        F.sqrt("_mse").alias("rmse"),
        F.sqrt("_aa").alias("norm_a"),
        F.sqrt("_bb").alias("norm_b"),
        cosine.alias("cosine"),
    )


def edge_row_norms(df: DataFrame, ft_out: int) -> DataFrame:
    """Sum of squares per edge feature row from a flat ``[row, out]`` tensor (pre-aggregates)."""
    return df.groupBy(F.expr(f"idx div {ft_out}").alias("row")).agg(F.sum(F.col("v") * F.col("v")).alias("ss"))


def profile_rows(spark: SparkSession, profile: str) -> int:
    return sum(r["width"] for r in dims.pair_list(spark, profile))


def _axis(name: str, key: Column) -> Column:
    return F.struct(F.lit(name).alias("axis"), key.alias("key"))


def pair_norm_breakdown(df: DataFrame, ft_out: int, profile: str) -> DataFrame:
    """Sum of squares by attacker class, attack/defense, slider/step and same/cross class.

    Feature rows are summed first, then find their pair by bisection in the row, then are folded
    along all four axes at once. A tensor with rows outside the profile is an error.
    """
    spark = df.sparkSession
    rows = dims.with_pair(edge_row_norms(df, ft_out), profile)
    names = F.array(*[F.lit(n) for n in dims.CLASS_NAMES])
    ac, dc = F.col("ac"), F.col("dc")
    axes = F.array(
        _axis("total", F.lit("all")),
        _axis("class", F.get(names, ac)),
        _axis("side", F.when(F.col("attacker_side") == F.col("attacked_side"), "defense").otherwise("attack")),
        _axis("reach", F.when(ac.isin(*dims.SLIDER_CLASSES), "slider").otherwise("step")),
        _axis("pair", F.when(ac == dc, "same-class").otherwise("cross-class")),
    )
    sums = rows.select("ss", F.explode(axes).alias("x")).groupBy("x.axis", "x.key").agg(F.sum("ss").alias("l2sq"))
    widths = dims.pair_ranges(spark, profile)
    sizes = widths.groupBy(F.get(names, F.col("ac")).alias("key")).agg(F.sum("width").cast("bigint").alias("dims"))
    sizes = sizes.withColumn("axis", F.lit("class"))
    joined = sums.join(F.broadcast(sizes), ["axis", "key"], "left")  # nine classes
    return joined.withColumn("per_dim", F.col("l2sq") / F.greatest(F.col("dims"), F.lit(1)))


# Named ablation specs.
ABLATIONS = ("all", "slider-attacker", "step-attacker", "bigslider-attacker", "defense", "attack", "same-class")


def ablation_predicate(spec: str) -> Column:
    ac = F.col("ac")
    table = {
        "all": F.lit(True),
        "slider-attacker": ac.isin(*dims.SLIDER_CLASSES),
        "step-attacker": ~ac.isin(*dims.SLIDER_CLASSES),
        "bigslider-attacker": ac.isin(*dims.BIG_SLIDER_CLASSES),
        "defense": F.col("attacker_side") == F.col("attacked_side"),
        "attack": F.col("attacker_side") != F.col("attacked_side"),
        "same-class": ac == F.col("dc"),
    }
    if spec not in table:
        raise ValueError(f"unknown ablation spec {spec!r}")
    return table[spec]


def with_random_rows(rows: DataFrame, n_rows: int, seed: int, k: int, out: str) -> DataFrame:
    """Add ``out``: whether ``row`` is among the ``k`` of ``n_rows`` feature rows that rank first by a seeded hash.

    The last of them is found once; a row then compares its own draw with it, so nothing is joined.
    """
    if k < 1:
        return rows.withColumn(out, F.lit(False))
    spark = rows.sparkSession
    drawn = with_unit24(spark.range(n_rows).withColumnRenamed("id", "row"), "row", seed)
    last = drawn.orderBy("u24", "row").limit(k).agg(F.max(F.struct("u24", "row")).alias("m")).first()["m"]
    mine = with_unit24(rows, "row", seed, out="_u24")
    first = (F.col("_u24") < last["u24"]) | ((F.col("_u24") == last["u24"]) & (F.col("row") <= last["row"]))
    return mine.withColumn(out, first).drop("_u24")


def ablate_rows(df: DataFrame, ft_out: int, profile: str, spec: str) -> DataFrame:
    """The tensor with the rows of ``spec`` zeroed; ``zeroed`` tells which.

    ``spec`` is one of :data:`ABLATIONS` or ``random:<seed>:<rows>``.
    """
    rows = dims.with_pair(df.withColumn("row", F.expr(f"idx div {ft_out}")), profile)
    if spec.startswith("random:"):
        _, seed, k = spec.split(":")
        n_rows = profile_rows(df.sparkSession, profile)
        out = with_random_rows(rows, n_rows, int(seed), min(int(k), n_rows), "zeroed")
    else:
        out = rows.withColumn("zeroed", ablation_predicate(spec))
    return out.drop(*dims.PAIR_KEY).withColumn("v", F.when(F.col("zeroed"), 0.0).otherwise(F.col("v")))


def ablation_report(df: DataFrame, ft_out: int, profile: str) -> DataFrame:
    """Per named spec: the feature rows (``dims``) and ``pairs`` it zeroes, and how many values and what
    sum of squares the tensor holds there.

    Values meet per feature row, then per pair (at most 324), before any spec is asked.
    """
    spark = df.sparkSession
    values = df.groupBy(F.expr(f"idx div {ft_out}").alias("row")).agg(F.sum(F.col("v") * F.col("v")).alias("ss"), F.count("v").alias("n"))
    key = list(dims.PAIR_KEY)
    held = dims.with_pair(values, profile).groupBy(*key).agg(F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    pairs = dims.pair_ranges(spark, profile).select(*key, "width").join(held, key, "left")
    specs = F.array(*[F.struct(F.lit(s).alias("spec"), ablation_predicate(s).alias("hit")) for s in ABLATIONS])
    zero = F.lit(0)
    return (
        pairs.select("width", "n", "ss", F.explode(specs).alias("s"))
        .where("s.hit")
        .groupBy("s.spec")
        .agg(
            F.sum("width").cast("bigint").alias("dims"), F.count(F.lit(1)).alias("pairs"),
            F.coalesce(F.sum("n"), zero).alias("n_values"), F.coalesce(F.sum("ss"), zero.cast("double")).alias("l2sq"),
        )
    )


def group_norm_correction(df: DataFrame, group: Column, lr: float, factor: float, eps: float = 1e-8) -> DataFrame:
    """Pull each weight group's L2 norm toward one: ``v * (1 - lr * 2 f (1 - 1/(norm + eps)))``.

    Group norms are one row per output neuron; the optimiser broadcasts them when their
    measured size allows and otherwise joins with skew handling.
    """
    rows = df.withColumn("_g", group)
    norms = rows.groupBy("_g").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    out = rows.join(norms, "_g")
    pull = F.lit(2.0 * factor) * (F.lit(1.0) - F.lit(1.0) / (F.col("norm") + F.lit(eps)))
    return out.withColumn("v", F.col("v") * (F.lit(1.0) - F.lit(lr) * pull)).drop("_g")


def virtual_row(feature: Column, piece_inputs: int, n_buckets: int = 1, mode: str = "base") -> Column:
    """The shared row of a real feature row: by piece, pooled over buckets, or per bucket."""
    f = feature.cast("bigint")
    if mode == "base":
        return f % piece_inputs
    plain = F.floor(f / n_buckets) % piece_inputs
    if mode == "pool":
        return plain
    if mode == "per-bucket":
        return plain * n_buckets + f % n_buckets
    raise ValueError(f"unknown sharing mode {mode!r}")


def shared_row_reduce(grads: DataFrame, vrow: Column) -> DataFrame:
    """Sum of gradients per virtual row and output column (``feature, out, g``)."""
    return grads.groupBy(vrow.alias("vrow"), "out").agg(F.sum("g").alias("g"))


def shared_row_fold(weights: DataFrame, virtual: DataFrame, vrow: Column) -> DataFrame:
    """Effective weight = real weight + its virtual row's (``feature, out, v`` and ``vrow, out, vv``).

    Virtual rows are as many as piece inputs times outputs; a missing one adds nothing.
    """
    joined = weights.withColumn("vrow", vrow).join(virtual, ["vrow", "out"], "left")
    return joined.withColumn("v", F.col("v") + F.coalesce("vv", F.lit(0.0))).drop("vv")
