"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Each source gets a target of tokens (weights, with a cap of `most` times what it has and the excess reshared). Document
rates follow the exponential tilt exp(lambda * size / mean size), the entropy-balancing solution for a token constraint
per source, clipped at `most`; each lambda solves its source's convex dual by Newton steps on the logarithm of the
tokens taken, kept inside a bracket. A step is one distributed aggregation over the histogram (source, size, documents),
which holds all the sums need; hot sources are combined before the shuffle and only a scalar reaches the driver.

Rates become copies by error diffusion: documents of a source are dealt by hash into groups of about GROUP, ordered
from large to small, and each takes the whole number of copies that keeps the running total nearest to the running
target. So a group misses by about half its smallest documents, and reruns agree.

Rows: a null text has size 0, takes nothing and gets no copies; null is a source of its own, last in order. Sources
without tokens have target 0. Rows of equal doc_id, source and size are counted before they are dealt, take their copies
together and share them out evenly; each row is mixed. Extra columns are ignored by mix(); an empty table gives an empty table. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table, work_folder

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Documents in a rounding group, about.
GROUP = 256


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, n_docs, source_size) with no, weight and target: weights by order of sources, capped and reshared.

    The fixed point of capping and resharing is min(weight * level, cap) with one level. Sources ordered by the level at
    which their cap binds, the level is found where the rest of the total covers the rest of the weights. One row a
    source, so the window is as small as the list of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights) + 1).cast("int"))
    df = sources.withColumn("no", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", cycle)
    df = df.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("binds", F.col("cap") / F.col("weight"))
    before = Window.orderBy("binds", "no").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("binds", "no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(total).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    df = df.withColumn("level", left / F.sum("weight").over(rest))
    # the first source in that order whose cap is above the level of the rest sets the level for all from there on
    df = df.withColumn("found", F.min(F.when(F.col("level") <= F.col("binds"), F.struct("binds", "no", "level"))).over(total))
    return df.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("found.level"))).select("source", "no", "n_docs", "source_size", "weight", "target")


def _rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * size / mean, F.lit(50.0))))


def solve(histogram: DataFrame, goal: DataFrame, folder: str, most: float = 3.0, steps: int = 60, near: float = 1e-9) -> DataFrame:
    """(no, lam) for every source of goal (no, n_docs, source_size, target), from histogram (no, size, docs)."""
    live = goal.where("source_size > 0 and target > 0").withColumn("mean", F.col("source_size") / F.col("n_docs"))
    edge = F.col("mean") * F.log(F.col("target") / F.col("source_size"))
    # sizes are 1 at least, so the solution lies between 0 and the lambda at which documents of size 1 alone would do
    state = live.select("no", "target", "mean", F.least(F.lit(0.0), edge).alias("lo"), F.greatest(F.lit(0.0), edge).alias("hi"), (F.log(F.col("target") / F.col("source_size"))).alias("lam"), F.lit(1.0).alias("miss"))
    state = keep(state.withColumn("lam", F.greatest("lo", F.least("hi", "lam"))), folder, "dual-0")
    for k in range(1, steps + 1):
        rows = histogram.where("size > 0").join(state, "no")
        raw = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
        taken = F.col("docs") * F.col("size") * F.least(F.lit(float(most)), raw)
        slope = F.when(raw < most, F.col("docs") * F.col("size") * raw * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = rows.groupBy("no").agg(F.sum(taken).alias("f"), F.sum(slope).alias("g"))
        at = state.join(sums, "no")
        lo = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        at = at.withColumn("lo", lo).withColumn("hi", hi).withColumn("step", F.col("lam") - F.when(F.col("g") > 0, F.log(F.col("f") / F.col("target")) * F.col("f") / F.col("g")))
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        miss = F.abs(F.col("f") / F.col("target") - 1)
        lam = F.when(miss <= near, F.col("lam")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = keep(at.select("no", "target", "mean", "lo", "hi", lam.alias("lam"), miss.alias("miss")), folder, f"dual-{k}")
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= near:
            break
    # a source at its cap has all rates at the cap, whatever lambda
    return state.select("no", "lam")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies (0 to `most`) for every row of docs."""
    spark = docs.sparkSession
    folder = work_folder(spark)
    sizes = keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), folder, "sizes")
    histogram = sizes.groupBy("source", "size").agg(F.count("*").alias("docs"))
    sources = keep(sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), folder, "sources")
    goal = keep(targets(sources, weights, most), folder, "targets")
    numbered = histogram.join(goal.select("no", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("no", "size", "docs")
    lam = solve(keep(numbered, folder, "histogram"), goal, folder, most)
    plan = keep(goal.join(lam, "no", "left"), folder, "plan").withColumnRenamed("source", "s")
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    rate = F.when((F.col("size") == 0) | F.col("lam").isNull(), F.lit(0.0)).when(full, F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size"), F.col("source_size") / F.col("n_docs"), most))
    rows = rows.withColumn("rate", rate)
    group = F.pmod(F.xxhash64("doc_id", "size"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / GROUP)))
    rows = rows.withColumn("part", group)
    alike = rows.groupBy("no", "part", "doc_id", "size").agg(*(F.first(c).alias(c) for c in ("source", "source_size", "target", "rate")), F.count("*").alias("n"))
    item = F.struct((-F.col("size")).alias("minus"), "doc_id", "rate", "n")
    packed = alike.groupBy("no", "part").agg(F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.array_sort(F.collect_list(item)).alias("items"))
    fold = f"""aggregate(items, named_struct('goal', 0D, 'taken', 0L, 'out', cast(array() as array<bigint>)),
        (acc, x) -> named_struct('goal', acc.goal + x.rate * -x.minus * x.n, 'taken', acc.taken + {{copies}} * -x.minus, 'out', concat(acc.out, array({{copies}}))), acc -> acc.out)"""
    copies = f"cast(if(x.minus = 0, 0, greatest(0D, least({float(most)}D * x.n, round((acc.goal + x.rate * -x.minus * x.n - acc.taken) / -x.minus)))) as bigint)"
    packed = packed.withColumn("copies", F.expr(fold.format(copies=copies)))
    out = packed.select("source", "source_size", "target", F.explode(F.arrays_zip("items", "copies")).alias("x"))
    out = out.select(F.col("x.items.doc_id").alias("doc_id"), "source", (-F.col("x.items.minus")).alias("size"), "source_size", "target", F.col("x.items.rate").alias("rate"), F.col("x.items.n").alias("n"), F.col("x.copies").alias("copies"))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    own = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("nth") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", own.cast("int").alias("copies"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate")
