"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. The rates of its documents are the
ones closest to 1 in (two-sided) entropy that meet the target, at most
``cap`` each: ``rate = cap / (1 + (cap - 1) exp(-lambda size))``, an exponential tilt
by size. The convex dual has one multiplier per source; distributed Newton
steps, kept inside a bracket, solve all of them at once over a histogram of
(source, size). Rates are then rounded to whole copies by a hash of the id, and
what rounding left over is settled by a few documents of each source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axiomata.llm.scratch import Scratch

WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    """The whitespace-separated words of a whole text; null: 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size) of each row."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): weights in code-point order of the sources, null last, repeating.

    A target stops at ``cap`` times its source's size and the excess is
    reshared by weight until none is above; that is one water level, found
    with prefix sums over the sources (a small table: one row for each).
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1)
    full = Window.partitionBy(F.lit(0))
    x = total.withColumn("weight", w).withColumn("most", cap * F.col("source_size")).withColumn("all", share * F.sum("source_size").over(full))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.col("level") <= F.col("most") / F.col("weight")
    x = x.withColumn("water", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("most") / F.col("weight"))).over(full))
    return x.select("source", "source_size", F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most"))).alias("target"))


def _rate(x, lam, cap: float):
    return cap / (1.0 + (cap - 1.0) * F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), lam * x))))


def multipliers(hist: DataFrame, goal: DataFrame, scratch: Scratch, cap: float = 2.0, tolerance: float = 1e-5, rounds: int = 80) -> DataFrame:
    """(source, mean, lam) for every source whose target is positive and below its cap.

    Newton steps for all sources at once; a step that leaves its bracket is
    replaced by the bracket's middle, so every source settles. Raises RuntimeError if ``rounds`` do not suffice.
    """
    open_ = goal.filter("target > 0").filter(F.col("target") < cap * F.col("source_size") * (1 - 1e-9))
    n = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = open_.join(n, open_["source"].eqNullSafe(n["source"])).select(open_["source"], "target", "mean", F.lit(0.0).alias("lam"), F.lit(-64.0).alias("lo"), F.lit(64.0).alias("hi"), F.lit(1.0).alias("off"))
    state = scratch.keep(state, "dual")
    for _ in range(rounds):
        h, s = hist.alias("h"), state.alias("s")
        x = F.col("size") / F.col("mean")
        r = _rate(x, F.col("lam"), cap)
        sums = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source").alias("of"))
        sums = sums.agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * x * r * (1 - r / cap)).alias("slope"))
        nxt = state.join(sums, state["source"].eqNullSafe(sums["of"]))
        over = F.col("got") > F.col("target")
        off = F.abs(F.col("got") / F.col("target") - 1)
        nxt = nxt.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam"))).withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") + (F.col("target") - F.col("got")) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        moved = F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        nxt = nxt.select("source", "target", "mean", F.when(off <= tolerance, F.col("lam")).otherwise(moved).alias("lam"), "lo", "hi", off.alias("off"))
        state = scratch.keep(nxt, "dual", (state,))
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"the mix did not settle: a source is off its target by {worst:.2%}")
    return state.select("source", "mean", F.round("lam", 9).alias("lam"))


@dataclass(frozen=True)
class Mix:
    """``plan``: (of, source_size, target, mean, lam) for each source; ``changes``: (of, step, changed), a bounded number for each source."""

    plan: DataFrame
    changes: DataFrame
    cap: int

    def apply(self, rows: DataFrame, id_: str, source: str, size: str) -> DataFrame:
        """``rows`` with source_size, target, copies and taken; narrow but for the joins with the two small tables."""
        got = _rounded(rows, self.plan, self.cap, id_, source, size)
        c = self.changes.withColumnRenamed("of", "__of")
        out = got.join(c, (F.col(id_) == F.col("changed")) & F.col(source).eqNullSafe(F.col("__of")), "left")
        final = F.least(F.lit(self.cap), F.greatest(F.lit(0), F.col("copies") + F.coalesce("step", F.lit(0))))
        final = F.when(F.col(size) > 0, final).otherwise(F.lit(0)).cast("int")
        return out.withColumn("copies", final).withColumn("taken", (F.col("copies") * F.col(size)).cast("long")).drop("__of", "step", "changed")


def _rounded(rows: DataFrame, plan: DataFrame, cap: int, id_: str, source: str, size: str) -> DataFrame:
    """``rows`` with source_size, target and the copies that the hash of the id gives."""
    x = F.col(size) / F.col("mean")
    rate = F.when(F.col("lam").isNotNull(), _rate(x, F.col("lam"), cap)).when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col(id_).cast("string"), F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    copies = F.when(F.col(size) > 0, F.least(F.lit(cap), F.floor(rate + draw))).otherwise(F.lit(0)).cast("int")
    return rows.join(plan, F.col(source).eqNullSafe(F.col("of"))).withColumn("copies", copies).drop("of", "mean", "lam")


def fit(spark: SparkSession, base: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> Mix:
    """The plan and the changes for rows (id, source, size)."""
    goal = scratch.keep(targets(base, weights, share, cap), "targets")
    hist = scratch.keep(base.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    dual = multipliers(hist, goal, scratch, cap)
    g, d = goal.alias("g"), dual.alias("d")
    plan = g.join(d, F.col("g.source").eqNullSafe(F.col("d.source")), "left").select(F.col("g.source").alias("of"), "source_size", "target", "mean", "lam")
    plan = scratch.keep(plan, "plan")
    rounded = scratch.keep(_rounded(base, plan, cap, "id", "source", "size"), "rounded")

    # what is left: one document for each (source, power of two, slot) may change by one copy
    rest = rounded.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("got"))
    rest = rest.select(F.col("source").alias("of"), F.round(F.col("target") - F.col("got")).cast("long").alias("left"))
    key = F.xxhash64(F.col("id").cast("string"), F.lit("rest"))
    at = [F.col("source"), F.floor(F.log2(F.col("size").cast("double"))).alias("power"), F.pmod(key, F.lit(4)).alias("slot")]
    pick = lambda ok: F.min(F.when(ok, F.struct(key.alias("key"), "id", "size")))
    able = rounded.filter("size > 0 and id is not null").groupBy(*at).agg(pick(F.col("copies") < cap).alias("more"), pick(F.col("copies") > 0).alias("less"))
    able = able.groupBy("source").agg(F.collect_list("more").alias("more"), F.collect_list("less").alias("less"))  # at most 4 for each power of two
    joined = rest.join(able, rest["of"].eqNullSafe(able["source"]))
    falling = lambda c: F.reverse(F.array_sort(F.transform(c, lambda x: F.struct(x["size"].alias("size"), x["key"].alias("key"), x["id"].alias("id")))))
    todo = F.when(F.col("left") > 0, falling(F.col("more"))).otherwise(falling(F.col("less")))
    fill = lambda s, x: F.when(x["size"] <= s["left"], F.struct((s["left"] - x["size"]).alias("left"), F.array_append(s["ids"], x["id"]).alias("ids"))).otherwise(s)
    kind = dict(rounded.dtypes)["id"]
    start = F.struct(F.abs("left").alias("left"), F.array().cast(f"array<{kind}>").alias("ids"))
    changes = joined.select("of", F.signum(F.col("left").cast("double")).cast("int").alias("step"), F.explode(F.aggregate(todo, start, fill)["ids"]).alias("changed")).distinct()
    changes = scratch.keep(changes, "changes")
    return Mix(plan, changes, cap)


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row.

    A document is taken 0 to ``cap`` whole times; ``taken`` is copies times
    size. Empty and null texts have size 0 and add nothing; null sources are
    one source, the last; rows that repeat an id get the same number of
    copies if their sizes agree; an empty table gives no rows. Reruns agree, as
    only hashes of ids decide.
    """
    scratch = Scratch(spark, "mixing")
    base = scratch.keep(sizes(docs, id_col, text_col, source_col), "sizes")
    found = fit(spark, base, scratch, weights, share, cap).apply(base, "id", "source", "size")
    return found.select("id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_rows(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns kept, with copies (how often) and taken, which replace columns of these names; texts are counted again rather than shuffled."""
    scratch = Scratch(spark, "mixing")
    base = scratch.keep(sizes(docs, id_col, text_col, source_col), "sizes")
    kept = [c for c in docs.columns if c not in ("copies", "taken")]
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    out = fit(spark, base, scratch, weights, share, cap).apply(wide, "id", "source", "size")
    return out.filter("copies > 0").select("row.*", "copies", "taken")
