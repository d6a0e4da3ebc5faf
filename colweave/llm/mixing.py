"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Every document gets a rate, how often it is taken on average. Among all rates between 0 and ``most`` whose words add up to the
target of each source, those nearest to one copy each in relative entropy are sought. The dual of that convex
problem has one multiplier per source: rates are ``min(most, exp(multiplier * size / mean size))``. Newton steps,
kept inside a bracket, solve it: each is one aggregation over a table of (source, size, documents), far smaller than the documents, and the
multipliers stay a table of one row per source. Where the target is ``most`` times the source, all rates are ``most``.

Rates become whole copies: the whole part stays, and the fractions are rounded up in the order of a hash of the id until the
source's words are reached, the first document beyond is left, and the rest is filled with the smallest unused sizes. The running
sums are taken in cells of the hash, so a source holding a third of all rows never meets in one task.

Null text has size 0; such documents keep one copy of no words. A null source is a source of its own, last. Repeated
rows each count; repeated ids are told apart by a hash of all columns; rows equal in all are dealt with together. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of, unit_hash, written

CELLS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII blanks."""
    return F.when(text.rlike(r"\S"), F.length(F.regexp_replace(text, r"\s*+\S++\s*+", "x"))).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: source_size and target. ``sizes``: source, size, n (documents).

    Sources in order of code points, null last, get the weights in turn. A target stops at ``most`` times its source and the
    excess goes to the others by weight: with the sources by (limit / weight), the first k are at their limits and the others
    share what is left. These tables hold one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * float(most))
    by_need = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = by_need.rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    total = F.sum("source_size").over(whole) * float(share)
    level = (total - (F.sum("limit").over(upto) - F.col("limit"))) / (F.sum("weight").over(whole) - (F.sum("weight").over(upto) - F.col("weight")))
    # the first source whose limit is not reached sets the level for itself and all after it
    marked = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("limit"))
    marked = marked.withColumn("final", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(upto))
    return marked.select("source", "source_size", F.least("limit", F.coalesce(F.col("final") * F.col("weight"), F.col("limit"))).alias("target"))


def solve(sizes: DataFrame, wanted: DataFrame, most: float, steps: int = 120, tolerance: float = 1e-6) -> DataFrame:
    """Per source the multiplier of the dual; ``mean`` scales sizes. Newton inside a bracket, a job a step."""
    cap = math.log(most)
    stats = sizes.where("size > 0").groupBy(F.col("source").alias("s")).agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    # at the ends of the bracket even the smallest document's rate is next to 0 or at its limit
    state = written(
        wanted.join(stats, F.col("source").eqNullSafe(F.col("s"))).select(
            "source", "target", "mean", (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("at"), (-60.0 * F.col("mean") / F.col("least")).alias("low"),
            (cap * F.col("mean") / F.col("least")).alias("high"), F.lit(1e9).alias("gap"),
        ),
        "mix-dual",
    )
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        raw = F.col("at") * x
        rate = F.exp(F.least(raw, F.lit(cap)))
        mass = F.col("size") * F.col("n") * rate
        sums = sizes.join(state.select(F.col("source").alias("s"), "mean", "at"), F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(mass).alias("have"), F.sum(F.when(raw < cap, mass * x).otherwise(0.0)).alias("slope")
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")))
        over = F.col("have") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("at")), F.when(over, F.col("at")).otherwise(F.col("high"))
        newton = F.col("at") - F.when(F.col("slope") > 0, (F.col("have") - F.col("target")) / F.col("slope"))
        middle = (low + high) / 2
        step = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        gap = F.abs(F.col("have") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        done = (gap < tolerance) | F.col("full")
        state = written(
            joined.select("source", "target", "mean", "full", F.when(done, F.col("at")).otherwise(step).alias("at"),
                          low.alias("low"), high.alias("high"), F.when(F.col("full"), 0.0).otherwise(gap).alias("gap")),
            "mix-dual",
        )
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst < tolerance:
            return state
    raise ArithmeticError(f"the dual did not converge within {steps} steps: a target is still missed by a part of {worst:g}")


def copies(sized: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, row_hash, source, size, source_size, target and copies per row of ``sized`` (doc_id, row_hash, source, size)."""
    sizes = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    wanted = written(targets(sizes, weights, share, most), "mix-targets")
    dual = solve(sizes, wanted, most)
    per = wanted.join(dual.select(F.col("source").alias("s"), "mean", "at", "full"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "mean", "at", "full"
    )
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(most)).otherwise(
        F.least(F.exp(F.col("at") * F.col("size") / F.col("mean")), F.lit(float(most)))
    )
    rated = sized.join(per, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).drop("of", "mean", "at", "full")
    rated = rated.withColumn("base", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.col("base"))
    # (hash - fraction) in [-1, 1): documents with large fractions tend to come first, each with its fraction as probability
    rated = rated.withColumn("key", unit_hash("doc_id", "row_hash") - F.col("part")).withColumn(
        "cell", F.floor((F.col("key") + 1) / 2 * CELLS).cast("int")
    ).withColumn("open", (F.col("size") > 0) & (F.col("base") < most))
    rated = written(rated, "mix-rates")

    # words the whole parts leave open, by source; then by cell of the key where the running sum passes them
    open_ = rated.where("open")
    room = rated.groupBy("source").agg(F.greatest(F.max("target") - F.sum(F.col("base") * F.col("size")), F.lit(0.0)).alias("room"))
    in_cell = open_.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = in_cell.withColumn("before", before).join(room.select(F.col("source").alias("s"), "room"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    edge = written(
        cells.where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("words") > F.col("room")))
        .select(F.col("source").alias("edge_of"), F.col("cell").alias("edge"), "before", "room"),
        "mix-edge",
    )
    # a source without an edge takes all its open documents
    at_edge = open_.join(edge, F.col("source").eqNullSafe(F.col("edge_of")), "left")
    inside = at_edge.where(F.col("cell") == F.col("edge"))
    running = F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id", "row_hash").rowsBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("upto", F.col("before") + running).where(F.col("upto") <= F.col("room"))
    reached = last.groupBy("source").agg(F.max(F.struct("key", "doc_id", "row_hash")).alias("last"), F.max("upto").alias("upto"))
    cut = written(
        edge.join(reached, F.col("edge_of").eqNullSafe(F.col("source")), "left").select(
            "edge_of", "edge", "last", (F.col("room") - F.coalesce("upto", "before")).alias("rest")
        ),
        "mix-cut",
    )
    ranked = F.struct("key", "doc_id", "row_hash")
    placed = rated.join(cut, F.col("source").eqNullSafe(F.col("edge_of")), "left")
    up = F.col("open") & (
        F.col("edge").isNull() | (F.col("cell") < F.col("edge")) | ((F.col("cell") == F.col("edge")) & F.coalesce(ranked <= F.col("last"), F.lit(False)))
    )
    placed = placed.withColumn("up", up)

    # what is still missing is below the size of the document left out: fill it with the smallest sizes not rounded up
    unused = placed.where(F.col("open") & ~F.col("up") & (F.col("size") <= F.col("rest")))
    spare = unused.groupBy("source", "size").agg(F.count("*").alias("n"), F.max("rest").alias("rest"))
    sofar = F.coalesce(
        F.sum(F.col("size") * F.col("n")).over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    take = F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("rest") - sofar) / F.col("size"))))
    fill = spare.withColumn("take", take).where("take > 0").select(
        F.col("source").alias("fill_of"), F.col("size").alias("fill_size"), "take", (F.col("take") < F.col("n")).alias("some")
    )
    fill = written(fill, "mix-fill")
    filled = placed.join(fill, F.col("source").eqNullSafe(F.col("fill_of")) & (F.col("size") == F.col("fill_size")) & F.col("open") & ~F.col("up"), "left")
    # where only some documents of a size are needed, the first by key
    partly = filled.where("some").withColumn("nth", F.row_number().over(W.partitionBy("source", "size").orderBy(ranked)))
    entire = filled.where("not coalesce(some, false)").withColumn("nth", F.lit(0))
    more = F.col("up") | (F.col("take").isNotNull() & (F.col("nth") <= F.col("take")))
    return entire.unionByName(partly).select(
        "doc_id", "row_hash", "source", "size", "source_size", "target", (F.col("base") + more.cast("int")).cast("int").alias("copies")
    )


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _row_hash(docs), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps and variants, which have no hash, count as their JSON."""
    whole = [f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()]
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return F.xxhash64(*[F.to_json(F.struct(column(c))) if c in whole else column(c) for c in docs.columns]).alias("row_hash")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    key = F.xxhash64("doc_id", "row_hash").alias("key"), F.col("row_hash").alias("check")
    per = copies(sizes_of(docs), **settings).groupBy(*key).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    per = written(per, "mix-copies")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", _row_hash(docs)).select("row", *key)
    # equal rows have one key: one of them stands for all
    taken = rows.join(per, ["key", "check"]).dropDuplicates(["key", "check"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
