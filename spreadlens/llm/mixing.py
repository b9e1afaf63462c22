"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id. A copy's virtual finish time is the source's words up to and with
it, divided by the source's target; a document may come up to `max_repeats` times, the second round after the first. All
copies are ordered by finish time and taken until the total budget is spent, so every source reaches its target together.

No running total runs through one task: a source's shuffle is cut into hash buckets whose sums are added up first, and the
cut in the global order is found by zooming into the interval of finish times in which the budget runs out. Only interval
sums and one cut position come to the driver. One row per source is ranked in a single window, as weights follow the names.

Defined cases: NULL and empty texts have size 0 and are never taken; a NULL source comes last and is a source of its own;
repeated rows are documents of their own; an empty table mixes to an empty table; other columns are ignored (`mix_plan`) or
pass through (`mixed_documents`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlens.llm import common as c
from spreadlens.session import stored

WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
INTERVALS, SMALL_INTERVAL = 4096, 50_000


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights are dealt out in code-point order of the names. The budget, all sizes, is shared by weight; a source stops at
    `max_repeats` times its size and the excess is shared again. Ordered by cap per weight the stopped sources come first,
    so running sums over that order settle it at once.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    big = "decimal(38,0)"
    rows = totals.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_repeats).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        (F.sum(F.col("source_size").cast(big)).over(everything) - F.coalesce(F.sum(F.col("cap").cast(big)).over(before), F.lit(0))).cast(big).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    capped = F.col("cap").cast(big) * F.col("w_left") < F.col("left") * F.col("w")
    # The first source that isn't stopped has the share of all later ones: most is left over fewest caps.
    rows = rows.withColumn("capped", capped)
    open_left = F.max(F.when(~F.col("capped"), F.struct("w_left", "left"))).over(everything)
    share = open_left["left"].cast("double") * F.col("w").cast("double") / open_left["w_left"].cast("double")
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _queued(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """`sizes` (doc_id, source, size, digest) with source_size, target and `upto`, the source's words up to and with the row."""
    spot = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.select("*", spot.alias("spot"), F.conv(F.substring(spot, 1, 3), 16, 10).cast("int").alias("bucket"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("start"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    known = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    known = known.select(F.col("s.source").alias("_source"), F.col("bucket").alias("_bucket"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("spot", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("inner", F.sum("size").over(inside))
        .join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
        .select("doc_id", "source", "size", "digest", "spot", "source_size", "target", (F.col("start") + F.col("inner")).alias("upto"))
    )


def _finish(turn: Column | int) -> Column:
    return (F.lit(turn) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


def _place(turn: Column | int) -> Column:
    """A copy's place in the global order; ties of finish time go by source, hash and id."""
    return F.struct(
        _finish(turn).alias("finish"), F.coalesce("source", F.lit("\U0010ffff")).alias("source"), F.col("spot").alias("spot"),
        F.col("doc_id").alias("doc_id"), F.col("upto").alias("upto"), F.lit(turn).cast("int").alias("turn"),
    )


def _cut(queue: DataFrame, max_repeats: int):
    """The place of the last copy within the budget; None if no copy fits, True if all do.

    Finish times are cut into intervals with sums; the one in which the budget runs out is cut again until few copies are
    left, which are then ordered.
    """
    copies = queue.where("size > 0").select("size", F.explode(F.array(*(_place(t) for t in range(max_repeats)))).alias("place"))
    ends = copies.agg(F.max("place.finish"), F.sum("size").cast("decimal(38,0)")).first()
    budget = queue.agg(F.sum("size").cast("decimal(38,0)")).first()[0]
    if ends[0] is None:
        return None
    if ends[1] <= budget:
        return True
    low, high, spent = 0.0, ends[0], 0
    while True:
        # Finish times near 1 matter, so the first cut is even up to 2 and leaves the rest as one interval.
        width = (min(high, 2.0) if low == 0.0 else high - low) / INTERVALS
        if low + width == low or width <= 0:
            break
        step = F.least(F.floor((F.col("place.finish") - low) / width), F.lit(INTERVALS)).cast("int")
        inside = copies.where((F.col("place.finish") >= low) & (F.col("place.finish") <= high))
        sums = inside.groupBy(step.alias("step")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("place.finish").alias("lo"), F.max("place.finish").alias("hi"))
        for row in sorted(sums.collect()):
            if spent + row["words"] > budget:
                break
            spent += row["words"]
        low, high = row["lo"], row["hi"]
        if row["n"] <= SMALL_INTERVAL or low == high:
            break
    rest = copies.where((F.col("place.finish") >= low) & (F.col("place.finish") <= high))
    running = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = rest.select("place", running.alias("words")).where(F.col("words") + F.lit(spent) <= F.lit(budget)).agg(F.max("place")).first()[0]
    if last is None:
        before = copies.where(F.col("place.finish") < low).agg(F.max("place")).first()[0]
        return before
    return last


def mix_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size, digest) with source_size, target, copies and taken."""
    queue = stored(_queued(sizes, weights, max_repeats), "queue")
    cut = _cut(queue, max_repeats)
    if cut is None:
        copies = F.lit(0)
    elif cut is True:
        copies = F.lit(max_repeats)
    else:
        bound = F.struct(
            F.lit(cut["finish"]).alias("finish"), F.lit(cut["source"]).alias("source"), F.lit(cut["spot"]).alias("spot"),
            F.lit(cut["doc_id"]).cast(queue.schema["doc_id"].dataType).alias("doc_id"), F.lit(cut["upto"]).cast("long").alias("upto"), F.lit(cut["turn"]).alias("turn"),
        )
        copies = sum(((_place(t) <= bound).cast("int") for t in range(max_repeats)), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0))
    return queue.select("doc_id", "source", "size", "digest", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _sizes(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", "source", c.n_words(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("digest")), "sizes")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document (doc_id, text, source): doc_id, size, source_size, target, taken."""
    return mix_sizes(_sizes(docs), weights, max_repeats).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each document as often as it was taken, with exactly the columns it came with."""
    plan = mix_sizes(_sizes(docs), weights, max_repeats).where("copies > 0")
    ident = lambda: F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # Rows alike in id and content are numbered, so each gets the copies of one row of the plan.
    turns = plan.groupBy(ident().alias("_id"), F.col("digest").alias("_digest")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    packed = docs.select(ident().alias("_id"), F.xxhash64("text", "source").alias("_digest"), F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("_doc"))
    alike = Window.partitionBy("_id", "_digest").orderBy(F.lit(0))
    numbered = packed.withColumn("_n", F.row_number().over(alike)).join(turns, ["_id", "_digest"])
    times = F.coalesce(F.get("_copies", F.col("_n") - 1), F.lit(0))
    return numbered.where(times > 0).select(F.explode(F.array_repeat("_doc", times)).alias("_doc")).select("_doc.*")
