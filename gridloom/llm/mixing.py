"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its integral, scaled to the source's target, is the
source's cumulative token demand D(t). Documents of a source queue in a seeded order; a document whose first word is the
u-th of the queue is trained at the position t with D(t) = u. Targets beyond one pass send the queue round again, so a
document has at most ``passes`` positions. The output is range-sorted by the first position.

Targets: the sources share ``share`` times all words by weight; a target stops at ``passes`` times its source's size and
the excess goes to the others by weight until none is above. In closed form there is a level L with
target = min(passes * size, L * weight); sources reach their stop in the order of size / weight.

Skew: a source with a third of all rows is dealt over ``blocks`` ranges of its queue. Sums of the ranges are aggregated
first; each range then runs its own prefix sum from its offset. No window spans a source, but for the ``blocks`` sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, shuffle_partitions, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Rates at the start and the end of training, by weight: what weighs most comes early, what weighs least late.
SCHEDULE = {5: (1.5, 0.5), 2: (1.0, 1.0), 1: (0.5, 1.5)}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds weight and target."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(everything) - 1) % len(weights)) + 1),
    )
    ratio = F.col("source_size") / F.col("weight")
    before = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(
        ratio.asc(), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.orderBy(ratio.asc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        share * F.sum("source_size").over(all_rows) - passes * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    # The level that holds is the one at the first source that does not reach its stop.
    tried = ranked.withColumn("level", level).withColumn(
        "stops", F.col("level") * F.col("weight") >= passes * F.col("source_size")
    )
    first = F.min(F.when(~F.col("stops"), F.struct(ratio.alias("ratio"), F.col("level")))).over(all_rows)
    return tried.withColumn("held", first).select(
        "source",
        "source_size",
        "weight",
        F.when(
            F.col("held").isNull() | F.col("stops"), (passes * F.col("source_size")).cast("double")
        ).otherwise(F.col("held.level") * F.col("weight")).alias("target"),
    )


def position(u: Column, target: Column, a: Column, b: Column) -> Column:
    """Training time at which the cumulative demand of a source, with a rate from a to b, reaches u words."""
    q = u / target * (a + b) / 2
    return F.when(target <= 0, F.lit(None).cast("double")).when(a == b, u / target).otherwise(
        (F.sqrt(F.greatest(a * a + 2 * (b - a) * q, F.lit(0.0))) - a) / (b - a)
    )


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    schedule: dict[int, tuple[float, float]] | None = None,
    share: float = 1.5,
    passes: int = 2,
    seed: int = 42,
    blocks: int = 1024,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, weight, target, taken, taken_1 to taken_n (words taken in
    each of ``passes`` passes), and position (of the first word; null if none is taken), position_2 to position_n.

    Null texts have size 0; null sources form one source, last in order. Empty tables give no rows. Rows with equal id
    and text queue one after the other; they are counted first, so that a third of all rows may be equal. Very long
    texts count whole. A document at the end of a demand is taken in part, its first words. Other columns are ignored.
    """
    schedule = schedule or SCHEDULE
    spark = docs.sparkSession
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("key"),
    )
    rows = materialize(
        sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("times")).withColumn(
            "block", F.pmod(F.shiftrightunsigned("key", 20), F.lit(blocks)).cast("int")
        ),
        "mix-sizes",
    )
    words = F.col("size") * F.col("times")
    sums = rows.groupBy("source", "block").agg(F.sum(words).alias("words"))
    queue = Window.partitionBy("source").orderBy("block")
    offsets = sums.withColumn("offset", F.sum("words").over(queue) - F.col("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, passes)
    rates = F.create_map(
        *[
            x
            for w, (a, b) in schedule.items()
            for x in (F.lit(w), F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")))
        ]
    )
    goal = goal.withColumn(
        "rate", F.coalesce(rates[F.col("weight")], F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b")))
    )
    plan = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).select(
        offsets["source"].alias("s"), offsets["block"].alias("b"), "offset", "source_size", "weight", "target", "rate"
    )
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = rows.withColumn("inside", F.sum(words).over(inside) - words)
    placed = placed.join(plan, placed["source"].eqNullSafe(plan["s"]) & (placed["block"] == plan["b"]))
    # Equal rows come out one by one, each with its own place in the queue.
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).withColumn(
        "start", F.col("offset") + F.col("inside") + F.col("nth") * F.col("size")
    )
    demand = F.floor("target").cast("long")
    begins = [F.col("start") + i * F.col("source_size") for i in range(passes)]
    took = [F.greatest(F.lit(0), F.least(F.col("size"), demand - at)).cast("long") for at in begins]
    at = [
        F.when(n > 0, position(u, F.col("target"), F.col("rate.a"), F.col("rate.b")))
        for u, n in zip(begins, took, strict=True)
    ]
    out = placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "weight",
        "target",
        sum(took[1:], took[0]).alias("taken"),
        *[n.alias(f"taken_{i + 1}") for i, n in enumerate(took)],
        *[x.alias(f"position_{i + 1}" if i else "position") for i, x in enumerate(at)],
    )
    order = (F.col("position").asc_nulls_last(), "doc_id")
    return materialize(out, "mix").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)


def apply_mix(docs: DataFrame, *, passes: int = 2, **options) -> DataFrame:
    """``docs`` (with text and source) as the mix trains on them, same columns: a row for each pass that takes words of
    a row, its text cut after the words taken, in the order of the passes' training positions; rows of which nothing is
    taken go. Equal rows each have their own; rows are told apart by 128 bits of hash over all their columns. Nulls,
    empty and very long texts, and empty tables as in mix; columns may have any names."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols, F.lit(1)).alias("h2"))
    keyed = docs.select(key.alias("key"), F.struct(*cols).alias("row"))
    got = mix(keyed.select("key", "row.text", "row.source"), id_col="key", passes=passes, **options)
    places = ["position", *[f"position_{i}" for i in range(2, passes + 1)]]
    each = F.array(*[F.struct(F.col(f"taken_{i}").alias("n"), F.col(at).alias("at")) for i, at in enumerate(places, 1)])
    parts = F.filter(each, lambda x: x["n"] > 0)
    got = got.where("taken > 0").select(
        F.col("doc_id").alias("key"), F.explode(parts).alias("part"), "size"
    ).select("key", "size", "part.*")
    rows = keyed.groupBy("key").agg(F.first("row").alias("row")).join(got, "key")
    text, n = F.col("row.text"), F.col("n").cast("int")
    length = lambda xs: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    # A text is a gap and a word in turn; the first n of both make up its beginning.
    first = F.substring(
        text, F.lit(1), length(F.split(text, WORD, -1)) + length(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    )
    cut = F.when(F.col("n") >= F.col("size"), text).otherwise(first)
    order = (F.col("at").asc_nulls_last(), "key")
    made = rows.select(
        "key",
        "at",
        F.struct(*[cut.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]).alias("row"),
    )
    made = made.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "weight", "position"
    )
