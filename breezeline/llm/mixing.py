"""Interleaving sources to target weights as a Pfair schedule, with DataFrame functions only.

Each source's texts, in an order of their own, are cut into blocks of equal
length. With a weight w, a source's block k (from 0) is released at slot
floor(k / w) and due by slot ceil((k + 1) / w). Every slot goes to the released
block that is due first, which keeps each source less than one block away from
its share at any time. Weights are whole numbers of slots in a period, so the
schedule of one period, a table of ``period`` rows, repeats; block k of a source
takes the slot of block k mod q in period k div q.

A text's place in its source is a running length: over small chunks of each
source first, then within the chunk, so a source of any size is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 16  # characters
PERIOD = 1000  # slots; the schedule's resolution of weights
POWER = 0.7  # default weights are proportional to a source's length to this power
CHUNK_ROWS = 512
MAX_SOURCES = 10_000

_STATE = "struct<next:array<long>,plan:array<struct<slot:long,place:int,block:long>>>"


def schedule(quotas: Column, period: Column) -> Column:
    """Array of (slot, place, block) of one period for an array of whole quotas that sum to ``period``."""

    def step(state, slot):
        def due(block, i):
            quota = quotas[i]
            released = F.floor(block * period / quota) <= slot
            deadline = -F.floor(-(block + 1) * period / quota)
            return F.when(released, F.struct(deadline.alias("due"), i.alias("place"), block.alias("block")))

        def taken(first):
            following = F.transform(state["next"], lambda b, i: b + F.when(i == first["place"], 1).otherwise(0))
            row = F.struct(slot.cast("long").alias("slot"), first["place"].alias("place"), first["block"].alias("block"))
            return F.struct(following.alias("next"), F.concat(state["plan"], F.array(row)).alias("plan")).cast(_STATE)

        first = F.array_min(F.transform(state["next"], due))
        return F.transform(F.array(first), taken)[0]

    start = F.struct(
        F.transform(quotas, lambda q: F.lit(0).cast("long")).alias("next"),
        F.array().cast("array<struct<slot:long,place:int,block:long>>").alias("plan"),
    )
    return F.aggregate(F.sequence(F.lit(0), period - 1), start.cast(_STATE), step, lambda state: state["plan"])


def _quotas(sizes: DataFrame, weights: DataFrame | None, period: int) -> DataFrame:
    """(source_key, total, quota): at least one slot each, the rest by largest remainder; they sum to ``period``."""
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.greatest("total", F.lit(1)).cast("double"), POWER))
    else:
        sizes = sizes.join(F.broadcast(weights), "source_key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    every = Window.partitionBy(F.lit(0))  # one row for each source
    free = F.lit(period) - F.count("*").over(every)
    whole = F.sum("weight").over(every)
    exact = F.when(whole > 0, F.col("weight") / whole).otherwise(1 / F.count("*").over(every)) * free
    sizes = sizes.withColumn("exact", exact).withColumn("part", F.floor("exact"))
    sizes = sizes.withColumn("left", F.lit(period) - F.count("*").over(every) - F.sum("part").over(every))
    rank = F.row_number().over(every.orderBy((F.col("part") - F.col("exact")), "source_key"))
    quota = 1 + F.col("part") + F.when(rank <= F.col("left"), 1).otherwise(0)
    return sizes.select("source_key", "total", quota.cast("long").alias("quota"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: DataFrame | None = None,
    block: int = BLOCK,
    period: int = PERIOD,
) -> DataFrame:
    """``docs`` with the columns block, slot, offset and in_mix; nothing is dropped or repeated.

    Sort by slot and offset to read in the mixed order. ``offset`` is the text's
    first character in its source, ``block`` the block it starts in; in_mix says
    that no source had run out before the slot, so that the weights hold up to
    there. ``weights`` has (source, weight); unnamed sources and weights of zero
    get the least share, one slot of a period. Without it, weights follow the
    sources' lengths to the power 0.7. Null and empty texts have length 0 and
    keep a place; null sources are a source of their own; ids may be null or
    repeated. An empty table gives an empty result; columns of ``docs`` with the
    added names are replaced.
    """
    added = ("block", "slot", "offset", "in_mix")

    def key(column):
        return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")), column.isNull())

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    order = F.xxhash64(F.col(id_col), F.xxhash64(text_col))
    rows = docs.select(
        F.struct(*kept).alias("row"), key(F.col(source_col)).alias("source_key"), size.alias("size"), order.alias("order")
    )
    count = docs.count()
    chunks = max(1, -(-count // CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod("order", F.lit(chunks)))
    sums = rows.groupBy("source_key", "chunk").agg(F.sum("size").alias("size"))
    sizes = sums.groupBy("source_key").agg(F.sum("size").alias("total"))
    sources = sizes.count()
    if sources > MAX_SOURCES:
        raise ValueError(f"{sources} sources, more than {MAX_SOURCES}")
    period = max(period, 16 * sources)
    if weights is not None:
        weights = weights.select(key(F.col(weights.columns[0])).alias("source_key"), F.col(weights.columns[1]).cast("double").alias("weight"))
        weights = weights.groupBy("source_key").agg(F.max("weight").alias("weight"))
    quotas = _quotas(sizes, weights, period)
    listed = F.array_sort(F.collect_list(F.struct("source_key", "quota", "total")))
    plan = quotas.groupBy().agg(listed.alias("s"))
    plan = plan.select("s", F.explode(schedule(F.col("s.quota"), F.lit(period).cast("long"))).alias("p"))
    source = F.get(F.col("s"), F.col("p.place"))
    plan = plan.select(source["source_key"].alias("source_key"), source["quota"].alias("quota"),
                       source["total"].alias("total"), F.col("p.block").alias("turn"), F.col("p.slot").alias("at"))
    blocks = F.greatest(F.ceil(F.col("total") / block), F.lit(1))
    over = F.when(F.col("turn") == blocks % F.col("quota"), F.floor(blocks / F.col("quota")) * period + F.col("at"))
    plan = plan.withColumn("horizon", F.min(over).over(Window.partitionBy(F.lit(0))))
    before = Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_key", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("chunk_start"))
    inside = Window.partitionBy("source_key", "chunk").orderBy("order", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, ["source_key", "chunk"])
    # a text of length 0 at the very end belongs to the last block
    rows = rows.join(F.broadcast(sizes.select("source_key", F.col("total").alias("whole"))), "source_key")
    offset = F.col("chunk_start") + F.col("inside")
    number = F.floor(F.least(offset, F.greatest(F.col("whole") - 1, F.lit(0))) / block)
    rows = rows.select("row", "source_key", offset.alias("offset"), number.cast("long").alias("block"))
    quota = F.broadcast(quotas.select("source_key", "quota"))
    rows = rows.join(quota, "source_key").withColumn("turn", F.col("block") % F.col("quota"))
    rows = rows.join(F.broadcast(plan.drop("total", "quota")), ["source_key", "turn"])
    slot = (F.floor(F.col("block") / F.col("quota")) * period + F.col("at")).cast("long")
    rows = rows.select("row", "block", slot.alias("slot"), "offset", (slot < F.col("horizon")).alias("in_mix"))
    return rows.select("row.*", *added)


def in_order(mix: DataFrame) -> DataFrame:
    """The rows in mixed order, as range partitions sorted within."""
    return mix.repartitionByRange("slot", "offset").sortWithinPartitions("slot", "offset")
