"""Mixing sources to target weights on a low-discrepancy schedule, in DataFrame functions only.

Points of the golden-ratio sequence, mapped through the sources' cumulative shares, say which source each slot
takes from; a slot's rank among its source's slots says which of the source's shuffled blocks it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import WORD, stash, whole_row

#: Words in a block, at most; a smaller corpus gets smaller blocks, so that a schedule has ``LEAST_SLOTS`` slots.
BLOCK = 1024
LEAST_SLOTS = 50_000
#: Weights given to the sources in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken so many times at most.
EPOCHS = 3
#: Rows, and slots, are ranked in pieces of about so many, never a whole source in one task.
PIECE = 8192
#: Cells of the unit interval for looking up a point's source.
CELLS = 4096
GOLDEN = 0.6180339887498949


def size_of(text: str = "text") -> Column:
    """The words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mark_of(text: str = "text") -> Column:
    """A document's place in the shuffle."""
    return F.xxhash64(F.col("doc_id"), F.col(text))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target, weight)`` from ``sizes(source, source_size)``, one row per source.

    The sources in code point order (null last) get the weights in turn and share the total of all sizes;
    a target stops at ``epochs`` times its source's size and the excess is shared again by weight. In the order
    of the ratio size/weight the stopped sources come first, so running sums find the level directly.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("place").cast("int"))
    ranked = sizes.selectExpr("source", "source_size", f"(row_number() over (order by source nulls last) - 1) % {len(weights)} + 1 as place").withColumn("weight", w)
    capped = ranked.withColumn("cap", (epochs * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    run = capped.selectExpr(
        "*",
        "sum(source_size) over () as total",
        "coalesce(sum(cap) over (order by ratio, place, source nulls last rows between unbounded preceding and 1 preceding), 0D) as cap_before",
        "sum(weight) over (order by ratio desc, place desc, source desc nulls first rows between unbounded preceding and current row) as weight_left",
    ).withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    first = F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "source", "level"))
    level = run.withColumn("first", first).selectExpr("*", "min(first) over () as _first").withColumn("fill", F.col("_first.level"))
    return level.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("fill", F.col("ratio"))).alias("target"), "weight")


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """``(source_no, rank)`` for each of ``slots`` slots of ``plan(source_no, low, high)``; ranks count from 0 per source.

    Slot i falls to the source whose share [low, high) holds frac((i + 1) * golden ratio). Slots are counted by
    source in pieces of ``PIECE``; running sums over the pieces give each piece its first rank.
    """
    spark = plan.sparkSession
    point = F.col("id") + 1
    # The product is taken modulo 1 in two parts, so that no digit is lost at large slot numbers.
    high, low = F.floor(point / 4096), point % 4096
    step = (GOLDEN * 4096) % 1
    at = F.pmod(F.pmod(high * F.lit(step), F.lit(1.0)) + F.pmod(low * F.lit(GOLDEN), F.lit(1.0)), F.lit(1.0))
    # Interval lookup as an equi-join: each source is listed under the cells of [0, 1) that its share touches.
    cells = plan.select("source_no", "low", "high", F.explode(F.expr(f"sequence(cast(low * {CELLS} as int), cast(least(high * {CELLS}, {CELLS} - 1) as int))")).alias("cell"))
    drawn = spark.range(slots).select("id", at.alias("at"), F.expr(f"id div {PIECE}").alias("piece")).withColumn("cell", (F.col("at") * CELLS).cast("int"))
    drawn = drawn.join(cells, "cell").where("low <= at and at < high").select("id", "piece", "source_no")
    firsts = drawn.groupBy("source_no", "piece").agg(F.count("*").alias("n")).selectExpr("source_no", "piece", "sum(n) over (partition by source_no order by piece) - n as before")
    ranked = drawn.selectExpr("source_no", "piece", "row_number() over (partition by source_no, piece order by id) - 1 as within")
    return ranked.join(firsts, ["source_no", "piece"]).select("source_no", (F.col("before") + F.col("within")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(doc_id, mark, size, source_size, target, taken)`` per row of ``docs(doc_id, text, source)``.

    Within a source the documents lie one after another in hash order, ties by size; their words are cut into
    blocks that differ by at most one word, and slot rank r takes block r modulo the number of blocks. So no
    block is taken more than ``epochs`` times, and ``taken`` counts the words of a document that lie in taken
    blocks, repeats included. A null text has size 0 and takes nothing; a null source is a source of its own.
    Rows equal in id and text are told apart by their place alone. Places are running sums over pieces of the
    hash range, so a source with a third of all rows is not ranked in one task.
    """
    rows = stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), mark_of().alias("mark"), size_of().alias("size")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    first = rows.agg(F.sum("size"), F.count("*")).first()
    words, count = int(first[0] or 0), int(first[1])
    block = max(1, min(BLOCK, words // LEAST_SLOTS))
    goal = targets(sizes.select("source", "source_size"), weights, epochs)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block))
    plan = goal.withColumn("source_no", F.expr("row_number() over (order by source nulls last)")).withColumn("blocks", blocks)
    plan = plan.withColumn("want", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = stash(
        plan.selectExpr(
            "*",
            "sum(want) over () as wanted",
            "coalesce(sum(want) over (order by source_no rows between unbounded preceding and 1 preceding), 0D) as before",
        ).selectExpr("source", "source_no", "source_size", "target", "blocks", "wanted", "coalesce(before / nullif(wanted, 0), 0D) as low", "coalesce((before + want) / nullif(wanted, 0), 0D) as high"),
        "mix-plan",
    )
    wanted = plan.agg(F.max("wanted")).first()[0] or 0
    taken = schedule(plan.where("high > low").select("source_no", "low", "high"), round(wanted))
    # The last rank may pass epochs * blocks by the sequence's discrepancy; such slots take nothing.
    taken = taken.join(plan.select("source_no", "blocks"), "source_no").where(F.col("rank") < epochs * F.col("blocks"))
    taken = taken.groupBy("source_no", F.expr("rank % blocks").alias("block")).agg(F.count("*").alias("times"))
    pieces = max(1, -(-count // PIECE))
    named = rows.join(plan.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "blocks"), F.col("source").eqNullSafe(F.col("_source")))
    # A share of the unsigned hash range, rising with the hash.
    named = named.withColumn("piece", F.floor((F.col("mark").cast("double") / 2.0**64 + 0.5) * pieces).cast("long"))
    before = named.groupBy("source_no", "piece").agg(F.sum("size").alias("n")).selectExpr("source_no", "piece", "sum(n) over (partition by source_no order by piece) - n as before")
    placed = named.join(before, ["source_no", "piece"]).selectExpr(
        "doc_id", "mark", "size", "source_no", "source_size", "target", "blocks",
        "before + sum(size) over (partition by source_no, piece order by mark, size, doc_id rows between unbounded preceding and current row) - size as start",
    )
    placed = placed.withColumn("end", F.col("start") + F.col("size"))
    # Block j of a source holds the words from floor(j * source_size / blocks) on.
    edge = lambda j: F.expr(f"cast(floor(cast({j} as decimal(20,0)) * source_size / blocks) as long)")
    block_of = lambda x: F.expr(f"cast(floor((cast({x} as decimal(20,0)) * blocks + blocks - 1) / source_size) as long)")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(block_of("start"), block_of("end - 1"))))
    inside = F.least("end", edge("block + 1")) - F.greatest("start", edge("block"))
    joined = parts.withColumn("inside", inside).join(taken, ["source_no", "block"], "left")
    got = joined.groupBy("source_no", "start", "doc_id", "mark", "size", "source_size", "target").agg(F.sum(F.col("inside") * F.coalesce("times", F.lit(0))).alias("taken"))
    cols = ["doc_id", "mark", "size", "source_size", "target", "taken"]
    return got.select(*cols).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: each as many times as its taken words go into its size, rounded half up.

    Documents without words take no part in a mix by words; they stay, once. Rows equal in id and text share what
    they are taken together.
    """
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))))
    # Such rows share one entry, so that the join does not multiply them.
    share = mix(docs).groupBy("doc_id", "mark").agg(F.sum(times).alias("sum"), F.count("*").alias("n")).toDF("of_id", "of_mark", "sum", "n")
    marked = docs.select(whole_row(docs).alias("row"), "doc_id", mark_of().alias("mark"))
    joined = marked.join(share, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
    each = joined.select("row", F.round(F.col("sum") / F.col("n")).cast("int").alias("k")).where("k > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy")).select("row.*")
