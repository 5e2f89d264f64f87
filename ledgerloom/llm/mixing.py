"""Mixing sources to target weights along a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of their id) into one stream of words,
cut into blocks of ``block`` words; the stream may be gone through twice. The schedule
is a row of slots: slot n has the point frac(n * golden ratio), which falls into one
source's part of the cumulative targets, and the source's r-th slot takes its r-th
block. Any stretch of the schedule so has every source close to its share. Slots that a
source does not need fall away, and slots that it lacks follow at the end (both a few
per source, by the points' discrepancy); the last block is cut, so that a source's words
meet its target to the nearest word.

Only built-in functions. Positions in a hot source's stream and ranks in the schedule
are computed in two levels (pieces, then sums of pieces), so no window holds a source.
What is kept per source (one row each) is the only table handled in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CLASS, WORD, stored

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2
BLOCK, SEED = 256, "mix-1"
# Points are multiples of 2**-31: n * round(2**31 / golden ratio) modulo 2**31.
_RANGE, _STEP, _CELL_BITS = 1 << 31, 1327217885, 21
_CHUNK_BITS = 14


def _row_key() -> Column:
    """Tells rows with one doc_id but other text or source apart."""
    return F.xxhash64(F.isnull("doc_id"), F.isnull("source"), "source", "text")


def word_count(text: str | Column = "text") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and the place in the shuffled order, without the text."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return documents.select(
        "doc_id",
        "source",
        _row_key().alias("key"),
        word_count().alias("size"),
        order.alias("place"),
    ).withColumn("part", F.substr("place", F.lit(1), F.lit(3)))


def targets(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    limit: int = LIMIT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per source: its number in code point order, size, target and blocks.

    Weighted shares of ``share`` times all words; sources that would get more than
    ``limit`` times their size get that, and the others share the rest. Taken in order
    of size per weight, the limited sources come first, so running sums find them.
    """
    every = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    fill = Window.orderBy(F.col("bound") / F.col("weight"), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", number)
        .withColumn(
            "weight",
            F.get(F.array(*[F.lit(w) for w in weights]), F.col("source_no") % len(weights)),
        )
        .withColumn("bound", F.col("source_size") * limit)
        .withColumn("wanted", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(every))
    )

    def rate(bounds: Column, used: Column) -> Column:
        return (F.col("wanted") - bounds) / F.nullif(F.col("weights") - used, F.lit(0))

    so_far = rate(
        F.coalesce(F.sum("bound").over(before), F.lit(0)),
        F.coalesce(F.sum("weight").over(before), F.lit(0)),
    )
    limited = F.min((F.col("bound") <= F.col("weight") * F.col("so_far")).cast("int")).over(upto) == 1
    table = table.withColumn("so_far", so_far).withColumn("limited", limited)
    level = rate(
        F.sum(F.when(F.col("limited"), F.col("bound")).otherwise(0)).over(every),
        F.sum(F.when(F.col("limited"), F.col("weight")).otherwise(0)).over(every),
    )
    target = F.when(F.col("limited"), F.col("bound").cast("double")).otherwise(
        F.col("weight") * F.col("level")
    )
    words = F.least(F.round("target").cast("long"), F.col("bound"))
    return (
        table.withColumn("level", level)
        .withColumn("target", target)
        .withColumn("words", words)
        .withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
        .select("source", "source_no", "source_size", "target", "words", "blocks")
    )


def slots(table: DataFrame) -> DataFrame:
    """The schedule: slot, source_no, r. ``table`` is a stored result of ``targets``."""
    spark = table.sparkSession
    count = table.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    order = Window.orderBy("source_no")
    running = F.sum("words").over(order)
    total = F.sum("words").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    scaled = lambda x: F.floor(x / F.col("total") * _RANGE).cast("long")
    parts = (
        table.where("words > 0")
        .withColumn("upto", running)
        .withColumn("total", total)
        .select(
            "source_no",
            scaled(F.col("upto") - F.col("words")).alias("lo"),
            scaled(F.col("upto")).alias("hi"),
        )
        .where("lo < hi")
    )
    cells = parts.withColumn(
        "cell",
        F.explode(F.expr(f"sequence(shiftright(lo, {_CELL_BITS}), shiftright(hi - 1, {_CELL_BITS}))")),
    )
    points = spark.range(count).select(
        F.col("id").alias("slot"),
        ((F.col("id") % _RANGE) * _STEP % _RANGE).alias("point"),
    )
    drawn = (
        points.withColumn("cell", F.shiftright("point", _CELL_BITS))
        .join(cells, "cell")
        .where("point >= lo AND point < hi")
        .select("slot", "source_no", F.shiftright("slot", _CHUNK_BITS).alias("chunk"))
    )
    chunks = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk")
    chunks = stored(
        chunks.withColumn("r0", F.sum("n").over(earlier) - F.col("n")), "chunks"
    )
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = drawn.join(chunks.drop("n"), ["source_no", "chunk"]).withColumn(
        "r", F.col("r0") + F.row_number().over(within) - 1
    )
    needed = table.select("source_no", "blocks")
    scheduled = ranked.join(needed, "source_no").where("r < blocks").select("slot", "source_no", "r")
    got = chunks.groupBy("source_no").agg(F.sum("n").alias("got"))
    lacking = (
        needed.join(got, "source_no", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < blocks")
        .withColumn("lack", F.col("blocks") - F.col("got"))
        .withColumn("slot0", F.lit(count) + F.sum("lack").over(order) - F.col("lack"))
        .select("source_no", "slot0", "got", F.explode(F.expr("sequence(got, blocks - 1)")).alias("r"))
        .select((F.col("slot0") + F.col("r") - F.col("got")).alias("slot"), "source_no", "r")
    )
    return scheduled.unionByName(lacking)


def _placed(sized: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their offset in their source's stream; (source_no, part, rn) names a row."""
    numbered = sized.join(table, sized.source.eqNullSafe(table.source)).select(
        "doc_id", "key", "size", "place", "part", "source_no", "source_size", "target", "words"
    )
    sums = numbered.groupBy("source_no", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("part")
    sums = sums.select("source_no", "part", (F.sum("n").over(earlier) - F.col("n")).alias("from"))
    order = Window.partitionBy("source_no", "part").orderBy("place", "doc_id", "key")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.join(sums, ["source_no", "part"]).select(
        "doc_id",
        "key",
        "source_no",
        "part",
        F.row_number().over(order).alias("rn"),
        "size",
        "source_size",
        "target",
        "words",
        (F.col("from") + F.sum("size").over(upto) - F.col("size")).alias("offset"),
    )


def _pieces(placed: DataFrame, block: int, limit: int) -> DataFrame:
    """The parts of rows in each block of their source's stream."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(limit - 1)))
    start = F.col("offset") + F.col("epoch") * F.col("source_size")
    pieces = (
        placed.where("size > 0 AND words > 0")
        .withColumn("epoch", rounds)
        .withColumn("start", start)
        .withColumn("stop", F.least(start + F.col("size"), F.col("words")))
        .where("start < stop")
        .withColumn(
            "r",
            F.explode(
                F.sequence(
                    F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
                )
            ),
        )
    )
    begin = F.greatest("start", F.col("r") * block)
    end = F.least("stop", (F.col("r") + 1) * block)
    return pieces.withColumn("first", begin - F.col("start")).withColumn("taken", end - begin)


def schedule(documents: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The mix itself: slot, source_no, r, epoch, doc_id, first (word), taken (words)."""
    sized = stored(sizes(documents, seed), "sizes")
    table = stored(targets(sized, block=block), "targets")
    pieces = _pieces(_placed(sized, table), block, LIMIT)
    return pieces.join(slots(table), ["source_no", "r"]).select(
        "slot", "source_no", "r", "epoch", "doc_id", "first", "taken"
    )


def mix(documents: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """doc_id, key, size, source_size, target and taken, for every row of ``documents``.

    A null text has no words; a null source is a source of its own, and the last one.
    Rows without words are taken 0 times. Repeated rows each have their place. Ties in
    the shuffled order go by doc_id, then by a hash of text and source.
    """
    sized = stored(sizes(documents, seed), "sizes")
    table = stored(targets(sized, block=block), "targets")
    placed = stored(_placed(sized, table), "placed")
    taken = _pieces(placed, block, LIMIT).join(slots(table), ["source_no", "r"])
    row = ["source_no", "part", "rn", "doc_id", "key", "size", "source_size", "target"]
    return (
        placed.select(*row, F.lit(0).cast("long").alias("taken"))
        .unionByName(taken.select(*row, "taken"))
        .groupBy(*row)
        .agg(F.sum("taken").alias("taken"))
        .select("doc_id", "key", "size", "source_size", "target", "taken")
    )


def digest(documents: DataFrame) -> DataFrame:
    return mix(documents).drop("key")


def mixed_documents(documents: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them; columns stay.

    A row taken k times its size appears k times; what is left over makes one more row
    with that many first words of the text. Rows the mix does not take are left out.
    Of several equal rows, which one is taken more often does not matter.
    """
    named = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("nameless")]
    keys = ["id", "nameless", "key"]
    counts = (
        mix(documents, block, seed)
        .where("taken > 0")
        .select(*named, "key", "taken", "size")
        .groupBy(*keys, "taken", "size")
        .agg(F.count("*").alias("n"))
    )
    # Equal rows are taken all once, all twice and so on, but for the one that is cut: a
    # few outcomes, each for a stretch of their numbers, however many rows there are.
    falling = Window.partitionBy(*keys).orderBy(F.desc("taken"), "size")
    upto = F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcomes = (
        counts.withColumn("upto", upto)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct((F.col("upto") - F.col("n")).alias("from"), "upto", "taken", "size")).alias("all"))
    )
    same = Window.partitionBy(*keys).orderBy(F.lit(0))
    # A row is one value, so no column of its own can be mistaken for one of these.
    rows = (
        documents.select(*named, _row_key().alias("key"), F.struct("*").alias("row"))
        .withColumn("number", F.row_number().over(same))
        .join(outcomes, keys)
        .withColumn(
            "mine",
            F.get(F.filter("all", lambda x: (F.col("number") > x["from"]) & (F.col("number") <= x["upto"])), F.lit(0)),
        )
        .where("mine IS NOT NULL")
        .withColumn("copies", F.expr("mine.taken div mine.size"))
        .withColumn("rest", F.expr("mine.taken % mine.size"))
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies + if(rest > 0, 1L, 0L))")))
    )
    whole = F.col("copy") <= F.col("copies")
    leading = F.concat(
        F.lit(rf"^(?:[{SPACE_CLASS}]*+[^{SPACE_CLASS}]++){{"), F.col("rest").cast("string"), F.lit("}+")
    )
    text = F.when(whole, F.col("row.text")).otherwise(F.regexp_substr("row.text", leading))
    rows = rows.withColumn("text", text)
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])
