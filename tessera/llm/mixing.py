"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

Every source's documents are shuffled by a seeded hash into one word stream,
which is cut into blocks of equal length. Slot i of the schedule is the point
frac(i * golden ratio); mapped through the cumulative shares of the sources it
names a source, and its rank among that source's slots names the block: rank r
takes block r mod n in epoch r div n. Joining slots to blocks and blocks to
documents gives what the mix takes of each document, and in which slots. The
points alone decide: a source gets the slots whose points fall in its interval, so
its words are as near its target as the sequence's discrepancy, a few blocks.

No source is ever gathered in one task: positions in a stream come from sums
over hash buckets and a running sum within a bucket, ranks from counts over
chunks of consecutive slots and a rank within a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.workers import row_key
from tessera.plans.storage import concluded, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 64
SEED = 20
#: Rows of a bucket of a source's stream, and slots of a chunk, on average.
BUCKET_ROWS = 20_000
CHUNK_SLOTS = 4096
_GOLDEN = (math.sqrt(5) - 1) / 2
_JUMP = 1 << 20
#: frac(2**20 * golden ratio), from the exact integer part of 2**84 * golden ratio.
_GOLDEN_JUMP = ((math.isqrt(5 << 168) - (1 << 84)) // 2 % (1 << 64)) / (1 << 64)


def golden_point(i: Column) -> Column:
    """frac(i * golden ratio) for i below 2**40, in two parts so that large i keep their precision."""
    high = F.floor(i / _JUMP)
    return F.pmod(F.pmod(high * F.lit(_GOLDEN_JUMP), F.lit(1.0)) + F.pmod((i - high * _JUMP) * F.lit(_GOLDEN), F.lit(1.0)), F.lit(1.0))


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_no, weight, source_size, target) from rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the
    total of all sizes; a target stops at ``max_epochs`` times its source's size and
    the excess is shared among the others by weight. That level is found in one
    pass over the sources ordered by the level at which each one stops. The
    windows run over one row a source, never over documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = by_source.withColumn("source_no", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_no", F.lit(len(weights))) + 1)
    capped = numbered.withColumn("weight", weight.cast("double")).withColumn("cap", max_epochs * F.col("source_size"))
    before = W.orderBy("stop", "source_no").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = capped.withColumn("stop", F.col("cap") / F.col("weight")).withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    settled = F.when(F.col("stop") >= F.col("level"), F.struct("stop", "source_no", "level"))  # the first in that order holds
    chosen = levels.withColumn("chosen", F.min(settled).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("chosen") * F.col("weight"), F.col("cap").cast("double")))
    return chosen.select("source", "source_no", "weight", "source_size", target.alias("target"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(slot, source_no, rank, block): the mix's blocks in order.

    A source's interval is as long as the slots that its target needs; there are as
    many points as slots in all, to the nearest one. A source's slots beyond
    ``max_epochs`` times its blocks stay unused.
    """
    planned = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long")).select(
        "source_no", "blocks", (F.col("target") / F.col("source_size") * F.col("blocks")).alias("width")
    )
    planned = written(planned.where("width > 0"), "mix-plan")
    total = planned.agg(F.sum("width")).first()[0] or 0.0
    running = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0)  # one row a source
    spans = planned.withColumn("high", F.sum("width").over(running)).withColumn("low", F.lag("high", 1, 0.0).over(W.orderBy("source_no")))
    cells = 4096
    cell = lambda x: F.least(F.floor(x * (cells / total if total else 0.0)), F.lit(cells - 1))
    # a share's interval of [0, total) is listed for each grid cell it touches, so that points find it by an equi-join
    grid = spans.select("source_no", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    point = golden_point(F.col("id")) * total
    points = planned.sparkSession.range(round(total)).select(F.col("id").alias("slot"), point.alias("point"), cell(point).alias("cell"))
    dealt = points.join(grid, "cell").where("point >= low AND point < high").select(
        "slot", "source_no", "blocks", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk")
    )
    counts = dealt.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = dealt.join(bases, ["source_no", "chunk"]).withColumn("rank", F.col("base") + within)
    used = ranked.where(F.col("rank") < max_epochs * F.col("blocks"))
    return used.select("slot", "source_no", "rank", F.pmod("rank", F.col("blocks")).alias("block"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row a row of ``docs``: id_col, size, source_size, target, taken, first_slot, slots, last_slot, row_hash.

    ``taken`` counts the words that the schedule takes of the document, repeats
    included; it never exceeds ``max_epochs`` times the size. ``slots`` are those of
    the block in which the document begins, one a use; ``first_slot`` and
    ``last_slot`` bound all in which it is taken. ``row_hash`` is ``row_key``. Null and
    empty texts have size 0 and give nothing; a null source is a source of its own;
    repeated rows are documents of their own. The order of a stream depends on the
    seed, ids, texts and sources alone, so reruns agree; rows equal in all of them are
    interchangeable.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col))
    sized = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), row_key(docs).alias("row")
        ),
        "mix-sizes",
    )
    sources = written(targets(sized, weights, max_epochs), "mix-sources")
    bits = max(6, math.ceil(math.log2(max(1, sized.count() / BUCKET_ROWS))))
    known = sources.select(F.col("source").alias("s"), "source_no", "source_size", "target")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    order = W.partitionBy("source_no", "bucket").orderBy("key", "id", "size", "row")
    placed = rows.join(bases, ["source_no", "bucket"]).withColumn("nth", F.row_number().over(order)).withColumn(
        "start", F.col("base") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    )
    uses = schedule(sources, block_words, max_epochs).groupBy("source_no", "block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # one a use, few
    first_block = F.floor(F.col("start") / block_words)
    blocks = F.when(F.col("size") > 0, F.sequence(first_block, F.floor((F.col("start") + F.col("size") - 1) / block_words)))
    pieces = placed.withColumn("first_block", first_block).withColumn("block", F.explode_outer(blocks))
    a = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    b = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    got = pieces.join(uses, ["source_no", "block"], "left")
    n = F.coalesce(F.size("slots"), F.lit(0))
    taken = got.groupBy("source_no", "bucket", "nth", "key", "row", "id", "size", "source_size", "target").agg(
        F.sum(F.when(n > 0, n * (b - a)).otherwise(0)).alias("taken"), F.min(F.get("slots", F.lit(0))).alias("first_slot"),
        F.max(F.when(F.col("block") == F.col("first_block"), F.col("slots"))).alias("slots"), F.max(F.get("slots", n - 1)).alias("last_slot"),
    )
    return taken.select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_slot",
        F.coalesce("slots", F.array().cast("array<bigint>")).alias("slots"), "last_slot", F.col("row").alias("row_hash"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each document as many times as its taken words, to the nearest whole copy, in slot order.

    A copy stands at the slot that takes the document's beginning, a further one at
    the last slot that takes of it; partitions hold ascending ranges of slots. Rows
    are told apart by all their columns, and rows equal in all come as often as they do.
    """
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    at = F.transform(F.sequence(F.lit(0), copies - 1), lambda k: F.coalesce(F.get("slots", k), F.col("last_slot")))

    def places() -> DataFrame:
        used = mix(docs, id_col, text_col, source_col).where(copies > 0)
        return used.groupBy(F.col("row_hash").alias("__tessera_key")).agg(F.flatten(F.collect_list(at)).alias("__tessera_at"))

    found = concluded(docs.sparkSession, "mix-places", places)
    once = docs.withColumn("__tessera_row", row_key(docs)).dropDuplicates(["__tessera_row"])
    met = once.join(found.hint("merge"), F.col("__tessera_row") == F.col("__tessera_key")).withColumn("__tessera_slot", F.explode("__tessera_at"))
    return met.repartitionByRange("__tessera_slot").sortWithinPartitions("__tessera_slot", "__tessera_row").select(*docs.columns)
