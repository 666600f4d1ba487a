"""Mixing sources to target weights: rates from source totals, whole repeats plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pick, word_count

#: Denominator of the draws: 13 hexadecimal digits.
DRAW = 2**52
#: Sources up to which the targets are broadcast.
MOST_BROADCAST = 100_000


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the seed, the id and the text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / DRAW


def source_targets(totals: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """Targets of sources from (source, source_size), a row for each source.

    Sources in code point order, null last, get ``weights`` in turn and share ``budget`` times all sizes by weight; a
    target stops at ``cap`` times its source's size, and what is over goes to the others by weight until none is above.
    That is one level L with target = min(weight * L, cap * size): in order of cap * size / weight, a source is capped
    if the level that remains after capping all before it reaches it. If no source has any words, all targets are 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", cases).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("left", F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("most"))
    )
    # Capped sources come first in this order; the first source that isn't has the level of all that follow.
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(whole)
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _repeats(rows: DataFrame, totals: DataFrame, weights, budget: float, cap: float) -> DataFrame:
    """``rows`` (source, draw, ...) with source_size, target and copies."""
    if not weights or min(weights) <= 0 or budget < 0 or cap <= 0 or budget > cap:
        raise ValueError("weights must be positive, and 0 <= budget <= cap")
    targets = checkpoint(source_targets(totals, tuple(weights), budget, cap)).withColumnRenamed("source", "target_source")
    if targets.count() <= MOST_BROADCAST:
        targets = F.broadcast(targets)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    extra = (F.col("draw") < rate - F.floor(rate)).cast("long")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
    return joined.withColumn("copies", F.floor(rate) + extra).drop("target_source", "draw")


def mix_counts(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Each document with how often the mix takes it: floor(rate) copies plus a Bernoulli draw on the fraction.

    The rate of a source is its target over its size. The draw is a hash of the seed, the id and the text, so reruns
    agree and the layout of the input has no effect; rows alike in id and text share one draw. Documents without
    words (null, empty, white space) are repeated at their source's rate as well, and count no words. A null source is
    a source of its own; an empty table gives an empty result; other columns are ignored.

    Returns doc_id, source, size, source_size, target, copies. Totals are summed before they are shuffled, so a hot
    source costs one row for each task; the windows run over one row for each source, and the targets are broadcast
    only up to ``MOST_BROADCAST`` sources, beyond which they are joined by a shuffle.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = checkpoint(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("draw")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return _repeats(rows, totals, weights, budget, cap)


def mix_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, repeated as :func:`mix_counts` says."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text, source = (F.col(f"_c{names.index(c)}") for c in (id_col, text_col, source_col))
    totals = flat.groupBy(source.alias("source")).agg(F.sum(word_count(text)).alias("source_size"))
    rows = flat.select(F.struct(*flat.columns).alias("row"), source.alias("source"), draw(seed, doc_id, text).alias("draw"))
    mixed = _repeats(rows, totals, weights, budget, cap).where("copies > 0")
    copies = mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("row.*").toDF(*names)
