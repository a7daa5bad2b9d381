"""Mixing sources to target weights: whole copies by rate, the fraction by a seeded coin.

Sizes are summed by source, targets follow from the weights, and a source's repetition
rate is target / size. Each document comes floor(rate) times, and once more with the fraction
of the rate as the probability. The coins of a source are spread evenly: its documents stand in
order of size, those of one size by the hash of seed and id, and the hash of seed and source
says where a step of 1 / fraction along that order begins. So each document's probability is
that of a coin of its own, but a source misses its target by one of its largest documents at
most, not by what its large documents happen to add up to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import nested, own, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of a text's md5; the same on every run."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """What tells the coins of documents apart: a hash of seed and id, or of the text of a document without an id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) rows -> (source, source_size, target, rate), one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share``
    of the whole size. A target stops at ``most`` times its source's size and the excess is
    shared anew by weight until none is above. That fixed point needs no loop: in order of
    most * size / weight, sources are full as long as that ratio lies below what one unit
    of weight gets of the size that is left. The ordered steps see one row a source.
    A source of size 0 has target and rate 0.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    weighed = summed.select("source", "source_size", turn.alias("weight")).select("*", (F.col("source_size") * most).alias("cap"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    sofar = full.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(all_) * share - F.coalesce(F.sum("cap").over(sofar), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(sofar), F.lit(0.0))).alias("of"),
    ).select("*", (F.col("cap") / F.col("weight") < F.col("left") / F.col("of")).alias("full"))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), (F.col("left") / F.col("of")).alias("level")))).over(all_)
    level = left.select("*", first.alias("first"))
    open_ = F.col("cap") / F.col("weight") >= F.col("first.ratio")
    target = F.when(open_, F.least(F.col("weight") * F.col("first.level"), F.col("cap"))).otherwise(F.col("cap"))
    return level.select("source", "source_size", target.alias("target")).select("*", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def _placed(sized: DataFrame) -> DataFrame:
    """The coins of ``sized`` (source, size, coin), each once, with their place in the order of their source, from 0.

    Places come without a source in one task: coins are dealt out by ranges of the whole
    order and counted in each range, and the ranges of a source are summed up.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("coin")]
    ranged = sized.select("source", "size", "coin").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(ranged.select("*", F.monotonically_increasing_id().alias("at"))).select("*", F.shiftright("at", 33).alias("part"))
    counts = dealt.groupBy("source", "part").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    sofar = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    starts = counts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), "lo", F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias("sofar"))
    met = dealt.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return met.select("source", "size", "coin", (F.col("at") - F.col("lo") + F.col("sofar")).alias("k"))


def _copies(sized: DataFrame, weights: Sequence[int], share: float, most: float, seed: str) -> DataFrame:
    """Each coin of ``sized`` with its source's source_size and target and the copies it gives: (of, of_size, of_coin, source_size, target, copies)."""
    rates = targets(sized.select("source", "size"), weights, share, most).withColumnRenamed("source", "of")  # one row a source
    k, whole, start = F.col("k"), F.floor("rate"), uniform(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("null"))))
    part = F.col("rate") - whole
    again = F.floor((k + 1) * part + start) - F.floor(k * part + start)
    rated = _placed(sized).join(rates, F.col("source").eqNullSafe(F.col("of")))
    return rated.select("of", F.col("size").alias("of_size"), F.col("coin").alias("of_coin"), "source_size", "target", (whole + again).cast("long").alias("copies"))


def _flipped(rows: DataFrame, given: DataFrame) -> DataFrame:
    """Rows with source, size and coin beside what their coins give."""
    same = (F.col("coin") == F.col("of_coin")) & (F.col("size") == F.col("of_size")) & F.col("source").eqNullSafe(F.col("of"))
    return rows.join(given, same)


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    Size is the number of words, 0 for a null, empty or blank text. Rows of a source that repeat
    a doc_id and a size share a coin, as do rows without an id that repeat a text. A null
    source is a source of its own, the last. Other columns, whatever their names, are ignored.
    An empty table gives an empty result.
    """
    text = own(docs, "text")
    sized = stored(docs.select(own(docs, "doc_id").alias("doc_id"), own(docs, "source").alias("source"), word_count(text).alias("size"), coin(own(docs, "doc_id"), text, seed).alias("coin")))
    return _flipped(sized, _copies(sized, weights, share, most, seed)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan says; the columns of ``docs``, whatever their names.

    Nulls, empty texts, repeated rows and ids: see mix_plan(). A source without a word has rate
    0, so none of its rows comes. An empty table gives an empty result.
    """
    rows = nested(docs, "doc_id", "source").select("row", "source", word_count(F.col("row.text")).alias("size"), coin(F.col("doc_id"), F.col("row.text"), seed).alias("coin"))
    sized = stored(rows.select("source", "size", "coin"))
    counted = _flipped(rows, _copies(sized, weights, share, most, seed).where("copies > 0")).select("row", "copies")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
