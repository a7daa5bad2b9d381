"""Line dedup with content-defined chunks of lines, by DataFrame functions only.

Lines without a word aside, a rolling window over the hashes of two neighbouring lines tells
whether the gap between them is a boundary, in each of ``CHUNKINGS`` chunkings at once. A
line's hash gives it a code of as many bits, half of them set; chunking k holds two lines
together if bit k is unset in the first one's code and set in the second's, and has a
boundary in every other gap. So a chunk has one line or two, and as the window looks at the
lines of the chunk alone, it is found wherever they stand: an inserted or missing line moves
the boundaries next to it and no others. No code holds another, so two neighbours with
different codes are a chunk in some chunking; only equal codes, one pair in 70, are not.

Chunks of two lines that occur again anywhere in the corpus are compared byte by byte, and
the lines of all but the first occurrence (smallest doc_id, then place) are taken out. What
a line loses its place to comes strictly before it, so of equal lines one always stays.
Joins are merge joins at every size, as what repeats grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import WORD, drop_stored, nested, own, stored

CHUNKINGS = 8
#: The codes: numbers of so many bits, half of them set.
CODES = [c for c in range(1 << CHUNKINGS) if c.bit_count() * 2 == CHUNKINGS]
HEX = "0123456789abcdef"


def code(line: Column) -> Column:
    """The code of a line, from the first two digits of its md5."""
    digit = lambda k: F.instr(F.lit(HEX), F.substring(F.md5(line), k, 1)) - 1
    return F.get(F.array(*[F.lit(c) for c in CODES]), (digit(1) * 16 + digit(2)) % len(CODES))


def _fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column computed once a row: behind a generator the optimizer can't copy it into lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def chunks(docs: DataFrame) -> DataFrame:
    """(id, th, a, b, ch) of the two-line chunks of all chunkings, each once: numbers of the two lines and the md5 of their text. Null texts have none."""
    texts = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.md5("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    full = _fixed(texts, "full", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(WORD)))
    coded = _fixed(full, "codes", F.transform("full", lambda i: code(F.get("lines", i))))
    gaps = F.when(F.size("full") > 1, F.sequence(F.lit(0), F.size("full") - 2)).otherwise(F.array().cast("array<int>"))
    held = F.filter(gaps, lambda k: F.bitwise_not(F.get("codes", k)).bitwiseAND(F.get("codes", k + 1)) != 0)  # the chunkings without a boundary there
    chunk = lambda k: F.struct(F.get("full", k).alias("a"), F.get("full", k + 1).alias("b"))
    rows = coded.select("id", "th", "lines", F.inline(F.transform(held, chunk)))
    return rows.select("id", "th", "a", "b", F.md5(_text()).alias("ch"))


def _text() -> Column:
    """The two lines of a chunk, from lines, a and b."""
    return F.concat(F.get("lines", F.col("a")), F.lit("\n"), F.get("lines", F.col("b")))


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("a").alias("a"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(id, th, a, b) of the chunks to take out: occurrences other than the first. Chunks of one md5 whose bytes differ all stay."""
    every = stored(chunks(docs))
    again = stored(every.groupBy("ch").agg(F.count("*").alias("n")).where("n > 1").select("ch"))  # a table, so that the join's hot keys can be split
    found = stored(every.join(again.hint("merge"), "ch"))
    drop_stored(every)
    of = found.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b", "ch")).alias("of")).withColumnsRenamed({"id": "of_id", "th": "of_th"})
    texts = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.md5("text").alias("th"), "text")
    read = texts.join(of.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")))
    again_read = read.select("id", "th", F.split("text", "\n", -1).alias("lines"), F.inline("of")).select(_place().alias("place"), "ch", _text().alias("text"))
    same = stored(again_read.groupBy("ch").agg(F.min("place").alias("first"), F.min("text").alias("least"), F.max("text").alias("most")).where("least = most").select("ch", "first"))
    return found.join(same.hint("merge"), "ch").where(~_place().eqNullSafe(F.col("first"))).select("id", "th", "a", "b")


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the lines of repeated chunks taken out of text, and n_lines and n_removed (long) added.

    Lines without a word between the two lines of a chunk go with them; others stay, as does a
    line that repeats alone. A null text stays null with n_lines 0; a text all of whose lines
    are taken becomes empty. Rows that repeat both doc_id and text share one place, so that
    all keep or all lose a chunk; a null doc_id comes after all others. An empty table gives
    an empty result. n_lines and n_removed of ``docs`` itself, if there, are replaced; other
    columns may have any name.
    """
    gone = repeated_chunks(docs).groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("a", "b")))).alias("gone"))
    kept = docs.select(*[own(docs, c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    rows = nested(kept, "doc_id", "text").select("row", "doc_id", "text", F.md5("text").alias("row_th"))
    joined = rows.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_th") == F.col("th")), "left")
    cut = _fixed(joined, "lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = cut.select("row", text.alias("cut"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out.select(*[F.col("cut").alias(c) if c == "text" else own_of(c) for c in kept.columns], "n_lines", "n_removed")


def own_of(name: str) -> Column:
    """A column of the nested row."""
    return F.col("row").getField(name).alias(name)
