"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. The turns of a conversation are rendered
prefix by prefix: what a turn adds to the output before it is its span, and an output that
does not begin with the one before it shows a template that rewrites history. Where a turn's
own text lies in its span is found by rendering two probes in its place.

A conversation of more than ``CUT`` turns is rendered in segments, each behind the few turns
that its template can look back at, so neither a worker's memory nor the cost of the
prefixes grows with the conversation.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import own, stored

#: Turns of a segment.
CUT = 32

Turn = tuple[str, str]


class Template(NamedTuple):
    """``reach``: how many earlier turns the output of a turn may depend on or change; None if that is unknown.

    With None a conversation is never cut, and must fit a worker.
    """

    render: Callable[[list[Turn]], str]
    parse: Callable[[str], Iterable[Turn]]
    unescape: Callable[[str], str]
    reach: int | None = None


_OPEN, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_ROLE, _UNROLE = {"\\": r"\\", "\n": r"\n", "|": r"\p"}, {r"\\": "\\", r"\n": "\n", r"\p": "|"}


def escape(text: str) -> str:
    """A text without ``<|``, from which unescape() gets the text back: a backslash more between ``<`` and ``|``."""
    return _OPEN.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text) if "<" in text else text


def _role(role: str) -> str:
    return re.sub(r"[\\\n|]", lambda m: _ROLE[m[0]], role)


def chatml_render(turns: list[Turn]) -> str:
    return "".join([f"<|im_start|>{_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns])


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def chatml_parse(formatted: str) -> Iterator[Turn]:
    """The turns of an output of chatml_render()."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        yield re.sub(r"\\[\\np]", lambda x: _UNROLE[x[0]], m[1]), unescape(m[2])
        at = m.end()


CHATML = Template(chatml_render, chatml_parse, unescape, reach=1)


class Located(NamedTuple):
    formatted: str
    spans: list[dict]
    rewritten_at: int | None


def locate(render: Callable[[list[Turn]], str], turns: list[Turn], context: int = 0, loss_roles: frozenset[str] = frozenset({"assistant"})) -> Located:
    """What ``turns[context:]`` add to the output of ``turns[:context]``, and where.

    Spans have start, end, loss_start and loss_end in code points of the added output; the
    latter two are null for a role without loss and for a turn whose probes do not show where
    its text lies. If a turn changes the output before it, ``rewritten_at`` is its place among
    ``turns[context:]``, the output is that of all turns from the first changed character or
    the end of the context on, whichever is earlier, and no span is given.
    """
    before = render(turns[:context]) if context else ""
    base, spans = len(before), []
    for k in range(context, len(turns)):
        out = render(turns[: k + 1])
        if not out.startswith(before):
            whole, old = render(turns), render(turns[:context]) if context else ""
            return Located(whole[len(os.path.commonprefix([whole, old])) :], [], k - context)
        start, loss = len(before), None
        if turns[k][0] in loss_roles:
            one, two = (render([*turns[:k], (turns[k][0], probe)]) for probe in "ab")
            if one.startswith(before) and two.startswith(before):
                head = start + len(os.path.commonprefix([one[start:], two[start:]]))
                tail = len(one) - head - 1
                shown = one[head : head + 1] == "a" and one[head + 1 :] == two[head + 1 :] and head + tail <= len(out)
                if shown and out[start:head] == one[start:head] and out[len(out) - tail :] == one[head + 1 :]:
                    loss = (head - base, len(out) - tail - base)
        spans.append({"role": turns[k][0], "start": start - base, "end": len(out) - base, "loss_start": loss and loss[0], "loss_end": loss and loss[1]})
        before = out
    return Located(before[base:], spans, None)


SPANS = "array<struct<role:string,start:long,end:long,loss_start:long,loss_end:long>>"
SCHEMA = f"conv_id long, segment long, n_turns long, formatted string, spans {SPANS}, rewritten_at long"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))), ("rewritten_at", pa.int64()),
])
#: Characters of output after which a worker passes on what it has.
_FLUSH = 4_000_000


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows that agree in ``keys``, across batches."""
    now, rows = None, []
    for b in batches:
        for at in range(0, b.num_rows, 500):
            for r in b.slice(at, 500).to_pylist():
                key = tuple(r[k] for k in keys)
                if key != now:
                    if rows:
                        yield now, rows
                    now, rows = key, []
                rows.append(r)
    if rows:
        yield now, rows


def _render(batches: Iterator[pa.RecordBatch], template: Template, loss_roles: frozenset[str]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for (conv, segment), rows in _groups(batches, "conv_id", "segment"):
        context = sum(r["context"] for r in rows)
        if context == len(rows):
            continue
        found = locate(template.render, [(r["role"], r["text"]) for r in rows], context, loss_roles)
        out.append({"conv_id": conv, "segment": segment, "n_turns": len(rows) - context, "formatted": found.formatted, "spans": found.spans, "rewritten_at": None if found.rewritten_at is None else segment * CUT + found.rewritten_at})
        held += len(found.formatted)
        if held > _FLUSH or len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, _ARROW)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def _in_order(turns: DataFrame, *first: str) -> DataFrame:
    return turns.repartition(*first).sortWithinPartitions(*first, F.col("turn").asc_nulls_last(), "role", "text")


def _cut(long: DataFrame, reach: int) -> DataFrame:
    """``long`` with the number of each turn's segment, the last ``reach`` turns before a segment once more as its context.

    Turns are numbered without bringing a conversation into one task: rows are dealt out by
    ranges of conversation and turn, counted in each range, and the ranges of a conversation
    (their number does not depend on its length) are summed up.
    """
    ranged = long.repartitionByRange("conv_id", F.col("turn").asc_nulls_last(), "role", "text").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    placed = stored(ranged.select("*", F.monotonically_increasing_id().alias("at"))).select("*", F.shiftright("at", 33).alias("range"))
    counts = placed.groupBy("conv_id", "range").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    sofar = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("conv_id").alias("of"), F.col("range").alias("of_range"), "lo", F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias("sofar"))
    number = F.col("at") - F.col("lo") + F.col("sofar")
    numbered = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range"))).select("conv_id", "turn", "role", "text", F.floor(number / CUT).alias("segment"), (number % CUT >= CUT - reach).alias("last"))
    places = F.array(F.struct("segment", F.lit(False).alias("context")), F.struct((F.col("segment") + 1).alias("segment"), F.lit(True).alias("context")))
    return numbered.select("conv_id", "turn", "role", "text", F.inline(F.filter(places, lambda p: ~p.context | F.col("last"))))


def formatted(conversations: DataFrame, template: Template = CHATML, loss_roles: frozenset[str] = frozenset({"assistant"})) -> tuple[DataFrame, DataFrame]:
    """Conversations as (whole, cut): those in one segment, and the segments of longer ones; columns as in SCHEMA.

    The output of a conversation is its segments one after another. ``spans`` has the place of
    each turn in its segment and of the text that counts for the loss (see locate()), and
    ``rewritten_at`` the first turn that changed the output before it, null if none did.
    Turns come by ``turn``, null last, ties by role and text. A null text or role is empty;
    rows without a conv_id are one conversation. Other columns are ignored. An empty table
    gives no row. Which conversations are long is counted without reading a text.
    """
    turns = conversations.select(own(conversations, "conv_id").cast("long").alias("conv_id"), own(conversations, "turn").alias("turn"), *[F.coalesce(own(conversations, c), F.lit("")).alias(c) for c in ("role", "text")])
    run = lambda batches: _render(batches, template, loss_roles)
    as_one = lambda df: df.select("*", F.lit(0).cast("long").alias("segment"), F.lit(False).alias("context"))
    if template.reach is None:
        return _in_order(as_one(turns), "conv_id").mapInArrow(run, SCHEMA), turns.sparkSession.createDataFrame([], SCHEMA)
    if template.reach > CUT:
        raise ValueError("a template that looks back further than a segment must not be cut: reach=None")
    many = stored(turns.groupBy("conv_id").count().where(F.col("count") > CUT).select(F.col("conv_id").alias("of")))
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    whole = _in_order(as_one(turns.join(many, same, "left_anti")), "conv_id")
    cut = _in_order(_cut(turns.join(many, same, "left_semi"), template.reach), "conv_id", "segment")
    return whole.mapInArrow(run, SCHEMA), cut.mapInArrow(run, SCHEMA)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    def row(conv, n, turns, chars, loss, size):
        return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

    def segments():
        for b in batches:
            for at in range(0, b.num_rows, 100):
                yield from b.slice(at, 100).select(["conv_id", "formatted", "spans"]).to_pylist()

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    out, state = [], None
    for s in segments():
        if state is None or state[0] != s["conv_id"]:
            if state:
                out.append(row(*state))
            state = [s["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        for role, text in template.parse(s["formatted"]):
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in s["spans"]:
            if span["loss_start"] is not None:
                text = template.unescape(s["formatted"][span["loss_start"] : span["loss_end"]])
                state[3] += len(text)
                state[4].update(text.encode("utf-8", "surrogatepass"))
        state[5] += len(s["formatted"])
    if state:
        out.append(row(*state))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def read_back(outputs: tuple[DataFrame, DataFrame], template: Template = CHATML) -> DataFrame:
    """Digests of each conversation, from the outputs of formatted() alone: its turns by parsing, its loss text by the mask.

    A digest is a chain over the whole conversation, so the segments of a long one are read in
    order by one task, which holds a segment at a time.
    """
    whole, cut = outputs
    run = lambda batches: _read(batches, template)
    ordered = cut.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return whole.mapInArrow(run, READ).unionByName(ordered.mapInArrow(run, READ))
