"""Chat formatting with a template that is only ever called, never looked into.

Successive prefixes of a conversation are rendered. If each output continues the one before it, the
new part is the turn's span; two probe texts that differ in one character show where in it the text
stands. A template whose output changes text of earlier turns is reported, not masked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
# Turns whose prefixes one task renders; a longer conversation goes to as many tasks as it takes.
BLOCK = 512
PROBES = "\u0001", "\u0002"

Turn = tuple[str, str]


def escaped(text: str) -> str:
    """Reversible: no control string is left inside."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: each turn between marks, control strings inside texts and roles escaped."""
    return "".join(f"{START}{escaped(role).replace(chr(10), chr(92) + 'n')}\n{escaped(text)}{STOP}\n" for role, text in turns)


def parse_marked(output: str) -> list[Turn]:
    """Turns of an output of `marked_turns`."""
    turns = []
    for part in output.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescaped(role), unescaped(rest.removesuffix(f"{STOP}\n"))))
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _text_place(render: Callable[[list[Turn]], str], before: list[Turn], role: str, output: str) -> tuple[int, int] | None:
    """Start and end of the last turn's text in ``output``; None if the template doesn't show it plainly."""
    one, two = (render([*before, (role, p)]) for p in PROBES)
    start = _common(one, two)
    tail = len(one) - start - 1
    if one[start:start + 1] != PROBES[0] or one[start + 1:] != two[start + 1:]:
        return None
    if output[:start] != one[:start] or output[len(output) - tail:] != one[start + 1:] or start + tail > len(output):
        return None
    return start, len(output) - tail


def locate(render: Callable[[list[Turn]], str], turns: list[Turn], first: int = 0, stop: int | None = None) -> tuple[str, list, int | None]:
    """Output of the prefix that ends before turn ``stop``, (start, end, text start, text end) of the turns from ``first`` on,
    and the first of them that rewrites history: spans from that turn on are missing, a mask over them
    could not be trusted.

    Every prefix is rendered as a whole, so what the turns before ``first`` do is left to other calls.
    """
    spans: list[tuple[int, int, int | None, int | None]] = []
    stop = len(turns) if stop is None else stop
    previous = render(turns[:first]) if first else ""
    for k in range(first, stop):
        output = render(turns[:k + 1])
        if not output.startswith(previous):
            return (render(turns[:stop]) if k + 1 < stop else output), spans, k
        place = _text_place(render, turns[:k], turns[k][0], output)
        spans.append((len(previous), len(output), *(place or (None, None))))
        previous = output
    return previous, spans, None


def format_conversations(turns: DataFrame, render: Callable[[list[Turn]], str] = marked_turns, trained: tuple[str, ...] = ("assistant",),
                         block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): conv_id, formatted, n_turns,
    loss (start and end of the text of every trained turn, in characters), rewrites (number of the
    first turn whose rendering changes earlier text, else null; later turns have no loss).

    Turns are ordered by turn, then role and text, missing turn numbers first; a null role or text
    counts as empty; repeated rows are turns of their own; rows without conv_id form one conversation.
    An empty table gives no rows. All prefixes are rendered, those of ``block`` turns in one task, and the
    findings about a conversation are joined; its turns and its output must fit in a task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, loss, rewrites = [], [], []
            for own, part in zip(batch.column("turns").to_pylist(), batch.column("part").to_pylist()):
                pairs = [(t["role"], t["text"]) for t in own]
                stop = min(len(pairs), (part + 1) * block)
                output, spans, changed = locate(render, pairs, part * block, stop)
                outputs.append(output if stop == len(pairs) else None)
                loss.append([{"turn": k, "start": s[2], "end": s[3]} for k, s in enumerate(spans, part * block) if pairs[k][0] in trained and s[2] is not None])
                rewrites.append(changed)
            span = pa.struct([("turn", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(outputs, pa.string()), batch.column("n_turns"), pa.array(loss, pa.list_(span)), pa.array(rewrites, pa.int32())],
                ["conv_id", "formatted", "n_turns", "loss", "rewrites"])

    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = grouped.withColumn("n_turns", F.size("turns").cast("long")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_turns - 1) div {block}"))))
    kind = turns.schema["conv_id"].dataType.simpleString()
    found = parts.repartition("conv_id", "part").mapInArrow(
        run, f"conv_id {kind}, formatted string, n_turns long, loss array<struct<turn: long, start: long, end: long>>, rewrites int")
    return found.groupBy("conv_id").agg(
        F.first("formatted", ignorenulls=True).alias("formatted"), F.first("n_turns").alias("n_turns"),
        F.sort_array(F.flatten(F.collect_list("loss"))).alias("loss"), F.min("rewrites").alias("rewrites")).select(
        "conv_id", "formatted", "n_turns",
        F.transform(F.filter("loss", lambda s: F.coalesce(s["turn"] < F.col("rewrites"), F.lit(True))),
                    lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"), "rewrites")


def read_back(formatted: DataFrame, parse: Callable[[str], list[Turn]] = parse_marked) -> DataFrame:
    """Digests of what an output of `format_conversations` still holds: the turns, parsed from the output,
    and the text under the loss mask, unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for output, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parse(output)
                said = "".join(unescaped(output[s["start"]:s["end"]]) for s in loss)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                             len(said), hashlib.sha256(said.encode()).hexdigest(), len(output)))
            n, all_, chars, said, size = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(all_, pa.string()), pa.array(chars, pa.int64()),
                 pa.array(said, pa.string()), pa.array(size, pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
