"""Tokens of answers as a stream, without a JSON object that comes before the prose.

A model may put the result of a tool before its answer.  Tokens are held back
while they may be such a preface, and released once it is clear that they are
not, or that enough prose follows; at the end of an answer, or when it is idle, what
is held is judged as a whole.  The text that comes out is that of ``after_json``
for the whole answer, however it was split into tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Characters of prose that must follow a preface.
LEAST = 20
#: Groups of answers that share a state; a stream keeps the number that it began with.
BUCKETS = 1024


class Held(NamedTuple):
    """What is held of an answer, and where its scan stands: in how many braces, in a string, behind a backslash."""

    text: str = ""
    scanned: int = 0
    depth: int = 0
    quoted: bool = False
    escaped: bool = False
    end: int = 0
    live: bool = False


def feed(held: Held, token: str, least: int = LEAST) -> tuple[Held, str]:
    """The state after a token, and what is released."""
    if held.live:
        return held, token
    text, at, depth, quoted, escaped, end, _ = held._replace(text=held.text + token)
    if not depth and not end:
        at = len(text) - len(text.lstrip())
        if at == len(text):
            return Held(text), ""
        if text[at] != "{":
            return Held(live=True), text
    while not end and at < len(text):
        c = text[at]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            end = at + 1 if not depth else 0
        at += 1
    if end and len(rest := text[end:].lstrip()) > least:
        return Held(live=True), rest
    return Held(text, at, depth, quoted, escaped, end), ""


def flush(held: Held) -> str:
    """What is left at the end of an answer: all that is held, as too little prose follows for it to be a preface."""
    return "" if held.live else held.text


def _stream(idle_ms: int | None, least: int):
    """Feeds the tokens of a bucket's answers in order; flushes each at its last one, or after ``idle_ms`` without one."""

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Of each open answer: what is held, its last seq, and when it is idle (never: 0).
        open_ = {a: (Held(*held), seq, until) for a, *held, seq, until in zip(*state.get)} if state.exists else {}
        out, now = [], 0 if idle_ms is None else state.getCurrentProcessingTimeMs()
        for answer, (held, seq, until) in open_.items():
            if 0 < until <= now:
                out.append((answer, seq, flush(held)))
                # Later tokens of an answer that was flushed are shown as they come.
                open_[answer] = (Held(live=True), seq, 0)
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            ended = set()
            for answer, seq, token, last in zip(*(rows[c].tolist() for c in ("answer", "seq", "token", "last"))):
                answer = answer if isinstance(answer, str) else None
                held, before, _ = open_.get(answer, (Held(), -1, 0))
                if seq <= before:  # repeated by the source
                    continue
                held, text = feed(held, token if isinstance(token, str) else "", least)
                if last:
                    ended.add(answer)
                out.append((answer, seq, text + flush(held) if last else text))
                open_[answer] = (held, int(seq), 0 if idle_ms is None else now + idle_ms)
            for answer in ended:
                del open_[answer]
        if open_:
            state.update(tuple(map(list, zip(*((a, *held, seq, until) for a, (held, seq, until) in open_.items())))))
            if waits := [until for _, _, until in open_.values() if until]:
                state.setTimeoutDuration(max(min(waits) - now, 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([o for o in out if o[2]], columns=["answer", "seq", "text"])

    return run


def released(events: DataFrame, idle_ms: int | None = None, least: int = LEAST) -> DataFrame:
    """``answer, seq, text`` of a stream ``events(answer, seq, token, last)``: the pieces of each answer to be shown.

    ``seq`` counts an answer's tokens from 0; those of one batch may come in any
    order, and a repeated one counts once.  A null token is empty.  ``answer`` is a
    string or a type that casts to one and back.  An answer's state is what is
    held of it, and goes with its last token; answers share the state of their
    bucket of ``BUCKETS``, as a call for each answer costs more than its tokens.
    ``idle_ms`` is for streams that run on: one that is to end with its input never
    would, as Spark goes on for the sake of times that may run out.
    """
    kind = events.schema["answer"].dataType.simpleString()
    held = "answer array<string>, text array<string>, scanned array<int>, depth array<int>, quoted array<boolean>, escaped array<boolean>, end array<int>, live array<boolean>, seq array<long>, until array<long>"
    rows = events.select(F.col("answer").cast("string").alias("answer"), "seq", "token", "last")
    buckets = rows.withColumn("bucket", F.pmod(F.xxhash64("answer"), F.lit(BUCKETS)).cast("int")).groupBy("bucket")
    out = buckets.applyInPandasWithState(_stream(idle_ms, least), "answer string, seq long, text string", held, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(F.col("answer").cast(kind).alias("answer"), "seq", "text")
