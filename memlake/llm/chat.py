"""Chat formatting into budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose each window's last
turn; a window begins with the conversation's system turn and a limited number of turns before its first new
one. Repeated turns carry no loss, so each assistant text is under the loss mask exactly once.

A turn reads ``### role``, a line feed, the escaped text, ``</turn>`` and a line feed. In texts and roles a
backslash is put before each backslash and before ``###`` and ``</turn>``, so markers can't be forged and
``unescape`` gives back the text. Rows of a conversation are sorted by Spark and go through the formatter as a
stream, so a conversation of any length takes the memory of one window.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .packing import word_ids

#: Tokens of a window, and turns of history that are repeated at most.
BUDGET = 1024
HISTORY = 2

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
WINDOWS = "conv_id long, window int, text string, spans array<struct<start:int,end:int>>, repeated int"


def count_tokens(text: str, tokenizer: str) -> int:
    """Ids of a text by the vocabulary at path ``tokenizer``; the markers of a turn count too."""
    return len(word_ids(tokenizer)(text)) // 4


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = "### " + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + "</turn>\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """role, text, and where the escaped text begins and ends, of each turn of a window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


class Windows:
    """Takes a conversation's turns one by one and gives its windows: (text, spans, repeated)."""

    def __init__(self, count: Callable[[str], int], budget: int = BUDGET, history: int = HISTORY):
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple | None = None
        self.before: list[tuple] = []
        self.new: list[tuple] = []
        self.started = False

    def add(self, role: str, text: str) -> list[tuple]:
        made, begin, end = format_turn(role, text)
        turn = (made, begin, end, role == "assistant", self.count(made))
        done = []
        if self.started is False and role == "system":
            self.system = turn
        head = (self.system[4] if self.system and self.new[:1] != [self.system] else 0) + sum(t[4] for t in self.before)
        sums = list(accumulate((t[4] for t in [*self.new, turn]), initial=head))
        if self.new and bisect_right(sums, self.budget) - 1 < len(self.new) + 1:
            done.append(self.close())
        self.started = True
        self.new.append(turn)
        return done

    def close(self) -> tuple:
        """The window of the turns so far; the next begins with the history it may repeat, if that leaves room."""
        first = bool(self.system) and self.new[:1] == [self.system]
        repeated = ([self.system] if self.system and not first else []) + self.before
        out, spans, at = [], [], 0
        for k, (made, begin, end, loss, _) in enumerate([*repeated, *self.new]):
            if loss and k >= len(repeated):
                spans.append((at + begin, at + end))
            out.append(made)
            at += len(made)
        last = [t for t in [*self.before, *self.new] if t is not self.system][-self.history :] if self.history else []
        while last and sum(t[4] for t in last) * 4 > self.budget:
            last.pop(0)
        self.before, self.new = last, []
        return "".join(out), spans, len(repeated)


def format_conversations(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, spans (the loss mask: code points start to end), repeated (turns at its head that came before).

    Turns are in the order of turn, role and text, nulls first; rows that repeat a turn are turns of their
    own. A null text or role is empty. Rows without a conv_id are one conversation. Windows are aligned with turns, so
    a turn that alone is longer than the budget is never cut: it has a longer window to itself, beside the system turn
    and history. An empty table has no windows. Tokens are the ids of the vocabulary at path ``tokenizer``.
    The rows of a partition come conversation by conversation, window by window.
    """
    short_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held = object(), 0, None
        rows: list[tuple] = []

        def put(done: list[tuple]) -> None:
            nonlocal number
            for text, spans, repeated in done:
                rows.append((now, number, text, [{"start": a, "end": b} for a, b in spans], repeated))
                number += 1

        def out() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32())
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "window", "text", "spans", "repeated"])
            rows.clear()
            return made

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if held is None or conv != now:
                    if held is not None and held.new:
                        put([held.close()])
                    now, number, held = conv, 0, Windows(partial(count_tokens, tokenizer=tokenizer), budget, history)
                put(held.add(role or "", text or ""))
                if len(rows) >= 500:
                    yield out()
        if held is not None and held.new:
            put([held.close()])
        yield out()

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn")
    )
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from windows in their partitions' order."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in kinds.split(", ")]
        types = [pa.string() if "sha" in x else pa.int64() for x in names]
        now, state, rows = object(), None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            rows.clear()
            return made

        def close() -> None:
            n, turns, loss_n, loss, chars = state
            rows.append((now, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

        for batch in batches:
            for conv, _, text, spans, repeated in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(rows) >= 500:
                yield out()
        if state is not None:
            close()
        yield out()

    return windows.mapInArrow(run, kinds)


def op9_chat(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """What read_back finds for every conversation and for -7, whose two turns hold control strings."""
    spark = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    return read_back(format_conversations(own.union(extra), tokenizer))
