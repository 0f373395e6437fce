"""Chat formatting into token-budgeted, turn-aligned windows with a loss mask.

A turn is <|im_start|>role, a line feed, the text, <|im_end|> and a line feed. Inside texts and roles every "<|" gets a
backslash after "<" (one more if backslashes are there already), so only the template writes control strings; unescape
takes it away again. A turn costs the tokens of all that is written for it; tokenizers that join nothing across a line
feed (as word_bpe_49k.json) count a window as the sum of its turns. Prefix sums of these costs give the longest run of new turns that fits the budget beside the
system turn and a limited history of the turns just before; the loss mask covers the new turns' assistant texts only,
so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, tokens

BUDGET, HISTORY = 2048, 256
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns that a conversation holds in memory before its windows are cut.
HOLD = 4096
WINDOWS = "conv_id long, window long, text string, loss array<struct<start:long,end:long>>, n_repeated long, first_turn long, n_tokens long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its text begins and ends there."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def render(turns: list[tuple[str, str]], n_repeated: int) -> tuple[str, list[dict]]:
    """The window's text and the spans of its targets, in code points."""
    out, at, spans = [], 0, []
    for i, (role, text) in enumerate(turns):
        written, start, end = turn(role, text)
        if role == "assistant" and i >= n_repeated:
            spans.append({"start": at + start, "end": at + end})
        out.append(written)
        at += len(written)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    turns = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        turns.append((unescape_role(role), unescape(body.removesuffix(END))))
    return turns


class Conversation:
    """Takes the turns of one conversation in order, and gives windows as soon as they are full."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []  # the last `old` turns that may be repeated, then the new ones
        self.old, self.done, self.windows, self.started = 0, 0, 0, False

    def add(self, role: str, text: str, cost: int) -> Iterator[tuple]:
        if not self.started and role == "system":
            self.system = (role, text, cost)
        self.started = True
        self.turns.append((role, text, cost))
        if len(self.turns) - self.old > HOLD:
            yield from self.cut(False)

    def cut(self, last: bool) -> Iterator[tuple]:
        sums = [0]
        for _, _, cost in self.turns:
            sums.append(sums[-1] + cost)
        start = self.old
        floor = max(0, bool(self.system) - (self.done - self.old))  # the system turn stands in front already
        while start < len(self.turns):
            fixed = [self.system] if self.system and self.windows else []
            room = self.budget - sum(x[2] for x in fixed)
            first = start
            while first > floor and sums[start] - sums[first - 1] <= min(self.history, room - self.turns[start][2]):
                first -= 1
            end = max(start + 1, bisect_right(sums, sums[first] + room) - 1)
            if end >= len(self.turns) and not last:
                break
            shown = [*fixed, *self.turns[first:end]]
            repeated = len(fixed) + start - first
            text, spans = render([x[:2] for x in shown], repeated)
            yield self.conv_id, self.windows, text, spans, repeated, self.done, sum(x[2] for x in shown)
            self.windows += 1
            self.done += end - start
            start = end
        keep = start
        while keep > 0 and sums[start] - sums[keep - 1] <= self.history:
            keep -= 1
        self.turns, self.old = self.turns[keep:], start - keep


def format_windows(conversations: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """WINDOWS of every conversation.

    Rows go by conv_id and turn (null first), ties by role and text, so repeated rows are turns of their own. Null texts
    and roles are empty; rows with a null conv_id are one conversation. A turn of more tokens than the budget has a
    window to itself, with the system turn, and stays whole. A system turn counts as such only where it is the first.
    Conversations are streamed through sorted partitions, so memory is bound by HOLD turns, not by a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, out = tokens.encoder(path), None, []
        for batch in common.slices(batches):
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            costs = [len(x) // 4 for x in encoder.encode([turn(role or "", text or "")[0] for role, text in zip(roles, texts)])]
            for conv_id, role, text, cost in zip(ids, roles, texts, costs):
                if now is None or now.conv_id != conv_id:
                    out += now.cut(True) if now else ()
                    now = Conversation(conv_id, budget, history)
                out += now.add(role or "", text or "", cost)
            if out:
                yield _batch(out)
                out = []
        if now:
            yield _batch(list(now.cut(True)))

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "window", "text", "loss", "n_repeated", "first_turn", "n_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)


def digest(windows: DataFrame) -> DataFrame:
    """DIGEST of each conversation, from its windows alone: repeated turns are left out, targets unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in common.slices(batches):
            for conv_id, text, loss, repeated in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if now is None or now[0] != conv_id:
                    out += [_closed(now)] if now else []
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
            if out:
                yield _digests(out)
                out = []
        if now:
            yield _digests([_closed(now)])

    rows = windows.select("conv_id", "window", "text", "loss", "n_repeated")
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window").mapInArrow(run, DIGEST)


def _closed(now: list) -> tuple:
    return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
