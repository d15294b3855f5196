"""Chat formatting in budgeted windows.

Turns are rendered as ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a line feed. Control
strings of this and other common templates inside texts and roles are broken by a backslash after their first
character; backslashes are doubled; so the text can be read back exactly. A conversation becomes windows of at
most ``budget`` tokens, cut between turns: the prefix sums of the turns' tokens choose where each window ends.
Later windows repeat the system turn and as many of the last turns as fit ``history`` tokens and leave room for
the next turn. The loss mask
covers assistant texts in the window where they are new; repeated ones are masked out.

Turns stream through each task in order, so memory holds one window and its history, however long a
conversation is. Defined cases: a null text or role is empty; a null turn comes first; rows of equal turn are
ordered by role and text; a null conv_id is a conversation of its own; a turn longer than the budget gets a
window of its own, whole, behind the system turn; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.chunked_text import hf_chunks
from plumbline.llm.common import table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\([\\n])?")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

BUDGET, HISTORY = 1024, 256


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """Reverses :func:`escape`. No control string has 'n' or a backslash in its second place."""
    return _UNESCAPE.sub(lambda m: {"\\": "\\", "n": "\n", None: ""}[m[1]], text) if "\\" in text else text


@dataclass
class Turn:
    role: str
    text: str
    tokens: int = 0
    head: str = field(init=False)
    body: str = field(init=False)

    def __post_init__(self) -> None:
        self.head = BEGIN + escape(self.role).replace("\n", "\\n") + "\n"
        self.body = escape(self.text)

    @property
    def rendered(self) -> str:
        return self.head + self.body + END


def window_end(prefix: np.ndarray, start: int, room: int) -> int:
    """One past the last turn of the window that starts at ``start``; it takes one turn at least."""
    return max(start + 1, int(np.searchsorted(prefix, prefix[start] + room, side="right")) - 1)


def history_start(prefix: np.ndarray, start: int, history: int) -> int:
    return int(np.searchsorted(prefix, prefix[start] - history, side="left"))


class Windows:
    """The windows of one conversation, from turns that arrive in order in any number of parts."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.turns: list[Turn] = []  # repeated turns, then turns not yet in a window
        self.repeated = 0
        self.system: Turn | None = None
        self.number = self.done = 0

    def add(self, turns: list[Turn], last: bool) -> Iterator[tuple]:
        if not self.done and not self.turns and turns and turns[0].role == "system":
            self.system = turns[0]
        self.turns += turns
        while self.repeated < len(self.turns):
            prefix = np.concatenate([[0], np.cumsum([t.tokens for t in self.turns])])
            again = self.system is not None and self.number > 0
            room = self.budget - (self.system.tokens if again else 0)
            # repeated turns go, oldest first, until the next new turn fits
            over = int(np.searchsorted(prefix[: self.repeated], prefix[self.repeated + 1] - room, side="left"))
            self.turns, self.repeated, prefix = self.turns[over:], self.repeated - over, prefix[over:] - prefix[over]
            room -= int(prefix[self.repeated])
            end = window_end(prefix, self.repeated, room)
            if end >= len(self.turns) and not last:
                return
            yield self._window(end, again)
            first = history_start(prefix, end, self.history)
            if self.system is not None and self.number == 0:
                first = max(first, 1)  # the system turn comes again by itself
            self.number, self.done = self.number + 1, self.done + end - self.repeated
            self.turns, self.repeated = self.turns[first:], end - first

    def _window(self, end: int, again: bool) -> tuple:
        shown = ([self.system] if again else []) + self.turns[:end]
        new = end - self.repeated
        text, at, mask = [], 0, []
        for i, t in enumerate(shown):
            if t.role == "assistant" and i >= len(shown) - new:
                mask.append({"start": at + len(t.head), "end": at + len(t.head) + len(t.body)})
            text.append(t.rendered)
            at += len(text[-1])
        return self.number, self.done, len(shown) - new, new, sum(t.tokens for t in shown), "".join(text), mask


WINDOW_COLUMNS = "window int, first_turn long, n_repeated int, n_new int, n_tokens long, text string, loss_mask array<struct<start:int,end:int>>"
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_WINDOW_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), _MASK)


def format_conversations(turns: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, first_turn, n_repeated, n_new, n_tokens, text, loss_mask.

    The last ``n_new`` turns of ``text`` are new, the ``n_repeated`` before them are repeated. ``loss_mask``
    holds half-open spans of code points. A conversation's windows follow each other within one partition.
    """
    key_type = to_arrow_type(turns.schema["conv_id"].dataType)
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {WINDOW_COLUMNS}"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = hf_chunks(tokenizer_path)
        key, state = object(), None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (key_type, *_WINDOW_TYPES))], names=["conv_id", "window", "first_turn", "n_repeated", "n_new", "n_tokens", "text", "loss_mask"])

        for part in batches:
            keys = part.column(0).to_pylist()
            made = [Turn(r or "", t or "") for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            for t, tokens in zip(made, encoder.encode([t.rendered for t in made])[1].tolist()):
                t.tokens = tokens
            rows: list[tuple] = []
            begin = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[begin]:
                    continue
                if state is None or keys[begin] != key:
                    if state is not None:
                        rows += [(key, *w) for w in state.add([], True)]
                    key, state = keys[begin], Windows(budget, history)
                rows += [(key, *w) for w in state.add(made[begin:i], False)]
                begin = i
            if rows:
                yield batch(rows)
        if state is not None and (rows := [(key, *w) for w in state.add([], True)]):
            yield batch(rows)

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(windows, schema)


def parse_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a window."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def conversation_digests(windows: DataFrame) -> DataFrame:
    """What can be read back from the windows of :func:`format_conversations`, one row per conversation."""
    key_type = to_arrow_type(windows.schema["conv_id"].dataType)
    schema = f"conv_id {windows.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # key, turns, hash of turns, loss characters, hash of loss, characters, windows

        def closed() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]

        for part in batches:
            rows: list[tuple] = []
            for w in part.to_pylist():
                if now is None or w["window"] == 0:
                    if now is not None:
                        rows.append(closed())
                    now = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse_window(w["text"])[w["n_repeated"] :]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in w["loss_mask"]:
                    text = unescape(w["text"][span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(w["text"])
                now[6] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(closed(), types)], names=names)

    return windows.mapInArrow(digest, schema)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return conversation_digests(format_conversations(turns.union(probe), public_tokenizers.path("byte_bpe_50k.json")))
