"""Chat formatting with a grammar round trip.

Every turn is rendered between marks, the rendered text is read again by a deterministic parser,
and what it recovers is compared with the source. Where they differ, the control strings inside
the text are escaped, and the comparison is made again; it then holds for every text. A rendered
conversation is its turns' texts end to end: a turn always begins and ends with its own marks, so
the parser needs no look ahead from turn to turn.

Conversations are read in order within a partition and digested row by row, so memory doesn't grow
with the length of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks of the template. An assistant's turn has no opening mark but the space that begins it.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": (" ", " </s>")}
#: Any other role is named in its turn.
OTHER = ("<<ROLE>> ", " <<TEXT>> ", " <</ROLE>>")
CONTROLS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")


def escape(text: str) -> str:
    """A backslash before each control string; backslashes that stand before one are doubled."""
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def _rendered(role: str, text: str) -> str:
    if role in MARKS:
        first, last = MARKS[role]
        return first + text + last
    return OTHER[0] + role + OTHER[1] + text + OTHER[2]


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a rendered conversation; start and end bound the escaped text.

    Raises ValueError where the text is not of the grammar.
    """
    turns = []
    # Control strings that aren't escaped; an even number of backslashes before one is no escape of ours.
    marks = [(m.start(2), m[2]) for m in _CONTROL.finditer(rendered) if not m[1] or len(m[1]) % 2 == 0]
    at, k = 0, 0

    def take(mark: str, before: str = " ", after: str = "") -> int:
        nonlocal k
        if k >= len(marks) or marks[k][1] != mark or not rendered.startswith(before, marks[k][0] - len(before)) or not rendered.startswith(after, marks[k][0] + len(mark)):
            raise ValueError(f"expected {mark} after {at}")
        k += 1
        return marks[k - 1][0]

    while at < len(rendered):
        role = next((r for r, (first, _) in MARKS.items() if rendered.startswith(first, at)), None)
        if role is None:
            if not rendered.startswith(OTHER[0], at):
                raise ValueError(f"no turn begins at {at}")
            take("<<ROLE>>", "", " ")
            named = take("<<TEXT>>", " ", " ")
            role, start = unescape(rendered[at + len(OTHER[0]) : named - 1]), named + len("<<TEXT>> ")
            last = "<</ROLE>>"
        else:
            first, last = MARKS[role]
            last = last[1:]
            start = at + len(first)
            if role != "assistant":
                take(first[:-1], "", " ")
        end = take(last) - 1
        if end < start:
            raise ValueError(f"the turn at {at} has no text")
        turns.append((role, unescape(rendered[start:end]), start, end))
        at = end + 1 + len(last)
    if k != len(marks):
        raise ValueError("a mark stands outside the turns")
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the bounds of its text, escaped as far as the parser needs it."""
    for own_role, own_text in ((role, text), (escape(role), escape(text))):
        out = _rendered(role if role in MARKS else own_role, own_text)
        try:
            turns = parse(out)
        except ValueError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return out, turns[0][2], turns[0][3]
    raise ValueError("the round trip failed")


_TURNS = "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long"


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end) for every row.

    ``formatted`` of the turns of a conversation, joined in order, is its text. ``loss_start`` and
    ``loss_end`` bound in code points what is learned: an assistant's text, else nothing. A null text
    or role is empty; further columns are left out; a repeated row is a further turn; a very long text
    is rendered whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for role, text in zip(batch["role"], batch["text"], strict=True):
                out, start, end = render(role, text)
                rows.append((out, start, end) if role == "assistant" else (out, 0, 0))
            made = pd.DataFrame(rows, columns=["formatted", "loss_start", "loss_end"], index=batch.index)
            yield pd.concat([batch[["conv_id", "turn", "role"]], made], axis=1)

    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.mapInPandas(run, _TURNS)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame) -> DataFrame:
    """A row for each conversation of :func:`format_turns`, from the formatted text alone.

    Turns go by number; turns of equal number by their formatted text. Null numbers come first, and
    rows with a null conv_id make one conversation. Columns beside those of :func:`format_turns`,
    whatever their names, change nothing; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: object = run  # no conversation yet
        state: list = []

        def row() -> tuple:
            conv, n, sha, chars, loss, length = state
            return (conv, n, sha.hexdigest(), chars, loss.hexdigest(), length)

        for batch in batches:
            done = []
            for conv, text, start, end in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if last is run or conv != last:
                    if state:
                        done.append(row())
                    last, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                learned = unescape(text[int(start) : int(end)])
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(text)
            yield pd.DataFrame(done, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([row()], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInPandas(run, _DIGESTS)
