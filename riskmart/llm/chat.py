"""Chat formatting with a grammar round trip.

    conversation = { "<|im_start|>" role "\\n" text "<|im_end|>" "\\n" }

Neither role nor text has a bare control string; in a role "<|nl|>" stands for a line
break. Every turn is rendered plainly, parsed again and compared with its source. If
the grammar refuses it, or text or role would be read as something else, control strings in it are
escaped by a backslash behind "<|" (and one more where there are some already), which
the parser takes away again; that is repeated until the turn comes back identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.shipping import ship

OPEN, CLOSE, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LEARNED_ROLE = "assistant"
#: Code points after which a long conversation goes on in another piece.
PIECE_CHARS = 1 << 20

_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end|nl)\|>")
_MARK = re.compile(r"<\|(im_start|im_end)\|>")
_BARE = re.compile(r"<\|(im_start|im_end|nl)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    """Takes one backslash from every escaped control string; plain ones stay."""
    return _CONTROL.sub(lambda m: f"<|{m[1][1:]}{m[2]}|>" if m[1] else m[0], text)


def _role_out(role: str, escaped: bool) -> str:
    return escape(role).replace("\n", LINE) if escaped else role


def _role_in(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<|{m[1][1:]}{m[2]}|>" if m[1] else ("\n" if m[2] == "nl" else m[0]), text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, start and end being the place of its text as rendered.

    Raises ValueError for what the grammar does not give.
    """
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.find("\n", at)
        if line < 0:
            raise ValueError(f"the role at {at} does not end")
        end = formatted.find(CLOSE + "\n", line + 1)
        stop = formatted.find(CLOSE, line + 1)
        if end < 0 or stop != end:
            raise ValueError(f"the text at {line + 1} does not end")
        if _MARK.search(formatted, at + len(OPEN), line) or _BARE.search(formatted, line + 1, end):
            raise ValueError(f"a control string stands inside the turn at {at}")
        turns.append((_role_in(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len(CLOSE) + 1
    return turns


def render(role: str, text: str) -> str:
    """One turn that parses back to exactly this role and text."""
    for escaped in (False, True):
        out = f"{OPEN}{_role_out(role, escaped)}\n{escape(text) if escaped else text}{CLOSE}\n"
        try:
            back = parse(out)
        except ValueError:
            continue
        if [turn[:2] for turn in back] == [(role, text)]:
            return out
    raise ValueError("a turn does not survive its rendering")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, turns, text, loss): the rendered conversations.

    `conversations` has conv_id, turn, role and text, one row per turn. Turns
    go by number (NULL first), then role, then text, so repeated rows and equal
    numbers have an order. NULL role or text counts as empty. NULL conv_ids
    are one conversation. loss holds (start, end) of the assistant's texts in the
    rendered piece. A conversation is one piece, or pieces of about PIECE_CHARS
    that end with a turn, so that a conversation of any length passes through a task
    in order without being held. Extra columns are ignored; an empty table gives no rows.
    """
    ship(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, piece, turns, size, parts, loss = nothing, 0, 0, 0, [], []
        done: list[tuple] = []
        out_kind = None

        def close() -> None:
            nonlocal piece, turns, size, parts, loss
            done.append((current, piece, turns, "".join(parts), loss))
            piece, turns, size, parts, loss = piece + 1, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal done
            ids, pieces, counts, texts, masks = (list(x) for x in zip(*done, strict=True))
            done = []
            spans = pa.array([[{"start": a, "end": b} for a, b in m] for m in masks], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array(ids, out_kind), pa.array(pieces, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), spans]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "piece", "turns", "text", "loss"])

        for batch in batches:
            out_kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if current is nothing or conv != current:
                    if current is not nothing:
                        close()
                    current, piece = conv, 0
                elif size >= PIECE_CHARS:
                    close()
                turn = render(role, text)
                if role == LEARNED_ROLE:
                    (_, _, a, b), = parse(turn)
                    loss.append((size + a, size + b))
                parts.append(turn)
                turns, size = turns + 1, size + len(turn)
            if done:
                yield flush()
        if current is not nothing:
            close()
            yield flush()

    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    schema = f"conv_id {kind}, piece long, turns long, text string, loss array<struct<start:long,end:long>>"
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(assemble, schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from the rendered text alone: turns, digests of turns and of what the loss covers.

    The digests run over a conversation from its first turn to its last, so its
    pieces pass one task in order; only the running digests are held.
    """
    ship(pieces.sparkSession)
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, n_turns, loss_chars, chars, all_turns, all_loss = nothing, 0, 0, 0, None, None
        done: list[tuple] = []
        out_kind = None

        def flush() -> pa.RecordBatch:
            nonlocal done
            ids, *rest = (list(x) for x in zip(*done, strict=True))
            done = []
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids, out_kind), *[pa.array(x, k) for x, k in zip(rest, kinds, strict=True)]], names=names)

        def close() -> None:
            done.append((current, n_turns, all_turns.hexdigest(), loss_chars, all_loss.hexdigest(), chars))

        for batch in batches:
            out_kind = batch.schema.field("conv_id").type
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if current is nothing or conv != current:
                    if current is not nothing:
                        close()
                    current, n_turns, loss_chars, chars = conv, 0, 0, 0
                    all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in parse(text):
                    all_turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    all_loss.update(learned.encode())
                    loss_chars += len(learned)
                chars += len(text)
            if done:
                yield flush()
        if current is not nothing:
            close()
            yield flush()

    ordered = pieces.select("conv_id", "piece", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "text", "loss").mapInArrow(digest, schema)
