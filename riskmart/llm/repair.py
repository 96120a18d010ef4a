"""Conversation structure repair by a persistent audit DP.

A conversation's rows pass through a four-state automaton for the role
initials `(s?(ua)+)?`. For every state the cheapest sequence of edits so far is
kept, as the end of a chain of linked nodes: sequences that begin alike share the
nodes of their common beginning. A node knows its ancestors 1, 2, 4, ... steps back
and a rolling hash of all edits up to it, so two sequences of equal cost are
told apart at their longest common prefix, which is searched over the
hashes. Equal hashes are verified: shared beginnings are the same node, and
where they are not, the sequences themselves are compared.

Edits, by their initials: Keep (0), Rerole to the role that may follow (1), Delete (2; the
only edit for blank and duplicate rows), Insert of an empty turn (5). A
truncated row that is not deleted costs 5 more.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.shipping import ship

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that may be put in at each state, and where it leads.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
LEGAL = {"su", "ua", "au"}

PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
#: Rows after which the edits that all sequences share are settled.
SETTLE_ROWS = 256
LONGEST = (1 << 63) - 1


class Node:
    """The last edit of a sequence; `ups[k]` is the node 2**k edits before it."""

    __slots__ = ("edit", "depth", "hash", "ups")

    def __init__(self, parent: Node | None = None, edit: str = "") -> None:
        self.edit = edit
        if parent is None:
            self.depth, self.hash, self.ups = 0, 0, []
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * BASE + ord(edit)) % PRIME
        self.ups, at, k = [parent], parent, 0
        while k < len(at.ups):
            at = at.ups[k]
            self.ups.append(at)
            k += 1


def lifted(node: Node, depth: int) -> Node:
    while node.depth > depth:
        k = (node.depth - depth).bit_length() - 1
        node = node.ups[min(k, len(node.ups) - 1)]
    return node


def edits(node: Node, depth: int = 0) -> str:
    """The edits behind `depth` up to the node."""
    out = []
    while node.depth > depth:
        out.append(node.edit)
        node = node.ups[0]
    return "".join(reversed(out))


def parted(a: Node, b: Node, same: Callable[[Node, Node], bool]) -> tuple[Node, Node]:
    """From two different nodes of one depth, those right behind the longest common prefix."""
    for k in reversed(range(min(len(a.ups), len(b.ups)))):
        if k < len(a.ups) and k < len(b.ups) and not same(a.ups[k], b.ups[k]):
            a, b = a.ups[k], b.ups[k]
    return a, b


def _same_hash(a: Node, b: Node) -> bool:
    return a.hash == b.hash


def _identical(a: Node, b: Node) -> bool:
    return a is b


def shared(a: Node, b: Node) -> Node:
    """The last node that both sequences go through."""
    depth = min(a.depth, b.depth)
    a, b = lifted(a, depth), lifted(b, depth)
    return a if a is b else parted(a, b, _identical)[0].ups[0]


def precedes(a: Node, b: Node) -> bool:
    """Whether a's edits come before b's in ASCII order; both grow from one root."""
    depth = min(a.depth, b.depth)
    x, y = lifted(a, depth), lifted(b, depth)
    if x is y:
        return a.depth < b.depth
    if x.hash != y.hash:
        x, y = parted(x, y, _same_hash)
        if x.ups[0] is y.ups[0]:
            return x.edit < y.edit
    root = shared(a, b).depth  # two sequences with one hash: compared as they are
    return edits(a, root) < edits(b, root)


class Repair:
    """The rows of one conversation in order; `emit(edit, role, text)` gets its edits in order.

    Edits are given as soon as all sequences that can still win share them, so
    what is held is the part in which they differ, not the conversation.
    """

    def __init__(self, emit: Callable[[str, str | None, str | None], None]) -> None:
        self.emit = emit
        self.root = Node()
        self.state = START
        self.rows: deque = deque()
        self.best: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]
        self.since = 0
        self._insertions()

    @staticmethod
    def _least(options: list[tuple[int, Node, str]]) -> tuple[int, Node] | None:
        if not options:
            return None
        cost = min(o[0] for o in options)
        nodes = [Node(parent, edit) if edit else parent for c, parent, edit in options if c == cost]
        least = nodes[0]
        for node in nodes[1:]:
            if precedes(node, least):
                least = node
        return cost, least

    def _insertions(self) -> None:
        for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            options = [(*self.best[target], "")] if self.best[target] else []
            options += [(self.best[q][0] + INSERT_COST, self.best[q][1], INSERT) for q in sources if self.best[q]]
            self.best[target] = self._least(options)

    def row(self, role: str, text: str, removed: bool, truncated: bool) -> None:
        """One more row; `removed` if it may only be deleted."""
        self.rows.append(None if removed else (role, text))
        more = TRUNCATED_COST if truncated else 0
        options: list[list] = [[], [], [], []]
        for q, found in enumerate(self.best):
            if found is None:
                continue
            cost, node = found
            options[q].append((cost + DELETE_COST, node, DELETE))
            if removed:
                continue
            kept = STEP.get((q, role[:1]))
            if kept is not None:
                options[kept].append((cost + more, node, KEEP))
            options[NEXT[q][1]].append((cost + REROLE_COST + more, node, REROLE))
        self.best = [self._least(o) for o in options]
        self._insertions()
        # What can follow the start or a system turn can follow an assistant's turn, for at most a deleted row more.
        settled = self.best[ASSISTANT][0]
        for q, extra in ((START, DELETE_COST), (SYSTEM, 0)):
            if self.best[q] and settled + extra < self.best[q][0]:
                self.best[q] = None
        self.since += 1
        if self.since >= SETTLE_ROWS:
            self.since = 0
            common = None
            for found in self.best:
                if found:
                    common = found[1] if common is None else shared(common, found[1])
            self._settle(common)

    def _settle(self, node: Node) -> None:
        for edit in edits(node, self.root.depth):
            if edit == INSERT:
                role, self.state = NEXT[self.state]
                self.emit(edit, role, "")
                continue
            row = self.rows.popleft()
            if edit == DELETE:
                self.emit(edit, None, None)
            elif edit == REROLE:
                role, self.state = NEXT[self.state]
                self.emit(edit, role, row[1])
            else:
                self.state = STEP[self.state, row[0][:1]]
                self.emit(edit, *row)
        node.ups = []
        self.root = node

    def finish(self) -> int:
        """Gives the remaining edits; the cost of all."""
        cost, node = self._least([(*self.best[q], "") for q in (START, ASSISTANT) if self.best[q]])
        self._settle(node)
        return cost


class Conversation:
    """Counts and digest of one conversation, row by row."""

    def __init__(self, conv_id, emit: Callable | None = None) -> None:
        self.conv_id = conv_id
        self.sha = hashlib.sha256()
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit: list[str] = []
        self.before: tuple | None = None
        self.written = 0
        self.pass_on = emit
        self.repair = Repair(self._emit)

    def _emit(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        if role is not None:
            self.sha.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
            self.written += 1
        if self.pass_on is not None:
            self.pass_on(self.conv_id, edit, role, text)

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        body = text.rstrip(SPACES)
        blank = not body
        duplicate = not blank and (repeated or self.before == (turn, role, text))
        truncated = not blank and not duplicate and body[-1] not in ".!?"
        self.before = (turn, role, text)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def finish(self) -> tuple:
        cost = self.repair.finish()
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, LONGEST)
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return (self.conv_id, *counts, "".join(self.audit), self.sha.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of `conv_id:turn`; NULL counts as one space everywhere but in turn.

    One row of twenty each (by remainder): 0 is lost, 1 loses its text, 2 its
    `[.!?]`, 3 is there twice, 4 becomes the user's. `copies` tells how often a row stands: 0, 1 or 2.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order, one conversation in one partition; `repeated` where an earlier turn has the same role and text.

    Which texts come back at a later turn is found from digests, summed
    up before they move; texts move once.
    """
    space = F.lit(" ")
    copies = F.coalesce("copies", F.lit(0)) if "copies" in rows.columns else F.lit(1)
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copies.alias("copies"))
    rows = rows.withColumn("named", F.unhex(F.sha2(F.concat_ws("\n", "role", "text"), 256)))
    place = F.struct("turn")
    again = (
        rows.where("copies > 0")
        .groupBy(F.col("conv_id").alias("c"), F.col("named").alias("n"))
        .agg(F.min(place).alias("early"), F.max(place).alias("late"))
        .where("early < late")
        .select("c", "n", "early")
    )
    marked = rows.join(again, rows["conv_id"].eqNullSafe(again["c"]) & (rows["named"] == again["n"]), "left")
    repeated = F.coalesce(F.col("early") < place, F.lit(False))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    wanted = marked.select("conv_id", "turn", "role", "text", "copies", repeated.alias("repeated"))
    return wanted.repartition("conv_id").sortWithinPartitions(*order)


def _conversations(batches: Iterator[pa.RecordBatch], emit: Callable | None = None) -> Iterator[list[tuple] | None]:
    """The finished conversations of each batch, lost executors or not the same ones in the same order."""
    current: Conversation | None = None
    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "repeated"))
        for conv_id, turn, role, text, copies, repeated in zip(*columns, strict=True):
            if current is None or conv_id != current.conv_id:
                if current is not None:
                    done.append(current.finish())
                current = Conversation(conv_id, emit)
            for _ in range(copies):
                current.row(turn, role, text, repeated)
        yield done
    if current is not None:
        yield [current.finish()]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audited(rows: DataFrame) -> DataFrame:
    """Per conversation: its faults, and the cheapest edits that make its roles `(s?(ua)+)?`.

    `rows` has conv_id, turn, role and text, one row per turn, and may have
    `copies` (how often the row stands; 0: the conversation is known, the row is
    lost). Rows go by turn (NULL first), then role, then text. NULL role or text
    counts as one space; a NULL conv_id is a conversation of its own. Of edits of
    equal cost the ASCII-least initials win. A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated. gaps are missing turn
    numbers; the count stops at the largest long. Extra columns are ignored;
    an empty table gives no rows. `repaired_sha256` runs over the repaired turns in
    order, so a conversation passes one task as a stream, whatever its length; held
    are the audit and the turns about which the cheapest sequences still differ.
    """
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_kind = None

        def watched():
            nonlocal out_kind
            for batch in batches:
                out_kind = batch.schema.field("conv_id").type
                yield batch

        for done in _conversations(watched()):
            if done:
                ids, *rest = (list(x) for x in zip(*done, strict=True))
                kinds = [pa.int64()] * len(_COUNTS) + [pa.string()] * 2
                columns = [pa.array(ids, out_kind), *[pa.array(x, k) for x, k in zip(rest, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([f"conv_id {kind}", *[f"{c} long" for c in _COUNTS], "audit string", "repaired_sha256 string"])
    return _ordered(rows).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, turn, role, text, edit), turns counted from 0.

    Takes what `audited` takes. Conversations without turns left give no rows.
    """
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        out_kind, current, turn = None, object(), 0

        def emit(conv_id, edit: str, role: str | None, text: str | None) -> None:
            nonlocal current, turn
            if conv_id != current:
                current, turn = conv_id, 0
            if role is not None:
                kept.append((conv_id, turn, role, text, edit))
                turn += 1

        def watched():
            nonlocal out_kind
            for batch in batches:
                out_kind = batch.schema.field("conv_id").type
                yield batch

        for _ in _conversations(watched(), emit):
            if kept:
                kinds = (out_kind, pa.int64(), pa.string(), pa.string(), pa.string())
                columns = [pa.array(list(x), k) for x, k in zip(zip(*kept, strict=True), kinds, strict=True)]
                kept.clear()
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "edit"])

    return _ordered(rows).mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, edit string")
