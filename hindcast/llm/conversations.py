"""Operator 12, conversation structure repair by Viterbi with survivor coalescence.

The edits that make a conversation's roles ``(s?(ua)+)?`` are a path through four
states (nothing yet, after system, after user, after assistant).  A task reads the rows
of one conversation after another, in order, and keeps for each state the cheapest way
to reach it, ties by the least audit text.  The ways form a tree of back pointers.
A node counts its references (its children, and the state that it is the survivor of)
and goes when they are gone; once all survivors share an ancestor, everything up to it
is decided, is emitted (into the audit and the running sha256) and goes too.  Only the
undecided end of a conversation is in memory, with its texts.  Two ways of equal cost
are compared by their whole undecided parts, back to where they part.

Survivors that no continuation can make the cheapest are dropped, or a way that deletes
everything would hold the tree to the end.  ``EXCESS[a][b]`` bounds how much more the
rest can cost from state b than from state a: any edits that follow a can follow b
after some rows are deleted (2 each, instead of being kept) or an insertion (5 each) or
two are made.  Only ways that are dearer by more than that are dropped, so ties stay.

Rows come to the task by a shuffle on the conversation and a sort that spills; a long
conversation is read as a stream and never gathered.  (Its sha256 is one sequence, so
one task must read it.)  Which rows repeat an earlier one of the conversation is found
in Spark on hashes: the least turn of (conversation, role, text), by a combining
aggregate, is joined with the turns of these keys; each later turn gives a mark, which
sorts just before the row that it is about.

Rows: nulls in role, text and the damage key are one space, a null conversation is one
conversation, and null turns come first.  Rows of equal turn come by role and then by
the sha256 of their text, so copies of a turn are neighbours and the result does not
depend on how rows are dealt out; other ties of cost go to the least audit, which fixes
the roles too.  An empty role has no initial: its row can't be kept as it is.  A
conversation of no rows after damage has zeros, an empty audit and the hash of nothing;
an empty table gives no rows; columns other than ``conv_id``, ``turn``, ``role`` and
``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.common import ship_code, slices
from hindcast.sources.tables import read_table

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
FAULTS = ("blank", "duplicate", "truncated")

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an initial leads to, where it may stand.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: How much more the rest can cost from the second state than from the first: a row
#: deleted instead of kept is 2, an insertion 5.
EXCESS = [[0, 10, 5, 2], [0, 0, 2, 0], [2, 5, 0, 2], [0, 10, 5, 0]]
WHITE = " \t\n\x0b\f\r"
ENDS = tuple(".!?")

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
#: Results held before a task hands them on, by their count and the length of audits.
RESULTS_AT_A_TIME, AUDIT_AT_A_TIME = 1000, 1_000_000

GHOST, MARK, ROW = range(3)
DAMAGE_PARTS = 20
DROP, EMPTY, UNPOINTED, REPEAT, AS_USER = range(5)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kind): the rows after damage; a dropped row leaves a
    ghost, so that its conversation is known."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    what = F.crc32(key.cast("binary")) % F.lit(DAMAGE_PARTS)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), what.alias("damage"))
    text = F.when(F.col("damage") == EMPTY, F.lit("")).when(
        F.col("damage") == UNPOINTED, F.translate("text", "".join(ENDS), "")).when(F.col("damage") == DROP, F.lit("")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == AS_USER, F.lit(ROLES["u"])).otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.when(F.col("damage") == DROP, F.lit(GHOST)).otherwise(F.lit(ROW)).alias("kind"),
        F.explode(F.when(F.col("damage") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def marks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, hash) of the turns at which a role and text stand that the
    conversation has at an earlier turn.  Turns are compared with nulls first."""
    keys = ["conv", "role", "hash"]
    at = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"))
    seen = rows.where(F.col("kind") == ROW).select(
        F.struct(F.col("conv_id").isNotNull().alias("told"), F.coalesce("conv_id", F.lit(0)).alias("id")).alias("conv"),
        "conv_id", "turn", "role", "hash", at.alias("at"))
    first = seen.groupBy(*keys).agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    return seen.join(first, keys).where("at > first").select("conv_id", "turn", "role", "hash").distinct()


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows, ghosts and marks of each conversation, together and in order."""
    rows = damaged(conversations).withColumn("hash", F.unhex(F.sha2("text", 256)))
    marked = marks(rows).select("conv_id", "turn", "role", F.lit("").alias("text"), F.lit(MARK).alias("kind"), "hash")
    return rows.unionByName(marked).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "hash", "kind").drop("hash")


def fault(text: str, seen: bool) -> str | None:
    """The first fault of a row."""
    end = text.rstrip(WHITE)
    if not end:
        return "blank"
    if seen:
        return "duplicate"
    return None if end.endswith(ENDS) else "truncated"


class Node:
    """One edit of a way: the line that it leaves (None: none) and who refers to it."""

    __slots__ = ("parent", "edit", "line", "depth", "children", "survivors")

    def __init__(self, parent: Node | None, edit: str, line: tuple[str, str] | None):
        self.parent, self.edit, self.line = parent, edit, line
        self.depth = parent.depth + 1 if parent else 0
        self.children, self.survivors = [], 0
        if parent:
            parent.children.append(self)


def earlier(a: Node, a_edit: str, b: Node, b_edit: str) -> bool:
    """Whether the way to ``a`` and ``a_edit`` sorts before that to ``b`` and ``b_edit``.
    The undecided parts are compared from where they part; neither begins with the
    other, as equal edits cost the same and these two ways do."""
    one, two = [a_edit], [b_edit]
    while a is not b:
        if a.depth >= b.depth:
            one.append(a.edit)
            a = a.parent
        else:
            two.append(b.edit)
            b = b.parent
    return "".join(one)[::-1] < "".join(two)[::-1]


class Repair:
    """The cheapest edits of one conversation, decided as its rows come."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.root.survivors = 1
        self.alive: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.audit: list[str] = []
        self.sha, self.lines = hashlib.sha256(), 0

    def _emit(self, node: Node) -> None:
        self.audit.append(node.edit)
        if node.line is not None:
            self.sha.update((("\n" if self.lines else "") + ":".join(node.line)).encode())
            self.lines += 1

    def _moved(self, ways: dict[int, tuple[int, Node, str, tuple | None]]) -> None:
        """Make the winning ways the survivors, drop those that can't win, free what
        nobody refers to and emit what all share."""
        best = {s: w for s, w in ways.items() if not any(o[0] + EXCESS[s][t] < w[0] for t, o in ways.items())}
        old = self.alive
        self.alive = {s: (cost, Node(node, edit, line) if edit else node) for s, (cost, node, edit, line) in best.items()}
        for _, node in self.alive.values():
            node.survivors += 1
        for _, node in old.values():
            node.survivors -= 1
            while not node.survivors and not node.children:
                node.parent.children.remove(node)
                node = node.parent
        while not self.root.survivors and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self._emit(self.root)

    @staticmethod
    def _offer(ways: dict, state: int, cost: int, node: Node, edit: str, line: tuple[str, str] | None) -> None:
        known = ways.get(state)
        if known is None or cost < known[0] or cost == known[0] and earlier(node, edit, known[1], known[2]):
            ways[state] = (cost, node, edit, line)

    def inserted(self) -> None:
        """Let every state be reached by an insertion.  Two in a row are two rounds;
        a third could only return to a state at a greater cost."""
        for _ in range(2):
            ways = {s: (cost, node, "", None) for s, (cost, node) in self.alive.items()}
            for state, (cost, node) in self.alive.items():
                for initial, role in ROLES.items():
                    if initial in NEXT[state]:
                        self._offer(ways, NEXT[state][initial], cost + COST[INSERT], node, INSERT, (role, ""))
            self._moved(ways)

    def row(self, role: str, text: str, trouble: str | None) -> None:
        self.inserted()
        ways: dict = {}
        extra = TRUNCATED_COST if trouble == "truncated" else 0
        for state, (cost, node) in self.alive.items():
            self._offer(ways, state, cost + COST[DELETE], node, DELETE, None)
            if trouble in ("blank", "duplicate"):
                continue
            for initial, to in NEXT[state].items():
                if role[:1] == initial:
                    self._offer(ways, to, cost + COST[KEEP] + extra, node, KEEP, (role, text))
                if initial in ROLES:
                    self._offer(ways, to, cost + COST[REROLE] + extra, node, REROLE, (ROLES[initial], text))
        self._moved(ways)

    def done(self) -> tuple[int, str, str]:
        """(cost, audit, sha256 of the repaired text)."""
        self.inserted()
        ways: dict = {}
        for state in (START, ASSISTANT):
            if state in self.alive:
                cost, node = self.alive[state]
                self._offer(ways, 0, cost, node, "", None)
        cost, node = ways[0][:2]
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.parent
        for x in reversed(rest):
            self._emit(x)
        return cost, "".join(self.audit), self.sha.hexdigest()


class Conversation:
    """Counts and repair of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair = conv_id, Repair()
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.least = self.turn = None
        self.last: tuple | None = None  # (turn, role, text) of the row before
        self.marked = False

    def take(self, turn: int | None, role: str, text: str, kind: int) -> None:
        if kind != ROW:
            self.marked = self.marked or kind == MARK
            return
        trouble = fault(text, self.marked or self.last == (turn, role, text))
        self.marked = False
        if trouble:
            self.faults[trouble] += 1
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.turn:  # turns come in order, nulls first
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.turn = turn
        self.last = (turn, role, text)
        self.repair.row(role, text, trouble)

    def result(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        cost, audit, sha = self.repair.done()
        return (self.conv_id, gaps, *(self.faults[f] for f in FAULTS), self.illegal, cost, audit, sha)


def repaired(conversations: DataFrame) -> DataFrame:
    """``RESULT`` for each conversation of (conv_id, turn, role, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_code(conversations.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed():
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*told), arrow)], schema=arrow)

        current, told, size = None, [], 0
        for batch in slices(batches):
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind"))):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        told.append(current.result())
                        size += len(told[-1][-2])
                        if len(told) >= RESULTS_AT_A_TIME or size >= AUDIT_AT_A_TIME:
                            yield handed()
                            told, size = [], 0
                    current = Conversation(conv_id)
                current.take(*row)
        if current is not None:
            told.append(current.result())
            yield handed()

    return in_order(conversations).mapInArrow(run, RESULT)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return repaired(read_table(spark, sf_dir, "conversations"))
