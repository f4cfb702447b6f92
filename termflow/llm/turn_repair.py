"""Repair of conversation structure by Viterbi search with coalescing survivors.

The roles of a repaired conversation read `(s?(ua)+)?`: an optional system turn, then user and assistant in
turn. Every row is kept, given another role or deleted, and empty turns may be inserted; the cheapest edits
win, of equally cheap ones those whose initials (D, I, K, R) come first in ASCII order. Rows are read in
order, and one survivor is held for each state of the grammar. Survivors are leaves of a tree of
back-pointers whose nodes count what refers to them: a node that no survivor needs goes, and as soon as all
survivors share an ancestor, the edits up to it are certain and leave. Only the unresolved rest is in memory,
whatever the length of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
ROLE = {"u": "user", "a": "assistant"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
#: State after a turn of this initial: nothing yet, after s, after u, after a.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: The role that a changed or inserted turn gets in a state, and the state after it.
FILL = {"": "u", "s": "u", "u": "a", "a": "u"}
FINAL = ("", "a")
LEGAL = ("su", "ua", "au")


class _Node:
    """An edit, with the edit before it, the edits that follow it and the number of survivors that end in it."""
    __slots__ = ("edit", "row", "role", "before", "after", "held")

    def __init__(self, edit, row=None, role=None, before=None):
        self.edit, self.row, self.role, self.before, self.after, self.held = edit, row, role, before, [], 0
        if before is not None:
            before.after.append(self)

    def release(self) -> None:
        """Give up nodes that nothing refers to, from here towards the root."""
        node = self
        while node.before is not None and not node.held and not node.after:
            node.before.after.remove(node)
            node = node.before


class Survivors:
    """Cheapest edits for each state of the grammar, as leaves of one tree.

    A survivor is (cost, place, fresh, node). `place` orders the survivors of the row before by their
    whole edits: none of those is the beginning of another (what follows would be inserted turns, but
    each ends in an edit of the same row), so their order never changes, whatever follows. `fresh` are
    the initials since then. So (cost, place, fresh) compares ties by all their unresolved edits
    without reading them again.
    """

    def __init__(self):
        self.root = _Node("")
        self.root.held = 1
        self.leaves = {"": (0, 0, "", self.root)}
        self.cost = None
        self._insert()

    def _insert(self) -> None:
        """Up to two empty turns after every state; with a third, a survivor of its state is cheaper."""
        for _ in range(2):
            for state in list(self.leaves):
                cost, place, fresh, node = self.leaves[state]
                to = FILL[state]
                rank = (cost + COST["I"], place, fresh + "I")
                held = self.leaves.get(to)
                if held is None or rank < held[:3]:
                    new = _Node("I", None, ROLE[to], node)
                    new.held = 1
                    self.leaves[to] = (*rank, new)
                    if held is not None:
                        self._drop(held)
        self._prune()

    @staticmethod
    def _drop(leaf: tuple) -> None:
        leaf[3].held -= 1
        leaf[3].release()

    def _prune(self) -> None:
        """Drop survivors that another one beats whatever follows, so that the rest can coalesce.

        After an assistant, every edit that is legal after a system turn is legal too, and so is every
        one at the start but to keep a system turn, which a deletion stands for at its cost.
        """
        over = self.leaves["a"]
        if "s" in self.leaves and over[:3] < self.leaves["s"][:3]:
            self._drop(self.leaves.pop("s"))
        if "" in self.leaves and over[0] + COST["D"] < self.leaves[""][0]:
            self._drop(self.leaves.pop(""))

    def take(self, row: tuple, role: str, must_go: bool, truncated: bool) -> None:
        """Read one row, which is handed back with its edit."""
        extra = TRUNCATED_COST if truncated else 0
        best: dict[str, tuple] = {}

        def offer(state, cost, edit, turned):
            rank = (cost, place, fresh + edit)
            if state not in best or rank < best[state][:3]:
                best[state] = (*rank, edit, turned, node)
        for state, (cost, place, fresh, node) in self.leaves.items():
            offer(state, cost + COST["D"], "D", None)
            if not must_go:
                same = NEXT.get((state, role[:1]))
                if same:
                    offer(same, cost + COST["K"] + extra, "K", role)
                to = FILL[state]
                offer(to, cost + COST["R"] + extra, "R", ROLE[to])
        before = self.leaves
        order = sorted(best, key=lambda q: best[q][1:3])
        self.leaves = {}
        for place, state in enumerate(order):
            cost, _, _, edit, turned, node = best[state]
            new = _Node(edit, row, turned, node)
            new.held = 1
            self.leaves[state] = (cost, place, "", new)
        for leaf in before.values():
            self._drop(leaf)
        self._insert()

    def settled(self) -> Iterator[_Node]:
        """Edits that all survivors share, once."""
        while not self.root.held and len(self.root.after) == 1:
            self.root = self.root.after[0]
            self.root.before = None
            yield self.root

    def finish(self) -> Iterator[_Node]:
        """The rest of the cheapest edits that end well."""
        ends = [q for q in FINAL if q in self.leaves]
        end = min(ends, key=lambda q: self.leaves[q][:3])
        self.cost = self.leaves[end][0]
        for state in list(self.leaves):
            if state != end:
                self._drop(self.leaves.pop(state))
        node = self.leaves[end][3]
        out = []
        while node is not self.root:
            out.append(node)
            node = node.before
        return reversed(out)

    def unresolved(self) -> int:
        """Edits in memory."""
        n, rest = 0, [self.root]
        while rest:
            n += 1
            rest += rest.pop().after
        return n


def records(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, dropped) as the search reads them, sorted by conversation.

    Faults that a row shows by itself are found here; where a role and text stand first in a
    conversation is a grouped minimum, whose result stands as a marker in front of its row, so texts
    move once and no task remembers a conversation's texts. A dropped row only names its conversation.
    """
    text = F.coalesce("text", F.lit(" "))
    end = F.rtrim(text, F.lit(BLANKS))
    rows = turns.where("not dropped").select(
        "conv_id", "turn", F.lit(1).alias("kind"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        (end == "").alias("blank"), ((end != "") & ~F.contains(F.lit(ENDINGS), F.right(end, F.lit(1)))).alias("truncated"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    none = lambda kind: F.lit(None).cast(kind)
    firsts = (rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("f"))
              .select("conv_id", F.col("f.turn").alias("turn"), F.lit(0).alias("kind"), "role", "digest", none("string").alias("text"),
                      none("boolean").alias("blank"), none("boolean").alias("truncated")))
    gone = (turns.where("dropped").groupBy("conv_id").agg(F.lit(1)).select(
        "conv_id", none("long").alias("turn"), F.lit(-1).alias("kind"), F.lit("").alias("role"), F.lit("").alias("digest"),
        none("string").alias("text"), none("boolean").alias("blank"), none("boolean").alias("truncated")))
    order = ["conv_id", "turn", "role", "digest", "kind"]
    columns = ["conv_id", "turn", "kind", "role", "digest", "text", "blank", "truncated"]
    every = rows.select(columns).union(firsts.select(columns)).union(gone.select(columns))
    return every.repartition("conv_id").sortWithinPartitions(*order)


class _Conversation:
    """What is told of one conversation as its rows pass."""

    def __init__(self, emit):
        self.survivors, self.emit = Survivors(), emit
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = self.first = None
        self.place = 0

    def read(self, turn, kind, role, digest, text, blank, truncated) -> None:
        if kind < 0:
            return
        if kind == 0:
            self.first = (turn, digest)
            return
        new = self.first == (turn, digest)
        self.first = None
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.before is not None and self.before[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role
        again = not blank and not new
        truncated = truncated and not again
        self.blank += blank
        self.duplicate += again
        self.truncated += truncated
        self.survivors.take((turn, role, text), role, blank or again, truncated)
        self._give(self.survivors.settled())

    def _give(self, edits) -> None:
        for n in edits:
            self.place += 1
            self.emit(self.place, n)

    def close(self) -> tuple:
        self._give(self.survivors.finish())
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.survivors.cost


def _walk(frames: Iterator[pd.DataFrame], start, done):
    """Drive conversations through a batch of sorted frames; yields what `done` makes of each one."""
    name, at, seen = None, None, False
    for frame in frames:
        ids = frame["conv_id"].astype(object).where(frame["conv_id"].notna(), None).tolist()
        turns = frame["turn"].astype(object).where(frame["turn"].notna(), None).tolist()
        rest = [frame[c].tolist() for c in ("kind", "role", "digest", "text", "blank", "truncated")]
        for conv, turn, *row in zip(ids, turns, *rest, strict=True):
            if not seen or conv != name:
                if seen:
                    yield done(name, at)
                name, at, seen = conv, start(conv), True
            at.read(turn, *row)
        yield None
    if seen:
        yield done(name, at)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv_id", *[c.split()[0] for c in SUMMARY.split(", ")]]

    def start(_):
        audit, sha = bytearray(), hashlib.sha256()
        first = [True]

        def emit(_, n):
            audit.extend(n.edit.encode())
            if n.role is not None:
                if not first[0]:
                    sha.update(b"\n")
                first[0] = False
                sha.update(f"{n.role}:{n.row[2] if n.row else ''}".encode())
        at = _Conversation(emit)
        at.audit, at.sha = audit, sha
        return at

    out = []
    for row in _walk(frames, start, lambda name, at: (name, *at.close(), at.audit.decode(), at.sha.hexdigest())):
        if row is not None:
            out.append(row)
        elif out:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def _edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []

    def start(conv):
        return _Conversation(lambda place, n: out.append(
            (conv, place, n.edit, n.row[0] if n.row else None, n.role, None if n.role is None else n.row[2] if n.row else "")))
    for _ in _walk(frames, start, lambda name, at: at.close()):
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=["conv_id", "place", "edit", "turn", "role", "text"])
            out.clear()
    if out:
        yield pd.DataFrame(out, columns=["conv_id", "place", "edit", "turn", "role", "text"])


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32(`conv_id:turn`) mod 20: 0 drops a row, 1 empties its text, 2
    takes away its `.!?`, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (turns.select("conv_id", F.col("turn").cast("long").alias("turn"), fault.alias("fault"), role.alias("role"), text.alias("text"))
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text")).alias("text"),
                    (F.col("fault") == 0).alias("dropped"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
            .drop("_copy"))


def _with_dropped(turns: DataFrame) -> DataFrame:
    dropped: Column = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", dropped.alias("dropped"))


def repairs(turns: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256). Rows marked in a boolean column `dropped`, if there is one, are not there, but
    their conversation still has its row.

    Rows come by turn (nulls first), rows of one turn by role and digest of role and text, so repeated rows
    are neighbours; a null role or text is one space. A row's first fault counts: blank, duplicate (its role
    and text seen earlier in the conversation) or truncated (it does not end in . ! or ?). An empty role
    has no legal initial and is changed or deleted. Rows with a null conv_id are one conversation. A
    conversation without rows has zeros, an empty audit and the hash of an empty text; an empty table
    gives an empty result. Other columns are not read.

    A conversation passes one task row by row; the task holds the unresolved edits alone, and of the
    output the audit, which has one letter for each edit.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    return records(_with_dropped(turns)).mapInPandas(_summaries, f"conv_id {kind}, {SUMMARY}")


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the edits of `repairs` in order, with the repaired turns;
    role and text are null for a deleted row, turn for an inserted one."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return records(_with_dropped(turns)).mapInPandas(
        _edits, f"conv_id {kind}, place long, edit string, turn long, role string, text string")
