"""Repair of conversations: the cheapest edits that give roles in their order.

A row is kept, given another role, deleted, or other rows are put in before it,
so that the initials of roles spell ``(s?(ua)+)?``. Which edits cost least is a
shortest path through a weighted automaton of four states (nothing yet, after
system, after user, after assistant). It is determinised as rows come: the
costs of going on from each of the four, less the least of them, are a state of
a new automaton, and what a row of some kind makes of such a state is kept in a
table. Few states exist, so almost every row is one look-up.

The table is scanned from a conversation's last row to its first, which gives
costs; the trace then goes back the other way, from first row to last, along
arcs that lose nothing (tight arcs), and takes at each the edit whose initial
is least: that is the least of all cheapest audits.

Rows are put in order by ranges and cut into blocks; a conversation may lie in
many. A block is first summed up for whatever state may follow it, the sums of
a conversation's blocks are put together, and then each block is traced by
itself. So a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, shared_dir, stored

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant. The state after the role that may be put in, and that role.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
FILL_NEXT, FILL_ROLE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U), ("user", "user", "assistant", "user")
KEEP_NEXT = {(NOTHING, 0): AFTER_S, (NOTHING, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_U, 2): AFTER_A, (AFTER_A, 1): AFTER_U}
#: Kinds of rows: twice the place of the initial in "sua" (3: another), one more if truncated; or one that must go.
GONE = 8
#: White space of the contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a block, as a power of two.
BLOCK_BITS = 16


class CostTable:
    """The lazily determinised automaton: states are vectors of costs still to come, less the least."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.moves: dict[tuple[int, int, int], tuple[str, str, str | None, int]] = {}
        self.end = self._state(self._filled([0, 10**6, 10**6, 0]))[0]  # what may end: nothing, or after assistant

    @staticmethod
    def _filled(costs: list[int]) -> list[int]:
        """With rows put in wherever that costs less."""
        for _ in range(3):
            costs = [min(c, INSERT + costs[FILL_NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    def _before(self, state: int, kind: int) -> list[int]:
        """Costs from before a row of ``kind``, if those after it are ``state``."""
        after, more = self.vectors[state], TRUNCATED * (kind % 2)
        out = []
        for q in range(4):
            ways = [DELETE + after[q]]
            if kind != GONE:
                ways.append(REROLE + more + after[FILL_NEXT[q]])
                if (q, kind // 2) in KEEP_NEXT:
                    ways.append(more + after[KEEP_NEXT[q, kind // 2]])
            out.append(min(ways))
        return self._filled(out)

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """(the state before a row of ``kind``, what was taken off its costs)."""
        if (state, kind) not in self.steps:
            self.steps[state, kind] = self._state(self._before(state, kind))
        return self.steps[state, kind]

    def move(self, state: int, kind: int, q: int) -> tuple[str, str, str | None, int]:
        """Along tight arcs over a row whose costs after it are ``state``: (edits, roles put in, the row's new role, where it leads)."""
        if (state, kind, q) not in self.moves:
            before, after, edits, roles, at, role = self._before(state, kind), self.vectors[state], "", [], q, None
            while True:  # D, I, K, R: the order of initials
                kept = KEEP_NEXT.get((at, kind // 2)) if kind != GONE else None
                if before[at] == DELETE + after[at]:
                    edits += "D"
                elif before[at] == INSERT + before[FILL_NEXT[at]]:
                    roles.append(FILL_ROLE[at])
                    edits, at = edits + "I", FILL_NEXT[at]
                    continue
                elif kept is not None and before[at] == TRUNCATED * (kind % 2) + after[kept]:
                    edits, at = edits + "K", kept
                else:
                    edits, role, at = edits + "R", FILL_ROLE[at], FILL_NEXT[at]
                break
            self.moves[state, kind, q] = edits, ",".join(roles), role, at
        return self.moves[state, kind, q]

    def ending(self, q: int) -> list[str]:
        """Roles put in after the last row."""
        roles = []
        while q not in (NOTHING, AFTER_A):
            roles.append(FILL_ROLE[q])
            q = FILL_NEXT[q]
        return roles

    @functools.cached_property
    def explored(self) -> tuple[np.ndarray, np.ndarray]:
        """All states there are: (the state before each kind of row, where each move leads), in the order of their numbers."""
        k = 0
        while k < len(self.vectors):
            for kind in range(GONE + 1):
                self.step(k, kind)
            k += 1
        n = range(len(self.vectors))
        steps = np.array([[self.step(s, kind)[0] for kind in range(GONE + 1)] for s in n], np.int16)
        moves = np.array([[[self.move(s, kind, q)[3] for q in range(4)] for kind in range(GONE + 1)] for s in n], np.int8)
        return steps, moves

    def summed(self, kinds: list[int]) -> tuple[list[int], list[list[int]]]:
        """For each state after these rows: the state before them, and where a trace over them leads from each of the four."""
        steps, moves = self.explored
        lanes = [np.arange(len(self.vectors))]
        for kind in reversed(kinds):
            lanes.append(steps[lanes[-1], kind])
        at = np.tile(np.arange(4, dtype=np.int8), (len(self.vectors), 1))
        for kind, after in zip(kinds, lanes[-2::-1], strict=True):
            at = moves[after[:, None], kind, at]
        return lanes[-1].tolist(), at.tolist()

    def traced(self, kinds: list[int], state: int, q: int, first: bool, last: bool) -> list[tuple[str, str, str | None, str, int]]:
        """For each row: (edits, roles put in before, new role, roles put in after, its part of the cost)."""
        states, costs = [state], []
        for kind in reversed(kinds):
            state, taken = self.step(state, kind)
            states.append(state)
            costs.append(taken)
        costs[-1] += self.vectors[state][NOTHING] * first
        out = []
        for kind, after, cost in zip(kinds, states[-2::-1], reversed(costs), strict=True):
            edits, roles, role, q = self.move(after, kind, q)
            out.append((edits, roles, role, "", cost))
        if last and (more := self.ending(q)):
            edits, roles, role, _, cost = out[-1]
            out[-1] = edits + "I" * len(more), roles, role, ",".join(more), cost
        return out


@functools.cache
def _table() -> CostTable:
    """One for each worker, its states all numbered in one order: their numbers go from worker to worker."""
    table = CostTable()
    _ = table.explored
    return table


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that the query asks for: by the CRC-32 of ``conv_id:turn``, modulo 20.

    0 drops a row, 1 empties its text, 2 takes its stops away, 3 repeats it, 4
    makes it the user's. Nulls read as one space, in the checksum too.
    """
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def faulted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, fault) with places in order; the result is a written table.

    ``rows`` has conv_id, turn, role and text; other columns are not read. A
    conversation's rows are ordered by turn, nulls first; rows that tie by
    role, then by the SHA-256 of the text. Null roles and texts read as one
    space. ``fault`` is the first that holds: blank (white space only),
    duplicate (role and text of an earlier row), truncated (the last character
    but white space is no stop), or null.
    """
    home = shared_dir(rows.sparkSession)
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", read("role"), read("text"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "row": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    # rows that are the same in all but their number may be dealt to several ranges
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("place", F.monotonically_increasing_id())
    rows = stored(rows, f"{home}/ordered")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"))
    # the key of this join is one row's own, whatever many rows say the same
    out = rows.drop("digest").join(firsts.select("first"), F.col("place") == F.col("first"), "left")
    said = F.rtrim("text", F.lit(SPACES))
    fault = F.when(said == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.right(said, F.lit(1)).isin(*".!?"), "truncated")
    return stored(out.withColumn("fault", fault).drop("first"), f"{home}/faulted")


def _kind(role: Column, fault: Column) -> Column:
    initial = F.instr(F.lit("sua"), F.substring(role, 1, 1)) - 1
    initial = F.when((F.length(role) == 0) | (initial < 0), 3).otherwise(initial)
    return F.when(fault.isin("blank", "duplicate"), GONE).otherwise(2 * initial + F.coalesce(fault == "truncated", F.lit(False)).cast("int")).cast("int")


def _segments(convs: np.ndarray) -> list[tuple[int, int]]:
    """Where each conversation of a block begins and ends."""
    cuts = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)]
    return list(zip(cuts, cuts[1:], strict=False))


def _sums(block: pd.DataFrame) -> pd.DataFrame:
    """The first and the last conversation of a block, which may go on in others."""
    block = block.sort_values("place")
    kinds, rows = block["kind"].tolist(), []
    parts = _segments(block["conv"].to_numpy(object))
    for part, (a, b) in [(0, parts[0]), (len(parts) - 1, parts[-1])][: len(parts)]:
        before, leads = _table().summed(kinds[a:b])
        rows.append((block["block"].iat[0], block["conv"].iat[a], part, before, [x for four in leads for x in four]))
    return pd.DataFrame(rows, columns=["block", "conv", "part", "before", "leads"])


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """A conversation's parts, one a block: the state after each, and where the trace enters it."""
    parts = parts.sort_values("block")
    state, states = _table().end, []
    for before in parts["before"].iloc[::-1]:
        states.append(state)
        state = int(before[state])
    q, enters = NOTHING, []
    for after, leads in zip(reversed(states), parts["leads"], strict=True):
        enters.append(q)
        q = int(leads[4 * after + q])
    n = np.arange(len(parts))
    return parts[["block", "part"]].assign(state=states[::-1], enter=enters, is_first=n == 0, is_last=n == len(parts) - 1)


def _edits(block: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("place")
    kinds, rows = block["kind"].tolist(), []
    known = {r.part: (r.state, r.enter, r.is_first, r.is_last) for r in ends.itertuples()}
    for part, (a, b) in enumerate(_segments(block["conv"].to_numpy(object))):
        rows += _table().traced(kinds[a:b], *known.get(part, (_table().end, NOTHING, True, True)))
    out = pd.DataFrame(rows, columns=["edits", "before", "new_role", "after", "cost"])
    return out.assign(place=block["place"].to_numpy())


def edited(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``faulted`` rows with their edits: adds edits, before, new_role, after and cost.

    ``edits`` are initials in order: I for each row put in before, then K
    (keep), R (another role, ``new_role``) or D (delete) for the row, and after
    a conversation's last row I for each row put in there. ``before`` and
    ``after`` are the roles put in, comma-separated; their texts are empty.
    ``cost`` adds up to that of the conversation. Of cheapest edits those whose
    initials come first in ASCII are taken. No rows give no rows.

    Blocks of 2^``block_bits`` places hold kinds of rows only, no texts.
    """
    home = shared_dir(rows.sparkSession)
    kinds = rows.select(F.shiftright("place", block_bits).alias("block"), F.col("conv_id").cast("string").alias("conv"), "place", _kind(F.col("role"), F.col("fault")).alias("kind"))
    kinds = stored(kinds, f"{home}/kinds")
    sums = kinds.groupBy("block").applyInPandas(_sums, "block long, conv string, part int, before array<int>, leads array<int>")
    # the parts of one conversation: at most one for each block that it lies in
    ends = sums.groupBy("conv").applyInPandas(_joined, "block long, part int, state int, enter int, is_first boolean, is_last boolean")
    ends = stored(ends, f"{home}/ends")
    schema = "edits string, before string, new_role string, after string, cost long, place long"
    edits = kinds.groupBy("block").cogroup(ends.groupBy("block")).applyInPandas(_edits, schema)
    return rows.join(edits, "place")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, part, role, text): the rows of ``edited`` after repair, in the order of place and part."""
    put = lambda c: F.transform(F.filter(F.split(c, ","), lambda r: r != ""), lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.contains("edits", F.lit("D")), F.array().cast("array<struct<role:string,text:string>>"))
    own = own.otherwise(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))))
    return rows.select("conv_id", "place", F.posexplode(F.concat(put("before"), own, put("after"))).alias("part", "row")).select("conv_id", "place", "part", "row.*")


SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Digest:
    """One conversation as its rows pass by."""

    def __init__(self, conv):
        self.conv, self.turns, self.low, self.high, self.last = conv, 0, None, None, None
        self.faults, self.illegal, self.cost, self.audit, self.sha, self.any = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, [], hashlib.sha256(), False
        self.initial = None

    def say(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def add(self, turn, role, text, fault, edits, before, new_role, after, cost) -> None:
        if turn is not None and turn != self.last:  # turns ascend
            self.turns, self.last = self.turns + 1, turn
            turn = int(turn)
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault is not None:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.cost += cost
        self.audit.append(edits)
        for r in before.split(",") if before else ():
            self.say(r, "")
        if "D" not in edits:
            self.say(role if new_role is None else new_role, text)
        for r in after.split(",") if after else ():
            self.say(r, "")

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, known = None, ["turn", "role", "text", "fault", "edits", "before", "new_role", "after", "cost"]
    for batch in batches:
        done = []
        for conv, *row in zip(batch["conv"], *(batch[c] for c in known), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(*row)
        yield pd.DataFrame(done, columns=[c.split()[0] for c in SUMMARY.split(", ")])
    if now is not None:
        yield pd.DataFrame([now.row()], columns=[c.split()[0] for c in SUMMARY.split(", ")])


def summaries(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``edited`` rows.

    ``gaps`` counts turns that are missing between the first and the last,
    ``illegal`` neighbours whose initials are not su, ua or au; the hash is of
    the repaired rows, ``role:text`` and newlines between them. A hash and an
    audit are of a whole conversation in order, so its rows pass through one
    task; they are streamed, and only the audit is kept.
    """
    sent = rows.select(
        F.col("conv_id").cast("string").alias("conv"), "place", F.col("turn").cast("long").cast("string").alias("turn"), "role", "text", "fault",
        "edits", "before", "new_role", "after", "cost",
    )
    sent = sent.repartition("conv").sortWithinPartitions("conv", "place")
    with batches_of(rows.sparkSession):
        out = stored(sent.mapInPandas(_digests, SUMMARY), f"{shared_dir(rows.sparkSession)}/summaries")
    return out.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *out.columns[1:])
