"""Conversation structure repair: the cheapest edits that make turns alternate.

The roles of a sound conversation spell `(s?(ua)+)?`: the empty string, and one
string of each length from two on. A conversation's turns are aligned with the
string of every feasible length in Wagner and Fischer's table. Counted from their
ends these strings agree, so that one table of (turns left, roles left) serves all
lengths. Ukkonen's band keeps to the cells that a known repair's cost, the
incumbent, allows. The audits of all cheapest alignments, of whatever length, are
backtraced side by side and the least is taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns_from

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Edits by number, in the order in which ties are settled.
EDITS = "DIKR"
_D, _I, _K, _R = range(4)
_SPACES = " \t\n\x0b\x0c\r"
_SOUND = ("su", "ua", "au")
_NEVER = 1 << 40
#: The costs of every so many rows of a table are kept; the choices of the rows between are counted again from them when they are backtraced.
_BLOCK, _BLOCKS = 256, 8

Turn = tuple[str, str]  # role, text


def faults(turns: Sequence[Turn]) -> list[str]:
    """Each turn's first fault: blank, duplicate, truncated, or none ("")."""
    seen: set[Turn] = set()
    out = []
    for turn in turns:
        solid = turn[1].rstrip(_SPACES)
        out.append("blank" if not solid else "duplicate" if turn in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add(turn)
    return out


def incumbent(roles: str, faulty: Sequence[str]) -> int:
    """The cost of one repair: a turn that comes too early gets the turn that it misses before it, other roles are changed."""
    cost, last = 0, ""
    for role, fault in zip(roles, faulty):
        if fault in ("blank", "duplicate"):
            cost += DELETE
            continue
        cost += TRUNCATED * (fault == "truncated")
        if not last and role == "s":
            last = "s"
            continue
        due = "a" if last == "u" else "u"
        cost += 0 if role == due else INSERT if role in "ua" else REROLE
        last = role if role in "ua" else due
    return cost + INSERT * {"s": 2, "u": 1}.get(last, 0)


class _Table:
    """Wagner and Fischer's table of turns i.. against the last k roles of an alternating string, for all i and k within the band.

    `rows` are a pair of arrays over k: costs of the roles alone, and of an s before
    them. With u turns from i on that may stay, and a budget of b insertions or
    deletions beyond the forced ones, k lies between u - 1 - b and u + b.
    """

    def __init__(self, roles: str, faulty: Sequence[str]):
        self.n, self.roles = len(roles), roles
        self.forced = [f in ("blank", "duplicate") for f in faulty]
        self.extra = [TRUNCATED * (f == "truncated") for f in faulty]
        # an insertion costs two, a deletion two at least beyond what keeping the turn would
        self.slack = (incumbent(roles, faulty) - DELETE * sum(self.forced) - sum(self.extra)) // min(INSERT, DELETE - TRUNCATED)
        self.at = np.arange(2 * self.slack + 2)
        self.low = (np.cumsum([0, *(not f for f in self.forced[::-1])])[::-1] - 1 - self.slack).tolist()
        k = self.at + self.low[self.n]
        end = np.where(k >= 0, INSERT * k, _NEVER), np.full(len(k), _NEVER)
        self.marks, self.blocks = {self.n: end}, {}
        rows = end
        for i in range(self.n - 1, -1, -1):
            rows = self._row(i, rows)[:2]
            if i % _BLOCK == 0:
                self.marks[i] = rows
        self.first = rows

    def _row(self, i: int, after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row i from the row after it: the costs of both kinds, and the number of the least cheapest edit of each."""
        k = self.at + self.low[i]
        plain, headed = after
        never = np.full(len(k), _NEVER)
        options = {e: never for e in range(4)}
        if self.forced[i]:
            options[_D], head_d, head_k = DELETE + plain, DELETE + headed, never
        else:
            up = np.append(plain[1:], _NEVER)
            options[_D], head_d = DELETE + up, DELETE + np.append(headed[1:], _NEVER)
            taken = np.where(k > 0, plain + self.extra[i], _NEVER)
            options[_R] = taken + REROLE
            if self.roles[i] in "ua":
                options[_K] = np.where(k % 2 == (self.roles[i] == "a"), taken, _NEVER)
            head_k = up + self.extra[i] if self.roles[i] == "s" else never
        base = np.where(k >= 0, np.minimum(np.minimum(options[_D], options[_K]), options[_R]), _NEVER)
        cost = np.minimum(np.minimum.accumulate(base - INSERT * self.at) + INSERT * self.at, _NEVER)
        options[_I] = np.append(_NEVER, cost[:-1]) + INSERT
        choice = np.full(len(k), _R, np.uint8)
        for e in (_K, _I, _D):
            choice[options[e] == cost] = e
        head = np.minimum(np.minimum(head_d, head_k), _NEVER)
        return cost, head, choice, np.where(head_d == head, _D, _K).astype(np.uint8)

    def choices(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = i // _BLOCK
        if b not in self.blocks:
            if len(self.blocks) >= _BLOCKS:
                self.blocks.pop(next(iter(self.blocks)))
            last = min(self.n, (b + 1) * _BLOCK)
            rows, found = self.marks[last], {}
            for r in range(last - 1, b * _BLOCK - 1, -1):
                *rows, plain, headed = self._row(r, tuple(rows))
                found[r] = plain, headed
            self.blocks[b] = found
        return self.blocks[b][i]

    def best(self) -> tuple[int, set[tuple[bool, int, int]]]:
        """The least cost over all feasible lengths, and the cells (s due, turn, roles left) from which it is had."""
        k = self.at + self.low[0]
        plain, headed = (np.where((k >= least) & (k % 2 == 0), row, _NEVER) for row, least in zip(self.first, (0, 2)))
        cost = int(min(plain.min(), headed.min()))
        return cost, {(s, 0, int(x)) for s, row in ((False, plain), (True, headed)) for x in k[row == cost]}

    def audit(self, cells: set[tuple[bool, int, int]]) -> str:
        """The least of the audits from the given cells: all that agree so far go on together."""
        out = []
        while not any(not s and i == self.n and k == 0 for s, i, k in cells):
            edit = {c: _I if c[1] == self.n else int(self.choices(c[1])[c[0]][c[2] - self.low[c[1]]]) for c in cells}
            least = min(edit.values())
            out.append(EDITS[least])
            cells = {(s and least != _K, i + (least != _I), k - (least != _D and not s)) for (s, i, k), e in edit.items() if e == least}
        return "".join(out)


def edited(turns: Sequence[Turn], audit: str) -> list[Turn]:
    """The turns after the edits of an audit. Its length says which string it leads to."""
    left = sum(e != "D" for e in audit)
    s_due, out, i = left % 2 == 1, [], 0
    for e in audit:
        if e != "D":
            role = "user" if left % 2 == 0 else "assistant"
            out.append(turns[i] if e == "K" else (role, "" if e == "I" else turns[i][1]))
            left, s_due = left - 1, False
        i += e != "I"
    return out


def aligned(roles: str, faulty: Sequence[str]) -> tuple[int, str]:
    """The least cost, and the least audit of that cost, for turns of these role initials and faults."""
    table = _Table(roles, faulty)
    cost, cells = table.best()
    return cost, table.audit(cells)


#: Short conversations are often alike in roles and faults; an alignment depends on nothing else.
_remembered = lru_cache(maxsize=50_000)(aligned)
_SHORT = 32


def repaired(turns: Sequence[Turn]) -> tuple[int, str, list[Turn]]:
    """(cost, audit, turns) of the cheapest repair with the least audit."""
    align = _remembered if len(turns) <= _SHORT else aligned
    cost, audit = align("".join(role[:1] or "\0" for role, _ in turns), tuple(faults(turns)))
    return cost, audit, edited(turns, audit)


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) for each conversation.

    Turns are taken by number (nulls first), then role and text. gaps counts the
    numbers between the least and the greatest that no turn has; the next three
    count turns by first fault, illegal the neighbours whose roles can't follow each
    other. repaired is an array of (role, text).

    present: rows that don't meet it only name their conversation, which is empty if
    it has no others: zeros, an empty audit and no turns. Null roles and texts are
    one space: such a turn is blank, or of no known role. Rows of a null
    conversation are one conversation; a repeated row is a duplicate turn; an empty
    table gives none; other columns aren't read. A conversation is one row of the
    result with all of its turns, so it is also one group; the time for it grows
    with turns times faults, the memory beyond its texts with the band's width.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    )
    there = turn if present is None else F.when(present, turn)
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(there)).alias("turns"))
    numbers = F.filter("turns.turn", lambda x: x.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")

    def find(conversations: list) -> dict[str, pa.Array]:
        counts, out = [], []
        for turns in conversations:
            turns = [(t["role"], t["text"]) for t in turns]
            kinds = faults(turns)
            cost, audit, mended = repaired(turns)
            illegal = sum(a[0][:1] + b[0][:1] not in _SOUND for a, b in zip(turns, turns[1:]))
            counts.append((*map(kinds.count, ("blank", "duplicate", "truncated")), illegal, cost))
            out.append((audit, [{"role": r, "text": t} for r, t in mended]))
        found = {c: pa.array([r[k] for r in counts], pa.int64()) for k, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost"))}
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        return found | {"audit": pa.array([a for a, _ in out], pa.string()), "repaired": pa.array([m for _, m in out], kind)}

    schema = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"
    return with_columns_from(grouped.select("conv_id", gaps.alias("gaps"), "turns"), "turns", find, schema, drop=True)
