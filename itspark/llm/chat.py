"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with an assistant.
Every turn keeps its role or gets another; a turn of the role before it is merged into that one; a missing
turn is inserted empty. The cheapest repair is a shortest path over the automaton's states (start, system,
user, assistant), found by dynamic programming. Costs of stretches of a conversation compose like matrices
in which sums take the place of products and minima that of sums, so a conversation may span tasks: turns are
range-sorted by conversation and turn, each task solves the conversations that lie inside its range, and for
the two at its ends gives the 4 x 4 matrix of its stretch. The matrices of a conversation, one per range,
settle the states between its stretches, and these are then traced on their own.

The result is one row per turn with a piece of rendered text; a conversation's pieces in order are its text.

Cases: a null or unknown role may become any at a small cost; a null text is empty; turns with equal numbers
are ordered by role and text, null first; all turns without a conversation id are one conversation; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.llm.common import shuffle_partitions, staged

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns that must stand between two states for the second to follow the first; None: it never can.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Turns that are missing at the end.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
NEVER = 1 << 40


@dataclass(frozen=True)
class Costs:
    relabel: int = 3
    name: int = 1  # give a role to a turn without one
    merge: int = 1
    insert: int = 2


def moves(role: str | None, costs: Costs) -> list[tuple[int, int, int, bool]]:
    """(from, to, cost, merged) that a turn of a role may make, in the order in which ties are settled."""
    found = []
    for to in (SYSTEM, USER, ASSISTANT):
        named = 0 if ROLES[to] == role else costs.relabel if role in ROLES[1:] else costs.name
        for at in range(4):
            if at == to:
                found.append((at, to, named + costs.merge, True))
            if (at, to) in BETWEEN and (at != to or costs.insert * len(BETWEEN[at, to]) < costs.merge):
                found.append((at, to, named + costs.insert * len(BETWEEN[at, to]), False))
    return found


def closing(costs: Costs) -> list[int]:
    return [costs.insert * len(CLOSING[s]) for s in range(4)]


def forward(roles: list, entry: list[int], costs: Costs, known: dict) -> tuple[list[int], list[list]]:
    """Cheapest cost of each state after the turns, given those before, and the move by which each was reached."""
    now, back = entry, []
    for role in roles:
        steps = known.get(role) or known.setdefault(role, moves(role, costs))
        then, by = [NEVER] * 4, [None] * 4
        for step in steps:
            cost = now[step[0]] + step[2]
            if cost < then[step[1]]:
                then[step[1]], by[step[1]] = cost, step
        back.append(by)
        now = then
    return now, back


def trace(back: list[list], state: int) -> list[tuple[int, int, int, bool]]:
    """The moves that lead to a state."""
    path = []
    for by in reversed(back):
        path.append(by[state])
        state = by[state][0]
    return path[::-1]


def from_state(state: int) -> list[int]:
    return [0 if s == state else NEVER for s in range(4)]


def render(path: list, texts: list, exit_state: int | None) -> list[dict]:
    """Rows of the turns; ``exit_state`` is given where the conversation ends here."""
    out = []
    for (at, to, cost, merged), text in zip(path, texts):
        inserted = [] if merged else list(BETWEEN[at, to])
        opened = [f"<|{ROLES[s]}|>\n" for s in [*inserted, to]]
        before = "\n" if merged else ("" if at == START else "<|end|>\n") + "<|end|>\n".join(opened)
        out.append({"new_role": ROLES[to], "merged": merged, "inserted_before": [ROLES[s] for s in inserted], "inserted_after": [], "cost": cost, "rendered": before + (text or "")})
    if exit_state is not None and out:
        missing = CLOSING[exit_state]
        out[-1]["inserted_after"] = [ROLES[s] for s in missing]
        out[-1]["rendered"] += "".join(f"<|end|>\n<|{ROLES[s]}|>\n" for s in missing) + "<|end|>\n"
    return out


TURN = "conv_id long, turn long, role string, text string"
FIXED = "new_role string, merged boolean, inserted_before array<string>, inserted_after array<string>, cost long, rendered string"
FIRST = f"{TURN}, piece int, costs array<long>, {FIXED}"
_TURN_TYPES = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
_FIXED_TYPES = {
    "new_role": pa.string(), "merged": pa.bool_(), "inserted_before": pa.list_(pa.string()), "inserted_after": pa.list_(pa.string()), "cost": pa.int64(), "rendered": pa.string(),
}


def _batch(rows: list[dict], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], names=list(types))


def _ranges(turns: DataFrame, costs: Costs) -> DataFrame:
    """Solved turns of conversations inside a range; the turns at its ends as they were, with the number of
    the range, and on the first of them the stretch's matrix, row after row."""
    types = {**_TURN_TYPES, "piece": pa.int32(), "costs": pa.list_(pa.int64()), **_FIXED_TYPES}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, known = TaskContext.get().partitionId(), {}
        end_cost = closing(costs)

        def solved(rows: list[dict], is_open: bool) -> list[dict]:
            roles = [r["role"] for r in rows]
            if is_open:
                matrix = [c for s in range(4) for c in forward(roles, from_state(s), costs, known)[0]]
                return [{**r, "piece": piece, "costs": matrix if i == 0 else None} for i, r in enumerate(rows)]
            reached, back = forward(roles, from_state(START), costs, known)
            last = min(range(4), key=lambda s: (reached[s] + end_cost[s], s))
            return [{**r, **f} for r, f in zip(rows, render(trace(back, last), [r["text"] for r in rows], last))]

        held, first, ready = [], True, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[-1]["conv_id"]:
                    ready.extend(solved(held, first))
                    held, first = [], False
                held.append(row)
            if len(ready) > 2000:
                yield _batch(ready, types)
                ready = []
        if held:
            ready.extend(solved(held, True))
        yield _batch(ready, types)

    ordered = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(work, FIRST)


def _settled(pieces: DataFrame, costs: Costs) -> DataFrame:
    """Entry and exit state of each stretch of a conversation, and whether it is the last one."""

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        now, back = from_state(START), []
        for r in rows:
            m = r["costs"]
            ways = [min((now[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
            now, came = [w[0] for w in ways], [w[1] for w in ways]
            back.append(came)
        end_cost = closing(costs)
        state = min(range(4), key=lambda s: (now[s] + end_cost[s], s))
        out = []
        for r, came in zip(reversed(rows), reversed(back)):
            out.append({"conv_id": r["conv_id"], "piece": r["piece"], "entry": came[state], "exit": state, "last": not out})
            state = came[state]
        return pa.Table.from_batches([_batch(out, {"conv_id": pa.int64(), "piece": pa.int32(), "entry": pa.int32(), "exit": pa.int32(), "last": pa.bool_()})])

    return pieces.groupBy("conv_id").applyInArrow(work, "conv_id long, piece int, entry int, exit int, last boolean")


def repair(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, merged, inserted_before, inserted_after, cost, rendered."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    first = staged(_ranges(staged(turns, "turns"), costs), "ranges")
    settled = staged(_settled(first.filter("costs is not null").select("conv_id", "piece", "costs"), costs), "settled")
    left = first.filter("piece is not null").select("conv_id", "turn", "role", "text", "piece").alias("l")
    # At most two stretches a range, so this table is bounded by the number of partitions.
    joined = left.join(F.broadcast(settled.alias("s")), F.col("l.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("l.piece") == F.col("s.piece")))
    stretches = joined.select("l.*", "entry", "exit", "last")
    types = {**{k: v for k, v in _TURN_TYPES.items() if k != "text"}, **_FIXED_TYPES}

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        # As Spark sorts: null first.
        rows.sort(key=lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in ("turn", "role", "text")])
        _, back = forward([r["role"] for r in rows], from_state(rows[0]["entry"]), costs, {})
        fixed = render(trace(back, rows[0]["exit"]), [r["text"] for r in rows], rows[0]["exit"] if rows[0]["last"] else None)
        return pa.Table.from_batches([_batch([{**r, **f} for r, f in zip(rows, fixed)], types)])

    columns = ["conv_id", "turn", "role", *_FIXED_TYPES]
    traced = stretches.groupBy("conv_id", "piece").applyInArrow(work, f"conv_id long, turn long, role string, {FIXED}")
    return first.filter("piece is null").select(*columns).unionAll(traced.select(*columns))
