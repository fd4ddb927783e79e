"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. The
automaton's state is the role of the open message. Every turn may be kept, relabelled, merged into the open
message, or preceded by an inserted empty message; each choice has a cost, and dynamic programming finds the
cheapest legal sequence. The recurrence is a product of small (min, +) matrices, one a turn, and the product is
associative: conversations are range-partitioned by (conv_id, turn), so that a long one spans several tasks; each
task reduces its stretch to one matrix, the stretches of a conversation are multiplied in order, and every stretch
is then traced on its own from the state that it is entered in. Only conversations of several stretches take part in
that; one that lies inside a stretch is settled with it. Steps are planned from roles alone: texts stay in the JVM,
where each gets its prefix and suffix, so that no task holds the texts of a stretch, and none a whole conversation.

The rendered conversation is one fragment a turn, in order of seq: concatenated, they are the repaired text.

Defined results: turns are ordered by (turn, role, text), nulls first; an unknown or null role can only be
relabelled or merged; a null text is empty; a null conv_id is a conversation; repeated rows are turns of their
own; an empty table gives no rows; texts of any length are rendered whole; of equal costs the choice first in the order
keep, merge, relabel, insert wins; columns other than conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import cut, grouped, map_arrow, session

ROLES = ("system", "user", "assistant")
#: Costs of an edit: merging with the same role, relabelling, inserting an empty message.
MERGE, RELABEL, INSERT = 1, 2, 3
START, S, U, A = range(4)
_NEXT = {START: (S, U), S: (U,), U: (A,), A: (U,)}
#: Turns of one stretch at most; longer runs inside a task are cut so that traces stay small (roles, no texts).
STRETCH = 20_000
_BIG = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _choices(role: str | None):
    """For each state: new state -> (cost, action, inserted role or None), the cheapest, first of equals."""
    own = {"system": S, "user": U, "assistant": A}.get(role)
    out = []
    for q in range(4):
        best: dict[int, tuple[int, str, int | None]] = {}

        def offer(to, cost, action, inserted=None, best=best):
            if to not in best or cost < best[to][0]:
                best[to] = (cost, action, inserted)

        for e in _NEXT[q]:
            if e == own:
                offer(e, 0, "keep")
        if q != START:
            offer(q, MERGE + (0 if q == own else RELABEL), "merge")
        for e in _NEXT[q]:
            if e != own:
                offer(e, RELABEL, "relabel")
        for x in _NEXT[q]:
            if x != S:
                for e in _NEXT[x]:
                    offer(e, INSERT + (0 if e == own else RELABEL), "insert", x)
        out.append(best)
    return out


_TABLE = {r: _choices(r) for r in (*ROLES, None)}
_MATRIX = {r: np.array([[t[q].get(p, (_BIG,))[0] for p in range(4)] for q in range(4)], np.int64) for r, t in _TABLE.items()}
#: Cost of ending in a state: only the assistant may be last, else an empty reply is inserted.
FINAL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def _known(role):
    return role if role in ROLES else None


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product of 4 x 4 cost matrices."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _BIG)


def reduce_roles(roles: list) -> np.ndarray:
    out = np.full((4, 4), _BIG, np.int64)
    np.fill_diagonal(out, 0)
    for r in roles:
        out = product(out, _MATRIX[_known(r)])
    return out


def trace(roles: list, start: int, end: int) -> list[tuple[int, str, int | None, int]]:
    """(state, action, inserted, cost) of every turn on a cheapest way from `start` to `end`."""
    ways, cost = [], {start: 0}
    for r in roles:
        new: dict[int, int] = {}
        way: dict[int, int] = {}
        for q in sorted(cost):
            for p, (c, _, _) in _TABLE[_known(r)][q].items():
                if p not in new or cost[q] + c < new[p]:
                    new[p], way[p] = cost[q] + c, q
        ways.append(way)
        cost = new
    out, p = [], end
    for r, way in zip(reversed(roles), reversed(ways), strict=True):
        q = way[p]
        c, action, inserted = _TABLE[_known(r)][q][p]
        out.append((p, action, inserted, c))
        p = q
    return out[::-1]


def repair(roles: list) -> tuple[int, list[tuple[int, str, int | None, int]]]:
    """(cost, steps) of one conversation held in memory."""
    total = reduce_roles(roles)[START] + FINAL
    end = int(total.argmin())
    return int(total[end]), trace(roles, START, end) if roles else []


def _message(role: int, text: str = "") -> str:
    return OPEN.format(ROLES[role - 1]) + text


def frames(steps, last: bool, entered: int = START) -> list[tuple[str, str]]:
    """What stands before and after the text of each of a stretch's turns; `last` closes the conversation."""
    out, q = [], entered
    for p, action, inserted, _ in steps:
        if action == "merge":
            out.append(("\n", ""))
        else:
            head = CLOSE if q != START else ""
            if inserted is not None:
                head += _message(inserted) + CLOSE
            out.append((head + _message(p), ""))
        q = p
    if last and out:
        tail = CLOSE
        if q == S:
            tail += _message(U) + CLOSE
        if q != A:
            tail += _message(A) + CLOSE
        out[-1] = (out[-1][0], tail)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, role, new_role, action, inserted, cost, seq, fragment.

    `seq` is the turn's place in its conversation, from 0; `cost` is the turn's share of the conversation's repair, with
    that of replies inserted at the end on its last turn.
    """
    spark = session(turns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "digest"]
    rows = rows.withColumns({"digest": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})  # a tie lets a range boundary fall between equal rows
    rows = rows.repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order, "text", "tie").drop("digest", "tie")  # range keys are sampled on the driver, so no text is one
    rows = cut(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    # A stretch: a run of one conversation inside a task, cut where it grows long. `at` rises along the order.
    roles = rows.select("conv_id", "part", F.floor(F.col("at") % F.lit(1 << 33) / STRETCH).alias("stretch"), "at", "role")

    def make():
        state = {"key": None, "m": None, "at": 0, "n": 0, "before": None}

        def emit(after):
            """The open stretch; it is whole where the stretches around it, in this task, are of other conversations."""
            key, m = state["key"], state["m"]
            ends = [x is not None and x[0] != key[0] for x in (state["before"], after)]
            whole, way = all(ends), {}
            if whole:
                total = m[START] + FINAL
                leave = int(total.argmin())
                way = {"enter": START, "leave": leave, "last": True, "tail": int(FINAL[leave]), "base": 0}
            state["before"] = key
            row = {"conv_id": key[0], "part": key[1], "stretch": key[2], "first": state["at"], "n": state["n"], "m": None if whole else m.ravel().tolist()}
            return {k: [v] for k, v in (row | {k: way.get(k) for k in ("enter", "leave", "last", "tail", "base")}).items()}

        def each(b):
            cols = [b.column(k).to_pylist() for k in ("conv_id", "part", "stretch", "at", "role")]
            out: dict[str, list] = {}
            for *key, at, role in zip(*cols, strict=True):
                if state["key"] != key:
                    if state["key"] is not None:
                        for k, v in emit(key).items():
                            out.setdefault(k, []).extend(v)
                    state.update(key=key, m=reduce_roles([]), at=at, n=0)
                state["n"] += 1
                state["m"] = product(state["m"], _MATRIX[_known(role)])
            if out:
                yield out

        def close():
            if state["key"] is not None:
                yield emit(None)

        each.close = close
        return each

    way = "enter int, leave int, last boolean, tail long, base long"
    pieces = cut(map_arrow(roles, make, f"conv_id long, part int, stretch long, first long, n long, m array<long>, {way}"))

    def plan(g: dict[str, list]) -> dict[str, list]:
        order = np.argsort(np.array(g["first"], np.int64))
        ms = [np.array(g["m"][k], np.int64).reshape(4, 4) for k in order]
        fronts = [np.array([0, _BIG, _BIG, _BIG], np.int64)]
        for m in ms:
            fronts.append((fronts[-1][:, None] + m).min(axis=0))
        end = int((fronts[-1] + FINAL).argmin())
        leave = [end]
        for m, front in zip(reversed(ms), reversed(fronts[:-1]), strict=True):
            leave.append(int((front + m[:, leave[-1]]).argmin()))
        leave = leave[::-1]
        n = np.array([g["n"][k] for k in order])
        out = {k: [g[k][i] for i in order] for k in ("conv_id", "part", "stretch")}
        return out | {"enter": leave[:-1], "leave": leave[1:], "last": [k == len(n) - 1 for k in range(len(n))], "tail": [0] * (len(n) - 1) + [int(FINAL[end])], "base": np.cumsum(n) - n}

    keys = ["conv_id", "part", "stretch"]
    whole = pieces.where("m is null").select(*keys, "enter", "leave", "last", "tail", "base")
    spread = grouped(pieces.where("m is not null").select(*keys, "first", "n", "m"), ["conv_id"], plan, f"conv_id long, part int, stretch long, {way}")
    ways = whole.unionByName(spread).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("stretch").alias("s"), "enter", "leave", "last", "tail", "base")
    both = roles.join(ways, roles["conv_id"].eqNullSafe(ways["c"]) & (roles["part"] == ways["p"]) & (roles["stretch"] == ways["s"])).drop("c", "p", "s")

    def planned(g: dict[str, list]) -> dict[str, list]:
        order = sorted(range(len(g["at"])), key=g["at"].__getitem__)
        g = {k: [v[i] for i in order] for k, v in g.items()}
        steps = trace(g["role"], g["enter"][0], g["leave"][0])
        cost = [s[3] for s in steps]
        cost[-1] += g["tail"][0]
        around = frames(steps, g["last"][0], g["enter"][0])
        return {
            "at": g["at"], "new_role": [ROLES[s[0] - 1] for s in steps], "action": [s[1] for s in steps], "inserted": [None if s[2] is None else ROLES[s[2] - 1] for s in steps],
            "cost": cost, "seq": [g["base"][0] + k for k in range(len(steps))], "prefix": [x for x, _ in around], "suffix": [x for _, x in around],
        }

    steps = grouped(both, keys, planned, "at long, new_role string, action string, inserted string, cost long, seq long, prefix string, suffix string")
    fragment = F.concat("prefix", F.coalesce("text", F.lit("")), "suffix").alias("fragment")
    return rows.join(steps, "at").select("conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "seq", fragment)


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
