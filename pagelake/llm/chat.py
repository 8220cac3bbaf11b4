"""Chat formatting: the cheapest repair of a role sequence, then its rendering.

A conversation is legal when an optional system turn is followed by user and assistant turns in alternation, from a
user turn to an assistant turn. Every turn may be kept, relabelled or merged into the turn before it, and empty turns
may be inserted; dynamic programming over the states of that automaton finds the repair of least cost. One turn maps
states to states with a small matrix of costs, and such matrices compose, so a conversation may be cut anywhere:
turns are range-partitioned in order, and where a partition ends inside a conversation its parts are first summed up
by their matrices, which fix the states at the cuts, and then repaired one by one. No conversation is gathered.

The result has one row per piece (a turn, a merged turn or an inserted one); ``rendered`` of all pieces in order is
the text. Costs: merge 1, relabel 2 (1 for an unknown role), insertion 3. Of equal repairs the first in the order
keep, merge, relabel, insert is taken, and of equal states the least, from the last turn backwards; the matrices carry
that order too, so the result does not depend on where partitions cut a conversation.

Defined results: a null or unknown role has to be relabelled; a null text is empty; turns are ordered by ``turn``
(nulls first), role and text, so ties and repeated rows have a fixed order; rows without ``conv_id`` form one
conversation; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
SAME_AS = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}
START = 3  # states are the role of the turn last written, or START
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}  # roles that may follow a state
LAST = (2,)
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
NEVER = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

Step = tuple[str, int]  # action and role


def inserted() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest chains of inserted roles between any two states."""
    found: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (a, b), chain in list(found.items()):
            for role in NEXT[b]:
                if (a, role) not in found or len(found[a, role]) > len(chain) + 1:
                    found[a, role] = (*chain, role)
    return found


INSERTED = inserted()


def choices(kind: int, state: int) -> list[tuple[int, int, list[Step]]]:
    """``cost, state after, steps`` of every way to take a turn of a kind (a role, or 3: unknown) in a state."""
    out = []
    change = RELABEL_UNKNOWN if kind == 3 else RELABEL
    for (a, b), chain in INSERTED.items():
        if a != state:
            continue
        steps = [("insert", r) for r in chain]
        cost = INSERT * len(chain)
        for role in NEXT[b]:
            out.append((cost + (0 if role == kind else change), role, [*steps, ("keep" if role == kind else "relabel", role)]))
        if b == state and state != START:
            out.append((MERGE + (0 if state == kind else change), state, [("merge", state)]))
    rank = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}
    out.sort(key=lambda x: (x[0], len(x[2]), rank[x[2][-1][0]], x[1]))
    return out


BEST: dict[tuple[int, int, int], tuple[int, list[Step]]] = {}
for _kind in range(4):
    for _state in range(4):
        for _cost, _after, _steps in choices(_kind, _state):
            BEST.setdefault((_kind, _state, _after), (_cost, _steps))
FINISH = {s: min((INSERT * len(INSERTED[s, e]), e) for e in LAST if (s, e) in INSERTED) for s in range(4)}


def kind_of(role: str | None) -> int:
    role = (role or "").strip().lower()
    role = SAME_AS.get(role, role)
    return ROLES.index(role) if role in ROLES else 3


def costs(kinds: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Least cost from each state to each state over these turns, and the rank of each way among those to one state.

    Ways to a state are ranked as ``repair`` chooses among ways of one cost: by the state before it, and so on back.
    """
    table = [[0 if a == b else NEVER for b in range(4)] for a in range(4)]
    ranks = [[0] * 4 for _ in range(4)]
    for k in kinds:
        moves = [(s, e, BEST[k, s, e][0]) for s in range(4) for e in range(3) if (k, s, e) in BEST]
        new = [[(NEVER, 4)] * 4 for _ in range(4)]
        for a in range(4):
            for s, e, c in moves:
                new[a][e] = min(new[a][e], (table[a][s] + c, s))
        ordered = [sorted(range(4), key=lambda a, e=e: (s := new[a][e][1], ranks[a][s] if s < 4 else 0)) for e in range(4)]
        ranks = [[ordered[e].index(a) for e in range(4)] for a in range(4)]
        table = [[min(NEVER, c) for c, _ in row] for row in new]
    return table, ranks


def repair(kinds: list[int], entry: int = START, leave: int | None = None) -> tuple[list[list[Step]], list[Step]]:
    """Steps for each turn from state ``entry``, and the insertions after them.

    ``leave`` is the state to end in when the conversation goes on; without it the conversation ends here.
    """
    reached: list[dict[int, tuple[int, int]]] = [{entry: (0, entry)}]  # state -> cost, state before
    for k in kinds:
        new: dict[int, tuple[int, int]] = {}
        for s, (cost, _) in sorted(reached[-1].items()):
            for e in range(3):
                if (k, s, e) in BEST and (e not in new or cost + BEST[k, s, e][0] < new[e][0]):
                    new[e] = (cost + BEST[k, s, e][0], s)
        reached.append(new)
    if leave is None:
        state = min(reached[-1], key=lambda s: (reached[-1][s][0] + FINISH[s][0], s))
        end = [("insert", r) for r in INSERTED[state, FINISH[state][1]]]
    else:
        state, end = leave, []
    steps = []
    for k, at in zip(reversed(kinds), reversed(reached[1:]), strict=True):
        before = at[state][1]
        steps.append(BEST[k, before, state][1])
        state = before
    return steps[::-1], end


def pieces_of(turns: list[tuple], entry: int = START, leave: int | None = None) -> list[tuple]:
    """Rows ``turn, role, action, rendered`` for turns ``(turn, role, text)``; every head closes the turn before it."""
    steps, end = repair([kind_of(r) for _, r, _ in turns], entry, leave)
    out: list[list] = []
    state = entry
    for (turn, _, text), own in [*zip(turns, steps, strict=True), *([((None, None, None), end)] if end else [])]:
        for n, (action, role) in enumerate(own):
            words = (text or "") if n == len(own) - 1 and action != "insert" else ""
            head = "\n" if action == "merge" else (CLOSE if state != START else "") + OPEN.format(ROLES[role])
            out.append([turn, ROLES[role], action, head + words + ("" if words.endswith("\n") or not words else "\n")])
            state = role
    if leave is None and out:
        out[-1][3] += CLOSE
    return [tuple(r) for r in out]


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id, piece, turn, role, action, rendered``; ``piece`` counts from 0 in each conversation."""
    kind_id, kind_turn = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    order = ["conv_id", "turn", "role", "text"]
    turns = conversations.select(*order)
    partitions = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = turns.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()) \
        .withColumn("place", F.monotonically_increasing_id())

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repair the conversations inside a partition; pass on the turns of the first and the last one."""
        id_type, turn_type = None, None
        run: list[tuple] = []
        first = True

        def rows(found: list[tuple], open_: bool) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [[]] * 8
            kinds = [id_type, pa.bool_(), pa.int32(), pa.int64(), turn_type, pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                              names=["conv_id", "open", "part", "piece", "turn", "role", "action", "rendered"])

        def finished(run: list[tuple]) -> list[tuple]:
            return [(run[0][0], False, None, i, *p) for i, p in enumerate(pieces_of([r[1:4] for r in run]))]

        def passed_on(run: list[tuple]) -> list[tuple]:
            return [(c, True, part, place, turn, role, None, text) for c, turn, role, text, part, place in run]

        for b in batches:
            id_type, turn_type = b.schema.field("conv_id").type, b.schema.field("turn").type
            done: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "part", "place")), strict=True):
                if run and run[0][0] != row[0]:
                    done += passed_on(run) if first else finished(run)
                    run, first = [], False
                run.append(row)
            yield rows(done, False)
        if run:
            yield rows(passed_on(run), True)

    fields = f"conv_id {kind_id}, open boolean, part int, piece bigint, turn {kind_turn}, role string, action string, rendered string"
    both = stored(dealt.mapInArrow(first_pass, fields), "pieces")
    cut = both.where("open").withColumn("id", F.struct("conv_id"))

    def summed(part: pa.Table) -> pa.Table:
        part = part.sort_by("piece")
        tables = costs([kind_of(r) for r in part.column("role").to_pylist()])
        return pa.table({"conv_id": part.column("conv_id").slice(0, 1), "part": part.column("part").slice(0, 1),
                         **{name: pa.array([[x for row in t for x in row]], pa.list_(pa.int64())) for name, t in zip(("costs", "ranks"), tables, strict=True)}})

    def placed(parts: pa.Table) -> pa.Table:
        """States at the cuts of one conversation, at most one part for each partition."""
        parts = parts.sort_by("part")
        reached = [{START: (0, START)}]
        for t, ranks in zip(parts.column("costs").to_pylist(), parts.column("ranks").to_pylist(), strict=True):
            ways = {e: [(cost + t[4 * s + e], ranks[4 * s + e], s) for s, (cost, _) in reached[-1].items() if t[4 * s + e] < NEVER] for e in range(3)}
            reached.append({e: (min(w)[0], min(w)[2]) for e, w in ways.items() if w})
        state = min(reached[-1], key=lambda s: (reached[-1][s][0] + FINISH[s][0], s))
        states = []
        for at in reversed(reached[1:]):
            states.append((at[state][1], state))
            state = at[state][1]
        states.reverse()
        return pa.table({"conv_id": parts.column("conv_id"), "part": parts.column("part"), "entry": pa.array([a for a, _ in states], pa.int32()),
                         "leave": pa.array([*(b for _, b in states[:-1]), None], pa.int32())})

    parts = cut.groupBy("conv_id", "part").applyInArrow(summed, f"conv_id {kind_id}, part int, costs array<bigint>, ranks array<bigint>")
    states = stored(parts.groupBy("conv_id").applyInArrow(placed, f"conv_id {kind_id}, part int, entry int, leave int"), "states")

    def second_pass(part: pa.Table) -> pa.Table:
        part = part.sort_by("piece")
        entry, leave = part.column("entry")[0].as_py(), part.column("leave")[0].as_py()
        turns = list(zip(*(part.column(c).to_pylist() for c in ("turn", "role", "rendered")), strict=True))
        found = pieces_of(turns, entry, leave)
        n = len(found)
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.table({
            "conv_id": pa.array([part.column("conv_id")[0].as_py()] * n, part.schema.field("conv_id").type),
            "part": pa.array([part.column("part")[0].as_py()] * n, pa.int32()), "piece": pa.array(list(range(n)), pa.int64()),
            "turn": pa.array(columns[0], part.schema.field("turn").type), "role": pa.array(columns[1], pa.string()),
            "action": pa.array(columns[2], pa.string()), "rendered": pa.array(columns[3], pa.string())})

    known = cut.drop("id").join(states.withColumnsRenamed({"conv_id": "c", "part": "p"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))) \
        .select("conv_id", "part", "piece", "turn", "role", "rendered", "entry", "leave")
    mended = stored(known.groupBy("conv_id", "part").applyInArrow(
        second_pass, f"conv_id {kind_id}, part int, piece bigint, turn {kind_turn}, role string, action string, rendered string"), "mended")
    # at most two rows for each partition
    counts = mended.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    mended = mended.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("piece", F.col("piece") + F.col("offset"))
    columns = ["conv_id", "piece", "turn", "role", "action", "rendered"]
    return both.where("not open").select(*columns).unionByName(mended.select(*columns))
