"""Conversation structure repair: the cheapest edits that give legal roles, found by divide and conquer.

A legal conversation is empty, or an optional system turn and then pairs of user and assistant turns. The output so far is in
one of four states: empty, after system, after user, after assistant. Every row is deleted, kept or gets another role, and
turns with empty texts may be put in anywhere; each edit leads from a state to exactly one other.

Hirschberg's method: from the first row a vector of four costs goes forward, from the last one a vector goes
backward, and they meet at the middle row. Of the states with the least sum, the one is taken whose edits so far come first
in ASCII order (below), then both halves are solved by themselves. So costs are never kept for more than one row.

Which edits come first is carried as a rank of the four states next to their costs: edits up to a row end with the edit
of that row, so those of two states never continue each other and their order is final.

Long conversations are solved in pieces. Rows are sorted by range over conversation and turn, and cut into blocks of at
most ``BLOCK`` rows; a block of a conversation that may go on elsewhere is summed up by the four-by-four costs and ranks
of its ways through. The same method runs over these sums, one short row per block, and gives each block its first and last
state; then blocks are rebuilt independently. A hash of a whole conversation is sequential by nature: its blocks stream in order
through one task, which holds one block, the running hash and the edits so far.

Defined results: null roles and texts are one space; a null conversation id is a conversation of its own; turns are ordered with
nulls first, equal ones by role, then text; repeated rows are duplicates of the first; a conversation all of whose rows have
``copies`` 0, or are deleted, has an empty repair; an empty table gives an empty result; columns other than conv_id, turn, role,
text and copies are not read. A gap count beyond the largest long is given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .shipping import ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and bytes of text of a block.
BLOCK, BLOCK_BYTES = 4_096, 1 << 20
#: Bytes of text of a partition of sorted rows.
PART_BYTES = 64 << 20
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = frozenset(("su", "ua", "au"))
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_INF = 1 << 60
#: What is put in after the last row, by state.
_TAIL = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_END = [INSERT * len(_TAIL[s]) for s in range(4)]
#: Kinds of rows: 0 must go; then initial (s, u, a, other) and truncated or not.
KINDS = 9

Step = tuple[list[list[int]], list[list[int]]]


def _ways(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> the least (cost, edits) that take up one row, insertions before it included."""
    initial, cut = divmod(kind - 1, 2)
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        at = start
        for n in range(3):
            options = [(at, DELETE, "D")]
            if kind:
                extra = TRUNCATED * cut
                options.append((_NEXT[at], REROLE + extra, "R"))
                if initial == 0 and at == EMPTY:
                    options.append((SYSTEM, KEEP + extra, "K"))
                if initial == 1 and _NEXT[at] == USER or initial == 2 and _NEXT[at] == ASSISTANT:
                    options.append((_NEXT[at], KEEP + extra, "K"))
            for to, cost, edit in options:
                way = (INSERT * n + cost, "I" * n + edit)
                out[start, to] = min(out.get((start, to), (_INF, "")), way)
            at = _NEXT[at]
    return out


_WAYS = [_ways(kind) for kind in range(KINDS)]
_SPELT = sorted({edits for ways in _WAYS for _, edits in ways.values()})


def _step(ways: dict[tuple[int, int], tuple[int, str]]) -> Step:
    cost, order = ([[x] * 4 for _ in range(4)] for x in (_INF, 0))
    for (a, b), (c, edits) in ways.items():
        cost[a][b], order[a][b] = c, _SPELT.index(edits)
    return cost, order


ROW_STEPS: list[Step] = [_step(ways) for ways in _WAYS]


def _forward(steps: list[Step], lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Costs from ``start`` to every state after steps lo..hi - 1, and the ranks of their edits in ASCII order."""
    cost, rank = [_INF] * 4, [0] * 4
    cost[start] = 0
    for k in range(lo, hi):
        by, order = steps[k]
        found = []
        for t in range(4):
            best = (_INF, 0, 0)
            for s in range(4):
                if cost[s] < _INF and by[s][t] < _INF:
                    best = min(best, (cost[s] + by[s][t], rank[s], order[s][t]))
            found.append(best)
        places = sorted({x[1:] for x in found if x[0] < _INF})
        cost, rank = [x[0] for x in found], [places.index(x[1:]) if x[0] < _INF else 0 for x in found]
    return cost, rank


def _backward(steps: list[Step], lo: int, hi: int, end: list[int]) -> list[int]:
    """Costs from every state before step lo to the end, which adds ``end`` by state."""
    cost = end
    for k in range(hi - 1, lo - 1, -1):
        by = steps[k][0]
        cost = [min(min(by[s][t] + cost[t] for t in range(4)), _INF) for s in range(4)]
    return cost


def crossings(steps: list[Step], start: int, end: list[int]) -> list[int]:
    """The states after every step on the cheapest way, of equally cheap ones that with the first edits."""
    out = [start] * len(steps)
    open_ = [(0, len(steps), start, end)]
    while open_:
        lo, hi, a, goal = open_.pop()
        if hi <= lo:
            continue
        mid = (lo + hi) // 2 if hi - lo > 1 else hi
        ahead, rank = _forward(steps, lo, mid, a)
        back = _backward(steps, mid, hi, goal)
        s = min(range(4), key=lambda x: (ahead[x] + back[x], rank[x]))
        out[mid - 1] = s
        if hi - lo > 1:
            open_ += [(lo, mid, a, [0 if x == s else _INF for x in range(4)]), (mid, hi, s, goal)]
    return out


def _solve(kinds: bytes, start: int, last: int) -> tuple[int, str]:
    end = _END if last < 0 else [0 if x == last else _INF for x in range(4)]
    states = crossings([ROW_STEPS[k] for k in kinds], start, end)
    cost, edits, at = 0, [], start
    for k, s in zip(kinds, states, strict=True):
        c, e = _WAYS[k][at, s]
        cost, at = cost + c, s
        edits.append(e)
    if last < 0:
        cost += _END[at]
        edits.append(_TAIL[at])
    return cost, "".join(edits)


_solve_short = lru_cache(65_536)(_solve)


def solved(kinds: bytes, start: int = EMPTY, last: int = -1) -> tuple[int, str]:
    """Cost and edits of rows of these kinds, from a state to a state, or to a legal end (-1)."""
    return (_solve_short if len(kinds) <= 24 else _solve)(kinds, start, last)


def summed(kinds: bytes) -> Step:
    """A block as one step: costs and ranks of the ways from every state to every state."""
    rows = [ROW_STEPS[k] for k in kinds]
    ways = [_forward(rows, 0, len(rows), s) for s in range(4)]
    return [w[0] for w in ways], [w[1] for w in ways]


def rebuilt(edits: str, start: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) of the turns that ``edits`` leave of the rows that may stay, in order.

    ``roles`` and ``texts`` hold None at rows that must go."""
    out, at, row = [], start, 0
    for e in edits:
        if e == "D":
            row += 1
            continue
        if e == "K":
            role = roles[row]
            at = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            at = _NEXT[at]
            role = _ROLE[at]
        if e == "I":
            out.append((role, ""))
        else:
            out.append((role, texts[row]))
            row += 1
    return out


def _known(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, kind (of the first copy), blank, every distinct row once.

    Equal rows are counted before anything is ordered, and whether role and text came earlier is told by an aggregate
    of the first turns, not by a window over a conversation."""
    copies = F.coalesce(F.col("copies").cast("long"), F.lit(0)) if "copies" in rows.columns else F.lit(1).cast("long")
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _known("role").alias("role"), _known("text").alias("text"), copies.alias("copies"))
    # A row without copies only tells that there is such a conversation.
    there = F.col("copies") > 0
    known = known.withColumns({c: F.when(there, F.col(c)) for c in ("turn", "role", "text")})
    once = stored(known.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    h1, h2 = F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "text", "role")
    again = (
        once.where(there).groupBy(F.col("conv_id").alias("c"), h1.alias("k1"), h2.alias("k2"))
        .agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    both = once.withColumns({"h1": h1, "h2": h2}).join(stored(again, "recurring-turns"), same, "left")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank = bare == ""
    repeated = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "sua"]), F.substring("role", 1, 1)), F.lit(0))
    kind = F.when(blank | repeated, 0).otherwise(F.pmod(initial + 3, F.lit(4)) * 2 + cut.cast("int") + 1).cast("int")
    return both.select(
        "conv_id", "turn", "role", "text", "copies", kind.alias("kind"), F.coalesce(blank, F.lit(False)).alias("blank"), F.substring("text", 1, 64).alias("head"),
    )


_BLOCKS = (
    "conv_id long, part int, seq long, open boolean, n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "least long, most long, turns long, kinds binary, roles array<string>, texts array<string>, cost array<long>, rank array<int>"
)
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_()), *[(c, pa.int64()) for c in ("n_rows", "blank", "duplicate", "truncated", "illegal")],
    ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("least", "most", "turns")], ("kinds", pa.binary()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32())),
])


class _Block:
    """Rows of one conversation, in order, with what is counted over them."""

    def __init__(self, conv_id):
        self.conv_id, self.kinds, self.roles, self.texts, self.size = conv_id, bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn, role, text, kind, blank) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.blank += blank
        self.duplicate += not kind and not blank
        self.truncated += kind > 0 and (kind - 1) % 2
        self.kinds.append(kind)
        self.roles.append(role if kind else None)
        self.texts.append(text if kind else None)
        self.size += len(text) if kind else 0

    def row(self, part: int, seq: int, open_: bool) -> dict:
        kinds = bytes(self.kinds)
        cost, rank = summed(kinds) if open_ else (None, None)
        return {
            "conv_id": self.conv_id, "part": part, "seq": seq, "open": open_, "n_rows": len(kinds), "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "first": self.first, "last": self.last, "least": self.least, "most": self.most,
            "turns": self.turns, "kinds": kinds, "roles": self.roles, "texts": self.texts,
            "cost": cost and sum(cost, []), "rank": rank and sum(rank, []),
        }


def _cut(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks. A conversation that begins and ends within the partition and fits one block is closed; the first and
    the last one of a partition may go on in others."""
    part, seq, runs = TaskContext.get().partitionId(), 0, 0
    held: _Block | None = None
    several = False
    out, size = [], 0

    def told(open_: bool) -> None:
        nonlocal seq, size
        out.append(held.row(part, seq, open_))
        seq, size = seq + 1, size + held.size + 256

    for batch in batches:
        for r in batch.to_pylist():
            if held is None or held.conv_id != r["conv_id"]:
                if held is not None:
                    told(several or runs == 1)
                held, several, runs = _Block(r["conv_id"]), False, runs + 1
            for n in range(r["copies"]):
                if len(held.kinds) >= block or held.size >= BLOCK_BYTES:
                    told(True)
                    held, several = _Block(r["conv_id"]), True
                held.add(r["turn"], r["role"], r["text"], 0 if n else r["kind"], r["blank"])
            if size >= 8 * BLOCK_BYTES or len(out) >= 4_096:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                out, size = [], 0
    if held is not None:
        told(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def _cross(blocks: pd.DataFrame) -> pd.DataFrame:
    """part, seq, start, goal of the blocks of one conversation, from one short row each."""
    blocks = blocks.sort_values(["part", "seq"])
    steps = [tuple([[int(x) for x in v[4 * s : 4 * s + 4]] for s in range(4)] for v in (c, r)) for c, r in zip(blocks["cost"], blocks["rank"], strict=True)]
    ends = crossings(steps, EMPTY, _END)
    return pd.DataFrame({"part": blocks["part"], "seq": blocks["seq"], "start": [EMPTY, *ends[:-1]], "goal": [*ends[:-1], -1]})


_REPAIRED = "conv_id long, part int, seq long, n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        cost, audit, turns = [], [], []
        for r in batch.select(["kinds", "roles", "texts", "start", "goal"]).to_pylist():
            c, edits = solved(r["kinds"], r["start"], r["goal"])
            cost.append(c)
            audit.append(edits)
            turns.append([{"role": a, "text": b} for a, b in rebuilt(edits, r["start"], r["roles"], r["texts"])])
        names = ["conv_id", "part", "seq", "n_rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(turns, kind)], names=[*names, "cost", "audit", "repaired"],
        )


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of a conversation, in the order of part and seq: faults counted in it, cost, audit (initials of Delete, Insert,
    Keep, Rerole) and the repaired turns. Ordinary conversations are one block.

    ``rows``: conv_id, turn, role, text and, if there, copies (a row with 0 copies only tells that there is such a conversation)."""
    ship(rows.sparkSession)
    turns = stored(marked(rows), "marked-turns")
    n_bytes = turns.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // PART_BYTES))
    # Equal rows are one row here and texts are compared by their heads, so bounds are short and a long conversation is cut.
    order = ["conv_id", "turn", "role", "head"]
    dealt = turns.repartitionByRange(parts, *order).sortWithinPartitions("conv_id", "turn", "role", "text")
    blocks = stored(dealt.select("conv_id", "turn", "role", "text", "copies", "kind", "blank").mapInArrow(lambda b: _cut(b, block), _BLOCKS), "conversation-blocks")
    ends = blocks.where("open").select("conv_id", "part", "seq", "cost", "rank").groupBy("conv_id").applyInPandas(_cross, "part int, seq long, start int, goal int")
    closed = blocks.where("NOT open").select("*", F.lit(EMPTY).alias("start"), F.lit(-1).alias("goal"))
    opened = blocks.where("open").join(stored(ends, "crossings"), ["part", "seq"]).select(*closed.columns)
    return closed.unionByName(opened).drop("open", "cost", "rank").mapInArrow(_rebuild, _REPAIRED)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that stand together by conversation, in order, to one row per conversation."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    now: dict | None = None

    def closed() -> dict:
        span = now["most"] - now["least"] + 1 - now["turns"] if now["least"] is not None else 0
        return {"conv_id": now["conv_id"], "gaps": min(span, 2**63 - 1), **{c: now[c] for c in counts}, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    out.append(closed())
                now = {"conv_id": r["conv_id"], **dict.fromkeys(counts, 0), "turns": 0, "least": None, "most": None, "last": None, "audit": [], "hash": hashlib.sha256(), "any": False}
            if now["last"] is not None and r["first"] is not None and now["last"] + r["first"] not in LEGAL:
                now["illegal"] += 1
            now["last"] = now["last"] if r["last"] is None else r["last"]
            if r["least"] is not None:
                now["turns"] += r["turns"] - (r["least"] == now["most"])
                now["least"], now["most"] = r["least"] if now["least"] is None else now["least"], r["most"]
            for c in counts:
                now[c] += r[c]
            now["audit"].append(r["audit"])
            for t in r["repaired"]:
                now["hash"].update((("\n" if now["any"] else "") + t["role"] + ":" + t["text"]).encode())
                now["any"] = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def digests(blocks: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of :func:`repaired` blocks.

    Conversations of one block are read where they stand; blocks of the others come together, one after the other."""
    ship(blocks.sparkSession)
    blocks = stored(blocks, "repaired-blocks")
    several = stored(blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c")), "cut-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    whole = blocks.join(several, same, "left_anti").mapInArrow(_digest, _DIGEST)
    parts = blocks.join(several, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_digest, _DIGEST)
    return whole.unionByName(parts)
