import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.llm import oracle, queries, repair
from pyspark.sql import functions as F
from tools.check_queries import canonical

ROWS = "conv_id long, turn long, role string, text string"
_AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, edits, turns) of (role, text, gone, cut) rows: every state after every row with its edits in full."""
    found = {"": (0, "", ())}

    def put(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def filled(table):
        out = dict(table)
        for _ in range(3):
            for state, (c, e, t) in list(out.items()):
                role = {"u": "user", "a": "assistant"}[_AFTER[state]]
                put(out, _AFTER[state], (c + 3, e + "I", (*t, (role, ""))))
        return out

    for role, text, gone, cut in rows:
        new = {}
        for state, (c, e, t) in filled(found).items():
            put(new, state, (c + 4, e + "D", t))
            if not gone:
                nxt = _AFTER[state]
                put(new, nxt, (c + 3 + 3 * cut, e + "R", (*t, ({"u": "user", "a": "assistant"}[nxt], text))))
                if role[:1] == nxt or role[:1] == "s" and not state:
                    put(new, role[:1], (c + 3 * cut, e + "K", (*t, (role, text))))
        found = new
    return min(filled(found)[s] for s in ("", "a") if s in filled(found))


def brute(rows, copies=lambda r: 1):
    """The result row of every conversation of (conv, turn, role, text) rows."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]] += [(r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ")] * copies(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, told, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            told.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, edits, turns = cheapest(told)
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(f"{a}:{b}" for a, b in turns)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(blocks):
    return {r.conv_id: tuple(r)[1:] for r in repair.digests(blocks).collect()}


def test_sql_on_all_conversations(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    df = queries.op12_conversation_repair(spark, sf)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(df.columns, con.execute(oracle.OP12).fetchall())


def test_query_against_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    spoilt, copies = [], {}
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        r = (conv, turn, "user" if fate == 4 else role, text)
        spoilt.append(r)
        copies[r] = {0: 0, 3: 2}.get(fate, 1)
    assert {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, sf).collect()} == brute(spoilt, copies.get)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.booleans(), st.booleans()), max_size=9))
@settings(max_examples=400, deadline=None)
def test_edits_are_the_cheapest_and_first(rows):
    told = [(role, f"t{i}", gone, cut and not gone) for i, (role, gone, cut) in enumerate(rows)]
    kinds = bytes(0 if gone else "sua".find(role[:1] or "?") % 4 * 2 + cut + 1 for role, _, gone, cut in told)
    cost, edits = repair._solve(kinds, repair.EMPTY, -1)
    turns = repair.rebuilt(edits, repair.EMPTY, [None if g else r for r, _, g, _ in told], [None if g else t for _, t, g, _ in told])
    assert (cost, edits, tuple(turns)) == cheapest(told)


@given(st.lists(st.integers(0, 8), min_size=2, max_size=24), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_blocks_give_what_the_whole_gives(kinds, size):
    """Sums of blocks, crossed at their edges, and blocks solved by themselves make the same edits."""
    pieces = [bytes(kinds[i : i + size]) for i in range(0, len(kinds), size)]
    ends = repair.crossings([repair.summed(p) for p in pieces], repair.EMPTY, repair._END)
    found = [repair._solve(p, a, b) for p, a, b in zip(pieces, [repair.EMPTY, *ends[:-1]], [*ends[:-1], -1], strict=True)]
    assert (sum(c for c, _ in found), "".join(e for _, e in found)) == repair._solve(bytes(kinds), repair.EMPTY, -1)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "user", "Hi."), (2, None, "user", None), (2, None, None, "x"),
        (3, None, "system", "S."), (3, 2, "user", "u"), (3, 2, "assistant", "a!"), (3, 2, "assistant", "b! \n"), (None, 4, "user", "q?"), (None, 3, "assistant", "r."),
        (4, 0, "", "no role."), (4, 1, "unknown", "kept as user."), (5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b."), (6, 0, "user", " "),
    ]
    want = brute(rows)
    want[5] = (2**63 - 1, *want[5][1:])  # beyond the largest long
    frame = spark.createDataFrame(rows, ROWS).withColumns({"audit": F.lit("x"), "kind": F.lit(1), "h1": F.lit(2), "c": F.lit(3)})
    assert got(repair.repaired(frame)) == want
    assert got(repair.repaired(spark.createDataFrame([], ROWS))) == {}
    none = spark.createDataFrame([(7, 0, "user", "gone.", 0)], ROWS + ", copies long")
    assert got(repair.repaired(none)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("block", [3, 64])
def test_a_long_conversation_is_cut(spark, block):
    """Half of all rows in one conversation, over several partitions and many blocks."""
    roles = ("user", "assistant", "system", "user", "user", "tool")
    rows = [(9, i // 2, roles[i * 7 % 11 % 6], f"text {i % 90}" + ".?x"[i % 3]) for i in range(400)]
    rows += [(i // 4, i % 4, roles[i % 2], f"turn {i}.") for i in range(40, 440)]
    blocks = repair.repaired(spark.createDataFrame(rows, ROWS), block)
    assert got(blocks) == brute(rows)
    long = blocks.where("conv_id = 9").collect()
    assert len(long) >= 400 // block and len({b.part for b in long}) > 1 and max(b.n_rows for b in long) <= block
