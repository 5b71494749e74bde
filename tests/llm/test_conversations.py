import hashlib
import heapq
import random
import re
import zlib

import pytest
from linkloom.llm import conversations as op
from oracle import duck, rows
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(turns, faults):
    """Best-first search over edit strings, with no states merged."""
    heap, name = [(0, "", 0, "", ())], {"u": "user", "a": "assistant"}
    while True:
        cost, audit, i, seen, out = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", seen):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        ways = [(cost + 3, "I", i, x, (f"{name[x]}:",)) for x in "ua"]
        if i < len(turns):
            role, text = turns[i]
            ways.append((cost + 4, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                ways.append((cost + late, "K", i + 1, role[:1] or "?", (f"{role}:{text}",)))
                ways += [(cost + late + 3, "R", i + 1, x, (f"{name[x]}:{text}",)) for x in "ua"]
        for c, e, j, x, lines in ways:
            if re.fullmatch("s?(ua)*u?", seen + x):
                heapq.heappush(heap, (c, audit + e, j, seen + x, out + lines))


def slow(table):
    """The contract by loops: table of (conv_id, turn, role, text, copies)."""
    out = []
    for conv in {x[0] for x in table}:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in table for _ in range(n) if c == conv), key=lambda y: (y[0], y[1], y[2].encode(), y[3].encode()))
        faults, seen = [], set()
        for _, _, r, x in mine:
            bare = x.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((r, x))
        turns = [t for known, t, _, _ in mine if known]
        starts = [r[:1] for _, _, r, _ in mine]
        cost, audit, sha = cheapest([y[2:] for y in mine], faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha))
    return sorted(out, key=repr)


def run(spark, table, size=op.CHUNK, parts=2):
    df = spark.createDataFrame(table, SCHEMA + ", n int").repartition(parts)
    for name in ("sig", "chunk", "sign", "initial", "blank", "raw", "costs", "edits", "lo", "hi", "first", "__low"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    got = op.repair(df.withColumnRenamed("n", "times"), F.col("times"), size)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(x) for x in got.collect()), key=repr)


@pytest.mark.parametrize("seed,size", [(0, 256), (1, 1), (2, 2), (3, 3)])
def test_brute_force(spark, seed, size):
    r = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "agent", "tool", "", "User", None]
    texts = ["Yes.", "No!", "no end", "Why? \n", "", " \t", None, "é", "a. ", "Yes.", "x" * 50]
    table = []
    for c in range(60):
        base = [("user", "assistant")[i % 2] for i in range(6)] if c % 2 else None
        table += [(None if c == 7 else c, r.choice([i, i, i, r.randint(0, 4), None]), base[i] if base and r.random() < 0.7 else r.choice(roles), r.choice(texts), r.choice([1, 1, 1, 1, 0, 2])) for i in range(r.randint(1, 4))]
    assert run(spark, table, size) == slow(table)


def test_trie_walks_each_prefix_once():
    r = random.Random(4)
    signatures = sorted({"".join(r.choice("suaxSUAXD") for _ in range(r.randint(0, 7))) for _ in range(300)})
    trie = op.Trie()
    for s in signatures:
        layer = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
        for sign in s:
            layer = [op.stepped(x, sign) for x in layer]
        assert trie.walk(s) == layer
    assert trie.made == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


def test_shared_prefixes_meet_whatever_the_partitions(spark):
    signatures = spark.createDataFrame([(s,) for s in ["ua", "ua", "uau", "", "suaD", "suaX"]], "sig string")
    got = {x.sig: (x.costs, x.edits) for x in op.answers(signatures).collect()}
    assert set(got) == {"", "ua", "uau", "suaD", "suaX"}
    assert got["ua"][0][3] == 0 and got["ua"][1][3] == "KK" and got["uau"][1][0] == "DDD"


def test_cheap_ends(spark):
    """Ties go to the edits that sort first; insertions may stand anywhere."""
    one = [(1, 0, "assistant", "Hello.", 1)]
    assert run(spark, one) == slow(one)
    assert run(spark, one)[0][6:8] == (3, "IK")
    two = [(1, 0, "user", "A.", 1), (1, 1, "user", "B.", 1)]
    assert run(spark, two)[0][6:8] == slow(two)[0][6:8] == (3, "KR")


def test_long_conversation_and_hot_copies(spark):
    """Chunks of one conversation, over partitions, give what one chunk gives."""
    long = [(1, i, ("user", "assistant", "tool")[i % 3], f"Say {i % 700}." if i % 5 else "cut", 1) for i in range(2000)]
    hot = [(2, 3, "user", "Same.", 20_000), (2, 4, "assistant", "Fine.", 1), (3, None, "user", " ", 5000), (4, 0, "user", "w" * 1_000_000 + ".", 1)]
    got = run(spark, long + hot, 64, 4)
    assert got == run(spark, long + hot, 500, 1)
    by = {x[0]: x for x in got}
    assert by[2][3] == 19_999 and by[2][6] == 4 * 19_999 and by[2][7] == "K" + "D" * 19_999 + "K"
    assert by[3][2:8] == (5000, 0, 0, 4999, 20_000, "D" * 5000)
    assert by[4][6:8] == (3, "KI")


def test_no_rows(spark):
    assert run(spark, [(5, 1, "user", "x", 0), (5, None, None, None, 0)]) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert run(spark, []) == []


def test_damage(spark):
    table = [(c, t, "assistant", "A. b! c? d") for c in (1, 2, None) for t in [*range(40), None]]
    out, n = op.damaged(spark.createDataFrame(table, SCHEMA))
    got = {(x.conv_id, x.turn): (x.role, x.text, x.k) for x in out.withColumn("k", n).collect()}
    for c, t, role, text in table:
        roll = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = ("user" if roll == 4 else role, "" if roll == 1 else "A b c d" if roll == 2 else text, {0: 0, 3: 2}.get(roll, 1))
        assert got[c, t] == want


def test_sql(spark, sf):
    assert rows(op.op13_repair_conversations(spark, sf).toPandas()) == rows(duck(sf, op.OP13_SQL))


def test_sql_on_nulls(spark):
    """The SQL and the operator on rows with nulls, ties and strange roles."""
    import duckdb
    import pandas as pd

    r = random.Random(8)
    table = [(r.choice([1, 2, 3, 4, None]), r.choice([0, 1, 2, 3, None]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "cut", "", None, "No? "])) for _ in range(60)]
    con = duckdb.connect()
    frame = pd.DataFrame(table, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    assert rows(op.repair(*op.damaged(spark.createDataFrame(table, SCHEMA))).toPandas()) == rows(con.execute(op.OP13_SQL).fetch_df())
