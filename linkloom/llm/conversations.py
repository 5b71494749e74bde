"""Operator 13: cheapest repairs of conversation structure by a DP over a trie.

A conversation's rows become a signature, one sign for each row: its role's
initial, in upper case if the text is truncated, or D if the row must go. The
distinct signatures are sorted and walked as a prefix trie; a node's DP layer is
computed once for all signatures below it, and a signature's answer is the layer
at its end. A layer holds, for each pair of states before and after, the least
cost and the edits, so that long conversations are cut into chunks whose answers
are put together. The repaired text is hashed as it streams by, once for each
state that may turn out best.

States: 0 nothing written, 1 a system turn, 2 a user turn, 3 an assistant turn.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, read

#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Signs in a chunk of a conversation.
CHUNK = 256

_SPACE = " \t\n\x0b\x0c\r"
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_TURN = {0: 2, 1: 2, 3: 2, 2: 3}  # the state after a user or assistant turn that may come next
_NAME = {2: "user", 3: "assistant"}

#: Least cost and edits so far, by state; None where it can't be reached.
Layer = list[tuple[int, str] | None]


def inserted(layer: Layer) -> Layer:
    """The layer with turns inserted after it, where that is cheapest. Of equal
    costs the edits that sort first stay; none of them starts another, since
    they hold as many edits of rows and so as many insertions."""
    user = min((x for x in (layer[2], *((c + INSERT, a + "I") for c, a in (x for x in (layer[0], layer[1], layer[3]) if x))) if x), default=None)
    reply = min((x for x in (layer[3], user and (user[0] + INSERT, user[1] + "I")) if x), default=None)
    return [layer[0], layer[1], user, reply]


def stepped(layer: Layer, sign: str) -> Layer:
    """The layer after one more row."""
    out: list[list[tuple[int, str]]] = [[], [], [], []]
    late = TRUNCATED if sign.isupper() else 0
    keep = _NEXT.get(sign.lower(), {}) if sign != "D" else {}
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, edits = best
        out[state].append((cost + DELETE, edits + "D"))
        if sign != "D":
            out[_TURN[state]].append((cost + REROLE + late, edits + "R"))
            if state in keep:
                out[keep[state]].append((cost + late, edits + "K"))
    return inserted([min(x, default=None) for x in out])


class Trie:
    """The path of a prefix trie from its root to the signature walked last.
    Signatures come sorted, so that a node is met once and its layer, one for
    each state to start from, is computed once."""

    def __init__(self):
        self.path, self.nodes = "", [[[(0, "") if i == j else None for j in range(4)] for i in range(4)]]
        self.made = 0

    def walk(self, signature: str) -> list[Layer]:
        shared = len(os.path.commonprefix([self.path, signature]))
        del self.nodes[shared + 1 :]
        for sign in signature[shared:]:
            self.nodes.append([stepped(layer, sign) for layer in self.nodes[-1]])
            self.made += 1
        self.path = signature
        return self.nodes[-1]


def answers(signatures: DataFrame) -> DataFrame:
    """sig, costs, edits: the 16 entries of the answer of each distinct signature
    by state before and state after, cost -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            found = [[x or (-1, "") for layer in trie.walk(sig) for x in layer] for sig in batch.column("sig").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array([[c for c, _ in x] for x in found], pa.list_(pa.int64())), pa.array([[a for _, a in x] for x in found], pa.list_(pa.string()))], ["sig", "costs", "edits"])

    spread = signatures.select("sig").distinct().repartitionByRange("sig").sortWithinPartitions("sig")
    return spread.mapInArrow(run, "sig string, costs array<long>, edits array<string>")


def _legal(a: str | None, b: str | None) -> bool:
    return (a or "") + (b or "") in ("su", "ua", "au")


def _fields(kind: str) -> str:
    return f"conv_id {kind}, chunk long, sig string, roles array<string>, texts array<string>, `first` string, `last` string, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long"


def _arrow(rows: list[dict], like: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in like], [n for n, _ in like])


def chunks(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """Runs of up to `size` signs of each conversation, in order: signature,
    roles and texts of the rows that need not go, and counts. turns: conv_id,
    turn, role, text (no nulls in either), n (copies; with 0 of them, a row only
    tells that its conversation is there)."""
    whole = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # Of the rows of one role and text, the one of the smallest turn is no duplicate.
    earliest = whole.where((F.col("n") > 0) & ~blank).groupBy(*[F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "text")]).agg(F.min(F.struct(F.col("turn").isNotNull().alias("x"), "turn")).alias("__low"))
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("role") == F.col("__role")) & (F.col("text") == F.col("__text"))
    marked = whole.join(earliest, same, "left").withColumn("leads", ~blank & (F.col("n") > 0) & F.col("turn").eqNullSafe(F.col("__low.turn")))
    initial = F.substring("role", 1, 1)
    open_end = ~F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1).isin(".", "!", "?")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    signed = marked.select("conv_id", "turn", "role", F.col("text").alias("raw"), "n", initial.alias("initial"), blank.alias("blank"), F.when(F.col("leads"), F.when(open_end, F.upper(known)).otherwise(known)).alias("sign"))
    order = ["conv_id", "turn", "role", "raw"]
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, ready, like = TaskContext.get().partitionId() << 33, None, [], []

        def fresh(conv) -> dict:
            nonlocal number
            number += 1
            return {"conv_id": conv, "chunk": number, "sig": "", "roles": [], "texts": [], "first": None, "last": None, "lo": None, "hi": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

        def add(row: dict, sign: str, copies: int, which: str | None) -> None:
            now["sig"] += sign * copies
            now["illegal"] += copies - 1 + (bool(now["sig"][copies:]) and not _legal(now["last"], row["initial"]))
            now["first"] = row["initial"] if now["first"] is None else now["first"]
            now["last"] = row["initial"]
            if row["turn"] is not None and row["turn"] != now["hi"]:
                now["lo"] = row["turn"] if now["lo"] is None else now["lo"]
                now["hi"], now["turns"] = row["turn"], now["turns"] + 1
            if which:
                now[which] += copies
            if sign != "D":
                now["roles"].append(row["role"])
                now["texts"].append(row["raw"])

        for batch in batches:
            like = like or [("conv_id", batch.schema.field("conv_id").type), ("chunk", pa.int64()), ("sig", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), *[(n, pa.int64()) for n in ("lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal")]]
            for row in (x for i in range(0, batch.num_rows, 64) for x in batch.slice(i, 64).to_pylist()):
                if now is None or now["conv_id"] != row["conv_id"]:
                    ready += [now] if now else []
                    now = fresh(row["conv_id"])
                left = row["n"]
                while left > 0:
                    if len(now["sig"]) >= size:
                        ready.append(now)
                        now = fresh(row["conv_id"])
                    if row["sign"]:
                        add(row, row["sign"], 1, "truncated" if row["sign"].isupper() else None)
                        row["sign"], left = None, left - 1
                    else:
                        some = min(left, size - len(now["sig"]))
                        add(row, "D", some, "blank" if row["blank"] else "duplicate")
                        left -= some
                if sum(len(x["sig"]) + 1 for x in ready) > 8 * size:
                    yield _arrow(ready, like)
                    ready = []
        ready += [now] if now else []
        if ready:
            yield _arrow(ready, like)

    return signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _fields(kind))


class _Best:
    """The cheapest repair so far that ends in one state: cost, edits, the hash
    of its lines."""

    def __init__(self, cost: int = 0, edits: str = "", sha=None, lines: int = 0):
        self.cost, self.edits, self.sha, self.lines = cost, edits, sha or hashlib.sha256(), lines

    def after(self, state: int, cost: int, edits: str, chunk: dict) -> _Best:
        """With the edits of a chunk, which begin in `state`."""
        new = _Best(self.cost + cost, self.edits + edits, self.sha.copy(), self.lines)
        signs, rows = iter(chunk["sig"]), zip(chunk["roles"], chunk["texts"])
        for edit in edits:
            role, text = "", ""
            if edit != "I":
                sign = next(signs)
                if sign != "D":
                    role, text = next(rows)
                if edit == "D":
                    continue
            if edit == "K":
                state = _NEXT[sign.lower()][state]
            else:
                state = _TURN[state]
                role = _NAME[state]
            new.sha.update(f"{chr(10) if new.lines else ''}{role}:{text}".encode())
            new.lines += 1
        return new


_EMPTY = {"sig": "", "roles": [], "texts": []}
_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _report(parts: Iterator[dict]) -> dict:
    """The result row of a conversation from its chunks in order, one at a time."""
    best: list[_Best | None] = [_Best().after(0, x[0], x[1], _EMPTY) if x else None for x in inserted([(0, ""), None, None, None])]
    total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
    lo = hi = last = None
    part = next(parts, None)
    while part is not None:
        following = next(parts, None)
        ways: list[tuple[int, str, int, int] | None] = [None] * 4
        for i, b in enumerate(best):
            for j in range(4) if b else ():
                cost, edits = part["costs"][4 * i + j], part["edits"][4 * i + j]
                if cost >= 0 and (ways[j] is None or (b.cost + cost, b.edits + edits) < (ways[j][0], ways[j][1])):
                    ways[j] = (b.cost + cost, b.edits + edits, i, j)
        if following is None:
            end = min(x for x in (ways[0], ways[3]) if x)
            ways = [end if w == end else None for w in ways]
        best = [w and best[w[2]].after(w[2], part["costs"][4 * w[2] + w[3]], part["edits"][4 * w[2] + w[3]], part) for w in ways]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            total[name] += part[name]
        if part["sig"]:
            total["illegal"] += last is not None and not _legal(last, part["first"])
            last = part["last"]
        if part["hi"] is not None:
            total["turns"] += part["turns"] - (part["lo"] == hi)
            lo, hi = part["lo"] if lo is None else lo, part["hi"]
        part = following
    end = min((x for x in (best[0], best[3]) if x), key=lambda x: (x.cost, x.edits))
    turns = total.pop("turns")
    return {"gaps": hi - lo + 1 - turns if hi is not None else 0, **total, "cost": end.cost, "audit": end.edits, "repaired_sha256": end.sha.hexdigest()}


def _put_together(parts: DataFrame) -> DataFrame:
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like: list = []

        def rows() -> Iterator[dict]:
            for batch in batches:
                like[:] = [("conv_id", batch.schema.field("conv_id").type), *[(n, pa.int64()) for n in _REPORT], ("audit", pa.string()), ("repaired_sha256", pa.string())]
                for i in range(0, batch.num_rows, 64):
                    yield from batch.slice(i, 64).to_pylist()

        stream, ready = rows(), []
        ahead = next(stream, None)

        def of(conv) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead["conv_id"] == conv:
                part, ahead = ahead, next(stream, None)
                yield part

        while ahead is not None:
            conv = ahead["conv_id"]
            ready.append({"conv_id": conv, **_report(of(conv))})
            if len(ready) >= 1000:
                yield _arrow(ready, like)
                ready = []
        if ready:
            yield _arrow(ready, like)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair(turns: DataFrame, copies: Column | None = None, size: int = CHUNK) -> DataFrame:
    """Faults and cheapest repair of every conversation in turns (conv_id, turn,
    role, text). copies: how often a row is there (once); rows of 0 only tell of
    a conversation.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Rows stand in the order of turn (nulls first), then role and
    text. A repair gives roles (system? (user assistant)+)? by their initials.

    Null role or text: one space. Null turn: before all others, no part of the
    gaps. Null conv_id: a conversation of its own. Empty text: blank. Repeated
    rows: duplicates, counted before they are shuffled. Roles other than s…, u…
    and a… must be changed or go. Very long conversations: cut into chunks; only
    their hash, and the streaming of their lines into it, is one task's work.
    Conversations without rows: zeros, empty audit, hash of the empty text. Empty
    table: empty result. Other columns are ignored.
    """
    clean = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.lit(1) if copies is None else copies).cast("long").alias("n"))
    here = F.col("n") > 0  # nothing of the others counts
    clean = clean.select("conv_id", F.when(here, F.col("turn")).alias("turn"), *[F.when(here, F.col(c)).otherwise(" ").alias(c) for c in ("role", "text")], "n")
    parts = materialize(chunks(clean, size), "chunks", "zstd")
    found = materialize(answers(parts), "answers", "zstd")
    return _put_together(parts.join(broadcast_if_small(found, 64 * size), "sig"))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """turns with the faults of the test, and how often each row is there."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    roll = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    text = F.when(roll == 1, F.lit("")).when(roll == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = turns.select("conv_id", "turn", F.when(roll == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(roll == 0, F.lit(0)).when(roll == 3, F.lit(2)).otherwise(F.lit(1)).alias("n"))
    return out, F.col("n")


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(*damaged(read(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), roll AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS x
  FROM (SELECT DISTINCT k FROM src), tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE WHEN x = 1 THEN '' WHEN x = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN x = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM src JOIN roll USING (k) WHERE x <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), faulty AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM ordered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), r AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS p0, {'c': 1000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS p1, {'c': 3::BIGINT, 'a': 'I', 'o': ['user:']} AS p2, {'c': 6::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']} AS p3 FROM ids
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, list_min([n3, {'c': m2.c + 3, 'a': m2.a || 'I', 'o': list_append(m2.o, 'assistant:')}]) AS m3 FROM (
    SELECT conv_id, i, n0, n1, n3, list_min([n2, {'c': n0.c + 3, 'a': n0.a || 'I', 'o': list_append(n0.o, 'user:')}, {'c': n1.c + 3, 'a': n1.a || 'I', 'o': list_append(n1.o, 'user:')}, {'c': n3.c + 3, 'a': n3.a || 'I', 'o': list_append(n3.o, 'user:')}]) AS m2 FROM (
      SELECT conv_id, i, d0 AS n0, CASE WHEN keep AND ini = 's' THEN list_min([d1, {'c': p0.c + late, 'a': p0.a || 'K', 'o': list_append(p0.o, line)}]) ELSE d1 END AS n1,
        CASE WHEN NOT keep THEN d2 ELSE list_min([d2, {'c': p0.c + toser, 'a': p0.a || useed, 'o': list_append(p0.o, uline)}, {'c': p1.c + toser, 'a': p1.a || useed, 'o': list_append(p1.o, uline)}, {'c': p3.c + toser, 'a': p3.a || useed, 'o': list_append(p3.o, uline)}]) END AS n2,
        CASE WHEN NOT keep THEN d3 ELSE list_min([d3, {'c': p2.c + toass, 'a': p2.a || asssd, 'o': list_append(p2.o, aline)}]) END AS n3
      FROM (
        SELECT f.conv_id, f.i, p0, p1, p2, p3, ini, fault NOT IN ('b', 'd') AS keep, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS late, role || ':' || text AS line,
          CASE WHEN ini = 'u' THEN 0 ELSE 3 END + CASE WHEN fault = 't' THEN 3 ELSE 0 END AS toser, CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END AS useed, CASE WHEN ini = 'u' THEN role ELSE 'user' END || ':' || text AS uline,
          CASE WHEN ini = 'a' THEN 0 ELSE 3 END + CASE WHEN fault = 't' THEN 3 ELSE 0 END AS toass, CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END AS asssd, CASE WHEN ini = 'a' THEN role ELSE 'assistant' END || ':' || text AS aline,
          {'c': p0.c + 4, 'a': p0.a || 'D', 'o': p0.o} AS d0, {'c': p1.c + 4, 'a': p1.a || 'D', 'o': p1.o} AS d1, {'c': p2.c + 4, 'a': p2.a || 'D', 'o': p2.o} AS d2, {'c': p3.c + 4, 'a': p3.a || 'D', 'o': p3.o} AS d3
        FROM r JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)))
), final AS (
  SELECT conv_id, list_min([p0, p3]) AS best FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
)
SELECT final.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CASE WHEN counts.blank IS NULL THEN 0 ELSE best.c END AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM final LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM final.conv_id
"""
