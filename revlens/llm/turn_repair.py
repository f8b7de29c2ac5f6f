"""Conversation structure repair with Four-Russians block tables.

`damaged` breaks rows by a checksum of their key; `repair` finds, for each
conversation, the cheapest edits after which its role initials match
`(s?(ua)+)?`, the ASCII-least audit among ties, and the faults it had.

Rows become symbols: must be deleted (blank, duplicate), or the role's initial
(u, a, s, other) with or without a cut-off ending. The automaton has four states
(start, after s, after u, after a). The costs to go from the four states, less
their least, form a vector; only a few vectors exist, all within reach of the
end vector. `Tables` holds, for every vector and every block of `BLOCK` symbols,
the vector before the block and the cost it adds. A conversation is run through
backward, a block at a lookup. The trace then goes forward: each block is
expanded from its right-hand vector, and at every step the least letter that
lies on a cheapest way is taken. Next states follow from the letters alone, so
this is the ASCII-least audit.

Rows are range-sorted by (conv_id, turn, role, text), so a conversation of any
size spreads over many tasks. A conversation that lies inside one task and has at
most `SEGMENT` rows is finished there. Others are cut into segments; each
segment's transition for every possible vector is worked out where it is read,
and two streams over the segments join them: backward for the vectors (a lookup
a segment), forward for the trace and the hash, with one segment in memory at a
time. SHA-256 is sequential by nature, so one task has to read the texts of a
split conversation one after another.

Defined results: a null role or text counts as one space, also a null conv_id
or turn in the checksum's key; a null conv_id is a conversation of its own;
rows of equal turn are taken by role and text (bytes), so equal rows are
adjacent and interchangeable; every repeated row is damaged alike; an initial
other than u, a, s fits nowhere and is deleted or reroled; very long texts are
hashed as they are; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import materialize

# --- fixed values: costs and the automaton ----------------------------------------
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
INITIALS = "uas"  # other initials are the class after these
KEEPS = {(START, 2): AFTER_S, (START, 0): AFTER_U, (AFTER_S, 0): AFTER_U, (AFTER_U, 1): AFTER_A, (AFTER_A, 0): AFTER_U}
INSERTS = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after a user or assistant turn of our own
LEGAL = {(2, 0), (0, 1), (1, 0)}
# ----------------------------------------------------------------------------------

MUST_DELETE, SYMBOLS = 0, 9  # the others are 1 + 2 * initial class + truncated
BLOCK = 4
SEGMENT = 4096  # rows of a segment, and of a conversation finished at once
SEGMENT_BYTES = 1 << 20
ROLE = {AFTER_U: b"user", AFTER_A: b"assistant"}


def kept(symbol: int, state: int) -> int | None:
    """The state after keeping the row, or None."""
    return KEEPS.get((state, (symbol - 1) // 2)) if symbol else None


def extra(symbol: int) -> int:
    return TRUNCATED if symbol and (symbol - 1) % 2 else 0


def before(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go in front of a row, from those behind it."""
    out = []
    for q in range(4):
        c = DELETE + costs[q]
        if symbol:
            c = min(c, REROLE + extra(symbol) + costs[INSERTS[q]])
            k = kept(symbol, q)
            c = c if k is None else min(c, extra(symbol) + costs[k])
        out.append(c)
    return tuple(min(out[q], INSERT + out[INSERTS[q]], 2 * INSERT + out[INSERTS[INSERTS[q]]]) for q in range(4))


class Tables:
    """Vectors in reach, their transitions by one symbol and by a block."""

    END = (0, 2 * INSERT, INSERT, 0)

    def __init__(self) -> None:
        self.vectors, number = [self.END], {self.END: 0}
        step, cost = [], []
        for v in self.vectors:  # grows while it is read
            raws = [before(s, v) for s in range(SYMBOLS)]
            cost.append([min(r) for r in raws])
            for r in raws:
                n = tuple(c - min(r) for c in r)
                if n not in number:
                    number[n] = len(self.vectors)
                    self.vectors.append(n)
            step.append([number[tuple(c - min(r) for c in r)] for r in raws])
        self.step, self.cost = np.array(step, np.int32), np.array(cost, np.int32)
        # a block's code has its first symbol in front; the last one is applied first
        nxt, add = self.step, self.cost
        for _ in range(BLOCK - 1):
            add = np.concatenate([self.cost[nxt[:, None, :], s] + add[:, None, :] for s in range(SYMBOLS)], 1).reshape(len(self.vectors), -1)
            nxt = np.concatenate([self.step[nxt[:, None, :], s] for s in range(SYMBOLS)], 1).reshape(len(self.vectors), -1)
        self.block_step, self.block_cost = nxt, add
        self.one_step, self.one_cost = self.step.tolist(), self.cost.tolist()
        self.expanded: dict[tuple, tuple] = {}

    def codes(self, symbols: np.ndarray) -> list[int]:
        """Codes of the whole blocks, from the front."""
        whole = symbols[: len(symbols) // BLOCK * BLOCK].reshape(-1, BLOCK).astype(np.int64)
        return (whole @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()

    def backward(self, symbols: np.ndarray, vector: int) -> tuple[list[int], int, int]:
        """From the vector behind the symbols: the vectors behind each whole
        block, the vector in front of all and the cost added."""
        total = 0
        for s in symbols[len(symbols) // BLOCK * BLOCK :][::-1].tolist():
            total += self.one_cost[vector][s]
            vector = self.one_step[vector][s]
        behind = []
        for code in reversed(self.codes(symbols)):
            behind.append(vector)
            total += int(self.block_cost[vector, code])
            vector = int(self.block_step[vector, code])
        return behind[::-1], vector, total

    def transition(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols: the vector in front, the cost."""
        v, total = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for s in symbols[len(symbols) // BLOCK * BLOCK :][::-1].tolist():
            total, v = total + self.cost[v, s], self.step[v, s]
        for code in reversed(self.codes(symbols)):
            total, v = total + self.block_cost[v, code], self.block_step[v, code]
        return v, total

    def trace(self, symbols: tuple[int, ...], vector: int, state: int) -> tuple[str, tuple, int]:
        """Expands up to a block backward from the vector behind it, then takes
        the least letters from `state`: letters, what to write for each of them
        (row and state, row None for an insertion), and the state behind."""
        key = (symbols, vector, state)
        if key in self.expanded:
            return self.expanded[key]
        behind = [vector]
        for s in reversed(symbols):
            behind.append(self.one_step[behind[-1]][s])
        behind.reverse()  # behind[i + 1] is the vector behind row i
        letters, written = "", []
        for i, s in enumerate(symbols):
            after, base = self.vectors[behind[i + 1]], self.one_cost[behind[i + 1]][s]
            here = [c + base for c in self.vectors[behind[i]]]
            while True:
                k = kept(s, state)
                if here[state] == DELETE + after[state]:
                    letters += "D"
                    break
                if here[state] == INSERT + here[INSERTS[state]]:
                    state = INSERTS[state]
                    letters += "I"
                    written.append((None, state))
                    continue
                if k is not None and here[state] == extra(s) + after[k]:
                    letters, state = letters + "K", k
                    written.append((i, None))
                else:
                    letters, state = letters + "R", INSERTS[state]
                    written.append((i, state))
                break
        self.expanded[key] = letters, tuple(written), state
        return self.expanded[key]


@cache
def tables() -> Tables:
    return Tables()


# --- damage and faults: DataFrame functions ------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `copies`: how often the row stands there
    after the damage. A dropped row leaves copies = 0 without turn, role and
    text, so that its conversation stays known."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    there = kind != 0
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(there, F.col("turn").cast("long")).alias("turn"),
        F.when(there, F.when(kind == 4, F.lit("user")).otherwise(role)).alias("role"),
        F.when(there, F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)).alias("text"),
        F.when(~there, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def symbols(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, each with its symbol (of the first
    copy) and fault: 0 none, 1 blank, 2 duplicate, 3 truncated. A role and text
    that also stand at an earlier turn are found by an aggregate on their hash;
    only those at several turns are joined back."""
    row = ["conv_id", "turn", "role", "text"]
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    same = rows.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.md5(F.col("text").cast("binary")).alias("h"))
    first = same.agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").drop("last")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.md5(F.col("text").cast("binary")) == F.col("h"))
    rows = rows.groupBy(*row).agg(F.sum("copies").alias("copies")).join(first, on, "left")
    ending = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    place = F.coalesce(*[F.when(initial == c, i) for i, c in enumerate(INITIALS)], F.lit(len(INITIALS)))
    fault = F.when(ending == "", 1).when(F.col("first").isNotNull() & (F.col("first") != at), 2).when(~F.substring(ending, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    rows = rows.select(*row, "copies", place.cast("int").alias("initial"), F.coalesce(fault, F.lit(0)).cast("int").alias("fault"))
    symbol = F.when(F.col("fault").isin(1, 2), MUST_DELETE).otherwise(1 + 2 * F.col("initial") + F.when(F.col("fault") == 3, 1).otherwise(0))
    return rows.withColumn("symbol", symbol.cast("int"))


# --- one conversation or a part of it ------------------------------------------------
class Part:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.symbols, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.faults = [0, 0, 0, 0]
        self.illegal, self.head, self.tail = 0, None, None  # initials of the first and last row
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: bytes, text: bytes, initial: int, fault: int, symbol: int) -> None:
        self.symbols.append(symbol)
        text = b"" if symbol == MUST_DELETE else text  # never written
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        self.faults[fault] += 1
        if self.head is None:
            self.head = initial
        elif (self.tail, initial) not in LEGAL:
            self.illegal += 1
        self.tail = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def counts(self) -> dict:
        return {
            "blank": self.faults[1], "duplicate": self.faults[2], "truncated": self.faults[3], "illegal": self.illegal,
            "head": self.head, "tail": self.tail, "low": self.low, "high": self.high, "turns": self.turns,
        }


class Whole:
    """Running result of a conversation whose parts come in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.state, self.audit, self.hash, self.any = conv_id, START, [], hashlib.sha256(), False
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.tail = self.low = self.high = None

    def write(self, role: bytes, text: bytes) -> None:
        self.hash.update(b"\n" + role + b":" if self.any else role + b":")
        self.hash.update(text)
        self.any = True

    def add(self, c: dict, symbols: np.ndarray, roles: list, texts: list, behind: list[int], last: int) -> None:
        """`behind`: the vectors behind the whole blocks; `last`: behind all."""
        for k in self.sums:
            self.sums[k] += c[k] or 0
        if c["head"] is not None:
            self.sums["illegal"] += self.tail is not None and (self.tail, c["head"]) not in LEGAL
            self.tail = c["tail"]
        if c["low"] is not None:
            self.sums["turns"] -= self.high == c["low"]
            self.low, self.high = c["low"] if self.low is None else self.low, c["high"]
        values = symbols.tolist()
        for start in range(0, len(values), BLOCK):
            block = start // BLOCK
            piece = tuple(values[start : start + BLOCK])
            letters, written, self.state = tables().trace(piece, behind[block] if block < len(behind) else last, self.state)
            self.audit.append(letters)
            for i, state in written:
                if i is None:
                    self.write(ROLE[state], b"")
                else:
                    self.write(roles[start + i] if state is None else ROLE[state], texts[start + i])

    def result(self, cost: int) -> dict:
        while self.state in (AFTER_S, AFTER_U):
            self.state = INSERTS[self.state]
            self.audit.append("I")
            self.write(ROLE[self.state], b"")
        s = self.sums
        gaps = self.high - self.low + 1 - s["turns"] if self.low is not None else 0
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": s["blank"], "duplicate": s["duplicate"], "truncated": s["truncated"],
            "illegal": s["illegal"], "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(),
        }


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SEGMENTS = (
    "part int, segment long, symbols binary, roles array<binary>, texts array<binary>, head int, tail int, low long, high long, turns long, to array<int>, adds array<long>"
)
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2048, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("audit") or "") + sum(map(len, r.get("texts") or ()))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for start in range(0, b.num_rows, 512):  # Python objects of few rows at a time
            yield from b.slice(start, 512).to_pylist()


def _segment(part: int, number: int, p: Part) -> dict:
    to, adds = tables().transition(np.frombuffer(bytes(p.symbols), np.uint8))
    counts = p.counts()
    return {"conv_id": p.conv_id, "part": part, "segment": number, "symbols": bytes(p.symbols), "roles": p.roles, "texts": p.texts, "to": to.tolist(), "adds": adds.tolist(), **counts}


def _finish(p: Part) -> dict:
    w, s = Whole(p.conv_id), np.frombuffer(bytes(p.symbols), np.uint8)
    behind, vector, cost = tables().backward(s, 0)
    w.add(p.counts(), s, p.roles, p.texts, behind, 0)
    return w.result(cost + tables().vectors[vector][START])


def _read_part(rows: Iterator[dict]) -> Iterator[dict]:
    """One task's rows in order: results of the conversations that lie inside,
    segments of the first, the last and the large ones."""
    p, number, first = None, 0, True
    for r in rows:
        if p is not None and r["conv_id"] != p.conv_id:
            yield _finish(p) if not number and not first else _segment(r["part"], number, p)
            p, number, first = None, 0, False
        p = p or Part(r["conv_id"])
        part = r["part"]
        for i in range(r["copies"]):
            if len(p.symbols) >= SEGMENT or p.size >= SEGMENT_BYTES:
                yield _segment(part, number, p)
                p, number = Part(r["conv_id"]), number + 1
            fault, symbol = r["fault"], r["symbol"]
            if i and fault != 1:
                fault, symbol = 2, MUST_DELETE
            p.add(r["turn"], r["role"], r["text"], r["initial"], fault, symbol)
    if p is not None:
        yield _segment(part, number, p)


def _backward(rows: Iterator[dict]) -> Iterator[dict]:
    """Segments of each conversation from the last to the first: adds the
    vector behind the segment and, to the first one, the whole cost."""
    held = None  # the segment before it in the text may belong to another conversation
    vector = cost = 0
    for r in rows:
        if held is not None:
            if held["conv_id"] != r["conv_id"]:
                held["cost"] = cost + tables().vectors[vector][START]
                vector = cost = 0
            yield held
        r["behind"] = vector
        cost += r["adds"][vector]
        vector = r["to"][vector]
        r["to"], r["adds"], held = None, None, r
    if held is not None:
        held["cost"] = cost + tables().vectors[vector][START]
        yield held


def _forward(rows: Iterator[dict]) -> Iterator[dict]:
    w = cost = None
    for r in rows:
        if w is None or r["cost"] is not None:
            if w is not None:
                yield w.result(cost)
            w, cost = Whole(r["conv_id"]), r["cost"]
        s = np.frombuffer(r["symbols"], np.uint8)
        w.add(r, s, r["roles"], r["texts"], tables().backward(s, r["behind"])[0], r["behind"])
    if w is not None:
        yield w.result(cost)


def _mapped(step, columns: str):
    schema = _schema(columns)
    return lambda batches: _batches(step(_rows(batches)), schema)


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation. `rows`: conv_id, turn,
    role, text and copies, as `damaged` gives them."""
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    ranged = symbols(rows).repartitionByRange(*order, F.substring("text", 1, 64).asc_nulls_first())
    ranged = ranged.sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select(
        "conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"),
        "copies", "initial", "fault", "symbol", F.spark_partition_id().alias("part"),
    )
    both = f"{RESULT}, {SEGMENTS}"
    read = materialize(ranged.mapInArrow(_mapped(_read_part, both), both), "repair-parts")
    results = [c.split(" ")[0] for c in RESULT.split(", ")]
    done = read.where("segment is null").select(*results)
    place = ["part", "segment"]
    behind = f"{both}, behind int"
    parts = read.where("segment is not null").repartition("conv_id").sortWithinPartitions("conv_id", *[F.desc(c) for c in place])
    parts = parts.mapInArrow(_mapped(_backward, behind), behind).sortWithinPartitions("conv_id", *place)
    return done.unionByName(parts.mapInArrow(_mapped(_forward, RESULT), RESULT))


def repaired(conversations: DataFrame) -> DataFrame:
    """The conversations damaged and repaired, one row each."""
    return repair(damaged(conversations))


#: The same in DuckDB's SQL: a forward search that keeps, for every state, the
#: cheapest way with the least letters, and its text.
REPAIR_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key,
         coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0 FROM conversations
), kinds AS (
  SELECT conv_id, turn, r0, t0, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: ascii(c)),
           lambda s, b: xor(s // 256, bits.t[xor(s, b) % 256 + 1])), 4294967295) % 20 AS kind FROM keyed, bits
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r0 END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(t0, '.!?', '') ELSE t0 END AS text
  FROM kinds, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), numbered AS (
  SELECT *, row_number() OVER w AS n,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS c, lag(left(role, 1)) OVER w AS prior
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), faults AS (
  SELECT *, body = '' AS blank, body <> '' AND seen > 1 AS dup, body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM numbered)
), convs AS (
  SELECT conv_id, coalesce(max(n), 0) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (prior || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), ways(conv_id, n, s, su, u, a) AS (
  SELECT conv_id, 0, {'c': 0, 'l': '', 't': ''}, NULL::STRUCT(c INTEGER, l VARCHAR, t VARCHAR),
         {'c': 5, 'l': 'I', 't': chr(10) || 'user:'}, {'c': 10, 'l': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} FROM convs
  UNION ALL
  SELECT conv_id, n, s, su, u, a FROM (
    SELECT conv_id, n, s, su,
      list_min(list_filter([u, {'c': s.c + 5, 'l': s.l || 'I', 't': s.t || chr(10) || 'user:'}, {'c': su.c + 5, 'l': su.l || 'I', 't': su.t || chr(10) || 'user:'},
        {'c': a.c + 5, 'l': a.l || 'I', 't': a.t || chr(10) || 'user:'}], lambda z: z.c IS NOT NULL)) AS u,
      list_min(list_filter([a, {'c': u.c + 5, 'l': u.l || 'I', 't': u.t || chr(10) || 'assistant:'},
        {'c': s.c + 10, 'l': s.l || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
        {'c': su.c + 10, 'l': su.l || 'II', 't': su.t || chr(10) || 'user:' || chr(10) || 'assistant:'}], lambda z: z.c IS NOT NULL)) AS a
    FROM (
      SELECT w.conv_id, w.n + 1 AS n,
        {'c': s.c + 2, 'l': s.l || 'D', 't': s.t} AS s,
        list_min(list_filter([{'c': su.c + 2, 'l': su.l || 'D', 't': su.t},
          {'c': CASE WHEN ok AND f.c = 's' THEN s.c + x END, 'l': s.l || 'K', 't': s.t || kept}], lambda z: z.c IS NOT NULL)) AS su,
        list_min(list_filter([{'c': u.c + 2, 'l': u.l || 'D', 't': u.t},
          {'c': CASE WHEN ok AND f.c = 'u' THEN s.c + x END, 'l': s.l || 'K', 't': s.t || kept},
          {'c': CASE WHEN ok AND f.c = 'u' THEN su.c + x END, 'l': su.l || 'K', 't': su.t || kept},
          {'c': CASE WHEN ok AND f.c = 'u' THEN a.c + x END, 'l': a.l || 'K', 't': a.t || kept},
          {'c': CASE WHEN ok THEN s.c + x + 1 END, 'l': s.l || 'R', 't': s.t || chr(10) || 'user:' || f.text},
          {'c': CASE WHEN ok THEN su.c + x + 1 END, 'l': su.l || 'R', 't': su.t || chr(10) || 'user:' || f.text},
          {'c': CASE WHEN ok THEN a.c + x + 1 END, 'l': a.l || 'R', 't': a.t || chr(10) || 'user:' || f.text}], lambda z: z.c IS NOT NULL)) AS u,
        list_min(list_filter([{'c': a.c + 2, 'l': a.l || 'D', 't': a.t},
          {'c': CASE WHEN ok AND f.c = 'a' THEN u.c + x END, 'l': u.l || 'K', 't': u.t || kept},
          {'c': CASE WHEN ok THEN u.c + x + 1 END, 'l': u.l || 'R', 't': u.t || chr(10) || 'assistant:' || f.text}], lambda z: z.c IS NOT NULL)) AS a
      FROM ways w JOIN (SELECT *, NOT blank AND NOT dup AS ok, CASE WHEN cut THEN 5 ELSE 0 END AS x, chr(10) || role || ':' || text AS kept FROM faults) f
        ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1
    )
  )
), ends AS (
  SELECT w.conv_id, list_min([w.s, w.a]) AS best FROM ways w JOIN convs v ON w.conv_id IS NOT DISTINCT FROM v.conv_id AND w.n = v.n
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.l, '') AS audit, sha256(coalesce(substring(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs v ON o.conv_id IS NOT DISTINCT FROM v.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
