"""Repair of conversations: faults of their turns, and the cheapest edits that make roles alternate again.

A conversation may be longer than a task: rows are sorted into ranges, and a conversation that reaches over a range's end
is put together from its fragments' cost matrices. Within a fragment the backward costs are kept at every square root of
its rows only, and a block's are computed again when the walk forward enters it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loam.llm.common import buckets_for
from loam.shared import stored

#: Classes of a role's first letter. A state is what the last role was, START before the first.
START, S, U, A = range(4)
OTHER = 0
#: A row's first fault.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: NEXT[state][class]: the state after a role that may follow; ONLY[state]: the one that an edit can put there.
NEXT = ((None, S, U, None), (None, None, U, None), (None, None, None, A), (None, None, U, None))
ONLY = (U, U, A, U)
ROLES = {U: "user", A: "assistant"}
LEGAL = {(S, U), (U, A), (A, U)}
#: Costs when no row is left: nothing, or a reply is there; else turns have to be inserted.
AT_END = (0, 4, 2, 0)
FAR = 1 << 40
#: Ranges at most: the driver holds two small summaries of each.
MOST_RANGES = 1 << 16
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def backward(code: int, after: Sequence[int]) -> list[int]:
    """Least costs in each state before a row, from those after it. A code is class + 4 x fault."""
    cls, fault = code & 3, code >> 2
    v = [3 + x for x in after]
    if fault not in (BLANK, DUPLICATE):
        more = int(fault == TRUNCATED)
        for q in range(4):
            v[q] = min(v[q], 2 + more + after[ONLY[q]])
            if (to := NEXT[q][cls]) is not None:
                v[q] = min(v[q], more + after[to])
    v[U], v[A] = min(v[U], 2 + v[A]), min(v[A], 2 + v[U])
    v[START], v[S] = min(v[START], 2 + v[U]), min(v[S], 2 + v[U])
    return v


def costs(codes: bytes, after: Sequence[int]) -> list[int]:
    v = list(after)
    for code in reversed(codes):
        v = backward(code, v)
    return v


def matrix(codes: bytes) -> list[list[int]]:
    """[to][from]: the least cost of a fragment that is entered in state `from` and left in state `to`."""
    return [costs(codes, [0 if q == to else FAR for q in range(4)]) for to in range(4)]


def walk(codes: bytes, state: int, after: Sequence[int], last: bool = True) -> tuple[str, list[tuple[int, int]], int]:
    """The ASCII-least edits of least cost from a state on, if `after` are the costs behind the fragment; each edit's (row,
    or -1 if inserted; role it sets, or -1); the state at the end. last: no fragment follows.

    Backward costs are stored at block ends only: memory and work are those of twice the square root, and twice the rows."""
    block = isqrt(len(codes)) + 1
    marks, v = [list(after)], list(after)
    for begin in range((len(codes) - 1) // block * block if codes else -1, -1, -block):
        v = costs(codes[begin : begin + block], v)
        marks.append(v)
    audit, steps = [], []
    for begin in range(0, len(codes), block):
        own = codes[begin : begin + block]
        marks.pop()
        there = [marks[-1]]
        for code in reversed(own):
            there.append(backward(code, there[-1]))
        for i, code in enumerate(own):
            now, then = there.pop(), there[-1]
            while 3 + then[state] != now[state] and 2 + now[ONLY[state]] == now[state]:
                state = ONLY[state]
                audit.append("I")
                steps.append((-1, state))
            more = int(code >> 2 == TRUNCATED)
            if 3 + then[state] == now[state]:
                audit.append("D")
                continue
            to = NEXT[state][code & 3]
            if to is not None and more + then[to] == now[state]:
                audit.append("K")
                steps.append((begin + i, -1))
            else:
                to = ONLY[state]
                audit.append("R")
                steps.append((begin + i, to))
            state = to
    while last and AT_END[state]:
        state = ONLY[state]
        audit.append("I")
        steps.append((-1, state))
    return "".join(audit), steps, state


@dataclass
class Fragment:
    """Rows of one conversation that stand together in a range."""

    conv: object
    codes: bytearray = field(default_factory=bytearray)
    texts: dict[int, tuple[str, str]] = field(default_factory=dict)
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, n: int, code: int, role: str | None, text: str | None) -> None:
        """A row n times: what follows its first is its duplicate, unless it is blank."""
        if n and turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if n and code >> 2 in (NONE, TRUNCATED):
            self.texts[len(self.codes)] = (role, text)
        self.codes += bytes([code]) + bytes([code if code >> 2 == BLANK else (code & 3) | DUPLICATE << 2]) * (n - 1) if n else b""

    def summary(self) -> dict:
        c = self.codes
        faults = [0, 0, 0, 0]
        for code in c:
            faults[code >> 2] += 1
        illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(c, c[1:], strict=False))
        return {"rows": len(c), "low": self.low, "high": self.high, "turns": self.turns, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED], "illegal": illegal, "first": c[0] & 3 if c else None, "last": c[-1] & 3 if c else None}

    def repaired(self, steps: list[tuple[int, int]]) -> list[tuple[str, str]]:
        """Role and text of the turns that edits leave."""
        kept = (self.texts[i] if i >= 0 else ("", "") for i, _ in steps)
        return [(ROLES.get(role, own), text) for (own, text), (_, role) in zip(kept, steps, strict=True)]


def joined(a: dict, b: dict) -> dict:
    """The summary of two neighbouring fragments."""
    if not a["rows"] or not b["rows"]:
        return a if a["rows"] else b
    out = {k: a[k] + b[k] for k in ("rows", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["illegal"] += (a["last"], b["first"]) not in LEGAL
    return out | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "first": a["first"], "last": b["last"]}


def counts(summary: dict, cost: int) -> list[int]:
    gaps = summary["high"] - summary["low"] + 1 - summary["turns"] if summary["turns"] else 0
    return [gaps, *(summary[k] for k in COUNTS[1:5]), cost]


def damage(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copies: rows as a lossy log might leave them, by crc32(`conv:turn`) % 20. 0: copies = 0;
    1: no text; 2: no sentence ends; 3: copies = 2; 4: role user. A null counts as one space, but stays null in conv, turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    said = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    return rows.select(F.col(conv), F.col(turn), F.when(fate == 4, "user").otherwise(filled(role)).alias(role), said.alias(text), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def _ranges(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, n, code, text in ranges of conversation and turn, sorted. Equal rows are one, with n. A row
    without n brings a text to where its conversation has it first, and sorts right before that row."""
    spaces = r"\x20\x09-\x0D"
    fault = F.when(~F.col("text").rlike(f"[^{spaces}]"), BLANK).when(F.col("text").rlike(rf"[^.!?{spaces}][{spaces}]*\z"), TRUNCATED).otherwise(NONE)
    cls = F.when(F.startswith("role", F.lit("s")), S).when(F.startswith("role", F.lit("u")), U).when(F.startswith("role", F.lit("a")), A).otherwise(OTHER)
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("fault", fault).withColumn("code", (cls + 4 * F.col("fault")).cast("int"))
    narrow = rows.groupBy("conv", "turn", "role", "digest", "code").agg(F.sum("n").cast("bigint").alias("n"))
    seen = rows.where((F.col("n") > 0) & (F.col("fault") != BLANK)).groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("at"), F.first("text").alias("text"))
    marks = seen.select("conv", "at.turn", "role", "digest", F.lit(None).cast("int").alias("code"), F.lit(None).cast("bigint").alias("n"), "text")
    parts = min(MOST_RANGES, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets_for(rows.select("role", "text"), 32)))
    by = ["conv", "turn", "role", "digest"]
    return narrow.withColumn("text", F.lit(None).cast("string")).unionByName(marks).repartitionByRange(parts, *by).sortWithinPartitions(*by, F.col("n").asc_nulls_first())


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[Fragment]:
    """Fragments of one range in order. The row behind a text is the first that has it; others are duplicates."""
    own, mark, said = None, None, None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv", "turn", "role", "digest", "n", "code", "text")]
        for conv, turn, role, digest, n, code, text in zip(*columns, strict=True):
            if own is None or conv != own.conv:
                if own is not None:
                    yield own
                own = Fragment(conv)
            if n is None:
                mark, said = (conv, turn, role, digest), text
                continue
            if n and code >> 2 != BLANK and mark != (conv, turn, role, digest):
                code = (code & 3) | DUPLICATE << 2
            own.add(turn, n, code, role, said)
            mark = None
    if own is not None:
        yield own


def repair_conversations(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, with_turns: bool = False) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, if asked
    for, turns (role and text of what is left, as one array).

    Rows go by turn, nulls first, those of one turn by role and the text's SHA-256. A row's first fault counts: blank (only
    white space), duplicate (role and text stood in the conversation before), truncated (its last character that is no
    white space ends no sentence). gaps: missing turns between the least and the greatest. illegal: neighbours whose
    roles' first letters are not su, ua or au. Edits, in order: K keep (0), R set role user or assistant (2), D delete (3;
    has to be for blank and duplicate), I insert an empty turn (2); 1 more for a truncated row that stays; the roles' first
    letters have to be (s?(ua)+)? then. Of the cheapest edits, audit is the ASCII-least. copies: a column that says how
    often a row stands there, 0 for rows that only name their conversation.

    Conversations of any length: ranges of rows are tasks, and of one that spans ranges the driver composes a 4 x 4 matrix
    per range (65,536 ranges at most). Equal rows are counted before the shuffle. Only
    the repaired text's hash and the audit are put together in one task per conversation, piece by piece. Null roles and
    texts are empty; null conversations are one; no rows left: zeros, an empty audit, the empty text's hash; other columns
    are ignored; empty gives empty.
    """
    spark = rows.sparkSession
    kind = rows.schema[conv].dataType
    filled = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), (F.lit(1) if copies is None else F.col(copies)).cast("int").alias("n"))
    turns = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    report = [T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()), T.StructField("turns", turns)]
    edge = [T.StructField("part", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    both = T.StructType([*report, *edge])
    shape = to_arrow_schema(both)

    def reported(own: Fragment) -> dict:
        codes = bytes(own.codes)
        audit, steps, _ = walk(codes, START, AT_END)
        left = own.repaired(steps)
        out = dict(zip(COUNTS, counts(own.summary(), costs(codes, AT_END)[START]), strict=True)) | {"conv": own.conv, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()}
        return out | {"turns": [{"role": r, "text": t} for r, t in left]} if with_turns else out

    def pending(own: Fragment, part: int, place: int) -> Iterator[dict]:
        """A fragment's rows as they are, for the conversation may go on in other ranges. Its first row has its turns."""
        low = {"conv": own.conv, "part": part, "place": place}
        yield low | {"seq": -1, "turn": own.low, "n": own.turns, "gaps": own.high}
        for i, code in enumerate(own.codes):
            role, text = own.texts.get(i, (None, None))
            yield low | {"seq": i, "code": code, "role": role, "text": text}

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, before = TaskContext.get().partitionId(), 0, [], None
        for own in _fragments(batches):
            if before is not None:
                held += pending(before, part, 0) if place == 0 else [reported(before)]
                place = 1
            before = own
            if len(held) >= 2000:
                yield pa.RecordBatch.from_pylist(held, shape)
                held = []
        if before is not None:
            held += pending(before, part, place)
        for k in range(0, len(held), 2000):
            yield pa.RecordBatch.from_pylist(held[k : k + 2000], shape)

    found = stored(_ranges(filled).mapInArrow(first_pass, both), "conversations")
    inside = found.where("part is null").select([f.name for f in report])
    edges = found.where("part is not null").select("conv", *(f.name for f in edge), F.col("gaps").alias("high"))
    out = inside.unionByName(_across(edges, T.StructType(report), with_turns))
    return out.select(F.col("conv").alias(conv), *COUNTS, "audit", "repaired_sha256", *(["turns"] if with_turns else []))


def _fragment_of(table: pa.Table) -> Fragment:
    table = table.sort_by("seq")
    rows = table.to_pylist()
    own = Fragment(rows[0]["conv"], bytearray(r["code"] for r in rows[1:]), {r["seq"]: (r["role"], r["text"]) for r in rows[1:] if r["text"] is not None})
    own.low, own.high, own.turns = rows[0]["turn"], rows[0]["high"], rows[0]["n"]
    return own


def _across(edges: DataFrame, report: T.StructType, with_turns: bool) -> DataFrame:
    """Conversations at the ranges' ends: summaries of their fragments, composed on the driver, then one more pass."""
    spark = edges.sparkSession

    def summed(table: pa.Table) -> pa.Table:
        own = _fragment_of(table)
        said = json.dumps(own.summary() | {"matrix": matrix(bytes(own.codes)), "key": repr(own.conv)})
        return pa.table({"part": table["part"][:1], "place": table["place"][:1], "said": [said]})

    per = edges.groupBy("part", "place").applyInArrow(summed, "part bigint, place int, said string")
    fragments = [(r.part, r.place, json.loads(r.said)) for r in sorted(per.collect())]
    chains: list[list] = []
    for f in fragments:
        if chains and chains[-1][-1][2]["key"] == f[2]["key"]:
            chains[-1].append(f)
        else:
            chains.append([f])
    after: dict[tuple[int, int], list[int]] = {}
    whole: dict[int, list[int]] = {}
    for k, chain in enumerate(chains):
        v = list(AT_END)
        for part, place, said in reversed(chain):
            after[part, place] = v
            v = [min(said["matrix"][to][q] + v[to] for to in range(4)) for q in range(4)]
        total = chain[0][2]
        for _, _, said in chain[1:]:
            total = joined(total, said)
        whole[k] = counts(total, v[START])
    long = [chain for chain in chains if len(chain) > 1]
    enter: dict[tuple[int, int], int] = {}
    if long:
        ends = {(p, q): after[p, q] for chain in long for p, q, _ in chain}
        sent = spark.sparkContext.broadcast(ends)

        def left(table: pa.Table) -> pa.Table:
            own, at = bytes(_fragment_of(table).codes), (table["part"][0].as_py(), table["place"][0].as_py())
            to = [walk(own, q, sent.value[at], last=False)[2] for q in range(4)] if at in sent.value else []
            return pa.table({"part": table["part"][:1], "place": table["place"][:1], "states": pa.array([to], pa.list_(pa.int32()))})

        went = {(r.part, r.place): r.states for r in edges.groupBy("part", "place").applyInArrow(left, "part bigint, place int, states array<int>").collect()}
        for chain in long:
            state = START
            for part, place, _ in chain:
                enter[part, place] = state
                state = went[part, place][state]
    plan = spark.sparkContext.broadcast({(p, q): (k, enter.get((p, q), START), after[p, q], i == len(chain) - 1) for k, chain in enumerate(chains) for i, (p, q, _) in enumerate(chain)})
    totals = spark.sparkContext.broadcast(whole)

    def pieces(table: pa.Table) -> pa.Table:
        own, at = _fragment_of(table), (table["part"][0].as_py(), table["place"][0].as_py())
        chain, state, behind, last = plan.value[at]
        audit, steps, _ = walk(bytes(own.codes), state, behind, last)
        left = [{"role": r, "text": t} for r, t in own.repaired(steps)]
        return pa.table({"conv": table["conv"][:1], "chain": [chain], "part": table["part"][:1], "place": table["place"][:1], "audit": [audit], "turns": pa.array([left], shape.field("turns").type)})

    shape = to_arrow_schema(report)
    schema = T.StructType([report["conv"], T.StructField("chain", T.LongType()), *edges.select("part", "place").schema, report["audit"], report["turns"]])
    cut = edges.groupBy("part", "place").applyInArrow(pieces, schema)
    lined = cut.repartition("chain").sortWithinPartitions("chain", "part", "place")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, conv, audit, sha, turns, begun = None, None, [], None, [], False

        def done() -> pa.RecordBatch:
            values = [*totals.value[own], "".join(audit), sha.hexdigest(), turns if with_turns else None]
            return pa.RecordBatch.from_arrays([conv, *(pa.array([x], f.type) for x, f in zip(values, list(shape)[1:], strict=True))], schema=shape)

        for batch in batches:
            for i in range(batch.num_rows):
                if (chain := batch.column(1)[i].as_py()) != own:
                    if own is not None:
                        yield done()
                    own, conv, audit, sha, turns, begun = chain, batch.column(0).slice(i, 1), [], hashlib.sha256(), [], False
                audit.append(batch.column(4)[i].as_py())
                for t in (left := batch.column(5)[i].as_py()):
                    sha.update(f"{chr(10) if begun else ''}{t['role']}:{t['text']}".encode())
                    begun = True
                if with_turns:
                    turns += left
        if own is not None:
            yield done()

    return lined.mapInArrow(digests, report)
