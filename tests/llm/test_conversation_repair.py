import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import conversation_repair as R
from loam.llm.conversation_repair import damage, repair_conversations
from loam.llm.queries import op12_conversation_repair

SPACES = " \t\n\x0b\x0c\r"
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}


def hurt(rows):
    """Rows of the contract's damage: (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra over whole audits: least cost, then ASCII-least."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(kept)
        for role in ("user", "assistant"):
            if role[0] in FOLLOW[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*kept, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, kept))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] and role[:1] in FOLLOW[last]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*kept, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if new[0] in FOLLOW[last]:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new[0], (*kept, f"{new}:{text}")))
    raise AssertionError


def plain(rows, convs):
    """What the operator has to return, conversation by conversation."""
    out, by = {}, defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    for conv in convs:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, role, text in own:
            end = text.rstrip(SPACES)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = cheapest(judged)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def messy(seed, n_convs=60, most=12):
    r = random.Random(seed)
    rows = []
    for c in [*range(n_convs), None]:
        for t in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None, "ua"])
            text = r.choice([None, "", " \t", "Yes.", "No!", "Cut off", "Why? ", "Why?\n x", "é京.", f"text {t}.", "no end\x0b"])
            rows.append((c, r.choice([t, t, t, t + 3, None]), role, text))
    return rows + rows[:9]


def compare(got, want):
    have = {r[0]: tuple(r)[1:] for r in got}
    assert len(got) == len(have) and have.keys() == want.keys()
    for k in want:
        assert have[k] == want[k], k


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_damaged_conversations(spark, seed, tmp_path):
    rows = messy(seed)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_conversation_repair(spark, str(tmp_path)).collect()
    compare(got, plain(hurt(rows), {r[0] for r in rows}))


def test_conversations_longer_than_a_range(spark, monkeypatch):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "user", "assistant", "system", "x"]), r.choice(["Same.", f"{t}.", f"{t}", ""])) for t in range(400)]
    rows += [(8, None, "user", "Equal.")] * 150 + [(9, 1, "assistant", f"{k}?") for k in range(150)] + messy(4, 10)
    monkeypatch.setattr(R, "buckets_for", lambda df, mb: 24)
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"conv_id": "c", "turn": "n", "role": "code", "text": "digest"})
    got = repair_conversations(df, conv="c", turn="n", role="code", text="digest").collect()
    filled = [(c, t, role or "", text or "") for c, t, role, text in rows]
    compare(got, plain(filled, {r[0] for r in rows}))


def test_turns_and_empty_table(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "user", "There?"), ("b", 0, "system", "Be kind.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in repair_conversations(df.repartition(1), with_turns=True).collect()}
    assert got["a"].audit == "KR" and got["a"].cost == 2 and got["b"].audit == "D"
    assert [tuple(t) for t in got["a"].turns] == [("user", "Hi."), ("assistant", "There?")] and got["b"].turns == []
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert damage(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dropped_rows_leave_their_conversation(spark):
    dropped = next((c, 0, "user", "Gone.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair_conversations(damage(spark.createDataFrame([dropped], SCHEMA)), copies="copies").collect()
    assert [tuple(r) for r in got] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), st.sampled_from(["blank", "duplicate", "truncated", None, None, None])), max_size=9), st.integers(0, 9))
def test_walk_is_the_least_edit(rows, cut):
    code = {"u": R.U, "a": R.A, "s": R.S, "x": R.OTHER}
    fault = {None: R.NONE, "blank": R.BLANK, "duplicate": R.DUPLICATE, "truncated": R.TRUNCATED}
    codes = bytes(code[role[0]] + 4 * fault[f] for role, f in rows)
    cost, audit, _ = cheapest([(role, "t", f) for role, f in rows])
    assert (R.costs(codes, R.AT_END)[R.START], R.walk(codes, R.START, R.AT_END)[0]) == (cost, audit)
    left, right = codes[:cut], codes[cut:]  # the same in two fragments
    behind = R.costs(right, R.AT_END)
    assert min(R.matrix(left)[q][R.START] + behind[q] for q in range(4)) == cost
    a, _, state = R.walk(left, R.START, behind, last=False)
    assert a + R.walk(right, state, R.AT_END)[0] == audit
