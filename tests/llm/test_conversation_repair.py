"""Conversation repair against a search over all edits, and against a plain table of costs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from echogrid.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, letters string, step int"
SPACES = " \t\n\x0b\x0c\r"
SOUND = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """(cost, edits, repaired rows) by Dijkstra's search over (rows done, initials so far); the queue is ordered by cost and edits."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, i, state, kept = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, edits, list(kept)
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i < len(rows):
            role, text, fault = rows[i]
            late = fault == "truncated"
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, state, kept))
            if fault in ("", "truncated"):
                if role[:1] and role[0] in follows:
                    heapq.heappush(queue, (cost + late, edits + "K", i + 1, role[0], (*kept, (role, text))))
                for to in ("user", "assistant"):
                    if to[0] in follows:
                        heapq.heappush(queue, (cost + 2 + late, edits + "R", i + 1, to[0], (*kept, (to, text))))
        for to in ("user", "assistant"):
            if to[0] in follows:
                heapq.heappush(queue, (cost + 2, edits + "I", i, to[0], (*kept, (to, ""))))
    raise AssertionError


def brute(rows):
    out = {}
    hurt = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, edits, kept = cheapest([(r[2], r[3], f) for r, f in zip(own, faults, strict=True)])
        assert SOUND.fullmatch("".join(r[0] for r, _ in kept))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, edits, sha), kept
    return out


def sample(seed=2, n=150):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "so it is. \t", "", "  \n", None, "Étion dans. ", "\x1f", "more…"]
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(0, 14)):
            rows.append((conv, None if r.random() < 0.05 else turn * r.choice([1, 1, 1, 2]), r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "Sam"]), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.", "x", 3))
    # no turns, all rows dropped, repeated rows, one turn for all, no conv_id
    dropped = [c for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    rows += [(c, 0, "user", "gone", "", 0) for c in dropped] + [(500, None, "user", "a.", "", 0)] * 3 + [(501, 7, x, "b.", "", 0) for x in ("user", "assistant", "system")] * 4
    return rows + [(None, t, "assistant" if t % 2 else "user", "c.", "", 1) for t in range(9)] + [(502, t, "user" if t % 3 else "assistant", "again.", "", 1) for t in range(40)] + [(503, -(2**63), "user", "a.", "", 0), (503, 2**63 - 1, "assistant", "b.", "", 0)]


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_the_search_over_all_edits(spark, block):
    rows = sample()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in repair.digest(df, block).collect()}
    for conv, (values, _) in want.items():
        assert got[conv] == (min(values[0], 2**63 - 1), *values[1:]), conv
    assert got.keys() == want.keys()
    if block == 3:
        out = {}
        for conv, place, role, text in sorted(map(tuple, repair.repaired(df, block).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            out.setdefault(conv, []).append((role, text))
            assert place == len(out[conv]) - 1
        assert out == {conv: kept for conv, (_, kept) in want.items() if kept}


def test_empty_table_and_long_texts(spark):
    assert repair.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, t, "assistant" if t % 2 else "user", "word " * 600_000 + f"{t}.", "", 0) for t in range(4)]
    got = [tuple(r)[1:] for r in repair.digest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [brute(rows)[1][0]]


def test_blocks_of_a_conversation_that_holds_most_rows(spark):
    """Blocks on several tasks give the edits of one long walk."""
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), f"{t}{r.choice(['.', ''])}", "", 0) for t in range(3000)] + [(2, 0, "user", "a.", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = repair.blocks(repair.faults(repair.damaged(df)), 100)
        assert made.where("conv_id = 1").select("part").distinct().count() > 1
        got = {x.conv_id: x for x in repair.digest(df, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {c: tuple(x)[1:] for c, x in got.items()} == {c: v for c, (v, _) in brute(rows).items()}


def test_checkpoints_give_the_walk_over_all_vectors():
    r = random.Random(1)
    for n in (1, 2, 3, 10, 50, 101):
        letters, faults = "".join(r.choice("sua?") for _ in range(n)), bytes(r.choice([0, 0, 1, 2]) for _ in range(n))
        vectors = [repair.FINAL]
        for a, f in zip(reversed(letters), reversed(faults), strict=True):
            vectors.append(repair.before(a, f, vectors[-1]))
        v, total = repair.back(letters, faults, repair.FINAL)
        assert tuple(x + total for x in v) == vectors[-1]
        q, want = 0, []
        for i, (a, f) in enumerate(zip(letters, faults, strict=True)):
            edits, q = repair.taken(a, f, vectors[n - 1 - i], q)
            want.append(edits)
        assert repair.walk(letters, faults, repair.FINAL, 0) == (want, q)
        m = repair.matrix(letters, faults)
        least = min(vectors[-1])
        assert repair.through(m, repair.FINAL) == tuple(x - least for x in vectors[-1])
