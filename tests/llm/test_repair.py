import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import repair as rp

AUDIT = str.maketrans("uaUA", "IIRR")


def plain_faults(rows):
    """(role, text) in order -> faults."""
    seen, out = set(), []
    for role, text in rows:
        last = re.findall("[^ \t-\r]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired rows) by best-first search over (cost, audit)."""
    faults, heap, done, best = plain_faults(rows), [(0, "", 0, 0, ())], {}, None
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and q in (0, 3):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if cost > 4 * len(rows) + 6 or done.get((i, q), (cost + 1,)) <= (cost, audit):
            continue
        done[i, q] = (cost, audit)
        after, name = (3, "assistant") if q == 2 else (2, "user")
        heapq.heappush(heap, (cost + 3, audit + "I", i, after, (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if faults[i] in (None, "truncated"):
                extra = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, after, (*out, (name, text))))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                if kept:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept, (*out, (role, text))))
    return best


def conversations(seed, n, longest):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No!", "", " \t", "cut off", "What?", "Yes. ", f"Turn {rng.randrange(99)}."])
    return {c: [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), text()) for _ in range(rng.randrange(1, longest))] for c in range(n)}


def check(found, expected):
    rows = found.select("conv", "part", "nth", "turn", "role", "text", "fault", "illegal", "edits", "cost", rp.repaired(F.col("edits"), F.col("role"), F.col("text")).alias("out")).orderBy("conv", "part", "nth").collect()
    digest = {r.conv: r for r in rp.digests(found).collect()}
    assert set(digest) == set(expected)
    for c, turns in expected.items():
        own = [r for r in rows if r.conv == c]
        assert [(r.role, r.text) for r in own] == turns
        cost, audit, out = plain_repair(turns)
        assert [r.fault for r in own] == plain_faults(turns)
        initials = [x[:1] for x, _ in turns]
        assert sum(r.illegal for r in own) == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert (sum(r.cost for r in own), "".join(r.edits for r in own).translate(AUDIT)) == (cost, audit)
        assert [tuple(x) for r in own for x in r.out] == list(out)
        assert digest[c].audit == audit and digest[c].repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def frame(spark, conversations):
    rows = [(c, k, role, text, "x", 1) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, cost int")


@pytest.mark.parametrize("block", [64, 3])
def test_repair_against_search(spark, monkeypatch, block):
    monkeypatch.setattr(rp, "BLOCK", block)
    own = conversations(block, 60, 9)
    check(rp.repair(frame(spark, own)), own)


def test_a_conversation_over_many_tasks(spark):
    own = conversations(5, 3, 8) | {7: conversations(6, 1, 400)[0] + conversations(8, 1, 90)[0]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = rp.repair(frame(spark, own))
        assert found.where("conv = 7").select("part").distinct().count() > 3
        check(found, own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_blocks_against_search():
    rng = random.Random(9)
    letters = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for _ in range(300):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(1, 8)))
        # A text of its own makes no duplicates; what only may go is blank.
        rows = [(letters[c // 3], ("Fine %d.", "cut %d", " ")[c % 3] % i if c % 3 < 2 else " ") for i, c in enumerate(codes)]
        edits, _, cost = rp.repair_piece(codes, rp.END, 0, True)
        assert (cost, "".join(edits).translate(AUDIT)) == plain_repair(rows)[:2]


def test_edges(spark):
    rows = [(None, None, "user", "Hi."), (None, 0, "assistant", "Ho."), (1, 3, None, None), (1, None, "user", "Null turns first."), (2, 5, "user", "word " * 100_000 + "."), (2, 6, "assistant", "é\U0001f642."), (3, 1, "user", "Same."), (3, 1, "user", "Same.")]
    found = rp.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv: (r.audit, r.repaired_sha256) for r in rp.digests(found).collect()}
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got[None] == ("KK", sha("user:Hi.", "assistant:Ho."))
    assert got[1] == ("KDI", sha("user:Null turns first.", "assistant:"))
    assert got[2] == ("KK", sha("user:" + "word " * 100_000 + ".", "assistant:é\U0001f642."))
    assert got[3] == ("KDI", sha("user:Same.", "assistant:"))
    empty = rp.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert empty.collect() == [] and rp.digests(empty).collect() == []
