"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar.

Roles must read `(s?(ua)+)?`: nothing, or an optional system turn and then pairs of user and assistant turns. Rows may
be kept, get another role, be deleted, and turns without text may be inserted, each at a price. Prices are searched
layer by layer, as approximate matching by bit vectors does it: for each cost 0, 1, 2, ... and each turn stands the set
of grammar states from which the rest can be finished at exactly that cost, as bits; a layer comes from the layers
below it. The first layer that accepts from the start gives the cost, and following bits from there, taking the
ASCII-least edit that still has its bit, gives the least audit.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any length lies in as many tasks as it needs.
Tasks work in blocks of BLOCK rows. Of a piece that may go on in another task, they first tell what it costs from each
state to each other (16 numbers, two pieces a task at most); from those a piece learns what the rest costs, traces its
edits from each state that may be its first, and in the end the one that is its first counts.
"""

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ordered_parts, salted, written

#: Grammar states: 0 nothing yet, 1 after a system turn, 2 after a user's, 3 after an assistant's; 0 and 3 accept. An
#: inserted or renamed turn is what the state lacks: the assistant's in 2, the user's elsewhere.
NEXT = (2, 2, 3, 2)
#: Role initial -> states in which a row can be kept, and the state after it.
KEPT = {"s": ((0,), 1), "u": ((0, 1, 3), 2), "a": ((2,), 3)}
INITIALS = "sua"
#: Prices, and what the end costs from each state: turns that are still to be inserted.
RENAME, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
END = (0, 2 * INSERT, INSERT, 0)
#: What a row allows: kept for nothing, kept at a price, only deleted.
FINE, CUT_OFF, GONE = 0, 1, 2
BLOCK = 64
WHITE = " \t\n\x0b\x0c\r"


def _before(pairs) -> bytes:
    """For each set of states, as bits, the states from which a step (from, to) leads into it."""
    return bytes(sum(1 << a for a, b in pairs if s >> b & 1) for s in range(16))


_STEP = _before(list(enumerate(NEXT)))
_KEEP = [_before([(a, KEPT[r][1]) for a in KEPT[r][0]]) for r in INITIALS] + [bytes(16)]


@lru_cache(maxsize=2048)
def layers(codes: bytes, goal: tuple[float, ...]) -> tuple[bytes, ...]:
    """For each cost, the sets of states before each row of a block, and after its last, from which the rest costs that
    and what `goal` says beyond its least. codes: 3 * role + what the row allows. As many layers as reach every state
    that can be finished."""
    n, low = len(codes), min(goal)
    nothing, found, seen = bytes(n + 1), [], 0
    limit = max(v for v in goal if v < math.inf) - low + DELETE * n + 2 * INSERT if low < math.inf else -1
    while seen != 15 and len(found) <= limit:
        d = len(found)
        insert, delete, kept_at_price, renamed_at_price = (found[d - k] if d >= k else nothing for k in (INSERT, DELETE, TRUNCATED, RENAME + TRUNCATED))
        rename, own = found[d - RENAME] if d >= RENAME else nothing, bytearray(n + 1)
        own[n] = _STEP[insert[n]] | sum(1 << q for q, v in enumerate(goal) if v - low == d)
        for i in range(n - 1, -1, -1):
            role, allows = divmod(codes[i], 3)
            states = _STEP[insert[i]] | delete[i + 1]
            if allows == FINE:
                states |= _KEEP[role][own[i + 1]] | _STEP[rename[i + 1]]
            elif allows == CUT_OFF:
                states |= _KEEP[role][kept_at_price[i + 1]] | _STEP[renamed_at_price[i + 1]]
            own[i] = states
        found.append(bytes(own))
        seen |= own[0]
    return tuple(found)


def starts(codes: bytes, goal: tuple[float, ...]) -> tuple[float, ...]:
    """What each state before a block costs, if the states after it cost `goal`."""
    found, low = layers(codes, goal), min(goal)
    return tuple(next((low + d for d, own in enumerate(found) if own[0] >> q & 1), math.inf) for q in range(4))


def trace(codes: bytes, goal: tuple[float, ...], state: int) -> tuple[list[str], int]:
    """The least of the cheapest edits of a block, a string a row, and the state after them. D, K: the row goes or is
    kept; U, A: it becomes the user's or assistant's; u, a before these: such a turn is inserted."""
    found, out, own, i = layers(codes, goal), [], "", 0
    d = next(d for d, sets in enumerate(found) if sets[0] >> state & 1)
    leads = lambda cost, i, q: d >= cost and found[d - cost][i] >> q & 1
    while i < len(codes):
        role, allows = divmod(codes[i], 3)
        extra = TRUNCATED if allows == CUT_OFF else 0
        keeps, after = KEPT[INITIALS[role]] if role < 3 else ((), 0)
        turn = "a" if state == 2 else "u"
        if leads(DELETE, i + 1, state):
            letter, d = "D", d - DELETE
        elif leads(INSERT, i, NEXT[state]):
            own, d, state = own + turn, d - INSERT, NEXT[state]
            continue
        elif allows != GONE and state in keeps and leads(extra, i + 1, after):
            letter, d, state = "K", d - extra, after
        else:
            letter, d, state = turn.upper(), d - RENAME - extra, NEXT[state]
        out.append(own + letter)
        own, i = "", i + 1
    return out, state


def _blocks(codes: bytes) -> list[bytes]:
    return [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)]


def _goals(codes: bytes, goal: tuple[float, ...]) -> list[tuple[float, ...]]:
    """What the states before each block of a piece cost, and after the last."""
    found = [goal]
    for block in reversed(_blocks(codes)):
        found.append(starts(block, found[-1]))
    return found[::-1]


def repair_piece(codes: bytes, goal: tuple[float, ...], state: int, ends: bool) -> tuple[list[str], int, float]:
    """Edits of the rows of a piece, the state after it, and the cost from its first state to the conversation's end."""
    goals, edits, first = _goals(codes, goal), [], state
    for block, after in zip(_blocks(codes), goals[1:]):
        own, state = trace(block, after, state)
        edits += own
    if ends:
        edits[-1] += ("", "ua", "a", "")[state]
    return edits, state, goals[0][first]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, dict[str, list]]]:
    """(part, conversation, columns) of runs of rows of one part and conversation."""
    key, held = None, None
    for b in batches:
        rows = b.to_pydict()
        for i, own in enumerate(zip(rows["part"], rows["conv"])):
            if own != key:
                if held is not None:
                    yield *key, held
                key, held = own, {c: [] for c in rows}
            for c, values in rows.items():
                held[c].append(values[i])
    if held is not None:
        yield *key, held


def _crossings(conv: pa.DataType) -> Callable:
    """Of the first and the last piece of each part: what it costs from each state to each other, its last role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(part, name, held):
            codes = bytes(held["code"])
            ways = [_goals(codes, tuple(0.0 if p == q else math.inf for p in range(4)))[0] for q in range(4)]
            rows = {"conv": pa.array([name], conv), "part": pa.array([part], pa.int32()), "ways": pa.array([[w for way in ways for w in way]], pa.list_(pa.float64())), "last": pa.array([codes[-1] // 3], pa.int32())}
            return pa.RecordBatch.from_pydict(rows)

        part, last = None, None
        for piece in _pieces(batches):
            if piece[0] != part:
                if last is not None:
                    yield told(*last)
                part, last = piece[0], None
                yield told(*piece)
            else:
                last = piece
        if last is not None:
            yield told(*last)

    return run


def _rest(pieces: pa.Table) -> pa.Table:
    """What the rest of a conversation costs after each of its pieces, and the role before it."""
    pieces = pieces.sort_by("part")
    goals, goal = [], END
    for ways in reversed(pieces["ways"].to_pylist()):
        goals.append(list(goal))
        goal = tuple(min(ways[4 * q + p] + goal[q] for q in range(4)) for p in range(4))
    n = pieces.num_rows
    columns = [pieces["conv"], pieces["part"], pa.array(goals[::-1], pa.list_(pa.float64())), pa.array([i == n - 1 for i in range(n)]), pa.array([None, *pieces["last"].to_pylist()[:-1]], pa.int32())]
    return pa.Table.from_arrays(columns, ["conv", "part", "goal", "ends", "before"])


def _entries(exits: pa.Table) -> pa.Table:
    """The state in which each piece of a conversation begins."""
    exits = exits.sort_by("part")
    found = [0]
    for after in exits["exits"].to_pylist()[:-1]:
        found.append(after[found[-1] if len(after) > 1 else 0])
    return pa.Table.from_arrays([exits["conv"], exits["part"], pa.array(found, pa.int32())], ["conv", "part", "entry"])


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _edited(conv: pa.DataType) -> Callable:
    """Each row's edits, from each state that may be its piece's first: all four if the piece goes on with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, name, held in _pieces(batches):
            codes, before = bytes(held["code"]), held["before"][0]
            goal, ends = held["goal"][0], held["ends"][0] is not False
            ways = [repair_piece(codes, tuple(goal) if goal else END, q, ends) for q in (range(4) if before is not None else (0,))]
            roles, n = [c // 3 for c in codes], len(codes)
            illegal = [int(before is not None and (before, roles[0]) not in _LEGAL)] + [int(p not in _LEGAL) for p in zip(roles, roles[1:])]
            yield pa.RecordBatch.from_pydict(
                {
                    "conv": pa.array([name] * n, conv), "part": pa.array([part] * n, pa.int32()), "nth": pa.array(held["nth"], pa.int64()), "illegal": pa.array(illegal, pa.int64()),
                    "options": pa.array([list(x) for x in zip(*(w[0] for w in ways))], pa.list_(pa.string())), "cost": pa.array([int(ways[0][2]) if before is None else 0] + [0] * (n - 1), pa.int64()),
                    "exits": pa.array([None] * (n - 1) + [[w[1] for w in ways]], pa.list_(pa.int32())),
                }
            )

    return run


def faults(text: Column, first: Column) -> Column:
    """blank, duplicate, truncated or null: the first that holds. first: no such row stands before."""
    seen = F.rtrim(text, F.lit(WHITE))
    return F.when(seen == "", "blank").when(~first, "duplicate").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn: conv, turn, role, text, part and nth (its place: turns go by these in a conversation), fault,
    illegal (1 if its role may not follow the one before), edits (see `trace`), cost (of the whole conversation at its
    first row, 0 elsewhere).

    Conversations go by turn, null first, then by role and by the MD5 of the text, and repeated rows are interchangeable;
    a null conversation is one of its own, null roles and texts are empty; a role counts by its first letter; texts are
    read whole, however long; an empty table gives an empty one; other columns are not read.
    """
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("tie", F.md5("text")).withColumn("own", F.monotonically_increasing_id())
    rows = ordered_parts(own, [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "tie", "own")], "turns").drop("tie", "own")
    mark = F.sha2(F.to_json(F.struct(F.col("conv").cast("string").alias("c"), F.col("role"), F.col("text"))), 256)
    marked = rows.select("conv", "part", "nth", mark.alias("mark"), faults(F.col("text"), F.lit(True)).alias("fault"), F.left("role", F.lit(1)).alias("initial"))
    firsts = marked.groupBy("mark").agg(F.min(F.struct("part", "nth")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = F.coalesce(F.struct("part", "nth") == F.col("first"), F.lit(True))
    fault = F.when(F.col("fault").eqNullSafe("blank"), "blank").when(~first, "duplicate").otherwise(F.col("fault"))
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = 3 * role + F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT_OFF).otherwise(FINE)
    slim = salted(marked, firsts, "mark", "nth", "left").withColumn("fault", fault).select("conv", "part", "nth", "fault", code.cast("int").alias("code"))
    slim = written(slim, "turn-codes")
    kind, conv = turns.schema[conv_col].dataType.simpleString(), to_arrow_type(turns.schema[conv_col].dataType)
    in_order = lambda df: df.repartition("part").sortWithinPartitions("part", "nth")
    crossings = in_order(slim.select("conv", "part", "nth", "code")).mapInArrow(_crossings(conv), f"conv {kind}, part int, ways array<double>, last int")
    # Two rows a part at most, so these tables are as small as the list of tasks.
    rest = written(crossings.groupBy("conv").applyInArrow(_rest, f"conv {kind}, part int, goal array<double>, ends boolean, before int"), "turn-rest")
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"]) & (a["part"] == b["part"])
    told = slim.join(F.broadcast(rest), same(slim, rest), "left").select(slim["conv"], slim["part"], "nth", "code", "goal", "ends", "before")
    edited = written(in_order(told).mapInArrow(_edited(conv), f"conv {kind}, part int, nth long, illegal long, options array<string>, cost long, exits array<int>"), "turn-edits")
    exits = edited.where("exits is not null").select("conv", "part", "exits")
    crossing = exits.join(F.broadcast(rest.select("conv", "part")), same(exits, rest), "left_semi")
    entries = written(crossing.groupBy("conv").applyInArrow(_entries, f"conv {kind}, part int, entry int"), "turn-entries")
    chosen = edited.join(F.broadcast(entries), same(edited, entries), "left")
    edits = F.get("options", F.when(F.size("options") > 1, F.coalesce("entry", F.lit(0))).otherwise(0))
    chosen = chosen.select(edited["part"], "nth", "illegal", edits.alias("edits"), "cost")
    return rows.join(chosen, ["part", "nth"]).join(slim.select("part", "nth", "fault"), ["part", "nth"])


def repaired(edits: Column, role: Column, text: Column) -> Column:
    """The rows that a turn becomes, an array of (role, text): inserted ones first, then the turn itself unless it goes."""
    own = F.filter(F.split(edits, ""), lambda x: (x != "") & (x != "D"))
    name = lambda x: F.when(x == "K", role).when(F.upper(x) == "U", "user").otherwise("assistant")
    return F.transform(own, lambda x: F.struct(name(x).alias("role"), F.when(x.isin("u", "a"), "").otherwise(text).alias("text")))


def audit_letters(edits: Column) -> Column:
    """Edits by their initials: Delete, Insert, Keep, Rerole."""
    return F.translate(edits, "uaUA", "IIRR")


def _digests(conv: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told():
            return pa.RecordBatch.from_pydict({"conv": pa.array([key], conv), "audit": pa.array(["".join(letters)]), "repaired_sha256": pa.array([digest.hexdigest()])})

        begun = False
        for b in batches:
            rows = b.to_pydict()
            for name, own, lines in zip(rows["conv"], rows["audit"], rows["lines"]):
                if not begun or name != key:
                    if begun:
                        yield told()
                    begun, key, letters, digest, gap = True, name, [], hashlib.sha256(), b""
                letters.append(own)
                for line in lines:
                    digest.update(gap + line.encode("utf-8", "surrogatepass"))
                    gap = b"\n"
        if begun:
            yield told()

    return run


def digests(found: DataFrame) -> DataFrame:
    """Of each conversation: conv, audit, and the SHA-256 of its repaired rows as role:text, one a line. A hash of this
    kind goes through a conversation in order, so its rows stream through one task, which holds none but the audit."""
    conv = found.schema["conv"].dataType
    lines = F.transform(repaired(F.col("edits"), F.col("role"), F.col("text")), lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    rows = found.select("conv", "part", "nth", audit_letters(F.col("edits")).alias("audit"), lines.alias("lines"))
    streamed = rows.repartition("conv").sortWithinPartitions("conv", "part", "nth").select("conv", "audit", "lines")
    return streamed.mapInArrow(_digests(to_arrow_type(conv)), f"conv {conv.simpleString()}, audit string, repaired_sha256 string")
