"""Mixture-controlled packing: deficit round-robin over source queues, cut into windows of equal length.

Each source (or explicit mixture lane) is a queue of tokens. A round is one window's worth of tokens: every queue
earns its share of it as credit, sends its whole quanta of credit, and carries the rest of the credit as its
deficit. Credit is a fixed-point number, so what a queue has sent after w rounds is `floor(rate * w)`: any task
knows the deficits carried into any round, and places its own documents without seeing the others. So the work
is one pass over the texts (token ids, written once) and one over the ids; nothing but counts is shuffled.

Without weights, the target proportions are the sources' shares of all tokens, and all queues last to the end.
With weights, when a queue runs dry the others go on in their own proportions. What is left of a queue, less than
its next credit, is packed at the end. Sequences follow each other without gaps, so only the last one is short.

Any number of sources is served. The QUEUES - 1 largest have queues of their own. The others, each with less than a
quantum of a window if sources are more than that, share one queue, and within it a second round-robin: a run of at
most a window of a source's tokens, whose middle is the source's token x, is due at x / weight (x / tokens of the
source without weights), and runs stand in the order in which they are due. That is the same proportion carried
across windows; a source is ahead or behind by one run at most.

A null text is an empty one (its closing id alone), null ids and sources are kept, repeated rows are packed each.
Other columns of the input are not read. An empty table gives no pieces. Long texts are encoded one at a time.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import word_ids
from .common import ordered_parts, written

#: Queues, of which the last is shared where there are more sources.
QUEUES = 256
#: Bits after the point of a queue's credit for a round.
POINT = 20


def token_table(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: id, source, block (the task that read it), before (tokens of its source earlier in that
    block), n_tokens, ids (little-endian, the closing end_id included)."""
    kind, source_kind = (docs.schema[c].dataType.simpleString() for c in (id_col, source_col))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, sent = word_ids(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            before, n, ids = [], [], []
            for text, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = words.ids(text or "") + end
                size = len(raw) // words.dtype.itemsize
                before.append(sent.get(source, 0))
                n.append(size)
                ids.append(raw)
                sent[source] = sent.get(source, 0) + size
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([block] * len(n), pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["id", "source", "block", "before", "n_tokens", "ids"])

    return docs.select(id_col, text_col, source_col).mapInArrow(encode, f"id {kind}, source {source_kind}, block long, before long, n_tokens long, ids binary")


def shared_queue(rows: DataFrame, due: Column, window: int, bytes_each: int) -> DataFrame:
    """(id, g, start, length, n_tokens, ids): the runs of documents in the order in which they are due, with their
    places g in the queue. rows: id, source, g (within the source), n_tokens, ids; due: a number by the run's middle
    token, of columns of rows and `middle`."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(window).cast("long"))
    cut = rows.select("*", F.explode(starts).alias("start"))
    cut = cut.withColumn("length", F.least(F.lit(window).cast("long"), F.col("n_tokens") - F.col("start")))
    cut = cut.withColumn("middle", F.col("g") + F.col("start") + F.col("length") / 2).withColumn("due", due)
    own = F.substring("ids", (F.col("start") * bytes_each + 1).cast("int"), (F.col("length") * bytes_each).cast("int"))
    runs = cut.select("id", "source", "g", "start", "length", "n_tokens", "due", own.alias("ids"))
    placed = ordered_parts(runs, [F.asc("due"), F.asc("source"), F.asc("g"), F.asc("start")], "packing-runs")
    sums = placed.groupBy("part").agg(F.sum("length").alias("n"))
    ahead = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row a part
    inside = F.sum("length").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.withColumn("inside", inside).join(ahead, "part").select("id", (F.col("ahead") + F.col("inside")).alias("g"), "start", "length", "n_tokens", "ids")


def rounds(totals: list[int], weights: list[float] | None, window: int, quantum: int) -> list[dict]:
    """The phases of the round-robin, each with its number of rounds, the queues' rates (quanta a round, fixed
    point), and what the queues had sent before. The last phase has no rounds: there the queues' rests follow."""
    left, each = [t // quantum for t in totals], window // quantum
    sent, at, phases = [0] * len(totals), 0, []
    while any(left):
        if weights:
            live = [w if q else 0 for w, q in zip(weights, left, strict=True)]
            if not sum(live):
                break
            rate = [int((each << POINT) * w / sum(live)) for w in live]
            n = min((q << POINT) // r for q, r in zip(left, rate, strict=True) if r)
        else:
            n = -(-sum(left) // each)
            rate = [(q << POINT) // n for q in left]
        if n:
            phases.append({"rounds": n, "rate": rate, "sent": sent, "at": at * quantum})
        done = [r * n >> POINT for r in rate]
        at += sum(done)
        sent = [a + b for a, b in zip(sent, done, strict=True)]
        left = [a - b if not weights or (r and a - b >= r >> POINT and b) else 0 for a, b, r in zip(left, done, rate, strict=True)]
        if not weights:
            break
    return [*phases, {"rounds": 0, "rate": [], "sent": sent, "at": at * quantum}]


#: Rounds that are worked out at a time, each with a number for every queue.
ROUNDS = 2048


def sending(lo: int, hi: int, rate: int) -> Iterator[np.ndarray]:
    """The rounds in which a queue sends its quanta lo to hi, in order. A queue of a small share sends in few of the
    rounds that pass meanwhile, so there are never more than the quanta."""
    first, final = ((((u + 1) << POINT) - 1) // rate for u in (lo, hi))
    if final - first <= hi - lo:
        yield from (np.arange(s, min(s + ROUNDS, final + 1), dtype=np.int64) for s in range(first, final + 1, ROUNDS))
    else:  # less than a quantum a round, so each has a round of its own
        for s in range(lo, hi + 1, ROUNDS):
            u = np.arange(s, min(s + ROUNDS, hi + 1), dtype=np.int64)
            yield (((u + 1) << POINT) - 1) // rate


def places(q: int, lo: int, hi: int, phases: list[dict], totals: list[int], quantum: int) -> Iterator[tuple[int, int, int]]:
    """(token in the queue, place in the packed stream, length) of the runs that tokens lo to hi of queue q make."""
    for phase, after in zip(phases, [*phases[1:], None], strict=True):
        start = phase["sent"][q] * quantum
        stop = totals[q] if after is None else after["sent"][q] * quantum
        a, b = max(lo, start), min(hi, stop)
        if a >= b:
            continue
        if after is None:
            yield a, phase["at"] + sum(t - s * quantum for t, s in zip(totals[:q], phase["sent"][:q], strict=True)) + a - start, b - a
            continue
        rate = np.array(phase["rate"], np.int64)
        for w in sending((a - start) // quantum, (b - 1 - start) // quantum, int(rate[q])):
            # What each queue has sent before and after these rounds; where they follow each other, after is before the next.
            if w[-1] - w[0] == len(w) - 1:
                sent = np.multiply.outer(np.append(w, w[-1] + 1), rate) >> POINT
                before, upto = sent[:-1], sent[1:]
            else:
                before, upto = np.multiply.outer(w, rate) >> POINT, np.multiply.outer(w + 1, rate) >> POINT
            ahead = upto[:, :q].sum(1) + before[:, q:].sum(1)
            begins, ends = start + before[:, q] * quantum, start + upto[:, q] * quantum
            lows, highs = np.maximum(begins, a), np.minimum(ends, b)
            for x, y, z, g in zip(lows.tolist(), highs.tolist(), begins.tolist(), ahead.tolist(), strict=True):
                if y > x:
                    yield x, phase["at"] + g * quantum + x - z, y - x


def pack(docs: DataFrame, path: str, window: int = 2048, quantum: int = 8, weights: dict | None = None, queues: int = QUEUES, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a piece: id, start, length, doc_tokens, queue, sequence_id, offset, ids (binary, little-endian
    unsigned 32-bit). `sequences` puts the pieces together.

    quantum: tokens that a queue sends at least, but at its end; a window's share of a source is met within it.
    weights: source -> weight; sources that it lacks follow when the others have run dry. queues: QUEUES.
    """
    spark = docs.sparkSession
    tokens = written(token_table(docs, path, end_id, id_col, text_col, source_col), "packing-ids")
    sums = written(tokens.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")), "packing-sums")
    totals_of = sums.groupBy("source").agg(F.sum("n").alias("total"))
    kind, bytes_each = tokens.schema["source"].dataType.simpleString(), word_ids(path).dtype.itemsize
    given = spark.createDataFrame([(k, float(v)) for k, v in (weights or {}).items()], f"named {kind}, weight double")
    weighed = totals_of.join(given, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "total", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    known = written(weighed, "packing-sources")
    first = known.orderBy((F.col("weight") > 0).desc(), F.desc("total"), F.col("source").asc_nulls_last()).limit(queues + 1).collect()
    if len(first) > queues:
        del first[queues - 1 :]
    everything, all_weight = known.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    totals, own = [r.total for r in first], [r.weight for r in first]
    rest = everything - sum(totals)
    if rest:
        totals, own = [*totals, rest], [*own, max(0.0, all_weight - sum(own))]
    phases = rounds(totals, own if weights is not None else None, window, quantum)
    # At most `queues` rows; sources beyond them have no row, and so the shared queue.
    numbered = F.broadcast(spark.createDataFrame([(r.source, i) for i, r in enumerate(first)], f"named {kind}, queue int"))
    offsets = sums.select("source", "block", (F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")).alias("ahead"))
    at = offsets.select(F.col("source").alias("of"), F.col("block").alias("by"), "ahead")
    placed = tokens.join(at, (F.col("block") == F.col("by")) & F.col("source").eqNullSafe(F.col("of"))).join(numbered, F.col("source").eqNullSafe(F.col("named")), "left")
    placed = placed.select("id", "source", "queue", (F.col("before") + F.col("ahead")).alias("g"), "n_tokens", "ids")
    runs = placed.where("queue is not null").select("id", "queue", "g", F.lit(0).cast("long").alias("start"), F.col("n_tokens").alias("length"), "n_tokens", "ids")
    if rest:
        mine = placed.where("queue is null").join(known.withColumnsRenamed({"source": "of"}), F.col("source").eqNullSafe(F.col("of")))
        # Sources without a weight, where others have one, are due after these.
        due = F.col("middle") / F.col("total")
        if weights is not None:
            due = F.when(F.col("weight") > 0, F.col("middle") / F.col("weight")).otherwise(F.lit(1e300) * (1 + due))
        late = shared_queue(mine, due, window, bytes_each)
        runs = runs.unionByName(late.withColumn("queue", F.lit(len(totals) - 1)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_ids(path).dtype
        for batch in batches:
            rows: list[tuple] = []
            for doc, q, g, begin, n, whole, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                ids = np.frombuffer(raw, dtype).astype("<u4").tobytes()
                for token, place, length in places(q, g, g + n, phases, totals, quantum):
                    while length > 0:
                        sequence, offset = divmod(place, window)
                        size = min(length, window - offset)
                        at = token - g
                        rows.append((doc, begin + at, size, whole, q, sequence, offset, ids[4 * at : 4 * (at + size)]))
                        token, place, length = token + size, place + size, length - size
            out = zip(*rows, strict=True) if rows else ((),) * 8
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (batch.schema.field(0).type, *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 2, pa.binary()), strict=True)], NAMES)

    NAMES = [id_col, "start", "length", "doc_tokens", "queue", "sequence_id", "offset", "ids"]
    id_kind = tokens.schema["id"].dataType.simpleString()
    return runs.mapInArrow(cut, f"`{id_col}` {id_kind}, start long, length long, doc_tokens long, queue int, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a sequence: sequence_id, n_tokens, pieces (in order). A sequence has at most `window` pieces."""
    own = F.struct("offset", "length", F.col(id_col), "start", "ids")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(own)).alias("pieces"))
