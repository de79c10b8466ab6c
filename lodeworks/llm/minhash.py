"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two values of a signature, its minimum and its maximum, so that a signature
of 128 values costs 64 hashes a shingle. 32 bands of two permutations, four values, name a document's buckets:
documents of more than SHORT shingles with a similarity of 0.75 share one with a probability above 0.9999. In shorter
ones minimum and maximum depend on each other, and more pairs would be lost; there, the smallest shingles by hash,
one more than a pair of that similarity may lack, are buckets too, of which such a pair always shares one.

Equal word sequences count once. In each bucket, all documents are held against the smallest, on their full
shingle sets; links make components. Where a bucket then still spans several components, further turns follow: its
documents are held against the one that shares most shingles with other components, and at last all but its largest
component's documents against those of other components. So no candidate
pair stays undecided unless it is already in one component. What can't be linked drops out before pairs are made,
by an exact bound: two documents have no more in common than the lesser of them shares with other components at
all. In these turns the sets are compared inside the join, so that it gives links, not candidates. Pairs that a 128-bit sketch of the signatures shows to be far apart (less than one in a million of those with
a similarity of 0.75) are left out inside the join, too. So a large family of loose variants, of which many are
close to a few and to none else, makes as many pairs as it has members for each turn, not their square.

No key is one task's burden: the rows of a bucket, a shingle, a component, and the pairs of one document are dealt
out by hash, with the row that they meet copied to each.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, ordered_parts, salted, written
from .components import components

WORDS = 5
PERMUTATIONS = 64
BANDS = 32
#: Shingles up to which a document's pairs are found by its smallest shingles, too.
SHORT = 16
#: Differing bits of two sketches at most; with a similarity of 0.75, 16 of 128 are expected.
FAR = 35
#: Turns in which a bucket's documents are held against one of them, after the first.
TURNS = 1
#: Pairs of one document that one copy of its text serves.
PAIRS = 500
#: Ids up to which a filter is broadcast (some MB); beyond that it is a shuffled semi-join.
BROADCAST_ROWS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(WORDS, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _MIX + w[k : len(w) - size + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


@lru_cache(1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    own = np.random.default_rng(20240501)
    return own.integers(1, 2**63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), own.integers(0, 2**63, (PERMUTATIONS, 1), dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, 2 * PERMUTATIONS values, those of a permutation side by side."""
    a, b = _hashes()
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 2048):
        h = a * s[at : at + 2048] + b
        h ^= h >> np.uint64(32)
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def bands_of(sig: np.ndarray) -> np.ndarray:
    v = sig.reshape(BANDS, -1)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(v.shape[1]):
        out = (out ^ v[:, k]) * _MIX
        out ^= out >> np.uint64(30)
    return out.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two longs with one bit of each value."""
    bits = (sig >> np.uint64(40)) & np.uint64(1)
    return (bits.reshape(2, 64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def short_buckets(s: np.ndarray, least: int) -> list[int]:
    """Of a small set, the smallest hashes, of which a set with that similarity has one as its own smallest, too."""
    if not 0 < len(s) <= SHORT * 100 // least:
        return []
    return (s[: len(s) - -(-len(s) * least // 100) + 1] ^ _MIX).view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str, least: int = 75) -> DataFrame:
    """id, text_hash, n_shingles, key (of the word sequence; null without words), s0, s1, bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, s0, s1, bands = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                tokens = word_list(text)
                s = shingles(tokens)
                sig = signature(s)
                x, y = sketch(sig).tolist()
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(b" ".join(tokens)) if tokens else None)
                s0.append(x)
                s1.append(y)
                bands.append(bands_of(sig).tolist() + short_buckets(s, least) if tokens else [])
            arrays = [pa.array(v, t) for v, t in zip((n, key, s0, s1, bands), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["id", "text_hash", "n_shingles", "key", "s0", "s1", "bands"])

    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return own.mapInArrow(sign, f"id {kind}, text_hash long, n_shingles long, key binary, s0 long, s1 long, bands array<long>")


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame, unique: bool, id_col: str, text_col: str) -> DataFrame:
    """(rep, text) of the wanted reps, one row each. unique: ids are."""
    leads = wanted.join(reps.select("rep", "lead"), "rep").select("rep", F.col("lead.id").alias("lead_id"), F.col("lead.text_hash").alias("lead_hash"))
    leads = written(leads, "minhash-wanted")
    small = F.broadcast(leads) if leads.count() <= BROADCAST_ROWS else leads
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if unique:
        return written(own.join(small, F.col("id") == F.col("lead_id")).select("rep", "text"), "minhash-texts")
    # Repeated or null ids: the row of that very text, and one of those that repeat it.
    own = own.withColumn("text_hash", F.xxhash64("text"))
    found = own.join(small, F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("text_hash") == F.col("lead_hash")))
    return written(found.select("rep", "text").dropDuplicates(["rep"]), "minhash-texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: rep, text."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(128)(lambda text: shingles(word_list(text)))
        for batch in batches:
            fits = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = sets(x), sets(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                fits.append(len(p) > 0 and 100 * both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

    # A document with many pairs: as many copies of its text as it has PAIRS of them, to which they are dealt out.
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("copies"))
    dealt = salted(pairs, copies, "a", "b").withColumn("copy", F.pmod(F.xxhash64("b"), "copies").cast("int")).select("a", "b", "copy")
    given = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")).join(copies, "a").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    both = dealt.join(given, ["a", "copy"]).join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(confirm, "a long, b long").distinct(), "minhash-links")


def _bridging(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, shared, own): those of a document's shingles that other components have, too, and their number.
    labels: rep, label."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(word_list(t)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "s"])

    each = texts.mapInArrow(cut, "rep long, s array<long>").join(labels, "rep").select("rep", "label", F.explode("s").alias("shingle"))
    wide = each.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle")
    return written(salted(each, wide, "shingle", "rep").groupBy("rep").agg(F.count("*").alias("shared"), F.collect_set("shingle").alias("own")), "minhash-shared")


def near_duplicates(docs: DataFrame, least: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept (whether it is its component's smallest id), text_hash
    (xxhash64 of the text), leads.

    least: the similarity in hundredths from which documents are linked. leads: of each component the rows of one id
    and text do, those of the smallest id (null last), ties by hash; one of them stands for the component.

    Rows are documents: those that share an id but not a text are told apart by text_hash and linked by their texts
    alone; repeated rows are copies of each other. A null id gets the smallest id of its component, null if there is
    none. Documents without words (null, empty or blank texts) are their own component, and each leads it. Texts are
    read whole, one at a time. Other columns of the input are not read; an empty table gives an empty one.
    """
    signed = written(signatures(docs, id_col, text_col, least), "minhash-signed")
    unique = signed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty()
    lead = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    classes = signed.where("key is not null").groupBy("key", "n_shingles", "s0", "s1", "bands").agg(F.min(lead).alias("lead"))
    # Numbered in the order of their leads, so that a component's smallest number is that of its smallest id.
    reps = ordered_parts(classes, [F.asc("lead"), F.asc("key")], "minhash-reps").withColumn("rep", F.shiftleft(F.col("part").cast("long"), 33) + F.col("nth"))
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = written(salted(rows, hubs, "bucket", "rep").select("bucket", "rep", "hub", "n"), "minhash-members")
    texts = _texts(docs, reps, members.select("rep").distinct(), unique, id_col, text_col)
    known = reps.select("rep", F.col("n_shingles").alias("size"), "s0", "s1")
    side = lambda df, k, keep=(): df.select(*keep, *(F.col(c).alias(k if c == "rep" else f"{c}_{k}") for c in df.columns if c not in keep))
    near = f"(100 * size_a >= {least} * size_b and 100 * size_b >= {least} * size_a and bit_count(s0_a ^ s0_b) + bit_count(s1_a ^ s1_b) <= {FAR})"
    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(salted(stars.join(side(known, "b"), "b"), side(known, "a"), "a", "b").where(near).select("a", "b"), texts, least)
    found = components(links)

    shared = None
    for turn in range(TURNS + 1):
        bounds = lambda df: df.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("size").alias("least_n")).where("lo <> hi").select("bucket", "least_n")
        spread = lambda df: salted(df, bounds(df), "bucket", "rep")  # noqa: E731, B023
        marked = members.where("n > 2").join(found, members.rep == found.node, "left").select("bucket", "rep", F.coalesce("component", "rep").alias("label")).join(known, "rep")
        if shared is None:
            open_rows = written(spread(marked), "minhash-open")
            if open_rows.isEmpty():
                break
            shared = _bridging(open_rows.select("rep", "label").distinct(), texts)
        # Documents that share too few shingles with other components can't be linked to one of the bucket's sizes.
        kept = spread(marked.join(shared.drop("own"), "rep")).where(f"{100 + least} * shared >= {least} * (size + greatest(ceil({least} * size / 100), least_n))").drop("least_n")
        kept = written(spread(kept).drop("least_n"), "minhash-open")
        if kept.isEmpty():
            break
        at_a, at_b = (side(kept, k, ("bucket",)) for k in "ab")
        with_own = lambda df, k: df.join(shared.select(F.col("rep").alias(k), F.col("own").alias(f"own_{k}")), k)
        if turn < TURNS:  # the document that shares most
            at_a = at_a.join(kept.groupBy("bucket").agg(F.max(F.struct("shared", "rep"))["rep"].alias("a")), ["bucket", "a"])
            once = F.lit(True)
        else:
            sizes = kept.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max(F.struct("count", "label"))["label"].alias("most"))
            at_a = salted(at_a, sizes, "bucket", "a").where("label_a <> most")
            once = F.expr("label_b = most or a < b")
        overlap = f"{100 + least} * least(shared_a, shared_b) >= {least} * (size_a + size_b)"
        linked = f"{100 + least} * size(array_intersect(own_a, own_b)) >= {least} * (size_a + size_b)"  # cheap tests first
        # Both sides of a bucket in pieces: b's are dealt out, a's are copied to each.
        at_a = with_own(at_a, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        at_b = with_own(at_b, "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        pairs = at_a.join(at_b, (at_a["bucket"] == at_b["bucket"]) & (at_a["salt"] == at_b["salt"]) & once & F.expr(f"label_a <> label_b and {overlap} and {near} and {linked}"))
        more = written(pairs.select("a", "b").distinct(), "minhash-links")
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)
    first = found.select(F.col("component").alias("rep")).distinct().join(reps.select("rep", "lead"), "rep").withColumnsRenamed({"rep": "component", "lead": "led"})
    joined = salted(found, written(first, "minhash-first"), "component", "node").select("node", "led")
    named = reps.join(joined, reps.rep == joined.node, "left").select("key", F.coalesce("led", "lead").alias("led"))
    out = salted(signed.where("key is not null").select("id", "text_hash", "n_shingles", "key"), named, "key", "id")
    out = out.unionByName(signed.where("key is null").select("id", "text_hash", "n_shingles", "key"), True)
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("led.id"))
    leads = F.when(F.col("key").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("led.id")) & (F.col("text_hash") == F.col("led.text_hash")))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash", leads.alias("leads"))
