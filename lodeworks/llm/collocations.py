"""Phrase collocations: phrases whose words occur together more often than their parts would.

Texts are cut into pieces at punctuation; identical pieces of a language become one with a multiplicity, so that
copies cost nothing further. Tasks count the n-grams of their pieces, weighted and already added up in blocks; partial
counts go, packed, to buckets by a hash of (language, phrase), and DuckDB adds up each bucket out of core: memory has a
limit, and what goes beyond it lies in the task's own spill folder, which ends with the task and which no one else reads.
Only phrases of `least` occurrences go further, since a candidate's parts occur at least as often as it does; so longer
phrases are counted only where both phrases with a word less are frequent, as a bitmap of fixed size tells. Each
candidate then asks for the counts of its parts: requests are dealt out by the part, meet its count there, and the
answers come back to the candidate. A hot part's requests are split by adaptive execution (skew join).
"""

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Characters of pieces whose n-grams are added up together in a task, and the memory in which DuckDB counts a bucket.
BLOCK_CHARS, BUCKET_MEMORY = 8 << 20, "256MB"
#: Phrases that are packed together, and rows of a batch of counts.
CHUNK, ROWS = 4096, 20_000
#: Bits of what is known of shorter phrases (16 MB), and those that Spark's bitmap aggregate puts in a row.
BITS, BUNDLE = 1 << 27, 1 << 15
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, piece, m) of texts: pieces in lower case, their words one space apart, as often as the batch has them."""
    for b in batches:
        text = pc.ascii_lower(pc.fill_null(b.column("text"), ""))
        parts = pc.split_pattern_regex(text, "[.,;:!?\n\x0b\x0c\r]")
        piece = pc.ascii_trim(pc.replace_substring_regex(parts.flatten(), "[ \t]+", " "), " ")
        found = pa.table({"lang": b.column("lang").take(pc.list_parent_indices(parts)), "piece": piece})
        found = found.filter(pc.not_equal(found["piece"], "")).group_by(["lang", "piece"]).aggregate([([], "count_all")])
        yield from found.rename_columns(["lang", "piece", "m"]).to_batches()


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its language and words before, and its last word's; the same in every task."""
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Block:
    """The words of a block of pieces as numbers: place by place their language, weight and the end of their piece."""

    def __init__(self, block: pa.Table):
        lists = pc.split_pattern(block["piece"].combine_chunks(), " ")
        sizes = np.asarray(lists.value_lengths())
        coded, langs = lists.flatten().dictionary_encode(), block["lang"].combine_chunks().dictionary_encode()
        self.words, self.langs = coded.dictionary, langs.dictionary
        self.codes = np.asarray(coded.indices).astype(np.int64)
        self.lang = np.repeat(np.asarray(langs.indices).astype(np.int64), sizes)
        self.m, self.ends = np.repeat(np.asarray(block["m"]), sizes), np.repeat(np.cumsum(sizes), sizes)
        self.by_word, self.by_lang = _word_hashes(self.words), _word_hashes(self.langs)

    def places(self, size: int) -> np.ndarray:
        """Where phrases of so many words begin."""
        at = np.arange(len(self.codes))
        return at[at + size <= self.ends]

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        h = self.by_lang[self.lang[at]]
        for k in range(size):
            h = _mixed(h, self.by_word[self.codes[at + k]])
        return h

    def counted(self, at: np.ndarray, size: int) -> tuple[pa.Table, np.ndarray]:
        """The different phrases that begin at these places, their weights added up, and their hashes."""
        key, width = self.lang[at], len(self.langs)
        for k in range(size):
            if width * len(self.words) >= 1 << 62:
                key, width = np.unique(key, return_inverse=True)[1], len(at)
            key, width = key * len(self.words) + self.codes[at + k], width * len(self.words)
        order = np.argsort(key)
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        total, one = np.add.reduceat(self.m[at[order]], starts), at[order[starts]]
        own = [self.words.take(pa.array(self.codes[one + k])) for k in range(size)]
        phrase = pc.binary_join_element_wise(*own, " ") if size > 1 else own[0] if size else pa.array([""] * len(one), pa.string())
        return pa.Table.from_arrays([self.langs.take(pa.array(self.lang[one])), phrase, pa.array(np.full(len(one), size, np.int32)), pa.array(total)], schema=_PHRASES), self.hashes(one, size)


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def block_phrases(block: pa.Table, sizes: tuple[int, ...], bits: np.ndarray | None) -> tuple[pa.Table, np.ndarray]:
    """Weighted counts of the phrases of these sizes of a block of pieces. The empty phrase of a language counts all
    its words. bits: what is known of the phrases with a word less; without both of those bits a phrase is too rare."""
    own, found = Block(block), []
    for size in sizes:
        at = own.places(max(size, 1))
        if bits is not None and len(at):
            known = np.zeros(len(own.codes) + 1, bool)
            shorter = own.places(size - 1)
            known[shorter] = has_bit(bits, own.hashes(shorter, size - 1))
            at = at[known[at] & known[at + 1]]
        if len(at):
            found.append(own.counted(at, size))
    return (pa.concat_tables([t for t, _ in found]), np.concatenate([h for _, h in found])) if found else (_PHRASES.empty_table(), np.zeros(0, np.uint64))


def packed(found: pa.Table, hashes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases by bucket, CHUNK of them at most in a compressed Arrow stream: a fraction of what rows would take."""
    if not len(hashes):
        return
    own = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    found, own = found.take(pa.array(order)).combine_chunks(), own[order]
    edges = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
    starts = [s for a, b in zip(edges, edges[1:]) for s in range(a, b, CHUNK)]
    blobs = []
    for a, b in zip(starts, [*starts[1:], len(own)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _PHRASES, options=_ZSTD) as out:
            out.write_table(found.slice(a, b - a))
        blobs.append(sink.getvalue().to_pybytes())
    yield from pa.Table.from_pydict({"bucket": pa.array(own[starts], pa.int64()), "phrases": pa.array(blobs, pa.binary())}).to_batches(100)


def phrases_of(sizes: tuple[int, ...], buckets: int, bits: Broadcast | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else np.frombuffer(bits.value, np.uint8)
        held, chars = [], 0
        for b in batches:
            held.append(b)
            chars += b.column("piece").nbytes
            if chars >= BLOCK_CHARS:
                yield from packed(*block_phrases(pa.Table.from_batches(held), sizes, known), buckets)
                held, chars = [], 0
        if any(b.num_rows for b in held):
            yield from packed(*block_phrases(pa.Table.from_batches(held), sizes, known), buckets)

    return run


def bucket_counts(least: int) -> Callable:
    """Adds up the partial counts of a task's buckets; phrases below `least` go, the empty one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = (own for b in batches for blob in b.column("phrases") for own in pa.ipc.open_stream(blob.as_buffer()))
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": spill}) as db:
            db.register("partial", pa.RecordBatchReader.from_batches(_PHRASES, partial))
            counted = db.sql(f"select lang, phrase, words, sum(f)::bigint as f from partial group by all having words = 0 or sum(f) >= {int(least)}")
            yield from counted.to_arrow_reader(ROWS)

    return run


def _bit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of phrases, all of one number of words."""
    for b in batches:
        if b.num_rows:
            langs, words = b.column("lang").dictionary_encode(), pc.split_pattern(b.column("phrase"), " ").flatten().dictionary_encode()
            h = _word_hashes(langs.dictionary)[np.asarray(langs.indices)]
            for word in _word_hashes(words.dictionary)[np.asarray(words.indices)].reshape(b.num_rows, -1).T:
                h = _mixed(h, word)
            yield pa.RecordBatch.from_pydict({"bit": pa.array((h % np.uint64(BITS)).astype(np.int64))})


def known_bits(phrases: DataFrame) -> Broadcast:
    """BITS bits, of which those are set that phrases have by their hashes: 16 MB, however many phrases there are. The
    more there are, the fewer it tells apart; a bit too many costs a count, no result."""
    bit = F.col("bit")
    found = phrases.select("lang", "phrase").mapInArrow(_bit_places, "bit long").select((bit / BUNDLE).cast("long").alias("bundle"), (bit % BUNDLE).alias("place"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in found.groupBy("bundle").agg(F.expr("bitmap_construct_agg(place)").alias("own")).collect():
        own = np.frombuffer(r.own, np.uint8)
        bits[r.bundle * BUNDLE // 8 :][: len(own)] = own
    return phrases.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame, max_words: int, least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, f) of the phrases that occur `least` times; the empty phrase has the number of words.

    Phrases of two words are counted at once, longer ones a size at a time, and only where both phrases with a word less
    may be frequent. There are as many buckets as shuffle partitions, which the session sets by the size of its data."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(split_pieces, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))
    pieces, found, bits = written(pieces, "pieces"), [], None
    for size in range(2, max_words + 1):
        if size > 2:
            bits = known_bits(found[-1].where(F.col("words") == size - 1))
        partial = pieces.mapInArrow(phrases_of((size,) if bits else (0, 1, 2), buckets, bits), "bucket long, phrases binary")
        counted = partial.repartition("bucket").mapInArrow(bucket_counts(least), "lang string, phrase string, words int, f long")
        found.append(written(counted, f"phrases-{size}"))
    return reduce(DataFrame.unionByName, found)


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The `top` phrases of two to max_words words of each language by score: lang, rank, phrase, a (its occurrences),
    cut (words of its first part), l and r (the parts' occurrences), n (words of the language), score = floor(10^6 *
    a * a / (l * r)) for the cut with the lowest score, the first of these. A phrase inside a longer candidate that
    has `share` percent of its occurrences is left out.

    A null language is `und`; null and empty texts have no words; repeated rows count each; texts are read whole,
    however long; ties of score go by a, then by the phrase's bytes; no documents or no candidates give no rows; other
    columns are not read. Figures are exact while a * a * 10^6 has no more than 38 digits.
    """
    known = phrase_counts(docs, max_words, least, lang_col, text_col)
    wanted = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    word = wanted.withColumn("w", F.split("phrase", " "))
    cuts = word.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("cut") + 1, F.col("words")).alias("part")))).alias("q"))
    counts = known.select("lang", F.col("phrase").alias("part"), "f")
    answers = asked.select("lang", "phrase", "a", "cut", "q.left", "q.part").join(counts, ["lang", "part"])
    by_cut = answers.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (_exact("a") * _exact("a")), _exact("l") * _exact("r")).cast("long")
    best = by_cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inside = word.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    longer = inside.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longest"))
    free = best.join(longer, ["lang", "phrase"], "left").where(f"longest is null or 100 * longest < {int(share)} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = known.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("b.cut").alias("cut"), F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
