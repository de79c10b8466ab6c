"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; whoever runs them writes each
stage's rows and reads them again. A stage begins by deleting the intermediate tables of the stages before it in the
same run, since their rows have been written then; no other tables are touched. A run is what a thread does over an
sf_dir from one first stage to its next. Counted as part of `lodeworks.llm`.

In every stage null texts count as empty, null ids, languages and sources are values of their own, repeated rows are
documents each until near_dedup makes them one, texts are read whole, columns besides those of DOCUMENT are not read
(so they can't clash), and an empty table gives an empty one.
"""

from collections.abc import Callable
from functools import wraps
from threading import get_ident

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import delete, scratch, table, until_exit, written
from lodeworks.llm.minhash import near_duplicates
from lodeworks.llm.mixing import mix, mixed_rows
from lodeworks.llm.packing import pack
from lodeworks.llm.quality import judge
from lodeworks.llm.secrets import redacted, scan_secrets

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: (thread, sf_dir) -> (stage, its intermediate tables) of the stages of the present run that have begun.
_TABLES: dict[tuple[int, str], list[tuple[int, list[str]]]] = {}


def _stage(place: int):
    """A stage at a place in the order: what it makes on the way is deleted when a later one begins."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            begun = _TABLES.setdefault((get_ident(), sf_dir), [])
            if place == 0:
                # Another run's tables may still be read; they go when the program ends.
                until_exit(x for _, paths in begun for x in paths)
                begun.clear()
            for before, paths in begun:
                if before < place:
                    delete(spark, paths)
            begun[:] = [x for x in begun if x[1]]
            with scratch() as paths:
                out = f(spark, docs, sf_dir)
            begun.append((place, paths))
            return out

        return run

    return wrap


def _back(*others: str) -> list:
    """The columns of documents from those that an operator carried, but for `others`."""
    return [F.col(f"carried_{c}").alias(c) for c in DOCUMENT if c not in others]


def _same(own: DataFrame, other: DataFrame, names: tuple[str, ...]):
    """The rows of both that agree in these columns, nulls too."""
    on = F.lit(True)
    for c in names:
        on = on & own[c].eqNullSafe(other[f"_{c}"])
    return on


@_stage(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null language is a stratum of its own. Rows are found again by id, text
    and language, which the verdict depends on, so that no text is held beside its counts."""
    own = docs.select(*DOCUMENT, F.xxhash64("text").alias("text_hash"))
    kept = judge(own, table(spark, sf_dir, "labels"), carry=("text_hash", "lang")).where("kept")
    kept = kept.select(F.col("doc_id").alias("_doc_id"), F.col("carried_text_hash").alias("_text_hash"), F.col("carried_lang").alias("_lang"))
    return own.join(kept, _same(own, kept, ("doc_id", "text_hash", "lang")), "left_semi").select(*DOCUMENT)


@_stage(1)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: the one with the smallest id (null last), of several texts
    with that id the one of the smallest hash, and of rows that repeat it one. Rows that share an id but not a text
    are different documents. Documents without words are like no other, but rows that repeat an id and a text are one."""
    leads = near_duplicates(docs).where("leads").select(F.col("doc_id").alias("lead_id"), "text_hash").distinct()
    own = docs.select(*DOCUMENT, F.xxhash64("text").alias("text_hash"))
    found = own.join(leads, own["doc_id"].eqNullSafe(leads["lead_id"]) & (own["text_hash"] == leads["text_hash"]), "left_semi")
    # An aggregate, which combines repeated rows before it deals them out.
    one = found.groupBy("doc_id", "text_hash").agg(F.min(F.struct("lang", "source", "n_chars")).alias("o"), F.min("text").alias("text"))
    return one.select("doc_id", "text", "o.lang", "o.source", "o.n_chars").select(*DOCUMENT)


@_stage(2)
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark."""
    found = scan_secrets(docs, carry=DOCUMENT)
    spans = F.array_sort(F.concat("base", "extra"))
    masked = found.select("*", redacted(F.col("carried_text"), spans).alias("text"))
    return masked.select(*_back("text", "n_chars"), "text", F.length("text").cast("long").alias("n_chars")).select(*DOCUMENT)


@_stage(3)
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source draws them, in the order of the mix."""
    rows = mixed_rows(mix(docs, carry=DOCUMENT), DOCUMENT)
    return rows.withColumn("n_chars", F.length("text").cast("long"))


@_stage(4)
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's rows go when the next one's have been written, those that the last
    stage reads when the program ends."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with scratch() as own:
                docs = written(docs, f"pipeline-{name}")
            delete(spark, before)
            before = own
    until_exit(before)
    return docs
