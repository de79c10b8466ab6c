"""A search index that is kept fresh: postings and vectors of chunks as Parquet, in generations.

A refresh compares the fingerprints of the chunks with those that the index holds, and writes a new generation: the
postings and vectors of new and changed chunks, and marks for changed and vanished ones. Nothing else is written, and
of the index only ids and fingerprints are read. What is live is the latest generation of each id; `postings` and
`vectors` give that. A generation counts once its manifest is there, which is written last, so a refresh that fails
leaves no trace; `compacted` puts the live rows of all generations into one. One refresh of a path runs at a time.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_fingerprint, token_set
from .shared import if_small

#: Version of the layout; an index of another one is built anew.
LAYOUT = 1
_LIVE, _GONE = "live", "gone"


def _fs(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """The generations that count, in order; nothing for an index that is not there or of another layout. There is one
    small file a generation."""
    fs, folder = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    rows = [json.loads(r.value) for r in spark.read.text(f"{path}/manifests").collect()]
    found = sorted((r for r in rows if r["layout"] == LAYOUT), key=lambda r: r["generation"])
    # A compacted generation stands for all before it.
    last = max((i for i, r in enumerate(found) if r["whole"]), default=0)
    return found[last:]


def _read(spark: SparkSession, path: str, part: str, known: list[dict]) -> DataFrame:
    """A part of all generations, with the generation of each row."""
    out = None
    for r in known:
        own = spark.read.parquet(f"{path}/{part}/generation-{r['generation']}").withColumn("generation", F.lit(r["generation"]))
        out = own if out is None else out.unionByName(own)
    return out


def _latest(entries: DataFrame) -> DataFrame:
    """(id, generation, fingerprint) of what is live: the last word on each id."""
    last = entries.groupBy("id").agg(F.max(F.struct("generation", "state", "fingerprint")).alias("e"))
    return last.where(F.col("e.state") == _LIVE).select("id", "e.generation", "e.fingerprint")


def live(spark: SparkSession, path: str) -> DataFrame:
    """(id, generation, fingerprint) of the chunks in the index."""
    known = manifests(spark, path)
    if not known:
        raise FileNotFoundError(f"no index at {path}")
    return _latest(_read(spark, path, "entries", known))


def _live_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    known = manifests(spark, path)
    if not known:
        raise FileNotFoundError(f"no index at {path}")
    rows = _read(spark, path, part, known)
    if len(known) == 1:
        return rows.drop("generation")
    # What later generations say of an id replaces its rows. Few ids have more than one entry, so few are to be left out.
    entries = _read(spark, path, "entries", known).groupBy("id").agg(F.max(F.struct("generation", "state")).alias("e"), F.count("*").alias("n"))
    last = entries.where((F.col("n") > 1) | (F.col("e.state") == _GONE)).select("id", F.when(F.col("e.state") == _LIVE, F.col("e.generation")).otherwise(-1).alias("_last"))
    own = rows.join(if_small(last), "id", "left")
    return own.where(F.col("_last").isNull() | (F.col("_last") == F.col("generation"))).drop("generation", "_last")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of the chunks in the index."""
    return _live_part(spark, path, "postings").select("token", "id")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of the chunks in the index that have one."""
    return _live_part(spark, path, "vectors").select("id", "vector")


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(token, df, idf): how many chunks have a token, and its weight."""
    n = live(spark, path).count()
    own = postings(spark, path).groupBy("token").agg(F.count("*").alias("df"))
    return own.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def _write(spark: SparkSession, path: str, generation: int, whole: bool, entries: DataFrame, chunks: DataFrame | None, posted: DataFrame | None = None, placed: DataFrame | None = None) -> None:
    if chunks is not None:
        posted = chunks.select(F.explode(token_set(F.col("text"))).alias("token"), "id")
        placed = chunks.where("vector is not null").select("id", "vector")
    for part, df in (("entries", entries), ("postings", posted), ("vectors", placed)):
        df.write.mode("overwrite").parquet(f"{path}/{part}/generation-{generation}")
    fs, target = _fs(spark, f"{path}/manifests/generation-{generation}.json")
    out = fs.create(target, True)
    out.write(bytearray((json.dumps({"layout": LAYOUT, "generation": generation, "whole": whole}) + "\n").encode()))
    out.close()


def refresh(spark: SparkSession, path: str, chunks: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Brings the index at a path to what chunks (id, text, vector, and columns whose change counts, too) say, and tells
    (state, chunks): how many were added, changed, gone, same. Of rows that share an id the one with the smallest
    fingerprint counts; null ids are left out; null texts have no tokens. Where nothing differs, nothing is written. Chunks are read
    several times: hand over a table, not a join."""
    # A chunk's fingerprint is of its text, its vector and the columns named.
    marks = json_fingerprint(F.col("text"), F.col("vector"), *map(F.col, columns))
    given = chunks.where("id is not null").select("id", "text", "vector", marks.alias("fingerprint"))
    one = given.groupBy("id").agg(F.min("fingerprint").alias("fingerprint"), F.count("*").alias("rows"))
    known = manifests(spark, path)
    # The numbers of generations only grow, those of failed refreshes and of other layouts, too, are taken again or passed.
    number = max((r["generation"] for r in known), default=0) + 1
    if known:
        old = live(spark, path).select("id", F.col("fingerprint").alias("had"))
        both = one.join(old, "id", "full_outer")
    else:
        both = one.withColumn("had", F.lit(None).cast("string"))
    state = F.when(F.col("had").isNull(), "added").when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint") != F.col("had"), "changed").otherwise("same")
    compared = both.select("id", "fingerprint", "rows", state.alias("state"))
    entries = f"{path}/comparisons/generation-{number}"
    compared.write.mode("overwrite").parquet(entries)
    compared = spark.read.schema(compared.schema).parquet(entries)
    differing = compared.where("state <> 'same'")
    if not known or not differing.isEmpty():
        wanted = differing.where("state <> 'gone'").select("id", "fingerprint")
        if not known and compared.agg(F.coalesce(F.sum("rows"), F.lit(0)) == F.count("*")).first()[0]:
            new = given  # all of it, and no id twice
        else:
            new = given.join(if_small(wanted), ["id", "fingerprint"], "left_semi").dropDuplicates(["id"])
        own = differing.select("id", F.when(F.col("state") == "gone", _GONE).otherwise(_LIVE).alias("state"), "fingerprint")
        _write(spark, path, number, not known, own, new)
    return compared.groupBy("state").agg(F.count("*").alias("chunks"))


def compacted(spark: SparkSession, path: str) -> None:
    """One generation of all that is live, in the place of those before. Their files stay for readers that have begun;
    `vacuum` deletes them."""
    known = manifests(spark, path)
    if len(known) > 1:
        now = live(spark, path).select("id", F.lit(_LIVE).alias("state"), "fingerprint")
        _write(spark, path, known[-1]["generation"] + 1, True, now, None, postings(spark, path), vectors(spark, path))


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes generations that a compacted one stands for, and what refreshes compared."""
    known = {r["generation"] for r in manifests(spark, path)}
    fs, _ = _fs(spark, path)
    for part in ("manifests", "entries", "postings", "vectors", "comparisons"):
        _, folder = _fs(spark, f"{path}/{part}")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            number = f.getPath().getName().removeprefix("generation-").removesuffix(".json")
            if part == "comparisons" or (number.isdigit() and int(number) < min(known, default=0)):
                fs.delete(f.getPath(), True)
