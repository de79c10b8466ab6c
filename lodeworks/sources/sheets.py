"""Sheets as CSV files in folders: cells with their places, headers found in the data, rows, notes, questions, answers.

A folder is read once, whatever its files' columns are: a row is an array of cells, and what its header says is a table
of its own, one row a file. So files with different headers, or with lines above them, go through one job.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cell, plain_id, squeeze
from ..operators.shared import shared_table

#: Header names by what they stand for, in lower case.
QUESTION = ("question", "questions", "query", "prompt", "sample query")
QUESTION_ID = ("q_id", "id", "question id", "question_id", "#")
EXPECTED = ("expected_answer", "expected answer", "golden answer", "golden_answer", "answer", "reference answer", "reference_answer")
KEY_FACTS = ("key_facts", "key facts", "facts")
ANSWER = ("golden_answer", "golden answer", "reference_answer", "reference answer", "reference", "answer", "golden_summary", "golden summary")
#: Rows of a file among which its header is looked for, and letters that a question has at least.
HEADER_ROWS, LETTERS = 10, 5


def _text(c: Column) -> Column:
    """A cell's text: white space squeezed, whole numbers without a fraction."""
    return F.when(c.rlike(r"^\s*-?\d+\.0+\s*$"), cell(c.try_cast("double"))).otherwise(squeeze(c))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, cells): the rows of CSV files in their order within a file; place only orders them. Empty lines are
    no rows. Values may be quoted, but not hold line ends: then a file can be read in parts."""
    lines = spark.read.text(path)
    # No row has more cells than separators and one: a bound that needs no parsing.
    width = (lines.agg(F.max(F.regexp_count("value", F.lit(",")))).first()[0] or 0) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.schema(schema).option("escape", '"').csv(path)
    where = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return rows.select(F.col("_metadata.file_path").alias("file"), where.alias("place"), F.array(*(_text(F.col(f"c{i}")) for i in range(width))).alias("cells"))


def filled(rows: DataFrame) -> DataFrame:
    """Rows of `cells` that have a cell which isn't empty."""
    return rows.where(F.exists("cells", lambda c: c != ""))


def headed(rows: DataFrame, names: tuple[str, ...] | None, search: int = HEADER_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, headers) of `cells`: headers are (file, at, names): a file's first row among `search` with one of these
    names, its empty names column_1, column_2, ...; without names wanted, a file's first row. rows: file, nth (from 1
    after the header), cells. Files without such a row have neither."""
    early = rows.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("place"))).where(F.col("k") <= search)
    fits = F.lit(True) if names is None else F.exists("cells", lambda c: F.lower(c).isin(*names))
    first = early.where(fits).groupBy("file").agg(F.min(F.struct("place", "cells")).alias("h"))
    titled = F.transform("h.cells", lambda c, i: F.when(c != "", c).otherwise(F.concat(F.lit("column_"), (i + 1).cast("string"))))
    headers = shared_table(first.select("file", F.col("h.place").alias("at"), titled.alias("names")), "headers")
    after = rows.join(headers.select("file", "at"), "file").where(F.col("place") > F.col("at"))
    # Places within a block of a file, and the blocks before it: no task numbers a whole large file.
    blocks = after.groupBy("file", "place.block").agg(F.count("*").alias("n"))
    ahead = blocks.select("file", F.col("block").alias("of"), (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("file", "place.block").orderBy("place"))
    placed = after.withColumn("inside", inside).withColumn("of", F.col("place.block")).join(ahead, ["file", "of"])
    return placed.select("file", (F.col("inside") + F.col("ahead")).alias("nth"), "cells"), headers


def _picked(names: Column, wanted: tuple[str, ...]) -> Column:
    """The place of the first column with one of these names, from 0; null without one."""
    at = F.array_position(F.transform(names, lambda c: F.lower(c).isin(*wanted)), F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def _at(place: str) -> Column:
    return F.when(F.col(place).isNull(), "").otherwise(F.coalesce(F.get("cells", F.col(place)), F.lit("")))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, q_id, question, expected_answer, key_facts) of question sheets, whose headers may stand below other
    rows. Without an id column, or with an empty id, a row's number is its id; questions of fewer than LETTERS letters
    are left out; no answer is null."""
    rows, headers = headed(cells(spark, path), QUESTION)
    places = headers.select("file", _picked(F.col("names"), QUESTION).alias("q"), _picked(F.col("names"), QUESTION_ID).alias("id"), _picked(F.col("names"), EXPECTED).alias("a"), _picked(F.col("names"), KEY_FACTS).alias("f"))
    own = rows.join(places, "file").select("file", "nth", plain_id(_at("id")).alias("given"), _at("q").alias("question"), F.nullif(_at("a"), F.lit("")).alias("expected_answer"), F.nullif(_at("f"), F.lit("")).alias("key_facts"))
    number = F.col("nth").cast("string")
    return own.where(F.length("question") >= LETTERS).select("file", "nth", F.when(F.col("given") == "", number).otherwise(F.col("given")).alias("q_id"), "question", "expected_answer", "key_facts")


def json_questions(spark: SparkSession, path: str) -> DataFrame:
    """The same of JSON files: a list of objects, an object with such a list under `questions`, or one of question by id."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    listed = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.questions", "string"), F.col("value"))
    entry = "struct<question:string,query:string,prompt:string,q_id:string,id:string,expected_answer:string,key_facts:string>"
    items = F.when(F.ltrim(listed).startswith("["), F.from_json(listed, f"array<{entry}>"))
    by_id = F.when(items.isNull(), F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: F.struct(e["value"].alias("question"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("prompt"), e["key"].alias("q_id"), *(F.lit(None).cast("string").alias(k) for k in ("id", "expected_answer", "key_facts")))))
    own = raw.select("file", F.posexplode(F.coalesce(items, by_id)).alias("at", "e"))
    first = lambda *names: F.coalesce(*(F.nullif(squeeze(F.col(f"e.{n}")), F.lit("")) for n in names))
    out = own.select("file", (F.col("at") + 1).cast("long").alias("nth"), F.coalesce(first("q_id", "id"), (F.col("at") + 1).cast("string")).alias("q_id"), first("question", "query", "prompt").alias("question"), first("expected_answer").alias("expected_answer"), F.col("e.key_facts").alias("key_facts"))
    return out.where(F.length("question") >= LETTERS)


def question_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, question): the questions of sheets whose first row is a header: of the first column that says so, else
    of the first; each once, where it stands first."""
    rows, headers = headed(filled(cells(spark, path)), None)
    place = F.coalesce(_picked(F.col("names"), QUESTION[:4]), F.lit(0))
    own = rows.join(headers.select("file", place.alias("q")), "file").select("file", "nth", _at("q").alias("question")).where(F.length("question") >= LETTERS)
    return own.groupBy("file", "question").agg(F.min("nth").alias("nth")).select("file", "nth", "question")


def reference_answers(spark: SparkSession, path: str) -> DataFrame:
    """(file, question, answer): the last answer of each question; without an answer column the second one counts. Files
    without a question column give none."""
    rows, headers = headed(filled(cells(spark, path)), None)
    places = headers.select("file", _picked(F.col("names"), QUESTION[:4]).alias("q"), F.coalesce(_picked(F.col("names"), ANSWER), F.lit(1)).alias("a")).where("q is not null")
    own = rows.join(places, "file").select("file", "nth", _at("q").alias("question"), _at("a").alias("answer"))
    return own.where((F.length("question") >= LETTERS) & (F.col("answer") != "")).groupBy("file", "question").agg(F.max_by("answer", "nth").alias("answer"))


def rows_and_notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, notes) of sheets. A sheet is a table if two of its columns or more have both a name and a cell; its rows are
    (file, nth, values), the cells that aren't empty by name. Any other sheet is a note, its cells below the header by
    columns: (file, place, text), place by column and row; `note_texts` puts them together."""
    rows, headers = headed(filled(cells(spark, path)), None)
    used = rows.select("file", F.posexplode("cells").alias("column", "c")).where("c <> ''").groupBy("file").agg(F.collect_set("column").alias("used"))
    titled = F.size(F.filter(F.col("used"), lambda k: ~F.get("names", k).rlike(r"^(column_\d+|Unnamed.*)$")))
    own = rows.join(headers.join(used, "file").select("file", "names", (titled >= 2).alias("table")), "file")
    values = F.map_from_entries(F.filter(F.arrays_zip(F.col("names").alias("key"), F.slice("cells", 1, F.size("names")).alias("value")), lambda e: e["value"] != ""))
    tables = own.where("table").select("file", "nth", values.alias("values")).where("size(values) > 0")
    notes = own.where("not table").select("file", "nth", F.posexplode("cells").alias("column", "text")).where("text <> ''").select("file", F.struct("column", "nth").alias("place"), "text")
    return tables, notes


def note_texts(notes: DataFrame) -> DataFrame:
    """(file, text): a note's cells one below the other."""
    return notes.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))
