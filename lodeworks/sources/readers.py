"""Sources: text lines, CSV tables with header aliases, JSON lines, documents in folders, county shapes."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import html as H
from ..functions import text as T


def query_list(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(query, ord): lines, squeezed, blank ones dropped, numbered from 0; offset and limit count queries. A file is read
    in parts, each of which numbers its own lines."""
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select(T.squeeze(F.col("value")).alias("query"), where.alias("part"), F.monotonically_increasing_id().alias("nth")).where("query <> ''")
    ahead = lines.groupBy("part").agg(F.count("*").alias("n"))
    ahead = ahead.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row a part
    inside = F.row_number().over(Window.partitionBy("part").orderBy("nth")) - 1
    own = lines.withColumn("inside", inside).join(ahead, F.col("part") == F.col("of")).select("query", (F.col("inside") + F.col("ahead")).alias("ord"))
    own = own.where(F.col("ord") >= offset)
    return own if limit is None else own.where(F.col("ord") < offset + limit)


def table_rows(df: DataFrame) -> DataFrame:
    """Rows of any table as a map of the cells that aren't blank."""
    cells = F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(T.squeeze(F.col(f"`{c}`").cast("string")) for c in df.columns)))
    return df.select(F.map_filter(cells, lambda _, v: v != "").alias("values")).where("size(values) > 0")


def renamed(df: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns under their canonical names by header aliases; an error if a required one is missing."""
    plain = lambda s: " ".join(s.lower().replace("_", " ").split())
    by = {plain(a): name for name, every in ({r: [] for r in required} | aliases).items() for a in [name, *every]}
    out, seen = [], set()
    for c in df.columns:
        name = by.get(plain(c), c)
        if name not in seen:
            seen.add(name)
            out.append(F.col(f"`{c}`").alias(name))
    if missing := [r for r in required if r not in seen]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*out)


def gold_answers(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Gold answers by id; blank rows are dropped, a repeated id is an error."""
    own = renamed(df, aliases, ("q_id", "question", "golden_answer"))
    own = own.withColumn("q_id", T.plain_id(F.col("q_id"))).where((F.col("q_id") != "") & (T.squeeze(F.col("question")) != "") & (T.squeeze(F.col("golden_answer")) != ""))
    twice = own.groupBy("q_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated q_id: {twice[0].q_id}")
    return own


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: the last by an order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def documents(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, issues) of the text and HTML files below a folder. manifest: name, and what is known of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = files.select("path", F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"), F.sha2("content", 256).alias("bytes_sha256"))
    kind = F.when(F.col("name").rlike(r"\.html?$"), "html").when(F.col("name").rlike(r"\.(txt|md)$"), "text").otherwise("other")
    read = raw.withColumn("kind", kind).withColumn("title", F.when(kind == "html", H.title(F.col("raw"))).otherwise(T.filename_words(F.col("name"))))
    read = read.withColumn("text", F.when(kind == "html", H.main_text(F.col("raw"))).when(kind == "text", T.document_text(F.col("raw"))).otherwise("")).drop("raw")
    if manifest is not None:
        read = read.join(manifest.withColumn("name", F.lower("name")), "name", "left")
    return read.where("text <> ''"), read.where("text = ''").select("path", F.when(F.col("kind") == "other", "unknown type").otherwise("no text").alias("issue"))


def counties(spark: SparkSession, path: str) -> DataFrame:
    """(county, region) of a GeoJSON file's features."""
    props = spark.read.option("multiLine", "true").json(path).select(F.explode("features.properties").alias("p")).select("p.*")
    own = lambda c: F.col(c) if c in props.columns else F.lit("")
    return props.select(F.coalesce(F.nullif(own("NAMELSAD10"), F.lit("")), own("NAME10")).alias("county"), own("Reg_Comm").alias("region")).distinct()


def file_index(files: DataFrame) -> DataFrame:
    """(key, path): files under three spellings of their names; the first path of a key wins."""
    name = F.element_at(F.split("path", "/"), -1)
    keys = F.array_distinct(F.array(F.lower(name), F.lower(T.filename_words(name)), F.lower(T.safe_filename(name))))
    return files.select("path", F.explode(keys).alias("key")).groupBy("key").agg(F.min("path").alias("path"))
