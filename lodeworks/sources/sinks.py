"""Sinks: tables, JSON lines, CSV, cleaned cells, column contracts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.text import text


def contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in order, missing ones as empty text, then the others."""
    first = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    return df.select(*first, *(c for c in df.columns if c not in columns))


def public(df: DataFrame) -> DataFrame:
    """Without columns whose names begin with an underscore."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, names in snake case: what a registry of plain cells takes."""
    snake = lambda c: "_".join("".join(x if x.isalnum() else " " for x in c.lower()).split())
    nested = lambda f: isinstance(f.dataType, ArrayType | MapType | StructType)
    return df.select(*((F.to_json(f.name) if nested(f) else F.col(f.name)).alias(snake(f.name)) for f in df.schema.fields))


def clean_cells(df: DataFrame, limit: int = 32767) -> DataFrame:
    """Text columns without control characters, cut to a cell's limit."""
    return df.select(*(F.left(F.regexp_replace(text(F.col(f.name)), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit(limit)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields))


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    public(df).write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    clean_cells(flat(public(df))).write.mode("overwrite").option("header", "true").csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below a folder."""
    for name, df in tables.items():
        public(df).write.mode("overwrite").parquet(f"{path}/{name}")
