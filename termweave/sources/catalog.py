"""Sources and sinks of name, term and gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import long_hash, tokenize


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with a header, all columns strings; only an empty field is null."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True)


def scan_gold(table: DataFrame, name: str, term: str) -> DataFrame:
    """Distinct (name, term) pairs with a term."""
    return table.where(F.col(term).isNotNull()).select(F.col(name).alias("name"), F.col(term).alias("term")).distinct()


def scan_names(table: DataFrame, name: str) -> DataFrame:
    """Distinct names with their tokens and an id that depends on the name alone."""
    names = table.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    return names.select(long_hash(F.col("name")).alias("name_id"), "name", tokenize(F.col("name")).alias("tokens"))


def scan_terms(table: DataFrame, term: str, term_id: Column | None = None) -> DataFrame:
    """Every term row with its tokens; equal terms stay apart where a row id is given."""
    terms = table.where(F.col(term).isNotNull())
    key = long_hash(F.col(term)) if term_id is None else term_id
    return terms.select(key.alias("term_id"), F.col(term).alias("term"), tokenize(F.col(term)).alias("tokens"))


#: A text file is a CSV file of one column: no separator, and no quotes.
_LINES = {"header": True, "sep": "\u0001", "quote": "", "escape": ""}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files whose first line is a title, which is left out; so are empty lines."""
    return spark.read.schema("value string").options(**_LINES).csv(path)


def write_lines(lines: DataFrame, path: str, title: str) -> None:
    """Write the lines of column value; every file begins with the title."""
    # lines that begin with the comment character would be quoted
    space = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "comment": "\u0002"}
    lines.select(F.col("value").alias(title)).write.mode("overwrite").options(**_LINES, **space).csv(path)


def scan_relation_file(spark: SparkSession, path: str) -> DataFrame:
    """scan_relation_text of files with a title line; col_id depends on the column's full name alone."""
    rows = scan_relation_text(read_lines(spark, path))
    return rows.select(long_hash(F.col("schema_name"), F.col("table_name"), F.col("column_name")).alias("col_id"), *rows.columns)


def scan_term_file(spark: SparkSession, path: str) -> DataFrame:
    """scan_term_text of files with a title line; term_id depends on the term alone."""
    return scan_term_text(read_lines(spark, path)).select(long_hash(F.col("term")).alias("term_id"), "term")


def scan_relation_text(lines: DataFrame) -> DataFrame:
    """(schema_name, table_name, column_name) from lines ``schema.table(c1, c2)`` in column value."""
    parts = F.filter(F.split("value", r"[.(), ]"), lambda x: x != "")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 3)
    return rows.select(
        F.col("p")[0].alias("schema_name"), F.col("p")[1].alias("table_name"),
        F.explode(F.slice("p", 3, F.size("p") - 2)).alias("column_name"),
    )


def scan_term_text(lines: DataFrame) -> DataFrame:
    """Distinct terms, one to a line of column value."""
    return lines.where("value <> ''").select(F.col("value").alias("term")).distinct()


def format_relation_text(columns: DataFrame) -> DataFrame:
    """Lines ``SCHEMA.TABLE(c1, c2)`` of a (schema_name, table_name, column_name) table."""
    prefix = F.concat_ws(".", "schema_name", "table_name")
    grouped = columns.groupBy(prefix.alias("prefix")).agg(F.array_sort(F.collect_list("column_name")).alias("names"))
    return grouped.select(F.concat("prefix", F.lit("("), F.array_join("names", ", "), F.lit(")")).alias("value"))


def format_term_text(columns: DataFrame, term: str) -> DataFrame:
    """The distinct terms of a table of columns, a line each; columns without a term give none."""
    return columns.where(F.col(term).isNotNull()).select(F.col(term).alias("value")).distinct()


def flattened(df: DataFrame) -> DataFrame:
    """df with arrays and structs as JSON text."""
    nested = ("array", "struct", "map")
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name) for f in df.schema.fields])


def sink_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header; arrays and structs as JSON text."""
    flattened(df).write.mode("overwrite").csv(path, header=True)


def load_vectors(table: DataFrame, word: str, vector: str) -> DataFrame:
    """(word, vector) with double components; words without a vector are left out."""
    return table.where(F.col(vector).isNotNull()).select(
        F.col(word).alias("word"), F.col(vector).cast("array<double>").alias("vector")
    )


def load_vector_text(lines: DataFrame) -> DataFrame:
    """(word, vector) from the lines ``word v1 v2 ...`` of a .vec file in column value; its header is left out."""
    parts = F.split(F.trim("value"), " ")
    return lines.select(parts.alias("p")).where(F.size("p") > 2).select(
        F.col("p")[0].alias("word"), F.slice("p", 2, F.size("p") - 1).cast("array<double>").alias("vector")
    )
