"""CSV, JSON and JDBC inputs as mapped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.relation import TERMS
from ..terms import LANG_STRING, STRING
from .table import Field, TableSource, from_context


def csv_source(spark: SparkSession, path: str, context: dict, name: str, separator: str | None = None, infer: bool = True, turtle_cells: bool = False, links: dict | None = None) -> TableSource:
    """A CSV file with header, TSV by its extension. turtle_cells: cells may be `"x"@en`, `<iri>` or numbers in Turtle."""
    sep = separator or ("\t" if path.endswith((".tsv", ".tab")) else ",")
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=infer and not turtle_cells, escape='"', multiLine=True)
    source = from_context(df, context, name, links)
    if turtle_cells:
        source.mapping.fields = [Field(f.predicate, turtle_cell(f.column), TERMS, "term") for f in source.mapping.fields]
    return source


def turtle_cell(c: Column) -> Column:
    """A cell in Turtle's short form as a term; whatever has no such form is a plain string."""
    from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER

    def term(k: str, lex, dt=None, lang=None) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(F.lit(k).alias("k"), lex.alias("lex"), as_col(dt).alias("dt"), as_col(lang).alias("lang"))

    body = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
    out = F.when(c.rlike(r"^<[^<>\s]+>$"), term("I", F.regexp_extract(c, "^<(.*)>$", 1)))
    out = out.when(c.rlike(r'^"(?:[^"\\]|\\.)*"@[A-Za-z]+(-[A-Za-z0-9]+)*$'), term("L", body, LANG_STRING, F.lower(F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1))))
    out = out.when(c.rlike(r'^"(?:[^"\\]|\\.)*"\^\^<[^<>\s]+>$'), term("L", body, F.regexp_extract(c, r"\^\^<(.*)>$", 1)))
    out = out.when(c.rlike(r'^"(?:[^"\\]|\\.)*"$'), term("L", body, STRING))
    for pattern, dt in ((r"^[+-]?[0-9]+$", INTEGER), (r"^[+-]?[0-9]*\.[0-9]+$", DECIMAL), (r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+$", DOUBLE), (r"^(?:true|false)$", BOOLEAN)):
        out = out.when(c.rlike(pattern), term("L", c, dt))
    return out.when(c.isNotNull(), term("L", c, STRING))


def flattened(df: DataFrame) -> DataFrame:
    """Nested objects become columns named by their path (`a.b`); arrays become one row per element."""
    while True:
        nested = next((f for f in df.schema.fields if isinstance(f.dataType, (StructType, ArrayType))), None)
        if nested is None:
            return df
        if isinstance(nested.dataType, ArrayType):
            df = df.withColumn(nested.name, F.explode_outer(F.col(f"`{nested.name}`")))
        else:
            inner = [F.col(f"`{nested.name}`")[x.name].alias(f"{nested.name}.{x.name}") for x in nested.dataType.fields]
            df = df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.name != nested.name], *inner)


def json_source(spark: SparkSession, path: str, context: dict, name: str, lines: bool = True, links: dict | None = None) -> TableSource:
    """JSON documents: nested members are mapped by their path. Members with many values repeat the subject's row."""
    df = flattened(spark.read.json(path, multiLine=not lines))
    return from_context(df, context, name, links, unique=False)


def jdbc_source(spark: SparkSession, url: str, table: str, context: dict, name: str, links: dict | None = None, partition_column: str | None = None, partitions: int = 16, **options) -> TableSource:
    """A table behind JDBC: Spark pushes filters, columns and limits down.

    partition_column: a number, date or timestamp whose range, asked for first, is split over so many connections.
    """
    read = lambda **o: spark.read.format("jdbc").options(url=url, **options, **o).load()
    if partition_column:
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(partition_column)
        low, high = read(query=f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {table}").first()
        if low is not None:
            return from_context(read(dbtable=table, partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)), context, name, links)
    return from_context(read(dbtable=table), context, name, links)
