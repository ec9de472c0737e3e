"""Records whose shape drifts, read as VARIANT (OP-09, OP-10).

Saved API pages and inventories change: a field is added, another is missing, a number
becomes a string.  A fixed schema then loses whole records or fails the scan.  Here a page is parsed once into a
VARIANT, its records are taken out, and each field of the wanted schema is looked up and
cast by itself: unknown fields are ignored, missing ones are null, retyped ones are cast where
they can be.  Lines that are no JSON, and records that are no objects, are kept apart with their text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pages(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, value, page)``: one page a line; ``page`` is null where the line is no JSON."""
    if isinstance(paths, str):
        paths = [paths]
    return parsed(spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value"))


def parsed(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines with their ``page``, blank ones left out."""
    return lines.filter(F.trim(col) != "").withColumn("page", F.try_parse_json(col))


def records(pages: DataFrame) -> DataFrame:
    """One ``record`` for each object of a page: the elements of an array, or the page itself."""
    return _elements(pages).filter(_is_object(F.col("record"))).drop("value", "page")


def unreadable(pages: DataFrame) -> DataFrame:
    """``(file, text)`` of lines that are no JSON and of elements that are no objects."""
    broken = pages.filter(F.col("page").isNull()).select("file", F.col("value").alias("text"))
    odd = _elements(pages).filter(~_is_object(F.col("record"))).select("file", F.to_json("record").alias("text"))
    return broken.unionByName(odd)


def _elements(pages: DataFrame) -> DataFrame:
    some = pages.filter(F.col("page").isNotNull())
    elements = F.coalesce(F.try_variant_get("page", "$", "array<variant>"), F.array("page"))
    return some.withColumn("record", F.explode(elements))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def field(v: Column, kind: T.DataType, path: str = "$") -> Column:
    """The value at ``path`` as ``kind``, null where it is missing or cannot be cast; structs and arrays field by field."""
    if isinstance(kind, T.StructType):
        there = F.try_variant_get(v, path, "variant")
        parts = [field(v, f.dataType, f"{path}['{f.name}']").alias(f.name) for f in kind.fields]
        return F.when(there.isNotNull() & _is_object(there), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: field(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.try_variant_get(v, path, "map<string,variant>"), lambda _, x: field(x, kind.valueType))
    return F.try_variant_get(v, path, kind.simpleString())


def typed(rows: DataFrame, schema: T.StructType, col: str = "record") -> DataFrame:
    """The columns of ``schema`` from each record; other columns of ``rows`` go."""
    return rows.select(*[field(F.col(col), f.dataType, f"$['{f.name}']").alias(f.name) for f in schema.fields])


def read_drifting(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records as ``schema``, unreadable texts): ``read_records`` for pages whose shape changes."""
    pages = read_pages(spark, paths)
    return typed(records(pages), schema), unreadable(pages)
