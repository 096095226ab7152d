"""SPARQL JSON result documents.

A result document is ``{"head": {"vars": [...]}, "results": {"bindings": [{var: {type,
value, xml:lang?}}, ...]}}``; an unbound optional variable is an absent key. Documents
are read with an explicit schema (absent key -> NULL struct -> NULL value) and flattened
with ``explode``. Documents written by :func:`write_bindings` hold at most
``per_doc`` bindings each, one document per line, so reading stays splittable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "struct<type: string, value: string, `xml:lang`: string>"
COUNTRY_VARS = {"country": "uri", "countryLabel": "name", "isoCode": "iso_code", "capitalLabel": "capital"}
LITERAL_VARS = {"countryLabel", "capitalLabel"}


def bindings_schema(variables: list[str]) -> str:
    fields = ", ".join(f"`{v}`: {VALUE}" for v in variables)
    return f"head struct<vars: array<string>>, results struct<bindings: array<struct<{fields}>>>"


def write_bindings(rows: DataFrame, path: str, var_map: dict[str, str] = COUNTRY_VARS,
                   per_doc: int = 10_000, lang: str = "en") -> None:
    """Rows -> result documents; a NULL column becomes an unbound (absent) variable."""
    def term(var: str, col: str):
        kind = F.lit("literal") if var in LITERAL_VARS else F.lit("uri")
        tag = F.lit(lang) if var in LITERAL_VARS else F.lit(None).cast("string")
        return F.when(F.col(col).isNotNull(), F.struct(kind.alias("type"), F.col(col).alias("value"),
                                                       tag.alias("xml:lang"))).alias(var)
    binding = F.struct(*[term(v, c) for v, c in var_map.items()])
    docs = (rows.select(F.floor(F.monotonically_increasing_id() / F.lit(per_doc)).alias("doc"), binding.alias("b"))
            .groupBy("doc").agg(F.collect_list("b").alias("bindings")))
    out = docs.select(F.to_json(F.struct(
        F.struct(F.array(*[F.lit(v) for v in var_map]).alias("vars")).alias("head"),
        F.struct(F.col("bindings").alias("bindings")).alias("results"))).alias("value"))
    out.write.mode("overwrite").text(path)


def read_bindings(spark: SparkSession, path: str, var_map: dict[str, str] = COUNTRY_VARS,
                  multi_line: bool = False) -> DataFrame:
    """Flatten result documents to one row per binding with the mapped column names."""
    docs = spark.read.schema(bindings_schema(list(var_map))).option("multiLine", multi_line).json(path)
    b = docs.select(F.explode("results.bindings").alias("b"))
    return b.select(*[F.col(f"b.`{v}`.value").alias(c) for v, c in var_map.items()])
