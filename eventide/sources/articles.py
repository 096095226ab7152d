"""Article-mention files: headerless TSV read by position with optional trailing
columns (S12, D16). A row shorter than the layout yields NULLs for the missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Ordinals of the organisation, person, location and extras columns.
ARTICLE_COLUMNS = {19: "organizations", 21: "persons", 23: "locations", 29: "extras"}
ARTICLE_WIDTH = 30


def read_article_file(spark: SparkSession, path: str, encoding: str = "UTF-8",
                      width: int = ARTICLE_WIDTH, id_ordinal: int = 0) -> DataFrame:
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(width)])
    df = (spark.read.schema(schema).option("sep", "\t").option("header", False)
          .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))
    return df.select(F.col(f"c{id_ordinal}").alias("record_id"),
                     *[F.col(f"c{i}").alias(n) for i, n in ARTICLE_COLUMNS.items()])


def write_article_file(rows: DataFrame, path: str, width: int = ARTICLE_WIDTH, id_ordinal: int = 0) -> None:
    """Land ``rows(record_id, organizations, persons, locations[, extras])`` as article files."""
    at = {id_ordinal: "record_id", **ARTICLE_COLUMNS}
    cols = [(F.col(at[i]) if at.get(i) in rows.columns else F.lit(None).cast("string")).alias(f"c{i}") for i in range(width)]
    (rows.select(*cols).write.option("sep", "\t").option("header", False).option("nullValue", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
