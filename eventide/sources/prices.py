"""Daily price files (S10, D15): one table of ``(ticker, price_date, open, high, low, close, volume)``.

Spark's layout keeps the ticker in the directory name (``ticker=<name>/``); the
reference's layout keeps it in the file name (``<ticker>.csv``). Both are read with an
explicit schema; rows without a ticker are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_COLUMNS = "price_date date, open double, high double, low double, close double, volume bigint"
# Column layout of a per-ticker file from the price provider the reference uses.
PROVIDER_COLUMNS = "Date date, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint"


def write_prices(prices: DataFrame, path: str) -> None:
    """One directory per ticker. The ``rebalance`` hint hashes rows by ticker, splits a heavy one
    over tasks and merges small ones, so a ticker has few files and no task a whole hot ticker."""
    (prices.hint("rebalance", "ticker").sortWithinPartitions("ticker", "price_date").write.mode("overwrite")
     .partitionBy("ticker").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_price_files(prices: DataFrame, path: str) -> None:
    """One file per ticker, named ``<ticker>.csv``, in the provider's column layout.

    The layout itself puts all rows of a ticker into one file; days bound their number. Files
    are written by Spark under a ticker directory and then given their name."""
    spark = prices.sparkSession
    parts = f"{path.rstrip('/')}/_parts"
    cols = [F.col("price_date").alias("Date"), *[F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close")],
            F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"), "ticker"]
    (prices.select(*cols).repartition("ticker").sortWithinPartitions("ticker", "Date").write.mode("overwrite")
     .partitionBy("ticker").option("header", True).csv(parts))
    jvm = spark.sparkContext._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(to_path(f"{parts}/ticker=*/part-*")):
        ticker = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(
            f.getPath().getParent().getName().split("=", 1)[1])
        if not fs.rename(f.getPath(), to_path(f"{path.rstrip('/')}/{ticker}.csv")):
            raise OSError(f"cannot name the file of {ticker}")
    fs.delete(to_path(parts), True)


def read_prices(spark: SparkSession, path: str, layout: str = "partitioned") -> DataFrame:
    if layout == "partitioned":
        df = spark.read.schema(PRICE_COLUMNS + ", ticker string").option("header", True).csv(path)
    elif layout == "file_per_ticker":
        # file names come percent-encoded; a plus sign in them is one
        name = F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
        df = (spark.read.schema(PROVIDER_COLUMNS).option("header", True).csv(path)
              .select(F.regexp_extract(name, r"^(.*)\.csv$", 1).alias("ticker"),
                      F.col("Date").alias("price_date"), F.col("Open").alias("open"), F.col("High").alias("high"),
                      F.col("Low").alias("low"), F.col("Close").alias("close"), F.col("Volume").alias("volume")))
    else:
        raise ValueError(layout)
    return (df.filter(F.col("ticker").isNotNull() & (F.col("ticker") != "") & F.col("price_date").isNotNull())
            .select("ticker", "price_date", "open", "high", "low", "close", "volume"))
