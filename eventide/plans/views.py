"""Deterministic projections of the driver tables onto the event data model.

Each view exists twice: as a Spark DataFrame (what the jobs read) and as a DuckDB
SQL text (what the oracle reads). Only integer and string arithmetic is used so both
engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.timefmt import floor_interval

EVENT_COLUMNS = [
    "sqldate", "actor1_code", "actor1_name", "actor2_code", "actor2_name",
    "event_code", "event_base_code", "event_root_code", "quad_class",
    "goldstein_scale", "num_mentions", "avg_tone",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pad2(c) -> F.Column:
    return F.lpad(c.cast("string"), 2, "0")


def v_interactions(spark: SparkSession, sf_dir: str, with_id: bool = False,
                   with_ticker: bool = False) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ supplier ⋈ nation as event rows (A1/A4).

    ``with_id`` adds ``event_id`` = source file name + Parquet row index of the line
    item, a unique and replay-stable key (Q20). ``with_ticker`` adds the part's brand as
    ``ticker``, the key that links an event to a price series.
    """
    li_cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
               "l_discount", "l_tax", "l_shipdate"]
    li = table(spark, sf_dir, "lineitem")
    if with_id:
        li = li.select(*li_cols, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    else:
        li = li.select(*li_cols)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Join order for scale: the plain supplier table meets the line items first, since a join's size is
    # estimated too large to be broadcast; then the two large sides meet once, on the order key, by
    # hashing the orders (no sort of the line items); nation names are added to the joined rows.
    buyers = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
              .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
                    F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "c_nationkey"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")
         .join(buyers.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"))
    if with_ticker:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
        j = j.join(part, F.col("l_partkey") == F.col("p_partkey"))
    for side in ("s", "c"):
        j = j.join(nation.select(F.col("n_nationkey").alias(f"{side}n_key"), F.col("n_name").alias(f"{side}n_name")),
                   F.col(f"{side}_nationkey") == F.col(f"{side}n_key")).drop(f"{side}n_key")
    code = _pad2(F.lit(1) + F.col("l_partkey") % 20)
    out = [
        F.date_format("l_shipdate", "yyyyMMdd").alias("sqldate"),
        F.concat(F.lit("S"), _pad2(F.col("s_nationkey"))).alias("actor1_code"),
        F.col("sn_name").alias("actor1_name"),
        F.concat(F.lit("C"), _pad2(F.col("c_nationkey"))).alias("actor2_code"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("cn_name")).alias("actor2_name"),
        F.concat(code, F.col("l_linenumber").cast("string")).alias("event_code"),
        F.concat(code, F.col("l_linenumber").cast("string")).alias("event_base_code"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit("")).otherwise(code).alias("event_root_code"),
        (F.lit(1) + F.floor((F.col("l_partkey") % 20) / 5)).cast("bigint").cast("string").alias("quad_class"),
        ((F.round(F.col("l_discount") * 100).cast("int") - 5) * 2).cast("string").alias("goldstein_scale"),
        F.col("l_quantity").cast("int").cast("string").alias("num_mentions"),
        (F.round(F.col("l_tax") * 100).cast("int") - 4).cast("string").alias("avg_tone"),
    ]
    if with_id:
        out.append(F.concat_ws(":", "__file", F.col("__row").cast("string")).alias("event_id"))
    if with_ticker:
        out.append(F.col("ticker"))
    return j.select(*out)


def v_interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an interval log (A2): 15-minute interval, root code = event type,
    four quad classes from the JSON property ``k``."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        "event_id", "ts",
        floor_interval("ts").alias("interval_ts"),
        F.col("event_type").alias("event_root_code"),
        (F.lit(1) + k % 4).cast("string").alias("quad_class"),
    )


def v_actor_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actor upserts with a unique order key (exercises last-write-wins and NULL codes)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("order_key"), "ts",
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("actor1_name"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("event_type")).alias("actor1_code"),
        F.concat(F.lit("U"), (F.col("user_id") * 7 % 100).cast("string")).alias("actor2_name"),
        F.concat(F.lit("T"), (F.col("event_id") % 10).cast("string")).alias("actor2_code"),
    )


def v_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per ticker (brand) from line items."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("price_date"))
            .agg(F.min_by("l_extendedprice", order).alias("open"),
                 F.max("l_extendedprice").alias("high"),
                 F.min("l_extendedprice").alias("low"),
                 F.max_by("l_extendedprice", order).alias("close"),
                 F.sum(F.col("l_quantity").cast("bigint")).alias("volume")))


def v_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RDF-style triples ``(s, p, o, lang)`` (A5): countries and regions from nation and
    region, plus supplier and customer entities (type, English label, country link), so
    the store — and every pattern's scan — grows with the data."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    sup = table(spark, sf_dir, "supplier")
    cus = table(spark, sf_dir, "customer")
    s = F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"))
    null = F.lit(None).cast("string")
    parts = [
        n.select(s.alias("s"), F.lit("type").alias("p"), F.lit("Country").alias("o"), null.alias("lang")),
        n.select(s.alias("s"), F.lit("label").alias("p"), F.col("n_name").alias("o"), F.lit("en").alias("lang")),
        n.select(s.alias("s"), F.lit("label").alias("p"), F.concat("n_name", F.lit("_DE")).alias("o"),
                 F.lit("de").alias("lang")),
        n.filter(F.col("n_nationkey") % 3 != 0).select(
            s.alias("s"), F.lit("isoCode").alias("p"),
            F.concat(F.lit("N"), _pad2(F.col("n_nationkey"))).alias("o"), null.alias("lang")),
        n.filter(F.col("n_nationkey") % 2 == 0).select(
            s.alias("s"), F.lit("capital").alias("p"),
            F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("o"), null.alias("lang")),
        r.select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("s"),
                 F.lit("label").alias("p"), F.col("r_name").alias("o"),
                 F.when(F.col("r_regionkey") == 4, F.lit("fr")).otherwise(F.lit("en")).alias("lang")),
    ]
    for df, kind, key, name, nation in ((sup, "Supplier", "s_suppkey", "s_name", "s_nationkey"),
                                        (cus, "Customer", "c_custkey", "c_name", "c_nationkey")):
        ent = F.concat(F.lit(kind.lower() + "/"), F.col(key).cast("string"))
        parts += [
            df.select(ent.alias("s"), F.lit("type").alias("p"), F.lit(kind).alias("o"), null.alias("lang")),
            df.select(ent.alias("s"), F.lit("label").alias("p"), F.col(name).alias("o"), F.lit("en").alias("lang")),
            df.select(ent.alias("s"), F.lit("country").alias("p"),
                      F.concat(F.lit("nation/"), F.col(nation).cast("string")).alias("o"), null.alias("lang")),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# DuckDB twins (used as CTEs by the oracle)
# ---------------------------------------------------------------------------

SQL_VIEWS = {
    "v_interactions": """
SELECT strftime(l.l_shipdate, '%Y%m%d') AS sqldate,
       'S' || lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') AS actor1_code,
       sn.n_name AS actor1_name,
       'C' || lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') AS actor2_code,
       CASE WHEN l.l_orderkey % 50 = 0 THEN NULL ELSE cn.n_name END AS actor2_name,
       lpad(CAST(1 + l.l_partkey % 20 AS VARCHAR), 2, '0') || CAST(l.l_linenumber AS VARCHAR) AS event_code,
       lpad(CAST(1 + l.l_partkey % 20 AS VARCHAR), 2, '0') || CAST(l.l_linenumber AS VARCHAR) AS event_base_code,
       CASE WHEN l.l_partkey % 97 = 0 THEN '' ELSE lpad(CAST(1 + l.l_partkey % 20 AS VARCHAR), 2, '0') END
         AS event_root_code,
       CAST(1 + (l.l_partkey % 20) // 5 AS VARCHAR) AS quad_class,
       CAST((CAST(round(l.l_discount * 100) AS INTEGER) - 5) * 2 AS VARCHAR) AS goldstein_scale,
       CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR) AS num_mentions,
       CAST(CAST(round(l.l_tax * 100) AS INTEGER) - 4 AS VARCHAR) AS avg_tone
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey""",
    "v_interval_events": """
SELECT event_id, ts, time_bucket(INTERVAL '15 minutes', ts) AS interval_ts,
       event_type AS event_root_code,
       CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS VARCHAR) AS quad_class
FROM events""",
    "v_actor_updates": """
SELECT event_id AS order_key, ts,
       'U' || CAST(user_id AS VARCHAR) AS actor1_name,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS actor1_code,
       'U' || CAST(user_id * 7 % 100 AS VARCHAR) AS actor2_name,
       'T' || CAST(event_id % 10 AS VARCHAR) AS actor2_code
FROM events""",
    "v_prices": """
SELECT p.p_brand AS ticker, CAST(l.l_shipdate AS DATE) AS price_date,
       arg_min(l.l_extendedprice, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) AS open,
       max(l.l_extendedprice) AS high,
       min(l.l_extendedprice) AS low,
       arg_max(l.l_extendedprice, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) AS close,
       CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS volume
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_brand, CAST(l.l_shipdate AS DATE)""",
    "v_triples": """
SELECT 'nation/' || CAST(n_nationkey AS VARCHAR) AS s, 'type' AS p, 'Country' AS o, CAST(NULL AS VARCHAR) AS lang FROM nation
UNION ALL SELECT 'nation/' || CAST(n_nationkey AS VARCHAR), 'label', n_name, 'en' FROM nation
UNION ALL SELECT 'nation/' || CAST(n_nationkey AS VARCHAR), 'label', n_name || '_DE', 'de' FROM nation
UNION ALL SELECT 'nation/' || CAST(n_nationkey AS VARCHAR), 'isoCode', 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), NULL
  FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'nation/' || CAST(n_nationkey AS VARCHAR), 'capital', 'region/' || CAST(n_regionkey AS VARCHAR), NULL
  FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'region/' || CAST(r_regionkey AS VARCHAR), 'label', r_name,
  CASE WHEN r_regionkey = 4 THEN 'fr' ELSE 'en' END FROM region
UNION ALL SELECT 'supplier/' || CAST(s_suppkey AS VARCHAR), 'type', 'Supplier', NULL FROM supplier
UNION ALL SELECT 'supplier/' || CAST(s_suppkey AS VARCHAR), 'label', s_name, 'en' FROM supplier
UNION ALL SELECT 'supplier/' || CAST(s_suppkey AS VARCHAR), 'country', 'nation/' || CAST(s_nationkey AS VARCHAR), NULL
  FROM supplier
UNION ALL SELECT 'customer/' || CAST(c_custkey AS VARCHAR), 'type', 'Customer', NULL FROM customer
UNION ALL SELECT 'customer/' || CAST(c_custkey AS VARCHAR), 'label', c_name, 'en' FROM customer
UNION ALL SELECT 'customer/' || CAST(c_custkey AS VARCHAR), 'country', 'nation/' || CAST(c_nationkey AS VARCHAR), NULL
  FROM customer""",
}


SQL_VIEWS["v_interactions_t"] = (
    SQL_VIEWS["v_interactions"].replace("SELECT strftime", "SELECT pt.p_brand AS ticker, strftime", 1)
    + "\nJOIN part pt ON l.l_partkey = pt.p_partkey")


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named views (and extra named CTEs, in order)."""
    ctes = [f"{n} AS ({SQL_VIEWS[n]}\n)" for n in names]
    for k, v in (extra or {}).items():
        ctes.append(f"{k} AS ({v}\n)")
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql
