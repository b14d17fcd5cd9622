"""Receipt-shaped views of the driver's tables; the same text runs in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import table

# {l}, {p}, {c}, {o} are lineitem, part, customer, orders.
RECEIPTS = """
with l as (
  select l_orderkey, l_partkey, l_suppkey, l_extendedprice, p_name,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn
  from {l} join {p} on l_partkey = p_partkey),
n as (select l_orderkey, count(*) n from {l} group by l_orderkey)
select l_orderkey receipt_id, cast(2*rn as int) seq,
       case when l_partkey % 23 = 0 then '  ' else p_name end text,
       cast(10 as double) x1, cast(100 + 40*rn + 6*(l_partkey % 5) as double) y1,
       cast(10 + 10*length(p_name) as double) x2, cast(122 + 40*rn + 6*(l_partkey % 5) as double) y2,
       case when l_partkey % 17 = 0 then null else cast(64 + l_suppkey % 64 as double) / 128 end confidence
from l
union all
select l_orderkey, cast(2*rn + 1 as int), cast(cast(floor(l_extendedprice) as bigint) as varchar(20)),
       cast(case when l_suppkey % 3 = 0 then 30 + 10*length(p_name) else 300 end as double),
       cast(100 + 40*rn + 6*(l_suppkey % 5) as double),
       cast(case when l_suppkey % 3 = 0 then 80 + 10*length(p_name) else 350 end as double),
       cast(120 + 40*rn + 6*(l_suppkey % 5) as double),
       cast(32 + l_partkey % 96 as double) / 128
from l
union all
select o_orderkey, 0, c_name, cast(10 as double), cast(10 as double), cast(200 as double), cast(30 as double), cast(1 as double)
from {o} join {c} on o_custkey = c_custkey where o_custkey % 29 <> 0
union all
select o_orderkey, cast(2*n + 2 as int), 'Total', cast(10 as double), cast(240 + 40*n as double),
       cast(60 as double), cast(260 + 40*n as double), cast(0.9375 as double)
from {o} join n on o_orderkey = l_orderkey
"""

INPUTS = """
select doc_id, 'in/' || source || case when doc_id % 7 = 0 then '-b/' else '/' end || 'r' || cast(doc_id % 400 as varchar(20))
       || case doc_id % 6 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png' when 3 then '.HEIC' when 4 then '.txt' else '.pdf' end path,
       cast(1 + (doc_id * 37) % 6000 as int) w, cast(1 + (doc_id * 101) % 6000 as int) h
from {d}
"""

TEXTS = "select 'r' || cast(doc_id as varchar(20)) output_id, text from {d}"
# Ids that an earlier run has done: a part of them, so that some are left to do.
DONE = "select 'r' || cast(doc_id as varchar(20)) output_id from {d} where doc_id % 3 <> 0"

MANIFEST = """
select event_id pos, 'r' || cast(user_id as varchar(20)) output_id,
       case event_type when 'view' then 'ok' when 'click' then 'low_confidence' when 'signup' then 'empty' when 'error' then 'error' end status
from {e}
"""

_NAMES = {"l": "lineitem", "p": "part", "c": "customer", "o": "orders", "d": "documents", "e": "events"}


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {k: table(spark, sf_dir, t) for k, t in _NAMES.items() if "{" + k + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    for k, t in _NAMES.items():
        text = text.replace("{" + k + "}", t)
    return text


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of RECEIPTS, with lineitem numbered and counted in one shuffle and a
    line's two fragments made from one row."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    order = Window.partitionBy("l_orderkey")
    numbered = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "p_name",
        F.row_number().over(order.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("rn"),
    )
    name = """struct(cast(2*rn as int) seq, case when l_partkey % 23 = 0 then '  ' else p_name end text, 10d x1,
        cast(100 + 40*rn + 6*(l_partkey % 5) as double) y1, cast(10 + 10*length(p_name) as double) x2, cast(122 + 40*rn + 6*(l_partkey % 5) as double) y2,
        case when l_partkey % 17 = 0 then null else cast(64 + l_suppkey % 64 as double) / 128 end confidence)"""
    price = """struct(cast(2*rn + 1 as int) seq, cast(cast(floor(l_extendedprice) as bigint) as string) text,
        cast(case when l_suppkey % 3 = 0 then 30 + 10*length(p_name) else 300 end as double) x1, cast(100 + 40*rn + 6*(l_suppkey % 5) as double) y1,
        cast(case when l_suppkey % 3 = 0 then 80 + 10*length(p_name) else 350 end as double) x2, cast(120 + 40*rn + 6*(l_suppkey % 5) as double) y2,
        cast(32 + l_partkey % 96 as double) / 128 confidence)"""
    items = numbered.select(F.col("l_orderkey").alias("receipt_id"), F.expr(f"inline(array({name}, {price}))"))
    headers = orders.where("o_custkey % 29 <> 0").join(names, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey receipt_id", "0 seq", "c_name text", "10d x1", "10d y1", "200d x2", "30d y2", "1d confidence",
    )
    counts = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    totals = orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "o_orderkey receipt_id", "cast(2*n + 2 as int) seq", "'Total' text", "10d x1", "cast(240 + 40*n as double) y1", "60d x2", "cast(260 + 40*n as double) y2", "0.9375d confidence",
    )
    return items.unionByName(headers).unionByName(totals)
