"""Views over the driver's tables with the shapes of the engine's inputs (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Select lists that Spark and DuckDB read alike.
V_OBS = [
    "l_partkey as pixel_id",
    "cast(floor(l_partkey/50.0) as int) as r",
    "cast(l_partkey%50 as int) as c",
    "cast(l_shipdate as date) as obs_date",
    "case when l_quantity=50 then 65535 else 200+cast(l_quantity*20 as int) end as b2",
    "300+cast(round(l_tax*100) as int)*150 as b4",
    "1500+cast(floor(l_extendedprice/35) as int) as b8",
    "800+cast(round(l_discount*100) as int)*200 as b11",
    "500+l_linenumber*200 as b12",
    "case when l_returnflag='R' then 1 when l_returnflag='A' and l_linestatus='O' then 2 else 0 end as flg",
]
V_GRID = [
    "p_partkey as pixel_id",
    "cast(floor(p_partkey/50.0) as int) as r",
    "cast(p_partkey%50 as int) as c",
    "p_retailprice as elevation",
    "cast((p_partkey*7)%3 as int) as cls1",
    "case p_size%5 when 0 then 255 when 1 then 1 when 2 then 1 else 2 end as cls2",
    "case when p_size>10 then 1 else 0 end as forest",
    "cast((p_partkey%13) as int) as eco",
    "cast((p_partkey*37)%256 as int) as prob",
    # 1 cloud, 2 snow, 3 water; clear on a sparse lattice
    "case when (p_partkey*7919)%97=0 then 0 else cast(1+p_partkey%3 as int) end as flg",
]
V_BOX = [
    "s_suppkey as seq",
    "cast((s_suppkey*37)%45 as int) as x0",
    "cast((s_suppkey*37)%45+1+s_suppkey%6 as int) as x1",
    "cast((s_suppkey*11)%35 as int) as y0",
    "cast((s_suppkey*11)%35+1+s_suppkey%4 as int) as y1",
    "cast(s_nationkey%2+1 as int) as value",
]
V_STATE = ["user_id as tile_idx", "max(ts) as last_update", "max(case when event_type='purchase' and value>250 then 1 else 0 end) as completed"]
V_PATH = (
    "concat('/data/', cast(year(o_orderdate) as varchar(4)), '/', lpad(cast(month(o_orderdate) as varchar(2)),2,'0'), "
    "'-01_plus_minus_30_days/s2/s2_EPSG2154_', cast(100000+50000*n_nationkey as varchar(10)), '_', "
    "cast(6000000+50000*n_regionkey as varchar(10)), '.tif') as path"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*V_OBS)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*V_GRID)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*V_BOX)


def tile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        _expr(V_STATE[1]), _expr(V_STATE[2])
    ).withColumnRenamed("user_id", "tile_idx")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    # Month by month and nation by nation there are few: reduce before the small join.
    keys = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderdate", "c_nationkey").distinct()
    return keys.join(nation, keys.c_nationkey == nation.n_nationkey).selectExpr(V_PATH).distinct()


def _expr(sql: str):
    from pyspark.sql import functions as F

    return F.expr(sql)


#: The same views as common table expressions for the oracles.
CTE = {
    "v_obs": f"select {', '.join(V_OBS)} from lineitem",
    "v_grid": f"select {', '.join(V_GRID)} from part",
    "v_box": f"select {', '.join(V_BOX)} from supplier",
    "v_state": f"select {', '.join(V_STATE)} from events group by user_id",
    "v_path": f"select distinct {V_PATH} from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey",
}
