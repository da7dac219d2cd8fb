"""The archive's tables, read from the test tables by plain projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["message", "event", "task"]
#: Suppliers and customers are both people; suppliers' ids come after this.
SUPPLIERS = 1_000_000_000


class Archive:
    """Lazy tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def items(self) -> DataFrame:
        kind = F.when(F.col("o_orderstatus") == "O", "message").when(F.col("o_orderstatus") == "F", "event").otherwise("task")
        return self.table("orders").select(F.col("o_orderkey").alias("item_id"), kind.alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred"), F.col("o_orderpriority").alias("subject"))

    @property
    def item_sources(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("source_id")).distinct()

    @property
    def people(self) -> DataFrame:
        c = self.table("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
        s = self.table("supplier").select((F.col("s_suppkey") + SUPPLIERS).alias("person_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
        return c.union(s)

    @property
    def participations(self) -> DataFrame:
        sent = self.table("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("person_id"), F.lit("from").alias("role"))
        got = self.item_sources.select("item_id", (F.col("source_id") + SUPPLIERS).alias("person_id"), F.lit("to").alias("role"))
        return sent.union(got)

    @property
    def folders(self) -> DataFrame:
        """Each order lies in a folder of its customer's segment, within the nation's."""
        c = self.table("customer").join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        c = c.select(F.col("c_custkey").alias("o_custkey"), F.concat_ws("/", "n_name", "c_mktsegment").alias("folder"))
        return self.table("orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("item_id"), "folder")

    @property
    def _lines(self) -> DataFrame:
        return self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    @property
    def tags(self) -> DataFrame:
        """The brands of an order's parts."""
        return self._lines.select(F.col("l_orderkey").alias("item_id"), F.col("p_brand").alias("tag")).distinct()

    @property
    def attachments(self) -> DataFrame:
        """What was returned of an order, by the parts' names."""
        return self._lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("attachment_id"), F.col("p_name").alias("filename"))


#: The same tables as SQL, to stand before a query.
SQL = """items as (select o_orderkey as item_id, case o_orderstatus when 'O' then 'message' when 'F' then 'event' else 'task' end as kind,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as occurred, o_orderpriority as subject from orders),
item_sources as (select distinct l_orderkey as item_id, l_suppkey as source_id from lineitem),
people as (select c_custkey as person_id, c_name as name, c_nationkey as nation from customer
  union all select s_suppkey + 1000000000, s_name, s_nationkey from supplier),
participations as (select o_orderkey as item_id, o_custkey as person_id, 'from' as role from orders
  union all select item_id, source_id + 1000000000, 'to' from item_sources)"""
