"""Queries of stored tables: versions with tokens, files by owner, pages at any depth. Each writes what it needs of the given tables to the shared folder and reads it back."""

from pyspark.sql import functions as F

from sparkfolio.sources import store
from sparkfolio.sources.tables import shared_folder, table

QUERIES = {}


def query(sql):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


def _committed(spark, sf_dir):
    """Orders by customer as version 1; then two thirds of the customers are offered new rows (prices one up, pending orders gone), half of them with stale tokens."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    kept = store.Store(spark, shared_folder(spark), buckets=16)
    kept.commit(rows, rows.select("task_id", F.lit(None).cast("string").alias("token")).distinct(), "import")
    offered = kept.tokens().where("task_id % 3 < 2").withColumn("token", F.when(F.col("task_id") % 3 == 0, F.col("token")).otherwise("stale"))
    _, refused = kept.commit(rows.where("status <> 'P'").withColumn("price", F.col("price") + 1), offered, "canonicalization")
    return kept, refused


@query("SELECT o_custkey AS task_id, o_orderkey AS id, o_orderstatus AS status, o_totalprice + (o_custkey % 3 = 0)::INT AS price FROM orders WHERE o_custkey % 3 > 0 OR o_orderstatus <> 'P'")
def store_commits(spark, sf_dir):
    return _committed(spark, sf_dir)[0].read()


@query("SELECT DISTINCT o_custkey AS task_id FROM orders WHERE o_custkey % 3 = 1")
def store_refused(spark, sf_dir):
    return _committed(spark, sf_dir)[1]


@query("SELECT o_custkey AS task_id, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def store_rollback(spark, sf_dir):
    kept = _committed(spark, sf_dir)[0]
    return kept.read(kept.rollback(kept.before_last("canonicalization")))


@query("SELECT event_type AS business_type, user_id AS business_id, event_id, value FROM events WHERE event_type IN ('view', 'error') AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def owned_files(spark, sf_dir):
    path = f"{shared_folder(spark)}/files"
    store.write_owned(table(spark, sf_dir, "events").select(F.col("event_type").alias("business_type"), F.col("user_id").alias("business_id"), "event_id", "value"), path, 16)
    owners = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.explode(F.array(F.lit("view"), F.lit("error"))).alias("business_type"), F.col("c_custkey").alias("business_id"))
    return store.owned_by(spark, path, owners, 16).select("business_type", "business_id", "event_id", "value")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, o_totalprice, total FROM o WHERE n >= (total - 1) // 25 * 25""")
def page_at(spark, sf_dir):
    """The last page of all orders, the dearest first."""
    rows, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), f"{shared_folder(spark)}/pages"
    store.write_pages(rows, path, [("o_totalprice", True), ("o_orderkey", False)])
    return store.read_page(spark, path, (rows.count() + 24) // 25, 25)
