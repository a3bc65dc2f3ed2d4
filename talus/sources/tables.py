"""Table scans, and the catalogue relations laid over the star-schema test tables.

The engine's operators take plain DataFrames; this module only says which columns of the given tables play
which role. Every relation covers its whole base table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

MODEL_VERSION = "v1"
FILTER_VERSION = "best"


# Declared schemas save the job that reads a footer for every scan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
}


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """Partitioned read of a relational table through any JDBC driver on the class path."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        .options(**options)
        .load()
    )


class Catalogue:
    """Areas, routes, photos, vectors, scores and review events seen through the given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, self.folder, name)

    @cached_property
    def areas(self) -> DataFrame:
        """Three levels: region, nation, customer. Customers in debt are still unreviewed."""
        url = F.concat(F.lit("https://x/area/"), F.col("id").cast("string"), F.lit("/"), F.col("name"))
        regions = self.table("region").select(
            F.col("r_regionkey").cast("long").alias("id"),
            F.lit(None).cast("long").alias("parent_id"),
            F.lower("r_name").alias("name"),
            F.lit("approved").alias("status"), F.lit(None).cast("long").alias("submitted_by"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("double").alias("balance"),
        )
        nations = self.table("nation").select(
            (F.lit(100) + F.col("n_nationkey")).cast("long").alias("id"),
            F.col("n_regionkey").cast("long").alias("parent_id"),
            F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("name"),
            F.lit("approved").alias("status"), F.lit(None).cast("long").alias("submitted_by"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("double").alias("balance"),
        )
        customers = self.table("customer").select(
            (F.lit(1000) + F.col("c_custkey")).cast("long").alias("id"),
            (F.lit(100) + F.col("c_nationkey")).cast("long").alias("parent_id"),
            F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("name"),
            F.when(F.col("c_acctbal") < 0, "unreviewed").otherwise("approved").alias("status"),
            F.col("c_nationkey").cast("long").alias("submitted_by"),
            # sent in the order of the balance, a minute a unit
            F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(floor(c_acctbal) as int), 0)").alias("created_at"),
            F.col("c_acctbal").alias("balance"),
        )
        return regions.unionByName(nations).unionByName(customers).withColumn("url", url)

    @cached_property
    def part_tree(self) -> DataFrame:
        """A deep binary tree over the parts, numbered from 1: node n hangs below n div 2, node 1 is the root."""
        numbered = self.table("part").select((F.col("p_partkey") + 1).alias("id"))
        return numbered.select(
            "id", F.when(F.col("id") > 1, F.expr("id div 2")).alias("parent_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name")
        )

    @cached_property
    def routes(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            (F.lit(1000) + F.col("o_custkey")).alias("area_id"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
            F.col("o_orderpriority").alias("grade"),
            F.concat(F.lit("https://x/route/"), F.col("o_orderkey").cast("string")).alias("url"),
            status.alias("type"),
            F.when(F.col("o_totalprice") > 250000, F.lit("long route")).alias("description"),
            F.when(status == "F", "approved").when(status == "O", "unreviewed").otherwise("rejected").alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_custkey").alias("submitted_by"),
        )

    @cached_property
    def images(self) -> DataFrame:
        """Field photos: one per event, on the route numbered like the user."""
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("route_id"),
            F.when(kind == "signup", "admin").otherwise("user").alias("source"),
            F.when(kind == "error", "rejected").when(kind == "view", "unreviewed").otherwise("approved").alias("status"),
            F.col("user_id").alias("submitted_by"),
            F.col("ts").alias("created_at"),
            kind.alias("content"),
        )

    @cached_property
    def route_images(self) -> DataFrame:
        """Catalogue photos: one per document, ten consecutive documents to a route."""
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.expr("doc_id div 10").alias("route_id"),
            F.concat(F.lit("https://x/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("_large.jpg?c=1")).alias("image_url"),
            F.col("text").alias("content"),
        )

    @cached_property
    def image_embeddings(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("image_id"), F.lit(MODEL_VERSION).alias("model_version"), "embedding", "label"
        )

    @cached_property
    def route_image_embeddings(self) -> DataFrame:
        return self.image_embeddings.withColumnRenamed("image_id", "route_image_id")

    @cached_property
    def filter_scores(self) -> DataFrame:
        score = ((F.col("doc_id") * 37) % 1000) / F.lit(1000.0)
        return self.table("labels").select(
            F.col("doc_id").alias("route_image_id"),
            F.lit(FILTER_VERSION).alias("filter_model_version"),
            score.alias("score"),
            score.cast("float").alias("raw_score"),
            (F.col("quality") == 1).alias("keep"),
        )

    @cached_property
    def label_queries(self) -> DataFrame:
        """One query vector per label: the mean of the label's stored vectors."""
        from talus.operators.prototypes import mean_vectors

        return mean_vectors(self.table("embeddings"), "label", "embedding").select(
            F.col("label").cast("long").alias("query_id"), F.col("mean").alias("vector")
        )

    @cached_property
    def review_log(self) -> DataFrame:
        """Every event read as a review decision or a feedback on the image numbered like the user."""
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("user_id").alias("image_id"),
            F.struct("ts", "event_id").alias("seq"),
            F.when(kind.isin("error", "purchase", "signup"), "review").otherwise("feedback").alias("channel"),
            F.when(kind == "error", "reject").when(kind.isin("purchase", "signup"), "approve").alias("action"),
            F.when(kind == "click", F.lit(True)).when(kind == "view", F.lit(False)).alias("confirmed"),
            F.when(kind.isin("purchase", "view", "error"), F.get_json_object("props", "$.k").cast("long")).alias("correct_route_id"),
        )
