"""Connected components by alternating stars, as joins and aggregates; nothing is gathered on the driver but a count and a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed, met

#: Edges of a partition, at least: few edges make few files.
PART_EDGES = 20_000
#: Edges beyond which a node of many edges isn't left to one task.
MANY = 2_000_000


def _starred(edges: DataFrame, smaller_only: bool, many: bool) -> DataFrame:
    """Large star: each node hands its least neighbour to its larger ones. Small star: to its smaller ones and itself."""
    both = edges.select("u", "v") if smaller_only else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    handed = met(both, least, ["u"], "n") if many else both.join(least, "u")
    if smaller_only:
        out = handed.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    else:
        out = handed.where("v > u").select("v", "m")
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b", *, most: int = MANY) -> DataFrame:
    """doc_id and component (its least member) of each node that an edge touches. Edges in any direction; repeated ones and loops count for nothing."""
    now = checkpointed(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
    before = None
    while (seen := tuple(now.agg(mark).first()[0])) != before:
        before = seen
        many = seen[0] > most
        parts = max(1, -(-seen[0] // PART_EDGES))  # a star has no more edges than the graph, nodes aside
        now = checkpointed(_starred(_starred(now.coalesce(parts), smaller_only=False, many=many).coalesce(parts), smaller_only=True, many=many).coalesce(parts))
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())
