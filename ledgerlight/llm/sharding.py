"""Sharding by extendible hashing.

Documents hash to 64 bits. The directory starts with one bucket and only buckets over the byte limit split, on the next
bit of the hash, until each fits. Splitting is decided for ``step`` bits at a time from one map-side combined histogram of
(prefix, bytes) over the documents of buckets still too large; documents are read and shuffled in no other way. The
directory has one row per shard and is joined to the documents, never collected.

A single document over the limit cannot be split: it ends alone in a shard, marked ``oversize``. Rows equal in doc_id and
text share all 64 bits; where they exceed the limit together, 64 more bits come from each row's place, which splits them.

Nulls: a null text has 0 bytes; a null doc_id hashes by its text. An empty table gives no rows. Other columns are kept
by write_shards and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh_dir, materialize

LIMIT = 4 << 20
STEP = 12


def hashed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, n_bytes, bits): ``bits`` is the hash as a string of 128 binary digits, the second half from the row's place.

    ``carry`` adds the whole row as ``row``."""
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce("text", F.lit("")))
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(5))
    bits = F.concat(F.lpad(F.bin(h), 64, "0"), F.lpad(F.bin(place), 64, "0"))
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), bits.alias("bits"), *([F.struct("*").alias("row")] if carry else []))


def shards(docs: DataFrame, limit: int = LIMIT, step: int = STEP, carry: bool = False) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, oversize); ``shard`` is the bucket's hash prefix; ``carry`` adds the row."""
    row = ["row"] if carry else []
    rows = materialize(hashed(docs, carry), "hashes")
    live, depth, done = rows.withColumn("top", F.lit("")), 0, []
    while True:
        cells = live.groupBy("top", F.substring("bits", 1, depth + step).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = materialize(cells, "cells")
        # Every prefix of each cell, with its sums: the nodes of the tree below the buckets that are too large.
        nodes = cells.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(depth + step)))).groupBy("d", F.expr("substring(cell, 1, d)").alias("node")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        nodes = nodes.withColumn("fits", (F.col("b") <= limit) | (F.col("n") == 1))
        own = cells.select("cell", F.explode(F.sequence(F.lit(depth), F.lit(depth + step))).alias("d")).withColumn("node", F.expr("substring(cell, 1, d)"))
        first = own.join(nodes, ["d", "node"]).where("fits").groupBy("cell").agg(F.min(F.struct("d", "node", "b", "n")).alias("s"))
        first = materialize(first.select(F.col("cell"), F.col("s.node").alias("shard"), F.col("s.d").alias("depth"), F.col("s.b").alias("shard_bytes"), F.col("s.n").alias("shard_docs")), "directory")
        placed = live.withColumn("cell", F.substring("bits", 1, depth + step)).join(first, "cell", "left")
        done.append(placed.where("shard is not null").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", *row))
        depth += step
        rest = placed.where("shard is null")
        if depth >= 120 or not cells.join(first, "cell", "left_anti").take(1):
            break
        live = materialize(rest.select("doc_id", "n_bytes", "bits", *row, F.substring("bits", 1, depth).alias("top")), "live")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.withColumn("oversize", F.col("shard_bytes") > limit)


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard: its prefix, local depth, bytes and documents."""
    return assigned.groupBy("shard", "depth", "shard_bytes", "shard_docs", "oversize").agg(F.min("doc_id").alias("first_doc_id"))


def write_shards(docs: DataFrame, where: str, limit: int = LIMIT) -> DataFrame:
    """Write all columns of ``docs`` as Parquet, one folder per shard; returns the directory of what was read back."""
    rows = shards(docs, limit, carry=True).select("row.*", F.concat(F.lit("p"), "shard").alias("shard"))  # "" and 01 are no folder names
    rows.repartition("shard").write.partitionBy("shard").parquet(where)
    return directory(read_shards(docs, where, limit))


def read_shards(docs: DataFrame, where: str, limit: int = LIMIT) -> DataFrame:
    """The rows of shards() from the files of write_shards(): bytes and documents are those found in them."""
    rows = docs.sparkSession.read.schema(StructType([*docs.schema, StructField("shard", StringType())])).parquet(where)
    rows = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.expr("substring(shard, 2)").alias("shard"))
    sums = rows.groupBy("shard").agg(F.length("shard").alias("depth"), F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    rows = rows.join(sums, "shard")
    return rows.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversize"))


def op5_extendible_hashing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = fresh_dir(spark, "shards") + "/rows"
    write_shards(docs, where)
    return read_shards(docs, where)
