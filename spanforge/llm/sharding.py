"""Sharding by extendible hashing, in DataFrame functions only.

The directory is indexed by prefixes of a 60-bit hash of the document id. A bucket that is
above the byte limit splits on its next bit, others never do, so a shard is the shortest
prefix whose bucket fits. Bytes are first summed per fine prefix (about 16 per shard), and
these sums are added up to every shorter prefix in one aggregation; only documents in fine
buckets that are still too large (a skew of sizes) are looked at one by one, down to the last
bit. Rows that share all 60 bits, i.e. repeated ids, go on splitting on the hash of their row
number. A document that is larger than the limit gets a shard of its own: the prefix at which
it is alone.

Odd rows: null or empty text has 0 bytes; a null doc_id hashes as ''; repeated rows count and
are placed each on its own; an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

HASH_BITS = 60


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def _leaves(sums: DataFrame, h: str, base: int, depth: int, limit: int) -> DataFrame:
    """sums(path, h, bytes, n) -> (path, h, level): the shortest prefix of h, from base to depth
    bits, whose bucket fits (or holds one row); level is null where none does."""
    levels = F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("level")
    cut = F.expr(f"shiftright({h}, {depth} - level)")
    every = sums.select("path", h, "bytes", "n", levels).withColumn("prefix", cut)
    bucket = every.groupBy("path", "level", "prefix").agg(F.sum("bytes").alias("b"), F.sum("n").alias("k"))
    fit = bucket.where(f"b <= {limit} OR k = 1").select("path", "level", "prefix")
    own = every.select("path", h, "level", "prefix").distinct().join(fit, ["path", "level", "prefix"])
    return own.groupBy("path", h).agg(F.min("level").alias("level"))


def shard(docs: DataFrame, *, limit: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, shard, depth) for every row of docs(doc_id, text); shard is the bit
    string of the prefix ('' if one shard holds all), no shard holds more than limit bytes
    unless it is a single document."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows.withColumn("h", hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    fine = min(40, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)

    rows = rows.withColumn("path", F.lit("")).withColumn("f", F.expr(f"shiftright(h, {HASH_BITS - fine})"))
    sums = materialize(rows.groupBy("path", "f").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")))
    leaves = _leaves(sums, "f", 0, fine, limit)
    placed = materialize(rows.join(leaves.hint("merge"), ["path", "f"], "left"))

    def bits(h, width, level):
        return F.expr(f"substring(lpad(bin({h}), {width}, '0'), 1, {level})")

    done = placed.where("level is not null").select("doc_id", "n_bytes", bits("h", HASH_BITS, "level").alias("shard"), F.col("level").alias("depth"))

    # fine buckets above the limit: on with single rows, then with the hash of the row number
    rest = placed.where("level is null").drop("level", "path").withColumn("path", F.col("f").cast("string"))
    rest = rest.withColumnRenamed("n_bytes", "bytes").withColumn("n", F.lit(1))
    at = _leaves(rest.groupBy("path", "h").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "h", fine, HASH_BITS, limit)
    deep = materialize(rest.join(at.hint("merge"), ["path", "h"], "left"))
    done2 = deep.where("level is not null").select("doc_id", F.col("bytes").alias("n_bytes"), bits("h", HASH_BITS, "level").alias("shard"), F.col("level").alias("depth"))
    same = deep.where("level is null").drop("level", "path").withColumn("path", F.col("h").cast("string")).withColumn("g", hash60(F.col("row").cast("string")))
    end = _leaves(same.select("path", "g", "bytes", F.lit(1).alias("n")), "g", 0, HASH_BITS, limit)
    tail = same.join(end, ["path", "g"], "left")
    name = F.concat(bits("h", HASH_BITS, HASH_BITS), bits("g", HASH_BITS, "level"))
    done3 = tail.select("doc_id", F.col("bytes").alias("n_bytes"), name.alias("shard"), (F.lit(HASH_BITS) + F.col("level")).alias("depth"))
    return done.unionByName(done2).unionByName(done3)


def _sql(limit: int = 1 << 20) -> str:
    return f"""
WITH docs AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
levels AS (SELECT doc_id, n_bytes, h, level, h >> (60 - level) AS prefix FROM docs, (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS level)),
fit AS (SELECT level, prefix FROM levels GROUP BY ALL HAVING sum(n_bytes) <= {limit} OR count(*) = 1),
leaf AS (SELECT doc_id, n_bytes, h, min(level) AS depth FROM levels JOIN fit USING (level, prefix) GROUP BY ALL)
SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, depth FROM leaf"""


SQL = _sql()
