"""Operator 4: extendible hashing into shards under a byte limit, with DataFrame functions only.

A row's address is 60 bits of its key's hash, so a key can be looked up in the
directory, and no row moves when files are split in another way. The directory
starts at no bits; a bucket over the limit splits on the next bit, others stay.
So a row's shard is its shortest address prefix whose bucket fits. Bucket sizes
come from a histogram of addresses that is summed at each depth; only buckets
still too large at its last bit are looked at again, with further bits. A key
that exceeds the limit by itself goes on splitting on the bits of its rows'
contents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.llm.runtime import spool

#: Bytes a shard may hold.
LIMIT = 16 << 20
#: Bits of an address: fifteen hexadecimal signs of a digest.
BITS = 60
#: Bits by which one histogram is finer than the shards expected of it.
FINER = 5
#: Equal rows of one key that are numbered in one window partition.
NUMBERED = 1 << 18


def row_bytes(docs: DataFrame, cols: list[str] | None = None) -> Column:
    """Bytes of a row: UTF-8 text of the columns (all by default), 0 for nulls."""
    return sum((F.coalesce(F.octet_length(docs[c].cast("string")), F.lit(0)) for c in cols or docs.columns), F.lit(0)).cast("long")


def bits_of(text: Column) -> Column:
    """The first 60 bits of a text's MD5; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Buckets (``by``, depth, prefix, shard_bytes, shard_rows) that cover the ``address`` space of ``rows`` (``by``, address, bytes, rows).

    Each value of ``by`` has a directory of its own. A bucket over the limit
    remains only if it is one row, or one address.
    """
    done = None
    depth, left, seen = 0, rows, None
    while True:
        total = left.agg(F.sum("bytes")).first()[0] or 0
        if not total and done is not None:
            return done
        span = min(BITS - depth, FINER + math.ceil(math.log2(max(1, total / (max(1, seen or 1) * limit)) + 1)))
        last = depth + span
        fine = left.groupBy(*by, F.shiftrightunsigned("address", BITS - last).alias("p")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        # the sums of each histogram bucket at every depth of this round
        at = fine.select("*", F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("depth"))
        prefix = F.expr(f"shiftrightunsigned(p, {last} - depth)")
        sums = at.groupBy(*by, "depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        sums = spool(sums.withColumn("fits", fits), "directory")
        over = sums.where(~F.col("fits")).select(*by, (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        # a bucket exists if its parent was split (or it is a root of this round)
        born = sums.where("fits").withColumn("up", F.shiftrightunsigned("prefix", 1))
        made = born.join(over, [*by, "depth", "up"], "left_semi").drop("up", "fits")
        if depth == 0:
            made = made.unionByName(born.where("depth = 0").drop("up", "fits"))
        done = made if done is None else done.unionByName(made)
        rest = sums.where(~F.col("fits") & (F.col("depth") == last)).select(*by, F.col("prefix").alias("p"))
        seen = rest.count()
        if not seen:
            return done
        left = left.withColumn("p", F.shiftrightunsigned("address", BITS - last)).join(rest, [*by, "p"], "left_semi")
        left = spool(left.groupBy(*by, "address").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), "left")
        depth = last


def _placed(rows: DataFrame, found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with depth, prefix, shard_bytes and shard_rows of the bucket that holds each address."""
    # the bucket is found on the address's prefix at the depths that the directory has (at most 61 numbers)
    depths = sorted(r[0] for r in found.select("depth").distinct().collect()) or [0]
    at = rows.select("*", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    return at.withColumn("prefix", F.expr(f"shiftrightunsigned(address, {BITS} - depth)")).join(found, [*by, "depth", "prefix"])


def _bits(depth: str, prefix: str) -> Column:
    return F.when(F.col(depth) == 0, F.lit("")).otherwise(F.expr(f"lpad(bin({prefix}), {depth}, '0')"))


def _within_keys(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (key_address, content, row and more) with ``address``: bits of the content and of the number among equal rows of the key.

    Equal rows are numbered in two steps, so no window holds more than a part
    of them; which of them gets which number makes no difference.
    """
    spread = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-total // NUMBERED)))).alias("spread")
    rows = rows.select("*", spread)
    same = ["key_address", "content"]
    counts = rows.groupBy(*same, "spread").count()
    before = W.partitionBy(*same).orderBy("spread").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(*same, "spread", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(W.partitionBy(*same, "spread").orderBy("row")) - 1
    numbered = rows.withColumn("nth", nth).join(firsts, [*same, "spread"])
    return numbered.withColumn("address", bits_of(F.concat_ws(":", "content", (F.col("first") + F.col("nth")).cast("string"))))


def shard(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", cols: list[str] | None = None) -> DataFrame:
    """id, row_bytes, depth, shard (the address prefix in bits, "" for all), shard_bytes, shard_rows of every row.

    ``limit`` bounds each shard's bytes, but for a single larger row, which is
    a shard of its own. Rows of one key share a shard, unless the key's rows
    exceed the limit: then they split on, by content, and equal rows by their
    number. A null key counts as an empty one, nulls have no bytes, ``cols``
    (all by default) are what is weighed, and an empty table has no shards.
    """
    every = F.concat_ws("\x1f", *(F.coalesce(docs[c].cast("string"), F.lit("\x00")) for c in docs.columns))
    rows = docs.select(
        docs[key].alias("id"), bits_of(docs[key].cast("string")).alias("address"), row_bytes(docs, cols).alias("bytes"), F.md5(every.cast("binary")).alias("content"), F.monotonically_increasing_id().alias("row")
    )
    rows = spool(rows, "addresses")
    found = spool(directory(rows.select("address", "bytes", F.lit(1).cast("long").alias("rows")), limit), "shards")
    large = found.where((F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1))
    held = large.agg(F.sum("shard_rows")).first()[0] or 0
    placed = _placed(rows.drop("content", "row"), found if not held else found.join(large, ["depth", "prefix"], "left_anti"))
    out = placed.select("id", "bytes", "depth", _bits("depth", "prefix").alias("shard"), "shard_bytes", "shard_rows")
    if held:
        own = rows.join(large.select(F.col("prefix").alias("address")), "address", "left_semi").withColumnRenamed("address", "key_address")
        own = spool(_within_keys(own, held).select("id", "bytes", "key_address", "address"), "large-keys")
        by = ("key_address",)
        inside = spool(directory(own.select("key_address", "address", "bytes", F.lit(1).cast("long").alias("rows")), limit, by), "shards")
        names = F.concat(F.expr(f"lpad(bin(key_address), {BITS}, '0')"), _bits("depth", "prefix"))
        split = _placed(own, inside, by).select("id", "bytes", (F.col("depth") + BITS).alias("depth"), names.alias("shard"), "shard_bytes", "shard_rows")
        out = out.unionByName(split)
    return out.select(F.col("id").alias(key), F.col("bytes").alias("row_bytes"), "depth", "shard", "shard_bytes", "shard_rows")


def shard_sql(table: str, cols: list[str], limit: int, key: str = "doc_id") -> str:
    """The same in DuckDB's SQL, for tables whose keys each fit the limit."""
    weight = " + ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)), 0)" for c in cols)
    return f"""
        WITH own AS (SELECT {key}, {weight} AS row_bytes, row_number() OVER () AS nr,
                            CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15) AS BIGINT) AS address FROM {table}),
             cuts AS (SELECT own.*, d, address >> ({BITS} - d) AS prefix FROM own, (SELECT unnest(range({BITS + 1})) AS d)),
             sums AS (SELECT d, prefix, sum(row_bytes) AS shard_bytes, count(*) AS shard_rows FROM cuts GROUP BY d, prefix),
             least AS (SELECT nr, min(d) AS d FROM cuts JOIN sums USING (d, prefix) WHERE shard_bytes <= {limit} OR shard_rows = 1 OR d = {BITS} GROUP BY nr)
        SELECT {key}, row_bytes, CAST(d AS INTEGER) AS depth, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), CAST(d AS INTEGER)) END AS shard,
               CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
        FROM cuts JOIN least USING (nr, d) JOIN sums USING (d, prefix)"""
