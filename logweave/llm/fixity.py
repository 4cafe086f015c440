"""Merkle fixity audit of WARC replicas.

A replica's index lists its records: file, offset, length and the hash of the record's bytes. Records are
leaves; leaves of an offset range of ``RANGE`` bytes form a node, ``FANOUT`` neighbouring ranges the node
above it, up to a root for each file. Node hashes cover their children in order of offset. Two replicas
are compared from the roots down, and only children of nodes that differ are looked at, level by level, so
the lower levels are touched where something is wrong only.

Defined cases: null page ids and urls are written as empty header values; null html is an empty body; equal
rows are records of their own, one after another; a replica without rows lacks every record; records with
the same file and offset in an index are one leaf over all of their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import keep

RANGE = 65_536
FANOUT = 16
PAGES_PER_FILE = 512


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record, as text."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def placed(pages: DataFrame, copy_hash: Column | None = None) -> DataFrame:
    """page_id, file, offset, length, hash of each page's record; a file holds PAGES_PER_FILE page ids in order.

    copy_hash: the hash that a replica has at the same place, null if it lacks the record; returned as copy_hash.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    # equal rows are counted first, so a page repeated many times is one row where offsets are summed up
    other = copy_hash if copy_hash is not None else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("hash"), other.alias("copy_hash"))
    rows = rows.groupBy("page_id", "length", "hash", "copy_hash").agg(F.count("*").alias("n"))
    file = F.format_string("pages-%08d.warc", F.floor(F.col("page_id") / PAGES_PER_FILE))
    order = Window.partitionBy("file").orderBy("page_id", "hash", "length", "copy_hash")
    rows = rows.withColumn("file", F.when(F.col("page_id").isNull(), F.format_string("unnumbered-%03d.warc", F.pmod(F.xxhash64("hash"), F.lit(256)))).otherwise(file))
    rows = rows.withColumn("base", F.sum(F.col("n") * F.col("length")).over(order) - F.col("n") * F.col("length"))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return copies.select("page_id", "file", (F.col("base") + F.col("copy") * F.col("length")).alias("offset"), "length", "hash", "copy_hash")


def tree(index: DataFrame, levels: int) -> list[DataFrame]:
    """file, node, hash for each level, offset ranges first and roots last; level -1 in front: the leaves, by offset."""
    leaves = index.groupBy("file", "offset").agg(F.sha2(F.concat_ws("", F.min("hash"), F.max("hash"), F.count("hash").cast("string"), F.min("length").cast("string"), F.max("length").cast("string")), 256).alias("hash"))
    out = [leaves.withColumnRenamed("offset", "node")]
    for width in [RANGE] + [FANOUT] * levels:
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        joined = F.concat_ws("", F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["hash"], F.lit(";"))))
        out.append(out[-1].groupBy("file", F.floor(F.col("node") / width).cast("long").alias("parent")).agg(F.sha2(joined, 256).alias("hash")).withColumnRenamed("parent", "node"))
    return out


def levels_for(longest: int) -> int:
    """Levels above the offset ranges until one root covers ``longest`` bytes."""
    ranges, levels = longest // RANGE + 1, 0
    while ranges > 1:
        ranges, levels = -(-ranges // FANOUT), levels + 1
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file, offset, expected_hash, found_hash, finding (changed, missing or unexpected) for each record that differs."""
    longest = primary.select("offset").union(replica.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = levels_for(longest)
    trees = [[keep(level, "tree") for level in tree(index, levels)] for index in (primary, replica)]
    suspect = None
    for depth, (a, b) in reversed(list(enumerate(zip(*trees)))):
        if suspect is not None:
            width = RANGE if depth == 0 else FANOUT
            parent = F.floor(F.col("node") / width).cast("long")
            a, b = (x.withColumn("parent", parent).join(suspect, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        both = a.withColumnRenamed("hash", "expected_hash").join(b.withColumnRenamed("hash", "found_hash"), ["file", "node"], "full")
        differs = both.where(~F.col("expected_hash").eqNullSafe(F.col("found_hash")))
        suspect = keep(differs.select("file", F.col("node").alias("parent")), "suspect") if depth else None
    finding = F.when(F.col("expected_hash").isNull(), "unexpected").when(F.col("found_hash").isNull(), "missing").otherwise("changed")
    return differs.select("file", F.col("node").alias("offset"), "expected_hash", "found_hash", finding.alias("finding"))


def damaged(html: Column) -> Column:
    """A body whose last character was changed."""
    return F.when(F.length(html) > 0, F.concat(F.substring(html, F.lit(1), F.length(html) - 1), F.when(F.substring(html, -1, 1) == "!", "?").otherwise("!"))).otherwise(html)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica of ``pages`` in which one page in 97 was changed and one in 101 is lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = F.when(F.col("page_id") % 97 == 5, damaged(F.col("html"))).otherwise(F.col("html"))
    lost = F.coalesce(F.col("page_id") % 101 == 7, F.lit(False))
    both = keep(placed(pages, F.when(~lost, F.sha2(record(F.col("page_id"), F.col("url"), html), 256))), "replicas")
    primary = both.select("file", "offset", "length", "hash")
    replica = both.where("copy_hash is not null").select("file", "offset", "length", F.col("copy_hash").alias("hash"))
    return audit(primary, replica).join(both.select("file", "offset", "page_id", "length"), ["file", "offset"])


#: The same findings straight from the two copies of each page.
ORACLE = """
with parts as (
  select page_id, coalesce(url, '') as u, coalesce(html, '') as h,
         case when page_id % 97 = 5 and length(html) > 0 then substr(html, 1, length(html) - 1) || case when right(html, 1) = '!' then '?' else '!' end
              else coalesce(html, '') end as h2
  from pages),
records as (
  select page_id, page_id % 101 = 7 as lost,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10)
         || h || chr(13) || chr(10) || chr(13) || chr(10) as r,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h2) || chr(13) || chr(10) || chr(13) || chr(10)
         || h2 || chr(13) || chr(10) || chr(13) || chr(10) as r2
  from parts),
spots as (
  select *, 'pages-' || lpad(cast(page_id // 512 as varchar), 8, '0') || '.warc' as file, cast(strlen(r) as bigint) as length from records),
index as (
  select *, cast(sum(length) over (partition by file order by page_id) - length as bigint) as "offset" from spots),
leaf as (
  select file, "offset", page_id, length, lost,
         sha256(sha256(r) || sha256(r) || '1' || length || length) as expected_hash,
         sha256(sha256(r2) || sha256(r2) || '1' || length || length) as found_hash
  from index)
select file, "offset", page_id, length, expected_hash, case when not lost then found_hash end as found_hash,
       case when lost then 'missing' else 'changed' end as finding
from leaf where lost or expected_hash <> found_hash
"""
