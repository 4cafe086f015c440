"""Exact duplicates by recipes of content-defined chunks, on built-in functions only.

A text is normalised and cut where its own bytes say so: a chunk ends after three bytes that fall into three fixed
classes, at least ``LEAST`` and at most ``MOST`` bytes after its start, so equal stretches are cut alike wherever they
stand. A chunk's identifier is its 64-bit hash and a rank among the different chunks of that hash. The distinct chunks
are the only text that is shuffled, each once a task: grouping them by hash and content shows whether a hash stands for
one content. Where it does, the rank is 0; chunks of a hash that stands for several are told apart by their content. A
document is then its recipe, the ordered list of its chunks' identifiers, of about a hundredth of its length, and
documents are equal when their recipes are. Recipes are counted by (recipe, doc_id) first, so a group of copies of any
size is summed up in many tasks; groups of one row never meet the rows again.

Defined cases: a null text is empty and equals other empty texts; an empty text has an empty recipe; of rows that
repeat a text and the smallest doc_id exactly one stays; a null doc_id counts as larger than any other (keep_id is null
where a group has no other); columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import keep

#: Bytes of a chunk: it is not cut earlier, and always cut later.
LEAST, MOST = 256, 8192
BLANKS = r"[\x20\x09-\x0D]+"


def byte_class(number: int) -> str:
    """A sixth of all byte values, spread over them; another one for each number."""
    return "[" + "".join(f"\\x{b:02X}" for b in range(256) if (b * 151 + number * 89) % 256 < 43) + "]"


CHUNK = f"(?s).{{{LEAST},{MOST}}}?{byte_class(1)}{byte_class(2)}{byte_class(3)}|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def chunks(text: Column) -> Column:
    """The chunks of a text in order; each character of a chunk stands for one byte of the text in UTF-8."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def clashing(docs: DataFrame, bits: int = 64) -> DataFrame:
    """id, chunk, rank (from 1) of the distinct chunks whose identifier another chunk has too."""
    pieces = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    distinct = pieces.select(identifier(F.col("chunk"), bits).alias("id"), "chunk").distinct()
    several = distinct.groupBy("id").count().where("count > 1").select("id")
    # an empty right side, as nearly always, ends the second pass before it reads anything
    found = distinct.join(several, "id", "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """row (a number of its own), doc_id, text_sha256, ids, ranks (empty where all are 0) of every row of ``docs``."""
    text = normalised(F.col("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    own = F.transform(chunks(F.col("text")), lambda c: identifier(c, bits))
    none = F.array().cast("array<int>")
    plain = keep(rows.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"), own.alias("ids"), none.alias("ranks")), "recipes")
    clash = keep(clashing(docs, bits), "clashing_chunks")
    if clash.isEmpty():
        return plain
    hit = plain.select("row", F.explode("ids").alias("id")).join(clash.select("id").distinct(), "id", "left_semi").select("row").distinct()
    pieces = rows.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
    ranked = pieces.withColumn("id", identifier(F.col("chunk"), bits)).join(clash, ["id", "chunk"], "left").groupBy("row", "doc_id", "text_sha256")
    parts = ranked.agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("parts"))
    told = parts.where(F.exists("parts", lambda p: p["rank"] > 0)).select((-1 - F.col("row")).alias("row"), "doc_id", "text_sha256", F.col("parts.id").alias("ids"), F.col("parts.rank").alias("ranks"))
    return keep(plain.join(hit, "row", "left_anti").unionByName(told), "verified_recipes")


def duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row."""
    rows, key = recipes(docs, bits), ["ids", "ranks"]
    by_doc = rows.groupBy(*key, "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("k"))
    groups = by_doc.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"), F.sum("k").alias("group_size"))
    # written first: a join of two plain shuffles, whose large partitions are split
    several = keep(groups.where("group_size > 1"), "groups")
    found = rows.join(several, key, "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", F.size("ids").cast("long").alias("n_chunks"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chunks")


ORACLE = r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id) = 1 as kept, sha256(t) as text_sha256
from texts
"""
