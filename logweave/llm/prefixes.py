"""A trie of conversations by their common first turns, built level by level.

Depth by depth, the conversations that still share their node meet their next turn and are grouped by (parent node, next
turn); a group is a node and is named by its smallest conv_id. A conversation that is alone in its node leaves the
loop: all its later nodes are a chain of its own, written in one go. After the last level the nodes that several
conversations share are joined with their children level by level, deepest first, which sums up children, leaves and
saved words. Every level is written to the shared folder, so a plan never grows with the depth. Turns travel as the
SHA-256 of role and text and the number of words, not as texts.

The loop runs as many levels as two conversations share at most, two small jobs each. Turns are numbered by sums over
blocks of turn numbers, so one conversation of any length is dealt to many tasks. The conversations that end in a node
are listed in ascending pieces of at most ``PIECE`` ids, which one task a node reads one after another, so the list is
never held as a whole.

Defined cases: rows with a null conv_id take no part; a null turn comes first, a null role or text is empty; rows of one
turn number are in order of role and digest, and repeated rows are turns of their own; an empty table has no node, not
even a root; a conversation without turns is a member of the root only; columns besides conv_id, turn, role and text
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import keep, put, scratch

#: Turn numbers that one task puts in order; ids in one piece of a list.
BLOCK, PIECE = 256, 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations whose first turns are shared when they are rebuilt, and most turns that are.
FAMILY, MOST_SHARED = 20, 4


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, words of each turn, in order of turn number."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    block = F.floor(F.col("turn") / BLOCK)
    rows = turns.where("conv_id is not null").select("conv_id", "turn", block.alias("block"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "digest")
    numbered = rows.withColumn("n", F.row_number().over(inner))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block"))) - F.col("k")
    base = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), before.alias("base"))
    return numbered.join(base, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).select("conv_id", (F.col("base") + F.col("n")).alias("place"), "digest", "words")


def sharing(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of the first of their family: (conv_id, size) and (conv_id, place, digest, words).

    A conversation c takes the first h = crc32(c) % 4 turns of c - c % 20 and goes on with its own after its first h.
    """
    own = keep(placed(turns), "turns")
    convs = turns.where("conv_id is not null").select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED)
    first = own.where(F.col("place") < MOST_SHARED).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    asked = convs.where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    lent = asked.join(first, "base").where("place <= h").select("conv_id", "place", "digest", "words")
    taken = lent.groupBy("conv_id").agg(F.count("*").alias("taken"))
    heads = convs.join(taken, "conv_id", "left").select("conv_id", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    rest = own.join(heads, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "words")
    built = keep(lent.unionByName(rest).sortWithinPartitions("place"), "rebuilt")
    sizes = built.groupBy("conv_id").agg(F.max("place").alias("size"))
    return keep(convs.select("conv_id").join(sizes, "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "conversations"), built


def list_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each node's comma-joined pieces, which come one after another in order."""
    at, digest = None, None
    for batch in batches:
        done = []
        for depth, conv, piece in zip(batch["depth"], batch["conv_id"], batch["piece"]):
            if (depth, conv) == at:
                digest.update(b"," + piece.encode())
            else:
                if at:
                    done.append((*at, digest.hexdigest()))
                at, digest = (depth, conv), hashlib.sha256(piece.encode())
        if done:
            yield pd.DataFrame(done, columns=["depth", "conv_id", "ends_sha256"])
    if at:
        yield pd.DataFrame([(*at, digest.hexdigest())], columns=["depth", "conv_id", "ends_sha256"])


def ends(ending: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256 of nodes, from (depth, conv_id, member) of each conversation that ends there."""
    block = F.floor(F.col("member") / PIECE)
    pieces = ending.groupBy("depth", "conv_id", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("piece"))
    ordered = pieces.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "block")
    return ordered.select("depth", "conv_id", "piece").mapInPandas(list_hashes, "depth long, conv_id long, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, size (its number of turns). turns: conv_id, place (from 1 to size), digest, words.
    """
    spark = conversations.sparkSession
    place, nothing, one, none = scratch(spark), F.sha2(F.lit(""), 256), F.lit(1).cast("long"), F.lit(0).cast("long")

    def table(name: str, columns: str) -> Callable[..., DataFrame]:
        """Writes the rows of a depth; without rows, reads those of a depth or of all."""

        def at(depth: int | None = None, rows: DataFrame | None = None) -> DataFrame:
            if rows is not None:
                put(rows, f"{place}/{name}/depth={depth}")
            found = spark.read.schema(f"{columns}, depth long").parquet(f"{place}/{name}")
            return found if depth is None else found.where(F.col("depth") == depth)

        return at

    nodes = table("nodes", "conv_id long, parent long, digest binary, n_convs long, words long")
    live = table("live", "conv_id long, size long, node long")
    rolled = table("rolled", "conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long")

    top = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = nodes(0, top.select("conv_id", F.lit(None).cast("long").alias("parent"), F.lit(b"").alias("digest"), "n_convs", none.alias("words"))).first()
    live(0, conversations.select("conv_id", "size", F.lit(root and root["conv_id"]).cast("long").alias("node")))
    several, depth = nodes(0), 0
    while not several.isEmpty():
        depth += 1
        # the conversations that share a node, with their next turn
        step = turns.where(F.col("place") == depth).join(live(depth - 1).where(F.col("size") >= depth).drop("depth"), "conv_id")
        several = nodes(depth, step.groupBy(F.col("node").alias("parent"), "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))).where("n_convs > 1")
        again = several.select(F.col("parent").alias("node"), "digest", F.col("conv_id").alias("child"))
        live(depth, step.join(again, ["node", "digest"]).select("conv_id", "size", F.col("child").alias("node")))

    alone = (F.col("n_convs") == 1) & F.col("parent").isNotNull()
    for level in range(depth, -1, -1):
        own = nodes(level).where(~alone)
        if level == depth:
            below = own.where("false").select("parent", none.alias("n_leaves"), none.alias("saved_tokens"))
        else:
            below = rolled(level + 1).select("parent", "n_leaves", "saved_tokens").unionByName(nodes(level + 1).where(alone).select("parent", one.alias("n_leaves"), none.alias("saved_tokens")))
        sums = below.groupBy(F.col("parent").alias("over")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        summed = own.join(sums, F.col("conv_id") == F.col("over"), "left")
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", none)
        rolled(level, summed.select("conv_id", "parent", "n_convs", F.coalesce("n_children", none).alias("n_children"), F.coalesce("leaves", one).alias("n_leaves"), saved.alias("saved_tokens")))

    lists = ends(live().where("size = depth").select("depth", F.col("node").alias("conv_id"), F.col("conv_id").alias("member")))
    tops = rolled().join(lists, ["depth", "conv_id"], "left").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    # from where a conversation is alone, its turns are its nodes
    chains = nodes().where(alone).select("conv_id", "parent", F.col("depth").alias("start")).join(conversations, "conv_id")
    last = F.col("place") == F.col("size")
    chained = turns.select("conv_id", "place").join(keep(chains, "chains"), "conv_id").where("place >= start").select(
        "conv_id", F.col("place").alias("depth"), F.when(F.col("place") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return tops.unionByName(chained)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, rebuilt on their families' first turns."""
    return trie(*sharing(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: crc32 of a text of ASCII characters.
CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint),
    lambda state, byte: list_reduce(range(8), lambda s, k: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end, xor(state, byte)), 4294967295))"""

ORACLE = rf"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null),
convs as (select conv_id, {CRC_SQL.format(text="conv_id::varchar")} % {MOST_SHARED} as h from (select distinct conv_id from conversations where conv_id is not null)),
lent as (select c.conv_id, o.place, o.role, o.text from convs c join own o on o.conv_id = c.conv_id - c.conv_id % {FAMILY} and o.place <= c.h),
taken as (select c.conv_id, h, (select count(*) from lent l where l.conv_id = c.conv_id) as n from convs c),
built as (
  select * from lent union all
  select o.conv_id, o.place - t.h + t.n, o.role, o.text from own o join taken t using (conv_id) where o.place > t.h),
paths as (
  select conv_id, place as depth, text, list(struct_pack(r := role, t := text)) over (partition by conv_id order by place rows unbounded preceding) as path from built
  union all select conv_id, 0, '', [] from convs),
named as (select *, min(conv_id) over (partition by depth, path) as node, count(*) over (partition by depth, path) as n, max(depth) over (partition by conv_id) as size from paths),
nodes as (
  select node as conv_id, depth, any_value(n) as n_convs, (any_value(n) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) as own_saved,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '')) as ends_sha256
  from named group by node, depth),
-- a node's first member leads through all nodes above it
linked as (select n.*, p.node as parent_conv_id from nodes n left join named p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
children as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as k from linked where depth > 0 group by all),
above as (select m.node as conv_id, m.depth, n.own_saved, c.k is null as leaf from nodes n join named m on m.conv_id = n.conv_id and m.depth <= n.depth left join children c on c.conv_id = n.conv_id and c.depth = n.depth),
sums as (select conv_id, depth, sum(leaf::int) as n_leaves, sum(own_saved) as saved_tokens from above group by all)
select l.conv_id, l.depth::bigint as depth, l.parent_conv_id, l.n_convs, coalesce(c.k, 0) as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, l.ends_sha256
from linked l join sums s on s.conv_id = l.conv_id and s.depth = l.depth left join children c on c.conv_id = l.conv_id and c.depth = l.depth
"""
