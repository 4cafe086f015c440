"""Preference formatting of chosen and rejected conversations.

A pair's two conversations are compared turn by turn. The longest common prefix is rendered once, as the
prompt; the rest of each is a completion of its own. Every turn is a segment of rendered text with its place
in its part (in code points) and a loss mask: 1 for an assistant's turn in a completion, else 0.

Turns are in order of turn number, then role and text. Two ordered sets of turns part at the least turn that
is in one of them only, so the prefix is found by counting, without gathering a conversation in one row, and
places are summed in blocks of turns, so a conversation of any length is dealt to many tasks.

Defined cases: rows with a null pair id take no part; null turn numbers come last; null roles and texts are
rendered as empty and equal each other only; a turn that is repeated word for word is one turn; a pair that
is on one side only has no prompt, and its turns are that side's completion; equal sides give a prompt alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turn numbers whose segments one task sums up.
BLOCK = 256
OPEN, CLOSE, END = "<|", "|>\n", "\n<|end|>\n"


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), turn, role, rendered, start, length, loss of each turn.

    Both inputs have pair_id, turn, role and text; other columns are ignored.
    """
    sides = [x.where("pair_id is not null").select("pair_id", F.col("turn").isNull().alias("late"), "turn", "role", "text", F.lit(i == 0).alias("c"), F.lit(i == 1).alias("r")) for i, x in enumerate((chosen, rejected))]
    turn = ["pair_id", "late", "turn", "role", "text"]
    turns = sides[0].unionByName(sides[1]).groupBy(*turn).agg(F.max("c").alias("c"), F.max("r").alias("r"))
    key = F.struct("late", "turn", "role", "text")
    parting = turns.where("not (c and r)").groupBy(F.col("pair_id").alias("pair")).agg(F.min(key).alias("parting"))
    marked = turns.join(parting, F.col("pair_id") == F.col("pair"), "left")
    shared = F.col("parting").isNull() | (key < F.col("parting"))
    parts = F.when(shared, F.array(F.lit("prompt"))).otherwise(F.filter(F.array(F.when(F.col("c"), F.lit("chosen")), F.when(F.col("r"), F.lit("rejected"))), lambda p: p.isNotNull()))
    rendered = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE), F.coalesce("text", F.lit("")), F.lit(END))
    out = marked.withColumn("part", F.explode(parts)).withColumn("rendered", rendered).withColumn("length", F.length("rendered").cast("long"))
    out = out.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(0)))
    whole = ["pair_id", "part", "late", "block"]
    sums = out.groupBy(*whole).agg(F.sum("length").alias("in_block"))
    over = Window.partitionBy("pair_id", "part").orderBy("late", "block")
    base = sums.select(F.col("pair_id").alias("p"), F.col("part").alias("q"), F.col("late").alias("l"), F.col("block").alias("b"), (F.sum("in_block").over(over) - F.col("in_block")).alias("base"))
    out = out.join(base, (F.col("pair_id") == F.col("p")) & (F.col("part") == F.col("q")) & (F.col("late") == F.col("l")) & (F.col("block") == F.col("b")))
    inner = Window.partitionBy(*whole).orderBy("turn", "role", "text")
    start = F.col("base") + F.sum("length").over(inner) - F.col("length")
    loss = F.when((F.col("part") != "prompt") & F.col("role").eqNullSafe(F.lit("assistant")), 1).otherwise(0)
    return out.select("pair_id", "part", "turn", "role", "rendered", start.cast("long").alias("start"), "length", loss.alias("loss"))


def with_stale_reply(turns: DataFrame) -> DataFrame:
    """The conversations with their last reply replaced: by their first reply, or by the first user turn if they have only one.

    A stand-in for rejected conversations where the data has none. Conversations without a reply are left out.
    """
    turns = turns.select("pair_id", "turn", "role", "text")
    reply, asked = F.col("role") == "assistant", F.col("role") == "user"
    ends = turns.where("turn is not null").groupBy(F.col("pair_id").alias("pair")).agg(
        F.max(F.when(reply, F.col("turn"))).alias("last"), F.min(F.when(reply, F.col("turn"))).alias("first"),
        F.min(F.when(reply, F.struct("turn", "text")))["text"].alias("stale"), F.min(F.when(asked, F.struct("turn", "text")))["text"].alias("echo"),
    ).where("last is not null")
    both = turns.join(ends, F.col("pair_id") == F.col("pair"))
    text = F.when(reply & (F.col("turn") == F.col("last")), F.when(F.col("first") < F.col("last"), F.col("stale")).otherwise(F.coalesce("echo", F.lit("")))).otherwise(F.col("text"))
    return both.select("pair_id", "turn", "role", text.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` as chosen, against themselves with a stale last reply."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").where("pair_id is not null")
    replied = turns.where("role = 'assistant' and turn is not null").select("pair_id").distinct()
    return preference_segments(turns.join(replied, "pair_id", "left_semi"), with_stale_reply(turns))


ORACLE = """
with ends as (
  select conv_id, max(turn) filter (where role = 'assistant') as last, min(turn) filter (where role = 'assistant') as first,
         arg_min(text, turn) filter (where role = 'assistant') as stale, arg_min(text, turn) filter (where role = 'user') as echo
  from conversations group by conv_id),
sides as (
  select c.conv_id, c.turn, c.role, c.text, 'chosen' as side from conversations c join ends e on c.conv_id = e.conv_id and e.last is not null
  union all
  select c.conv_id, c.turn, c.role, case when c.role = 'assistant' and c.turn = e.last then case when e.first < e.last then e.stale else coalesce(e.echo, '') end else c.text end, 'rejected'
  from conversations c join ends e on c.conv_id = e.conv_id and e.last is not null),
paired as (
  select a.conv_id, a.turn, a.role = b.role and a.text = b.text as same
  from (select * from sides where side = 'chosen') a join (select * from sides where side = 'rejected') b on a.conv_id = b.conv_id and a.turn = b.turn),
parting as (select conv_id, min(turn) filter (where not same) as turn from paired group by conv_id),
segments as (
  select distinct s.conv_id as pair_id, case when p.turn is null or s.turn < p.turn then 'prompt' else s.side end as part, s.turn, s.role,
         '<|' || s.role || '|>' || chr(10) || s.text || chr(10) || '<|end|>' || chr(10) as rendered
  from sides s join parting p on s.conv_id = p.conv_id)
select pair_id, part, turn, role, rendered, cast(sum(length(rendered)) over (partition by pair_id, part order by turn) - length(rendered) as bigint) as start,
       length(rendered) as length, case when part <> 'prompt' and role = 'assistant' then 1 else 0 end as loss
from segments
"""
