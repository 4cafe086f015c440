"""Repair of a conversation's structure by composition of weighted finite-state machines.

A conversation's turns are an input acceptor, the edits (keep, rerole, delete, insert) a transducer from roles to roles,
and ``s?(ua)*`` with at least one pair, or nothing, an acceptor of role initials. They are composed lazily: a state of
the product is a place in the input and a state of the grammar, and its arcs are made when it is reached. Weights are
(cost, label string) in lexicographic order. States are relaxed in reverse topological order, so a string grows at its
front and two candidates are told apart by their own labels or by the rank of their ends among the states of one place:
no string is stored, only a rank and the arc taken. Insertions stand before a place's own arc, at most two: a third
would come back to a state that was cheaper before.

A conversation is read in order by one task, first its turns' kinds alone (a few bytes a turn are kept), then, with
the decided edits, its texts for the hash, one after another; no task holds a conversation's texts. Both passes are
sorts of Spark on conv_id and place.

Defined cases: a null turn comes first, a null role or text is one space; rows of one turn number are in order of role
and text; a null conv_id is a conversation of its own; a role whose first character is none of s, u, a, or that is
empty, can't be kept; columns besides conv_id, turn, role and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import keep
from logweave.llm.prefixes import CRC_SQL

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
#: The grammar: start, after s, after u, after a; its final states; what an insertion adds.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (True, False, False, True)
ADDED = ("u", "u", "a", "u")
#: Steps of the relaxation that a task remembers.
REMEMBERED = 100_000


def edits(initial: str, fault: str) -> list[tuple[str, str, int]]:
    """The transducer's arcs for a turn: (label, initial that comes out or nothing, cost)."""
    arcs = [("D", "", DELETE)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED * (fault == "truncated")
        arcs += [("K", initial, more)] * (initial in ("s", "u", "a")) + [("R", out, REROLE + more) for out in "ua" if out != initial]
    return arcs


def composed(state: int, initial: str, fault: str) -> Iterator[tuple[int, str, str, int]]:
    """Arcs of the product from a grammar state over one turn: (cost, labels, initials that come out, next state)."""
    cost, labels, out = 0, "", ""
    for _ in range(3):
        for label, role, price in edits(initial, fault):
            if not role:
                yield cost + price, labels + label, out, state
            elif role in GRAMMAR[state]:
                yield cost + price, labels + label, out + role, GRAMMAR[state][role]
        cost, labels, out, state = cost + INSERT, labels + "I", out + ADDED[state], GRAMMAR[state][ADDED[state]]


def endings() -> list[tuple[int, str, str]]:
    """For each grammar state, the cheapest way to end: (cost, labels, initials that come out)."""
    found = []
    for state in range(4):
        labels = out = ""
        while not FINAL[state]:
            labels, out, state = labels + "I", out + ADDED[state], GRAMMAR[state][ADDED[state]]
        found.append((INSERT * len(labels), labels, out))
    return found


ENDINGS = endings()
Weights = tuple[tuple[int, int], ...]


def ranked(weights: list[tuple]) -> list[int]:
    order = {w: i for i, w in enumerate(sorted(set(weights)))}
    return [order[w] for w in weights]


class Shortest:
    """Relaxes one place after another from the end; equal steps are remembered."""

    def __init__(self) -> None:
        self.seen: dict = {}

    def step(self, initial: str, fault: str, after: Weights) -> tuple[int, Weights, list]:
        """What all costs grow by, (cost, rank) of each grammar state before the turn, and its best arc: (labels, out, next)."""
        key = (initial, fault, after)
        if key not in self.seen:
            best = [min((cost + after[to][0], labels, after[to][1], to, out) for cost, labels, out, to in composed(state, initial, fault)) for state in range(4)]
            low, ranks = min(b[0] for b in best), ranked([(b[1], b[2]) for b in best])
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[key] = low, tuple((b[0] - low, r) for b, r in zip(best, ranks)), [(b[1], b[4], b[3]) for b in best]
        return self.seen[key]

    def path(self, turns: list[tuple[str, str]]) -> tuple[int, list[tuple[str, str]]]:
        """The cost, and for each turn and the end (labels, initials that come out), of the least path over (initial, fault)."""
        after: Weights = tuple(zip((e[0] for e in ENDINGS), ranked([e[1] for e in ENDINGS])))
        total, arcs = 0, []
        for initial, fault in reversed(turns):
            grown, after, best = self.step(initial, fault, after)
            total += grown
            arcs.append(best)
        total, state, steps = total + after[0][0], 0, []
        for best in reversed(arcs):
            labels, out, state = best[state]
            steps.append((labels, out))
        return total, steps + [ENDINGS[state][1:]]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, copy: rows with their damage done; those dropped are marked."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    gone = F.col("fate") == 0
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("dropped"), F.explode(copies).alias("copy"))


def faulty(rows: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, dropped, fault: rows in their conversation's order (from 1; those dropped last) with their first fault."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("dropped", F.asc_nulls_first("turn"), "role", "text", "copy"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("place")) > 1
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("seen"), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    # one shuffle: what is dealt by conversation is so by conversation and text too
    return rows.repartition("conv_id").withColumn("place", place).withColumn("seen", seen).select("conv_id", "place", "turn", "role", "text", "dropped", fault.alias("fault"))


DECIDED = "conv_id long, place long, labels string, lead string, role string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def together(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """Runs of rows of one conversation, rows as tuples; a run that goes on in the next batch is carried over."""
    run: list = []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if run and run[0][0] != row[0]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (conv key, place, turn, initial, dropped, fault) in order: the edits of each turn, and a last row with the conversation's figures."""
    columns, shortest, out = [c.split()[0] for c in DECIDED.split(", ")], Shortest(), []
    for run in together(batches):
        conv = None if run[0][0] == "" else int(run[0][0])
        rows = [r for r in run if not r[4]]
        cost, steps = shortest.path([(r[3], r[5]) for r in rows])
        for place, (labels, made) in enumerate(steps, 1):
            kept = labels[-1:] in ("K", "R")
            lead = "".join(f"{NAMES[x]}:\n" for x in (made[:-1] if kept else made))
            out.append([conv, place, labels, lead, NAMES[made[-1]] if labels[-1:] == "R" else "=" if kept else None] + [None] * 6)
        numbers = {int(r[2]) for r in rows if r[2] != ""}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        faults = [sum(r[5] == f for r in rows) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[3] + b[3] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[-1][5:] = [gaps, *faults, illegal, cost]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Figures, audit and hash of each conversation, from edits and texts in order of place, edits before the text that they are for."""
    columns, out, conv, labels, digest, parted, edit = [c.split()[0] for c in REPAIRED.split(", ")], [], None, [], None, False, None

    def add(piece: str) -> None:
        nonlocal parted
        digest.update(("\n" + piece if parted else piece).encode())
        parted = True

    for batch in batches:
        for key, text, role, label, lead, *figures in batch[["key", "text", "role", "labels", "lead", *FIGURES]].itertuples(index=False, name=None):
            if digest is None or key != conv:
                conv, labels, digest, parted = key, [], hashlib.sha256(), False
            if label is not None:
                edit = role
                labels.append(label)
                for line in lead.split("\n")[:-1]:
                    add(line)
                if figures[0] != "":
                    out.append([None if key == "" else int(key), *map(int, figures), "".join(labels), digest.hexdigest()])
            elif edit is not None:
                add(f"{role if edit == '=' else edit}:{text}")
        if out:
            yield pd.DataFrame(out, columns=columns)
            out = []


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, from its turns after damage."""
    rows = keep(faulty(turns), "turns")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    kinds = ordered.select(text("conv_id"), "place", text("turn"), F.left("role", F.lit(1)).alias("initial"), "dropped", "fault")
    edits_of = keep(kinds.mapInPandas(decided, DECIDED), "edits")
    nothing = F.lit(None).cast("string")
    own = rows.where("not dropped").select("conv_id", "place", F.lit(1).alias("part"), "text", "role", nothing.alias("labels"), nothing.alias("lead"), *[F.lit("").alias(c) for c in FIGURES])
    asked = edits_of.select("conv_id", "place", F.lit(0).alias("part"), F.lit("").alias("text"), "role", "labels", "lead", *[text(c) for c in FIGURES])
    both = own.unionByName(asked).repartition("conv_id").sortWithinPartitions("conv_id", "place", "part")
    return both.select(text("conv_id").alias("key"), "text", "role", "labels", "lead", *FIGURES).mapInPandas(hashed, REPAIRED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _relaxed(state: int) -> str:
    """SQL of the forward weight of a grammar state after a turn: six digits of cost, then the labels."""
    add = lambda w, cost, label: f"(lpad(((left({w}, 6))::int + {cost})::varchar, 6, '0') || substr({w}, 7) || '{label}')"
    may, late = "t.fault not in ('blank', 'duplicate')", f"(case when t.fault = 'truncated' then {TRUNCATED} else 0 end)"
    found = [add(f"w{state}", DELETE, "D")]
    for source, arcs in enumerate(GRAMMAR):
        for initial, target in arcs.items():
            if target == state:
                found.append(f"case when {may} and t.initial = '{initial}' then {add(f'w{source}', late, 'K')} end")
                if initial in NAMES:
                    found.append(f"case when {may} and t.initial <> '{initial}' then {add(f'w{source}', f'{REROLE} + {late}', 'R')} end")
    return f"least({', '.join(found)})"


def _inserted(state: int) -> str:
    """SQL of a grammar state's weight after at most one more insertion."""
    found = [f"w{state}"] + [f"(lpad((left(w{s}, 6)::int + {INSERT})::varchar, 6, '0') || substr(w{s}, 7) || 'I')" for s in range(4) if GRAMMAR[s][ADDED[s]] == state]
    return f"least({', '.join(found)}) as w{state}"


def _twice(source: str) -> str:
    once = ", ".join(_inserted(s) for s in range(2, 4))
    return f"(select * replace ({once}) from (select * replace ({once}) from {source}))"


SPACE_SQL = r"[^\x20\x09-\x0D]"
ORACLE = rf"""
with recursive fates as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC_SQL.format(text="coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fate from conversations),
rows_ as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from fates, lateral (select unnest(range(case when fate = 3 then 2 else 1 end)) as copy) where fate <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as place, left(role, 1) as initial from rows_),
turns as (
  select *, case when not regexp_matches(text, '{SPACE_SQL}') then 'blank'
                 when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
                 when regexp_extract(text, '({SPACE_SQL})[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(initial) over (partition by conv_id order by place) as before
  from ordered),
figures as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
         count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before || initial not in ('su', 'ua', 'au')) as illegal, max(place) as size
  from turns group by conv_id),
paths as (
  select distinct conv_id, 0::bigint as place, '000000' as w0, null::varchar as w1, null::varchar as w2, null::varchar as w3 from conversations
  union all
  select p.conv_id, t.place, {", ".join(_relaxed(s) for s in range(4))}
  from {_twice("paths")} p join turns t on t.conv_id is not distinct from p.conv_id and t.place = p.place + 1),
best as (
  select p.conv_id, least(w0, w3) as weight from {_twice("paths")} p left join figures f on f.conv_id is not distinct from p.conv_id where p.place = coalesce(f.size, 0)),
labels as (
  select conv_id, substr(weight, 7) as audit, unnest(string_split(substr(weight, 7), '')) as label, unnest(range(1, length(weight) - 5)) as nth from best where length(weight) > 6),
steps as (
  select *, count(*) filter (where label <> 'I') over so_far as place, count(*) filter (where label <> 'D') over so_far as made, length(replace(audit, 'D', '')) % 2 as odd
  from labels window so_far as (partition by conv_id order by nth)),
lines as (
  select s.conv_id, s.nth, case when s.label = 'K' then t.role when (s.made - s.odd) % 2 = 1 then 'user' else 'assistant' end || ':' || case when s.label = 'I' then '' else t.text end as line
  from steps s left join turns t on t.conv_id is not distinct from s.conv_id and t.place = s.place where s.label <> 'D'),
joined as (select conv_id, string_agg(line, chr(10) order by nth) as text from lines group by conv_id)
select b.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal,
       left(b.weight, 6)::bigint as cost, substr(b.weight, 7) as audit, sha256(coalesce(j.text, '')) as repaired_sha256
from best b left join figures f on f.conv_id is not distinct from b.conv_id left join joined j on j.conv_id is not distinct from b.conv_id
"""
