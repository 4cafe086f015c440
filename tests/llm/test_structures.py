"""Repair, prefix trie and exact duplicates against brute force and their SQL, on odd rows and real tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.llm import pages, prefixes, recipes, repair
from logweave.llm.queries import ORACLE_SQL, QUERIES

TURNS = "conv_id long, turn long, role string, text string, place int, fault string, size int, node long, row long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], TURNS).repartition(3)


def odd_turns(seed):
    """Conversations with nulls, empty and long texts, ties, repeats and other roles."""
    rng, rows = random.Random(seed), []
    texts = ["", " ", None, "Yes.", "No", "What? ", "a b\tc!", "Yes.", "so it is...\n", "　", "é"]
    for conv in [*range(0, 45), 60, 61, 62, 101]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([turn, turn, turn, None, 300 - turn]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rng.choice(texts)))
    rows += [(conv, t, ["user", "assistant"][t % 2], f"shared {t}") for conv in (44, 45, 46, 47, 48, 49, 120, 121) for t in range(6)]
    return rows + [(None, 0, "user", "lost"), (0, 1, "user", "x " * 50_000), (130, 5, "system", "Only."), *[(131, 2, "user", "again")] * 3]


def crc(text):
    return zlib.crc32(text.encode())


def brute_nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = crc(str(c)) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        saved = sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        listed = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out)


def test_trie_equals_brute_force(spark):
    for seed in (1, 2):
        rows = odd_turns(seed)
        got = prefixes.trie(*prefixes.sharing(turns_frame(spark, rows)))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect())) == brute_nodes(rows)


def test_trie_of_deep_copies_and_of_few_rows(spark):
    deep = [(c, t, "user", f"w {t}") for c in (200, 203, 207) for t in range(7)]
    # a hundred members of one node, in several pieces of a list
    wide = [(c, 0, "user", "same") for c in range(0, 40 * prefixes.PIECE, prefixes.PIECE // 2)]
    for rows in (deep, wide, [(7, 0, "user", "a b")], []):
        assert sorted(map(tuple, prefixes.trie(*prefixes.sharing(turns_frame(spark, rows) if rows else spark.createDataFrame([], TURNS))).collect())) == brute_nodes(rows)


def brute_edits(turns):
    """The least (cost, labels, roles) over all edits of a conversation, with at most two insertions in one place."""
    lead = [(n, roles) for n in range(3) for roles in itertools.product("ua", repeat=n)]

    def after(i):
        for n, roles in lead:
            if i == len(turns):
                yield 3 * n, "I" * n, roles
                continue
            initial, fault = turns[i]
            own = [(4, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                own += [(more, "K", (initial,)), (3 + more, "R", ("u",)), (3 + more, "R", ("a",))]
            for (cost, label, made), (rest, labels, others) in itertools.product(own, list(after(i + 1))):
                yield 3 * n + cost + rest, "I" * n + label + labels, roles + made + others

    return min(x for x in after(0) if re.fullmatch("(s?(ua)+)?", "".join(x[2])) and "" not in x[2])


def test_least_edits_equal_enumeration():
    rng, shortest = random.Random(5), repair.Shortest()
    cases = [[(rng.choice("suaut"), rng.choice(["", "", "truncated", "blank"])) for _ in range(n)] for n in (0, 1, 2, 2, 3, 3, 3) for _ in range(6)]
    cases += [[(i, "") for i in s] for s in ("su", "aa", "uu", "us", "ss", "a", "u", "s", "")] + [[("", ""), ("u", "")]]
    for turns in cases:
        cost, steps = shortest.path(turns)
        assert (cost, "".join(s[0] for s in steps)) == brute_edits(turns)[:2], turns
    assert shortest.path([("a", "")] * 4)[0] == 6 and shortest.path([("u", "truncated")])[0] == 4
    long = shortest.path([("ua"[i % 2], "") for i in range(200_000)])
    assert long[0] == 0 and len(long[1]) == 200_001


def test_repair_equals_its_sql_and_brute_force_on_odd_rows(spark):
    con = duckdb.connect()
    for seed in (3, 4):
        rows = [r for r in odd_turns(seed) if r[0] != 0] + [(500, t, "user", "Go on.") for t in range(30)]
        frame = turns_frame(spark, rows)
        pd = frame.select("conv_id", "turn", "role", "text").toPandas()
        con.register("conversations_frame", pd.astype({"conv_id": "Int64", "turn": "Int64"}))
        con.execute("create or replace view conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role::varchar as role, text::varchar as text from conversations_frame")
        got = sorted(map(str, map(tuple, repair.repaired(repair.damaged(frame)).collect())))
        assert got == sorted(map(str, con.execute(repair.ORACLE).fetchall()))
        assert len(got) == len({r[0] for r in rows})
    empty = repair.repaired(repair.damaged(spark.createDataFrame([], TURNS)))
    assert empty.collect() == [] and empty.columns[0] == "conv_id"


def test_conversation_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(c, t, ["user", "assistant"][t % 2], f"Turn {t} of {c}.") for c in (1, 2) for t in range(60)]
    whole = sorted(map(tuple, repair.repaired(repair.damaged(turns_frame(spark, rows))).collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(tuple, repair.repaired(repair.damaged(turns_frame(spark, rows))).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


DOCS = "doc_id long, text string, lang string, ids string, ranks int, row long, k int"


@pytest.mark.parametrize("bits", [64, 4])
def test_duplicates_are_exact(spark, bits):
    rng = random.Random(bits)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé中 ") for _ in range(6))
    long = [" ".join(word() for _ in range(900)) for _ in range(4)]
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b", " a b", "a b ", *long, long[0].replace(" ", " \n"), long[0] + "x", "y" + long[1], long[2][:5000] + "Z" + long[2][5001:], "x" * 30_000, "x" * 30_001]
    rows = [(rng.randrange(1000), rng.choice(texts)) for _ in range(120)]
    rows += [(5, "a b"), (5, "a b"), (5, "a  b"), (None, "a b"), (None, "only null"), (None, "only  null"), (3, long[0]), (3, long[1])]
    docs = spark.createDataFrame([(i, t, "en", "x", 1, 2, 3) for i, t in rows], DOCS).repartition(3)
    got = [tuple(r) for r in recipes.duplicates(docs, bits).collect()]
    texts_of = defaultdict(list)
    for i, t in rows:
        t = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        texts_of[hashlib.sha256(t.encode()).hexdigest()].append(i)
    want = [(i, min((x for x in ids if x is not None), default=None), len(ids), sha) for sha, ids in texts_of.items() for i in ids]
    assert sorted(str((*r[:3], r[4])) for r in got) == sorted(map(str, want))
    stays = defaultdict(list)
    for r in got:
        if r[3]:
            stays[r[4]].append(r[0])
    assert stays == {sha: [min((x for x in ids if x is not None), default=None)] for sha, ids in texts_of.items()}
    assert recipes.duplicates(docs.limit(0)).collect() == []


def test_chunks_make_up_the_text_and_meet_again_after_an_insertion(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("etaoinshrdlu éà中") for _ in range(7)) for _ in range(6000))
    rows = spark.createDataFrame([(text,), ("new start " + text,), ("x" * 20_000,)], "text string").select(recipes.chunks(F.col("text")).alias("c")).collect()
    for r, t in zip(rows, (text, "new start " + text, "x" * 20_000)):
        assert "".join(r["c"]).encode("latin-1").decode() == t and max(map(len, r["c"])) <= recipes.MOST + 3
        assert all(len(c) >= recipes.LEAST for c in r["c"][:-1])
    a, b = set(rows[0]["c"]), set(rows[1]["c"])
    assert len(a) > 10 and len(a - b) <= 2


@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_prefix_trie", "op13_exact_dedup"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, "/root/testdata/sf0.01"), con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, ours.select(columns).collect()))) == sorted(map(str, theirs.fetchall()))


#: Pages of other themes than the templates', with their articles.
THEMES = {
    "reply box inside the post": ('<div class="post"><p>The river rose fast last night. People moved to the hills.</p><p>By morning the bridge was gone. Nobody was hurt.</p><div id="respond"><h3>Leave a reply</h3><form><label>Name</label><input><textarea></textarea><button>Send</button></form></div></div>',
        "The river rose fast last night. People moved to the hills.\nBy morning the bridge was gone. Nobody was hurt."),
    "lines about the post": ('<html><body><div class="header"><h1><a href="/">My blog</a></h1></div><div class="post"><h2>Flood in the valley</h2><p class="meta">May 2, 2020 by Ann</p><p>The river rose fast last night. People moved to the hills.</p><p>By morning the bridge was gone. Nobody was hurt.</p><p class="tags">Tagged <a href="/t/flood">flood</a></p></div><h3>2 thoughts</h3><ol class="commentlist"><li><b>Bob</b><p>So sad to hear.</p></li></ol><div id="respond"><form><label>Name</label><input></form></div></body></html>',
        "Flood in the valley\nThe river rose fast last night. People moved to the hills.\nBy morning the bridge was gone. Nobody was hurt."),
    "wiki": ('<html><body><div id="content"><h1>Barn owl</h1><p>The barn owl is a bird of prey found on most continents.</p><p>It hunts at night and nests in old barns.</p></div><div id="footer"><ul><li>This page was last edited on 3 May 2020, at 10:11.</li></ul></div></body></html>',
        "Barn owl\nThe barn owl is a bird of prey found on most continents.\nIt hunts at night and nests in old barns."),
    "links in the article": ("<html><body><nav><a href=/>Home</a> <a href=/b>About</a></nav><article><h1>Tools we use</h1><p>These are the tools that we use each day in our work.</p><ul><li><a href=/x>A fast text editor</a></li><li><a href=/y>A plotting library</a></li></ul><p>All of them are free to use.</p></article></body></html>",
        "Tools we use\nThese are the tools that we use each day in our work.\nA fast text editor\nA plotting library\nAll of them are free to use."),
    "nothing but menus": ('<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><form><label>Search</label><input><button>Go</button></form><footer>&copy; 2024 Some company</footer>', ""),
}


@pytest.mark.parametrize("theme", list(THEMES))
def test_articles_of_other_themes(theme):
    html, text = THEMES[theme]
    assert pages.own_model().text(html) == text


def test_styled_and_distant_letters_are_letters(spark):
    from logweave.llm import toxicity

    plain, styled = toxicity.Windows(["stupid idiot"]), toxicity.Windows(["𝐬𝐭𝐮𝐩𝐢𝐝 ｉｄｉｏｔ"])
    assert plain.classes.tobytes() == styled.classes.tobytes()
    assert toxicity.encoded("𝓼𝓬𝓾𝓶") == toxicity.encoded("scum") and toxicity.classes("𐐨𐑌😀").tolist()[2] == toxicity.BLANK
    assert all(c > toxicity.BLANK for c in toxicity.classes("𐐨𐑌"))


def test_many_items_are_joined_to_the_same_leaks(spark):
    from logweave.llm import decontaminate

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 30, 60]))) for _ in range(60)] + [None, "", "...", "one two"]
    items += [items[7], items[8].upper()]
    docs = []
    for i in range(120):
        own = [word() for _ in range(rng.choice([0, 3, 40, 400]))]
        for _ in range(rng.randrange(3)):
            leak = (rng.choice(items) or "").split()
            if leak and rng.random() < 0.5:
                leak[rng.randrange(len(leak))] = "changed"
            own[len(own) // 2 : len(own) // 2] = leak
        docs.append((i, " ".join(own), "en", "item", 1, 2, 3))
    docs += [(None, docs[5][1], "en", "x", 1, 2, 3), docs[6], (500, None, "en", "x", 1, 2, 3), (501, items[0], "en", "x", 1, 2, 3)]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(enumerate(items)) + [(None, items[3])], "item_id long, text string")
    for percent in (80, 100, 50):
        small, many = (sorted(map(str, map(tuple, decontaminate.find_leaks(frame, bench, percent, most).collect()))) for most in (10**6, 1))
        assert small == many and len(small) > 20
        left = [sorted(str(tuple(r)) for r in decontaminate.clean(frame, bench, percent, most).collect()) for most in (10**6, 1)]
        assert left[0] == left[1] and 3 < len(left[0]) < len(docs)
    assert decontaminate.find_leaks(frame, bench.limit(0), block_shingles=-1).count() == 0


@pytest.mark.parametrize("name", ["op5_decontamination", "op9_licence_scan"])
def test_earlier_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, "/root/testdata/sf0.01"), con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(map(str, map(tuple, ours.select(columns).collect()))) == sorted(map(str, theirs.fetchall()))


#: Notices, and the licence that they state or none.
NOTICES = {
    "The MIT License (MIT)\n\nCopyright (c) 2020 X": "MIT", "SPDX-License-Identifier: Apache-2.0\nimport x": "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "Licensed under the GNU GPL v3.": "GPL-3.0",
    "This work is licensed under the Creative\nCommons Attribution 4.0 International License.": "CC-BY-4.0", "This text is licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nMore.": "LGPL-2.1",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0": "EPL-2.0", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
    "Code is available under the Unlicense License.": "Unlicense", "GPLv3": "GPL-3.0", "Released under the 3-clause BSD license.": "BSD-3-Clause", "Licence: EUPL-1.2": "EUPL-1.2", "Content is available under CC BY-NC-SA 3.0 unported.": "CC-BY-NC-SA-3.0",
    "This is not licensed under the MIT License.": None, "Unless it is licensed under the MIT License.": None, "All rights reserved by others.": None, "Mit. Das ist mit.": None, "The license of the house.": None, "Under the MIT bridge.": None,
}


def test_notices(spark):
    from logweave.llm import licences

    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(docs).collect()}
    assert got == {i: licence for i, licence in enumerate(NOTICES.values()) if licence}


def test_no_python_worker_in_exact_dedup(spark):
    plan = QUERIES["op13_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
