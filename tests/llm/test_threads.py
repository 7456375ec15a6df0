import random

import duckdb

from formweave.llm import oracles, quotations, url_filter

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def same(df, con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*sorted(names)).collect()) == want


def conversations(seed):
    """Conversations whose messages quote parts of earlier ones, also at deeper levels and wrongly."""
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 30)):
            own = [f"line {rng.randint(0, 40)} of {conv}" for _ in range(rng.randint(1, 3))]
            text = list(own)
            for _ in range(rng.randint(0, 2)):
                if said:
                    t, lines = rng.choice(said)
                    mark = rng.choice(["> ", ">> ", " > > ", ">"])
                    quoted = [mark + x.upper() if rng.random() < 0.3 else mark + x for x in lines]
                    text = quoted + text if rng.random() < 0.8 else text + quoted
            if rng.random() < 0.1:
                text = []
            said.append((turn, own))
            rows.append((conv if rng.random() < 0.97 else None, turn, "user", "\n".join(text) if rng.random() < 0.97 else None))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return rows


def test_generated_conversations_match_sql(spark):
    for seed in (1, 2):
        rows = conversations(seed)
        df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", root_turn int, position int, hash int")
        con = duckdb.connect()
        con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
        linked = quotations.link_conversations(df)
        assert linked.where("depth > 2").count() and linked.where("n_linked > 1").count()
        same(linked, con, oracles.OP6)


def test_positions_of_trees(spark):
    rng = random.Random(3)
    chain = [(1, t, t - 1) for t in range(1, 120)]
    bush = [(2, t, rng.randint(0, t - 1)) for t in range(1, 90)]
    star = [(3, t, 0) for t in range(1, 60)]
    parents = spark.createDataFrame(chain + bush + star, "conv_id bigint, turn bigint, parent bigint")
    got = {(r["conv_id"], r["turn"]): r["position"] for r in quotations.positions(parents, quotations.threads(parents)).collect()}
    want = {}
    for conv in (1, 2, 3):
        below = {}
        for c, t, p in chain + bush + star:
            if c == conv:
                below.setdefault(p, []).append(t)
        stack, n = [0], 0
        while stack:
            t = stack.pop()
            want[(conv, t)] = n
            n += 1
            stack += sorted(below.get(t, []), reverse=True)
    assert got == {k: v for k, v in want.items() if k[1]}


def test_long_listings_are_joined_without_broadcast(spark):
    rows = [(i, f"http://h{i % 40}.test/p/{i % 97}" if i % 11 else None, 1, 2) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, listed int, _bf_block int")
    listed = spark.createDataFrame([(f"h{i % 40}.test/p/{i % 97}",) for i in range(0, 900, 7)] + [(None,)], "url string")
    names = {r["url"] for r in listed.collect()}
    want = sorted((i, (u or "")[7:] in names) for i, u, *_ in rows)
    for options in ({}, {"broadcast_urls": 3}, {"broadcast_urls": 3, "blocks": 1}, {"blocks": 1}):
        got = url_filter.filter_urls(pages, [], listed, **options).collect()
        assert sorted((r["page_id"], r["listed"]) for r in got) == want
        assert all(r["verdict"] == ("block" if r["listed"] else "allow") and r["rule"] is None for r in got)
    assert url_filter.filter_urls(pages.limit(0), [], listed).count() == 0
    none = url_filter.filter_urls(pages, [], listed.limit(0)).collect()
    assert len(none) == 600 and not any(r["listed"] for r in none)


def test_filter_grows_with_the_listing():
    assert url_filter.blocks_for(0) == url_filter.LEAST_BLOCKS
    for n in (10_000, 1_000_000, 16_000_000):
        assert 16 * n <= 64 * url_filter.blocks_for(n) <= 64 * n
    assert url_filter.blocks_for(10**10) == url_filter.MOST_BLOCKS
