from duecall.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def run(spark, rows):
    return chat.formatted(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))


def test_quotes_lead_to_their_originals(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\n\nIt has many items."),
        (1, 1, "assistant", "On Monday Ann wrote:\n> how do I  sort a list?\n\nUse sorted."),
        (1, 2, "user", ">> How do I sort a list?\n> Use sorted.\nThanks a lot for that"),
        (2, 0, "user", "> Thanks a lot for that\nI have the same question here"),
        (3, 0, "user", "> nobody ever said this\nhello"),
        (4, 0, "user", None),
        (None, 0, "user", "> Use sorted.\nx"),
        (5, 0, "user", ""),
    ]
    got = {(r.conv_id, r.turn): r for r in run(spark, rows).collect()}
    assert len(got) == len(rows)
    link = {k: (r.to_conv, r.to_turn) for k, r in got.items()}
    assert link[1, 1] == (1, 0) and link[1, 2] == (1, 1) and link[2, 0] == (1, 2)
    assert link[3, 0] == link[4, 0] == link[None, 0] == (None, None)
    assert got[1, 1].text == "Use sorted." and got[1, 2].text == "Thanks a lot for that" and got[4, 0].text is None and got[5, 0].text == ""
    assert got[1, 2].n_quotes == 2 and got[3, 0].text == "hello"
    assert {k: r.thread_id for k, r in got.items()} == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (2, 0): 1, (3, 0): 3, (4, 0): 4, (None, 0): None, (5, 0): 5}


def test_many_copies_of_one_passage(spark):
    rows = [(k, t, "user", "the same first words of all" if t == 0 else "> the same first words of all\nreply %d" % k) for k in range(60) for t in (0, 1)]
    rows += [(99, 0, "user", "> the same first words of all\nlate"), (99, 0, "user", "> the same first words of all\nlate")]
    got = run(spark, rows).collect()
    assert len(got) == len(rows)
    assert all((r.to_conv, r.to_turn) == (r.conv_id, 0) for r in got if r.turn == 1)
    assert [(r.to_conv, r.to_turn, r.thread_id) for r in got if r.conv_id == 99] == [(0, 0, 0)] * 2


def test_chains_of_conversations_and_order(spark):
    rows = [(k, 0, "user", (f"> message number {k - 1} of the chain\n" if k else "") + f"message number {k} of the chain") for k in range(20)]
    got = run(spark, rows).collect()
    assert {r.thread_id for r in got} == {0}
    assert [(r.conv_id, r.turn) for r in got] == sorted((r.conv_id, r.turn) for r in got)


def test_empty_table(spark):
    assert run(spark, []).count() == 0


def test_replies_as_their_sql(spark, tmp_path):
    """The query against SQL over conversations with repeated, blank, null and very long texts."""
    import random

    from compare import same

    rng = random.Random(6)
    said = ["yes", "Yes ", "no thank you all", "first line here it is\n\nsecond paragraph of it\nlast line of all", "second paragraph of it", "last line of  all", " \n", None, "", "a <|user|> mark", "word " * 30_000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in range(40) for t in range(rng.randint(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    out = chat.query(spark, str(tmp_path))
    same(out, con, chat.ORACLE)
    assert out.filter("n_quotes = 2").count() > 40 and out.filter("to_turn < turn - 1").count() > 5


def test_a_million_marks(spark):
    rows = [(1, 0, "user", "some words that are quoted"), (1, 1, "user", ">" * 1_000_000 + " some words that are quoted\nyes"), (1, 2, "user", "> " * 500_000 + "\n" + " >" * 9 + " x")]
    got = {r.turn: r for r in run(spark, rows).collect()}
    assert (got[1].to_turn, got[1].text) == (0, "yes") and got[2].text == ""
