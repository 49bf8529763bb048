import datetime as dt

from deponent.operators import evidence as V


def test_bubbles_break_at_sides_clocks_and_gaps(spark):
    rows = [("d", 1, 1, "LEFT", 0, 10, 5, 10, "Hello"), ("d", 1, 2, "LEFT", 0, 22, 5, 10, "there 08:16 ✓"), ("d", 1, 3, "LEFT", 0, 34, 5, 10, "again"), ("d", 1, 4, "RIGHT", 9, 46, 5, 10, "yes"), ("d", 1, 5, "RIGHT", 9, 90, 5, 10, "later"), ("d", 1, 6, "CENTER", 5, 95, 5, 10, "Today")]
    df = spark.createDataFrame(rows, "doc string, screen int, block int, side string, x int, y int, w int, h int, text string")
    got = [(r.bubble, r.side, r.time, r.text) for r in V.bubbles(df).orderBy("bubble").collect()]
    assert got == [(1, "LEFT", "08:16", "Hello there"), (2, "LEFT", None, "again"), (3, "RIGHT", None, "yes"), (4, "RIGHT", None, "later")]


def test_excerpts_skip_what_does_not_fit(spark):
    rows = [("a", 1, 1, "x" * 6), ("a", 2, 2, "y" * 6), ("a", 3, 3, "zz"), ("b", 1, 1, "w" * 20), ("c", 1, 1, None)]
    df = spark.createDataFrame(rows, "k string, n int, r int, t string")
    got = sorted((r.k, r.n, r.t) for r in V.packed_excerpt(df, "k", "n", "r", "t", 10).collect())
    assert got == [("a", 1, "xxxxxx"), ("a", 3, "zz"), ("b", 1, "w" * 10), ("c", 1, "")]


def test_as_of_takes_the_last_row_at_or_before(spark):
    t = dt.datetime(2025, 1, 1)
    chat = spark.createDataFrame([(1, "c", "chat", t), (2, "c", "chat", t + dt.timedelta(days=3)), (3, "c", "email", t), (4, "d", "chat", None)], "row_id long, case_id string, source_kind string, loaded_at timestamp")
    rec = spark.createDataFrame([("r", "c", t + dt.timedelta(days=2)), ("s", "c", t + dt.timedelta(days=3)), ("u", "c", t - dt.timedelta(days=1)), ("v", "d", t), ("w", None, t)], "recording_id string, case_id string, recorded_at timestamp")
    assert {r.recording_id: r.row_id for r in V.last_chat_before(rec, chat).collect()} == {"r": 1, "s": 2, "u": None, "v": None}
    assert V.last_chat_before(rec, chat.limit(0)).filter("row_id is not null").count() == 0


def test_cues_and_amounts(spark):
    rows = [(1, "c", "email", "Hi Ann, pay $1,200 or USD 30"), (2, "c", "chat", "I'm Ann, nice to meet you"), (3, "c", "chat", "ann, please answer me"), (4, "c", "chat", "saw Ann"), (5, "c", "chat", None), (6, None, "chat", "Ann")]
    df = spark.createDataFrame(rows, "row_id long, case_id string, source_kind string, message string")
    people = spark.createDataFrame([("c", 7, "Ann Lee"), ("c", 8, None)], "case_id string, participant_id long, full_name string")
    assert {r.row_id: r.cue for r in V.identity_cues(df, people).collect()} == {1: "address", 2: "self", 3: "address", 4: "mention"}
    docs = spark.createDataFrame([("c", "He paid USD30."), (None, "USD30")], "case_id string, text string")
    assert [tuple(r) for r in V.agreed_amounts(df, docs).collect()] == [("c", "USD30", True)]
