import zipfile

from pyspark.sql import functions as F

from deponent.sources import readers, sinks


def test_transcript_round_trip_and_legacy_header(spark, tmp_path):
    rows = [("c", 1, "01/01/2025 10:00:00", "False", "Ann", "Ben", 'said "yes", twice'), ("c", 2, "01/01/2025 10:00:01", "True", "Ben", "Ann", "two\nlines")]
    df = spark.createDataFrame(rows, "case_id string, seq long, msg_timestamp string, estimated string, sender string, receiver string, message string")
    sinks.write_transcript(df, str(tmp_path / "out"))
    back = readers.transcript_csv(spark, str(tmp_path / "out"))
    assert sorted((r.msg_timestamp, r.estimated, r.sender, r.receiver, r.message) for r in back.collect()) == [r[2:] for r in rows]
    (tmp_path / "old.csv").write_text('﻿Time,Sender,Receiver,Message\n"01/01/2025 10:00",Ann,Ben,hi\n"01/01/2025 10:00",Ann,,hi\n', encoding="utf-8")
    old = readers.transcript_csv(spark, str(tmp_path / "old.csv")).collect()
    assert [(r.estimated, r.message, r.source_row) for r in old] == [("False", "hi", 2)]
    (tmp_path / "bad.csv").write_text("A,B\n1,2\n")
    assert readers.transcript_csv(spark, str(tmp_path / "bad.csv")) is None


def test_audio_offsets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Offset_Seconds,Sender,Receiver,Message\n0,Ann,Ben,"a"\n61.5,Ben,Ann,"b"\n-4,Ann,Ben,"c"\nx,Ann,Ben,"d"\n')
    got = sorted((r.message, r.msg_timestamp) for r in readers.audio_csv(spark, str(tmp_path / "a.csv"), "2/3/2025").collect())
    assert got == [("a", "02/03/2025 00:00:00"), ("b", "02/03/2025 00:01:01"), ("c", "02/03/2025 00:00:00")]
    assert readers.audio_csv(spark, str(tmp_path / "a.csv"), None).count() == 0
    assert readers.audio_csv(spark, str(tmp_path / "a.csv"), None, include_undated=True).count() == 3


def test_side_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text('```csv\nTime,Side,Message\n"10:00",left,"a",b\n10:01,INCOMING,c\n10:02,CENTER,d\n10:03,RIGHT,\n```\n')
    got = [(r.time, r.side, r.message) for r in readers.side_csv(spark, str(tmp_path / "s.csv")).orderBy("pos").collect()]
    assert got == [("10:00", "LEFT", "a,b"), ("10:01", "LEFT", "c")]


def test_side_messages_are_whole(spark, tmp_path):
    long = ",".join(f"piece {n}" for n in range(11))
    (tmp_path / "s.csv").write_text(f'Time,Side,Message\n10:00,LEFT,{long}\n10:01,RIGHT,a,,b,\n10:02,LEFT,"two, ""or""\nmore lines"\n10:03,RIGHT\n10:04,OUTGOING,end\n')
    got = [(r.time, r.side, r.message) for r in readers.side_csv(spark, str(tmp_path / "s.csv")).orderBy("pos").collect()]
    assert got == [("10:00", "LEFT", long), ("10:01", "RIGHT", "a,,b,"), ("10:02", "LEFT", 'two, "or"\nmore lines'), ("10:04", "RIGHT", "end")]


def test_blocks_carry_their_screen(spark):
    lines = ["[SCREEN 1]", "[BLOCK 1] [POS=LEFT] [X=1] [Y=2] [W=3] [H=4] [CONF=0.91] hello", "noise", "[SCREEN 2]", "[BLOCK 1] [POS=right] [X=5] [Y=6] [W=7] [H=8] there"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, pos int, line string")
    got = [tuple(r) for r in readers.text_blocks(df).orderBy("screen").collect()]
    assert got == [("d", 1, 1, "LEFT", 1, 2, 3, 4, 0.91, "hello"), ("d", 2, 1, "RIGHT", 5, 6, 7, 8, None, "there")]


def test_three_speech_spellings(spark):
    texts = [(1, "[0.48][S01]Hello[1.66][2.00][S02]Hi  there[2.40]"), (2, "Good day. [S01] It is me. [SPEAKER_01] Who?"), (3, "S01: one\nSPEAKER_09: two"), (4, "no labels"), (5, None)]
    df = spark.createDataFrame(texts, "k int, t string")
    got = [(r.k, r.label, r.start_s, r.end_s, r.message) for r in readers.speech_text(df, "k", "t").orderBy("k", "pos").collect()]
    assert got == [(1, "S01", 0.48, 1.66, "Hello"), (1, "S02", 2.0, 2.4, "Hi there"), (2, "S01", None, None, "Good day. It is me."), (2, "S02", None, None, "Who?"), (3, "S01", None, None, "one"), (3, "S10", None, None, "two")]


def test_json_objects(spark):
    raw = ['```json\n{"a": 1}\n```', 'Sure: {"a": 2} done', "[1]", '{"a": ', None]
    got = [r.x for r in spark.createDataFrame([(x,) for x in raw], "s string").select(readers.json_object(F.col("s"), "a int").alias("x")).collect()]
    assert [x and x.a for x in got] == [1, 2, None, None, None]


def test_archives_inventory_and_reports(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("viber/a.png", b"1")
        z.writestr("../out.png", b"2")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    (tmp_path / "__MACOSX").mkdir()
    (tmp_path / "__MACOSX" / "x.png").write_bytes(b"3")
    (tmp_path / "report.txt").write_bytes("﻿café".encode())
    (tmp_path / "latin.txt").write_bytes("café".encode("latin-1"))
    got = readers.archive_members(spark, str(tmp_path)).collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("viber/a.png", b"1")] and got[0].folder.startswith("in_")
    files = {r.rel_path: r.kind for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert files == {"in.zip": "archive", "broken.zip": "archive", "report.txt": "report", "latin.txt": "report"}
    assert {r.text for r in readers.reports(spark, str(tmp_path)).collect()} == {"café"}


def test_text_forms(spark):
    df = spark.createDataFrame([(1, "S01", 0.5, 2.0, "hi"), (2, "S02", None, 2.0, "yo")], "n int, l string, s double, e double, m string")
    got = [tuple(r) for r in df.select(sinks.turn_line(F.col("n"), F.col("l"), F.col("s"), F.col("e"), F.col("m")), sinks.offset_text(F.coalesce("s", F.lit(-1.0)))).collect()]
    assert got == [("TURN_001 | [0.50-2.00] S01: hi", "0.5"), ("TURN_002 | S02: yo", "0")]
    assert sinks.manifest(df.select("n"), {"mode": "x"}).first().value == '{"settings":{"mode":"x"},"counts":{"n":1}}'
