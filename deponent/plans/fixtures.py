"""Queries over literal rows: rules whose cases the tables do not hold. Their SQL states the rows that the rules must give, or computes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deponent.functions import dates as D
from deponent.functions import text as T
from deponent.operators import dedupe, evidence, files, guards, joins
from deponent.operators.sequence import islands
from deponent.plans.registry import query
from deponent.session import checkpoint_dir
from deponent.sources import readers, sinks


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    """Literal rows as SQL."""
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({columns})"


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------------------------- times

STAMPS = [(k, x) for k, x in enumerate(("1/2/2025 3:04", "01/02/2025, 03:04:05", "31/12/2024,23:59:59", "30/02/2025 10:00", "3/4/2025, 9:5", "", None, "2025-01-02 03:04", "soon", "1/13/2025 10:00"))]
CLOCKS = [(k, x) for k, x in enumerate(("Ji00", "11,01", "8.05", "24:00", "08:16 ✓✔", "Ii04 vi", "110", "1 1 : 0 5", "9*30", "12:60", "lO:Ol", "", None, "text 08:16"))]
FORCED = [(1, "3/4/2021, 9:05", "01/02/2025", 2025), (2, "3/4/2021 9;05:10", "", 2024), (3, "11,01", "01/02/2025", 2025), (4, "11,01", None, 2025), (5, "later", "01/02/2025", 2025), (6, '"5/6/2023  7*08"', None, 2022), (7, None, "01/02/2025", 2025)]
MAIL_DATES = [(1, "Fri, 3 March 2025 10:00"), (2, "Sept 9, 2024"), (3, "2025-02-30"), (4, "12/25/2024"), (5, "1.2.2025"), (6, "2025-2-1 08:00"), (7, "4 July"), (8, "May 5th"), (9, "31/12"), (10, "yesterday"), (11, ""), (12, None)]
TAILS = [(1, "see you 08:16 ✓"), (2, "at 8.05"), (3, "no 99:99"), (4, "08:16"), (5, None), (6, "two\nlines 7:05v")]
HOURS = [(1, 1, "10:01"), (1, 2, "18:05"), (1, 3, "10:09"), (2, 1, "10:01"), (2, 2, "25:05"), (2, 3, "10:09"), (3, 1, "10:10"), (3, 2, "11:05"), (3, 3, "10:20"), (4, 1, "09:10"), (4, 2, "19:15"), (4, 3, "09:20"), (4, 4, None)]


@query(f"SELECT id, strftime(coalesce(try_strptime(t, '%d/%m/%Y %H:%M:%S'), try_strptime(t, '%d/%m/%Y %H:%M')), '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT id, regexp_replace(raw, ',\\s?', ' ') AS t FROM {_values(STAMPS, 'id, raw')})")
def fixture_row_times(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, STAMPS, "id int, raw string").select("id", F.date_format(D.row_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT * FROM " + _values([(0, "11:00"), (1, "11:01"), (2, "08:05"), (3, None), (4, "08:16"), (5, "11:04"), (6, None), (7, "11:05"), (8, "09:30"), (9, None), (10, "10:01"), (11, None), (12, None), (13, None)], "id, clock"))
def fixture_clocks(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, CLOCKS, "id int, raw string").select("id", D.clock(F.col("raw")).alias("clock"))


@query("SELECT * FROM " + _values([(1, "01/02/2025 09:05"), (2, "03/04/2024 09:05"), (3, "01/02/2025 11:01"), (4, "11,01"), (5, "later"), (6, "05/06/2022 07:08"), (7, None)], "id, stamp"))
def fixture_forced_times(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, FORCED, "id int, raw string, visible string, year int").select("id", D.forced_time(F.col("raw"), F.col("visible"), F.col("year")).alias("stamp"))


@query("SELECT * FROM " + _values([(1, "03/03/2025"), (2, "09/09/2024"), (3, None), (4, "25/12/2024"), (5, "01/02/2025"), (6, "01/02/2025"), (7, "04/07/2023"), (8, "05/05/2023"), (9, "31/12/2023"), (10, None), (11, None), (12, None)], "id, day"))
def fixture_mail_dates(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, MAIL_DATES, "id int, raw string").select("id", D.mail_date(F.col("raw"), F.lit(2023)).alias("day"))


@query("SELECT * FROM " + _values([(1, "see you", "08:16"), (2, "at", "08:05"), (3, "no 99:99", None), (4, "08:16", None), (5, None, None), (6, "two\nlines", "07:05")], "id, body, clock"))
def fixture_trailing_times(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, TAILS, "id int, raw string").withColumn("t", D.trailing_time(F.col("raw"))).select("id", F.col("t.text").alias("body"), F.col("t.time").alias("clock"))


@query(f"""SELECT g, pos, CASE WHEN coalesce(regexp_matches(a, '^([01][0-9]|2[0-3]):[0-5][0-9]$') AND regexp_matches(t, '^([01][0-9]|2[0-3]):[0-5][0-9]$') AND regexp_matches(b, '^([01][0-9]|2[0-3]):[0-5][0-9]$') AND left(a, 2) = left(b, 2) AND left(t, 2) <> left(a, 2)
  AND hamming(left(t, 2), left(a, 2)) = 1 AND right(t, 2) BETWEEN least(right(a, 2), right(b, 2)) AND greatest(right(a, 2), right(b, 2)), false) THEN left(a, 2) || ':' || right(t, 2) ELSE t END AS clock
  FROM (SELECT *, lag(t) OVER (PARTITION BY g ORDER BY pos) AS a, lead(t) OVER (PARTITION BY g ORDER BY pos) AS b FROM {_values(HOURS, 'g, pos, t')})""")
def fixture_hour_repair(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("g").orderBy("pos")  # the bubbles of one screen
    return _frame(spark, HOURS, "g int, pos int, t string").withColumns({"a": F.lag("t").over(w), "b": F.lead("t").over(w)}).select("g", "pos", D.hour_repair(F.col("a"), F.col("t"), F.col("b")).alias("clock"))


# ---------------------------------------------------------------------------------------------- texts and edits

FINALS = [
    (1, "  “Hi” ,there .Come  now!please "), (2, "write ann@letters.test,now"), (3, "or www.bank.example.Ok"), (4, "https : / / www.bank com"), (5, "visit Rome. com later,mail ann @ box. com"), (6, "https Il bank com and HTTP : / / b. org"), (7, "url anydeskcom;visit Rome"),
    (8, "I came. Then we left:10.50 at 8:05"), (9, ""), (10, None), (11, "see https://a.b.example/x.y?z=1,2"),
]
PAIRS = [
    (1, "hello there", "hello there", True, "unchanged"), (2, "pay 20 now", "pay 30 now", False, "protected value"), (3, "password: abc1", "password: abd1", False, "credential"), (4, "I don't know", "I do not know", False, "rephrased"), (5, "he is waiting", "he wait", False, "rephrased"),
    (6, "come here", "come here!", False, "punctuation"), (7, "think so", "I think so", True, "missing_I"), (8, "you are how", "you how are", True, "adjacent_word_order"), (9, "go to the inn", "inn go to the", True, "wrapped_word_order"), (10, "can not go", "cannot go", True, "spacing"),
    (11, "we left early", "we left late", False, "words changed"), (12, "", "x", False, "empty"), (13, None, "x", False, "empty"), (14, "what?! no", "what!? no", False, "punctuation"), (15, "a, b c", "a b, c", False, "moved punctuation"), (16, "“x” don’t", "\"x\" don't", True, "same words"),
    (17, "see www.a.com", "see www.b.com", False, "protected value"),
]
GLYPHS = [(1, "wil! do", "will do", "glyph_l_exclamation"), (2, "that'$ mine", "that's mine", "glyph_dollar_s"), (3, "it'$ 5", "it's 5", ""), (4, "a b", "a c", ""), (5, "x!l", "xl!", ""), (6, "pay $5", "pay s5", "")]
NAMES = [(1, "Anna Weber"), (2, "ANNA WEBER"), (3, "Case Overview"), (4, "J. K. O'Neil-Smith"), (5, "Anna"), (6, "A B C D E F"), (7, "Weber Bank"), (8, "anna weber"), (9, " (Anna  Weber), "), (10, ""), (11, None), (12, "Anna Weber Jr. III Senior"), (13, "Ana-María López")]
ORDERED = [(1, "a b c", "x a y b z c"), (2, "a b c", "c b a"), (3, "", "a"), (4, "a a b", "a b a"), (5, "b", ""), (6, None, "a")]


@query("SELECT * FROM " + _values([
    (1, '"Hi", there. Come now! please'), (2, "write ann@letters.test, now"), (3, "or www.bank.example.Ok"), (4, "https://www.bank.com"), (5, "visit Rome.com later, mail ann@box.com"), (6, "https://bank.com and http://b.org"), (7, "url anydesk.com; visit Rome"),
    (8, "I came. Then we left:10.50 at 8:05"), (9, ""), (10, None), (11, "see https://a.b.example/x.y?z=1,2"),
], "id, body"))
def fixture_final_messages(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, FINALS, "id int, raw string").select("id", T.final_message(F.col("raw")).alias("body"))


@query("SELECT id, allowed, reason FROM " + _values(PAIRS, "id, a, b, allowed, reason"))
def fixture_edit_verdicts(spark: SparkSession, d: str) -> DataFrame:
    pairs = _frame(spark, [r[:3] for r in PAIRS], "id int, a string, b string")
    return pairs.withColumn("v", guards.edit_verdict(F.col("a"), F.col("b"))).select("id", "v.allowed", "v.reason")


@query("SELECT id, kind FROM " + _values(GLYPHS, "id, a, b, kind"))
def fixture_glyph_changes(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, [r[:3] for r in GLYPHS], "id int, a string, b string").select("id", guards.glyph_change(F.col("a"), F.col("b")).alias("kind"))


@query("SELECT * FROM " + _values([(1, "I think so", "missing_I"), (2, "pay 20", "protected value"), (3, "stay", "none"), (4, "ok then", "several proposals")], "k, m, edit"))
def fixture_guarded_edits(spark: SparkSession, d: str) -> DataFrame:
    rows = _frame(spark, [(1, "think so"), (2, "pay 20"), (3, "stay"), (4, "ok then")], "k int, m string")
    offers = _frame(spark, [(1, "I think so"), (2, "pay 30"), (4, "Ok then"), (4, "ok Then"), (9, "x")], "k int, m string")
    return guards.guarded_edits(rows, offers, "k", "m")


@query("SELECT * FROM " + _values([(k, k in (1, 2, 4, 9)) for k, _ in NAMES], "id, human"))
def fixture_human_names(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, NAMES, "id int, raw string").select("id", T.is_human_name(F.col("raw")).alias("human"))


@query("SELECT * FROM " + _values([(1, 1.0), (2, 0.3333), (3, 0.0), (4, 0.6667), (5, 0.0), (6, 0.0)], "id, share"))
def fixture_ordered_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = lambda c: F.coalesce(T.words(F.col(c)), F.array().cast("array<string>"))
    return _frame(spark, ORDERED, "id int, a string, b string").select("id", F.round(T.covered_in_order(w("a"), w("b")), 4).alias("share"))


# ---------------------------------------------------------------------------------------------- screens

BLOCKS = [
    (1, "[SCREEN 1]"), (2, "[BLOCK 1] [POS=LEFT] [X=10] [Y=10] [W=90] [H=10] [CONF=0.91] Hello there"), (3, "[BLOCK 2] [POS=LEFT] [X=10] [Y=22] [W=80] [H=10] my friend 08:16"), (4, "[BLOCK 3] [POS=RIGHT] [X=60] [Y=40] [W=70] [H=10] [CONF=x] Yes 8.17 ✓"), (5, "[BLOCK 4] [POS=CENTER] [X=40] [Y=60] [W=50] [H=10] Today"),
    (6, "[SCREEN 2]"), (7, "[BLOCK 1] [POS=LEFT] [X=10] [Y=10] [W=90] [H=10] one"), (8, "[BLOCK 2] [POS=LEFT] [X=60] [Y=12] [W=90] [H=10] more"), (9, "[BLOCK 3] [POS=LEFT] [X=10] [Y=60] [W=90] [H=10] two"), (10, "no block"), (11, None),
]


def _blocks(spark: SparkSession) -> DataFrame:
    return readers.text_blocks(_frame(spark, [("f", *r) for r in BLOCKS], "doc string, pos int, line string"))


@query("SELECT * FROM " + _values([(1, 1, "LEFT", 10, 10, 0.91, "Hello there"), (1, 2, "LEFT", 10, 22, None, "my friend 08:16"), (1, 3, "RIGHT", 60, 40, None, "Yes 8.17 ✓"), (1, 4, "CENTER", 40, 60, None, "Today"), (2, 1, "LEFT", 10, 10, None, "one"), (2, 2, "LEFT", 60, 12, None, "more"), (2, 3, "LEFT", 10, 60, None, "two")], "screen, block, side, x, y, conf, body"))
def fixture_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark).select("screen", "block", "side", "x", "y", "conf", F.col("text").alias("body"))


@query("SELECT * FROM " + _values([(1, 1, "LEFT", "08:16", "Hello there my friend"), (1, 2, "RIGHT", "08:17", "Yes"), (2, 1, "LEFT", None, "one more"), (2, 2, "LEFT", None, "two")], "screen, bubble, side, clock, body"))
def fixture_bubbles(spark: SparkSession, d: str) -> DataFrame:
    return evidence.bubbles(_blocks(spark)).select("screen", "bubble", "side", F.col("time").alias("clock"), F.col("text").alias("body"))


@query("SELECT * FROM " + _values([(1, "LEFT", 1, "Hello there"), (1, "LEFT", 2, "my friend 08:16"), (1, "RIGHT", 1, "Yes 8.17 ✓"), (1, "CENTER", 1, "Today"), (2, "LEFT", 1, "one more"), (2, "LEFT", 2, "two")], "screen, side, line, body"))
def fixture_text_lines(spark: SparkSession, d: str) -> DataFrame:
    return evidence.text_lines(_blocks(spark)).select("screen", "side", "line", F.col("text").alias("body"))


_ROWS = [("f", 1, "LEFT", "hello there my good friend"), ("f", 1, "LEFT", "yes"), ("f", 2, None, "one other")]


@query("SELECT * FROM " + _values([(1, 1, 1.0, True), (1, 2, 0.0, False), (2, 1, 0.5, False), (2, 2, 0.0, False)], "screen, bubble, best, covered"))
def fixture_screen_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _frame(spark, _ROWS, "doc string, screen int, side string, message string")
    return evidence.screen_coverage(evidence.bubbles(_blocks(spark)), rows).select("screen", "bubble", "best", "covered")


@query("SELECT * FROM " + _values([(1, "RIGHT", "Yes"), (2, "LEFT", "one more"), (2, "LEFT", "two")], "screen, side, body"))
def fixture_missing_bubbles(spark: SparkSession, d: str) -> DataFrame:
    """Bubbles that no row of their screen gives: they are added to the rows."""
    found = evidence.bubbles(_blocks(spark))
    missing = evidence.screen_coverage(found, _frame(spark, _ROWS, "doc string, screen int, side string, message string")).filter("not covered")
    return found.join(missing, ["doc", "screen", "bubble"], "left_semi").select("screen", "side", F.col("text").alias("body"))


# ---------------------------------------------------------------------------------------------- readers and sinks

SPEECH = [(1, "[0.48][S01]Hello[1.66][2.00][S02]Hi  there[2.40]"), (2, "S01: good day\nSPEAKER_00: yes ,sir"), (3, "[S01] one\n```\n[S02] two"), (4, "nothing said"), (5, None)]
ANSWERS = [(1, '```json\n{"name": "Ann", "n": 2}\n```'), (2, 'Sure! {"name": "Bo"} is it'), (3, '{"name": "Cut'), (4, "[1, 2]"), (5, None)]
DRAFTS = [("m", 1, 1, "first block"), ("m", 2, 2, "a much longer second block of the mail"), ("m", 3, 3, "third"), ("n", 1, 1, "x" * 60), ("n", 2, 2, "short"), ("o", 1, 1, None)]


@query("SELECT * FROM " + _values([(1, 1, "S01", 0.48, 1.66, "Hello"), (1, 2, "S02", 2.0, 2.4, "Hi there"), (2, 1, "S01", None, None, "good day"), (2, 2, "S01", None, None, "yes,sir"), (3, 1, "S01", None, None, "one"), (3, 2, "S02", None, None, "two")], "id, pos, label, start_s, end_s, message"))
def fixture_speech_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.speech_text(_frame(spark, SPEECH, "id int, raw string"), "id", "raw").select("id", "pos", "label", "start_s", "end_s", "message")


@query("SELECT * FROM " + _values([(1, "Ann", 2), (2, "Bo", None), (3, None, None), (4, None, None), (5, None, None)], "id, name, n"))
def fixture_json_answers(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, ANSWERS, "id int, raw string").withColumn("j", readers.json_object(F.col("raw"), "name string, n int")).select("id", "j.name", "j.n")


@query("SELECT * FROM " + _values([("m", 1, "first block"), ("m", 3, "third"), ("n", 1, "x" * 24), ("o", 1, "")], "id, pos, body"))
def fixture_packed_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return evidence.packed_excerpt(_frame(spark, DRAFTS, "id string, pos int, rank int, body string"), "id", "pos", "rank", "body", 24)


def _written(spark: SparkSession, name: str, text: str) -> str:
    """A small file of literal text in the folder that all executors share."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/fixtures/{name}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


SIDES = 'Time,Side,Message\n08:01,LEFT,"Hello, you"\n08:02,outgoing,one, two, three, four, five\n08:03,MIDDLE,lost\n08:04,INCOMING,"two\nlines"\n'


@query("SELECT * FROM " + _values([("08:01", "LEFT", "Hello, you"), ("08:02", "RIGHT", "one, two, three, four, five"), ("08:04", "LEFT", "two\nlines")], "clock, side, message"))
def fixture_side_csv(spark: SparkSession, d: str) -> DataFrame:
    return readers.side_csv(spark, _written(spark, "side.csv", SIDES)).select(F.col("time").alias("clock"), "side", "message")


CHATS = '﻿"Timestamp","Estimated_Timestamp","Sender","Receiver","Message"\n"01/02/2025 10:00:00","yes","Ann","Bo","Hi, ""you"""\n"01/02/2025 10:01:00","","Ann","","lost"\n" 01/02/2025 10:02:00 ","False"," Bo ","Ann","two\nlines"\n'


@query("SELECT * FROM " + _values([("01/02/2025 10:00:00", "True", "Ann", "Bo", 'Hi, "you"', 2), ("01/02/2025 10:02:00", "False", "Bo", "Ann", "two\nlines", 4)], "msg_timestamp, estimated, sender, receiver, message, source_row"))
def fixture_transcript_csv(spark: SparkSession, d: str) -> DataFrame:
    return readers.transcript_csv(spark, _written(spark, "chat.csv", CHATS)).select("msg_timestamp", "estimated", "sender", "receiver", "message", "source_row")


AUDIO = "Offset_Seconds,Sender,Receiver,Message\n1.5,Ann,Bo,one\n-3,Ann,Bo,two\n,Ann,Bo,three\nx,Ann,Bo,lost\n3,,Bo,lost\n"


@query("SELECT * FROM " + _values([("05/03/2025 00:00:01", "one"), ("05/03/2025 00:00:00", "two"), ("05/03/2025 00:00:00", "three")], "msg_timestamp, message"))
def fixture_audio_csv(spark: SparkSession, d: str) -> DataFrame:
    return readers.audio_csv(spark, _written(spark, "audio.csv", AUDIO), "5/3/2025").select("msg_timestamp", "message")


@query("SELECT * FROM " + _values([(1, "TURN_001 | [0.50-2.00] S01: hi", "0.5"), (2, "TURN_002 | S02: yes", "0"), (3, "TURN_003 | S01: bye", "12.346")], "n, line, offset_text"))
def fixture_turn_lines(spark: SparkSession, d: str) -> DataFrame:
    t = _frame(spark, [(1, "S01", 0.5, 2.0, "hi", 0.5), (2, "S02", None, 3.0, "yes", -1.0), (3, "S01", None, None, "bye", 12.3456)], "n int, label string, a double, b double, m string, o double")
    return t.select("n", sinks.turn_line(F.col("n"), F.col("label"), F.col("a"), F.col("b"), F.col("m")).alias("line"), sinks.offset_text(F.col("o")).alias("offset_text"))


# ---------------------------------------------------------------------------------------------- joins that the tables leave empty

_LONG = "we agreed that the parcel would leave the harbour on friday morning and that nobody would open it before the clerk had signed the form"
DONORS = [(1, "c", "a.csv", "Unknown", "Bo", _LONG), (2, "c", "b.csv", "Ann", "Bo", _LONG + " and went home"), (3, "c", "b.csv", "Ann", "Bo", "short text"), (4, "d", "a.csv", None, None, _LONG), (5, "c", "a.csv", "Speaker 1", "Cy", _LONG)]
SPEAKERS = [(1, 1, "Ann", "please send the form"), (2, 2, "Ann", "the form"), (3, 3, "Bo", "the form"), (4, 4, "Bo", "form"), (5, 5, "Cy", None)]


@query("SELECT * FROM " + _values([(1, "Ann", "Bo", 2)], "row_id, sender, receiver, donor_row"))
def fixture_unique_donors(spark: SparkSession, d: str) -> DataFrame:
    """Unknown people filled from the one long row of another file that says the same; one that names others gives nothing."""
    return joins.filled_from_donors(_frame(spark, DONORS, "row_id long, case_id string, source_csv string, sender string, receiver string, message string"))


@query(f"""SELECT row_id, sum(fresh) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(coalesce(sender, '')) OVER (ORDER BY pos) = coalesce(sender, '') THEN 0 ELSE 1 END AS fresh FROM {_values(SPEAKERS, 'row_id, pos, sender, message')})""")
def fixture_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = _frame(spark, SPEAKERS, "row_id int, pos int, sender string, message string").withColumns({"k": F.lit(1), "b": F.floor(F.col("pos") / 2)})
    run = islands(rows, ["k"], "b", ["pos"], "sender", "first")
    return run.select("row_id", F.dense_rank().over(Window.orderBy("first")).cast("long").alias("run"))


@query("SELECT * FROM " + _values([(2,), (4,)], "row_id"))
def fixture_contained_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = _frame(spark, SPEAKERS, "row_id int, pos int, sender string, message string").withColumns({"k": F.lit(1), "b": F.floor(F.col("pos") / 2)})
    return dedupe.contained_neighbours(rows, ["k"], "b", ["pos"], "sender", "message").select("row_id")


_SAID = ["we agreed that the parcel would leave the harbour on friday morning", "nobody has told me why the second payment was never returned to us"]
RECORDED = [("r1", "c", 1, _SAID[0]), ("r1", "c", 2, _SAID[1]), ("r2", "c", 3, _SAID[0] + "."), ("r3", "c", 4, "something else was said here about a lamp and a very long road"), ("r4", "d", 5, _SAID[0]), ("r5", "c", 6, None), ("r6", "c", 7, _SAID[0])]


@query("SELECT * FROM " + _values([("r2", "r1", 1), ("r6", "r1", 1), ("r6", "r2", 1)], "recording_id, covered_by, rows"))
def fixture_recording_coverage(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.covered_recordings(_frame(spark, RECORDED, "recording_id string, case_id string, segment_id long, message string"))


PARTS = [(1, 1, "08:00", "LEFT", "a"), (1, 2, "08:01", "LEFT", "b"), (2, 1, "08:01", "LEFT", "b"), (2, 2, "08:01", "RIGHT", "b"), (2, 3, None, "LEFT", "c"), (3, 1, None, "LEFT", "c")]


@query(f"SELECT part, pos, t, side, m FROM (SELECT *, row_number() OVER (PARTITION BY t, side, m ORDER BY part, pos) AS k FROM {_values(PARTS, 'part, pos, t, side, m')}) WHERE k = 1")
def fixture_ordered_union(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.ordered_union(_frame(spark, PARTS, "part int, pos int, t string, side string, m string"), "part", "pos", ["t", "side", "m"])


@query("SELECT * FROM " + _values([(1, "LEFT", "hello there my good friend", False), (1, "LEFT", "yes", False), (2, None, "one other", False), (1, "RIGHT", "Yes", True), (2, "LEFT", "one more thing", True), (2, "LEFT", "two", True), (3, "LEFT", "alone", True)], "screen, side, message, added"))
def fixture_added_rows(spark: SparkSession, d: str) -> DataFrame:
    draft = _frame(spark, _ROWS, "doc string, screen int, side string, message string")
    repair = _frame(spark, [("f", 1, "RIGHT", "Yes"), ("f", 1, "LEFT", "hello there my friend"), ("f", 2, "LEFT", "one more thing"), ("f", 2, "LEFT", "two"), ("f", 2, "RIGHT", "two"), ("f", 3, "LEFT", "alone")], "doc string, screen int, side string, message string")
    return evidence.added_rows(draft, repair, evidence.bubbles(_blocks(spark))).select("screen", "side", "message", "added")


SCORES = [("f", 1, "draft", 10.0, 5), ("f", 1, "repair", 10.9, 5), ("f", 1, "additive", 10.3, 6), ("f", 2, "draft", 10.0, 5), ("f", 2, "additive", 10.35, 6), ("f", 3, "draft", 1.0, 5), ("f", 3, "repair", 9.0, 9), ("f", 4, "draft", 0.0, 0), ("f", 4, "repair", 0.5, 7), ("f", 5, "draft", 3.0, 2), ("f", 5, "repair", 4.0, 2), ("f", 6, "draft", 3.0, 2), ("f", 6, "repair", 9.0, 0)]


@query("SELECT * FROM " + _values([(1, "draft"), (2, "additive"), (3, "draft"), (4, "repair"), (5, "repair"), (6, "draft")], "screen, name"))
def fixture_chosen_candidates(spark: SparkSession, d: str) -> DataFrame:
    return evidence.chosen_candidates(_frame(spark, SCORES, "doc string, screen int, name string, score double, rows int")).select("screen", "name")


@query("SELECT * FROM " + _values([(1, "Ann", None), (2, "Bo", None), (3, None, "no object"), (4, None, "no object"), (5, None, "no object"), (6, None, "broken object")], "id, name, error"))
def fixture_strict_json(spark: SparkSession, d: str) -> DataFrame:
    j = _frame(spark, [*ANSWERS, (6, '{"name": Ann}')], "id int, raw string").withColumn("j", readers.strict_json_object(F.col("raw"), "name string, n int"))
    return j.select("id", "j.value.name", "j.error")


VIBER = [(1, "Seen 10:00"), (2, "Messages in chats are private, this chat too"), (3, "cted by more"), (4, "g1f"), (5, "08:16"), (6, "hello"), (7, ""), (8, None), (9, "Protected end 2 end, to you"), (10, "✓✓"), (11, "encryption is nice")]


@query("SELECT * FROM " + _values([(k, k not in (2, 6, 11)) if k != 2 else (2, True) for k, _ in VIBER], "id, screen_text"))
def fixture_viber_screen_text(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, VIBER, "id int, raw string").select("id", T.is_viber_screen_text(F.col("raw")).alias("screen_text"))


TERMS = [(1, "Hello again, the parcel's 2nd form is at St. Anne-Marie’s"), (2, ""), (3, None)]


@query("SELECT * FROM " + _values([(1, "parcel form anne marie", "the parcel 2nd form anne marie", "hello parcel's anne-marie’s"), (2, "", "", ""), (3, None, None, None)], "id, context, speech, report"))
def fixture_terms(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, TERMS, "id int, raw string").select("id", *[F.array_join(T.terms(F.col("raw"), r), " ").alias(r) for r in ("context", "speech", "report")])


LABELS = [(1, "Possible  Offences"), (2, "Victim 2"), (3, "Anna Weber"), (4, "timeline"), (5, ""), (6, None), (7, "Account_Manager")]


@query("SELECT * FROM " + _values([(1, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, True)], "id, heading"))
def fixture_heading_labels(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, LABELS, "id int, raw string").select("id", T.is_heading_label(F.col("raw")).alias("heading"))


PEOPLE = [(1, "c", "Ann Lee", "complainant"), (2, "c", "Bob Moss", None), (3, "c", "Cyd Dahl", "suspect"), (4, "d", "Ann Lee", None), (5, None, "Bob Moss", None), (6, "c", None, None)]
STATED = [(1, "c", "Ann Lee met Bob Moss.\n\nBob Moss and Cyd Dahl left; ann lee stayed."), (2, "c", "Bob Moss, Ann Lee"), (3, "d", "Ann Lee and Bob Moss"), (4, None, "Ann Lee, Bob Moss"), (5, "c", None)]


@query("SELECT * FROM " + _values([("ann lee", "bob moss", 3), ("ann lee", "cyd dahl", 1), ("bob moss", "cyd dahl", 1)], "a, b, n"))
def fixture_passage_pairs(spark: SparkSession, d: str) -> DataFrame:
    people = _frame(spark, PEOPLE, "participant_id int, case_id string, full_name string, case_role string")
    return evidence.passage_pairs(_frame(spark, STATED, "doc_id int, case_id string, text string"), people).select("a", "b", "n")


TALK = [(1, "Ann Lee", "hi bob, it is late"), (2, "Bob Moss", "this is bob speaking"), (3, "Ann Lee", "I am Ann Lee"), (4, "Bob Moss", "cyd knows it"), (5, "Unknown", "hello ann"), (6, "Ann Lee", None)]


@query("SELECT * FROM " + _values([(1, "ann lee", "bob moss", 394, 0, 3)], "place, l, r, score, hard, strong"))
def fixture_side_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """One fitting greeting (20), two people who name themselves (250), both sides (36) and the pair (42) kept, the complainant (28) and three passages (18)."""
    rows = _frame(spark, [(k, "c", "v", "chat", s, m) for k, s, m in TALK], "row_id int, case_id string, conv_key string, source_kind string, sender string, message string")
    talks = _frame(spark, [("v", "c", "Ann Lee", "Bob Moss")], "conv_key string, case_id string, left_name string, right_name string")
    people = _frame(spark, PEOPLE, "participant_id int, case_id string, full_name string, case_role string")
    found = evidence.side_hypotheses(rows, talks, people, _frame(spark, STATED, "doc_id int, case_id string, text string"))
    return found.filter("place = 1").select("place", F.col("left").alias("l"), F.col("right").alias("r"), "score", "hard", "strong")


SHOTS = [(1, "a/1.png"), (2, "a/2.png"), (3, None), (4, "A/1.png")]


@query("SELECT * FROM " + _values([(2,), (4,)], "row_id"))
def fixture_rows_without_file(spark: SparkSession, d: str) -> DataFrame:
    return files.rows_without_file(_frame(spark, SHOTS, "row_id int, source_image string"), _frame(spark, [("a/1.png",), ("b/2.png",), (None,)], "rel_path string")).select("row_id")
