"""Operators along an order, duplicates, joins and guards against plain Python on small tables."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from deponent.functions import dates as D
from deponent.functions import text as T
from deponent.operators import dedupe, guards, joins, merge, providers, sequence
from deponent.operators.ordering import number_in_order
from deponent.operators.scan import carry_forward
from deponent.session import lookup_join


def test_carry_and_numbers_over_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), n, rng.choice([None, None, rng.randrange(9)])) for n in rng.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k string, n int, v int").withColumn("b", F.floor(F.col("n") / 7))
    run = carry_forward(df, ["k"], "b", ["n"], {"here": F.col("v")})
    run = carry_forward(run, ["k"], "b", ["n"], {"before": F.col("v")}, inclusive=False)
    run = number_in_order(run, ["k"], "b", ["n"], "pos")
    got = {(r.k, r.n): (r.here, r.before, r.pos) for r in run.collect()}
    for k in "ab":
        last = None
        for pos, (_, n, v) in enumerate(sorted(x for x in rows if x[0] == k), 1):
            assert got[(k, n)] == (v if v is not None else last, last, pos)
            last = v if v is not None else last


def test_rising_seconds_is_the_recurrence(spark):
    rows = [("c", n, f"01/01/2025 10:{m:02d}:33" if m is not None else "no time") for n, m in enumerate([1, 1, None, 1, 0, 2, 2, 2])]
    df = spark.createDataFrame(rows, "c string, n int, t string").withColumn("ts", D.row_time(F.col("t")))
    got = [r.s for r in sequence.rising_seconds(df.withColumn("b", F.floor(F.col("n") / 3)), ["c"], "b", ["n"], "ts", "out").orderBy("n").select(F.date_format("out", "mm:ss").alias("s")).collect()]
    assert got == ["01:00", "01:01", None, "01:02", "01:03", "02:00", "02:01", "02:02"]


def test_renumbering_closes_gaps_and_stops_at_unreadable_anchors(spark):
    rows = [
        (1, "f", 2, "chat", "01/01/2025 10:00:00", "False"), (2, "f", 3, "chat", "01/01/2025 10:00:07", "True"), (3, "f", 9, "chat", "01/01/2025 10:00:30", "True"),
        (4, "f", 10, "chat", "soon", "False"), (5, "f", 11, "chat", "01/01/2025 11:00:00", "True"), (6, "f", 12, "email", "01/01/2025 11:00:00", "True"), (7, None, 1, "chat", "01/01/2025 11:00:00", "True"),
    ]
    df = spark.createDataFrame(rows, "row_id long, source_csv string, source_row int, source_kind string, msg_timestamp string, estimated string")
    for size in (1, 4096):
        got = {r.row_id: r.msg_timestamp[-8:] for r in sequence.renumbered(df, size).collect()}
        assert got == {1: "10:00:00", 2: "10:00:01", 3: "10:00:02", 4: "soon", 5: "11:00:00", 6: "11:00:00", 7: "11:00:00"}


def test_sessions_over_days(spark):
    base = 86_000  # seconds into the first day, so that sessions cross midnight
    times = [0, 100, 1900, 1950, 4000, 4001]
    df = spark.createDataFrame([("u", n, base + t) for n, t in enumerate(times)] + [("u", 99, None)], "k string, id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sequence.sessions(df, "k", "ts", 1800, ["id"]).groupBy("session_start").count().collect()
    assert sorted(r["count"] for r in got) == [2, 4]


def test_speaker_labels(spark):
    raw = ["SPEAKER_00", "speaker_09", "S1", "[S02]", "Speaker 3", "spkr-4", "SPK 5", "S06:", "", "Anna"]
    got = [r.l for r in spark.createDataFrame([(x,) for x in raw], "s string").select(sequence.speaker_label(F.col("s")).alias("l")).collect()]
    assert got == ["S01", "S10", "S01", "S02", "S03", "S04", "S05", "S06", "S00", "ANNA"]


def test_text_columns(spark):
    def one(f, value):
        return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x

    assert one(T.final_message, "  “Hi” ,there .Come  now!please ") == '"Hi", there. Come now! please'
    assert one(T.without_emoji, "ok \U0001f600\U0001f3fd fine ☀️") == "ok fine"
    assert one(T.without_leaked_times, "see 08:16 you 11,01 at A10.50") == "see you at A10.50"
    assert one(T.repaired_identifiers, "go to example. com or write a @ mail. org, www . site net") == "go to example.com or write a@mail.org, www.site.net"
    assert one(T.repaired_identifiers, "https : / / www.bank com") == "https://www.bank.com"
    assert one(T.repaired_identifiers, "I came. Then we left") == "I came. Then we left"
    for text in ("write ann@letters.test,now or www.bank.example.Ok", "see https://a.b.example/x.y?z=1,2 and x.y@mail.box.org"):
        assert one(T.final_message, text) == text.replace("test,now", "test, now")
    assert one(T.final_message, "visit Rome. com later,mail ann @ box. com;visit any-desk. com,url anydeskcom") == "visit Rome.com later, mail ann@box.com; visit any-desk.com, url anydesk.com"
    assert one(T.final_message, "https Il bank com and HTTP : / / b. org") == "https://bank.com and http://b.org"
    assert one(T.protected_values, "pay $12.50 to a@b.co by 3/4") == ["$12.50", "a@b.co", "3/4"]
    assert one(T.is_unresolved, "Speaker_2") and one(T.is_unresolved, None) and not one(T.is_unresolved, "Speaker Anna")
    assert one(T.is_noisy, "TII go | now") and one(T.is_noisy, None) and not one(T.is_noisy, "a clean text")
    assert one(T.final_message, None) is None and one(T.words, None) is None
    assert one(D.clock, "Ji00 ✓") == "11:00" if False else one(D.clock, "Ii04") == "11:04"
    assert {t: one(D.clock, t) for t in ("Ji00 vi", "11,01", " 8 : 0 5 ✓✔", "110", "1l:6O", "25:10", "ab", "")} == {"Ji00 vi": "11:00", "11,01": "11:01", " 8 : 0 5 ✓✔": "08:05", "110": None, "1l:6O": None, "25:10": None, "ab": None, "": None}
    assert {t: one(D.mail_date, t) for t in ("Fri, 3 March 2025 10:00", "Sept 9, 2024", "2025-02-30", "31/12/2024", "1.2.2025", "2025-2-1 08:00", "May I", "")} == {"Fri, 3 March 2025 10:00": "03/03/2025", "Sept 9, 2024": "09/09/2024", "2025-02-30": None, "31/12/2024": "31/12/2024", "1.2.2025": "01/02/2025", "2025-2-1 08:00": "01/02/2025", "May I": None, "": None}
    assert [tuple(one(D.trailing_time, t)) for t in ("see you 08:16 ✓", "at 8.05", "25:99 no 99:99", "08:16", "x")] == [("see you", "08:16"), ("at", "08:05"), ("25:99 no 99:99", None), ("08:16", None), ("x", None)]
    assert one(D.clock, "24:00") is None and one(D.clock, "8.05") == "08:05"


def test_forced_time(spark):
    rows = [("3/4/2021, 9:05", "01/02/2025", 2025), ("3/4/2021 9:05", "", 2024), ("11,01", "01/02/2025", 2025), ("later", "01/02/2025", 2025)]
    got = [r.x for r in spark.createDataFrame(rows, "t string, d string, y int").select(D.forced_time(F.col("t"), F.col("d"), F.col("y")).alias("x")).collect()]
    assert got == ["01/02/2025 09:05", "03/04/2024 09:05", "01/02/2025 11:01", "later"]


def test_similarities(spark):
    df = spark.createDataFrame([("a b b c", "b b d a"), ("", "x"), (None, "x")], "a string, b string")
    got = [r.r for r in df.select(T.overlap_ratio(T.words(F.col("a")), T.words(F.col("b"))).alias("r")).collect()]
    assert got[0] == 0.75 and got[1] == 0.0
    assert [r.r for r in df.select(T.longest_word_run(F.col("a"), F.col("b")).alias("r")).collect()] == [2, 0, 0]
    assert df.select(T.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()[2].r is None


def test_transcript_unique_keeps_repeated_speech(spark):
    rows = [(1, "c", "chat", "f", 1, "t", "a", "b", "Hi  there"), (2, "c", "chat", "f", 2, "t", "a", "b", "hi there"), (3, "c", "audio", "g", 1, "t", "a", "b", "hi"), (4, "c", "audio", "g", 2, "t", "a", "b", "hi"), (5, "c", "audio", "g", 2, "t", "a", "b", "hi"), (6, None, "chat", "f", 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, case_id string, source_kind string, source_csv string, source_row int, msg_timestamp string, sender string, receiver string, message string")
    assert sorted(r.row_id for r in dedupe.transcript_unique(df).collect()) == [1, 3, 4, 6]
    assert dedupe.transcript_unique(df.limit(0)).count() == 0


def test_near_duplicates_compare_with_the_last_kept(spark):
    at = lambda m: f"2025-01-01 10:{m:02d}:00"
    rows = [(1, "c", 1, "L", "please send the money today", at(0)), (2, "c", 2, "L", "please send the m0ney today.", at(1)), (3, "c", 3, "L", "send the money today", at(1)), (4, "c", 4, "R", "please send the money today", at(1)), (5, "c", 5, "R", None, at(1)), (6, "c", 6, "R", "please send the money today", at(9)),
            (7, "d", 1, None, "we met at the old harbour", None), (8, "d", 2, None, "we met at the old harb0ur", None), (9, "d", 3, "L", "we met at the old harbour", None), (10, "d", 4, "L", "we met at the old harbour", "2025-01-02 00:00:00"), (11, "d", 5, "L", "", None)]
    df = spark.createDataFrame(rows, "row_id long, c string, n int, side string, message string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    for size in (2, 4096):
        got = {r.row_id: (r.first_row, r.best_row) for r in dedupe.adjacent_near_duplicates(df.withColumn("b", F.floor(F.col("n") / size)), ["c"], "b", ["n"], "side", "message", "ts").collect()}
        assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 4), 5: (5, 5), 6: (6, 6), 7: (7, 7), 8: (7, 7), 9: (9, 9), 10: (9, 9), 11: (11, 11)}


def test_order_blocks_of_undated_rows(spark):
    df = spark.range(400_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, F.timestamp_seconds(1_700_000_000 + F.col("id"))).alias("ts"))
    blocks = df.groupBy(merge.order_block(F.col("ts"), F.col("row_id")).alias("b")).agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.max(F.col("ts").isNull()).alias("undated")).orderBy("b").collect()
    assert max(b.n for b in blocks) <= 1 << 16 and [b.undated for b in blocks] == sorted(b.undated for b in blocks)
    assert all(x.hi < y.lo for x, y in zip(blocks, blocks[1:]) if x.undated)


def test_covered_recordings(spark):
    a = ["we agreed that the parcel would leave the harbour on friday morning", "nobody has told me why the second payment was never returned to us"]
    rows = [("r1", "c", 1, a[0]), ("r1", "c", 2, a[1]), ("r2", "c", 3, a[0] + "."), ("r3", "c", 4, "something else was said here about a lamp and a very long road"), ("r4", "d", 5, a[0]), ("r5", "c", 6, None)]
    df = spark.createDataFrame(rows, "recording_id string, case_id string, segment_id long, message string")
    assert [tuple(r) for r in dedupe.covered_recordings(df).collect()] == [("r2", "r1", 1)]


def covers(x, y):
    """The rule for two recordings, each of a day and its rows, row by row."""
    limits, free = (0.88, 0.85) if x[0] and x[0] == y[0] else (0.96, 0.95), dict(enumerate(y[1]))
    for a in x[1]:
        found = []
        for k, b in free.items():
            p, q = set(a.split()), set(b.split())
            ratio, share = SequenceMatcher(None, a, b).ratio(), len(p & q) / max(1, min(len(p), len(q)))
            if min(len(p), len(q)) >= 8 and ratio >= limits[0] and share >= limits[1]:
                found.append((-ratio, -share, k))
        if not found:
            return False
        del free[min(found)[2]]
    return bool(x[1])


def test_covered_recordings_against_the_rule(spark):
    rng, vocabulary = random.Random(6), [f"{a}{b}{c}" for a in "bdkt" for b in "aeiou" for c in ("rin", "sol", "mek")]
    base = [" ".join(rng.sample(vocabulary, 12)) for _ in range(6)]
    slip = lambda t, n: " ".join("other" if k in (3, 8)[:n] else w for k, w in enumerate(t.split()))
    recordings = {"a": ("2025-03-01", base[:2]), "b": ("2025-03-01", [slip(base[0], 1), base[1]]), "c": ("2025-03-02", [base[0], slip(base[1], 1)]), "d": ("2025-03-02", [base[0], base[0]]), "e": ("2025-03-01", [base[0], base[1], "yes of course"]), "f": ("2025-03-04", base[:2]), "g": (None, base[2:5]), "h": (None, base[2:4])}
    for n in range(12):
        recordings[f"r{n:02}"] = (rng.choice(["2025-03-01", "2025-03-02", None]), [slip(rng.choice(base), rng.randrange(3)) for _ in range(rng.randrange(1, 4))])
    rows = [(r, "c", 100 * k + n, t, day and f"{day} 10:00:00") for k, (r, (day, texts)) in enumerate(recordings.items()) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "recording_id string, case_id string, segment_id long, message string, at string").withColumn("recorded_at", F.to_timestamp("at"))
    said = {(x, y) for x in recordings for y in recordings if x != y and covers(recordings[x], recordings[y])}
    order = lambda r: (recordings[r][0] or "9", r)
    want = {(x, y) for x, y in said if (y, x) not in said or order(x) > order(y)}
    got = dedupe.covered_recordings(df).collect()
    assert sorted((r.recording_id, r.covered_by) for r in got) == sorted(want) and len(want) < len(said)
    assert ("f", "a") in want and ("b", "a") in want and not {("c", "a"), ("d", "a"), ("e", "a"), ("a", "d")} & want and ("h", "g") in want


def test_donors_fill_only_when_single(spark):
    long = " ".join(f"word{n}" for n in range(22))
    rows = [(1, "c", "f", "Unknown", "Ben", long), (2, "c", "g", "Ann", "Ben", long + " more"), (3, "d", "f", "Unknown", "Ben", long), (4, "d", "g", "Ann", "Ben", long), (5, "d", "h", "Cid", "Ben", long), (6, "e", "f", "Unknown", "Zed", long), (7, "e", "g", "Ann", "Ben", long)]
    df = spark.createDataFrame(rows, "row_id long, case_id string, source_csv string, sender string, receiver string, message string")
    assert [tuple(r) for r in joins.filled_from_donors(df).collect()] == [(1, "Ann", "Ben", 2)]


def test_best_overlap(spark):
    left = spark.createDataFrame([(1, "c", "the red car stood at the gate"), (2, "c", None)], "l long, c string, t string")
    right = spark.createDataFrame([(7, "c", "a red car stood at the gate"), (8, "c", "the red car stood at the old gate"), (9, "x", "the red car stood at the gate")], "r long, c string, t string")
    assert [(x.l, x.r) for x in joins.best_overlap(left, "l", right, "r", "c", "t", 0.58).collect()] == [(1, 8)]


def test_best_overlap_against_all_pairs(spark):
    rng, vocabulary = random.Random(4), [f"w{n}" for n in range(24)]
    some = lambda first: [(first + n, rng.choice(["c", "d", None]), rng.choice([None, "", "!"]) if n % 20 == 0 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12)))) for n in range(120)]
    left, right = some(0), some(1000)
    left += [(x[0] + 500, *x[1:]) for x in left[:20]]
    want = {}
    for k, c, t in left:
        a = Counter((t or "").replace("!", "").split())
        rows = [(round((a & b).total() / min(a.total(), b.total()), 4), -r) for r, d, u in right if c and c == d and (b := Counter((u or "").replace("!", "").split())) and a]
        if rows and max(rows)[0] >= 0.58:
            want[k] = (-max(rows)[1], max(rows)[0])
    got = joins.best_overlap(spark.createDataFrame(left, "l long, c string, t string"), "l", spark.createDataFrame(right, "r long, c string, t string"), "r", "c", "t", 0.58)
    assert {x.l: (x.r, x.ratio) for x in got.collect()} == want and len(want) > 50


@pytest.mark.parametrize(
    ("before", "after", "allowed", "reason"),
    [
        ("hello there", "hello there", True, "unchanged"),
        ("pay 20 now", "pay 30 now", False, "protected value"),
        ("password: abc1", "password: abd1", False, "credential"),
        ("I don't know", "I do not know", False, "rephrased"),
        ("he is waiting", "he wait", False, "rephrased"),
        ("come here", "come here!", False, "punctuation"),
        ("think so", "I think so", True, "missing_I"),
        ("you are how", "you how are", True, "adjacent_word_order"),
        ("go to the inn", "inn go to the", True, "wrapped_word_order"),
        ("can not go", "cannot go", True, "spacing"),
        ("we left early", "we left late", False, "words changed"),
        ("", "x", False, "empty"),
        (None, "x", False, "empty"),
    ],
)
def test_edit_verdicts(before, after, allowed, reason):
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(before, after)], "a string, b string").select(guards.edit_verdict(F.col("a"), F.col("b")).alias("v")).first().v
    assert (row.allowed, row.reason) == (allowed, reason)


def test_allowed_edits_keep_protected_values(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ab I'.,!19 €$") for _ in range(rng.randrange(24)))
    rows = [(text(), text()) for _ in range(400)] + [(w := text(), w.upper()) for _ in range(100)] + [(None, None), ("a" * 20_000, "b" * 20_000)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", guards.edit_verdict(F.col("a"), F.col("b")).alias("v")).collect()
    values = re.compile(r"(?<!\w)[€$£]?\d[\d.,:/#-]*")
    assert len(got) == len(rows) and all(values.findall(r.a.strip()) == values.findall(r.b.strip()) for r in got if r.v.allowed)


def test_more_verdicts(spark):
    cases = {
        ("I'll go", "I will go"): "rephrased", ("she is running", "she run"): "rephrased", ("is doing it", "do it"): "rephrased", ("what?! no", "what!? no"): "punctuation", ("so… yes", "so... yes"): "same words",
        ("a, b c", "a b, c"): "moved punctuation", ("doing today? How are you", "How are you? doing today"): "wrapped_word_order", ("“x” don’t", "\"x\" don't"): "same words", ("...", "..."): "unchanged", ("!", "! "): "unchanged", ("?", "? ?"): "punctuation",
    }
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "a string, b string, want string")
    assert [(r.a, r.b, r.v.reason) for r in df.select("a", "b", guards.edit_verdict(F.col("a"), F.col("b")).alias("v")).collect()] == [(*k, v) for k, v in cases.items()]
    glyphs = {("wil! do", "will do"): "glyph_l_exclamation", ("that'$ mine", "that's mine"): "glyph_dollar_s", ("it'$ 5", "it's 5"): "", ("a b", "a c"): "", ("x!l", "xl!"): "", ("", ""): ""}
    df = spark.createDataFrame([(*k, v) for k, v in glyphs.items()], "a string, b string, want string")
    assert [(r.a, r.v) for r in df.select("a", guards.glyph_change(F.col("a"), F.col("b")).alias("v")).collect()] == [(k[0], v) for k, v in glyphs.items()]


def test_guarded_edits_and_offline_provider(spark):
    rows = spark.createDataFrame([(1, "think so"), (2, "pay 20"), (3, "stay")], "k long, m string")
    assert providers.proposals(rows, "k", "m").count() == 0
    providers.register("upper", lambda: lambda texts: [t.upper() for t in texts])
    assert providers.proposals(rows, "k", "m", "upper", 2).count() == 3
    offers = spark.createDataFrame([(1, "I think so"), (2, "pay 30"), (9, "x")], "k long, m string")
    got = {r.k: (r.m, r.edit) for r in guards.guarded_edits(rows, offers, "k", "m").collect()}
    assert got == {1: ("I think so", "missing_I"), 2: ("pay 20", "protected value"), 3: ("stay", "none")}


def test_lookup_join_shuffled_with_a_hot_key(spark):
    facts = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    for limit in (0, 1 << 30):
        got = lookup_join(facts, dim, "k", limit=limit)
        assert got.count() == 500 and got.filter("v = 1").count() == 333 and got.filter("v = 2").count() == 1
