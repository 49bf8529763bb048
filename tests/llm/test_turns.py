import itertools

from deponent.llm import turns as U

SEG = "segment_id long, recording_id string, segment_no int, start_s double, end_s double, speaker string, message string"


def make(spark, rows, maps=()):
    return spark.createDataFrame(rows, SEG), spark.createDataFrame(list(maps), "recording_id string, speaker_map string, start_s int")


def test_reading_of_segments():
    cases = {
        "[00:00:27] Yes I'm calling": ("", "Yes I'm calling", True),
        "[S02] we need {breath} that um, done": ("[S02]", "we need that done", True),
        "SPEAKER_00: (dial (long) tone) Uh-huh...": ("SPEAKER_00:", "", False),
        "00:52 - Speaker 1 - hello 14:05": ("Speaker 1 - ", "hello 14:05", True),
        "*sighs* mm-hm": ("", "", False),
        "♪ — ...": ("", "", False),
        "[12.03]": ("", "", False),
        "let me me read [it": ("", "let me me read it", True),
        "I paid (about two hundred dollars) on Monday": ("", "I paid about two hundred dollars on Monday", True),
        "he said (yes) {I agree}": ("", "he said yes I agree", True),
        "no no no, very very bad": ("", "no no no, very very bad", True),
        "it was *very* late <noise> [loud (static)] ok [ ]": ("", "it was very late ok", True),
        "[door closes] (line crackles) {breath} (they were laughing at me)": ("", "they were laughing at me", True),
        "(Maria) came [to the door]": ("", "Maria came to the door", True),
        "(dial (the long) tone)": ("", "dial the long tone", True),
        "": ("", "", False),
        None: ("", "", False),
        "umbrella eh?": ("", "umbrella?", True),
    }
    for text, want in cases.items():
        got = U.read_segment(text)
        assert (got[0].strip(), got[2]) == (want[0].strip(), want[2]), (text, got)
        assert got[1] == want[1], (text, got)


def test_speaker_numbers():
    names = {1: "Adrian Redmayner", 2: "Adriana Redmayner", 3: "Theodore Joaquindo"}
    cases = {"SPEAKER_00": 1, "speaker_01": 2, "S02": 2, "[S03]": 3, "Speaker 1": 1, "spkr-4": 4, "S01 (Adriana)": 1, "Adriana": 2, "REDMAYNER, ADRIAN": 1, "Theodore J.": 3, "Redmayner": None, "": None, None: None, "Nobody Known": None}
    assert {k: U.speaker_number(k, names) for k in cases} == cases
    assert U._map('{"speaker_map": {"S01": "A"}}') == {1: "A"} and U._map("{broken") == {} and U._map(None) == {} and U._map("[1]") == {}


def test_turns_follow_time_and_carry_speakers(spark):
    rows = [
        (1, "r", 1, 1.0, 2.0, "S01", "one"), (2, "r", 2, 9.0, 9.5, "S02", "four"), (3, "r", 3, 3.0, None, None, "two"), (4, "r", 4, None, None, "S01", "three"), (5, "r", 5, 10.0, 11.0, "S01", "um..."), (6, "r", 6, 12.0, 13.0, "", "S02: five"),
        (7, "r", 6, 12.0, 13.0, "", "S02: five"), (8, "r", 7, 14.0, 15.0, "Ann", "six"), (9, "q", 1, None, None, None, None), (10, None, 1, 1.0, 1.0, "S01", "lost"), (11, "r", None, 1.0, 1.0, "S01", "lost"),
    ]
    seg, rec = make(spark, rows, [("r", '{"S03": "Ann Lee"}', 7)])
    for a, b in ((4096, 3600), (1, 1)):
        U.BLOCK_SEGMENTS, U.BLOCK_SECONDS = a, b
        got = sorted(tuple(r) for r in U.turn_starts(seg, rec).collect())
        assert got == [("r", 1, 1), ("r", 2, 2), ("r", 8, 3)]
    U.BLOCK_SEGMENTS, U.BLOCK_SECONDS = 4096, 3600
    text = [(r.turn_no, r.speaker_no, r.message) for r in U.speaker_turns(seg, rec).orderBy("turn_no").collect()]
    assert text == [(1, 1, "one two three"), (2, 2, "four five"), (3, 3, "six")]
    assert U.turn_starts(seg.limit(0), rec).count() == 0


def test_against_plain_python(spark, sf):
    seg = spark.read.parquet(f"{sf}/audio_utils.parquet")
    rec = spark.read.parquet(f"{sf}/recordings.parquet")
    maps = {r.recording_id: U._map(r.speaker_map) for r in rec.collect()}
    want = set()
    rows = sorted(seg.collect(), key=lambda r: (r.recording_id, r.segment_no, r.segment_id))
    for rid, group in itertools.groupby(rows, key=lambda r: r.recording_id):
        once = [next(g) for _, g in itertools.groupby(group, key=lambda r: r.segment_no)]
        placed, anchor = [], (float("-inf"), -1)
        for r in once:
            anchor = (r.start_s, r.segment_no) if r.start_s is not None else anchor
            placed.append((*anchor, r.segment_no, r))
        speaker = last = None
        for *_, r in sorted(placed, key=lambda x: x[:3]):
            label, _, speech = U.read_segment(r.message)
            n = U.speaker_number(r.speaker, maps.get(rid, {})) or U.speaker_number(label, maps.get(rid, {}))
            speaker = n or speaker
            if speech and speaker:
                if speaker != last:
                    want.add((rid, r.segment_id, speaker))
                last = speaker
    assert {tuple(r) for r in U.turn_starts(seg, rec).collect()} == want
