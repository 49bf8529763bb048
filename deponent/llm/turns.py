"""Speech segments into ordered turns of clean words (problem 3).

A parsing expression grammar reads labels, time marks, nested sound annotations, hesitations and words out of each segment;
the parse tree is turned into the label, the words spoken, and whether anything was spoken at all. Brackets are an
annotation only if what stands in them parses as a sound: plain words of which one names a sound, and no pronoun, number or
other word of a sentence. Any other words in brackets were spoken and are kept, and so are words said twice.

Running values and turns go over blocks of a recording and carry keys and flags only; texts are parsed once, where they are
read, and joined at the end.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deponent.llm.peg import ahead_not, by_first, choice, later, many, maybe, named, seq, token, where
from deponent.operators.ordering import number_in_order
from deponent.operators.scan import carry_forward
from deponent.session import checkpointed, lookup_join

#: Segments in one piece of a recording, and seconds in one, for running values.
BLOCK_SEGMENTS, BLOCK_SECONDS = 4096, 3600

# Hesitations.
HESITATIONS = "um umm uh uhh uhm erm er ah ahh eh ehm hm hmm mm mmm mhm mm-hm mm-hmm uh-huh uh-uh oh-uh huh ähm äh este"

# Beginnings of words that name a sound or what makes one, and words of sentences, which no annotation holds.
SOUNDS = (
    "laugh chuckl giggl sigh breath inhal exhal cough sneez sniff sob cry weep gasp groan moan yawn whisper mumbl mutter stutter throat paus silen noise nois music song sing crosstalk cross-talk overlap inaudibl unintelligibl indistinct "
    "unclear applau clap cheer static crackl hiss buzz hum beep tone ring dial click clatter bang thud knock slam bark footstep rustl typing keyboard echo feedback interferen background door traffic siren horn wind rain voicemail sound line "
    "hang phone disconnect chatter crowd baby dog television tv radio"
).split()
SPOKEN = (
    "i you he she it we they me him her us them my your his its our their this that these those who what when where why how which a an the is am are was were be been do does did done have has had will would can could should may might must not no yes "
    "yeah okay ok and or but so if because as than then about to of at from for with without by on in into after before again please thanks sorry hello hi bye one two three four five six seven eight nine ten hundred thousand dollars"
).split()

_space = token(r"\s+")
_clock = r"\d{1,3}(?::\d{2}){1,2}(?:[.,]\d+)?|\d+[.,]\d+|\d+(?=s?\s*[\])>])"
_stamp = named(
    "time",
    choice(
        token(rf"\[\s*(?:{_clock})s?\s*(?:(?:-|–|-->)\s*(?:{_clock})s?\s*)?\]"),
        token(rf"\(\s*(?:{_clock})s?\s*\)"),
        token(rf"<\s*(?:{_clock})s?\s*>"),
    ),
)
_lead_stamp = named("time", token(r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\s*[-–—]\s+"))
_number_label = r"(?:speaker|spkr|spk|s)[ _\-]?\d+"
_label = named("label", choice(token(rf"(?i)[\[(]\s*{_number_label}\s*[\])]\s*[:\-–—]?"), token(rf"(?i){_number_label}\s*(?::|[-–—]\s)")))
_annotation = later(lambda: _annotation_rule)


_sign = token(r"[\s,;.:&/|…-]+")
_event = named("event", token(r"(?i)(?:" + "|".join(SOUNDS) + r")[\w'’-]*"))
_plain = seq(ahead_not(token(r"(?i)(?:" + "|".join(SPOKEN) + r")(?:['’]\w+)?(?![\w-])|\w*\d")), token(r"[^\W\d_][\w'’-]*"))
_sound = many(choice(_sign, _annotation, _event, _plain))


def _bracketed(left: str, right: str):
    return seq(token(re.escape(left)), _sound, token(re.escape(right)))


def _names_a_sound(nodes: list) -> bool:
    return any(name == "event" or _names_a_sound(inner) for name, _, inner in nodes)


_group = choice(_bracketed("[", "]"), _bracketed("(", ")"), _bracketed("{", "}"), _bracketed("*", "*"))
# Angle brackets are a transcriber's, whatever plain words they hold. Inside an annotation a part may name no sound itself.
_annotation_rule = named("aside", choice(_group, _bracketed("<", ">")))
_sound_mark = named("sound", choice(where(_group, _names_a_sound), _bracketed("<", ">"), token(r"[♪♫♬]+"), token(r"[\[({*]\s*[\])}*]")))
_boundary = token(r"[\w'’-]")
_hesitation = named("hesitation", seq(token(r"(?i)(?:" + "|".join(sorted(map(re.escape, HESITATIONS.split()), key=len, reverse=True)) + ")"), ahead_not(_boundary), token(r"(?:\.\.\.|…|,)?")))
_word = named("word", token(r"[^\s\[\](){}<>*♪♫♬]+"))
_other = named("mark", token(r"[\[\](){}<>*]"))
_marked = choice(_stamp, _sound_mark, _word, _other)
_item = by_first({" \t\n\r": _space, "[({<>})]*♪♫♬": _marked}, choice(_hesitation, _word, _space))
_segment = seq(maybe(_space), many(choice(_space, _stamp, _lead_stamp)), maybe(_label), many(choice(_space, _stamp, _lead_stamp)), many(_item))


def read_segment(text: str | None) -> tuple[str, str, bool]:
    """The label at the start, the words spoken, and whether there are any, of one segment; null counts as empty."""
    if not text:
        return "", "", False
    try:
        _, nodes = _segment(text, 0)
    except RecursionError:  # brackets nested beyond any annotation are taken as marks
        _, nodes = _segment(re.sub(r"[\[\](){}<>*]", " ", text), 0)
    label = next((part for name, part, _ in nodes if name == "label"), "")
    kept: list[str] = []
    for name, part, _ in nodes:
        if name == "word" and (kept or re.search(r"\w", part)):
            kept.append(part)
    line = re.sub(r"\s+([.,!?;:…]+)", r"\1", " ".join(kept))
    return label, line, bool(kept)


def _fold(name: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", re.sub(r"\(.*?\)", " ", name).casefold())


def speaker_number(label: str | None, mapped: dict[int, str]) -> int | None:
    """The speaker, from 1, that a label means; None for an empty label or a name that fits no single speaker of the map."""
    label = (label or "").strip()
    if m := re.search(r"(?i)(?<![a-z])(speaker_|speaker[ \-]?|spkr[ _\-]?|spk[ _\-]?|s[ _\-]?)(\d+)", label):
        return int(m[2]) + (m[1].lower() == "speaker_")
    words = _fold(label)
    if not words:
        return None
    best: list[tuple[int, int]] = []
    for number, name in mapped.items():
        full = _fold(name)
        rest, score = list(full), 0
        for w in words:
            if w in rest:
                rest.remove(w)
                score += 2
            elif len(w) == 1 and any(x.startswith(w) for x in rest):
                rest.remove(next(x for x in rest if x.startswith(w)))
                score += 1
            else:
                score -= 3
        best.append((score, number))
    best.sort(reverse=True)
    if best and best[0][0] > 0 and (len(best) == 1 or best[0][0] > best[1][0]):
        return best[0][1]
    return None


def _map(raw: str | None) -> dict[int, str]:
    try:
        found = json.loads(raw or "{}")
    except ValueError:
        return {}
    found = found.get("speaker_map", found) if isinstance(found, dict) else {}
    return {n: str(v) for k, v in found.items() if v and (n := speaker_number(str(k), {})) is not None} if isinstance(found, dict) else {}


_READ = "number int, words string, speech boolean"


def _read(speaker: pd.Series, message: pd.Series, raw_map: pd.Series) -> pd.DataFrame:
    maps: dict = {}
    out = []
    for s, m, raw in zip(speaker, message, raw_map):
        if raw not in maps:
            if len(maps) > 4096:
                maps.clear()
            maps[raw] = _map(raw)
        label, words, speech = read_segment(m)
        number = speaker_number(s, maps[raw])
        out.append((number if number is not None else speaker_number(label, maps[raw]), words, speech))
    return pd.DataFrame({"number": pd.array([x[0] for x in out], dtype="Int32"), "words": [x[1] for x in out], "speech": [x[2] for x in out]})


def speech_segments(segments: DataFrame, recordings: DataFrame, texts: bool = False) -> DataFrame:
    """Speech segments in order, each with its speaker and the number of its turn's first segment.

    Columns: ``recording_id``, ``segment_id``, ``at`` (order: start, then place), ``_block`` (a piece of the recording),
    ``start_s``, ``end_s``, ``speaker_no``, ``first_of_turn``, and ``words`` if ``texts`` are asked for. A segment delivered
    twice counts once, by its smallest id. Segments without recording or place are left out, as they have no order; null times
    and texts are allowed.
    """
    delivered = segments.filter(F.col("recording_id").isNotNull() & F.col("segment_no").isNotNull()).select("recording_id", "segment_no", "segment_id", "start_s", "end_s", "speaker", "message")
    maps = recordings.groupBy("recording_id").agg(F.max("speaker_map").alias("speaker_map"))
    read = lookup_join(delivered, maps, "recording_id").withColumn("r", F.pandas_udf(_read, _READ)("speaker", "message", "speaker_map"))
    row = F.struct("segment_id", "start_s", "end_s", F.col("r.number").alias("number"), F.col("r.speech").alias("speech"), *([F.col("r.words").alias("words")] if texts else []))
    once = read.groupBy("recording_id", "segment_no").agg(F.min_by(row, "segment_id").alias("x")).select("recording_id", "segment_no", "x.*")
    once = checkpointed(once.withColumn("_block", F.floor(F.col("segment_no") / BLOCK_SEGMENTS)))  # each text is parsed once, though running values read the rows twice
    timed = F.when(F.col("start_s").isNotNull() & ~F.isnan("start_s"), F.struct("start_s", "segment_no"))
    placed = carry_forward(once.drop("words"), ["recording_id"], "_block", ["segment_no"], {"anchor": timed})
    placed = placed.withColumn("at", F.struct(F.coalesce(F.col("anchor.start_s"), F.lit(float("-inf"))).alias("t"), F.coalesce(F.col("anchor.segment_no"), F.lit(-1)).alias("n"), F.col("segment_no").alias("k")))
    placed = checkpointed(placed.withColumn("_block", F.floor(F.greatest(F.coalesce(F.col("anchor.start_s"), F.lit(0.0)), F.lit(0.0)) / BLOCK_SECONDS)).drop("anchor"))
    turned = _speakers(placed)
    if texts:
        turned = turned.join(once.select("recording_id", "segment_no", "words"), ["recording_id", "segment_no"])
    return turned.select("recording_id", "segment_id", "at", "_block", "start_s", "end_s", "speaker_no", "first_of_turn", *(["words"] if texts else []))


def _speakers(placed: DataFrame) -> DataFrame:
    """Speech rows with ``speaker_no``, the last number at or before them, and ``first_of_turn``.

    Both run inside a block first; of each block one row goes on to the later ones: the last number, the number at its last
    speech (which may be one from before the block), and whether it holds speech.
    """
    inside = Window.partitionBy("recording_id", "_block").orderBy("at")
    upto, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("_own", F.last("number", ignorenulls=True).over(upto))
    run = run.withColumn("_said", F.last(F.when(F.col("speech"), F.struct("_own")), ignorenulls=True).over(ahead))
    last = run.groupBy("recording_id", "_block").agg(F.max_by("number", F.when(F.col("number").isNotNull(), F.col("at"))).alias("n"), F.max_by(F.struct("_own"), F.when(F.col("speech"), F.col("at"))).alias("s"))
    before = Window.partitionBy("recording_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    known = last.withColumn("_n", F.last("n", ignorenulls=True).over(before))
    spoke = F.when(F.col("s").isNotNull(), F.coalesce("s._own", "_n"))
    summary = known.select("recording_id", "_block", "_n", F.last(spoke, ignorenulls=True).over(before).alias("_s"))
    both = run.filter("speech").join(summary, ["recording_id", "_block"], "left").withColumn("speaker_no", F.coalesce("_own", "_n")).filter("speaker_no is not null")
    spoken = F.when(F.col("_said").isNotNull(), F.coalesce("_said._own", "_n")).otherwise(F.col("_s"))
    return both.withColumn("first_of_turn", spoken.isNull() | (spoken != F.col("speaker_no")))


def turn_starts(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """The first segment of each turn: ``recording_id``, ``segment_id``, ``speaker_no``."""
    return speech_segments(segments, recordings).filter("first_of_turn").select("recording_id", "segment_id", "speaker_no")


def speaker_turns(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """The turns: ``recording_id``, ``turn_no`` (from 1), ``speaker_no``, ``first_segment``, ``start_s``, ``end_s``, ``n_segments``, ``message``.

    A turn's words are put together block by block, then over blocks, so that no list holds more than a block's segments.
    """
    rows = speech_segments(segments, recordings, texts=True)
    turns = carry_forward(checkpointed(rows), ["recording_id"], "_block", ["at"], {"turn_at": F.when(F.col("first_of_turn"), F.struct("at", "_block"))})
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]), " ")
    parts = turns.groupBy("recording_id", "turn_at", "_block").agg(
        F.max("speaker_no").alias("speaker_no"),
        F.min(F.struct("at", "segment_id")).alias("first"),
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.count("*").alias("n"),
        in_order("words").alias("text"),
    )
    texts = parts.withColumn("at", F.col("first.at")).groupBy("recording_id", "turn_at").agg(
        F.max("speaker_no").alias("speaker_no"),
        F.min("first").alias("first"),
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.sum("n").cast("int").alias("n_segments"),
        in_order("text").alias("message"),
    )
    placed = checkpointed(texts.withColumn("_block", F.col("turn_at._block")))
    numbered = number_in_order(placed, ["recording_id"], "_block", ["turn_at"], "turn_no")
    return numbered.select("recording_id", F.col("turn_no").cast("int").alias("turn_no"), "speaker_no", F.col("first.segment_id").alias("first_segment"), "start_s", "end_s", "n_segments", "message")
