"""Who is who: parties by name or number, speakers by map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_senders(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """``row_id``, ``participant_id`` of rows whose sender is a party's full name or alias, case aside; the smallest id of several."""
    names = participants.select("case_id", "participant_id", F.explode(F.concat(F.array("full_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    keys = names.filter("n is not null").groupBy("case_id", F.lower(F.trim("n")).alias("k")).agg(F.min("participant_id").alias("participant_id"))
    sent = rows.filter("sender is not null").select("row_id", "case_id", F.lower(F.trim("sender")).alias("k"))
    return sent.join(keys, ["case_id", "k"]).select("row_id", "participant_id")


def phone_owners(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """``row_id``, ``participant_id`` for numbers in messages that are, digit for digit, a party's of the same case."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    owned = participants.select("case_id", "participant_id", F.explode("contact_numbers").alias("c")).select("case_id", "participant_id", digits("c").alias("digits")).filter("length(digits) >= 7")
    said = rows.filter("message is not null").select("row_id", "case_id", F.explode(F.regexp_extract_all("message", F.lit(r"(\+?\(?\d[\d\s().-]{6,18}\d)"), 1)).alias("c")).select("row_id", "case_id", digits("c").alias("digits"))
    return said.join(owned, ["case_id", "digits"]).select("row_id", "participant_id").distinct()


def speaker_names(recordings: DataFrame) -> DataFrame:
    """``recording_id``, ``label``, ``name`` of speaker maps in either shape; unreadable maps give no rows."""
    inner = F.from_json(F.get_json_object("speaker_map", "$.speaker_map"), "map<string,string>")
    flat = F.when(F.get_json_object("speaker_map", "$.speaker_map").isNull(), F.from_json("speaker_map", "map<string,string>"))
    return recordings.filter("speaker_map is not null").select("recording_id", F.explode(F.coalesce(inner, flat)).alias("label", "name")).filter("name is not null")
