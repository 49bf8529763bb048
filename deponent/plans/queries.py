"""Queries of the core operators for the driver, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deponent.functions import dates as D
from deponent.functions import text as T
from deponent.operators import dedupe, evidence, files, identity, joins, merge, retrieval, sequence, timestamps
from deponent.operators.ordering import number_in_order
from deponent.operators.scan import carry_forward, lagged
from deponent.plans import fixtures  # noqa: F401  (registers its queries)
from deponent.plans.registry import QUERIES, SQL, query
from deponent.session import lookup_join, table

# Pieces of SQL that several queries share. The white space is that of both engines' regular expressions.
_TRIM = r"regexp_replace({0}, '^[\s\x{{00A0}}\x{{202F}}]+|[\s\x{{00A0}}\x{{202F}}]+$', '', 'g')"
_SQUEEZE = r"trim(regexp_replace({0}, '[\s\x{{00A0}}\x{{0085}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1680}}\x0B]+', ' ', 'g'))"


class _RowTime:
    """The time of a transcript row, or null."""

    @staticmethod
    def format(x: str) -> str:
        t = _TRIM.format(x)
        flat = rf"regexp_replace({t}, ',\s?', ' ')"
        return rf"""CASE WHEN regexp_matches({t}, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}( |, |,)\d{{1,2}}:\d{{1,2}}(:\d{{1,2}})?$')
  THEN coalesce(try_strptime({flat}, '%d/%m/%Y %H:%M:%S'), try_strptime({flat}, '%d/%m/%Y %H:%M')) END"""


_ROW_TIME = _RowTime()
_ESTIMATED = f"CASE WHEN lower({_TRIM.format('estimated_timestamp')}) IN ('true', '1', 'yes', 'y') THEN 'True' ELSE 'False' END"
class _Final:
    """The last cleanup of a message: blanks after marks but not inside addresses, then broken addresses put together."""

    @staticmethod
    def parts(x: str, pattern: str, inside: str, outside: str) -> str:
        p = pattern.replace("'", "''")
        return f"""array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{p}'), list_append(regexp_extract_all({x}, '{p}'), '')), lambda z: {outside} || {inside}), '')"""

    @staticmethod
    def format(x: str) -> str:
        bare = rf"regexp_replace({x}, '\s+([,.;:!?])', '\1', 'g')"
        whole = r"(?i)(?:\b(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
        spaced = _Final.parts(bare, whole, "z[2]", r"regexp_replace(z[1], '([,.;:!?])([A-Za-z])', '\1 \2', 'g')")
        tld = "com|net|org|edu|gov|mil|int|io|ai|co|uk|gr|eu|de|fr|it|es|nl|be|ch|at|us|ca|au|info|biz|online|site|app|dev|tech|me|tv"
        host, dotless = "[a-z0-9](?:[a-z0-9.-]*[a-z0-9-])?", "com|net|org|edu|gov|mil|int|info|biz|online|site|app|dev|tech"
        broken = (
            rf"(?i)(?:[\w.+-]+ ?@ ?{host} ?\. ?(?:{tld})\b|\bhttps? ?: ?/ ?/ ?{host}(?: ?\. ?| )(?:{tld})\b|\bhttps (?:[:/\\|]+|(?-i:I[lI]|l[I|])) ?{host} (?:{tld})\b|\bwww ?\. ?{host}(?: ?\. ?| )(?:{tld})\b"
            rf"|\bwww ?\. ?[a-z0-9]|\b(?:website|web site|site|url|visit|go to) (?:{host} ?\. ?(?:{tld})|[a-z0-9-]{{2,}}?(?:{dotless}))\b)"
        )
        closed = rf"regexp_replace(z[2], '(?i)(?: ?\. ?| )?({tld})$', '.\1')"
        for found, meant in ((r"(?i)^https(?: ?: ?/ ?/ ?| (?:[:/\\|]+|(?-i:I[lI]|l[I|])) ?)", "https://"), (r"(?i)^http ?: ?/ ?/ ?", "http://"), (r"(?i)\bwww ?\. ?", "www."), (" ?@ ?", "@")):
            closed = f"regexp_replace({closed}, '{found}', '{meant}', 'g')"
        return f"(SELECT {_Final.parts('s', broken, closed, 'z[1]')} FROM (SELECT {spaced} AS s))"


_FINAL = _Final()


class _Key:
    """The comparison form of a message."""

    @staticmethod
    def format(x: str) -> str:
        return _SQUEEZE.format(f"lower(replace({x}, '’', chr(39)))")


_KEY = _Key()
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_UNRESOLVED = r"""(trim(regexp_replace(lower(trim(coalesce({0}, ''))), '[_\s-]+', ' ', 'g')) IN ('', 'unknown', 'unknown sender', 'unknown receiver', 'unresolved')
  OR regexp_matches(trim(regexp_replace(lower(trim(coalesce({0}, ''))), '[_\s-]+', ' ', 'g')), '^speaker\s*\d+$'))"""
_READABLE = f"""SELECT row_id, case_id, conv_key, source_kind, source_csv, source_row, {_TRIM.format('msg_timestamp')} AS msg_timestamp, {_ESTIMATED} AS estimated,
  {_TRIM.format('sender')} AS sender, {_TRIM.format('receiver')} AS receiver, {_TRIM.format('message')} AS message FROM mass_extract
  WHERE {_TRIM.format('msg_timestamp')} <> '' AND {_TRIM.format('sender')} <> '' AND {_TRIM.format('receiver')} <> '' AND {_TRIM.format('message')} <> ''"""
_QUOTED = "translate({0}, '“”‘’', '\"\"''''')"
_MERGED = f"""
WITH clean AS (SELECT * REPLACE ({_FINAL.format(_SQUEEZE.format(_QUOTED.format('message')))} AS message) FROM ({_READABLE})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_kind = 'audio', case_id,
    CASE WHEN source_kind = 'audio' THEN source_csv ELSE msg_timestamp END, CASE WHEN source_kind = 'audio' THEN source_row::VARCHAR ELSE sender END,
    CASE WHEN source_kind <> 'audio' THEN receiver END, CASE WHEN source_kind <> 'audio' THEN {_KEY.format('message')} END ORDER BY row_id) AS k FROM clean WHERE message <> ''),
kept AS (SELECT *, row_number() OVER (PARTITION BY source_kind = 'chat', source_csv ORDER BY source_row, row_id) AS pos FROM ranked WHERE k = 1),
grouped AS (SELECT *, count(*) FILTER (WHERE estimated = 'False') OVER (PARTITION BY source_kind = 'chat', source_csv ORDER BY source_row, row_id) AS g FROM kept),
anchored AS (SELECT *, first_value(pos) OVER w AS apos, first_value({_ROW_TIME.format('msg_timestamp')}) OVER w AS ats, first_value(estimated) OVER w AS aest
  FROM grouped WINDOW w AS (PARTITION BY source_kind = 'chat', source_csv, g ORDER BY source_row, row_id)),
final AS (SELECT *, CASE WHEN source_kind = 'chat' AND estimated = 'True' AND aest = 'False' AND ats IS NOT NULL
  THEN strftime(ats + to_seconds(pos - apos), '%d/%m/%Y %H:%M:%S') ELSE msg_timestamp END AS stamp FROM anchored)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {_ROW_TIME.format('stamp')} NULLS LAST, row_id) AS seq, row_id, stamp AS msg_timestamp, estimated, sender, receiver, message FROM final"""


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalized_stamps(table(spark, d, "mass_extract"), table(spark, d, "conversation_state"))


# ---------------------------------------------------------------------------------------------- transcript

@query(_MERGED)
def merged_transcript(spark: SparkSession, d: str) -> DataFrame:
    return merge.merged_transcript(table(spark, d, "mass_extract"))


@query(f"SELECT row_id, source_kind, msg_timestamp, estimated, sender, receiver, message FROM ({_READABLE})")
def chat_reader_filter(spark: SparkSession, d: str) -> DataFrame:
    return merge.readable_rows(table(spark, d, "mass_extract")).select("row_id", "source_kind", "msg_timestamp", "estimated", "sender", "receiver", "message")


@query(f"SELECT coalesce(estimated_timestamp, '<null>') AS flag, {_ESTIMATED} AS estimated, count(*) AS n FROM mass_extract GROUP BY 1, 2")
def estimated_flag_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mass_extract").select(F.coalesce("estimated_timestamp", F.lit("<null>")).alias("flag"), timestamps.is_estimated("estimated_timestamp").alias("estimated"))
    return rows.groupBy("flag", "estimated").agg(F.count("*").alias("n"))


@query(f"SELECT row_id, strftime({_ROW_TIME.format('msg_timestamp')}, '%Y-%m-%d %H:%M:%S') AS iso FROM mass_extract WHERE {_ROW_TIME.format('msg_timestamp')} IS NOT NULL")
def parse_six_formats(spark: SparkSession, d: str) -> DataFrame:
    ts = D.row_time(F.col("msg_timestamp"))
    return table(spark, d, "mass_extract").select("row_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("iso")).filter("iso is not null")


@query(f"""SELECT case_id, source_kind, count(*) AS rows, count(*) FILTER (WHERE {_ROW_TIME.format('msg_timestamp')} IS NULL) AS unreadable, count(*) FILTER (WHERE {_ESTIMATED} = 'True') AS estimated,
  count(DISTINCT conv_key) AS conversations, count(*) FILTER (WHERE {_UNRESOLVED.format('sender')} OR {_UNRESOLVED.format('receiver')}) AS unresolved FROM mass_extract GROUP BY 1, 2""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mass_extract")
    return m.groupBy("case_id", "source_kind").agg(
        F.count("*").alias("rows"),
        F.count_if(D.row_time(F.col("msg_timestamp")).isNull()).alias("unreadable"),
        F.count_if(timestamps.is_estimated("estimated_timestamp") == "True").alias("estimated"),
        F.countDistinct("conv_key").alias("conversations"),
        F.count_if(T.is_unresolved(F.col("sender")) | T.is_unresolved(F.col("receiver"))).alias("unresolved"),
    )


# ---------------------------------------------------------------------------------------------- text

@query(f"SELECT row_id, {_FINAL.format(_SQUEEZE.format(_QUOTED.format('message')))} AS message FROM mass_extract WHERE message IS NOT NULL")
def clean_final_message(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mass_extract").filter("message is not null").select("row_id", T.final_message(F.col("message")).alias("message"))


@query(f"SELECT case_id, {_KEY.format('message')} AS k, count(*) AS n, min(row_id) AS first_row FROM mass_extract WHERE message IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def normalize_dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "mass_extract").filter("message is not null").select("case_id", "row_id", T.dedupe_key(F.col("message")).alias("k"))
    return keyed.groupBy("case_id", "k").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row")).filter("n > 1")


@query(rf"""SELECT row_id, {_SQUEEZE.format(r"regexp_replace(message, '[\x{{1F1E6}}-\x{{1F1FF}}\x{{1F300}}-\x{{1F64F}}\x{{1F680}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE0E}}\x{{FE0F}}\x{{200D}}]+', '', 'g')".replace('{{', '{').replace('}}', '}'))} AS message FROM mass_extract WHERE message IS NOT NULL""")
def strip_emojis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mass_extract").filter("message is not null").select("row_id", T.without_emoji(F.col("message")).alias("message"))


@query(rf"""SELECT row_id, {_SQUEEZE.format(r"regexp_replace(regexp_replace(message, '(^|[^A-Za-z0-9])\d{1,2}[:.,;]\d{2}($|[^A-Za-z0-9])', '\1 \2', 'g'), '(^|[^A-Za-z0-9])\d{1,2}[:.,;]\d{2}($|[^A-Za-z0-9])', '\1 \2', 'g')")} AS message FROM mass_extract WHERE message IS NOT NULL""")
def leaked_time_removal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mass_extract").filter("message is not null").select("row_id", T.without_leaked_times(F.col("message")).alias("message"))


@query(rf"""SELECT source_kind, count(*) AS rows, count(*) FILTER (WHERE coalesce(trim(message) = '' OR regexp_matches(message, '(^|[^A-Za-z0-9])\d{{1,2}}[:.,;]\d{{2}}($|[^A-Za-z0-9])') OR
  {' + '.join("(regexp_matches(message, '" + p.replace("'", "''") + "'))::INT" for p in T.ARTIFACTS)} >= 2, true)) AS noisy FROM mass_extract GROUP BY 1""")
def noisy_text_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mass_extract").groupBy("source_kind").agg(F.count("*").alias("rows"), F.count_if(T.is_noisy(F.col("message"))).alias("noisy"))


@query(rf"""SELECT row_id FROM mass_extract WHERE coalesce(lower(trim(message)) = '' OR {' OR '.join("contains(lower(trim(message)), '" + w.replace("'", "''") + "')" for w in T.SCREEN_WORDS)}
  OR regexp_matches(lower(trim(message)), '^({T.SCREEN_CONTROLS})$') OR regexp_matches(lower(trim(message)), '^[0o]{{2,4}}$') OR regexp_matches(lower(trim(message)), '^[✓✔v]{{1,4}}$')
  OR regexp_matches(lower(trim(message)), '^\d{{1,2}}[:.,;*]\d{{2}}$') OR regexp_matches(lower(trim(message)), '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$'), true)""")
def ui_noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mass_extract").filter(T.is_screen_text(F.col("message"))).select("row_id")


@query(r"""SELECT row_id, len(v) AS n, array_to_string(v, ' ') AS found FROM (SELECT row_id, regexp_extract_all(message, '(?i)(https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,})', 1) AS v FROM mass_extract WHERE message IS NOT NULL) WHERE len(v) > 0""")
def protected_addresses(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("message", F.lit(r"(?i)(https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,})"), 1)
    return table(spark, d, "mass_extract").filter("message is not null").select("row_id", F.size(found).alias("n"), F.array_join(found, " ").alias("found")).filter("n > 0")


@query(f"SELECT case_id, sum(len(w)) AS words, count(DISTINCT row_id) AS rows, max(len(w)) AS longest FROM (SELECT case_id, row_id, {_WORDS.format('message')} AS w FROM mass_extract WHERE message IS NOT NULL) GROUP BY 1")
def message_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "mass_extract").filter("message is not null").select("case_id", "row_id", F.size(T.words(F.col("message"))).alias("n"))
    return w.groupBy("case_id").agg(F.sum("n").alias("words"), F.countDistinct("row_id").alias("rows"), F.max("n").alias("longest"))


@query(r"""SELECT segment_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(message, '\s+', ' ', 'g')), '\s+([,.?!:;])', '\1', 'g'), '([(\[{])\s+', '\1', 'g'), '\s+([)\]}])', '\1', 'g')) AS message FROM audio_utils WHERE message IS NOT NULL""")
def clean_speech(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio_utils").filter("message is not null").select("segment_id", T.clean_message(F.col("message")).alias("message"))


# ---------------------------------------------------------------------------------------------- dates and years

@query(r"""WITH y AS (SELECT case_id, doc_id, unnest(regexp_extract_all(text, '\b(20\d{2})\b', 1)) AS year FROM documents WHERE case_id IS NOT NULL),
n AS (SELECT case_id, year, count(*) AS n FROM y GROUP BY 1, 2)
SELECT case_id, year, n FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, year DESC) AS k FROM n) WHERE k = 1""")
def report_year_mode(spark: SparkSession, d: str) -> DataFrame:
    """The year that a case's documents name most often; of equally frequent ones the later."""
    y = table(spark, d, "documents").filter("case_id is not null").select("case_id", F.explode(D.years(F.col("text"))).alias("year"))
    n = y.groupBy("case_id", "year").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", "year"))
    return n.groupBy("case_id").agg(best.alias("b")).select("case_id", "b.year", "b.n")


@query(r"""SELECT case_id, first(year ORDER BY doc_id) AS year FROM (SELECT case_id, doc_id, regexp_extract_all(text, '\b(20\d{2})\b', 1)[1] AS year FROM documents WHERE case_id IS NOT NULL) WHERE year IS NOT NULL GROUP BY 1""")
def report_year_first(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "documents").filter("case_id is not null").select("case_id", "doc_id", F.get(D.years(F.col("text")), 0).alias("year")).filter("year is not null")
    return y.groupBy("case_id").agg(F.min_by("year", "doc_id").alias("year"))


@query(rf"""SELECT DISTINCT case_id, strftime(d, '%d/%m/%Y') AS day FROM (
  SELECT case_id, {_ROW_TIME.format('msg_timestamp')}::DATE AS d FROM mass_extract WHERE source_kind = 'chat'
  UNION ALL SELECT case_id, try_strptime(replace(unnest(regexp_extract_all(text, '\b(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}})\b', 1)), '-', '/'), '%d/%m/%Y')::DATE FROM documents
  UNION ALL SELECT case_id, try_strptime(unnest(regexp_extract_all(text, '\b(\d{{4}}-\d{{1,2}}-\d{{1,2}})\b', 1)), '%Y-%m-%d')::DATE FROM documents) WHERE d IS NOT NULL AND case_id IS NOT NULL""")
def evidence_dates(spark: SparkSession, d: str) -> DataFrame:
    """The days that chat rows or documents of a case name."""
    chat = table(spark, d, "mass_extract").filter("source_kind = 'chat'").select("case_id", D.row_time(F.col("msg_timestamp")).cast("date").alias("d"))
    docs = table(spark, d, "documents").select("case_id", F.explode(D.report_dates(F.col("text"))).alias("d"))
    return chat.union(docs).filter("d is not null and case_id is not null").select("case_id", F.date_format("d", "dd/MM/yyyy").alias("day")).distinct()


@query(rf"""WITH d AS (SELECT case_id, {_ROW_TIME.format('msg_timestamp')}::DATE AS d, row_id FROM mass_extract WHERE source_kind = 'chat'),
n AS (SELECT case_id, d, count(*) AS n, min(row_id) AS first_row FROM d WHERE d IS NOT NULL GROUP BY 1, 2)
SELECT case_id, strftime(d, '%d/%m/%Y') AS day, n FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, first_row) AS k FROM n) WHERE k = 1""")
def mode_audio_date(spark: SparkSession, d: str) -> DataFrame:
    """The day with most chat rows of a case, the first seen of equal ones: the date its recordings get."""
    days = table(spark, d, "mass_extract").filter("source_kind = 'chat'").select("case_id", "row_id", D.row_time(F.col("msg_timestamp")).cast("date").alias("d")).filter("d is not null")
    n = days.groupBy("case_id", "d").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
    return n.groupBy("case_id").agg(F.max_by(F.struct("d", "n"), F.struct(F.col("n"), -F.col("first_row"))).alias("b")).select("case_id", F.date_format("b.d", "dd/MM/yyyy").alias("day"), F.col("b.n").alias("n"))


@query(rf"""SELECT m.row_id, coalesce(last_value(strftime({_ROW_TIME.format('m.msg_timestamp')}, '%d/%m/%Y') IGNORE NULLS) OVER (PARTITION BY m.conv_key ORDER BY m.source_row, m.row_id ROWS UNBOUNDED PRECEDING), s.last_visible_date) AS day
  FROM mass_extract m LEFT JOIN conversation_state s USING (conv_key) WHERE m.source_kind = 'chat'""")
def date_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each chat row's day: that of the last row with a readable time, else the one remembered for the conversation."""
    m = table(spark, d, "mass_extract").filter("source_kind = 'chat' and conv_key is not null").select("row_id", "conv_key", "source_row", D.row_time(F.col("msg_timestamp")).alias("ts"))
    run = carry_forward(m.withColumn("_block", _row_block()), ["conv_key"], "_block", ["source_row", "row_id"], {"day": F.date_format("ts", "dd/MM/yyyy")})
    return lookup_join(run, table(spark, d, "conversation_state").select("conv_key", "last_visible_date"), "conv_key").select("row_id", F.coalesce("day", "last_visible_date").alias("day"))


# ---------------------------------------------------------------------------------------------- order

def _row_block():
    """The block of a conversation or recording that a row belongs to."""
    return F.floor(F.coalesce("source_row", F.lit(0)) / 4096)


@query(rf"""WITH t AS (SELECT row_id, conv_key, source_row, {_ROW_TIME.format('msg_timestamp')} AS ts FROM mass_extract WHERE source_kind = 'chat'),
n AS (SELECT *, epoch(date_trunc('minute', ts))::BIGINT AS m, row_number() OVER (PARTITION BY conv_key, ts IS NOT NULL ORDER BY source_row, row_id) AS n FROM t)
SELECT row_id, CASE WHEN ts IS NOT NULL THEN max(m - n) OVER (PARTITION BY conv_key, ts IS NOT NULL ORDER BY source_row, row_id ROWS UNBOUNDED PRECEDING) + n END AS seconds FROM n""")
def monotone_seconds(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mass_extract").filter("source_kind = 'chat'").select("row_id", "conv_key", "source_row", D.row_time(F.col("msg_timestamp")).alias("ts"))
    return sequence.rising_seconds(m.withColumn("_block", _row_block()), ["conv_key"], "_block", ["source_row", "row_id"], "ts", "out").select("row_id", F.unix_timestamp("out").alias("seconds"))


_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, segment_no ORDER BY segment_id) AS k FROM audio_utils) WHERE k = 1"
_LABEL = r"""CASE WHEN regexp_extract(upper(trim(speaker)), '^\[?SPEAKER_(\d+)', 1) <> '' THEN printf('S%02d', regexp_extract(upper(trim(speaker)), '^\[?SPEAKER_(\d+)', 1)::INT + 1)
  WHEN regexp_extract(upper(trim(speaker)), '^\[?(SPEAKER[\s-]?|SPKR[ -]?|SPK[ -]?|S)(\d+)', 2) <> '' THEN printf('S%02d', regexp_extract(upper(trim(speaker)), '^\[?(SPEAKER[\s-]?|SPKR[ -]?|SPK[ -]?|S)(\d+)', 2)::INT)
  WHEN upper(trim(speaker)) = '' THEN 'S00' ELSE upper(trim(speaker)) END"""


def _segments_once(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audio_utils").filter("recording_id is not null and segment_no is not null")
    return dedupe.keep_first(a, [F.col("recording_id"), F.col("segment_no")], ["segment_id"])


@query(f"SELECT segment_id, {_LABEL} AS label FROM audio_utils WHERE speaker IS NOT NULL")
def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio_utils").filter("speaker is not null").select("segment_id", sequence.speaker_label(F.col("speaker")).alias("label"))


@query(f"""WITH s AS (SELECT recording_id, segment_no, segment_id, start_s, end_s, coalesce(message, '') AS message, {_LABEL.replace('speaker', "coalesce(speaker, '')")} AS label FROM ({_ONCE})),
b AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY recording_id ORDER BY segment_no) = label THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY segment_no ROWS UNBOUNDED PRECEDING) AS turn FROM b)
SELECT recording_id, min(segment_no) AS first_no, any_value(label) AS label, count(*) AS segments, round(min(start_s), 2) AS start_s, round(max(end_s), 2) AS end_s, string_agg(message, ' ' ORDER BY segment_no) AS message FROM g GROUP BY recording_id, turn""")
def merge_same_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring segments of one label as one turn, their texts joined in order."""
    s = _segments_once(spark, d).withColumn("label", sequence.speaker_label(F.coalesce("speaker", F.lit("")))).withColumn("_block", F.floor(F.col("segment_no") / 4096))
    runs = sequence.islands(s, ["recording_id"], "_block", ["segment_no"], "label", "run")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_no", F.coalesce("message", F.lit("")).alias("m")))), lambda x: x["m"]), " ")
    return runs.groupBy("recording_id", F.col("run.segment_no").alias("first_no")).agg(F.max("label").alias("label"), F.count("*").alias("segments"), F.round(F.min("start_s"), 2).alias("start_s"), F.round(F.max("end_s"), 2).alias("end_s"), texts.alias("message"))


@query(f"""SELECT recording_id, segment_id, printf('%.3f', greatest(0, coalesce(start_s, 0) - first_value(coalesce(start_s, 0)) OVER (PARTITION BY recording_id ORDER BY segment_no))) AS offset_s FROM ({_ONCE})""")
def audio_offset_rebase(spark: SparkSession, d: str) -> DataFrame:
    """Offsets from the first segment's start, never negative."""
    s = _segments_once(spark, d)
    first = s.groupBy("recording_id").agg(F.min_by(F.coalesce("start_s", F.lit(0.0)), "segment_no").alias("first"))
    return lookup_join(s, first, "recording_id").select("recording_id", "segment_id", F.format_string("%.3f", F.greatest(F.lit(0.0), F.coalesce("start_s", F.lit(0.0)) - F.col("first"))).alias("offset_s"))


@query(f"""SELECT recording_id, bool_and(ok) AS complete, count(*) AS segments FROM (SELECT recording_id, coalesce(start_s IS NOT NULL AND end_s IS NOT NULL AND start_s >= 0 AND end_s >= start_s
  AND start_s >= coalesce(lag(start_s) OVER (PARTITION BY recording_id ORDER BY segment_no), -1), false) AS ok FROM ({_ONCE})) GROUP BY 1""")
def timing_complete_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether all segments of a recording have times that never run back."""
    s = _segments_once(spark, d)
    s = lagged(s.withColumn("_block", F.floor(F.col("segment_no") / 4096)), ["recording_id"], "_block", ["segment_no"], {"before_s": "start_s"})
    before = F.coalesce("before_s", F.lit(-1.0))
    ok = F.coalesce(F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & (F.col("start_s") >= 0) & (F.col("end_s") >= F.col("start_s")) & (F.col("start_s") >= before), F.lit(False))
    return s.withColumn("ok", ok).groupBy("recording_id").agg(F.bool_and("ok").alias("complete"), F.count("*").alias("segments"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT <= 1800 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session, count(*) AS events, min(event_id) AS first_event, round(sum(value), 2) AS total FROM s GROUP BY 1, 2""")
def session_recordings(spark: SparkSession, d: str) -> DataFrame:
    s = sequence.sessions(table(spark, d, "events"), "user_id", "ts", 1800, ["event_id"])
    totals = s.groupBy("user_id", "session_start").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 2).alias("total"))
    numbered = number_in_order(totals.withColumn("day", F.to_date("session_start._t")), ["user_id"], "day", ["session_start"], "session")
    return numbered.select("user_id", "session", "events", "first_event", "total")


# ---------------------------------------------------------------------------------------------- duplicates

@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def sha256_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY source_kind = 'audio', case_id, CASE WHEN source_kind = 'audio' THEN source_csv ELSE msg_timestamp END,
  CASE WHEN source_kind = 'audio' THEN source_row::VARCHAR ELSE sender END, CASE WHEN source_kind <> 'audio' THEN receiver END, CASE WHEN source_kind <> 'audio' THEN {_KEY.format('message')} END ORDER BY row_id) AS k FROM ({_READABLE})) WHERE k = 1""")
def final_chat_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.transcript_unique(merge.readable_rows(table(spark, d, "mass_extract"))).select("row_id")


@query("""SELECT recording_id, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, segment_no, coalesce(start_s, -1), lower(trim(coalesce(speaker, ''))), trim(regexp_replace(lower(coalesce(message, '')), '\\s+', ' ', 'g')) ORDER BY segment_id) AS k FROM audio_utils) WHERE k > 1""")
def recording_exact_rows(spark: SparkSession, d: str) -> DataFrame:
    """Segments that repeat another of the same place, start, speaker and text."""
    a = table(spark, d, "audio_utils")
    keys = [F.col("recording_id"), F.col("segment_no"), F.coalesce("start_s", F.lit(-1.0)), F.lower(F.trim(F.coalesce("speaker", F.lit("")))), T.dedupe_key(F.coalesce("message", F.lit("")))]
    first = dedupe.keep_first(a, keys, ["segment_id"])
    return a.join(first.select("segment_id"), "segment_id", "left_anti").select("recording_id", "segment_id")


@query(f"""WITH w AS (SELECT row_id, conv_key, source_row, sender, {_KEY.format('message')} AS k FROM mass_extract WHERE source_kind = 'chat' AND message IS NOT NULL AND conv_key IS NOT NULL),
n AS (SELECT *, lag(k) OVER v AS before, lag(sender) OVER v AS who, lead(k) OVER v AS after, lead(sender) OVER v AS next FROM w WINDOW v AS (PARTITION BY conv_key ORDER BY source_row, row_id))
SELECT row_id FROM n WHERE k <> '' AND length(k) < 40 AND ((who = sender AND length(before) > length(k) AND contains(before, k)) OR (next = sender AND length(after) > length(k) AND contains(after, k)))""")
def short_contained_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """Short messages that the same sender's message just before or after contains."""
    m = table(spark, d, "mass_extract").filter("source_kind = 'chat' and message is not null and conv_key is not null").select("row_id", "conv_key", "source_row", "sender", "message")
    return dedupe.contained_neighbours(m.withColumn("_b", _row_block()), ["conv_key"], "_b", ["source_row", "row_id"], "sender", "message").select("row_id")


@query()
def adjacent_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Chat rows that repeat a row kept shortly before, with that row and the one whose text is best."""
    m = table(spark, d, "mass_extract").filter("source_kind = 'chat' and conv_key is not null").select("row_id", "conv_key", "source_row", "sender", "message", D.row_time(F.col("msg_timestamp")).alias("ts"))
    return dedupe.adjacent_near_duplicates(m.withColumn("_block", _row_block()), ["conv_key"], "_block", ["source_row", "row_id"], "sender", "message", "ts").filter("first_row <> row_id")


@query()
def recording_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = lookup_join(_segments_once(spark, d), table(spark, d, "recordings").select("recording_id", "case_id", "recorded_at"), "recording_id", "inner")
    return dedupe.covered_recordings(a)


# ---------------------------------------------------------------------------------------------- joins and identity

@query(rf"""WITH w AS (SELECT row_id, conv_key, source_row, {_WORDS.format('message')} AS w FROM mass_extract WHERE source_kind = 'chat' AND message IS NOT NULL AND conv_key IS NOT NULL),
p AS (SELECT row_id, w AS a, lag(w) OVER (PARTITION BY conv_key ORDER BY source_row, row_id) AS b FROM w)
SELECT row_id, CASE WHEN least(len(a), len(b)) > 0 THEN round(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x)))))::DOUBLE / least(len(a), len(b)), 4) ELSE 0.0 END AS ratio FROM p WHERE b IS NOT NULL""")
def token_overlap_adjacent(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mass_extract").filter("source_kind = 'chat' and message is not null and conv_key is not null").select("row_id", "conv_key", "source_row", T.words(F.col("message")).alias("a"))
    p = lagged(m.withColumn("_block", _row_block()), ["conv_key"], "_block", ["source_row", "row_id"], {"b": "a"}).filter("b is not null")
    return p.select("row_id", F.round(T.overlap_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


@query("""SELECT m.row_id, min(p.participant_id) AS participant_id FROM mass_extract m JOIN (SELECT case_id, participant_id, lower(trim(full_name)) AS k FROM case_participants WHERE full_name IS NOT NULL
  UNION SELECT case_id, participant_id, lower(trim(a)) FROM (SELECT case_id, participant_id, unnest(aliases) AS a FROM case_participants)) p ON p.case_id = m.case_id AND p.k = lower(trim(m.sender)) GROUP BY 1""")
def canonical_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    return identity.known_senders(table(spark, d, "mass_extract"), table(spark, d, "case_participants"))


@query(r"""WITH p AS (SELECT participant_id, case_id, regexp_replace(unnest(contact_numbers), '\D', '', 'g') AS digits FROM case_participants),
f AS (SELECT row_id, case_id, regexp_replace(unnest(regexp_extract_all(message, '(\+?\(?\d[\d\s().-]{6,18}\d)', 1)), '\D', '', 'g') AS digits FROM mass_extract WHERE message IS NOT NULL)
SELECT DISTINCT f.row_id, p.participant_id FROM f JOIN p ON p.case_id = f.case_id AND p.digits = f.digits WHERE length(f.digits) >= 7""")
def phone_owner_join(spark: SparkSession, d: str) -> DataFrame:
    return identity.phone_owners(table(spark, d, "mass_extract"), table(spark, d, "case_participants"))


@query("""SELECT m.row_id, CASE WHEN lower(trim(m.sender)) = lower(trim(s.left_name)) THEN 'LEFT' WHEN lower(trim(m.sender)) = lower(trim(s.right_name)) THEN 'RIGHT' ELSE 'UNKNOWN' END AS side FROM mass_extract m LEFT JOIN conversation_state s USING (conv_key) WHERE m.source_kind = 'chat'""")
def apply_side_map(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mass_extract").filter("source_kind = 'chat'").select("row_id", "conv_key", "sender")
    j = lookup_join(m, table(spark, d, "conversation_state").select("conv_key", "left_name", "right_name"), "conv_key")
    name = lambda c: F.lower(F.trim(c))
    return j.select("row_id", F.when(name("sender") == name("left_name"), "LEFT").when(name("sender") == name("right_name"), "RIGHT").otherwise("UNKNOWN").alias("side"))


@query("""SELECT row_id FROM mass_extract m WHERE EXISTS (SELECT 1 FROM case_participants a WHERE a.case_id = m.case_id AND lower(trim(a.full_name)) = lower(trim(m.sender))) AND EXISTS (SELECT 1 FROM case_participants b WHERE b.case_id = m.case_id AND lower(trim(b.full_name)) = lower(trim(m.receiver))) AND lower(trim(sender)) <> lower(trim(receiver))""")
def interaction_pair_semi(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which sender and receiver are different parties of the case by their full names."""
    names = table(spark, d, "case_participants").filter("full_name is not null").select("case_id", F.lower(F.trim("full_name")).alias("k")).distinct()
    m = table(spark, d, "mass_extract").select("row_id", "case_id", F.lower(F.trim("sender")).alias("s"), F.lower(F.trim("receiver")).alias("r")).filter("s <> r")
    return m.join(names.withColumnRenamed("k", "s"), ["case_id", "s"], "left_semi").join(names.withColumnRenamed("k", "r"), ["case_id", "r"], "left_semi").select("row_id")


@query(f"""SELECT case_id, n FROM (SELECT case_id, count(*) FILTER (WHERE {_UNRESOLVED.format('sender')}) AS n FROM mass_extract GROUP BY 1) WHERE n > 0""")
def unresolved_senders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mass_extract").groupBy("case_id").agg(F.count_if(T.is_unresolved(F.col("sender"))).alias("n")).filter("n > 0")


@query(r"""WITH r AS (SELECT recording_id, CASE WHEN json_extract(speaker_map, '$.speaker_map') IS NOT NULL THEN json_extract(speaker_map, '$.speaker_map') ELSE json(speaker_map) END AS m FROM recordings WHERE speaker_map IS NOT NULL),
k AS (SELECT recording_id, m, unnest(json_keys(m)) AS label FROM r)
SELECT recording_id, label, json_extract_string(m, '$.' || label) AS name FROM k""")
def speaker_map_entries(spark: SparkSession, d: str) -> DataFrame:
    return identity.speaker_names(table(spark, d, "recordings"))


@query()
def unique_donor_fill(spark: SparkSession, d: str) -> DataFrame:
    return joins.filled_from_donors(table(spark, d, "mass_extract").filter("source_kind = 'audio'"))


@query()
def bubble_best_match(spark: SparkSession, d: str) -> DataFrame:
    a = lookup_join(table(spark, d, "audio_utils").select("segment_id", "recording_id", "message"), table(spark, d, "recordings").select("recording_id", "case_id"), "recording_id", "inner")
    m = table(spark, d, "mass_extract").filter("source_kind = 'audio'").select("row_id", "case_id", "message")
    return joins.best_overlap(m, "row_id", a, "segment_id", "case_id", "message", 0.58)


# ---------------------------------------------------------------------------------------------- retrieval

@query(rf"""WITH a AS (SELECT DISTINCT case_id, unnest({_WORDS.format('message')}) AS t FROM mass_extract WHERE source_kind = 'audio' AND message IS NOT NULL),
t AS (SELECT case_id, t FROM a WHERE length(t) >= 4 AND t NOT IN ({', '.join("'" + w + "'" for w in retrieval.CONTEXT_STOPWORDS)})),
c AS (SELECT row_id, case_id, {_ROW_TIME.format('msg_timestamp')}::DATE AS d, list_distinct({_WORDS.format('message')}) AS w FROM mass_extract WHERE source_kind = 'chat' AND message IS NOT NULL),
o AS (SELECT c.row_id, c.case_id, c.d, count(t.t) AS overlap FROM (SELECT row_id, case_id, d, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS x FROM c WHERE d IS NOT NULL) c LEFT JOIN t ON t.case_id = c.case_id AND t.t = c.x GROUP BY 1, 2, 3),
g AS (SELECT case_id, d, row_number() OVER (PARTITION BY case_id ORDER BY sum(overlap) DESC, max(overlap) DESC, d) AS place FROM o GROUP BY case_id, d),
r AS (SELECT o.*, g.place, row_number() OVER (PARTITION BY o.case_id, o.d ORDER BY o.overlap DESC, o.row_id) AS k FROM o JOIN g ON g.case_id = o.case_id AND g.d = o.d WHERE g.place <= 14)
SELECT case_id, place, strftime(d, '%d/%m/%Y') AS day, row_id, overlap FROM r WHERE k <= 8 AND case_id IN (SELECT case_id FROM t)""")
def date_grouped_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.date_context(table(spark, d, "mass_extract"))


@query(rf"""WITH p AS (SELECT doc_id, case_id, unnest(string_split_regex(text, '\n\s*\n')) AS body, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) - 1 AS pos FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL),
names AS (SELECT DISTINCT case_id, lower(trim(full_name)) AS k FROM case_participants WHERE full_name IS NOT NULL AND trim(full_name) <> ''),
s AS (SELECT p.doc_id, p.case_id, p.pos, count(n.k) AS names FROM p LEFT JOIN names n ON n.case_id = p.case_id AND contains(lower(p.body), n.k) WHERE trim(p.body) <> '' GROUP BY 1, 2, 3)
SELECT case_id, doc_id, pos, names, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY names DESC, doc_id, pos) AS k FROM s WHERE names > 0) WHERE k <= 12""")
def relevant_passages_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.passages_naming_parties(table(spark, d, "documents"), table(spark, d, "case_participants"))


# ---------------------------------------------------------------------------------------------- files

@query(f"SELECT file_id, {files.PLATFORM_SQL} AS platform, {files.EXTENSION_SQL} AS ext, {files.KIND_SQL} AS kind FROM file_inventory")
def platform_by_path(spark: SparkSession, d: str) -> DataFrame:
    return files.classified(table(spark, d, "file_inventory")).select("file_id", "platform", "ext", "kind")


@query(f"SELECT coalesce(case_id, '') AS case_id, coalesce(lower(file_status), 'unknown') AS status, {files.KIND_SQL} AS kind, count(*) AS files FROM file_inventory GROUP BY 1, 2, 3")
def inventory_status(spark: SparkSession, d: str) -> DataFrame:
    f = files.classified(table(spark, d, "file_inventory"))
    return f.groupBy(F.coalesce("case_id", F.lit("")).alias("case_id"), F.coalesce(F.lower("file_status"), F.lit("unknown")).alias("status"), "kind").agg(F.count("*").alias("files"))


@query(r"""WITH s AS (SELECT file_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(rel_path, '^.*/', ''), '\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g') AS a FROM file_inventory WHERE rel_path IS NOT NULL),
t AS (SELECT file_id, CASE WHEN regexp_replace(a, '^[._]+|[._]+$', '', 'g') = '' THEN 'input' ELSE regexp_replace(a, '^[._]+|[._]+$', '', 'g') END AS stem FROM s)
SELECT file_id, CASE WHEN k = 1 THEN stem ELSE stem || '_' || printf('%03d', k) END AS stem FROM (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY file_id) AS k FROM t)""")
def unique_output_stem(spark: SparkSession, d: str) -> DataFrame:
    return files.unique_stems(table(spark, d, "file_inventory"))


@query(f"""SELECT case_id, rel_path, score FROM (SELECT case_id, rel_path, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, depth, rel_path DESC) AS k FROM
  (SELECT case_id, rel_path, {files.SCORE_SQL} AS score, len(string_split(rel_path, '/')) AS depth FROM file_inventory WHERE rel_path IS NOT NULL AND case_id IS NOT NULL)) WHERE k = 1""")
def report_discovery(spark: SparkSession, d: str) -> DataFrame:
    return files.best_report(table(spark, d, "file_inventory"))


# ---------------------------------------------------------------------------------------------- evidence

_AMOUNTS = r"list_transform(regexp_extract_all({0}, '((?:[$€£]|\b(?:USD|PHP|EUR|GBP)\s?)\d[\d,]*(?:\.\d{{2}})?)', 1), lambda x: regexp_replace(x, '[,\s]', '', 'g'))"


@query(r"""SELECT * FROM (SELECT row_id, nullif(trim(regexp_extract(message, '(?im)^(?:from|sender):?[ \t]+([^<\n]+)', 1)), '') AS mail_from, lower(nullif(trim(regexp_extract(message, '(?im)^(?:from|sender):?[ \t]+[^<\n]*\n?<([^>\n]+)>', 1)), '')) AS mail_address,
  nullif(trim(regexp_extract(message, '(?im)^subject:[ \t]*([^\n]+)$', 1)), '') AS subject FROM mass_extract WHERE message IS NOT NULL) WHERE mail_from IS NOT NULL OR subject IS NOT NULL""")
def email_headers(spark: SparkSession, d: str) -> DataFrame:
    return evidence.mail_headers(table(spark, d, "mass_extract"))


@query(f"""WITH b AS (SELECT case_id, unnest({_AMOUNTS.format('message')}) AS amount FROM mass_extract WHERE source_kind = 'email' AND message IS NOT NULL AND case_id IS NOT NULL
  INTERSECT SELECT case_id, unnest({_AMOUNTS.format('text')}) FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL) SELECT case_id, amount, count(*) OVER (PARTITION BY case_id) = 1 AS agreed FROM b""")
def amount_consensus_intersect(spark: SparkSession, d: str) -> DataFrame:
    return evidence.agreed_amounts(table(spark, d, "mass_extract"), table(spark, d, "documents"))


@query(rf"""WITH p AS (SELECT case_id, participant_id, {_WORDS.format('full_name')}[1] AS w FROM case_participants WHERE full_name IS NOT NULL AND case_id IS NOT NULL),
t AS (SELECT row_id, case_id, lower(message) AS m, unnest(list_distinct({_WORDS.format('message')})) AS w FROM mass_extract WHERE message IS NOT NULL AND case_id IS NOT NULL)
SELECT row_id, participant_id, CASE WHEN regexp_matches(m, '\b(i''m|i am|this is|my name is) ' || p.w || '\b') THEN 'self' WHEN regexp_matches(m, '(^|[.!?,\n] ?)(hi|hello|dear|good day),? ' || p.w || '\b') OR regexp_matches(m, '(^|\n)' || p.w || ',? please') THEN 'address' ELSE 'mention' END AS cue
FROM t JOIN p ON p.case_id = t.case_id AND p.w = t.w WHERE length(p.w) >= 3""")
def identity_cues(spark: SparkSession, d: str) -> DataFrame:
    return evidence.identity_cues(table(spark, d, "mass_extract"), table(spark, d, "case_participants"))


_CUED = rf"""p AS (SELECT case_id, participant_id, {_WORDS.format('full_name')}[1] AS w FROM case_participants WHERE full_name IS NOT NULL AND case_id IS NOT NULL),
t AS (SELECT row_id, case_id, lower(message) AS m, unnest(list_distinct({_WORDS.format('message')})) AS w FROM mass_extract WHERE message IS NOT NULL AND case_id IS NOT NULL),
ic AS (SELECT row_id, participant_id, CASE WHEN regexp_matches(m, '\b(i''m|i am|this is|my name is) ' || p.w || '\b') THEN 'self' WHEN regexp_matches(m, '(^|[.!?,\n] ?)(hi|hello|dear|good day),? ' || p.w || '\b') OR regexp_matches(m, '(^|\n)' || p.w || ',? please') THEN 'address' ELSE 'mention' END AS cue
  FROM t JOIN p ON p.case_id = t.case_id AND p.w = t.w WHERE length(p.w) >= 3),
st AS (SELECT conv_key, case_id, lower(trim(left_name)) AS l, lower(trim(right_name)) AS r FROM conversation_state),
chat AS (SELECT row_id, conv_key, sender, lower(trim(sender)) AS s FROM mass_extract WHERE source_kind = 'chat' AND conv_key IS NOT NULL),
sided AS (SELECT row_id, conv_key, CASE WHEN s = l THEN 'LEFT' ELSE 'RIGHT' END AS side FROM chat JOIN st USING (conv_key) WHERE s = l OR s = r),
cues AS (SELECT conv_key, side, cue, lower(trim(full_name)) AS name, count(*) AS n FROM ic JOIN sided USING (row_id) JOIN case_participants c USING (participant_id) WHERE full_name IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_CUED} SELECT conv_key, side, cue, name, n FROM cues")
def side_cues(spark: SparkSession, d: str) -> DataFrame:
    return evidence.side_cues(*(table(spark, d, n) for n in ("mass_extract", "conversation_state", "case_participants")))


_PASSAGES = r"""para AS (SELECT case_id, doc_id, unnest(string_split_regex(lower(text), '\n\s*\n')) AS body, generate_subscripts(string_split_regex(lower(text), '\n\s*\n'), 1) AS pos FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL),
nm AS (SELECT DISTINCT case_id, lower(trim(full_name)) AS k FROM case_participants WHERE full_name IS NOT NULL AND case_id IS NOT NULL),
held AS (SELECT DISTINCT para.case_id, doc_id, pos, k FROM para JOIN nm ON nm.case_id = para.case_id AND contains(body, k)),
passages AS (SELECT x.case_id, x.k AS a, y.k AS b, count(*) AS n FROM held x JOIN held y ON x.case_id = y.case_id AND x.doc_id = y.doc_id AND x.pos = y.pos AND x.k < y.k GROUP BY 1, 2, 3)"""


@query(f"WITH {_PASSAGES} SELECT case_id, a, b, n FROM passages")
def passage_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evidence.passage_pairs(table(spark, d, "documents"), table(spark, d, "case_participants"))


@query(f"""WITH {_CUED}, {_PASSAGES},
pool AS (SELECT conv_key, name, min(k) AS k, sum(n) AS n FROM (SELECT conv_key, s AS name, count(*) AS n, 3 AS k FROM chat WHERE NOT {_UNRESOLVED.format('sender')} GROUP BY 1, 2
  UNION ALL SELECT conv_key, name, sum(n), 2 FROM cues GROUP BY 1, 2 UNION ALL SELECT conv_key, x, 0, 1 FROM (SELECT conv_key, unnest([l, r]) AS x FROM st) WHERE NOT {_UNRESOLVED.format('x')}) GROUP BY 1, 2),
chosen AS (SELECT conv_key, name FROM (SELECT *, row_number() OVER (PARTITION BY conv_key ORDER BY k, n DESC, name) AS place FROM pool) WHERE place <= 16),
pairs AS (SELECT x.conv_key, x.name AS l, y.name AS r FROM chosen x JOIN chosen y ON x.conv_key = y.conv_key AND x.name <> y.name),
each AS (SELECT pairs.*, cue, name, n, CASE WHEN side = 'LEFT' THEN l ELSE r END AS snd, CASE WHEN side = 'LEFT' THEN r ELSE l END AS rcv FROM pairs LEFT JOIN cues USING (conv_key)),
weighed AS (SELECT conv_key, l, r, coalesce(sum(n * CASE WHEN cue = 'self' THEN CASE WHEN name = snd THEN 125 ELSE -165 END WHEN cue = 'address' THEN CASE WHEN name = rcv THEN 20 WHEN name = snd THEN 8 ELSE -35 END ELSE 0 END), 0) AS w,
  coalesce(sum(n) FILTER (WHERE cue = 'self' AND name <> snd), 0) AS hard, coalesce(sum(n) FILTER (WHERE (cue = 'self' AND name = snd) OR (cue = 'address' AND name = rcv)), 0) AS strong,
  coalesce(sum(n) FILTER (WHERE cue = 'mention' AND name = l), 0) AS ml, coalesce(sum(n) FILTER (WHERE cue = 'mention' AND name = r), 0) AS mr,
  coalesce(sum(n) FILTER (WHERE ((cue = 'self' AND name = snd) OR (cue = 'address' AND name = rcv)) AND name = l), 0) AS sl, coalesce(sum(n) FILTER (WHERE ((cue = 'self' AND name = snd) OR (cue = 'address' AND name = rcv)) AND name = r), 0) AS sr FROM each GROUP BY 1, 2, 3),
pri AS (SELECT case_id, list(DISTINCT lower(trim(full_name))) AS names FROM case_participants WHERE case_role = 'complainant' AND full_name IS NOT NULL AND case_id IS NOT NULL GROUP BY 1),
known AS (SELECT w.*, coalesce(w.l = st.l AND w.r = st.r, false) AS same, coalesce(w.l = st.r AND w.r = st.l, false) AS turned, coalesce(w.l = st.l, false) AS lk, coalesce(w.r = st.r, false) AS rk,
  coalesce(list_contains(names, w.l) OR list_contains(names, w.r), false) AS party, least(coalesce(passages.n, 0), 3) AS passages
  FROM weighed w LEFT JOIN st USING (conv_key) LEFT JOIN pri ON pri.case_id = st.case_id LEFT JOIN passages ON passages.case_id = st.case_id AND passages.a = least(w.l, w.r) AND passages.b = greatest(w.l, w.r)),
scored AS (SELECT *, w - CASE WHEN ml > 0 AND sl = 0 THEN least(30, 10 * ml) ELSE 0 END - CASE WHEN mr > 0 AND sr = 0 THEN least(30, 10 * mr) ELSE 0 END + CASE WHEN lk THEN 18 ELSE 0 END + CASE WHEN rk THEN 18 ELSE 0 END
  + CASE WHEN same THEN 42 ELSE 0 END + CASE WHEN turned THEN 14 ELSE 0 END + CASE WHEN party THEN 28 ELSE 0 END + 6 * passages AS score, min(hard) OVER (PARTITION BY conv_key) AS cleanest FROM known)
SELECT conv_key, place, l AS "left", r AS "right", score, hard, strong FROM (SELECT *, row_number() OVER (PARTITION BY conv_key ORDER BY hard, score DESC, strong DESC, same DESC, passages DESC, party DESC, l, r) AS place FROM scored WHERE cleanest > 0 OR hard = 0) WHERE place <= 10""")
def hypothesis_ranking(spark: SparkSession, d: str) -> DataFrame:
    return evidence.side_hypotheses(*(table(spark, d, n) for n in ("mass_extract", "conversation_state", "case_participants", "documents")))


@query("""SELECT m.conv_key, CASE WHEN lower(trim(m.sender)) = lower(trim(s.left_name)) THEN 'LEFT' WHEN lower(trim(m.sender)) = lower(trim(s.right_name)) THEN 'RIGHT' ELSE 'UNKNOWN' END AS side, count(*) AS rows, sum(length(coalesce(message, ''))) AS chars
  FROM mass_extract m LEFT JOIN conversation_state s USING (conv_key) WHERE m.source_kind = 'chat' AND m.conv_key IS NOT NULL GROUP BY 1, 2""")
def side_votes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.side_votes(table(spark, d, "mass_extract"), table(spark, d, "conversation_state"))


_HUMAN_NAME = r"""(length({0}) <= 80 AND len(string_split({0}, ' ')) BETWEEN 2 AND 5 AND len(list_filter(string_split({0}, ' '), lambda w: NOT regexp_matches(w, '^([A-Z][A-Za-z''’-]*|[A-Z]\.)$'))) = 0
  AND NOT list_has_any(list_transform(string_split({0}, ' '), lambda w: lower(regexp_replace(w, '^[.''"-]+|[.''"-]+$', '', 'g'))), string_split('account advisor agency alleged amount application army bank case chat chronology clinic company complainant complaint consult consultancy consulting contact corps country customs date department description details document email evidence facebook financial findings fraud full hospital identity incident information investigation investment legal location marine matter messenger moneygram name narrative office overview package payment platform police receiver report reported representative section sender service shipping statement subject summary support suspect suspected team time timeline transaction transfer viber victim website witness', ' ')))"""
_NAME_BODY = r"regexp_replace({0}, '^[\s,;:.()\[\]{{}}\"'']+|[\s,;:.()\[\]{{}}\"'']+$', '', 'g')"


@query(f"""SELECT DISTINCT case_id, name FROM (SELECT case_id, name, {_NAME_BODY.format(_SQUEEZE.format('name'))} AS body FROM (SELECT case_id, unnest([sender, receiver]) AS name FROM mass_extract WHERE case_id IS NOT NULL)) WHERE {_HUMAN_NAME.format('body')}""")
def human_names(spark: SparkSession, d: str) -> DataFrame:
    """Senders and receivers that are written as a person's full name."""
    names = table(spark, d, "mass_extract").filter("case_id is not null").select("case_id", F.explode(F.array("sender", "receiver")).alias("name")).distinct()
    return names.filter(T.is_human_name(F.col("name")))


@query(f"""WITH c AS (SELECT DISTINCT case_id, name FROM (SELECT case_id, trim(full_name) AS name FROM case_participants WHERE case_id IS NOT NULL UNION ALL SELECT case_id, trim(regexp_extract(text, '(?m)^Statement of ([^\\n]+)$', 1)) FROM documents WHERE case_id IS NOT NULL AND regexp_matches(text, '(?m)^Statement of ([^\\n]+)$')
  UNION ALL SELECT case_id, trim(unnest(regexp_extract_all(message, 'Full [Nn]ame:\\s*([A-Z][A-Za-z''’.-]*(?: [A-Z][A-Za-z''’.-]*)+)', 1))) FROM mass_extract WHERE case_id IS NOT NULL AND message IS NOT NULL))
SELECT case_id, string_agg(name, '; ' ORDER BY name) AS names, count(*) AS n FROM (SELECT case_id, name, {_NAME_BODY.format(_SQUEEZE.format('name'))} AS body FROM c) WHERE {_HUMAN_NAME.format('body')} GROUP BY 1""".replace("\\\\", "\\"))
def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    """The people a case may be about: its parties, those who made statements, and full names that messages give after a label."""
    stated = evidence.statement_makers(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "case_id"), "doc_id").select("case_id", "name")
    given = table(spark, d, "mass_extract").filter("message is not null").select("case_id", F.explode(F.regexp_extract_all("message", F.lit(r"Full [Nn]ame:\s*([A-Z][A-Za-z'’.-]*(?: [A-Z][A-Za-z'’.-]*)+)"), 1)).alias("name"))
    every = table(spark, d, "case_participants").select("case_id", F.col("full_name").alias("name")).unionByName(stated).unionByName(given)
    names = every.filter("case_id is not null").select("case_id", F.trim("name").alias("name")).filter(T.is_human_name(F.col("name"))).distinct()
    return names.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names"), F.count("*").alias("n"))


@query(f"""SELECT DISTINCT label FROM (SELECT {_SQUEEZE.format('v')} AS label FROM (SELECT unnest([sender, receiver]) AS v FROM mass_extract WHERE source_kind = 'chat')) WHERE lower(label) IN ('possible offences', 'possible offenses', 'executive summary', 'incident summary', 'case overview', 'evidence package', 'matter reported', 'timeline', 'victim details', 'complainant details', 'suspect details', 'report summary')
  OR list_has_any(regexp_split_to_array(lower(label), '[^\\p{{L}}\\p{{N}}]+'), string_split('offence offences offense offenses summary overview details evidence report timeline section subject victim complainant suspect sender receiver profile account contact information matter incident', ' '))""".replace("\\\\", "\\"))
def heading_labels(spark: SparkSession, d: str) -> DataFrame:
    """Chat participants that are headings or labels of a report."""
    names = table(spark, d, "mass_extract").filter("source_kind = 'chat'").select(F.explode(F.array("sender", "receiver")).alias("v")).select(T.squeeze(F.col("v")).alias("label")).distinct()
    return names.filter(T.is_heading_label(F.col("label")))


@query(r"""SELECT source_kind, count(*) FILTER (WHERE regexp_matches(message, '(?i)https?\s*:|www\s*\.|[@/\\_=`]|[\d€$£]|\w[.,;:!?…]\w|\b(?:password|passcode|username|login|api[_ -]?key)\b')) AS sensitive, count(*) AS rows FROM mass_extract GROUP BY 1""")
def sensitive_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mass_extract").groupBy("source_kind").agg(F.count_if(T.is_sensitive(F.col("message"))).alias("sensitive"), F.count("*").alias("rows"))


@query(f"""WITH r AS (SELECT case_id, source_csv, NOT {_UNRESOLVED.format('sender')} AS s, NOT {_UNRESOLVED.format('receiver')} AS r, lower(trim(sender)) AS sn, lower(trim(receiver)) AS rn, message FROM mass_extract WHERE source_kind = 'audio' AND case_id IS NOT NULL AND source_csv IS NOT NULL),
k AS (SELECT case_id, source_csv, count(*) FILTER (WHERE s) + count(*) FILTER (WHERE r) AS resolved, len(list_distinct(list_concat(coalesce(list(sn) FILTER (WHERE s), []), coalesce(list(rn) FILTER (WHERE r), [])))) AS people, count(*) AS rows,
  sum(len(list_filter(string_split({_SQUEEZE.format(r"regexp_replace(lower(replace(coalesce(message, ''), '’', chr(39))), '[^\p{L}\p{N}_\s]', ' ', 'g')")}, ' '), lambda x: x <> ''))) AS words FROM r GROUP BY 1, 2)
SELECT case_id, source_csv, resolved, people, rows, words FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY resolved = 2 * rows DESC, resolved DESC, people DESC, rows DESC, words DESC, source_csv) AS place FROM k) WHERE place = 1""")
def best_recording_copy(spark: SparkSession, d: str) -> DataFrame:
    """The audio transcript of each case with the best evidence."""
    rows = table(spark, d, "mass_extract").filter("source_kind = 'audio' and case_id is not null and source_csv is not null")
    return dedupe.best_recordings(rows, ["case_id"], "source_csv")


_STARTS = "and but because so that which with without for to of in on at by from as than my your our their the a an"
_PLAIN_TEXT = _SQUEEZE.format(r"regexp_replace(message, '[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0E}\x{FE0F}\x{200D}]+', '', 'g')".replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")


@query(rf"""SELECT row_id FROM (SELECT row_id, t, regexp_extract_all(t, '[A-Za-z'']+', 0) AS w FROM (SELECT row_id, {_PLAIN_TEXT} AS t FROM mass_extract WHERE message IS NOT NULL)) WHERE len(w) > 0 AND ((regexp_matches(t, '^[a-zà-ÿ]') AND len(w) <= 8 AND
  (contains(t, '?') OR list_contains(string_split('{_STARTS} there then right', ' '), regexp_replace(lower(w[1]), '^''+|''+$', '', 'g')))) OR (len(w) <= 12 AND regexp_matches(t, '\b[a-z]{{2,}}\s+(The|I|I''m|I''ll|You|We|They)\b')))""")
def message_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Messages that look like a piece of another."""
    return table(spark, d, "mass_extract").filter(T.is_fragment(F.col("message"))).select("row_id")


@query(rf"""WITH m AS (SELECT row_id, conv_key, source_row, coalesce(sender, '') AS s, message, {_ROW_TIME.format('msg_timestamp')} AS ts FROM mass_extract WHERE source_kind = 'chat' AND conv_key IS NOT NULL AND message IS NOT NULL),
n AS (SELECT *, lag(s) OVER w AS who, trim(lag(message) OVER w) AS a, lag(ts) OVER w AS then_ts, trim(message) AS b, regexp_extract_all(trim(message), '[A-Za-z0-9'']+', 0) AS tk FROM m WINDOW w AS (PARTITION BY conv_key ORDER BY source_row, row_id)),
f AS (SELECT *, lower(regexp_replace(tk[1], '[^A-Za-z'']+', '', 'g')) AS first, regexp_matches(b, '^[a-zà-ÿ]') AS small, NOT regexp_matches(a, '[.!?…]$') AS op FROM n),
g AS (SELECT *, CASE WHEN who = s AND NOT coalesce(ts::DATE <> then_ts::DATE OR abs(epoch(ts)::BIGINT - epoch(then_ts)::BIGINT) > 60, false) AND coalesce(a <> '' AND len(tk) > 0 AND NOT (small AND contains(b, '?'))
  AND ((op AND ((len(tk) <= 8 AND (small OR list_contains(string_split('{_STARTS} better', ' '), first))) OR len(tk) <= 3)) OR (len(tk) <= 2 AND regexp_matches(a, '[,;:]$') AND first NOT IN ('yes', 'no', 'ok', 'okay'))), false) THEN 0 ELSE 1 END AS fresh FROM f),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_key ORDER BY source_row, row_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT arg_min(row_id, (source_row, row_id)) AS row_id, count(*) AS parts, trim(regexp_replace(regexp_replace(regexp_replace({_SQUEEZE.format("string_agg(message, ' ' ORDER BY source_row, row_id)")}, '\s+([,.?!:;])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g'), '\s+([)\]}}])', '\1', 'g')) AS message FROM r GROUP BY conv_key, run HAVING count(*) > 1""")
def continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    return evidence.continuations(table(spark, d, "mass_extract"), _row_block())


@query(f"""WITH s AS (SELECT conv_key, trim(receiver) AS name, count(*) AS n FROM mass_extract WHERE source_kind = 'chat' AND conv_key IS NOT NULL AND NOT {_UNRESOLVED.format('receiver')} GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY conv_key ORDER BY n DESC, name)) SELECT conv_key, name, n FROM k WHERE k = 1 AND n >= 4 AND n >= second + 2""")
def counterpart_margin(spark: SparkSession, d: str) -> DataFrame:
    return evidence.clear_counterparts(table(spark, d, "mass_extract"))


@query(r"""SELECT doc_id, trim(regexp_extract(text, '(?m)^Statement of ([^\n]+)$', 1)) AS name, nullif(regexp_extract(text, '(?m)^Date: [^\n]*(20\d{2})[^\n]*$', 1), '') AS year FROM documents WHERE regexp_matches(text, '(?m)^Statement of ([^\n]+)$')""")
def statement_makers(spark: SparkSession, d: str) -> DataFrame:
    return evidence.statement_makers(table(spark, d, "documents"))


@query("""SELECT r.recording_id, arg_max(m.row_id, (m.loaded_at, m.row_id)) AS row_id FROM recordings r LEFT JOIN mass_extract m ON m.case_id = r.case_id AND m.source_kind = 'chat' AND m.loaded_at <= r.recorded_at WHERE r.case_id IS NOT NULL AND r.recorded_at IS NOT NULL GROUP BY 1""")
def last_chat_before_recording(spark: SparkSession, d: str) -> DataFrame:
    return evidence.last_chat_before(table(spark, d, "recordings"), table(spark, d, "mass_extract"))


@query("""SELECT m.row_id FROM mass_extract m WHERE m.source_image IS NOT NULL AND NOT EXISTS (SELECT 1 FROM file_inventory f WHERE f.rel_path = m.source_image)""")
def rows_without_file(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose screenshot is not in the inventory."""
    return files.rows_without_file(table(spark, d, "mass_extract").select("row_id", "source_image"), table(spark, d, "file_inventory")).select("row_id")


@query("""SELECT conv_key, row_id, k FROM (SELECT conv_key, row_id, row_number() OVER (PARTITION BY conv_key ORDER BY length(message) DESC, row_id) AS k FROM mass_extract WHERE message IS NOT NULL) WHERE k <= 3""")
def longest_messages_topk(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("conv_key").orderBy(F.length("message").desc(), "row_id"))
    return table(spark, d, "mass_extract").filter("message is not null").select("conv_key", "row_id", k.cast("long").alias("k")).filter("k <= 3")


@query("""SELECT coalesce(case_id, '*') AS case_id, coalesce(source_kind, '*') AS source_kind, count(*) AS n FROM mass_extract WHERE case_id IS NOT NULL AND source_kind IS NOT NULL GROUP BY ROLLUP (case_id, source_kind)""")
def rows_rolled_up(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "mass_extract").filter("case_id is not null and source_kind is not null").rollup("case_id", "source_kind").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("case_id", F.lit("*")).alias("case_id"), F.coalesce("source_kind", F.lit("*")).alias("source_kind"), "n")


@query("""SELECT conv_key, last_visible_date, any_value(n) AS rows FROM (SELECT s.conv_key, s.last_visible_date, (SELECT count(*) FROM mass_extract m WHERE m.conv_key = s.conv_key) AS n FROM conversation_state s) GROUP BY 1, 2""")
def conversation_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "mass_extract").groupBy("conv_key").agg(F.count("*").alias("rows"))
    return table(spark, d, "conversation_state").select("conv_key", "last_visible_date").join(n, "conv_key", "left").select("conv_key", "last_visible_date", F.coalesce("rows", F.lit(0)).alias("rows"))


@query(r"""WITH v AS (SELECT conv_key, source_row, row_id, message, row_number() OVER (PARTITION BY conv_key ORDER BY source_row, row_id) AS pos FROM mass_extract WHERE source_kind = 'chat' AND message IS NOT NULL AND conv_key IS NOT NULL)
SELECT row_id, CASE WHEN regexp_matches(message, '[.!?…]\s*$') THEN 'finished' WHEN regexp_matches(message, '[,;:]\s*$') THEN 'open' ELSE 'bare' END AS ending, CASE WHEN regexp_matches(trim(message), '^[a-z]') THEN 'lower' ELSE 'other' END AS start FROM v""")
def message_endings(spark: SparkSession, d: str) -> DataFrame:
    """How messages end and begin, which decides whether a row can continue the one before."""
    m = table(spark, d, "mass_extract").filter("source_kind = 'chat' and message is not null and conv_key is not null")
    ending = F.when(F.col("message").rlike(r"[.!?…]\s*$"), "finished").when(F.col("message").rlike(r"[,;:]\s*$"), "open").otherwise("bare")
    return m.select("row_id", ending.alias("ending"), F.when(F.trim("message").rlike("^[a-z]"), "lower").otherwise("other").alias("start"))


# ---------------------------------------------------------------------------------------------- general joins and aggregates

@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def grouped_totals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    price = F.col("l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def joined_totals(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
