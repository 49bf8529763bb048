"""Evidence about who and what: mail headers, amounts, cues of identity, hypotheses on sides, bubbles of screens, as-of rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deponent.functions import dates as D
from deponent.functions import text as T
from deponent.operators.scan import carry_forward, lagged
from deponent.session import lookup_join

AMOUNT = r"((?:[$€£]|\b(?:USD|PHP|EUR|GBP)\s?)\d[\d,]*(?:\.\d{2})?)"
# What evidence counts for a pair of names as (left, right). A cue is worth one thing if it fits the side's name, another if the other
# side's, and another if neither's; a name only spoken of loses a little for each time, and remembered sides, the complainant and passages of documents that name both speak for a pair.
SELF_FITS, SELF_ELSE = 125, -165
ADDRESS_FITS, ADDRESS_TURNED, ADDRESS_ELSE = 20, 8, -35
MENTION_LOSS, MENTION_MOST = 10, 30
SIDE_KEPT, PAIR_KEPT, PAIR_TURNED, COMPLAINANT, PASSAGE, PASSAGES_MOST = 18, 42, 14, 28, 6, 3


def mail_headers(rows: DataFrame) -> DataFrame:
    """``row_id``, ``mail_from``, ``mail_address``, ``subject`` of messages that begin with mail headers; missing ones are null."""
    part = lambda p: F.nullif(F.trim(F.regexp_extract("message", p, 1)), F.lit(""))
    got = rows.filter("message is not null").select(
        "row_id",
        part(r"(?im)^(?:from|sender):?[ \t]+([^<\n]+)").alias("mail_from"),
        F.lower(part(r"(?im)^(?:from|sender):?[ \t]+[^<\n]*\n?<([^>\n]+)>")).alias("mail_address"),
        part(r"(?im)^subject:[ \t]*([^\n]+)$").alias("subject"),
    )
    return got.filter("mail_from is not null or subject is not null")


def amounts(c: Column) -> Column:
    """Sums of money with their currency, without separators, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), 1), lambda x: F.regexp_replace(x, r"[,\s]", ""))


def agreed_amounts(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Sums that both a case's mails and its documents name: ``case_id``, ``amount``, ``agreed`` (whether it is the only one)."""
    said = rows.filter("source_kind = 'email' and message is not null and case_id is not null").select("case_id", F.explode(amounts(F.col("message"))).alias("amount"))
    told = documents.filter("case_id is not null and text is not null").select("case_id", F.explode(amounts(F.col("text"))).alias("amount"))
    both = said.intersect(told)
    one = both.groupBy("case_id").agg(F.count("*").alias("n"))
    return both.join(one, "case_id").select("case_id", "amount", (F.col("n") == 1).alias("agreed"))


def identity_cues(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """Mentions of a party's given name: ``row_id``, ``participant_id``, ``cue`` (self, address or mention).

    Names are joined by their first word, so a message is compared only with the parties whose word it holds.
    """
    people = participants.filter("full_name is not null and case_id is not null").select("case_id", "participant_id", F.get(T.words(F.col("full_name")), 0).alias("w")).filter("length(w) >= 3")
    said = rows.filter("message is not null and case_id is not null").select("row_id", "case_id", F.lower("message").alias("m"))
    tokens = said.select("row_id", "case_id", "m", F.explode(F.array_distinct(T.words(F.col("m")))).alias("w"))
    hit = tokens.join(people, ["case_id", "w"])
    near = lambda *parts: F.rlike("m", F.concat(*[F.lit(p) if p != "w" else F.col("w") for p in parts]))
    cue = F.when(near(r"\b(i'm|i am|this is|my name is) ", "w", r"\b"), "self").when(near(r"(^|[.!?,\n] ?)(hi|hello|dear|good day),? ", "w", r"\b") | near("(^|\n)", "w", ",? please"), "address").otherwise("mention")
    return hit.select("row_id", "participant_id", cue.alias("cue"))


def _name(c) -> Column:
    return F.lower(F.trim(c))


def side_cues(rows: DataFrame, conversations: DataFrame, participants: DataFrame) -> DataFrame:
    """Cues of chat rows whose sender is the remembered name of a side: ``conv_key``, ``side``, ``cue``, ``name``, ``n``, added up."""
    chat = rows.filter("source_kind = 'chat' and conv_key is not null")
    sides = conversations.groupBy("conv_key").agg(F.min(F.struct(_name("left_name").alias("l"), _name("right_name").alias("r"))).alias("x")).select("conv_key", "x.*")
    sided = lookup_join(chat.select("row_id", "conv_key", "sender"), sides, "conv_key").withColumn("side", F.when(_name("sender") == F.col("l"), "LEFT").when(_name("sender") == F.col("r"), "RIGHT")).filter("side is not null")
    said = identity_cues(chat, participants).join(sided.select("row_id", "conv_key", "side"), "row_id")
    named = participants.filter("full_name is not null").select("participant_id", _name("full_name").alias("name"))
    return said.join(named, "participant_id").groupBy("conv_key", "side", "cue", "name").agg(F.count("*").alias("n"))


def passage_pairs(documents: DataFrame, participants: DataFrame) -> DataFrame:
    """Pairs of a case's parties whom one paragraph of its documents names: ``case_id``, ``a``, ``b`` (a < b), ``n`` paragraphs."""
    p = documents.filter("case_id is not null and text is not null").select("case_id", "doc_id", F.posexplode(F.split(F.lower("text"), r"\n\s*\n")).alias("pos", "body"))
    names = participants.filter("full_name is not null and case_id is not null").select("case_id", _name("full_name").alias("k")).distinct().withColumn("t", F.get(T.words(F.col("k")), 0))
    words = p.select("case_id", "doc_id", "pos", "body", F.explode(F.array_distinct(T.words(F.col("body")))).alias("t"))
    held = words.join(names, ["case_id", "t"]).filter(F.contains(F.col("body"), F.col("k"))).groupBy("case_id", "doc_id", "pos").agg(F.array_sort(F.collect_set("k")).alias("ks")).filter("size(ks) > 1")
    pairs = held.select("case_id", F.explode("ks").alias("a"), "ks").select("case_id", "a", F.explode("ks").alias("b")).filter("a < b")
    return pairs.groupBy("case_id", "a", "b").agg(F.count("*").alias("n"))


def side_hypotheses(rows: DataFrame, conversations: DataFrame, participants: DataFrame, documents: DataFrame, most: int = 10, names: int = 16) -> DataFrame:
    """Ordered pairs of a conversation's names as (left, right), best first: ``conv_key``, ``place``, ``left``, ``right``, ``score``, ``hard``, ``strong``.

    Names are those remembered for the sides, those that cues name and the senders, at most ``names`` in this order, then by
    their number; so pairs are bounded. Pairs are scored by the weighted evidence, those that a hard cue contradicts
    (``hard``: somebody else names themselves) are left out where a pair without any exists, and the rest is ordered by
    contradictions, score, fitting cues, kept sides, passages, the complainant, and the names.
    """
    cues = side_cues(rows, conversations, participants)
    chat = rows.filter("source_kind = 'chat' and conv_key is not null")
    state = conversations.groupBy("conv_key").agg(F.min(F.struct("case_id", _name("left_name").alias("kl"), _name("right_name").alias("kr"))).alias("x")).select("conv_key", "x.*")
    sent = chat.filter(~T.is_unresolved(F.col("sender"))).groupBy("conv_key", _name("sender").alias("name")).agg(F.count("*").alias("n")).withColumn("rank", F.lit(3))
    told = cues.groupBy("conv_key", "name").agg(F.sum("n").alias("n")).withColumn("rank", F.lit(2))
    kept = state.select("conv_key", F.explode(F.array("kl", "kr")).alias("name")).filter(~T.is_unresolved(F.col("name"))).withColumns({"n": F.lit(0), "rank": F.lit(1)})
    pool = sent.unionByName(told).unionByName(kept).groupBy("conv_key", "name").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("conv_key").orderBy("rank", F.desc("n"), "name"))
    chosen = pool.withColumn("k", first).filter(F.col("k") <= names).select("conv_key", "name")
    pairs = chosen.withColumnRenamed("name", "left").join(chosen.withColumnRenamed("name", "right"), "conv_key").filter("left <> right")

    sender, receiver = F.when(F.col("side") == "LEFT", F.col("left")).otherwise(F.col("right")), F.when(F.col("side") == "LEFT", F.col("right")).otherwise(F.col("left"))
    is_sender, is_receiver, own, greeted = F.col("name") == sender, F.col("name") == receiver, F.col("cue") == "self", F.col("cue") == "address"
    worth = F.when(own, F.when(is_sender, SELF_FITS).otherwise(SELF_ELSE)).when(greeted, F.when(is_receiver, ADDRESS_FITS).when(is_sender, ADDRESS_TURNED).otherwise(ADDRESS_ELSE)).otherwise(0)
    fits = (own & is_sender) | (greeted & is_receiver)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    loss = lambda x: F.when((F.col(f"m{x}") > 0) & (F.col(f"s{x}") == 0), F.least(F.lit(MENTION_MOST), MENTION_LOSS * F.col(f"m{x}"))).otherwise(0)
    weighed = pairs.join(cues, "conv_key", "left").groupBy("conv_key", "left", "right").agg(
        F.coalesce(F.sum(worth * F.col("n")), F.lit(0)).alias("cues"), count(own & ~is_sender).alias("hard"), count(fits).alias("strong"),
        *[count((F.col("cue") == "mention") & (F.col("name") == F.col(x))).alias(f"m{x}") for x in ("left", "right")], *[count(fits & (F.col("name") == F.col(x))).alias(f"s{x}") for x in ("left", "right")],
    )
    primary = participants.filter("case_role = 'complainant' and full_name is not null and case_id is not null").groupBy("case_id").agg(F.collect_set(_name("full_name")).alias("primary"))
    known = lookup_join(lookup_join(weighed, state, "conv_key"), primary, "case_id")
    both = passage_pairs(documents, participants).select("case_id", "a", "b", F.least("n", F.lit(PASSAGES_MOST)).alias("passages"))
    full = known.withColumns({"a": F.least("left", "right"), "b": F.greatest("left", "right")}).join(both, ["case_id", "a", "b"], "left")
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    same, turned = (F.col("left") == F.col("kl")) & (F.col("right") == F.col("kr")), (F.col("left") == F.col("kr")) & (F.col("right") == F.col("kl"))
    party = F.arrays_overlap("primary", F.array("left", "right"))
    support = F.coalesce("passages", F.lit(0))
    score = F.col("cues") - loss("left") - loss("right") + yes(F.col("left") == F.col("kl"), SIDE_KEPT) + yes(F.col("right") == F.col("kr"), SIDE_KEPT) + yes(same, PAIR_KEPT) + yes(turned, PAIR_TURNED) + yes(party, COMPLAINANT) + PASSAGE * support
    scored = full.select("conv_key", "left", "right", score.alias("score"), "hard", "strong", yes(same, 1).alias("same"), support.alias("passages"), yes(party, 1).alias("party"))
    clean = F.min("hard").over(Window.partitionBy("conv_key")) == 0
    order = Window.partitionBy("conv_key").orderBy("hard", F.desc("score"), F.desc("strong"), F.desc("same"), F.desc("passages"), F.desc("party"), "left", "right")
    left = scored.withColumn("_clean", clean).filter(~F.col("_clean") | (F.col("hard") == 0))
    return left.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most).select("conv_key", "place", "left", "right", "score", "hard", "strong")


def side_votes(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """How much each remembered side of a conversation says: ``conv_key``, ``side``, ``rows``, ``chars``."""
    sides = conversations.groupBy("conv_key").agg(F.min(F.struct(_name("left_name").alias("l"), _name("right_name").alias("r"))).alias("x")).select("conv_key", "x.*")
    chat = rows.filter("source_kind = 'chat' and conv_key is not null").select("conv_key", _name("sender").alias("s"), F.length(F.coalesce("message", F.lit(""))).alias("n"))
    side = F.when(F.col("s") == F.col("l"), "LEFT").when(F.col("s") == F.col("r"), "RIGHT").otherwise("UNKNOWN")
    return lookup_join(chat, sides, "conv_key").groupBy("conv_key", side.alias("side")).agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))


def continuations(rows: DataFrame, block: Column, minutes: int = 1) -> DataFrame:
    """Chat rows joined to the one before that they go on with: ``row_id`` of each run's first row, ``parts`` and ``message``, runs of two or more.

    The row before must be of the same sender and day, at most ``minutes`` off where both times are known. Runs are found over blocks.
    """
    m = rows.filter("source_kind = 'chat' and conv_key is not null and message is not null").select("row_id", "conv_key", "source_row", F.coalesce("sender", F.lit("")).alias("sender"), "message", D.row_time(F.col("msg_timestamp")).alias("ts")).withColumn("_block", block)
    order = ["source_row", "row_id"]
    near = lagged(m, ["conv_key"], "_block", order, {"_who": "sender", "_said": "message", "_then": "ts"})
    apart = (F.to_date("ts") != F.to_date("_then")) | (F.abs(F.unix_timestamp("ts") - F.unix_timestamp("_then")) > 60 * minutes)
    goes_on = F.coalesce(F.col("_who") == F.col("sender"), F.lit(False)) & ~F.coalesce(apart, F.lit(False)) & T.continues(F.col("_said"), F.col("message"))
    starts = near.withColumn("_start", F.when(~goes_on, F.struct(*order)))
    runs = carry_forward(starts, ["conv_key"], "_block", order, {"_run": F.col("_start")})
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "message"))), lambda x: x["message"]), " ")
    return runs.groupBy("conv_key", "_run").agg(F.count("*").alias("parts"), T.clean_message(told).alias("message")).filter("parts > 1").select(F.col("_run.row_id").alias("row_id"), "parts", "message")


def screen_coverage(bubbles: DataFrame, rows: DataFrame, least: float = 0.58) -> DataFrame:
    """Bubbles of screens with the best overlap of their words with a row of the same screen: ``doc``, ``screen``, ``bubble``, ``best``, ``covered``.

    A side that both know must agree. Screens hold a few bubbles and rows, which are compared each with each. Bubbles without
    rows have 0; those that are not covered are missing from the rows.
    """
    b = bubbles.select("doc", "screen", "bubble", F.col("side").alias("bs"), T.words(F.col("text")).alias("bw"))
    r = rows.select("doc", "screen", F.col("side").alias("rs"), T.words(F.col("message")).alias("rw"))
    agree = ~(F.col("bs").isin("LEFT", "RIGHT") & F.col("rs").isin("LEFT", "RIGHT") & (F.col("bs") != F.col("rs")))
    ratio = F.when(F.coalesce(agree, F.lit(True)), F.coalesce(T.overlap_ratio(F.col("bw"), F.col("rw")), F.lit(0.0))).otherwise(0.0)
    best = b.join(r, ["doc", "screen"], "left").groupBy("doc", "screen", "bubble").agg(F.round(F.max(ratio), 4).alias("best"))
    return best.withColumn("covered", F.col("best") >= least)


def added_rows(draft: DataFrame, repair: DataFrame, bubbles: DataFrame, least: float = 0.58) -> DataFrame:
    """The draft's rows and those of a repair that give a bubble which no row of the draft gives: ``doc``, ``screen``, ``side``, ``message``, ``added``.

    Of several repair rows for one bubble the best is added. A screen without a draft takes the whole repair. Screens hold a
    few rows, which are compared each with each.
    """
    have = draft.select("doc", "screen").distinct()
    missing = screen_coverage(bubbles, draft, least).filter("not covered").select("doc", "screen", "bubble")
    open_ = bubbles.join(missing, ["doc", "screen", "bubble"], "left_semi").select("doc", "screen", "bubble", F.col("side").alias("bs"), T.words(F.col("text")).alias("bw"))
    offers = repair.join(have, ["doc", "screen"], "left_semi").select("doc", "screen", "side", "message", T.words(F.col("message")).alias("w")).distinct()
    pairs = offers.join(open_, ["doc", "screen"]).filter(F.coalesce(F.col("side") == F.col("bs"), F.lit(True))).withColumn("r", T.overlap_ratio(F.col("w"), F.col("bw"))).filter(F.col("r") >= least)
    best = pairs.groupBy("doc", "screen", "bubble").agg(F.max_by(F.struct("side", "message"), F.struct("r", F.size("w"), "message")).alias("x")).select("doc", "screen", "x.side", "x.message").distinct()
    alone = repair.join(have, ["doc", "screen"], "left_anti").select("doc", "screen", "side", "message")
    return draft.select("doc", "screen", "side", "message", F.lit(False).alias("added")).unionByName(best.unionByName(alone).withColumn("added", F.lit(True)))


def chosen_candidates(scored: DataFrame, slack: int = 3) -> DataFrame:
    """The candidate of each screen: ``doc``, ``screen``, ``name``, from rows of ``name`` (draft, repair, additive), ``score``, ``rows``.

    The draft stays unless another scores clearly better: by 1, or by 0.35 if it only adds rows. A candidate without rows or
    with more than ``slack`` rows above the draft is no choice; a draft without rows gives way to any.
    """
    draft = scored.filter("name = 'draft'").select("doc", "screen", F.col("score").alias("ds"), F.col("rows").alias("dr"))
    judged = scored.join(draft, ["doc", "screen"]).withColumn("ok", (F.col("name") == "draft") | ((F.col("rows") > 0) & ((F.col("dr") == 0) | (F.col("rows") <= F.col("dr") + slack))))
    best = judged.filter("ok").groupBy("doc", "screen").agg(F.max_by(F.struct("name", "score"), F.struct("score", "rows", "name")).alias("b"), F.max_by(F.struct("name"), F.struct(F.col("rows") > 0, "score", "rows")).alias("any"), F.first("ds").alias("ds"), F.first("dr").alias("dr"))
    margin = F.when(F.col("b.name") == "additive", 0.35).otherwise(1.0)
    name = F.when(F.col("dr") == 0, F.col("any.name")).when(F.col("b.score") >= F.col("ds") + margin, F.col("b.name")).otherwise("draft")
    return best.select("doc", "screen", name.alias("name"))


def text_lines(blocks: DataFrame) -> DataFrame:
    """Blocks of a screen as lines of reading: ``doc``, ``screen``, ``line``, ``side``, ``text``; neighbours down the screen share a line if they overlap by half of the lower one.

    A line is cut where a block begins below the middle of the one above it; blocks of a line are read from left to right.
    """
    w = Window.partitionBy("doc", "screen", "side").orderBy("y", "x", "block")
    before = F.lag(F.struct("y", "h")).over(w)
    new = before.isNull() | (F.col("y") > before["y"] + before["h"] / 2)
    numbered = blocks.withColumn("_new", new.cast("int")).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "block", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("doc", "screen", "side", "line").agg(T.squeeze(told).alias("text"))


def clear_counterparts(rows: DataFrame, least: int = 4, margin: int = 2) -> DataFrame:
    """The name that clearly leads the receivers of a conversation: ``conv_key``, ``name``, ``n``; none where two are close."""
    got = rows.filter("source_kind = 'chat' and conv_key is not null").filter(~T.is_unresolved(F.col("receiver"))).groupBy("conv_key", F.trim("receiver").alias("name")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_key").orderBy(F.desc("n"), "name")
    led = got.withColumns({"k": F.row_number().over(w), "second": F.coalesce(F.lead("n").over(w), F.lit(0))})
    return led.filter((F.col("k") == 1) & (F.col("n") >= least) & (F.col("n") >= F.col("second") + margin)).select("conv_key", "name", "n")


def statement_makers(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``name``, ``year`` of documents headed as someone's statement."""
    head = r"(?m)^Statement of ([^\n]+)$"
    return documents.filter(F.col("text").rlike(head)).select("doc_id", F.trim(F.regexp_extract("text", head, 1)).alias("name"), F.nullif(F.regexp_extract("text", r"(?m)^Date: [^\n]*(20\d{2})[^\n]*$", 1), F.lit("")).alias("year"))


def last_chat_before(recordings: DataFrame, rows: DataFrame) -> DataFrame:
    """As-of join: for each recording the last chat row of its case that was loaded at or before it: ``recording_id``, ``row_id`` (null if none).

    Both sides are laid on one line of time, cut by day, and the last row is carried forward.
    """
    chat = rows.filter("source_kind = 'chat' and case_id is not null and loaded_at is not null").select("case_id", F.col("loaded_at").alias("t"), F.lit(0).alias("side"), F.col("row_id"), F.lit(None).cast("string").alias("recording_id"))
    asked = recordings.filter("case_id is not null and recorded_at is not null").select("case_id", F.col("recorded_at").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("row_id"), "recording_id")
    line = chat.unionByName(asked).withColumn("day", F.to_date("t"))
    run = carry_forward(line, ["case_id"], "day", ["t", "side", "row_id", "recording_id"], {"found": F.col("row_id")})
    return run.filter("side = 1").select("recording_id", F.col("found").alias("row_id"))


def bubbles(blocks: DataFrame, gap: float = 0.9) -> DataFrame:
    """Text blocks of a screen grouped into bubbles: ``doc``, ``screen``, ``bubble``, ``side``, ``time``, ``text``.

    Blocks follow each other down the screen; a new bubble begins with another side, after a pause of more than ``gap`` times
    the median height, or after a block that ends with a clock. Centred blocks belong to no bubble.
    """
    b = blocks.filter("side in ('LEFT', 'RIGHT')")
    screen = Window.partitionBy("doc", "screen")
    w = screen.orderBy("y", "block")
    tail = F.regexp_extract("text", r"(\d{1,2}[:.,;]\d{2})\s*(?:[✓✔v]*)$", 1)
    timed = b.withColumn("_tall", F.percentile("h", 0.5).over(screen)).withColumn("_clock", D.clock(F.nullif(tail, F.lit(""))))
    new = F.lag("side").over(w).isNull() | (F.lag("side").over(w) != F.col("side")) | F.lag("_clock").over(w).isNotNull() | (F.col("y") - F.lag(F.col("y") + F.col("h")).over(w) > gap * F.col("_tall"))
    marked = timed.withColumn("_new", new.cast("int")).withColumn("bubble", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = T.squeeze(F.when(F.col("_clock").isNotNull(), F.regexp_replace("text", r"\s*\d{1,2}[:.,;]\d{2}\s*[✓✔v]*$", "")).otherwise(F.col("text")))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "block", body.alias("t")))), lambda x: x["t"]), " ")
    return marked.groupBy("doc", "screen", "bubble").agg(F.first("side").alias("side"), F.max("_clock").alias("time"), T.squeeze(told).alias("text"))


def packed_excerpt(blocks: DataFrame, key: str, order: str, rank: str, text: str, budget: int) -> DataFrame:
    """The blocks of each ``key`` taken by ``rank`` while they fit into ``budget`` characters; one that does not fit is skipped.

    A first block longer than the budget is cut to it. Groups are folded in one task each, as every choice depends on all before.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, kept = 0, []
        for row in pdf.sort_values([rank, order]).itertuples(index=False):
            body = getattr(row, text) or ""
            extra = len(body) + (1 if kept else 0)
            if kept and used + extra > budget:
                continue
            if not kept and len(body) > budget:
                body, extra = body[:budget], budget
            kept.append((getattr(row, key), getattr(row, order), body))
            used += extra
        return pd.DataFrame(kept, columns=[key, order, text])

    picked = blocks.select(key, order, rank, text)
    return picked.groupBy(key).applyInPandas(fold, picked.drop(rank).schema)
