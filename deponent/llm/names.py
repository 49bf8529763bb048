"""Names of people: tokens, titles, skeletons that survive misread letters, and lexicons learned from the parties of all cases."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words before a name that are not part of it.
TITLES = frozenset("mr mrs ms miss mx sir madam dr prof atty atty. attorney engr hon rev fr sr don doña dona señor señora herr frau mister".split())
# Words that mark an organisation.
ORGANISATION_WORDS = frozenset(
    "inc incorporated corp corporation co company ltd limited llc llp plc gmbh ag sa bv group holdings services service associates department dept desk unit international intl management mgmt "
    "bank lending credit savings trading investment investments payout parcel courier claims recovery consumer complaints office agency institute foundation university ministry bureau trust partners".split()
)
# Short forms of given names.
SHORT_NAMES = {
    "alexander": "alex lex sasha xander", "elizabeth": "liz liza beth betty betsy eliza", "william": "bill will billy", "frederick": "fred freddie", "katherine": "kate kathy kat", "benjamin": "ben benjie benny", "theodore": "ted theo teddy",
    "christopher": "chris topher kit", "samuel": "sam sammy", "daniel": "dan danny", "daniela": "dani", "martin": "marty", "martina": "tina tinay marti", "patricia": "pat trish patty", "margarita": "margie marga rita", "francisco": "paco kiko pancho frank",
    "guillermo": "memo guiller", "ignacio": "nacho iggy", "concepcion": "connie concha", "dolores": "lola dolly", "josefina": "josie pina", "roberto": "berto bobby bert", "ricardo": "ricky carding", "eduardo": "ed eddie edong", "antonio": "tony tonyo",
    "ramon": "mon monching", "ramona": "monette mona", "leonardo": "leo nardo", "emmanuel": "manny noel", "victoria": "vicky tori", "veronica": "vera ronnie", "isabella": "isa bella", "gabriela": "gabby ella", "angelica": "angie jelai",
    "rosalinda": "rosa linda", "teresita": "tess tessie tinay", "susannah": "sue suzie", "philippa": "pippa", "nathaniel": "nate nathan", "jonathan": "jon jonny", "maximilian": "max", "madeleine": "maddie lena", "beatriz": "bea betsy", "cristina": "cris tina",
    "hannelore": "hanne lore", "siegfried": "siggi", "adrian": "ade", "adriana": "yana", "julian": "jules", "juliana": "juliet",
}
#: A name token is sent to the tasks if this share of all parties has it; each party has few, so there are at most a few million in any corpus.
TOKEN_SHARE = 1e-6

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*", re.U)
_SKELETON = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "@": "a", "4": "a", "+": "t", "7": "t", "3": "e", "c": "e", "9": "g", "q": "g", "6": "b", "8": "b", "(": "e"})


def fold(text: str) -> str:
    """Lower case without marks on letters."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def skeleton(word: str) -> str:
    """A form in which characters that are read for one another are the same."""
    w = fold(word)
    for pair, one in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u")):
        if pair in w:
            w = w.replace(pair, one)
    return w.translate(_SKELETON)


def is_organisation(name: str) -> bool:
    return any(w in ORGANISATION_WORDS for w in re.findall(r"[a-z]+", fold(name)))


def name_tokens(participants: DataFrame) -> DataFrame:
    """Distinct name tokens of people: ``token`` (lower case), ``given`` and ``family`` and ``alias`` (numbers of parties that have it so)."""
    people = participants.filter(F.col("full_name").isNotNull() & (F.coalesce("case_role", F.lit("")) != "organisation"))
    people = people.filter(~F.lower("full_name").rlike(r"\b(?:" + "|".join(sorted(ORGANISATION_WORDS)) + r")\b"))
    words = F.filter(F.split(F.lower(F.trim("full_name")), r"[\s,]+"), lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", "")) > 1)
    known = people.withColumn("w", words).filter(F.size("w") > 0)
    given = known.select(F.element_at("w", 1).alias("token"), F.lit("given").alias("kind"))
    family = known.filter(F.size("w") > 1).select(F.element_at("w", -1).alias("token"), F.lit("family").alias("kind"))
    alias = known.select(F.explode_outer("aliases").alias("a")).filter("a is not null").select(F.explode(F.split(F.lower("a"), r"[\s,().]+")).alias("token"), F.lit("alias").alias("kind"))
    every = given.unionByName(family).unionByName(alias)
    least = TOKEN_SHARE * participants.count()
    every = every.filter(F.length("token") > 1).groupBy("token").pivot("kind", ["given", "family", "alias"]).count().na.fill(0)
    return every.filter(F.col("given") + F.col("family") + F.col("alias") >= least)


def _shorter(w: str) -> set[str]:
    return {w[:k] + w[k + 1 :] for k in range(len(w))}


def _is_slip(w: str, known: set[str], near: set[str]) -> bool:
    """Whether a spelling seen once is a letter more, less, changed or swapped away from a known name; ``near`` holds the known names less a letter."""
    return w in near or not known.isdisjoint(less := _shorter(w)) or not near.isdisjoint(less)


def lexicon(participants: DataFrame) -> tuple[frozenset, frozenset, frozenset]:
    """Given names, family names, and further names in lower case that need an introduction: short forms, and given names that no party has."""
    rows = name_tokens(participants).collect()
    skip = TITLES | ORGANISATION_WORDS | {"mobile", "work", "the", "and", "home", "new"}
    given = {r["token"] for r in rows if r["given"] and r["given"] >= r["family"]} - skip
    family = {r["token"] for r in rows if r["family"] > r["given"]} - skip
    aliases = {r["token"]: r["alias"] for r in rows if r["alias"] and len(r["token"]) > 2 and r["token"].isalpha()}
    known = given | family | {w for w, n in aliases.items() if n > 1} | set(SHORT_NAMES)
    near = {x for w in known for x in _shorter(w)}
    short = {w for w, n in aliases.items() if n > 1 or not _is_slip(w, known, near)} | {w for name, ws in SHORT_NAMES.items() for w in (name, *ws.split())}
    short = short - given - family - skip
    return frozenset(given), frozenset(family), frozenset(short)
