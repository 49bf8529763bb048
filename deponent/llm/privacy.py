"""Personal data in free text, found by anchors and replaced by typed placeholders (problem 5).

One automaton (Aho-Corasick) finds the anchors of every type in one pass: at-signs and their disguises, schemes, cues of
identity numbers, accounts and telephones, street and unit words, number words, digits, name tokens, and words that introduce
a name. No pattern scans the text: from each anchor a local parser expands to the boundaries of an address, number or name
and checks it (account and card numbers by their check digits). Names come from the parties of all cases and from the words
that introduce a name: after them one to three words with a capital that are neither common words nor an organisation are a
name, whether or not anyone knows it.

Types are email, phone, id_number, address, name, and account (numbers of bank accounts and cards).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.llm.names import ORGANISATION_WORDS, TITLES, lexicon, skeleton

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]", "account": "[ACCOUNT]"}

# Cues of identity numbers, street words, number words, and words that introduce a name.
ID_CUES = (
    "passport", "driver's licence", "drivers licence", "driver's license", "driving licence", "licence", "license", "national id", "identity card", "id card", "id number", "id no", "tax number", "tax id", "tin", "tax no",
    "insurance number", "national insurance", "insurance no", "social security", "ssn", "sss", "umid", "philhealth", "nino", "ni number", "ni no", "dni", "nie", "nif", "curp", "pasaporte", "licencia", "reisepass", "personalausweis",
    "führerschein", "steuer-id", "steuernummer", "sozialversicherungsnummer", "aadhaar", "pan number", "emirates id", "medicare number", "tfn",
)
STREET_WORDS = "street st avenue ave road rd lane ln drive dr close row rise court ct way place pl terrace crescent boulevard blvd highway square walk gardens mews parade grove hill".split()
STRONG_STREETS = frozenset("street avenue road lane crescent boulevard terrace highway".split())
UNIT_WORDS = "unit flat apt apartment suite room rm blk block".split()
STREET_LEADS = "calle avenida paseo plaza camino carrera rua via rue".split()
STREET_ENDS = ("straße", "strasse", "weg", "platz", "gasse", "allee", "str.")
STREET_PLACES = (" am ", " im ", " an der ", " auf der ")
NUMBER_WORDS = "zero oh one two three four five six seven eight nine double triple null eins zwei drei vier fünf sechs sieben acht neun cero uno dos tres cuatro cinco seis siete ocho nueve".split()
PHONE_CUES = "call text phone mobile tel telephone whatsapp viber reach ring cell fax contact dial sms".split()
ACCOUNT_CUES = ("account number", "account no", "acct number", "acct no", "a/c no", "iban", "card number", "card no", "credit card", "debit card", "kontonummer", "numero de cuenta", "número de cuenta")
SCHEMES = ("http://", "https://", "www.", "ftp://", "mailto:", "tel:", "sms:")
# Words that stand between a street's number and its name in no address written small.
NO_STREET = frozenset("the of a an on to in at down up along this that these my our his her their your its per and or for from with by minutes minute hours hour days day weeks months years people persons calls times messages more other each every next same one two way".split())
NAME_CUES = (
    "look for", "ask for", "receiver is", "tell", "contact person", "addressed to", "the identity of", "the number of", "i'm", "i am", "this is", "my name is", "for the record,", "full name:", "name:", "dear", "hello", "hi",
    "good day", "from:", "to:", "from", "sender", "the agent called", "did", "regards,", "sincerely,", "thank you,", "thanks,", "best,", "attn:", "remembers that", "mr.", "ms.", "mrs.", "atty.", "sir", "care of", "c/o", " -",
)
# Cues by how they introduce an unknown name: one word will do; two are needed; nothing else may stand in the line; a header's end must follow; one word will do if small letters follow; a comma ends the greeting.
# Words after a name that begins a sentence; a name before a verb has two words, or an initial and one.
AFTER_CUES = (", please", " said ", " visited ", " lives ", " wrote ", " gave ", " wants ", " really ", " phoned ")
HEADER_CUES = frozenset(("from:", "sender", "to:"))
SINGLE_CUES = frozenset(("tell", "did", "the identity of", "the number of", "the agent called", "remembers that", "for the record,"))
GREETINGS = frozenset(("dear", "hello", "hi", "good day"))
OPENING_CUES = frozenset(("dear", "hello", "hi", "good day", "my name is", "addressed to", "full name:", "name:", "contact person", "look for", "ask for", "receiver is", "attn:", "care of", "c/o", "mr.", "ms.", "mrs.", "atty."))
NARROW_CUES = frozenset(("this is", "i am", "i'm", "did", "tell", "the identity of", "the number of", "the agent called", "remembers that", "for the record,"))
CLOSING_CUES = frozenset(("regards,", "sincerely,", "thank you,", "thanks,", "best,"))
# Words with a capital that are no names.
COMMON_WORDS = frozenset(
    "i it this that these those here there yes no not ok okay please thanks thank kindly good great sorry sure just my your our their his her its who what where why how which all everyone everybody team friend friends customer customers client "
    "clients user users member members subscriber valued esteemed colleague colleagues guys folks love darling honey babe po opo ate kuya tita tito ma'am maam mam boss day morning afternoon evening night again also only any some one two first second "
    "last new next monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december viber messenger whatsapp facebook gmail telegram skype "
    "page pg seite pahina página confidential printout print transcript annex file case report statement draft copy exhibit appendix volume vol circulation subject date sent cc re fwd attached urgent important dispute account accounts "
    "payment refund transfer order number code street road avenue city filipino english spanish german american british usd php eur gbp".split()
)
_SMALL_NAME = re.compile(r"[a-zà-ÿ][\w'’-]+ [a-zà-ÿ][\w'’-]+(?=\s*<)")
_NAME_SHAPE = re.compile(r"[^\W\d_a-z][^\W\d_]+(?:['’-][^\W\d_]+)*")

_STREET = re.compile(
    r"(?:(?:Unit|Flat|Apt\.?|Apartment|Suite|Room|Rm\.?|UNIT|FLAT)\s+(?:[A-Z]{0,2}-?\d{1,4}[A-Z]?|[A-Z])\s*,\s*(?:[A-Z][\w'’-]+\s+){0,3}?(?:(?:Tower|Towers|Building|Bldg\.?|House|Mansions?|Residences?|Condominium)\s*,\s*)?)?"
    r"(?:No\.?\s*|NO\.?\s*|#\s?)?\d{1,5}(?:\s?[-/]\s?\d{1,4})?[A-Za-z]?,?\s+(?:(?:[A-Z][\w'’.-]*|de|del|la|of|the)\s+){0,4}?[A-Z][\w'’-]*\s+(?:" + "|".join(w.title() for w in STREET_WORDS) + "|" + "|".join(w.upper() for w in STREET_WORDS) + r")\b(?:(?<=\bSt)\.|(?<=\bAve)\.|(?<=\bRd)\.|(?<=\bLn)\.|(?<=\bDr)\.|(?<=\bCt)\.|(?<=\bPl)\.|(?<=\bBlvd)\.)?"
)
_BLOCK = re.compile(r"(?:Blk\.?|Block|BLK|BLOCK)\s*\d{1,4}\w?\s*,?\s*(?:Lot|LOT)\s*\d{1,4}\w?(?:\s*,?\s*(?:[A-Z][\w'’-]+\s+){0,3}[A-Z][\w'’-]+)?")
_CALLE = re.compile(r"\b(?:" + "|".join(w.title() for w in STREET_LEADS) + "|" + "|".join(w.upper() for w in STREET_LEADS) + r")\s+(?:(?:de|del|la|las|los|el|des)\s+)*(?:[A-Z][\w'’-]*\s+){1,3}?(?:No\.?\s*)?\d{1,4}\b")
_STRASSE = re.compile(r"\b(?:[A-ZÄÖÜ][\w-]*(?:straße|strasse|weg|platz|gasse|allee|str\.)|(?:[A-ZÄÖÜ][\w-]+[ -])?(?:Straße|Strasse|Weg|Platz|Gasse|Allee)|(?:Am|An der|Auf der|Im)\s+[A-ZÄÖÜ][\w-]+)\s+\d{1,4}\s?[a-z]?\b")

_AT, _DOT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s?@\s?)", r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s?\.(?:\s(?=(?-i:[a-z]))|(?=[A-Za-z])))"
_AT_SIGN = re.compile(_AT, re.I)
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[\w\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z][\w\-]*)+", re.A | re.I)
_SPELLED_DOT = re.compile(r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)$", re.I)
_URL = re.compile(r"[^\s<>\"“”]+")
_ID_LINK = re.compile(r"(?:'s)?(?:\s*(?:card|document))?\s*(?:no\.?|nos\.?|number|num\.?|nr\.?|id|#|№)?\s*(?:is|was|:|=|-|–|#)?\s*", re.I)
_ID_VALUE = re.compile(r"(?=(?:[^\s\d]{0,5}\s?)?\d)(?:[A-Z]{1,4}[\s\-]?)?[A-Z]?\d[\dA-Z]*(?:[\s\-/.]?(?:[A-Z]\b|[A-Z]{0,2}\d[\dA-Z]*))*", 0)
_ID_ALONE = re.compile(r"(?<![\w#/.-])(?:\d{3}-\d{2}-\d{4}|\d{3}-\d{3}-\d{3}-\d{3}|[A-CEGHJ-PR-TW-Z]{2}\s\d{2}\s\d{2}\s\d{2}\s[A-D]|[A-Z]\d{2}-\d{2}-\d{6})(?![\w-]|\.\d)")
_NOT_PII = re.compile(r"(?:\bref(?:erence)?|\border|\bticket|\btracking|\bcode|\bcase|\btrx|\binvoice|\breceipt|\bnumber(?= #)|\bno\. of|\bfile|\bvol\.?|\bpage|[#$£€₱]|\b(?:usd|php|eur|gbp))[\s.:#-]*$", re.I)
_PHONE = re.compile(
    r"(?<![\w#/.,+-])(?:"
    r"\+\s?\d{1,3}(?:[\s.\-]?\(\s?\d{1,4}\s?\))?(?:[\s.\-]?\d{1,5}){1,6}"
    r"|00\d{1,3}(?:[\s.\-]?\d{2,5}){2,5}"
    r"|\(\s?\+?\d{1,4}\s?\)[\s.\-]?\d{3,4}[\s.\-]?\d{3,4}(?:[\s.\-]\d{2,4})?"
    r"|0\d{3,4}[\s.\-]?\d{3}[\s.\-]?\d{2,4}(?:[\s.\-]?\d{2})?"
    r"|\d{3}[\s.\-]\d{3}[\s.\-]\d{4}"
    r"|\d{3}[\s.\-]\d{4}(?=\s*(?:ext|x)\b\.?\s*\d)"
    r")(?:\s*(?:ext|x)\.?\s*\d{1,5})?(?![\w]|-\d|[.,]\d)"
)
_LOCAL_PHONE = re.compile(r"(?<![\w#/.,+-])\d{3}[\s\-]\d{4}(?![\w]|-\d|[.,]\d)")
_BARE_PHONE = re.compile(r"(?<![\w#/.,+-])\d{6,11}(?![\w]|-\d|[.,]\d)")
_CALLED = re.compile(r"[a-z]*(?:\s+(?:me|us|him|her|them|my|our|his|the|your|their|at|on|to|no\.?|number|num\.?|nr\.?|is|was|line|phone|mobile|now|via|or|new|this|up)|\s*[:=.(-])*\s*", re.I)
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w#/.,+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w]|-\d|[.,]\d)")
_ACCOUNT = re.compile(r"(?:[A-Z]{2}(?=\d))?\d(?:[ -]?[\dA-Z]){5,33}(?![\w])")
_LEAD_SIGN = re.compile(r"(?:\(\s?\+?\s?|\+\s?)$")
_LEAD_NUMBER = re.compile(r"(?:\b(?:No|NO|no)\.?\s*|#\s?)$")
_SMALL_STREET = re.compile(r"\d{1,5}[a-z]?,?\s+((?:[a-zà-ÿ][a-zà-ÿ'’-]*\s+){1,3})")
_WORD_PHONE = re.compile(r"\b(?:(?:plus|" + "|".join(NUMBER_WORDS) + r")[\s,\-]+){6,}(?:" + "|".join(NUMBER_WORDS) + r")\b", re.I)
_BREAK = re.compile(r"(?<=\w)[-‐‑­¬][ \t]*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_](?:[^\s,;:<>\"“”()/]*[^\W_])?", re.U)
_JOINER = re.compile(r"[ \t]*\n?[ \t]*")


def joined(text: str) -> tuple[str, list[int] | None]:
    """The text with words broken at line ends put together, and the place of each of its characters in the original."""
    if "\n" not in text or not _BREAK.search(text):
        return text, None
    parts, places, last = [], [], 0
    for m in _BREAK.finditer(text):
        parts.append(text[last : m.start()])
        places += range(last, m.start())
        last = m.end()
    parts.append(text[last:])
    places += range(last, len(text) + 1)
    return "".join(parts), places


_NO_NAME = TITLES | ORGANISATION_WORDS | {w.strip(".,:") for c in NAME_CUES for w in c.split()} | frozenset("the and or but when as if in on at by with both neither nor after before while then name she he they we you".split())
_FLAT = str.maketrans({c: " " for c in "\n\t\u00a0\u202f"})


def _luhn(number: str) -> bool:
    """Whether the last digit of a card number fits the others."""
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def _iban_fits(number: str) -> bool:
    """Whether the check digits of an international account number fit the rest."""
    return 15 <= len(number) <= 34 and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


class Finder:
    """Finds personal data in one text after another; made once for each task."""

    def __init__(self, given: frozenset, family: frozenset, short: frozenset):
        self.given, self.family, self.short = given, family, short
        self.kinds: dict[str, str] = {}
        self.shapes = {skeleton(w): w for w in given | family if len(w) > 4}
        auto = ahocorasick.Automaton()
        for kind, keys in (
            ("email", ("@", " at ", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", "{ at }", "< at >")), ("scheme", SCHEMES), ("id", ID_CUES), ("account", ACCOUNT_CUES), ("call", PHONE_CUES), ("number", ("plus", *NUMBER_WORDS)),
            ("digit", "0123456789"), ("street", [" " + w for w in STREET_WORDS]), ("unit", UNIT_WORDS), ("lead", STREET_LEADS), ("end", STREET_ENDS), ("place", STREET_PLACES), ("cue", NAME_CUES), ("after", AFTER_CUES),
        ):
            for key in keys:
                self._anchor(auto, key, kind)
        for key in given | family | short:
            self._anchor(auto, key, "name")
        auto.make_automaton()
        self.anchors = auto

    @staticmethod
    def _anchor(auto: ahocorasick.Automaton, key: str, kind: str) -> None:
        """Adds a key; one that is an anchor of several types keeps them all."""
        before = auto.get(key, None)
        if before is None or kind not in before[0]:
            auto.add_word(key, ((*(before[0] if before else ()), kind), len(key)))

    def find(self, message: str) -> list[tuple[str, int, int]]:
        """(type, start, end) of each occurrence, in order; positions count characters from 0."""
        text, places = joined(message)
        flat = text.translate(_FLAT)
        low = flat.lower()
        if len(low) != len(flat):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in flat)
        hits: dict[str, list[tuple[int, int]]] = {}
        runs: list[int] = []
        last = -2
        for end, (kinds, size) in self.anchors.iter(low):
            if size == 1 and kinds[0] == "digit":
                if end != last + 1:
                    runs.append(end)  # where a run of digits begins
                last = end
                continue
            for kind in kinds:
                hits.setdefault(kind, []).append((end + 1 - size, end + 1))
        taken: list[tuple[str, int, int]] = []
        covered = bytearray(len(text) + 1)

        def take(kind: str, start: int, end: int) -> None:
            if start < end and not any(covered[start:end]):
                if kind:
                    taken.append((kind, start, end))
                covered[start:end] = b"\1" * (end - start)

        for at in hits.get("email", ()):
            self._email(flat, at, take)
        for at in hits.get("scheme", ()):
            self._scheme(flat, low, at, take)
        if runs:
            for at in hits.get("id", ()):
                self._identity(flat, low, at, take)
            self._accounts(flat, low, hits.get("account", ()), runs, covered, take)
            self._addresses(flat, low, hits, runs, covered, take)
            self._phones(flat, low, hits.get("call", ()), runs, covered, take)
            self._standing_ids(flat, runs, covered, take)
        if "number" in hits:
            done = 0
            for lo, hi in hits["number"]:
                if lo >= done and not (lo and low[lo - 1].isalnum()) and (m := _WORD_PHONE.match(flat, lo)):
                    take("phone", lo, m.end())
                    done = m.end()
        if "name" in hits or "cue" in hits or "after" in hits:
            self._names(text, low, hits, take)
        if places is not None:
            taken = [(k, places[s], places[e - 1] + 1) for k, s, e in taken]
        return sorted(taken, key=lambda x: x[1])

    @staticmethod
    def _email(flat: str, at: tuple[int, int], take) -> None:
        """From an at-sign or its disguise to the left over the mailbox, to the right over the domain."""
        lo = at[0]
        while lo and flat[lo - 1] == " ":
            lo -= 1
        if flat[at[0]] == " ":
            lo = at[0]
        sign = _AT_SIGN.match(flat, max(0, at[0] - 1) if flat[at[0] - 1 : at[0]] == " " and flat[at[0]] != " " else at[0])
        if sign is None or sign.end() < at[1] or not (domain := _DOMAIN.match(flat, sign.end())):
            return
        plain = "@" in sign[0]
        if not plain and not re.search(r"dot|[\[({<]", sign[0] + domain[0], re.I):
            return  # a disguised address must spell out its dot
        left = lo = sign.start()
        while True:
            while lo and flat[lo - 1].isascii() and (flat[lo - 1].isalnum() or flat[lo - 1] in "._+-"):
                lo -= 1
            spelled = _SPELLED_DOT.search(flat, max(0, lo - 12), lo) if lo < left or plain is False else None
            if spelled is None or plain or not flat[spelled.start() - 1 : spelled.start()].isalnum():
                break
            lo = spelled.start()
        while lo < left and not flat[lo].isalnum():
            lo += 1
        if lo < left and (flat[left - 1].isalnum() or flat[left - 1] in "_+"):
            take("email", lo, domain.end())

    @staticmethod
    def _scheme(flat: str, low: str, at: tuple[int, int], take) -> None:
        """The rest of a web address is no other data; what follows mailto, tel or sms is read by its own anchors."""
        if low[at[0] : at[1]] not in ("mailto:", "tel:", "sms:") and (m := _URL.match(flat, at[0])):
            take("", at[0], m.end())

    def _identity(self, flat: str, low: str, at: tuple[int, int], take) -> None:
        if at[0] and low[at[0] - 1].isalnum() or at[1] < len(low) and low[at[1]].isalpha():
            return
        link = _ID_LINK.match(flat, at[1])
        start = link.end() if link else at[1]
        m = _ID_ALONE.match(flat, start) or _ID_VALUE.match(flat, start)
        if m and sum(c.isdigit() for c in m[0]) >= 5:
            take("id_number", m.start(), m.end())

    @staticmethod
    def _accounts(flat: str, low: str, cues, runs: list[int], covered: bytearray, take) -> None:
        """Account numbers after their cues, and account and card numbers whose check digits are right."""
        for lo, hi in cues:
            if not (lo and low[lo - 1].isalnum()):
                link = _ID_LINK.match(flat, hi)
                if m := _IBAN.match(flat, link.end()) or _ACCOUNT.match(flat, link.end()):
                    take("account", m.start(), m.end())
        for p in runs:
            if covered[p]:
                continue
            if p >= 2 and flat[p - 2 : p].isupper() and flat[p - 2 : p].isalpha() and (m := _IBAN.match(flat, p - 2)):
                parts = m[0].split(" ")
                while parts and not _iban_fits("".join(parts)):
                    parts.pop()
                # One that fits no check digits is no account, but no telephone number either.
                take("account" if parts else "", m.start(), m.start() + len(" ".join(parts)) if parts else m.end())
            elif (m := _CARD.match(flat, p)) and _luhn(m[0]) and not _NOT_PII.search(flat, max(0, p - 16), p):
                take("account", m.start(), m.end())

    @staticmethod
    def _addresses(flat: str, low: str, hits: dict, runs: list[int], covered: bytearray, take) -> None:
        """Street addresses from unit words, street words and the numbers of houses."""
        streets = hits.get("street", ())
        for lo, hi in hits.get("unit", ()):
            if not (lo and low[lo - 1].isalnum()) and (m := _BLOCK.match(flat, lo) or (_STREET.match(flat, lo) if streets else None)):
                take("address", m.start(), m.end())
        if streets:
            for p in runs:
                if not covered[p]:
                    lead = _LEAD_NUMBER.search(flat, max(0, p - 8), p)
                    if m := _STREET.match(flat, lead.start() if lead else p):
                        take("address", m.start(), m.end())
            k = 0
            for lo, hi in streets:  # written small: a number, one to three words, a street word that is nothing else
                while k + 1 < len(runs) and runs[k + 1] < lo:
                    k += 1
                if low[lo + 1 : hi] in STRONG_STREETS and not low[hi : hi + 1].isalnum() and runs[k] < lo and not covered[runs[k]] and not (runs[k] and low[runs[k] - 1].isalnum()):
                    m = _SMALL_STREET.fullmatch(low, runs[k], lo + 1)
                    if m and NO_STREET.isdisjoint(m[1].split()):
                        lead = _LEAD_NUMBER.search(flat, max(0, runs[k] - 8), runs[k])
                        take("address", lead.start() if lead else runs[k], hi)
        for lo, hi in hits.get("lead", ()):
            if not (lo and low[lo - 1].isalnum()) and (m := _CALLE.match(flat, lo)):
                take("address", m.start(), m.end())
        for lo, hi in hits.get("end", ()):
            word = lo
            while word and (flat[word - 1].isalnum() or flat[word - 1] in "-_"):
                word -= 1
            before = word
            if word == lo and word and flat[word - 1] in " -":  # the street word stands alone: the word before belongs to it
                before = word - 1
                while before and (flat[before - 1].isalnum() or flat[before - 1] in "-_"):
                    before -= 1
            if m := (_STRASSE.match(flat, before) if before < word else None) or _STRASSE.match(flat, word):
                take("address", m.start(), m.end())
        for lo, hi in hits.get("place", ()):
            if m := _STRASSE.match(flat, lo + 1):
                take("address", m.start(), m.end())

    @staticmethod
    def _phones(flat: str, low: str, cues, runs: list[int], covered: bytearray, take) -> None:
        """Telephone numbers from where digits begin; short ones only after a word that tells of a call."""
        k, cue = 0, None
        for p in runs:
            while k < len(cues) and cues[k][1] <= p:
                if not (cues[k][0] and low[cues[k][0] - 1].isalnum()):
                    cue = cues[k]
                k += 1
            if covered[p]:
                continue
            lead = _LEAD_SIGN.search(flat, max(0, p - 4), p)
            plus = flat.rfind("+", lead.start(), p) if lead else -1
            m = (_PHONE.match(flat, lead.start()) if lead else None) or (_PHONE.match(flat, plus) if plus >= 0 else None) or _PHONE.match(flat, p)
            if m and 7 <= sum(c.isdigit() for c in m[0]) <= 17:
                if not _NOT_PII.search(flat, max(0, m.start() - 16), m.start()):
                    take("phone", m.start(), m.end())
                continue
            if cue is None:
                continue
            between = low[cue[1] : p]
            if (m := _LOCAL_PHONE.match(flat, p)) and between.count(" ") <= 6 and not re.search(r"[!?]|[a-z]{4}\. ", between):
                if not _NOT_PII.search(flat, max(0, p - 16), p):
                    take("phone", m.start(), m.end())
            elif (m := _BARE_PHONE.match(flat, p)) and _CALLED.fullmatch(between) and not _NOT_PII.search(flat, max(0, p - 16), p):
                take("phone", m.start(), m.end())

    @staticmethod
    def _standing_ids(flat: str, runs: list[int], covered: bytearray, take) -> None:
        """Identity numbers known by their form alone."""
        for p in runs:
            if not covered[p]:
                for start in (p - 3, p - 1, p):
                    if start >= 0 and (m := _ID_ALONE.match(flat, start)) and m.end() > p:
                        if not _NOT_PII.search(flat, max(0, start - 16), start):
                            take("id_number", m.start(), m.end())
                        break

    def _kind(self, word: str) -> str:
        """The kind of a word; each word is judged once."""
        if (got := self.kinds.get(word)) is None:
            if len(self.kinds) > 500_000:
                self.kinds.clear()
            got = self.kinds[word] = self._judged(word)
        return got

    def _judged(self, word: str) -> str:
        """given, family, short, initial or nothing; a word with misread characters counts as the name it looks like."""
        bare = word.lower().rstrip(".")
        if bare.endswith(("'s", "’s")):
            bare = bare[:-2]
        if bare in self.given:
            return "given"
        if bare in self.family:
            return "family"
        if len(bare) == 1 and bare.isalpha() and word[0].isupper():
            return "initial"
        if bare in self.short and word[0].isupper():
            return "short"
        if len(bare) > 4 and (known := self.shapes.get(skeleton(bare))) is not None:
            return "given" if known in self.given else "family"
        if "-" in bare:
            parts = [self._kind(x) for x in word.split("-") if x]
            return parts[0] if parts and all(parts) else ""
        return ""

    def _names(self, text: str, low: str, hits: dict, take) -> None:
        starts: set[int] = set()
        for lo, hi in hits.get("name", ()):
            if lo and low[lo - 1].isalnum():
                continue
            starts.add(lo)
        cued: set[int] = set()
        opened: dict[int, str] = {}
        for lo, hi in hits.get("cue", ()):
            if lo and low[lo - 1].isalnum():
                continue
            gap = _JOINER.match(text, hi)
            if hi < len(low) and low[hi].isalnum():
                continue
            cued.add(gap.end())
            if low[lo:hi] in OPENING_CUES or low[lo:hi] == " -" or low[lo:hi] in NARROW_CUES or low[lo:hi] in CLOSING_CUES or low[lo:hi] in HEADER_CUES:
                opened[gap.end()] = text[lo:hi]
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        later: list[tuple[str, int, int]] = []
        for lo, hi in hits.get("after", ()):
            self._before(text, words, lo, low[lo:hi], lambda *x: later.append(x))
        k = 0
        while k < len(words):
            lo, hi, w = words[k]
            kind = self._kind(w) if (lo in starts or w[0].isupper() or lo in cued) else ""
            if lo in opened and kind == "initial" and k + 1 < len(words) and not self._kind(words[k + 1][2]):
                kind = ""  # an initial before a word nobody knows
            if not kind or w.lower() in TITLES:
                if lo in opened and w.lower() in TITLES and k + 1 < len(words) and re.fullmatch(r"\.? ", text[hi : words[k + 1][0]]):
                    opened.setdefault(words[k + 1][0], opened[lo])  # the cue leads on over a title
                if lo in opened and not kind and (n := self._stranger(text, words, k, opened[lo])):
                    end = words[k + n - 1][1]
                    take("name", lo, end - (2 if text[lo:end].endswith(("'s", "’s")) else 0))
                    k += n
                else:
                    k += 1
                continue
            group, kinds = [k], [kind]
            j = k + 1
            while j < len(words) and len(group) < 4:
                between = text[words[group[-1]][1] : words[j][0]]
                nxt = self._kind(words[j][2])
                glue = between.replace("\n", " ")
                if nxt == "" or words[j][2].lower() in TITLES:
                    break
                if nxt == "initial" and words[j][2] == "I" and text[words[j][1] : words[j][1] + 1] != ".":
                    break
                if "family" in kinds and len(kinds) > 1:
                    break
                if re.fullmatch(r" {1,3}|\. ?| \. ?", glue):
                    if kinds[-1] == "family" and (nxt in ("given", "family", "short") or "." in glue):
                        break
                    if kinds[-1] in ("given", "short") and nxt in ("given", "short") and "\n" in between:
                        break
                elif re.fullmatch(r", {1,2}", glue) and kinds == ["family"] and nxt in ("given", "short", "initial"):
                    pass
                else:
                    break
                group.append(j)
                kinds.append(nxt)
                j += 1
            real = [x for x in kinds if x != "initial"]
            good = "given" in kinds or "family" in kinds or ("short" in kinds and self._introduced(text, low, words, k, lo in cued))
            if real and kinds[-1] == "initial" and len(kinds) > 1 and "given" not in kinds and "short" not in kinds and kinds[0] != "family":
                good = False
            if good and real and "family" in kinds and len(kinds) == 1 and self._organisation(text, words, k):
                good = False
            if good and real:
                if kinds == ["family"] and k and self._leads(text, words, k):
                    group.insert(0, k - 1)  # an unknown given name or short form before a known family name
                elif lo in opened and "family" not in kinds and len(group) < 3:  # an unknown family name after an introduced given name
                    last = group[-1]
                    glue = text[words[last][1] : words[last + 1][0]] if last + 1 < len(words) else ""
                    if glue == " " or glue == ". " and kinds[-1] == "initial":
                        group += range(last + 1, last + 1 + min(3 - len(group), self._capitals(text, words, last + 1, opened[lo].isupper())))
                end = words[group[-1]][1]
                take("name", words[group[0]][0], end - (2 if text[words[group[0]][0] : end].endswith(("'s", "’s")) else 0))
                k = group[-1] + 1
            else:
                k += 1
        for found in later:  # what the cues before and the known names have left
            take(*found)

    def _before(self, text: str, words: list, at: int, cue: str, take) -> None:
        """A name that begins a sentence and ends where words stand that follow a name."""
        k = bisect_left(words, at, key=lambda w: w[1])
        if k == len(words) or words[k][1] != at:
            return
        lo = k
        while lo and words[lo - 1][2][0].isupper() and re.fullmatch(r" |\n|\. ", text[words[lo - 1][1] : words[lo][0]]) and ("." not in text[words[lo - 1][1] : words[lo][0]] or len(words[lo - 1][2]) == 1):
            lo -= 1
        if not words[lo][2][0].isupper() or k - lo > 2 or k == lo and cue != ", please":
            return
        if not re.search(r"(?:^|\n|[.!?…/]\s|[-–—]\s)\s*$", text[max(0, words[lo][0] - 4) : words[lo][0]]):
            return
        if self._capitals(text, words, lo, False) == k - lo + 1:
            take("name", words[lo][0], at)

    def _stranger(self, text: str, words: list, k: int, cue: str) -> int:
        """How many words from the k-th on are the name of somebody unknown whom the cue before them introduces."""
        low = cue.lower()
        if low in HEADER_CUES and _SMALL_NAME.match(text, words[k][0]):
            return 2
        n = self._capitals(text, words, k, cue.isupper(), low not in GREETINGS)
        if not n:
            return 0
        first, end = words[k][0], words[k + n - 1][1]
        line = text[end : (text.find("\n", end) + 1 or len(text) + 1) - 1]
        if low in NARROW_CUES and n < 2:
            if low not in SINGLE_CUES or not re.match(r"(?:['’]s)?(?: [a-z]| I |[.!?]?$)", line):
                return 0
        if low == " -" and (n > 2 or not re.match(r"\s*(?:[.,!?…]|$)", line) or text[: words[k][0]].rstrip(" -")[-1:] in ("", "\n")):
            return 0  # a dash before a signature ends a line of text
        if low in HEADER_CUES and line.strip(" ") and not line.lstrip().startswith(("<", "/")):
            return 0
        if low in CLOSING_CUES:
            before = text[text.rfind("\n", 0, first) + 1 : first].strip().lower()
            if line.strip(" .,-–—~") or before and before != low:
                return 0
        return n

    def _capitals(self, text: str, words: list, k: int, loud: bool, reverse: bool = False) -> int:
        """Words from the k-th on, three and initials among them at most, that may be a name by their form; 0 if they go on to an organisation.

        With ``reverse`` a comma may part the family name from the given name. Words in capitals throughout are a name only where all is (``loud``), or two at once.
        """
        n = plain = shouted = 0
        open_ = True
        for j in range(k, min(k + 6, len(words))):
            w = words[j][2]
            bare = w[:-2] if w.endswith(("'s", "’s")) else w
            glue = " " if j == k else text[words[j - 1][1] : words[j][0]]
            lone = j > k and len(words[j - 1][2].rstrip(".")) == 1
            turned = reverse and glue == ", " and n == plain == 1 and j == k + 1
            if not w[0].isupper() or not (glue in (" ", "\n") or glue == ". " and lone or turned):
                break
            if bare.lower() in ORGANISATION_WORDS:
                return 0
            if not open_ or plain == 3:
                continue
            initial = len(bare.rstrip(".")) == 1 and bare.rstrip(".") != "I"
            if bare.lower() in COMMON_WORDS or bare.lower() in _NO_NAME or not initial and not _NAME_SHAPE.fullmatch(bare):
                open_ = False
                continue
            if not initial:
                shouted += bare.isupper() and not loud
                n, plain = j - k + 1, plain + 1
            open_ = bare == w and not turned and not (plain > 1 and self._kind(w) == "family")
        return n if not shouted or shouted == plain >= 2 else 0

    @staticmethod
    def _leads(text: str, words: list, k: int) -> bool:
        lo, hi, w = words[k - 1]
        return w[0].isupper() and w.isalpha() and len(w) > 1 and w.lower() not in _NO_NAME and re.fullmatch(r" |\n", text[hi : words[k][0]]) is not None

    @staticmethod
    def _introduced(text: str, low: str, words: list, k: int, cued: bool) -> bool:
        """Whether a short form, which may be an ordinary word, stands where a name stands."""
        lo, hi, w = words[k]
        if cued:
            return True
        after, before = low[hi : hi + 24], low[max(0, lo - 24) : lo]
        if re.match(r",? please answer|\s+(?:said|called|really|wants|told|sent|asked)\b", after) and (not before.strip() or not before.rstrip()[-1:].isalpha()):
            return True
        line = text[text.rfind("\n", 0, lo) + 1 : (text.find("\n", hi) + 1 or len(text) + 1) - 1].strip()
        return line.strip("-–—~., ") == w or re.search(r"(?:\btell|\bfor|\bis|\bto|\bcalled|\bof|[-–—])\s+$", before) is not None

    @staticmethod
    def _organisation(text: str, words: list, k: int) -> bool:
        return any(words[j][2].lower() in ORGANISATION_WORDS for j in range(k + 1, min(k + 3, len(words))) if "\n" not in text[words[k][1] : words[j][0]])


def _batches(shared, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*shared.value)
        for batch in batches:
            ids, kinds, starts, ends, texts, counts = [], [], [], [], [], []
            for row, message in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = finder.find(message) if message else []
                if redact:
                    out, last = [], 0
                    for kind, start, end in found:
                        out += [message[last:start], PLACEHOLDERS[kind]]
                        last = end
                    ids.append(row)
                    texts.append(None if message is None else "".join([*out, message[last:]]))
                    counts.append(len(found))
                    continue
                for kind, start, end in found:
                    ids.append(row)
                    kinds.append(kind)
                    starts.append(start + 1)
                    ends.append(end)
            if redact:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["row_id", "message", "n_replaced"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["row_id", "pii_type", "start_pos", "end_pos"])

    return run


def personal_data(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """Each occurrence: ``row_id``, ``pii_type`` (a key of PLACEHOLDERS), ``start_pos`` and ``end_pos`` (from 1, inclusive, in characters).

    Null and empty messages give no rows; every delivered row is searched by itself.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lexicon(participants))
    return rows.select(F.col("row_id").cast("long"), "message").mapInArrow(_batches(shared, False), "row_id long, pii_type string, start_pos int, end_pos int")


def redacted(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """Every row with its message in which personal data are replaced by placeholders: ``row_id``, ``message``, ``n_replaced``."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon(participants))
    return rows.select(F.col("row_id").cast("long"), "message").mapInArrow(_batches(shared, True), "row_id long, message string, n_replaced int")
