"""Spellings of names linked to the person or organisation they mean, within each case (problem 2).

Merge-and-rematch: every spelling starts as a profile, and so does every party of the case with its aliases. Profiles that
surely match are merged; a merged profile has the spellings, short forms and initials of both, enters the blocks of all of
them, and is matched again. Forms that leave something out (initials, given names, short names, acronyms) are merged only
with a profile that is the single best one. It ends when a whole pass merges nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.llm.names import ORGANISATION_WORDS, SHORT_NAMES, TITLES, TOKEN_SHARE, fold

# Abbreviations in names of organisations, and words that say nothing of which one it is.
ORGANISATION_SHORT = {"corp": "corporation", "intl": "international", "int'l": "international", "dept": "department", "mgmt": "management", "svcs": "services", "svc": "services", "assoc": "associates", "assocs": "associates", "inv": "investment", "co": "company", "mgt": "management", "dep": "department"}
_LEGAL = frozenset("inc incorporated ltd limited llc plc gmbh the official verified page company".split())
_NOBODY = re.compile(r"(?i)\s*(?:unknown(?: (?:sender|receiver|caller|number))?|n/?a|none|null|\?+|-+|me|you|(?:speaker|spkr|spk|s)[ _-]?\d+\s*:?|\[s\d+\])?\s*$")
_PLACES = frozenset("mobile work home cell office new old phone tel viber facebook messenger official personal private main".split())


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, a swap of neighbours counting as one; more than ``most`` is given as most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        now = [most + 1] * (len(b) + 1)
        if i <= most:
            now[0] = i
        for j in range(lo, hi + 1):
            y = b[j - 1]
            now[j] = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], two[j - 2] + 1)
        if min(now) > most:
            return most + 1
        two, last = last, now
    return last[-1]


def near(a: str, b: str) -> int | None:
    """Slips between two words that may be the same one, or None."""
    if a == b:
        return 0
    short = min(len(a), len(b))
    if short < 4 or short > 64:  # a "word" beyond that is no name
        return None
    d = distance(a, b, 2 if short >= 9 else 1)
    return d if d <= (2 if short >= 9 else 1) else None


class Spelling:
    """One spelling taken apart: words, initials, short names in brackets, and whether it names an organisation."""

    def __init__(self, text: str, given: frozenset, family: frozenset):
        self.text = text
        plain = fold(text).replace("’", "'")
        self.extra: list[str] = []
        body = text
        for m in re.findall(r"\(([^)]*)\)", text):
            self.extra += [w for w in re.findall(r"[^\W\d_]+", fold(m)) if w not in _PLACES]
        body = re.sub(r"\([^)]*\)", " ", body)
        body = re.sub(r"\s[-–—|]\s*(?:" + "|".join(_PLACES) + r")\b.*$", " ", body, flags=re.I)
        self.acronym = ""
        bare = body.strip()
        if re.fullmatch(r"(?:[A-Za-z]\.){2,5}[A-Za-z]?|[A-Z]{2,5}", bare) and fold(bare) not in given:
            self.acronym = re.sub(r"\W", "", fold(bare))
        body = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-zà-ÿ])", " ", body)
        self.comma = "," in body
        body = re.sub(r"(?<=[A-Za-z])0(?=[A-Za-z])|(?<=[a-z])0\b", "o", body)
        body = re.sub(r"(?<=[A-Za-z])1(?=[A-Za-z])", "l", body)
        body = re.sub(r"(?<=[A-Za-z])5(?=[A-Za-z])", "s", body)
        words = [w.strip("'") for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", fold(body).replace("’", "'"))]
        words = [w for w in words if w]
        expanded = [ORGANISATION_SHORT.get(w, w) for w in words]
        self.is_org = any(w in ORGANISATION_WORDS and w not in given and w not in family for w in expanded)
        if not self.is_org and len(words) > 1:
            self.is_org = any(len(w) >= 6 and w not in given and w not in family and any(near(w, o) == 1 for o in ORGANISATION_WORDS if len(o) >= 6) for w in expanded)
        if self.is_org:
            self.words = [w for w in expanded if w not in _LEGAL]
            self.initials: list[str] = []
        else:
            if not body.isupper():
                for pair in re.findall(r"(?<!\w)[A-Z]{2}(?=\s+\w{3})", body):  # two initials written together
                    if (low := fold(pair)) in words:
                        words[words.index(low) : words.index(low) + 1] = list(low)
            titled = [w for w in words if w not in TITLES and w not in ("ma'am", "maam", "ma", "sr", "jr", "atty", "am")]
            words = titled or words
            self.words = [w for w in words if len(w) > 1 and w not in _PLACES]
            self.initials = [w for w in words if len(w) == 1]
        self.plain = plain
        self.nobody = _NOBODY.fullmatch(text) is not None or not (self.words or self.acronym)


class Profile:
    """What is known of one person or organisation."""

    def __init__(self):
        self.spellings: list[Spelling] = []
        self.given: Counter = Counter()
        self.family: Counter = Counter()
        self.short: set[str] = set()
        self.initials: set[str] = set()  # first letters of given and family name that its spellings show, together
        self.sets: list[tuple[str, ...]] = []
        self.is_org = False
        self.party = False

    def absorb(self, other: Profile) -> None:
        self.spellings += other.spellings
        self.given += other.given
        self.family += other.family
        self.short |= other.short
        self.initials |= other.initials
        self.sets += [x for x in other.sets if x not in self.sets]
        self.is_org |= other.is_org
        self.party |= other.party

    def fullest(self) -> tuple[str, ...]:
        return max(self.sets, key=len, default=())


class Resolver:
    """Resolves the spellings of one case after another."""

    def __init__(self, given: frozenset, family: frozenset, short_of: dict[str, frozenset]):
        self.given, self.family = given, family
        self.short_of = short_of  # given name -> short forms
        self.long_of: dict[str, set[str]] = defaultdict(set)
        for g, shorts in short_of.items():
            for s in shorts:
                self.long_of[s].add(g)

    def same_given(self, a: str, b: str) -> float | None:
        """Cost at which two given names may be the same, or None."""
        if a == b:
            return 0.0
        if a in self.short_of.get(b, ()) or b in self.short_of.get(a, ()):
            return 0.2
        if self.long_of.get(a, set()) & self.long_of.get(b, set()):
            return 0.4
        if a in self.given and b in self.given or a in self.long_of and b in self.given or b in self.long_of and a in self.given:
            return None
        d = near(a, b)
        return None if d is None else d - 0.1 * (len(a) == len(b))

    def same_family(self, a: str, b: str) -> float | None:
        if a == b:
            return 0.0
        if a in self.family and b in self.family:
            return None
        d = near(a, b)
        return None if d is None else d - 0.1 * (len(a) == len(b))

    def role(self, w: str) -> str:
        if w in self.given or w in self.long_of:
            return "given"
        return "family" if w in self.family else ""

    def profile(self, s: Spelling) -> Profile:
        p = Profile()
        p.spellings, p.is_org = [s], s.is_org
        if s.is_org:
            p.sets = [tuple(s.words)]
            return p
        p.short |= set(s.extra)
        words = s.words
        if len(words) >= 2:
            first, last = (words[-1], words[0]) if s.comma else (words[0], words[-1])
            if s.comma and len(words) > 2:
                first, last = words[1], words[0]
            if not s.comma:
                r1, r2 = self.role(first), self.role(last)
                if r1 == "family" and r2 != "family" or r2 == "given" and r1 != "given":
                    first, last = last, first
                elif not r1 and not r2 and self._nearer(last, self.given) and not self._nearer(first, self.given):
                    first, last = last, first
            p.given[first] += 1
            p.family[last] += 1
            p.initials |= {x[0] + last[0] for x in (first, *self.long_of.get(first, ()), *self.short_of.get(first, ()))}
        elif len(words) == 1 and s.initials:
            p.initials |= {x + words[0][0] for x in s.initials} | {words[0][0] + x for x in s.initials}
        return p

    @staticmethod
    def _nearer(w: str, names: frozenset) -> bool:
        return any(near(w, n) is not None for n in names if n[:1] == w[:1] or n[-1:] == w[-1:])

    def fit(self, s: Spelling, p: Profile) -> tuple[int, float] | None:
        """How a spelling fits a profile: (strength, minus cost); strength 3 is sure, 2 and 1 leave something out."""
        if p.is_org:
            return self._fit_org(s, p)
        if s.is_org or s.acronym and not s.initials and len(s.words) == 0:
            return None
        best: tuple[int, float] | None = None

        def offer(strength: int, cost: float) -> None:
            nonlocal best
            if best is None or (strength, -cost) > best:
                best = (strength, -cost)

        words, initials = s.words, s.initials
        for g in p.given:
            for f in p.family:
                if len(words) >= 2:
                    for a, b in ((words[0], words[-1]), (words[-1], words[0]), *(((words[1], words[0]),) if s.comma else ())):
                        cg, cf = self.same_given(a, g), self.same_family(b, f)
                        if cg is not None and cf is not None and cg + cf <= 2.2:
                            offer(3, cg + cf)
                elif len(words) == 1:
                    w = words[0]
                    cg, cf = self.same_given(w, g), self.same_family(w, f)
                    if initials:
                        if cg is not None and f[0] in initials:
                            offer(2, cg)
                        if cf is not None and (g[0] in initials or any(x[0] in initials for x in self.short_of.get(g, ()))):
                            offer(2, cf + (0.0 if g[0] in initials else 0.5))
                    else:
                        joined = [(g + f, 0.0), (f + g, 0.0), *((n + f, 0.2) for n in self.short_of.get(g, ()))]
                        for whole, extra in joined:
                            if len(w) > len(f) + 2 and (d := near(w, whole)) is not None:
                                offer(3, d + extra)
                        if w == g[0] + f or w == f + g[0]:
                            offer(2, 0.3)
                        if w == g + f[0]:
                            offer(2, 0.4)
                        if cg is not None:
                            offer(1, cg)
                        elif w in p.short:
                            offer(1, 0.3)
                        if cf is not None:
                            offer(1, cf + 0.05)
        if len(words) >= 2 and best is None and p.short:
            for f in p.family:
                for a, b in ((words[0], words[-1]), (words[-1], words[0])):
                    if a in p.short and (cf := self.same_family(b, f)) is not None:
                        offer(3, 0.3 + cf)
        return best

    def _fit_org(self, s: Spelling, p: Profile) -> tuple[int, float] | None:
        best: tuple[int, float] | None = None
        for full in p.sets:
            if s.acronym and len(full) >= 2:
                short = "".join(w[0] for w in full)
                if s.acronym == short and len(short) >= 2:
                    best = max(best or (0, 0.0), (2, 0.0))
                continue
            if not s.words:
                continue
            words = s.words
            if len(words) == 1 and len(words[0]) > 9 and len(full) >= 2:
                for k in range(len(full), 1, -1):
                    if (d := near(words[0], "".join(full[:k]))) is not None:
                        best = max(best or (0, -9.0), (3 if k == len(full) else 2, -float(d)))
            cost, left = 0.0, list(full)
            for w in words:
                hits = [(d, x) for x in left if (d := near(w, x)) is not None]
                if not hits:
                    break
                d, x = min(hits)
                cost += d
                left.remove(x)
            else:
                if full and full[0] in left:
                    continue
                if cost <= 2:
                    best = max(best or (0, -9.0), (3 if not left else 2 if len(words) >= 2 else 1, -cost))
        return best

    def keys(self, p: Profile) -> set[str]:
        """Blocks a profile stands in: starts, ends and skeletons of its words, its initials, and its acronym."""
        out: set[str] = {"." + x for x in p.initials}
        for s in p.spellings:
            for w in [*s.words, *s.extra]:
                out |= {"<" + w[:3], ">" + w[-3:]}
                for g in (w, *self.long_of.get(w, ()), *self.short_of.get(w, ())):
                    out.add("=" + g)
                    out.add("<" + g[:3])
                if len(w) > 9:
                    out |= {"<" + w[k : k + 3] for k in range(2, len(w) - 3)}
            if s.acronym:
                out.add("@" + s.acronym)
        for full in p.sets:
            if len(full) >= 2:
                out.add("@" + "".join(w[0] for w in full))
        return out

    def resolve(self, names: list[str], parties: list[tuple[str, list[str]]]) -> list[list[str]]:
        """Groups of the ``names`` that mean the same; names that mean nobody are in none."""
        profiles: list[Profile | None] = []
        taken: dict[str, int] = {}
        for full, aliases in parties:
            s = Spelling(full, self.given, self.family)
            if s.nobody:
                continue
            p = self.profile(s)
            p.party = True
            for a in aliases:
                t = Spelling(a, self.given, self.family)
                if t.nobody:
                    continue
                p.spellings.append(t)
                if not p.is_org:
                    p.short |= {w for w in (*t.extra, *(t.words if len(t.words) == 1 and not t.initials else ())) if len(w) > 1 and w not in self.family}
            profiles.append(p)
            taken.setdefault(full, len(profiles) - 1)
        owners: dict[str, set[int]] = defaultdict(set)
        for k, p in enumerate(profiles):
            for s in p.spellings:
                owners[s.text].add(k)
        for name in names:
            s = Spelling(name, self.given, self.family)
            if s.nobody:
                continue
            if len(owners.get(name, ())) == 1:
                continue  # already among a single party's spellings
            profiles.append(self.profile(s))
        blocks: dict[str, set[int]] = defaultdict(set)
        for k, p in enumerate(profiles):
            for key in self.keys(p):
                blocks[key].add(k)
        for least in (3, 2, 1):
            merged = True
            while merged:
                merged = False
                order = sorted((k for k, p in enumerate(profiles) if p is not None), key=lambda k: (profiles[k].party, -len(profiles[k].spellings)))
                for k in order:
                    p = profiles[k]
                    if p is None or p.party and least < 3:
                        continue
                    around = set().union(*(blocks[key] for key in self.keys(p))) - {k}
                    scored = []
                    for j in around:
                        q = profiles[j]
                        if q is None or p.party and q.party:
                            continue
                        # A profile fits another by the fullest of its spellings.
                        fits = [f for s in p.spellings if (f := self.fit(s, q)) is not None and f[0] >= least]
                        if fits:
                            scored.append((max(fits), q.party, j))
                    if not scored:
                        continue
                    scored.sort(reverse=True)
                    top = scored[0]
                    rivals = [x for x in scored[1:] if x[0] == top[0] and not self._alike(profiles[x[2]], profiles[top[2]])]
                    if rivals and not (top[1] and not any(x[1] for x in rivals) and top[0][0] == 3):
                        continue
                    into, gone = (k, top[2]) if p.party else (top[2], k)  # a party takes in what its spellings fit
                    profiles[into].absorb(profiles[gone])
                    profiles[gone] = None
                    for key in self.keys(profiles[into]):
                        blocks[key].add(into)
                    merged = True
        wanted = set(names)
        return [sorted({s.text for s in p.spellings} & wanted) for p in profiles if p is not None and not all(s.nobody for s in p.spellings)]

    def _alike(self, a: Profile, b: Profile) -> bool:
        """Whether two profiles will surely be merged anyway."""
        return any((f := self.fit(s, b)) is not None and f[0] == 3 for s in a.spellings)


def learned_shorts(participants: DataFrame, given: frozenset, family: frozenset) -> dict[str, frozenset]:
    """Short forms by given name: the fixed ones, and those that parties of several cases have among their aliases."""
    known = {k: set(v.split()) for k, v in SHORT_NAMES.items()}
    people = participants.filter(F.col("full_name").isNotNull() & (F.coalesce("case_role", F.lit("")) != "organisation"))
    first = F.element_at(F.split(F.lower(F.trim("full_name")), r"\s+"), 1)
    alone = people.select(first.alias("g"), F.explode("aliases").alias("a")).filter("a rlike '^\\\\p{L}{2,12}$'")
    rows = alone.groupBy("g", F.lower("a").alias("s")).count().filter(F.col("count") >= max(3.0, TOKEN_SHARE * participants.count())).collect()
    for r in rows:
        if r["s"] not in given and r["s"] not in family and near(r["g"], r["s"]) is None:
            known.setdefault(r["g"], set()).add(r["s"])
    return {k: frozenset(v) for k, v in known.items()}


def _lexicons(participants: DataFrame) -> tuple[frozenset, frozenset]:
    words = F.split(F.lower(F.trim("full_name")), r"\s+")
    people = participants.filter(F.col("full_name").isNotNull() & (F.coalesce("case_role", F.lit("")) != "organisation")).select(words.alias("w")).filter("size(w) >= 2")
    people = people.filter(~F.exists("w", lambda x: x.isin(*sorted(ORGANISATION_WORDS))))
    kinds = people.select(F.explode(F.array(F.struct(F.element_at("w", 1).alias("t"), F.lit(1).alias("g")), F.struct(F.element_at("w", -1).alias("t"), F.lit(0).alias("g")))).alias("x"))
    rows = kinds.groupBy("x.t").agg(F.sum("x.g").alias("g"), F.count("*").alias("n")).filter(F.col("n") >= TOKEN_SHARE * participants.count()).collect()
    given = frozenset(fold(r["t"]) for r in rows if 2 * r["g"] >= r["n"]) | frozenset(SHORT_NAMES)
    return given, frozenset(fold(r["t"]) for r in rows if 2 * r["g"] < r["n"]) - given


def _grouped(rows: DataFrame, participants: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct spellings of each case with the case's parties; a case is reduced to its spellings before it is one group."""
    names = rows.select("case_id", F.explode(F.array("sender", "receiver")).alias("name")).filter("case_id is not null and name is not null and trim(name) <> ''").groupBy("case_id", "name").agg(F.lit(None).cast("array<string>").alias("aliases"))
    parties = participants.filter("case_id is not null and full_name is not null").select("case_id", F.col("full_name").alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    given, family = _lexicons(participants)
    return names.unionByName(parties), (given, family, learned_shorts(participants, given, family))


def _resolved(shared, pairs: bool):
    made: dict = {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if "r" not in made:
            made["r"] = Resolver(*shared.value)
        parties = [(n, [x for x in a if x]) for n, a in zip(pdf["name"], pdf["aliases"]) if a is not None]
        names = sorted({n for n, a in zip(pdf["name"], pdf["aliases"]) if a is None})
        groups = made["r"].resolve(names, parties) if names else []
        case = pdf["case_id"].iloc[0]
        if pairs:
            out = [(case, a, b) for g in groups for a, b in combinations(g, 2)]
            return pd.DataFrame(out, columns=["case_id", "name_a", "name_b"])
        out = [(case, n, g[0], len(g)) for g in groups for n in g]
        return pd.DataFrame(out, columns=["case_id", "name", "entity", "n_spellings"])

    return run


def linked_pairs(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """``case_id``, ``name_a``, ``name_b``: different values of sender or receiver of a case that mean the same."""
    every, models = _grouped(rows, participants)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    return every.groupBy("case_id").applyInPandas(_resolved(shared, True), "case_id string, name_a string, name_b string")


def entities(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """``case_id``, ``name``, ``entity`` (its first spelling), ``n_spellings``; values that mean nobody are left out."""
    every, models = _grouped(rows, participants)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    return every.groupBy("case_id").applyInPandas(_resolved(shared, False), "case_id string, name string, entity string, n_spellings int")
