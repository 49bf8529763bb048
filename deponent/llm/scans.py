"""Repair of text recognised from scanned pages (problem 1): broken words, misread characters, running titles, page numbers.

Averaged perceptrons are trained here. One pair judges lines: it tells running titles and page numbers from text by their
place on the page, by whether they interrupt a sentence, by their words, and by how they recur in other messages. The other is
a character editor: a sequence model that gives each character of a word one operation (keep, replace, delete, each with or
without an insertion after it), and the hyphen at a line end one of keep and join. Operation sequences are searched along the
prefixes of the words that the corpus knows; which operations a character may have, and after which, is learned from the
aligned training pairs: known words misread by the fixed confusions, slips of typists, short forms, and compounds.

Nothing is cut off by size: line shapes are counted and joined back as rows, and the words sent to the tasks are those with
at least KNOWN_SHARE of all words, which are at most 1 / KNOWN_SHARE in any corpus.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.session import bounded_sample, checkpointed, lookup_join

#: A word is known if it makes up this share of all words, so at most a million words are known.
KNOWN_SHARE = 1e-6
#: Messages whose lines train the line model, and words that train the editor, at most.
TRAIN_MESSAGES, TRAIN_WORDS = 3000, 4000
#: Places of a word that may be misread at once.
PLACES = 3

# What is read, and what it stands for.
MISREADINGS = (
    ("c", "e"), ("e", "c"), ("!", "i"), ("!", "l"), ("@", "a"), ("+", "t"), ("0", "o"), ("5", "s"), ("$", "s"), ("1", "l"), ("1", "i"), ("9", "g"), ("6", "b"), ("8", "b"), ("|", "l"), ("|", "i"),
    ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("nn", "m"), ("in", "m"), ("iii", "m"), ("tl", "d"), ("0", "e"), ("q", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("l", "t"),
)
#: The first of them are as common as all others together; they are drawn more often when training pairs are made.
_FREQUENT = MISREADINGS[:32]

_TOKEN = re.compile(r"(?<![\w@+!$|.])[A-Za-zÀ-ÿ0-9@+!$|]++(?![\w@])")
_PLAIN = re.compile(r"[a-zà-ÿ]{2,}")
_COMPOUND = re.compile(r"(?<![\w-])[a-zà-ÿ]{2,}-[a-zà-ÿ]{2,}(?![\w-])")
_LEFT = re.compile(rf"([^\W_]+(?:['’][^\W_]+)?)[-‐‑‒­¬][ \t]*$")
_RIGHT = re.compile(r"\s*([^\W_]+)")
_DIGITS = re.compile(r"\d+")
_HYPHEN = "-‐‑‒­¬"
_BREAK = re.compile(rf"[^\W\d_][{_HYPHEN}][ \t]*$")
_PAGE = re.compile(
    r"\s*(?:(?:page|pg|p|seite|s|página|pagina|pág|pahina|blatt)\.?\s*\d{1,4}(?:\s*(?:/|of|von|de)\s*\d{1,4})?|\d{1,4}\s*\|\s*(?:page|seite|página)|[-–—\[(|~]\s*\d{1,4}\s*[-–—\])|~]"
    r"|\d{1,4}\s*(?:/|of|von)\s*\d{1,4}|\d{1,4}|(?=[ivxl])x{0,3}l?x{0,3}(?:ix|iv|v?i{0,3}))\s*$",
    re.I,
)
_SURE_PAGE = re.compile(r"\s*(?:(?:page|pg|seite|página|pahina)\.?\s*\d|\d{1,4}\s*\|\s*page|[-–—\[]\s*\d{1,4}\s*[-–—\]]\s*$|p\.\s*\d)", re.I)
_ENDED = re.compile(r"[.!?:;…][\"”’)\]]*\s*$")
_FIELD = re.compile(r"\s*(?:from|to|subject|sender|cc|date|sent|re|fwd|asunto|betreff|von|an|de|para)\b\s*:?", re.I)
_BULLET = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)]|[a-z][.)])\s+\S", re.I)
_CLOSING = re.compile(r"\s*(?:dear|hello|hi|good day|regards|best|thank|thanks|sincerely|yours|kind|cheers|please bring|greetings)\b", re.I)


# Keys beside one another.
_BESIDE = {"a": "qws", "b": "vn", "c": "xvd", "d": "sfxe", "e": "wrd", "f": "dgcr", "g": "fhvt", "h": "gjby", "i": "uok", "j": "hkn", "k": "jlm", "l": "ko", "m": "nk", "n": "bmj", "o": "ipl", "p": "ol", "q": "wa", "r": "etf", "s": "adwz", "t": "ryg", "u": "yij", "v": "cbg", "w": "qes", "x": "zcs", "y": "tuh", "z": "xa"}
# Words on which no title ends.
_OPEN = frozenset("the a an and or of to in on at by for with from that which who was is be had has have not as if but so because el la de y que ang ng na sa der die das und von".split())


def shape(line: str) -> str:
    """A line without its case, numbers and spacing."""
    return _DIGITS.sub("9", " ".join(line.lower().split()))


def hashed(shape: str) -> int:
    """A signed 64-bit hash of a shape."""
    return xxhash.xxh64_intdigest(shape) - 2**63


def shape_key(line: str) -> int:
    return hashed(shape(line))


def _is_page(line: str) -> bool:
    return _PAGE.match(line) is not None


def _neighbours(lines: list[str]) -> Iterator[tuple[int, str, str, str]]:
    """Each line that is not blank, with the nearest ones before and after it that are neither blank nor page numbers."""
    filled = [bool(x) and not x.isspace() for x in lines]
    text = [f and not _is_page(x) for x, f in zip(lines, filled)]
    before, after, last = [""] * len(lines), [""] * len(lines), ""
    for k, x in enumerate(lines):
        before[k] = last
        if text[k]:
            last = x
    last = ""
    for k in range(len(lines) - 1, -1, -1):
        after[k] = last
        if text[k]:
            last = lines[k]
    for k, x in enumerate(lines):
        if filled[k]:
            yield k, x, before[k], after[k]


def _interrupts(before: str, after: str) -> bool:
    return bool(before and after and not _ENDED.search(before) and not before.rstrip().endswith(",") and re.match(r"\s*[a-zà-ÿ]", after))


def _placed(lines: list[str], k: int, before: str, after: str) -> bool:
    """Whether a line stands where page furniture stands: inside a sentence, or beside a page number."""
    return _interrupts(before, after) or any(0 <= j < len(lines) and _is_page(lines[j]) for j in (k - 2, k - 1, k + 1, k + 2))


class Perceptron:
    """Averaged perceptron over named features that chooses among alternatives; an alternative without features scores 0."""

    def __init__(self):
        self.w: dict[str, float] = {}

    def score(self, features: list[str]) -> float:
        get = self.w.get
        return sum([get(f, 0.0) for f in features])

    def fit(self, examples: list[tuple[list[list[str]], int]], epochs: int = 6, seed: int = 7) -> Perceptron:
        """Each example holds the alternatives' features and the place of the right one."""
        rng, total, stamp, step = random.Random(seed), {}, {}, 0
        examples = list(examples)

        def move(features: list[str], by: int) -> None:
            for f in features:
                w = self.w.get(f, 0.0)
                total[f] = total.get(f, 0.0) + (step - stamp.get(f, 0)) * w
                stamp[f] = step
                self.w[f] = w + by

        for _ in range(epochs):
            rng.shuffle(examples)
            for alternatives, right in examples:
                step += 1
                scores = [self.score(x) for x in alternatives]
                worst = max((k for k in range(len(scores)) if k != right), key=scores.__getitem__, default=None)
                if worst is not None and scores[right] - scores[worst] < 1:
                    move(alternatives[right], 1)
                    move(alternatives[worst], -1)
        self.w = {f: (total.get(f, 0.0) + (step + 1 - stamp.get(f, 0)) * v) / (step + 1) for f, v in self.w.items()}
        return self


def _choices(rows: list[tuple[list[str], bool]]) -> list[tuple[list[list[str]], int]]:
    """Yes-no rows as choices between an alternative and doing nothing."""
    return [([x, []], 0 if yes else 1) for x, yes in rows]


def _bucket(x: float) -> int:
    return int(math.log2(x + 1)) if x > 0 else 0


class Page:
    """The lines of one message and what is known of each from other messages."""

    def __init__(self, message: str, seen: dict[int, tuple[int, int]]):
        self.lines = message.split("\n")
        shapes = [shape(x) if x and not x.isspace() else "" for x in self.lines]
        self.seen = [seen.get(hashed(x), (0, 0)) if x else (0, 0) for x in shapes] if seen else [(0, 0)] * len(self.lines)
        self.again = [min(2, n) for n in map(Counter(shapes).__getitem__, shapes)]
        filled = [k for k, x in enumerate(self.lines) if x and not x.isspace()]
        self.first, self.last = (filled[0], filled[-1]) if filled else (0, 0)
        long = [len(x) for x in self.lines if x.count(" ") >= 3]
        self.width = max(long, default=1)
        self.form = f"form{min(3, len(long))} {min(4, len(filled))} {min(3, sum(long) // 90)}"
        #: A page has several lines of running text; others give examples of what is no furniture.
        self.wrapped = len(long) >= 2 and len(self.lines) >= 4


class PageModel:
    """Judges the lines of a message."""

    def __init__(self):
        self.header, self.page = Perceptron(), Perceptron()
        #: A first look at few features, with the least score that any title of the sample has, less a margin; other lines are text.
        self.glance, self.least = Perceptron(), 0.0

    @staticmethod
    def first_features(page: Page, k: int, body: str) -> list[str]:
        n, breaks = page.seen[k]
        small = sum(map(str.islower, body.split()))
        return ["bias", f"seen{min(3, n)}", f"share{4 * breaks // n if n else 'x'}", f"again{page.again[k]}", f"small{min(4, small)}", f"lead{body[0].isupper()}", f"end{body[-1] in '.,!?;:…'}", f"seen{min(3, n)} small{min(2, small)}"]

    @staticmethod
    def features(page: Page, k: int, line: str, before: str, after: str) -> list[str]:
        body = line.strip()
        n, breaks = page.seen[k]
        words = body.split()
        upper = sum(w[:1].isupper() or not w[:1].isalpha() for w in words) / max(1, len(words))
        near = [page.lines[j] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(page.lines)]
        broken, numbered, share = _interrupts(before, after), any(x and _is_page(x) for x in near), f"break{int(4 * breaks / n) if n >= 3 else 'x'}"
        end = "" if body[-1].isalnum() or body[-1] not in ".,!?;:…" else body[-1]
        lead = f"lead{'upper' if body[0].isupper() else 'lower' if body[0].islower() else 'sign'}"
        size = f"words{min(12, len(words))} {min(4, len(body) // 40)}"
        lower = f"lower{min(3, sum(w.islower() and w not in _OPEN for w in words))}"
        signed = f"signed{_CLOSING.match(before) is not None} {before.rstrip()[-1:] in (',', ':')}"
        again, fill = f"again{page.again[k]}", f"fill{min(4, 4 * len(body) // page.width)}"
        out = [
            "bias", share, f"seen{min(3, n)}", f"upper{int(4 * upper)}", size, page.form, f"broken{broken}", f"numbered{numbered}", f"first{k == page.first}", f"last{k == page.last}", f"end{end}", lead, lower,
            f"field{_FIELD.match(body) is not None}", f"bullet{_BULLET.match(body) is not None}", f"closing{_CLOSING.match(body) is not None}", f"bars{'|' in body or ' / ' in body or '   ' in body}",
            f"digits{any(c.isdigit() for c in body)}", f"at{'@' in body}", f"tail{words[-1].lower() in _OPEN}",
        ]
        told = {"word " + w.strip(".,:;|()[]#-").lower() for w in words if w[0].isupper() and w.lower() not in _OPEN}
        return [*out, *sorted(told), f"wrapped{page.wrapped}", again, fill, signed, signed + share, lower + share, lower + again, lower + fill, share + again, again + f"{bool(end)}" + lead, share + f" {broken}", share + f" {numbered}", lead + f" end{end}", lead + size, share + lead + f"{bool(end)}", lower + f" {broken}"]

    @staticmethod
    def page_features(page: Page, k: int, line: str, before: str, after: str) -> list[str]:
        body = line.strip()
        form = re.sub(r"[a-z]+", "a", re.sub(r"\d+", lambda m: f"9x{len(m[0])}", body.lower()))
        bare = re.fullmatch(r"\d+|[ivxl]+", body.lower()) is not None
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(page.lines)]
        title = any(page.seen[j][1] * 4 >= page.seen[j][0] >= 3 for j in near)
        out = ["bias", form, f"bare{bare}", f"wrapped{page.wrapped}", page.form, f"broken{_interrupts(before, after)}", f"title{title}", f"sure{_SURE_PAGE.match(body) is not None}", f"blank{any(not page.lines[j].strip() for j in near)}", f"edge{k in (page.first, page.last)}"]
        return [*out, out[2] + out[9] + out[3], out[2] + out[3], out[2] + out[5], out[2] + out[6], out[2] + out[3] + out[5] + out[8], out[2] + out[4], out[7] + out[3]]

    def train(self, messages: list[tuple[str, dict[int, tuple[int, int]]]]) -> PageModel:
        heads, pages = [], []
        for message, seen in messages:
            page = Page(message, seen)
            if len(page.lines) < 2:
                continue
            for k, line, before, after in _neighbours(page.lines):
                if _is_page(line):
                    # At the edge of a page, inside a sentence, or by its form a number is the page's; other numbers of pages give no label.
                    sure, breaks = _SURE_PAGE.match(line.strip()) is not None, _interrupts(before, after) or k in (page.first, page.last)
                    if sure or not page.wrapped or breaks:
                        pages.append((self.page_features(page, k, line, before, after), page.wrapped and (sure or breaks)))
                    continue
                n, breaks = page.seen[k]
                often = n >= 3 and breaks >= 0.25 * n and page.wrapped
                plain = not page.wrapped or _FIELD.match(line) or _BULLET.match(line) or _CLOSING.match(line) or _CLOSING.match(before) and breaks < 0.5 * n or _ENDED.search(line) or line.rstrip()[-1] in ",:;" or "@" in line or line.split()[-1].lower() in _OPEN
                if plain:
                    heads.append((self.first_features(page, k, line.strip()), False, (page, k, line, before, after)))
                elif often:
                    words = line.split()
                    if words[0][0].isupper() and sum(w.islower() and w not in _OPEN for w in words) <= 1:
                        heads.append((self.first_features(page, k, line.strip()), True, (page, k, line, before, after)))
                elif n < 3 or breaks < 0.12 * n:
                    heads.append((self.first_features(page, k, line.strip()), False, (page, k, line, before, after)))
        self.glance.fit(_choices([(first, yes) for first, yes, _ in heads]))
        self.least = min((self.glance.score(first) for first, yes, _ in heads if yes), default=0.0) - 1.0
        self.header.fit(_choices([(self.features(*line), yes) for first, yes, line in heads if self.glance.score(first) >= self.least]))
        self.page.fit(_choices(pages))
        return self

    def judge(self, page: Page) -> list[str]:
        """For each line: text, header, page_number or blank."""
        kinds = ["blank" if not x or x.isspace() else "text" for x in page.lines]
        if len(kinds) < 2:
            return kinds
        for k, line, before, after in _neighbours(page.lines):
            if _is_page(line):
                if self.page.score(self.page_features(page, k, line, before, after)) > 0:
                    kinds[k] = "page_number"
            elif self.glance.score(self.first_features(page, k, line.strip())) >= self.least and self.header.score(self.features(page, k, line, before, after)) > 0:
                kinds[k] = "header"
        return kinds


KEEP, DELETE, JOIN = "keep", "delete", "join"


def operations(read: str, meant: str) -> list[str]:
    """One operation for each character of ``read`` that turns it into ``meant``."""
    ops = [KEEP if r == m else "replace " + m for r, m in zip(read, meant)] + [DELETE] * (len(read) - len(meant))
    if len(meant) > len(read):
        ops[-1] += " insert " + meant[len(read) :]
    return ops


def _written(c: str, op: str) -> str:
    """What stands for a character after its operation."""
    if op == DELETE:
        return ""
    kept, _, added = op.partition(" insert ")
    return (c if kept == KEEP else kept[8:]) + added


Edits = tuple[tuple[int, str], ...]


class Editor:
    """Character editor: one operation for each character of a word, and join or keep for the hyphen of a broken line."""

    def __init__(self, counts: dict[str, int], total: int | None = None, places: int = PLACES):
        self.counts, self.model, self.places = counts, Perceptron(), places
        self.total = total or sum(counts.values()) or 1
        #: Occurrences that a word which is not known may have at most.
        self.least = max(1.0, self.total * KNOWN_SHARE)
        self.known = sorted(w for w in counts if "-" not in w)
        self.starts: dict[str, set[str]] = {}  # operations that may begin a misread place, by character
        self.follows: dict[tuple[str, str, str], set[str]] = {}  # operations that go on with one, by the one before, its character and the next
        self.ends: set[tuple[str, str]] = set()  # operations that may end one, with their character
        for read, meant in MISREADINGS:
            ops = operations(read, meant)
            self.starts.setdefault(read[0], set()).add(ops[0])
            self.ends.add((ops[-1], read[-1]))
            for k in range(1, len(ops)):
                self.follows.setdefault((ops[k - 1], read[k - 1], read[k]), set()).add(ops[k])

    def readings(self, word: str) -> list[tuple[str, Edits]]:
        """Known words that operation sequences make of ``word``, with the operations that are not keep."""
        words, size, found, most = self.known, len(word), [], self.places
        n = len(words)
        todo: list[tuple[int, str, Edits, str, int]] = [(0, "", (), KEEP, 0)]
        while todo:
            i, out, edits, last, used = todo.pop()
            whole = last == KEEP or (last, word[i - 1]) in self.ends
            if i == size:
                if edits and whole and out in self.counts and out != word:
                    found.append((out, edits))
                continue
            c = word[i]
            options = [] if last == KEEP else [(op, used) for op in self.follows.get((last, word[i - 1], c), ())]
            if whole:
                options.append((KEEP, used))
                if used < most:
                    options += [(op, used + 1) for op in self.starts.get(c, ())]
            for op, u in options:
                more = out + _written(c, op)
                k = bisect_left(words, more)
                if k < n and words[k].startswith(more):
                    todo.append((i + 1, more, edits if op == KEEP else (*edits, (i, op)), op, u))
        return found

    def share(self, word: str) -> int:
        """How frequent a word is among all words, in steps of two."""
        n = self.counts.get(word, 0)
        return _bucket(n / self.least) if n else -1

    def features(self, word: str, to: str, edits: Edits) -> list[str]:
        have, want = self.counts.get(word, 0), self.counts.get(to, 0)
        odd = sum(not c.isalpha() for c in word)
        ratio, known = f"ratio{min(12, _bucket(want / (have + self.least)))}", f"known{have > 0}"
        places = sum(1 for k, (i, _) in enumerate(edits) if not k or edits[k - 1][0] != i - 1)
        out = ["bias", ratio, known, f"want{min(12, self.share(to))}", f"odd{min(3, odd)}", f"places{places}", f"size{min(8, len(word))}", ratio + f" size{min(8, len(word))}", known + ratio]
        before = ""
        for i, op in edits:
            o = f"{word[i]} {op}"
            out += [o, o + f" odd{odd > 0}", f"{o} start{i == 0}", f"{o} end{i + 1 == len(word)}", o + "<" + word[i - 1 : i], o + ">" + word[i + 1 : i + 2], before + "|" + o, o + " " + ratio]
            before = o
        return out

    def best(self, word: str) -> str | None:
        """The word meant, if the model prefers operations to keeping every character."""
        top, choice = 0.0, None
        for to, edits in self.readings(word):
            s = self.model.score(self.features(word, to, edits))
            if s > top or s == top and choice is not None and to < choice:
                top, choice = s, to
        return choice

    def join_features(self, left: str, right: str, sign: str, gap: str) -> list[str]:
        a, b = left.lower(), right.lower()
        whole, both = self.counts.get(a + b, 0), self.counts.get(f"{a}-{b}", 0)
        known = f"join whole{min(3, self.share(a + b) + 1)}", f"join parts{min(3, self.share(a) + 1)} {min(3, self.share(b) + 1)}"
        sort = f"join sign{'hyphen' if sign == '-' else 'other'}"
        out = ["join", *known, sort, f"join gap{gap}", f"join lower{right[:1].islower()}", f"join compound{min(3, _bucket(4 * both / (whole + 1)))}", f"join sizes{min(4, len(a))} {min(4, len(b))}"]
        return [*out, known[0] + known[1], known[0] + sort, sort + out[6], known[1] + sort]

    def joins(self, left: str, right: str, sign: str, gap: str) -> bool:
        """Whether the hyphen at a line end only marks a broken word."""
        return self.model.score(self.join_features(left, right, sign, gap)) > 0

    def _misreadings(self, w: str, rng: random.Random) -> Iterator[tuple[str, Edits]]:
        """Misread forms of a word with the operations that mend them."""
        fit = [(r, m) for r, m in _FREQUENT if m in w]
        for read, meant in rng.sample(fit, min(4, len(fit))):
            at = rng.choice([m.start() for m in re.finditer(re.escape(meant), w)])
            yield w[:at] + read + w[at + len(meant) :], tuple((at + k, op) for k, op in enumerate(operations(read, meant)) if op != KEEP)
        if len(w) >= 7 and len(fit) > 1:  # two places at once
            (r1, m1), (r2, m2) = rng.sample(fit, 2)
            a = w.find(m1)
            b = w.find(m2, a + len(m1))
            if b >= 0:
                first = [(a + k, op) for k, op in enumerate(operations(r1, m1)) if op != KEEP]
                second = [(b + len(r1) - len(m1) + k, op) for k, op in enumerate(operations(r2, m2)) if op != KEEP]
                yield w[:a] + r1 + w[a + len(m1) : b] + r2 + w[b + len(m2) :], (*first, *second)

    @staticmethod
    def _slips(w: str, rng: random.Random) -> list[str]:
        """How a hurried typist may write a word: letters swapped, doubled, missed, hit beside, or a number for a sound."""
        k = rng.randrange(len(w) - 1)
        beside = _BESIDE.get(w[k], w[k])
        out = [w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k] + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(beside) + w[k + 1 :], w[:k] + rng.choice(beside) + w[k:]]
        out += [w.replace(a, b, 1) for a, b in (("to", "2"), ("for", "4"), ("ate", "8"), ("eat", "8")) if a in w]
        return [x for x in out if x != w]

    def train(self, seed: int = 11) -> Editor:
        """Fits the model on known words; what would be ambiguous, as both forms are words, is left out."""
        rng = random.Random(seed)
        ranked = sorted((w for w in self.known if len(w) >= 4), key=lambda w: (-self.counts[w], w))
        common = ranked[: TRAIN_WORDS // 2]
        examples: list = []

        def add(word: str, right: tuple[str, Edits] | None) -> None:
            found = self.readings(word)
            if right is not None and right not in found:
                return
            if found:
                examples.append(([*(self.features(word, to, e) for to, e in found), []], found.index(right) if right is not None else len(found)))

        for w in common:
            for bad, edits in self._misreadings(w, rng):
                if self.counts.get(bad, 0) * 8 <= self.counts[w]:
                    add(bad, (w, edits))
            for slip in self._slips(w, rng):
                if self.counts.get(slip, 0) * 8 <= self.counts[w]:
                    add(slip, None)
        short = sorted(w for w in self.known if 3 <= len(w) <= 4)
        for w in [*ranked[:: max(1, len(ranked) // TRAIN_WORDS)], *short[:: max(1, len(short) // TRAIN_WORDS)] * 2]:
            if not any(self.counts[to] > (40 if len(w) > 4 else 400) * self.counts[w] for to, _ in self.readings(w)):
                add(w, None)
        examples += self._breaks(ranked, common, rng)
        self.model.fit(examples)
        return self

    def _breaks(self, ranked: list[str], common: list[str], rng: random.Random) -> list:
        """Words broken at a line end, and compounds whose own hyphen stands there."""
        rows = []
        counts = self.counts
        for w in [*common, *ranked[len(common) :: max(1, len(ranked) // 500)]]:
            if len(w) >= 5:
                k = rng.randrange(2, len(w) - 1)
                rows.append((self.join_features(w[:k], w[k:], rng.choice("---¬‐"), rng.choice(("none", "none", "page"))), True))
                unseen = self.join_features(w[:k] + "qx", w[k:], "-", "none")  # a word that is not known, broken
                rows.append((unseen, counts.get(w[k:], 0) < self.least or rng.random() < 0.5))
        compounds = sorted(w for w in counts if "-" in w and counts[w] > 8 * counts.get(w.replace("-", ""), 0))
        plain = [w for w in common if len(w) >= 4]
        for w in compounds[: TRAIN_WORDS // 2]:
            a, b = w.split("-")
            rows.append((self.join_features(a, b, "-", "none"), False))
        for _ in range(len(common) // 2 if plain else 0):
            a, b = rng.choice(plain), rng.choice(plain)
            if a + b not in counts:
                rows.append((self.join_features(a, b, "-", rng.choice(("none", "page", "blank"))), False))
        for w in plain[:: max(1, len(plain) // 300)]:  # a list or a dash, not a broken word
            rows.append((self.join_features(w, w.capitalize(), "-", "blank"), False))
        return _choices(rows)

    def misread(self, token: str) -> str | None:
        """The word meant by a token that was misread, or None. Two letters are too little to tell."""
        low = token.lower()
        return self.best(low) if len(low) >= 3 and sum(map(str.isalpha, low)) >= 2 else None


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in each batch, added up before they are shuffled, and the line shapes of each text (by its hash)."""
    for batch in batches:
        words: Counter = Counter()
        lines: dict[tuple[int, int], list[int]] = {}
        for key, message in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not message:
                continue
            text = (joined_lines(message, None)[0] if "\n" in message else message).lower()
            words.update(_PLAIN.findall(text))
            if "-" in text:
                words.update(_COMPOUND.findall(text))
            if "\n" not in message:
                continue
            parts = message.split("\n")
            for k, line, before, after in _neighbours(parts):
                if not _is_page(line):
                    got = lines.setdefault((key, shape_key(line)), [0, 0])
                    got[0] += 1
                    got[1] += _placed(parts, k, before, after)
        n, m = len(words), len(lines)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*words, *[None] * m], pa.string()),
                pa.array([*[None] * n, *[k for k, _ in lines]], pa.int64()),
                pa.array([*[None] * n, *[x for _, x in lines]], pa.int64()),
                pa.array([*words.values(), *[x for x, _ in lines.values()]], pa.int64()),
                pa.array([*[0] * n, *[x for _, x in lines.values()]], pa.int64()),
            ],
            ["word", "text_key", "shape", "n", "breaks"],
        )


def joined_lines(message: str, kinds: list[str] | None) -> tuple[str, int]:
    """The message with words broken at line ends put together over furniture and blank lines; the number of joins."""
    lines = message.split("\n")
    kinds = kinds or ["blank" if not x.strip() else "text" for x in lines]
    out: list[str] = []
    joins, k = 0, 0
    pending = ""
    for k, line in enumerate(lines):
        if kinds[k] in ("header", "page_number"):
            continue
        if pending:
            if kinds[k] == "blank" and any(x in ("header", "page_number") for x in kinds[max(0, k - 3) : k + 4]):
                continue
            body = line.lstrip()
            if body[:1].isalpha():
                head, _, rest = body.partition(" ")
                line = pending.rstrip()[:-1] + head + ("\n" + rest if rest else "")
                joins += 1
            else:
                out.append(pending)
            pending = ""
            parts = line.split("\n")
            out += parts[:-1]
            line = parts[-1]
        if _BREAK.search(line):
            pending = line
        else:
            out.append(line)
    if pending:
        out.append(pending)
    return "\n".join(out), joins


class Repairer:
    """Both models; made once for each task."""

    def __init__(self, pages: PageModel, editor: Editor):
        self.pages, self.editor, self.fine = pages, editor, set()

    def broken(self, lines: list[str], kinds: list[str]) -> list[tuple[int, int]]:
        """Lines whose last word is broken, with the line on which it goes on."""
        found, after = [], len(lines)
        following = [after] * len(lines)
        for k in range(len(lines) - 1, -1, -1):
            following[k] = after
            if kinds[k] == "text":
                after = k
        for k, line in enumerate(lines):
            if kinds[k] != "text" or not _BREAK.search(line) or (j := following[k]) == len(lines):
                continue
            left, right = _LEFT.search(line), _RIGHT.match(lines[j])
            if not left or not right:
                continue
            between = kinds[k + 1 : j]
            gap = "none" if not between else "blank" if all(x == "blank" for x in between) else "page"
            if self.editor.joins(left[1], right[1], line.rstrip()[-1], gap):
                found.append((k, j))
        return found

    def defects(self, message: str, seen: dict[int, tuple[int, int]] | None = None) -> list[str]:
        out, text = [], message
        if "\n" in message:
            page = Page(message, seen or {})
            kinds = self.pages.judge(page)
            out = [x for x in ("header", "page_number") if x in kinds]
            if self.broken(page.lines, kinds):
                out.append("hyphenation")
            text = joined_lines(message, kinds)[0]
        if "header" in out:
            text += "\n" + "\n".join(x for x, k in zip(page.lines, kinds) if k == "header")
        odd = {w for w in set(_TOKEN.findall(text)) - self.fine if self._meant(w)}
        if odd and any(m[0] in odd and self._word(text, m) for m in _TOKEN.finditer(text)):
            out.append("misread")
        return out

    def _meant(self, token: str) -> str | None:
        """What a token was misread from, or None; tokens found to be fine are kept so that each is judged once."""
        got = self.editor.misread(token)
        if got is None:
            if len(self.fine) > 500_000:
                self.fine.clear()
            self.fine.add(token)
        return got

    @staticmethod
    def _word(text: str, m: re.Match) -> bool:
        """Whether a token is a word of the text, not part of an address or a code."""
        token = m[0]
        if not any(c.isalpha() for c in token):
            return False
        if token.isalpha():
            return text[m.end() : m.end() + 1] != "@" and not re.match(r"\.\w+@|[\w.+-]*@", text[m.end() : m.end() + 30])
        return not re.search(r"[^\W\d_]!$|^[+@]", token) and not re.match(r"[.\w-]*@|\.\w", text[m.end() : m.end() + 30]) and ("@" not in token or re.fullmatch(r"[A-Za-z]*@[a-z]*", token) is not None)

    def repair(self, message: str, seen: dict[int, tuple[int, int]] | None = None) -> str:
        """Continuous paragraphs with whole words, right characters and no page furniture."""
        page = Page(message, seen or {})
        kinds, lines = self.pages.judge(page), page.lines
        joins = dict(self.broken(lines, kinds)) if len(lines) > 1 else {}
        paragraphs: list[list[str]] = [[]]
        carry = ""
        for k, line in enumerate(lines):
            if kinds[k] == "blank":
                if paragraphs[-1] and not carry and not any(x in ("header", "page_number") for x in kinds[max(0, k - 2) : k + 3]):
                    paragraphs.append([])
                continue
            if kinds[k] != "text":
                continue
            body = carry + line.strip()
            carry = ""
            if k in joins:
                carry = body.rstrip()[:-1]
                continue
            fresh = _BULLET.match(body) or _FIELD.match(body) or _CLOSING.match(body)
            if fresh and paragraphs[-1]:
                paragraphs.append([])
            paragraphs[-1].append(body)
            if fresh or len(lines) > 1 and body.endswith((":",)):
                paragraphs.append([])
        if carry:
            paragraphs[-1].append(carry)
        text = "\n".join(" ".join(p) for p in paragraphs if p)
        return _TOKEN.sub(lambda m: self._mended(text, m), text)

    def _mended(self, text: str, m: re.Match) -> str:
        token = m[0]
        if token in self.fine or (to := self._meant(token)) is None or not self._word(text, m):
            return token
        return to.upper() if token.isupper() and len(token) > 1 else to.capitalize() if token[0].isupper() else to


def prepared(rows: DataFrame) -> tuple[DataFrame, Repairer]:
    """The rows, ``row_id``, ``message`` and ``seen`` (what other messages tell of the message's lines), and both models.

    Words are counted over all rows. Line shapes are counted by text, so copies are added up before they meet, and joined
    back by the text's hash; a shape or a text that makes up most of the rows is salted by the join.
    """
    keyed = rows.select(F.col("row_id").cast("long").alias("row_id"), "message", F.xxhash64("message").alias("text_key"))
    found = checkpointed(keyed.select("text_key", "message").mapInArrow(_collected, "word string, text_key long, shape long, n long, breaks long"))
    words = found.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    total = int(found.filter("word is not null").agg(F.sum("n")).first()[0] or 0)
    known = {r["word"]: int(r["n"]) for r in words.filter(F.col("n") >= max(1.0, KNOWN_SHARE * total)).collect()}
    lines = found.filter("shape is not null").groupBy("text_key", "shape").agg(F.sum("n").alias("n"), F.sum("breaks").alias("breaks"))
    shapes = lines.groupBy("shape").agg(F.sum("n").alias("n"), F.sum("breaks").alias("breaks")).filter("n >= 2 and breaks >= 1")
    told = lookup_join(lines.select("text_key", "shape"), shapes, "shape", "inner")
    maps = checkpointed(told.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("shape", F.array("n", "breaks")))).alias("seen")))
    paged = F.contains("message", F.lit("\n"))
    joined = lookup_join(keyed.filter(paged), maps, "text_key").select("row_id", "message", "seen")
    plain = keyed.filter(F.coalesce(~paged, F.lit(True))).select("row_id", "message", F.lit(None).cast("map<bigint,array<bigint>>").alias("seen"))
    drawn = lookup_join(bounded_sample(keyed.filter(paged), "message", TRAIN_MESSAGES), maps, "text_key")  # only the sample meets the maps twice
    sample = sorted(((r["message"], {k: tuple(v) for k, v in (r["seen"] or {}).items()}) for r in drawn.select("message", "seen").collect()), key=lambda x: x[0])
    return joined.unionByName(plain), Repairer(PageModel().train(sample), Editor(known, total).train())


def _applied(shared, judge: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            if judge:
                got = [(i, d) for i, m, seen in rows if m for d in model.defects(m, {k: tuple(v) for k, v in seen or ()})]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())], ["row_id", "defect"])
            else:
                texts = [m and model.repair(m, {k: tuple(v) for k, v in seen or ()}) for _, m, seen in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row_id", "message"])

    return run


def found_defects(rows: DataFrame) -> DataFrame:
    """``row_id``, ``defect`` for each kind of defect a message has; null and empty messages have none."""
    every, model = prepared(rows)
    return every.mapInArrow(_applied(rows.sparkSession.sparkContext.broadcast(model), True), "row_id long, defect string")


def repaired(rows: DataFrame) -> DataFrame:
    """``row_id``, ``message`` of every row, the message repaired; null stays null."""
    every, model = prepared(rows)
    return every.mapInArrow(_applied(rows.sparkSession.sparkContext.broadcast(model), False), "row_id long, message string")
