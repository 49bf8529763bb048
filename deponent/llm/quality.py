"""Statistics of each document's text, and trees trained on them that tell prose from lists, tables and junk (problem 8).

One pass over each text gives two kinds of statistics. Shares of the characters standing in lines that look like items, rows
of fields or junk (STRUCTURE) give weak labels to a bounded sample. Gradient-boosted trees learn the kinds from the other
statistics alone (INPUTS: words, characters, and the form of lines), so they do not see what made the labels. Their scores
are calibrated by a temperature and a shift of each kind on documents checked by hand, and a document is a list, a table or
junk if these together have a calibrated probability of at least a half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.llm.quality_examples import CHECKED, EXAMPLES
from deponent.llm.trees import BoostedTrees, calibrate
from deponent.session import bounded_sample

#: Documents on which the trees are fitted, at most; taken evenly by a hash of their text.
TRAIN_DOCUMENTS = 4000
KINDS = ("prose", "list", "table", "junk")
WORDING = (
    "n_words", "mean_word_length", "letter_ratio", "digit_ratio", "symbol_ratio", "upper_ratio", "line_end_share", "common_share", "type_ratio", "line_ratio",
    "mean_line_length", "longest_token", "stop_rate",
)
STRUCTURE = ("item_share", "bare_item_share", "row_share", "junk_line_share", "repeat_share", "damage_share", "salad_share")
FORM = (
    "marked_lines", "counted_lines", "cut_share", "even_cuts", "gap_share", "short_lines", "words_per_line", "length_spread", "lower_starts", "capital_rate", "vowel_ratio", "beyond_ascii", "labelled_lines", "colon_lines",
    "separator_rate",
)
FEATURES = (*WORDING, *STRUCTURE, *FORM)
INPUTS = [k for k, f in enumerate(FEATURES) if f not in STRUCTURE]

_ITEM = re.compile(r"\s*(?:[-*•–—·▪◦‣+]|\[[ xX✓✗]?\]|[☐☑☒✓✔]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,5}[.)])\s+\S")
_GAP = re.compile(r"(?<=\S)\s{2,}(?=\S)")
_FIELD = re.compile(r"(?:^|\s{2,})[A-Za-z][\w ]{0,14}: ?")
_SPEAKER = re.compile(r"\s*(?:\[?\d{1,2}[:.]\d{2}(?::\d{2})?\]?\s*(?:[-–]\s*)?)?[^\W\d][\w .'’-]{1,40}(?::| [-–])\s+\S")
_LETTER = re.compile(r"(?:Dear|Hello|Hi|Good day|Statement of|Date|From|To|Subject|Re)\b|.{1,40},$")
_DAMAGE = re.compile(r"[\u0080-\u009f�†‡™œŒ¿½¼¾¤¶©®€¦§¨¬±²³¹º»«ÂÃÐðþÞ]")
_RUN = re.compile(r"[A-Za-z0-9+/=_\-]{32,}")
_SPLIT = re.compile(r"\s*[»›|·•→]\s*|\s[>/–-]\s|\s{2,}")
_NUMBERS = re.compile(r"[\d\s.,:+\-]+$")
_SENTENCE = re.compile(r"[^\W\d_]{2,}[.!?…]+(?=\s|$|[\"”)])|[,;:](?=\s)")
_STOPS = frozenset(".!?…")
_MARKS = (". ", ".\n", ", ", "? ", "! ", "; ", ": ", ",\n", "?\n", "…")
_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_UPPER, _DIGITS, _BLANK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"
_TO_WORDS = {c: c if chr(c).isalpha() or c == 39 else 32 for c in range(128)} | {0x2019: 39, 0x201C: 32, 0x201D: 32, 0x2026: 32, 0x2014: 32, 0x2013: 32}


_VOWELS = b"aeiouyAEIOUY"
_MARKED = re.compile(r"\s*[^\w\s\"'“”‘’(¿¡]").match
_COUNTED = re.compile(r"\s*[\[(]?(?:\d{1,3}|[A-Za-z]|[ivx]{1,4})[.)\]]\s").match
_CAPITAL = re.compile(r"(?<!\S)[A-ZÀ-Þ]").findall
_LABELLED = re.compile(r"[^\s:][^:\n]{1,39}:(?: |$)").match


def _form(text: str, b: bytes, letters: int, real: list[str], lengths: list[int]) -> list[float]:
    """The statistics of FORM for a text with lines that are not blank."""
    n, total = len(real), sum(lengths)
    mean = total / n
    cuts = [x.count("\t") + x.count("|") + x.count(";") + x.count(",") - x.count(", ") for x in real]
    gaps = [x.count("  ") for x in real]
    blanks = [x.count(" ") for x in real]
    words = sum(blanks) + n
    return [
        sum(_MARKED(x) is not None for x in real) / n, sum(_COUNTED(x) is not None for x in real) / n,
        sum(k for k, c in zip(lengths, cuts) if c >= 2) / total, sum(x == y >= 2 for x, y in zip(cuts, cuts[1:])) / max(1, n - 1),
        sum(k for k, g in zip(lengths, gaps) if g >= 2) / total, sum(x < 6 for x in blanks) / n, words / n, (sum((k - mean) ** 2 for k in lengths) / n) ** 0.5 / mean,
        sum(x.lstrip()[0].islower() for x in real) / n, len(_CAPITAL(text)) / words, (len(b) - len(b.translate(None, _VOWELS))) / max(1, letters),
        0.0 if text.isascii() else (len(text) - len(text.encode("ascii", "ignore"))) / len(text), sum(_LABELLED(x) is not None for x in real) / n, sum(x.count(": ") >= 2 for x in real) / n,
        sum(map(text.count, "»›/>")) / words,
    ]


def _key(body: str) -> bool:
    """Whether a text holds a long run of mixed key characters."""
    return any(not x.isalpha() and not x.islower() and not x.isupper() and any(c.isdigit() for c in x) for x in _RUN.findall(body))


def _words(text: str) -> list[str]:
    return text.lower().translate(_TO_WORDS).split()


def _share_common(words: list[str], common: dict[str, frozenset]) -> float:
    """The share of words that are frequent in the language in which most of them are."""
    return max((sum(map(ws.__contains__, words)) for ws in common.values()), default=0) / max(1, len(words))


def _row_style(line: str) -> str:
    """How a line is cut into fields, with their number; empty if it is not."""
    n = line.count("\t")
    if n:
        return f"t{n}"
    n = line.count("|")
    if n >= 2 and (line.strip()[:1] == "|" or line.count(" | ") >= 2):
        return f"p{n}"
    n = line.count(";")
    if n >= 2 and n - line.count("; ") >= 2:
        return f"s{n - line.count('; ')}"
    if line.count(",") >= 2:
        bare = re.sub(r'"[^"]*"', "", line) if '"' in line else line
        n = bare.count(",") - bare.count(", ")
        if n >= 2:
            return f"c{n}"
    if "  " in line:
        body = line.strip()
        if len(body) <= 240 and (gaps := len(_GAP.findall(body))) >= 2 and (gaps < len(body.split()) - 1 or "   " in body):
            return f"g{gaps}"
    return ""


def _menu(body: str) -> bool:
    parts = _SPLIT.split(body)
    if len(parts) < 6:
        return False
    short = [x for x in parts if x and len(x) <= 18 and x[0].isupper() and x.replace(" ", "").isalpha() and x.count(" ") <= 1]
    return len(short) >= 0.85 * len(parts) and len(set(short)) < 0.9 * len(short)


def _junk_line(body: str) -> bool:
    """Whether a line is a run of symbols, digits or key characters, a menu, or damaged beyond reading."""
    b = body.encode("utf-8", "replace")
    size = len(b)
    letters = size - len(b.translate(None, _LETTERS))
    solid = size - b.count(b" ")
    if letters > 0.75 * solid:
        if not body.isascii() and len(_DAMAGE.findall(body)) > 0.08 * len(body):
            return True
        return size >= 32 and (body.count(" ") <= 1 + size // 60 and _key(body) or (("  " in body or "|" in body or not body.isascii() or "/" in body or ">" in body or " - " in body) and _menu(body)))
    digits = size - len(b.translate(None, _DIGITS))
    if digits and _NUMBERS.match(body):
        return body.count(" ") >= 3
    if letters < 0.4 * solid and body.isascii() and solid - letters - digits > 0.4 * solid:
        return True
    if solid <= 8 and letters == 0 and digits == 0:
        return True
    words = body.split()
    if len(words) >= 4 and max(map(len, words)) <= 2 and len(set(words)) <= 3:
        return True
    if len(body) >= 3 and not body.strip("il1|I "):
        return True
    if not body.isascii() and len(_DAMAGE.findall(body)) > 0.08 * len(body):
        return True
    return size >= 32 and (len(words) <= 2 + size // 60 and _key(body) or _menu(body))


def text_features(text: str, common: dict[str, frozenset]) -> list[float]:
    """The statistics of one text, in the order of FEATURES; an empty text has zeros."""
    b = text.encode("utf-8", "replace")
    size = len(b)
    digits, blank = size - len(b.translate(None, _DIGITS)), size - len(b.translate(None, _BLANK))
    beyond = len(text) - len(b.translate(None, bytes(range(128, 256)))) if not text.isascii() else 0  # characters beyond ASCII
    letters = size - len(b.translate(None, _LETTERS)) + beyond
    upper = size - len(b.translate(None, _UPPER))
    total = len(text)
    solid = total - blank
    if solid <= 0:
        return [0.0] * len(FEATURES)
    low = _words(text)
    common_share = _share_common(low, common)
    distinct = len(set(low))
    lines = text.split("\n")
    real = [x for x in lines if x and not x.isspace()]
    n = len(real)
    bodies = [x.strip() for x in real]
    seen = Counter(bodies)
    lengths = [len(x) for x in real]
    chars = sum(lengths)
    stopped = [x.rstrip("\"”’)] ")[-1:] in _STOPS for x in bodies]
    styles = [_row_style(x) for x in real]
    labels = [x[0].isupper() and len(x) <= 18 and x.count(" ") <= 1 and x.replace(" ", "").isalpha() for x in bodies] if n >= 5 else [False] * n
    labelled = sum(labels)
    if labelled < 5 or max(seen[x] for x, y in zip(bodies, labels) if y) < 2:
        labels = [False] * n
    item = bare = row = junk = repeat = salad = 0
    open_run: list[int] = []
    wrapped = 0

    def close() -> int:
        nonlocal wrapped
        got = 0
        if open_run and n >= 3:
            sizes = [lengths[j] for j in open_run]
            most = max(sizes)
            if wrapped < 0.5 * len(sizes) or len(sizes) >= 3 and (most < 38 or len(sizes) > 3 and min(sizes[:-1]) < 0.55 * most):
                got = sum(sizes)
        open_run.clear()
        wrapped = 0
        return got

    doubtful = common_share < 0.36
    for k, line in enumerate(real):
        length, style = lengths[k], styles[k]
        if _ITEM.match(line):
            item += length
            bare += close()
            continue
        if style or ":" in line and "  " in line:
            near = {styles[j] for j in (k - 1, k + 1) if 0 <= j < n}
            if style and (style in near or length < 240 and any(s and s[0] == style[0] for s in near)) or ":" in line and len(_FIELD.findall(line)) >= 3:
                if not _junk_line(bodies[k]) or style[:1] == "p" and digits:
                    row += length
                    bare += close()
                    continue
        if labels[k]:
            repeat += length
            bare += close()
            continue
        if _junk_line(bodies[k]):
            junk += length
            bare += close()
            continue
        if doubtful and length >= 40:
            words = _words(line)
            if len(words) >= 6:
                share = _share_common(words, common)
                mixed = common_share < 0.2 and not _SENTENCE.search(text)
                if share < (0.2 if mixed else 0.1) or len(words) >= 14 and share < 0.2 and not _SENTENCE.search(line):
                    salad += length
                    bare += close()
                    continue
        if stopped[k] or length > 90 or line[:1] in ">|" or _SPEAKER.match(line) or _LETTER.match(line):
            bare += close()
            continue
        width = max(x for x in lengths[max(0, k - 3) : k + 4] if x < 120)
        after = real[k + 1] if k + 1 < n else ""
        open_run.append(k)
        wrapped += length + 1 + len(after.split(" ", 1)[0]) >= width if after else 0
    bare += close()
    marks = sum(map(text.count, _MARKS))
    damage = len(_DAMAGE.findall(text)) / solid if beyond else 0.0
    return [
        len(low), sum(map(len, low)) / max(1, len(low)), letters / solid, digits / solid, max(0.0, (solid - letters - digits) / solid), upper / max(1, letters),
        sum(stopped) / max(1, n), common_share, distinct / max(1, len(low)), len(seen) / max(1, n), total / max(1, n), max(map(len, text.split()), default=0),
        marks / max(1, len(low)), item / chars, bare / chars, row / chars, junk / chars, repeat / chars, damage, salad / chars,
        *_form(text, b, letters - beyond, real, lengths),
    ]


def weak_label(x: list[float]) -> int | None:
    """The kind a text's shares point to, as an index of KINDS; None where they point to nothing clear."""
    f = dict(zip(FEATURES, x))
    shares = (f["item_share"] + f["bare_item_share"], f["row_share"], f["junk_line_share"] + f["repeat_share"] + f["salad_share"])
    best = int(np.argmax(shares))
    if shares[best] > 0.5:
        return best + 1
    if f["damage_share"] > 0.08:
        return 3
    return 0 if shares[best] < 0.47 else None


def _word_lists(common_words: DataFrame, limit: int = 20_000) -> dict[str, frozenset]:
    """The frequent words of each language (a fixed table; more than ``limit`` rows are refused)."""
    rows = common_words.select("lang", F.lower("word").alias("word")).dropna().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"common_words has more than {limit} rows")
    lists: dict[str, set] = {}
    for r in rows:
        lists.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in sorted(lists.items())}


def decided(p: np.ndarray) -> np.ndarray:
    """The kind of each row of calibrated probabilities: the likeliest structure if all of them together have a half, else prose."""
    return np.where(1 - p[:, 0] >= 0.5, 1 + p[:, 1:].argmax(1), 0) if len(p) else np.zeros(0, int)


def _feature_batches(common: dict[str, frozenset], model=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t or "", common) for t in batch.column(1).to_pylist()]
            x = np.array(rows, float).reshape(-1, len(FEATURES))
            arrays, names = [batch.column(0).cast(pa.int64())], ["doc_id"]
            if model is not None:
                p = model.value.predict(x[:, INPUTS])
                best = decided(p)
                arrays += [pa.array([KINDS[k] for k in best]), pa.array(p[np.arange(len(p)), best] if len(p) else np.empty(0))]
                names += ["kind", "probability"]
            arrays += [pa.array(x[:, j]) for j in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *FEATURES])

    return run


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics named in FEATURES, one row per document; null and empty texts have zeros."""
    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return documents.select("doc_id", "text").mapInArrow(_feature_batches(_word_lists(common_words)), schema)


def train(documents: DataFrame, common_words: DataFrame, limit: int = TRAIN_DOCUMENTS) -> BoostedTrees:
    """Trees fitted on at most ``limit`` weakly labelled documents and calibrated on documents checked by hand."""
    common = _word_lists(common_words)
    sample = bounded_sample(documents.select("doc_id", "text"), "text", limit)
    rows = document_statistics(sample, common_words).select(*FEATURES).collect()
    labelled = [(list(r), y) for r in rows if (y := weak_label(list(r))) is not None]
    # Texts made by hand keep every kind present in a small sample.
    data = labelled + [(text_features(t, common), KINDS.index(k)) for t, k in EXAMPLES]
    model = BoostedTrees.fit(np.array([x for x, _ in data])[:, INPUTS], np.array([y for _, y in data]), len(KINDS))
    return calibrate(model, np.array([text_features(t, common) for t, _ in CHECKED])[:, INPUTS], np.array([KINDS.index(k) for _, k in CHECKED]))


def document_kinds(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id``, ``kind`` (prose, list, table or junk), its calibrated ``probability``, and the statistics.

    Every document has one row, repeated ones included; null and empty texts count as prose, having nothing else in them.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, common_words))
    schema = "doc_id long, kind string, probability double, " + ", ".join(f"{f} double" for f in FEATURES)
    judged = documents.select("doc_id", "text").mapInArrow(_feature_batches(_word_lists(common_words), model), schema)
    return judged.withColumn("kind", F.when((F.col("n_words") == 0) & (F.col("symbol_ratio") == 0) & (F.col("digit_ratio") == 0), "prose").otherwise(F.col("kind")))


def structural_documents(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id``, ``kind`` of the documents of which more than half is a list, a table or junk."""
    return document_kinds(documents, common_words).filter("kind <> 'prose'").select("doc_id", "kind")
