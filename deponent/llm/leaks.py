"""Held-out passages inside corpus documents, by winnowing (problem 7).

Every text becomes words and every run of K words a hash; of each W neighbouring hashes the smallest is kept. Any K + W - 1
words shared unchanged then share a kept hash. Twenty words of which at most one in eight is changed always hold six
neighbouring unchanged ones, so with K = 5 and W = 2 no case is missed. Kept hashes of corpus and passages are joined, and
from every run of K words that a document and a passage so joined share the alignment is carried on to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.llm.text import plain_words
from deponent.session import checkpointed, lookup_join

#: Words in a hashed run, and neighbouring hashes of which one is kept.
K, W = 5, 2
#: Shortest shared span in words of the passage, and words to each allowed change.
SPAN, PER_CHANGE = 20, 8
#: The set of passage hashes is sent to the tasks as a filter up to this many; beyond it all corpus hashes are joined.
FILTER_HASHES = 4_000_000
_CHUNK_CHARS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hash of each word, kept for words seen before; emptied when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _winnow(docs: list[list[str]], known: _WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept hashes of some documents: index of the document, position of the run's first word, hash."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(lengths)
    words = np.fromiter((h for d in docs for h in map(known.__getitem__, d)), np.uint64, int(ends[-1]) if len(docs) else 0)
    empty = np.empty(0, np.int64)
    if len(words) < K:
        return empty, empty, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        runs = np.zeros(len(words) - K + 1, np.uint64)
        for j in range(K):
            runs = runs * _MIX + words[j : len(words) - K + 1 + j]
        runs ^= runs >> np.uint64(31)
        runs *= _MIX
    doc = np.repeat(np.arange(len(docs)), lengths)
    at = np.arange(len(words)) - np.repeat(ends - lengths, lengths)
    inside = doc[: len(runs)] == doc[K - 1 :]
    largest = np.uint64(0xFFFFFFFFFFFFFFFF)
    runs[~inside] = largest
    kept = np.zeros(len(runs), bool)
    # A run is kept if it is the smallest (the last of equal ones) of some window of W runs; a short text keeps its smallest.
    n = len(runs)
    for start in range(-(W - 1), 1):
        best = np.ones(n, bool)
        for j in range(start, start + W):
            if j == 0:
                continue
            other = np.full(n, largest)
            if j > 0:
                other[:-j] = runs[j:]
                best &= runs < other if j > 0 else best
            else:
                other[-j:] = runs[:j]
                best &= runs <= other
        kept |= best
    kept &= inside
    where = np.flatnonzero(kept)
    return doc[where], at[where], runs[where]


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, list[list[str]]]]:
    keys, docs, size = [], [], 0
    for i, t in zip(ids, texts):
        if t:
            keys.append(i)
            docs.append(plain_words(t))
            size += len(t)
            if size > _CHUNK_CHARS:
                yield keys, docs
                keys, docs, size = [], [], 0
    if docs:
        yield keys, docs


def fingerprints(df: DataFrame, key: str, text: str, only: np.ndarray | None = None) -> DataFrame:
    """Kept hashes by text: ``key``, ``words`` (normalised, joined by blanks), ``hits`` array of (hash, pos).

    With ``only``, a sorted array of hashes, just hits on it and texts with such are given. Null and empty texts, and those
    shorter than K words, have no rows.
    """
    shared = None if only is None else df.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        wanted = None if shared is None else shared.value
        if wanted is not None:
            bits = np.zeros(1 << 22, bool)
            bits[(wanted >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            for keys, docs in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, at, hashes = _winnow(docs, known)
                if wanted is not None:
                    near = np.flatnonzero(bits[(hashes >> np.uint64(42)).astype(np.int64)])
                    doc, at, hashes = doc[near], at[near], hashes[near]
                    if len(wanted) and len(hashes):
                        hit = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes
                        doc, at, hashes = doc[hit], at[hit], hashes[hit]
                if not len(doc):
                    continue
                named, first = np.unique(doc, return_index=True)
                offsets = pa.array(np.append(first, len(doc)), pa.int32())
                structs = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32))], ["hash", "pos"])
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in named], pa.int64()), pa.array([" ".join(docs[i]) for i in named]), pa.ListArray.from_arrays(offsets, structs)], [key, "words", "hits"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, words string, hits array<struct<hash:long,pos:int>>")


def _reach(a: list, i: int, b: list, j: int, step: int, most: int) -> list[int]:
    """How many words of ``a``, from place i on in direction ``step``, stand in ``b`` from place j on, with 0 to ``most`` changes."""
    rest_a, rest_b = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    front, out = {0: 0}, []  # furthest word of ``a`` by how many more words of ``b`` are passed
    for e in range(most + 1):
        if e:
            ahead: dict[int, int] = {}
            for k, x in front.items():
                if x < rest_a:
                    ahead[k - 1] = max(ahead.get(k - 1, 0), x + 1)
                    if x + k < rest_b:
                        ahead[k] = max(ahead.get(k, 0), x + 1)
                if x + k < rest_b:
                    ahead[k + 1] = max(ahead.get(k + 1, 0), x)
            front = ahead
        for k, x in front.items():
            while x < rest_a and x + k < rest_b and a[i + step * x] == b[j + step * (x + k)]:
                x += 1
            front[k] = x
        out.append(max([*front.values(), *out[-1:]]))
    return out


def _run_length(span: int, per_change: int) -> int:
    """Neighbouring unchanged words that any span from ``span`` to twice as many words holds, but at most K."""
    return min(K, *(-(-(n - n // per_change) // (n // per_change + 1)) for n in range(span, 2 * span)))


def _runs(words: list, n: int) -> dict[tuple, list[int]]:
    """Places of each run of ``n`` words."""
    found: dict[tuple, list[int]] = {}
    for at, run in enumerate(zip(*(words[k:] for k in range(n)))):
        found.setdefault(run, []).append(at)
    return found


def repeats(document: list[str], passage: list[str], span: int = SPAN, per_change: int = PER_CHANGE, runs: dict[tuple, list[int]] | None = None) -> bool:
    """Whether some ``span`` or more consecutive words of the passage stand in the document with at most one change to ``per_change`` words.

    A span of twice ``span`` words or more has a half that is good by itself, so changes are few; each good span holds a run of
    unchanged words. From every run that both texts share the alignment is carried on to both sides, whatever stands elsewhere.
    """
    n, most = _run_length(span, per_change), (2 * span - 1) // per_change
    runs = _runs(document, n) if runs is None else runs
    for p, run in enumerate(zip(*(passage[k:] for k in range(n)))):
        for d in runs.get(run, ()):
            if p and d and passage[p - 1] == document[d - 1]:
                continue  # part of a longer run
            after = _reach(passage, p, document, d, 1, most)
            before = _reach(passage, p - 1, document, d - 1, -1, most)
            if any(before[x] + after[y] >= max(span, per_change * (x + y)) for x in range(most + 1) for y in range(most + 1 - x)):
                return True
    return False


def _verified(words: pd.Series, passages: pd.Series) -> pd.Series:
    """The keys of those passages that the document repeats; ``passages`` holds arrays of (key, words)."""
    out = []
    for text, candidates in zip(words, passages):
        doc = text.split(" ")
        runs = _runs(doc, _run_length(SPAN, PER_CHANGE))
        out.append([c["key"] for c in candidates if repeats(doc, c["words"].split(" "), runs=runs)])
    return pd.Series(out)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id`` for every document that repeats at least SPAN words of an item's passage, up to one change in PER_CHANGE words.

    Items that share a passage are each given. Null and empty texts and passages give no rows; repeated documents are
    each judged; passages shorter than SPAN words cannot be repeated.
    """
    spark = documents.sparkSession
    texts = items.filter("passage is not null").groupBy("passage").agg(F.min("item_id").alias("key"))
    tests = checkpointed(fingerprints(texts, "key", "passage"))
    hashes = tests.select("key", F.explode("hits.hash").alias("hash")).distinct()
    n = hashes.count()
    only = None
    if n <= FILTER_HASHES:
        only = np.sort(np.array([r[0] for r in hashes.select("hash").distinct().toLocalIterator()], np.int64).view(np.uint64))
    corpus = fingerprints(documents, "doc_id", "text", only)
    corpus = checkpointed(corpus) if only is not None else corpus
    hits = corpus.select("doc_id", F.explode("hits.hash").alias("hash"))
    # Each side of a checked size is broadcast; a larger one meets salted rows, so a hash or passage that most documents hold is split.
    pairs = lookup_join(hits.distinct(), hashes, "hash", "inner").select("doc_id", "key").distinct()
    passages = lookup_join(pairs, tests.select("key", "words"), "key", "inner").groupBy("doc_id").agg(F.collect_list(F.struct("key", "words")).alias("passages"))
    texts_hit = corpus.groupBy("doc_id").agg(F.first("words").alias("words")) if only is None else corpus.select("doc_id", "words")
    found = texts_hit.join(passages, "doc_id").select("doc_id", F.explode(F.pandas_udf(_verified, "array<bigint>")("words", "passages")).alias("key"))
    members = lookup_join(items.filter("passage is not null"), texts, "passage", "inner").select("key", "item_id")
    return lookup_join(found, members, "key", "inner").select("doc_id", "item_id").distinct()
