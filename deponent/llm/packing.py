"""Documents packed into containers of a fixed number of tokens (problem 6), by bin completion.

Documents are cut into blocks of a fixed number by a hash, and each block is packed by itself. Containers are filled one after
another, each around the largest document left, with fillings that no other filling found dominates. The first descent takes
the fullest filling each time and is the result where it meets the lower bound or is no worse than best-fit decreasing, which
gives the incumbent. Where neither meets the bound, a branch-and-bound search goes on: of the fillings of a container it tries
first the one after which the bound of what is left is least, and it gives up branches whose containers and bound (by waste,
by items too large to share, and by how many containers can hold three of their items) reach the incumbent's. The best
solution found is kept; a document is split only if it alone exceeds the capacity.

The search, not the result, is limited: by FILLINGS and BRANCH for each container and by DESCENTS for each block. Every
document is always placed.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A public byte-level vocabulary as ranks, and the tokens a container holds.
TOKENIZER_FILE, CAPACITY = "/opt/tokenizers/byte_bpe_50k.tiktoken", 4096
#: Items in one block, on average.
BLOCK_ITEMS = 4000
#: Fillings tried for one container, values tried at each place of a filling, and the search of a block in descents, at most.
FILLINGS, BRANCH, DESCENTS = 6, 3, 8
#: Fillings of more items than this are not compared for dominance.
COMPARED = 10
# Fixed value: how the vocabulary's public tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """``doc_id``, ``n_tokens``: tokens of each text; null and empty texts have none."""
    shared = documents.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        count = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(count(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], [key, "n_tokens"])

    return documents.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, n_tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; ``sizes`` fall, and containers list places in them."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for k, size in enumerate(sizes):
        at = bisect_right(room, (size, -1))
        if at == len(room):
            bins.append([k])
            insort(room, (capacity - size, len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append(k)
            insort(room, (left - size, b))
    return bins


def _bound(sizes: np.ndarray, capacity: int) -> float:
    """Containers that any packing of the rising ``sizes`` needs, before rounding up."""
    n = len(sizes)
    if not n:
        return 0.0
    total = np.concatenate(([0], np.cumsum(sizes)))
    best = total[-1] / capacity
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))  # from here on no two share a container
    best = max(best, float(n - half))
    for at in range(0, half, max(1, half // 24)):  # items of at least this size cannot go to the largest ones
        least = sizes[at]
        alone = max(int(np.searchsorted(sizes, capacity - least, side="right")), half)
        free = (alone - half) * capacity - (total[alone] - total[half])
        best = max(best, (n - alone) + (alone - half) + max(0.0, (total[half] - total[at] - free) / capacity))
    for k in range(2, 9):  # dual feasible functions
        x = sizes * (k + 1) / capacity
        whole = np.floor(x + 1e-12)
        best = max(best, float(np.where(np.abs(x - whole) < 1e-12, x / (k + 1), whole / k).sum()))
    quarter = int(np.searchsorted(sizes, capacity / 4, side="right"))  # from here on three at most share one
    some = n - quarter
    if some >= 3:
        threes = np.arange(1, some // 3 + 1)
        fit = total[quarter + 3 * threes] - total[quarter] <= threes * capacity
        most = float(threes[fit][-1]) if fit.any() else 0.0
        if fit.any() and most < some // 3:  # a part of one more, to guide the search
            j = int(most)
            gap = (total[quarter + 3 * j + 3] - total[quarter]) - (j + 1) * capacity
            spare = j * capacity - (total[quarter + 3 * j] - total[quarter])
            most += spare / (spare + gap) if spare + gap > 0 else 0.0
        best = max(best, (some - most) / 2)
    return float(best)


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by total size, by documents too large to share, and by how many can share."""
    return int(np.ceil(_bound(np.sort(np.asarray(sizes, float)), capacity) - 1e-9))


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` fit into containers of the sizes of ``a``: then ``a`` leaves nothing that is harder to pack."""
    if sum(a) < sum(b):
        return False
    room, items = list(a), sorted(b, reverse=True)

    def place(k: int) -> bool:
        if k == len(items):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= items[k] and r not in tried:
                tried.add(r)
                room[j] -= items[k]
                if place(k + 1):
                    return True
                room[j] += items[k]
        return False

    return place(0)


def fillings(room: int, sizes: list[int], spare: float, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with values of the rising list ``sizes`` that leave at most ``spare``, the fullest first."""
    found: set[tuple[int, ...]] = set()
    steps = 0

    def grow(chosen: tuple[int, ...], left: int, hi: int) -> bool:
        """Adds items of falling size; true once enough are found."""
        nonlocal steps
        at = min(hi, bisect_right(sizes, left))
        if at == 0:
            if left <= spare:
                found.add(chosen)
            return most == 1 and left == 0 or len(found) >= 4 * most or steps >= 60 * most
        k = at - 1
        for _ in range(BRANCH):
            if k < 0:
                break
            size = sizes[k]
            steps += 1
            if grow((*chosen, size), left - size, k):
                return True
            if left == size:
                break
            k = bisect_right(sizes, size - 1, 0, k + 1) - 1
        return False

    grow((), room, len(sizes))
    ranked = sorted(found, key=lambda c: (room - sum(c), len(c)))
    kept: list[tuple[int, ...]] = []
    for c in ranked:
        if len(kept) >= most:
            break
        if len(c) > COMPARED or not any(len(k) <= COMPARED and dominates(k, c) for k in kept):
            kept.append(c)
    return kept


def _without(left: list[int], chosen: tuple[int, ...]) -> list[int]:
    rest = left[:-1]
    for s in chosen:
        del rest[bisect_right(rest, s) - 1]
    return rest


def _first_descent(rising: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Every container around the largest item left with the fullest filling found."""
    left, out = rising, []
    while left:
        c = (fillings(capacity - left[-1], left[:-1], capacity, 1) or [()])[0]
        out.append((left[-1], *c))
        left = _without(left, c)
    return out


def _search(rising: list[int], capacity: int, best: list[tuple[int, ...]], bound: int, nodes: int) -> list[tuple[int, ...]]:
    """Branch and bound, depth first: the best packing found with so many containers filled, ``best`` if none is better."""
    path: list[tuple[int, ...]] = []

    def options(left: list[int]) -> list[tuple[float, int, tuple[int, ...], list[int]]]:
        largest, rest = left[-1], left[:-1]
        found = fillings(capacity - largest, rest, capacity)
        if rest:  # the fullest fillings of one, and of two items, are always among them: they keep small items for later
            for n in (1, 2):
                if (c := _few(capacity - largest, rest, n)) and c not in found:
                    found.append(c)
        out = []
        for c in found or [()]:
            after = _without(left, c)
            out.append((_bound(np.asarray(after, float), capacity), capacity - largest - sum(c), c, after))
        return sorted(out, key=lambda x: x[:3])

    stack = [[rising, options(rising), 0]]
    while stack and nodes > 0:
        left, ways, k = stack[-1]
        if k == len(ways):
            stack.pop()
            del path[len(stack) - 1 if stack else 0 :]
            continue
        stack[-1][2] += 1
        need, _, c, after = ways[k]
        if len(path) + 1 + int(np.ceil(need - 1e-9)) >= len(best):
            continue
        nodes -= 1
        path.append((left[-1], *c))
        if not after:
            best = list(path)
            if len(best) <= bound:
                break
            path.pop()
            continue
        stack.append([after, options(after), 0])
    return best


def _few(room: int, rising: list[int], n: int) -> tuple[int, ...] | None:
    """The fullest filling of exactly one or two items, or None."""
    if n == 1:
        at = bisect_right(rising, room)
        return (rising[at - 1],) if at else None
    lo, hi, top, got = 0, len(rising) - 1, -1, None
    while lo < hi:
        both = rising[lo] + rising[hi]
        if both > room:
            hi -= 1
        else:
            if both > top:
                top, got = both, (rising[hi], rising[lo])
            lo += 1
    return got


def complete(sizes: list[int], capacity: int, descents: int = DESCENTS) -> list[list[int]]:
    """Packs sizes of at most the capacity: containers as lists of places in ``sizes``. An empty list gives no containers."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    falling = [sizes[k] for k in order]
    incumbent = best_fit(falling, capacity)
    bound = lower_bound(falling, capacity)
    rising = falling[::-1]
    best = _first_descent(rising, capacity)
    if min(len(best), len(incumbent)) > bound:
        if len(incumbent) < len(best):
            best = [tuple(falling[k] for k in row) for row in incumbent]
        best = _search(rising, capacity, best, bound, descents * len(best))
    elif len(incumbent) < len(best):
        return [[order[k] for k in row] for row in incumbent]
    places: dict[int, list[int]] = {}
    for k, s in zip(order[::-1], rising):
        places.setdefault(s, []).append(k)
    return [[places[s].pop() for s in row] for row in best]


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer_file: str = TOKENIZER_FILE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id``, ``piece`` (from 0), ``n_tokens``, ``container``: every document, in one container unless it alone exceeds the capacity.

    A larger document is cut into pieces of the capacity and a rest. Documents without tokens take no room but have a row.
    """
    blocks = max(1, -(-documents.count() // block_items))
    sized = token_counts(documents, tokenizer_file=tokenizer_file)
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int"))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        where = [0] * len(pdf)
        for n, row in enumerate(complete(pdf["n_tokens"].tolist(), capacity)):
            for k in row:
                where[k] = n
        return pdf.assign(container=[f"{b}-{n}" for b, n in zip(pdf["block"], where)])[["doc_id", "piece", "n_tokens", "container"]]

    return pieces.groupBy("block").applyInPandas(pack, "doc_id long, piece int, n_tokens int, container string")
