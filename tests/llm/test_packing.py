import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from deponent.llm import packing as K


def least(sizes, capacity):
    """The fewest containers, by trying every partition."""
    best = len(sizes)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity:
                put(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        put(k + 1, [*bins, sizes[k]])

    put(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=8))
def test_whole_and_least(sizes):
    got = K.complete(sizes, 100)
    assert sorted(itertools.chain.from_iterable(got)) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in b) <= 100 for b in got)
    assert len(got) >= K.lower_bound(sorted(sizes, reverse=True), 100)
    if sizes and len(sizes) <= 7:
        assert len(got) == least(sorted(sizes, reverse=True), 100)


def test_search_beats_best_fit():
    rng, better = random.Random(1), 0
    for _ in range(100):
        sizes = sorted((rng.randint(200, 700) for _ in range(40)), reverse=True)
        got, first = len(K.complete(sizes, 1000)), len(K.best_fit(sizes, 1000))
        assert got <= first
        better += got < first
    assert better >= 3


def test_completion_wins_on_blocks_of_real_size():
    """Sizes at which best-fit wastes much: the search must come near the bound within its budget."""
    rng = random.Random(5)
    for sizes, share in (([rng.randint(1100, 2000) for _ in range(1200)], 0.97), ([1400] * 50 + [1300] * 60 + [1396] * 40, 0.9)):
        got, first = K.complete(sizes, 4096), K.best_fit(sorted(sizes, reverse=True), 4096)
        assert sorted(itertools.chain.from_iterable(got)) == list(range(len(sizes))) and all(sum(sizes[k] for k in b) <= 4096 for b in got)
        assert len(got) <= share * len(first) and len(got) <= 1.02 * K.lower_bound(sizes, 4096) + 1


def test_dominance():
    assert K.dominates((70,), (40, 30)) and K.dominates((50, 40), (40, 30, 10)) and not K.dominates((40, 30), (70,)) and not K.dominates((50, 20), (35, 35))


def test_fillings_are_undominated():
    # 70 fills the room better than 30 and 40 together, which it could replace.
    assert (70,) in K.fillings(70, [10, 30, 40, 70], 70) and (40, 30) not in K.fillings(70, [10, 30, 40, 70], 70)


def test_documents(spark):
    long = "word " * 900
    docs = [(1, "a b c"), (2, None), (3, ""), (4, long), (5, "a b c"), (5, "a b c"), (6, "x y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("piece", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    got = K.packed(df, capacity=128, block_items=4).collect()
    counts = {r.doc_id: r.n_tokens for r in K.token_counts(df).collect()}
    assert sorted(r.doc_id for r in got if r.piece == 0) == [1, 2, 3, 4, 5, 5, 6]
    assert sum(r.n_tokens for r in got if r.doc_id == 4) == counts[4] and sum(r.doc_id == 4 for r in got) == -(-counts[4] // 128)
    fill: dict = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 128
    assert K.packed(df.limit(0)).count() == 0


def test_waste_on_real_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = K.packed(docs).groupBy("container").sum("n_tokens").collect()
    total = sum(r[1] for r in got)
    assert len(got) <= 1.02 * total / K.CAPACITY + 1
