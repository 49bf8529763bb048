import random

from deponent.llm import leaks as L
from deponent.llm.text import plain_words

WORDS = [f"w{n}x" for n in range(400)]


def changed(words, n, rng):
    out, span = [], len(words) // max(1, n)
    spots = {k * span + rng.randrange(span) for k in range(n)}
    for k, w in enumerate(words):
        if k in spots:
            out += rng.choice(([], ["other"], [w, "added"]))
        else:
            out.append(w)
    return out


def test_words_ignore_form():
    same = ["The “Old” harbour's <b>gate</b>, re-built", "the old HARBOURS gate REBUILT", "**The** old harbour’s gate re-\nbuilt", "Thе  оld hаrbours gate rebuilt", "the óld harbours gate rebuilt"]
    assert len({tuple(plain_words(t)) for t in same}) == 1
    assert plain_words("") == [] and plain_words("_ — *") == []


def test_every_span_with_few_changes_shares_a_kept_hash():
    rng, known = random.Random(5), L._WordHashes()
    for _ in range(300):
        n = rng.randrange(20, 70)
        passage = [rng.choice(WORDS) for _ in range(n)]
        doc = ["before"] * 3 + changed(passage, n // 8, rng) + ["after"] * 3
        _, _, a = L._winnow([passage], known)
        _, _, b = L._winnow([doc], known)
        assert set(a) & set(b)


def fewest_changes(document, passage):
    """Whether a span is repeated, by the edit distances of all spans of the passage to all places of the document."""
    for i in range(len(passage)):
        row = [0] * (len(document) + 1)
        for n, w in enumerate(passage[i:], 1):
            last, row = row, [n]
            for j, v in enumerate(document, 1):
                row.append(min(last[j - 1] + (v != w), last[j] + 1, row[j - 1] + 1))
            if n >= L.SPAN and min(row) * L.PER_CHANGE <= n:
                return True
    return False


def test_pieces_in_another_order():
    a, t = [f"a{n}" for n in range(1, 21)], [f"t{n}" for n in range(1, 9)]
    near = ["x" if w in ("a7", "a14") else w for w in a]
    assert L.repeats(t + near, a + t) and L.repeats(near[5:] + ["and"] + near, a + t)
    assert not L.repeats(t + ["x" if w in ("a6", "a11", "a16") else w for w in a], a + t)
    assert L._verified([" ".join(t + near)], [[{"key": 1, "words": " ".join(a + t)}]]).tolist() == [[1]]


def test_repeats_against_all_alignments():
    rng, seen = random.Random(8), []
    for _ in range(60):
        passage = [rng.choice(WORDS[:60]) for _ in range(rng.randrange(18, 42))]
        cut = rng.randrange(6, len(passage) - 6)
        doc = ["b"] * 2 + changed(passage[cut:], rng.randrange(1, 4), rng) + changed(passage[:cut], rng.randrange(1, 4), rng) + ["c"]
        seen.append(fewest_changes(doc, passage))
        assert L.repeats(doc, passage) == seen[-1]
    assert 10 < sum(seen) < 50


def test_found_leaks_and_their_items(spark):
    rng = random.Random(2)
    p = [[rng.choice(WORDS) for _ in range(60)] for _ in range(3)]
    noise = lambda n: [f"n{rng.randrange(999)}" for _ in range(n)]
    items = [(1, " ".join(p[0]), 0), (2, " ".join(p[0]), 0), (3, " ".join(p[1]), 0), (4, None, 0), (5, "", 0), (6, "too short", 0)]
    docs = [
        (1, " ".join(noise(40) + p[0][10:32] + noise(40))), (2, " ".join(noise(9) + p[1][0:15] + noise(9))), (3, " ".join(noise(5) + changed(p[1][20:60], 4, rng) + noise(5)).upper()),
        (4, None), (5, ""), (6, " ".join(p[0][:20]) + ". " + " ".join(p[1][:20])), (7, " ".join(p[2])), (1, " ".join(p[0])), (8, " ".join(w for k, w in enumerate(p[0]) if k % 4)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string, doc_id int")
    want = {(1, 1), (1, 2), (3, 3), (6, 1), (6, 2), (6, 3)}
    assert {tuple(r) for r in L.leaked_items(d, i).collect()} == want
    old, L.FILTER_HASHES = L.FILTER_HASHES, -1  # all corpus hashes joined
    try:
        assert {tuple(r) for r in L.leaked_items(d, i).collect()} == want
    finally:
        L.FILTER_HASHES = old
    assert L.leaked_items(d.limit(0), i).count() == 0
    assert L.leaked_items(d, i.limit(0)).count() == 0


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/eval_items.parquet")
    passages = {r.item_id: plain_words(r.passage) for r in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() if d.text for w in [plain_words(d.text)] for i, p in passages.items() if len(set(w) & set(p)) > 8 and L.repeats(w, p)}
    got = {tuple(r) for r in L.leaked_items(docs, items).collect()}
    assert got == want
