import random

from deponent.llm import scans as S

PAGE = "The officer at the branch promised the voice recor-\nPg 6 / 20\nPrint view - Inbox\nding and asked whether the first page is mis-\nsing. She added that the witn3ss had kept the form."


def trained(spark):
    return S.prepared(spark.read.parquet("/root/testdata/sf0.01/mass_extract.parquet"))[1]


def test_operations():
    for read, meant in S.MISREADINGS:
        ops = S.operations(read, meant)
        assert len(ops) == len(read) and "".join(map(S._written, read, ops)) == meant
    e = S.Editor({"modern": 50, "second": 50, "burn": 20}, 120)
    assert ("modern", ((0, "replace m"), (1, "delete"), (2, "keep"))) not in e.readings("rnodern")
    assert e.readings("rnodern") == [("modern", ((0, "replace m"), (1, "delete")))]
    assert dict(e.readings("rnoclern")) == {"modern": ((0, "replace m"), (1, "delete"), (3, "replace d"), (4, "delete"))}
    assert e.readings("modern") == [] and e.readings("r") == [] and e.readings("") == []


def test_models(spark):
    r = trained(spark)
    seen = {S.shape_key("Print view - Inbox"): (9, 7)}
    assert set(r.defects(PAGE.replace("witn3ss", "witncss"), seen)) == {"hyphenation", "page_number", "header", "misread"}
    fixed = r.repair(PAGE.replace("witn3ss", "witncss"), seen)
    assert fixed == "The officer at the branch promised the voice recording and asked whether the first page is missing. She added that the witness had kept the form."
    for slip in ("I lost it alreday and I can't sleep", "gr8, c u l8r, paid b4 u asked", "your code is 748485", "a long-term plan for the well-written form", "see GX12560625Q and TRX-87926918"):
        assert r.defects(slip) == [], slip
    assert r.defects("748485\n12\nok\nhello po") == []
    # Held-out misreadings of known words, and the same words unchanged.
    rng = random.Random(9)
    words = [w for w, n in r.editor.counts.items() if n >= 30 and len(w) >= 6 and "-" not in w]
    hits = total = wrong = 0
    for w in rng.sample(sorted(words), 200):
        options = [(a, b) for a, b in S.MISREADINGS[:32] if b in w]
        if not options:
            continue
        a, b = rng.choice(options)
        total += 1
        got = r.editor.misread(w.replace(b, a, 1))
        hits += got == w
        wrong += got not in (None, w)
    assert hits >= 0.9 * total and wrong <= 0.03 * total
    assert sum(r.editor.misread(w) is not None for w in words) <= 0.01 * len(words)
    slips = [s for w in rng.sample(sorted(words), 200) for s in r.editor._slips(w, rng) if s.isalpha() and s not in r.editor.counts]
    assert sum(r.editor.misread(s) is not None for s in slips) <= 0.03 * len(slips)


def test_line_joins_are_predicted(spark):
    e, rng = trained(spark).editor, random.Random(3)
    words = sorted(w for w, n in e.counts.items() if n >= 10 and len(w) >= 7 and "-" not in w)
    cut = [(w, rng.randrange(2, len(w) - 2)) for w in rng.sample(words, 200)]
    assert sum(e.joins(w[:k], w[k:], "-", "none") for w, k in cut) >= 0.95 * len(cut)
    assert sum(e.joins(w[:k], w[k:], "-", "page") for w, k in cut) >= 0.95 * len(cut)
    assert e.joins("Monte", "falko", "-", "none")  # a name nobody knows
    assert not e.joins("long", "term", "-", "none") and not e.joins("first", "account", "-", "none")
    far = "The witness kept the voice recor-" + "\n\n" * 12 + "Page 3 of 9\n" + "ding in the office."
    pages = S.PageModel()
    pages.judge = lambda page: ["blank" if not x else "page_number" if x.startswith("Page") else "text" for x in page.lines]
    assert "voice recording in" in S.Repairer(pages, e).repair(far)  # however far the other half is


def test_recurring_misreadings_at_any_size(spark):
    counts = trained(spark).editor.counts
    meant = {"officcr": "officer", "accoiint": "account", "parccl": "parcel", "nurnber": "number"}
    recurring = {bad: counts[w] // 100 or 1 for bad, w in meant.items()}
    for times in (1, 10, 100, 1000):
        editor = S.Editor({w: n * times for w, n in (counts | recurring).items()}, 2_000_000 * times).train()
        assert {bad: editor.misread(bad) for bad in meant} == meant, times
        common = [w for w, n in counts.items() if n >= 30 and "-" not in w]
        assert sum(editor.misread(w) is not None for w in common) <= 0.01 * len(common)


def test_joins_over_furniture():
    kinds = ["text", "page_number", "blank", "header", "text"]
    assert S.joined_lines("the voice recor-\n- 9 -\n\nPrint\nding ended", kinds) == ("the voice recording\nended", 1)
    assert S.joined_lines("no break\nhere", None) == ("no break\nhere", 0)
    assert S.joined_lines("ends with recor-", None) == ("ends with recor-", 0)


def test_rows_with_nulls_and_repeats(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/mass_extract.parquet").select("row_id", "message")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n \n"), (-4, "a" * 50_000), (-5, PAGE), (-5, PAGE)], base.schema)
    got = S.repaired(base.union(odd))
    assert got.count() == base.count() + 6
    out = {r.row_id: r.message for r in got.filter("row_id < 0").collect()}
    assert out[-1] is None and out[-2] == "" and out[-4] == "a" * 50_000
    assert S.found_defects(base.limit(0)).count() == 0
