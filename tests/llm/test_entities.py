from deponent.llm import entities as E

GIVEN = frozenset(E.SHORT_NAMES)
FAMILY = frozenset({"dallimorn", "zamoreno", "harrowden", "kalverson"})
R = E.Resolver(GIVEN, FAMILY, {k: frozenset(v.split()) for k, v in E.SHORT_NAMES.items()})


def groups(names, parties=()):
    return sorted(g for g in R.resolve(sorted(names), list(parties)) if g)


def test_spellings_of_people():
    names = ["Guillermo Harrowden", "GUILLERMO HARROWDEN", "Harrowden, Guillermo", "Guillermo B. Harrowden", "Memo Harrowden", "memo.harrowden", "GuillermoHarrowden", "Guillermo Harrowden (Mobile)", "Guilelrmo Harrowden", "G. Harrowden", "GB Harrowden", "Guillermo H.", "Memo", "Atty. Guillermo Harrowden"]
    assert groups(names) == [sorted(names)]


def test_relatives_stay_apart():
    got = groups(["Julian Dallimorn", "Juliana Dallimorn", "Julian Dalimorn", "juliana_dallimorn24", "J. Dallimorn", "Dallimorn", "Juliet"])
    assert got == [["Dallimorn"], ["J. Dallimorn"], ["Julian Dalimorn", "Julian Dallimorn"], ["Juliana Dallimorn", "Juliet", "juliana_dallimorn24"]]


def test_organisations():
    a = ["Meridian Savings International", "Meridian Savings Intl.", "Meridian Savings", "M.S.I.", "MSI", "International Savings Meridian", "MeridianSavings", "The Meridian Savings International, Inc.", "Meridian Savngs International"]
    b = ["Meridian Claims Management", "Meridian Claims Mgmt"]
    assert groups([*a, *b]) == sorted([sorted(a), sorted(b)])


def test_nobody_is_linked():
    assert groups(["Unknown", "unknown ", "Speaker 1", "SPEAKER_00", "S01", "", "?", "Daniel Zamoreno"]) == [["Daniel Zamoreno"]]


def test_aliases_of_parties_link_what_spelling_cannot():
    assert groups(["Bud", "Daniel Zamoreno"], [("Daniel Zamoreno", ["Bud"])]) == [["Bud", "Daniel Zamoreno"]]


def test_merging_brings_new_matches():
    # "Dani" is known only through the bracketed form, and the initials only once that is merged.
    got = groups(["Daniela Kalverson (Nella)", "Daniela Kalverson", "Nella Kalverson", "Nella"])
    assert got == [["Daniela Kalverson", "Daniela Kalverson (Nella)", "Nella", "Nella Kalverson"]]


def test_distances():
    assert E.distance("daniela", "danieal") == 1 and E.distance("abc", "abc") == 0 and E.distance("abcd", "x", 2) == 3
    assert E.near("abc", "abd") is None and E.near("kalverson", "kalvers0n") == 1


def test_held_out_aliases(spark):
    """Aliases of parties are linked to their owner from the spelling alone."""
    people = spark.read.parquet("/root/testdata/sf0.01/case_participants.parquet")
    given, family = E._lexicons(people)
    r = E.Resolver(given, family, {k: frozenset(v.split()) for k, v in E.SHORT_NAMES.items()})
    cases: dict = {}
    for p in people.collect():
        cases.setdefault(p.case_id, []).append((p.full_name, [a for a in p.aliases or [] if a]))
    linked = total = mixed = 0
    for parties in cases.values():
        owner: dict = {}
        for full, aliases in parties:
            for a in (full, *aliases):
                owner.setdefault(a, set()).add(full)
        found = r.resolve(sorted(owner), [(f, []) for f, _ in parties])
        where = {n: k for k, g in enumerate(found) for n in g}
        mixed += sum(len({next(iter(owner[n])) for n in g if len(owner[n]) == 1}) > 1 for g in found)
        for full, aliases in parties:
            for a in aliases:
                if a != full and len(owner[a]) == 1:
                    total += 1
                    linked += where.get(a) == where.get(full)
    assert linked >= 0.97 * total and mixed == 0


def test_pairs_of_a_table(spark):
    rows = [("c", "Daniel Zamoreno", "Unknown"), ("c", "daniel zamoreno", None), ("c", "daniel zamoreno", ""), ("d", "Daniel Zamoreno", "D. Zamoreno"), (None, "Daniel Zamoreno", "Dan")]
    df = spark.createDataFrame(rows, "case_id string, sender string, receiver string")
    people = spark.createDataFrame([("c", "Daniel Zamoreno", "witness", None, "x"), ("e", None, None, None, "x")], "case_id string, full_name string, case_role string, aliases array<string>, sender string")
    got = sorted(tuple(r) for r in E.linked_pairs(df, people).collect())
    assert got == [("c", "Daniel Zamoreno", "daniel zamoreno"), ("d", "D. Zamoreno", "Daniel Zamoreno")]
    assert E.linked_pairs(df.limit(0), people).count() == 0
    assert E.entities(df, people.limit(0)).filter("case_id = 'c'").count() == 2


def test_profiles_hold_initials_and_parties_reenter():
    p, q = (R.profile(E.Spelling(n, GIVEN, FAMILY)) for n in ("Daniela Kalverson", "D. Kalverson"))
    q.absorb(p)
    assert {"dk"} <= q.initials and len(q.spellings) == 2 and ".dk" in R.keys(q)
    # The party's alias fits a spelling whose own words fit another short name as well.
    assert groups(["Tinay Brightlow", "tinay.brightlow", "Teresita Brightlow"], [("Teresita Brightlow", ["Tinay Brightlow"])]) == [["Teresita Brightlow", "Tinay Brightlow", "tinay.brightlow"]]
