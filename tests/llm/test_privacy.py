import pytest

from deponent.llm import privacy as P
from deponent.llm.names import lexicon

FINDER = P.Finder(frozenset({"martina", "daniel", "daniela", "frederick"}), frozenset({"salvaleon", "ostranel", "kalverson"}), frozenset({"dani", "will", "mon"}))

CASES = [
    ("my email is daniel-nard@quickmail.invalid, please", [("email", "daniel-nard@quickmail.invalid")]),
    ("write rosa at mailbox dot example or r.o (at) box (dot) test", [("email", "rosa at mailbox dot example"), ("email", "r.o (at) box (dot) test")]),
    ("meet at noon, dot the form", []),
    ("call +63 915 555 0189 or 0927 555 01 59", [("phone", "+63 915 555 0189"), ("phone", "0927 555 01 59")]),
    ("(02) 8555 0138, +1 (202) 555-0140 and 555-0167 ext. 50", [("phone", "(02) 8555 0138"), ("phone", "+1 (202) 555-0140"), ("phone", "555-0167 ext. 50")]),
    ("from zero nine one one five five five nine five nine two?", [("phone", "zero nine one one five five five nine five nine two")]),
    ("ref 7619-1645, order #318553, TRX-48529699, 72710175A, code 497002, USD 53708", []),
    ("here is my passport no.\nR94037723 ok", [("id_number", "R94037723")]),
    ("TIN 899-747-339-000, tax number 93 825 442 804, licence no NN051625", [("id_number", "899-747-339-000"), ("id_number", "93 825 442 804"), ("id_number", "NN051625")]),
    ("insurance number QQ 77 62 37 C is that enough", [("id_number", "QQ 77 62 37 C")]),
    ("I live at No. 295 Mabolo St., Brgy. Wrenfield", [("address", "No. 295 Mabolo St.")]),
    ("at Unit 23A, Mabolo Tower, 202 Rivermoor Close, Greyford", [("address", "Unit 23A, Mabolo Tower, 202 Rivermoor Close")]),
    ("Blk 6 Lot 2 Juniper Rise, Calle Molave 76, Narrastraße 49", [("address", "Blk 6 Lot 2 Juniper Rise"), ("address", "Calle Molave 76"), ("address", "Narrastraße 49")]),
    ("look for Dani", [("name", "Dani")]),
    ("Will you come on Mon or Tue?", []),
    ("Atty. Frederick A. Ostranel and Ostranel, Frederick", [("name", "Frederick A. Ostranel"), ("name", "Ostranel, Frederick")]),
    ("DANIELA KALVERS0N wrote", [("name", "DANIELA KALVERS0N")]),
    ("Dear Daniel,\nMartina's aunt", [("name", "Daniel"), ("name", "Martina")]),
    ("Regards,\nFrederick\nOstranel", [("name", "Frederick\nOstranel")]),
    ("from martina.salvaleon@letters.test", [("email", "martina.salvaleon@letters.test")]),
    ("Kalverson Trading Services", []),
    ("IBAN DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00", [("account", "DE89 3704 0044 0532 0130 00")]),
    ("account number 1234567890123, card 4111 1111 1111 1111 or 4111 1111 1111 1112", [("account", "1234567890123"), ("account", "4111 1111 1111 1111")]),
    ("call 5550142 or call me at 555 0142, not 5550143", [("phone", "5550142"), ("phone", "555 0142")]),
    ("I moved from 14 rose lane, 5 minutes down the road", [("address", "14 rose lane")]),
    ("at 14 Rose Lane. Then 2 Elm St. was shut", [("address", "14 Rose Lane"), ("address", "2 Elm St.")]),
    ("SSN 999-99-9999 123-45-6789", [("id_number", "999-99-9999"), ("id_number", "123-45-6789")]),
    ("mailto:a.b@c.test, http://x.test/+639155550189 and tel:+639155550189", [("email", "a.b@c.test"), ("phone", "+639155550189")]),
    ("x@" + "y" * 200 + ".test", [("email", "x@" + "y" * 200 + ".test")]),
    ("w" * 300 + "@box.test", [("email", "w" * 300 + "@box.test")]),
    ("see me @ Noon. Then (+63 915 555 0189)", [("phone", "+63 915 555 0189")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_finds(text, want):
    assert [(k, text[a:b]) for k, a, b in FINDER.find(text)] == want


STRANGERS = [
    ("Dear Ramona Montefalko, please call", ["Ramona Montefalko"]),
    ("my name is Roberto A. Dumayagan and I paid", ["Roberto A. Dumayagan"]),
    ("It was addressed to Mr Hinterman.", ["Hinterman"]),
    ("the contact person Martina Hinterman was away", ["Martina Hinterman"]),
    ("This is Angelica Hinterman from Silverpine", ["Angelica Hinterman"]),
    ("I paid.\nSincerely,\nEduarda Zubirando", ["Eduarda Zubirando"]),
    ("DEAR RAMONA MONTEFALKO", ["RAMONA MONTEFALKO"]),
    ("Dear Daniel Please call", ["Daniel"]),
    ("Dear Customer, addressed to Meridian Consumer Complaints Unit, hi PHP 500", []),
    ("Dear Sir or Madam, this is Important. I am Sorry.\nRegards,\nPage 3", []),
    ("money from Lower Penhurst; dear me", []),
    ("My name is Priyanka Okonkwo", ["Priyanka Okonkwo"]),
    ("Dear Mr. Okonkwo, hello", ["Okonkwo"]),
    ("this is R. Dallimorn from Oakstone, receiver is Wexcombe, Alexander / paid", ["R. Dallimorn", "Wexcombe, Alexander"]),
    ("please tell Samuela I came. Maximus Wexcombe visited us.\nSamuela, please answer", ["Samuela", "Maximus Wexcombe", "Samuela"]),
    ("The Officer said it. Silverpine Payout Department said no. For the record, Greyford, a town", []),
]


def test_names_that_no_party_has(spark):
    """Recall and precision of names of which no word is in the lexicon, against what the whole lexicon finds."""
    given, family, short = lexicon(spark.read.parquet("/root/testdata/sf0.1/case_participants.parquet"))
    hidden = {w for k, w in enumerate(sorted(given | family)) if k % 5 == 0}
    whole, part = P.Finder(given, family, short), P.Finder(given - hidden, family - hidden, short - hidden)
    found = total = extra = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/mass_extract.parquet").filter("row_id % 4 = 0").select("message").collect():
        if not r.message:
            continue
        ours = {a for k, a, _ in part.find(r.message) if k == "name"}
        want = [(a, r.message[a:b].lower().replace("\n", " ").split()) for k, a, b in whole.find(r.message) if k == "name"]
        extra += len(ours - {a for a, _ in want})
        for a, words in want:
            words = {w.strip(".,'") for w in words if len(w.strip(".,")) > 1}
            if words & hidden and not words & ((given | family | short) - hidden):
                total += 1
                found += a in ours
    assert total > 50 and found >= 0.9 * total and extra <= 0.1 * total, (found, total, extra)


@pytest.mark.parametrize(("text", "want"), STRANGERS)
def test_introduced_strangers(text, want):
    assert [text[a:b] for k, a, b in FINDER.find(text) if k == "name"] == want


def test_given_names_without_a_party(spark):
    people = spark.createDataFrame([("c", "Daniel Kalverson", "witness", None)], "case_id string, full_name string, case_role string, aliases array<string>")
    rows = spark.createDataFrame([(1, "please tell Eduardo I came"), (2, "did Guillermo Farnbrook really call?")], "row_id long, message string")
    got = {r.row_id: r.message for r in P.redacted(rows, people).collect()}
    assert got == {1: "please tell [NAME] I came", 2: "did [NAME] really call?"}


@pytest.mark.parametrize("parties", [1, 450])
def test_aliases_seen_once_at_any_size(spark, parties):
    letters = "".join(chr(97 + k) for k in range(26))
    names = [f"Q{letters[n // 26]}{letters[n % 26]}uvorre Z{letters[n // 26]}{letters[n % 26]}ammilo" for n in range(parties)]
    rows = [("c", "Daniel Kalverson", "witness", ["Bongbong", "Kalverzon", "Danile"]), *[("c", n, "witness", None) for n in names]]
    short = lexicon(spark.createDataFrame(rows, "case_id string, full_name string, case_role string, aliases array<string>"))[2]
    assert "bongbong" in short and not {"kalverzon", "danile"} & short


def test_positions_over_broken_lines():
    text = "I met Daniel Kalver-\nson at home 😀 and Martina"
    found = FINDER.find(text)
    assert [text[a:b] for _, a, b in found] == ["Daniel Kalver-\nson", "Martina"]


def test_replacement_keeps_the_rest(spark):
    rows = [(1, "call Daniel on +63 915 555 0189!", 1), (2, None, 1), (3, "", 1), (4, "nothing", 1), (4, "nothing", 1), (5, "x" * 100_000 + " Daniel Kalverson", 1)]
    df = spark.createDataFrame(rows, "row_id long, message string, start_pos int")
    people = spark.createDataFrame([("c", "Daniel Kalverson", "witness", ["Dani"]), ("c", "Acme Trading Services", "organisation", None), ("c", None, None, None)], "case_id string, full_name string, case_role string, aliases array<string>")
    got = {r.row_id: (r.message, r.n_replaced) for r in P.redacted(df, people).collect()}
    assert got[1] == ("call [NAME] on [PHONE]!", 2) and got[2] == (None, 0) and got[3] == ("", 0) and got[4] == ("nothing", 0) and got[5] == ("x" * 100_000 + " [NAME]", 1)
    found = sorted(tuple(r) for r in P.personal_data(df, people).select("row_id", "pii_type", "start_pos").collect())
    assert found == [(1, "name", 6), (1, "phone", 16), (5, "name", 100_002)]
    assert P.personal_data(df.limit(0), people).count() == 0 and P.personal_data(df, people.limit(0)).filter("pii_type = 'name'").count() == 0
