import numpy as np

from deponent.llm import quality as Q
from deponent.llm.quality_examples import EXAMPLES
from deponent.llm.trees import BoostedTrees, calibrate, calibration_error

# Labelled by hand; none of them is used in training or calibration.
HELD_OUT = [
    ("The agent called twice on Monday. Nobody knew whether the parcel had arrived, and the office stayed shut.", "prose"),
    ("Dear Ann,\n\nThe letter reached me late.\n\nRegards,\nBen", "prose"),
    ("13:16 - Ann Lee - Did you see the form?\n13:18 - Ben Moss - I did, it was on the desk.\n13:19 - Ann Lee - Then please sign it", "prose"),
    ("> On Friday the clerk wrote that the form\n> was lost. We asked for a copy, and she\n> promised to send one.", "prose"),
    ("* the blue form\n* a copy of the lease\n* Ann Lee, York\n* 20 pounds / Monday", "list"),
    ("1) the form\n2) a stamp\n3) the receipt\n4) a pen\n5) the old letter", "list"),
    ("a spare key\nthe green lamp\n20 pounds / Monday\nAnn Lee, York\nthe long table\nthe second chair", "list"),
    ("town;day;n\nYork;Monday;3\nHull;Friday;4\nLeeds;Sunday;9", "table"),
    ("| a | 12 | 3 |\n|---|---|---|\n| b | 15 | 4 |\n| c | 19 | 5 |", "table"),
    ("REF     TOWN      N\nA12     York      3\nB19     Hull      14\nC77     Leeds     9", "table"),
    ("Back\nHome\nNext\nBack\nShare\nHome\nBack\nNext\nHelp", "junk"),
    ("::::\n||||\n~~~~~~\n......\n[][][]\n,,,,,", "junk"),
    ("aGk3Lm9QzX0pRtVbYw2NcDf7HsSeUiOo5TtKk6AaBbZzXxVvQ1qWwEeRrTtYy/UuIi+OoPpLlKk==", "junk"),
    ("qwzx plmk; vbnt/hgf dsa.rtew, ncv bmk;qaz wsx/edc rfv.tgb yhn ujm,ik plo zxq", "junk"),
]


def test_held_out_texts(spark):
    words = spark.read.parquet("/root/testdata/sf0.001/common_words.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = Q.train(docs, words)
    common = Q._word_lists(words)
    p = model.predict(np.array([Q.text_features(t, common) for t, _ in HELD_OUT])[:, Q.INPUTS])
    assert sum(Q.KINDS[k] == y for k, (_, y) in zip(Q.decided(p), HELD_OUT)) >= len(HELD_OUT) - 1
    assert np.allclose(p.sum(1), 1)
    # The trees do not see the shares that made their labels, and agree with them on documents they were not fitted on.
    assert not {Q.FEATURES[k] for k in Q.INPUTS} & set(Q.STRUCTURE)
    x = np.array([list(r)[1:] for r in Q.document_statistics(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 5 = 0"), words).collect()])
    y = np.array([-1 if (k := Q.weak_label(r)) is None else k for r in x.tolist()])
    x, y = x[y >= 0], y[y >= 0]
    p = model.predict(x[:, Q.INPUTS])
    for kind in range(4):
        assert (Q.decided(p)[y == kind] == kind).mean() >= 0.95, Q.KINDS[kind]
    assert calibration_error(p, y) <= 0.03


def test_calibration_moves_the_decision():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + 0.8 * rng.normal(size=400) > 0).astype(int)
    m = BoostedTrees.fit(x[:200], (y[:200] | (rng.random(200) < 0.4)).astype(int), 2, rounds=20, depth=3)  # labels that lean to one class
    before, error = m.predict(x[300:]).argmax(1), calibration_error(m.predict(x[300:]), y[300:])
    calibrate(m, x[200:300], y[200:300])
    after = m.predict(x[300:])
    assert (after.argmax(1) != before).any() and calibration_error(after, y[300:]) < error and (after.argmax(1) == y[300:]).mean() >= (before == y[300:]).mean()


def test_statistics_of_odd_texts(spark):
    common = {"en": frozenset(["the", "a"])}
    x = dict(zip(Q.FEATURES, Q.text_features("The cat saw a dog. 12 %\nThe end", common)))
    assert x["n_words"] == 7 and round(x["common_share"], 3) == round(3 / 7, 3) and x["line_ratio"] == 1.0 and x["mean_word_length"] == 19 / 7
    assert Q.text_features("", common) == Q.text_features(" \n ", common) == [0.0] * len(Q.FEATURES)
    assert all(np.isfinite(Q.text_features(t, common)).all() for t in ("\ud800", "…", "a" * 200_000, "\t\t", "é" * 50, "| |\n| |"))


def test_every_document_has_one_row(spark):
    words = spark.read.parquet("/root/testdata/sf0.001/common_words.parquet")
    docs = spark.createDataFrame([(1, EXAMPLES[0][0], "x"), (2, None, "x"), (3, "", "x"), (3, EXAMPLES[2][0], "x"), (4, EXAMPLES[6][0], "x")], "doc_id long, text string, kind string")
    got = Q.document_kinds(docs, words)
    assert got.count() == 5 and {r.doc_id: r.kind for r in got.collect()}[2] == "prose"
    assert Q.structural_documents(docs.limit(0), words).count() == 0
    assert Q.document_statistics(docs, words).count() == 5


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.5).astype(int)
    m = calibrate(BoostedTrees.fit(x[:400], y[:400], 4, rounds=15, depth=3), x[400:500], y[400:500])
    assert (m.predict(x[500:]).argmax(1) == y[500:]).mean() > 0.93
    assert m.predict(x[:0]).shape == (0, 4)
