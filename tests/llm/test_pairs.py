"""Defects of pairs on hand-made cases."""

from foliant.llm import pairs

Q = "Which surety did the board of Acme Foods release after the overdue levy of INR 9,100 dated 3 May 2011?"
G = "Wie hoch ist die Gebühr, die Acme Foods laut Vertrag an den Versicherer zahlt und wann ist sie fällig?"


def test_suffix_automaton_stretches():
    a = pairs.SuffixAutomaton("abcdefgh")
    assert a.stretches("xxabcdexcdefgh", 4) == [(2, 7), (8, 14)] and a.stretches("", 1) == []


def test_defects(spark):
    whole = "The board of Acme Foods must release the surety within 9 days of the levy."
    rows = [
        (1, Q, None, "empty"),
        (2, Q, " <p></p>​", "empty"),
        (3, Q, "N/A", "empty"),
        (4, Q, Q.upper(), "copied"),
        (5, Q, "Question: " + Q + " " + Q, "copied"),
        (6, Q, 'Regarding your question, "' + Q + '": ' + whole, None),
        (7, Q, "Thanks. I'm unable to share details of the levy.", "refusal"),
        (8, Q, "Acme Foods refused to release the surety, and the board is unable to extend the levy of the board.", None),
        (9, G, whole, "wrong_language"),
        (10, Q, "Für die Rechnung zahlt der Notar an Acme einen Betrag von INR 10.", "wrong_language"),
        (11, Q, 'The clause titled "die neue Frist der Gebühr" applies: ' + whole, None),
        (12, Q, whole[:-1], None),
        (13, Q, whole[:40], "truncated"),
        (14, Q, whole[:-1].rsplit(" ", 1)[0], "truncated"),
        (15, Q, whole + " The board of Acme Foods must,", "truncated"),
        (16, Q, "INR 9,100", None),
        (17, None, whole, None),
        (18, None, None, "empty"),
        (19, "", "...", "empty"),
        (20, Q, whole * 3000, None),
        (21, Q, "The board of Acme Foods (see", "truncated"),
        (22, Q, "<p>&nbsp;</p>" * 40, "empty"),
        (23, Q, "n/a " + "." * 90, "empty"),
        (24, Q, "The tenant wrote that I cannot assign the lease without consent of the board.", None),
        (25, Q, "Unfortunately, I cannot comment on the levy.", "refusal"),
        (26, Q, "I regret that I cannot comment on the levy.", "refusal"),
        (27, Q, whole[:-1] + " and: 1)", "truncated"),
    ]
    rows += [(100 + i, Q, x, None) for i, x in enumerate([whole] * 4 + ["INR 9,100."] * 4 + ["INR 8,200"] * 6)]
    df = spark.createDataFrame([("s", i, q, a, "x", "y") for i, q, a, _ in rows] + [("s", 1, Q, None, "x", "y"), ("s", None, Q, None, "x", "y")], "src string, row_id bigint, question string, answer string, defect string, tail string")
    got = {r.row_id: r.defect for r in pairs.broken_pairs(df).collect()}
    assert got == {i: d for i, _, _, d in rows if d}
    assert pairs.broken_pairs(df.limit(0)).count() == 0
