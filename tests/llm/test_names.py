"""Spellings of people and organisations on hand-made cases."""

import time

import pandas as pd
import pytest

from foliant.llm import names

FORMS = [("William", "Bill"), ("Walter", "Wally"), ("Henry", "Harry"), ("Margaret", "Peggy"), ("Samuel", "Sam")]


def test_edits():
    assert names.within_one("abcd", "abdc") and names.within_one("abcd", "abd") and names.within_one("abcd", "xabcd") and names.within_one("abcd", "abxd")
    assert not names.within_one("abcd", "badc") and not names.within_one("abcd", "ab") and names.within_one("", "a")
    for a, b in [("abcdef", "abdcef"), ("abcdef", "abcef"), ("abcdef", "abxdef")]:
        assert names.deletions(a) & names.deletions(b)


def test_reading():
    forms = names.Forms(FORMS)
    for text in ("William Rasovu", "Rasovu, William", "RASOVU WILLIAM", "Bill Rasovu", "Adv. William Rasovu", "William Rasovu, Esq.", "Wílliam Rásovú", "WilliamRasovu", "William Ras ovu", "Wiliam Rasovu"):
        p = names.read_person(text, forms)
        assert (p["family"], p["given"], p["middle"]) == ("rasovu", "william", ""), text
    assert names.read_person("W.T. Rasovu", forms) == names.read_person("Rasovu, W. T.", forms) == {"family": "rasovu", "given": "", "first": "w", "middle": "t"}
    assert names.read_person("Dr.", forms) is None and names.read_organisation("Ltd.") is None
    want = names.read_organisation("Bomaru Engineering Development Limited")["family"]
    for text in ("The Bomaru Engg Devt", "Bomaru-Engineering-Development Pvt. Ltd.", "M/s Bomaru & Development & Engrg", "Bom Aru Development Engineering Ltd", "Engineering Development Bomaru LTD", "Bomaru Enginering Dev. Co."):
        assert names.read_organisation(text)["family"] == want, text


@pytest.fixture(scope="module")
def linked(spark):
    people = {
        "a1": ["William Rasovu"], "a2": ["Bill Rasovu"], "a3": ["W. T. Rasovu"], "a4": ["William T. Rasovu", "the Lender"], "a5": ["Rasovu W."], "a6": ["William Rasoovu"], "a7": ["Wm. Rasvou", "William Rasovu"],
        "b1": ["Margaret Tolime"], "b2": ["Tolime M."], "b3": ["Peggy Tolime", "the Lender"],
        "c1": ["Henry Dovata"], "c2": ["Harry Dovata"], "c3": ["Samuel Dovata"], "c4": ["S. Dovata"],
        "d1": ["Walter Kumeso"], "d2": ["William Kumeso"], "d3": ["W. Kumeso"],
        "e1": ["Samuel A. Vokute"], "e2": ["Samuel B. Vokute"], "e3": ["Samuel Vokute"], "e4": ["Vokute, Sam A."], "e5": ["S. B. Vokute"],
        "x1": [None], "x2": ["  "], "x3": ["Dr."],
    }
    firms = {
        "f1": ["Bomaru Engineering Limited"], "f2": ["Bomaru Engg Ltd"], "f3": ["Bomraru Engineering"], "f4": ["Bomaru Holdings Limited"], "f5": ["Bomaru Hldgs", "Director"],
        "g1": ["Vatehoha"], "g2": ["Sorilame Transport Company", "Vatehoha", "Director"], "g3": ["Sorilame Trnsprt", "Sorilame Transport Company"], "g4": ["Director"],
    }
    rows = [(e, p, min(i, 1), t, "u", 1) for p, some in ((True, people), (False, firms)) for e, own in some.items() for i, t in enumerate(own)]
    rows += [("a1", True, 2, "william  rasovu", "u", 1), ("a1", True, 0, "William Rasovu", "u", 1), (None, True, 0, "William Rasovu", "u", 1)]
    df = spark.createDataFrame(rows, "entity_id string, person boolean, rank int, text string, family string, node int")
    forms = spark.createDataFrame([*FORMS, (None, None)], "given_name string, short_form string")
    return df, forms, {(r.entity_a, r.entity_b) for r in names.pairs(names.resolve(df, forms)).collect()}


def test_groups(linked):
    got = linked[2]
    group = lambda *ids: {(a, b) for a in ids for b in ids if a < b}
    want = group("a1", "a2", "a3", "a4", "a5", "a6", "a7") | group("b1", "b2", "b3") | group("c1", "c2") | group("c3", "c4") | group("e1", "e4") | group("e2", "e5") | group("f1", "f2", "f3") | group("f4", "f5") | group("g1", "g2", "g3")
    assert got == want


def test_former_name_of_many_spellings(spark, linked):
    head = "Tolimareko"
    spelt = [head] + [head[:i] + "x" + head[i:] for i in range(10)] + [head[:i] + head[i + 1 :] for i in range(10)]
    rows = [(f"m{i:02d}", False, r, t) for i, s in enumerate(spelt) for r, t in ((0, f"{s} Foods Ltd"), (1, "Gavusero"))] + [("m99", False, 0, "Gavusero")]
    rows += [(f"z{i}", False, r, t) for i, s in enumerate(("Lakamo", "Birevu", "Todano")) for r, t in ((0, f"{s} Foods Ltd"), (1, "Director"))] + [("z9", False, 0, "Director")]
    df = spark.createDataFrame(rows, "entity_id string, person boolean, rank int, text string")
    by: dict = {}
    for r in names.resolve(df, linked[1]).collect():
        by.setdefault(r.root, set()).add(r.entity_id)
    assert sorted(map(len, by.values())) == [1, 1, 1, 1, 22]


def test_large_block_in_seconds():
    rows = [(i, True, "kumaresan", "", "r", "abcdefghij"[i % 10]) for i in range(10)]
    rows += [(100 + i, True, "kumaresan"[: 1 + i % 8] + "x" + "kumaresan"[1 + i % 8 :], f"r{i}", "r", "") for i in range(10_000)]
    f = pd.DataFrame(rows, columns=["node", "person", "family", "given", "first", "middle"])
    t = time.time()
    assert len(names._resolve(f)) == 0 and time.time() - t < 15


def test_empty(linked):
    df, forms, _ = linked
    assert names.pairs(names.resolve(df.limit(0), forms)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (200, 201), (201, 200)]
    got = {r.node: r.root for r in names.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
