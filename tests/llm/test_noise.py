"""Scanning noise on hand-made pages."""

import random

import pytest

from foliant.llm import noise

COUNTS = {w: n for n, words in ((5000, "the of and to in is it that for"), (300, "lender shall review payable tenant while compliance without allows deposit must lien lieu modern form from under maintain division"), (120, "long-term year-end agreement instalment register liability")) for w in words.split()}
LEX = noise.Lexicon(COUNTS)


def test_readings():
    cases = {"1ender": "lender", "sha|l": "shall", "rewew": "review", "pavable": "payable", "tenarit": "tenant", "wbile": "while", "comphance": "compliance", "vvithout": "without", "aUows": "allows", "cleposit": "deposit", "mu5t": "must", "tbe": "the", "0f": "of", "rnodern": "modern", "uncler": "under", "m@in+ain": "maintain", "division": "division"}
    assert {k: LEX.best(k)[0] for k in cases} == cases
    for typed in ("lendder", "lnder", "revview", "tenent", "zebra"):
        assert LEX.best(typed) is None
    assert LEX.best("lien") == ("lien", 0.0) and LEX.best("lieu") == ("lieu", 0.0)


def test_rare_misreadings_leave_the_lexicon():
    lex = noise.Lexicon({"the": 9000, "tbe": 5, "lien": 50, "lieu": 9, "reserve": 90, "réserve": 40, "rédeem": 3, "redeem": 60, "léase": 2})
    assert lex.best("tbe")[0] == "the" and lex.best("rédeem")[0] == "redeem" and set(lex.cost) == {"the", "lien", "lieu", "reserve", "réserve", "redeem", "léase"}


def test_decoding():
    read = lambda *lines: [(w.text, w.broken, w.misread) for w in noise.decode(list(lines), LEX) if w.broken or w.misread]
    assert read("the agree-", "ment of the") == [("agreement", True, False)]
    assert read("the agree\xad", "rnent of the") == [("agreement", True, True)]
    assert read("a long-", "term deposit") == [("long-term", True, False)]
    assert read("of Tolib-", "oju Energy") == [("Toliboju", True, False)]
    assert read("the agree", "ment of the") == [("agreement", True, False)]
    assert read("the tenant", "shall review") == [] and read("x -", "the lender") == []
    assert read("of thc Ien", "the 1ender, (wbile)") == [("the", False, True), ("lender,", False, True), ("(while)", False, True)]
    counts = {**COUNTS, "pay": 900, "payment": 800, "form": 300, "inform": 250}
    lex = noise.Lexicon(counts)
    again = lambda *lines: [w.text for w in noise.decode(list(lines), lex)]
    assert again("the pay ment of it") == again("the pay", "ment of it") == again("the pay-", "ment of it") == ["the", "payment", "of", "it"]
    assert again("in form of it") == ["in", "form", "of", "it"] and again("shall pay", "the tenant") == ["shall", "pay", "the", "tenant"]
    seven = "tbe 1ender sha|l rewew tbe pavable tenarit agreem ent (uncler tbe 1ien) x"
    assert again(seven) == "the lender shall review the payable tenant agreement (under the lien) x".split()
    assert again("x" * 500, "agree", "ment") == ["x" * 500, "agreement"]
    assert [w.text for w in noise.decode(["the len der shallreview it"], LEX) if w.text] == ["the", "lender", "shall", "review", "it"]


def test_page_numbers():
    for line, page in [("Page 3 of 9", 3), ("- 12 -", 12), ("iv", 4), ("[7]", 7), ("Pg. 2/6", 2), ("25", 25), ("~ 2 ~", 2), (" ix ", 9)]:
        assert noise.is_page_number(line, page) and not noise.is_page_number(line, page + 1)
    for line in ("INR 5,146,707", "1.4 Municipal fee", "Clause 3", "mild"):
        assert not noise.is_page_number(line, 3)
    assert noise.is_page_number("Page 3 of 9", None) and not noise.is_page_number("389", None)


def test_paragraphs():
    body = ["The lender shall review the deposit of the tenant", "and maintain it without a lien."]
    lines = ["1.4 Deposit", *body, "", *body, *body]
    assert noise.paragraphs(lines)[0] == (0, 1) and (1, 3) in noise.paragraphs(lines)
    # what a boundary costs depends on the whole paragraph: short lines inside a long one are cut, in a short one kept
    long = [*["The lender shall review the deposit of the tenant and so on."] * 4, "It is so.", "The tenant shall pay the lender for the deposit and so on."]
    assert noise.paragraphs(long) == [(0, 5), (5, 6)]
    assert noise.paragraphs(["the tenant shall pay the depo-", "", "sit of the lender"]) == [(0, 3)]
    lines_ = [f"Sentence number {i} of a paragraph without an end that runs over very many lines." for i in range(300)]
    found = noise.paragraphs(lines_)
    assert 5 < len(found) < 60 and [b for _, b in found] == [a for a, _ in found][1:] + [300]
    assert noise.paragraphs([]) == [] and noise.paragraphs(["a"]) == [(0, 1)]
    assert [b for _, b in noise.paragraphs(lines)] == [a for a, _ in noise.paragraphs(lines)][1:] + [len(lines)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    words = ["lender", "shall", "review", "payable", "tenant", "while", "compliance", "deposit", "register", "liability", "annual", "budget", "and", "the"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for p in range(1, 6):
        body = "\r\n".join(prose(9) for _ in range(6))
        rows.append(("page", "a.pdf", p, p, f"Deposit and tenant Register\n{p + 30}\n{body}\nthe com-\npliance of the 1ender\n- {p} -"))
    for p in (1, 2):
        rows.append(("page", "b.pdf", p, p, f"Private & Confidential\n2.1 Annual budget\n{prose(30)}\nPage {p} of 2"))
        rows.append(("page", "d.pdf", p, p, f"Private & Confidential\n{prose(30)}\n{p}"))
        rows.append(("page", "e.pdf", p, p, f"Private & Confidential\n{prose(30)}\n{p}"))
    rows += [("page", "c.pdf", 1, 1, None), ("page", "c.pdf", 2, 2, ""), ("page", "c.pdf", 3, 3, " \r\n "), ("page", "c.pdf", 4, 4, f"Private & Confidential\n{prose(5000)}")]
    rows += [("chunk", "a.pdf", 0, 2, f"{prose(8)}\n- 2 -\nDeposit and tenant Register\n{prose(8)} wbile"), ("chunk", None, 1, None, prose(9)), ("chunk", "a.pdf", None, 1, "the\nbudget")]
    rows += rows[:2]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "src string, document string, idx int, page int, text string, kind string, keys int")


def test_found(texts):
    got = {tuple(r) for r in noise.found(texts).collect()}
    want = {("page", "a.pdf", p, k, f) for p in range(1, 6) for k, f in (("furniture", "Deposit and tenant Register"), ("furniture", f"- {p} -"), ("broken", "compliance"), ("misread", "lender"))}
    want |= {("page", d, p, "furniture", "Private & Confidential") for d in ("b.pdf", "d.pdf", "e.pdf") for p in (1, 2)} | {("page", "c.pdf", 4, "furniture", "Private & Confidential")}
    want |= {("page", "b.pdf", p, "furniture", f"Page {p} of 2") for p in (1, 2)} | {("page", d, p, "furniture", str(p)) for d in ("d.pdf", "e.pdf") for p in (1, 2)}
    want |= {("chunk", "a.pdf", 0, "furniture", "- 2 -"), ("chunk", "a.pdf", 0, "furniture", "Deposit and tenant Register"), ("chunk", "a.pdf", 0, "misread", "while")}
    assert got == want
    assert noise.found(texts.limit(0)).count() == 0


def test_repaired(texts):
    rows = noise.repaired(texts).filter("src = 'page' AND document = 'a.pdf'").collect()
    assert all("compliance of the lender" in " ".join(r.text for r in rows if r.idx == p) for p in range(1, 6))
    assert not any("Register" in r.text or " - " in r.text for r in rows)
