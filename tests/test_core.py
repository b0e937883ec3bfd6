"""Core operators on hand-made fixtures."""

import json
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import plugins
from foliant.api import Engine
from foliant.functions import text as T
from foliant.operators import chunking, evaluation, graph, records, retrieval, state
from foliant.plans import planner
from foliant.sources import corpus
from foliant.streaming import events


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string", bool: "boolean"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(values[n])]}" for n in names)).select(column.alias("x")).first()[0]


# -- text
def test_clean(spark):
    clean = lambda t: one(spark, T.clean_ocr(F.col("t")), t=t)
    assert clean("agree-\r\nment of\nthe  lender.\nNext\n\n\n\nA") == "agreement of the lender.\nNext\n\nA"
    assert clean("a\nb\nc\n(d") == "a b c (d" and clean("") == "" and clean(None) is None


def test_sentences(spark):
    got = one(spark, T.sentences(F.col("t")), t='First one. Second? "Third" lower. no split\n\nPara')
    assert got == ["First one.", "Second?", '"Third" lower. no split', "Para"]


def brute_stem(w):
    for s in T.SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= 3:
            return w[: -len(s)]
    return w


def test_stem(spark):
    rng = random.Random(1)
    words = ["founders", "invested", "companies", "as", "ness", "illness", "happinesses", "élément", "s", ""] + ["".join(rng.choice("abinesgtmlyrdof") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert all(r.s == brute_stem(r.w) for r in got)


def test_formats(spark):
    assert [one(spark, T.format_ttl(F.col("s")), s=s) for s in (45, 185, 3720)] == ["45s", "3m 5s", "1h 2m"]
    assert [one(spark, T.format_number(F.col("v")), v=v) for v in (1234567.0, 12.5, 0.25)] == ["1,234,567", "12.5", "0.25"]
    assert one(spark, T.normalise_entity(F.col("t"), F.col("l")), t="  Contract   CX-1001 ", l="CONTRACT") == "cx-1001"
    assert one(spark, T.relation_name(F.col("t")), t="who are the owners of") == "WHO_OWN"
    assert one(spark, T.label_of_id(F.col("n"), F.col("t")), n="invoice", t="INV-1") == "INVOICE_ID"
    assert one(spark, T.entity_number(F.col("t"), F.col("l")), t="$ 5 million", l="REVENUE") == 5e6 and one(spark, T.entity_number(F.col("t"), F.col("l")), t="5", l="CITY") is None
    assert [one(spark, T.confidence_badge(F.col("v")), v=v) for v in (0.7, 0.4, 0.1)] == ["high", "medium", "low"]


def test_numbers_are_read_whole(spark):
    rows = [("50000", "", 50000.0), ("1,234,567", "", 1234567.0), ("5", "million", 5e6), ("5", "more", 5.0), ("$ 12.50", "", 12.5), ("2024", "", 2024.0)]
    got = spark.createDataFrame(rows, "t string, u string, want double").select("want", T.number_with_unit(F.col("t"), F.col("u")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


# -- chunking
def tokens(s):
    return max(1, len(s) // 4)


def brute_pack(sentences, size=512, overlap=64):
    out, own = [], []
    for s in sentences:
        if own and sum(map(tokens, own)) + tokens(s) > size:
            out.append(own)
            kept = []
            for x in reversed(own):
                if sum(map(tokens, kept)) + tokens(x) > overlap:
                    break
                kept.insert(0, x)
            own = kept if sum(map(tokens, kept)) + tokens(s) <= size else []
        own = [*own, s]
    return [*out, own] if own else out


def test_pack_sentences(spark):
    rng = random.Random(5)
    cases = [["a" * 1800, "b" * 240, "c" * 2000], ["x" * 5000], [], ["a" * 260, "b" * 1900, "c" * 250, "d" * 1900]] + [["s" * rng.randrange(4, 900) for _ in range(30)] for _ in range(5)]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>").select("i", chunking.pack_sentences(F.col("s")).alias("p")).collect()
    for r in got:
        assert [list(x) for x in r.p] == brute_pack(cases[r.i])
        assert [s for x in r.p for s in x if True][-1:] == cases[r.i][-1:]


def test_split_long(spark):
    words = ["w" * n for n in (3, 2100, 5, 2000, 40, 50)] * 3
    parts = one(spark, chunking.split_long(F.col("s")), s=" ".join(words))
    assert " ".join(parts).split() == words and all(len(p) <= 2048 or " " not in p for p in parts)
    assert one(spark, chunking.split_long(F.col("s")), s="short") == ["short"]


PAGES = "document string, page int, raw_text string, ocr_confidence double, extraction_method string"


def test_chunks(spark):
    page = " ".join(f"Sentence number {i} says something." for i in range(200))
    rows = [("a", 1, "1. Scope Of Work\n" + page, 0.9, "native"), ("a", 2, page, None, None), ("a", 3, "   ", 1.0, "native"), ("a", 4, None, 1.0, "native"), ("b", 1, "One line.", 1.0, "native")]
    df = spark.createDataFrame(rows, PAGES)
    for made in (chunking.chunk_fixed(df), chunking.chunk_semantic(df)):
        got = sorted(made.collect(), key=lambda r: (r.document, r.chunk_index))
        own = [r for r in got if r.document == "a"]
        assert [r.chunk_index for r in own] == list(range(len(own))) and {r.page for r in own} == {1, 2}
        assert all(r.token_count <= 600 and r.section_title.startswith("1. Scope") for r in own)
        assert all(f"number {i} says" in " ".join(r.text for r in own if r.page == 2) for i in range(200))


def test_semantic_falls_back(spark):
    def broken(texts):
        raise RuntimeError("no model")

    df = spark.createDataFrame([("a", 1, "One. Two. Three.", 1.0, "native")], PAGES)
    assert [r.text for r in chunking.chunk_semantic(df, broken).collect()] == [r.text for r in chunking.chunk_fixed(df).collect()]


def test_semantic_splits_on_drop():
    base = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    sentences = ["a" + "x" * 200] * 4 + ["b" + "y" * 200] * 4
    embed = lambda s: np.array([base[x[0]] for x in s])
    groups = chunking.semantic_groups(sentences, embed, overlap=0)
    assert [len(g) for g in groups] == [4, 4] and chunking.semantic_groups([], embed) == []


def test_summary_parts(spark):
    parts = one(spark, chunking.summary_parts(F.col("t"), 300, 20), t="\n".join(["p" * 700, "q" * 700, "r" * 3000, "s"]))
    assert parts[0] == "p" * 700 and parts[1].startswith("p" * 80) and all(len(p) <= 1400 for p in parts) and parts[-1] == "s"


# -- planning
@pytest.mark.parametrize(
    "question, kind",
    [
        ("Compare A and B", "COMPARISON"), ("How many contracts are there?", "COUNTING"), ("growth of sales over time", "NUMERICAL_FILTER"), ("revenue between 2022 and 2023", "NUMERICAL_FILTER"), ("top 5 projects", "RANKING"),
        ("Invoice INV-12 amount", "ENTITY_LOOKUP"), ("which project earned the income", "SEMANTIC_LOOKUP"), ("total cost", "AGGREGATION"), ("when was it signed", "TEMPORAL"), ("explain the clause", "ANALYTICAL"), ("Who signed?", "LOOKUP"),
    ],
)
def test_types(spark, question, kind):
    assert one(spark, planner.query_type(F.col("q")), q=question) == kind


def test_rewrite_and_route(spark):
    rewrite = lambda q: one(spark, planner.rewrite(F.col("q")), q=q)
    assert rewrite("payment terms") == "Find document evidence about payment terms." and rewrite("tell me about payment terms") == "Find document evidence related to: tell me about payment terms"
    assert rewrite("Who signed it?").endswith("Answer using the uploaded document evidence.") and rewrite("Who signed the contract?") == "Who signed the contract?" and rewrite("  ") == ""
    route = lambda q, cached=False, n=3: one(spark, planner.route(F.col("q"), F.lit(cached), F.lit(n)), q=q)
    assert route("x", n=0) == "empty" and route("x", cached=True) == "exact_cache" and route("amount of INV-9?") == "exact_metric" and route("list all firms") == "graph_fact"
    assert route('Is "escrow" mentioned?') == "keyword" and route("who pays") == "semantic" and one(spark, planner.keyword(F.col("q")), q='Is "escrow" mentioned?') == "escrow"


# -- retrieval
def test_rrf_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, k string, rank int")
    first, second = ({(r.k, r.score, r["rank"]) for r in retrieval.rrf(x, ["k"]).collect()} for x in ([("a", a), ("b", b)], [("b", b), ("a", a)]))
    assert first == second and ("y", round(1 / 61 + 1 / 62, 6), 1) in first


def test_bm25(spark):
    chunks = spark.createDataFrame([("d", i, t) for i, t in enumerate(["escrow of the lender", "the tenant pays the lender", "the board", "the levy of the board", None, "", "a clause", "a notice", "a premium"])], "document string, chunk_index int, text string")
    q = spark.createDataFrame([(1, "escrow"), (2, "lend"), (3, "absent"), (4, None)], "query_id int, question string")
    got = {(r.query_id, r.chunk_index) for r in retrieval.bm25(q, chunks).collect()}
    assert (1, 0) in got and {(2, 0), (2, 1)} <= got and not any(x[0] in (3, 4) for x in got)
    shallow, deep = ([(r.query_id, r.chunk_index) for r in retrieval.bm25(q, chunks, k).orderBy("query_id", "rank").collect()] for k in (1, 3))
    assert set(shallow) <= set(deep)


def test_questions_meet_chunks_in_blocks(spark, monkeypatch):
    """Blocks pass on k chunks of a question, however many share its words; ties and blocks of any size."""
    chunks = spark.createDataFrame([(f"d{i % 70:02}", i, f"the lender w{i % 9} " + "levy " * (i % 4)) for i in range(900)], "document string, chunk_index int, text string").repartition(3)
    q = spark.createDataFrame([(i, f"the lender levy w{i % 11} tenant") for i in range(60)], "query_id int, question string")
    index, want = retrieval.build_index(chunks), None
    for rows, asked, part, thick in ((8192, 4096, 256, 16), (100, 4096, 7, 0), (64, 9, 5, 3), (50, 7, 256, 10**9)):
        for name, value in (("CHUNK_BLOCK", rows), ("QUESTION_BLOCK", asked), ("SLICE", part), ("DENSE", thick)):
            monkeypatch.setattr(retrieval, name, value)
        got = sorted(map(tuple, retrieval.bm25(q, index, 5).collect()))
        assert want is None or got == want
        want = got
    assert len(want) == 300 and {r[4] for r in want} == {1, 2, 3, 4, 5}
    held = q.select("query_id", F.array(F.lit("the"), F.lit("lender")).alias("terms"), F.array(F.lit(1.0), F.lit(2.0)).alias("worths"))
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 8192)
    assert retrieval._score(held, index.forward, 5, 4.0, 900).count() <= 60 * 5  # and no row for each of 54,000 pairs


def test_index_kept_up(spark):
    row = lambda d, i, t: (d, i, t)
    kind = "document string, chunk_index int, text string"
    old = spark.createDataFrame([row("a", i, f"escrow of lender {i}") for i in range(9)] + [row("b", 0, "the escrow")], kind)
    new = spark.createDataFrame([row("a", 0, "a levy of the board"), row("c", 0, "escrow levy")], kind)
    kept = retrieval.replace_in_index(retrieval.build_index(old), new.select("document"), new)
    fresh = retrieval.build_index(old.filter("document <> 'a'").unionByName(new))
    q = spark.createDataFrame([(1, "escrow levy"), (2, "board"), (3, "len")], "query_id int, question string")
    both = [sorted(map(tuple, retrieval.bm25(q, x).collect())) for x in (kept, fresh)]
    assert both[0] == both[1] and both[0]
    gone = retrieval.replace_in_index(fresh, spark.createDataFrame([("b",), ("c",)], "document string"))
    assert {r.document for r in retrieval.bm25(q, gone).collect()} <= {"a"}


def test_adaptive_judges_each_question(spark):
    asked = []
    q = spark.createDataFrame([(1, True), (2, True), (3, False)], "query_id int, deepen boolean")

    def search(some, k):
        ids = sorted(r.query_id for r in some.collect())
        asked.append((ids, k))
        most = {1: 50, 2: 20, 3: 99}
        return spark.createDataFrame([(i, n) for i in ids for n in range(min(k, most[i]))], "query_id int, n int")

    found = retrieval.adaptive(search, lambda r: r.groupBy("query_id").count().withColumnRenamed("count", "m"), q, 20)
    assert {(r.query_id, r["count"]) for r in found.groupBy("query_id").count().collect()} == {(1, 50), (2, 20), (3, 20)}
    assert asked == [([1, 2, 3], 20), ([1, 2], 40), ([1], 60)]


def test_dense_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7 - 3), 1.0, 0.5]) for i in range(50)] + [(90, None), (91, [1.0]), (92, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])], "id int, v array<float>")
    q = v.filter("id IN (0, 3, 90, 92)")
    want = None
    for rows in (3, 2048):
        got = sorted(((r["query"], r["item"] is None, r["item"], r["score"], r["rank"]) for r in retrieval.dense(q, v, "id", "id", "v", 5, rows).collect()), key=str)
        assert want is None or got == want
        want = got
    assert {g[0] for g in got} == {0, 3, 92} and max(g[4] for g in got) == 5


def test_keyword_scan(spark):
    chunks = spark.createDataFrame([("d", 1, 0, "The ESCROW agent, pre-escrowed"), ("d", 1, 1, "escrow"), ("d", 2, 2, "a force majeure event"), ("e", 1, 0, None), ("e", 2, 1, "Force  majeure; escrow?")], "document string, page int, chunk_index int, text string")
    asked = spark.createDataFrame([(1, "escrow"), (2, "Force Majeure"), (3, "zebra"), (4, None), (5, " ")], "query_id int, keyword string")
    got = [(r.query_id, r.document, r.page, r.chunk_index, r["rank"]) for r in retrieval.keyword_scan(asked, chunks).collect()]
    assert sorted(got) == [(1, "d", 1, 0, 1), (1, "e", 2, 1, 2), (2, "d", 2, 2, 1)]
    assert retrieval.keyword_scan(asked, chunks.limit(0)).count() == 0


# -- graph
def test_keyword_blocks(spark, monkeypatch):
    """Keywords that recur and are in every text, blocks of any size; a page that is not known comes last."""
    page = lambda i: None if i % 17 == 0 else i % 13
    rows = [(f"d{i % 7}", page(i), i, f"Common w{i % 5}x /{i % 3}/") for i in range(300)]
    chunks = spark.createDataFrame(rows, "document string, page int, chunk_index int, text string").repartition(5)
    words = ["common", "COMMON ", "w1x", "w", "/2/", "nothing", "x /0"]
    asked = spark.createDataFrame([(i, words[i % 7]) for i in range(70)], "query_id int, keyword string")

    def want(word):
        first = {}
        for d, p, k, t in rows:
            if word.strip().lower() in t.lower():
                first[d, p] = min(k, first.get((d, p), k))
        return [(d, p, k) for _, p, k, d in sorted((p is None, p, k, d) for (d, p), k in first.items())[:3]]

    for share, block in ((200_000, 8192), (2, 11)):
        monkeypatch.setattr(retrieval, "CHUNK_BLOCK", block)
        got = sorted((r.query_id, r["rank"], r.document, r.page, r.chunk_index) for r in retrieval.keyword_scan(asked, chunks, share=share).collect())
        assert got == [(i, n + 1, *x) for i in range(70) for n, x in enumerate(want(words[i % 7]))]


def test_search_strips_the_type_word(spark):
    e = spark.createDataFrame([("e1", "EXECUTIVE", "jane doe", ["Jane Doe"], 0.9), ("e2", "COMPANY", "doe mills", None, 0.8), ("e3", "CITY", "x", [None], None)], "entity_id string, label string, name string, aliases array<string>, confidence double")
    assert [r.entity_id for r in graph.search(e, "company Doe", 5).collect()] == ["e1", "e2"] and [r.entity_id for r in graph.search(e, "Jane Doe?", 5).collect()] == ["e1"]


def test_neighbours(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "x")], "source_id string, target_id string")
    roots = spark.createDataFrame([("a",), ("z",), ("x",)], "entity_id string")
    got = lambda n: {(r.root, r.entity_id, r.hops) for r in graph.neighbours(roots, edges, n).collect()}
    assert got(1) == {("a", "b", 1), ("a", "c", 1)} and got(2) == got(1) | {("a", "d", 2)} and got(9) == got(3) == got(2) | {("a", "e", 3)}


def test_all_met_in_a_chunk_are_neighbours(spark):
    rows = [("a", "d", 1, 0), ("b", "d", 1, 0), ("c", "d", 1, 0), ("c", "d", 1, 0), ("b", "d", 2, 1), ("c", "d", 2, 1), ("x", "d", 2, 2), ("c", "e", None, 4), ("x", None, 1, 1), ("c", None, 1, 1)]
    m = spark.createDataFrame(rows, "entity_id string, document string, page int, chunk_index int")
    asked = spark.createDataFrame([("q", "b"), ("r", "x"), ("s", "none")], "query_id string, entity_id string")
    got = {(r.query_id, r.document, r.page, r.chunk_index): r.hits for r in graph.chunk_retrieve(asked, m).collect()}
    assert got == {("q", "d", 1, 0): 3, ("q", "d", 2, 1): 2, ("q", "e", None, 4): 1, ("r", "d", 2, 2): 1}


def test_hot_entities_are_not_walked_through(spark):
    """The same chunks and hits whatever counts as hot, against brute force."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        met = {f"e{min(int(rng.expovariate(0.12)), 60)}" for _ in range(rng.randint(1, 3))} | ({"h1"} if rng.random() < 0.6 else set()) | ({"h2"} if rng.random() < 0.3 else set())
        rows += [(e, f"d{i % 9}", rng.choice([None, 1, 2]) if i % 4 else 3, i) for e in sorted(met)]
    at, of = {}, {}
    for e, *c in rows:
        at.setdefault(e, set()).add(tuple(c))
        of.setdefault(tuple(c), set()).add(e)
    asked = [(q, e) for q, es in {"a": ["e0"], "b": ["e50", "e3"], "c": ["h1"], "d": ["e7"], "e": ["gone"], "f": ["h2", "e1"]}.items() for e in es]
    want = []
    for q in "abcdef":
        own = {e for x, e in asked if x == q}
        wide = own | {y for e in own for c in at.get(e, ()) for y in of[c]}
        hits = sorted((-len(wide & held), c[0], c[1] is None, c[1], c[2]) for c, held in of.items() if wide & held)[:12]
        want += [(q, n + 1, -h, d, p, k) for n, (h, d, _, p, k) in enumerate(hits)]
    m = spark.createDataFrame(rows, "entity_id string, document string, page int, chunk_index int").repartition(4)
    a = spark.createDataFrame(asked, "query_id string, entity_id string")
    for hot in (1000, 60, 3):
        got = sorted((r.query_id, r["rank"], r.hits, r.document, r.page, r.chunk_index) for r in graph.chunk_retrieve(a, m, hot=hot).collect())
        assert got == want


def test_places_are_made_once(spark):
    kind = "entity_id string, document string, page int, chunk_index int"
    m = spark.createDataFrame([("a", "d", 1, 0), ("b", "d", 1, 0)], kind)
    engine = Engine(spark, spark.createDataFrame([("d", 0, 1, "x")], "document string, chunk_index int, page int, text string"), m)
    held = engine.places()
    asked = spark.createDataFrame([("q", "a")], "query_id string, entity_id string")
    assert engine.places() is held and [r.hits for r in graph.chunk_retrieve(asked, held).collect()] == [2]
    engine.mentions = m.limit(0)
    assert engine.places() is not held and graph.chunk_retrieve(asked, engine.places()).count() == 0


def test_relations(spark):
    m = spark.createDataFrame([(1, "e1", "Acme", "acme", "d", 1, 0), (2, "e2", "Bolt Ltd", "bolt ltd", "d", 1, 0), (3, "e3", "acme", "acme", "d", 1, 0)], "mention_id int, entity_id string, text string, normalized string, document string, page int, chunk_index int")
    r = spark.createDataFrame([("d", 1, 0, 1, "ACME", "OWNS", "Bolt Ltd"), ("d", 1, 0, 2, "acme", "OWNS", "bolt ltd"), ("d", 1, 0, 3, "Nobody", "OWNS", "Acme")], "document string, page int, chunk_index int, seq int, source string, type string, target string")
    assert [(x.source_id, x.target_id, x.type) for x in graph.relations_of(r, m).collect()] == [("e1", "e2", "OWNS")]


def test_canonical(spark):
    m = spark.createDataFrame([("COMPANY", n) for n in ("acme holdings", "acme holding", "acme x", "bolt")] + [("DATE", "2020-01-01"), ("DATE", "2020-01-02"), ("COMPANY", None), ("COMPANY", "")], "label string, normalized string")
    got = {(r.label, r.normalized): r.canonical for r in graph.canonical_mentions(m).collect()}
    assert got["COMPANY", "acme holdings"] == "acme holding" and got["DATE", "2020-01-02"] == "2020-01-02" and len(got) == 6


@pytest.mark.parametrize("most", [4096, 12])
def test_canonical_in_any_place(spark, most):
    from difflib import SequenceMatcher

    rng = random.Random(8)
    names = {"benjamin okonkwo", "adv. benjamin okonkwo", "ebnjamin okonkwo", "okonkwo benjamin", "anna", "a"}
    for base in ("marlowe capital partners", "jujukedi textiles", "vedovoge holdings ltd", "é. zola"):
        for _ in range(12):
            x = list(base)
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(["", "x", "y", "z "])
            names.add("".join(x))
    want, kept = {}, []
    for n in sorted(names):
        want[n] = next((c for c in kept if SequenceMatcher(None, n, c).ratio() >= 0.88), n)
        if want[n] == n:
            kept.append(n)
    m = spark.createDataFrame([(label, n) for label in ("PERSON", None) for n in names], "label string, normalized string")
    got = graph.canonical_mentions(m, most=most).collect()
    assert len(got) == 2 * len(names) and all(r.canonical == want[r.normalized] for r in got)
    assert any(n[:2] != c[:2] for n, c in want.items())


# -- evidence
def test_constraints(spark):
    c = lambda q: one(spark, F.to_json(records.constraint(F.col("q"))), q=q)
    assert json.loads(c("revenue no less than 5")) == {"operator": ">=", "low": 5.0, "high": 5.0}
    assert json.loads(c("between 9 thousand and $ 1,000")) == {"operator": "between", "low": 1000.0, "high": 9000.0}
    assert json.loads(c("over 2.5 million"))["low"] == 2.5e6 and c("hello") is None


def test_dedupe_prefers_value(spark):
    rows = [("Project A", "p", "revenue", 5.0, "d", 1, 0, 1.0, 0), ("project a", "p", "revenue", 9.0, "d", 1, 1, 0.8, 0), ("Project A", "p", "revenue", 9.0, "d", 1, 2, 0.9, 0)]
    got = records.dedupe(spark.createDataFrame(rows, "entity string, entity_type string, metric string, value double, document string, page int, chunk_index int, confidence double, pos int")).collect()
    assert [(r.value, r.confidence) for r in got] == [(9.0, 0.9)]


def test_fallback_confidence(spark):
    hits = spark.createDataFrame([(1, "d.pdf", 2, 7, "The  excerpt.", 0.82, 1), (2, "d.pdf", 2, 7, "x" * 600, 0.1, 1)], "query_id int, document string, page int, chunk_index int, text string, score double, rank int")
    got = {r.query_id: r for r in records.fallback_answer(hits).collect()}
    assert got[1].confidence == 0.45 and "- d.pdf, page 2: The excerpt." in got[1].answer and got[2].confidence == 0.2 and "x …" in got[2].answer


# -- state
def test_cache(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", "k", "who pays", 5, t, t), ("b", "k", "who pays", 5, t + timedelta(seconds=9), t), ("c", "k", "who pays", 3, t, t + timedelta(seconds=5))]
    df = spark.createDataFrame(rows, "cache_id string, corpus_key string, normalized_question string, top_k int, created_at timestamp, last_accessed_at timestamp")
    q = spark.createDataFrame([(1, "k", 5, " Who  pays?"), (2, "k", 4, "who pays"), (3, None, 5, None)], "query_id int, corpus_key string, top_k int, question string")
    assert [(r.query_id, r.cache_id) for r in state.exact(q, df).collect()] == [(1, "b")]
    now = F.lit(t + timedelta(seconds=3600))
    assert state.live(df, now).count() == 3 and state.live(df, F.lit(t + timedelta(seconds=3601))).count() == 1 and state.live(df, now, 0).count() == 3
    assert [r.cache_id for r in state.survivors(df, ["corpus_key"], 1).collect()] == ["c"]
    assert state.invalidate(df, "k").count() == 0


def test_history(spark):
    turns = spark.createDataFrame([("s", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 13)] + [(" ", 1, "user", "x"), (None, 1, "user", "x")], "session_id string, turn int, role string, content string")
    got = state.format_history(turns).collect()
    assert len(got) == 1 and got[0].history.splitlines()[0] == "User: m5" and len(got[0].history.splitlines()) == 8


# -- evaluation
def test_ranks(spark):
    kind = "query_id int, question_type string, expected_document string, expected_page int, retrieved_top5 array<struct<document:string,page:int>>"
    rows = [(1, "t", "A.pdf", 3, [("b.pdf", 3), ("a.PDF", 4)]), (2, "t", "A.pdf", 3, [("a.pdf", 5)]), (3, "t", "A.pdf", 3, None), (4, "t", None, None, [("a.pdf", 1)])]
    got = {r.query_id: r for r in evaluation.ranks(spark.createDataFrame(rows, kind)).collect()}
    assert [got[i]["rank"] for i in (1, 2, 3, 4)] == [2, 0, 0, 0] and got[1].reciprocal_rank == 0.5 and got[1].hit_3 == 1
    r = evaluation.report(evaluation.ranks(spark.createDataFrame(rows, kind))).first()
    assert r.recall_at_1 <= r.recall_at_3 <= r.recall_at_5 == 0.25


def test_distinct_questions_twice_is_once(spark):
    pool = spark.createDataFrame([("b", 1, "Which lender pays escrow"), ("b", 2, "which lender pays the escrow?"), ("b", 3, "Something else entirely here"), ("c", 4, "Which lender pays escrow")], "block string, question_id int, question string")
    once = evaluation.distinct_questions(pool)
    assert {r.question_id for r in once.collect()} == {1, 3, 4} == {r.question_id for r in evaluation.distinct_questions(once).collect()}


@pytest.mark.parametrize("most", [8192, 20])
def test_distinct_questions_of_the_whole_pool(spark, most):
    rng = random.Random(6)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(90)]
    rows = [(rng.choice(["a", "b", None]), i, " ".join(rng.sample(words[: rng.choice([30, 90])], rng.randrange(3, 9)))) for i in range(150)] + [(None, 500, ""), ("a", 501, "?")]
    sets = {i: set(x) for i, x in spark.createDataFrame(rows, "block string, i int, q string").select("i", T.token_set(F.col("q"), T.EVALUATION_STOPWORDS, True)).collect()}
    kept = []
    for _, i, _ in rows:
        if not any(sets[i] and sets[k] and len(sets[i] & sets[k]) / min(len(sets[i]), len(sets[k])) >= 0.6 for k in kept):
            kept.append(i)
    pool = spark.createDataFrame(rows, "block string, question_id int, question string")
    got = evaluation.distinct_questions(pool, whole=True, most=most).collect()
    assert sorted(r.question_id for r in got) == kept and len(kept) < 150
    assert all((r.block, r.question_id, r.question) in rows for r in got)


# -- sources, plug-ins, API
def test_cut_and_sweep(spark):
    from foliant.session import cut, small, sweep

    df = cut(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "test")
    assert df.count() == 2 and small(df).count() == 2 and small(df, 1).count() == 2
    assert sweep(spark) >= 1 and sweep(spark) == 0


def test_sources(spark, tmp_path):
    for name, content in (("a.pdf", b"one"), ("b.txt", b"two"), ("c.PNG", b"three")):
        (tmp_path / name).write_bytes(content)
    files = corpus.scan_files(spark, str(tmp_path))
    assert files.count() == 2 and files.filter(corpus.accepted_upload(F.col("path"), F.col("length"))).count() == 2
    read = lambda path, content: [{"text": content.decode(), "confidence": 1.0, "method": "native"}] if path.endswith("pdf") else []
    got = {r.document: r for r in corpus.extract_pages(files, [read]).collect()}
    assert got["a.pdf"].raw_text == "one" and got["c.PNG"].extraction_method == "ocr_unavailable" and got["c.PNG"].ocr_confidence == 0
    (tmp_path / "qa.json").write_text(json.dumps([{"question": "q", "expected_document": "d", "expected_page": 1}]))
    assert corpus.read_qa(spark, str(tmp_path / "qa.json")).first().answer_hint == ""
    assert corpus.write_report(spark.createDataFrame([(0.7,)], "recall_at_3 double"), str(tmp_path / "report")) and not corpus.write_report(spark.createDataFrame([(0.69,)], "recall_at_3 double"), str(tmp_path / "report"))


def test_replace_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", i, f"old{i}") for i in range(5)] + [("b", 0, "keep")], "document string, chunk_index int, text string")
    new = spark.createDataFrame([("a", 0, "new0")], "document string, chunk_index int, text string")
    want = {("a", 0, "new0"), ("b", 0, "keep")}
    once = corpus.replace_documents(old, new)
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in corpus.replace_documents(once, new).collect()}
    path = str(tmp_path / "t")
    corpus.write_documents(old, path)
    corpus.write_documents(new, path)
    assert {(r.document, r.chunk_index, r.text) for r in spark.read.parquet(path).collect()} == want
    v = lambda rows: spark.createDataFrame(rows, "document string, chunk_index int, embedding array<float>")
    assert {r.chunk_index: list(r.embedding) for r in corpus.upsert_vectors(v([("a", 0, [1.0]), ("a", 1, [2.0])]), v([("a", 0, [3.0])])).collect()} == {0: [3.0], 1: [2.0]}


def test_json_repair():
    for text, want in [('```json\n{"a": [1, 2,]}\n```', {"a": [1, 2]}), ('Sure: {“a”: “b”} ok', {"a": "b"}), ('{"a": [{"b": 1', {"a": [{"b": 1}]}), ('[{"a": 1}\n{"a": 2}]', [{"a": 1}, {"a": 2}]), ("none", None), ("", None)]:
        assert plugins.repair_json(text) == want
    assert plugins.parse_questions('1. "What is the levy amount"\nIgnore this\n- Who signed the contract?') == ["What is the levy amount?", "Who signed the contract?"]
    assert plugins.is_transient_error("Request timed out") and not plugins.is_capacity_error("bad input")


def test_engine(spark):
    pages = spark.createDataFrame([("a.pdf", 1, "The escrow is held by Acme Ltd. Invoice INV-7 amount was $1,200 today.", 1.0, "native"), ("b.pdf", 1, "The tenant keeps the premises in repair.", 1.0, "native")] + [(f"f{i}.pdf", 1, f"Filler {i} about nothing.", 1.0, "native") for i in range(6)], PAGES)
    e = Engine(spark, chunking.chunk_fixed(pages.limit(0)))
    q = spark.createDataFrame([(1, "Who holds the escrow?"), (2, "What is the amount of INV-7?"), (3, "Who keeps the premises?")], "query_id int, question string")
    assert {r.route for r in e.answer(q).collect()} == {"empty"}
    assert e.ingest(pages, semantic=False).count() == 8 and e.status().first().n_chunks == 8
    got = {r.query_id: r for r in e.answer(q).collect()}
    assert got[2].answer == "The amount of invoice INV-7 is 1,200." and got[2].confidence == 1.0 and "held by Acme" in got[1].answer and got[3].confidence <= 0.45
    e.remember(spark.createDataFrame([("c1", "Who holds the escrow?", "Acme.", datetime(2024, 1, 1))], "cache_id string, question string, answer string, created_at timestamp"))
    assert {r.query_id: r.answer for r in e.answer(q).collect()}[1] == "Acme."
    pairs = spark.createDataFrame([(1, "Who holds the escrow?", "A.PDF", 1, "t"), (3, "Who keeps the premises?", "b.pdf", 1, "t")], "query_id int, question string, expected_document string, expected_page int, question_type string")
    assert e.evaluate(pairs).first().recall_at_3 == 1.0
    e.plugins.generate = lambda prompt: "Generated: " + prompt[-20:]
    assert {r.query_id: r.answer for r in e.answer(q).collect()}[3].startswith("Generated")
    assert e.delete_document("a.pdf") == 1 and "a.pdf" not in [r.document for r in e.list_documents().collect()] and e.summaries().count() == 7
    e.reset()
    assert e.chunks.count() == 0


# -- streams
def test_streams(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(minutes=17 * i), i % 2, "view", 1.0, None) for i in range(20)]
    df = spark.createDataFrame([*rows, rows[3]], events.EVENT_SCHEMA)
    source = str(tmp_path / "in")
    df.repartition(3).write.parquet(source)
    run = lambda s, name, mode: s.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    run(events.tumbling(events.file_stream(spark, source), late="1 day"), "tumbling", "complete")
    assert {tuple(r) for r in spark.table("tumbling").collect()} == {tuple(r) for r in events.tumbling(df).collect()}
    run(events.unique(events.file_stream(spark, source), "1 day"), "uniq", "append")
    assert spark.table("uniq").count() == 20
    accesses = events.file_stream(spark, source).select(F.col("user_id").cast("string").alias("key"), F.col("ts"))
    run(events.cache_replay(accesses, 3600, "30 days"), "replay", "update")
    last = {r.key: (r.hits + r.misses) for r in spark.table("replay").collect()}
    assert max(last.values()) >= 10


def test_incremental_ingest(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "document string, chunk_index int, text string"
    spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], schema).coalesce(1).write.parquet(source)
    go = lambda: events.ingest(events.file_stream(spark, source, schema), target, str(tmp_path / "cp")).awaitTermination()
    go()
    spark.createDataFrame([("a", 0, "new")], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    assert {(r.document, r.text) for r in spark.read.parquet(target).collect()} == {("a", "new"), ("b", "z")}
    assert re.fullmatch(r"[\w.-]+", "ok")


def test_pairs_of_dealt_groups(spark):
    from foliant.session import deal, join_hot, pairs_across, pairs_within

    rows = [(i, i % 3 if i < 40 else 7) for i in range(60)] + [(99, 8)]
    members = spark.createDataFrame(rows, "id int, group int")
    for hot in (5, 2000):
        dealt = deal(members, hot)
        assert sorted(map(tuple, pairs_within(dealt).collect())) == sorted((a, b) for a, g in rows for b, h in rows if g == h and a < b)
        links = spark.createDataFrame([(0, 7), (8, 1)], "group_a int, group_b int")
        assert sorted(map(tuple, pairs_across(dealt, links).collect())) == sorted((a, b) for a, g in rows for b, h in rows if (g, h) in ((0, 7), (8, 1)))
    sizes = members.groupBy("group").count().withColumnRenamed("count", "n")
    for hot in (13, 10_000):
        assert sorted(r.n for r in join_hot(members, sizes, ["group"], hot).collect()) == sorted(sum(h == g for _, h in rows) for _, g in rows)
    assert pairs_within(deal(members.limit(0))).count() == 0
