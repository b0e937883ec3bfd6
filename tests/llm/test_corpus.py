"""Tokens, containers and shared spans against brute force."""

import random
from collections import defaultdict

import pytest

from foliant.llm import packing, spans, tokens

SCHEMA = "doc_id bigint, text string, ids string, n_tokens string"


def brute_ids(text):
    return tokens.encoding(tokens.vocabulary_path()).encode_ordinary(text or "")


@pytest.mark.parametrize("leaf", [1, 2, 7, 40])
def test_tree_equals_whole(leaf):
    enc = tokens.encoding(tokens.vocabulary_path())
    rng = random.Random(leaf)
    alphabet = ["we'll", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "don't", "é", "中文", "123", "4", "...", "!", "a", "B", " ", "\x1c", "\x85", "😀", "हिन्दी", "<|endoftext|>", "\r\n", "ll"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        got = tokens.encode_tree(enc, text, leaf)
        assert got.tolist() == enc.encode_ordinary(text), repr(text)
        assert tokens.decode_tree(enc, got) == text


def test_encode_rows(spark):
    long = "The lessee shall. " * 4000
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, "a b", "x", None), (3, "a b", "x", None), (None, "c", None, None), (4, long, None, None), (5, "x" * 9000, None, None)]
    got = tokens.encode_corpus(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted((r[0] or -1, tuple(brute_ids(r[1]))) for r in rows)
    assert tokens.encode_corpus(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ceilings_are_optimal():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(20):
        h = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 40), 8)}
        lengths = sorted(h)
        pad = lambda ceil: sum(c * (min(x for x in ceil if x >= n) - n) for n, c in h.items())
        least = min(pad([*some, lengths[-1]]) for some in combinations(lengths[:-1], 2))
        got = packing.optimal_ceilings(h, 3)
        assert len(got) <= 3 and pad(got) == least


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([rng.randrange(1, 600), 2048, 5000, 1025])) for i in range(800)] + [(900, None), (901, 0), (902, -4), (903, 7), (903, 7)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), buckets=64).collect()
    fill, parts = defaultdict(int), defaultdict(list)
    for r in got:
        fill[r.container_id] += r.n_tokens
        parts[r.doc_id].append((r.part, r.start, r.n_tokens))
    assert max(fill.values()) <= 2048
    assert sum(fill.values()) == sum(n for _, n in rows if n and n > 0)
    assert len(fill) == max(fill) + 1
    assert sum(fill.values()) / (2048 * len(fill)) > 0.9
    for i, n in rows[:800]:
        own = sorted(parts[i])
        assert sum(p[2] for p in own) == n and len(own) == -(-n // 2048)
        assert [p[1] for p in own] == [2048 * p[0] for p in own]
    assert sorted(parts[903]) == [(0, 0, 7), (0, 0, 7)] and not {900, 901, 902} & set(parts)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0


def brute_shared(texts, span):
    where = defaultdict(set)
    for d, t in texts.items():
        for i in range(len(t) - span + 1):
            where[t[i : i + span]].add(d)
    out = {}
    for d, t in texts.items():
        hit = set()
        for i in range(len(t) - span + 1):
            if len(where[t[i : i + span]]) > 1:
                hit.update(range(i, i + span))
        if hit:
            out[d] = len(hit)
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_shared_spans(spark, hot):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdé 中😀") for _ in range(n))
    passage = make(700)
    texts = {i: make(rng.randrange(0, 500)) for i in range(30)}
    for i in range(0, 24):
        a = rng.randrange(0, 400)
        texts[i] += passage[a : a + rng.randrange(150, 400)] + make(rng.randrange(0, 90))
    texts[40], texts[41], texts[42] = "a" * 400, "a" * 300 + make(50), texts[3]
    texts[43] = "b" * 199
    texts[44] = "b" * 250
    texts[45] = texts[5][:260] + texts[5][:260]
    rows = [(d, t, None, None) for d, t in texts.items()] + [(50, None, None, None), (51, "", None, None), (None, texts[3], None, None), (3, texts[3], "again", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = spans.passages(df, hot=hot)
    got = {r.doc_id: r.shared_chars for r in spans.shared_chars(found).collect()}
    assert got == brute_shared(texts, 200)
    for r in found.collect():
        assert r.doc != r.partner
        for p in r.pieces:
            assert texts[r.doc][p.start : p.end] in texts[r.partner]
    assert spans.passages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 20])
def test_all_partners(spark, hot):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    clauses = [make(320) for _ in range(3)]
    texts = {i: make(40) + clauses[i % 3] + make(30) + (clauses[(i + 1) % 3][:260] if i % 4 == 0 else "") for i in range(24)}
    texts |= {30: texts[4], 31: texts[4], 32: clauses[0] + make(5) + clauses[0], 33: "a" * 300, 34: "a" * 260 + "b"}
    found = spans.passages(spark.createDataFrame([(d, t, None, None) for d, t in texts.items()], SCHEMA), hot=hot).collect()
    windows = {d: {t[i : i + 200] for i in range(len(t) - 199)} for d, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a != b and windows[a] & windows[b]}
    classes = {d: min(x for x in texts if texts[x] == texts[d]) for d in texts}
    pairs = {(r.doc, r.partner) for r in found}
    assert all(r["class"] == classes[r.doc] for r in found)
    assert {(a, b) for a in texts for b in texts if a != b and (classes[a] == classes[b] or (classes[a], classes[b]) in pairs)} == want and pairs <= want
    held = defaultdict(set)
    for r in found:
        held[r.doc, r.partner].update(x for p in r.pieces for x in range(p.start, p.end))
    for a, b in pairs:
        assert held[a, b] == {x for i in range(len(texts[a]) - 199) if texts[a][i : i + 200] in windows[b] for x in range(i, i + 200)}


def test_fuzzy_passages(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh ijklmnop") for _ in range(n))
    base = make(1200)
    changed = "".join(base[i : i + 150] + "#" for i in range(0, 1200, 150))  # no 200 characters agree
    other = make(500) + base[:180] + make(40) + base[180:400] + make(500)
    rows = [(1, base, None, None), (2, make(300) + changed, None, None), (3, other, None, None), (4, make(900), None, None)]
    found = {(r.doc, r.partner): r for r in spans.passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    a = found[1, 2]
    # a stretch of which no seed is left at either end of the copy is not found; the edits are
    assert a.start == 0 and a.end >= 1050 and not a.pieces and a.edits == (a.end - 1) // 150 and a.identity > 0.99
    assert found[2, 1].edits == a.edits and found[2, 1].start == 300 and found[2, 1].identity == a.identity
    b = found[3, 1]
    assert (b.start, b.end, b.partner_start, b.partner_end) == (500, 940, 0, 400) and b.edits == 40 and b.gaps == 1 and [(p.start, p.end) for p in b.pieces] == [(720, 940)]
    assert not any(4 in k for k in found)


def test_edits():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, z in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != z)))
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 80))) for _ in range(2))
        assert spans.edits(a, b) == brute(a, b)


def test_long_text_sections(monkeypatch):
    monkeypatch.setattr(spans, "_BITS", 10)
    text = "".join(random.Random(1).choice("abcd ") for _ in range(5000))
    got = [(at, s) for at, s in spans._sections(text, 200)]
    starts = [at + i for at, s in got for i in range(len(s) - 199)]
    assert starts == list(range(4801)) and all(text[at : at + len(s)] == s for at, s in got)


def test_chain_fenwick():
    assert spans.chain([(0, 200, 50), (230, 440, 285), (900, 1200, 10)]) in ([[0, 1], [2]], [[2], [0, 1]])
    assert sorted(map(len, spans.chain([(0, 200, 500), (210, 420, 0)]))) == [1, 1]
    assert spans.chain([]) == []
