"""Splitting, near-duplicates and nearest vectors against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import near, neighbours, split


def test_split(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    prose = " ".join(word().capitalize() + " " + " ".join(word() for _ in range(9)) + "." for _ in range(400))
    shapes = {
        "prose": prose,
        "paragraphs": prose.replace(". ", ".\n\n", 30),
        "lines": "\n".join(word() * 9 for _ in range(200)),
        "no blanks": "x" * 10_000,
        "wide": "😀漢" * 3000,
        "short": "short text",
        "limit": "y" * 2051,
        "over": "y" * 2052,
        "empty": "",
        "blank": " " * 5000,
        "crlf": "ab cd\r\n\r\n" * 900,
    }
    rows = [(k, v, "t", 1) for k, v in shapes.items()] + [("null", None, None, None), (None, "z" * 3000, None, 0)]
    df = spark.createDataFrame(rows, "document string, text string, piece string, tokens int")
    got = split.split_oversized(df, ["document"], "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.document, []).append(r)
    assert "null" not in by and len(by[None]) == 2
    for k, t in shapes.items():
        own = sorted(by[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.pieces == len(own) for r in own)
        assert "".join(r.piece_text[r.overlap_chars :] for r in own) == t
        for r in own:
            assert t[r.start : r.start + len(r.piece_text)] == r.piece_text
            assert r.tokens == max(1, len(r.piece_text) // 4) <= 512 and r.overlap_chars <= 256
        assert (len(own) > 1) == (len(t) // 4 > 512)
    for k in ("prose", "paragraphs"):
        assert all(re.search(r"[.]\s+\Z", r.piece_text) for r in sorted(by[k], key=lambda r: r.piece)[:-1])
        assert all(r.overlap_chars > 0 and re.match(r"[A-Z]", r.piece_text) for r in by[k] if r.piece)
    assert split.split_oversized(df.limit(0), ["document"], "text").count() == 0


def brute_pairs(rows, t=0.7):
    norm = {i: re.sub("[^a-z0-9]+", " ", x.lower()).strip() for i, x in rows if i is not None and x}
    sets = {i: near.grams(x) for i, x in norm.items() if x}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.mark.parametrize("least", [2048, 40])
def test_near_pairs(spark, least):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 10))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 25, 60, 700]))) for _ in range(60)]
    for i in range(140):
        own = texts[rng.randrange(60)].split(" ")
        for _ in range(rng.randrange(0, 1 + len(own) // 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.2:
            own = own[len(own) // 2 :] + own[: len(own) // 2]
        texts.append(" ".join(own).upper() if i % 3 else " ".join(own))
    texts += ["abc", "ABC!", "ab", "abcd", "abcde", "?!", "", None, "Ünïcode ab", "nïcode ab"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])]
    df = spark.createDataFrame([(i, x, i) for i, x in rows], "query_id bigint, question string, id bigint")
    got = [(r.id_a, r.id_b) for r in near.near_pairs(df, "query_id", "question", least=least).collect()]
    true = brute_pairs(rows)
    assert len(got) == len(set(got)) and set(got) == true and len(true) > 50
    by = {r.id: r for r in near.near_classes(df, "query_id", "question", least=least).collect()}
    heads = {r["class"] for r in by.values()}
    assert sum(r.links for r in by.values() if r.id == r["class"]) == 2 * sum(a in heads and b in heads for a, b in true)
    assert near.near_pairs(df.limit(0), "query_id", "question").count() == 0


def test_axes_lose_no_pair_and_rule_out_the_rest():
    """Texts of one vocabulary share much; few of their pairs may be left to be checked on the texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(8)) for _ in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(35, 60))) for _ in range(350)]
    for i in range(200):
        own = texts[i].split(" ")
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += ["abc", "abcd", words[0], " ".join(words * 3), texts[0] + " " + texts[1]]
    sets = [near.grams(x) for x in texts]
    row, codes = near.distinct(texts)
    assert np.bincount(row).tolist() == [len(x) for x in sets] and len(set(zip(row.tolist(), codes.tolist()))) == len(row)
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    true = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if share(a, b) >= 0.7}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "norm"])
    signed = pa.Table.from_batches(near._signatures(iter([batch]), 0.7, 1024)).to_pandas()
    other = np.random.default_rng(1).integers(0, 256, size=(50, 128), dtype=np.uint8)
    for m in (near.bitmaps(row, codes, len(texts), 1024), other, other[:1] * 0):
        mean, along = near.axes(m)
        assert np.allclose(along.T @ along, np.eye(along.shape[1]), atol=1e-5)
        for tile in (256, 7):
            got = near.compare(signed, signed, True, 0.7, mean, along, tile)
            found = set(zip(got.id_a, got.id_b))
            assert len(found) == len(got) and true <= found and len(found) < 1.2 * len(true) and len(true) > 120
            halves = near.compare(signed[::2], signed[1::2], False, 0.7, mean, along, tile)
            assert set(zip(halves.id_a, halves.id_b)) == {(a, b) for a, b in found if (a + b) % 2}


def test_blocks_cover_all_sizes():
    rng = random.Random(2)
    for rows in (5, 50, 5000):
        h = [(n, rng.randrange(1, 60)) for n in rng.sample(range(1, 900), 200)]
        spread, reach = near.blocks_of(h, 0.7, rows, 1)
        where = {n: set(range(b, b + k)) for n, b, k in spread}
        span = {b: range(x, y + 1) for b, x, y in reach}
        assert sorted(span) == list(range(len(span))) == sorted({b for s in where.values() for b in s})
        assert all(a in span[b] for a in span for b in span[a])
        for n in where:
            for m in where:
                if n <= m and n >= 0.7 * m:
                    assert all(b in span[a] for a in where[n] for b in where[m])


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    x = np.repeat(centres, 10, axis=0) + rng.normal(size=(600, 64)) * 0.25
    x *= rng.uniform(0.5, 3, size=(600, 1))
    rows = [(f"c{i:04d}", [float(v) for v in np.float32(r)], 1) for i, r in enumerate(x)]
    same = rows[0][1]
    rows += [(f"t{i:02d}", same, 2) for i in range(12)]
    rows += [("bad1", None, 0), ("bad2", [0.0] * 64, 0), ("bad3", [1.0] * 32, 0), ("bad4", [math.nan] + [1.0] * 63, 0), ("bad5", [math.inf] + [1.0] * 63, 0), ("bad6", [None] + [1.0] * 63, 0), (None, same, 0), rows[5]]
    df = spark.createDataFrame(rows, "cache_id string, embedding array<float>, a int")
    good = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows if r[0] and not r[0].startswith("bad")}
    ids = sorted(good)
    m = np.array([good[i] for i in ids])
    cos = np.round(m @ m.T, 9)
    np.fill_diagonal(cos, -2)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.lexsort((np.arange(len(ids)), -cos[i]))[:5] if cos[i, j] >= 0.85}
    for tile in (4096, 4):
        got = neighbours.nearest(df, "cache_id", "embedding", floor=0.85, tile=tile).collect()
        pairs = {(r.a, r.b) for r in got}
        assert len(pairs) == len(got) and max(r["rank"] for r in got) == 5
        assert len(pairs & want) / len(want) >= 0.95 and len(pairs - want) <= 0.05 * len(want)
        assert {r.b for r in got if r.a == "t11"} == {"c0000", "t00", "t01", "t02", "t03"}
    assert neighbours.nearest(df.limit(0), "cache_id", "embedding").count() == 0


def test_hadamard_is_orthogonal():
    h = neighbours.hadamard(np.eye(64))
    assert np.allclose(h @ h.T, np.eye(64))
