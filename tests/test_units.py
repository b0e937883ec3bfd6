"""Quantities: reading, conversion, estimated links."""

from fractions import Fraction

import pytest

from foliant.operators import units

COMMON = [("money", "inr_paise"), ("money", "usd_cent"), ("money", "eur_cent"), ("temperature", "centi_degc"), ("area", "m2"), ("duration", "s"), ("length", "mm"), ("mass", "g"), ("ratio", "bp"), ("volume", "ml")]

CASES = {
    "six hundred and sixteen kilometres": ("mm", 616_000_000), "fifty-eight and a half fortnights": ("s", 70_761_600), "eighty-twok USD": ("usd_cent", 8_200_000), "many (1881) days": ("s", 162_518_400),
    "5 hours 30 min": ("s", 19_800), "9 ft 4 in": ("mm", 2845), "568 1/2 yards": ("mm", 519_836), "1766k dollars": ("usd_cent", 176_600_000), "Rs 12.73Cr": ("inr_paise", 12_730_000_000),
    "€8.293.020,00": ("eur_cent", 829_302_000), "Rs 7,85,76,377/-": ("inr_paise", 7_857_637_700), "-12.5 deg F": ("centi_degc", -2472), "389.5 K": ("centi_degc", 11_635), "up to  1,142\xa0ltr": ("ml", 1_142_000),
    "about 9½ oz": ("g", 269), "22,8 metres": ("mm", 22_800), "0,5 kg": ("g", 500), "1,458 ha": ("m2", 14_580_000), "12.25 %": ("bp", 1225), "7 ‰": ("bp", 70), "one hundred rupees only": ("inr_paise", 10_000), "2 sq. ft.": ("m2", 0),
}


def test_texts():
    ways = units.reachable([u for _, u in COMMON])
    for text, want in CASES.items():
        unit, value = units.read_quantity(text)
        target, s, o = ways[unit]
        assert (target, round(s * value + o)) == want, text
    for text in ("Clause 2.4", "Form 45A", "INV-205", "Q1 2025", "FY2016", "Section 4(0)", "version 4.5", "Annexure 2-8", "", None, "   ", "five", "Rs", "1/0 m", "3 apples", "m" * 5000):
        found = units.read_quantity(text)
        assert found is None or found[0] is None, text
    assert units.read_quantity("1,458") == (None, Fraction(1458)) and units.read_quantity("94.93", currency="USD", scale="M") == ("usd", Fraction(94_930_000))
    assert units.read_quantity("5 km", unit="kg") == ("km", Fraction(5)) and units.read_quantity("-3", unit="°F") == ("degf", Fraction(-3))


def test_marks_are_estimated(spark):
    """In a country where the comma marks decimals, figures say so by the numbers recorded."""
    kind = "entity_id string, text string, number string"
    rows = [(f"e{i}", f"{i + 2},{100 + i} kg", f"{i + 2}.{100 + i}") for i in range(20)] + [(f"d{i}", f"about {i + 1}.{200 + i} m", f"{i + 1}{200 + i}") for i in range(20)]
    assert units.marks_of(spark.createDataFrame(rows, kind)) == {",": False, ".": True}
    usual = [(f"e{i}", f"{i + 2},{100 + i} kg", f"{i + 2}{100 + i}") for i in range(20)] + [("x", "1.234", "1.234"), ("y", "5,678", None), (None, "5,678", "5"), ("z", None, "5")]
    usual[3:6] = [(f"e{i}", f"{i + 2},{100 + i} kg", "7") for i in range(3, 6)]  # a minority is wrong
    assert units.marks_of(spark.createDataFrame(usual, kind)) == units.MARKS == units.marks_of(spark.createDataFrame([], kind))
    assert units.read_quantity("1,458 kg", marks={",": False, ".": True}) == ("kg", Fraction("1.458")) and units.read_quantity("1.458 kg", marks={",": False, ".": True}) == ("kg", Fraction(1458))


def test_conversions_compose():
    assert units.conversions(("mm",))["mi"] == (Fraction(1609344), 0)
    s, o = units.conversions(("degf",))["kelvin"]
    assert float(s * Fraction("273.15") + o) == pytest.approx(32)


def test_estimates_snap(spark):
    rows = [(f"e{i}", "x", float(3 * i + 1)) for i in range(60)] + [(f"e{i}", "y", (3 * i + 1) * 1.8 + 32) for i in range(60)] + [(f"e{i}", "z", 1000.0 * (3 * i + 1)) for i in range(30, 60)]
    rows[60:70] = [(f"e{i}", "y", 7.0) for i in range(10)]  # a minority is wrong
    rows += [("e1", "w", 1.0), (None, "x", 1.0), ("e2", None, 1.0), ("e3", "x", None), ("e4", "x", float("nan"))]
    df = spark.createDataFrame(rows, "entity string, source string, value double")
    got = {(r.a, r.b): (r.scale, r.offset) for r in units.estimate_links(df).collect()}
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}
    assert units.snap(*got["x", "y"], 100) == (Fraction(9, 5), 32) and units.snap(*got["x", "z"], 1e5) == (1000, 0)
    assert units.snap(1.37, 0, 10) is None
    assert units.estimate_links(df.limit(0)).count() == 0


def test_align(spark):
    rows = [(f"e{i}", "kg", float(i + 1)) for i in range(40)] + [(f"e{i}", "scale_a", 1000.0 * (i + 1)) for i in range(20)] + [(f"f{i}", "scale_a", 500.0) for i in range(3)] + [("g", "alone", 5.0)]
    got, ways = units.align(spark.createDataFrame(rows, "entity string, source string, value double"), ["g"])
    assert ways["scale_a"] == ("g", 1, 0)
    by = {(r.entity, r.source): r.amount for r in got.collect()}
    assert by["f0", "scale_a"] == 500 and by["e4", "kg"] == 5000 and ("g", "alone") not in by


def test_mentions(spark):
    texts = [*CASES, None, "", "1,458", "94.93", "Clause 3.1", "x" * 100_000]
    mentions = [(i, f"e{i}", t, "u", 1) for i, t in enumerate(texts)] + [(0, "e0", texts[0], "u", 1), (None, "e0", texts[0], "u", 1), (900, None, "5 kg", "u", 1), (901, "nobody", "5 kg", "u", 1)]
    at = len(CASES)
    meta = {at + 2: {"unit": "kg"}, at + 3: {"currency": "USD", "scale": "M", "numeric_value": "94.93"}}
    entities = [(f"e{i}", meta.get(i), "z") for i in range(len(texts))] + [("e0", None, "z")]
    # a unit nobody knows, used by entities that also state kilograms
    mentions += [(1000 + i, f"k{i}", f"{i + 2} pecks", "u", 1) for i in range(12)] + [(1100, "k99", "10 pecks", "u", 1)]
    entities += [(f"k{i}", {"unit": "kg", "numeric_value": str((i + 2) * 100)}, "z") for i in range(12)] + [("k99", None, "z")]
    m = spark.createDataFrame(mentions, "mention_id bigint, entity_id string, text string, unit string, amount int")
    e = spark.createDataFrame(entities, "entity_id string, metadata map<string,string>, text string")
    c = spark.createDataFrame([*COMMON, (None, None)], "dimension string, unit string")
    got = {r.mention_id: (r.unit, r.amount) for r in units.common_quantities(m, e, c).collect()}
    want = {i: v for i, v in enumerate(CASES.values())} | {at + 2: ("g", 1_458_000), at + 3: ("usd_cent", 9_493_000_000), 900: ("g", 5000), 901: ("g", 5000)}
    want |= {1000 + i: ("g", (i + 2) * 100_000) for i in range(12)} | {1100: ("g", 1_000_000)}
    assert got == want
    assert units.common_quantities(m.limit(0), e.limit(0), c).count() == 0 and units.common_quantities(m, e, c.limit(0)).count() == 0
