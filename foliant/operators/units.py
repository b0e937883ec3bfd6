"""Quantities recorded in different units, brought to common units.

Every way to record a quantity is a source: a spelling of a unit, a money scale, a way to
mark figures, a column. Sources are nodes of a graph whose edges convert one into another by
scale and offset. Edges are known conversions, or are estimated: records of the same entities
in two sources give a robust scale and offset (median slope from the centre, median of what
remains), which are snapped to a known conversion if near enough. Conversions are composed
along the graph until every source that hangs together with a common unit has its conversion
to it.

What figures with one mark and three digits behind it mean ("1,458", "1.458") is estimated as
well: read with a decimal mark they are a source of their own, which is linked to the column
that records the same entities' numbers; the scale between them, 1 or 1000, decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut

#: How units are spelt. The first spelling names the unit.
SPELLINGS = {
    "mm": "mm millimetre millimetres millimeter millimeters", "cm": "cm centimetre centimetres centimeter centimeters", "m": "m metre metres meter meters mtr mtrs", "km": "km kms kilometre kilometres kilometer kilometers",
    "in": "in inch inches", "ft": "ft foot feet", "yd": "yd yds yard yards", "mi": "mi mile miles",
    "mg": "mg milligram milligrams", "g": "g gm gms gram grams gramme grammes", "kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes", "quintal": "quintal quintals qtl", "t": "t tonne tonnes metric_ton metric_tons mt", "oz": "oz ounce ounces", "lb": "lb lbs pound pounds pound_weight pounds_weight",
    "m2": "m2 m² sq_m sq_metre sq_metres square_metre square_metres square_meter square_meters sqm", "km2": "km2 km² sq_km square_kilometre square_kilometres square_kilometer square_kilometers sqkm", "ha": "ha hectare hectares", "acre": "acre acres", "sqft": "sqft sq_ft sq_feet square_foot square_feet ft² ft2", "sqyd": "sqyd sq_yd square_yard square_yards",
    "ml": "ml millilitre millilitres milliliter milliliters", "cl": "cl centilitre centilitres", "l": "l ltr ltrs litre litres liter liters", "kl": "kl kilolitre kilolitres kiloliter kiloliters", "m3": "m3 m³ cu_m cubic_metre cubic_metres cubic_meter cubic_meters cum",
    "s": "s sec secs second seconds", "min": "min mins minute minutes", "h": "h hr hrs hour hours", "day": "day days", "week": "week weeks wk wks", "fortnight": "fortnight fortnights",
    "bp": "bp bps basis_point basis_points", "permille": "‰ per_mille permille", "percent": "% percent per_cent pct",
    "degc": "°c ℃ deg_c degc degree_celsius degrees_celsius celsius centigrade degrees_centigrade", "degf": "°f ℉ deg_f degf degree_fahrenheit degrees_fahrenheit fahrenheit", "kelvin": "kelvin kelvins k",
    "inr": "inr ₹ rs rs. rupee rupees indian_rupee indian_rupees", "usd": "usd $ us$ dollar dollars us_dollar us_dollars", "eur": "eur € euro euros",
}

#: Known conversions (from, to, scale, offset): to = scale * from + offset.
CONVERSIONS = (
    ("cm", "mm", "10", "0"), ("m", "cm", "100", "0"), ("km", "m", "1000", "0"), ("in", "mm", "25.4", "0"), ("ft", "in", "12", "0"), ("yd", "ft", "3", "0"), ("mi", "yd", "1760", "0"),
    ("g", "mg", "1000", "0"), ("kg", "g", "1000", "0"), ("quintal", "kg", "100", "0"), ("t", "kg", "1000", "0"), ("lb", "kg", "0.45359237", "0"), ("lb", "oz", "16", "0"),
    ("km2", "m2", "1000000", "0"), ("ha", "m2", "10000", "0"), ("acre", "sqyd", "4840", "0"), ("sqyd", "sqft", "9", "0"), ("sqft", "m2", "0.09290304", "0"),
    ("cl", "ml", "10", "0"), ("l", "ml", "1000", "0"), ("kl", "l", "1000", "0"), ("m3", "l", "1000", "0"),
    ("min", "s", "60", "0"), ("h", "min", "60", "0"), ("day", "h", "24", "0"), ("week", "day", "7", "0"), ("fortnight", "week", "2", "0"),
    ("permille", "bp", "10", "0"), ("percent", "permille", "10", "0"),
    ("degc", "centi_degc", "100", "0"), ("degf", "degc", "5/9", "-160/9"), ("kelvin", "degc", "1", "-273.15"),
    ("inr", "inr_paise", "100", "0"), ("usd", "usd_cent", "100", "0"), ("eur", "eur_cent", "100", "0"),
)

#: Scales of money.
SCALES = {"k": 10**3, "thousand": 10**3, "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "lacs": 10**5, "m": 10**6, "mn": 10**6, "mln": 10**6, "million": 10**6, "millions": 10**6, "cr": 10**7, "cr.": 10**7, "crore": 10**7, "crores": 10**7, "bn": 10**9, "billion": 10**9, "billions": 10**9, "trillion": 10**12, "tn": 10**12}
MONEY = ("inr", "usd", "eur")
_ONES = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20))) | {"a": 1, "an": 1}
_TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
_HALVES = {"½": Fraction(1, 2), "¼": Fraction(1, 4), "¾": Fraction(3, 4), "⅓": Fraction(1, 3), "⅔": Fraction(2, 3), "⅛": Fraction(1, 8), "⅜": Fraction(3, 8), "⅝": Fraction(5, 8), "⅞": Fraction(7, 8), "⅕": Fraction(1, 5), "⅖": Fraction(2, 5), "⅗": Fraction(3, 5), "⅘": Fraction(4, 5)}
_UNIT_OF = {s.replace("_", " "): unit for unit, some in SPELLINGS.items() for s in some.split()}
_HEDGE = re.compile(r"^(?:(?:about|approximately|approx\.?|around|circa|c\.|ca\.|nearly|almost|roughly|some|over|under|up to|at least|at most|less than|more than|not less than|not more than|~|≈|<|>|≤|≥|many|total of|sum of)\s*)+", re.I)
_TAIL = re.compile(r"(?:\s*(?:/-|/=|only|approx\.?|or so))+\.?$", re.I)
_NUMBER = re.compile(r"[-−–+]?\s?(?:\d[\d.,'’   ]*\d|\d)")
_FRACTION = re.compile(r"\s*(?:(\d+)\s*/\s*(\d+)|([½¼¾⅓⅔⅛⅜⅝⅞⅕⅖⅗⅘]))")
_MARK = re.compile(r"^(?:US\$|Rs\.?(?![a-z])|INR|USD|EUR|[₹$€])\s*", re.I)


#: Whether one mark with three digits behind it separates thousands, where no estimate says so.
MARKS = {",": True, ".": False}


def read_number(text: str, marks: dict[str, bool] = MARKS) -> Fraction | None:
    """A number in figures, with whichever marks separate its thousands and decimals; ``marks``
    says what one with three digits behind it does."""
    t = re.sub(r"[\s'’  ]", "", text).replace("−", "-").replace("–", "-").lstrip("+")
    sign, t = (-1, t[1:]) if t.startswith("-") else (1, t)
    comma, dot = t.rfind(","), t.rfind(".")
    if re.fullmatch(r"[1-9]\d{0,2}[.,]\d{3}", t):
        t = re.sub(r"[.,]", "" if marks[t[-4]] else ".", t)
    elif comma >= 0 and dot >= 0:
        t = t.replace(".", "").replace(",", ".") if comma > dot else t.replace(",", "")
    elif comma >= 0:
        whole = re.fullmatch(r"[1-9]\d{0,2}(,\d{2,3})*,\d{3}", t)
        t = t.replace(",", "") if whole else t.replace(",", ".") if t.count(",") == 1 else t.replace(",", "")
    elif t.count(".") > 1:
        t = t.replace(".", "")
    return sign * Fraction(t) if re.fullmatch(r"\d+(?:\.\d+)?", t) else None


def read_words(text: str) -> tuple[Fraction, str] | None:
    """(number, rest) of a text that begins with a number in words."""
    parts = re.findall(r"[^\s-]+|[\s-]+", text)
    total, current, used, seen = 0, 0, 0, False
    half = Fraction(0)
    i = 0
    while i < len(parts):
        w = parts[i].lower().strip(",")
        if re.fullmatch(r"[\s-]+", parts[i]) or (w == "and" and seen):
            i += 1
            continue
        if w == "half" and seen:
            current, half = current - (1 if used and parts[used - 1].lower() in ("a", "an") else 0), Fraction(1, 2)
        elif w == "hundred" and seen:
            current *= 100
        elif w == "thousand" and seen:
            total, current = total + current * 1000, 0
        elif w in _ONES and not (w in ("a", "an") and not seen and not re.search(r"\bhundred|thousand\b", text.lower())):
            current += _ONES[w]
        elif w in _TENS:
            current += _TENS[w]
        else:
            glued = next((n for n in sorted({**_ONES, **_TENS}, key=len, reverse=True) if len(n) > 2 and w.startswith(n) and w[len(n) :] in SCALES), None)
            if glued:
                current += {**_ONES, **_TENS}[glued]
                return Fraction(total + current) + half, w[len(glued) :] + " " + "".join(parts[i + 1 :])
            break
        seen = True
        i += 1
        used = i
    if not seen:
        return None
    rest = "".join(parts[used:]).strip()
    return Fraction(total + current) + half, rest


def unit_of(text: str) -> str | None:
    t = " ".join(text.replace("_", " ").split()).strip()
    for form in (t, t.rstrip(".")):
        if form == "K":
            return "kelvin"
        found = _UNIT_OF.get(form.lower()) or _UNIT_OF.get(form.lower().replace(".", ""))
        if found and not (found == "kelvin" and form == "k"):
            return found
    return None


def money_of(text: str) -> tuple[str | None, int | None]:
    """(currency, scale) of what stands behind an amount: a scale, a currency, or both."""
    t = " ".join(text.split())
    if not t:
        return None, 1
    low = t.lower()
    for name in sorted(SCALES, key=len, reverse=True):
        if low == name or low.startswith(name + " "):
            rest = t[len(name) :].strip()
            currency = unit_of(rest) if rest else None
            return (currency, SCALES[name]) if not rest or currency in MONEY else (None, None)
    currency = unit_of(t)
    return (currency, 1) if currency in MONEY else (None, None)


def read_quantity(text: str | None, unit: str | None = None, currency: str | None = None, scale: str | None = None, marks: dict[str, bool] = MARKS) -> tuple[str | None, Fraction] | None:
    """(unit, value) of a text that is one quantity, None if it is none. What the text does not
    say is taken from ``unit``, or ``currency`` and ``scale``; the unit is None if nothing says
    it. Hedges are ignored; parts of a compound (feet and inches) are added in the first's unit."""
    if not text or not text.strip():
        return None
    t = _TAIL.sub("", " ".join(text.split()))
    t = _HEDGE.sub("", t)
    said = None
    if m := _MARK.match(t):
        said, t = unit_of(m[0].strip()), t[m.end() :]
        t = _HEDGE.sub("", t)
    if m := re.match(r"^[^\d()]*\((\d[\d,.]*)\)\s*", t):  # in words and, in brackets, in figures
        t = f"{m[1]} {t[m.end() :]}"
    value, rest = None, t
    if m := _NUMBER.match(t):
        figures = m[0]
        f = _FRACTION.match(t, m.end())
        split = re.match(r"([-−–+]?\s?\d[\d,]*?)\s+(\d+)$", figures)  # "5 1/2": the first figure belongs to the fraction
        if split and re.match(r"\s*/\s*\d", t[m.end() :]):
            figures = split[1]
            f = _FRACTION.match(t, m.start() + len(split[1]))
        elif not f and re.match(r"\s*/\s*\d", t[m.end() :]):
            return None
        value = read_number(figures, marks)
        if value is None:
            return None
        end = m.start() + len(figures)
        if f:
            if f[2] == "0":
                return None
            part = _HALVES[f[3]] if f[3] else Fraction(int(f[1]), int(f[2]))
            value += part if value >= 0 and not figures.strip().startswith(("-", "−", "–")) else -part
            end = f.end()
        rest = t[end:].strip()
    elif m := re.match(r"^([½¼¾⅓⅔⅛⅜⅝⅞⅕⅖⅗⅘])\s*", t):
        value, rest = _HALVES[m[1]], t[m.end() :]
    elif words := read_words(t):
        value, rest = words
    if value is None:
        return None
    rest = _TAIL.sub("", rest).strip()
    if said:
        own, times = money_of(rest)
        return (said, value * times) if times and own in (None, said) else None
    if not rest:
        if currency and unit_of(currency) in MONEY:
            times = SCALES.get((scale or "").lower().strip(), 1 if not scale else None)
            return (unit_of(currency), value * times) if times else None
        return (unit_of(unit) if unit else None), value
    own, times = money_of(rest)
    if times and own:
        return own, value * times
    if times and currency and unit_of(currency) in MONEY:
        return unit_of(currency), value * times
    if u := unit_of(rest):
        return u, value
    if m := re.match(r"^([^\d]+?)\s*,?\s*(?:and\s+)?(\d.*)$", rest):  # a compound
        first, more = unit_of(m[1]), read_quantity(m[2], marks=marks)
        if first and more and more[0]:
            ways = conversions((first,))
            if more[0] in ways:
                a, b = ways[more[0]]
                if b == 0:
                    return first, value + a * more[1]
    return None


def conversions(targets: tuple[str, ...], links: tuple = CONVERSIONS) -> dict[str, tuple[Fraction, Fraction]]:
    """{source: (scale, offset)} to the target each source hangs together with, composed along
    the graph of ``links`` by breadth first, so along a shortest chain of conversions."""
    edges: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for a, b, scale, offset in links:
        s, o = Fraction(scale), Fraction(offset)
        edges.setdefault(b, []).append((a, s, o))  # from a to b
        edges.setdefault(a, []).append((b, 1 / s, -o / s))  # and back
    known = {t: (Fraction(1), Fraction(0)) for t in targets}
    queue = list(targets)
    while queue:
        at = queue.pop(0)
        s, o = known[at]
        for other, es, eo in edges.get(at, ()):
            if other not in known:
                known[other] = (s * es, s * eo + o)
                queue.append(other)
    return known


def reachable(targets: list[str], links: tuple = CONVERSIONS) -> dict[str, tuple[str, Fraction, Fraction]]:
    """{source: (target, scale, offset)} for several targets that do not hang together."""
    out: dict[str, tuple[str, Fraction, Fraction]] = {}
    for t in targets:
        for source, (s, o) in conversions((t,), links).items():
            out.setdefault(source, (t, s, o))
    return out


_RECORD = "entity string, source string, value double"


def estimate_links(records: DataFrame, least: int = 8) -> DataFrame:
    """(a, b, n, scale, offset): for sources a < b that record the same ``least`` entities or
    more, b = scale * a + offset, robust against a minority of wrong records.

    ``records`` has (entity, source, value); an entity's records in a source count by their
    median, nulls and NaN not at all. Sources whose values do not vary give the scale as ratio
    of medians. Pairs are formed by entity, so there are as many as an entity has sources.
    """
    clean = records.filter("entity IS NOT NULL AND source IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").groupBy("entity", "source").agg(F.percentile_approx("value", 0.5).alias("value"))
    x = clean.select("entity", F.col("source").alias("a"), F.col("value").alias("x"))
    y = clean.select("entity", F.col("source").alias("b"), F.col("value").alias("y"))
    both = cut(x.join(y, "entity").filter("a < b"), "linked-records")
    mid = lambda c: F.percentile_approx(c, 0.5, 10_000)
    centres = both.groupBy("a", "b").agg(F.count("*").alias("n"), mid("x").alias("mx"), mid("y").alias("my")).filter(F.col("n") >= least)
    spread = both.join(F.broadcast(centres), ["a", "b"]).withColumn("dx", F.abs(F.col("x") - F.col("mx"))).withColumn("dy", F.abs(F.col("y") - F.col("my")))
    # the slope of a record from the centre; its median is robust and keeps the sign
    slope = F.when(F.col("dx") > 1e-9 * F.greatest(F.lit(1.0), F.abs("mx")), (F.col("y") - F.col("my")) / (F.col("x") - F.col("mx")))
    slopes = spread.groupBy("a", "b").agg(mid(slope).alias("slope"), F.first("n").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"))
    scaled = slopes.withColumn("scale", F.coalesce("slope", F.when(F.col("mx") != 0, F.col("my") / F.col("mx")), F.lit(1.0)))
    rest = both.join(F.broadcast(scaled.select("a", "b", "n", "scale")), ["a", "b"]).withColumn("r", F.col("y") - F.col("scale") * F.col("x"))
    return rest.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("scale").alias("scale"), mid("r").alias("offset"))


def snap(scale: float, offset: float, size: float, tolerance: float = 0.01) -> tuple[Fraction, Fraction] | None:
    """The known conversion next to an estimate: scale within the tolerance, and offset within
    the tolerance of the known offset or of ``size``, the usual size of values of the target."""
    best = None
    ways = {(Fraction(1), Fraction(0))} | {(Fraction(s), Fraction(o)) for _, _, s, o in CONVERSIONS} | {(Fraction(n), Fraction(0)) for n in SCALES.values()}
    for unit in SPELLINGS:
        for s, o in conversions((unit,)).values():
            ways.add((s, o))
    for s, o in ways | {(1 / s, -o / s) for s, o in ways}:
        if abs(scale - float(s)) <= tolerance * abs(float(s)) and abs(offset - float(o)) <= tolerance * max(abs(float(o)), abs(size), 1e-9):
            miss = abs(scale / float(s) - 1) + abs(offset - float(o)) / max(abs(float(o)), abs(size), 1e-9)
            if best is None or miss < best[0]:
                best = (miss, s, o)
    return best[1:] if best else None


def align(records: DataFrame, common: list[str], least: int = 8) -> tuple[DataFrame, dict[str, tuple[str, Fraction, Fraction]]]:
    """The records in common units: (entity, source, target, amount), and the conversions used.

    Sources named as units are converted by known conversions, the others by estimated links
    that snap to a known conversion. Records of sources that hang together with no common
    source are left out. The estimates are one row for each pair of sources.
    """
    estimates = estimate_links(records, least)
    sizes = {r["source"]: r["size"] for r in records.groupBy("source").agg(F.percentile_approx(F.abs("value"), 0.5).alias("size")).collect()}  # a row for each source
    links = list(CONVERSIONS)
    for r in estimates.collect():
        found = snap(r["scale"], r["offset"], sizes.get(r["b"]) or 1.0)
        if found:
            links.append((r["a"], r["b"], str(found[0]), str(found[1])))
    ways = reachable(common, tuple(links))
    rows = [(s, t, float(a), float(b)) for s, (t, a, b) in sorted(ways.items()) if s in sizes]
    table = records.sparkSession.createDataFrame(rows, "source string, target string, scale double, shift double")
    joined = records.join(F.broadcast(table), "source")
    return joined.select("entity", "source", "target", (F.col("scale") * F.col("value") + F.col("shift")).alias("amount")), ways


_OTHER = re.compile(r"^([-−–+]?\s?\d[\d.,]*)\s*([^\W\d]{1,20}\.?(?: [^\W\d]{1,20}\.?){0,2})$")


def _read(batches: Iterator[pd.DataFrame], marks: dict[str, bool] = MARKS) -> Iterator[pd.DataFrame]:
    """Texts as a source and a value; a unit nobody knows is a source by its own name."""
    for f in batches:
        out = []
        for text, unit, currency, scale in zip(f["text"], f["unit"], f["currency"], f["scale"]):
            found = read_quantity(text, unit, currency, scale, marks)
            if found is None and (m := _OTHER.match(_HEDGE.sub("", " ".join((text or "").split())))) and (value := read_number(m[1], marks)) is not None:
                found = (f"text:{m[2].casefold()}", value)
            out.append(found if found and found[0] else (None, None))
        yield pd.concat([f.reset_index(drop=True), pd.DataFrame({"source": [s for s, _ in out], "value": [None if v is None else str(v) for _, v in out]})], axis=1)


def _converted(batches: Iterator[pd.DataFrame], ways: dict[str, tuple[str, Fraction, Fraction]]) -> Iterator[pd.DataFrame]:
    for f in batches:
        out = []
        for source, value in zip(f["source"], f["value"]):
            target, s, o = ways.get(source, (None, None, None))
            amount = round(s * Fraction(value) + o) if target else None  # exact fractions; of two nearest the even one
            out.append((target, amount) if target and abs(amount) < 2**63 else (None, None))
        yield pd.concat([f.drop(columns=["source", "value"]).reset_index(drop=True), pd.DataFrame({"target": [t for t, _ in out], "amount": pd.array([a for _, a in out], dtype="Int64")})], axis=1)


def _units_of(names: pd.Series) -> pd.Series:
    return names.map(lambda n: unit_of(n) if n else None)


def _floats(values: pd.Series) -> pd.Series:
    return values.map(lambda v: float(Fraction(v)))


def _second_records(read: DataFrame, held: DataFrame, cond) -> DataFrame:
    """(entity, source, value) of quantities in a unit nobody knows whose entity states the
    quantity once more, as a number in a known unit."""
    other = held.alias("h").join(read.filter("source LIKE 'text:%'").alias("r"), cond).filter("h.number IS NOT NULL AND h.unit IS NOT NULL")
    known = F.pandas_udf(_units_of, "string")
    number = F.expr("try_cast(h.number AS double)")
    value = F.pandas_udf(_floats, "double")
    rows = other.select(F.col("h.entity_id").alias("entity"), F.array(F.struct(F.col("r.source").alias("source"), value("r.value").alias("value")), F.struct(known("h.unit").alias("source"), number.alias("value"))).alias("x"))
    return rows.select("entity", F.explode("x").alias("x")).select("entity", "x.source", "x.value").filter("source IS NOT NULL AND value IS NOT NULL")


def marks_of(held: DataFrame) -> dict[str, bool]:
    """What each mark with three digits behind it separates, by the scale between such figures
    read as decimals and the number recorded for their entity (entity_id, text, number); as
    usual for a mark that too few entities have. One row for each of the two marks is collected."""
    figures = F.regexp_extract("text", r"^[^\d.,]*(?<!\d)([1-9]\d{0,2}[.,]\d{3})(?![\d.,])[^\d]*$", 1)
    seen = held.select(F.col("entity_id").alias("entity"), figures.alias("f"), F.abs(F.expr("try_cast(number AS double)")).alias("recorded")).filter("f <> '' AND recorded IS NOT NULL")
    mark = F.concat(F.lit("mark"), F.regexp_extract("f", "[.,]", 0))
    each = F.array(F.struct(mark.alias("source"), F.regexp_replace("f", ",", ".").cast("double").alias("value")), F.struct(F.lit("number").alias("source"), F.col("recorded").alias("value")))
    links = estimate_links(seen.select("entity", F.explode(each).alias("x")).select("entity", "x.source", "x.value"))
    said = {}
    for r in links.collect():  # number and a mark: two rows at most
        if r["b"] == "number" or r["a"] == "number":
            scale = r["scale"] if r["b"] == "number" else 1 / r["scale"] if r["scale"] else 0.0
            found = snap(scale, 0.0, 1.0)
            if found and found[0] in (1, 1000):
                said[(r["a"] if r["b"] == "number" else r["b"])[-1]] = found[0] == 1000
    return {**MARKS, **said}


def common_quantities(mentions: DataFrame, entities: DataFrame, common: DataFrame) -> DataFrame:
    """(mention_id, unit, amount): each mention of a quantity of known unit in the unit of its
    dimension in ``common`` (dimension, unit), rounded to the nearest whole number.

    ``mentions`` has (mention_id, entity_id, text), ``entities`` (entity_id, metadata). A unit
    the text does not say is taken from the metadata (unit, uom, or currency and scale). Texts
    that are null, empty or no quantity, quantities without a unit anywhere and null keys give
    no row; a repeated mention counts once; empty tables give no rows. Equal texts with equal
    metadata are read once. What marks in figures mean follows the numbers recorded for the
    same entities (``marks_of``). A unit nobody knows is converted if enough entities that use
    it state the same quantities in a known unit (``estimate_links``, ``snap``).
    """
    targets = [r["unit"] for r in common.select("unit").distinct().orderBy("unit").collect() if r["unit"]]  # one for each dimension
    words = "|".join([*(w for w in _ONES if len(w) > 2), *_TENS, "hundred"])
    likely = mentions.filter(F.col("mention_id").isNotNull() & F.col("text").rlike(rf"[0-9½¼¾⅓⅔⅛⅜⅝⅞]|(?i)\b({words})")).select("mention_id", "entity_id", "text").dropDuplicates(["mention_id"])
    m = F.col("metadata")
    meta = entities.filter("entity_id IS NOT NULL").select("entity_id", F.coalesce(m["unit"], m["uom"]).alias("unit"), m["currency"].alias("currency"), m["scale"].alias("scale"), m["numeric_value"].alias("number")).dropDuplicates(["entity_id"])
    held = cut(likely.join(meta, "entity_id", "left"), "quantities")
    keys = ["text", "unit", "currency", "scale"]
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"h.{k}").eqNullSafe(F.col(f"r.{k}"))
    said = "text string, unit string, currency string, scale string"
    marks = marks_of(held)
    read = cut(held.select(*keys).distinct().mapInPandas(lambda it: _read(it, marks), f"{said}, source string, value string").filter("source IS NOT NULL"), "quantities-read")
    links = list(CONVERSIONS)
    second = cut(_second_records(read, held, cond), "second-records")
    if not second.isEmpty():
        sizes = {r["source"]: r["size"] for r in second.groupBy("source").agg(F.percentile_approx(F.abs("value"), 0.5).alias("size")).collect()}  # known units, and unknown ones that recur
        for r in estimate_links(second).collect():
            if found := snap(r["scale"], r["offset"], sizes.get(r["b"]) or 1.0):
                links.append((r["a"], r["b"], str(found[0]), str(found[1])))
    ways = reachable(targets, tuple(links))
    done = read.mapInPandas(lambda it: _converted(it, ways), f"{said}, target string, amount bigint").filter("amount IS NOT NULL")
    return held.alias("h").join(done.alias("r"), cond).select("h.mention_id", F.col("r.target").alias("unit"), "r.amount")
