"""Text functions: all built-in expressions, so they stay inside code generation.

Nulls give nulls unless said otherwise; letters and digits are those of Unicode where a
pattern names them by property, ASCII where it says ``\\w`` or ``a-z``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- Fixed values ---------------------------------------------------------------------------
SUFFIXES = ("nesses", "ations", "ments", "iness", "ation", "ings", "ness", "ment", "ers", "ing", "ion", "ies", "ful", "ed", "er", "es", "ly", "s")
EVALUATION_STOPWORDS = "the a an is are was were of in to and or that this it for on with as at by from be has have had not its their they which who what how when where".split()
CONFIDENCE_STOPWORDS = "the a an is are was were of in to and or that this it for on with as at by from be has have had not".split()
RELATION_STOPWORDS = "a an the is are was were be been being by of to for from with in on at as and or all every list show give display enumerate their its his her".split()
BAD_SUMMARY_MARKERS = ("partial summary 1", "please provide", 'provided "partial summary', "provided partial summary", "is incomplete", "i apologize")
ENTITY_PREFIX = (
    r"(?i)^(?:company|corporation|corp\.?|subsidiary|investor|shareholder|founder|ceo|executive|board\s+member|person|billionaire|entrepreneur|project|product|business\s+unit|contract|agreement|partnership|invoice|payment|transaction|"
    r"revenue|profit|loss|expense|cashflow|asset|liability|equity|stock|bond|fund|etf|bank|financial\s+institution|department|employee|country|city|region|quarter|fiscal\s+year|date)\s+"
)
EXACT_LABELS = ("AMOUNT", "CURRENCY", "DATE", "DIVIDEND", "FISCAL_YEAR", "MARKET_CAP", "PERCENTAGE", "PROFIT", "QUARTER", "REVENUE", "LOSS")
NUMERIC_LABELS = ("REVENUE", "PROFIT", "LOSS", "EXPENSE", "CASHFLOW", "PAYMENT", "TRANSACTION", "ASSET", "LIABILITY", "EQUITY")
MULTIPLIERS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "billion": 1e9, "trillion": 1e12}
SECTION = r"(?i)^\s*(?:section|article|clause|schedule|exhibit|annexure)?\s*(?:\d+(?:\.\d+)*|[A-Z])[\).:-]?\s+[A-Z][A-Za-z0-9 ,&/()-]{3,120}$"
CHARS_PER_TOKEN = 4
# -------------------------------------------------------------------------------------------

BREAK = "\x01"


def clean_ocr(text: Column) -> Column:
    """Line ends unified, words joined over a hyphen and line end, lines of one sentence joined,
    blanks and empty lines collapsed."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N}_])-\n(?=[\p{L}\p{N}_])", "")
    t = F.regexp_replace(t, r"(?<![.!?:;])\n(?=[a-z0-9(])", " ")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def tokens_approx(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("int")


def sentences(text: Column) -> Column:
    """Sentences: split behind . ! ? before a capital or quote, and at empty lines."""
    t = F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r"\n{3,}", "\n\n")
    parts = F.split(t, "(?<=[.!?])\\s+(?=[A-Z\"‘’])|(?<=\n)\\s*\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def words(text: Column) -> Column:
    """Lower-case tokens between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """A lower-case word less the first suffix of the list that leaves three characters.
    Comparisons of endings, as they cost a tenth of a regular expression."""
    out = None
    for suffix in SUFFIXES:
        n = len(suffix)
        cond, cut = word.endswith(suffix) & (F.length(word) >= n + 3), word.substr(F.lit(1), F.length(word) - n)
        out = F.when(cond, cut) if out is None else out.when(cond, cut)
    return out.otherwise(word)


def stemmed(word: str) -> str:
    """``stem`` of a word in Python."""
    for suffix in SUFFIXES:
        if word.endswith(suffix) and len(word) >= len(suffix) + 3:
            return word[: len(word) - len(suffix)]
    return word


def token_set(text: Column, stopwords: list[str], stemmed: bool) -> Column:
    """Distinct tokens without punctuation and stopwords, sorted; null gives none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    kept = F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*stopwords))
    return F.array_sort(F.array_distinct(F.transform(kept, stem) if stemmed else kept))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common members over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def recall(a: Column, b: Column) -> Column:
    """Share of ``a`` found in ``b``; 0 if ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def normalise_question(text: Column) -> Column:
    """Cache key of a question: trimmed, lower case, blanks collapsed, punctuation dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " "), r"[^\p{L}\p{N}_\s]", "")


def normalise_entity(text: Column, label: Column) -> Column:
    """A name less its type word, lower case; labels of exact values lose only commas."""
    tidy = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    bare = F.regexp_replace(F.regexp_replace(tidy, ENTITY_PREFIX, ""), r"^\s+|\s+$", "")
    exact = F.lower(F.regexp_replace(bare, ",", ""))
    loose = F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}_\s&.-]", ""), r"^\s+|\s+$", "")
    return F.when(label.isin(*EXACT_LABELS), exact).otherwise(loose)


def normalise_graph_entity(text: Column, label: Column) -> Column:
    """The graph's variant: identifiers keep their punctuation."""
    tidy = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    bare = F.regexp_replace(F.regexp_replace(tidy, ENTITY_PREFIX, ""), r"^\s+|\s+$", "")
    keeps = label.endswith("_ID") | label.isin("ID", "EMAIL", "PHONE")
    return F.when(keeps, F.lower(bare)).otherwise(F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}_\s&.-]", ""), r"^\s+|\s+$", ""))


def entity_key(label: Column, normalised: Column) -> Column:
    return F.concat(F.lower(label), F.lit(":"), F.substring(F.sha1(F.concat(label, F.lit(":"), normalised)), 1, 12))


def label_of_id(noun: Column, text: Column) -> Column:
    """Label of an identifier: its noun's, else its prefix's."""
    return F.when(noun.isNotNull() & (noun != ""), F.concat(F.upper(noun), F.lit("_ID"))).otherwise(F.concat(F.upper(F.substring_index(text, "-", 1)), F.lit("_ID")))


def query_entity_text(text: Column) -> Column:
    """A name in a question less trailing punctuation and its type word."""
    tidy = F.regexp_replace(F.trim(text), r"[?.,;:]+$", "")
    kinds = "company|corporation|corp\\.?|project|contract|invoice|department|employee|product|bank|fund|stock|bond|agreement|partnership|payment|transaction"
    return F.trim(F.regexp_replace(F.regexp_replace(tidy, rf"(?i)^(?:{kinds})\s+", ""), r"\s+", " "))


def relation_stem(word: Column) -> Column:
    n = F.length(word)
    rules = [("ers", 5, 3, ""), ("er", 4, 2, ""), ("ies", 4, 3, "y"), ("ing", 5, 3, ""), ("ed", 4, 2, ""), ("es", 4, 2, ""), ("s", 3, 1, "")]
    out = None
    for suffix, longer, off, put in rules:
        cond, value = word.endswith(suffix) & (n > longer), F.concat(word.substr(F.lit(1), n - off), F.lit(put))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(word)


def relation_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.slice(F.transform(F.filter(found, lambda w: ~w.isin(*RELATION_STOPWORDS)), relation_stem), 1, 5)


def relation_name(text: Column) -> Column:
    """A relation type from words; null if nothing is left."""
    w = relation_words(text)
    return F.when(F.size(w) > 0, F.upper(F.array_join(w, "_")))


def number_with_unit(figures: Column, unit: Column) -> Column:
    """A number in figures times its unit word."""
    factor = F.lit(1.0)
    for name, times in MULTIPLIERS.items():
        factor = F.when(F.lower(unit) == name, F.lit(times)).otherwise(factor)
    return F.regexp_replace(figures, "[^0-9.+-]", "").try_cast("double") * factor


def entity_number(text: Column, label: Column) -> Column:
    """The first number of an entity of a numeric label, else null."""
    pattern = r"(?i)([-+]?\d[\d,]*(?:\.\d+)?)\s*(k|m|b|thousand|million|billion|trillion)?\b"
    found = F.regexp_extract(text, pattern, 1)
    return F.when(label.isin(*NUMERIC_LABELS) & (found != ""), number_with_unit(found, F.regexp_extract(text, pattern, 2)))


def format_number(value: Column) -> Column:
    """Thousands separated, two decimals at most, trailing zeros dropped."""
    return F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")


def preview(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def format_ttl(seconds: Column) -> Column:
    """45s, 3m 5s, 1h 2m."""
    s = seconds.cast("bigint")
    text = lambda n: n.cast("string")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s < 60, F.concat(text(s), F.lit("s"))).when(s < 3600, F.concat(text(F.floor(s / 60)), F.lit("m "), text(rest), F.lit("s"))).otherwise(F.concat(text(hours), F.lit("h "), text(minutes), F.lit("m")))


def is_bad_summary(text: Column, least: int = 20) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    bad = F.length(low) < least
    for marker in BAD_SUMMARY_MARKERS:
        bad = bad | low.contains(marker)
    return bad


def extractive_summary(text: Column) -> Column:
    """The first two longer sentences, then up to six as points; else the text's beginning."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ +| +$", "")
    s = F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda p: F.trim(p)), lambda x: F.length(x) > 20)
    points = F.when(F.size(s) > 2, F.slice(s, 3, 6)).otherwise(F.slice(s, 1, 6))
    made = F.concat(F.array_join(F.slice(s, 1, 2), " "), F.lit("\n\nKey points:\n"), F.array_join(F.transform(points, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return F.when(F.size(s) == 0, F.substring(t, 1, 1200)).otherwise(made)


def section_title(text: Column) -> Column:
    """The first line of 4 to 140 characters that is a numbered or lettered heading."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    fit = F.filter(lines, lambda s: (F.length(s) >= 4) & (F.length(s) <= 140) & s.rlike(SECTION))
    return F.when(F.size(fit) > 0, fit[0])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def confidence(top_score: Column, overlap: Column, scale: float = 1.6) -> Column:
    return F.round(F.least(F.lit(1.0), F.lit(scale) * (0.6 * top_score + 0.4 * overlap)), 3)


def confidence_badge(value: Column) -> Column:
    return F.when(value >= 0.70, "high").when(value >= 0.40, "medium").otherwise("low")
