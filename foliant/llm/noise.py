"""Repairing text of scanned pages.

Lines that are page furniture are taken out; furniture is what recurs at the edges of a
document's pages, or has a form that recurs so in several documents. The other lines are cut
into paragraphs by dynamic programming, and each paragraph is run together into one character
stream, which is decoded: a shortest path over its characters whose edges are words of the
lexicon. An edge may run over a line break (with or without a hyphen), over a blank, or stop
inside a token, and it may read characters that a scanner confuses. Tokens that are words, and
whose neighbours neither need decoding nor make a likelier word with them, are edges of their
own, so only the stretches between such tokens are searched character by character. Edges are
followed along the strokes of the lexicon's words and end where no word goes on so.

Confusions are found through strokes: each glyph is written as the strokes it looks like (m
as three, n, u and w as two, rn as three, cl and d as a bow and a stroke), so that a word and
all its misreadings have the same strokes and the lexicon is looked up by them.

The lexicon holds the words that make up a share LEAST_SHARE of all running words or more, so
it has at most 1 / LEAST_SHARE entries for a corpus of any size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut

LEAST_SHARE = 5e-6
LEAST_COUNT = 3
NOISE_RATIO = 40  # a word is taken for a misreading if one of the same strokes is so much commoner
ACCENT_RATIO = 4
EDGE_LINES = 3  # furniture stands in the first or last lines of a page
FORM_SHARE, FORM_DOCUMENTS = 0.002, 3

#: The strokes that glyphs look like.
STROKES = {
    "i": "i", "l": "i", "1": "i", "|": "i", "!": "i", "í": "i", "r": "i", "n": "ii", "u": "ii", "h": "ii", "b": "ii", "6": "ii", "U": "ii", "H": "ii", "m": "iii",
    "e": "c", "c": "c", "o": "c", "a": "c", "0": "c", "@": "c", "é": "c", "è": "c", "O": "c", "C": "c", "€": "c", "d": "ci", "v": "i", "y": "i", "w": "ii", "s": "s", "5": "s", "$": "s", "S": "s",
    "g": "g", "9": "g", "q": "g", "t": "t", "+": "t", "f": "t", "ſ": "t", "†": "t", "k": "k", "p": "p", "x": "x", "z": "z", "2": "z", "j": "j", "I": "i", "8": "B", "V": "i", "W": "ii", "-": "-", "'": "'", "’": "'",
}
#: Pairs (as misread, as meant) that scanners produce. What people mistype has other pairs.
COMMON = frozenset(
    [("é", "e"), ("c", "e"), ("e", "c"), ("+", "t"), ("@", "a"), ("1", "i"), ("1", "l"), ("|", "l"), ("|", "i"), ("l", "i"), ("i", "l"), ("I", "l"), ("I", "i"), ("5", "s"), ("0", "o"), ("9", "g"), ("6", "b"), ("ſ", "f"), ("v", "y"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u")]
    + [("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("ii", "n"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("vv", "w"), ("w", "vv"), ("w", "vi"), ("vi", "w"), ("U", "ll"), ("ll", "U"), ("h", "li"), ("li", "h"), ("o", "a"), ("a", "o"), ("o", "e"), ("e", "o"), ("o", "c"), ("c", "o"), ("f", "t"), ("t", "f"), ("!", "l"), ("!", "i"), ("q", "g"), ("$", "s"), ("8", "B")]
)
_BY_MISREAD: dict[str, list[str]] = {}
for _a, _b in sorted(COMMON):
    _BY_MISREAD.setdefault(_a, []).append(_b)

HYPHENS = "-\xad‐‑¬"
_LINE = re.compile(r"\r\n|\r|\n|\x0b|\x0c|\x85| | ")
_TRIM = ".,;:()[]{}\"“”?"
_PLAIN = r"^[(\[\"'“]?(\p{Ll}+(?:[-'’]\p{Ll}+)*)[)\]\"'”.,;:?!]*$"
_HEADING = re.compile(r"^(?:\d+(?:\.\d+)+\.?|\(?[a-z\d]{1,3}[.)]|[IVX]+\.|#+)\s")
_NUMBER = re.compile(r"(?:page|pg\.?|p\.|seite|folio)?\s*[-~–—\[(|]?\s*(\d{1,5}|[ivxlc]{1,7}|[IVXLC]{1,7})\s*(?:(?:of|/|von)\s*(\d{1,5}))?\s*[-~–—\])|]?", re.I)
_ROMAN = re.compile(r"[ivx]{2,6}")


def strokes(word: str) -> str:
    return "".join(STROKES.get(c, c) for c in word)


class Lexicon:
    """Words of the corpus with their counts, by strokes."""

    def __init__(self, counts: dict[str, int]) -> None:
        by: dict[str, list[str]] = {}
        for w in counts:
            by.setdefault(strokes(w), []).append(w)
        self.by, self.cost, self.begun = {}, {}, set()
        total = sum(counts.values()) + 1
        for s, group in by.items():
            top = max(counts[w] for w in group)
            head = max(group, key=lambda x: counts[x])
            # accents are noise more often than not: an accented word must be nearly as common
            kept = [w for w in group if counts[w] * (NOISE_RATIO if w.isascii() else ACCENT_RATIO) >= top or not self.reading(w, head)]
            self.by[s] = sorted(kept, key=lambda w: (-counts[w], w))
            for w in kept:
                self.cost[w] = -math.log(counts[w] / total)
            self.begun.update(s[:i] for i in range(1, len(s) + 1))

    @staticmethod
    def reading(seen: str, meant: str) -> float | None:
        """The number of confusions by which ``meant`` is read as ``seen``; None if it takes others."""
        row = {0: 0.0}  # position in meant -> cost, for each position in seen
        rows = [dict() for _ in range(len(seen) + 1)]
        rows[0] = row
        for i in range(len(seen)):
            for j, cost in rows[i].items():
                moves = []
                if j < len(meant):
                    if seen[i] == meant[j]:
                        moves.append((i + 1, j + 1, 0.0))
                for a in (seen[i], seen[i : i + 2]):
                    for b in _BY_MISREAD.get(a, ()):
                        if meant.startswith(b, j):
                            moves.append((i + len(a), j + len(b), 1.0))
                for ni, nj, c in moves:
                    if ni <= len(seen) and cost + c < rows[ni].get(nj, 9.0):
                        rows[ni][nj] = cost + c
        return rows[len(seen)].get(len(meant))

    def best(self, seen: str) -> tuple[str, float] | None:
        """The word that ``seen`` reads best as, with the cost of the confusions."""
        if seen in self.cost:
            return seen, 0.0
        found = None
        for w in self.by.get(strokes(seen), ()):
            c = self.reading(seen, w)
            if c is not None and (found is None or 3 * c + self.cost[w] < found[2]):
                found = (w, c, 3 * c + self.cost[w])
        return found[:2] if found else None


def roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    n = [values[c] for c in text.lower()]
    return sum(-a if any(b > a for b in n[i + 1 : i + 2]) else a for i, a in enumerate(n)) if n else None


def is_page_number(line: str, page: int | None) -> bool:
    """A page number in one of its usual forms; a number alone must be the page's own."""
    text = line.strip()
    m = _NUMBER.fullmatch(text)
    if not m:
        if page is not None and re.match(r"(?i)(page|pg|p)\W", text):  # a misread digit or word
            return bool(_NUMBER.fullmatch(text.translate(str.maketrans("lIO|oS", "110105"))))
        return False
    n = int(m[1]) if m[1].isdigit() else roman(m[1])
    named = bool(re.match(r"(?i)p|seite|folio", text)) and not re.fullmatch(r"(?i)[ivxlc]+", m[0]) or m[2] is not None
    return n == page if page is not None else named


def header_key(line: str, page: int | None) -> str | None:
    """What the same header or footer has on every page: strokes, with the page's number left
    out. None for lines that are text, headings, cells or numbers."""
    text = " ".join(line.split())
    if "\t" in line.strip() or text[:1].islower() or _HEADING.match(text) or re.search(r"[.,;:]\Z", text) or not re.search(r"[^\W\d_]{4}|[A-Z]+/\d", text):
        return None
    if page is not None:
        text = re.sub(rf"\b{page}\b(?!/)(?!.*\b{page}\b)", "#", text)
    return strokes(text.lower())


def form_of(line: str) -> tuple[str, int] | None:
    """(form, words) of a header or footer, of capitalised words and codes. Each run of words is
    written by its case and last word, or as it stands if it is one word; a code (letters and
    figures between slashes) as C, a number as 9. None for a line that is none of this."""
    parts, run, n = [], [], 0

    def end() -> None:
        if run:
            letters = "".join(run)
            parts.append(run[0].lower() if len(run) == 1 else f"{'U' if letters.isupper() else 'T'}:{run[-1].lower()}")
            run.clear()

    for t in line.split():
        word = t.strip(".,;:()[]&")
        if re.search(r"\w/\w", word) and any(c.isdigit() for c in word):
            end()
            parts.append("C")
        elif word and all(c.isdigit() or c in "OIl" for c in word):
            end()
            parts.append("9")
        elif any(c.isalpha() for c in word):
            if not n and not run and not parts and not word[0].isupper():
                return None
            run.append(word)
            n += 1
            if run[-1][0].islower() and len(parts) and parts[-1] == "C" and len(run) == 1 and len(word) > 2:
                return None
        else:
            end()
            if word:
                parts.append(word)
    if run and len(run) > 1 and not run[-1][0].isupper():
        return None
    end()
    return (" ".join(parts), n) if n else None


def split_lines(text: str) -> list[str]:
    return _LINE.split(text)


def furniture(lines: list[str], page: int | None, keys: set[str], forms: dict[str, int], whole_page: bool) -> list[int]:
    """Numbers of the lines that are furniture. On a page they stand at its edges; a chunk may
    hold the edges of pages anywhere."""
    filled = [i for i, line in enumerate(lines) if line.strip()]
    edge = set(filled[:EDGE_LINES] + filled[-EDGE_LINES:]) if whole_page else set(filled)
    if not whole_page and len(filled) < 2:
        return []
    out = []
    for i in filled:
        line = lines[i]
        if i not in edge:
            continue
        if is_page_number(line, page):
            out.append(i)
            continue
        key = header_key(line, page)
        if key is None:
            continue
        form = form_of(line)
        if key in keys or any(abs(len(k) - len(key)) <= 2 and _near(k, key) for k in keys) or (form is not None and _known_form(form, forms)):
            out.append(i)
    return out


def _near(a: str, b: str, most: int = 3) -> bool:
    """Whether the middles of two strings that differ are short, for strings long enough."""
    if min(len(a), len(b)) < 8:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= most


def _known_form(form: tuple[str, int], forms: dict[str, int]) -> bool:
    """Whether a line has one of the forms, read as a scanner may misread it, in no more words
    than lines of that form have where they recur."""
    name, words = form
    if name in forms:
        return words <= forms[name]
    return len(name) >= 4 and any(words <= n and (strokes(f) == strokes(name) or (len(f) == len(name) and sum(x != y for x, y in zip(f, name)) <= 1)) for f, n in forms.items() if abs(len(f) - len(name)) <= 2)


class Word:
    """A decoded word: what it reads, and how it stood in the stream."""

    __slots__ = ("text", "broken", "misread", "after")

    def __init__(self, text: str, broken: bool = False, misread: bool = False, after: str = " ") -> None:
        self.text, self.broken, self.misread, self.after = text, broken, misread, after


OOV, OOV_CHAR, CONFUSED, MERGED, SPLIT, LINE_JOIN = 9.0, 1.1, 3.0, 5.0, 6.0, 4.0


class Token:
    """A token of a stretch to decode: its core between punctuation, and what follows it: a
    blank, a line break ("\\n") or a hyphen at a line's end ("-\\n")."""

    __slots__ = ("lead", "core", "tail", "after")

    def __init__(self, text: str, core: str, after: str) -> None:
        at = text.find(core)
        self.lead, self.core, self.tail, self.after = text[:at], core, text[at + len(core) :], after


def _lower_first(core: str) -> str:
    return core[:1].lower() + core[1:] if core[:1].isupper() else core


def decode_span(span: list[Token], lexicon: Lexicon) -> list[Word]:
    """Best reading of tokens that have cores.

    A shortest path over the span's characters: an edge is a stretch of characters, read as a
    word of the lexicon of the same strokes, or a token as it stands. Over a separator inside
    it, and for an end inside a token, an edge pays; over punctuation there is none."""
    chars: list[str] = []
    starts: dict[int, Token] = {}
    ends: dict[int, Token] = {}
    for t in span:
        starts[len(chars)] = t
        chars.extend(t.core)
        ends[len(chars)] = t
    n, text = len(chars), "".join(chars)
    best: list[tuple[float, int, Word | None]] = [(0.0, -1, None)] + [(math.inf, -1, None)] * n
    for i in range(n):
        base = best[i][0]
        if base == math.inf:
            continue
        lead = starts[i].lead if i in starts else ""
        capital = chars[i].isupper()

        def put(j: int, cost: float, w: str, broken: bool, misread: bool) -> None:
            total = base + cost + (0.0 if j in ends else SPLIT)
            if total < best[j][0]:
                end = ends.get(j)
                best[j] = (total, i, Word(lead + w + (end.tail if end else ""), broken, misread, end.after if end else " "))

        cross, broken, hyphen = 0.0, False, -1
        run, joined = "", None  # strokes so far, and with a hyphen that stood at a line's end
        for j in range(i + 1, n + 1):
            if j - 1 > i and j - 1 in ends:
                if ends[j - 1].tail or starts[j - 1].lead:
                    break
                s = ends[j - 1].after
                cross += MERGED if s == " " else 0.0 if s == "-\n" else LINE_JOIN
                broken = broken or s != " "
                if s == "-\n":
                    hyphen, joined = j - 1, run + "-"
                if cross > 2 * MERGED:
                    break
            c = chars[j - 1].lower() if capital and j - 1 == i else chars[j - 1]
            stroke = STROKES.get(c, c)
            run += stroke
            joined = joined + stroke if joined is not None else None
            if run in lexicon.by:
                known = lexicon.best(_lower_first(text[i:j]))
                if known:
                    w, c = known
                    if capital:
                        if c == 0:
                            put(j, cross + lexicon.cost[w], w[:1].upper() + w[1:], broken, False)
                    elif c == 0 or any("a" <= x <= "z" for x in chars[i:j]):
                        put(j, cross + lexicon.cost[w] + CONFUSED * c, w, broken, c > 0)
            if joined is not None and joined in lexicon.by and not capital:
                known = lexicon.best(text[i:hyphen] + "-" + text[hyphen:j])
                if known:
                    put(j, cross + lexicon.cost[known[0]] + CONFUSED * known[1] - 0.5, known[0], broken, known[1] > 0)
            if run not in lexicon.begun and (joined is None or joined not in lexicon.begun):
                break
        # as it stands: a token, with what a hyphen joins to it
        j, t = i, starts.get(i)
        while t is not None:
            j += len(t.core)
            put(j, OOV + OOV_CHAR * (j - i), text[i:j], t is not starts[i], False)
            t = starts.get(j) if t.after == "-\n" and not t.tail and j in starts and not starts[j].lead else None
    words, j = [], n
    while j > 0:
        _, i, w = best[j]
        words.append(w)
        j = i
    return words[::-1]


def tokens_of(lines: list[str]) -> tuple[list[str], dict[int, str]]:
    """The de-lined stream: tokens, and what follows them where it is no blank. A hyphen that
    ends a line is taken off."""
    out: list[str] = []
    after: dict[int, str] = {}
    for line in lines:
        parts = line.split()
        if parts:
            out += parts
            t = parts[-1]
            if len(t) > 1 and t[-1] in HYPHENS and (t[-2].isalpha() or t[-2] in STROKES):
                out[-1] = t[:-1]
                after[len(out) - 1] = "-\n"
            else:
                after[len(out) - 1] = "\n"
    return out, after


_LOWER = re.compile("[a-z]")


def _likelier(a: str, b: str, after: str, lexicon: Lexicon) -> bool:
    """Whether two cores make one word that is likelier than both by themselves."""
    joined = lexicon.cost.get(_lower_first(a + b))
    if joined is None or b[:1].isupper():
        return False
    alone = lambda x: lexicon.cost.get(_lower_first(x), OOV + OOV_CHAR * len(x))
    return joined + (MERGED if after == " " else LINE_JOIN) < alone(a) + alone(b)


def decode(lines: list[str], lexicon: Lexicon, whole: bool = True) -> list[Word]:
    """Words of the lines' stream, or without ``whole`` just those of the stretches that were
    searched. A token is plain if it is a word or nothing that is a lower-case word; plain
    tokens stand, unless a neighbour is doubtful or makes a likelier word with them, and what
    lies between two that stand is decoded as one."""
    stream, after = tokens_of(lines)
    out: list[Word] = []
    n, known = len(stream), lexicon.cost
    cores = [t if t in known else t.strip(_TRIM) for t in stream]
    open_ = set()
    for k, core in enumerate(cores):
        if core and (after.get(k) == "-\n" or not (core in known or core[0].isupper() or not _LOWER.search(core) or _ROMAN.fullmatch(core))):
            open_.add(k)
    doubt = frozenset(open_)
    for k in range(n - 1):
        a, b = cores[k], cores[k + 1]
        if a and b and (k in doubt or k + 1 in doubt or a + b in known or (a[0].isupper() and _lower_first(a + b) in known)):
            if stream[k].endswith(a) and stream[k + 1].startswith(b) and (k in doubt or k + 1 in doubt or _likelier(a, b, after.get(k, " "), lexicon)):
                open_.update((k, k + 1))
    i = 0
    for k in sorted(open_):
        if k < i:
            continue
        if whole:
            out += [Word(stream[x], after=after.get(x, " ")) for x in range(i, k)]
        i = k + 1
        while i in open_ and stream[i - 1].endswith(cores[i - 1]) and stream[i].startswith(cores[i]):
            i += 1
        out += decode_span([Token(stream[x], cores[x], after.get(x, " ")) for x in range(k, i)], lexicon)
    if whole:
        out += [Word(stream[x], after=after.get(x, " ")) for x in range(i, n)]
    return out


def cases(text: str | None, page: int | None, keys: set[str], forms: dict[str, int], lexicon: Lexicon, whole_page: bool) -> set[tuple[str, str]]:
    """(kind, fixed) of a text: furniture lines, broken words, misread words."""
    if not text or not text.strip():
        return set()
    lines = split_lines(text)
    gone = set(furniture(lines, page, keys, forms, whole_page))
    out = {("furniture", lines[i].strip()) for i in gone}
    kept = [line for i, line in enumerate(lines) if i not in gone]
    for part in [*(kept[a:b] for a, b in paragraphs(kept)), *([lines[i]] for i in gone if not is_page_number(lines[i], page))]:
        for w in decode(part, lexicon, whole=False):
            if not (w.broken or w.misread):
                continue
            fixed = w.text.strip(_TRIM + "!").lower()
            if w.broken and len(fixed) > 1:
                out.add(("broken", fixed))
            elif w.misread and w.text[:1] != w.text[:1].upper() or w.misread and not w.text[:1].isalpha():
                out.add(("misread", fixed))
    return out


SHORT_LINE = 0.75
#: Costs of a paragraph: each, for its excess length, for short lines, headings and blank lines inside
#: it, for how it begins and ends, and what words that recur in it are worth.
EACH, USUAL_CHARS, EXCESS, SHORT_INSIDE, HEADING_INSIDE, BLANK_INSIDE, LOWER_START, OPEN_END, HYPHEN_END, FULL_END, COHESION = 2.0, 1500, 1.0, 3.0, 5.0, 6.0, 4.0, 3.0, 6.0, 0.5, 1.0
_CONTENT = re.compile(r"[^\W\d_]{6,}")


def _is_heading(line: str) -> bool:
    return bool(_HEADING.match(line)) and not line.endswith((".", ","))


def _segment(lines: list[str], blank: list[bool], width: int) -> list[tuple[int, int]]:
    """Paragraphs of the lines that are not blank, as ranges, by the least sum of costs;
    ``blank`` says which have a blank line before them."""
    n = len(lines)
    size = [len(line) for line in lines]
    ends = [line[-1] in ".!?:।\"”" for line in lines]
    heading = [_is_heading(line) and size[i] < width for i, line in enumerate(lines)]
    words = [_CONTENT.findall(line.lower()) for line in lines] if n > 1 else [[]]
    start = [LOWER_START if i and lines[i][0].islower() else 0.0 for i in range(n)]
    end = [(0.0 if ends[i] or i == n - 1 or heading[i] else OPEN_END) + (HYPHEN_END if lines[i][-1] in HYPHENS and i < n - 1 else 0.0) + (FULL_END if size[i] >= 0.95 * width and i < n - 1 else 0.0) for i in range(n)]
    # what it costs if the paragraph goes on behind a line
    inside = [(SHORT_INSIDE if ends[i] and size[i] < SHORT_LINE * width else 0.0) + (HEADING_INSIDE if heading[i] and not lines[i + 1][0].islower() else 0.0) + (HEADING_INSIDE if heading[i + 1] else 0.0) + (BLANK_INSIDE if blank[i + 1] else 0.0) for i in range(n - 1)]
    best, back, least = [0.0] + [math.inf] * n, [0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        chars, within, seen, again, total = 0, 0.0, set(), 0, 0
        low, at, tail = math.inf, 0, EACH + end[j - 1]
        for i in range(j - 1, -1, -1):
            chars += size[i] + 1
            if i < j - 1:
                within += inside[i]
            own = words[i]
            before = len(seen)
            seen.update(own)
            total += len(own)
            again += len(own) - len(seen) + before
            excess = EXCESS * (chars / USUAL_CHARS - 1) ** 2 if chars > USUAL_CHARS else 0.0
            cost = best[i] + start[i] + within + tail + excess - (COHESION * again / total if total else 0.0)
            if cost < low:
                low, at = cost, i
            # longer ones cost no less than this, and what comes before them no less than the least so far
            if tail + within + excess - COHESION + least[i] > low:
                break
        best[j], back[j] = low, at
        least[j] = min(least[j - 1], low)
    out, j = [], n
    while j > 0:
        out.append((back[j], j))
        j = back[j]
    return out[::-1]


def paragraphs(lines: list[str]) -> list[tuple[int, int]]:
    """Ranges of lines that are a paragraph each, chosen for the least sum of costs, where the
    cost of a paragraph depends on all its lines: its length, its short and blank lines, how it
    begins and ends, and how many of its words recur in it. Blank lines between paragraphs
    belong to the next."""
    bare = [line.strip() for line in lines]
    filled = [i for i, line in enumerate(bare) if line]
    if not filled:
        return [(0, len(lines))] if lines else []
    widths = sorted(len(bare[i]) for i in filled)
    width = widths[int(0.8 * (len(widths) - 1))]
    found = _segment([bare[i] for i in filled], [bool(k) and filled[k] - filled[k - 1] > 1 for k in range(len(filled))], width)
    ends = [filled[b - 1] + 1 for _, b in found]
    ends[-1] = len(lines)
    return list(zip([0, *ends[:-1]], ends))


def repair(text: str | None, page: int | None, keys: set[str], forms: dict[str, int], lexicon: Lexicon, whole_page: bool) -> list[str]:
    """The paragraphs of a text, words repaired and furniture left out."""
    if not text or not text.strip():
        return []
    lines = split_lines(text)
    gone = set(furniture(lines, page, keys, forms, whole_page))
    kept = [line for i, line in enumerate(lines) if i not in gone]
    out = []
    for a, b in paragraphs(kept):
        words = [w.text for w in decode(kept[a:b], lexicon) if w.text]
        if words:
            out.append(" ".join(words))
    return out


def lexicon_counts(texts: DataFrame, share: float = LEAST_SHARE, least: int = LEAST_COUNT) -> dict[str, int]:
    """Lower-case words of ``texts`` (text) with their counts, at most 1 / share of them."""
    words = texts.select(F.explode(F.split("text", r"\s+")).alias("t")).select(F.regexp_extract("t", _PLAIN, 1).alias("w"))
    counts = cut(words.filter("w <> ''").groupBy("w").agg(F.count("*").alias("n")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {r["w"]: r["n"] for r in counts.filter(F.col("n") >= max(least, share * total)).collect()}


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        out = []
        for document, page, text in zip(f["document"], f["page"], f["text"]):
            filled = [line for line in split_lines(text) if line.strip()] if text else []
            for line in {*filled[:EDGE_LINES], *filled[-EDGE_LINES:]}:
                key = header_key(line, None if pd.isna(page) else int(page))
                if key:
                    out.append((document, page, key, *(form_of(line) or (None, 0))))
        yield pd.DataFrame(out, columns=["document", "page", "key", "form", "words"])


def running_lines(pages: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(document, keys) of the lines at page edges that recur on pages of a document, and the
    forms such lines have in at least a share of the documents (at most 1 / share of them),
    with the most words they have there."""
    seen = cut(pages.filter("document IS NOT NULL AND text IS NOT NULL").mapInPandas(_edges, "document string, page int, key string, form string, words int"), "page-edges")
    recurring = seen.groupBy("document", "key").agg(F.countDistinct("page").alias("n"), F.min("form").alias("form"), F.min("words").alias("words")).filter("n > 1")
    recurring = cut(recurring, "running-lines")
    documents = recurring.select("document").distinct().count()
    forms = recurring.filter("form IS NOT NULL").groupBy("form").agg(F.countDistinct("document").alias("n"), F.max("words").alias("words")).filter(F.col("n") >= max(FORM_DOCUMENTS, FORM_SHARE * documents))
    return recurring.groupBy("document").agg(F.collect_list("key").alias("keys")), {r["form"]: r["words"] for r in forms.select("form", "words").collect()}


def _prepared(texts: DataFrame) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """Texts (src, document, idx, page, text) with the running lines of their documents."""
    texts = texts.filter("text IS NOT NULL").distinct()
    keys, forms = running_lines(texts.filter("src = 'page'").select("document", "page", "text"))
    return texts.join(keys, "document", "left"), lexicon_counts(texts.select("text")), forms


_LEXICONS: dict[str, Lexicon] = {}


def _each(texts: DataFrame, work, schema: str) -> DataFrame:
    prepared, counts, forms = _prepared(texts)
    spark = texts.sparkSession
    shared, name = spark.sparkContext.broadcast((counts, forms)), uuid4().hex  # bounded by the shares

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, known = shared.value
        if name not in _LEXICONS:  # built once in a worker
            _LEXICONS.clear()
            _LEXICONS[name] = Lexicon(counts)
        lexicon = _LEXICONS[name]
        for f in batches:
            out = []
            for row in f.itertuples(index=False):
                keys = set(row.keys) if row.keys is not None else set()
                page = None if pd.isna(row.page) else int(row.page)
                idx = None if pd.isna(row.idx) else int(row.idx)
                out += [(row.src, row.document, idx, *x) for x in work(row.text, page, keys, known, lexicon, row.src == "page")]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"idx": "Int32"})

    return prepared.mapInPandas(run, schema)


def found(texts: DataFrame) -> DataFrame:
    """(src, document, idx, kind, fixed): one row for each distinct case of ``texts`` (src,
    document, idx, page, text), where src ``page`` is a whole page and anything else a part.

    Null, empty and blank texts have no cases; repeated rows count once; a null document has
    no running lines but those of known forms, a null page no page numbers but named ones. An
    empty table gives no rows; other columns are not read.
    """
    cols = texts.select("src", "document", "idx", "page", "text")
    return _each(cols, lambda *a: sorted(cases(*a)), "src string, document string, idx int, kind string, fixed string").distinct()


def repaired(texts: DataFrame) -> DataFrame:
    """(src, document, idx, paragraph, text): the paragraphs of each text, repaired. Texts
    without any are left out; the rest is as for ``found``."""
    cols = texts.select("src", "document", "idx", "page", "text")
    return _each(cols, lambda *a: enumerate(repair(*a)), "src string, document string, idx int, paragraph int, text string")
