"""Defective question-answer pairs.

Each answer is read once against its question:

* ``copied``: the answer is traversed in the suffix automaton of the question, which gives
  the longest stretch of the question that ends at each character. Nothing but a few
  characters outside such stretches, and most of the question inside them: a copy.
* ``refusal``: an automaton of refusals in the first person, over what is not quoted; in a
  clause that reports what somebody says or asks they are none.
* ``wrong_language``: stopword votes (and letters of a script) of question and answer.
* ``truncated``: a stack of delimiters and what the answer ends on. An answer that has no
  end mark may still be complete, so its last sentence is held against all sentences of the
  table: its skeleton (function words kept, runs of other words as one) must end sentences in
  a share of the cases in which sentences begin with it, and its last word must be a last
  word in a share of its occurrences. A form of answer without end mark that recurs, and that
  no sentence goes on from, is complete too. All measures are shares, alike at every size.
* ``empty``: nothing left without markup, blanks, punctuation and placeholders.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut

PLACEHOLDERS = frozenset(
    ["na", "n a", "null", "none", "nil", "nan", "tbd", "tba", "todo", "answer", "a", "undefined", "unknown", "empty", "blank", "response", "reply", "placeholder"]
    + ["not available", "no answer", "not applicable", "lorem ipsum", "no response", "keine angabe", "k a", "sans objet"]
)

REFUSALS = (
    "i'm unable to", "i am unable to", "i'm not able to", "i am not able to", "i can't ", "i cannot ", "i can not ", "i won't ", "i will not ", "i must decline", "i have to decline",
    "i would rather not", "i'd rather not", "i don't have permission", "i do not have permission", "i'm not permitted", "i am not permitted", "i'm not allowed", "i am not allowed",
    "appropriate for me to", "outside what i may do", "outside what i can do", "beyond what i may do", "i decline to", "i refuse to", "i don't feel comfortable", "i'm sorry, but", "i am sorry, but",
    "we're unable to", "we are unable to help", "we cannot help", "we cannot provide", "not something i can", "i couldn't ", "i could not ", "unable to assist", "can't assist", "cannot assist",
    "ich kann ihnen", "ich kann diese", "kann ich nicht beantworten", "kann ich leider", "ich darf nicht", "ich bin nicht in der lage", "ich muss ablehnen", "ich möchte nicht", "leider kann ich", "es tut mir leid, aber",
    "je ne peux pas", "je ne suis pas en mesure", "je regrette, mais", "no puedo ", "no me es posible", "lo siento, pero",
)

STOPWORDS = {
    "en": "the a an of to and in is it that for as with by on at from or not be are was were will which who what when how must may can shall has have had this these those if any each no under between before after until unless upon within without where while because so its their both all than there into only does did do instead yes provided how many",
    "de": "der die das den dem des ein eine einer eines einem einen und oder nicht ist sind war wird werden kann muss darf soll hat haben für von vom mit nach bei bis zu zum zur im in an am auf aus als auch dass wenn wann wie welche welcher welches was wer bevor damit er sie es sofern gilt laut gemäß ohne durch über unter dann",
    "fr": "le la les un une des du de et ou ne pas est sont sera doit peut avant que qui dans pour par avec sans sur selon lorsque au aux ce cette son sa ses jusqu il elle à en sauf afin",
    "es": "el la los las un una de del y o no es son será debe puede podrá antes que en para por con sin sobre según cuando al su sus este esta hasta salvo pacto a",
}
_STOP = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
_FUNCTION = frozenset().union(*_STOP.values())
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_TOKEN = re.compile(r"[A-Z]+/\d+(?:/[A-Z]+)?|\d[\d.,]*\d|\d|[^\W\d_]+(?:[-'’][^\W_]+)*|[,;()\-–]")
_ENDED = re.compile(r"[.!?।…][\"'”’»)\]]*\s*\Z")
_SENTENCES = re.compile(r"(?<=[.!?।])[\"'”’»)\]]*\s+(?=[^\da-zà-ÿ])")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»")
_MARKUP = re.compile(r"<[^<>]*>|&\w+;")
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}
RUN = 8  # shorter stretches in common with the question count as chance
COPIED_ANSWER, COPIED_QUESTION = 0.82, 0.7


class SuffixAutomaton:
    """All substrings of a text; a state holds the length of its longest."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.length)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.length)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def stretches(self, text: str, least: int = RUN) -> list[tuple[int, int]]:
        """Where ``text`` runs along the automaton's text for ``least`` characters or more."""
        state, size, out = 0, 0, []
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            if size >= least:
                s = i + 1 - size
                if out and s <= out[-1][1]:
                    out[-1] = (min(s, out[-1][0]), i + 1)
                else:
                    out.append((s, i + 1))
        return out


def _words(text: str) -> list[str]:
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


_RUNS: list[slice] = []


def _runs(text: str) -> Iterator[str]:
    while len(_RUNS) < len(text):
        _RUNS.append(slice(len(_RUNS), len(_RUNS) + RUN))
    return map(text.__getitem__, _RUNS[: max(0, len(text) - RUN + 1)])


def is_copy(question: list[str], answer: list[str]) -> bool:
    """Whether an answer gives back the question; both by their words."""
    q, a = " ".join(question), " ".join(answer)
    if not q or not a:
        return False
    if a == q:
        return True
    if len(q) < 2 * RUN or len(a) < 0.5 * len(q):
        return False
    # every stretch is made of runs of RUN characters, so few of these mean few stretches
    runs = frozenset(_runs(q))
    if RUN * sum(map(runs.__contains__, _runs(a))) < COPIED_ANSWER * len(a):
        return False
    own = SuffixAutomaton(q).stretches(a)
    inside = sum(e - s for s, e in own)
    if inside < COPIED_ANSWER * len(a):
        return False
    back = SuffixAutomaton(a).stretches(q)  # a single phrase repeated is no copy of the question
    return sum(e - s for s, e in back) >= COPIED_QUESTION * len(q)


@lru_cache(maxsize=1)
def _refusals():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in REFUSALS:
        automaton.add_word(p, p)
    automaton.make_automaton()
    return automaton


#: Words of clauses that report, and of the first person who may report on themselves.
_REPORTING = re.compile(
    r"\b(?:that|whether|if|why|how|says?|said|writes?|wrote|written|states?|stated|reply|replies|replied|tells?|told|notes?|noted|claims?|claimed|explains?|explained|answers|answered|argues?|argued|thinks?|thought|believes?|believed"
    r"|dass|ob|sagte?|schreibt|schrieb|erklärte?|meinte?|que|dit|écrit|dice|dijo|escribió)\b"
)
_SELF = re.compile(r"(?:i|i'm|we|we're|sorry|please|unfortunately|ich|wir|leider|bitte|je|nous|lo)\b")
_CLAUSE = re.compile(r"[.!?।;]\s+")


def is_refusal(answer: str) -> bool:
    """Whether the answerer declines. Before the phrase, in its sentence, nothing may report: in
    "the tenant wrote that I cannot assign the lease" nobody declines to answer."""
    text = " ".join(_QUOTED.sub(" ", answer).replace("’", "'").casefold().split()) + " "
    for end, phrase in _refusals().iter(text):
        start = end - len(phrase) + 1
        if start and text[start - 1].isalnum():
            continue
        before = _CLAUSE.split(text[:start])[-1]
        if not _REPORTING.search(before) or _SELF.match(before):
            return True
    return False


_LONGEST = max(map(len, PLACEHOLDERS))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if "<" not in answer and "&" not in answer and sum(map(str.isalnum, answer)) > _LONGEST:
        return False
    words = " ".join(_words(_MARKUP.sub(" ", answer)))
    return not words or words in PLACEHOLDERS


_LANGUAGES: dict[str, tuple[str, ...]] = {w: tuple(k for k, x in _STOP.items() if w in x) for w in _FUNCTION}


def votes(words: list[str]) -> dict[str, int]:
    out = dict.fromkeys([*_STOP, "hi"], 0)
    for w in words:
        if w in _LANGUAGES:
            for k in _LANGUAGES[w]:
                out[k] += 1
        elif w[0] > "\u08ff":
            out["hi"] += "ऀ" <= w[0] <= "ॿ"
    return out


def is_foreign(question: list[str], answer: list[str]) -> bool:
    asked, said = votes(question), votes(answer)
    lang = max(asked, key=asked.get)
    other = max(said, key=lambda k: (said[k], k == lang))
    return other != lang and asked[lang] >= 2 and said[other] >= 2 and said[other] >= 2 * said[lang] + 1


_YEAR, _AMOUNT = re.compile(r"(?:19|20)\d\d"), re.compile(r"\d{1,3}(?:,\d{2,3})+")


def skeleton(sentence: str, words: set | None = None) -> tuple[list[int], str]:
    """(skeleton, last word) of a sentence without its end mark. The skeleton is given by the
    hashes of its beginnings, the last of which is its own. Words, figures by their kind, are
    put into ``words``."""
    hashes: list[int] = []
    own: list[str] = []
    h, before = 1, ""
    for t in _TOKEN.findall(sentence):
        low, k, code = _KINDS.get(t) or _kind(t)
        if t == "May" and own:  # the month
            k, code = "X", _X
        own.append(low)
        if k != "X" or before != "X":
            h = (h * 0x9E3779B97F4A7C15 + code) % 0x1FFFFFFFFFFFFFFF
            hashes.append(h)
        before = k
    if words is not None:
        words.update(own)
    return hashes, own[-1] if own else ""


_KINDS: dict[str, tuple[str, str, int]] = {}
_X = xxhash.xxh64_intdigest("X")


def _kind(t: str) -> tuple[str, str, int]:
    """(word to count, what stands for it in a skeleton, number of that), kept for the next time."""
    low = t.casefold()
    if t[0].isdigit():
        k = low = "Y" if _YEAR.fullmatch(t) else "M" if _AMOUNT.fullmatch(t) else "9"
    elif "/" in t:
        k = low = "C"
    elif not t[0].isalnum():
        k = t
    else:
        k = low if low in _FUNCTION else "X"
    if len(_KINDS) > 200_000:
        _KINDS.clear()
    _KINDS[t] = low, k, xxhash.xxh64_intdigest(k)
    return _KINDS[t]


def dangling(answer: str) -> bool:
    """Whether an answer without an end mark shows by itself that it is cut: it ends on an
    opener, a comma, a dash or the mark of a list item, or leaves a bracket or quotation open."""
    text = answer.rstrip()
    if text.endswith(("...", "…")) or re.search(r"[,;:(\[{“«\-–—/]\Z|[:;,]\s*\(?(?:\d{1,2}|[a-z]|[ivx]+)[).]\Z", text):
        return True
    stack: list[str] = []
    for i, c in enumerate(text):
        if c in _OPEN:
            stack.append(_OPEN[c])
        elif stack and c == stack[-1]:
            stack.pop()
        elif c == '"':
            stack.pop() if stack and stack[-1] == '"' else stack.append('"')
    return bool(stack)


_READ = "src string, row_id bigint, defect string, tail bigint, last string, alone boolean, kind string, key bigint, word string, n bigint"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each answer, and the counts of a batch: answers that have sentences with an end
    mark of a skeleton (``s``), with a beginning (``b``) and with a last word (``w``), and answers
    that have a word (``o``)."""
    for f in batches:
        defect, tail, last, alone = [], [], [], []
        counts = {"s": Counter(), "b": Counter(), "w": Counter(), "o": Counter()}
        for q, a in zip(f["question"], f["answer"]):
            d, t, w, parts = None, None, None, []
            if is_empty(a):
                d = "empty"
            elif is_copy(asked := _words(q) if q else [], said := _words(a)):
                d = "copied"
            elif is_refusal(a):
                d = "refusal"
            elif asked and is_foreign(asked, _words(bare) if (bare := _QUOTED.sub(" ", a)) != a else said):
                d = "wrong_language"
            else:
                # what stands before a colon announces the sentence
                parts = [re.split(r":\s+", s)[-1] for s in _SENTENCES.split(a.strip()) if s and s.strip()]
                ended = bool(_ENDED.search(a)) and not a.rstrip().endswith(("...", "…")) and not _CUT_AFTER.search(a)
                own = {k: set() for k in counts}
                for s in parts if ended else parts[:-1]:
                    k, x = skeleton(s, own["o"])
                    if k:
                        own["s"].add(k.pop())
                        own["b"].update(k)
                        own["w"].add(x)
                if not ended and dangling(a):
                    d = "truncated"
                elif not ended and parts:
                    t, w = skeleton(parts[-1], own["o"])
                    t = t[-1] if t else 0
                for k, c in counts.items():
                    c.update(own[k])
            defect.append(d)
            alone.append(t is not None and len(parts) == 1)
            tail.append(t)
            last.append(w)
        yield pd.DataFrame({"src": f["src"], "row_id": f["row_id"], "defect": defect, "tail": pd.array(tail, dtype="Int64"), "last": last, "alone": alone, "kind": "a", "key": None, "word": None, "n": 1})
        rows = [(None, None, None, None, None, None, k, *((x, None) if k in "sb" else (None, x)), n) for k, c in counts.items() for x, n in c.items()]
        yield pd.DataFrame(rows, columns=["src", "row_id", "defect", "tail", "last", "alone", "kind", "key", "word", "n"], dtype=object)


#: Abbreviations after which a full stop ends no sentence.
_CUT_AFTER = re.compile(r"\b(?:Rs|No|Nos|Art|Sec|Ref|vs|e\.g|i\.e|z\.B|Nr)\.\s*\Z")
WHOLE, LAST, RECURS, FEW = 0.05, 0.01, 0.5, 5


def broken_pairs(pairs: DataFrame, whole: float = WHOLE, last: float = LAST, recurs: float = RECURS, few: int = FEW) -> DataFrame:
    """(src, row_id, defect) of each defective pair of ``pairs`` (src, row_id, question,
    answer); at most one defect for an answer: empty, copied, refusal, wrong_language,
    truncated, in that order.

    A null question leaves only defects that show without it; a null answer is empty. Rows
    with a null row_id are left out, repeated keys are reported once. An empty table gives no
    rows; other columns are not read. An answer without end mark is complete if its skeleton
    ends ``whole`` of the sentences that begin with it and its last word ends sentences in ``last``
    of the answers that have it; or if answers that are this one sentence make up ``recurs`` of these
    sentences (``few`` more are reckoned to go on, as little evidence is none).
    """
    rows = pairs.select("src", F.col("row_id").cast("bigint").alias("row_id"), F.col("question").cast("string"), F.col("answer").cast("string")).filter("row_id IS NOT NULL").dropDuplicates(["src", "row_id"])
    read = cut(rows.mapInPandas(_read, _READ), "pairs-read")
    open_ = read.filter("kind = 'a' AND tail IS NOT NULL").select("src", "row_id", "tail", "last", "alone")
    total = lambda kind, key, by, n: read.filter(F.col("kind") == kind).groupBy(F.col(key).alias(by)).agg(F.sum("n").alias(n))
    tails = open_.groupBy("tail", "last").agg(F.count_if("alone").alias("same"), F.count("*").alias("opened"))
    ends_open = tails.groupBy("last").agg(F.sum("opened").alias("ends_open"))
    judged = tails.join(total("s", "key", "tail", "stops"), "tail", "left").join(total("b", "key", "tail", "on"), "tail", "left").join(ends_open, "last", "left")
    judged = judged.join(total("w", "word", "last", "ends"), "last", "left").join(total("o", "word", "last", "seen"), "last", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    by_sentence = (zero("stops") >= whole * (zero("stops") + zero("on") + 1)) & (zero("ends") >= last * zero("seen")) & (zero("ends") > 0)
    by_form = (F.col("same") >= recurs * (F.col("same") + zero("on") + few)) & (zero("ends") + zero("ends_open") >= last * zero("seen"))
    cut_off = judged.filter(~(by_sentence | by_form)).select("tail", "last")
    truncated = open_.join(cut_off, ["tail", "last"]).select("src", "row_id", F.lit("truncated").alias("defect"))
    return read.filter("kind = 'a' AND defect IS NOT NULL").select("src", "row_id", "defect").union(truncated)
