"""Linking the spellings of people and organisations by merge and rematch.

Every name is read into a profile: for a person the surname, given names (short forms under
the full one) and initials, for an organisation the family name and its trades (abbreviations
written out, legal forms dropped). Profiles meet in blocks of equal surname-less-a-letter and
given initial, or family-less-a-letter and trades; two strings within one edit share such a
key. In a block, profiles that match are merged into one that has the spellings, given names
and initials of both. Merged profiles are blocked and matched again, until a round merges
nothing: an initial that fits one person only after two profiles became one is linked then.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut, deal, pairs_within

PERSON_LABELS = ("PERSON", "EXECUTIVE", "BOARD_MEMBER")
ORGANISATION_LABELS = ("COMPANY", "SUBSIDIARY", "CORPORATION")
TITLES = frozenset("mr mrs ms miss dr prof professor adv advocate hon honourable justice shri smt sri sir madam capt col esq esquire jr sr phd md llb ca".split())
LEGAL = frozenset("limited ltd incorporated inc company co corporation corp private pvt p llc llp plc gmbh ag sa nv bv pte pty the ms and of".split())
TRADES = tuple(
    "agricultural agencies airlines associates automotive bank banking beverages capital cement chemicals consultancy consulting construction development distribution electricals electronics energy engineering enterprises estates exports fashions finance financial foods foundation global healthcare holdings hospitality hotels imports industries infrastructure insurance international investments laboratories leasing logistics machinery manufacturing marketing media metals mining motors packaging partners petroleum pharmaceuticals plastics power products projects properties publishing retail securities services shipping software solutions steel systems technologies telecom textiles trading transport travels trust ventures".split()
)
_TRADE_SET = frozenset(TRADES)
_WORDS = re.compile(r"[a-z0-9]+")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("’", "'")


def within_one(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def close(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 5 and within_one(a, b))


def close_names(a: str, b: str) -> bool:
    """Surnames, or family names (with their trades behind a tilde) of the same trades."""
    x, _, t = a.partition("~")
    y, _, u = b.partition("~")
    return t == u and close(x, y)


def deletions(word: str) -> set[str]:
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) >= 5 else set())


class Forms:
    """Given names with their short forms; a word one edit away from just one is that one."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.full: dict[str, str] = {}
        for given, short in rows:
            if given:
                self.full[fold(given).lower()] = fold(given).lower()
        for given, short in rows:
            if given and short:
                self.full.setdefault(fold(short).lower(), fold(given).lower())
        self.near: dict[str, set[str]] = {}
        for w in self.full:
            for k in deletions(w):
                self.near.setdefault(k, set()).add(w)

    def of(self, word: str) -> str | None:
        if word in self.full:
            return self.full[word]
        if len(word) < 4:
            return None
        found = {self.full[w] for k in deletions(word) for w in self.near.get(k, ()) if len(w) >= 4 and within_one(w, word)}
        return found.pop() if len(found) == 1 else None


def expand_trade(word: str) -> str | None:
    """The trade that ``word`` writes, in full, with one edit, or abbreviated."""
    if word in _TRADE_SET:
        return word
    if len(word) >= 6:
        near = [t for t in TRADES if len(t) >= 6 and within_one(word, t)]
        if len(near) == 1:
            return near[0]
    if len(word) < 3:
        return None
    fits = []
    for t in TRADES:
        if t[0] == word[0] and len(word) < len(t):
            letters = iter(t)
            same = next((i for i, (x, y) in enumerate(zip(word, t)) if x != y), len(word))
            rest = word[same if same >= 3 else 1 :]  # a beginning of the word, or consonants
            if all(c in letters for c in word) and not set(rest) & set("aeiou"):
                fits.append(t)
    if len(fits) > 1:  # letters that stand together decide, then the shorter word
        prefixed = [t for t in fits if t.startswith(word.rstrip("s"))]
        fits = prefixed if len(prefixed) == 1 else [t for t in _USUAL if t in fits][:1]
    return fits[0] if len(fits) == 1 else None


#: Of several trades an abbreviation fits, the first here is meant.
_USUAL = ("development", "engineering", "services", "manufacturing", "pharmaceuticals", "technologies", "transport", "holdings", "agricultural", "construction", "international", "industries")


def read_organisation(text: str) -> dict | None:
    low = re.sub(r"\bm/s\b\.?", " ", fold(text).lower()).replace("'", "")
    words = [w for w in _WORDS.findall(low) if w not in LEGAL]
    trades, family = set(), []
    for w in words:
        t = expand_trade(w)
        trades.add(t) if t else family.append(w)
    name = "".join(family) or "".join(sorted(trades))
    return {"family": f"{name}~{'+'.join(sorted(trades))}", "given": "", "first": "", "middle": ""} if name else None


def read_person(text: str, forms: Forms) -> dict | None:
    spaced = re.sub(r"([a-z]{3})([A-Z][a-z]{2})", r"\1 \2", fold(text))
    left, comma, right = spaced.lower().partition(",")
    words_of = lambda s: [w for w in _WORDS.findall(s.replace("'", "")) if w not in TITLES]
    before, after = words_of(left), words_of(right)
    if comma and not after:  # only a title stood behind the comma
        comma = ""
    initials = [w for w in before + after if len(w) == 1]
    before, after = [w for w in before if len(w) > 1], [w for w in after if len(w) > 1]
    given = ""
    if comma and before:
        family = before
        if after:
            given = forms.of("".join(after)) or forms.of(after[0]) or after[0]
    else:
        words, family = before + after, []
        for w in words:
            known = forms.of(w) if not given else None
            if known:
                given = known
            else:
                family.append(w)
        if not family and words:
            family, given = words[-1:], (forms.of(words[0]) or words[0]) if len(words) > 1 else ""
        elif not given and not initials and len(family) > 1:
            given, family = family[0], family[1:]
    if not family:
        return None
    first = given[:1] or (initials[0] if initials else "")
    middle = initials if given else initials[1:]
    return {"family": "".join(family), "given": given, "first": first, "middle": "".join(sorted(set(middle)))}


def _profiles(batches: Iterator[pd.DataFrame], rows: list[tuple[str, str]]) -> Iterator[pd.DataFrame]:
    """Spellings of an entity into one profile, that of its name with those of the same family
    name. Any other is a row of its own: a former name, or a role that says nothing."""
    forms = Forms(rows)
    for f in batches:
        out = []
        for entity, person, names in zip(f["entity_id"], f["person"], f["names"]):
            read = [p for n in names if (p := read_person(n["text"], forms) if person else read_organisation(n["text"]))]
            if not read:
                continue
            head = read[0]
            fits = [close_names(p["family"], head["family"]) and (p["first"] == head["first"] or not p["first"] or not head["first"]) for p in read]
            own = [p for p, fit in zip(read, fits) if fit]
            merged = {k: " ".join(sorted({p[k] for p in own if p[k]})) for k in ("family", "given", "first")}
            out.append((entity, True, bool(person), merged["family"], merged["given"], merged["first"], "".join(sorted(set("".join(p["middle"] for p in own))))))
            out += [(entity, False, bool(person), p["family"], p["given"], p["first"], p["middle"]) for p, fit in zip(read, fits) if not fit]
        yield pd.DataFrame(out, columns=["entity_id", "own", "person", "family", "given", "first", "middle"])


_PROFILE = "person boolean, family string, given string, first string, middle string"


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        out = []
        for row in f.itertuples(index=False):
            parts = [w.partition("~") for w in row.family.split(" ")]
            tags = row.first.split(" ") if row.person else [""]
            for key in {f"{int(row.person)}|{d}|{trades}|{t}" for name, _, trades in parts for d in deletions(name) for t in tags}:
                out.append((key, *row))
        yield pd.DataFrame(out, columns=["key", *f.columns])


class _Profile:
    def __init__(self, row) -> None:
        self.node, self.person, self.gone = row.node, row.person, False
        self.family, self.given, self.first, self.middle = set(row.family.split(" ")), set(filter(None, row.given.split(" "))), set(filter(None, row.first.split(" "))), set(row.middle)

    def agrees(self, other: _Profile) -> bool:
        """Middle initials may be left out, but not contradict."""
        return not self.middle or not other.middle or bool(self.middle & other.middle)


class _Index:
    """Live profiles by family name and something else; family names by what they are close to."""

    def __init__(self) -> None:
        self.names: dict[str, set[str]] = {}
        self.at: dict[tuple, list[_Profile]] = {}

    def add(self, p: _Profile, tags: set[str]) -> None:
        for f in p.family:
            name, _, trades = f.partition("~")
            for d in deletions(name):
                self.names.setdefault(f"{d}~{trades}", set()).add(f)
            for t in tags:
                held = self.at.setdefault((f, t), [])
                if not any(k is p for k in held[-1:]):
                    held.append(p)

    def near(self, p: _Profile) -> list[str]:
        """Family names close to one of the profile's, its own first."""
        own = sorted(p.family)
        close_ = {g for f in own for d in deletions(f.partition("~")[0]) for g in self.names.get(f"{d}~{f.partition('~')[2]}", ()) if g not in p.family and close_names(f, g)}
        return own + sorted(close_)

    def of(self, p: _Profile, families: list[str], tags: set[str], most: int | None = None) -> list[_Profile]:
        """Other live profiles of these families and tags that agree with it, ``most`` at most."""
        found: list[_Profile] = []
        for f in families:
            for t in sorted(tags):
                for k in self.at.get((f, t), ()):
                    if not k.gone and k is not p and k.person == p.person and k.agrees(p) and not any(x is k for x in found):
                        found.append(k)
                        if len(found) == most:
                            return found
        return found


def _resolve(f: pd.DataFrame) -> list[tuple[int, int]]:
    """Merges within a block: (node, node it is merged into). Candidates come by lookup, so a
    block of very many profiles is never compared pair by pair."""
    pool = [_Profile(r) for r in f.sort_values("node").itertuples(index=False)]
    merges: list[tuple[int, int]] = []
    by_given, by_first, by_middle, bare = _Index(), _Index(), _Index(), _Index()
    given = lambda p: p.given if p.person else {""}
    letters = lambda p: {t + m for t in p.first for m in p.middle}

    def enter(p: _Profile) -> None:
        if p.given or not p.person:
            by_given.add(p, given(p))
            by_first.add(p, p.first)
            by_middle.add(p, letters(p))
        else:
            bare.add(p, p.first)

    def merge(p: _Profile, mate: _Profile) -> None:
        p.gone = True
        merges.append((p.node, mate.node))
        known = mate.family | mate.given | mate.first | mate.middle
        for k in ("family", "given", "first", "middle"):
            getattr(mate, k).update(getattr(p, k))
        if mate.family | mate.given | mate.first | mate.middle != known:
            enter(mate)

    def named(p: _Profile) -> _Profile | None:
        """Who has a family and given name of ``p``. A name without a middle initial is merged
        only if all that it fits agree."""
        alike = lambda x: by_given.of(x, sorted(x.family), given(x)) or by_given.of(x, by_given.near(x), given(x))
        fits = alike(p)
        if not fits or not p.person:
            return fits[0] if fits else None
        said = [k for k in fits if k.middle]
        if p.middle:
            return said[0] if said else next((k for k in fits if all(x.agrees(p) for x in alike(k))), None)
        if all(a.agrees(said[0]) for a in said):
            return fits[0]
        return next((k for k in fits if not k.middle), None)

    def initials(p: _Profile) -> _Profile | None:
        families = by_first.near(p)
        exact = by_middle.of(p, families, letters(p), 2) if p.middle else []
        if len(exact) == 1:
            return exact[0]
        fits = by_first.of(p, families, p.first, 2)
        if fits:
            return fits[0] if len(fits) == 1 else None
        if any(not k.gone for f in families for t in p.first for k in by_first.at.get((f, t), ())):
            return None
        return next((k for k in bare.of(p, bare.near(p), p.first) if k.first == p.first), None)

    said = sorted((p for p in pool if p.given or not p.person), key=lambda p: not p.middle)
    rest = [p for p in pool if p.person and not p.given]
    for p in rest:
        enter(p)
    changed = True
    while changed:
        changed = False
        for some, find in ((said, named), (rest, initials)):
            for p in some:
                if p.gone:
                    continue
                mate = find(p)
                if mate:
                    merge(p, mate)
                    changed = True
                elif some is said:
                    enter(p)
    return merges


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; each block is resolved as a whole."""

    def done(f: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        sizes = f.groupby("key", sort=False)["node"].transform("size")
        for _, block in f[sizes > 1].groupby("key", sort=False):
            out += _resolve(block)
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")

    held = None
    for f in batches:
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        if len(held) > 5000 and held["key"].iloc[0] != held["key"].iloc[-1]:
            last = held["key"] == held["key"].iloc[-1]
            yield done(held[~last])
            held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield done(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b), root the least node of its component.
    Labels are lowered along edges and then along labels, so rounds grow with the logarithm
    of a component's width; all tables stay in the shared folder."""
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("root")), "labels")
    while True:
        seen = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("n")).agg(F.min("root").alias("low"))
        lowered = labels.join(seen, labels["node"] == seen["n"]).select("node", "root", F.least("root", "low").alias("low"))
        up = labels.select(F.col("node").alias("m"), F.col("root").alias("above"))
        nxt = cut(lowered.join(up, lowered["low"] == up["m"], "left").select("node", F.least("low", F.coalesce("above", "low")).alias("root"), (F.least("low", F.coalesce("above", "low")) < F.col("root")).alias("moved")), "labels")
        labels = nxt.select("node", "root")
        if nxt.filter("moved").isEmpty():
            return labels


def _joined(column: str):
    return F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(column, " "), lambda x: x != ""))))), " ")


def _heads_keys(heads: pd.Series) -> pd.Series:
    return heads.map(lambda h: sorted(f"{d}~{h.partition('~')[2]}" for d in deletions(h.partition("~")[0])))


def _are_close(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([close_names(x, y) for x, y in zip(a, b)], dtype="bool")


def _of_one(heads: DataFrame) -> DataFrame:
    """The b of ``heads`` (b, head) whose heads are spellings of one name: all are close to one
    of them. Those that are close meet at a key, so no b's heads are gathered or paired whole."""
    counted = heads.groupBy("b").agg(F.count("*").alias("n"))
    keys, close_ = F.pandas_udf(_heads_keys, "array<string>"), F.pandas_udf(_are_close, "boolean")
    several = heads.join(counted.filter("n > 1"), "b")
    keyed = cut(several.select("b", "n", "head", F.explode(keys("head")).alias("key")), "heads")
    met = keyed.join(keyed.select("b", "key", F.col("head").alias("other")), ["b", "key"]).select("b", "n", "head", "other").distinct()
    centres = met.filter(close_("head", "other")).groupBy("b", "n", "head").agg(F.count("*").alias("m")).filter("m = n")
    return counted.filter("n = 1").select("b").union(centres.select("b").distinct())


def _other_names(read: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b): profiles of entities with that of another name of theirs. A name that entities
    of several families bear is a role and links nobody."""
    own = read.filter("own").select("entity_id", F.xxhash64(*columns).alias("a"), F.split("family", " ").alias("heads"))
    other = read.filter("NOT own").select("entity_id", F.xxhash64(*columns).alias("b")).distinct()
    borne = cut(other.join(own, "entity_id"), "other-names")
    specific = _of_one(borne.select("b", F.explode("heads").alias("head")).distinct())
    return borne.join(specific, "b").select("a", "b").distinct()


def resolve(spellings: DataFrame, forms: DataFrame) -> DataFrame:
    """(entity_id, root): entities and the number of the person or organisation they mean.

    ``spellings`` has (entity_id, person, rank, text), any number of rows for an entity; its
    name is the readable text of least rank. ``forms`` has (given_name, short_form), a
    reference list of names, read as a whole. Null and blank texts, texts of titles only and
    null entity_ids are left out; spellings may repeat. An initial that fits several people
    stays alone; names whose middle initials contradict are never merged. An empty table gives
    no rows.
    """
    spark = spellings.sparkSession
    rows = [(r["given_name"], r["short_form"]) for r in forms.select("given_name", "short_form").collect()]
    texts = spellings.filter("entity_id IS NOT NULL AND trim(text) <> ''").groupBy("entity_id", "person", "text").agg(F.min("rank").alias("rank"))
    named = texts.groupBy("entity_id", "person").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("names"))
    read = cut(named.mapInPandas(lambda it: _profiles(it, rows), "entity_id string, own boolean, " + _PROFILE), "name-profiles")
    columns = [c.split(" ")[0] for c in _PROFILE.split(", ")]
    other = cut(_other_names(read, columns), "other-names")
    nodes = read.select(F.xxhash64(*columns).alias("node"), "own", *columns).join(other.select(F.col("b").alias("node"), F.lit(True).alias("borne")).distinct(), "node", "left")
    nodes = cut(nodes.filter("own OR borne").select("node", *columns).distinct(), "name-nodes")
    of_node = read.filter("own").select("entity_id", F.xxhash64(*columns).alias("node"))
    roots = nodes.select("node", F.col("node").alias("root"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        keyed = nodes.mapInPandas(_keys, "key string, node bigint, " + _PROFILE)
        merges = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_blocks, "a bigint, b bigint")
        edges = cut((merges if other is None else merges.union(other)).distinct(), "merges")
        other = None  # other names link once
        if edges.isEmpty():
            return of_node.join(roots, "node").select("entity_id", "root")
        found = components(edges)
        moved = found.select(F.col("node").alias("was"), F.col("root").alias("now"))
        roots = cut(roots.join(moved, roots["root"] == moved["was"], "left").select("node", F.coalesce("now", "root").alias("root")), "name-roots")
        renamed = nodes.join(moved, nodes["node"] == moved["was"], "left").withColumn("node", F.coalesce("now", "node"))
        letters = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("middle", ""), lambda x: x != ""))))), "")
        nodes = cut(renamed.groupBy("node").agg(F.first("person").alias("person"), _joined("family").alias("family"), _joined("given").alias("given"), _joined("first").alias("first"), letters.alias("middle")), "name-nodes")


def pairs(groups: DataFrame) -> DataFrame:
    """(entity_a, entity_b), entity_a < entity_b: all pairs of a group."""
    found = pairs_within(deal(groups.select(F.col("entity_id").alias("id"), F.col("root").alias("group"))))
    return found.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"))
