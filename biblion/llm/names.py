"""Problem 5: variant spellings of names typed by people.

Names are taken apart (titles, order, initials, nicknames; for organisations
abbreviations, word order, acronyms). Spellings within one edit of each other by the
unrestricted Damerau-Levenshtein metric are found cell by cell: a cell is the ball
around a string that lacks one letter, a name is copied into the cells of all strings
it reaches by one deletion, and two names within the radius share a cell by the
triangle inequality (see README on pivots). Inside a cell the distance is computed.
Links and aliases join into components; names that fit several stay apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.llm.components import components
from biblion.operators.packed import PackedField, explode_packed
from biblion.session import checkpoint

# Short forms and the names they stand for.
NICKNAMES = {
    "alex": ["alexander"], "sasha": ["alexander"], "sandy": ["alexander"], "bob": ["robert"], "rob": ["robert"], "bobby": ["robert"], "bert": ["robert"], "bill": ["william"], "will": ["william"], "billy": ["william"], "liam": ["william"],
    "chuck": ["charles"], "charlie": ["charles"], "hank": ["henry"], "harry": ["henry", "harold"], "hal": ["henry"], "tom": ["thomas"], "tommy": ["thomas"], "ted": ["edward", "theodore"], "theo": ["theodore"], "ed": ["edward"], "eddie": ["edward"], "ned": ["edward"],
    "fritz": ["frederick", "friedrich"], "fred": ["frederick"], "freddy": ["frederick"], "nick": ["nicholas"], "jackie": ["jacqueline"], "susie": ["susanna", "susan"], "sue": ["susanna", "susan"], "susan": ["susanna"], "gabi": ["gabriele"], "gaby": ["gabriele"], "beth": ["elizabeth"], "liz": ["elizabeth"], "lisa": ["elizabeth"], "betty": ["elizabeth"], "eliza": ["elizabeth"],
    "beppe": ["giuseppe"], "pino": ["giuseppe"], "kate": ["katherine"], "katie": ["katherine"], "kathy": ["katherine"], "kat": ["katherine"], "kit": ["katherine"], "hans": ["johannes"], "hannes": ["johannes"], "jo": ["johannes", "joanna"], "ben": ["benjamin"], "benny": ["benjamin"], "rick": ["richard"], "dick": ["richard"], "rich": ["richard"], "ritchie": ["richard"],
    "debbie": ["deborah"], "deb": ["deborah"], "mike": ["michael"], "mick": ["michael"], "mickey": ["michael"], "chris": ["christopher"], "kit": ["christopher", "katherine"], "tony": ["anthony"], "maggie": ["margaret"], "peggy": ["margaret"], "meg": ["margaret"], "vicky": ["victoria"], "vicki": ["victoria"], "tori": ["victoria"], "patty": ["patricia"], "pat": ["patricia", "patrick"], "trish": ["patricia"], "tricia": ["patricia"],
    "becky": ["rebecca"], "becca": ["rebecca"], "sam": ["samuel", "samantha"], "paco": ["francisco"], "pancho": ["francisco"], "cisco": ["francisco"], "ellie": ["eleanor"], "nell": ["eleanor"], "nora": ["eleanor"], "lena": ["helena"], "joe": ["joseph"], "jim": ["james"], "jack": ["john"], "dan": ["daniel"], "dave": ["david"], "steve": ["stephen"], "greg": ["gregory"], "jeff": ["jeffrey"], "andy": ["andrew"], "max": ["maximilian"], "bea": ["beatriz"], "kiki": ["francisca"], "pepe": ["jose"], "goyo": ["gregorio"], "quique": ["enrique"], "luca": ["lucas"], "milo": ["emil"],
}
TITLES = frozenset("dr prof professor mr mrs ms miss sir herr frau mme m dipl ing phd md rn mph msc bsc ma ba mba frcp frcs jr sr ii iii dphil dsc pharmd do mbbs".split())
# Abbreviations in names of organisations.
ORGANISATION_WORDS = {
    "univ": "university", "uni": "university", "hosp": "hospital", "dept": "department", "dep": "department", "ctr": "centre", "center": "centre", "cntr": "centre", "cncl": "council", "agcy": "agency", "cons": "consortium", "inst": "institute", "instit": "institute", "soc": "society", "assoc": "association", "fdn": "foundation", "found": "foundation", "lab": "laboratory", "labs": "laboratory", "labor": "laboratory", "acad": "academy", "natl": "national", "intl": "international",
    "clin": "clinical", "med": "medical", "sci": "science", "gen": "general", "mem": "memorial", "meml": "memorial", "coll": "college", "sch": "school", "fac": "faculty", "govt": "government", "min": "ministry", "org": "organisation", "organization": "organisation", "comm": "committee", "tech": "technology", "res": "research", "eng": "engineering", "info": "informatics", "inform": "informatics", "hlth": "health", "pub": "public", "sys": "systems", "diag": "diagnostics", "biosci": "biosciences", "grp": "group",
}
ORGANISATION_SKIP = frozenset("the of for on and in at de des du la le der die das und & gmbh sa ag inc ltd llc plc corp co bv nv kg spa srl oy ab limited".split())
#: Labelled names (``Last, First``) the lexicon of given names is fitted on, at most.
LABELLED = 200_000
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def folded(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFD", text.lower().translate(_LETTERS))
    return "".join(c for c in plain if not unicodedata.combining(c))


def edit_distance(a: str, b: str, limit: int = 2) -> int:
    """Unrestricted Damerau-Levenshtein distance (a metric), or ``limit + 1`` if it is above."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    seen: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2)] + [[top, i] + [0] * len(b) for i in range(len(a) + 1)]
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), match
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return min(d[-1][-1], limit + 1)


def within_one(a: str, b: str) -> bool:
    """Whether the unrestricted Damerau-Levenshtein distance is at most 1."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def _initials(word: str) -> str | None:
    """The letters of initials (``J.``, ``J.-L.``, ``JL``), else None."""
    if regex.fullmatch(r"(?:\p{Lu}\.?[- ]?){1,3}", word) or regex.fullmatch(r"(?:\p{L}\.[- ]?){1,3}", word):
        return "".join(folded(c)[:1] for c in word if c.isalpha())
    return None


def person_parts(name: str, given_names: frozenset[str]) -> tuple[str, str, str] | None:
    """(given, middle initials, surname): given is a folded name or one initial; None if it is no person's name."""
    text = regex.sub(r"\([^)]*\)", " ", name)
    left, comma, right = text.partition(",")
    clean = lambda s: [w for w in s.replace(",", " ").split() if folded(w).strip(".") not in TITLES or (len(w.strip(".")) == 1)]
    first, rest = clean(left), clean(right)
    if comma and rest and first:
        surname, others = first, rest
    else:
        words = first or rest
        if len(words) < 2:
            return None
        initials = [bool(_initials(w)) for w in words]
        known = [_given_key(w) in given_names or _given_key(w) in NICKNAMES for w in words]
        shouted = [len(w) > 2 and w.isupper() for w in words]
        if initials[-1] and not initials[0]:
            cut = next(i for i, x in enumerate(initials) if x)
            # "Last F" or "Last First M."
            surname, others = ([words[0]], words[1:]) if cut > 0 else (words[-1:], words[:-1])
            if known[0] and not known[1] and cut == 2:
                surname, others = [words[1]], [words[0], *words[2:]]
        elif shouted[0] and not all(shouted):
            surname, others = words[:1], words[1:]
        elif not known[0] and known[1]:
            surname, others = words[:1], words[1:]
        elif not known[0] and not any(known) and not initials[0] and _near(words[-1], given_names) and not _near(words[0], given_names):
            surname, others = words[:1], words[1:]
        else:
            surname, others = words[-1:], words[:-1]
    last = folded("".join(surname))
    last = regex.sub(r"[^a-z]", "", last)
    if not last or not others:
        return None
    letters = _initials(others[0])
    if letters:
        given, middle = letters[0], letters[1:] if "-" not in others[0] else letters[2:]
        if regex.fullmatch(r"\p{Lu}{2,3}", others[0]):
            middle = letters[1:]
    elif len(others) > 1 and _given_key(others[0] + others[1]) in given_names:
        given, middle, others = _given_key(others[0] + others[1]), "", others[1:]
    else:
        given, middle = _given_key(others[0]), ""
    for w in others[1:]:
        got = _initials(w)
        middle += got if got else folded(w)[:1]
    return (given, middle, last) if given else None


def _given_key(word: str) -> str:
    return regex.sub(r"[^a-z]", "", folded(word))


_lacking: dict[frozenset[str], dict[str, list[str]]] = {}


def _near(word: str, given_names: frozenset[str]) -> bool:
    """Whether a word lacks or has one letter more than a given name, or is within an edit of one of the same initial."""
    index = _lacking.get(given_names)
    if index is None:  # built once in a worker
        _lacking.clear()
        index = _lacking[given_names] = {}
        for g in given_names:
            for x in deletions(g):
                index.setdefault(x, []).append(g)
    key = _given_key(word)
    return any(key[:i] + key[i + 1 :] in given_names for i in range(len(key))) or any(
        g[:1] == key[:1] and within_one(g, key) for x in deletions(key) for g in index.get(x, ())
    )


def organisation_words(name: str) -> list[str]:
    words = [w.replace("'", "") for w in regex.findall(r"[a-z0-9']+", folded(name.replace("S.A.", " ").replace("s.a.", " ")))]
    return [ORGANISATION_WORDS.get(w, w) for w in words if w not in ORGANISATION_SKIP]


def _id(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}|{text}") - 2**63


def deletions(text: str) -> set[str]:
    """Centres of the cells a string is in: itself and the strings that lack one of its letters."""
    return {text} | {text[:i] + text[i + 1 :] for i in range(len(text))}


def given_lexicon(names: DataFrame, least: int = 4, labelled: int = LABELLED) -> frozenset[str]:
    """Given names: words after the comma of ``Last, First`` with ``least`` surnames or more.

    ``Last, First`` are the labelled rows of the model that tells the order of other
    names; it is fitted on ``labelled`` of them at most, drawn by hash, which bounds the
    lexicon as well.
    """
    parts = F.split(F.col("name"), ",")
    found = names.where(F.size(parts) == 2).select(
        F.regexp_extract(F.trim(parts[1]), r"^([\p{L}'-]{2,})", 1).alias("g"), F.trim(parts[0]).alias("s")
    ).where("g <> ''")
    drawn = found.orderBy(F.xxhash64("g", "s")).limit(labelled)
    rows = drawn.groupBy("g").agg(F.count_distinct("s").alias("n")).where(F.col("n") >= least).select("g").collect()
    return frozenset(_given_key(r.g) for r in rows if folded(r.g) not in TITLES) | frozenset(x for v in NICKNAMES.values() for x in v)


def _parse(names: DataFrame, given_names: frozenset[str]) -> DataFrame:
    """Distinct ``name``, ``kind`` -> ``unit`` (text), ``given``, ``middle``, ``last``, ``full``, ``sure`` (not one of several readings)."""
    shared = names.sparkSession.sparkContext.broadcast(given_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        cols = ["name", "kind", "unit", "given", "middle", "last", "full", "sure"]
        for batch in batches:
            rows = []
            for name, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "person":
                    got = person_parts(name, known)
                    if got:
                        given, middle, last = got
                        readings = NICKNAMES.get(given, [given])
                        rows += [(name, kind, f"{g} {last}", g, middle[:1], last, len(given) > 1, len(readings) == 1) for g in readings]
                else:
                    words = organisation_words(name)
                    short = regex.match(r"^\s*([A-Z]{3,6})\s*(?:\(([^)]+)\))?\s*$", name)
                    if short and (short[2] or name.isupper()) and len(words) <= 2:
                        rows.append((name, kind, short[1].lower(), " ".join(organisation_words(short[2] or "")), "", "", False, True))
                    elif words:
                        plain = regex.sub(r"\(([^)]*)\)", "", name)
                        inner = regex.search(r"\(([^)]*)\)", name)
                        order = organisation_words((inner[1] + " " if inner else "") + plain)
                        rows.append((name, kind, " ".join(sorted(words)), order[0], "".join(w[0] for w in order), "", True, True))
            data = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in data[:6]), *(pa.array(c, pa.bool_()) for c in data[6:])], names=cols)

    return names.mapInArrow(run, "name string, kind string, unit string, given string, middle string, last string, full boolean, sure boolean")


def cells_of(unit: str, kind: str) -> set[int]:
    """Cells a unit is copied into.

    A person's lack one letter. An organisation's lack one letter of one word (of five
    letters or more, or one shorter where the other may have five), whatever the order of
    the words. Units of a cell lie in the ball around its centre, which bounds them by
    its length and the alphabet at any size of the corpus.
    """
    if kind == "person":
        return {_id(kind, x) for x in deletions(unit)}
    words = unit.split()
    return {_id(kind, f"{' '.join(words[:i] + words[i + 1 :])}#{x}") for i, w in enumerate(words) if len(w) >= 4 for x in deletions(w)}


def close(a: str, b: str, kind: str) -> bool:
    """Whether two units are within the radius: one edit for persons, one edit of one word for organisations."""
    if kind == "person":
        (g1, _, s1), (g2, _, s2) = a.partition(" "), b.partition(" ")
        return (g1 == g2 or s1 == s2) and within_one(s1, s2) and within_one(a, b)
    x, y = a.split(), b.split()
    odd = [w for w in x if w not in y], [w for w in y if w not in x]
    return len(odd[0]) == len(odd[1]) == 1 and max(len(odd[0][0]), len(odd[1][0])) >= 5 and within_one(odd[0][0], odd[1][0])


def near_units(units: DataFrame) -> DataFrame:
    """Pairs ``u`` < ``v`` of distinct units (``unit``, ``kind``) within the radius: an exact radius join in each cell."""

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, k, u) for u, k in zip(*(c.to_pylist() for c in batch.columns), strict=True) for c in cells_of(u, k)]
            data = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(data[0], pa.int64()), pa.array(data[1], pa.string()), pa.array(data[2], pa.string())], names=["cell", "kind", "unit"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(kind: str, held: list[str]) -> list[tuple[str, str, str]]:
            return [(u, v, kind) for i, u in enumerate(held) for v in held[i + 1 :] if close(u, v, kind)]

        cell, kind_, held = None, "", []
        for batch in batches:
            found = []
            for c, k, u in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, k) != (cell, kind_):
                    found += pairs(kind_, held) if len(held) > 1 else []
                    cell, kind_, held = c, k, []
                if not held or held[-1] != u:
                    held.append(u)
            yield _pairs(found)
        if len(held) > 1:
            yield _pairs(pairs(kind_, held))

    spread = units.select("unit", "kind").mapInArrow(copies, "cell long, kind string, unit string")
    sorted_ = spread.repartition("cell").sortWithinPartitions("cell", "kind", "unit")
    return sorted_.mapInArrow(join, "u string, v string, kind string").distinct()


def _pairs(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    data = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in data], names=["u", "v", "kind"])


def name_classes(entities: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of spellings: entities (``id``, ``kind``, ``label``) and authors (``uid``, ``label``).

    ``entities`` (id, canonical_name, entity_type, aliases) count if they are persons or
    organisations, of the articles (uid, authors) the authors. Rows of one label name
    one person or organisation; rows that fit none or several for certain have none and
    are left out. Names given by initials alone belong to a class only if one fits; so do
    names without middle initial where several middle initials are known. NULL and
    unreadable names belong to none, NULL and empty aliases count as none, repeated rows
    count once.
    """
    kind = F.when(F.upper("entity_type") == "PERSON", "person").when(F.upper("entity_type").isin("ORGANIZATION", "ORGANISATION"), "organisation")
    ent = entities.select("id", "canonical_name", "aliases", kind.alias("kind")).where("kind is not null and id is not null")
    spelt = ent.select(
        "id", "kind", F.explode(F.array_compact(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name")
    )
    authors = explode_packed(articles, "uid", [PackedField("authors", person=True)])
    # Every mention once: of an entity (id) or of an article (uid).
    said = checkpoint(
        spelt.select("name", "kind", "id", F.lit(None).cast("string").alias("uid"))
        .unionByName(authors.select(F.col("val").alias("name"), F.lit("person").alias("kind"), F.lit(None).cast("long").alias("id"), "uid"))
        .distinct()
    )
    names = checkpoint(said.select("name", "kind").distinct())
    parsed = checkpoint(_parse(names, given_lexicon(names.where("kind = 'person'"))))

    # Full names: a node for each given name, surname and middle initial.
    middle = F.when(F.col("kind") == "person", F.col("middle")).otherwise("")
    full = parsed.where("full").select("unit", "kind", middle.alias("m")).distinct()
    near = near_units(parsed.where("full").select("unit", "kind").distinct())
    both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"), "kind"))
    both = both.unionByName(full.select(F.col("unit").alias("u"), F.col("unit").alias("v"), "kind").distinct())
    node = lambda u, m: F.xxhash64(F.col("kind"), F.col(u), F.col(m))
    pairs = checkpoint(
        both.join(full.select(F.col("unit").alias("u"), "m", "kind"), ["u", "kind"])
        .join(full.select(F.col("unit").alias("v"), F.col("m").alias("n"), "kind"), ["v", "kind"])
        .where("(m = n or m = '') and (u <> v or m <> n)")
        .select(node("u", "m").alias("a"), node("v", "n").alias("b"), "m", "n")
    )
    # A name without middle initial that fits several middle initials fits none for certain, and none links to it.
    one = pairs.where("m = '' and n <> ''").groupBy("a").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo = hi").select("a")
    sure = pairs.where("m = n").select("a", "b").unionByName(pairs.where("m <> n").join(one, "a", "left_semi").select("a", "b"))
    where = parsed.where("full").select("name", "kind", F.xxhash64("kind", "unit", middle).alias("node"), "last", "given", "middle", "sure")
    held = checkpoint(said.join(where.select("name", "kind", "node"), ["name", "kind"]).select("id", "uid", "kind", "node").distinct())
    ties = held.where("id is not null").select(F.xxhash64(F.lit("entity"), F.col("id")).alias("a"), F.col("node").alias("b"))
    parts = components(sure.unionByName(ties))
    # A node that nothing ties to another is a class of its own, unless it is but one reading of a nickname.
    label = F.coalesce("label", F.when(F.col("sure"), F.col("node"))).alias("label")
    labelled = checkpoint(where.join(parts, "node", "left").select("name", "kind", "last", "given", "middle", label).where("label is not null").distinct())

    # Initials alone, and acronyms: the one class that fits, if there is one. What they meet is summed first:
    # 27 middle initials a surname and initial, at most, and the first words of an acronym.
    range_ = [F.min("label").alias("lo"), F.max("label").alias("hi")]
    people = labelled.where("kind = 'person'").groupBy("last", F.substring("given", 1, 1).alias("given"), F.col("middle").alias("n")).agg(*range_)
    few = parsed.where("kind = 'person' and not full").select("name", "last", "given", "middle").distinct()
    asked = few.select("last", "given", "middle").distinct().join(people, ["last", "given"]).where("middle = n or middle = '' or n = ''")
    fits = asked.groupBy("last", "given", "middle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi")
    orgs = labelled.where("kind = 'organisation'").groupBy(F.col("middle").alias("acronym"), F.col("given").alias("place")).agg(*range_)
    any_ = orgs.groupBy("acronym").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("place", F.lit(""))
    shorts = parsed.where("kind = 'organisation' and not full").select("name", F.col("unit").alias("acronym"), F.col("given").alias("place"))
    spelled = shorts.join(orgs.where("place <> ''").unionByName(any_, allowMissingColumns=True), ["acronym", "place"]).where("lo = hi")
    alone = few.join(fits, ["last", "given", "middle"]).select("name", F.lit("person").alias("kind"), F.col("lo").alias("label")).unionByName(
        spelled.select("name", F.lit("organisation").alias("kind"), F.col("lo").alias("label"))
    )
    alone = alone.groupBy("name", "kind").agg(*range_).where("lo = hi").select("name", "kind", F.col("lo").alias("label"), F.lit(False).alias("full"))

    # An entity's class: by its full names, else by the only one its short names fit.
    by_name = labelled.select("name", "kind", "label", F.lit(True).alias("full")).distinct().unionByName(alone)
    met = checkpoint(said.join(by_name, ["name", "kind"]).select("id", "uid", "kind", "label", "full").distinct())
    of_entity = met.where("id is not null").groupBy("id", "kind").agg(
        F.min(F.when(F.col("full"), F.col("label"))).alias("whole"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    member = of_entity.withColumn("label", F.coalesce("whole", F.when(F.col("lo") == F.col("hi"), F.col("lo")))).where("label is not null").select("id", "kind", "label")
    return member, met.where("uid is not null").select("uid", "label").distinct()


def link_names(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Links between spellings, expanded from ``name_classes``: ``link_kind``, ``left_key``, ``right_key``.

    ``entity_entity``: all pairs of entities of a class, the smaller id first;
    ``author_entity``: an article and each person that its authors' classes hold.
    """
    member, authors = name_classes(entities, articles)
    member = checkpoint(member)
    text = lambda c: F.col(c).cast("string")
    pairs = (
        member.alias("x").join(member.alias("y"), "label").where("x.id < y.id")
        .select(F.lit("entity_entity").alias("link_kind"), text("x.id").alias("left_key"), text("y.id").alias("right_key"))
    )
    written = authors.join(member.where("kind = 'person'"), "label").select(F.lit("author_entity").alias("link_kind"), F.col("uid").alias("left_key"), text("id").alias("right_key"))
    return pairs.unionByName(written.distinct())
