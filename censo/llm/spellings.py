"""Problem 5: variant spellings of people's and organisations' names.

Names are parsed into an organisation's class and distinctive words, or a person's readings: which word is the given name follows from its
place (before or after a comma, first or last), from the roles its words have in other names of the same tables, and where that leaves both
open, both readings stay. Distinctive texts are joined within a bounded edit distance by a sharded trie join: texts are sharded by their
segments (with k+1 segments, k edits leave one intact, so no neighbour is missed), each shard holds its index texts in a trie, and a
Levenshtein automaton walks the trie for every probe text. Candidates are then checked over the orders of their words by bipartite matching,
initials and short forms of given names included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censo.functions.places import damerau, fold, is_missing
from censo.operators.components import connected_components
from censo.session import cut, table

# Words of an organisation's kind.
CLASS = {
    "pharmaceuticals": "farma", "pharmaceutical": "farma", "pharma": "farma", "pharm": "farma",
    "therapeutics": "terap", "therapeutic": "terap", "terapeuticos": "terap", "terapeutico": "terap", "tx": "terap",
    "biotech": "biotec", "biotec": "biotec", "bio-tech": "biotec", "biotechnology": "biotec", "biotecnologia": "biotec",
    "laboratorios": "lab", "laboratorio": "lab", "lab": "lab", "labs": "lab", "laboratories": "lab",
    "universidad": "univ", "university": "univ", "universitat": "univ", "univ": "univ", "u": "univ",
    "fundacion": "fund", "fundacio": "fund", "foundation": "fund", "fund": "fund", "fi": "fund",
    "instituto": "inst", "institute": "inst", "institut": "inst", "inst": "inst",
    "cooperativo": "coop", "cooperatiu": "coop", "cooperative": "coop", "coop": "coop", "gc": "coop",
    "asociacion": "asoc", "associacio": "asoc", "association": "asoc", "asoc": "asoc", "as": "asoc",
}
SIDE_WORDS = frozenset("grupo grup group gpo medica medical oncologia oncology doncologia investigacion research recerca de la del para per a of the y and e".split())
LEGAL = frozenset("ltd limited inc incorporated gmbh sa sl slu sociedad anonima limitada s l".split())
TITLES = frozenset("dr dra prof".split())
PARTICLES = frozenset("de la del y".split())
# Short forms of given names.
NICKNAMES = {
    "chelo": "consuelo", "lola": "dolores", "charo": "rosario", "tere": "teresa", "goyo": "gregorio", "manolo": "manuel", "mnel": "manuel",
    "montse": "montserrat", "concha": "concepcion", "rafa": "rafael", "quique": "enrique", "berto": "alberto", "merche": "mercedes",
    "lupe": "guadalupe", "nacho": "ignacio", "ign": "ignacio", "paco": "francisco", "fco": "francisco", "edu": "eduardo", "isa": "isabel",
    "isabelita": "isabel", "santi": "santiago", "stgo": "santiago", "pepa": "josefa", "toni": "antonio", "ant": "antonio", "pepe": "jose",
    "curro": "francisco", "rfl": "rafael",
}
LONG_SHORT_FORMS = sorted({w for kv in NICKNAMES.items() for w in kv if len(w) >= 4})
LONG_WORDS = sorted({w for w in (*CLASS, *SIDE_WORDS, *LEGAL) if len(w) >= 5})
# Openings of additions after a name.
ADDITION = re.compile(r"\(promotor|\bon behalf\b|\by sus filial|\brepresentad|\brepresented\b|\ba company\b|(?<![a-z])c/|\bpart of\b|\bthrough\b")
LEGAL_RUN = [(re.compile(p), r) for p, r in ((r"\bg\.? ?m\.? ?b\.? ?h\b\.?", "gmbh"), (r"\bs\. ?l\. ?u\b\.?", "slu"), (r"\bs\. ?a\b\.?", "sa"), (r"\bs\. ?l\b\.?", "sl"), (r"\bg\.c\.", "gc "), (r"\bf\.i\.", "fi "))]


@lru_cache(maxsize=100_000)
def near_word(word: str, choices: tuple[str, ...], least: int = 5) -> str:
    if len(word) < least:
        return word
    allowed = 1 if len(word) < 9 else 2
    best, d0 = word, allowed + 1
    for c in choices:
        if abs(len(c) - len(word)) <= allowed:
            d = damerau(word, c, allowed)
            if d < d0:
                best, d0 = c, d
    return best


class Name(NamedTuple):
    """``kind``: the class of an organisation ('' without one) or 'persona'. ``before``: the words of a person before a comma, 0 without one."""

    kind: str
    words: list[str]
    before: int = 0
    title: bool = False


def parse_name(name: str | None) -> Name | None:
    """An organisation's class and distinctive words, or a person's words in the order of the text; None for nobody's name.

    Additions after the name, legal forms and titles are left out; short forms of given names are written in full, an initial stays an
    initial. A name of one word without class is an organisation's.
    """
    if is_missing(name):
        return None
    text = fold(name).replace("’", "'")
    m = ADDITION.search(text)
    if m and m.start() > 3:
        text = text[: m.start()]
    for pattern, plain in LEGAL_RUN:
        text = pattern.sub(plain, text)
    text = text.replace("bio-tech", "biotech").replace("d'", "d")
    comma = "," in text.rstrip(" ,")
    head = text.split(",")[0]
    words = re.findall(r"[a-z?ª]+", text.replace("-", " "))
    words = [w if w in CLASS or w in SIDE_WORDS or w in LEGAL or w in TITLES else near_word(w, tuple(LONG_WORDS)) for w in words]
    title = any(w in TITLES for w in words)
    kinds = [CLASS[w] for w in words if w in CLASS and not (w in ("u", "as") and title)]
    legal = any(w in LEGAL and len(w) > 1 for w in words)
    if not title and (kinds or legal):
        kind = next((k for k in kinds if k not in ("lab",)), kinds[0] if kinds else "")
        stems = [w for w in words if w not in CLASS and w not in SIDE_WORDS and w not in LEGAL]
        # a short word beside two long ones is a slip of 'para', 'the' and the like
        long = [w for w in stems if len(w) > 4]
        stems = long if len(long) >= 2 else stems
        return Name(kind, stems) if stems else None
    whose = lambda ws: [w for w in ws if w not in TITLES and w not in PARTICLES and (w not in LEGAL or len(w) == 1)]
    parts = whose(words)
    parts = [p for p in parts if p != "mª"] or parts
    if not parts:
        return None
    if len(parts) == 1 and not title:
        return Name("", parts)
    before = len([w for w in whose(re.findall(r"[a-z?ª]+", head.replace("-", " "))) if w != "mª"]) if comma else 0
    return Name("persona", [NICKNAMES.get(p, p) for p in parts], min(before, len(parts) - 1), title)


_MOVES: dict[tuple, tuple | None] = {}


class Automaton:
    """Levenshtein automaton of one word: a state is the letters read and the cells of the distance table within ``k`` of the diagonal.

    Transitions depend on the cells and on which letters of the word around the diagonal match, so they are made once for all words.
    """

    def __init__(self, word: str, k: int) -> None:
        self.word, self.k = word, k
        self.start = (0, tuple(o - k if 0 <= o - k <= len(word) else k + 1 for o in range(2 * k + 1)))

    def step(self, state: tuple, ch: str) -> tuple | None:
        k, d = self.k, state[0] + 1
        # cell o of the new row stands for the first d + o - k letters of the word
        width = min(2 * k + 1, len(self.word) - d + k + 1)
        at = d - k - 1
        key = (k, state[1], width, tuple(at + o >= 0 and self.word[at + o] == ch for o in range(width)))
        if key not in _MOVES:
            old, new = (*state[1], k + 1), [k + 1] * (2 * k + 1)
            for o in range(width):
                new[o] = min(old[o + 1] + 1, (new[o - 1] if o else k + 1) + 1, old[o] + (not key[3][o]), k + 1)
            _MOVES[key] = tuple(new) if min(new) <= k else None
        out = _MOVES[key]
        return None if out is None else (d, out)

    def distance(self, state: tuple) -> int:
        """Edits between the word and the letters read, more than ``k`` counting as ``k + 1``."""
        o = len(self.word) - state[0] + self.k
        return state[1][o] if 0 <= o <= 2 * self.k else self.k + 1


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return root


def walk(trie: dict, auto: Automaton) -> Iterator[tuple[str, int]]:
    """(word, distance) of all words of the trie the automaton accepts."""
    stack = [(trie, auto.start)]
    while stack:
        node, state = stack.pop()
        for ch, child in node.items():
            if ch == "":
                if auto.distance(state) <= auto.k:
                    yield child, auto.distance(state)
                continue
            new = auto.step(state, ch)
            if new is not None:
                stack.append((child, new))


def bound(n: int) -> int:
    """Edits allowed for a text of n letters."""
    return 0 if n < 5 else 1 if n < 9 else 2 if n < 16 else 3


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(parts)]


def shard_keys(text: str) -> tuple[set[str], set[str]]:
    """(index keys, probe keys): a text within ``bound`` edits of a longer or equal one shares one of its index keys with its probe keys.

    Where a segment can have moved to follows from the edits that the segments before and after it leave over (Li et al., 2011), so a probe
    has some 26 keys at 3 edits.
    """
    n = len(text)
    k = bound(n)
    index = {f"{n}|{i}|{text[p : p + s]}" for i, (p, s) in enumerate(segments(n, k + 1))}
    probe = set()
    for length in range(max(1, n - k), n + 1):
        kl, more = bound(length), n - length
        if more > kl:
            continue
        for i, (p, s) in enumerate(segments(length, kl + 1)):
            for start in range(max(0, p - i, p + more - (kl - i)), min(n - s, p + i, p + more + (kl - i)) + 1):
                probe.add(f"{length}|{i}|{text[start : start + s]}")
    return index, probe


def trie_join(texts: DataFrame, group: str, text: str) -> DataFrame:
    """(group, a, b, d), a < b: distinct texts of one group within their ``bound`` of edits. Exact; empty texts and nulls have no neighbour."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fixed number of parts: the texts are small, the keys made of them are not
    distinct = texts.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(group).alias("g"), F.col(text).alias("t")).repartition(n, "g", "t").distinct()
    fields = [T.StructField("g", T.StringType()), T.StructField("t", T.StringType())]
    keyed_schema = T.StructType([T.StructField("k", T.LongType()), *fields, T.StructField("idx", T.BooleanType())])
    out_schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("d", T.IntegerType())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ks, at, ix = [], [], []
            for row, (g, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                index, probe = shard_keys(t)
                for s, flag in ((index, True), (probe, False)):
                    ks += [xxhash.xxh64_intdigest(f"{g}|{x}") - (1 << 63) for x in s]
                    at += [row] * len(s)
                    ix += [flag] * len(s)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), part.column(0).take(rows), part.column(1).take(rows), pa.array(ix, pa.bool_())], ["k", "g", "t", "idx"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])

        def flush(shard: list[tuple[str, str, bool]]) -> None:
            if len(shard) < 2 or not any(x[2] for x in shard):
                return
            # texts of one group and length make one trie; keys are hashes, so another group or length may share the shard
            tries: dict[tuple[str, int], list[str]] = {}
            for g, t, idx in shard:
                if idx:
                    tries.setdefault((g, len(t)), []).append(t)
            built = {key: build_trie(words) for key, words in tries.items()}
            for g, t, idx in shard:
                if idx:
                    continue
                for (h, n), trie in built.items():
                    k = bound(n)
                    if h == g and 0 <= len(t) - n <= k:
                        for word, d in walk(trie, Automaton(t, k)):
                            if word != t:
                                for o, v in zip(out, (g, min(t, word), max(t, word), d)):
                                    o.append(v)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32())], ["g", "a", "b", "d"])
            for o in out:
                o.clear()
            return made

        now, shard = None, []
        for part in batches:
            for k, g, t, idx in zip(*(part.column(i).to_pylist() for i in range(4))):
                if k != now:
                    flush(shard)
                    now, shard = k, []
                shard.append((g, t, idx))
            yield batch()
        flush(shard)
        yield batch()

    keyed = distinct.mapInArrow(keys, keyed_schema)
    # one shuffle of the keys: counting the shards first to drop lone ones would shuffle them twice more
    return keyed.repartition(n, "k").sortWithinPartitions("k").mapInArrow(join, out_schema).groupBy("g", "a", "b").agg(F.min("d").alias("d"))


@lru_cache(maxsize=500_000)
def word_fits(a: str, b: str) -> int:
    """2 for one word up to a slip, 1 for an initial of the other, 0 for different words."""
    if a == b:
        return 2 if len(a) > 1 else 1
    if len(a) == 1 or len(b) == 1:
        return int(bool(a) and bool(b) and a[0] == b[0])
    k = max(bound(min(len(a), len(b))), 1 if min(len(a), len(b)) >= 4 else 0)
    return 2 if damerau(a, b, k) <= k else 0


def words_fit(x: list[str], y: list[str]) -> bool:
    """Whether every word of ``x`` fits a word of its own in ``y``, in any order, at least one of them in full.

    Equal words are paired first; the others by augmenting paths, so the orders are never listed and no length is refused.
    """
    rest = Counter(y)
    same = Counter()
    for w in x:
        if len(w) > 1 and rest[w] > 0:
            rest[w] -= 1
            same[w] += 1
    left = list((Counter(x) - same).elements())
    right = list(rest.elements())
    if len(left) > len(right):
        return False
    taken: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j, w in enumerate(right):
            if j not in tried and word_fits(left[i], w):
                tried.add(j)
                if j not in taken or place(taken[j], tried):
                    taken[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(left))) and (bool(same) or any(word_fits(left[i], right[j]) == 2 for j, i in taken.items()))


def same_person(a: list[str], b: list[str]) -> bool:
    """Whether two readings [given, surnames...] fit: the given names, and the surnames in some order; later surnames may be missing.

    At least one surname must fit in full; a missing given name fits none.
    """
    if not a or not b or not a[0] or not b[0] or not word_fits(a[0], b[0]):
        return False
    x, y = sorted((a[1:], b[1:]), key=len)
    if not x:
        return False
    if (len(x) == len(y) or word_fits(x[0], y[0])) and words_fit(x, y):
        return True
    joined_x, joined_y = "".join(x), "".join(y)
    return len(joined_x) > 9 and damerau(joined_x, joined_y, 2) <= 2


def _person_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([any(same_person(list(x), list(y)) for x in xs for y in ys) for xs, ys in zip(a, b)], dtype="bool")


def _word_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_fits(x, y) > 0 for x, y in zip(a, b)], dtype="bool")


PARSED = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("clase", T.StringType()), T.StructField("palabras", T.ArrayType(T.StringType())), T.StructField("antes", T.IntegerType()), T.StructField("titulo", T.BooleanType())]
)


def parse_names(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """(id, clase, palabras, antes, titulo) of every row that names somebody."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = [(i, parse_name(n)) for i, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            got = [(i, p) for i, p in got if p is not None and i is not None]
            cols = [pa.array([i for i, _ in got], pa.int64()), pa.array([p.kind for _, p in got], pa.string()), pa.array([p.words for _, p in got], pa.list_(pa.string())), pa.array([p.before for _, p in got], pa.int32()), pa.array([p.title for _, p in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, PARSED.names)

    return df.select(F.col(id_col).cast("bigint"), F.col(name).cast("string")).mapInArrow(run, PARSED)


def _given(read: pd.Series) -> pd.Series:
    """Readings with a mistyped short form of a given name in full."""
    full = lambda w: NICKNAMES.get(x := near_word(w, tuple(LONG_SHORT_FORMS)), x)
    return pd.Series([[[full(r[0]), *r[1:]] for r in rs] for rs in read])


def readings(people: DataFrame) -> DataFrame:
    """(s, lecturas): the readings [given, surnames...] of each person's words.

    After a comma comes the given name. Without one it is the first or the last word: the one that stands more often as a given name in all
    names (after a comma, behind a title) than as a surname (before a comma, between two words); an initial in front is a given name. Where
    the words are equally (un)known, both readings stay.
    """
    n = F.size("palabras")
    word = people.select("antes", "titulo", n.alias("n"), F.length(F.col("palabras")[0]).alias("l0"), F.posexplode("palabras").alias("i", "w")).filter("length(w) > 1")
    given = ((F.col("antes") > 0) & (F.col("i") == F.col("antes"))) | ((F.col("antes") == 0) & F.col("titulo") & (F.col("i") == 0) & (F.col("n") > 1))
    family = ((F.col("antes") > 0) & (F.col("i") < F.col("antes"))) | ((F.col("antes") == 0) & (F.col("i") > 0) & ((F.col("i") < F.col("n") - 1) | (F.col("l0") == 1)))
    role = word.groupBy("w").agg(F.count_if(given).alias("g"), F.count_if(family).alias("f")).filter("g + f > 0")
    role = cut(role.select("w", (F.col("g") / (F.col("g") + F.col("f"))).alias("p")))
    ends = people.withColumn("w0", F.col("palabras")[0]).withColumn("w1", F.element_at("palabras", -1))
    ends = ends.join(role.select(F.col("w").alias("w0"), F.col("p").alias("p0")).hint("merge"), "w0", "left").join(role.select(F.col("w").alias("w1"), F.col("p").alias("p1")).hint("merge"), "w1", "left")
    p0 = F.when(F.length("w0") == 1, F.lit(1.0)).otherwise(F.coalesce("p0", F.lit(0.5)))
    p1 = F.coalesce("p1", F.lit(0.5))
    first, last = F.col("palabras"), F.concat(F.slice("palabras", -1, 1), F.slice("palabras", F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice("palabras", F.col("antes") + 1, F.lit(1)), F.slice("palabras", F.lit(1), F.col("antes")), F.slice("palabras", F.col("antes") + 2, F.greatest(n - F.col("antes") - 1, F.lit(0))))
    both = F.when((F.col("antes") > 0) & (n > 1), F.array(after)).when((p0 > p1) | (n < 2), F.array(first)).when(p1 > p0, F.array(last)).otherwise(F.array_distinct(F.array(first, last)))
    return ends.select("s", F.pandas_udf(_given, "array<array<string>>")(both).alias("lecturas"))


#: Up to so many surnames, each two of them make keys of their own; longer names are found by their whole text.
SURNAMES = 6


def person_links(people: DataFrame) -> DataFrame:
    """Links (a, b) between the spellings ``s`` of one person.

    Candidates share an initial of the given name, a surname within its bound and the initial of another surname, or the whole text within
    its bound; so no list of all bearers of a common surname is ever paired. Full names that fit are linked; an abbreviated name is linked
    to the one person it fits, and to none where it fits several; abbreviated names that fit no full one are linked with each other.
    """
    read = cut(readings(people))
    r = read.select("s", F.explode("lecturas").alias("l")).select("s", F.col("l")[0].alias("given"), F.substring(F.col("l")[0], 1, 1).alias("i"), F.slice("l", F.lit(2), F.size("l")).alias("sur"), F.array_join("l", "").alias("todo"), (~F.exists("l", lambda w: F.length(w) <= 1)).alias("largas"))
    two = r.filter((F.size("sur") >= 2) & (F.size("sur") <= SURNAMES))
    pairs = two.select("s", "i", F.posexplode("sur").alias("p", "t"), "sur").filter("length(t) > 2").select("s", "i", "p", "t", F.posexplode("sur").alias("q", "o")).filter("p <> q")
    by_two = pairs.select("s", F.concat_ws("|", F.lit("2"), "i", F.substring("o", 1, 1)).alias("g"), "t")
    whole = r.filter("largas AND size(sur) >= 1").select("s", F.lit("todo").alias("g"), F.col("todo").alias("t"))
    # who has one surname only, and the first surnames such a name may be short for
    firsts = r.filter((F.size("sur") >= 1) & (F.length(F.col("sur")[0]) > 2)).select("s", F.concat_ws("|", F.lit("1"), "i").alias("g"), F.col("sur")[0].alias("t"), "given", (F.size("sur") == 1).alias("uno"))
    firsts = cut(firsts)
    keyed = cut(by_two.unionByName(whole).distinct())
    near = cut(trie_join(keyed.select("g", "t").unionByName(firsts.select("g", "t")), "g", "t"))
    near = cut(near.select("g", F.col("a").alias("t"), F.col("b").alias("u")).unionByName(near.select("g", F.col("b").alias("t"), F.col("a").alias("u"))))
    other = keyed.select("g", F.col("t").alias("u"), F.col("s").alias("b"))
    at = keyed.select("g", "t", F.col("s").alias("a"), F.col("t").alias("u")).unionByName(keyed.join(near.hint("merge"), ["g", "t"]).select("g", "t", F.col("s").alias("a"), "u"))
    cand = at.select("g", "u", "a").join(other.hint("merge"), ["g", "u"]).filter("a < b").select("a", "b").distinct()
    side = lambda n: read.select(F.col("s").alias(n), F.col("lecturas").alias(f"l{n}"))
    is_full = lambda l: F.exists(l, lambda w: (F.size(w) >= 3) & ~F.exists(w, lambda x: F.length(x) <= 1))
    fits = cand.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").filter(F.pandas_udf(_person_pairs, "boolean")("la", "lb"))
    fits = cut(fits.select("a", "b", is_full("la").alias("fa"), is_full("lb").alias("fb")))
    strong = fits.filter("fa AND fb").select("a", "b")
    full = read.filter(is_full("lecturas")).select(F.col("s").alias("node"))
    comp = cut(full.join(connected_components(strong, "a", "b").hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    mixed = fits.filter("fa <> fb").select(F.when(F.col("fa"), F.col("b")).otherwise(F.col("a")).alias("weak"), F.when(F.col("fa"), F.col("a")).otherwise(F.col("b")).alias("node"))
    owner = cut(mixed.join(comp.hint("merge"), "node").groupBy("weak").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    free = fits.filter("NOT fa AND NOT fb").join(owner.select(F.col("weak").alias("a")).hint("merge"), "a", "left_anti").join(owner.select(F.col("weak").alias("b")).hint("merge"), "b", "left_anti").select("a", "b")
    links = cut(strong.unionByName(owner.filter("lo = hi").select(F.col("weak").alias("a"), F.col("lo").alias("b"))).unionByName(free))
    # one surname only: entities of the longer names are counted by (given name, first surname) first
    known = connected_components(links, "a", "b").select(F.col("node").alias("s"), "component")
    longer = firsts.filter("NOT uno").join(known.hint("merge"), "s", "left").groupBy("g", "t", "given").agg(F.min(F.coalesce("component", "s")).alias("lo"), F.max(F.coalesce("component", "s")).alias("hi"))
    short = firsts.filter("uno").join(owner.select(F.col("weak").alias("s")).hint("merge"), "s", "left_anti")
    short = cut(short.select("s", "g", "given", F.col("t").alias("u"), F.lit(True).alias("igual")).unionByName(short.join(near.hint("merge"), ["g", "t"]).select("s", "g", "given", "u", F.lit(False).alias("igual"))))
    same = F.pandas_udf(_word_pairs, "boolean")
    found = short.join(longer.select("g", F.col("t").alias("u"), F.col("given").alias("other"), "lo", "hi").hint("merge"), ["g", "u"]).filter(same("given", "other"))
    # the surname as written comes before its neighbours
    lo, hi = F.min(F.when(F.col("igual"), F.col("lo"))), F.max(F.when(F.col("igual"), F.col("hi")))
    found = cut(found.groupBy("s").agg(F.coalesce(lo, F.min("lo")).alias("lo"), F.coalesce(hi, F.max("hi")).alias("hi")))
    alone = short.join(found.select("s").hint("merge"), "s", "left_anti")
    mates = firsts.filter("uno").join(found.select("s").hint("merge"), "s", "left_anti").select("g", F.col("t").alias("u"), F.col("given").alias("other"), F.col("s").alias("b"))
    alike = alone.select("g", "u", "given", F.col("s").alias("a")).join(mates.hint("merge"), ["g", "u"]).filter(F.col("a") < F.col("b")).filter(same("given", "other")).select("a", "b")
    return cut(links.unionByName(found.filter("lo = hi").select(F.col("s").alias("a"), F.col("lo").alias("b"))).unionByName(alike))


def organisation_links(orgs: DataFrame) -> DataFrame:
    """Links (a, b) between the spellings ``s`` of one organisation.

    Within a class: the words run together are near in the order of the text, reversed or sorted; or, with three words and more, all words but
    one are the same and that one is near, whatever their order.
    """
    join = lambda w: F.array_join(w, "")
    n = F.size("palabras")
    orders = F.array_distinct(F.array(join("palabras"), join(F.reverse("palabras")), join(F.array_sort("palabras"))))
    texts = orgs.select("s", F.concat(F.lit("t|"), "clase").alias("g"), F.explode(orders).alias("t"))
    ordered = orgs.filter((n >= 3) & (n <= 2 * SURNAMES)).select("s", "clase", F.array_sort("palabras").alias("w"))
    one_out = ordered.select("s", "clase", "w", F.posexplode("w").alias("p", "t")).select("s", F.concat_ws("|", F.lit("u"), "clase", F.array_join(F.filter("w", lambda x, i: i != F.col("p")), "|")).alias("g"), "t")
    keyed = texts.unionByName(one_out)
    by_text = cut(keyed.groupBy("g", "t").agg(F.min("s").alias("m"), F.max("s").alias("hi")))
    near = cut(trie_join(by_text, "g", "t"))
    copies = keyed.join(by_text.filter("m < hi").hint("merge"), ["g", "t"]).filter(F.col("s") != F.col("m")).select(F.col("s").alias("a"), F.col("m").alias("b"))
    side = lambda x: by_text.select("g", F.col("t").alias(x), F.col("m").alias(f"m{x}"))
    return cut(copies.unionByName(near.join(side("a").hint("merge"), ["g", "a"]).join(side("b").hint("merge"), ["g", "b"]).select(F.col("ma").alias("a"), F.col("mb").alias("b"))))


def resolve_names(parsed: DataFrame) -> DataFrame:
    """(id, entity) of all parsed names; equal spellings collapse before anything is joined."""
    parts = ["clase", "palabras", "antes", "titulo"]
    spelled = cut(parsed.groupBy(*parts).agg(F.min("id").alias("s")))
    # the same words with and without a title or comma are one spelling of an organisation, but not of a person, whose reading they decide
    links = organisation_links(spelled.filter("clase <> 'persona'")).unionByName(person_links(spelled.filter("clase = 'persona'")))
    entity = connected_components(links, "a", "b")
    whole = cut(spelled.join(entity.hint("merge"), spelled["s"] == entity["node"], "left").select(*parts, F.coalesce("component", "s").alias("entity")))
    return parsed.join(whole.hint("merge"), parts).select("id", "entity")


def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = parse_names(table(spark, sf_dir, "sponsors"), "sponsor_id", "promotor")
    return cut(resolve_names(cut(s.unionByName(parse_names(table(spark, sf_dir, "funders"), "funder_id", "nombre")))))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entidad): every spelling with the smallest id of its body, one row each, and the number of its spellings in ``grafias``."""
    e = p5_names(spark, sf_dir)
    n = e.groupBy("entity").agg(F.count(F.lit(1)).alias("grafias"))
    return e.join(n.hint("merge"), "entity").select("id", F.col("entity").alias("entidad"), "grafias")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one organisation or person, sponsors and funders pooled."""
    e = p5_names(spark, sf_dir)
    a, b = e.select("entity", F.col("id").alias("id_a")), e.select("entity", F.col("id").alias("id_b"))
    return a.join(b, "entity").filter("id_a < id_b").select("id_a", "id_b")
