"""Problem 9: passages of evaluation items inside training documents.

Item passages are cut into windows the size of the shortest stretch that counts, documents into windows of the same size; each window has a
64-bit SimHash of its weighted words. Fingerprints are compared through a multi-index: with four blocks of 16 bits, two fingerprints within
Hamming distance 3 agree in at least one block, so all pairs within the radius are found. Each candidate pair is then verified exactly by
growing the stretches around its windows and measuring the share of the passage's words they cover.

The items are a stated query set: they are held in blocks of bounded size and every document is read against each block, in a narrow stage
(small tables are spread over all cores first).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censo.functions.places import damerau, fold
from censo.session import at_least_partitions, cut, table

#: Words in a window: a stretch of a fifth of the shortest usual passage.
WINDOW = 7
BLOCKS, RADIUS = 4, 3
#: Share of a passage's words that makes a case, in at most two stretches of at least LEAST_STRETCH words; the slips leave some out.
LEAST_SHARE, LEAST_STRETCH = 0.4, 5
ITEMS_PER_PASS = 4000
#: Words whose windows are computed at a time.
CHUNK = 100_000
#: Weighted share of a stretch's words and word pairs that the document must repeat exactly.
LEAST_SIMILAR = 0.62
#: An opening sentence shared by this many items is an instruction.
SHARED_BY = 3

WORD = re.compile(r"[^\W_]+(?:[.,'’·-][^\W_]+)*")
TAGS = re.compile(r"<[^<>]{1,80}>")


def words_of(text: str | None) -> list[str]:
    """Folded words of a text without markup; numbers with their decimals are one word. Null gives no words."""
    if not text:
        return []
    return WORD.findall(fold(TAGS.sub(" ", text)))


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.?!;])\s+", text) if s.strip()]


def without_answers(text: str | None) -> str:
    return re.split(r"(?:^|\s)A\)\s", text or "", maxsplit=1)[0]


def own_passages(items: list[tuple[int, str | None]]) -> dict[int, list[str]]:
    """The words of each item's own passage: without lettered answers at its end and opening sentences that other items share."""
    cut_answers = {i: without_answers(t) for i, t in items}
    opening = Counter()
    for t in cut_answers.values():
        first = sentences(t)[:1]
        if first:
            opening[" ".join(words_of(first[0]))] += 1
    out = {}
    for i, t in cut_answers.items():
        parts = sentences(t)
        while len(parts) > 1 and opening[" ".join(words_of(parts[0]))] >= SHARED_BY:
            parts = parts[1:]
        out[i] = words_of(" ".join(parts))
    return out


def fingerprints(texts: list[list[str]], weights: dict[str, float], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SimHash, text, offset) of every window of ``width`` words of the texts; a shorter text is one window, an empty one has none."""
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    # whole-number weights: sums are exact, so equal windows have equal fingerprints wherever they stand
    kind = np.int16 if width * max([2.0, *weights.values()]) * 16 < 32_000 else np.int32  # differences are exact though running sums wrap
    w = np.array([round(weights.get(x, 2.0) * 16) for x in number], kind)[:, None]
    signed = np.where(bits, w, -w)
    total = np.zeros((len(at) + 1, 64), kind)
    np.cumsum(signed[at], axis=0, out=total[1:], dtype=kind)
    size = np.array([len(words) for words in texts], np.int64)
    begin = np.cumsum(size) - size
    windows = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = begin[text] + offset
    prints = np.packbits((total[start + np.minimum(width, size[text])] - total[start]) > 0, axis=1).view(np.uint64).reshape(-1)
    return prints, text, offset


class Index:
    """Multi-index over the fingerprints of a block of items."""

    def __init__(self, passages: dict[int, list[str]], width: int = WINDOW, counts: dict[str, int] | None = None, n: int = 0) -> None:
        """``counts``: in how many of all ``n`` passages each word stands; by default those of ``passages``."""
        if counts is None:
            counts, n = Counter(w for p in passages.values() for w in set(p)), len(passages)
        n = max(n, 1)
        self.weights = {w: float(0.3 + np.log((n + 1) / c) / np.log(n + 1) * 2.0) for w, c in counts.items()}
        self.passages = passages
        prints, owner, offset = [], [], []
        for i, p in passages.items():
            # a passage that repeats itself is entered once for each different window: the stretches grow from there
            f, first = np.unique(fingerprints([p], self.weights, width)[0], return_index=True)
            prints.append(f)
            owner.append(np.full(len(f), i, np.int64))
            offset.append(first.astype(np.int32))
        self.prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        self.offset = np.concatenate(offset) if offset else np.empty(0, np.int32)
        self.order, self.start = [], []
        for b in range(BLOCKS):
            v = self._block(self.prints, b)
            order = np.argsort(v, kind="stable")
            self.order.append(order)
            self.start.append(np.searchsorted(v[order], np.arange(65537)))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, window of the items) of all pairs within the radius."""
        places, found = [], []
        for b in range(BLOCKS):
            v = self._block(prints, b)
            lo, hi = self.start[b][v], self.start[b][v + 1]
            size = hi - lo
            if not size.any():
                continue
            d = np.repeat(np.arange(len(prints)), size)
            within = np.arange(len(d)) - np.repeat(np.cumsum(size) - size, size)
            x = self.order[b][np.repeat(lo, size) + within]
            near = np.bitwise_count(prints[d] ^ self.prints[x]) <= RADIUS
            places.append(d[near])
            found.append(x[near])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(found)


def like(a: str, b: str) -> bool:
    """One word up to a slip of the keyboard or the scanner."""
    if a == b:
        return True
    n = min(len(a), len(b))
    k = 0 if n < 4 else 1 if n < 9 else 2
    return k > 0 and damerau(a, b, k) <= k


# ways around a slip: words skipped in the passage and in the document
SKIPS = ((1, 1), (0, 1), (1, 0), (1, 2), (2, 1), (2, 2), (0, 2), (2, 0), (3, 3), (2, 3), (3, 2), (1, 3), (3, 1))


def grow(p: list[str], d: list[str], i: int, j: int, step: int) -> tuple[int, int]:
    """The last place (i, j) that still fits when going on from a fitting place in the direction of ``step``."""
    while True:
        a, b = i + step, j + step
        if 0 <= a < len(p) and 0 <= b < len(d) and like(p[a], d[b]):
            i, j = a, b
            continue
        for si, sj in SKIPS:
            a, b = i + step * (1 + si), j + step * (1 + sj)
            c, e = a + step, b + step
            if 0 <= a < len(p) and 0 <= b < len(d) and p[a] == d[b] and (not 0 <= c < len(p) or (0 <= e < len(d) and like(p[c], d[e]))):
                i, j = a, b
                break
        else:
            return i, j


def shingle_share(p: list[str], d: list[str], weights: dict[str, float]) -> float:
    """Weighted share of the words and word pairs of ``p`` that occur in ``d``: what a common template leaves open weighs most."""
    have = Counter(d)
    have.update(zip(d, d[1:]))
    total = found = 0.0
    for s in [*p, *zip(p, p[1:])]:
        w = weights.get(s, 2.0) if isinstance(s, str) else 0.5 * (weights.get(s[0], 2.0) + weights.get(s[1], 2.0))
        total += w
        if have[s] > 0:
            have[s] -= 1
            found += w
    return found / total if total else 0.0


def covered(p: list[str], d: list[str], seeds: list[tuple[int, int]], weights: dict[str, float]) -> float:
    """Share of the passage's words in the best one or two stretches, in the passage's order, that grow from the seeds."""
    stretches: list[tuple[int, int, int, int]] = []
    for i, j in seeds:
        at = next((k for k in range(min(WINDOW, len(p) - i)) if j + k < len(d) and p[i + k] == d[j + k]), None)
        if at is None:
            continue
        i, j = i + at, j + at
        if any(a <= i <= b and x <= j <= y for a, b, x, y in stretches):
            continue
        a, x = grow(p, d, i, j, -1)
        b, y = grow(p, d, i, j, 1)
        if b - a + 1 >= LEAST_STRETCH and shingle_share(p[a : b + 1], d[x : y + 1], weights) >= LEAST_SIMILAR:
            stretches.append((a, b, x, y))
    if not stretches or not p:
        return 0.0
    A, B, X, Y = np.array(stretches).T
    best = int((B - A + 1).max())
    for a, b, x, y in stretches:
        # the other stretch comes before this one, in the passage and in the document
        before = (Y < x) & (A <= a)
        if before.any():
            best = max(best, int(((B - A + 1)[before] + np.maximum(0, b - np.maximum(a, B[before] + 1) + 1)).max()))
    return best / len(p)


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("cubre", T.DoubleType())])


def passages_of(items: DataFrame) -> DataFrame:
    """(item_id, palabras): the words of each item's own passage (``own_passages``), those of LEAST_STRETCH words and more."""
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("frases", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            said = [[" ".join(words_of(x)) for x in sentences(without_answers(t))] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.list_(pa.string()))], ["item_id", "frases"])

    one = items.filter("item_id IS NOT NULL").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.max(F.col("text").cast("string")).alias("text"))
    parsed = cut(one.mapInArrow(run, schema))
    shared = parsed.filter(F.size("frases") > 0).groupBy(F.col("frases")[0].alias("f")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED_BY)
    each = parsed.select("item_id", F.size("frases").alias("of"), F.posexplode("frases").alias("i", "f")).join(shared.hint("merge"), "f", "left")
    # the last sentence is always the item's own
    start = each.filter((F.col("n").isNull()) | (F.col("i") == F.col("of") - 1)).groupBy("item_id").agg(F.min("i").alias("i"))
    rest = parsed.join(start.hint("merge"), "item_id").select("item_id", F.slice("frases", F.col("i") + 1, F.size("frases")).alias("frases"))
    text = rest.select("item_id", F.array_join("frases", " ").alias("t"))
    return text.select("item_id", F.filter(F.split("t", " "), lambda w: w != "").alias("palabras")).filter(F.size("palabras") >= LEAST_STRETCH)


def _chunks(part: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[str]]]]:
    """The documents of a batch, some CHUNK words at a time."""
    ids, texts, n = [], [], 0
    for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
        ids.append(i)
        texts.append(words_of(t))
        n += len(texts[-1])
        if n >= CHUNK:
            yield ids, texts
            ids, texts, n = [], [], 0
    yield ids, texts


def _leaks_of(texts: list[list[str]], index: Index, least: float) -> Iterator[tuple[int, int, float]]:
    """(text, item, share) of all texts that hold at least ``least`` of an item's passage."""
    prints, text, offset = fingerprints(texts, index.weights)
    at, window = index.search(prints)
    if not len(at):
        return
    hits = np.unique(np.stack([text[at], index.owner[window], index.offset[window], offset[at]], axis=1), axis=0)
    begins = np.flatnonzero(np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(axis=1)])
    for rows in np.split(hits, begins[1:]):
        t, item = int(rows[0, 0]), int(rows[0, 1])
        share = covered(index.passages[item], texts[t], [(i, j) for i, j in rows[:, 2:].tolist()], index.weights)
        if share >= least:
            yield t, item, share


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, cubre) for every document that holds at least ``least`` of an item's own passage; cubre is the share.

    Null or empty texts and items leak nothing; repeated documents are each reported; repeated rows of one doc_id give repeated results;
    passages shorter than LEAST_STRETCH words are no cases; of an item_id given twice the greater text counts. ``items``: (item_id, text), a query
    set of some thousand: it is searched in blocks of about ITEMS_PER_PASS, each of which reads the documents once.
    """
    docs = at_least_partitions(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))
    own = cut(passages_of(items))
    words = F.array_distinct("palabras")
    counts = cut(own.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    number = own.count()
    passes = max(1, -(-number // ITEMS_PER_PASS))
    out = None
    for at in range(passes):
        # one block of the query set at a time comes to the driver, with the counts of its own words
        mine = own.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == at)
        block = {r["item_id"]: list(r["palabras"]) for r in mine.orderBy("item_id").collect()}
        known = mine.select(F.explode(words).alias("w")).distinct().join(counts.hint("merge"), "w")
        weights = {r["w"]: r["n"] for r in known.collect()}

        def run(batches: Iterator[pa.RecordBatch], block=block, weights=weights) -> Iterator[pa.RecordBatch]:
            index = Index(block, WINDOW, weights, number)
            for part in batches:
                rows: tuple[list, list, list] = ([], [], [])
                for ids, texts in _chunks(part):
                    for at, item, share in _leaks_of(texts, index, least):
                        for column, v in zip(rows, (ids[at], item, share)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], OUT.names)

        found = docs.mapInArrow(run, OUT)
        out = found if out is None else out.unionByName(found)
    return out


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the items it gives away."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")
