"""Problem 10: the language of documents and of the segments of mixed documents.

Hierarchical discrimination: a linear model tells the language family of a sentence, then one-versus-one linear support vector machines
separate the related languages within the family. Sentences are scored in the order of the text, a Viterbi pass with a price for switching
gives their languages, and runs of two or more sentences are the segments.

The models are fitted on a bounded sample of labelled sentences (``TRAIN_SENTENCES``); labels are noisy, so the fit is repeated without the
sentences it contradicts. Everything else reads every document whole, in one narrow stage.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censo.functions.places import fold, repair
from censo.session import at_least_partitions, cut, table

FAMILIES = {"romance": ("ca", "es", "fr", "gl", "pt"), "germanica": ("de", "en"), "vasca": ("eu",)}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))
FAMILY_OF = {x: f for f, xs in FAMILIES.items() for x in xs}
#: Bound of the labelled sample the models are fitted on, sentences per language.
TRAIN_SENTENCES = 1500
TRAIN_DOCUMENTS, PER_OPENING = 20_000, 8
DIM, ORDERS = 1 << 16, (2, 3, 4)
EPOCHS, LAMBDA, SEED = 6, 1e-4, 7
SWITCH = 2.2
SHARPNESS = 7.0
LEAST_WORDS = 5
#: Characters whose sentences are scored at a time.
CHUNK = 500_000

# Notations of the eight languages.
NOTATIONS = {
    "es": "es spa castellano espanol spanish", "en": "en eng english ingles", "ca": "ca cat catalan catala", "gl": "gl glg galego gallego galician",
    "pt": "pt por portugues portuguese", "fr": "fr fra fre francais frances french", "de": "de deu ger deutsch aleman german",
    "eu": "eu eus baq euskara euskera vasco basque",
}
CODE_OF = {n: code for code, names in NOTATIONS.items() for n in names.split()}
STAND_INS = frozenset(["", "?", "n/a", "na", "xx", "und", "unknown", "none", "null", "nd", "n/d", "-", ".", "zxx", "mul", "sin datos", "desconocido", "s/d", "no consta"])

TAG = re.compile(r"<[^<>]{1,80}>")
BREAK = re.compile(r"(?<=[.!?…;])[\"»”')\]]*\s+|\n+|\s/\s|\s\|\s")
WORDS = re.compile(r"[^\W\d_]{2,}")


def label_code(label: str | None) -> str | None:
    """The code of a label in any notation; None where it is missing or a stand-in; 'otra' for other languages."""
    f = fold(label).strip()
    if f in STAND_INS:
        return None
    head = re.split(r"[-_ ]", f)[0]
    return CODE_OF.get(f) or CODE_OF.get(head) or "otra"


def sentences(text: str | None) -> list[str]:
    """Sentences of a text without markup, in order; parts without a word of letters are dropped. Null gives none."""
    if not text:
        return []
    t = TAG.sub(" ", text)
    lines = "\n".join(repair(x) for x in t.split("\n"))
    return [s.strip() for s in BREAK.split(lines) if s and WORDS.search(s)]


def plain(text: str) -> str:
    """Without accents: the form a text takes when they are lost."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def grams(parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, part) of all character n-grams of the parts, one pair of arrays for each n, in the order of the parts.

    Words only, case folded, with their ends; n-grams do not cross from one part to the next.
    """
    texts = [" " + " ".join(WORDS.findall(p.casefold())) + " " for p in parts]
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ c[k : len(c) - n + 1 + k]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = owner[: len(h)] == owner[n - 1 :]
        out.append((((h >> np.uint64(40)) % np.uint64(DIM)).astype(np.int64)[inside], owner[: len(h)][inside]))
    return out


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Averaged stochastic subgradient descent for a linear support vector machine (Pegasos) on sparse rows (index, value)."""
    w, total, t = np.zeros(DIM, np.float32), np.zeros(DIM, np.float64), 0
    scale = 1.0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1.0 / (LAMBDA * (t + 1000.0))
            idx, val = rows[i]
            margin = y[i] * scale * float(w[idx] @ val)
            scale *= 1.0 - rate * LAMBDA
            if margin < 1.0:
                w[idx] += (rate * y[i] / scale) * val
        if epoch >= EPOCHS // 2:
            total += scale * w
    return (total / max(1, EPOCHS - EPOCHS // 2)).astype(np.float32)


def _row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A sentence as a sparse row: n-gram counts over the root of their sum."""
    found = [x for x, _ in grams([text])]
    idx, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    return idx, (count / np.sqrt(max(1, count.sum()))).astype(np.float32)


class Discriminator:
    """Family model and one-versus-one machines; unfitted it knows only the languages it has seen."""

    def __init__(self) -> None:
        self.languages: tuple[str, ...] = ()
        self.families: tuple[str, ...] = ()
        self.family_w = np.zeros((0, DIM), np.float32)
        self.pairs: list[tuple[str, str]] = []
        self.pair_w = np.zeros((0, DIM), np.float32)
        self._weights: np.ndarray | None = None

    def fit(self, texts: list[str], labels: list[str]) -> Discriminator:
        """Fit, drop the sentences the first fit contradicts, fit again. Labels outside the eight languages are ignored."""
        keep = [i for i, x in enumerate(labels) if x in FAMILY_OF]
        texts, labels = [texts[i] for i in keep], [labels[i] for i in keep]
        for again in (False, True):
            self._fit(texts, labels)
            if not again:
                said = np.argmax(self.scores(texts), axis=1) if texts else []
                good = [i for i, k in enumerate(said) if self.languages[k] == labels[i]]
                if {labels[i] for i in good} == set(labels):
                    texts, labels = [texts[i] for i in good], [labels[i] for i in good]
        return self

    def _fit(self, texts: list[str], labels: list[str]) -> None:
        self._weights = None
        rng = np.random.default_rng(SEED)
        doubled = [(t, y) for t, y in zip(texts, labels)] + [(plain(t), y) for t, y in zip(texts, labels) if plain(t) != t]
        rows, ys = [_row(t) for t, _ in doubled], [y for _, y in doubled]
        self.languages = tuple(sorted(set(ys)))
        self.families = tuple(sorted({FAMILY_OF[y] for y in ys}))
        fam = np.array([FAMILY_OF[y] for y in ys]) if ys else np.array([], str)
        self.family_w = np.stack([_svm(rows, np.where(fam == f, 1.0, -1.0), rng) for f in self.families]) if len(self.families) > 1 else np.zeros((len(self.families), DIM), np.float32)
        self.pairs, ws = [], []
        for f in self.families:
            members = [x for x in self.languages if FAMILY_OF[x] == f]
            for a, b in combinations(members, 2):
                at = [i for i, y in enumerate(ys) if y in (a, b)]
                self.pairs.append((a, b))
                ws.append(_svm([rows[i] for i in at], np.array([1.0 if ys[i] == a else -1.0 for i in at]), rng))
        self.pair_w = np.stack(ws) if ws else np.zeros((0, DIM), np.float32)

    def scores(self, parts: list[str]) -> np.ndarray:
        """Log probabilities of ``languages`` for each part (one row a part)."""
        weights = np.vstack([self.family_w, self.pair_w]).T if self._weights is None else self._weights
        self._weights = np.ascontiguousarray(weights)
        sums, number = np.zeros((len(parts), self._weights.shape[1])), np.zeros(len(parts))
        for x, owner in grams(parts):
            if len(x):
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[owner[first]] += np.add.reduceat(self._weights[x], first, axis=0)
                number += np.bincount(owner, minlength=len(parts))
        sums /= np.sqrt(np.maximum(number, 1.0))[:, None]
        nf = len(self.families)
        fam = _log_softmax(SHARPNESS * sums[:, :nf])
        out = np.zeros((len(parts), len(self.languages)))
        for k, f in enumerate(self.families):
            members = [i for i, x in enumerate(self.languages) if FAMILY_OF[x] == f]
            inner = np.zeros((len(parts), len(members)))
            for m, i in enumerate(members):
                x = self.languages[i]
                own = [sums[:, nf + j] * (1.0 if a == x else -1.0) for j, (a, b) in enumerate(self.pairs) if x in (a, b)]
                # the weakest of a language's comparisons decides, so a related third language cannot outvote it
                inner[:, m] = np.min(own, axis=0) if own else 0.0
            out[:, members] = fam[:, [k]] + _log_softmax(SHARPNESS * inner)
        return out

    def best(self, text: str) -> str | None:
        return self.languages[int(np.argmax(self.scores([text])[0]))] if self.languages else None


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Of the last axis."""
    if not x.size:
        return x
    m = x.max(axis=-1, keepdims=True)
    return x - m - np.log(np.exp(x - m).sum(axis=-1, keepdims=True))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> list[int]:
    """The best sequence of languages, each change costing ``switch``."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), np.int64)
    for t in range(1, n):
        top = int(np.argmax(best))
        stay = best >= best[top] - switch
        back[t] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - switch) + scores[t]
    path = [int(np.argmax(best))]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return path[::-1]


def segments(model: Discriminator, text: str | None) -> list[tuple[str, float, int]]:
    """(language, confidence, sentences) of a text's segments in order; [] for texts of fewer than LEAST_WORDS words."""
    return segments_of(model, [text])[0]


def segments_of(model: Discriminator, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
    """The segments of each text; the sentences of all texts are scored together, some CHUNK characters at a time."""
    out: list[list[tuple[str, float, int]]] = []
    waiting: list[list[str]] = []

    def flush() -> None:
        parts = [p for ps in waiting for p in ps]
        scores = model.scores(parts) * np.minimum(1.0, np.array([len(p) for p in parts]) / 60.0)[:, None] if parts else np.zeros((0, 0))
        at = 0
        for ps in waiting:
            out.append(_runs(model, scores[at : at + len(ps)]) if ps else [])
            at += len(ps)
        waiting.clear()

    n = 0
    for t in texts:
        ps = sentences(t) if model.languages else []
        words = 0
        for p in ps:
            words += len(WORDS.findall(p)) if words < LEAST_WORDS else 0
        waiting.append(ps if words >= LEAST_WORDS else [])
        n += len(t or "")
        if n >= CHUNK:
            flush()
            n = 0
    flush()
    return out


def _runs(model: Discriminator, scores: np.ndarray) -> list[tuple[str, float, int]]:
    """Segments from the scores of a text's sentences.

    Runs of one sentence between others are no segments: they are left out, and the runs around them, if of one language, are one. A text of
    one language, or without any run of two, is a single segment.
    """
    best = scores.argmax(axis=1)
    # where every sentence says the same, no path can be better
    path = [int(best[0])] * len(best) if (best == best[0]).all() else viterbi(scores)
    runs: list[list[int]] = []
    for i, x in enumerate(path):
        if runs and path[runs[-1][0]] == x:
            runs[-1].append(i)
        else:
            runs.append([i])
    kept: list[list[int]] = []
    for r in (r for r in runs if len(r) > 1):
        if kept and path[kept[-1][0]] == path[r[0]]:
            kept[-1] += r
        else:
            kept.append(list(r))
    if len({path[r[0]] for r in kept}) < 2:
        total = scores.sum(axis=0)
        x = path[kept[0][0]] if kept else int(np.argmax(total))
        kept = [[i for i in range(len(path)) if path[i] == x] or list(range(len(path)))]
        path = [x] * len(path)
    out = []
    for r in kept:
        p = _log_softmax(scores[r].sum(axis=0))
        out.append((model.languages[path[r[0]]], float(np.exp(p[path[r[0]]])), len(r)))
    return out


def training_sample(documents: DataFrame, per_language: int = TRAIN_SENTENCES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """Up to ``per_language`` labelled sentences of each language, from about TRAIN_DOCUMENTS documents chosen by hash: the same at every partitioning.

    Sentences are grouped by their first two words; a group's sentences count only under the label most of them carry, and at most
    PER_OPENING of a group are taken, so that common phrases neither crowd out the others nor carry wrong labels in.
    """
    schema = T.StructType([T.StructField("y", T.StringType()), T.StructField("s", T.StringType()), T.StructField("o", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ys, ss, os = [], [], []
            for label, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                code = label_code(label)
                if code in FAMILY_OF:
                    for s in sentences(body):
                        if len(s) >= 30:
                            ys.append(code)
                            ss.append(s)
                            os.append(" ".join(re.findall(r"[^\W\d_]+", s.casefold())[:2]))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.string()), pa.array(ss, pa.string()), pa.array(os, pa.string())], ["y", "s", "o"])

    named = documents.select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"), F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(SEED)), F.lit(1_000_000)).alias("h")).filter("l IS NOT NULL AND t IS NOT NULL")
    share = min(1.0, TRAIN_DOCUMENTS / max(1, documents.count()))
    found = cut(named.filter(F.col("h") < F.lit(round(share * 1_000_000))).select("l", "t").mapInArrow(run, schema))
    votes = found.groupBy("o", "y").agg(F.count(F.lit(1)).alias("n"))
    firm = votes.groupBy("o").agg(F.max_by("y", F.struct("n", "y")).alias("y"), F.max("n").alias("n"), F.sum("n").alias("of")).filter("n * 2 > of").select("o", "y")
    by = W.partitionBy("o", "y").orderBy("k", "s")
    few = found.join(firm, ["o", "y"]).select("o", "y", "s").distinct().withColumn("k", F.xxhash64("s")).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= PER_OPENING)
    ranked = few.withColumn("q", F.row_number().over(W.partitionBy("y").orderBy("r", "k", "s"))).filter(F.col("q") <= per_language)
    texts, labels = [], []
    for r in ranked.select("y", "s").orderBy("y", "s").collect():  # at most per_language rows of each language
        texts.append(r["s"])
        labels.append(r["y"])
    return texts, labels


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("orden", T.IntegerType()), T.StructField("idioma", T.StringType()), T.StructField("confianza", T.DoubleType()), T.StructField("frases", T.IntegerType()), T.StructField("etiqueta", T.StringType()), T.StructField("varias", T.BooleanType())])


def identify(documents: DataFrame, model: Discriminator, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, orden, idioma, confianza, frases, etiqueta, varias): every segment of every document; ``etiqueta`` is the label's code."""
    docs = at_least_partitions(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cols: list[list] = [[] for _ in OUT.names]
            texts = part.column(1).to_pylist()
            for d, found, label in zip(part.column(0).to_pylist(), segments_of(model, texts), part.column(2).to_pylist()):
                for k, (x, conf, n) in enumerate(found):
                    for c, v in zip(cols, (d, k, x, conf, n, label_code(label), len(found) > 1)):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], OUT.names)

    return docs.mapInArrow(run, OUT)


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document with language and confidence."""
    documents = table(spark, sf_dir, "documents")
    return identify(documents, Discriminator().fit(*training_sample(documents)))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of mixed documents, and the language of each document whose label is missing or wrong."""
    s = p10_segments(spark, sf_dir)
    wrong = F.col("etiqueta").isNull() | (F.col("etiqueta") != F.col("idioma"))
    return s.filter(F.col("varias") | wrong).select("doc_id", "orden", "idioma")
