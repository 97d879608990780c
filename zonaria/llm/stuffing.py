"""Keyword-stuffed pages, link lists and product tags: bagged decision trees over content and link features.

Two views of a page are kept apart.  The *features* are counts over its words,
links and marks; they know nothing of what a line is.  The *units* (lines,
sentences, list entries) are prose, formula, table, reference, link entry, tag
list or repeated keywords, and the share of words in spam units gives the weak
label.  Trees learn the labels of a bounded sample from the features alone,
score every page, and the score is smoothed by the spam rate of the page's
host.  The pages that the smoothed score names are then counted exactly.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonaria.session import materialise

# Function words of English, Spanish and French, one line per language.
FUNCTION_WORDS = frozenset(
    """
    the a an of and or is are was were be been that this these those which who whose to in on for with by as at from it its we our not no than then if when but both neither nor each every any some has have had may can will only there here how so such into over under after before because since although yet while very more most
    el la los las un una unos unas de del y o es son era fue ser que este esta estos estas cuyo a en con por para como al su sus no ni si cuando pero cada todo toda algún ningún hay ha han se lo más muy sin sobre entre desde hasta aunque dado solo tanto también según donde
    le les une des du et ou est sont était que qui dont ce cette ces en dans avec par pour comme au aux sur il elle nous notre non ne pas ni si quand mais chaque tout toute plus très sans entre dès jusque bien puisque alors lorsque aucun seul leur
    """.split()
)
WORD = re.compile(r"\\[^\W\d_]+|([^\W_]+)")
LINK = re.compile(r"\\url\s*\{|\\href\s*\{|https?://|(?<![^\W_])www\.")
ADDRESS = re.compile(r"(?:https?://|(?<![^\W_])www\.)[^\s{}]*")
TAG = re.compile(r"\\?#[^\W_]")
CODE = re.compile(r"(?<![^\W_])[A-Z]{2,5}-?\d{3,}(?![^\W_])")
SENTENCE = re.compile(r"(?<=[.!?;])\s+")
BEGIN = re.compile(r"\\begin\{(equation|align|eqnarray|gather|multline|displaymath)\*?\}")
BODY = re.compile(r"\\begin\s*\{document\}")
END = re.compile(r"\\end\s*\{document\}")
STOP = re.compile(r"[.!?](?:\s|$)")

FEATURES = (
    "funcion", "tramo_corto", "tramo_largo", "pares", "distintas", "compresion", "enlaces", "direccion", "etiquetas",
    "codigos", "columnas", "formulas", "citas", "cifras", "frases", "letras", "palabras",
)
SAMPLE = 20_000  #: pages the trees are trained on: about as many, picked by a hash of the key
TREES, DEPTH, LEAST = 25, 6, 3
BLENDS = 0.25  #: blended rows per sampled page
HOST_PRIOR = 20.0  #: pages with the overall rate that every host is given
HOST_LIMIT = 2.0  #: largest change of a page's log odds by its host
CANDIDATE = 0.1  #: smoothed score from which a page is counted exactly
ODDS = 6.0  #: log odds of a page lie between -ODDS and ODDS
REPEATS = 3  #: times a word pair must occur on a page to count as repeated


def body(text: str) -> str:
    """What lies between the document's begin and end, or all of a fragment."""
    b = BODY.search(text)
    e = None
    for e in END.finditer(text, b.end() if b else 0):
        break
    return text[b.end() if b else 0 : e.start() if e else len(text)]


def _words(s: str) -> list[str]:
    return [w for w in WORD.findall(s) if w]


def _without_math(s: str) -> str:
    """The text outside pairs of dollar signs; what follows a lone one is text."""
    parts = s.split("$")
    return " ".join(parts[::2] if len(parts) % 2 else [*parts[:-1:2], parts[-1]])


def units(page: str) -> Iterator[tuple[str, list[str]]]:
    """(kind, words) of each unit; kind ``sin`` is a sentence or list entry without function words."""
    inside = ""
    for line, low in zip(page.split("\n"), page.lower().split("\n"), strict=True):
        low = low.strip().lstrip("%")
        if not low:
            continue
        if inside:
            if "\\end{" + inside in line:
                inside = ""
            yield "formula", _words(low)
            continue
        if "\\begin{" in line and (m := BEGIN.search(line)):
            if "\\end{" + m[1] not in line:
                inside = m[1]
            yield "formula", _words(low)
            continue
        linked = ("url" in low or "href" in low or "http" in low or "www." in low) and LINK.search(line)
        tags = len(TAG.findall(line)) if "#" in line else 0
        row = "&" in line and ("\\\\" in line or line.count("&") > 1)
        cited = "\\bibitem" in low
        if linked or tags or row or cited:
            words = _words(low)
            known = sum(map(FUNCTION_WORDS.__contains__, _words(ADDRESS.sub(" ", low)) if linked else words))
            if linked and known * 8 <= len(words):
                yield "enlace", words
                continue
            if tags and (tags * 6 >= len(words) or CODE.search(line)):
                yield "etiqueta", words
                continue
            if cited:
                yield "cita", words
                continue
            if row:
                yield ("etiqueta" if known == 0 and CODE.search(line) else "tabla"), words
                continue
        for s in SENTENCE.split(low):
            words = _words(_without_math(s)) if "$" in s else _words(s)
            if words:
                yield ("sin" if FUNCTION_WORDS.isdisjoint(words) else "prosa"), words


def spam_share(text: str | None) -> float:
    """The share of a page's words in spam units; 0 for a page without words.

    A unit without function words counts as keywords when at least a third of
    its word pairs occur REPEATS times among such units, else as prose (titles,
    names).
    """
    bare: list[list[str]] = []
    n = bad = 0
    for kind, words in units(body(text or "")):
        n += len(words)
        if kind == "sin":
            bare.append(words)
        elif kind in ("enlace", "etiqueta"):
            bad += len(words)
    pairs: Counter[tuple[str, str]] = Counter()
    for words in bare:
        pairs.update(zip(words, words[1:], strict=False))
    for words in bare:
        again = sum(pairs[p] >= REPEATS for p in zip(words, words[1:], strict=False))
        bad += len(words) if again and again * 3 >= len(words) - 1 else 0
    return bad / n if n else 0.0


def features(text: str | None) -> list[float]:
    """FEATURES of a page, none of them drawn from its units; a page without words has zeros."""
    page = body(text or "")
    words = _words(page.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    known = bytes(map(FUNCTION_WORDS.__contains__, words))
    runs = [len(r) for r in known.split(b"\x01")]
    pairs = Counter(zip(words, words[1:], strict=False))
    raw = page.encode("utf-8", "surrogatepass")
    linked = "http" in page or "www." in page or "\\url" in page or "\\href" in page
    return [
        known.count(1) / n,
        sum(r for r in runs if r >= 8) / n,
        sum(r for r in runs if r >= 20) / n,
        sum(v for v in pairs.values() if v >= REPEATS) / n,
        len(set(words)) / n,
        len(zlib.compress(raw, 1)) / len(raw),
        len(LINK.findall(page)) / n if linked else 0.0,
        len(_words(" ".join(ADDRESS.findall(page)))) / n if linked else 0.0,
        page.count("#") / n,
        len(CODE.findall(page)) / n,
        page.count("&") / n,
        page.count("$") / n,
        page.count("\\bibitem") / n,
        sum(map(str.isdigit, words)) / n,
        len(STOP.findall(page)) / n,
        sum(map(len, words)) / n,
        float(np.log1p(n)),
    ]


def weak_label(share: np.ndarray) -> np.ndarray:
    """1 where clearly more than half of the words are in spam units, 0 where clearly less, -1 between."""
    return np.where(share >= 0.55, 1, np.where(share <= 0.45, 0, -1))


def blended(x: np.ndarray, share: np.ndarray, n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and spam shares of ``n`` pages blended of a spam page and another one, in random parts.

    Features are means over words, so a page of two parts has about their
    weighted mean.  They fill the middle, where real pages are few.
    """
    spam, other = np.flatnonzero(share > 0.5), np.flatnonzero(share <= 0.5)
    if not len(spam) or not len(other):
        return x[:0], share[:0]
    rng = np.random.default_rng(seed)
    i, j, a = rng.choice(spam, n), rng.choice(other, n), rng.random(n)
    return a[:, None] * x[i] + (1 - a[:, None]) * x[j], a * share[i] + (1 - a) * share[j]


class Tree:
    """A binary classification tree (Gini) kept as arrays; thresholds lie midway between the values they part.

    Each split looks at a random half of the features, so that no single one
    decides in every tree.  A leaf's value is smoothed by half a page of either
    class.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, least: int = LEAST):
        self.rng = rng
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.value)
        for a in (self.feature, self.left, self.right):
            a.append(-1)
        self.cut.append(0.0)
        self.value.append(float((y.sum() + 0.5) / (len(y) + 1)))
        best = self._split(x, y, least) if depth and 0 < y.sum() < len(y) else None
        if best:
            k, cut = best
            go = x[:, k] <= cut
            self.feature[at], self.cut[at] = k, cut
            self.left[at] = self._grow(x[go], y[go], depth - 1, least)
            self.right[at] = self._grow(x[~go], y[~go], depth - 1, least)
        return at

    def _split(self, x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, float] | None:
        n, total, best, found = len(y), y.sum(), None, None
        count = np.arange(1, n)
        for k in sorted(self.rng.permutation(x.shape[1])[: -(-x.shape[1] // 2)]):
            o = np.argsort(x[:, k], kind="stable")
            v, ones = x[o, k], np.cumsum(y[o])[:-1]
            ok = (v[1:] > v[:-1]) & (count >= least) & (n - count >= least)
            if not ok.any():
                continue
            a, b = ones / count, (total - ones) / (n - count)
            gini = np.where(ok, count * a * (1 - a) + (n - count) * b * (1 - b), np.inf)
            i = int(gini.argmin())
            if best is None or gini[i] < best - 1e-12:
                best, found = gini[i], (int(k), float((v[i] + v[i + 1]) / 2))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(a) for a in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return np.array(self.value)[at]


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 7) -> tuple[list[Tree], np.ndarray]:
    """(trees, out-of-bag scores): each tree on a bootstrap sample; a row's score is that of the trees that did not see it.

    A row that every tree saw has NaN.
    """
    rng = np.random.default_rng(seed)
    model, total, seen = [], np.zeros(len(y)), np.zeros(len(y))
    for _ in range(trees if len(y) else 0):
        at = rng.integers(0, len(y), len(y))
        model.append(Tree(x[at], y[at], rng))
        out = np.setdiff1d(np.arange(len(y)), at)
        if len(out):
            total[out] += model[-1].score(x[out])
            seen[out] += 1
    return model, np.divide(total, seen, out=np.full(len(y), np.nan), where=seen > 0)


def host_weight(odds: np.ndarray, shift: np.ndarray, y: np.ndarray, rounds: int = 50) -> float:
    """How much of a host's shift of log odds is added to a page's: the weight from 0 to 1 of largest likelihood.

    Newton steps on a concave function of one variable; 0 where hosts tell nothing.
    """
    w = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(odds + w * shift)))
        slope, bend = float(((y - p) * shift).sum()), float((p * (1 - p) * shift**2).sum())
        if bend < 1e-12:
            break
        was, w = w, min(1.0, max(0.0, w + slope / bend))
        if abs(w - was) < 1e-9:
            break
    return w


def _odds(p: Column) -> Column:
    return F.greatest(F.lit(-ODDS), F.least(F.lit(ODDS), F.log(p / (1 - p))))


def _shift(sums: Column, count: Column, own: Column, overall: Column) -> Column:
    """Log odds of a host's rate, its page itself left out, against the rate of all pages, within HOST_LIMIT."""
    rate = (sums - own + HOST_PRIOR * overall) / (count - 1 + HOST_PRIOR)
    odds = lambda p: F.log((p + 1e-6) / (1 - p + 1e-6))
    return F.coalesce(F.greatest(F.lit(-HOST_LIMIT), F.least(F.lit(HOST_LIMIT), odds(rate) - odds(overall))), F.lit(0.0))


def sampled(docs: DataFrame, key: str, text: str, host: str, size: int = SAMPLE) -> DataFrame:
    """(_h, f, parte): features and spam share of about ``size`` whole pages, picked by a hash of the key."""
    n = docs.count()
    part = min(1.0, size / n) if n else 1.0
    picked = docs.select(F.col(key).alias("_k"), F.col(host).alias("_h"), F.col(text).alias("_t"))
    picked = picked.filter(F.pmod(F.xxhash64(F.lit("zonaria"), "_k"), F.lit(1 << 52)) < int(part * (1 << 52)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            f = pa.array([features(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), f, pa.array(map(spam_share, texts), pa.float64())], names=["_h", "f", "parte"])

    return picked.select("_h", "_t").mapInArrow(run, f"_h {dict(docs.dtypes)[host]}, f array<double>, parte double")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "coleccion") -> DataFrame:
    """(key, host, propio, anfitrion, puntaje, parte) of every page.

    propio is the trees' own score, anfitrion the spam rate of the host without
    the page, puntaje the smoothed score: the log odds of propio and the learned
    part of the host's shift.  Pages without host keep their own score.  parte
    is the exact share of words in spam units; null where even the largest shift
    leaves the score below CANDIDATE.  The texts are read twice, once for the
    sample (see SAMPLE) and once to score; every page is scored, on its whole text.
    """
    spark = docs.sparkSession
    sample = sorted(sampled(docs, key, text, host).collect(), key=lambda r: (r["parte"], r["f"], str(r["_h"])))
    x = np.array([r["f"] for r in sample], dtype=float).reshape(len(sample), len(FEATURES))
    share = np.array([r["parte"] for r in sample], dtype=float)
    more, more_share = blended(x, share, int(BLENDS * len(sample)))
    label = weak_label(np.concatenate([share, more_share]))
    clear = label >= 0
    model, bagged = train(np.vstack([x, more])[clear], label[clear].astype(float))
    floor = 1 / (1 + math.exp(HOST_LIMIT) * (1 - CANDIDATE) / CANDIDATE)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            f = np.array([features(t) for t in texts], dtype=float).reshape(b.num_rows, len(FEATURES))
            p = np.mean([t.score(f) for t in model], axis=0) if model else np.zeros(b.num_rows)
            parts = [spam_share(t) if q >= floor else None for t, q in zip(texts, p, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array(parts, pa.float64())], names=["_k", "_h", "p", "parte"])

    kinds = dict(docs.dtypes)
    pages = docs.select(F.col(key).alias("_k"), F.col(host).alias("_h"), F.col(text).alias("_t"))
    own = materialise(pages.mapInArrow(score, f"_k {kinds[key]}, _h {kinds[host]}, p double, parte double"))
    overall = F.lit(own.agg(F.avg("p")).first()[0] or 0.0)
    rates = materialise(own.filter(F.col("_h").isNotNull()).groupBy("_h").agg(F.sum("p").alias("sp"), F.count("*").alias("n")))
    shift = _shift(F.col("sp"), F.col("n"), F.col("p"), overall)

    hosts = [r["_h"] for r, c in zip(sample, clear, strict=False) if c]  # blended rows, at the end, have none
    seen = [(h, float(p), int(y)) for h, p, y in zip(hosts, bagged, label[clear], strict=False) if h is not None and math.isfinite(p)]
    learn = spark.createDataFrame(seen, f"_h {kinds[host]}, p double, y int").join(rates, "_h").select(_odds(F.col("p")).alias("o"), shift.alias("s"), "y").toPandas()
    weight = host_weight(*(learn[c].to_numpy(dtype=float) for c in ("o", "s", "y")))

    d = own.join(rates, "_h", "left")
    rate = F.coalesce((F.col("sp") - F.col("p") + HOST_PRIOR * overall) / (F.col("n") - 1 + HOST_PRIOR), overall)
    smooth = 1 / (1 + F.exp(-(_odds(F.col("p")) + weight * shift)))
    return d.select(F.col("_k").alias(key), F.col("_h").alias(host), F.col("p").alias("propio"), rate.alias("anfitrion"), smooth.alias("puntaje"), "parte")


def stuffed(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "coleccion") -> DataFrame:
    """(key): pages that the smoothed score names and more than half of whose words are in spam units.

    Null and empty texts have no words and are none.
    """
    return scores(docs, key, text, host).filter((F.col("puntaje") >= CANDIDATE) & (F.col("parte") > 0.5)).select(key)
