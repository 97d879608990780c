"""Evaluation texts leaking into a corpus, found with a generalised suffix automaton of the test items."""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.session import materialise

WORD = re.compile(r"\\[^\W\d_]+|([^\W_]+)")
LENGTH = 12  #: consecutive words in common that make a leak
BLOCK_WORDS = 200_000  #: words of test items per automaton; more items take one more reading of the corpus for each
COVER = 0.5  #: share of a document's words in leaked passages from which the whole document goes


def words(text: str | None) -> list[str]:
    """Runs of letters or digits in lower case, without command names."""
    return [w for w in WORD.findall((text or "").lower()) if w]


class Automaton:
    """A generalised suffix automaton over the words of many texts.

    Its states are the distinct sets of end positions of word sequences, so the
    longest sequence of a stream that occurs in any text is tracked with one
    step per word.  ``owner`` names, for a state whose sequences have at least
    ``length`` words, the state of its suffix of just that length, and
    ``items`` the texts that state occurs in.
    """

    def __init__(self, texts: Iterable[tuple[int, list[str]]], length: int = LENGTH):
        self.length = length
        self.vocabulary: dict[str, int] = {}
        self.link, self.size = array("q", [-1]), array("q", [0])
        self.next: dict[int, int] = {}  # state << 32 | word -> state
        self._copies: list[list[int]] = [[]]
        ends: dict[int, set[int]] = {}
        for ident, seq in texts:
            last = 0
            for w in seq:
                last = self._add(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.setdefault(last, set()).add(ident)
        self._finish(ends)

    def _state(self, size: int, link: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self._copies.append([])
        return len(self.size) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.size[p] + 1, self.link[q])
        for w in self._copies[q]:
            self._go(new, w, self.next[q << 32 | w])
        self.link[q] = new
        while p >= 0 and self.next.get(p << 32 | c) == q:
            self.next[p << 32 | c] = new
            p = self.link[p]
        return new

    def _go(self, a: int, c: int, b: int) -> None:
        if a << 32 | c not in self.next:
            self._copies[a].append(c)
        self.next[a << 32 | c] = b

    def _add(self, last: int, c: int) -> int:
        q = self.next.get(last << 32 | c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, c)
        new = self._state(self.size[last] + 1, 0)
        p = last
        while p >= 0 and p << 32 | c not in self.next:
            self._go(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.next[p << 32 | c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, c)
        return new

    def _finish(self, ends: dict[int, set[int]]) -> None:
        n = len(self.size)
        self._copies = []
        by_size = sorted(range(1, n), key=self.size.__getitem__)
        for s in reversed(by_size):
            up = self.link[s]
            if self.size[up] >= self.length and s in ends:
                ends.setdefault(up, set()).update(ends[s])
        self.owner = array("q", [-1]) * n
        self.items: dict[int, tuple[int, ...]] = {}
        for s in by_size:
            if self.size[s] >= self.length:
                up = self.link[s]
                self.owner[s] = self.owner[up] if self.size[up] >= self.length else s
                if self.owner[s] == s:
                    self.items[s] = tuple(sorted(ends.get(s, ())))

    def positions(self, stream: list[str]) -> Iterator[tuple[int, int, int]]:
        """(index, longest match, owner state) at each word that ends a match of at least ``length`` words."""
        step, link, size, owner, least = self.next.get, self.link, self.size, self.owner, self.length
        at = m = 0
        for i, c in enumerate(map(self.vocabulary.get, stream)):
            if c is None:
                at = m = 0
                continue
            to = step(at << 32 | c)
            while to is None and at:
                at = link[at]
                m = size[at]
                to = step(at << 32 | c)
            if to is None:
                continue
            at = to
            m += 1
            if m >= least:
                yield i, m, owner[at]

    def leaks(self, stream: list[str]) -> tuple[dict[int, list[int]], list[tuple[int, int]]]:
        """({item: [windows, words of its longest stretch]}, [(first word, last word) of each leaked span])."""
        found: dict[int, list[int]] = {}
        spans: list[tuple[int, int]] = []
        for i, m, state in self.positions(stream):
            a = i - m + 1
            if spans and a <= spans[-1][1] + 1:
                spans[-1] = (min(a, spans[-1][0]), i)
            else:
                spans.append((a, i))
            for ident in self.items[state]:
                f = found.setdefault(ident, [0, 0, -2, 0])
                f[0] += 1
                f[3] = f[3] + 1 if f[2] == i - 1 else self.length
                f[1], f[2] = max(f[1], f[3]), i
        return {k: v[:2] for k, v in found.items()}, spans


def blocks(items: DataFrame, ident: str, text: str, length: int = LENGTH) -> Iterator[list[tuple[int, list[str]]]]:
    """The test items in blocks of at most BLOCK_WORDS words (or one item), read one partition at a time."""
    block, n = [], 0
    for r in items.select(ident, text).filter(F.col(ident).isNotNull()).toLocalIterator():
        w = words(r[text])
        if len(w) < length:
            continue
        if block and n + len(w) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((r[ident], w))
        n += len(w)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", ident: str = "item_id", item_text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, item_id, ventanas, tramo): each document and each item it has ``length`` or more consecutive words of.

    ventanas counts the document's word positions that end such a passage,
    tramo the words of the longest stretch of them.  Items and texts that are
    null or shorter match nothing; a repeated item matches under each of its
    ids.  The corpus streams through the automaton of a block of items, which
    is broadcast and of bounded size; no text is shuffled.  More than
    BLOCK_WORDS words of items run at once, block by block (see _passes).
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    schema = f"`{key}` {kinds[key]}, item_id bigint, ventanas int, tramo int"

    def over(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = shared.value
            for b in batches:
                rows = [(k, i, *f) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, f in a.leaks(words(t))[0].items()]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = (b.schema.types[0], pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "item_id", "ventanas", "tramo"])

        return docs.select(key, text).mapInArrow(run, schema)

    out = None
    for d in _passes(spark, blocks(items, ident, item_text, length), length, over):
        out = d if out is None else out.unionByName(d)
    return spark.createDataFrame([], schema) if out is None else out


def _passes(spark: SparkSession, parts: Iterator[list[tuple[int, list[str]]]], length: int, over: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """The result of ``over`` for each block of items.

    One block stays a plan.  Of several, each is built, run over the corpus and
    written before the next is built, so the driver holds one automaton however
    many there are, and the corpus is read once per block.
    """
    block, after = next(parts, None), next(parts, None)
    if block is not None and after is None:
        yield over(spark.sparkContext.broadcast(Automaton(block, length)))
        return
    while block is not None:
        shared = spark.sparkContext.broadcast(Automaton(block, length))
        yield materialise(over(shared))
        shared.destroy()
        block, after = after, next(parts, None)


def leaked_spans(text: str, a: Automaton) -> list[tuple[int, int]]:
    """(first word, last word) of each leaked passage of a text."""
    low = [m[1].lower() for m in WORD.finditer(text) if m[1]]
    if any(not w.isalnum() for w in low):  # a letter whose lower case isn't one word: keep positions by the original
        low = [words(w)[0] if words(w) else w for w in low]
    return a.leaks(low)[1]


def without_spans(text: str, spans: Sequence[tuple[int, int]], cover: float = COVER) -> str | None:
    """The text without the passages, which may overlap; None when they make up more than ``cover`` of its words."""
    if not spans:
        return text
    at = [(m.start(), m.end()) for m in WORD.finditer(text) if m[1]]
    joined: list[list[int]] = []
    for i, j in sorted(spans):
        if joined and i <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], j)
        else:
            joined.append([i, j])
    if sum(j - i + 1 for i, j in joined) > cover * len(at):
        return None
    out, last = [], 0
    for i, j in joined:
        out.append(text[last : at[i][0]])
        last = at[j][1]
    return "".join([*out, text[last:]])


TRAMOS = pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())]))


def cleaned(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", ident: str = "item_id", item_text: str = "text", cover: float = COVER) -> DataFrame:
    """``docs`` with the leaked passages cut out of the text and the documents that are mostly leaks left out.

    Passages of all blocks of items are found in the original text and united
    before anything is cut or left out, so the result doesn't depend on the
    number of blocks.  Null texts stay.  Rows are told apart by key and a hash
    of the text; with one block nothing is shuffled.
    """
    spark = docs.sparkSession
    at, schema = docs.columns.index(text), docs.schema
    parts = blocks(items, ident, item_text)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return docs

    def cut(b: pa.RecordBatch, spans: Callable[[int, str], list[tuple[int, int]]]) -> pa.RecordBatch:
        """The batch without what ``spans`` finds in the text of each row; columns after those of ``docs`` fall away."""
        old = b.column(at).to_pylist()
        new = [None if t is None else without_spans(t, spans(k, t), cover) for k, t in enumerate(old)]
        keep = pa.array([t is not None or o is None for t, o in zip(new, old, strict=True)])
        kept = [pa.array(new, b.schema.types[at]) if k == at else b.column(k) for k in range(len(schema))]
        return pa.RecordBatch.from_arrays(kept, names=b.schema.names[: len(schema)]).filter(keep)

    if second is None:
        shared = spark.sparkContext.broadcast(Automaton(first))
        return docs.mapInArrow(lambda it: (cut(b, lambda _, t: leaked_spans(t, shared.value)) for b in it), schema)

    def over(block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [leaked_spans(t, block.value) if t is not None else [] for t in b.column(2).to_pylist()]
                tramos = pa.array([[{"i": i, "j": j} for i, j in g] for g in got], TRAMOS)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), tramos], names=["_k", "_x", "_t"]).filter(pa.array([bool(g) for g in got]))

        return docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_x"), text).mapInArrow(run, f"_k {dict(docs.dtypes)[key]}, _x bigint, _t array<struct<i: bigint, j: bigint>>")

    found = None
    for d in _passes(spark, itertools.chain((first, second), parts), LENGTH, over):
        found = d if found is None else found.unionByName(d)
    found = materialise(found.groupBy("_k", "_x").agg(F.flatten(F.collect_list("_t")).alias("_t")))
    d = docs.alias("d").join(found.alias("f"), F.col(f"d.`{key}`").eqNullSafe(F.col("f._k")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("f._x")), "left").select("d.*", "f._t")
    last = len(schema)
    return d.mapInArrow(lambda it: (cut(b, lambda k, _, c=b.column(last): [(x["i"], x["j"]) for x in c[k].as_py() or ()]) for b in it), schema)
