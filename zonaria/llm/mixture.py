"""Mixing sources to target shares of tokens, with a cap on how often a source may be repeated."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonaria.session import materialise

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_SOURCES = 10_000  #: rows of the target table, which the driver holds and broadcasts

_encoders: dict[int, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabularies lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(raw: bytes):
    """The byte-level BPE of a rank file, built once per process."""
    key = hash(raw)
    if key not in _encoders:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


# A run of white space this long exhausts the tokenizer's regex engine.
LONG_SPACE = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def count_tokens(text: str, enc) -> int:
    """Tokens of a whole text.

    The pattern makes a long run of white space one piece, but for its last
    character where more text follows; such runs are taken out and encoded as
    that piece, which gives the same tokens.
    """
    n, at = 0, 0
    for m in LONG_SPACE.finditer(text):
        n += len(enc.encode_ordinary(text[at : m.start()]))
        at = m.end() - (m.end() < len(text))
        n += len(enc._encode_single_piece(text[m.start() : at]))
    return n + len(enc.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, n_tokens): tokens of every whole text; null and empty texts have none.  Narrow."""
    raw = docs.sparkSession.sparkContext.broadcast(Path(path or vocabulary_path()).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for b in batches:
            n = pa.array([count_tokens(t, enc) if t else 0 for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=[key, source, "n_tokens"])

    kinds = dict(docs.dtypes)
    return docs.select(key, source, text).mapInArrow(run, f"`{key}` {kinds[key]}, `{source}` {kinds[source]}, n_tokens bigint")


@dataclass(frozen=True)
class Share:
    source: str
    weight: float
    cap: int
    tokens: int
    rate: float


def rates(available: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Share]:
    """How often each source is taken.

    The mix has ``total`` tokens, by default as many as the named sources hold.
    A source gets its weight's part of them, at most its tokens times its cap;
    what a capped source leaves over goes to the others in proportion to their
    weights, so that their shares stay in the target ratio.  If all are capped
    the mix is smaller.  Sources without tokens, weight or cap get nothing.
    """
    live = {s: (w, min(c, 1 << 30) * available.get(s, 0)) for s, w, c in targets if w and w > 0 and c and c > 0 and available.get(s, 0) > 0}
    want = float(sum(available.get(s, 0) for s, _, _ in targets) if total is None else total)
    part: dict[str, float] = {}
    left = dict(live)
    while left:
        weight = sum(w for w, _ in left.values())
        room = want - sum(part.values())
        full = [s for s, (w, most) in left.items() if room * w / weight >= most]
        if not full:
            part |= {s: room * w / weight for s, (w, _) in left.items()}
            break
        for s in full:
            part[s] = float(left.pop(s)[1])
    return [Share(s, w, c, available.get(s, 0), part.get(s, 0.0) / available[s] if part.get(s) else 0.0) for s, w, c in targets]


def uncapped_total(available: dict[str, int], targets: list[tuple[str, float, int]]) -> float:
    """The largest mix in which every source that has tokens still reaches its weight's part; 0 without sources.

    One tiny source bounds it, which is why it is no default: ``rates`` keeps the
    size of the corpus and lets that source stay below its share.
    """
    live = [(w, min(c, 1 << 30) * available.get(s, 0)) for s, w, c in targets if w and w > 0 and c and c > 0 and available.get(s, 0) > 0]
    weight = sum(w for w, _ in live)
    return min((most * weight / w for w, most in live), default=0.0)


def plan(counts: DataFrame, targets: DataFrame, source: str = "source", total: float | str | None = None) -> list[Share]:
    """The rates from token counts and (source, peso_objetivo, tope_repeticion); a source named twice takes its first row by weight.

    ``total`` is the number of tokens of the mix: None for as many as the named
    sources hold, "exact" for the largest mix that no cap keeps from its shares.
    """
    t = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("peso_objetivo", "tope_repeticion")).alias("t")).select("source", "t.*")
    rows = t.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the target table")
    named = [r["source"] for r in rows]
    sums = counts.filter(F.col(source).isin(named)).groupBy(source).agg(F.sum("n_tokens").alias("n")).collect() if named else []
    have, goal = {r[source]: r["n"] for r in sums}, [(r["source"], r["peso_objetivo"], r["tope_repeticion"]) for r in rows]
    return rates(have, goal, uncapped_total(have, goal) if total == "exact" else total)


def copies(key: str, rate: Column, seed: int) -> Column:
    """floor(rate), and one more with the probability of the fraction, drawn by a hash of the key."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) / float(1 << 52)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def _rated(df: DataFrame, shares: list[Share], source: str) -> DataFrame:
    table = df.sparkSession.createDataFrame([(s.source, s.rate) for s in shares], "_s string, tasa double")
    return df.join(F.broadcast(table), F.col(source) == F.col("_s")).drop("_s")


def mix(docs: DataFrame, shares: list[Share], key: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """``docs`` with ``copia`` = 1, 2, ...: each document as often as it is in the mix.

    Narrow: the rates are broadcast (at most MAX_SOURCES rows) and each row
    decides for itself, so no source, however large, is moved.  Rows without
    source or of a source without target are not in the mix.  A column of the
    documents that is called ``copia`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "copia"]
    rows = docs.select(F.struct(*kept).alias("fila"), F.col(source).alias("fuente"), F.col(key).alias("clave"))
    d = _rated(rows, shares, "fuente").withColumn("veces", copies("clave", F.col("tasa"), seed)).filter("veces > 0")
    return d.select("fila.*", F.explode(F.sequence(F.lit(1), F.col("veces"))).alias("copia"))


def reached(counts: DataFrame, shares: list[Share], key: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """(source, peso_objetivo, tope_repeticion, tokens, tasa, tokens_mezcla, proporcion): the shares really reached, one row per target."""
    spark = counts.sparkSession
    given = spark.createDataFrame([(s.source, s.weight, s.cap, s.tokens, s.rate) for s in shares], "source string, peso_objetivo double, tope_repeticion int, tokens bigint, tasa double")
    took = _rated(counts, shares, source).groupBy(F.col(source).alias("source")).agg(F.sum(F.col("n_tokens") * copies(key, F.col("tasa"), seed)).alias("tokens_mezcla"))
    d = materialise(given.join(took, "source", "left").withColumn("tokens_mezcla", F.coalesce("tokens_mezcla", F.lit(0))))
    whole = d.agg(F.sum("tokens_mezcla")).first()[0]
    return d.withColumn("proporcion", F.col("tokens_mezcla") / F.lit(whole) if whole else F.lit(0.0))


def mixed(docs: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 1, total: float | str | None = None) -> DataFrame:
    """The mix of ``docs`` for the target table (``total`` as in plan)."""
    return mix(docs, plan(token_counts(docs, path), targets, total=total), seed=seed)


def shares_reached(docs: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 1) -> DataFrame:
    """The shares of the mix (see reached), and as tokens_exactos and proporcion_exacta those of the "exact" one."""
    counts = materialise(token_counts(docs, path))
    exact = reached(counts, plan(counts, targets, total="exact"), seed=seed)
    exact = exact.select("source", F.col("tokens_mezcla").alias("tokens_exactos"), F.col("proporcion").alias("proporcion_exacta"))
    return reached(counts, plan(counts, targets), seed=seed).join(exact, "source")
