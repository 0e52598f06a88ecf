"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one binary classifier per bit, ridge
regression on hashed byte n-grams of a text, predicts that bit of the codeword. A
text goes to the codeword of least loss, where the logistic loss of a bit counts
by the log odds that its classifier is right on rows it was not fitted on. If the
two best codewords are too near each other the text is flagged ambiguous; if even
the best is farther than any text of the rows not fitted on was from its own, with
``SLACK`` to spare, the text is flagged unlike them all.

Fitting uses at most about ``rows_per_language`` labelled rows of each language and
``rows`` of all, taken by a hash of the doc_id (all of them while there are fewer): a
documented bound. They come to the driver as sparse counts and are added up into the
normal equations block by block, so it holds two square matrices whatever the number of
languages. Predicting streams through all texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows
without a language are not learned from; with no labelled rows all is ``und``; rows of
equal doc_id are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_name, ship, text_of

DIMS = 2048
#: Rows added up at once in fitting.
BLOCK = 512
#: How much farther from its codeword a text may be than any labelled one was.
SLACK = 1.5
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Bytes turned into n-grams at once, which bounds memory for very long texts.
CHUNK = 1 << 20


def gram_counts(text: str) -> np.ndarray:
    """Hashed byte bigrams and trigrams of the lower-cased text, counted."""
    raw = b" " + text.lower().encode("utf-8", "replace") + b" "
    counts = np.zeros(DIMS, np.int64)
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:] if len(b) > 2 else two[:0]
        if len(b) == CHUNK + 2 and at + len(b) < len(raw):
            two = two[:-1]  # the last one is the next chunk's first
        for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
            counts += np.bincount((grams * np.uint32(salt) >> np.uint32(21)).astype(np.int64), minlength=DIMS)
    return counts


def features(text: str) -> np.ndarray:
    """Square roots of the shares of ``gram_counts``."""
    counts = gram_counts(text)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1, far from each other: all distinct splits up to 5 classes, else the best of seeded draws."""
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s] or [(1,) * n]
        return np.array(splits, np.int8).T
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, -1, 1).astype(np.int8)
        gram = bits - code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(gram, 2 * bits)
        if gram.min() > apart:
            best, apart = code, gram.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    margin: float = 0.1
    farthest: float = np.inf

    def decode(self, text: str | None) -> tuple[str, float, bool, bool]:
        """Language, score (share of the best codeword), whether it is ambiguous, whether it is unlike all."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, False, False
        loss = self.losses(features(text)[None])[0]
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmax(p))
        near = len(p) > 1 and p[best] - np.partition(p, -2)[-2] < self.margin
        return self.languages[best], float(p[best]), bool(near), bool(loss[best] > self.farthest)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.decode(text)[:3]

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each row's outputs at each codeword."""
        m = x @ self.weights[:-1] + self.weights[-1]
        return (np.logaddexp(0.0, -3.0 * self.code[None] * m[:, None]) * self.trust).sum(2)


class Equations:
    """Normal equations of ridge regression, added up block by block."""

    def __init__(self, bits: int):
        self.xx, self.xy = np.zeros((DIMS + 1, DIMS + 1)), np.zeros((DIMS + 1, bits))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        self.xx += x.T @ x
        self.xy += x.T @ y

    def solve(self, penalty: float) -> np.ndarray:
        """Consumes the equations."""
        self.xx[np.diag_indices_from(self.xx)] += penalty
        return np.linalg.solve(self.xx, self.xy).astype(np.float32)


def fit(names: list[str], blocks: Iterable[tuple[np.ndarray, list[str]]], penalty: float = 0.05) -> LanguageModel:
    """blocks: feature rows and their labels, of ``names``. Every fifth row is kept back to judge the classifiers by."""
    code = codewords(len(names)) if names else np.zeros((0, 0), np.int8)
    if not names:
        return LanguageModel([], code, np.zeros((DIMS + 1, 0), np.float32), np.zeros(0))
    place = {v: i for i, v in enumerate(names)}
    most, rest = Equations(code.shape[1]), Equations(code.shape[1])
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    for x, labels in blocks:
        which, held = np.array([place[v] for v in labels], int), (at + np.arange(len(x))) % 5 == 0
        at += len(x)
        y = code[which].astype(np.float32)
        most.add(x[~held], y[~held])
        rest.add(x[held], y[held])
        kept.append((x[held], which[held]))
    rest.xx += most.xx
    rest.xy += most.xy
    weights, trust, farthest = most.solve(penalty), np.ones(code.shape[1]), np.inf
    del most
    if at > 1:
        wrong = np.zeros(code.shape[1])
        for x, which in kept:
            wrong += ((x @ weights[:-1] + weights[-1] > 0) != (code[which] > 0)).sum(0)
        errors = (wrong + 1) / (sum(len(w) for _, w in kept) + 2)
        trust = np.log((1 - errors) / errors).clip(0.05)
        judge = LanguageModel(names, code, weights, trust)
        farthest = SLACK * max((float(judge.losses(x)[np.arange(len(x)), which].max()) for x, which in kept if len(x)), default=np.inf)
    return LanguageModel(names, code, rest.solve(penalty), trust, farthest=farthest)


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts as (place, count) pairs of what is there, which for most texts is little."""
    for b in batches:
        rows = [gram_counts(t) for t in b.column("text").to_pylist()]
        there = [np.flatnonzero(r) for r in rows]
        at = [t.astype("<u2").tobytes() for t in there]
        n = [np.minimum(r[t], 0xFFFFFFFF).astype("<u4").tobytes() for r, t in zip(rows, there)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "lang", "at", "n"])


def fit_languages(labelled: DataFrame, rows_per_language: int = 1500, rows: int = 20_000, penalty: float = 0.05) -> LanguageModel:
    """Fits on rows with a lang and a text: about rows_per_language of each and ``rows`` of all at most."""
    ship(labelled.sparkSession)
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "lang", "text")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return fit([], [], penalty)
    most = min(rows_per_language, rows / len(counts))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, most / r["count"])))])
    picked = known.filter(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    got = picked.mapInArrow(_featurised, "doc_id long, lang string, at binary, n binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("n", "ascending")])

    def blocks() -> Iterator[tuple[np.ndarray, list[str]]]:
        for b in got.to_batches(max_chunksize=BLOCK):
            x = np.zeros((b.num_rows, DIMS), np.float32)
            for row, at, n in zip(x, b.column("at").to_pylist(), b.column("n").to_pylist()):
                c = np.frombuffer(n, "<u4").astype(np.float64)
                row[np.frombuffer(at, "<u2")] = np.sqrt(c / max(1.0, c.sum()))
            yield x, b.column("lang").to_pylist()

    return fit(sorted(set(got.column("lang").to_pylist())), blocks(), penalty)


def predict_languages(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str, str] = ("lang_pred", "lang_score", "lang_ambiguous", "lang_unlike")) -> DataFrame:
    """docs plus the prediction in columns of these names, which docs must not have yet."""
    if set(names) & set(docs.columns):
        raise ValueError(f"docs already has one of the columns {names}")
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            out = [m.decode(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*b.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def accepted(docs: DataFrame, languages: set[str] | None = None, ambiguous: bool = True) -> DataFrame:
    """docs of a language that can be told.

    Rejected are texts without a letter, texts unlike every language learned and, if asked
    for, ambiguous ones and those of other ``languages``. Where no row has a language
    nothing can be told, and all texts with a letter stay.
    """
    model = fit_languages(docs)
    if not model.languages:
        return docs.filter(F.regexp_like(text_of(docs), F.lit(r"\p{L}")))
    pred, score, near, unlike = names = tuple(free_name(docs, f"lang_{c}") for c in ("pred", "score", "ambiguous", "unlike"))
    told = predict_languages(docs, model, names).filter((F.col(pred) != UNKNOWN) & ~F.col(unlike))
    if languages is not None:
        told = told.filter(F.col(pred).isin(*languages))
    if not ambiguous:
        told = told.filter(~F.col(near))
    return told.drop(*names)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_languages(docs.filter(~held_out))
    out = predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
