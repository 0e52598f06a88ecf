"""Toxicity by a learned lexicon, matched by Levenshtein automata against a trie.

*Lexicon.* On a bounded sample of labelled rows, words and word beginnings are counted
by class. Those met almost only in toxic texts, in many texts and after many
different words (copies of one text meet theirs after the same word) make the lexicon.
*Matching.* The distinct tokens of a batch run through the trie of whole-word terms
together: a token's automaton state is its row of edit distances to the node's string,
and tokens leave a branch once their state exceeds the tolerance. Longer terms tolerate
more edits. Beginnings match exactly.
*Context.* Each match looks at a window of words around it, and whether quotation marks are
about it. Signs that stand near the lexicon's words in clean texts surely more often than in
toxic ones are learned from the sample with their log odds; they turn a match's weight down, so
quoting differs from abuse. A sample without clean texts that hold the words has no such signs.
*Score.* A logistic regression on the matches of a text, weighted back to the classes'
true shares, gives the probability of label 1.

Bounds: at most about ``rows_per_class`` labelled rows a class are fitted on, so what is
counted and collected of them is bounded too. The lexicon takes every term that passes, of any
length, unless ``terms`` is given. Scoring streams through all texts.

Defined cases: null and empty texts have no match and get the base score; labels other
than 0 and 1 are not learned from; a doc_id labelled twice, or a text labelled under several,
has its greatest label;
without labels of both classes all scores are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship, written
from .language_id import fold

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»„…–—¿¡"
QUOTES = "\"“”«»„‘’'`"
#: The sign that quotation marks stand about a match.
MARKS = '"'
#: Sample texts in which a sign must stand near a match before it counts.
SIGN_TEXTS = 5
BEGINNINGS = range(3, 9)
#: Words on each side of a match that are its context.
REACH = 6
#: Tokens remembered as looked up; beyond it the memory starts anew. It changes no result.
SEEN = 400_000
#: Characters of texts whose tokens are looked up together.
GROUP = 1 << 22


def tolerance(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


@dataclass
class Trie:
    """Whole-word terms by character."""

    next: dict[str, "Trie"] = field(default_factory=dict)
    term: int = -1
    reach: int = 0  # the greatest tolerance below

    @classmethod
    def of(cls, terms: list[str]) -> "Trie":
        root = cls()
        for i, t in enumerate(terms):
            node, k = root, tolerance(t)
            node.reach = max(node.reach, k)
            for c in t:
                node = node.next.setdefault(c, cls())
                node.reach = max(node.reach, k)
            node.term = i
        return root


#: The greatest tolerance; edits are counted up to one more.
MOST = 2


def automaton_matches(trie: Trie, terms: list[str], tokens: list[str]) -> dict[str, tuple[int, int]]:
    """token -> (nearest term, edits) for tokens within the tolerance of a term.

    A token's state is a band: the edits between the node's string, of i characters, and the
    token's first i - MOST to i + MOST characters. So memory grows with the tokens' number, not
    with their or the terms' length, and the walk keeps its own stack.
    """
    lengths = {n for t in terms for n in range(len(t) - tolerance(t), len(t) + tolerance(t) + 1)}
    tokens = [t for t in tokens if t and len(t) in lengths]  # no other is near a term
    if not tokens or not terms:
        return {}
    flat = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array(list(map(len, tokens)))
    starts = np.cumsum(lens) - lens
    found: dict[str, tuple[int, int]] = {}
    band = np.arange(-MOST, MOST + 1)[:, None]
    begin = np.where((band >= 0) & (band <= lens), band, MOST + 1).astype(np.int8)
    # what is put down is a child and its parent's state; the child's own is made when it is taken up
    stack = [(child, c, 1, np.arange(len(tokens)), begin) for c, child in trie.next.items()]
    while stack:
        node, c, depth, who, before = stack.pop()
        now = np.full_like(before, MOST + 1)
        for b in range(2 * MOST + 1):
            j = depth + b - MOST  # characters of the token
            if j < 0:
                continue
            own = now[b]
            if j:
                at = np.minimum(starts[who] + j - 1, flat.size - 1)
                np.minimum(own, before[b] + (flat[at] != ord(c)), out=own)
            if b < 2 * MOST:
                np.minimum(own, before[b + 1] + 1, out=own)
            if b and j:
                np.minimum(own, now[b - 1] + 1, out=own)
            own[lens[who] < j] = MOST + 1
        alive = now.min(axis=0) <= node.reach
        if not alive.any():
            continue
        who, now = who[alive], now[:, alive]
        if node.term >= 0:
            at = lens[who] - depth + MOST
            near = np.flatnonzero((at >= 0) & (at <= 2 * MOST))
            d = now[at[near], near]
            hit = d <= tolerance(terms[node.term])
            for x, edits in zip(near[hit].tolist(), d[hit].tolist()):
                t, new = tokens[who[x]], (edits, node.term)
                if t not in found or new < found[t][::-1]:
                    found[t] = new[::-1]
        stack.extend((child, k, depth + 1, who, now) for k, child in node.next.items())
    return found


class Matcher:
    """Finds lexicon matches in the words of texts, remembering tokens it has looked up."""

    def __init__(self, words: list[str], beginnings: list[str]):
        self.words, self.beginnings = words, {b: len(words) + i for i, b in enumerate(beginnings)}
        self.lengths = sorted({len(b) for b in beginnings})
        self.trie = Trie.of(words)
        self.seen: set[str] = set()
        self.known: dict[str, tuple[int, int]] = {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.seen) > SEEN:
            self.seen = set()
        new = tokens - self.seen
        self.seen |= new
        bare: dict[str, list[str]] = {}
        for raw in new:
            bare.setdefault(raw.strip(EDGES), []).append(raw)
        got = automaton_matches(self.trie, self.words, list(bare))
        for t, raws in bare.items():
            hit = got.get(t)
            if hit is None or hit[1]:
                for n in self.lengths:
                    if t[:n] in self.beginnings:
                        hit = (self.beginnings[t[:n]], 0)
            if hit is not None:
                for raw in raws:
                    self.known[raw] = hit

    def matches(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """For each text its words, lower-cased, and the places of matches."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < GROUP:
                group.append(texts[at].lower().split())
                size += len(texts[at])
                at += 1
            self.learn(set().union(*group))  # one walk of the trie for all their new tokens
            known = self.known
            for words in group:
                yield words, [i for i, w in enumerate(words) if w in known]


def signs(words: list[str], at: int) -> set[str]:
    """What stands around a match: the words of its window, and whether quotation marks are about it."""
    near = words[max(0, at - REACH) : at]
    after = words[at + 1 : at + 1 + REACH]
    own = words[at]
    out = {w.strip(EDGES) for w in near + after} - {""}
    opens = own[0] in QUOTES or any(w[0] in QUOTES for w in near)
    closes = own.rstrip(".,;:!?")[-1:] in tuple(QUOTES) or any(w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for w in after)
    return out | {MARKS} if opens and closes else out


@dataclass
class ToxicityModel:
    words: list[str]
    beginnings: list[str]
    weights: np.ndarray  # by term and number of edits
    logit: np.ndarray
    quoting: dict[str, float] = field(default_factory=dict)  # sign -> log odds that its match is not abuse

    def quotation(self, words: list[str], at: int) -> float:
        """0 (no sign of quoting) to 1, by the signs around a match."""
        if not self.quoting:
            return 0.0
        return 1 - math.exp(-sum(self.quoting.get(t, 0.0) for t in signs(words, at)))

    def matcher(self) -> Matcher:
        return Matcher(self.words, self.beginnings)

    def describe(self, words: list[str], places: list[int], known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, float]:
        """Features of a text's matches, and the share of them that is quoted."""
        if not places:
            return np.zeros(FEATURES), 0.0
        quoted = [self.quotation(words, i) for i in places]
        w = [self.weights[known[words[i]]] * (1 - q) for i, q in zip(places, quoted)]
        q = sum(quoted) / len(places)
        return np.array([max(w), math.log1p(max(0.0, sum(w))), math.log1p(len({known[words[i]][0] for i in places})), min(1.0, 20 * len(places) / len(words)), q]), q

    def score(self, f: np.ndarray) -> float:
        return 1 / (1 + math.exp(-float(np.clip(self.logit[0] + f @ self.logit[1:], -30, 30))))


FEATURES = 5


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            words = {w.strip(EDGES) for w in text.lower().split()}
            counts[toxic].update("=" + w for w in words if w)
            counts[toxic].update({w[:n] for w in words for n in BEGINNINGS if len(w) > n})
    for toxic, c in enumerate(counts):
        terms = list(c)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([c[t] for t in terms], pa.int64()), pa.array(np.full(len(terms), toxic, np.int32))], ["term", "n", "toxic"])


def _variety(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, begin, pairs = {t[1:] for t in terms if t[0] == "="}, {t for t in terms if t[0] != "="}, set()
        for b in batches:
            for text in b.column("text").to_pylist():
                before = ""
                for w in text.lower().split():
                    w = w.strip(EDGES)
                    if w in whole:
                        pairs.add(("=" + w, before))
                    for n in BEGINNINGS:
                        if len(w) > n and w[:n] in begin:
                            pairs.add((w[:n], before))
                    before = w
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["term", "before"])

    return run


def choose_terms(counts: list[tuple[str, int, int]], variety: dict[str, int], share: float, terms: int | None = None) -> tuple[list[str], list[str]]:
    """Whole words and beginnings. share: weight of a counted clean text against a toxic one."""
    good = {t: p for t, p, n in counts if p / (p + share * n) >= 0.8 and variety.get(t, 0) >= max(4, p**0.6)}
    bare = sorted((t.lstrip("="), t) for t in good)
    chosen: list[str] = []
    taken: set[str] = set()  # beginnings
    for t in sorted(good, key=lambda t: (-good[t], -len(t), t)):
        own = t.lstrip("=")
        # a beginning that a longer one or a whole word explains says less than that one does
        if t[0] != "=":
            at, explained = bisect_left(bare, (own, "")), False
            while at < len(bare) and bare[at][0].startswith(own):
                u = bare[at][1]
                if u != t and (len(bare[at][0]) > len(own) or u[0] == "=") and good[u] >= 0.93 * good[t]:
                    explained = True
                    break
                at += 1
            if explained:
                continue
        if any(own[:k] in taken for k in range(1, len(own))):
            continue
        chosen.append(t)
        if t[0] != "=":
            taken.add(own)
        if terms is not None and len(chosen) >= terms:
            break
    return [t[1:] for t in chosen if t[0] == "="], [t for t in chosen if t[0] != "="]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    b, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (w * (p - y)) + ridge @ b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000, terms: int | None = None) -> ToxicityModel:
    """Learns from about rows_per_class labelled documents of each class at most, by a hash of the doc_id."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(totals) != {0, 1}:
        return ToxicityModel([], [], np.zeros((1, 3)), np.array([-50.0, *[0.0] * FEATURES]))
    share = {c: min(1.0, rows_per_class / n) for c, n in totals.items()}
    u = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = known.filter(u < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).withColumnRenamed("doc_id", "_d")
    # bounded by the sample: about 2 * rows_per_class rows
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_d")).filter("text IS NOT NULL")
    rows = written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    n_toxic, n_clean = (rows.filter(F.col("toxic") == c).count() for c in (1, 0))
    counts = rows.mapInArrow(_count_terms, "term string, n long, toxic int").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n")
    )
    ratio = (totals[0] / max(1, n_clean)) / (totals[1] / max(1, n_toxic))
    likely = counts.filter((F.col("p") >= max(3, 0.004 * n_toxic)) & (F.col("p") >= 4 * ratio * F.col("n")))
    top = [(r["term"], r["p"], r["n"]) for r in likely.orderBy(F.desc("p"), "term").collect()]
    pairs = rows.filter("toxic = 1").mapInArrow(_variety([t for t, *_ in top]), "term string, before string")
    variety = {r["term"]: r["v"] for r in pairs.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("v")).collect()}
    words, beginnings = choose_terms(top, variety, ratio, terms)
    model = ToxicityModel(words, beginnings, np.ones((len(words) + len(beginnings), 3)), np.zeros(FEATURES + 1))
    # weights: log odds of a text by term and edits
    seen = rows.mapInArrow(_term_hits(model), "term int, edits int, toxic int, n long").groupBy("term", "edits", "toxic").agg(F.sum("n").alias("n")).collect()
    odds = np.zeros((len(model.weights), 3, 2))
    for r in seen:
        odds[r["term"], r["edits"], r["toxic"]] = r["n"]
    exact = np.log((odds[:, :1, 1] + 0.5) / (n_toxic + 1)) - np.log((odds[:, :1, 0] + 0.5) / (n_clean + 1))
    # misspellings fall back on the exact term's weight, less a half an edit, until they have been seen
    prior = np.array([[1.0, 0.5, 0.25]]) * exact
    seen_odds = np.log((odds[:, :, 1] + 0.5) / (n_toxic + 1)) - np.log((odds[:, :, 0] + 0.5) / (n_clean + 1))
    n = odds.sum(2)
    model.weights = np.maximum(0.0, (n * seen_odds + 5 * prior) / (n + 5)) / 3
    model.weights[:, 0] = np.maximum(0.0, exact[:, 0]) / 3
    model.quoting = _quoting(rows, model)
    got = rows.mapInArrow(_described(model), "f binary, toxic int").toPandas().sort_values(["toxic", "f"], ignore_index=True)
    x = np.frombuffer(b"".join(got["f"]), np.float64).reshape(-1, FEATURES)
    y = got["toxic"].to_numpy(float)
    model.logit = _logistic(x, y, np.where(y == 1, 1.0, ratio))
    return model


def _quoting(rows: DataFrame, model: ToxicityModel) -> dict[str, float]:
    """Signs of quoting: the least log odds, at 1.64 standard errors, of clean against toxic texts with a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = model.matcher(), Counter()
        for b in batches:
            for (words, places), toxic in zip(m.matches(b.column("text").to_pylist()), b.column("toxic").to_pylist()):
                counts.update((t, toxic) for t in {"", *(t for i in places for t in signs(words, i))} if places)
        cols = list(zip(*[(*k, n) for k, n in counts.items()])) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.int64()])], ["sign", "toxic", "n"])

    met = rows.mapInArrow(run, "sign string, toxic int, n long").groupBy("sign").agg(
        *[F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).alias(name) for c, name in ((1, "p"), (0, "q"))]
    )
    # the empty sign counts the texts that have a match at all
    every = met.filter("sign = ''").first()
    if every is None:
        return {}
    odds = F.log((F.col("q") + 0.5) / (every["q"] + 1)) - F.log((F.col("p") + 0.5) / (every["p"] + 1))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("q") + 0.5) + 1 / (F.col("p") + 0.5))
    found = met.filter((F.col("sign") != "") & (F.col("p") + F.col("q") >= SIGN_TEXTS)).select("sign", sure.alias("w")).filter("w > 0")
    return {r["sign"]: r["w"] for r in found.collect()}  # words of the sample


def _term_hits(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = model.matcher(), Counter()
        for b in batches:
            for (words, places), toxic in zip(m.matches(b.column("text").to_pylist()), b.column("toxic").to_pylist()):
                counts.update({(*m.known[words[i]], toxic) for i in places})
        cols = list(zip(*[(*k, n) for k, n in counts.items()])) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.int64()])], ["term", "edits", "toxic", "n"])

    return run


def _described(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            f = [model.describe(words, places, m.known)[0].astype(np.float64).tobytes() for words, places in m.matches(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), b.column("toxic")], ["f", "toxic"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, n_matches, quoted) of every row of docs."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        m = model.matcher()
        for b in batches:
            rows = []
            for words, places in m.matches([t or "" for t in b.column("text").to_pylist()]):
                f, q = model.describe(words, places, m.known)
                rows.append((model.score(f), len(places), q))
            score, n, q = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(q, pa.float64())], ["doc_id", "score", "n_matches", "quoted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, n_matches long, quoted double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_toxicity(docs, labels.filter(~held_out))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches", "quoted")
