"""LM scoring by context-tree weighting, with a word unigram score as a base.

*Text.* A-Z lower-cased, words joined by blanks, one end: its bytes are modelled, its
words and the end are the base's tokens.
*Model.* A byte is eight binary decisions. Each decision has a tree of contexts, the
0 to ``DEPTH`` bytes before; a node's Krichevsky-Trofimov estimate of its decisions is
mixed half and half with the product of its children, all the way down, so every depth
has the weight that the corpus gave it. A context the corpus never had is left out of
the mix. The log probability of a text is the sum over its bytes; code length per
byte follows.

*Scale.* All that training gathers are counts of (DEPTH + 1)-byte grams and of words,
added up in each task and then by key. The trees are built where the grams with the
same two last context bytes meet; the two upper levels have at most 256 * 256 nodes.
Probabilities are made once for each distinct gram. Scoring streams through the texts
with frequent grams and words in memory; what a text has of others is summed by a join
with the full tables. Frequent words are those of at least one in ``share`` of all tokens:
there are at most ``share`` of them, and the part of the tokens they leave to the join is
alike at every size. Grams, whose number levels off, are the most frequent ``limit``.

Defined cases: null and empty texts are the end alone; a null doc_id is scored (and
learned from) as any other; rows of equal doc_id are rows of their own; an empty
training set leaves even odds for each bit; an empty table gives an empty result.
Words and grams are known by 64-bit hashes and by their own bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LAST, documents, ship, text_of, written
from .language_id import fold
from .order_minhash import mix64

#: Context bytes; a gram is these and the byte they foretell, at most eight bytes in all.
#: The README has the code length by depth: what deeper trees gain, and what their grams cost.
DEPTH = 6
END = b"\n"
#: Keys that wait to be counted, and different ones that a task keeps before it passes them on.
CHUNK, KEPT = 1 << 20, 4_000_000
RESIDENT = 2_000_000
SHARE = 1 << 21
_U = np.uint64


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def grams_of(words: list[bytes]) -> np.ndarray:
    """The gram ending at each byte, as a number; contexts before the first byte are ends."""
    text = END * DEPTH + b" ".join(words[:-1]) + END
    n = len(text) - DEPTH
    at = np.ndarray((n,), ">u8", text + bytes(8), 0, (1,)).astype(np.uint64)
    return at >> _U(64 - 8 * (DEPTH + 1))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


class Tally:
    """Training counts of 64-bit keys, 0 for those of other texts, in bounded memory: about ``most`` keys are kept."""

    def __init__(self, most: int = KEPT) -> None:
        self.most = most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # sorted, each more than twice as long as the next
        self.waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size = 0

    def add(self, keys: np.ndarray, train: bool = True) -> None:
        self.waiting[train].append(keys)
        self.size += len(keys)
        if self.size >= CHUNK:
            self.settle()

    def settle(self) -> None:
        for train, waiting in self.waiting.items():
            if waiting:
                keys = np.concatenate(waiting)
                waiting.clear()
                keys, n = np.unique(keys, return_counts=True)
                self.parts.append((keys, n if train else n * 0))
                del keys, n
                while len(self.parts) > 1 and len(self.parts[-2][0]) <= 2 * len(self.parts[-1][0]):
                    self.merge()
        self.size = 0

    def merge(self) -> None:
        """The last two parts become one."""
        (b, n), (a, m) = self.parts.pop(), self.parts.pop()
        at = np.searchsorted(a, b)
        new = (at == len(a)) | (a[np.minimum(at, len(a) - 1)] != b)  # no part is empty: a text has an end at least
        m[at[~new]] += n[~new]
        a = np.insert(a, at[new], b[new])
        self.parts.append((a, np.insert(m, at[new], n[new])))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.parts) > 1:
            self.merge()
        return self.parts[0]

    def full(self) -> bool:
        return sum(len(keys) for keys, _ in self.parts) >= self.most

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts in pieces; what is told is forgotten, and keys may be told again later."""
        self.settle()
        if self.parts:
            keys, n = self.total()
            self.parts = []
            for at in range(0, len(keys), 1 << 16):
                yield keys[at : at + (1 << 16)], n[at : at + (1 << 16)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies = {"gram": Tally(), "word": Tally()}

    def told(kind: str) -> Iterator[pa.RecordBatch]:
        for k, n in tallies[kind].drain():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(k)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    for b in batches:
        for text, train in zip(b.column("text"), b.column("train").to_pylist()):
            words = tokens_of(text.as_py())
            tallies["gram"].add(grams_of(words), train)
            if train:
                tallies["word"].add(hashes_of(words), True)
            for kind, t in tallies.items():
                if t.full():
                    yield from told(kind)
    for kind in tallies:
        yield from told(kind)


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln of the gamma function for z > 0: Stirling's series, eight further on."""
    shift = np.ones_like(z)
    for k in range(8):
        shift = shift * (z + k)
    x = z + 8
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


LN2 = np.log(2.0)


class Nodes:
    """The nodes of one depth: context and bits of the byte so far, with their counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        symbol = keys & _U(255)
        context = keys >> _U(8) & _U((1 << 8 * depth) - 1)
        self.at, ids, zeros, ones, base = [], [], [], [], 0
        for bit in range(8):  # the node of each gram at this decision
            k, at = np.unique(context << _U(8) | (_U(1 << bit) | symbol >> _U(8 - bit)), return_inverse=True)
            one = (symbol >> _U(7 - bit) & _U(1)).astype(bool)
            zeros.append(np.bincount(at, n * ~one, len(k)))
            ones.append(np.bincount(at, n * one, len(k)))
            ids.append(k)
            self.at.append(at + base)
            base += len(k)
        self.ids, self.n0, self.n1 = np.concatenate(ids), np.concatenate(zeros), np.concatenate(ones)
        self.log_own = log_kt(self.n0, self.n1)

    def stop(self, below: np.ndarray) -> np.ndarray:
        """Weighs own estimate against the product ``below``; returns ln of the mix and sets the weight of stopping."""
        mix = np.logaddexp(self.log_own, below) - LN2
        self.weight = np.exp(self.log_own - LN2 - mix)
        return mix


def trees(keys: np.ndarray, n: np.ndarray, upto: int) -> tuple[list[Nodes], np.ndarray]:
    """Nodes by depth from ``upto`` to DEPTH, and ln of the mix of the nodes at ``upto``."""
    levels = [Nodes(keys, n, d) for d in range(upto, DEPTH + 1)]
    mix = levels[-1].log_own
    levels[-1].weight = np.ones(len(mix))
    for own, child in zip(levels[-2::-1], levels[:0:-1]):
        below = np.zeros(len(own.ids))
        parent = np.empty(len(child.ids), np.int64)
        for a, c in zip(own.at, child.at):
            parent[c] = a
        below = np.bincount(parent, mix, len(own.ids))
        mix = own.stop(below)
    return levels, mix


#: Depth from which trees are built apart: grams are dealt by so many context bytes.
SPLIT = 2


def _uppers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("n", pa.int64())]))
    if t.num_rows:
        keys, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy().astype(float)
        levels, mix = trees(keys, n, SPLIT)
        own = levels[0]
        upper, at = np.unique(own.ids & _U((1 << 8 * SPLIT) - 1), return_inverse=True)
        sums = [np.bincount(at, x, len(upper)) for x in (own.n0, own.n1, mix)]
        yield pa.RecordBatch.from_arrays([pa.array(upper.view(np.int64)), *map(pa.array, sums)], ["node", "n0", "n1", "mix"])


class Top:
    """Depths 0 and 1 of all trees: counts and weights by node."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, mix: np.ndarray):
        self.n0, self.n1, self.weight = ([np.zeros(256), np.zeros(1 << 16)] for _ in range(3))
        below = np.zeros(1 << 16)
        self.n0[1][node], self.n1[1][node], below[node] = n0, n1, mix
        self.n0[0], self.n1[0] = (x.reshape(256, 256).sum(0) for x in (self.n0[1], self.n1[1]))
        for depth in (1, 0):
            own = log_kt(self.n0[depth], self.n1[depth])
            mix_ = np.logaddexp(own, below) - LN2
            self.weight[depth] = np.exp(own - LN2 - mix_)
            if depth:
                below = mix_.reshape(256, 256).sum(0)


def gram_scores(keys: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its others."""
    levels, _ = trees(keys, n, SPLIT)
    symbol, last = keys & _U(255), (keys >> _U(8) & _U(255)).astype(np.int64)
    out = np.zeros(len(keys))
    for bit in range(8):
        one = (symbol >> _U(7 - bit) & _U(1)).astype(bool)
        node = (_U(1 << bit) | symbol >> _U(8 - bit)).astype(np.int64)
        path = [(top.n0[0][node], top.n1[0][node], top.weight[0][node]), (top.n0[1][last << 8 | node], top.n1[1][last << 8 | node], top.weight[1][last << 8 | node])]
        path += [(lv.n0[lv.at[bit]], lv.n1[lv.at[bit]], lv.weight[lv.at[bit]]) for lv in levels]
        p, seen = None, None
        for n0, n1, w in reversed(path):
            kt = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
            p = kt if p is None else np.where(seen, w * kt + (1 - w) * p, kt)
            seen = n0 + n1 > 0
        out += np.log10(p)
    return out


class Table:
    """Values by 64-bit key, in open addressing; misses are told."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.6))))
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.full = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype), np.zeros(1 << bits, bool)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = ~self.full[slot]
            self.keys[slot[free]] = keys[todo[free]]
            self.full[slot[free]] = True
            set_ = free & (self.keys[slot] == keys[todo])
            self.values[slot[set_]] = values[todo[set_]]
            todo, slot = todo[~set_], (slot[~set_] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for misses) and which keys are there."""
        slot = self._slot(keys)
        here = (self.keys[slot] == keys) & self.full[slot]
        out = np.where(here, self.values[slot], self.values.dtype.type(0))
        todo = np.flatnonzero(~here & self.full[slot])
        while len(todo):
            s = slot[todo] = (slot[todo] + 1) & self.mask
            hit = (self.keys[s] == keys[todo]) & self.full[s]
            out[todo[hit]] = self.values[s[hit]]
            here[todo[hit]] = True
            todo = todo[~hit & self.full[s]]
        return out, here


def resident(table: DataFrame, value: str, limit: int) -> tuple[Table, bool]:
    """The most frequent keys' values, at most ``limit``, and whether that is all of them."""
    size = F.floor(F.log2(F.col("n") + 1) * 16).cast("int")
    steps = sorted(table.groupBy(size.alias("s")).count().collect(), reverse=True)
    kept, least = 0, None
    for s, count in steps:
        if kept + count > limit:
            break
        kept, least = kept + count, s
    got = table.filter(size >= (1 << 20 if least is None else least)).select("key", value).toArrow()
    return Table(got.column("key").to_numpy().view(np.uint64), got.column(value).to_numpy().astype(np.float32)), kept == sum(c for _, c in steps)


OUT = "doc_id long, dk long, th long, n_bytes long, n_tokens long, n_known long, base double, score double, words array<long>, grams array<long>"


def _scored(words_in: Callable[[], Table], grams_in: Callable[[], Table]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = words_in(), grams_in()
        for b in batches:
            rows: list[tuple] = []
            for text in b.column("text").to_pylist():
                own = tokens_of(text)
                h, g = hashes_of(own), grams_of(own)
                c, known = words.get(h)
                lp, there = grams.get(g)
                rows.append((len(g), len(h), int(known.sum()), float(np.log10(c[known] + 0.5).sum()), float(lp.astype(np.float64).sum()), h[~known].view(np.int64), g[~there].view(np.int64)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + [pa.array(list(c), t) for c, t in zip(cols, kinds)], [f.split(" ")[0] for f in OUT.split(", ")])

    return run


def _missing(rows: DataFrame, column: str) -> DataFrame:
    """(dk, th, key, n) of the items that were not resident; equal rows count once."""
    # identical rows have identical lists, of which one is enough
    one = rows.filter(F.size(column) > 0).groupBy("dk", "th").agg(F.first(column).alias("items"))
    items = one.select("dk", "th", F.explode("items").alias("key"))
    return items.groupBy("dk", "th", "key").agg(F.count(F.lit(1)).alias("n"))


def score_texts(docs: DataFrame, train: Column, limit: int = RESIDENT, share: int = SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of docs.

    ``train`` says which rows are learned from.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        docs["doc_id"].cast("long"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("dk"),
        F.xxhash64(text_of(docs)).alias("th"),
        text_of(docs).cast("binary").alias("text"),
        F.coalesce(train, F.lit(True)).alias("train"),
    )
    counts = rows.select("text", "train").mapInArrow(_counted, "kind string, key long, n long")
    counts = written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "kind")
    grams, vocabulary = (counts.filter(F.col("kind") == k).select("key", "n") for k in ("gram", "word"))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    dealt = grams.repartition(n, F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SPLIT) - 1)))
    upper = dealt.mapInArrow(_uppers, "node long, n0 double, n1 double, mix double").groupBy("node")
    upper = upper.agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "mix")]).toPandas()  # at most 256 * 255 rows
    top = spark.sparkContext.broadcast(Top(*(upper[c].to_numpy() for c in ("node", "n0", "n1", "mix"))))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("n", pa.int64())]))
        if t.num_rows:
            lp = gram_scores(t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy().astype(float), top.value)
            yield from pa.table({"key": t.column("key"), "n": t.column("n"), "lp": lp}).to_batches()

    made = written(dealt.mapInArrow(scores, "key long, n long, lp double"))
    frequent = vocabulary.filter(F.col("n") >= total / share).select("key", "n").toArrow()
    words_table = Table(frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_numpy())
    grams_table, all_grams = resident(made, "lp", limit)
    words_in, grams_in = spark.sparkContext.broadcast(words_table), spark.sparkContext.broadcast(grams_table)
    del words_table, grams_table
    out = rows.select("doc_id", "dk", "th", "text").mapInArrow(_scored(lambda: words_in.value, lambda: grams_in.value), OUT)
    out = written(out)
    # words that training never had are in no table; they are missing from any
    late = _missing(out, "words").join(vocabulary.withColumnRenamed("n", "c"), "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    late = late.groupBy("dk", "th").agg(F.sum(F.log10(F.col("c") + 0.5) * F.col("n")).alias("late_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("late_known"))
    out = out.join(late, ["dk", "th"], "left")
    if not all_grams:
        rest = _missing(out, "grams").join(made.select("key", "lp"), "key").groupBy("dk", "th").agg(F.sum(F.col("lp") * F.col("n")).alias("late_score"))
        out = out.join(rest, ["dk", "th"], "left")
    else:
        out = out.withColumn("late_score", F.lit(0.0))
    zero = F.lit(0)
    score = F.col("score") + F.coalesce("late_score", F.lit(0.0))
    base = F.col("base") + F.coalesce("late_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total)) + 0.5 * (distinct + 1))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("late_known", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), (-score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    out = score_texts(docs, ~F.coalesce(fold(docs["doc_id"], 5) == 1, F.lit(False)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
