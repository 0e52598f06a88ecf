"""Exact substring dedup by suffix arrays.

Every byte inside a string of ``length`` bytes that starts somewhere else too, in the
same text or another, is marked.

*Anchors.* Of the ``GRAM``-byte grams in a window of ``length`` bytes, the one of least
hash is its anchor. Equal windows have equal anchors at equal places, so only windows
whose anchor's gram occurs twice can repeat; that filter is exact. The windows with
one anchor lie side by side: their bytes are a *context*. Equal contexts are carried
once, with their number.
*Shards.* Contexts are dealt out by their anchor's gram, so windows that are equal meet,
and cut into shards of about ``SHARD`` bytes at a change of gram; a gram of more has several. A shard is sorted by Larsson-Sadakane
refinement: ranks of ``h`` bytes give ranks of ``2 h``, and only suffixes not yet alone
in their group are sorted again. Kasai's pass gives common prefixes of neighbours, in
many lanes at once; runs of prefixes of at least ``length`` are the repeats.
*Merging.* Shards that share a gram are merged: windows alone in one are looked up in
the sorted windows of the others by binary search.

Scale: texts are shuffled once, on their document, and that exchange serves both for
cutting out contexts and for the result. What else moves are hashes and the distinct
contexts of repeated grams. Tasks grow in number with those contexts' bytes. The
distinct contexts of a single gram meet in one task, shard by shard.

Defined cases: null text is empty; texts shorter than ``length`` keep all; rows of equal
doc_id are rows of their own, and two equal rows repeat each other; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, documents, ship, text_of, written
from .order_minhash import mix64

GRAM = 64
SHARD = 4 << 20
#: Bytes of a text that anchors are looked for in at once.
SEGMENT = 1 << 22
#: Suffixes that are sorted again at once, which bounds memory.
SORTED = 1 << 19
#: Bytes of contexts a task is meant for.
TASK = 16 << 20
_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def _words(b: bytes | np.ndarray, n: int, order: str = "<") -> np.ndarray:
    """The 8-byte words at the first n places."""
    return np.ndarray((n,), f"{order}u8", b, 0, (1,)).astype(np.uint64)


def grams(b: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    h = mix64(_words(b, len(b) - 7))
    at = 8
    while at < GRAM:
        h = mix64(h[:-at] * _U(0x9E3779B97F4A7C15) + h[at:])
        at *= 2
    return h


def contexts(b: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(gram hash, first window start, number of windows) of each anchor of b."""
    width = length - GRAM + 1
    for base in range(0, len(b) - length + 1, SEGMENT):
        part = b[base : base + SEGMENT + length - 1]
        h = grams(part)
        starts = len(part) - length + 1
        v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(v) // width) * width, ~_U(0))
        padded[: len(v)] = v
        blocks = padded.reshape(-1, width)
        up = np.minimum.accumulate(blocks, axis=1).ravel()
        down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(down[:starts], up[width - 1 : width - 1 + starts]) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        n = np.diff(np.append(first, starts))
        yield from zip(h[anchor[first]].view(np.int64).tolist(), (first + base).tolist(), n.tolist())


def suffix_array(text: bytes, most: int = SORTED) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of text, by Larsson-Sadakane refinement of about ``most`` suffixes at once."""
    n = len(text)
    # seven bytes and, as shorter suffixes come first, how many of them the suffix has
    key = _words(text + bytes(8), n, ">")
    key &= ~_U(255)
    key |= _U(7)
    key[max(0, n - 7) :] += np.arange(min(n, 7), 0, -1, dtype=np.uint64) - _U(7)
    sa = np.argsort(key)
    key = key[sa]
    sa = sa.astype(np.int32)
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    rank = np.empty(n + 1, np.int32)
    group = np.arange(1, n + 1, dtype=np.int32)
    group *= new
    rank[sa] = np.maximum.accumulate(group, out=group)
    rank[n] = 0
    h = 7
    left = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    del group, new
    while len(left):
        rest, begin = [], 0
        while begin < len(left):
            # whole groups; ranks that earlier ones have refined in this round order the same suffixes further
            end = min(len(left), begin + most)
            if end < len(left):
                own = rank[sa[left[end - 1]]]
                ahead = np.flatnonzero(rank[sa[left[end : end + most]]] != own)
                while not len(ahead) and end < len(left):
                    end = min(len(left), end + most)
                    ahead = np.flatnonzero(rank[sa[left[end : end + most]]] != own)
                end += int(ahead[0]) if len(ahead) else 0
            part = left[begin:end]
            who = sa[part]
            packed = (rank[who].astype(np.uint64) << _U(32)) | rank[np.minimum(who + h, n)].astype(np.uint64)
            order = np.argsort(packed)
            who, packed = who[order], packed[order]
            del order
            sa[part] = who
            fresh = np.empty(len(part), bool)
            fresh[0] = True
            np.not_equal(packed[1:], packed[:-1], out=fresh[1:])
            rank[who] = part[np.maximum.accumulate(np.where(fresh, np.arange(len(part), dtype=np.int32), 0))] + 1
            rest.append(part[~(fresh & np.append(fresh[1:], True))])
            begin = end
        left = np.concatenate(rest)
        h *= 2
    rank -= 1
    return sa, rank[:n]


def kasai(text: bytes, sa: np.ndarray, rank: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix in sa with the one before, as far as ``most``; lanes of the text go in step."""
    n = len(text)
    lcp = np.zeros(n, np.int32)
    lanes = max(1, min(lanes, n // 64))
    words = np.frombuffer(text + bytes(16), np.uint8)
    eight = np.ndarray((n + 8,), "<u8", words, 0, (1,))
    at = np.linspace(0, n, lanes + 1).astype(np.int64)
    i, end = at[:-1].copy(), at[1:]
    match = np.zeros(lanes, np.int64)
    while n and len(i):
        r = rank[i]
        j = np.where(r > 0, sa[r - 1], n)
        match = np.where(r > 0, match, 0)
        a, b = np.minimum(i + match, n), np.minimum(j + match, n)
        x = eight[a] ^ eight[b]
        low = x & (~x + _U(1))
        same = np.where(x == 0, 8, np.bitwise_count(low - _U(1)).astype(np.int64) >> 3)
        room = np.minimum(n - np.maximum(a, b), most - match)
        same = np.minimum(same, room)
        match += np.maximum(same, 0)
        go_on = (same == 8) & (match < most)
        done = ~go_on
        lcp[r[done]] = match[done]
        i = i + done
        match = np.where(done, np.maximum(match - 1, 0), match)
        here = i < end
        if not here.all():
            i, end, match = i[here], end[here], match[here]
    return lcp


@dataclass
class Shard:
    """Sorted distinct windows of some contexts, with the number of their places."""

    text: bytes
    place: np.ndarray  # window starts, in order of their bytes
    kind: np.ndarray  # of each place, the number of its distinct window
    first: np.ndarray  # of each distinct window, a place
    total: np.ndarray  # of each distinct window, its places counted over equal contexts

    @classmethod
    def of(cls, texts: list[bytes], windows: list[int], times: list[int], length: int) -> "Shard":
        text = b"".join(texts)
        ends = np.cumsum(list(map(len, texts)))
        sa, rank = suffix_array(text)
        lcp = kasai(text, sa, rank, length)
        del rank
        # of each text, first the places that start a window and then its last bytes
        ways = np.array([(w, len(t) - w) for t, w in zip(texts, windows)], np.int64).reshape(-1)
        is_window = np.repeat(np.arange(len(ways)) % 2 == 0, ways)
        ok = is_window[sa]
        kind = np.cumsum(lcp < length, dtype=np.int32)[ok]
        place = sa[ok]
        del lcp, sa, ok, is_window
        at = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])[: len(kind)])
        kind = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(kind))))
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
        total = np.add.reduceat(np.array(times, np.int64)[owner[place]], at) if len(at) else np.zeros(0, np.int64)
        return cls(text, place, kind, place[at], total)

    def windows(self, which: np.ndarray, length: int) -> np.ndarray:
        """Rows of big-endian words of distinct windows; they compare as the bytes do."""
        b = np.frombuffer(self.text, np.uint8)
        rows = b[self.first[which][:, None] + np.arange(length)]
        rows = np.pad(rows, ((0, 0), (0, -length % 8)))
        return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)

    def holds(self, rows: np.ndarray, length: int) -> np.ndarray:
        """Which of the rows (of ``windows``) this shard has, by binary search."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.first))
        found = np.zeros(len(rows), bool)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            own = self.windows(mid, length)
            other = rows[todo]
            differ = own != other
            at = differ.argmax(axis=1)
            k = np.arange(len(todo))
            equal = ~differ[k, at]
            found[todo[equal]] = True
            less = own[k, at] < other[k, at]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[~equal & (lo[todo] < hi[todo])]
        return found


def merge(shards: list[Shard], length: int, rows: int = 20_000) -> list[np.ndarray]:
    """Of each shard, which distinct windows repeat, in it or across."""
    out = [s.total >= 2 for s in shards]
    for i, a in enumerate(shards):
        for j, b in enumerate(shards):
            if i != j:
                alone = np.flatnonzero(~out[i])
                for k in range(0, len(alone), rows):
                    part = alone[k : k + rows]
                    out[i][part] = b.holds(a.windows(part, length), length)
    return out


def repeats(keys: list[int], texts: list[bytes], windows: list[int], times: list[int], length: int, shard: int = SHARD) -> list[list[tuple[int, int]]]:
    """Of each context the ranges (first, last) of window starts that repeat; equal keys stand together."""
    runs: list[list[list[int]]] = []  # lists of shards that may share windows
    size = 0
    for i, t in enumerate(texts):
        same = i > 0 and keys[i] == keys[i - 1]
        if not runs or size >= shard and not same:
            runs.append([[]])
            size = 0
        elif size + len(t) > 2 * shard:
            runs[-1].append([])
            size = 0
        runs[-1][-1].append(i)
        size += len(t)
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    for groups in runs:
        shards = [Shard.of([texts[i] for i in g], [windows[i] for i in g], [times[i] for i in g], length) for g in groups]
        for g, s, again in zip(groups, shards, merge(shards, length)):
            marked = np.zeros(len(s.text) + 2, np.int8)
            marked[s.place[again[s.kind]] + 1] = 1
            step = np.diff(marked)
            first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
            ends = np.cumsum([len(texts[i]) for i in g])
            begins = np.concatenate([[0], ends[:-1]])
            # places of one context are never next to another's, whose last bytes start no window
            for o, a, z in zip(np.searchsorted(ends, first, side="right").tolist(), first.tolist(), last.tolist()):
                ranges[g[o]].append((a - int(begins[o]), z - int(begins[o])))
        del shards, s, again, marked  # before the next are sorted
    return ranges


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for dk, th, text in zip(b.column("dk").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist()):
                if len(text) < length:
                    continue
                for g, s, n in contexts(text, length):
                    d = np.frombuffer(xxhash.xxh3_128_digest(text[s : s + n + length - 1]), "<i8")
                    for c, x in zip(cols, (g, int(d[0]), int(d[1]), dk, th, s, n)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["g", "c1", "c2", "dk", "th", "s", "n"])

    return run


def _cut(length: int):
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["g", "c1", "c2", "m", "n", "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for text, own in zip(b.column("text"), b.column("own")):
                text = text.as_py()
                for o in own.as_py():
                    out.append((o["g"], o["c1"], o["c2"], o["m"], o["n"], text[o["s"] : o["s"] + o["n"] + length - 1]))
                    size += len(out[-1][-1])
                if size > SHARD:
                    yield batch(out)
                    out, size = [], 0
            yield batch(out)

    return run


def _sharded(length: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        keys = [t.column(c).to_numpy() for c in ("g", "c1", "c2")]
        order = np.lexsort(keys[::-1])
        texts = t.column("context").to_pylist()
        g = keys[0][order].tolist()
        n, m = t.column("n").to_pylist(), t.column("m").to_pylist()
        del rows, t
        found = repeats(g, [texts[i] for i in order], [n[i] for i in order], [m[i] for i in order], length, shard)
        which = np.repeat(order, [len(r) for r in found])
        pairs = np.array([p for r in found for p in r], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(k[which]) for k in keys] + [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["g", "c1", "c2", "a", "z"])

    return run


def spans_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, not touching, ascending runs of bytes that the ranges cover."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
    for b in batches:
        spans, kept, removed = [], [], []
        for text, own in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist()):
            s = spans_of([(r["a"], r["z"]) for r in own or []])
            at, parts = 0, []
            for a, z in s:
                parts.append(text[at:a])
                at = z
            parts.append(text[at:])
            kept.append(b"".join(parts))
            removed.append(len(text) - len(kept[-1]))
            spans.append([{"a": a, "z": z} for a, z in s])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(t) for t in kept], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            ["doc_id", "n_kept", "n_removed", "spans", "kept"],
        )


def substring_dedup(docs: DataFrame, length: int = 400, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_kept, n_removed, spans, kept): the bytes left of every row of docs, and the removed runs."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        docs["doc_id"].cast("long"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("dk"),
        F.xxhash64(text_of(docs)).alias("th"),
        text_of(docs).cast("binary").alias("text"),
    )
    anchored = written(rows.select("dk", "th", "text").mapInArrow(_anchored(length), "g long, c1 long, c2 long, dk long, th long, s long, n long"))
    kinds = anchored.groupBy("g", "c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("dk", "th", "s", "n")).alias("one"))
    again = anchored.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g")
    live = written(kinds.join(again, "g").select("g", "c1", "c2", "m", "one.*"))
    size = live.agg(F.sum(F.col("n") + (length - 1))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(n, -(-size // TASK))
    placed = rows.repartition(n, "dk", "th")
    own = live.groupBy("dk", "th").agg(F.collect_list(F.struct("g", "c1", "c2", "m", "s", "n")).alias("own"))
    # rows that are equal in dk and th cut the same contexts, which repeat in any case. Both
    # uses of placed take all its columns, so that Spark runs its exchange once
    cut = placed.join(own, ["dk", "th"]).select("doc_id", "dk", "th", "text", "own")
    cut = cut.mapInArrow(_cut(length), "g long, c1 long, c2 long, m long, n long, context binary")
    marks = cut.repartition(tasks, "g").mapInArrow(_sharded(length, shard), "g long, c1 long, c2 long, a long, z long")
    places = anchored.select("g", "c1", "c2", "dk", "th", "s").join(marks, ["g", "c1", "c2"])
    ranges = places.select("dk", "th", F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("z") + length).alias("z")).alias("r"))
    ranges = ranges.groupBy("dk", "th").agg(F.collect_list("r").alias("ranges"))
    out = placed.join(ranges, ["dk", "th"], "left").select("doc_id", "dk", "th", "text", "ranges")
    return out.mapInArrow(_spanned, "doc_id long, n_kept long, n_removed long, spans array<struct<a: long, z: long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", (F.col("n_kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
