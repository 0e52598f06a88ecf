"""Token-ID output as ORC.

Texts are encoded with a public tokenizer, an end id closes each document, and rows
go out in ascending doc_id order as ORC: integer columns are run-length encoded,
stripes are bounded in bytes, row indexes hold minima and maxima of every
``row_index_stride`` rows, and doc_id has a Bloom filter, so a reader takes stripes
in parallel and a filter on doc_id prunes by metadata.

Byte-level BPE never merges across the pieces that the tokenizer's pattern makes, and
a piece never ends inside a word or begins after its blank. So the words of many texts
whose white space is single blanks and newlines are numbered together, each distinct word
is encoded once, and the texts' ids are gathered by number; words seen are kept in bounded
memory. Any other text goes to the tokenizer. Special tokens' strings are plain text. Very
long texts are encoded in parts, cut before a blank between letters or digits, where every
piece ends.

Defined cases: a null or empty text is the end id alone; null doc_ids come first;
rows of equal doc_id are in order of their text's hash, and identical rows are
alike; an empty table makes an empty file set.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, shared_dir, ship, text_of, written

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Words kept in each of two generations; it changes no result.
CACHE = 300_000
#: Characters encoded together, and at most about as many of one text at once.
GROUP = 1 << 21
#: Texts to encode by words: characters on which the pattern is plain, single white space between.
BY_WORDS = re.compile(r"[!-~¡-¬®-ɏ]+(?:[\n ][!-~¡-¬®-ɏ]+)*+")
CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Marks of a word without a blank before it, of the end of a text, and of a part encoded whole: no word has them.
BARE, LAST, WHOLE = "\x01", "\x02", "\x03"
LEAD = f"\n{BARE}"

ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(8 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.encoding.strategy": "SPEED",
}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: themselves if printable, else from U+0100 on."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


LETTERS = _byte_letters()
BLANK = LETTERS[32]


def parts(text: str, most: int | None = None) -> Iterator[str]:
    """A text in parts of about ``most`` (GROUP) characters, if it has places to cut."""
    at, most = 0, most or GROUP
    while len(text) - at > most:
        m = CUT.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    """Texts to token ids."""

    _of: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.marks = {m: self._ids(m) for m in ".,;:!?"}
        self.newline = self._ids("\n")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "Encoder":
        """One a worker process, which serves many tasks."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, keys: list[str]) -> None:
        """Encodes words. Letters or digits only, with the blank before them, are one piece, which
        goes to the model itself; a mark behind letters is another."""
        young, old = self.young, self.old
        marked = [k for k in keys if k[-1] in self.marks and k[:-1].lstrip(LEAD).isalpha()]
        stems = {k[:-1] for k in marked}
        plain = [k for k in {*keys, *stems} if k not in young and k not in old and k.lstrip(LEAD).isalpha()]
        tokenize = self.model.tokenize
        for k in plain:
            word = k if k.isascii() else k.encode().decode("latin-1").translate(LETTERS)
            if k[0] == BARE:
                made = tokenize(word[1:])
            elif k[0] == "\n":
                made = tokenize(word[2:])
            else:
                made = tokenize(BLANK + word)
            ids = array("I", [t.id for t in made]).tobytes()
            young[k] = self.newline + ids if k[0] == "\n" else ids
        for k in marked:
            stem = k[:-1]
            young[k] = (young.get(stem) or old[stem]) + self.marks[k[-1]]
        others = [k for k in keys if k not in young]
        texts = [("" if k[0] == BARE else "\n" if k[0] == "\n" else " ") + k.lstrip(LEAD) for k in others]
        for k, e in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            young[k] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end``, and each one's number of ids."""
        own = {LAST: array("I", [end]).tobytes()}
        pieces: list[str] = []
        for text in texts:
            if text:
                for i, part in enumerate(parts(text)):
                    plain = part[1:] if i else part  # a later part begins with its blank
                    if BY_WORDS.fullmatch(plain):
                        pieces.append(("" if i else BARE) + plain.replace("\n", f" \n{BARE}"))
                    else:
                        pieces.append(f"{WHOLE}{len(own)}")
                        own[pieces[-1]] = self._ids(part)
            pieces.append(LAST)
        words = pc.split_pattern(pa.array([" ".join(pieces)], pa.large_string()), " ").flatten().dictionary_encode()
        del pieces
        keys, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        young, old = self.young, self.old
        if len(young) > CACHE:
            young, old = self.young, self.old = {}, young
        young.update((k, old[k]) for k in keys if k in old and k not in young)
        unknown = [k for k in keys if k not in young and k not in own]
        self._learn(unknown)
        ids = [own.get(k) or young[k] for k in keys]
        for k in unknown:
            if len(k) > 64:
                young.pop(k, None)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[which]
        stop = np.cumsum(n)
        out = flat[np.repeat(first[which] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        ends = stop[which == keys.index(LAST)]
        return out, np.diff(ends, prepend=0)

    def __call__(self, text: str) -> bytes:
        """The ids of one text, without an end, as little-endian unsigned 32-bit integers."""
        return self.encode([text], 0)[0][:-1].tobytes()


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= GROUP:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row = Encoder.at(path), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column("text").to_pylist()
            for at, stop in _groups(texts):
                ids, sizes = encoder.encode(texts[at:stop], end)
                k = stop - at
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, k), pa.array(np.full(k, part, np.int32)), pa.array(np.arange(row, row + k)), lists], ["doc_id", "part", "row", "ids"]
                )
                row += k

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, options: dict[str, str] | None = None) -> None:
    """Writes (doc_id, part, row, ids) as ORC in ascending doc_id order; file ``part`` comes before ``part + 1``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs["doc_id"].cast("long"), F.xxhash64(text_of(docs)).alias("th"), text_of(docs).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    out = rows.mapInArrow(_encoded(tokenizer or tokenizer_path(), end), "doc_id long, part int, row long, ids array<int>")
    out.write.options(**(ORC | (options or {}))).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, row long, ids array<int>").orc(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"), b.column("row"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "part", "row", "n_tokens", "ids_crc32"],
        )


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``read_tokens``.

    start adds the totals of the files before (a row a file) to a running sum within
    the file, so no task sees more than a file's rows.
    """
    ship(tokens.sparkSession)
    rows = written(tokens.mapInArrow(_digests, "doc_id long, part int, row long, n_tokens long, ids_crc32 long"))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(totals, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(documents(spark, sf_dir), path)
    return token_index(read_tokens(spark, path))
