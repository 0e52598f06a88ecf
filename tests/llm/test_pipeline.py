"""The stages one after the other, each against a plain version of its own decision."""

import random
import zlib

import numpy as np

import corpus_pipeline
from verdikt.llm import near_dedup, token_output
from verdikt.llm.common import written

from .test_operators import brute_print, least_of_components, words


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    item = words(rng, 24)
    made = [(i, words(rng, 60), "en", f"s{i % 3}", 0) for i in range(60)]
    made += [(60, None, "en", "s0", 0), (61, "12 34", "en", "s0", 0), (62, made[4][1], "en", "s1", 0), (62, made[4][1], "en", "s1", 0)]
    made += [(63, words(rng, 20) + " " + item + " " + words(rng, 20), "en", "s2", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns = docs.columns
        docs = written(stage(spark, docs, sf))
        assert docs.columns == columns
        kept[name] = ids(docs)
    assert kept["language_id"] == sorted(m[0] for m in made if m[0] not in (60, 61))
    left = [m for m in made if m[0] not in (60, 61)]
    prints = [brute_print(m[1]) for m in left]
    root = least_of_components(len(left), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert kept["simhash_near_dedup"] == sorted({left[r][0] for r in root}) and 62 not in kept["simhash_near_dedup"]
    assert kept["decontamination"] == [i for i in kept["simhash_near_dedup"] if i != 63]
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].count(i) for i in kept["mixing"]) <= 3
    encode = token_output.Encoder.at(token_output.tokenizer_path())
    want, at = [], 0
    for i in kept["mixing"]:
        b = encode(made[i][1]) + np.array([0], "<u4").tobytes()
        want.append((i, at, len(b) // 4, zlib.crc32(b)))
        at += len(b) // 4
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == want


def test_near_dedup_takes_five_words_and_similarity(spark):
    """Texts with a replaced word: against all pairs, which two bits of a fingerprint do not reach."""
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = words(rng, 60 + 40 * g).split(" ")
        texts += [" ".join(base)] * 2
        for k in range(1, 4):
            near = list(base)
            for at in rng.sample(range(len(base)), k * (1 + g // 4)):
                near[at] = f"new{at}"
            texts.append(" ".join(near))
    texts += [words(rng, 40) for _ in range(20)] + ["four words of text", "Four words of TEXT", "", None]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = least_of_components(len(texts), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == sorted(set(root))
    prints = [brute_print(t or "") for t in texts]
    assert len(set(root)) < len(set(least_of_components(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)))


def test_near_dedup_links_fingerprints_too(spark):
    """Repeated words make fingerprints alike where the sets of shingles are not."""
    rng = random.Random(6)
    often = words(rng, 5)  # an odd number of shingles: no bit is a tie
    texts = [" ".join([often] * 300 + [words(rng, 20)]) for _ in range(3)] + [words(rng, 50) for _ in range(5)]
    prints = [brute_print(t) for t in texts]
    root = least_of_components(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(set(root)) == [0, *range(3, 8)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == sorted(set(root))


def test_empty_unlabelled_and_clashing_tables(spark, tmp_path):
    """No documents, no labels, no benchmark, and columns named as the stages' own."""
    rng = random.Random(2)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _th string, lang_pred string, d string, k string"
    made = [(i if i else None, words(rng, 30), None, None if i % 2 else "s", 0, "x", "y", "z", "w") for i in range(12)] + [(99, "", None, "s", 0, "x", "y", "z", "w")]
    for name, rows, items in (("empty", [], [(0, "one two three four five six")]), ("bare", made, [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:4]:
            docs = written(stage(spark, docs, sf))
            assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
            if stage_name == "decontamination":
                assert docs.count() == (12 if rows else 0)
        assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() == docs.count()


def test_near_dedup_texts_that_only_resemble_stay_apart(spark, monkeypatch):
    """Texts of similarity near 0.6 share bands with each other; their counts rule them out, in whatever blocks."""
    rng = random.Random(8)
    head = words(rng, 150)
    texts = [f"{head} {words(rng, 45)}" for _ in range(40)]
    linked = texts[3].split(" ")
    linked[100] = "other"
    texts.append(" ".join(linked))
    met = []
    near = near_dedup._near

    def counted(pairs, *more):
        pairs = written(pairs)
        met.append(pairs.count())
        return near(pairs, *more)

    monkeypatch.setattr(near_dedup, "_near", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (3, 256):
        monkeypatch.setattr(near_dedup, "BLOCK", block, raising=False)
        met.clear()
        assert sorted(r["doc_id"] for r in near_dedup.deduplicated(docs).collect()) == list(range(40))
        assert len(met) == 2 and met[1] <= 1


def test_counts_lose_no_similar_pair():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 2, 5, 60, 127, 128, 140, 1000, 40_000):
        own = rng.integers(0, 1 << 63, n, np.uint64)
        for k in (0, n // 20, n // 9, n // 4, n // 2):
            sets.append(np.unique(np.append(own[k:], rng.integers(0, 1 << 63, k, np.uint64))))
            sets.append(np.unique(own[: n - k])) if n > k else None
    sets += [np.arange(1000, dtype=np.uint64) << np.uint64(40)] * 2  # too many hashes of one value
    n, made = np.array(list(map(len, sets))), list(map(near_dedup.counts, sets))
    assert made[-1] == b""
    size = len(sets)
    want = {(i, j) for i in range(size) for j in range(i + 1, size) if near_dedup.similarity(sets[i], sets[j]) >= 0.8}
    got = lambda kinds, side: {(min(p), max(p)) for p in zip(*(x.tolist() for x in near_dedup.alike(n, kinds, side, made)))}
    found = got(np.arange(size), np.zeros(size, np.int64))
    assert want <= found and len(found) < 1.5 * len(want)
    side = np.arange(size) % 3 % 2
    assert {p for p in want if side[p[0]] != side[p[1]] and p[0] // 2 != p[1] // 2} <= got(np.arange(size) // 2, side)
    assert all(side[i] != side[j] and i // 2 != j // 2 for i, j in got(np.arange(size) // 2, side))
