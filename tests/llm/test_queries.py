"""The registered queries themselves, over tables of their own: folds, columns and forms of results."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.llm import common, decontaminate, language_id, lm_scoring, mixing, near_dedup, order_minhash, registry, simhash, token_output, toxicity

from .test_operators import words

CLASHING = ["_th", "_i", "_d", "_n", "_t", "_c", "_h", "th", "dk", "key", "n", "lang_pred", "lang_score"]


def table(spark, sf, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{sf}/{name}.parquet")


def documents(spark, sf, rows):
    """rows: doc_id, text, lang, source; further columns clash with names that operators use."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    made = [(i, t, lang, s, len(t or ""), *["x"] * len(CLASHING)) for i, t, lang, s in rows]
    table(spark, sf, "documents", made, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    return spark.read.parquet(f"{sf}/documents.parquet")


def held(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 1


M = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & M
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & M
    return x ^ x >> 32


def plain_fingerprint(text, seed=11):
    """Order MinHash one k-mer at a time."""
    if not text:
        return [0] * 64
    k = 8
    kmers = [int.from_bytes(text, "little") | len(text) << 56] if len(text) < k else [int.from_bytes(text[i : i + k], "little") for i in range(len(text) - k + 1)]
    h, seen, keys = [mix(x) for x in kmers], {}, []
    for x in h:
        keys.append(mix(x + seen.get(x, 0) * 0xD6E8FEB86659FD93 & M) >> 32)
        seen[x] = seen.get(x, 0) + 1
    out = []
    for i in range(1, 65):
        s = mix(i + seed) >> 32 | 1
        best = sorted(range(len(keys)), key=lambda p: ((keys[p] ^ s >> 7) * s & 0xFFFFFFFF, p))[:2]
        value = seed
        for p in sorted(best):
            value = mix((value * 3 + h[p]) & M)
        out.append(value >> 48)
    return out


def test_op7_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(1, 40)), "en", "s") for i in range(20)] + [(20, None, None, None), (21, "", "en", "s"), (22, "kurz", "en", "s"), (23, "é" * 30, "en", "s"), (None, words(rng, 9), "en", "s")]
    documents(spark, str(tmp_path), rows)
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_order_minhash"](spark, str(tmp_path)).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    as_hex = lambda f: "".join(f"{x:04x}" for x in f)
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / 64
    assert len(got) == len(rows)
    for (i, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        m = len(t) // 3
        new = t[: len(t) - m] + after[:m]
        own, edited, following = (plain_fingerprint(x.encode()) for x in (t, new, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_hex(own), as_hex(edited))
        assert (r["near_edited"], r["near_next"]) == (like(own, edited), like(own, following))


def test_op9_folds_and_unknowns(spark, tmp_path):
    rng = random.Random(9)
    speak = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr"}
    say = lambda k: " ".join("".join(rng.choices(speak[k], k=5)) for _ in range(25))
    rows = [(i, say(k), k, "s") for i, k in enumerate(list(speak) * 30)]
    rows += [(900, None, "aa", "s"), (901, "12 34 !!", "aa", "s"), (902, "", None, "s"), (None, say("bb"), None, "s"), (903, say("cc") + " " + say("cc") * 4000, None, "s")]
    documents(spark, str(tmp_path), rows)
    got = registry.QUERIES["op9_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == held(r["doc_id"], 3) and 0 <= r["score"] <= 1
        want = "und" if r["doc_id"] in (900, 901, 902) else "bb" if r["doc_id"] is None else "cc" if r["doc_id"] == 903 else rows[r["doc_id"]][2]
        assert r["lang_pred"] == want


def test_language_stage_rejects_what_is_like_no_language_and_keeps_unlabelled_corpora(spark, tmp_path):
    rng = random.Random(3)
    speak = {"aa": "abcdef", "bb": "ghijkl"}
    rows = [(i, " ".join("".join(rng.choices(speak[k], k=5)) for _ in range(30)), k, "s") for i, k in enumerate(list(speak) * 40)]
    noise = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400))
    docs = documents(spark, str(tmp_path / "a"), rows + [(500, noise, None, "s"), (501, "12 !", "aa", "s")])
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= set(range(80)) and 501 not in ids
    only = {r["doc_id"] for r in language_id.accepted(docs, {"aa"}).collect()}
    assert only <= {i for i, r in enumerate(rows) if r[2] == "aa"} | {500}
    bare = documents(spark, str(tmp_path / "b"), [(i, t, None, s) for i, t, _, s in rows] + [(501, "12 !", None, "s")])
    assert {r["doc_id"] for r in language_id.accepted(bare).collect()} == set(range(80))
    assert language_id.accepted(docs.limit(0)).count() == 0


def test_gram_counts_do_not_depend_on_chunks(monkeypatch):
    text = "ein text, der über jede Kante reicht " * 50
    whole = language_id.gram_counts(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(language_id, "CHUNK", size)
        assert (language_id.gram_counts(text) == whole).all()


def test_op3_columns_and_folds(spark, tmp_path):
    rng = random.Random(1)
    bad = ["zounderkite", "muppetron", "gitface"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        text = words(rng, 20)
        if toxic:
            text += f" you {rng.choice(bad)} " + words(rng, 10)
        rows.append((i, text, "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (1002, words(rng, 20) + " you zounderkitte " + words(rng, 9), "en", "s"), (1003, rows[0][1], "en", "s")]
    labels += [(1003, 1, 0), (None, 1, 1), (5, 1, 7)]
    documents(spark, str(tmp_path), rows)
    table(spark, str(tmp_path), "labels", labels, "doc_id long, quality int, toxic int")
    run = lambda: {r["doc_id"]: r for r in registry.QUERIES["op3_toxicity"](spark, str(tmp_path)).collect()}
    got = run()
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == held(i, 3) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    caught = [got[i]["predicted"] for i in range(0, 300, 3)]
    assert np.mean(caught) > 0.95 and not any(got[i]["predicted"] for i in range(300) if i % 3)
    assert got[1002]["predicted"] == 1 and got[1000]["predicted"] == got[1001]["predicted"] == 0  # a misspelling, and nothing at all
    assert {i: r["score"] for i, r in run().items()} == {i: r["score"] for i, r in got.items()}


def test_op10_planted_among_stray_windows(spark, tmp_path):
    """Every verbatim and every consistently changed copy is found whatever else the text holds, and nothing else."""
    rng = random.Random(10)
    items = []
    for k in range(6):
        w = words(rng, 20).split(" ")
        w[5], w[11], w[15] = str(rng.randint(2, 90)), str(rng.randint(100, 900)), "Anna"
        items.append((k, " ".join(w)))
    dense = (6, "If 3 kg cost 12 dollars, how much do 7 kg cost?")  # hardly a plain word
    items.append(dense)
    rows, want = [], set()
    for i in range(60):
        body = [words(rng, 30), words(rng, 30)]
        k = i % 6
        parts = items[k][1].split(" ")
        at = rng.randint(0, 12)
        stray = " ".join(parts[at : at + 5])  # a window of the item, with other numbers
        stray = " ".join(str(rng.randint(2, 90)) if t.isdigit() else t for t in stray.split(" "))
        body.insert(1, stray)
        if i % 3 == 0:
            body.insert(rng.randint(0, 3), items[k][1])
            want.add((i, k))
        elif i % 3 == 1:
            body.insert(rng.randint(0, 3), " ".join("7" + t if t.isdigit() else "Bert" if t == "Anna" else t for t in parts))
            want.add((i, k))
        rows.append((i, " and then ".join(body), "en", "s"))
    rows += [(100, "Well. " + dense[1], "en", "s"), (101, None, None, None), (102, "", "en", "s")]
    want.add((100, 6))
    documents(spark, str(tmp_path), rows)
    table(spark, str(tmp_path), "benchmark", [*items, (7, None), (8, "")], "item_id long, text string")
    got = registry.QUERIES["op10_decontamination"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["coverage"] >= 0.8 for r in got) and all(r["reparameterised"] == (r["doc_id"] % 3 == 1) for r in got if r["doc_id"] < 60)


def test_first_pass_drops_no_match(spark, tmp_path, monkeypatch):
    """The pass by single words finds what looking at all documents finds."""
    rng = random.Random(2)
    items = spark.createDataFrame([(k, words(rng, 12)) for k in range(5)], "item_id long, text string")
    texts = [r["text"] for r in items.collect()]
    rows = [(i, words(rng, 10) + " " + " ".join(rng.choice(texts).split(" ")[: rng.randint(6, 12)]) + " " + words(rng, 10)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fast = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "_holding", lambda d, *_: d.select(F.col("doc_id").alias("d")).distinct())
    assert fast == sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) and fast


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, words(rng, 12), "en", f"s{i % 2}") for i in range(12)] + [(12, None, None, None), (3, words(rng, 12), "en", "s0")]
    docs = documents(spark, str(tmp_path), rows)
    for stage in (mixing.mixed_documents, simhash.deduplicated, near_dedup.deduplicated):
        out = stage(docs)
        assert out.columns == docs.columns and {r["_th"] for r in out.collect()} == {"x"}
        assert stage(docs.limit(0)).count() == 0


def test_long_texts_cross_every_edge(spark, monkeypatch):
    """Small chunks stand for long texts: results are those of one chunk."""
    rng = random.Random(6)
    text = words(rng, 700)
    prints, tokens = simhash.fingerprint(text.encode()), token_output.Encoder.at(token_output.tokenizer_path())
    omh, shingles = order_minhash.fingerprint(text.encode()).tolist(), near_dedup.bands(near_dedup.shingles(text.encode())).tolist()
    ids = tokens.encode([text, "", text], 0)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    monkeypatch.setattr(order_minhash, "CELLS", 999)
    monkeypatch.setattr(near_dedup, "CELLS", 999)
    monkeypatch.setattr(token_output, "GROUP", 100)
    assert simhash.fingerprint(text.encode()) == prints
    assert order_minhash.fingerprint(text.encode()).tolist() == omh
    assert near_dedup.bands(near_dedup.shingles(text.encode())).tolist() == shingles
    assert len(list(token_output.parts(text))) > 10
    cut = tokens.encode([text, "", text], 0)
    assert (cut[0] == ids[0]).all() and (cut[1] == ids[1]).all()
    ends = [i for i, t in enumerate(token_output._groups([text, "", text]))]
    assert ends == [0, 1]


def test_occurrences_of_more_than_a_packed_place_holds(monkeypatch):
    h = np.array([5, 5, 9, 5, 9], np.uint64) << np.uint64(30)
    monkeypatch.setattr(order_minhash, "_POSITION", 1)
    assert order_minhash.occurrences(h).tolist() == [0, 1, 0, 2, 1]


def test_tallies_are_bounded_and_exact(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 50)
    rng, t, keys = np.random.default_rng(1), lm_scoring.Tally(), []
    for _ in range(40):
        keys.append(rng.integers(0, 90, 33).astype(np.uint64))
        t.add(keys[-1])
        assert len(t.parts) <= 4
    t.settle()
    got = dict(zip(*(x.tolist() for x in t.total())))
    want = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(keys), return_counts=True))))
    assert got == want


def test_token_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path):
    """The files' own metadata: several stripes, a Bloom filter of doc_id, bounds that rule files out."""
    from pyarrow import orc

    rng = random.Random(5)
    docs = spark.createDataFrame([(i, words(rng, 60)) for i in range(3000)], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, options={"orc.stripe.size": "65536", "orc.compress.size": "4096"})
    files = sorted((tmp_path / "tokens").glob("*.orc"))
    read = [orc.ORCFile(str(f)) for f in files]
    assert sum(f.nrows for f in read) == 3000 and sum(f.nstripes for f in read) >= len(files)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kinds, bounds = set(), []
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        s = reader.getStatistics()[1]
        bounds.append((s.getMinimum(), s.getMaximum()))
        rows = reader.rows()
        footer = rows.readStripeFooter(reader.getStripes()[0])
        kinds |= {str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}
        rows.close()
    assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)
    bounds.sort()
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))  # a filter on doc_id leaves one file
    one = token_output.read_tokens(spark, path).filter("doc_id = 1234")
    assert one.count() == 1 and "EqualTo(doc_id,1234)" in one._jdf.queryExecution().executedPlan().toString()


def test_lm_beats_its_base_on_held_out_texts(spark, tmp_path):
    rng = random.Random(8)
    phrases = [words(rng, 6) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(phrases, k=12)) + " " + words(rng, 3), "en", "s") for i in range(400)]
    documents(spark, str(tmp_path), rows)
    got = [r for r in registry.QUERIES["op8_lm_scoring"](spark, str(tmp_path)).collect()]
    assert all(r["held_out"] == held(r["doc_id"], 5) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    for r in out:
        n = len((rows[r["doc_id"]][1].lower() + "\n").encode())
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / n)


def test_shared_folder_is_needed_off_one_machine():
    class Context:
        master, applicationId = "spark://somewhere:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    assert toxicity.tolerance("abc") == 0
