"""Small fixtures against brute force: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from verdikt.llm import common, components, decontaminate, language_id, line_dedup, lm_scoring, mixing, order_minhash, simhash, suffix_dedup, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, dk string, size int, target string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def make(spark, rows):
    """rows: (doc_id, text, lang, source); further columns clash with names used inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", 3, "y") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, "\n".join(words(rng, 25) for _ in range(4)), "en", f"s{i % 4}") for i in range(40)]
    long = "\n".join(words(rng, 40) for _ in range(60))
    out += [(40, None, None, None), (41, "", "en", "s0"), (42, out[3][1], "en", "s1"), (42, out[3][1], "en", "s1"), (43, out[3][1] + " tail", "en", None)]
    out += [(None, out[5][1], "en", "s2"), (44, long, "en", "s0"), (45, long[:3000] + " new " + long[3000:], "en", "s0"), (46, "one", "en", "s3"), (47, "ab " * 400, "en", "s1")]
    out += [(48, " \t\n \n", "en", "s1"), (49, "Common Line Here \nx\n common line here", "en", "s1"), (50, "COMMON LINE HERE", "en", "s2"), (51, "Ünïcode ÄÖ ẞ\n" * 3, "de", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def texts(rows):
    return [(i, t or "") for i, t, *_ in rows]


def multiset(values):
    return sorted(map(repr, values))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for t in (b"", b"a", b"banana", b"a" * 40, b"ab\0\0\0", bytes(rng.choices(b"ab\0", k=900)) * 2):
        want = sorted(range(len(t)), key=lambda i: t[i:])
        sa, rank = suffix_dedup.suffix_array(t)
        assert list(sa) == want and all(sa[rank[i]] == i for i in range(len(t)))
        for lanes in (1, 5):
            lcp = suffix_dedup.kasai(t, sa, rank, 50, lanes)
            for k in range(1, len(t)):
                a, b = t[want[k - 1] :], t[want[k] :]
                n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert lcp[k] == min(50, n)


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD, 700])
def test_substring_dedup(docs, rows, empty, shard):
    length = 100
    raw = [t.encode() for _, t in texts(rows)]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    want = []
    for (doc_id, _), b in zip(texts(rows), raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        n_spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((doc_id, len(b), int(gone.sum()), n_spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    out = suffix_dedup.substring_dedup(docs, length, shard)
    got = [(r["doc_id"], r["n_kept"] + r["n_removed"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in out.collect()]
    assert multiset(got) == multiset(want) and sum(w[2] for w in want) > 1000
    assert suffix_dedup.substring_dedup(empty, length).count() == 0


def test_line_dedup(docs, rows, empty):
    strip = " \t\n\x0b\f\r"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    place = lambda i: math.inf if i is None else i
    first = {}
    for i, t in texts(rows):
        for line in t.split("\n"):
            k = low(line.strip(strip))
            if len(k) >= 10:
                first[k] = min(first.get(k, math.inf), place(i))
    want = []
    for i, t in texts(rows):
        lines = t.split("\n")
        kept = [x for x in lines if first.get(low(x.strip(strip)), place(i)) == place(i)]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    for batches in (1, 5):
        out = line_dedup.line_dedup(docs, batches=batches, fanout=2)
        got = [(r["doc_id"], r["text"], r["n_lines"], max(0, r["n_dropped"])) for r in out.collect()]
        assert multiset(got) == multiset(want)
    assert line_dedup.line_dedup(empty).count() == 0


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs, block_words=8, shard_rows=10).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() >= {"doc_id", "size", "source_size", "target", "taken"}
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = float(sum(size.values())), {}, set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= 3 * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 8 for s in names)
    again = mixing.mix(docs.repartition(7), block_words=8, shard_rows=10).collect()
    assert multiset(map(tuple, again)) == multiset(map(tuple, out)) and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_apportionment_is_highest_quotients(spark):
    rng = random.Random(3)
    for total in (0, 1, 7, 500):
        w = [rng.choice([0, 1, 3, 10, 250]) + rng.random() for _ in range(9)]
        df = spark.createDataFrame([(k, x, total) for k, x in enumerate(w)], "k int, w double, total long")
        got = {r["k"]: r["n"] for r in mixing.apportion(df, [], "k", "w", "total", "n").collect()}
        want = Counter(k for _, k in sorted((-x / (2 * j - 1), k) for k, x in enumerate(w) for j in range(1, total + 2))[:total])
        assert got == {k: want[k] for k in range(9)}


def brute_print(t):
    w = [x for x in t.encode().lower().split()]
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def least_of_components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_simhash(docs, rows, empty):
    prints = [brute_print(t) for _, t in texts(rows)]
    root = least_of_components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    least = {}
    for r, (i, _) in zip(root, texts(rows)):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert multiset(got) == multiset((i, p, least.get(r)) for (i, _), p, r in zip(texts(rows), prints, root))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)]
    got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_radius_two_links_all_pairs(spark):
    rng = random.Random(8)
    base = rng.getrandbits(62)
    fps = [base, base ^ 1, base ^ 3, base ^ 7, base ^ (5 << 40), rng.getrandbits(62), 0, 3]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    root = least_of_components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for a in range(len(fps)):
        for b in range(a):
            assert (got.get(fps[a], fps[a]) == got.get(fps[b], fps[b])) == (root[a] == root[b])
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_token_output_round_trip(spark, docs, rows, empty, tmp_path):
    tokenizer = token_output.Encoder.at(token_output.tokenizer_path()).tokenizer
    token_output.write_tokens(docs, str(tmp_path / "t"))
    read = token_output.read_tokens(spark, str(tmp_path / "t"))
    got = sorted(((r["part"], r["row"], r["doc_id"], r["ids"]) for r in read.collect()), key=lambda r: r[:2])
    assert [r[2] for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i))
    want = [(i, tokenizer.encode(t, add_special_tokens=False).ids + [0]) for i, t in texts(rows)]
    assert multiset((r[2], r[3]) for r in got) == multiset(want)
    index = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_output.token_index(read).collect())
    at = 0
    for (start, i, n, crc), (_, _, doc_id, ids) in zip(index, got):
        assert (start, i, n, crc) == (at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    token_output.write_tokens(empty, str(tmp_path / "e"))
    assert token_output.token_index(token_output.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_encoder_equals_the_tokenizer():
    e = token_output.Encoder.at(token_output.tokenizer_path())
    for t in ["", "a", " a", "it's, it's!!\nDon't\n\nx  y   z ", "tab\tx", "　wide ü ß² 12.5%", "<|endoftext|> a", "x" * 300, "one\ntwo three,four. five;"]:
        assert e(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_order_minhash(docs, rows, empty):
    order = sorted(texts(rows), key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    got = {}
    for r in order_minhash.compared_with_next(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for k, (i, t) in enumerate(order):
        if i in (42, 43) or order[(k + 1) % len(order)][0] == 42:
            continue  # tied neighbours
        new = order_minhash.edited(t, order[(k + 1) % len(order)][1])
        r = got[i][0]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(new.encode()))
        own, other = order_minhash.fingerprint(t.encode()), order_minhash.fingerprint(new.encode())
        assert r["fingerprint"] == order_minhash.as_hex(own) and r["near_edited"] == order_minhash.likeness(own, other)
    assert order_minhash.compared_with_next(empty).count() == 0


def test_order_minhash_follows_edits_and_order():
    rng = random.Random(2)
    a = words(rng, 300)
    like = lambda b: order_minhash.likeness(order_minhash.fingerprint(a.encode()), order_minhash.fingerprint(b.encode()))
    parts = a.split(" ")
    blocks = [parts[k : k + 30] for k in range(0, 300, 30)]
    rng.shuffle(blocks)
    assert like(a) == 1 and like(a[:-10]) > like(a[: len(a) * 2 // 3]) > like(words(rng, 300)) == 0
    assert like(" ".join(sum(blocks, []))) < like(a[:-60])
    n = order_minhash.occurrences(np.array([5, 5, 9, 5, 9], np.uint64) << np.uint64(30))
    assert n.tolist() == [0, 1, 0, 2, 1]


def test_ctw_probabilities_sum_to_one_and_score(docs, rows, empty):
    train = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    learned = [t for i, t in texts(rows) if i is None or i % 5 != 1]
    counts = Counter(w for t in learned for w in lm_scoring.tokens_of(t.encode()))
    total, distinct = sum(counts.values()), len(counts)
    for limit, share in ((lm_scoring.RESIDENT, lm_scoring.SHARE), (40, 200)):
        got = {}
        for r in lm_scoring.score_texts(docs, train, limit, share).collect():
            got.setdefault(r["doc_id"], r)
        for i, t in texts(rows):
            own = lm_scoring.tokens_of(t.encode())
            base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
            assert r["base_score"] == pytest.approx(base, rel=1e-6) and r["score"] == pytest.approx(brute_ctw(learned)(t), rel=1e-4)
    assert lm_scoring.score_texts(empty, train).count() == 0


_models = {}


def brute_ctw(learned):
    """The trees as plain dictionaries and recursion."""
    key = hash(tuple(learned))
    if key in _models:
        return _models[key]
    counts, children = {}, {}
    depth = lm_scoring.DEPTH

    def bits(text):
        raw = b"\n" * depth + b" ".join(lm_scoring.tokens_of(text.encode())[:-1]) + b"\n"
        for at in range(depth, len(raw)):
            for b in range(8):
                yield raw[at - depth : at], (b, raw[at] >> (8 - b)), raw[at] >> (7 - b) & 1

    for t in learned:
        for context, prefix, bit in bits(t):
            for d in range(depth + 1):
                node = (context[depth - d :], prefix)
                counts.setdefault(node, [0, 0])[bit] += 1
                if d < depth:
                    children.setdefault(node, set()).add((context[depth - d - 1 :], prefix))
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)
    stop = {}

    def mix(node):
        own = kt(counts[node])
        if len(node[0]) == depth:
            stop[node] = 1.0
            return own
        m = np.logaddexp(own, sum(map(mix, children[node]))) - math.log(2)
        stop[node] = math.exp(own - math.log(2) - m)
        return m

    for b in range(8):
        for node in [n for n in counts if not n[0] and n[1][0] == b]:
            mix(node)

    def score(text):
        out = 0.0
        for context, prefix, bit in bits(text):
            path = [(context[depth - d :], prefix) for d in range(depth + 1)]
            path = [n for n in path if n in counts]
            p = 0.5
            for k, n in enumerate(reversed(path)):
                own = (counts[n][bit] + 0.5) / (sum(counts[n]) + 1)
                p = own if k == 0 else stop[n] * own + (1 - stop[n]) * p
            out += math.log10(p)
        return out

    _models[key] = score
    return score


def test_language_id(spark, empty):
    rng = random.Random(4)
    speak = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst", "ee": "uvwxy", "ff": "zabkp"}
    made = [(i, " ".join("".join(rng.choices(speak[k], k=5)) for _ in range(30)), k, "s") for i, k in enumerate(list(speak) * 20)]
    made += [(900, None, "aa", "s"), (901, "12 34 !!", "aa", "s"), (902, "", None, "s"), (903, made[0][1], None, None)]
    df = make(spark, made)
    model = language_id.fit_languages(df.filter("doc_id % 7 <> 1"))
    got = {r["doc_id"]: r for r in language_id.predict_languages(df, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in made[:120]) and got[903]["lang_pred"] == "aa"
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and all(0 <= r["lang_score"] <= 1 for r in got.values())
    none = language_id.fit_languages(empty)
    assert language_id.predict_languages(df, none).first()["lang_pred"] == "und" and language_id.predict_languages(empty, model).count() == 0
    code = language_id.codewords(9)
    assert min((code[a] != code[b]).sum() for a in range(9) for b in range(a)) >= 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = ["idiot", "clown", "worthless", "cat", "disgusting", "clowns"]
    tokens = list({"".join(rng.choices("clownidtrhes", k=rng.randint(3, 11))) for _ in range(400)} | {"idi0t", "clwn", "worthles", "wortless", "disgustin", "cats", "cloown", "xclowns"})
    got = toxicity.automaton_matches(toxicity.Trie.of(terms), terms, tokens)
    for t in tokens:
        near = [(edits(t, w), k) for k, w in enumerate(terms) if edits(t, w) <= toxicity.tolerance(w)]
        assert got.get(t) == (min(near)[::-1] if near else None), t


def test_toxicity(spark, empty):
    rng = random.Random(9)
    made, labels = [], []
    for i in range(300):
        w = words(rng, 60).split(" ")
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zzidiot", "zzclown", "zzrubbish"]))
        made.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(bad)))
    made += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "you zzidi0t, zzcloown and zzrubbsh you", "en", "s"), (903, "a plain text", None, None)]
    labels += [(5, 1, 0), (6, 1, None), (999, 1, 1)]
    df, known = make(spark, made), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(df, known.filter("doc_id % 3 <> 1 or doc_id % 2 = 0"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    assert all((got[i] >= 0.7) == (i % 3 == 0) for i in range(300)) and got[902] >= 0.7 > max(got[900], got[901], got[903])
    assert toxicity.signs('he said the word "idiot" was'.split(), 4) == {"he", "said", "the", "word", "was", toxicity.MARKS}
    assert toxicity.signs("you are an idiot now".split(), 3) == {"you", "are", "an", "now"}
    blank = toxicity.fit_toxicity(empty, known.limit(0))
    assert toxicity.score_toxicity(df, blank).agg(F.max("score")).first()[0] < 0.01


def test_decontamination(spark, docs, empty):
    rng = random.Random(7)
    ask = "a train leaves the old station at 12 and goes 340 km to Dover where it meets 12 others"
    plain = words(rng, 20)
    items = spark.createDataFrame([(0, ask), (1, plain), (2, "two words"), (3, None), (4, "1 2 3 4 5 6 7"), (5, "")], "item_id long, text string")
    other = ask.replace("12", "15").replace("340", "77").replace("Dover", "Calais")
    wrong = ask.replace("at 12", "at 15")  # 12 stands for 15 and for 12
    made = [(100, words(rng, 30) + " " + ask + " " + words(rng, 9)), (101, other.upper().replace("CALAIS", "Calais")), (102, wrong), (103, words(rng, 50) + "\n" + plain + "."), (104, " ".join(plain.split()[:9])), (105, "Two words!"), (106, "say two words now"), (107, "9 8 7 6 5 4 3"), (108, None)]
    df = make(spark, [(i, t, "en", "s") for i, t in made]).unionByName(docs)
    for limit in (1_000_000, 1):
        got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.contaminated(df, items, max_broadcast=limit).collect()}
        assert got.pop((101, 0), None) is True or (101, 0) not in got
        assert got == {(100, 0): False, (103, 1): False, (105, 2): False}, got
    again = decontaminate.contaminated(make(spark, [(1, other, "en", "s")]), items).collect()
    assert [(r["item_id"], r["reparameterised"]) for r in again] == [(0, True)]
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(df, items.limit(0)).count() == 0


def test_written_tables_outlive_their_source(spark, docs):
    t = common.written(docs.select("doc_id", "lang"), "lang")
    assert t.count() == docs.count() and json.loads(t.schema.json()) == json.loads(docs.select("doc_id", "lang").schema.json())


def matches(spark, texts, items):
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.contaminated(docs, items).collect()}


def test_decontamination_by_occurrence(spark):
    rng = random.Random(8)
    twice = "yesterday our friend bought 3 apples at the store and later someone bought 5 apples at the store"
    ask = "a train leaves the old station at 12 and goes 340 km to Dover where it meets 17 others"
    form = ask.replace("340", "77").replace("17", "9")
    third = form.replace("77", "55").replace("at 12", "at 8")
    swapped = twice.replace("3", "7").replace("5 ", "4 ")
    texts = [words(rng, 9) + " " + twice, ask + " " + words(rng, 40) + " " + form, form + " " + third, ask + " " + words(rng, 60) + " and goes 99 km to Dover " + words(rng, 9)]
    texts += [swapped, ask.replace("and goes", "and then it goes"), twice.replace("bought 3", "bought 4").replace("bought 5", "bought 4")]
    texts += [" ".join(ask.split()[9:]) + " " + words(rng, 99) + " " + " ".join(ask.split()[:9])]
    got = matches(spark, texts, [twice, ask])
    assert got == {(0, 0): False, (1, 1): False, (2, 1): True, (3, 1): False, (4, 0): True, (5, 1): False, (7, 1): False}, got


def test_decontamination_of_items_dense_in_values(spark):
    rng = random.Random(9)
    dense = ["A train travels 60 km in 2 hours and 90 km in 3 hours. Find its average speed.", "What is 15 percent of 240 dollars?", "If 3 kg cost 12 dollars, how much do 7 kg cost?"]
    dense += ["Compute 12 + 37 x 4 - 9 + 81 - 5", "Convert 5 km 300 m 20 cm to meters.", "1 2 3 4 5 6 7"]
    other = [dense[0].replace("60", "50").replace("90", "70"), dense[1].replace("15", "25").replace("240", "80"), dense[2].replace("12", "20").replace("7", "9")]
    other += [dense[4].replace("300", "800").replace("20", "70"), "9 8 7 6 5 4 3", "Compute 21 + 73 x 6 - 8 + 18 - 7"]
    got = matches(spark, [words(rng, 9) + " . " + t + " . " + words(rng, 9) for t in dense + other], dense)
    assert got == {(i, i): False for i in range(6)} | {(6, 0): True, (7, 1): True, (8, 2): True, (9, 4): True}, got


def test_decontamination_whatever_the_place_and_case_of_names(spark):
    names = "Tom has 5 apples. Anna gives 3 apples. Ben eats 2 apples. How many apples do they have left?"
    kate = names.replace("Tom", "Kate").replace("Anna", "Lena").replace("Ben", "Max")
    two = "When Peter met Laura in March they had 12 books each. In April Laura gave Peter 4 books and Peter lost 3 in May."
    other = two.lower().replace("12", "15").replace("4 ", "6 ")
    texts = [kate, two.lower(), two.upper(), names.replace(" Anna", "\nAnna"), two.replace(" Laura", "\nLaura").replace(" Peter", "\n \nPeter"), kate.replace("Max", "Lena"), kate.replace(". ", ".\n").replace("5", "8"), other]
    got = matches(spark, texts, [names, two])
    assert got == {(0, 0): True, (1, 1): False, (2, 1): False, (3, 0): False, (4, 1): False, (6, 0): True, (7, 1): True}, got
