"""Secrets, phrases and the filter audit against plain versions; the toxicity automaton at any length."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from verdikt.llm import decontaminate, filter_audit, phrases, registry, secrets, toxicity

from .test_operators import make
from .test_queries import documents, table

BITS = [
    "password", "PassWD", "secret", "TOKEN", "api_key", "apikey", "AKIA", "AKIAABCDEFGHIJKL", " ", '"', "'", ":", "=", "==", "abc", "0123456789abcdef", "f" * 33, "é", "Zz", "12345678", ".",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "A" * 36, "xoxb-", "1234567890", "AIza", "sk_live_", "eyJ", "a.", "://", "user", "@", "https", "\n", "ſecret", "日本",
]


def plain_spans(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"({r.head})(?:{r.value})".encode(), text.encode()):
            if m.end() - m.end(1) >= r.least:
                points = [len(text.encode()[:i].decode()) for i in (m.start(), m.end())]
                out.append((points[0], k, points[1]))
    return [(rules[k].kind, a, b) for a, k, b in sorted(out)]


def test_scanner_against_plain_expressions():
    rng, scanner = random.Random(1), secrets.Scanner()
    for _ in range(3000):
        text = "".join(rng.choices(BITS, k=rng.randint(0, 14)))
        got = [(secrets.RULES[k].kind, a, b) for a, k, b in secrets._code_points(text.encode(), scanner.spans(text.encode()))]
        assert got == plain_spans(text, secrets.RULES), text


@pytest.mark.parametrize("pattern", ["ab|abc", "(a|b)*c", "a{2,4}b?", "[^a-c]x+", "(ab){2,}", "a(b|c)?d", "(?i:ab)c", r"\x41\.[]-]", "a{3}"])
def test_any_rule_is_leftmost_and_longest(pattern):
    rng, scanner = random.Random(2), secrets.Scanner([secrets.Rule("r", pattern.replace("[]-]", "[-z]"))])
    pattern = re.compile(pattern.replace("[]-]", "[-z]"))
    for _ in range(400):
        text = "".join(rng.choices("abcdxABC.z-", k=rng.randint(0, 12)))
        want, at = [], 0
        while at < len(text):
            ends = [e for e in range(len(text), at, -1) if pattern.fullmatch(text, at, e)]
            if ends:
                want.append((at, 0, ends[0]))
            at = ends[0] if ends else at + 1
        assert scanner.spans(text.encode()) == want, text


def test_secret_that_is_too_short_still_covers():
    assert secrets.Scanner().spans(b"token=secret: 12345678") == []
    assert [s[:2] for s in secrets.Scanner().spans(b"token=ab secret: 12345678")] == [(9, 0)]


def test_secrets_defined_cases(spark):
    long = "é" * 70000 + " token = " + "x" * 50000
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, long, "en", "s"), (3, long, "en", "s"), (None, 'password: "hunter2222"', "en", "s")]
    docs = make(spark, rows)
    got = {(r["doc_id"], tuple(map(tuple, r["spans"]))) for r in secrets.secrets(docs).collect()}
    assert got == {(1, ()), (2, ()), (3, (("assign", 70001, 120009),)), (None, (("assign", 0, 21),))}
    red = secrets.redacted(docs)
    assert red.columns == docs.columns
    assert Counter(r["text"] for r in red.collect()) == {None: 1, "": 1, "é" * 70000 + " [assign]": 2, '[assign]"': 1}
    assert secrets.redacted(make(spark, [])).count() == 0 and secrets.secrets(make(spark, [])).count() == 0


def test_perfect_hash():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 50_000))
    h = phrases.PerfectHash(keys[::2])
    assert sorted(h.slots(keys[::2]).tolist()) == list(range(len(keys[::2])))
    assert (h.slots(keys[1::2]) == -1).all() and (h.keys[h.slots(keys[::2])] == keys[::2]).all()
    assert phrases.PerfectHash(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5
    with pytest.raises(ValueError):
        phrases.PerfectHash(np.array([1, 1]))


def plain_phrases(rows, least, cover):
    n, f = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    out = []
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in cands.items():
        inside = [b for (la, q), b in cands.items() if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= cover * a for b in inside):
            continue
        s, k, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], s))
    return sorted(out)


@pytest.mark.parametrize("max_slots", [1 << 20, 7])
def test_phrases_against_plain_counts(spark, max_slots):
    """Also with hashes of seven slots, so that words, candidates and buckets go over many of them."""
    rng = random.Random(4)
    words = ["The", "of", "la", "é", "ab", "x", "Ünï", "quick", "brown", "fox"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und"])) for _ in range(30)]
    rows += [(None, "en"), ("", None), ("la la la la la", "en"), ("zz yy " * 20000, "long")]
    docs = make(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)]).repartition(3)
    got = phrases.phrases(docs, 4, 50, max_slots)
    assert sorted(map(tuple, got.select("lang", "phrase", "a", "l", "r", "n", "score").collect())) == plain_phrases(rows, 4, 50)
    ranked = phrases.top_phrases(got, 5).collect()
    by_lang = {}
    for r in ranked:
        by_lang.setdefault(r["lang"], []).append((r["rank"], -r["score"], -r["a"], r["phrase"].encode()))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and sorted(x[1:] for x in v) == [x[1:] for x in sorted(v)] for v in by_lang.values())


def test_phrases_of_nothing(spark):
    assert phrases.phrases(make(spark, [])).count() == 0
    assert phrases.phrases(make(spark, [(1, None, None, None), (2, "a b", "en", "s")])).count() == 0


def test_audit_by_every_order(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        body = " ".join(rng.choices(["Ab", "c", "dd", "EE"] if rng.random() < 0.4 else [f"w{k}" for k in range(400)], k=rng.choice([0, 5, 230, 260])))
        rows.append((i, body + rng.choice(["", "", " #"]), "en", rng.choice(["s0", "s0", "s1", None, ""])))
    rows += [(200, rows[3][1], "en", "s1"), (200, rows[3][1], "en", "s1"), (None, rows[3][1], "en", "s0"), (201, None, "en", "s2"), (202, "", "en", "s2"), (203, "long $ " * 30000, "en", "s2")]
    sf = str(tmp_path)
    documents(spark, sf, rows)
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (200, 1, None)]
    table(spark, sf, "labels", [(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    best = {}
    for i, q, t in labels:
        if i is not None:
            a, b = best.get(i, (0, 0))
            best[i] = (max(a, q or 0), max(b, t or 0))
    firsts = {}
    for i, t, *_ in rows:
        firsts[t or ""] = min(firsts.get(t or "", 1 << 70), 1 << 69 if i is None else i)
    made = []
    for i, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            k for k, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), firsts[t] < (1 << 69 if i is None else i)]) if bad
        )
        made.append((s or "", fails, *best.get(i, (0, 0))))
    want, shapley = {}, Counter()
    for part in {m[0] for m in made}:
        own = [m for m in made if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                out = [m for m in left if f in m[1]]
                redundant = sum(f in m[1] for m in own) - len(out)
                left = [m for m in left if f not in m[1]]
                shapley[part, f] += len(out)
                want[part, order, step] = [len(left), len(out), redundant, sum(m[1] == f for m in own), sum(m[2] for m in out), sum(m[3] for m in out)]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    got = registry.QUERIES["op13_filter_audit"](spark, sf).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == want and len(got) == len(want)
    assert all(r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]] for r in got)
    table(spark, sf, "documents", [], "doc_id long, text string, lang string, source string")
    assert registry.QUERIES["op13_filter_audit"](spark, sf).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles_of_training_data_operators(spark, name):
    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, map(tuple, want)))


def edits(a, b):
    """Plain edit distance, up to 3."""
    if abs(len(a) - len(b)) > 2:
        return 3
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [9] * len(b)
        for j in range(max(1, i - 3), min(len(b), i + 3) + 1):  # farther from the diagonal more than two edits are needed
            now[j] = min(before[j] + 1 if j < i + 3 else 9, now[j - 1] + 1 if j > i - 3 or j == 1 else 9, before[j - 1] + (x != b[j - 1]))
        before = now
    return min(3, before[-1])


@pytest.mark.parametrize("length", [1, 2, 3, 4, 7, 8, 20, 126, 127, 128, 255, 400, 1000, 5000])
def test_automaton_at_any_length(length):
    rng = random.Random(length)
    for _ in range(3 if length > 300 else 20):
        terms = list(dict.fromkeys("".join(rng.choices("abé", k=max(1, length + rng.randint(-2, 2)))) for _ in range(4)))
        tokens = {"zzz", "ab"}
        for t in terms:
            for _ in range(6):
                u = list(t)
                for _ in range(rng.randint(0, 3)):
                    i = rng.randrange(len(u) + 1)
                    u[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
                tokens.add("".join(u))
        tokens = sorted(tokens - {""})
        near = {t: min(((edits(t, w), k) for k, w in enumerate(terms) if edits(t, w) <= toxicity.tolerance(w)), default=None) for t in tokens}
        assert toxicity.automaton_matches(toxicity.Trie.of(terms), terms, tokens) == {t: x[::-1] for t, x in near.items() if x}


def test_long_words_and_quoting_through_the_query(spark, tmp_path):
    """Toxic texts with words of 140 and 3,000 characters; clean texts that report the same words."""
    rng = random.Random(9)
    plain = ["".join(rng.choices("klmnoprst", k=5)) for _ in range(300)]
    bad = ["q" * 140, "zix" * 1000, "vugged", "hurbed"]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(plain, k=30)
        kind = 0 if i % 3 == 0 else 1 if i % 12 == 1 else 2
        if kind == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        elif kind == 1:
            for b in rng.choices(bad, k=2):
                w[rng.randrange(len(w)) : 0] = ["hemeld", f'"{b}"', "skirt"]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(kind == 0)))
    documents(spark, str(tmp_path), rows)
    table(spark, str(tmp_path), "labels", labels, "doc_id long, quality int, toxic int")
    got = registry.QUERIES["op3_toxicity"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    toxic, quoted = got[got.doc_id % 3 == 0], got[got.doc_id % 12 == 1]
    assert (toxic.predicted == 1).mean() > 0.95 and (quoted.predicted == 0).mean() > 0.95
    assert quoted.quoted.mean() > 0.5 > 0.2 > toxic.quoted.mean() and (quoted.n_matches > 0).mean() > 0.9


def test_audit_steps():
    steps = filter_audit.order_steps()
    assert len(steps) == 600 and len(set(steps)) == 600 and all(bin(a ^ b).count("1") == 1 for *_, a, b in steps)
    assert hashlib.sha256("".join(s[0] for s in steps[::5]).encode()).hexdigest() == hashlib.sha256("".join("".join(p) for p in permutations("ABCDE")).encode()).hexdigest()


ITEM = "A wooden plank of {a} is sawn into pieces of {b} each, so how many whole pieces does the carpenter get from it at last?"


@pytest.mark.parametrize("a,b,found", [("4 cm", "9 cm", True), ("11cm", "13cm", True), ("11CM", "13 CM", True), ("7,5kg", "2.5 kg", True), ("11cm", "13km", False), ("4cm", "4cm", False), ("x11cm", "y13cm", False)])
@pytest.mark.parametrize("item", [("4 cm", "9 cm"), ("4cm", "9cm")])
def test_units_written_to_the_number(spark, a, b, found, item):
    """Numbers and units are slots however they are written; equal values do not stand for different ones."""
    items = spark.createDataFrame([(1, ITEM.format(a=item[0], b=item[1]))], "item_id long, text string")
    docs = make(spark, [(5, "They sat down. " + ITEM.format(a=a, b=b) + " Nobody knew.", "en", "s"), (6, "Nothing of the kind was asked here at 4 cm.", "en", "s")])
    got = {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == ({5} if found else set())
