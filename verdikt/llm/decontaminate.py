"""Benchmark decontamination by template canonicalisation (DataFrame operations only).

A text becomes a template: numbers, names (capitalised words, but for usual starts of
sentences) and units turn into typed placeholders, the rest is lower-cased and stripped of punctuation. Windows of ``window`` template
tokens are hashed and hash-joined with those of the benchmark, which catches questions
asked again with other numbers or names. The placeholders' own values travel with a
window; an occurrence of an item in a document counts where one value of the item always
stands for one value of the document, and the other way round (slot consistency). Two
occurrences, as windows that an item repeats, may differ in their values.

Reported are pairs whose matching windows cover at least ``coverage`` of the item's
tokens. A window with placeholders is also matched by its own words, so a plain copy
matches whatever it holds. Placeholders alone say nothing: as a template a window needs
a plain word, and the run of windows it stands in ``min_words`` of them. A text of fewer tokens than a window is one window; it matches whole
texts of as many tokens.

Scale: most documents are ruled out by single words, without a template. A match misses at
most a share of 1 - ``coverage`` of the item's tokens, so of its rarest plain words, ``TELLING``
more than that, the document holds ``TELLING``: a first pass joins the words of all documents
with those and counts. Only documents found there get templates and windows. An item with too
few plain words for one more is looked for in all documents. Texts are read twice and never shuffled. The windows of
the benchmark are broadcast when counted at ``max_broadcast`` rows at most, else both sides
are shuffled by window hash, where Spark splits skewed partitions. Hits are written and
grouped by document, item and offset; what is grouped is bounded by an item's length and the
number of its occurrences.

Defined cases: null and empty texts and items match nothing; rows of equal doc_id are
one document; items of equal text are each reported; a null doc_id or item_id is
kept as a value; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, bounded_broadcast, documents, written

#: Between a placeholder and the value it stands for; a control character that texts' tokens lose.
MARK = "\u0001"
NAME = f"<name>{MARK}"
PLACEHOLDER = f"<(?:name|num|unit)>{MARK}"
UNITS = (
    "km|m|cm|mm|mi|miles?|feet|foot|ft|inch(?:es)?|yards?|kilomet(?:er|re)s?|met(?:er|re)s?|centimet(?:er|re)s?|"
    "kg|g|mg|kilograms?|grams?|lbs?|pounds?|ounces?|oz|tons?|tonnes?|l|ml|lit(?:er|re)s?|gallons?|"
    "seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|degrees?|mph|km/h|watts?|volts?"
)
NUMBER = r"[+\-]?[$€£]?[0-9][0-9.,:/]*%?"
#: Capitalised at the start of a sentence, and no names.
STARTS = (
    "The|An?|This|That|These|Those|There|Then|If|In|On|At|It|Its|Is|Are|Was|Were|He|She|They|We|You|His|Her|Their|How|What|Which|Who|When|Where|Why|"
    "Find|Compute|Calculate|Convert|Solve|Give|Given|Suppose|Let|Each|Every|After|Before|For|From|And|But|So|By|To|Of|With|As|One|Two|Three|Four|Five"
)
BLANK = r"[\x20\x09-\x0D]"
#: Punctuation and symbols but for < and >, as ranges, which the matcher tests fastest.
PUNCTUATION = r"[!-/:;=?@\[-`{-~\u0080-©«-±´¶-¸»¿×÷‐-⯿　-〿]"


def template(text: Column) -> Column:
    """Placeholders carry their value behind MARK; white space stays as it is."""
    t = F.replace(text, F.lit(MARK), F.lit(" "))
    # a name is a capitalised word anywhere, but for the words that sentences often begin with
    t = F.regexp_replace(t, rf"(\p{{Lu}}(?<![\p{{L}}\p{{N}}'’]\p{{Lu}})(?<!(?=(?:{STARTS})(?![\p{{L}}'’]))\p{{Lu}})[\p{{Ll}}'’]+)(?![\p{{L}}\p{{N}}])", f"{NAME}$1")
    # a unit counts as one right after a number; one that touches it is parted from it
    n = F.regexp_replace(t, rf"(?i)(?<![\p{{L}}\p{{N}}{MARK}])({NUMBER})({UNITS})(?![\p{{L}}\p{{N}}])", "$1 $2")
    n = F.regexp_replace(n, rf"(?i)(?<=[0-9])({BLANK}*)\b({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 <unit>{MARK}$2")
    n = F.regexp_replace(n, rf"(?<![\p{{L}}\p{{N}}{MARK}])({NUMBER})(?![\p{{L}}\p{{N}}])", f"<num>{MARK}$1")
    t = F.when(text.rlike("[0-9]"), n).otherwise(t)
    # punctuation at either end of a token; a token of nothing else vanishes
    t = F.regexp_replace(t, rf"{PUNCTUATION}++(?={BLANK}|$)|(^|{BLANK}){PUNCTUATION}++", "$1")
    return F.lower(F.btrim(t, F.lit(" \t\n\x0b\f\r")))


def _tokens(rows: DataFrame, ids: list[str]) -> DataFrame:
    return rows.select(*ids, F.split(template(F.coalesce("text", F.lit(""))), SPACE).alias("tokens"))


#: What stands between the letters and digits that make a bare word.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Words of an item that a document must hold to be looked at; fewer where the item has no more.
TELLING = 6


def _telling(items: DataFrame, coverage: float) -> DataFrame:
    """(item_id, text, key, need, words): an item's rarest plain words and how many places, by
    their weights, a match holds at least; null if the item has too few."""
    items = items.withColumn("key", F.xxhash64("item_id", "text"))
    tokens = _tokens(items, ["key"])
    misses = F.size("tokens") - F.ceil(coverage * F.size("tokens"))
    spots = tokens.select("key", misses.alias("misses"), F.posexplode("tokens").alias("pos", "token"))
    # of a token with marks inside, the longest part speaks for it
    part = F.array_max(F.transform(F.split("token", BETWEEN), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    spots = spots.filter(~F.col("token").contains(MARK)).withColumn("word", part).filter("word <> ''").distinct()
    of = spots.groupBy("word").agg(F.count_distinct("key").alias("of"))
    rank = F.row_number().over(W.partitionBy("key").orderBy("of", F.char_length("word").desc(), "pos"))
    told = spots.join(of, "word").withColumn("r", rank).filter(F.col("r") <= F.col("misses") + TELLING)
    told = told.groupBy("key", "misses", "word").agg(F.count(F.lit(1)).alias("weight")).groupBy("key", "misses")
    told = told.agg(F.collect_list(F.struct("word", "weight")).alias("words"), F.sum("weight").alias("n"))
    told = told.select("key", (F.col("n") - F.col("misses")).alias("need"), "words").filter("need > 0")
    return items.join(told, "key", "left")


def _holding(docs: DataFrame, telling: DataFrame, max_broadcast: int) -> DataFrame:
    """(d): doc_ids of the documents that hold as many of an item's words as a match does."""
    words = telling.select("key", "need", F.inline("words")).distinct()
    own = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), BETWEEN))).alias("word"))
    held = own.join(bounded_broadcast(words, max_broadcast), "word").groupBy("doc_id", "key").agg(F.sum("weight").alias("n"), F.first("need").alias("need"))
    return written(held.filter("n >= need").select(F.col("doc_id").alias("d")).distinct())


def windows(rows: DataFrame, ids: list[str], window: int, min_words: int, places: bool = False) -> DataFrame:
    """(ids, n, pos, h, plain, strong, slots, words): the hashed windows.

    Every window comes with its own words (plain), and one with placeholders comes as a
    template too if it has a plain word, and as one with its names for words; slots are
    the placeholders' values, null if there are none, words the places of plain words (if asked for), and strong says if a
    window counts by itself.

    Tokens are taken by index, as slicing an array costs its whole length each time.
    """
    tokens = _tokens(rows, ids)
    marked = F.exists("tokens", lambda t: t.contains(MARK))

    def told(f) -> Column:
        return F.when(marked, F.transform("tokens", lambda t: F.when(t.contains(MARK), f(t)).otherwise(t))).otherwise(F.col("tokens"))

    both = tokens.select(
        *ids, "tokens", marked.alias("marked"), F.size("tokens").alias("n"),
        told(lambda t: F.substring_index(t, MARK, 1)).alias("kinds"),
        told(lambda t: F.regexp_replace(t, PLACEHOLDER, "")).alias("values"),
        told(lambda t: F.substring_index(F.replace(t, F.lit(NAME), F.lit("")), MARK, 1)).alias("nameless"),
    )
    length = F.least(F.lit(window), F.col("n"))

    def held(i: Column) -> Column:
        slots = F.filter(F.array(*[F.get("tokens", i + k) for k in range(window)]), lambda t: t.contains(MARK))
        return F.struct(i.alias("pos"), F.when(F.col("marked"), slots).alias("slots"))

    def forms(w: Column) -> Column:
        pos, slots = w["pos"], w["slots"]
        free = slots.isNull() | (F.size(slots) == 0)
        values = F.filter(slots, lambda t: ~t.contains(NAME))

        def form(tokens: str, plain: bool, strong: Column, slots: Column = slots, kept: str | None = None) -> Column:
            h = F.xxhash64(*[F.get(tokens, pos + k) for k in range(window)])
            made = [pos.alias("pos"), h.alias("h"), F.lit(plain).alias("plain"), strong.alias("strong"), slots.alias("slots")]
            words = F.filter(F.sequence(pos, pos + length - 1), lambda p: ~F.get("tokens", p).contains(MARK) | (F.get("tokens", p).contains(kept) if kept else F.lit(False)))
            return F.struct(*made, words.alias("words")) if places else F.struct(*made)

        as_words = form("values", True, free)
        enough = F.least(F.lit(min_words), F.col("n"))
        as_template = F.array(form("kinds", False, length - F.size(slots) >= enough))
        as_template = F.when(F.size(slots) < length, as_template).otherwise(F.slice(as_template, 1, 0))
        # names as words, so that those of other case match where numbers were changed
        as_nameless = F.array(form("nameless", False, length - F.size(values) >= enough, values, NAME))
        mixed = (F.size(values) > 0) & (F.size(values) < F.size(slots))
        return F.when(free, F.array(as_words)).when(mixed, F.concat(F.array(as_words), as_template, as_nameless)).otherwise(F.concat(F.array(as_words), as_template))

    spots = F.when(F.get("tokens", F.lit(0)) != "", F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - window)))
    return both.select(*ids, "n", F.inline(F.flatten(F.transform(F.transform(spots, held), forms))))


def _consistent(slots: Column) -> Column:
    """One value of the item stands for one value of the document, and the other way round."""
    a, b = F.array_distinct(F.transform(slots, lambda s: s["a"])), F.array_distinct(F.transform(slots, lambda s: s["b"]))
    return (F.size(slots) == F.size(a)) & (F.size(slots) == F.size(b))


def _changed(slots: Column) -> Column:
    return F.exists(slots, lambda s: ~s["a"].eqNullSafe(s["b"]))


def _covered(at: Column, window: int) -> Column:
    return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, F.least(p + window, F.col("item_n")) - 1))))


def _slots(pairs: Column) -> Column:
    """Distinct value pairs of all slots."""
    return F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.arrays_zip(p["item_slots"].alias("a"), p["slots"].alias("b")))))


def _aligned(hits: DataFrame, window: int, coverage: float, min_words: int) -> DataFrame:
    """(doc_id, item_id, item_n, covered, changed): the best occurrence of each pair.

    Hits of one offset of the item in the document are a run. A run takes in others
    within an item's length or two that agree with its values, longest first, as text put
    in or left out shifts the rest; what disagrees belongs to another occurrence. Templates count where the
    run covers min_words plain words.
    """
    ids = ["doc_id", "item_id", "item_n"]
    exact = F.when(F.col("plain"), F.col("item_pos"))
    runs = hits.groupBy(*ids, (F.col("pos") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set("item_pos").alias("at"), F.collect_set("pair").alias("pairs"), F.collect_set("words").alias("words"),
        F.collect_set(exact).alias("exact"), F.collect_set(F.when(F.col("plain"), F.col("pair"))).alias("own"),
    )
    enough = F.size(F.array_distinct(F.flatten("words"))) >= F.least(F.lit(min_words), F.col("item_n"))
    at, pairs = F.when(enough, F.col("at")).otherwise(F.col("exact")), F.when(enough, F.col("pairs")).otherwise(F.col("own"))
    runs = runs.select(*ids, "offset", F.struct(_covered(at, window).alias("c"), _slots(pairs).alias("s")).alias("run"))
    # overlapping blocks of offsets, each two item's lengths: what belongs together meets in one
    block = F.floor(F.col("offset") / F.col("item_n"))
    near = runs.filter(_consistent(F.col("run.s"))).withColumn("block", F.explode(F.array(block, block - 1)))
    near = near.groupBy(*ids, "block").agg(F.collect_list("run").alias("runs"))
    near = near.filter(F.size(F.array_distinct(F.flatten("runs.c"))) >= coverage * F.col("item_n"))
    near = near.withColumn("runs", F.reverse(F.array_sort(F.transform("runs", lambda r: F.struct(F.size(r["c"]).alias("n"), r["c"].alias("c"), r["s"].alias("s"))))))

    def taken(seed: Column) -> Column:
        def add(own: Column, r: Column) -> Column:
            s = F.array_union(own["s"], r["s"])
            return F.when(_consistent(s), F.struct(F.array_union(own["c"], r["c"]).alias("c"), s.alias("s"))).otherwise(own)

        return F.aggregate("runs", F.struct(seed["c"].alias("c"), seed["s"].alias("s")), add)

    made = F.transform(F.transform("runs", taken), lambda r: F.struct(_changed(r["s"]).alias("changed"), (-F.size(r["c"])).alias("less")))
    found = near.select(*ids, F.inline(made)).filter(-F.col("less") >= coverage * F.col("item_n"))
    return found.groupBy(*ids).agg(F.min(F.struct("changed", "less")).alias("k")).select(*ids, (-F.col("k.less")).alias("covered"), F.col("k.changed").alias("changed"))


def _scattered(hits: DataFrame, window: int, coverage: float) -> DataFrame:
    """The same for an item whose parts lie anywhere in the document, if all hits agree."""
    ids = ["doc_id", "item_id", "item_n"]
    found = hits.groupBy(*ids).agg(F.collect_set("item_pos").alias("at"), F.collect_set("pair").alias("pairs"))
    found = found.select(*ids, F.size(_covered(F.col("at"), window)).alias("covered"), _slots(F.col("pairs")).alias("slots"))
    found = found.filter((F.col("covered") >= coverage * F.col("item_n")) & _consistent(F.col("slots")))
    return found.select(*ids, "covered", _changed(F.col("slots")).alias("changed"))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, min_words: int, max_broadcast: int) -> DataFrame:
    """Windows of documents that match windows of items."""
    items = windows(benchmark, ["item_id"], window, min_words, places=True).drop("strong")
    items = items.withColumnsRenamed({"n": "item_n", "pos": "item_pos", "slots": "item_slots"})
    own = windows(docs, ["doc_id"], window, min_words)
    own = own.select("doc_id", F.col("n").alias("doc_n"), "pos", "slots", "strong", "h", F.col("plain").alias("doc_plain"))
    # words match words, with the item's values on both sides, and templates match templates
    hits = own.join(bounded_broadcast(items, max_broadcast), "h").filter(F.col("plain") == F.col("doc_plain"))
    # a short item is a window of its own length: it matches whole texts only
    hits = hits.filter((F.col("item_n") >= window) | (F.col("item_n") == F.col("doc_n")))
    theirs = F.when(F.col("plain"), F.col("item_slots")).otherwise(F.col("slots"))
    pair = F.when(F.size("item_slots") > 0, F.struct("item_slots", theirs.alias("slots")))
    return written(hits.select("doc_id", "item_id", "item_n", "pos", "item_pos", "plain", "strong", "words", pair.alias("pair")))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.8, min_words: int = 3, max_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_tokens, covered, coverage, reparameterised) of each document and benchmark item that match."""
    docs = docs.select(docs["doc_id"], docs["text"])
    benchmark = written(_telling(benchmark.select(benchmark["item_id"], benchmark["text"]), coverage))
    told, dense = (benchmark.filter(f"words IS {n} NULL").select("item_id", "text") for n in ("NOT", ""))
    found = bounded_broadcast(_holding(docs, benchmark, max_broadcast), max_broadcast)
    hits = _hits(docs.join(found, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi"), told, window, min_words, max_broadcast)
    if not dense.isEmpty():
        hits = hits.unionByName(_hits(docs, dense, window, min_words, max_broadcast))
    found = _aligned(hits, window, coverage, min_words).unionByName(_scattered(hits.filter("strong"), window, coverage))
    found = found.groupBy("doc_id", "item_id", "item_n").agg(F.min(F.struct("changed", (-F.col("covered")).alias("less"))).alias("k"))
    n, covered = F.col("item_n").cast("long"), (-F.col("k.less")).cast("long")
    return found.select("doc_id", "item_id", n.alias("n_tokens"), covered.alias("covered"), (covered / n).alias("coverage"), F.coalesce("k.changed", F.lit(False)).alias("reparameterised"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
