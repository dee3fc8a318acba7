"""Benchmark decontamination by winnowing: which words of which documents also stand in benchmark items.

Words are runs of ASCII letters and digits and of all other characters, A-Z lowered. Every run of ``GRAM`` words is hashed;
in each window of ``SPAN`` words the least hash is kept (the first of equal ones), so two texts that share ``SPAN`` words keep
the same run of them. Runs kept in documents are joined with those kept in items, compared word by word, and extended to
both sides as far as a window of ``SPAN`` words that holds the run can reach; shared stretches of ``SPAN`` words and more are hit.
That finds every shared stretch of this length and nothing shorter. An item of fewer words is one window, found by its first word
and then compared whole.

Runs of items are joined together with the words around them, once for all items in which they stand alike, and the items
of a document are looked up once for all documents with the same set of them. Copies of a text are joined as one. Texts
are not shuffled: with kept runs of items that Spark finds small enough to broadcast, a document's runs meet them in the scan;
otherwise the runs are shuffled with the few words around them. DataFrame functions only.

NULL and empty texts have no words and no hits; items without words are ignored, NULL item ids are listed as empty text and
rows with one item id are one item; repeated documents get a row each; an empty benchmark contaminates nothing; other
columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import own_names, stored

#: Words of a window: the shortest shared stretch that counts.
SPAN = 10
#: Words of a hashed run, and how many of them lie in a window.
GRAM = 7
RUNS = SPAN - GRAM + 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The low bits of a hash make room for the place of a run within its window.
_PLACE = 7


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word_count(text: Column) -> Column:
    """How many words there are; A-Z need not be lowered for that."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def _kept_runs(texts: DataFrame, *columns: str) -> DataFrame:
    """The kept runs of each text: columns, pos, run (hash), lead (words before it that are given), near (words around it)."""
    # Short texts get empty arrays instead of a filter, which Spark would push below and cut all words twice for.
    long = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    get = lambda a, i: F.get(F.col(a), i)
    places = lambda a, less: F.slice(F.sequence(F.lit(0), F.size(a)), F.lit(1), F.greatest(F.size(a) - less + 1, F.lit(0)))
    runs = F.transform(
        places("hashes", GRAM),
        lambda i: F.xxhash64(*[get("hashes", i + j) for j in range(GRAM)]).bitwiseAND(F.lit(~_PLACE).cast("long")),
    )
    long = long.withColumn("runs", runs)
    least = F.transform(places("runs", RUNS), lambda i: F.least(*[get("runs", i + j) + F.lit(j) for j in range(RUNS)]))
    long = long.withColumn("least", least)
    place = lambda i: i + get("least", i).bitwiseAND(F.lit(_PLACE).cast("long"))
    first = F.filter(places("least", 1), lambda i: (i == 0) | (place(i) != place(i - 1)))
    kept = long.select(*columns, "words", "least", F.explode(first).alias("i"))
    kept = kept.select(*columns, "words", place(F.col("i")).cast("int").alias("pos"), get("least", F.col("i")).alias("run"))
    reach = SPAN - GRAM
    lead = F.least(F.col("pos"), F.lit(reach))
    near = F.slice("words", F.col("pos") - lead + 1, lead + GRAM + reach)
    run = F.col("run").bitwiseAND(F.lit(~_PLACE).cast("long"))
    return kept.select(*columns, "pos", run.alias("run"), lead.alias("lead"), near.alias("near"))


def _equal_beside(step: int) -> Column:
    """How many words next to the run are equal in document and item, on one side."""
    edge = 0 if step < 0 else GRAM - 1
    word = lambda side, j: F.get(F.col(f"{side}near"), F.col(f"{side}lead") + edge + step * j)
    count, so_far = F.lit(0), F.lit(True)
    for j in range(1, SPAN - GRAM + 1):
        so_far = so_far & F.coalesce(word("", j) == word("item_", j), F.lit(False))
        count = count + so_far.cast("int")
    return count


def _long_hits(texts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shared stretches (key, start, end, spot) and the items of each spot, an item's run with the words around it."""
    spot = F.sha2(F.concat_ws(" ", F.col("lead").cast("string"), "near"), 256)
    spots = stored(_kept_runs(items, "item_id").withColumn("spot", spot).select("item_id", "spot", "run", "lead", "near"), "leak-spots")
    distinct = spots.select("spot", "run", F.col("lead").alias("item_lead"), F.col("near").alias("item_near")).dropDuplicates(["spot"])
    met = _kept_runs(texts, "key").join(stored(distinct, "leak-runs"), "run")
    same = F.slice("near", F.col("lead") + 1, GRAM) == F.slice("item_near", F.col("item_lead") + 1, GRAM)
    met = met.where(same).select("key", "pos", "spot", _equal_beside(-1).alias("left"), _equal_beside(1).alias("right"))
    met = met.where(F.col("left") + F.col("right") >= SPAN - GRAM)
    hits = met.select("key", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + GRAM - 1 + F.col("right")).alias("end"), "spot")
    return hits, spots.select("spot", "item_id").distinct()


def _short_hits(texts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for items of fewer than ``SPAN`` words."""
    whole = F.array_join("words", " ")
    short = items.where((F.size("words") > 0) & (F.size("words") < SPAN))
    short = short.select("item_id", F.col("words")[0].alias("head"), F.size("words").alias("size"), whole.alias("whole"))
    short = stored(short.withColumn("spot", F.sha2("whole", 256)), "leak-short")
    heads = stored(short.select("head", "size").distinct(), "leak-heads")  # nine sizes for each word at most
    at = texts.select("key", "words", F.posexplode("words").alias("start", "head"))
    at = at.select("key", "start", "head", F.slice("words", F.col("start") + 1, SPAN - 1).alias("next"))
    begun = at.join(heads, "head").where(F.size("next") >= F.col("size"))
    begun = begun.select("key", "start", "size", F.array_join(F.slice("next", F.lit(1), F.col("size")), " ").alias("whole"))
    found = begun.join(stored(short.select("whole", "spot").distinct(), "leak-wholes"), "whole")
    return found.select("key", "start", (F.col("start") + F.col("size") - 1).alias("end"), "spot"), short.select("spot", "item_id").distinct()


def shared_stretches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches of words (key, start, end, spot) that documents share with items, and the items (spot, item_id).

    ``key`` is the sha256 of a document's text, ``start`` and ``end`` are numbers of words, from 0.
    """
    items = own_names(benchmark, item_id="item_id", text="text")
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words"))
    texts = own_names(docs, text="text").where("text <> ''").select(F.sha2("text", 256).alias("key"), words_of(F.col("text")).alias("words"))
    parts = [_long_hits(texts, items)]
    if items.where((F.size("words") > 0) & (F.size("words") < SPAN)).limit(1).count():
        parts.append(_short_hits(texts, items))
    hits = reduce(DataFrame.union, [h for h, _ in parts]).distinct()
    return stored(hits, "leak-hits"), stored(reduce(DataFrame.union, [s for _, s in parts]), "leak-items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits, spots = shared_stretches(docs, benchmark)
    ordered = Window.partitionBy("key").orderBy("start", "end")  # the stretches of one text
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, F.coalesce(reached, F.lit(-1))))
    covered = hits.select("key", "start", "end").distinct().select("key", fresh.alias("fresh")).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    sets = hits.groupBy("key").agg(F.sort_array(F.collect_set("spot")).alias("spots"))
    sets = stored(sets.withColumn("set", F.sha2(F.concat_ws("", "spots"), 256)), "leak-sets")
    named = sets.dropDuplicates(["set"]).select("set", F.explode("spots").alias("spot")).join(spots, "spot").select("set", "item_id").distinct()
    named = named.groupBy("set").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    named = named.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = stored(covered.join(sets.select("key", "set"), "key").join(named, "set").drop("set"), "leak-found")
    rows = own_names(docs, doc_id="doc_id", text="text").select("doc_id", F.sha2("text", 256).alias("key"), word_count(F.col("text")).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
