"""Near-duplicate detection with circulant MinHash.

A text's set holds its distinct shingles of five lower-cased words. Two random permutations of a universe of
``UNIVERSE`` places give all signature coordinates: the first scatters the shingles, the second, shifted circularly by
k, gives coordinate k as the smallest place that any shingle takes. Bands of the signature propose candidates, and a
link is confirmed by the Jaccard similarity of the full sets, in whole numbers.

Equal sets are one node, whatever the number of their rows. Within a bucket no pairs are enumerated at first: each node
is compared with two hubs, the nodes that are most often the smallest and the largest of its buckets and so share most
bands with it. The confirmed links give components.
Where a bucket still holds several, its nodes are compared with the bucket's smallest and largest node. The nodes of
buckets that are still in different components after that are compared where they share one of the rare shingles that
a link cannot do without. So a group of thousands of copies costs two comparisons per copy, a passage that unlike texts
share costs few, and no link between nodes of one bucket is left out. Components come from repeated hooking of larger
nodes to smaller ones in distributed tables.

With BANDS bands of ROWS rows a pair of similarity s becomes a candidate with probability 1 - (1 - s**ROWS)**BANDS:
0.99998 at 0.75.

Cases: NULL, empty and blank texts have an empty set and link with nothing; with fewer than five words the whole
sequence is the one shingle; repeated rows share a node; rows with a NULL id take part, but the id of a component is
the smallest that is known; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tablewright.llm.common import as_kind, as_text, ascii_words, own_names, prepare, stored

SHINGLE = 5
ROWS = 5
BANDS = 40
UNIVERSE = 1 << 20
#: Shingles whose signature rows are gathered at once (ROWS * BANDS * 4 bytes each).
GATHER = 1 << 12
#: Most frequent shingles of a comparison that are ordered by frequency (8 bytes each); all others go before them.
FREQUENT = 1 << 17
#: Numbers of 64 bits in the sketch of a set, a power of two.
SKETCH = 4
#: Similarity of a link as a fraction.
NUMERATOR, DENOMINATOR = 75, 100


def multiplier(i: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a word sequence's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    key = np.full(n, width, np.uint64)
    for j in range(width):
        key += h[j : j + n] * multiplier(2 * j + 1)
    return np.unique(mixed(key))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and every circular window of the second that coordinates need."""
    random = np.random.default_rng(20240229)
    first = random.permutation(UNIVERSE).astype(np.uint32)
    second = random.permutation(UNIVERSE).astype(np.uint32)
    width = ROWS * BANDS
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: width - 1]]), width)


def signature(keys: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    places = first[(keys & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    best = windows[places[:GATHER]].min(axis=0)
    for i in range(GATHER, len(places), GATHER):
        np.minimum(best, windows[places[i : i + GATHER]].min(axis=0), out=best)
    return best


def band_keys(sign: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for equal rows in different bands."""
    rows = sign.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * multiplier(3)
    for j in range(ROWS):
        key = mixed(key + rows[:, j] * multiplier(2 * j + 5))
    return key.view(np.int64)


def set_digest(keys: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    a = int(np.bitwise_xor.reduce(mixed(keys + multiplier(7))))
    b = int(np.add.reduce(mixed(keys + multiplier(9))))
    return a.to_bytes(8, "big") + (b ^ len(keys)).to_bytes(8, "big")


def sign_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first, windows = permutations()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            keys = shingles(ascii_words(text))
            if len(keys):
                rows.append((doc_id, len(keys), set_digest(keys), band_keys(signature(keys, first, windows))))
            else:
                rows.append((doc_id, 0, None, None))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "node", "bands"])


def set_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = [shingles(ascii_words(t)) for t in batch["text"]]
        yield pd.DataFrame({"node": batch["node"], "keys": [k.tobytes() for k in keys]})


@F.pandas_udf(T.BooleanType())
def linked(one: pd.Series, other: pd.Series) -> pd.Series:
    def alike(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            return False
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int((b[at] == a).sum())
        return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)

    return pd.Series([alike(x, y) for x, y in zip(one, other)], dtype=bool)


def close_sizes(a: str, b: str):
    """Sets of a link differ in size by the similarity at most."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough; ``texts``: one text for each node."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(texts.join(wanted, "node", "left_semi").mapInPandas(set_of, "node binary, keys binary"), "sets")
    one, other = (sets.select(F.col("node").alias(x), F.col("keys").alias(f"keys_{x}")) for x in "ab")
    return stored(pairs.join(one, "a").join(other, "b").where(linked("keys_a", "keys_b")).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node reached."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # Large star: neighbours that are larger than a node hook to the smallest that it knows, itself included.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours hook to the smallest of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = stored(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept."""
    prepare(docs.sparkSession)
    docs = own_names(docs, doc_id=doc_id, text=text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = as_text(docs).mapInPandas(sign_texts, "doc_id string, n long, node binary, bands array<long>")
    signed = stored(as_kind(signed, kind), "signed")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"))
    nodes = stored(nodes, "nodes")
    placed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("low"), F.max("node").alias("high")).where("nodes > 1")
    buckets = stored(placed.join(shared, "bucket"), "buckets")
    size = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"))

    def sized(star: DataFrame) -> DataFrame:
        """Distinct pairs of a node and another one, b, that their sizes allow to be links."""
        pairs = star.where("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        return pairs.join(size, "b").join(size.toDF("a", "na"), "a").where(close_sizes("na", "nb")).select("a", "b")

    hubs = buckets.groupBy("node").agg(F.mode("low", True).alias("low"), F.mode("high", True).alias("high"))
    tried = stored(sized(hubs.select("node", F.explode(F.array("low", "high")).alias("b"))), "pairs")
    # One text for each node in a shared bucket, through any row that has its set.
    owner = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "n")
    texts = stored(one_text(docs, signed, owner), "texts")
    links = confirmed(tried, texts)
    roots = components(links)
    # The ends of buckets that still hold several components, for nodes of other components than theirs.
    member = members(buckets, roots)
    ends = member.groupBy("bucket").agg(
        F.min_by("root", "node").alias("low_root"), F.max_by("root", "node").alias("high_root"), (F.min("root") != F.max("root")).alias("open")
    ).where("open").drop("open")
    end = F.explode(F.array(F.struct(F.col("low").alias("b"), F.col("low_root").alias("r")), F.struct(F.col("high").alias("b"), F.col("high_root").alias("r"))))
    star = member.join(ends, "bucket").select("node", "root", end.alias("e")).where("root <> e.r").select("node", F.col("e.b").alias("b"))
    more = stored(sized(star).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        tried, links = tried.union(more), links.union(confirmed(more, texts))
        roots = components(links)
        member = members(buckets, roots)
    # What the stars left: nodes of buckets that hold different components, by the rare shingles that a link must share.
    open_buckets = member.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("bucket")
    open_nodes = stored(member.join(open_buckets, "bucket", "left_semi").select("node", "n", "root").distinct(), "open")
    rest = stored(sharing_rare(open_nodes, texts).join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = components(links.union(confirmed(rest, texts)))
    return assigned(signed, nodes, roots)


def sharing_rare(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, n, root) of different components that have a shingle in common among their first.

    With all shingles in one order, two sets of na and nb that share at least k = 3/7 (na + nb) shingles, as links do,
    share one of the first na - k + 1 of one and the first nb - k + 1 of the other. The order is rare before frequent,
    so what a group of texts has in common proposes no pair unless it is most of them. Any order loses no link:
    shingles beyond the FREQUENT most frequent go by hash.

    Sets of a link differ in at most 1/7 (na + nb) shingles. Each set has a sketch of SKETCH * 64 parities, and two sketches
    differ in no more places than their sets do: what differs in more is no link. Of two components with a shingle in common,
    the nodes of the one with fewer such nodes are put beside the other, so a large group of copies costs a row for each other node.
    """
    spark = nodes.sparkSession
    sets = stored(texts.join(nodes, "node").mapInPandas(long_sets, "node binary, n long, root binary, keys array<long>"), "sets")
    often = sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > 2)
    often = often.orderBy(F.desc("nodes"), "key").limit(FREQUENT).select("key").toPandas()
    rank = spark.sparkContext.broadcast(often["key"].to_numpy(np.int64)[::-1].copy())
    marks = [f"m{i}" for i in range(SKETCH)]
    kind = "node binary, n long, root binary, key long, place long, " + ", ".join(f"{m} long" for m in marks)
    first = stored(sets.mapInPandas(rare_first(rank), kind), "first")
    split = first.groupBy("key").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("key")
    first = stored(first.join(split, "key", "left_semi"), "first")
    alone = [F.min(m).alias(m) for m in marks]  # used of groups of one node
    groups = first.groupBy("key", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("place"), F.count(F.lit(1)).alias("size"), *alone)
    groups = stored(groups, "groups")

    def reaches(place: str, most: str, other: str):
        """The place is among the first of a set of this size that a link to a set of the other size needs."""
        return F.col(place) <= F.col(most) - F.ceil((F.col(most) + F.col(other)) * NUMERATOR / (NUMERATOR + DENOMINATOR) - 1e-9) + 1

    def alike(na: str, nb: str):
        """The sketches x and y differ in no more places than linked sets of these sizes may."""
        differ = sum(F.bit_count(F.col(f"{m}_x").bitwiseXOR(F.col(f"{m}_y"))) for m in marks)
        return differ * (DENOMINATOR + NUMERATOR) <= (F.col(na) + F.col(nb)) * (DENOMINATOR - NUMERATOR)

    def named(df: DataFrame, end: str) -> DataFrame:
        return df.select("key", *[F.col(c).alias(f"{c}_{end}") for c in df.columns if c != "key"])

    sizes = (F.col("most_x") * DENOMINATOR >= F.col("least_y") * NUMERATOR) & (F.col("most_y") * DENOMINATOR >= F.col("least_x") * NUMERATOR)
    fewer = (F.col("size_x") < F.col("size_y")) | (F.col("size_x") == F.col("size_y")) & (F.col("root_x") < F.col("root_y"))
    across = named(groups, "x").join(named(groups, "y"), "key").where((F.col("root_x") != F.col("root_y")) & fewer & sizes)
    across = across.where(reaches("place_x", "most_x", "least_y") & reaches("place_y", "most_y", "least_x"))
    across = across.where((F.col("size_y") > 1) | alike("most_x", "most_y")).select("key", "root_x", "root_y", "least_y", "most_y", F.col("place_y").alias("first_y"))
    one, other = named(first, "x"), named(first, "y")
    few = across.join(one, ["key", "root_x"]).where(
        (F.col("n_x") * DENOMINATOR >= F.col("least_y") * NUMERATOR) & (F.col("most_y") * DENOMINATOR >= F.col("n_x") * NUMERATOR)
        & reaches("place_x", "n_x", "least_y") & reaches("first_y", "most_y", "n_x")
    )
    pairs = few.join(other, ["key", "root_y"]).where(
        close_sizes("n_x", "n_y") & reaches("place_x", "n_x", "n_y") & reaches("place_y", "n_y", "n_x") & alike("n_x", "n_y")
    )
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def long_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = [shingles(ascii_words(t)).view(np.int64) for t in batch["text"]]
        yield pd.DataFrame({"node": batch["node"], "n": batch["n"], "root": batch["root"], "keys": keys})


def sketch(keys: np.ndarray) -> list[int]:
    """SKETCH numbers whose bits say whether an odd number of the keys falls on each place."""
    place = mixed(keys.view(np.uint64) + multiplier(11)) & np.uint64(64 * SKETCH - 1)
    odd = np.bincount(place.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def rare_first(rank):
    """The shingles of each set, rare ones first, as far as any link can need: (node, n, root, key, place from 1, its set's sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = rank.value
        by_key = np.argsort(frequent, kind="stable")
        ordered = frequent[by_key]
        for batch in batches:
            for node, n, root, keys in zip(batch["node"], batch["n"], batch["root"], batch["keys"]):
                keys = np.asarray(keys, np.int64)
                at = np.searchsorted(ordered, keys)
                at[at == len(ordered)] = 0
                found = ordered[at] == keys if len(ordered) else np.zeros(len(keys), bool)
                order = np.lexsort((keys, np.where(found, by_key[at] if len(ordered) else 0, -1)))
                needed = len(keys) - -(-len(keys) * NUMERATOR // DENOMINATOR) + 1
                marks = {f"m{i}": m for i, m in enumerate(sketch(keys))}
                own = {"node": [node] * needed, "n": n, "root": [root] * needed}
                yield pd.DataFrame({**own, "key": keys[order[:needed]], "place": np.arange(1, needed + 1), **marks})

    return run


def members(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of every bucket with the component that each is in so far."""
    rooted = buckets.select("bucket", "node", "n", "low", "high").join(roots, "node", "left")
    return stored(rooted.withColumn("root", F.coalesce("root", "node")), "members")


def one_text(docs: DataFrame, signed: DataFrame, owner: DataFrame) -> DataFrame:
    """(node, text) of one row for each node; rows without an id, or that share one, are found by their set again."""
    by_id = signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    plain = owner.join(by_id.where("rows = 1"), "doc_id").select("doc_id", "node")
    found = docs.where("doc_id IS NOT NULL").join(plain, "doc_id").select("node", "text")
    other = owner.join(plain.select("node"), "node", "left_anti")
    if other.isEmpty():
        return found
    again = docs.join(by_id.where("rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("i")), F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    again = again.select("text").mapInPandas(name_set, "node binary, text string").join(other.select("node"), "node", "left_semi")
    return found.union(again.groupBy("node").agg(F.min("text").alias("text")))


def name_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = [shingles(ascii_words(t)) for t in batch["text"]]
        yield pd.DataFrame({"node": [set_digest(k) if len(k) else None for k in keys], "text": batch["text"]})


def assigned(signed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = rooted.join(named, "root").select("node", "component_id")
    out = signed.select("doc_id", "n", "node").join(component, "node", "left")
    name = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("doc_id") == name, name.isNull()).alias("kept")
    )
