"""The Merkle manifest against a plain recomputation."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node int, _metadata string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    parts = (None if v is None else str(v) for v in (row[f] for f in FIELDS))
    return digest("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def climb(nodes):
    """The root over a list of nodes and, for each, the (before, after) pairs on its way."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, places):
            first = at // 16 * 16
            path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
        places = [at // 16 for at in places]
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest(rows, changed):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(changed(r))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s])]) for s in names]
    root, crowns = climb([t[0] for t in trees])
    out = []
    for name, (subroot, paths), crown in zip(names, trees, crowns):
        for (known, doc_id, own, other), path in zip(sorted(groups[name]), paths):
            node = other
            for before, after in path + crown:
                node = digest(before + node + after)
            proof = digest("".join(b + a for b, a in path + crown))
            out.append((doc_id if known else None, own, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def lowered(row):
    tampered = row["doc_id"] is not None and row["doc_id"] % 3 == 0 and row["text"] is not None
    return {**row, "text": row["text"].lower()} if tampered else row


def check(df):
    found = merkle.merkle_manifest(
        df, FIELDS, "source", "doc_id", {"text": F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))}
    )
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == manifest([r.asDict() for r in df.collect()], lowered)
    return got


@pytest.mark.parametrize("fanout_blocks", [(1, 16), (2, 256)])
def test_against_plain_trees(spark, monkeypatch, fanout_blocks):
    """A hot source over several rounds with a last group cut short, lone leaves, many sources, NULLs, ties and repeats."""
    inner, block = fanout_blocks
    monkeypatch.setattr(merkle, "INNER", inner)
    monkeypatch.setattr(merkle, "BLOCK", block)
    row = lambda i, s, t="Some Text": (i, s, "en", None, t, "x", 1, "m")
    hot = [row(i, "hot", f"Text {i}") for i in range(4500 if inner == 2 else 1100)]
    sizes = {"a": 1, "b": 16, "c": 17, "d": 256, "e": 257, "Z": 2, "é": 3, "": 5, None: 4}
    some = [row(10_000 + i, s, f"{s} Ünï {i}") for s, n in sizes.items() for i in range(n)]
    lone = [row(i, f"s{i}") for i in range(20)]
    odd = [row(None, "odd"), row(None, None), row(7, "odd", None), row(7, "odd", ""), row(7, "odd", "T"), row(7, "odd", "T"),
           row(2**60 + 1, "odd", "Long " * 50_000)]
    got = check(spark.createDataFrame(hot + some + lone + odd, SCHEMA).repartition(7))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, None, None, None, "T", None, None, None)], SCHEMA)
    (only,) = check(one)
    assert only[1] == only[2] == only[3]
    assert merkle.merkle_manifest(one.where("false"), FIELDS, "source", "doc_id").count() == 0
