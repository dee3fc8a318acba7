"""A Merkle manifest of a table: every row's hash, the root over all rows and each row's proof.

A row's leaf is the sha256 of its named fields (``-`` for NULL, else byte count, ``:`` and value). Within a group leaves
stand in order, and runs of ``FANOUT`` nodes are hashed into one until a single subroot is left; the subroots in order of
their groups, NULL first, give the root the same way.

Butterfly exchange: leaves are cut into aligned blocks of ``BLOCK``, whose lower levels are hashed on the spot. Then, round
by round, the ``FANOUT`` neighbours that differ in one digit of the block number swap the roots of the subtrees they have
so far, and every block hashes the next ancestor itself. After the last round each block holds the siblings of its whole
way up; nothing is passed down. A last group that is cut short has fewer blocks than the others; they answer in turn for
the missing ones, so that no block serves more than its share. Places within a group come from the order of rows in written
files and the counts of those files, so a group of any size is never gathered.

Only 64-character hashes are shuffled, never the fields. NULL groups are a group, NULL order values come first, repeated rows
are leaves of their own (ties stand in order of their hash), an empty table has no rows in its manifest. Other columns, of
any name, are ignored. A proof is folded from ``changed`` leaves, where given, so tampering shows as another root.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import fresh_path, stored

FANOUT = 16
#: Levels hashed within a block, and the leaves of a block.
INNER = 2
BLOCK = FANOUT**INNER
_STEP = "array<struct<before:string,after:string>>"


def row_hash(fields: Sequence[Column]) -> Column:
    """sha256 in lower-case hex over fields that say their own length, so no two rows read alike."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _joined(nodes: Column) -> Column:
    return F.concat_ws("", nodes)


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``at``, their place within ``tree``, and ``n``, the rows of the tree.

    Rows are written in order; a tree's rows in one file follow each other, so a file's counts give all places.
    """
    path = fresh_path(rows.sparkSession, "merkle-order")
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    # The columns are this module's own, so ``_metadata`` cannot clash.
    written = written.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    lead = F.min(F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))]))
    runs = written.groupBy("tree", "file").agg(F.min("row").alias("first"), F.count("*").alias("here"), lead.alias("lead"))
    files = Window.partitionBy("tree")  # one row for each file that holds rows of the tree
    before = F.coalesce(F.sum("here").over(files.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "file", (before - F.col("first")).alias("shift"), F.sum("here").over(files).alias("n"))
    return written.join(runs, ["tree", "file"]).withColumn("at", F.col("row") + F.col("shift")).drop("file", "row", "shift")


def _levels(n: Column) -> Column:
    """How often runs of 16 are hashed until one node is left: the hex digits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.hex(n - 1)))


def _above(nodes: Column) -> Column:
    last = F.floor((F.size(nodes) - 1) / FANOUT)
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.sha2(_joined(F.slice(nodes, i * FANOUT + 1, FANOUT)), 256))


def _step(nodes: Column, i: Column) -> Column:
    """Siblings of node ``i`` within its run: the hashes before it and those after it."""
    run = F.slice(nodes, i - i % FANOUT + 1, FANOUT)
    return F.struct(
        _joined(F.slice(run, F.lit(1), i % FANOUT)).alias("before"), _joined(F.slice(run, i % FANOUT + 2, FANOUT)).alias("after")
    )


def _blocks(rows: DataFrame, order: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """One row per block: its members in order, its lower levels and the root of its subtree."""
    member = F.struct((F.col("at") % BLOCK).cast("int").alias("slot"), "node", *kept)
    blocks = _placed(rows, order).withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block")
    out = blocks.agg(F.sort_array(F.collect_list(member)).alias("members"), F.max("n").alias("n"))
    out = out.withColumn("levels", _levels(F.col("n"))).withColumn("level0", F.col("members.node"))
    for k in range(1, INNER + 1):
        out = out.withColumn(f"level{k}", F.when(F.col("levels") >= k, _above(F.col(f"level{k - 1}"))).otherwise(F.col(f"level{k - 1}")))
    blocks_of_tree = F.floor((F.col("n") - 1) / BLOCK) + 1
    return out.withColumn("blocks", blocks_of_tree).withColumn("top", F.col(f"level{INNER}")[0])


def _exchange(state: DataFrame, stride: int) -> DataFrame:
    """One round: blocks whose numbers differ in one digit swap the roots of their subtrees of ``stride`` blocks."""
    at, last = F.floor(F.col("block") / stride), F.floor((F.col("blocks") - 1) / stride)
    first = at - at % FANOUT
    asked = state.where(F.col("blocks") > stride).select(
        "tree", "block", "blocks", F.explode(F.sequence(first, F.least(first + FANOUT - 1, last))).alias("group")
    )
    size = F.least(F.lit(stride), F.col("blocks") - F.col("group") * stride)
    peer = F.col("group") * stride + F.col("block") % stride % size
    asked = asked.select("tree", "block", "group", peer.alias("peer"))
    heard = asked.join(state.select("tree", F.col("block").alias("peer"), "top"), ["tree", "peer"])
    met = heard.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("group", "top"))).alias("met"))
    own = (at % FANOUT).cast("int")
    nodes = F.col("met.top")
    joined = state.join(met, ["tree", "block"], "left")
    climbed = F.col("met").isNotNull()
    return joined.select(
        "tree", "block", "blocks",
        F.when(climbed, F.sha2(_joined(nodes), 256)).otherwise(F.col("top")).alias("top"),
        F.when(climbed, F.concat("up", F.array(_step(nodes, own)))).otherwise(F.col("up")).alias("up"),
    )


def _forest(rows: DataFrame, order: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Blocks of all trees with the siblings of their way up (``up``) and the root of their tree (``subroot``)."""
    blocks = stored(_blocks(rows, order, kept), "merkle-blocks")
    state = blocks.select("tree", "block", "blocks", "top", F.array().cast(_STEP).alias("up"))
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    stride = 1
    while stride < most:
        state = stored(_exchange(state, stride), "merkle-round")
        stride *= FANOUT
    return blocks.drop("top", "blocks").join(state.select("tree", "block", F.col("top").alias("subroot"), "up"), ["tree", "block"])


def _paths(forest: DataFrame, above: Column | None = None) -> DataFrame:
    """The members of all blocks, each with the siblings of its way up."""

    def path(member: Column) -> Column:
        inner = [
            F.when(F.col("levels") > k, F.array(_step(F.col(f"level{k}"), F.floor(member["slot"] / FANOUT**k).cast("int"))))
            .otherwise(F.array().cast(_STEP)) for k in range(INNER)
        ]
        return F.concat(*inner, F.col("up"), *([] if above is None else [above]))

    return forest.withColumn("members", F.transform("members", lambda m: F.struct(m.alias("m"), path(m).alias("path"))))


def merkle_manifest(
    rows: DataFrame, fields: Sequence[str], group: str, order: str, changed: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per row: ``order`` column, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` replaces fields by expressions over the row; the proof of the original row is then folded from the leaf of
    the changed one.
    """
    original = [F.col(f"`{f}`") for f in fields]
    tampered = [(changed or {}).get(f, F.col(f"`{f}`")) for f in fields]
    name = F.col(f"`{group}`").cast("string")
    leaves = rows.select(
        F.when(name.isNull(), "-").otherwise(F.concat(F.lit("v"), name)).alias("tree"),  # NULL first, then by bytes
        F.col(f"`{order}`").alias("order"), row_hash(original).alias("node"), row_hash(tampered).alias("changed"),
    )
    forest = _forest(leaves, ["order", "node"], ["order", "changed"])
    subroots = forest.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node"))
    crown = _paths(_forest(subroots, ["name", "node"], ["name"])).select(F.col("subroot").alias("root"), F.explode("members").alias("x"))
    crown = stored(crown.select(F.col("x.m.name").alias("tree"), "root", F.col("x.path").alias("above")), "merkle-crown")

    def answer(x: Column) -> Column:
        siblings = F.transform(x["path"], lambda s: F.concat(s["before"], s["after"]))
        folded = F.aggregate(x["path"], x["m"]["changed"], lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
        return F.struct(
            x["m"]["order"].alias(order), x["m"]["node"].alias("leaf"), F.sha2(_joined(siblings), 256).alias("proof_sha256"),
            folded.alias("folded_root"),
        )

    found = _paths(forest.join(crown, "tree"), F.col("above")).select(
        "subroot", "root", F.explode(F.transform("members", answer)).alias("a")
    )
    return found.select(
        F.col(f"a.{order}").alias(order), "a.leaf", "subroot", "root", "a.proof_sha256", "a.folded_root",
        (F.col("a.folded_root") == F.col("root")).alias("verified"),
    )
