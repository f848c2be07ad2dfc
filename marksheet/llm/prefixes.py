"""All prefixes of conversations as a trie, by SQL ROLLUP over positional columns of turn ids.

Turns become fixed-size ids.  A conversation is laid out in blocks of ``BLOCK`` positions, one row a
block with a column for each position; a block is keyed by the node that the blocks before it lead
to, a sum of hashes of (position, turn id), so all blocks of all conversations are rolled up at once,
however long they are.  ROLLUP over the position columns aggregates every prefix that ends in a block;
grouping_id tells how many positions a group has.  Counts over subtrees come from a second ROLLUP of
the same rows: every node's value is given to its smallest member, which is a member of all nodes
above it, and a group sums what its members hold at its depth or below.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.llm.common import Scratch
from marksheet.plans.skew import HOT_ROWS, hot_keys, row_number_by, running_totals

BLOCK = 8
SHARED, MOST_SHARED = 5, 9      # conversations that share a base; bound of the turns they share
IDS = 1 << 12                   # conversation ids in one sorted list


def _numbered(turns: DataFrame, hot_rows: int) -> DataFrame:
    """conv, pos (from 0), turn: the turn's 16-byte id and, behind it, the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    known = turns.select("conv", "at", F.concat(F.base64(F.unhex(F.substring(digest, 1, 32))),
                                                F.octet_length(text).cast("string")).alias("turn"))
    return row_number_by(known, ["conv"], ["at", "turn"], "row", hot_rows).select("conv", (F.col("row") - 1).alias("pos"), "turn")


def _shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Numbered turns (conv, pos, turn) as the contract rebuilds them; a null turn keeps a conversation without any.

    Conversation c starts with the first h turns of c - c % 5 and goes on with its own after its first h.
    """
    base = F.col("conv") - F.col("conv") % SHARED
    # What others may take over: at most eight turns of every fifth conversation.
    bases = scratch.keep(turns.filter((base == F.col("conv")) & (F.col("pos") < MOST_SHARED - 1)).select(
        F.col("conv").alias("base"), F.col("pos").alias("from"), "turn"), "bases")
    lengths = bases.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    convs = turns.filter("pos = 0").select("conv", base.alias("base"), _shared_turns(F.col("conv")).alias("h"))
    taken = convs.join(bases, "base").filter(F.col("from") < F.col("h")).select("conv", F.col("from").alias("pos"), "turn")
    own = turns.select("conv", "pos", "turn", base.alias("base"), _shared_turns(F.col("conv")).alias("h")).filter("pos >= h")
    found = F.least(F.coalesce("n", F.lit(0).cast("long")), F.col("h"))
    own = own.join(scratch.keep(lengths, "lengths"), "base", "left").select("conv", (F.col("pos") - F.col("h") + found).alias("pos"), "turn")
    empty = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("turn"))
    return taken.unionByName(own).unionByName(empty)


def _marks(pos: Column, turn: Column) -> list[Column]:
    """Four 32-bit hashes of a turn at its position; zeros for none."""
    found = [F.xxhash64(pos.cast("long"), turn, F.lit(salt)) for salt in (0, 1)]
    halves = [half for x in found for half in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    return [F.when(turn.isNull(), F.lit(0).cast("long")).otherwise(half) for half in halves]


KEY = [f"k{i}" for i in range(4)]
TURNS = [f"t{i}" for i in range(BLOCK)]


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def blocks(turns: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """conv, block, k0..k3 (the node before the block), t0..t7 (turn ids, null beyond the end)."""
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    laid = turns.select("conv", block.alias("block"), (F.col("pos") % BLOCK).alias("at"), "turn").groupBy("conv", "block").agg(
        *[F.max(F.when(F.col("at") == i, F.col("turn"))).alias(t) for i, t in enumerate(TURNS)])
    marks = [_marks(F.col("block") * BLOCK + i, F.col(t)) for i, t in enumerate(TURNS)]
    laid = laid.select("*", *[_sum([m[i] for m in marks]).alias(f"own{i}") for i in range(4)])
    own = [f"own{i}" for i in range(4)]
    if hot_keys(laid, ["conv"], hot_rows).isEmpty():
        before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        keys = [F.coalesce(F.sum(o).over(before), F.lit(0).cast("long")).alias(k) for o, k in zip(own, KEY)]
        return laid.select("conv", "block", *keys, *TURNS)
    summed = running_totals(laid, ["block"], dict(zip(KEY, own)), ["conv"])
    return summed.select("conv", "block", *[(F.col(k) - F.col(o)).alias(k) for o, k in zip(own, KEY)], *TURNS)


def _rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    """``aggregates`` of every prefix in every block, with ``level``, the positions of the block that it has.

    Groups of conversations that end earlier, and those of no position but the root's, are left out.
    """
    by = ", ".join(["block", *KEY])
    found = rows.sparkSession.sql(
        f"SELECT {by}, {', '.join(TURNS)}, {BLOCK} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{rows}} GROUP BY {by}, ROLLUP({', '.join(TURNS)})", rows=rows)
    last = F.element_at(F.array(*[F.col(t) for t in TURNS]), F.greatest(F.col("level"), F.lit(1)).cast("int"))
    return found.withColumn("last", last).filter((F.col("level") > 0) & F.col("last").isNotNull() | (F.col("level") == 0) & (F.col("block") == 0))


def _node(upto: int) -> Column:
    """depth and hash of the node of a rolled-up group, or of its parent (``upto`` -1)."""
    reached = F.col("level") + upto
    marks = [_marks(F.col("block") * BLOCK + i, F.when(F.lit(i) < reached, F.col(t))) for i, t in enumerate(TURNS)]
    parts = [(F.col(k) + _sum([m[i] for m in marks])).alias(k) for i, k in enumerate(KEY)]
    return F.struct((F.col("block") * BLOCK + reached).alias("depth"), *parts)


def _nodes(rows: DataFrame) -> DataFrame:
    """node, parent (null for the root), depth, conv_id, n_convs, saved (the node's own)."""
    size = F.substring(F.col("last"), 25, 20).cast("long")
    top = (F.col("block") == 0) & (F.col("level") == 0)
    return _rolled(rows, "min(conv) AS conv_id, count(1) AS n_convs").select(
        _node(0).alias("node"), F.when(~top, _node(-1)).alias("parent"), "conv_id", "n_convs",
        F.when(top, F.lit(0).cast("long")).otherwise((F.col("n_convs") - 1) * size).alias("saved"))


def _below(rows: DataFrame, nodes: DataFrame, scratch: Scratch, hot_rows: int) -> DataFrame:
    """node, n_leaves, saved_tokens: sums over the subtree of every node."""
    depth = F.col("node.depth")
    at = F.greatest(depth - 1, F.lit(0))
    gains = nodes.filter("saved > 0").select(F.col("conv_id").alias("conv"), F.floor(at / BLOCK).cast("long").alias("block"),
                                             (at % BLOCK).alias("at"), "saved")
    gains = gains.groupBy("conv", "block").agg(*[F.coalesce(F.sum(F.when(F.col("at") == i, F.col("saved"))), F.lit(0)).cast("long").alias(f"g{i}")
                                                 for i in range(BLOCK)], F.sum("saved").cast("long").alias("gain"))
    leaves = nodes.filter("leaf").select(F.col("conv_id").alias("conv")).distinct()
    # Only conversations that are the smallest of some node hold a value.
    held = scratch.keep(gains.select("conv").withColumn("leaf", F.lit(0)).union(leaves.withColumn("leaf", F.lit(1)))
                        .groupBy("conv").agg(F.max("leaf").alias("leaf")), "holders")
    laid = scratch.keep(rows.join(held, "conv").join(gains, ["conv", "block"], "left").fillna(0, ["gain", *[f"g{i}" for i in range(BLOCK)]]), "held")
    if hot_keys(laid, ["conv"], hot_rows).isEmpty():
        after = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        laid = laid.withColumn("later", F.coalesce(F.sum("gain").over(after), F.lit(0).cast("long")))
    else:
        back = running_totals(laid.withColumn("back", -F.col("block")), ["back"], {"later": "gain"}, ["conv"])
        laid = back.withColumn("later", F.col("later") - F.col("gain"))
    suffix = [_sum([F.col("later"), *[F.col(f"g{j}") for j in range(i, BLOCK)]]).alias(f"s{i + 1}") for i in range(BLOCK)]
    laid = laid.select("block", *KEY, *TURNS, "leaf", *suffix)
    sums = ", ".join(f"sum(s{i}) AS s{i}" for i in range(1, BLOCK + 1))
    level = F.greatest(F.col("level"), F.lit(1)).cast("int")    # a root holds nothing itself
    return _rolled(laid, f"sum(leaf) AS n_leaves, {sums}").select(
        _node(0).alias("node"), "n_leaves", F.element_at(F.array(*[F.col(f"s{i}") for i in range(1, BLOCK + 1)]), level).alias("saved_tokens"))


def _ends(rows: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes where conversations end.

    Ids are joined in sorted lists of one range of ids each.  A digest is made by a single reader of a
    node's lists, in order, and holds one list at a time.
    """
    level = _sum([F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in TURNS])
    ended = rows.withColumn("level", level).select("conv", _node(0).alias("node")).groupBy("conv").agg(F.max("node").alias("node"))
    lists = ended.groupBy("node", F.floor(F.col("conv") / IDS).alias("range")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    schema = T.StructType([lists.schema["node"], T.StructField("ends_sha256", T.StringType())])

    def run(batches):
        node, digest = None, None
        for batch in batches:
            nodes, digests = [], []
            for now, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if digest is None or now != node:
                    if digest is not None:
                        nodes.append(node)
                        digests.append(digest.hexdigest())
                    node, digest = now, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field("node").type), pa.array(digests, pa.string())],
                                             names=["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], batch.schema.field("node").type), pa.array([digest.hexdigest()], pa.string())],
                                             names=["node", "ends_sha256"])

    return lists.repartition("node").sortWithinPartitions("node", "range").mapInArrow(run, schema)


def trie(turns: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per node over positioned turns (conv, pos, turn): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, node and parent (their hashes)."""
    rows = scratch.keep(blocks(turns, hot_rows), "blocks")
    plain = scratch.keep(_nodes(rows), "nodes")
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    children = plain.filter("parent is not null").select(F.col("parent").alias("node"), one.alias("n"))
    counted = scratch.keep(plain.select("node", zero.alias("n")).union(children).groupBy("node").agg(F.sum("n").alias("n_children")), "children")
    nodes = scratch.keep(plain.join(counted, "node").withColumn("leaf", F.col("n_children") == 0), "numbered_nodes")
    scratch.drop(plain, counted)
    below = scratch.keep(_below(rows, nodes, scratch, hot_rows), "below")
    ends = scratch.keep(_ends(rows), "ends")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    scratch.only(nodes, below, ends)
    return (nodes.join(below, "node").join(ends, "node", "left").join(above, "parent", "left")
            .select("conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
                    "node", "parent"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", share: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The trie of all conversations: one row per distinct sequence of first turns, the root included.

    Turns are ordered by ``turn_col`` (null first), equal ones by a digest of role and text; null roles
    and texts are empty.  With ``share`` conversations first take over the first turns of another
    (``rebuilt``).  Rows without a conversation id belong to no conversation and are left out.  Repeated
    rows are repeated turns.  An empty table gives no node, not even a root.  Columns of other names are
    ignored.  Conversations over ``hot_rows`` turns are numbered and summed in pieces.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("at"), F.col(role_col).alias("role"),
                                 F.col(text_col).alias("text")).filter("conv is not null")
    numbered = scratch.keep(_numbered(turns, hot_rows), "turns")
    return trie(scratch.keep(rebuilt(numbered, scratch), "rebuilt") if share else numbered, scratch, hot_rows)
