"""Prefix trie of conversations by block digests.

A conversation is a sequence of turns, each the MD5 of its role and text. Blocks are ``BLOCK`` successive turns, the last of
a conversation perhaps fewer; a block's digest is the MD5 of the digest of the block before and of its turns, so it stands
for the whole sequence up to its end. Conversations are grouped by those digests first, which leaves one row a distinct
block, with its members counted before anything is shuffled. Where all that follows a block is one block, the nodes at the
turns inside have the members of that block and need no digests. Only where blocks follow that differ are their turns
digested and grouped, one row a distinct block again, not one a conversation.

Sums over subtrees take no walk over the tree. Each node belongs to its smallest member, its owner; a conversation owns
the nodes from some depth on to its end. The turns before that depth are its shared ones, and what a subtree saves is the
code points its members share inside it: the same grouping by block digests, over that number. Leaves are counted as the
members that own one.

A conversation is sorted by its rows' order and read as a stream, a block at a time; ids that end at a node are sorted by
range, packed, and hashed as a stream: nothing of a node or a conversation is gathered, however common it is. Joins in
which a node with very many children or members is a key have its single row on the other side, which lets Spark split them.

Edge cases: rows without ``conv_id`` are left out; null role or text is empty; rows of one turn come by role, then by the
MD5 of the text (null turns first), equal ones one after the other; other columns are not read; an empty table has no
node, not even a root; negative ids have the base that lies towards 0.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemesh.llm.streams import streamed
from tastemesh.sources.staging import stage

BLOCK, PACK = 4, 4096
HEAD, FAMILY = 6, 100  # of a conversation's checksum; of ids that share a base
ROOT = bytes(16)
_DIGEST = 16


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``digest`` and ``chars`` of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), _md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations, in the order of ``pos``; and all ids, with whether one has no turns.

    A conversation takes its first turns, up to ``HEAD`` - 1 by its checksum, from the first of its family.
    """
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own, first = _taken(), F.expr(f"conv_id - conv_id % {FAMILY}")
    heads = turns.where((F.col("pos") < HEAD) & (F.col("conv_id") == first)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    plan = stage(
        ids.select("conv_id", "n", own.alias("h"), first.alias("base")).join(heads, "base", "left")
        .select("conv_id", "n", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h")).alias("head")),
        "heads")
    rows = plan.select("conv_id", F.inline("head")).unionByName(turns.where(F.col("pos") > own))
    return rows, plan.select("conv_id", ((F.size("head") == 0) & (F.col("n") <= F.col("h"))).alias("turnless"))


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of sequences ``turns`` (``conv_id``, ``pos``, ``digest``, ``chars``) of the conversations ``ids``
    (``conv_id``, ``turnless``): ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``."""
    spark = turns.sparkSession
    columns = "conv_id long, start long, parent binary, node binary, turns binary, chars array<long>, before long, last boolean"
    ordered = turns.select("conv_id", "pos", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    blocks = stage(streamed(ordered, lambda conv_id: _Blocks(conv_id, block), columns), "blocks")
    content = ("start", "parent", "turns", "chars", "before")
    distinct = stage(
        blocks.groupBy("node").agg(
            *(F.first(c).alias(c) for c in content), F.count("*").alias("n"), F.min("conv_id").alias("owner"),
            F.sum(F.col("last").cast("long")).alias("n_end")), "distinct-blocks")
    lone = distinct.groupBy("parent").agg(F.count("*").alias("following"), F.first(F.struct(
        "node", *(c for c in distinct.columns if c not in ("node", "parent")))).alias("it")).where("following = 1").select("parent", "it.*")
    lone = stage(lone, "lone-blocks")
    forked = distinct.join(lone.select("node"), "node", "left_anti")
    # Nodes inside lone blocks have no digest but a name of their own, and no parent to look up after the first.
    along = _each_turn(lone).select(
        F.when(F.col("j") == F.size("chars"), F.col("node")).otherwise(_md5(F.concat("node", F.col("j").cast("string").cast("binary")))).alias("node"),
        F.when(F.col("j") == 1, F.col("parent")).alias("parent"), "depth", "at", "j", F.col("node").alias("block"),
        _sum(F.slice("chars", F.col("j"), F.size("chars") - F.col("j") + 1)).alias("rest"), F.size("chars").alias("length"),
        "n", "owner", F.when(F.col("j") == F.size("chars"), F.col("n_end")).otherwise(0).alias("n_end"))
    refined = stage(
        _each_turn(forked).select("*", _prefix(F.col("j")).alias("here"))
        .groupBy("here").agg(
            F.first("parent").alias("parent"), F.first(F.substring("turns", F.lit(1), _DIGEST * F.col("j"))).alias("turns"), F.first("j").alias("j"),
            F.first("depth").alias("depth"), F.first("at").alias("at"), F.first(F.get("chars", F.col("j") - 1)).alias("own_chars"),
            F.sum("n").alias("n"), F.min("owner").alias("owner"),
            F.sum(F.when(F.col("j") == F.size("chars"), F.col("n_end")).otherwise(0)).alias("n_end")), "refined")
    shares, totals = _shares(blocks, along.select("owner", "depth", "at", "n", "n_end").unionByName(refined.select("owner", "depth", "at", "n", "n_end")))
    sums = stage(shares, "block-sums")
    straight = along.join(sums, along["block"] == sums["node"]).select(
        along["node"], "parent", "depth", "owner", "n", "leaves", (F.col("after") + (F.col("n") - 1) * F.col("rest")).alias("saved"),
        (F.col("j") < F.col("length")).cast("long").alias("inner"))
    below = _each_turn(forked.join(sums, "node")).groupBy(_prefix(F.col("j")).alias("here")).agg(F.sum("leaves").alias("leaves"), F.sum("after").alias("after"))
    within = (
        refined.select("parent", "turns", F.explode(F.sequence(F.lit(1), "j")).alias("j"), ((F.col("n") - 1) * F.col("own_chars")).alias("saved"))
        .groupBy(_prefix(F.col("j")).alias("here")).agg(F.sum("saved").alias("saved")))
    branched = refined.join(below, "here").join(within, "here").select(
        F.col("here").alias("node"), F.when(F.col("j") == 1, F.col("parent")).otherwise(_prefix(F.col("j") - 1)).alias("parent"), "depth", "owner", "n",
        "leaves", (F.col("after") + F.col("saved")).alias("saved"), F.lit(0).cast("long").alias("inner"))
    n, least = ids.agg(F.count("*"), F.min("conv_id")).first()
    saved, leaves = totals.agg(F.sum("shared"), F.sum("leaf")).first()
    top = spark.createDataFrame(
        [(bytearray(ROOT), None, 0, least, n, leaves or 1, saved or 0, 0)] if n else [],
        "node binary, parent binary, depth long, owner long, n long, leaves long, saved long, inner long")
    nodes = stage(straight.unionByName(branched).unionByName(top), "nodes")
    return _described(nodes, _ends(blocks, ids))


class _Blocks:
    """Cuts one conversation, turn by turn, into blocks."""

    def __init__(self, conv_id, size: int):
        self.conv_id, self.size = conv_id, size
        self.start, self.parent, self.before = 0, ROOT, 0
        self.turns, self.chars = b"", []

    def row(self, pos, digest, chars) -> None:
        if len(self.chars) == self.size:
            self._close(False)
        self.turns += digest
        self.chars.append(chars)

    def _close(self, last: bool) -> None:
        node = hashlib.md5(self.parent + self.turns).digest()
        self.out.append((self.conv_id, self.start, self.parent, node, self.turns, self.chars, self.before, last))
        self.before += sum(self.chars)
        self.start, self.parent = self.start + len(self.chars), node
        self.turns, self.chars = b"", []

    def finish(self) -> None:
        self._close(True)


class _Packed:
    """Ids of one node, in order, as text in rows of ``PACK`` ids."""

    def __init__(self, node):
        self.node, self.first, self.ids = node, None, []

    def row(self, conv_id) -> None:
        if len(self.ids) == PACK:
            self.finish()
        if not self.ids:
            self.first = conv_id
        self.ids.append(str(conv_id))

    def finish(self) -> None:
        self.out.append((self.node, self.first, ",".join(self.ids)))
        self.ids = []


class _Hashed:
    """The hash of one node's packed ids."""

    def __init__(self, node):
        self.node, self.hash, self.any = node, hashlib.sha256(), False

    def row(self, first, ids) -> None:
        self.hash.update(("," * self.any + ids).encode())
        self.any = True

    def finish(self) -> None:
        self.out.append((self.node, self.hash.hexdigest()))


def _taken() -> Column:
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD


def _md5(of: Column) -> Column:
    return F.unhex(F.md5(of))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _prefix(j: Column) -> Column:
    """The digest of the sequence up to the ``j``-th turn of a block."""
    return _md5(F.concat("parent", F.substring("turns", F.lit(1), _DIGEST * j)))


def _each_turn(blocks: DataFrame) -> DataFrame:
    """A row for each turn ``j`` of the blocks, with its depth and the code points ``at`` which it begins."""
    rows = blocks.select("*", F.explode(F.sequence(F.lit(1), F.size("chars"))).alias("j"))
    return rows.select("*", *(x.alias(y) for x, y in (
        (F.col("start") + F.col("j"), "depth"), (F.col("before") + _sum(F.slice("chars", F.lit(1), F.col("j") - 1)), "at"))))


def _shares(blocks: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By block, the leaves below and the code points that members share after it (``after``); and by conversation,
    ``shared`` code points and whether it owns a ``leaf``."""
    owners = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min(F.struct("depth", "at")).alias("first"), F.max((F.col("n") == F.col("n_end")).cast("long")).alias("leaf"))
    end = F.col("before") + _sum(F.col("chars"))
    whole = blocks.where("last").select("conv_id", end.alias("whole"))
    totals = stage(
        whole.join(owners, "conv_id", "left").select(
            "conv_id", F.coalesce("first.at", "whole").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "shared-turns")
    sums = blocks.select("conv_id", "node", end.alias("end")).join(totals, "conv_id").groupBy("node").agg(
        F.sum("leaf").alias("leaves"), F.sum(F.greatest(F.lit(0).cast("long"), F.col("shared") - F.col("end"))).alias("after"))
    return sums, totals


def _ends(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """``node``, ``ends_sha256`` of the nodes at which conversations end."""
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = blocks.where("last").select("node", "conv_id").unionByName(
        ids.where("turnless").select(F.lit(bytearray(ROOT)).alias("node"), "conv_id"))
    sorted_ends = ends.repartitionByRange(partitions, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    packed = streamed(sorted_ends, _Packed, "node binary, first long, ids string")
    return streamed(packed.repartition("node").sortWithinPartitions("node", "first"), _Hashed, "node binary, ends_sha256 string")


def _described(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with their parents' owners, their children counted and their ends."""
    owners = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    known = nodes.where("parent IS NULL").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("owner")))
    nodes_up = nodes.where("parent IS NOT NULL").join(owners, "parent").select(known.columns).unionByName(known)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    return nodes_up.join(children, "node", "left").join(ends, "node", "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        (F.coalesce("children", F.lit(0)) + F.col("inner")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
