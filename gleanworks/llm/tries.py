"""Conversation prefix trie by family-first merging (operator 12).

Every conversation c is rebuilt: the first h turns of its base c - c % 5, then its own turns behind its first h, with h =
crc32(c) % 9. A distinct sequence of first d rebuilt turns (role, text) is a node.

Rows are dealt by base id, as slim digests without texts, and one sorted pass over a partition is the cogroup of each
base with its conversations: it keeps the base's first eight turns and one running digest, rebuilds, and builds the
family's small trie. Only the combined nodes of families are shuffled, to be merged by their digest (128 bits
of the whole sequence). A family larger than FAMILY nodes hands its nodes on in parts, which the merge combines, too.

No level of the trie is walked. Of a node's members the smallest owns it; along a conversation, what it does not own
is a prefix, because fewer members share each deeper node. So once each conversation knows how deep that prefix
is (its fate), every sum over a subtree is a sum over members: saved bytes of the subtree of u are, for each member, the
bytes between u and the end of its unowned prefix; leaves are members that own a childless end; children are members
that own the node behind u. All of these are aggregates with partial sums, whatever a node's number of members.

Defined results: null role or text is empty; null turn comes first, equal turns in the order of role and then of the
digest of role and text; repeated rows are turns each; remainders of negative ids are negative, as in SQL. Rows without
a conv_id belong to no conversation and make no node; an empty table has no nodes, not even a root. Texts of any
length; other columns are ignored. A node's ids are hashed as a stream in ascending order, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import looked_up, materialize

#: Conversations of a family have ids that differ by less than this.
SPAN = 5
#: No conversation takes this many turns or more of its base.
LONGEST = 9
#: Nodes of a family that are combined before they are handed on.
FAMILY = 50_000
#: Ids in one piece of a node's list of ends.
CHUNK = 50_000
ROOT = bytes(16)
NODES = "base long, node binary, depth long, bytes long, upto long, members array<long>, ends array<long>"
SCHEMA = pa.schema([
    ("base", pa.int64()), ("node", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("upto", pa.int64()), ("members", pa.list_(pa.int64())),
    ("ends", pa.list_(pa.int64()))
])


class Family:
    """The trie of one family while its conversations pass by, one after the other and turn by turn."""

    def __init__(self, base: int, most: int = FAMILY) -> None:
        self.base, self.most, self.prefix = base, most, []
        self.nodes: dict[bytes, list] = {}
        self.parts: list[tuple] = []
        self.conv: int | None = None

    def begin(self, conv: int, skip: int) -> None:
        self.conv, self.skip, self.seen = conv, skip, 0
        self.node, self.depth, self.upto = ROOT, 0, 0
        self._enter(0)
        if conv != self.base:
            for digest, size in self.prefix[:skip]:
                self._step(digest, size)

    def turn(self, digest: bytes, size: int) -> None:
        """One of the conversation's own turns, in order."""
        if self.conv == self.base:
            if len(self.prefix) < LONGEST - 1:
                self.prefix.append((digest, size))
        elif self.seen < self.skip:
            self.seen += 1
            return
        if len(self.nodes) >= self.most:  # the node that follows is the one that the conversation may end at
            self.parts += self.taken()
        self._step(digest, size)

    def end(self) -> None:
        if self.conv is not None:
            self.nodes[self.node][4].append(self.conv)
            self.conv = None

    def _step(self, digest: bytes, size: int) -> None:
        self.node = hashlib.blake2b(self.node + digest, digest_size=16).digest()
        self.depth += 1
        self.upto += size
        self._enter(size)

    def _enter(self, size: int) -> None:
        found = self.nodes.get(self.node)
        if found is None:
            self.nodes[self.node] = found = [self.depth, size, self.upto, [], []]
        found[3].append(self.conv)

    def taken(self) -> list[tuple]:
        """The nodes so far, which are let go of."""
        rows = self.parts + [(self.base, node, *rest) for node, rest in self.nodes.items()]
        self.nodes, self.parts = {}, []
        return rows


def _families(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the families of a partition, whose rows come by base, conversation (the base first) and turn."""
    family: Family | None = None
    done: list[tuple] = []

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    for batch in batches:
        for base, conv, skip, digest, size in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "skip", "digest", "bytes")), strict=True):
            if family is None or base != family.base:
                if family is not None:
                    family.end()
                    done += family.taken()
                family = Family(base, most)
            if conv != family.conv:
                family.end()
                family.begin(conv, skip)
            family.turn(digest, size)
            if family.parts:
                done += family.parts
                family.parts = []
            if len(done) >= 10_000:
                yield packed(done)
                done = []
    if family is not None:
        family.end()
        done += family.taken()
    if done:
        yield packed(done)


def family_nodes(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """One row per node of a family: its depth, bytes of its last text and up to it, members, and those that end there."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % SPAN).cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST).cast("int").alias("skip"), F.col("turn").alias("turn"), role.alias("role"),
        F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = ["base", F.expr("conv_id <> base"), "conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    return slim.repartition("base").sortWithinPartitions(*order).drop("turn", "role").mapInArrow(partial(_families, most=family), NODES)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Ids of a node, which come in order, as comma-joined pieces: (node, first, ids)."""
    node, ids, rows = None, [], []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if n != node or len(ids) >= most:
                if ids:
                    rows.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = n, []
            ids.append(c)
            if len(rows) >= 10_000:
                yield packed()
                rows = []
    if ids:
        rows.append((node, ids[0], ",".join(map(str, ids))))
    if rows:
        yield packed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, joined."""
    node, h, rows = None, None, []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])

    for batch in batches:
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n == node:
                h.update(b"," + ids.encode())
                continue
            if h is not None:
                rows.append((node, h.hexdigest()))
            node, h = n, hashlib.sha256(ids.encode())
            if len(rows) >= 10_000:
                yield packed()
                rows = []
    if h is not None:
        rows.append((node, h.hexdigest()))
    if rows:
        yield packed()


def ends(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end; ids go in ranges, so one node's may lie in many."""
    each = nodes.where(F.size("ends") > 0).select("node", F.explode("ends").alias("conv_id"))
    pieces = each.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(partial(_chunks, most=chunk), "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def _fates(nodes: DataFrame) -> DataFrame:
    """(base, fates): for each conversation of a family its length, whether it owns a leaf, and the deepest node that it
    doesn't own (depth -1 if it owns all): depth, bytes up to it, owner."""
    merged = nodes.groupBy("node").agg(
        F.min(F.array_min("members")).alias("owner"), F.sum(F.size("members") - F.size("ends")).alias("go_on"), F.count("*").alias("families")
    )
    known = looked_up(nodes.drop("bytes"), materialize(merged, "trie-merged"), "node", "families", ["owner", "go_on"])
    each = known.select("base", F.explode("members").alias("m"), "depth", "upto", "owner", "go_on", "ends")
    ends_here = F.array_contains("ends", F.col("m"))
    single = each.groupBy("base", "m").agg(
        F.max(F.when(F.col("m") != F.col("owner"), F.struct("depth", "upto", "owner"))).alias("shared"), F.max(F.when(ends_here, F.col("depth"))).alias("length"),
        F.max(ends_here & (F.col("m") == F.col("owner")) & (F.col("go_on") == 0)).alias("leaf")
    )
    none = F.struct(F.lit(-1).cast("long").alias("depth"), F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("owner"))
    fate = F.struct("m", F.coalesce("shared", none).alias("shared"), "length", "leaf")
    # a base has at most nine conversations, so a list of them is small
    return single.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("m", fate))).alias("fates"))


def trie(conversations: DataFrame, family: int = FAMILY, chunk: int = CHUNK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = materialize(family_nodes(conversations, family), "trie-nodes")
    own = nodes.drop("ends").join(_fates(nodes), "base")
    fates = F.transform("members", lambda m: F.col("fates")[m])

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda a, b: a + b)

    def count(which) -> Column:  # noqa: ANN001
        return F.size(F.filter(fates, which)).cast("long")

    depth, upto, size = F.col("depth"), F.col("upto"), F.col("bytes")
    saved = total(F.transform(fates, lambda f: F.when(f["shared"]["depth"] >= depth, f["shared"]["upto"] - upto + size).otherwise(F.lit(0).cast("long"))))
    owner = F.get(F.filter(fates, lambda f: f["shared"]["depth"] < depth), F.lit(0))
    above = F.when(depth - 1 > owner["shared"]["depth"], owner["m"]).otherwise(owner["shared"]["owner"])
    parts = own.select(
        "node", "depth", owner["m"].alias("conv_id"), F.when(depth > 0, above).alias("parent_conv_id"), F.size("members").cast("long").alias("n_convs"),
        count(lambda f: (f["shared"]["depth"] <= depth) & (f["length"] > depth)).alias("n_children"), count(lambda f: f["leaf"]).alias("n_leaves"),
        saved.alias("saved_tokens")
    )
    whole = parts.groupBy("node").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    return whole.join(ends(nodes, chunk), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )
