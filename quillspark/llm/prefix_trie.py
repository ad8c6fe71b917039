"""The trie of all conversation prefixes, merged family by family.

Conversations whose ids share a base are a family: each takes its first turns from the base's
conversation.  A family's turns meet in one task, sorted by conversation and turn, where the
conversations are rebuilt one after the other and entered into the family's own trie.  Only that
trie's nodes, one row each whatever the number of members, travel on to be merged with those of
other families.  Turns travel as digests of role and text with the number of words; a node is the
digest of its path.  The trie of a family is handed on in parts once it holds ``HELD`` nodes: parts
merge like tries of different families, so that neither a long conversation nor a large family fills
the memory of its task.

A merged node is named by its smallest member and its depth, as a conversation passes one node at
each depth.  What a subtree holds is summed by doubling: in round k each node adds up what the
nodes 2**k below it have summed so far, and learns its ancestor 2**(k+1) above.  That takes as many
rounds as the deepest conversation has binary digits, and only nodes that deep take part.

Cases: rows without a conv_id belong to no conversation and are passed over.  Null role and text are
empty.  Turns are ordered with null first; equal turns by role and then by the MD5 of role and text.
Repeated rows are turns of their own.  The base of a negative id is its multiple of 20 towards 0.
No conversations: no rows.  Only the columns conv_id, turn, role and text are looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_map, materialize

#: Ids in a family, and the numbers of turns that may come from its base.
FAMILY, HEADS = 20, 4
#: Nodes that a task holds before it hands them on.
HELD = 100_000

_ROOT = bytes(16)


def head_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


class _Trie:
    """Nodes by digest: parent, depth, smallest member, members, words of the last text, members that end there."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}

    def enter(self, conv_id: int) -> None:
        self.conv_id, self.last = conv_id, (_ROOT, _ROOT, 0, 0)
        self._pass(1)

    def _pass(self, members: int) -> list:
        node, parent, depth, words = self.last
        entry = self.nodes.setdefault(node, [parent, depth, self.conv_id, 0, words, []])
        entry[2] = min(entry[2], self.conv_id)
        entry[3] += members
        return entry

    def turn(self, digest: bytes, words: int) -> None:
        node, _, depth, _ = self.last
        self.last = hashlib.blake2b(node + digest, digest_size=16).digest(), node, depth + 1, words
        self._pass(1)

    def leave(self) -> None:
        self._pass(0)[5].append(self.conv_id)

    def handed_on(self) -> pa.RecordBatch:
        columns = zip(*([node, *entry] for node, entry in self.nodes.items()), strict=True)
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "parent", "depth", "conv_id", "n", "words", "ends"])
        self.nodes = {}
        return out


def _family_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each family's trie; rows come sorted by base, the base's own turns first, then by conversation and turn."""
    trie, base, conv_id = _Trie(), None, None
    head: list[tuple[bytes, int]] = []
    for batch in batches:
        for family, own, digest, words in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "digest", "words")), strict=True):
            if own != conv_id:
                if conv_id is not None:
                    trie.leave()
                if family != base:
                    base, head = family, []
                    if trie.nodes:
                        yield trie.handed_on()
                conv_id, place, skip = own, 0, 0
                trie.enter(own)
                if own != base:
                    skip = head_turns(own)
                    for turn in head[:skip]:
                        trie.turn(*turn)
            if own == base and len(head) < HEADS - 1:
                head.append((digest, words))
            if place >= skip:
                trie.turn(digest, words)
            place += 1
            if len(trie.nodes) > HELD:
                yield trie.handed_on()
    if conv_id is not None:
        trie.leave()
        yield trie.handed_on()


def family_nodes(conversations: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, n, words, ends) of the family tries of conversations (conv_id, turn, role, text)."""
    own = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id is not null").select((own - own % FAMILY).alias("base"), own.alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return arrow_map(turns.select("base", "conv_id", "digest", "words"), _family_tries, "node binary, parent binary, depth long, conv_id long, n long, words long, ends array<long>")


def _ends_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from (node, conv_id) sorted by both; ids are hashed as they pass, so that a node may have any number."""
    node, state = None, None
    for batch in batches:
        done = []
        for own, rows in itertools.groupby(zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True), lambda x: x[0]):
            ids = ",".join(str(i) for _, i in rows)
            if own != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([x for _, x in done])], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def merged_nodes(families: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, own_saved, ends_sha256) of the trie of all families' nodes."""
    nodes = families.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("words").alias("words"))
    nodes = materialize(nodes, "trie-nodes")
    least = nodes.agg(F.min("conv_id")).first()[0]
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # the root is the parent of very many nodes: its member is known without a join
    top = nodes.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")))
    named = nodes.filter("depth > 1").join(above, "parent").unionByName(top)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ends = families.filter(F.size("ends") > 0).repartition("node").select("node", F.explode("ends").alias("conv_id")).sortWithinPartitions("node", "conv_id")
    ends = arrow_map(ends, _ends_hashed, "node binary, ends_sha256 string")
    out = named.join(children, "node", "left").join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def subtree_sums(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """(conv_id, depth) with, for each new name in ``values``, the sum of that column over the node's subtree.

    ``nodes`` (a scratch table) has conv_id, depth, parent_conv_id and the columns.
    """
    sums = [F.sum(name).cast("long").alias(name) for name in values]
    state = nodes.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), *[F.col(c).cast("long").alias(name) for name, c in values.items()])
    parts, reach, deepest = [state.drop("up")], 1, nodes.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        state = state.filter(F.col("depth") >= reach)
        gain = materialize(state.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(*sums), "trie-gain")
        parts.append(gain)
        if 2 * reach <= deepest:
            above = state.select(F.col("conv_id").alias("up"), (F.col("depth") + reach).alias("depth"), F.col("up").alias("higher"))
            own = state.filter(F.col("depth") >= 2 * reach).join(above, ["up", "depth"])
            more = gain.select("conv_id", "depth", *[F.col(name).alias(f"{name}_more") for name in values])
            own = own.join(more, ["conv_id", "depth"], "left")
            state = materialize(own.select("conv_id", "depth", F.col("higher").alias("up"), *[(F.col(name) + F.coalesce(f"{name}_more", F.lit(0))).alias(name) for name in values]), "trie-state")
        reach *= 2
    return reduce(DataFrame.unionByName, parts).groupBy("conv_id", "depth").agg(*sums)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    (conv_id, its smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves and
    saved_tokens of its subtree; ends_sha256 of the conversations that end there).
    """
    families = materialize(family_nodes(conversations), "families")
    nodes = materialize(merged_nodes(families).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie")
    sums = subtree_sums(nodes, {"n_leaves": "leaf", "saved_tokens": "own_saved"})
    out = nodes.drop("leaf", "own_saved").join(sums, ["conv_id", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
