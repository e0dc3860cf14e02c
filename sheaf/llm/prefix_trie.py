"""Tries of conversations that share their first turns.

A turn is coded by the MD5 of its role and text and the length of its text, 24 bytes, and a
conversation by its turns' codes in a row: its path. Two conversations share a node of depth d if their paths
share d codes. Only codes are shuffled, never texts.

1. Conversations are put together by id, their turns in order, and rebuilt if asked.
2. Paths are sorted and dealt to range shards; copies of a path may lie in several shards. Each shard
   numbers its turns by a dictionary of its own, and builds a ternary search tree: one binary tree of turn numbers
   for the children of each node. Paths are put in median first, so those binary trees are balanced.
3. A traversal with a stack of its own lists the nodes, parents first. Backwards along the list,
   members, leaves, children and savings add up. Savings are kept as two sums, text bytes a
   member and text bytes a node, of which the second must count a node once.
4. Nodes on a shard's first or last path may go on in its neighbours. They are merged by the hash of
   their path: sums add up, and what later shards have counted again (a node, a child, or a path's
   end as a leaf although the next shard continues it) is taken off its ancestors in that shard.
   All other nodes are complete. Rows to be merged are two paths a shard.

A digest of the members that end in a node is a hash of one long string. Where such members lie in several shards,
each shard gives its part of the string and the parts are hashed in order as a stream; neither is held
whole.

Rows of a conversation are ordered by turn, null first; rows of equal turn by their code (the MD5 comes
first), so repeated rows are turns each. Null role or text is empty. Rows without conv_id belong to no
conversation and are left out. An empty table gives no nodes, also no root. One conversation's codes are one
value: 24 bytes a turn, whatever the texts' length. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sheaf.llm.common import as_batch, fields, parts_for, stored
from sheaf.session import union_all

#: Bytes of a coded turn: an MD5 and the length of the text.
CODE = 24
#: Bytes of paths in a shard, and ids that are passed on in one row.
SHARD_BYTES, PIECE = 4 << 20, 1000
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = fields(
    ("kind", T.StringType()),  # whole, part (to be merged) or ids (a piece of a part's members)
    ("shard", T.IntegerType()),
    ("node", T.BinaryType()),
    ("parent", T.BinaryType()),
    ("conv_id", T.LongType()),
    ("depth", T.LongType()),
    ("parent_conv_id", T.LongType()),
    ("n_convs", T.LongType()),
    ("n_children", T.LongType()),
    ("n_leaves", T.LongType()),
    ("member_bytes", T.LongType()),
    ("node_bytes", T.LongType()),
    ("own_bytes", T.LongType()),
    ("childless", T.BooleanType()),
    ("on_last", T.BooleanType()),  # the shard's last path, or a beginning of it
    ("ends", T.StringType()),
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _code(role: Column, text: Column) -> Column:
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.md5(said.cast("binary")), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def coded(conversations: DataFrame) -> DataFrame:
    """``conv_id, codes``: the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _code(role, text).alias("code"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "code")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["code"]).alias("codes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that begin with turns of another one: of conversation ``c - c % 5`` the first h, then
    the own turns after the first h, where h is the unsigned crc32 of the id in decimals, modulo 9."""
    own = convs.select(
        "conv_id",
        "codes",
        (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int").alias("h"),
    )
    bases = convs.filter(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.slice("codes", 1, 8).alias("lead"))
    head = F.expr("coalesce(slice(lead, 1, h), cast(array() as array<binary>))")
    rest = F.expr("slice(codes, h + 1, greatest(size(codes) - h, 0))")
    return own.join(bases, "base", "left").select("conv_id", F.concat(head, rest).alias("codes"))


class TernaryTree:
    """A ternary search tree of integer sequences, node 0 being the empty sequence.

    ``low`` and ``high`` lead to smaller and larger siblings, ``down`` to the children's middle one.
    """

    def __init__(self):
        self.turn, self.low, self.high, self.down = [-1], [0], [0], [0]

    def put(self, path: list[int]) -> int:
        """The node of a path, made if it is missing."""
        turn, low, high, down = self.turn, self.low, self.high, self.down
        node = 0
        for t in path:
            links, at = down, node
            nxt = links[at]
            while nxt and turn[nxt] != t:
                links, at = (low if t < turn[nxt] else high), nxt
                nxt = links[at]
            if not nxt:
                nxt = links[at] = len(turn)
                turn.append(t)
                low.append(0)
                high.append(0)
                down.append(0)
            node = nxt
        return node

    def listed(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth) of all nodes, parents first."""
        out, waiting = [(0, -1, 0)], [(self.down[0], 0, 1)]
        while waiting:
            node, parent, depth = waiting.pop()
            if not node:
                continue
            out.append((node, parent, depth))
            waiting += ((self.low[node], parent, depth), (self.high[node], parent, depth), (self.down[node], node, depth + 1))
        return out


def median_first(n: int) -> Iterator[int]:
    """0 to n - 1, the middle one first, then the middles of both halves, and so on."""
    waiting = [(0, n)]
    for lo, hi in waiting:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            waiting += ((lo, mid), (mid + 1, hi))


def shard_nodes(paths: list[bytes], ids: list[list[int]], shard: int) -> Iterator[tuple]:
    """Rows of NODE for a shard's distinct paths, sorted, and the ids of their members, ascending."""
    sizes = np.array([len(p) // CODE for p in paths])
    joined = b"".join(paths)
    turns = np.frombuffer(joined, f"S{CODE}") if joined else np.empty(0, f"S{CODE}")
    codes, numbers = np.unique(turns, return_inverse=True)
    lengths = np.frombuffer(codes.astype(f"S{CODE}").tobytes(), ">u8").reshape(-1, 3)[:, 2].tolist()
    ends = np.cumsum(sizes)
    numbers = numbers.tolist()
    tree, holder = TernaryTree(), {}
    for i in median_first(len(paths)):
        holder[tree.put(numbers[ends[i] - sizes[i] : ends[i]])] = i
    listed = tree.listed()
    n = len(tree.turn)
    members, least, children, leaves, shared, single = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    up = [0] * n
    for node, i in holder.items():
        members[node], least[node] = len(ids[i]), ids[i][0]
    own = [lengths[t] if t >= 0 else 0 for t in tree.turn]
    for node, parent, _ in reversed(listed):
        up[node] = parent
        leaves[node] = leaves[node] or 1
        shared[node] += members[node] * own[node]
        single[node] += own[node]
        if parent >= 0:
            least[parent] = min(least[parent], least[node]) if members[parent] else least[node]
            members[parent] += members[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            shared[parent] += shared[node]
            single[parent] += single[node]
    keys = {0: hashlib.md5().digest()}  # of the nodes that neighbours may share
    for i in (0, len(paths) - 1):
        chain, node = [], tree.put(numbers[ends[i] - sizes[i] : ends[i]])
        while node:
            chain.append(node)
            node = up[node]
        state = hashlib.md5()
        for d, node in enumerate(reversed(chain)):
            state.update(paths[i][d * CODE : (d + 1) * CODE])
            keys[node] = state.copy().digest()
    last = {0, *chain}
    for node, parent, depth in listed:
        part = node in keys
        own_ids = ids[holder[node]] if node in holder else []
        if part:
            yield from _pieces(own_ids, shard, keys[node])
        yield (
            "part" if part else "whole",
            shard,
            keys.get(node),
            keys.get(parent),
            least[node],
            depth,
            None if parent < 0 or parent in keys else least[parent],
            members[node],
            children[node],
            leaves[node],
            shared[node],
            single[node],
            own[node],
            not children[node],
            node in last,
            None if part else hashlib.sha256(",".join(map(str, own_ids)).encode()).hexdigest(),
        )


def _pieces(ids: list[int], shard: int, key: bytes) -> Iterator[tuple]:
    """Strings of ids, joined by commas, of bounded length."""
    for a in range(0, len(ids), PIECE):
        text = ",".join(map(str, ids[a : a + PIECE]))
        yield ("ids", shard, key, None, ids[a], *[None] * 10, text)


def _grouped(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], list[list[int]]]:
    paths, ids = [], []
    for batch in batches:
        for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if not paths or paths[-1] != path:
                paths.append(path)
                ids.append([])
            ids[-1].append(conv)
    return paths, ids


def _shards(paths: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows of NODE of all range shards."""
    arrow = to_arrow_schema(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids = _grouped(batches)
        if not found:
            return
        rows, held = [], 0
        for row in shard_nodes(found, ids, TaskContext.get().partitionId()):
            rows.append(row)
            held += 200 + len(row[-1] or "")
            if held > 8 << 20:
                yield as_batch(dict(zip(NODE.names, zip(*rows, strict=True), strict=True)), arrow)
                rows, held = [], 0
        if rows:
            yield as_batch(dict(zip(NODE.names, zip(*rows, strict=True), strict=True)), arrow)

    total = paths.agg(F.coalesce(F.sum(F.octet_length("path") + 16), F.lit(0))).first()[0]
    parts = parts_for(total, shard_bytes, paths.sparkSession.sparkContext.defaultParallelism)
    # a number of parts of its own, so that shards are neither joined nor cut while the query runs
    dealt = paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.mapInArrow(run, NODE)


def _merged(parts: DataFrame) -> DataFrame:
    """Nodes that several shards may have, put together.

    What a shard counted that an earlier one had counted: text bytes of nodes seen before, for them and
    their ancestors, and children seen before. What a later one counts: the leaf at a shard's end, if the
    next shard continues its path. All of these lie on the shard's first or last path.
    """
    same, chain = Window.partitionBy("node"), Window.partitionBy("shard")
    again, goes_on = F.col("again"), F.col("childless") & (F.col("shard") < F.col("last_shard"))
    seen = parts.withColumn("again", F.col("shard") > F.min("shard").over(same)).withColumn("last_shard", F.max("shard").over(same))
    deeper = chain.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.select(
        "*",
        F.coalesce(F.sum(F.when(again, F.col("own_bytes"))).over(deeper), F.lit(0)).alias("bytes_below"),
        F.max(F.when(again, F.col("depth"))).over(chain).alias("depth_again"),
        F.max(goes_on.cast("long")).over(chain).alias("end_goes_on"),
    )
    return seen.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.max("parent").alias("parent"),
        F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - F.when(again & (F.col("depth") < F.col("depth_again")), 1).otherwise(0)).alias("n_children"),
        F.sum(F.col("n_leaves") - F.when(F.col("on_last"), F.col("end_goes_on")).otherwise(0)).alias("n_leaves"),
        F.sum(F.col("member_bytes") - F.col("node_bytes") + F.when(again, F.col("bytes_below")).otherwise(0)).alias("saved_tokens"),
    )


def _digests(pieces: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the pieces of each node, hashed one after the other."""
    schema = fields(("node", T.BinaryType()), ("ends_sha256", T.StringType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: dict[str, list] = {"node": [], "ends_sha256": []}
            for key, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key == node:
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    done["node"].append(node)
                    done["ends_sha256"].append(state.hexdigest())
                node, state = key, hashlib.sha256(text.encode())
            yield as_batch(done, arrow)
        if node is not None:
            yield as_batch({"node": [node], "ends_sha256": [state.hexdigest()]}, arrow)

    ordered = pieces.repartition("node").sortWithinPartitions("node", "shard", "conv_id")
    return ordered.select("node", "ends").mapInArrow(run, schema)


def prefix_trie(convs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a node for conversations given as ``conv_id, codes``."""
    path = F.coalesce(F.expr("aggregate(codes, cast('' as binary), (a, c) -> concat(a, c))"), F.lit(b""))
    nodes = stored(_shards(stored(convs.select("conv_id", path.alias("path")), "trie-paths"), shard_bytes), "trie-nodes")
    parts = nodes.filter("kind = 'part'")
    merged = _merged(parts).join(_digests(nodes.filter("kind = 'ids'")), "node", "left")
    merged = stored(merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "trie-merged")
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.filter("kind = 'whole'").withColumn("saved_tokens", F.col("member_bytes") - F.col("node_bytes"))
    whole = whole.withColumnRenamed("ends", "ends_sha256")
    # a shard's nodes below one of its merged nodes are bounded by the shard, so no key is frequent
    below = whole.filter("parent IS NOT NULL").drop("parent_conv_id")
    below = below.join(parts.select("shard", F.col("node").alias("parent")).join(above, "parent"), ["shard", "parent"], "left")
    return union_all(
        whole.filter("parent IS NULL").select(*RESULT),
        below.select(*RESULT),
        merged.join(above, "parent", "left").select(*RESULT),
    )
