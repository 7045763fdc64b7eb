"""Prefix trie of conversations by burst tries.

A conversation is one binary path, ``TURN`` bytes a turn: an md5 of role and
text and the text's length in bytes. Equal paths are one entry, with the number
of their conversations, the smallest id and the digest of all ids.

Entries are kept in suffix containers under trie heads. At first the root's
container holds all of them. A container of more than ``limit`` entries bursts:
its head runs on along the prefix common to all its entries (the longest common
prefix of the smallest and the largest path), and the entries go to containers
by the id of the turn behind it. One round bursts all containers that are too
large at once; rounds end when none is, so their number follows the branchings
of the crowded prefixes, not their length. The containers left are dealt to
shards, sorted by path and swept: each path closes the open nodes that it does
not share. What crosses containers (the children, leaves and tokens of a burst
head) is summed from the containers' top nodes.

No key gathers an unbounded group: copies are counted map-side, ids of one path
are gathered in slices of 2**``SLICE`` ids and digested by streaming over the
slices (SHA-256 is sequential, so the slices of one path pass one task, in
constant memory), and no container is larger than ``limit``. The table of burst
heads, at most entries / ``limit`` a round, is broadcast up to ``HEADS`` rows
and shuffled beyond. A single conversation's turns are gathered in one row.

Nulls and special cases: turns are ordered by turn (null first), then role,
then the md5 of role and text; null role and text are empty strings; rows
without a conv_id belong to no conversation; a conversation that is left
without turns ends at the root; repeated rows are turns of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.shared import written

#: bytes of a turn in a path: md5 of role and text, length of the text
TURN, LENGTH_AT = 24, 16
#: entries of a container; binary digits of the ids of a slice; burst heads that are broadcast
CONTAINER, SLICE, HEADS = 4096, 16, 50_000

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
ENTRY = "path binary, n long, first long, ends string"

_EMPTY = hashlib.sha256(b"").hexdigest()


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation, its turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.concat(
            F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)),
            F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (TURN - LENGTH_AT), "0"),
        ).alias("id"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("turn", "role", "id")))
    return known.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(in_order, lambda t: t["id"]), "")).alias("path"))


def rebuilt(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation
    c - c % ``group`` (all of them if it has fewer, none if it is absent), then
    its own turns after its first h; h is crc32 of c's decimal text mod ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most * TURN).cast("int")
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("path").alias("base_path"))
    none = F.lit(b"")
    head = F.coalesce(F.substr("base_path", F.lit(1), h), none)
    return own.join(bases, "base", "left").select("conv_id", F.concat(head, F.substr("path", h + 1)).alias("path"))


def _digests(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds the slices of each path, which come in order, into one entry."""
    path, n, first, digest = None, 0, None, None
    for frame in frames:
        out = []
        for p, count, low, ids in zip(frame["path"], frame["n"], frame["first"], frame["ids"], strict=True):
            if p != path:
                if path is not None:
                    out.append((path, n, first, digest.hexdigest()))
                path, n, first, digest = p, 0, low, hashlib.sha256()
            else:
                digest.update(b",")
            n, first = n + count, min(first, low)
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=["path", "n", "first", "ends"])
    if path is not None:
        yield pd.DataFrame([(path, n, first, digest.hexdigest())], columns=["path", "n", "first", "ends"])


def entries(convs: DataFrame) -> DataFrame:
    """(path, n, first, ends) per distinct path: its conversations' number,
    smallest id, and SHA-256 of their decimal ids, ascending, comma-joined."""
    slices = convs.groupBy("path", F.shiftright("conv_id", SLICE).alias("slice")).agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
    )
    dealt = slices.repartition("path").sortWithinPartitions("path", "slice")
    return dealt.select("path", "n", "first", "ids").mapInPandas(_digests, ENTRY)


def _turns(path: bytes) -> int:
    return len(path) // TURN


def _common(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // TURN
    low, high = 0, most // TURN  # the prefix of ``low`` turns is common, that of ``high`` is not or is too long
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid
    return low


def _tokens(path: bytes, depth: int) -> int:
    """Bytes of the text of the turn that ends the prefix of ``depth`` turns."""
    return int.from_bytes(path[depth * TURN - TURN + LENGTH_AT : depth * TURN], "big") if depth else 0


def _heads(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each container that bursts branches."""
    for frame in frames:
        depth = [_common(a, b) for a, b in zip(frame["lo"], frame["hi"], strict=True)]
        head = [a[: d * TURN] for a, d in zip(frame["lo"], depth, strict=True)]
        yield frame[["key", "above", "parent", "top", "n", "first"]].assign(depth=depth, head=head)


def burst(found: DataFrame, limit: int = CONTAINER) -> tuple[DataFrame, DataFrame | None]:
    """(containers, heads): every entry under the head of its container
    (``top``: turns of the head's prefix with the turn that leads to the
    container), and the heads that were burst with their ancestors, or None."""
    state = found.withColumns(
        {
            "top": F.lit(0),
            "parent": F.lit(None).cast("long"),
            "above": F.array().cast("array<binary>"),
        }
    )
    settled, heads = [], []
    while True:
        state = written(state.withColumn("key", F.substr("path", F.lit(1), F.col("top") * TURN)), "containers")
        large = (
            state.groupBy("key")
            .agg(
                F.count("*").alias("entries"),
                F.min("path").alias("lo"),
                F.max("path").alias("hi"),
                F.sum("n").alias("n"),
                F.min("first").alias("first"),
                *(F.any_value(c).alias(c) for c in ("above", "parent", "top")),
            )
            .where(F.col("entries") > limit)
        )
        schema = "key binary, above array<binary>, parent long, top int, n long, first long, depth int, head binary"
        large = written(large.mapInPandas(_heads, schema), "heads")
        count = large.count()
        if not count:
            settled.append(state.select("path", "n", "first", "ends", "top", "parent", "above"))
            break
        heads.append(large)
        sent = F.broadcast(large) if count <= HEADS else large
        settled.append(state.join(sent, "key", "left_anti").select("path", "n", "first", "ends", "top", "parent", "above"))
        burst_ones = sent.select(
            "key", "depth", F.col("first").alias("head_first"), F.array_append("above", F.col("head")).alias("over")
        )
        inside = state.drop("parent", "above", "top").join(burst_ones, "key")
        state = inside.select(
            "path",
            "n",
            "first",
            "ends",
            # an entry that ends at the head itself leads to no container
            F.when(F.octet_length("path") > F.col("depth") * TURN, F.col("depth") + 1).alias("top"),
            F.col("head_first").alias("parent"),
            F.col("over").alias("above"),
        )
        ended = state.where("top is null").select("path", F.col("ends").alias("ended"))
        heads[-1] = large.join(ended, large["head"] == ended["path"], "left").drop("path")
        state = state.where("top is not null")
    return reduce(DataFrame.unionByName, settled), reduce(DataFrame.unionByName, heads) if heads else None


class _Open:
    """A node whose subtree is being read."""

    __slots__ = ("children", "depth", "done", "ends", "first", "leaves", "n", "path", "saved")

    def __init__(self, path: bytes, depth: int):
        self.path, self.depth = path, depth
        self.n = self.children = self.leaves = self.saved = 0
        self.first, self.ends = None, _EMPTY
        self.done: list[tuple] = []  # closed children, that wait for this node's smallest member

    def add(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


def _sweep(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Containers, sorted by path, to nodes. ``under`` holds the head above
    a container's top node, whose own node is not in the container."""
    stack: list[_Open] = []
    top, parent, under, out = 0, None, None, []

    def close() -> None:
        node = stack.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * _tokens(node.path, node.depth)
        row = (node.first, node.depth, node.n, node.children, node.leaves, node.saved, node.ends)
        for child in node.done:
            out.append((*child, node.first, None))
        if stack:
            above = stack[-1]
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
            above.add(node.n, node.first)
            above.done.append(row)
        else:
            out.append((*row, parent, under))

    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id", "under"]

    def taken() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=columns)
        frame["parent_conv_id"] = frame["parent_conv_id"].astype("Int64")
        out.clear()
        return frame

    before = b""
    for frame in frames:
        for row in frame.itertuples(index=False):
            path = row.path
            same = bool(stack) and row.top == top and path[: top * TURN] == before[: top * TURN]
            shared = _common(before, path) if same else -1
            while stack and stack[-1].depth > shared:
                close()
            if not same:
                top, under = row.top, (row.above[-1] if len(row.above) else None)
                parent = None if pd.isna(row.parent) else int(row.parent)
            for depth in range(stack[-1].depth + 1 if stack else top, _turns(path) + 1):
                stack.append(_Open(path, depth))
            stack[-1].add(row.n, row.first)
            stack[-1].ends = row.ends
            before = path
            if len(out) >= 20_000:
                yield taken()
    while stack:
        close()
    yield taken()


def _chains(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of burst heads: from the container's top to where it branches."""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            tokens = [_tokens(r.head, d) for d in range(r.top, r.depth + 1)]
            for i, d in enumerate(range(r.top, r.depth + 1)):
                last = d == r.depth
                saved = r.saved_below + (r.n - 1) * sum(tokens[i:])
                parent = r.first if i else r.parent
                ends = r.ended if last and r.ended is not None else _EMPTY
                out.append((r.first, d, parent, r.n, r.direct if last else 1, r.leaves_below, saved, ends))
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        yield pd.DataFrame(out, columns=names).astype({"parent_conv_id": "Int64"})


def _own_saved(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        saved = [(r.n - 1) * sum(_tokens(r.head, d) for d in range(r.top, r.depth + 1)) for r in frame.itertuples(index=False)]
        yield frame[["head", "above"]].assign(saved=saved)


def trie(found: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """All nodes of the trie of ``entries``: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    containers, heads = burst(found, limit)
    shard = F.substr("path", F.lit(1), F.col("top") * TURN)
    swept = (
        containers.repartition(shard)
        .sortWithinPartitions("path")
        .mapInPandas(
            _sweep,
            "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
            "ends_sha256 string, parent_conv_id long, under binary",
        )
    )
    columns = [c.split()[0] for c in NODE.split(", ")]
    swept = written(swept, "swept")
    if heads is None:
        return swept.select(*columns)
    heads = written(heads, "burst")
    # what lies below each head: tops of its containers, and the chains of heads below it
    tops = swept.where("under is not null").groupBy(F.col("under").alias("head")).agg(
        F.count("*").alias("direct"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    lines = heads.select("head", "above")
    from_tops = lines.join(tops, "head").select(
        F.explode(F.array_append("above", F.col("head"))).alias("head"), "leaves", "saved"
    )
    chains = heads.mapInPandas(_own_saved, "head binary, above array<binary>, saved long")
    from_heads = chains.select(F.explode("above").alias("head"), F.lit(0).cast("long").alias("leaves"), "saved")
    below = from_tops.unionByName(from_heads).groupBy("head").agg(
        F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below")
    )
    nested = heads.where(F.size("above") > 0).groupBy(F.element_at("above", -1).alias("head")).agg(F.count("*").alias("nested"))
    full = (
        heads.join(below, "head")
        .join(tops.select("head", "direct"), "head", "left")
        .join(nested, "head", "left")
        .withColumn("direct", F.coalesce("direct", F.lit(0)) + F.coalesce("nested", F.lit(0)))
        .select("top", "depth", "head", "parent", "n", "first", "ended", "direct", "leaves_below", "saved_below")
    )
    return swept.select(*columns).unionByName(full.mapInPandas(_chains, NODE))


def prefix_trie(turns: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The trie of the conversations of ``turns`` as they are."""
    return trie(entries(paths(turns)), limit)
