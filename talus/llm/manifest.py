"""Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

Every row is a leaf; the leaves of a language stand in ascending doc_id. Instead of sorting them, the ids of a language
are kept as compressed bitmaps, one container for 4,096 neighbouring ids: tasks make partial containers of the ids
they read, which are merged per container. A container counts its ids in a popcount directory, and directories of
containers count on in the same way, 65,536 children to a node, up to the language. The coordinate of a leaf is then a
sum of ranks: ids in earlier containers, plus ids below it in its own.

Coordinates are dense, so a tree is reduced in keyed slot arrays: 4,096 consecutive nodes form a block, each node goes
to its own slot, and a block reduces twelve levels at once. What the blocks of one round leave are the nodes of the
next. On the way down every block learns the siblings above it, and its leaves get their proofs from both.

Nothing is collected: a language that holds a third of all rows is as many containers and blocks as its rows need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from talus.llm.common import parts_for, stored
from talus.operators.ordering import global_rank

ARITY = 2
CONTAINER = 12  # bits of an id that its place in a container takes
SPARSE = 256  # ids from which on a container is a bitmap, not a list of 16-bit places
LEVELS = 12  # levels that a block reduces: ARITY ** LEVELS slots
NULL_ID = -(1 << (63 - CONTAINER)) - 1  # the container of null ids, before all others


# --- leaves ---------------------------------------------------------------------------------------------------


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, (doc_id, source, lang, n_chars, text))), 256)


def tampered_rows(doc_id: Column) -> Column:
    """The rows that the tampering touches; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(row, tree, bucket, place, doc_id, leaf, changed), stored. `tree` names the language, in the order of languages:
    null first, then bytewise. `changed` is the leaf that the row would have if it were tampered with, null for the
    rows that are not. `row` tells rows apart that are equal otherwise."""
    own = docs.select("doc_id", "source", "lang", "n_chars", "text")
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    columns = [F.col(c) for c in ("doc_id", "source", "lang")]
    made = own.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), CONTAINER), F.lit(NULL_ID)).alias("bucket"),
        F.coalesce(F.col("doc_id").cast("long").bitwiseAND(F.lit((1 << CONTAINER) - 1)), F.lit(0).cast("long")).cast("int").alias("place"),
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf(*columns, F.col("n_chars"), F.col("text"))).alias("leaf"),
        F.when(tampered_rows(F.col("doc_id")), F.unhex(leaf(*columns, more, F.col("text")))).alias("changed"),
    )
    return stored(made, "manifest-leaves")


# --- containers -----------------------------------------------------------------------------------------------


class Container:
    """The set of places of one container, compressed, with how many more rows some of them have."""

    def __init__(self, places: np.ndarray, counts: np.ndarray):
        """`places`, sorted and distinct, and the rows of each."""
        more = np.flatnonzero(counts > 1)
        self.again, self.extra = places[more].astype(np.uint16), counts[more].astype(np.int64) - 1
        if len(places) < SPARSE:
            self.kind, self.data = 0, places.astype(np.uint16)
        else:
            bits = np.zeros(1 << CONTAINER, np.uint8)
            bits[places] = 1
            self.kind, self.data = 1, np.packbits(bits, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, places: np.ndarray, counts: np.ndarray) -> Container:
        """From places in any order, repeats included."""
        distinct, at = np.unique(places, return_inverse=True)
        return cls(distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64))

    def to_bytes(self) -> bytes:
        head = np.array([self.kind, len(self.again)], np.int64)
        return head.tobytes() + self.extra.tobytes() + self.again.tobytes() + self.data.tobytes()

    @classmethod
    def from_bytes(cls, held: bytes) -> Container:
        out = cls.__new__(cls)
        out.kind, many = (int(x) for x in np.frombuffer(held, np.int64, 2))
        out.extra = np.frombuffer(held, np.int64, many, 16)
        out.again = np.frombuffer(held, np.uint16, many, 16 + 8 * many)
        rest = held[16 + 10 * many :]
        out.data = np.frombuffer(rest, np.uint64 if out.kind else np.uint16)
        return out

    def rows(self) -> int:
        distinct = int(np.bitwise_count(self.data).sum()) if self.kind else len(self.data)
        return distinct + int(self.extra.sum())

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """All places, and the rows of each."""
        at = np.flatnonzero(np.unpackbits(self.data.view(np.uint8), bitorder="little")) if self.kind else self.data.astype(np.int64)
        counts = np.ones(len(at), np.int64)
        counts[np.searchsorted(at, self.again)] += self.extra
        return at, counts

    def ranker(self):
        """places -> (rows below each, whether the place has more than one row)."""
        if self.kind:
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.data), dtype=np.int64)])  # the popcount directory
        extras = np.concatenate([[0], np.cumsum(self.extra)])

        def rank(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if self.kind:
                word = places >> 6
                below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
                found = before[word] + np.bitwise_count(self.data[word] & below)
            else:
                found = np.searchsorted(self.data, places)
            at = np.searchsorted(self.again, places)
            many = np.zeros(len(places), bool)
            if len(self.again):
                many = self.again[np.minimum(at, len(self.again) - 1)] == places
            return found + extras[at], many

        return rank


def containers(rows: DataFrame, parts: int) -> DataFrame:
    """(tree, bucket, ids, n), stored: one compressed container for every (tree, bucket) of `leaves`."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("tree").dictionary_encode()
            tree, bucket, place = codes.indices.to_numpy(), batch.column("bucket").to_numpy(), batch.column("place").to_numpy()
            order = np.lexsort((bucket, tree))
            edges = np.flatnonzero((np.diff(tree[order]) != 0) | (np.diff(bucket[order]) != 0)) + 1
            own = np.split(order, edges)
            ids = [Container.of(place[x], np.ones(len(x))).to_bytes() for x in own]
            first = pa.array([x[0] for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("tree").take(first), batch.column("bucket").take(first), pa.array(ids, pa.binary())], names=["tree", "bucket", "ids"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place, count = None, [], []  # of the container that is being merged

        def done():
            whole = Container.of(np.concatenate(place), np.concatenate(count)) if len(place) > 1 else Container(place[0], count[0])
            return pa.RecordBatch.from_pylist([{"tree": key[0], "bucket": key[1], "ids": whole.to_bytes(), "n": whole.rows()}], schema=schema)

        schema = pa.schema([("tree", pa.string()), ("bucket", pa.int64()), ("ids", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "bucket", "ids"))):
                if key is not None and row[:2] != key:
                    yield done()
                    place, count = [], []
                elif len(place) >= 64:  # partial containers are merged as they come
                    whole = Container.of(np.concatenate(place), np.concatenate(count))
                    place, count = ([x] for x in whole.places())
                key = row[:2]
                for held, x in zip((place, count), Container.from_bytes(row[2]).places()):
                    held.append(x)
        if key is not None:
            yield done()

    dealt = rows.select("tree", "bucket", "place").mapInArrow(partial, "tree string, bucket long, ids binary")
    dealt = dealt.repartition(parts, "tree", "bucket").sortWithinPartitions("tree", "bucket")
    return stored(dealt.mapInArrow(merged, "tree string, bucket long, ids binary, n long"), "manifest-containers")


def directory(held: DataFrame) -> DataFrame:
    """(tree, bucket, before): the rows of a tree in earlier containers.

    Counts are summed 65,536 children to a node at a time, and each node adds what its earlier siblings hold: no window
    has more rows than that, however many containers a tree has.
    """
    line = Window.partitionBy("tree", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    levels = []
    counts = held.select("tree", F.col("bucket").alias("node"), "n")
    for _ in range(3):  # 48 of the bits above a container; the few that are left have at most 18 values
        placed = counts.withColumn("up", F.shiftright("node", 16))
        levels.append(placed.select("tree", "node", "up", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("own")))
        counts = placed.groupBy("tree", "up").agg(F.sum("n").alias("n")).withColumnRenamed("up", "node")
    top = Window.partitionBy("tree").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("tree", F.col("node").alias("up"), F.coalesce(F.sum("n").over(top), F.lit(0)).alias("before"))
    for level in reversed(levels):
        before = level.join(before, ["tree", "up"]).select("tree", F.col("node").alias("up"), (F.col("own") + F.col("before")).alias("before"))
    return before.withColumnRenamed("up", "bucket")


def coordinates(rows: DataFrame) -> DataFrame:
    """The rows of `leaves` with `at`, their place among the leaves of their tree, stored.

    Leaves stand by doc_id, null first; rows that share an id stand by their leaf. Such rows are the only ones that are
    ever sorted, over as many tasks as they need.
    """
    spark = rows.sparkSession
    parts = parts_for(rows.count() * 96, spark)
    held = containers(rows, parts)
    based = held.join(directory(held), ["tree", "bucket"])
    # a container of more rows than it has places holds repeated ids: its rows are dealt to several tasks
    shares = F.ceil(F.col("n") / F.lit(1 << CONTAINER)).cast("long")
    crowded = stored(held.where(F.col("n") > 1 << CONTAINER).select("tree", "bucket", shares.alias("shares")), "manifest-crowded")
    ids = based.select("tree", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), "before", "ids")
    dealt = rows.join(crowded, ["tree", "bucket"], "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("row"), F.col("shares")), F.lit(0))).drop("shares")
    columns = ["tree", "bucket", "share", "place", "row", "doc_id", "leaf", "changed", "before", "ids"]
    both = dealt.withColumns({"before": F.lit(None).cast("long"), "ids": F.lit(None).cast("binary")}).select(columns).unionByName(
        ids.withColumns({"place": F.lit(-1), "row": F.lit(None).cast("long"), "doc_id": F.lit(None).cast("long"), "leaf": F.lit(None).cast("binary"), "changed": F.lit(None).cast("binary")}).select(columns))
    both = both.repartition(parts, "tree", "bucket", "share").sortWithinPartitions("tree", "bucket", "share", F.col("ids").isNull())

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, base = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.flatnonzero(batch.column("ids").is_valid().to_numpy(zero_copy_only=False))
            place = batch.column("place").to_numpy()
            at, many = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            edges = [0, *heads.tolist(), batch.num_rows] if not len(heads) or heads[0] else [*heads.tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if batch.column("ids")[start].is_valid:
                    rank, base = Container.from_bytes(batch.column("ids")[start].as_py()).ranker(), batch.column("before")[start].as_py()
                    start += 1
                if start < stop:
                    found, again = rank(place[start:stop])
                    at[start:stop], many[start:stop] = found + base, again
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "row", "doc_id", "leaf", "changed")), pa.array(at), pa.array(many)], names=["tree", "row", "doc_id", "leaf", "changed", "at", "many"])
            yield out.filter(batch.column("ids").is_null())

    schema = "tree string, row long, doc_id long, leaf binary, changed binary, at long, many boolean"
    found = stored(both.mapInArrow(ranked, schema), "manifest-coordinates")
    repeated = found.where("many")
    if repeated.isEmpty():
        return found.drop("many")
    again = global_rank(repeated, ["leaf", "row"], ["tree", "at"], "nth").withColumn("at", F.col("at") + F.col("nth") - 1).drop("nth")
    return found.where("NOT many").unionByName(again).drop("many")


# --- trees ----------------------------------------------------------------------------------------------------


def digest(*parts: bytes) -> bytes:
    """H of digests, which count as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _reduced(slots: list[bytes], levels: int) -> list[list[bytes]]:
    """A block's nodes, level by level from its slots on."""
    out = [slots]
    for _ in range(levels):
        slots = [digest(*slots[i : i + ARITY]) for i in range(0, len(slots), ARITY)]
        out.append(slots)
    return out


def _siblings(levels: list[list[bytes]], slot: int) -> list[tuple[int, list[bytes]]]:
    """For each level but the last: the place of a slot's node in its run, and the run's other nodes."""
    out = []
    for nodes in levels[:-1]:
        first = slot - slot % ARITY
        out.append((slot % ARITY, nodes[first:slot] + nodes[slot + 1 : first + ARITY]))
        slot //= ARITY
    return out


def _folded(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    for place, others in path:
        node = digest(*others[:place], node, *others[place:])
    return node


def _packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in path)


def _unpacked(held: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(held):
        place, n = held[at], held[at + 1]
        out.append((place, [held[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]))
        at += 2 + 32 * n
    return out


def _slots(nodes: pa.Table) -> tuple[list[bytes], list[int]]:
    """The nodes of a block in their slots, and the slot of each row."""
    slot = (nodes.column("at").to_numpy() % ARITY**LEVELS).tolist()
    slots: list[bytes] = [b""] * len(slot)
    for i, value in zip(slot, nodes.column("node").to_pylist()):
        slots[i] = value
    return slots, slot


def _steps(n: int, done: int) -> int:
    """Levels that a round reduces: all that are left, LEVELS at most."""
    return min(LEVELS, height(n) - done)


def _block_reducer(done: int):
    """A block's last node, after the `done` levels of earlier rounds."""

    def reduce(key: tuple, nodes: pa.Table) -> pa.Table:
        tree, block, n = (k.as_py() for k in key)
        steps = _steps(n, done)
        node = _reduced(_slots(nodes)[0], steps)[-1][0]
        return pa.table({"tree": [tree], "at": [block], "node": pa.array([node], pa.binary()), "n": [n], "last": [done + steps == height(n)]})

    return reduce


class Trees:
    """The trees over nodes (tree, at, node, n), `at` dense from 0 in each tree and n the nodes of its tree.

    Round by round every block of ARITY ** LEVELS slots leaves one node, until a tree has one: its top. `tops` is
    (tree, top).
    """

    def __init__(self, nodes: DataFrame, label: str):
        self.label, self.rounds, self.blocks = label, [], []
        while True:
            nodes = stored(nodes.withColumn("block", F.expr(f"at div {ARITY**LEVELS}")), f"{label}-nodes")
            left = nodes.groupBy("tree", "block", "n").applyInArrow(_block_reducer(len(self.rounds) * LEVELS), "tree string, at long, node binary, n long, last boolean")
            self.rounds.append(nodes)
            self.blocks.append(stored(left, f"{label}-blocks"))
            nodes = self.blocks[-1].where("NOT last").select("tree", "at", "node", "n")
            if nodes.isEmpty():
                break
        tops = self.blocks[0].where("last")
        for held in self.blocks[1:]:
            tops = tops.unionByName(held.where("last"))
        self.tops = tops.select("tree", F.col("node").alias("top"))

    def block_paths(self) -> DataFrame:
        """(tree, block, n, path), stored: the siblings above every block of the first round, packed."""
        paths = self._tops_paths(len(self.rounds) - 1)
        for number in range(len(self.rounds) - 1, 0, -1):
            above = self._node_paths(number, paths).withColumnsRenamed({"tree": "u_tree", "at": "u_at", "path": "u_path"})
            held = self._tops_paths(number - 1)
            joined = held.join(above, (F.col("tree") == F.col("u_tree")) & (F.col("block") == F.col("u_at")), "left")
            paths = joined.select("tree", "block", "n", F.coalesce("u_path", "path").alias("path"))
        return stored(paths, f"{self.label}-paths")

    def node_paths(self) -> DataFrame:
        """(tree, at, path): the siblings of every node of the first round up to its top, packed."""
        return self._node_paths(0, self.block_paths())

    def _tops_paths(self, number: int) -> DataFrame:
        return self.blocks[number].select("tree", F.col("at").alias("block"), "n", F.lit(b"").alias("path"))

    def _node_paths(self, number: int, paths: DataFrame) -> DataFrame:
        def below(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
            slots, slot = _slots(nodes)
            levels, tail = _reduced(slots, _steps(above.column("n")[0].as_py(), number * LEVELS)), above.column("path")[0].as_py()
            held = [_packed(_siblings(levels, s)) + tail for s in slot]
            return pa.table({"tree": pa.array([key[0].as_py()] * len(slot), pa.string()), "at": nodes.column("at"), "path": pa.array(held, pa.binary())})

        nodes = self.rounds[number].groupBy("tree", "block").cogroup(paths.groupBy("tree", "block"))
        return nodes.applyInArrow(below, "tree string, at long, path binary")


def proofs(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `docs` has doc_id, source, lang, n_chars and text; any of them may be null, other columns are not looked at. A tree
    has one language's leaves by doc_id, null ids first; rows of one id stand by their leaf, equal rows in any order.
    The subroots, by language (null first, then bytewise), are the leaves of the last tree. A proof is the siblings from
    the leaf to the root; the tampered rows (`tampered_rows`) are folded with their changed leaf.
    """
    rows = coordinates(leaves(docs))
    counts = stored(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "manifest-counts")
    trees = Trees(rows.join(counts, "tree").select("tree", "at", F.col("leaf").alias("node"), "n", "doc_id", "changed"), "manifest")

    # the languages are ordered by name; their subroots are the leaves of one more tree
    named = global_rank(trees.tops.withColumn("one", F.lit("")), ["tree"], ["one"], "rank", total="n")
    named = stored(named.select("one", "tree", (F.col("rank") - 1).alias("at"), "top", F.col("n").cast("long").alias("n")), "manifest-subroots")
    last = Trees(named.select(F.col("one").alias("tree"), "at", F.col("top").alias("node"), "n"), "manifest-root")
    ends = last.node_paths().join(last.tops.withColumnRenamed("top", "root"), "tree").select(F.col("at").alias("e_at"), F.col("path").alias("end"), "root")
    ends = named.join(ends, F.col("at") == F.col("e_at")).select(F.col("tree").alias("e_tree"), F.col("top").alias("subroot"), "end", "root")
    paths = trees.block_paths().join(stored(ends, "manifest-ends"), F.col("tree") == F.col("e_tree"))
    paths = paths.select("tree", "block", "n", F.concat("path", "end").alias("path"), "subroot", "root")
    both = trees.rounds[0].groupBy("tree", "block").cogroup(paths.groupBy("tree", "block"))
    return both.applyInArrow(_proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proved(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Proofs of the leaves of a block, and what their own or changed leaves fold to."""
    n, path, subroot, root = (above.column(c)[0].as_py() for c in ("n", "path", "subroot", "root"))
    slots, slot = _slots(nodes)
    levels, upper = _reduced(slots, _steps(n, 0)), _unpacked(path)
    tail = "".join(x.hex() for _, others in upper for x in others)
    proof, folded = [], []
    for s, changed in zip(slot, nodes.column("changed").to_pylist()):
        own = _siblings(levels, s)
        proof.append(hashlib.sha256(("".join(x.hex() for _, others in own for x in others) + tail).encode()).hexdigest())
        folded.append(_folded(_folded(slots[s] if changed is None else changed, own), upper))
    return pa.table({
        "doc_id": nodes.column("doc_id"), "leaf": pa.array([slots[s].hex() for s in slot], pa.string()),
        "subroot": pa.array([subroot.hex()] * len(slot), pa.string()), "root": pa.array([root.hex()] * len(slot), pa.string()),
        "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array([x.hex() for x in folded], pa.string()),
        "verified": pa.array([x == root for x in folded], pa.bool_()),
    })
