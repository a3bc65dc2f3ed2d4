"""SimHash near duplicates: fingerprints, pigeonhole blocks, components.

A fingerprint of 64 bits is cut into `distance + 2` blocks. Two fingerprints that differ in at most `distance` bits
agree in two blocks at least (pigeonhole), so every pair of blocks is a join key of about 64 * 2 / (distance + 2)
bits. Only different fingerprints are joined; equal ones are one class from the start.

Keys that many fingerprints share are not joined: the pairs of a hot block grow with its square. Their fingerprints
go through an exact detour whose rows grow in proportion: each names all points that differ from it in at most
`distance / 2` bits (rounded up on one side), and fingerprints that name the same point are linked through it. For a distance of 2 or less
two fingerprints are close exactly if they share a point within one bit of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from talus.llm.common import forget, fresh, stored, texts

SEED = 42
HOT = 64  # fingerprints of one block key above which the detour is taken
BITS = 64


def _shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included. Words are what ASCII white space separates, A-Z in lower case;
    with fewer words than `words` the whole sequence is the only shingle, and without a word there is none."""
    held = text.lower().split()
    if not held:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(held)
    ends = np.cumsum(np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1) - 1
    n = max(1, len(held) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(held)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64, count=n)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of big-endian 64-bit words, the bits that are set in over half the rows."""
    counts = np.zeros(hashes.shape[1] * BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so few that a count fits a byte
        part = np.ascontiguousarray(hashes[at : at + 255]).astype(">u8").view(np.uint8)
        counts += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.uint8)
    return counts * 2 > len(hashes)


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text's word shingles in 64 bits; 0 without a word."""
    hashes = _shingle_hashes(text, words)
    return int.from_bytes(np.packbits(_majority(hashes[:, None])).tobytes()) if len(hashes) else 0


def wide_fingerprint(text: bytes, words: int, width: int) -> bytes:
    """SimHash of the set of shingles in `width` 64-bit words: each shingle's hash is mixed anew for every word."""
    return _wide(np.unique(_shingle_hashes(text, words)), width)


def _wide(hashes: np.ndarray, width: int) -> bytes:
    counts = np.zeros(64 * width, dtype=np.int64)
    steps = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # a byte holds as many
        with np.errstate(over="ignore"):
            mixed = (hashes[at : at + 255, None] ^ steps) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xC4CEB9FE1A85EC53)
            mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column(1).cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _bits_apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b), a > b: links between different fingerprints (column `fp`, distinct, stored) whose transitive closure
    is that of all pairs at most `distance` bits apart. Pairs of blocks that are not hot give every pair."""
    if distance > 2:
        raise ValueError("the exact detour for hot blocks covers distances up to 2")
    count = distance + 2
    edges = [BITS * i // count for i in range(count + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(count)]
    keys = []
    for number, pair in enumerate(combinations(range(count), 2)):
        mask = masks[pair[0]] | masks[pair[1]]
        keys.append(F.struct(F.lit(number).alias("pair"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("block")))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.pair", "key.block")
    sizes = keyed.groupBy("pair", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = stored(keyed.join(sizes, ["pair", "block"]), "simhash-blocks")
    few = placed.where(F.col("n") <= hot)
    close = few.select("pair", "block", F.col("fp").alias("a")).join(few.select("pair", "block", F.col("fp").alias("b")), ["pair", "block"])
    close = close.where((F.col("a") > F.col("b")) & (_bits_apart("a", "b") <= distance)).select("a", "b").distinct()
    # hot keys: every fingerprint and its neighbours one bit away are meeting points
    crowded = placed.where(F.col("n") > hot).select("fp").distinct()
    flips = F.array(*[F.lit(v) for v in [0, *(1 << i for i in range(63)), -(1 << 63)]])
    points = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    if distance < 2:
        points = points.where(F.col("point") == F.col("fp")) if distance == 0 else points
    met = points.groupBy("point").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all"))  # 65 at most
    detour = met.select(F.explode("all").alias("a"), "b").where(F.col("a") != F.col("b"))
    if distance == 1:
        detour = detour.where(_bits_apart("a", "b") <= 1)
    return close.unionByName(detour).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, label), stored, of every node that an edge (a, b) touches: the smallest node of its component.

    Every round each node points at its smallest neighbour (or itself) and from there to the end of that path; the edges
    are then carried over to these ends, where most of them meet and drop out. No two ends of a path were neighbours, so
    at most half of the nodes are left after two rounds, and all rounds together read little more than the first.
    Rounds are written to the shared folder.
    """
    rounds: list[DataFrame] = []
    edges = stored(edges.select("a", "b"), "component-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("fp"), F.least("a", "b").alias("label"))
        rounds.append(ends := _path_ends(near))
        ends_a, ends_b = (ends.select(F.col("fp").alias(x), F.col("label").alias(f"{x}_end")) for x in "ab")
        moved = edges.join(ends_a, "a").join(ends_b, "b").where("a_end != b_end")
        edges = stored(moved.select(F.greatest("a_end", "b_end").alias("a"), F.least("a_end", "b_end").alias("b")).distinct(), "component-edges")
    labels = edges.select(F.col("a").alias("fp"), F.col("b").alias("label"))  # of the nodes that are left: none
    for ends in reversed(rounds):
        later = labels.select(F.col("fp").alias("end"), F.col("label").alias("last"))
        labels = ends.join(later, F.col("label") == F.col("end"), "left").select("fp", F.coalesce("last", "label").alias("label"))
    return stored(labels, "component-labels")


def _stars(labels: DataFrame) -> DataFrame:
    """(a, b): the fewest links that join the components again, from each node (fp) to its label."""
    return labels.where("fp != label").select(F.col("fp").alias("a"), F.col("label").alias("b"))


def _path_ends(near: DataFrame) -> DataFrame:
    """(fp, label), stored: for (fp, label) that lead from node to node, where the path from each node ends. A written
    round makes the paths four times as short."""
    near = stored(near, "component-paths")
    while True:
        hop = near.select(F.col("fp").alias("h"), F.col("label").alias("next"))
        moved = near
        for _ in range(3):
            moved = moved.join(hop, F.col("label") == F.col("h")).select("fp", F.col("label").alias("old"), F.col("next").alias("label"))
        moved = stored(moved, "component-paths")
        near = moved.drop("old")
        if moved.where("label != old").isEmpty():
            return near


def near_groups(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 lower-case hex digits), component_id, n_links.

    Documents whose fingerprints differ in at most `distance` bits are linked; a component's id is the smallest
    doc_id in it; `n_links` counts the links that were followed from the fingerprint. Null and empty texts have
    fingerprint 0 and are linked like any other. A row with a null id belongs to its component but never names it
    unless all its ids are null.
    """
    prints = stored(fingerprints(docs, words), "simhash")
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rank")), "simhash-classes")
    edges = stored(links(fps.select("fp"), distance), "simhash-links")
    members = components(edges).join(fps, "fp")
    roots = members.join(members.groupBy("label").agg(F.min("rank").alias("root")), "label").select("fp", "root")
    counts = edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    classes = fps.join(roots, "fp", "left").join(counts, "fp", "left")
    classes = classes.select(F.col("fp").alias("c_fp"), F.coalesce("root", "rank").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    joined = prints.join(classes, F.col("fp") == F.col("c_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


# --- groups by similarity -------------------------------------------------------------------------------------
#
# Texts whose shingle sets are similar to 0.8 differ in about 15 % of their fingerprint's bits, far more than a
# 64-bit fingerprint can split among blocks. A wide fingerprint has room for many blocks of enough bits each: a pair
# at the threshold agrees in 4.6 of them on average, closer pairs in many more. The Hamming distance only proposes
# links; the shingle sets decide.

TILE = 1024  # rows of a group that one task compares with each other
LEADERS = 16  # rows of a large group that each of its tiles is compared with
SPARE = 6.0  # standard deviations above the expected distance at the threshold that a proposed pair may have
MISSED = 0.01  # share of the pairs at the threshold that meet in no block


def _share(similarity: float) -> float:
    """Expected share of differing bits of sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_for(similarity: float, bits: int, spare: float = SPARE) -> int:
    """Differing bits that sets of this Jaccard similarity have at most, with `spare` standard deviations to spare."""
    share = _share(similarity)
    return round(bits * share + spare * math.sqrt(bits * share * (1 - share)))


def blocks_for(similarity: float, block_bits: int, missed: float = MISSED) -> int:
    """Blocks of so many bits, of which a pair of this similarity shares one but for `missed` of the cases."""
    return math.ceil(math.log(missed) / math.log1p(-((1 - _share(similarity)) ** block_bits)))


def block_bits_for(rows: int) -> int:
    """Bits of a block, so that of so many rows few share one by chance."""
    return min(40, max(16, math.ceil(math.log2(max(rows, 1))) + 2))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, blocks: int | None = None, block_bits: int | None = None, hot: int = 8, tile: int = TILE) -> DataFrame:
    """(doc_id, keep_id) for every row: documents linked by similar word shingles, and the smallest id of each group.

    Pairs that share a block are proposed by the Hamming distance of their whole fingerprints. Blocks that more than
    `hot` different fingerprints share are compared in tiles (see `closure`), which leaves no pair out. What is
    connected by proposed pairs is compared by exact shingle sets, again until no pair of two components is left.
    Equal fingerprints are one class from the start. `block_bits` follows the number of rows and `blocks` follows it
    unless they are given.

    Null and empty texts have no shingle and are one class; a row with a null id is a group of its own.
    """
    known = texts(docs).where("doc_id IS NOT NULL")
    block_bits = block_bits or block_bits_for(known.count())
    blocks = blocks or blocks_for(similarity, block_bits)
    width = -(-blocks * block_bits // BITS) + 1  # the last word is a sketch that most chance pairs fail
    limit = bits_for(similarity, width * BITS)
    if block_bits > 48:
        raise ValueError("a block's value and number have to fit 64 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [wide_fingerprint(t.as_buffer().to_pybytes(), words, width) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "fp"])

    prints = stored(known.mapInArrow(run, "doc_id long, fp binary"), "wide-simhash")
    weights = 1 << np.arange(block_bits - 1, -1, -1, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(flat, axis=1)[:, : blocks * block_bits].reshape(-1, blocks, block_bits)
                buckets = (bits @ weights) * blocks + np.arange(blocks)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * blocks)
                sketches = np.ascontiguousarray(flat[:, -8:]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(buckets.ravel())), pa.array(sketches)], names=["fp", "node", "buckets", "sketch"])

    # one row for each class, with all its blocks; the JVM takes them apart
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    classes = stored(classes.mapInArrow(deal, "fp binary, node long, buckets array<long>, sketch long"), "wide-classes")
    counted = classes.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = classes.select("node", "sketch", F.explode("buckets").alias("bucket"))
    members = stored(keyed.join(counted, "bucket"), "wide-members")
    crowd = members.where(F.col("n") > hot).select(F.col("bucket").alias("group"), "node").distinct()
    near = _near_bits(limit)
    linked = components(closure(crowd.join(classes.select("node", F.col("fp").alias("load")), "node"), near, tile).distinct())
    # what the crowded blocks have linked needs no further pairs
    few = members.where(F.col("n") <= hot).join(linked.select(F.col("fp").alias("k"), "label"), F.col("node") == F.col("k"), "left")
    few = few.withColumn("label", F.coalesce("label", "node"))
    sides = [few.select("bucket", F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("label").alias(f"l{x}")) for x in "ab"]
    proposed = (F.col("a") > F.col("b")) & (F.col("la") != F.col("lb")) & (_bits_apart("sa", "sb") <= bits_for(similarity, BITS, 4.6))
    links_ = _verified(sides[0].join(sides[1], "bucket").where(proposed).select("a", "b"), classes, limit).unionByName(_stars(linked))
    loose = components(links_).select(F.col("fp").alias("node"), F.col("label").alias("group"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(_shingle_hashes(t.as_buffer().to_pybytes(), words)).tobytes() for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(held, pa.binary())], names=["group", "node", "load"])

    held = known.join(loose, F.col("doc_id") == F.col("node")).select("group", "node", "text").mapInArrow(sets, "group long, node long, load binary")
    labels = components(closure(held, _near_sets(similarity), tile).where("a != b")).select(F.col("fp").alias("node"), "label")
    named = classes.join(labels, "node", "left").select(F.col("fp").alias("c_fp"), F.coalesce("label", "node").alias("keep_id"))
    grouped = prints.join(named, F.col("fp") == F.col("c_fp")).select("doc_id", "keep_id")
    return grouped.unionByName(texts(docs).where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("keep_id")))


def _near_bits(limit: int):
    """A `near` for `closure`: fingerprints that differ in at most `limit` bits."""

    def near(loads: list[bytes]):
        held = np.frombuffer(b"".join(loads), np.uint8).reshape(len(loads), -1)
        signs = np.unpackbits(held, axis=1).astype(np.float32) * 2 - 1
        return lambda i, others: others[signs[others] @ signs[i] >= signs.shape[1] - 2 * limit]

    return near


def _near_sets(similarity: float):
    """A `near` for `closure`: sets of hashes (sorted, eight bytes each) of at least this Jaccard similarity. Sets whose short
    fingerprints lie too far apart by six standard deviations are not compared: a pair at the threshold is lost that way
    once in 10^8; sets of under 16 hashes, for which that does not hold, always are."""

    def near(loads: list[bytes]):
        held = [np.frombuffer(x, np.uint64) for x in loads]
        sizes = np.array([len(x) for x in held])
        limit = bits_for(similarity, 16 * BITS)
        signs = np.unpackbits(np.frombuffer(b"".join(_wide(x, 16) for x in held), np.uint8).reshape(len(held), -1), axis=1).astype(np.float32) * 2 - 1

        def close(i: int, others: np.ndarray) -> np.ndarray:
            low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            others = others[low >= similarity * high - 1e-9]
            if len(others):
                others = others[(signs[others] @ signs[i] >= signs.shape[1] - 2 * limit) | (sizes[others] < 16)]
            if not len(others) or not sizes[i]:
                return others  # empty sets are equal
            every = np.concatenate([held[j] for j in others])
            at = np.minimum(np.searchsorted(held[i], every), sizes[i] - 1)
            found = np.concatenate([[0], np.cumsum(held[i][at] == every)])
            stops = np.cumsum(sizes[others])
            shared = found[stops] - found[stops - sizes[others]]
            return others[shared >= similarity * (sizes[others] + sizes[i] - shared) - 1e-9]

        return close

    return near


def closure(rows: DataFrame, near, tile: int = TILE) -> DataFrame:
    """(a, b), stored: links between the nodes of a group whose transitive closure is that of all its pairs that are near.

    `rows` has group, node and load. `near(loads)` gives a function of one row's number and an array of others' which
    names those that are near. A group of at most `tile` rows is compared in one task. A larger one is cut into tiles;
    each is compared in itself and with leaders of the group, which links most of what belongs together. Then the rows
    that are not in the group's largest component are compared with every row of another component, a pair of tiles in a task:
    no pair of two components is left untested, and pairs of one component cannot add anything.
    """
    rows = stored(rows, "closure-rows")
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = rows.join(stored(sizes, "closure-sizes").withColumn("tiles", F.ceil(F.col("n") / tile).cast("long")), "group")
    bins = max(1, rows.count() // tile)
    small = placed.where("tiles = 1").withColumns({"x": F.lit(-1).cast("long"), "y": F.pmod(F.xxhash64("group"), F.lit(bins))})
    large = placed.where("tiles > 1")
    parts = large.withColumns({"x": F.col("group"), "y": F.pmod(F.xxhash64("node", "load"), F.col("tiles"))})
    heads = large.groupBy("group", "tiles", F.pmod(F.hash("node"), F.lit(LEADERS)).alias("k")).agg(F.min(F.struct("node", "load")).alias("m"))
    heads = heads.select("group", F.col("m.node").alias("node"), F.col("m.load").alias("load"), F.col("group").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("y"))
    columns = ["x", "y", "group", "node", "load"]
    first = small.select(columns).unionByName(parts.select(columns)).unionByName(heads.select(columns))
    first = first.withColumns({"label": F.col("node"), "side": F.lit(0)})
    links_ = stored(first.groupBy("x", "y").applyInArrow(_in_tile(near, False), "a long, b long"), "closure-links")
    if large.isEmpty():
        return links_
    labels = components(links_.distinct())
    named = large.join(labels, F.col("node") == F.col("fp"), "left").select("group", "node", "load", F.coalesce("label", "node").alias("label"))
    named = stored(named, "closure-named")
    most = named.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("group")
    most = most.agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    most = most.select("group", "major", F.ceil((F.col("all") - F.col("most")) / tile).cast("long").alias("rows"), F.ceil(F.col("all") / tile).cast("long").alias("columns"))
    open_ = named.join(stored(most, "closure-open"), "group")
    place = F.xxhash64("node", "load")
    zero = F.lit(0).cast("long")
    minor = open_.where("label != major").select("group", "node", "load", "label", F.lit(0).alias("side"), F.pmod(place, F.col("rows")).alias("x"), F.explode(F.sequence(zero, F.col("columns") - 1)).alias("y"))
    every = open_.select("group", "node", "load", "label", F.lit(1).alias("side"), F.explode(F.sequence(zero, F.col("rows") - 1)).alias("x"), F.pmod(place, F.col("columns")).alias("y"))
    crossed = minor.unionByName(every).select("x", "y", "group", "node", "load", "label", "side")
    return _stars(labels).unionByName(stored(crossed.groupBy("group", "x", "y").applyInArrow(_in_tile(near, True), "a long, b long"), "closure-crossed"))


def _in_tile(near, crossed: bool):
    """Links that join what is near among the rows of each group; rows of one label are joined already. `crossed`:
    rows of side 0 are compared with those of side 1 only."""

    def run(table: pa.Table) -> pa.Table:
        group, node, label, side = (table.column(c).to_numpy() for c in ("group", "node", "label", "side"))
        load = table.column("load").to_pylist()
        a: list[int] = []
        b: list[int] = []
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(own) < 2:
                continue
            close = near([load[i] for i in own])
            nodes, sides = node[own], side[own]
            _, kinds = np.unique(label[own], return_inverse=True)
            mates = np.split(np.argsort(kinds, kind="stable"), np.cumsum(np.bincount(kinds))[:-1])
            left = np.ones(len(own), dtype=bool)
            for start in range(len(own)):
                if not left[start]:
                    continue
                queue = mates[kinds[start]].tolist()
                left[queue] = False
                while queue:
                    i = queue.pop()
                    others = np.flatnonzero(left & (sides != sides[i]) if crossed else left)
                    if not len(others):
                        continue
                    for j in close(i, others).tolist():
                        if left[j]:
                            a.append(max(int(nodes[i]), int(nodes[j])))
                            b.append(min(int(nodes[i]), int(nodes[j])))
                            same = mates[kinds[j]]
                            left[same] = False
                            queue.extend(same.tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verified(pairs: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose fingerprints differ in at most `limit` bits, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= limit
                yield batch.select(["a", "b"]).filter(pa.array(near))

    one = classes.select(F.col("node").alias("a"), F.col("fp").alias("x"))
    two = classes.select(F.col("node").alias("b"), F.col("fp").alias("y"))
    both = pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(run, "a long, b long"), "wide-verified")


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all columns, that name their group; one document of each group stays."""
    keep, = fresh(docs, "keep")
    named = similar_groups(docs, **options).where(F.col("doc_id") == F.col("keep_id")).select(F.col("doc_id").alias(keep)).distinct()
    stay = docs.join(named, F.col("doc_id") == F.col(keep), "left_semi")
    return stay.unionByName(docs.where("doc_id IS NULL"))
