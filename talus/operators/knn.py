"""Nearest-neighbour work on vector tables: exact top-k, partner mining and stored inverted lists.

Spark partitions and shuffles the vectors; inside a task blocks of them are compared by a matrix product and only what
survives (top-k rows, matched ids) leaves the task. No pair is ever emitted as a row. Rows are put into cells around
pivots, and on the sphere angles obey the triangle inequality, so cells and stretches of cells that cannot hold an answer
are not visited; the answer is exact wherever the pivots lie.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from talus.functions.vectors import to_matrix, unit_rows
from talus.session import cut, scratch, written

BLOCK_ROWS = 2048    # rows of one side in one block comparison
MOST_CELLS = 4096    # pivots of a search; every task holds them
LABEL_CELLS = 64     # pivots of one label
SIDES = 8            # tiles of the stored rows, or of a label's, that a row is sent to at most while tiles have room
TILE_FLOATS = 1 << 24  # numbers that the vectors of a tile have at most
ORDER_DIGITS = 12    # similarities are compared to this many digits, then by id
SLACK = 1e-6         # covers rounding in angles
SAME = 1e-11         # similarities that lie closer may be equal in ORDER_DIGITS digits

CANDIDATES = "query_id long, neighbour_id long, similarity double"


def by_length(rows: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(usable, errors, dim) of rows with a `vector`: usable ones have `dim` components, or where it is not given the
    commonest length (the longest of equals); errors have id, length and reason. A vector without direction is an error
    as well: it is not similar to anything."""
    sized = rows.withColumn("_length", F.coalesce(F.size("vector"), F.lit(-1)))
    if dim is None:
        first = sized.where("_length > 0").groupBy("_length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("_length").desc()).first()
        dim = first["_length"] if first else 0
    reason = F.when(F.col("_length") != dim, "length").when(~F.exists("vector", lambda x: x != 0), "zero").when(F.exists("vector", lambda x: x.isNull()), "gap")
    judged = sized.withColumn("_reason", F.when(F.col("_length") <= 0, "empty").otherwise(reason))
    errors = judged.where("_reason IS NOT NULL").select("id", F.col("_length").alias("length"), F.col("_reason").alias("reason"))
    return judged.where("_reason IS NULL").drop("_length", "_reason"), errors, dim


def _rank(candidates: DataFrame, k: int) -> DataFrame:
    order = [F.round("similarity", ORDER_DIGITS).desc(), F.col("neighbour_id").asc()]
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def nearest(queries: DataFrame, stored: DataFrame, k: int, exclude_self: bool = False, block_rows: int = BLOCK_ROWS, lists: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): the exact k nearest by cosine.

    Both inputs have (id long, vector array); vectors of another length than most stored ones, and those without direction,
    take no part (`by_length` names them). Self is excluded by id, not by position.

    The stored rows lie in `lists` cells around pivots, by default as many as the root of their number, and the cells lie in
    a few tiles. A query first visits the tile of the cell that can hold the nearest row; its k-th similarity there rules
    out every tile, and inside a tile every cell, whose rows are all farther away. A query is sent to a tile once, and many
    queries for one tile go in waves, so no task holds a whole hot cell.
    """
    usable, _, dim = by_length(stored.select("id", "vector"))
    asked, _, _ = by_length(queries.select("id", "vector"), dim)
    none = stored.sparkSession.createDataFrame([], CANDIDATES)
    n = usable.count()
    if not n:
        return _rank(none, k)
    if lists is None:  # no more than there are blocks to fill
        lists = min(MOST_CELLS, math.ceil(math.sqrt(n)), math.ceil(n / block_rows))
    cells = PivotCells(usable, lists, dim)
    tiles = Tiles(cells.sizes, tile_rows(n, dim, block_rows), cells.order())
    hosts = cells.rows.select("id", "vector", "cell", tiles.of("cell").alias("tile"))
    asked, _ = written(asked.select("id", "vector", cells.first_tile(tiles).alias("home")), "neighbour-queries")

    def away(q: pa.Table, units: np.ndarray, present: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ pivots[present].T, -1.0, 1.0)) - radius[present]

    pivots, radius = cells.pivots, cells.radius
    compare = _tile_compare(k, exclude_self, dim, block_rows, away)
    found = _probe(asked.select("id", "vector", F.lit(None).cast("double").alias("low"), F.col("home").alias("tile")), hosts, tiles, compare)
    if tiles.count > 1:
        found, _ = written(_rank(found, k).drop("rank"), "neighbours")
        reached = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("low"))
        asking = asked.join(reached, "id", "left")
        # outer: a plain explode makes Spark infer a filter that would run the function twice
        asking = asking.select("id", "vector", "low", "home", F.explode_outer(cells.tiles_within(tiles)).alias("tile"))
        found = found.unionByName(_probe(asking.where("tile <> home").drop("home"), hosts, tiles, compare))
    return _rank(found, k)


def tile_rows(rows: int, dim: int, block_rows: int) -> int:
    """Rows of a tile: an eighth of all, no less than a block and no more than a task holds easily."""
    return max(1, min(max(block_rows, math.ceil(rows / SIDES)), TILE_FLOATS // max(dim, 1)))


class Tiles:
    """Cells side by side in tiles of `rows` rows; a row's place in its cell comes from the hash of its id, so a crowded cell
    reaches over several tiles and small ones share one. `sizes` are the rows of each cell."""

    def __init__(self, sizes: np.ndarray, rows: int, order: np.ndarray | None = None):
        order = np.arange(len(sizes)) if order is None else order
        self.sizes, self.rows = sizes.astype(np.int64), rows
        self.starts = np.zeros(len(sizes), dtype=np.int64)
        self.starts[order] = np.cumsum(self.sizes[order]) - self.sizes[order]
        self.count = max(1, math.ceil(int(self.sizes.sum()) / rows))
        numbers = np.arange(self.count)
        first, last = self.starts // rows, (self.starts + self.sizes - 1) // rows
        self.cover = ((numbers >= first[:, None]) & (numbers <= last[:, None]) & (self.sizes > 0)[:, None]).astype(np.float32)

    def place(self, cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return (self.starts[cells] + np.mod(hashes, np.maximum(self.sizes[cells], 1))) // self.rows

    def of(self, cell: str):
        @F.arrow_udf("int")
        def tile(cells: pa.Array, hashes: pa.Array) -> pa.Array:
            return pa.array(self.place(cells.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)).astype(np.int32))

        return tile(cell, F.xxhash64("id"))

    def touched(self, wanted: np.ndarray) -> pa.Array:
        """For each row of wanted cells the tiles that these cells reach into."""
        held = wanted.astype(np.float32) @ self.cover > 0
        offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(held)[1].astype(np.int32)))


class PivotCells:
    """Rows (id, vector) with the cell of their nearest pivot, and each cell's radius: the largest angle between a member
    and the pivot. A row at angle `a` from a pivot is at least `a - radius` away from every member of its cell."""

    def __init__(self, rows: DataFrame, lists: int, dim: int):
        # any rows do as pivots; `lists` of them, MOST_CELLS at most unless the caller asks for more
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(lists).select("vector").toArrow()
        self.pivots = unit_rows(to_matrix(drawn["vector"], dim))
        self.rows, _ = written(rows.withColumn("_home", self._home()).select("id", "vector", "_home.cell", "_home.angle"), "pivot-cells")
        self.radius, self.sizes = np.full(len(self.pivots), -np.inf), np.zeros(len(self.pivots), dtype=np.int64)
        for row in self.rows.groupBy("cell").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # one row per cell
            self.radius[row["cell"]], self.sizes[row["cell"]] = row["r"], row["n"]

    def order(self) -> np.ndarray:
        """The cells by the angle of their pivot to the first one."""
        return np.argsort(-(self.pivots @ self.pivots[0]), kind="stable")

    def _angles(self, vectors: pa.Array) -> np.ndarray:
        return _angles(vectors, self.pivots)

    def _home(self):
        pivots = self.pivots

        @F.arrow_udf("cell int, angle double")
        def home(vectors: pa.Array) -> pa.Array:
            angles = _angles(vectors, pivots)
            best = angles.argmin(axis=1)
            return pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(angles[np.arange(len(best)), best])], ["cell", "angle"])

        return home("vector")

    def first_tile(self, tiles: Tiles):
        """The tile of the cell that can hold the row nearest to a query (`vector`)."""
        pivots, radius = self.pivots, self.radius

        @F.arrow_udf("int")
        def home(vectors: pa.Array, hashes: pa.Array) -> pa.Array:
            cells = (_angles(vectors, pivots) - radius).argmin(axis=1)  # empty cells are infinitely far
            return pa.array(tiles.place(cells, hashes.to_numpy(zero_copy_only=False)).astype(np.int32))

        return home("vector", F.xxhash64("id"))

    def tiles_within(self, tiles: Tiles):
        """The tiles with cells that can hold a row at least as similar to a query (`vector`) as its `low`, where it has one."""
        pivots, radius = self.pivots, self.radius

        @F.arrow_udf("array<int>")
        def within(vectors: pa.Array, lows: pa.Array) -> pa.Array:
            low = lows.fill_null(-1.0).to_numpy(zero_copy_only=False)
            return tiles.touched(_angles(vectors, pivots) - radius <= np.arccos(np.clip(low, -1.0, 1.0))[:, None] + SLACK)

        return within("vector", "low")


def _angles(vectors: pa.Array, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(to_matrix(vectors, pivots.shape[1])) @ pivots.T, -1.0, 1.0))


def _side(df: DataFrame, prefix: str) -> DataFrame:
    """Every column under a new name, so that a table can be cogrouped with itself."""
    return df.select(*[F.col(c).alias(f"{prefix}_{c.lstrip('_')}") for c in df.columns])


def _tile_compare(k: int, exclude_self: bool, dim: int, block_rows: int, away):
    """Cogroup function: the k best stored rows of each query in a tile (similarity down, then id up), block by block;
    undefined similarities never count. A query with a `low` is after rows that are at least as similar.
    `away(table, units, cells)` is the least angle of each query to a row of each cell."""

    def compare(q: pa.Table, s: pa.Table) -> pa.Table:
        ids, found, sims_found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if q.num_rows and s.num_rows:
            order = np.argsort(s["s_cell"].to_numpy(), kind="stable")
            present, starts = np.unique(s["s_cell"].to_numpy()[order], return_index=True)
            stops = [*starts[1:], len(order)]
            held, s_ids = unit_rows(to_matrix(s["s_vector"], dim))[order], s["s_id"].to_numpy()[order]
            asked, q_ids = unit_rows(to_matrix(q["q_vector"], dim)), q["q_id"].to_numpy()
            least = away(q, asked, present)
            lows = q["q_low"].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
            turn = np.argsort(least.argmin(axis=1), kind="stable")  # queries of a block are near the same cells
            for at in range(0, len(turn), block_rows):
                rows = turn[at : at + block_rows]
                best = _Best(q_ids[rows], lows[rows], k, exclude_self)
                for c in np.argsort(least[rows].mean(axis=0), kind="stable").tolist():
                    for first in range(starts[c], stops[c], block_rows):
                        # NaN, a vector with gaps, is never near
                        near = np.flatnonzero(least[rows, c] <= np.arccos(np.clip(best.low, -1.0, 1.0)) + SLACK)
                        if len(near):
                            block = slice(first, min(first + block_rows, stops[c]))
                            best.offer(near, asked[rows[near]] @ held[block].T, s_ids[block])
                r, place = np.nonzero(best.sims > -np.inf)
                ids.append(q_ids[rows[r]])
                found.append(best.ids[r, place])
                sims_found.append(best.sims[r, place])
        return pa.table({"query_id": np.concatenate(ids), "neighbour_id": np.concatenate(found), "similarity": np.concatenate(sims_found)})

    return compare


class _Best:
    """The k best rows so far of a block of queries, and in `low` what a row needs at least to be one of them."""

    def __init__(self, query_ids: np.ndarray, low: np.ndarray, k: int, exclude_self: bool):
        self.query_ids, self.low, self.k, self.exclude_self = query_ids, low.copy(), k, exclude_self
        self.sims, self.ids = np.full((len(low), k), -np.inf), np.zeros((len(low), k), dtype=np.int64)

    def offer(self, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """Similarities of the queries `rows` to stored rows."""
        low, width = self.low[rows], sims.shape[1]
        new = np.flatnonzero(low == -np.inf)
        if len(new) and width > self.k:  # at or above the k-th value of the block, so that equal values are still ordered by id
            part = sims[new]
            part[np.isnan(part)] = -np.inf
            if self.exclude_self:
                part[self.query_ids[rows[new], None] == ids[None, :]] = -np.inf
            low[new] = np.partition(part, width - self.k, axis=1)[:, width - self.k]
        at, col = np.nonzero(sims >= (low - SAME)[:, None])
        if self.exclude_self:
            other = self.query_ids[rows[at]] != ids[col]
            at, col = at[other], col[other]
        if not len(at):
            return
        touched = np.unique(rows[at])
        every = np.concatenate([np.repeat(touched, self.k), rows[at]])
        sims, ids = np.concatenate([self.sims[touched].ravel(), sims[at, col]]), np.concatenate([self.ids[touched].ravel(), ids[col]])
        order = np.lexsort((ids, -np.round(sims, ORDER_DIGITS), every))
        place = np.arange(len(order)) - np.searchsorted(every[order], every[order], side="left")
        order, place = order[place < self.k], place[place < self.k]
        self.sims[every[order], place], self.ids[every[order], place] = sims[order], ids[order]
        self.low[touched] = np.maximum(self.low[touched], self.sims[touched, self.k - 1])


def _probe(asking: DataFrame, stored: DataFrame, tiles: Tiles, compare) -> DataFrame:
    """Candidates of queries (id, vector, low, tile, what else `compare` reads) among stored rows (id, vector, cell, tile) of
    the same tile. Many queries for one tile go in waves of half a tile's rows."""
    waves = F.ceil(F.count(F.lit(1)) / F.lit(max(1, tiles.rows // 2))).cast("int")
    plan = F.broadcast(asking.groupBy("tile").agg(waves.alias("_waves")))  # one row per tile
    hosts = stored.join(plan, "tile").withColumn("_wave", F.explode(F.sequence(F.lit(0), F.col("_waves") - 1)))
    guests = asking.join(plan, "tile").withColumn("_wave", F.pmod(F.xxhash64("id"), F.col("_waves")).cast("int"))
    guests, hosts = _side(guests.drop("_waves"), "q"), _side(hosts.drop("_waves"), "s")
    return guests.groupBy("q_tile", "q_wave").cogroup(hosts.groupBy("s_tile", "s_wave")).applyInArrow(compare, CANDIDATES)


# --- partner mining ---------------------------------------------------------------------------------------


def with_partner(df: DataFrame, label: str, id: str, vector: str, threshold: float, block_rows: int = BLOCK_ROWS, lists: int = LABEL_CELLS) -> DataFrame:
    """Rows that form at least one pair with cosine > threshold inside their label.

    Every label has pivots, one for a block's worth of rows and more with the root of its size. Its rows lie in the cell of
    their nearest pivot, by their angle to it, in stretches of about `block_rows` rows (stretches that many rows share an
    angle of are split by hash). Rows first meet those of their own stretch. A row that found nobody then visits tiles of the
    whole label, `SIDES` at most until a tile's size is bounded, and in them the rows whose angles are within the
    threshold's angle of its own. Tasks answer with matched ids, never with pairs. Vectors of different lengths do not meet; null labels, null vectors and vectors
    without direction have no partner.
    """
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    slim = df.select(F.col(label).alias("label"), F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    slim = slim.where(F.col("label").isNotNull() & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))
    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("label", "id")}
    key = ["label", "dim"]
    sizes = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sized = slim.join(sizes, key).withColumns({
        "share": F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block_rows)).cast("int"),
        "pivot": F.pmod(F.hash("id"), F.least(F.lit(lists), F.ceil(F.sqrt(F.col("n") / block_rows)))).cast("int")})
    pivots = sized.groupBy(*key, "pivot").agg(F.min_by("vector", F.xxhash64("id")).alias("vector"))
    pivots = pivots.groupBy(*key).agg(F.flatten(F.collect_list("vector")).alias("pivots"))  # `lists` vectors at most

    def pack(group: tuple, rows: pa.Table) -> pa.Table:
        n, dim = rows.num_rows, group[1].as_py()
        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows["id"].combine_chunks())
        flat = pa.ListArray.from_arrays(pa.array([0, n * dim], pa.int32()), pa.array(to_matrix(rows["vector"], dim).ravel()))
        return pa.table({"label": rows["label"].slice(0, 1), "dim": pa.array([dim], pa.int32()), "ids": ids, "flat": flat})

    packed = sized.groupBy(*key, "share").applyInArrow(pack, f"label {kinds['label']}, dim int, ids array<{kinds['id']}>, flat array<double>")

    def assign(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids = batch.column("dim")[i].as_py(), batch.column("ids")[i].values
                rows, centres = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim) for c in ("flat", "pivots"))
                angles = np.arccos(np.clip(unit_rows(rows) @ unit_rows(centres).T, -1.0, 1.0))
                cell, n = angles.argmin(axis=1), len(rows)
                lists_of = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column("label")[i], n), pa.array(np.full(n, dim, np.int32)), ids, lists_of(rows), pa.array(cell.astype(np.int32)),
                     pa.array(angles[np.arange(n), cell]), lists_of(angles)], names=["label", "dim", "id", "vector", "cell", "angle", "angles"])

    schema = f"label {kinds['label']}, dim int, id {kinds['id']}, vector array<double>, cell int, angle double, angles array<double>"
    placed, _ = written(packed.join(pivots, key).mapInArrow(assign, schema), "partner-rows")

    # stretches of equal width over the angles of a cell, and parts of those that many rows share
    cells = placed.groupBy(*key, "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count(F.lit(1)) / block_rows).alias("bins"))
    cells = cells.withColumn("width", (F.col("high") - F.col("low")) / F.col("bins") + SLACK)
    cell = [*key, "cell"]
    bin_ = lambda angle: F.least(F.floor((angle - F.col("low")) / F.col("width")), F.col("bins") - 1)
    binned = placed.join(cells.select(*cell, "low", "width", "bins"), cell).withColumn("bin", bin_(F.col("angle"))).drop("low", "width", "bins")
    stretches = binned.groupBy(*cell, "bin").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    place = [*cell, "bin", "part"]
    binned = binned.join(stretches, [*cell, "bin"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")

    def inside(group: tuple, rows: pa.Table) -> pa.Table:
        unit = unit_rows(to_matrix(rows["vector"], group[1].as_py()))
        sims = unit @ unit.T
        np.fill_diagonal(sims, -np.inf)
        matched = (sims > threshold).any(axis=1)
        return rows.select(["id", *place, "angles"]).append_column("matched", pa.array(matched))

    found = binned.groupBy(*place).applyInArrow(inside, f"id {kinds['id']}, label {kinds['label']}, dim int, cell int, bin long, part long, angles array<double>, matched boolean")
    # a label of one block has nothing but cell, bin and part 0
    spread = F.count_if((F.col("cell") > 0) | (F.col("bin") > 0) | (F.col("part") > 0))
    settled, n = written(found, "partner-settled", left=F.count_if(~F.col("matched")), spread=spread)
    matched = settled.where("matched").select("id")
    if n["left"] and n["spread"]:
        seekers = settled.where("NOT matched").join(binned.select("id", *place, "vector"), ["id", *place])
        matched = matched.unionByName(_visitors(seekers, binned, sizes, place, reach, threshold, block_rows, kinds["id"]))
    return df.join(matched.withColumnRenamed("id", id), id, "left_semi")


def _visitors(seekers: DataFrame, binned: DataFrame, sizes: DataFrame, place: list[str], reach: float, threshold: float, block_rows: int, id_type: str) -> DataFrame:
    """Ids of the seekers that have a partner in another stretch than their own.

    A label's rows are dealt by hash into `SIDES` tiles, more only where these would not fit a task, and a seeker is sent to
    each tile once. Inside a task the rows of a cell lie in the order of their angle, and a block of seekers meets
    those within `reach` of it."""
    key, group = ["label", "dim"], ["label", "dim", "tile", "wave"]
    most = F.greatest(F.lit(1), F.floor(F.lit(TILE_FLOATS) / F.col("dim")))
    plan = sizes.join(seekers.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key)
    plan = plan.withColumn("rows", F.least(most, F.greatest(F.lit(block_rows), F.ceil(F.col("n") / SIDES))))
    plan = plan.select(*key, F.ceil(F.col("n") / F.col("rows")).alias("tiles"), F.ceil(F.col("m") / F.col("rows")).alias("waves"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    share = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    guests = seekers.join(plan, key).withColumn("wave", share("waves")).withColumn("tile", every("tiles"))
    hosts = binned.join(plan, key).withColumn("tile", share("tiles")).withColumn("wave", every("waves"))
    guests = _side(guests.select(*group, "id", "vector", "cell", "bin", "part", "angles"), "q")
    hosts = _side(hosts.select(*group, "vector", "cell", "bin", "part", "angle"), "s")

    def across(keys: tuple, q: pa.Table, s: pa.Table) -> pa.Table:
        left = np.ones(q.num_rows, dtype=bool)
        if q.num_rows and s.num_rows:
            dim = keys[1].as_py()
            order = np.lexsort((s["s_angle"].to_numpy(), s["s_cell"].to_numpy()))
            s = s.take(pa.array(order))
            asked, held = unit_rows(to_matrix(q["q_vector"], dim)), unit_rows(to_matrix(s["s_vector"], dim))
            toward = to_matrix(q["q_angles"], len(q["q_angles"][0]))
            spots = [np.stack([t[f"{x}_{c}"].to_numpy() for c in ("cell", "bin", "part")], axis=1) for x, t in (("q", q), ("s", s))]
            _, spot = np.unique(np.concatenate(spots), axis=0, return_inverse=True)
            own, there = spot[: q.num_rows], spot[q.num_rows :]
            angle, cell = s["s_angle"].to_numpy(), s["s_cell"].to_numpy()
            for c in np.unique(cell).tolist():
                first, last = np.searchsorted(cell, c, "left"), np.searchsorted(cell, c, "right")
                seek = np.flatnonzero(left)
                seek = seek[np.argsort(toward[seek, c], kind="stable")]
                for at in range(0, len(seek), block_rows):
                    rows = seek[at : at + block_rows]
                    # by the triangle inequality a partner's angle to the pivot lies within `reach` of the seeker's
                    start = first + np.searchsorted(angle[first:last], toward[rows[0], c] - reach, "left")
                    stop = first + np.searchsorted(angle[first:last], toward[rows[-1], c] + reach, "right")
                    for low in range(start, stop, block_rows):
                        block = slice(low, min(low + block_rows, stop))
                        hit = ((asked[rows] @ held[block].T > threshold) & (own[rows][:, None] != there[block][None, :])).any(axis=1)
                        left[rows[hit]] = False
                        rows = rows[~hit]
                        if not len(rows):
                            break
        return pa.table({"id": q["q_id"].filter(pa.array(~left))})

    met = guests.groupBy(*[f"q_{c}" for c in group]).cogroup(hosts.groupBy(*[f"s_{c}" for c in group]))
    return met.applyInArrow(across, f"id {id_type}").distinct()


# --- pair statistics without pairs ------------------------------------------------------------------------


def label_alignment(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, members, alignment): mean of 2-2(a.b) over the pairs of each label with two or more members.

    The sum of all pairwise dot products is (|sum v|^2 - sum |v|^2) / 2, so no pair has to be formed."""
    from pyspark.ml.functions import vector_to_array

    from talus.operators.prototypes import summaries

    stats = summaries(df.select(F.col(label).alias("label"), vector), "label", vector, "count", "sum", "normL2").where(F.col("s.count") > 1)
    square_sum = lambda v: F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)
    whole, own = square_sum(vector_to_array("s.sum")), square_sum(vector_to_array("s.normL2"))
    members = F.col("s.count")
    mean_dot = (whole - own) / (members * (members - 1))
    return stats.select("label", members.alias("members"), (F.lit(2.0) - F.lit(2.0) * mean_dot).alias("alignment"))


def alignment(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean of the per-label alignments; 0.0 where no label has two members."""
    return label_alignment(df, label, vector).agg(F.coalesce(F.avg("alignment"), F.lit(0.0)).alias("alignment"))


def uniformity(df: DataFrame, id: str, vector: str, sample: int = 2000, seed: int = 42, chunk: int = 250) -> DataFrame:
    """log(mean(exp(-2 d^2))) over the pairs of a seeded sample of at most `sample` rows.

    The sample is the statistic's own definition. Its rows are cut into chunks; each pair of chunks is one
    task that returns a sum and a count."""
    from talus.operators.sampling import order_key

    picked = df.select(F.col(id).alias("_id"), F.col(vector).alias("_vec")).orderBy(order_key(seed, F.col("_id")), "_id").limit(sample)
    chunks = max(1, math.ceil(sample / chunk))
    rows = picked.withColumn("_c", F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(chunks - 1))
    pairs = F.transform(every, lambda o: F.struct(F.least(F.col("_c"), o).alias("a"), F.greatest(F.col("_c"), o).alias("b")))
    placed = rows.withColumn("_p", F.explode(pairs)).select("_id", "_vec", "_c", "_p.a", "_p.b")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        left = np.stack(pdf.loc[pdf["_c"] == a, "_vec"]).astype(float) if (pdf["_c"] == a).any() else None
        right = np.stack(pdf.loc[pdf["_c"] == b, "_vec"]).astype(float) if (pdf["_c"] == b).any() else None
        if left is None or right is None:
            return pd.DataFrame({"total": [0.0], "pairs": [0]})
        d2 = (left ** 2).sum(1)[:, None] + (right ** 2).sum(1)[None, :] - 2 * left @ right.T
        terms = np.exp(-2 * np.maximum(d2, 0))
        if a == b:
            upper = np.triu_indices(len(left), 1)
            return pd.DataFrame({"total": [terms[upper].sum()], "pairs": [len(upper[0])]})
        return pd.DataFrame({"total": [terms.sum()], "pairs": [terms.size]})

    parts = placed.groupBy("a", "b").applyInPandas(sums, "total double, pairs long")
    return parts.agg(F.log(F.try_divide(F.sum("total"), F.sum("pairs"))).alias("uniformity"))


# --- inverted lists ---------------------------------------------------------------------------------------


def build_cells(stored: DataFrame, lists: int = 100, seed: int = 42) -> np.ndarray:
    """Unit centroids of at most `lists` k-means cells, fitted on all (id, vector) rows where they lie."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from talus.functions.vectors import normalise

    usable = stored.where(F.exists("vector", lambda x: x != 0))
    features = cut(usable.select(array_to_vector(normalise(F.col("vector"))).alias("features")))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(features)
    return unit_rows(np.array(model.clusterCenters()))


def assign_cells(df: DataFrame, centroids: np.ndarray, vector: str, probes: int = 1, name: str = "cell") -> DataFrame:
    """Add the nearest `probes` cells of each row, one row per cell. The centroid matrix is lists x dim."""
    # outer: a plain explode makes Spark infer a filter that would run the function twice
    return df.withColumn(name, F.explode_outer(nearest_cells(centroids, probes)(vector)))


def nearest_cells(centroids: np.ndarray, probes: int):
    """Arrow UDF: the nearest `probes` cells of each vector, nearest first."""
    take = min(probes, len(centroids))

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        best = np.argsort(-_centre_sims(vectors, centroids), axis=1, kind="stable")[:, :take].astype(np.int32)
        offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * take)
        return pa.ListArray.from_arrays(offsets, pa.array(best.ravel()))

    return cells


def _centre_sims(vectors: pa.Array, centroids: np.ndarray) -> np.ndarray:
    """Cosines to the centres; -2 for a vector without direction."""
    sims = unit_rows(to_matrix(vectors, centroids.shape[1])) @ centroids.T
    return np.where(np.isnan(sims), -2.0, np.clip(sims, -1.0, 1.0))


class InvertedLists:
    """A stored index: rows (id, vector) in a table partitioned by the cell of their nearest centroid, next to the
    centroids. A search reads the partitions of the cells that its queries probe and no others."""

    def __init__(self, path: str, centroids: np.ndarray):
        self.path, self.centroids = path, centroids

    @classmethod
    def build(cls, rows: DataFrame, lists: int = 100, path: str | None = None, block_rows: int = 1 << 20) -> InvertedLists:
        """Fit the centroids and write the lists. A list is as many files as it has `block_rows` rows, each from a task of
        its own."""
        usable, _, _ = by_length(rows.select("id", "vector"))
        centroids = build_cells(usable, lists)
        path = path or scratch(rows.sparkSession, "inverted-lists")
        placed = assign_cells(usable, centroids, "vector")
        share = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(usable.count() / lists / block_rows)))).cast("int")
        placed.repartition("cell", share).write.partitionBy("cell").parquet(f"{path}/lists")
        centre_rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        rows.sparkSession.createDataFrame(centre_rows, "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
        return cls(path, centroids)

    @classmethod
    def open(cls, spark, path: str) -> InvertedLists:
        found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        return cls(path, np.array([r["centroid"] for r in found]))

    def probed(self, queries: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
        """(asking, lists): the queries with the cells they probe, and the rows of those cells. The cells come out of a
        filtered table, so Spark prunes the partitions of the lists at run time."""
        spark = queries.sparkSession
        asking, _ = written(queries.select("id", "vector", nearest_cells(self.centroids, probes)("vector").alias("cells")), "list-queries")
        wanted = asking.select(F.explode("cells").alias("cell")).where(F.col("cell") >= 0).distinct()
        lists = spark.read.parquet(f"{self.path}/lists")
        return asking, lists.join(F.broadcast(wanted), "cell", "left_semi")  # a row per centroid at most

    def search(self, queries: DataFrame, k: int, probes: int = 10, exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(query_id, neighbour_id, similarity, rank) among the rows of each query's nearest `probes` cells; with all
        cells probed the exact answer."""
        usable, _, dim = by_length(queries.select("id", "vector"), self.centroids.shape[1])
        asking, lists = self.probed(usable, probes)
        return _among_cells(asking, lists, len(self.centroids), k, exclude_self, block_rows, dim)

    def probes_for(self, exact: DataFrame, recall: float = 0.9) -> int:
        """The fewest probes with which at least this share of the pairs of `exact` (query_id, neighbour_id) is found: the
        quantile of the place that a neighbour's cell has among its query's."""
        rows = exact.sparkSession.read.parquet(f"{self.path}/lists")
        homes = rows.select(F.col("id").alias("neighbour_id"), F.col("cell").alias("home"))
        orders = rows.select(F.col("id").alias("query_id"), nearest_cells(self.centroids, len(self.centroids))("vector").alias("cells"))
        places = exact.select("query_id", "neighbour_id").join(homes, "neighbour_id").join(orders, "query_id")
        counts = places.groupBy(F.array_position("cells", F.col("home")).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # a row per centroid at most
        total, found = sum(r["n"] for r in counts), 0
        for row in counts:
            found += row["n"]
            if found >= recall * total:
                return row["place"]
        return len(self.centroids)


def probe_nearest(queries: DataFrame, cells: DataFrame, centroids: np.ndarray, k: int, probes: int = 10,
                  exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate top-k: each query meets the vectors of its nearest `probes` cells only. `cells` is
    `assign_cells` output (id, vector, cell); `InvertedLists` keeps it as a table partitioned by cell."""
    usable = queries.select("id", "vector").where(F.col("vector").isNotNull())
    asking = cut(usable.withColumn("cells", nearest_cells(centroids, probes)("vector")))
    return _among_cells(asking, cells, len(centroids), k, exclude_self, block_rows, centroids.shape[1])


def _among_cells(asking: DataFrame, stored: DataFrame, count: int, k: int, exclude_self: bool, block_rows: int, dim: int) -> DataFrame:
    """The k nearest stored rows (id, vector, cell) of queries (id, vector, cells) in the cells of each."""
    sizes = np.zeros(count, dtype=np.int64)
    for row in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        sizes[row["cell"]] = row["n"]
    tiles = Tiles(sizes, tile_rows(int(sizes.sum()), dim, block_rows))

    def wanted(cells: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(cells), count), dtype=bool)
        out[np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()] = True
        return out

    @F.arrow_udf("array<int>")
    def tiles_of(cells: pa.Array) -> pa.Array:
        return tiles.touched(wanted(cells))

    def away(q: pa.Table, units: np.ndarray, present: np.ndarray) -> np.ndarray:
        return np.where(wanted(q["q_cells"].combine_chunks())[:, present], -math.pi, math.inf)

    hosts = stored.select("id", "vector", "cell", tiles.of("cell").alias("tile"))
    # outer: a plain explode makes Spark infer a filter that would run the function twice
    guests = asking.select("id", "vector", "cells", F.lit(None).cast("double").alias("low"), F.explode_outer(tiles_of("cells")).alias("tile")).where("tile IS NOT NULL")
    return _rank(_probe(guests, hosts, tiles, _tile_compare(k, exclude_self, dim, block_rows, away)), k)
