"""Tree queries over (id, parent_id, name) rows.

`lineages` resolves every node's chain of ancestors once by pointer doubling: each round replaces a node's
pointer by its target's chain, so a tree of depth d needs log2(d) joins, not d. Subtrees, paths and the
closure are then plain filters and explodes over the stored chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from talus.operators.ordering import running_before
from talus.session import cut, written


def lineages(areas: DataFrame, id: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """id, chain (array of {id, name}, the node itself first), rooted.

    A chain ends at a root (`rooted`), at a node whose parent is missing, or, on a cycle, before the first
    repeated node; the last two are not `rooted`.
    """
    state = areas.select(
        F.col(id).cast("long").alias("id"),
        F.array(F.struct(F.col(id).cast("long").alias("id"), F.col(name).alias("name"))).alias("chain"),
        F.col(parent).cast("long").alias("next"),
        F.col(parent).isNull().alias("rooted"),
        F.col(parent).isNull().alias("done"),
    )
    active = True
    while active:
        seen = Observation()
        state = cut(_doubled(state).observe(seen, F.count_if(~F.col("done")).alias("active")))
        active = seen.get["active"] > 0
    return state.select("id", "chain", "rooted")


def _doubled(state: DataFrame) -> DataFrame:
    """Every open chain continued by the chain its pointer leads to."""
    up = state.select(*[F.col(c).alias(f"up_{c}") for c in state.columns])
    missing = F.col("up_id").isNull()
    step = (
        state.where(~F.col("done")).join(up, F.col("next") == F.col("up_id"), "left")
        .select(
            "id",
            F.when(missing, F.col("chain")).otherwise(F.concat("chain", "up_chain")).alias("chain"),
            F.col("up_next").alias("next"),
            F.coalesce("up_done", F.lit(True)).alias("done"),
            (~missing & F.col("up_done") & F.col("up_rooted")).alias("rooted"),
        )
        .withColumn("cyclic", F.size(F.array_distinct("chain.id")) < F.size("chain"))
        .select(
            "id",
            F.when(F.col("cyclic"), F.array_distinct("chain")).otherwise(F.col("chain")).alias("chain"),
            "next",
            (F.col("rooted") & ~F.col("cyclic")).alias("rooted"),
            (F.col("done") | F.col("cyclic")).alias("done"),
        )
    )
    return state.where(F.col("done")).unionByName(step)


def closure(lines: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(ancestor, descendant, depth), each node being its own ancestor at depth 0."""
    pairs = lines.select(F.col("id").alias("descendant"), F.posexplode("chain").alias("depth", "node")).select(
        F.col("node.id").alias("ancestor"), "descendant", "depth"
    )
    return pairs if max_depth is None else pairs.where(F.col("depth") <= max_depth)


def subtree(lines: DataFrame, root: int, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of one root's subtree, whatever the nodes' status."""
    depth = F.array_position(F.col("chain.id"), F.lit(root).cast("long")) - 1
    found = lines.select("id", depth.cast("int").alias("depth")).where(F.col("depth") >= 0)
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def descend(areas: DataFrame, root: int, max_depth: int | None = None, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, depth) of one root's subtree, level by level from the root down.

    A round joins the edges with the level before it, so what is written is the subtree and nothing else, and the search
    ends at its last level or at `max_depth`. A node that was met is not met again (cycles); an unknown root has no subtree;
    rows that repeat a node's id repeat in the result.
    """
    edges = areas.select(F.col(id).cast("long").alias("id"), F.col(parent).cast("long").alias("up"))
    own = F.col("id") == root
    # the root and its children in one scan
    first = edges.where(own | (F.col("up") == root)).select("id", F.when(own, 0).otherwise(1).alias("depth"))
    found, n = written(first, "subtree-level", roots=F.count_if(F.col("depth") == 0))
    roots = found.where("depth = 0")
    if not n["roots"] or max_depth == 0:
        return roots
    frontier, rows, depth = found.where("depth = 1"), n["rows"] - n["roots"], 1
    while rows and depth != max_depth:
        depth += 1
        below = edges.join(frontier.select(F.col("id").alias("up")), "up", "left_semi").select("id", F.lit(depth).alias("depth"))
        frontier, n = written(below.join(found.select("id"), "id", "left_anti"), "subtree-level")
        found, rows = found.unionByName(frontier), n["rows"]
    return found


# --- nested-set numbering ---------------------------------------------------------------------------------------
#
# A node's subtree is a range of pre-order positions. Sizes are summed up the tree and positions down the tree by
# pointer doubling, log2(depth) rounds each over narrow rows, so nothing of the size nodes x depth is ever made.

BLOCK = 32  # neighbouring positions that meet in a containment join


def nested_sets(areas: DataFrame, id: str = "id", parent: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """(numbered, rest). `numbered` has id, up, pos, size, depth, rooted: the subtree of a node is the positions from `pos`
    to `pos + size - 1`; siblings stand in the order of their ids, trees too. A node whose parent is missing heads a tree
    that is not `rooted`. `rest` has the (id, up) of nodes on a cycle or below one, which no range can describe. Ids
    have to be unique and not null."""
    nodes = areas.select(F.col(id).cast("long").alias("id"), F.col(parent).cast("long").alias("parent"))
    known = nodes.select(F.col("id").alias("up"))
    state = nodes.join(known, F.col("parent") == F.col("up"), "left").select(
        "id", "up", F.col("up").alias("jump"), F.lit(1).cast("long").alias("size"), F.col("up").isNotNull().cast("int").alias("depth"),
        F.when(F.col("up").isNull(), F.col("parent").isNull()).alias("rooted"))
    open_ = F.count_if(F.col("jump").isNotNull())
    last, still = None, None
    while still is None or (still and still != last):  # the nodes of a cycle, or below one, stay open for ever
        ahead = state.select(F.col("id").alias("k"), F.col("jump").alias("k_jump"), F.col("depth").alias("k_depth"), F.col("rooted").alias("k_rooted"))
        # after k rounds a node has summed the nodes less than 2^k below it, and its pointer leads 2^k up
        sums = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("r")).agg(F.sum("size").alias("more"))
        state = state.join(ahead, F.col("jump") == F.col("k"), "left").join(sums, F.col("id") == F.col("r"), "left").select(
            "id", "up", F.col("k_jump").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
            (F.col("depth") + F.coalesce("k_depth", F.lit(0))).alias("depth"), F.coalesce("rooted", "k_rooted").alias("rooted"))
        state, n = written(state, "nested-sizes", open=open_)
        last, still = still, n["open"]
    ranged, rest = state.where("jump IS NULL").drop("jump"), state.where("jump IS NOT NULL").select("id", "up")

    # a node stands behind its parent and behind its earlier siblings' subtrees; these steps add up along the way to its root
    placed = running_before(ranged, "size", ["id"], ["up"], "earlier")
    step = (F.col("earlier") + F.col("up").isNotNull().cast("int")).alias("pos")
    line, still = placed.select("id", "up", "size", "depth", "rooted", F.col("up").alias("jump"), step), 1
    while still:
        ahead = line.select(F.col("id").alias("k"), F.col("jump").alias("k_jump"), F.col("pos").alias("k_pos"))
        line = line.join(ahead, F.col("jump") == F.col("k"), "left").select(
            "id", "up", "size", "depth", "rooted", F.col("k_jump").alias("jump"), (F.col("pos") + F.coalesce("k_pos", F.lit(0))).alias("pos"))
        line, n = written(line, "nested-positions", open=open_)
        still = n["open"]
    return line.select("id", "up", "pos", "size", "depth", "rooted"), rest


def contained(numbered: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(ancestor, descendant, depth) of every pair of a node and a node of its subtree, itself at depth 0.

    Positions are cut into blocks of 32. A node appears in every block that its range reaches into, which over a block is
    its ancestors and its nodes, and meets the nodes that stand there."""
    first, last = F.expr(f"pos div {BLOCK}"), F.expr(f"(pos + size - 1) div {BLOCK}")
    # two steps, so that the range of a node near the root is not one long array
    spans = numbered.select("id", "pos", "size", "depth", first.alias("lo"), last.alias("hi"))
    spans = spans.withColumn("part", F.explode(F.sequence(F.expr("lo div 4096"), F.expr("hi div 4096"))))
    within = F.sequence(F.greatest("lo", F.col("part") * 4096), F.least("hi", F.col("part") * 4096 + 4095))
    above = spans.select(F.col("id").alias("ancestor"), F.col("pos").alias("a_pos"), "size", F.col("depth").alias("a_depth"), F.explode(within).alias("a_block"))
    below = numbered.select(F.col("id").alias("descendant"), "pos", F.col("depth").alias("d_depth"), first.alias("block"))
    inside = (F.col("pos") >= F.col("a_pos")) & (F.col("pos") < F.col("a_pos") + F.col("size"))
    if max_depth is not None:
        inside = inside & (F.col("d_depth") - F.col("a_depth") <= max_depth)
    pairs = above.join(below, (F.col("a_block") == F.col("block")) & inside)
    return pairs.select("ancestor", "descendant", (F.col("d_depth") - F.col("a_depth")).cast("int").alias("depth"))


def area_pairs(areas: DataFrame, max_depth: int | None = None, **columns) -> DataFrame:
    """The closure of a table of areas: ranges for what hangs together as trees, chains for cycles and below them."""
    numbered, rest = nested_sets(areas, **columns)
    pairs = contained(numbered, max_depth)
    if rest.isEmpty():
        return pairs
    chains = lineages(rest.withColumn("name", F.lit(None).cast("string")), "id", "up", "name")
    return pairs.unionByName(closure(chains, max_depth))


def subtree_sums(numbered: DataFrame, roots: DataFrame, values: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, depth, total) for the roots (column `id`): the sum of `values` (id, value) over the root's descendants at each
    depth from 0 to `max_depth` below it, itself at 0. Without `max_depth` one row for the whole subtree, at depth null.
    Sums of 0 are left out.

    The descendants of a node on one level stand next to each other in the order of positions, so each sum is a difference
    of two running sums over that level: one row for each node with a value and two for each root and depth.
    """
    none = F.lit(None).cast("int")
    level = none if max_depth is None else F.col("depth")
    steps = F.array(none) if max_depth is None else F.sequence(F.lit(0), F.lit(max_depth))
    zero = F.lit(0).cast("long")
    nodes = numbered.join(values.select("id", F.col("value").cast("long")), "id")
    nodes = nodes.select(level.alias("level"), "pos", F.lit(1).alias("kind"), "value", F.lit(None).cast("long").alias("root"), none.alias("step"), F.lit(0).alias("sign"))
    ends = F.array(F.struct(F.col("pos").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("pos") + F.col("size")).alias("at"), F.lit(1).alias("sign")))
    asked = numbered.join(roots.select("id"), "id", "left_semi").select(F.col("id").alias("root"), "depth", ends.alias("ends"), F.explode(steps).alias("step"))
    asked = asked.withColumn("end", F.explode("ends")).select(
        (none if max_depth is None else F.col("depth") + F.col("step")).alias("level"), F.col("end.at").alias("pos"), F.lit(0).alias("kind"),
        zero.alias("value"), "root", "step", F.col("end.sign").alias("sign"))
    summed = running_before(nodes.unionByName(asked), "value", ["pos", "kind"], ["level"], "before").where("kind = 0")
    totals = summed.groupBy("root", F.col("step").alias("depth")).agg(F.sum(F.col("sign") * F.col("before")).alias("total"))
    return totals.where("total <> 0")


def area_sums(areas: DataFrame, roots: DataFrame, values: DataFrame, max_depth: int | None = None, **columns) -> DataFrame:
    """`subtree_sums` over a table of areas; roots on a cycle, or below one, are summed over their chains."""
    numbered, rest = nested_sets(areas, **columns)
    totals = subtree_sums(numbered, roots, values, max_depth)
    if rest.isEmpty():
        return totals
    pairs = closure(lineages(rest.withColumn("name", F.lit(None).cast("string")), "id", "up", "name"), max_depth)
    pairs = pairs.join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").join(values, F.col("descendant") == F.col("id"))
    depth = F.lit(None).cast("int") if max_depth is None else F.col("depth")
    return totals.unionByName(pairs.groupBy(F.col("ancestor").alias("root"), depth.alias("depth")).agg(F.sum("value").alias("total")))


def path_of(chain: str = "chain") -> Column:
    return F.array_join(F.reverse(F.col(f"{chain}.name")), "/")


def area_paths(lines: DataFrame) -> DataFrame:
    """(id, area_path, area_depth) of every node that reaches a root."""
    return lines.where("rooted").select(
        "id", path_of().alias("area_path"), (F.size("chain") - 1).cast("int").alias("area_depth")
    )


def depth_first_key(path: Column) -> Column:
    """Sort key for true depth-first order: the separator must sort below every character of a name."""
    return F.replace(path, F.lit("/"), F.lit("\u0001"))


FEW = 1 << 17  # rows of a table that every task may hold, a level of a search for instance


def _small(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join that Spark broadcasts while it is small; a larger one never passes the driver."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def reachable(links: DataFrame, roots: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages reached from `roots` over `links(src, dst)`, each once with its distance, and the targets that
    are linked or given as a root but not stored in `pages(url)`.

    The links of stored pages are written once, whatever they are computed from. One breadth-first level per round; only
    the new frontier is expanded, and each level is written once.
    """
    known = pages.select("url").hint("merge")
    edges, _ = written(links.select("src", "dst").join(known, F.col("src") == F.col("url"), "left_semi"), "reach-links")
    frontier, n = written(roots.select(F.col("url"), F.lit(0).alias("distance")).distinct(), "reach-level")
    visited, distance, count = frontier, 0, n["rows"]
    total = count
    while count:
        distance += 1
        if distance % 16 == 0:
            visited, _ = written(visited, "reach-visited")
        targets = edges.join(_small(frontier, count), F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        seen, most = visited, total
        if total > FEW:
            targets, n = written(targets, "reach-targets")
            if n["rows"] <= FEW:
                seen, most = visited.join(F.broadcast(targets), "url", "left_semi"), n["rows"]
        fresh = targets.join(_small(seen.select("url"), most), "url", "left_anti")
        frontier, n = written(fresh.withColumn("distance", F.lit(distance)), "reach-level")
        visited, count = visited.unionByName(frontier), n["rows"]
        total += count
    return visited.join(known, "url", "left_semi"), visited.join(known, "url", "left_anti")
