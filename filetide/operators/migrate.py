"""Migration: plan totals, waves, copy units, expected result, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import cut_lineage
from .skew import measured_join, number_within, running_min, running_sum, top_k

MIB = 1024 * 1024
MAX_FILES, MAX_HOURS = 100_000, 48
BAD_NAME = r'[\x00-\x1f<>:"/\\|?*]'  # fixed value: characters no folder name may hold
SINGLE, BUDGET, TOP_LEVEL = "SingleBatch", "BySizeBudget", "ByTopLevelFolder"


def _deepest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("level").alias("m")).first()["m"] or 0


# --- the design tree -------------------------------------------------------

def recursive_totals(nodes: DataFrame) -> DataFrame:
    """Size and file count of each node: the larger of its own estimate and its children's sum.

    Not a plain roll-up, so levels are worked from the deepest up: one grouped
    sum per level, each written once. A null file count stays unmeasured.
    """
    done, below = None, None
    for level in range(_deepest(nodes), -1, -1):
        here = nodes.where(F.col("level") == level)
        if below is None:
            joined = here.withColumn("_size", F.lit(None).cast("long")).withColumn("_files", F.lit(None).cast("long"))
        else:
            sums = below.where(F.col("parent_id").isNotNull()).groupBy("plan_id", F.col("parent_id").alias("node_id")).agg(
                F.sum("total_size").alias("_size"), F.sum("total_files").alias("_files")
            )
            joined = here.join(sums, ["plan_id", "node_id"], "left")
        size = F.greatest(F.coalesce("est_size", F.lit(0)), F.coalesce("_size", F.lit(0)))
        files = F.when(F.col("est_files").isNull(), F.col("_files")).otherwise(
            F.greatest("est_files", F.coalesce("_files", F.lit(0)))
        )
        below = cut_lineage(joined.withColumn("total_size", size).withColumn("total_files", files).drop("_size", "_files"))
        done = below if done is None else done.unionByName(below)
    return done


def with_paths(nodes: DataFrame) -> DataFrame:
    """Add the relative path, the root and the level-1 ancestor of each node, level by level from the top."""
    above = nodes.where(F.col("level") == 0).select(
        "*", F.col("name").alias("rel_path"), F.col("node_id").alias("root_id"), F.lit(None).cast("string").alias("top_id")
    )
    done = above
    for level in range(1, _deepest(nodes) + 1):
        parents = above.select(
            "plan_id", F.col("node_id").alias("parent_id"), F.col("rel_path").alias("_path"), F.col("root_id").alias("_root"),
            F.col("top_id").alias("_top"),
        )
        here = nodes.where(F.col("level") == level).join(parents, ["plan_id", "parent_id"])
        above = cut_lineage(here.select(
            *nodes.columns, F.concat("_path", F.lit(P.SEP), "name").alias("rel_path"), F.col("_root").alias("root_id"),
            F.coalesce("_top", "node_id").alias("top_id"),
        ))
        done = done.unionByName(above)
    return done


def design_from_tree(folders: DataFrame, max_level: int = 5) -> tuple[DataFrame, DataFrame]:
    """Plan nodes and sources from rolled-up folders ``(root_key, folder_key, bytes, files)``."""
    level = P.level_below("folder_key", "root_key")
    kept = folders.where(level < max_level)
    parent = F.when(F.col("folder_key") != F.col("root_key"), P.parent_key("folder_key"))
    nodes = kept.select(
        F.col("root_key").alias("plan_id"), F.col("folder_key").alias("node_id"), parent.alias("parent_id"),
        F.lit(0).alias("ord"), P.leaf("folder_key").alias("name"), level.alias("level"), F.col("bytes").alias("est_size"),
        F.col("files").alias("est_files"), F.lit(True).alias("inherit_acl"),
    )
    return nodes, nodes.select("plan_id", "node_id", F.col("node_id").alias("source_path"))


def design_aces(nodes: DataFrame, sources: DataFrame, aces: DataFrame) -> DataFrame:
    """Access entries of each node's source folder; nodes without any stay as one row of nulls."""
    keyed = sources.withColumn("path_key", P.path_key("source_path"))
    wanted = aces.select("path_key", "ace_order", "account", "rights", "access_type")
    joined = keyed.join(wanted, "path_key", "left")
    return nodes.select("plan_id", "node_id").join(joined, ["plan_id", "node_id"], "left").drop("path_key", "source_path")


def design_diff(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """What happens to each node: Consolidation, Relocation, Preserved or NewFolder. ``nodes`` needs ``rel_path``."""
    counts = sources.groupBy("plan_id", "node_id").agg(
        F.count("*").alias("source_count"), F.min("source_path").alias("first_source")
    )
    joined = nodes.join(counts, ["plan_id", "node_id"], "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))
    moved = (F.lower(P.leaf("first_source")) != F.lower("name")) | (F.col("level") > 1)
    kind = (
        F.when(F.col("source_count") > 1, "Consolidation").when(F.col("source_count") == 0, "NewFolder")
        .when(moved, "Relocation").otherwise("Preserved")
    )
    detail = (
        F.when(kind == "Consolidation", F.concat(F.lit("Consolidating "), F.col("source_count").cast("string"), F.lit(" source folders")))
        .when(kind == "Relocation", F.concat(F.lit("Source: "), P.leaf("first_source"), F.lit(" -> Relocate to new path")))
        .when(kind == "Preserved", "Migrate with same structure").otherwise("New empty folder on target server")
    )
    return joined.withColumn("kind", kind).withColumn("source_detail", detail)


def design_acl_changes(nodes: DataFrame, plan_aces: DataFrame) -> DataFrame:
    """One row per planned grant; a node without entries says whether it inherits."""
    joined = nodes.select("plan_id", "node_id", "inherit_acl").join(plan_aces, ["plan_id", "node_id"], "left")
    text = F.when(F.col("account").isNotNull(), F.concat(F.lit("Grant "), F.col("account"))).when(
        F.col("inherit_acl"), "Inherit permissions from parent").otherwise("Explicit permissions (Empty)")
    return joined.withColumn("change", text)


def skeleton(nodes: DataFrame, target_root: str, existing: DataFrame) -> DataFrame:
    """Folders of the design below ``target_root``: to create or already there. ``nodes`` needs ``rel_path``."""
    path = F.concat(F.lit(target_root.rstrip("/\\") + P.SEP), F.col("rel_path"))
    there = existing.where("is_dir").select("path_key", F.lit(True).alias("_there")).distinct()
    planned = nodes.withColumn("target_path", path).withColumn("path_key", P.path_key(path))
    return planned.join(there, "path_key", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


# --- waves -----------------------------------------------------------------

def units(nodes: DataFrame, totals: DataFrame, sources: DataFrame, policy: str = TOP_LEVEL) -> DataFrame:
    """The pieces waves are made of: ``(plan_id, unit_id, unit_ord, name, size, files)``.

    Usually the roots. A lone root with several children is split into them, plus
    a residual piece for the root's own sources holding what the children do not.
    """
    sized = nodes.select("plan_id", "node_id", "parent_id", "ord", "name", "level", "est_size").join(
        totals.select("plan_id", "node_id", "total_size", "total_files"), ["plan_id", "node_id"]
    )
    roots = sized.where(F.col("level") == 0)
    children = sized.where(F.col("level") == 1)
    shape = roots.groupBy("plan_id").agg(F.count("*").alias("_roots")).join(
        children.groupBy("plan_id").agg(F.count("*").alias("_children"), F.sum("total_size").alias("_below")), "plan_id", "left"
    )
    lone = (F.col("_roots") == 1) & (F.coalesce("_children", F.lit(0)) > 1) & F.lit(policy != SINGLE)
    shape = shape.select("plan_id", lone.alias("_split"), "_below")
    unit = lambda df, order, size, files: df.select(
        "plan_id", F.col("node_id").alias("unit_id"), order.cast("int").alias("unit_ord"), "name", size.alias("size"), files.alias("files"))
    whole = unit(roots.join(shape.where(~F.col("_split")), "plan_id"), F.col("ord"), F.col("total_size"), F.col("total_files"))
    parts = unit(children.join(shape.where("_split"), "plan_id"), F.col("ord"), F.col("total_size"), F.col("total_files"))
    own = sources.select("plan_id", "node_id").distinct()
    rest = unit(
        roots.join(shape.where("_split"), "plan_id").join(own, ["plan_id", "node_id"], "left_semi"), F.lit(-1),
        F.greatest(F.lit(0), F.coalesce("est_size", F.lit(0)) - F.col("_below")), F.lit(None).cast("long"),
    )
    return whole.unionByName(parts).unionByName(rest)


def next_fit(pieces: DataFrame, budget: int) -> DataFrame:
    """Waves by size budget, in order; an oversize first piece is kept.

    A wave that starts at piece i ends before the first piece j whose running sum
    passes the sum before i by more than the budget, so the next start of every
    piece is a look-up among running sums. Starts are marked from the first piece
    by doubling: with the 2^k-th next start of every piece, the first 2^k starts
    give the next 2^k. A plan is many tasks and takes log2(waves) rounds.
    """
    order = ["unit_ord", "unit_id"]
    sized = pieces.select("plan_id", "unit_id", "unit_ord", F.coalesce("size", F.lit(0)).cast("decimal(38,0)").alias("size"))
    numbered = number_within(sized, ["plan_id"], order, "i")
    summed = cut_lineage(running_sum(numbered, ["plan_id"], ["i"], "size", "before"))
    # Sorted from the greatest sum down, the last end seen before a limit is the first that passes it.
    ends = summed.select("plan_id", "i", (F.col("before") + F.col("size")).alias("at"), F.lit(1).alias("asks"), F.col("i").alias("j"))
    limits = summed.select("plan_id", "i", (F.col("before") + F.lit(budget)).alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("j"))
    found = running_min(ends.unionByName(limits), ["plan_id"], [F.desc("at"), F.col("asks"), F.col("i")], "j", "passes").where("asks = 0")
    jump = cut_lineage(found.where("passes is not null").select("plan_id", "i", F.greatest(F.col("passes"), F.col("i") + 1).alias("to")))
    jump = jump.join(summed.select("plan_id", F.col("i").alias("to")), ["plan_id", "to"], "left_semi")  # an oversize last piece has no next
    starts = cut_lineage(summed.where("i = 0").select("plan_id", "i"))
    jump = cut_lineage(jump)
    while True:
        reached = cut_lineage(starts.join(jump, ["plan_id", "i"]).select("plan_id", F.col("to").alias("i")))
        if reached.isEmpty():
            break
        starts = cut_lineage(starts.unionByName(reached))
        twice = jump.select("plan_id", F.col("i").alias("to"), F.col("to").alias("end"))
        jump = cut_lineage(jump.join(twice, ["plan_id", "to"]).select("plan_id", "i", F.col("end").alias("to")))
    marked = summed.select("plan_id", "unit_id", "i").join(starts.withColumn("starts", F.lit(1)), ["plan_id", "i"], "left")
    counted = running_sum(marked.fillna(0, ["starts"]), ["plan_id"], ["i"], "starts", "earlier")
    return counted.select("plan_id", "unit_id", (F.col("earlier") + F.col("starts")).cast("int").alias("wave"))


def assign_waves(pieces: DataFrame, policy: str = TOP_LEVEL, budget: int = 500 * 1024 * MIB) -> DataFrame:
    """``pieces`` with their wave number under a split policy."""
    if policy == SINGLE:
        return pieces.withColumn("wave", F.lit(1))
    if policy == BUDGET:
        return pieces.join(next_fit(pieces, budget), ["plan_id", "unit_id"])
    numbered = number_within(pieces, ["plan_id"], ["unit_ord", "unit_id"], "_i")
    return numbered.withColumn("wave", (F.col("_i") + 1).cast("int")).drop("_i")


def node_waves(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """Wave of every node: that of its level-1 ancestor when that is a piece, else that of its root."""
    known = pieces.select("plan_id", F.col("unit_id"), "wave")
    by_top = known.withColumnRenamed("unit_id", "top_id").withColumnRenamed("wave", "_top_wave")
    by_root = known.withColumnRenamed("unit_id", "root_id").withColumnRenamed("wave", "_root_wave")
    joined = nodes.join(by_top, ["plan_id", "top_id"], "left").join(by_root, ["plan_id", "root_id"], "left")
    return joined.withColumn("wave", F.coalesce("_top_wave", "_root_wave")).drop("_top_wave", "_root_wave")


def wave_totals(pieces: DataFrame, waved_nodes: DataFrame, sources: DataFrame, *, rate_mbps: float = 50.0,
                delta_percent: float = 5.0) -> DataFrame:
    """Bytes, files, distinct sources, durations and warnings of every wave."""
    rate = int(max(float(MIB), rate_mbps * MIB))
    ratio = min(max(delta_percent, 0.01), 100.0) / 100.0
    sums = pieces.groupBy("plan_id", "wave").agg(
        F.sum("size").alias("bytes"), F.sum("files").alias("files"), F.count("*").alias("unit_count")
    )
    heads = top_k(pieces, ["plan_id", "wave"], [F.asc("unit_ord"), F.asc("unit_id")], 2).groupBy("plan_id", "wave").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", "name"))), lambda u: u["name"]), " + ").alias("_heads")
    )
    mapped = (
        waved_nodes.where(F.col("wave").isNotNull()).select("plan_id", "node_id", "wave")
        .join(sources, ["plan_id", "node_id"]).select("plan_id", "wave", F.lower("source_path").alias("s")).distinct()
        .groupBy("plan_id", "wave").agg(F.count("*").alias("source_count"))
    )
    joined = sums.join(heads, ["plan_id", "wave"]).join(mapped, ["plan_id", "wave"], "left")
    more = F.when(F.col("unit_count") > 2, F.concat(F.lit(" and "), (F.col("unit_count") - 2).cast("string"), F.lit(" more"))).otherwise("")
    seconds = lambda c: F.greatest(F.lit(5), F.floor(c).cast("long"))
    return (
        joined.withColumn("wave_name", F.concat(F.lit("Wave "), F.col("wave").cast("string"), F.lit(": "), "_heads", more))
        .withColumn("source_count", F.coalesce("source_count", F.lit(0)))
        .withColumn("full_seconds", seconds(F.col("bytes") / rate))
        .withColumn("cutover_seconds", seconds(F.col("bytes") * ratio / rate))
        .withColumn("many_files", F.coalesce(F.col("files") > MAX_FILES, F.lit(False)))
        .withColumn("over_48h", F.col("full_seconds") > MAX_HOURS * 3600)
        .drop("_heads")
    )


def all_wave_totals(waves: DataFrame) -> DataFrame:
    """Totals per wave, per plan and over all plans."""
    return waves.rollup("plan_id", "wave").agg(
        F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.sum("full_seconds").alias("full_seconds"),
        F.sum("cutover_seconds").alias("cutover_seconds"),
    )


# --- copy units ------------------------------------------------------------

def copy_units(waved_nodes: DataFrame, sources: DataFrame, target_root: str) -> DataFrame:
    """Source and destination of every mapping, each pair once without regard to case."""
    destination = F.concat(F.lit(target_root.rstrip("/\\") + P.SEP), F.col("rel_path"))
    mapped = waved_nodes.select("plan_id", "node_id", "wave", destination.alias("destination")).join(
        sources.where(F.trim("source_path") != ""), ["plan_id", "node_id"]
    )
    keyed = mapped.select(
        "plan_id", "wave", P.path_key("source_path").alias("source_key"), P.path_key("destination").alias("destination_key"),
        F.col("source_path").alias("source"), "destination",
    )
    once = keyed.groupBy("plan_id", "source_key", "destination_key").agg(F.min(F.struct("wave", "source", "destination")).alias("_u"))
    return once.select("plan_id", "source_key", "destination_key", "_u.*")


def exclusions(copy: DataFrame) -> DataFrame:
    """Sources nested in another source, as rows ``(plan_id, source_key, excluded_key)``.

    Containment is an equality: each source joins its own ancestors to sources.
    """
    places = copy.select("plan_id", "source_key").distinct()
    nested = P.explode_all_ancestors(places.select("plan_id", F.col("source_key").alias("excluded_key")), "excluded_key", "source_key")
    return nested.join(places, ["plan_id", "source_key"], "left_semi").select("plan_id", "source_key", "excluded_key")


def overlaps(copy: DataFrame) -> DataFrame:
    """Pairs where a destination equals, contains or lies in a source; must be empty."""
    s = copy.select("plan_id", "source_key").distinct()
    d = copy.select("plan_id", "destination_key").distinct()
    inside_source = P.explode_all_ancestors(d, "destination_key", "source_key", include_self=True).join(s, ["plan_id", "source_key"], "left_semi")
    inside_target = P.explode_all_ancestors(s, "source_key", "destination_key", include_self=True).join(d, ["plan_id", "destination_key"], "left_semi")
    return inside_source.select("plan_id", "source_key", "destination_key").union(
        inside_target.select("plan_id", "source_key", "destination_key")).distinct()


def bad_folder_names(nodes: DataFrame) -> DataFrame:
    name = F.coalesce("name", F.lit(""))
    return nodes.where((F.trim(name) == "") | name.isin(".", "..") | F.rlike(name, F.lit(BAD_NAME)))


def planned_directories(nodes: DataFrame, target_root: str) -> DataFrame:
    """Every destination folder and its ancestors below the target, each once, shortest first."""
    root = target_root.rstrip("/\\")
    path = F.concat(F.lit(root + P.SEP), F.col("rel_path"))
    keyed = nodes.select("plan_id", P.path_key(path).alias("key"), P.path_key(F.lit(root)).alias("_root"))
    spread = P.explode_ancestors(keyed, "key", F.col("_root"), "directory", include_self=True)
    return (
        spread.where(F.col("directory") != F.col("_root")).select("plan_id", "directory").distinct()
        .orderBy("plan_id", F.length("directory"), "directory")
    )


# --- transfer --------------------------------------------------------------

def _cut_at(key: str, depth: int) -> Column:
    return F.substring_index(F.col(key), P.SEP, depth)


def _depths(places: DataFrame) -> list[int]:
    """Numbers of components that places have: no more than the components of the longest."""
    return sorted(r["d"] for r in places.select(P.components("place_key").alias("d")).distinct().collect())


def _covered(entries: DataFrame, places: DataFrame) -> DataFrame:
    """``(head_key, place_key, _rows)``: the deepest place at or above each head and the entries that have it, written.

    The head of an entry is its path cut at the depth of the deepest place, which decides
    what covers it. Only heads are repeated, once per depth at which places lie. The depth of
    the deepest one is kept, not its key: numbers are aggregated without a sort.
    """
    depths = _depths(places)
    heads = entries.groupBy(_cut_at("path_key", max(depths, default=0)).alias("head_key")).agg(F.count("*").alias("_rows"))
    above = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda d: d <= P.components("head_key"))
    return cut_lineage(
        heads.select("*", F.explode(above).alias("_depth")).withColumn("place_key", F.expr("substring_index(head_key, '/', _depth)"))
        .join(places.select("place_key").distinct(), "place_key")
        .groupBy("head_key").agg(F.max("_depth").alias("_d"), F.max("_rows").alias("_rows"))
        .select("head_key", F.expr("substring_index(head_key, '/', _d)").alias("place_key"), "_rows")
    )


def placed(entries: DataFrame, places: DataFrame, units: DataFrame) -> DataFrame:
    """Entries strictly below one of ``places(place_key)``, joined to the ``units`` of the deepest one that covers them.

    An entry that is a place itself belongs to nobody but itself and is dropped: it is its
    own head. Units are joined to heads first, so the entries are exchanged once.
    """
    covered = _covered(entries, places)
    owned = measured_join(covered, units, ["place_key"], counts=covered.groupBy("place_key").agg(F.count("*").alias("_rows")))
    headed = entries.withColumn("head_key", _cut_at("path_key", max(_depths(places), default=0)))
    joined = measured_join(headed, owned.drop("_rows"), ["head_key"], counts=covered.select("head_key", "_rows"))
    return joined.where(F.col("path_key") != F.col("place_key")).drop("head_key")


def expected_items(entries: DataFrame, copy: DataFrame) -> DataFrame:
    """What the destinations should hold once every unit is copied.

    An entry goes with the deepest source above it, which leaves nested sources
    to their own units. Unit destinations are expected as folders.
    """
    places = copy.select(F.col("source_key").alias("place_key")).distinct()
    moved = placed(entries, places, copy.select("plan_id", "wave", F.col("source_key").alias("place_key"), "destination_key"))
    suffix = F.substring(F.col("path_key"), F.length("place_key") + F.lit(1), F.length("path_key"))
    items = moved.select(
        "plan_id", "wave", F.concat("destination_key", suffix).alias("target_key"), "is_dir", F.col("path_key").alias("source_key"),
        F.when(~F.col("is_dir"), F.col("size")).alias("size"), "modified_at", "sha256",
    )
    heads = copy.select(
        "plan_id", "wave", F.col("destination_key").alias("target_key"), F.lit(True).alias("is_dir"),
        F.lit(None).cast("string").alias("source_key"), F.lit(None).cast("long").alias("size"),
        F.lit(None).cast("timestamp").alias("modified_at"), F.lit(None).cast("string").alias("sha256"),
    ).distinct()
    return items.unionByName(heads)


def expected_once(items: DataFrame) -> DataFrame:
    """One row per expected path: identical files from several sources are the same file.

    Dealt by path alone: what is found at the destination can join without another exchange.
    ``sha256``, the last to decide, may be left out.
    """
    rest = [c for c in ("wave", "source_key", "is_dir", "size", "modified_at", "sha256") if c in items.columns]
    first = items.repartition("target_key").groupBy("plan_id", "target_key").agg(F.min(F.struct(*rest)).alias("_i"))
    return first.select("plan_id", "target_key", "_i.*")


def collisions(items: DataFrame) -> DataFrame:
    """Expected paths that are both file and folder, or files of different content.

    Content is compared by size and hash; without a hash two sources cannot be
    proven equal and count as different. Minimum against maximum instead of
    distinct counts keeps it one partial aggregation.
    """
    proof = F.struct("size", F.coalesce("sha256", F.concat(F.lit("source:"), "source_key")).alias("proof"))
    file_proof = F.when(~F.col("is_dir"), proof)
    grouped = items.groupBy("plan_id", "target_key").agg(
        F.min("is_dir").alias("_lo"), F.max("is_dir").alias("_hi"), F.min(file_proof).alias("_pl"), F.max(file_proof).alias("_ph"),
        F.count("*").alias("sources"),
    )
    kind = F.when(F.col("_lo") != F.col("_hi"), "FileAndFolder").when(F.col("_pl") != F.col("_ph"), "DifferentContent")
    return grouped.withColumn("violation", kind).where(F.col("violation").isNotNull()).select(
        "plan_id", "target_key", "sources", "violation"
    )


def removals(actual: DataFrame, items: DataFrame, copy: DataFrame, wave: int | None = None) -> DataFrame:
    """Destination entries nobody expects. A branch owned by another unit or wave is left alone.

    What the units own is written, with all columns of ``actual``: pass those needed and ``path_key``.
    """
    places = copy.select(F.col("destination_key").alias("place_key")).distinct()
    active = copy if wave is None else copy.where(F.col("wave") == wave)
    mine = active.select("plan_id", F.col("destination_key").alias("place_key")).distinct()
    owned = cut_lineage(placed(actual, places, mine))
    wanted = items.select("plan_id", F.col("target_key").alias("path_key")).distinct()
    ancestors = P.explode_all_ancestors(copy.select("plan_id", "destination_key").distinct(), "destination_key", "path_key").select(
        "plan_id", "path_key").distinct()
    return owned.join(wanted, ["plan_id", "path_key"], "left_anti").join(ancestors, ["plan_id", "path_key"], "left_anti")


def verify(
    items: DataFrame, actual: DataFrame, sources_now: DataFrame, wave: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Every expected path against the destination and the present source; null ``problem`` is fine.

    What was found at the destination is written between the two joins, of ``items`` only
    the ``columns`` asked for (all by default).
    """
    chosen = items if wave is None else items.where(F.col("wave") == wave)
    columns = list(items.columns if columns is None else columns)
    have = actual.select(F.col("path_key").alias("target_key"), F.col("is_dir").alias("_dir"), F.col("size").alias("_size"))
    now = sources_now.select(F.col("path_key").alias("source_key"), F.col("size").alias("_now"), F.col("modified_at").alias("_modified"))
    judged = ["source_key", "is_dir", "size", "modified_at"]
    found = cut_lineage(chosen.join(have, "target_key", "left").select(*dict.fromkeys([*columns, *judged]), "_dir", "_size"))
    # Only files that are there as files need their source; all others are judged where they are.
    open_still = F.coalesce(~F.col("is_dir") & ~F.col("_dir"), F.lit(False))
    changed = F.col("_now").isNull() | (F.col("_now") != F.col("size")) | ~F.col("_modified").eqNullSafe(F.col("modified_at"))
    by_source = F.when(changed, "SourceChanged").when(F.col("_size") != F.col("size"), "SizeMismatch")
    here = F.when(F.col("_dir").isNull(), "Missing").when(F.col("_dir") != F.col("is_dir"), "TypeMismatch")
    looked_up = found.where(open_still).join(now, "source_key", "left").select(*columns, by_source.alias("problem"))
    return looked_up.unionByName(found.where(~open_still).select(*columns, here.alias("problem")))


def link_map(copy: DataFrame) -> DataFrame:
    """Old and new prefix of every unit, for repairing links after the move."""
    return copy.select("plan_id", "wave", F.col("source").alias("old_prefix"), F.col("destination").alias("new_prefix"))
