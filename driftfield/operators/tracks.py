"""Track identities from overlap links.

Links of a frame pair form a small directed graph: a reference feature leads to
every feature it is linked to (either direction), a new feature leads back only
to references that link *forward* to it.  A group is everything reachable from a
reference feature that no smaller-numbered reference of the pair reaches.  When
groups share members, the group with the highest leading reference decides.

All of this is local to a frame pair and is computed for all pairs at once; the
only step that runs along time is the walk to the first feature of each chain,
which doubles its reach in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.operators.components import connected_components
from driftfield.operators.ranking import bucketed_row_number
from driftfield.workspace import Workspace

# Status codes added up per feature: its role as reference plus its role as new feature.
CONTINUES, MERGE_MAIN, MERGE_MINOR = 1, 2, 21
SPLITS, SPLIT_MAIN, SPLIT_MINOR = 13, 3, 31

NODE_SHIFT = 32
ORDER_BLOCK = 4096


def node_key(frame="frame_id", feature="feature_id"):
    frame = F.col(frame) if isinstance(frame, str) else frame
    feature = F.col(feature) if isinstance(feature, str) else feature
    return F.shiftleft(frame.cast("long"), NODE_SHIFT) + feature.cast("long")


def link_groups(links: DataFrame, ws: Workspace, othresh: float) -> tuple[DataFrame, DataFrame]:
    """Group members per pair: refs (ref_frame, lead, ref_id) and news (ref_frame, lead, new_id)."""
    ref_node, new_node = F.col("ref_id") * 2 + 1, F.col("new_id") * 2
    edges = links.select(
        "ref_frame", "ref_id", "new_id", "is_fwd",
        ref_node.cast("long").alias("r"), new_node.cast("long").alias("n"),
    )
    forward = edges.where("is_fwd")
    if othresh >= 0.5:
        # more than half of a reference can lie in one new feature only
        stars = forward.select("ref_frame", F.col("r").alias("node"), F.col("n").alias("component"))
        hubs = forward.select("ref_frame", F.col("n").alias("node"), F.col("n").alias("component"))
        comp = stars.unionByName(hubs).distinct()
    else:
        comp = connected_components(
            forward.select("ref_frame", F.col("r").alias("src"), F.col("n").alias("dst")), ws, ["ref_frame"]
        )
        comp = ws.write(comp, "forward_components")
    of_ref = comp.select("ref_frame", F.col("node").alias("r"), F.col("component").alias("_cr"))
    of_new = comp.select("ref_frame", F.col("node").alias("n"), F.col("component").alias("_cn"))
    edges = ws.write(
        edges.join(of_ref, ["ref_frame", "r"], "left")
        .join(of_new, ["ref_frame", "n"], "left")
        .select(
            "ref_frame", "ref_id", "new_id",
            F.coalesce("_cr", "r").alias("cr"), F.coalesce("_cn", "n").alias("cn"),
        ),
        "link_components",
    )
    reach = _closure(
        edges.where("cr != cn").select("ref_frame", F.col("cr").alias("a"), F.col("cn").alias("b")).distinct(), ws
    )
    refs = edges.select("ref_frame", F.col("cr").alias("c"), "ref_id").distinct()
    news = edges.select("ref_frame", F.col("cn").alias("c"), "new_id").distinct()

    low = refs.groupBy("ref_frame", "c").agg(F.min("ref_id").alias("lead"))
    reached_by = (
        reach.join(low.select("ref_frame", F.col("c").alias("a"), "lead"), ["ref_frame", "a"])
        .groupBy("ref_frame", F.col("b").alias("c"))
        .agg(F.min("lead").alias("_earlier"))
    )
    leads = (
        low.join(reached_by, ["ref_frame", "c"], "left")
        .where(F.col("_earlier").isNull() | (F.col("_earlier") > F.col("lead")))
        .select("ref_frame", F.col("c").alias("a"), "lead")
    )
    scope = leads.select("ref_frame", "lead", F.col("a").alias("c")).unionByName(
        leads.join(reach, ["ref_frame", "a"]).select("ref_frame", "lead", F.col("b").alias("c"))
    )
    scope = ws.write(scope, "group_scope")
    return (
        scope.join(refs, ["ref_frame", "c"]).select("ref_frame", "lead", "ref_id"),
        scope.join(news, ["ref_frame", "c"]).select("ref_frame", "lead", "new_id"),
    )


def _closure(steps: DataFrame, ws: Workspace) -> DataFrame:
    """Transitive closure of (ref_frame, a, b).

    New pairs are continued by all known ones, so the reach doubles per round.
    """
    steps = ws.write(steps, "steps")
    known, fresh = steps, steps
    while not fresh.isEmpty():
        onward = known.select("ref_frame", F.col("a").alias("b"), F.col("b").alias("_next"))
        step = (
            fresh.join(onward, ["ref_frame", "b"])
            .where("a != _next")
            .select("ref_frame", "a", F.col("_next").alias("b"))
            .distinct()
        )
        fresh = ws.write(step.join(known, ["ref_frame", "a", "b"], "left_anti"), "reached")
        known = known.unionByName(fresh)
    return known


def resolve_pairs(
    features: DataFrame, links: DataFrame, ws: Workspace, othresh: float
) -> tuple[DataFrame, DataFrame]:
    """Per-pair outcome.

    refs: (ref_frame, ref_id, ref_status, merge_ref)
    news: (ref_frame, new_id, new_status, source_ref, born_lead, split_ref)
    ``source_ref`` continues into the new feature; ``born_lead`` is set instead
    when the feature starts a track as a split-off part.
    """
    ref_m, new_m = link_groups(links, ws, othresh)
    npix = features.select("frame_id", "feature_id", "npix")
    ref_m = ref_m.join(
        npix.select(F.col("frame_id").alias("ref_frame"), F.col("feature_id").alias("ref_id"), "npix"),
        ["ref_frame", "ref_id"],
    )
    new_m = new_m.join(
        npix.select((F.col("frame_id") - 1).alias("ref_frame"), F.col("feature_id").alias("new_id"), "npix"),
        ["ref_frame", "new_id"],
    )

    def summary(members: DataFrame, member: str, n: str, big: str) -> DataFrame:
        largest = F.max(F.struct("npix", (-F.col(member)).alias("_id")))
        return members.groupBy("ref_frame", "lead").agg(
            F.count(F.lit(1)).alias(n), (-largest["_id"]).alias(big)
        )

    groups = ws.write(
        summary(ref_m, "ref_id", "nref", "big_ref").join(
            summary(new_m, "new_id", "nnew", "big_new"), ["ref_frame", "lead"]
        ),
        "groups",
    )
    is_big = F.col("ref_id") == F.col("big_ref")
    merging, splitting = F.col("nref") > 1, F.col("nnew") > 1
    ref_status = (
        F.when(merging & splitting, F.when(is_big, MERGE_MAIN + SPLITS).otherwise(MERGE_MINOR + SPLITS))
        .when(merging, F.when(is_big, MERGE_MAIN).otherwise(MERGE_MINOR))
        .when(splitting, SPLITS)
        .otherwise(CONTINUES)
    )
    merge_to = F.when(merging & ~is_big, F.struct("lead", F.col("big_ref").alias("to")))
    refs = (
        ref_m.join(groups, ["ref_frame", "lead"])
        .groupBy("ref_frame", "ref_id")
        .agg(
            F.max(F.struct("lead", ref_status.alias("s")))["s"].alias("ref_status"),
            F.max(merge_to)["to"].alias("merge_ref"),
        )
    )
    main = F.col("new_id") == F.col("big_new")
    new_status = F.when(splitting, F.struct("lead", F.when(main, SPLIT_MAIN).otherwise(SPLIT_MINOR).alias("s")))
    split_from = F.when(~main, F.struct("lead", F.col("big_ref").alias("to")))
    last = F.max(F.struct("lead", F.when(main, F.col("big_ref")).alias("src")))
    news = (
        new_m.join(groups, ["ref_frame", "lead"])
        .groupBy("ref_frame", "new_id")
        .agg(
            F.max(new_status)["s"].alias("new_status"),
            last["src"].alias("source_ref"),
            F.when(last["src"].isNull(), last["lead"]).alias("born_lead"),
            F.max(split_from)["to"].alias("split_ref"),
        )
    )
    return refs, news


HOPS = 3


def chain_roots(parents: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) for every node with a parent, by pointer jumping.

    A round looks up the pointer of a pointer three times in the table written by
    the round before, so the reach of every pointer grows fourfold per round.
    """
    state = ws.write(parents.select("node", F.col("parent").alias("root")), "chains")
    while True:
        hop = state.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        step = state.select("node", "root")
        for _ in range(HOPS):
            step = step.join(hop, "root", "left").select(
                "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")
            )
        state = ws.write(step, "chains")
        if state.where("moved").isEmpty():
            return state.select("node", "root")


def number_tracks(
    features: DataFrame,
    links: DataFrame,
    pairs: DataFrame,
    ws: Workspace,
    othresh: float,
) -> DataFrame:
    """Track points of all features that lie in a frame with a valid neighbour frame.

    Columns: frame_id, feature_id, track_id, track_status, merge_track,
    split_track, track_reset (1 first frame of a gap-free run, 2 last frame,
    0 started in between, NULL otherwise).  Ids are dense, in the order in which
    a frame-by-frame pass would issue them.
    """
    refs, news = resolve_pairs(features, links, ws, othresh)
    has_next = pairs.select("frame_id", F.lit(True).alias("_next"))
    has_prev = pairs.select(F.col("next_frame").alias("frame_id"), F.lit(True).alias("_prev"))
    points = (
        features.select("frame_id", "feature_id")
        .join(has_next, "frame_id", "left")
        .join(has_prev, "frame_id", "left")
        .where("_next or _prev")
        .join(
            refs.withColumnsRenamed({"ref_frame": "frame_id", "ref_id": "feature_id"}),
            ["frame_id", "feature_id"],
            "left",
        )
        .join(
            news.withColumn("frame_id", F.col("ref_frame") + 1)
            .drop("ref_frame")
            .withColumnRenamed("new_id", "feature_id"),
            ["frame_id", "feature_id"],
            "left",
        )
        .select(
            node_key().alias("node"),
            "frame_id",
            "feature_id",
            (F.coalesce("ref_status", F.lit(0)) + F.coalesce("new_status", F.lit(0))).alias("track_status"),
            node_key("frame_id", "merge_ref").alias("merge_node"),
            node_key(F.col("frame_id") - 1, "split_ref").alias("split_node"),
            node_key(F.col("frame_id") - 1, "source_ref").alias("parent"),
            F.when(F.col("_prev").isNull(), 0)
            .when(F.col("born_lead").isNotNull(), 1)
            .otherwise(2)
            .alias("birth"),
            F.coalesce("born_lead", "feature_id").cast("long").alias("birth_order"),
            F.col("_prev").isNull().alias("opens"),
            F.col("_next").isNull().alias("closes"),
        )
    )
    points = ws.write(points, "points")
    chains = chain_roots(points.where("parent is not null"), ws)
    starts = bucketed_row_number(
        points.where("parent is null").select("node", "frame_id", "birth", "birth_order", "feature_id"),
        [],
        {
            "_span": F.floor(F.col("frame_id") / ORDER_BLOCK),
            "_frame": F.col("frame_id"),
            "_birth": F.col("birth"),
            "_block": F.floor(F.col("birth_order") / ORDER_BLOCK),
        },
        [F.col("birth_order"), F.col("feature_id")],
        "track_id",
    ).select("node", "track_id")
    starts = ws.write(starts, "starts")
    ids = ws.write(
        chains.join(starts.withColumnRenamed("node", "root"), "root")
        .select("node", "track_id")
        .unionByName(starts),
        "track_ids",
    )

    def pointer(col: str, out: str) -> DataFrame:
        return ids.select(F.col("node").alias(col), F.col("track_id").alias(out))

    # points without a pointer get a key of their own, so they do not pile up on NULL
    return (
        points.withColumns(
            {c: F.coalesce(c, -F.col("node")) for c in ("merge_node", "split_node")}
        )
        .join(ids, "node")
        .join(pointer("merge_node", "merge_track"), "merge_node", "left")
        .join(pointer("split_node", "split_track"), "split_node", "left")
        .select(
            "frame_id", "feature_id", "track_id", "track_status", "merge_track", "split_track",
            F.when(F.col("closes"), 2)
            .when(F.col("opens"), 1)
            .when(F.col("parent").isNull(), 0)
            .alias("track_reset"),
        )
    )
