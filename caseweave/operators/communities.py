"""Re-cutting an oversized component by weighted modularity, level by level.

Only components of more than ``SPLIT_EVENTS`` events from more than ``SPLIT_SOURCES`` sources are touched: a burst of one
actor must stay whole.  Nodes are runs, edges the summed link weights between them.  A level is rounds of best-gain
moves, each kept per component only while its modularity rises; then every community becomes one node, its inner weight
a loop, and the next level moves these.  Levels end when none merges anything.  Last, a community that its own edges do not
hold together is cut into its connected parts, which can only raise modularity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..session import Rounds, cut
from . import graph

#: Rounds of a level; every kept round raises modularity, so the state at this bound is the best so far.
MAX_ROUNDS = 200


def oversized(events: DataFrame, membership: DataFrame) -> DataFrame:
    """Components to re-cut.  Sources are counted per (component, address) first."""
    by_ip = graph.on_runs(events.select("tenant_id", "event_id", "ts_us", "src_ip"), membership.drop("run_id")).groupBy(
        "component", "src_ip").agg(F.count(F.lit(1)).alias("n"))
    size = by_ip.groupBy("component").agg(F.count(F.lit(1)).alias("ips"), F.sum("n").alias("n"))
    return size.where((F.col("ips") > C.SPLIT_SOURCES) & (F.col("n") > C.SPLIT_EVENTS)).select("component")


def link_graph(events: DataFrame, membership: DataFrame) -> DataFrame:
    """Weights between the runs of components (component, u, v, w), both directions; a loop counts twice, as in the usual definition."""
    ev = graph.on_runs(events, membership)
    ents = graph.entities_of(graph.with_values(ev), keep=["vals"])
    # every link counts here, also inside a run and below the cut
    ends = graph.edge_weights(graph.neighbour_pairs(graph.entity_index(ents, keep=["vals"])), 0.0).select("a", "b", "w")
    run_of = ev.select("event_id", "run_id", "component")
    edges = (ends.join(run_of.select(F.col("event_id").alias("a"), F.col("run_id").alias("u"), "component"), "a")
             .join(run_of.select(F.col("event_id").alias("b"), F.col("run_id").alias("v")), "b")
             .groupBy("component", "u", "v").agg(F.sum("w").alias("w")))
    both = F.explode(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    return edges.select("component", both.alias("e")).select("component", "e.*").groupBy("component", "u", "v").agg(F.sum("w").alias("w"))


def _strength(edges: DataFrame) -> DataFrame:
    return edges.groupBy("component", F.col("u").alias("node")).agg(F.sum("w").alias("k"))


def modularity(edges: DataFrame, strength: DataFrame, label: DataFrame) -> DataFrame:
    """(component, q) of labels (component, node, community): sum over communities of in/2m - (tot/2m)^2."""
    l1, l2 = label.select(F.col("node").alias("u"), F.col("community").alias("cu")), label.select(
        F.col("node").alias("v"), F.col("community").alias("cv"))
    inside = edges.join(l1, "u").join(l2, "v").where("cu = cv").groupBy("component", F.col("cu").alias("community")).agg(F.sum("w").alias("win"))
    tot = strength.join(label.select("node", "community"), "node").groupBy("component", "community").agg(F.sum("k").alias("tot"))
    whole = strength.groupBy("component").agg(F.sum("k").alias("m2"))
    return tot.join(inside, ["component", "community"], "left").join(whole, "component").groupBy("component").agg(
        F.sum(F.coalesce("win", F.lit(0.0)) / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), 2)).alias("q"))


def _best_moves(edges: DataFrame, strength: DataFrame, whole: DataFrame, label: DataFrame) -> DataFrame:
    """(component, node, own, to, d): the neighbouring community that gains a node most, where that beats staying by d."""
    tot = strength.join(label.select("node", "community"), "node").groupBy("component", "community").agg(F.sum("k").alias("tot"))
    near = edges.where(F.col("u") != F.col("v")).join(
        label.select(F.col("node").alias("v"), F.col("community")), "v").groupBy("component", "u", "community").agg(F.sum("w").alias("kin"))
    own = label.select("component", F.col("node").alias("u"), F.col("community").alias("own"))
    stay = own.select("component", "u", F.col("own").alias("community"), F.lit(0.0).alias("kin"))
    near = near.unionByName(stay).groupBy("component", "u", "community").agg(F.sum("kin").alias("kin"))
    gain = (near.join(own.drop("component"), "u").join(strength.select(F.col("node").alias("u"), "k"), "u")
            .join(tot, ["component", "community"]).join(whole, "component"))
    here = F.col("community") == F.col("own")
    without = F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)
    gain = gain.withColumn("g", F.round(F.col("kin") - F.col("k") * without / F.col("m2"), 9))
    best = gain.groupBy("component", F.col("u").alias("node"), "own").agg(
        F.max(F.struct("g", here.alias("here"), (-F.col("community")).alias("c"))).alias("b"), F.max(F.when(here, F.col("g"))).alias("stay"))
    return best.select("component", "node", "own", (-F.col("b.c")).alias("to"), (F.col("b.g") - F.col("stay")).alias("d")).where("own <> to and d > 0")


def _apply(label: DataFrame, moves: DataFrame) -> DataFrame:
    return label.join(moves.select("node", "to"), "node", "left").select("component", "node", F.coalesce("to", "community").alias("community"))


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch a community, each the best of both that it touches: together they raise modularity by the sum of their gains."""
    rank = F.struct("d", (-F.col("node")).alias("n"))
    best = moves.select("component", F.explode(F.array("own", "to")).alias("community"), rank.alias("r")).groupBy("component", "community").agg(F.max("r").alias("r"))
    top = lambda side: best.select("component", F.col("community").alias(side), F.col("r").alias(f"r_{side}"))
    both = moves.join(top("own"), ["component", "own"]).join(top("to"), ["component", "to"])
    return both.where((F.col("r_own") == rank) & (F.col("r_to") == rank)).select("component", "node", "own", "to", "d")


def one_level(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(component, node, community) at rest: no move of one node raises the modularity of its component.

    Every second node moves at once while that raises modularity; where it does not, moves that cannot disturb one another are made.
    """
    spark = edges.sparkSession
    strength = cut(_strength(edges))
    whole = cut(strength.groupBy("component").agg(F.sum("k").alias("m2")))
    labels, scores = Rounds(spark), Rounds(spark)
    label = labels.next(strength.select("component", "node", F.col("node").alias("community")))
    best = scores.next(modularity(edges, strength, label))
    idle = 0
    for r in range(rounds):
        moves = cut(_best_moves(edges, strength, whole, label))
        if moves.isEmpty():
            break
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        moved = cut(_apply(label, _apart(moves) if idle == 2 else moves.where(turn)))
        now = cut(modularity(edges, strength, moved))
        better = now.join(best.select("component", F.col("q").alias("old")), "component").where(F.col("q") > F.col("old") + 1e-12).select("component")
        if better.isEmpty():
            idle += 1
            if idle == 3:                                                               # gains under the precision of a sum
                break
            continue
        idle = 0
        label = labels.next(label.join(better, "component", "left_anti").unionByName(moved.join(better, "component", "left_semi")))
        best = scores.next(best.join(better, "component", "left_anti").unionByName(now.join(better, "component", "left_semi")))
    return label


def contracted(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The graph whose nodes are the communities."""
    to = lambda end: label.select(F.col("node").alias(end), F.col("community").alias(f"_{end}"))
    return (edges.join(to("u"), "u").join(to("v"), "v").groupBy("component", F.col("_u").alias("u"), F.col("_v").alias("v"))
            .agg(F.sum("w").alias("w")))


def levels(edges: DataFrame, rounds: int = MAX_ROUNDS) -> list[DataFrame]:
    """Labels (component, node, community) of the first nodes after each level."""
    out, now = [], edges
    while True:
        label = one_level(now, rounds)
        if label.where("node <> community").isEmpty():
            return out or [label]
        if out:
            up = label.select(F.col("node").alias("community"), F.col("community").alias("_up"))
            out.append(cut(out[-1].join(up, "community").select("component", "node", F.col("_up").alias("community"))))
        else:
            out.append(label)
        now = cut(contracted(now, label))


def connected(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Labels in which each community is one connected part, named by its smallest node."""
    inside = edges.where("u <> v").join(label.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(
        label.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv")
    parts = graph.components(inside.select("u", "v"))
    return label.join(parts.select("node", F.col("component").alias("_part")), "node", "left").select(
        "component", "node", F.coalesce("_part", "node").alias("community"))


def split_communities(events: DataFrame, membership: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``membership`` with a ``community`` column: the smallest run of the community, or the component where nothing is re-cut."""
    membership = cut(membership)
    big = cut(oversized(events, membership))
    if big.isEmpty():
        return membership.withColumn("community", F.col("component"))
    edges = cut(link_graph(events, membership.join(big, "component", "left_semi")))
    label = connected(edges, levels(edges, rounds)[-1])
    final = label.select(F.col("node").alias("run_id"), F.col("community").alias("_c"))
    # a run of a re-cut component that no link leaves is a community of its own
    alone = F.when(F.col("_big"), F.col("run_id")).otherwise(F.col("component"))
    tagged = membership.join(big.withColumn("_big", F.lit(True)), "component", "left").join(final, "run_id", "left")
    return tagged.withColumn("community", F.coalesce("_c", alone)).drop("_c", "_big")


def recut(events: DataFrame, membership: DataFrame) -> DataFrame:
    """``membership`` in which the communities of oversized components are components."""
    return split_communities(events, membership).drop("component").withColumnRenamed("community", "component")
