"""Linking events that share entities, and cutting the link graph into components.

Sizes are kept in check by construction:

* the fan-out of an entity is summed from per-(entity, time slice) counts, so a
  hot entity is never gathered to be counted;
* one rule links entities of any size: an event and its predecessor in time, per
  entity of every kind, are a candidate pair, built inside time slices plus one
  pair per slice boundary: linear, and no task holds the entity;
* a candidate pair carries the full sum over all kinds that both events share;
* events of one address closer than the run gap are one node before any
  iteration starts, so a flood of any length is a single node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions import expr as X
from ..session import Rounds, cut

SLICE_US = 600 * C.US
ENTITY = ["tenant_id", "kind", "value"]
RUN_KEY = ["tenant_id", "src_ip", "slot"]


def _by_kind(kind: Column, value) -> Column:
    out = None
    for k in C.LINKS:
        v = F.lit(value(k))
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


# --- entities -------------------------------------------------------------------

def _kinds(agents: bool = False) -> list[tuple[str, Column, Column]]:
    """(kind, value, whether the event has it) of every kind of entity."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    out = [
        ("ip", F.col("src_ip"), F.col("src_ip").isNotNull()), ("subnet", X.subnet24(F.col("src_ip")), F.col("src_ip").isNotNull()),
        ("asn", F.col("asn").cast("string"), F.col("asn").isNotNull() & (F.col("asn") != 0)),
        ("user", F.col("user_id"), filled("user_id")), ("asset", F.col("asset_id"), filled("asset_id")),
        ("session", F.col("session_id"), filled("session_id")), ("cve", F.col("cve"), filled("cve")),
    ]
    return out + ([("ua_hash", F.sha2(F.col("user_agent"), 256).substr(1, 12), filled("user_agent"))] if agents else [])


def entities_of(events: DataFrame, keep: list[str] = (), agents: bool = False) -> DataFrame:
    """One row per (event, entity): address, /24, network, account, asset, session, vulnerability."""
    ents = [F.when(present & value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value"))) for kind, value, present in _kinds(agents)]
    one = F.explode(F.array_compact(F.array(*ents)))
    return (events.select("tenant_id", "event_id", "ts_us", *keep, one.alias("e"))
            .select("tenant_id", "event_id", "ts_us", *keep, "e.kind", "e.value"))


def entity_index(ents: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Entity rows with the entity's fan-out and the previous event of the entity in (ts, id) order.

    The slice summary is a map-side-combined aggregate; only it is windowed per
    entity (one row per slice).  The rows meet it again on (entity, slice), a
    key that splits a hot entity in time.
    """
    at = F.struct("ts_us", "event_id", *keep)
    rows = ents.withColumn("slot", F.floor(F.col("ts_us") / F.lit(SLICE_US)).cast("long"))
    # the hash leads the sort keys: comparing one long beats comparing long strings
    group = ["gk", *ENTITY, "slot"]
    rows = rows.withColumn("gk", F.xxhash64(*ENTITY, "slot"))
    slices = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    whole = W.partitionBy(*ENTITY)
    slices = slices.select(
        *group, F.sum("n").over(whole).alias("fanout"),
        F.lag("last").over(whole.orderBy("slot")).alias("before"))
    inside = W.partitionBy(*group).orderBy("ts_us", "event_id")
    rows = rows.withColumn("_lag", F.lag(at).over(inside)).join(slices, group)
    return rows.select(*ENTITY, "event_id", "ts_us", *keep, "fanout", F.coalesce("_lag", "before").alias("prev"))


def fanout_split(index: DataFrame) -> DataFrame:
    """Tell entities that link anything (``linked``) from those seen once (``single``)."""
    return index.withColumn("path", F.when(F.col("fanout") > 1, "linked").otherwise("single"))


def _weight(kind: Column, gap_us: Column) -> Column:
    base = _by_kind(kind, lambda k: float(C.LINKS[k][0]))
    tau = _by_kind(kind, lambda k: float(C.LINKS[k][1]))
    return base * F.exp(-(gap_us / F.lit(float(C.HOUR_US))) / tau)


def _window(kind: Column) -> Column:
    return _by_kind(kind, lambda k: int(C.LINKS[k][2] * C.HOUR_US))


def with_values(events: DataFrame) -> DataFrame:
    """Add ``vals``: a hash of the event's value of every kind in turn, NULL where it has none."""
    return events.withColumn("vals", F.array(*[F.when(present, F.xxhash64(value)) for _, value, present in _kinds()]))


def chain_links(index: DataFrame) -> DataFrame:
    """Links between neighbours in time of one entity: (kind, a, b, w)."""
    gap = F.col("ts_us") - F.col("prev.ts_us")
    near = index.where(F.col("prev").isNotNull()).where(gap <= _window(F.col("kind")))
    ends = F.least("event_id", F.col("prev.event_id")).alias("a"), F.greatest("event_id", F.col("prev.event_id")).alias("b")
    return near.select("tenant_id", "kind", *ends, _weight(F.col("kind"), gap).alias("w")).where(F.col("w") >= C.LINK_FLOOR)


def neighbour_pairs(index: DataFrame, across: str | None = None) -> DataFrame:
    """Distinct candidate pairs (a, b) with ``shared``: kind and decayed weight of everything both events share.

    ``index`` keeps ``vals``, so both ends are at hand and nothing is joined.
    ``across`` names a kept column that must differ; its values come as a_* and b_*.
    """
    pairs = index.where(F.col("prev").isNotNull())
    if across:
        pairs = pairs.where(F.col(across) != F.col(f"prev.{across}"))
    gap, swap = F.col("ts_us") - F.col("prev.ts_us"), F.col("event_id") < F.col("prev.event_id")
    shared = []
    for i, (kind, _, _) in enumerate(_kinds()):
        w = _weight(F.lit(kind), gap)
        both = (F.col("vals")[i] == F.col("prev.vals")[i]) & (gap <= _window(F.lit(kind))) & (w >= C.LINK_FLOOR)
        shared.append(F.when(both, F.struct(F.lit(kind).alias("kind"), w.alias("w"))))
    ends = [F.when(swap, F.col("event_id")).otherwise(F.col("prev.event_id")).alias("a"),
            F.when(swap, F.col("prev.event_id")).otherwise(F.col("event_id")).alias("b")]
    if across:
        ends += [F.when(swap, F.col(across)).otherwise(F.col(f"prev.{across}")).alias(f"a_{across}"),
                 F.when(swap, F.col(f"prev.{across}")).otherwise(F.col(across)).alias(f"b_{across}")]
    out = pairs.select("tenant_id", *ends, F.array_compact(F.array(*shared)).alias("shared"))
    return out.where(F.size("shared") > 0).dropDuplicates(["tenant_id", "a", "b"])


def pair_links(pairs: DataFrame) -> DataFrame:
    """One row per candidate pair and shared kind: (kind, a, b, w)."""
    return pairs.select("tenant_id", "a", "b", F.explode("shared").alias("s")).select("tenant_id", "s.kind", "a", "b", "s.w")


def edge_weights(pairs: DataFrame, cut_at: float = C.EDGE_CUT) -> DataFrame:
    """Candidate pairs whose summed weight reaches the cut; rounded so that summation order cannot flip it."""
    w = F.round(F.aggregate("shared", F.lit(0.0), lambda a, s: a + s["w"]), 9)
    return pairs.withColumn("w", w).drop("shared").where(F.col("w") >= cut_at)


# --- runs: the nodes of the graph -----------------------------------------------

def with_slot(events: DataFrame) -> DataFrame:
    return events.withColumn("slot", F.floor(F.col("ts_us") / F.lit(C.RUN_GAP_US)).cast("long"))


def run_map(events: DataFrame) -> DataFrame:
    """(address, slot) -> run.  A slot is one run gap wide, so all its events are linked to each other.

    Two neighbouring slots of an address join the same run when the last event
    of one and the first of the next are within the gap.  ``run_id`` is the
    smallest event id of the run.
    """
    slots = with_slot(events).groupBy(*RUN_KEY).agg(
        F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"), F.min("event_id").alias("low"))
    order = W.partitionBy("tenant_id", "src_ip").orderBy("slot")
    fresh = F.col("t0") - F.lag("t1").over(order) > C.RUN_GAP_US
    slots = slots.withColumn("fresh", F.coalesce(fresh, F.lit(True)))
    slots = slots.withColumn("run", F.sum(F.col("fresh").cast("int")).over(order))
    return slots.select(*RUN_KEY, F.min("low").over(W.partitionBy("tenant_id", "src_ip", "run")).alias("run_id"))


def on_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Attach run (or component) columns to events through (address, slot): a busy address is split in time."""
    return with_slot(events).join(runs, RUN_KEY).drop("slot")


# --- connected components ---------------------------------------------------------

def _skewless_min(sym: DataFrame, total: int) -> DataFrame:
    """Attach to each directed edge (u, v) the minimum of u's neighbourhood, u included.

    A hub may hold a third of all edges.  Hubs are the nodes with more than
    1/500 of the directed edges, so there are fewer than 500 of them whatever the
    data: their minima are broadcast, everything else takes a shuffle join.
    """
    low = sym.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    low = low.select("u", F.least("u", "m").alias("m"), "deg")
    limit = max(total // 500, 1000)
    hubs = F.broadcast(low.where(F.col("deg") > limit).select("u", F.col("m").alias("hub_m")))
    tagged = sym.join(hubs, "u", "left")
    rest = tagged.where(F.col("hub_m").isNull()).select("u", "v").join(
        low.where(F.col("deg") <= limit).select("u", "m"), "u")
    return rest.unionByName(tagged.where(F.col("hub_m").isNotNull()).select("u", "v", F.col("hub_m").alias("m")))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, component), component = smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each
    round is cut to a written table.  Ends when the edge set repeats.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.next(edges.where(F.col("u") != F.col("v"))
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _digest(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_skewless_min(sym, 2 * state[0]).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _skewless_min(large, state[0])
        small = (small.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
            .where(F.col("u") != F.col("v")).distinct())
        edges = rounds.next(small)
        fresh = _digest(edges)
        if fresh == state:
            break
        state = fresh
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def event_components(event_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Components straight over event-level edges (a, b), without runs: (event_id, component)."""
    comp = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return event_ids.join(comp, event_ids.event_id == comp.node, "left").select(
        "event_id", F.coalesce("component", "event_id").alias("component"))


def run_components(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(address, slot, run_id, component) for every run.  Only links between runs are ever kept."""
    ents = entities_of(with_values(on_runs(events, runs)), keep=["run_id", "vals"])
    pairs = neighbour_pairs(entity_index(ents, keep=["run_id", "vals"]), across="run_id")
    edges = cut(edge_weights(pairs)).select(F.col("a_run_id").alias("u"), F.col("b_run_id").alias("v"))
    comp = components(edges)
    return runs.join(comp, runs.run_id == comp.node, "left").select(
        *runs.columns, F.coalesce("component", "run_id").alias("component"))
