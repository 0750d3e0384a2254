"""One-to-one resolution of candidate pairs."""

from __future__ import annotations

import heapq
from collections import defaultdict
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from skyweft.operators.components import connected_components
from skyweft.session import cut_lineage, ship_code

#: Edges of a component that one task solves.
MAX_EDGES = 200_000
#: Units of cost that the auction tells apart.
COST_UNIT = 1e-6


def one_to_one(
    pairs: DataFrame,
    *,
    left_key: str = "gaia_source_id",
    right_key: str = "wise_designation",
    log_factor: str = "ln_b",
) -> DataFrame:
    """The set of pairs with the largest total evidence that uses every source once.

    Each left source brings at most one candidate, so the pairs form stars
    around right sources, every right source can be served, and the optimum
    keeps the best pair of each star. That is a top-1 per right source: tasks
    keep one row per source before the shuffle, so a much wanted source is no
    hot spot. Equal evidence goes to the smaller left key.
    """
    best_first = Window.partitionBy(right_key).orderBy(F.col(log_factor).desc(), F.col(left_key))
    return pairs.withColumn("_rank", F.row_number().over(best_first)).filter(F.col("_rank") == 1).drop("_rank")


def cheapest_matching(edges: list[list[tuple[int, float]]]) -> list[int | None]:
    """Right partner of each left source in the largest matching of least total cost.

    ``edges``: the (right, cost) of every left source. Sources are added one after
    the other along the cheapest path that frees a right source for them; a left
    source may instead stay alone at a cost above that of any matching.
    """
    alone = 1.0 + 2.0 * sum(abs(cost) for own in edges for _, cost in own)
    partner: list[int | None] = [None] * len(edges)
    owner: dict[int, int] = {}
    on_right: dict[int, float] = defaultdict(float)
    on_left = [min([cost for _, cost in own], default=alone) for own in edges]
    for start in range(len(edges)):
        reached, came_from, at = {}, {}, {start: 0.0}
        queue: list[tuple[float, int, int]] = []

        def offer(left: int, distance: float) -> None:
            for right, cost in edges[left]:
                if right not in reached:
                    heapq.heappush(queue, (distance + cost - on_left[left] - on_right[right], right, left))
            heapq.heappush(queue, (distance + alone - on_left[left], -1 - left, left))

        offer(start, 0.0)
        while True:
            distance, right, left = heapq.heappop(queue)
            if right in reached:
                continue
            reached[right], came_from[right] = distance, left
            if right < 0 or right not in owner:
                break
            at[owner[right]] = distance
            offer(owner[right], distance)
        for left, passed in at.items():
            on_left[left] += distance - passed
        for passed_right, passed in reached.items():
            on_right[passed_right] -= distance - passed
        while True:
            left = came_from[right]
            freed, partner[left] = partner[left], None if right < 0 else right
            if right >= 0:
                owner[right] = left
            if left == start:
                break
            right = freed
    return partner


def assign_components(
    pairs: DataFrame,
    *,
    left_key: str = "gaia_source_id",
    right_key: str = "wise_designation",
    log_factor: str = "ln_b",
    max_edges: int = MAX_EDGES,
) -> DataFrame:
    """The pairs of a one-to-one assignment where sources on both sides have several candidates.

    As many sources as possible are matched, with the largest total evidence among
    such assignments; a pair that is listed twice counts with its larger evidence.

    * Stars, where all sources of one side have a single candidate, keep their best
      pair: a top-1 per key without a group.
    * The rest falls into connected components. Each is solved exactly in one task by
      shortest augmenting paths.
    * A component of more than ``max_edges`` pairs is settled by an auction, whose
      rounds are joins and aggregations, on costs in units of ``COST_UNIT``.

    Equal totals within ``COST_UNIT`` are settled in the order of keys.
    """
    ship_code(pairs.sparkSession)
    columns, keys = pairs.columns, [left_key, right_key]
    body = F.struct(*[F.col(f"`{c}`") for c in columns])
    best = F.max_by(body, F.col(log_factor)).alias("_row")
    graph = pairs.filter(F.col(log_factor).isNotNull()).groupBy(
        F.col(left_key).alias("_left"), F.col(right_key).alias("_right")).agg(best)
    graph = cut_lineage(graph.withColumn("_cost", -F.col("_row").getField(log_factor)))
    keyed = graph.select("_left", "_right", "_cost")

    # An edge is part of a star where no source at the far end of any neighbouring edge has a second edge.
    degrees = [keyed.groupBy(side).agg(F.count(F.lit(1)).alias(f"_n{side}")) for side in ("_left", "_right")]
    counted = cut_lineage(keyed.join(degrees[0], "_left").join(degrees[1], "_right"))
    far = {"_left": "_right", "_right": "_left"}
    most = [counted.groupBy(side).agg(F.max(f"_n{far[side]}").alias(f"_far{side}")) for side in ("_left", "_right")]
    shaped = cut_lineage(counted.join(most[0], "_left").join(most[1], "_right"))
    around_right = (F.col("_n_left") == 1) & (F.col("_far_right") == 1)
    around_left = (F.col("_n_right") == 1) & (F.col("_far_left") == 1)
    chosen = [
        _first(shaped.filter(around_right), "_right", "_left"),
        _first(shaped.filter(around_left & ~around_right), "_left", "_right"),
    ]
    mixed = shaped.filter(~(around_left | around_right)).select("_left", "_right", "_cost")
    if not mixed.isEmpty():
        chosen += _solved(mixed, max_edges)
    picked = chosen[0]
    for more in chosen[1:]:
        picked = picked.unionByName(more)
    out = graph.join(picked, ["_left", "_right"], "left_semi")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def _first(star: DataFrame, centre: str, ray: str) -> DataFrame:
    order = Window.partitionBy(centre).orderBy("_cost", ray)
    return star.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select("_left", "_right")


def _solved(mixed: DataFrame, max_edges: int) -> list[DataFrame]:
    """Chosen pairs of components that are no stars."""
    mixed = cut_lineage(mixed)
    node = {side: F.concat(F.lit(side[1]), F.col(side).cast("string")) for side in ("_left", "_right")}
    named = mixed.withColumns({"_l": node["_left"], "_r": node["_right"]})
    components = connected_components(named, "_l", "_r").select(F.col("node").alias("_l"), F.col("component").alias("_component"))
    labelled = cut_lineage(named.join(components, "_l").select("_component", "_left", "_right", "_cost"))
    large = cut_lineage(labelled.groupBy("_component").count().filter(F.col("count") > max_edges).select("_component"))
    small, chosen = labelled, []
    if not large.isEmpty():
        small = labelled.join(large, "_component", "left_anti")
        chosen.append(auction(labelled.join(large, "_component", "left_semi")))
    kept = T.StructType([labelled.schema["_left"], labelled.schema["_right"]])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_left", "ascending"), ("_right", "ascending")])
        lefts, rights, costs = (table.column(c).to_pylist() for c in ("_left", "_right", "_cost"))
        number = {r: i for i, r in enumerate(sorted(set(rights)))}
        places: dict = {}
        edges: list[list[tuple[int, float]]] = []
        rows: dict[tuple[int, int], int] = {}
        for at, (left, right, cost) in enumerate(zip(lefts, rights, costs, strict=True)):
            if left not in places:
                places[left] = len(edges)
                edges.append([])
            edges[places[left]].append((number[right], cost))
            rows[places[left], number[right]] = at
        found = [rows[left, right] for left, right in enumerate(cheapest_matching(edges)) if right is not None]
        return table.select(["_left", "_right"]).take(pa.array(found, pa.int64()))

    return [*chosen, small.groupBy("_component").applyInArrow(solve, kept)]


def auction(edges: DataFrame) -> DataFrame:
    """(_left, _right) of the largest matching of least total ``_cost``, in rounds of bids over the whole table.

    The graph is doubled with its sides exchanged, and each source is tied to its own
    double, so that everybody can be matched; being matched to another source is worth
    more than all evidence together. Unmatched sources bid for the partner that is worth
    most to them, raising its price by what it is better than their second choice plus a
    small step. The step shrinks from phase to phase until it is too small to hide a
    better matching of costs in whole units. Prices and owners are written after every
    round; only the number of those without a partner reaches the driver.
    """
    whole = cut_lineage(edges.select(
        F.concat(F.lit("l"), F.col("_left").cast("string")).alias("_l"), F.concat(F.lit("r"), F.col("_right").cast("string")).alias("_r"),
        F.round(F.col("_cost") / F.lit(COST_UNIT)).cast("decimal(38,0)").alias("_units"), "_left", "_right"))
    worst, least, n = whole.agg(F.max("_units"), F.min("_units"), F.count_distinct("_l") + F.count_distinct("_r")).first()
    # Integers of any length are exact: values are decimals, scaled so that a step of 1 is below one unit over all sources.
    scale = 2 * n + 1
    apart = int(worst - least)
    bonus = (apart + 1) * (n + 1)
    number = "decimal(38,0)"
    worth = ((F.lit(Decimal(bonus + int(worst))) - F.col("_units")) * F.lit(Decimal(scale))).cast(number)
    nodes = whole.select(F.col("_l").alias("_node")).union(whole.select("_r")).distinct()
    offers = [
        whole.select(F.col("_l").alias("_bidder"), F.col("_r").alias("_item"), worth.alias("_worth")),
        whole.select(F.col("_r").alias("_bidder"), F.col("_l").alias("_item"), worth.alias("_worth")),
        nodes.select(F.col("_node").alias("_bidder"), F.col("_node").alias("_item"), F.lit(0).cast(number).alias("_worth")),
    ]
    market = cut_lineage(offers[0].unionByName(offers[1]).unionByName(offers[2]))
    prices = cut_lineage(nodes.select(F.col("_node").alias("_item"), F.lit(0).cast(number).alias("_price"),
                                      F.lit(None).cast("string").alias("_owner")))
    step = (bonus + apart) * scale // 2
    while True:
        step = max(1, step // 6)
        prices = prices.withColumn("_owner", F.lit(None).cast("string"))
        while True:
            idle = market.join(prices.filter("_owner IS NOT NULL").select(F.col("_owner").alias("_bidder")), "_bidder", "left_anti")
            valued = idle.join(prices.select("_item", "_price"), "_item").withColumn("_net", F.col("_worth") - F.col("_price"))
            order = Window.partitionBy("_bidder").orderBy(F.desc("_net"), "_item")
            two = valued.withColumn("_nth", F.row_number().over(order)).filter("_nth <= 2").groupBy("_bidder").agg(
                F.max(F.when(F.col("_nth") == 1, F.struct("_item", "_price", "_net"))).alias("_best"),
                F.max(F.when(F.col("_nth") == 2, F.col("_net"))).alias("_second"))
            bid = F.col("_best._price") + F.col("_best._net") - F.coalesce("_second", F.col("_best._net")) + F.lit(Decimal(step))
            bids = two.select(F.col("_best._item").alias("_item"), F.struct(bid.cast(number).alias("bid"), "_bidder").alias("_bid"))
            highest = cut_lineage(bids.groupBy("_item").agg(F.max("_bid").alias("_bid")))
            if highest.isEmpty():
                break
            prices = cut_lineage(prices.join(highest, "_item", "left").select(
                "_item", F.coalesce("_bid.bid", "_price").alias("_price"), F.coalesce("_bid._bidder", "_owner").alias("_owner")))
        if step == 1:
            break
    matched = prices.select(F.col("_owner").alias("_l"), F.col("_item").alias("_r"))
    return whole.join(matched, ["_l", "_r"], "left_semi").select("_left", "_right")
