"""Filling containers of fixed capacity: a grouping genetic algorithm on islands.

Items are spread over groups of about ``group_items`` items by a hash of their id, so no group grows with
the data. A group is packed by best fit; where that needs more containers than the sum of its sizes, the
group is given to ``islands`` islands, each a population of packings that evolves in a task of its own:
crossover injects whole well-filled bins of one parent into the other, drops bins that now hold an item
twice and refits the displaced items, first by swapping them for smaller ones in half-full bins, then by
best fit; mutation empties the worst bins. After each epoch the elite of every island (its best packing)
migrates to the next island of the group, a ring, and the best of all is kept at the end.

Of a group's packing the well-filled bins are final; the items of its poorly filled bins are handed to
the next round's groups under other hash seeds. The last round closes every bin.

Only an item larger than the capacity is divided, in its group: into full containers, its remainder is
packed as an item of its own. Items of size 0 go with any bin at no cost; a null size counts as 0, a null id
as -1. Repeated ids are separate items. An empty table gives no bins. Rows of equal size are interchangeable;
ties are broken by id, and every random choice is seeded, so a packing is reproducible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.storage import written


def _best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], loads: list[int]) -> None:
    """Place items, largest first, into the fullest bin that still takes them (in place)."""
    room = sorted((capacity - load, i) for i, load in enumerate(loads))
    for item in sorted(items, key=lambda x: -sizes[x]):
        at = bisect_left(room, (sizes[item], -1))
        if at == len(room):
            bins.append([item])
            loads.append(sizes[item])
            insort(room, (capacity - sizes[item], len(bins) - 1))
        else:
            left, i = room.pop(at)
            bins[i].append(item)
            loads[i] += sizes[item]
            insort(room, (left - sizes[item], i))


def fill_quality(loads: list[int], capacity: int) -> float:
    """Mean squared fill: prefers a few full bins to many half-full ones."""
    return sum((x / capacity) ** 2 for x in loads) / len(loads) if loads else 1.0


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs."""
    return max(1, -(-sum(sizes) // capacity), sum(2 * x > capacity for x in sizes))


def _individual(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[float, list[list[int]], list[int]]:
    kept = [b for b in bins if b]
    loads = [sum(sizes[i] for i in b) for b in kept]
    return fill_quality(loads, capacity), kept, loads


def first_packing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit of the items, largest first."""
    bins: list[list[int]] = []
    _best_fit(list(range(len(sizes))), sizes, capacity, bins, [])
    return bins


def evolve(sizes: list[int], capacity: int, seed: int, elites: Iterable[list[list[int]]] = (), population: int = 12, generations: int = 60, children: int = 4) -> list[list[int]]:
    """Pack the items 0..n-1, starting from ``elites``; returns bins of item numbers. Every size must fit."""
    rng = np.random.default_rng(seed)
    n, bound = len(sizes), lower_bound(sizes, capacity)
    people = [_individual(e, sizes, capacity) for e in elites] or [_individual(first_packing(sizes, capacity), sizes, capacity)]
    while len(people) < population:
        order = rng.permutation(n) if len(people) % 2 else np.argsort(-np.asarray(sizes) * rng.normal(1, 0.2, n), kind="stable")
        bins: list[list[int]] = []
        loads: list[int] = []
        for part in np.array_split(order, max(1, n // 24)):
            _refit([int(i) for i in part], sizes, capacity, bins, loads)
        people.append(_individual(bins, sizes, capacity))
    for _ in range(generations):
        people.sort(key=lambda p: (len(p[1]), -p[0]))
        if len(people[0][1]) <= bound:
            break
        for _ in range(children):
            a, b = (people[min(rng.integers(0, population, 2))] for _ in range(2))
            child = _cross(a, b, sizes, capacity, rng)
            if all(child[0] != p[0] for p in people):
                people.append(child)
        people = sorted(people, key=lambda p: (len(p[1]), -p[0]))[:population]
    return people[0][1]


def _refit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], loads: list[int]) -> None:
    """Displaced items go in for smaller ones where that fills a bin better, one or two for one; the rest by best fit."""
    left = sorted(items, key=lambda x: -sizes[x])
    for k, (held, load) in enumerate(zip(bins, loads, strict=True)):
        if load >= capacity or not left:
            continue
        best, room = None, capacity - load
        asked = sorted({sizes[x] for x in left})
        for x in held:
            free = room + sizes[x]
            at = bisect_left(asked, free + 1) - 1
            if at >= 0 and asked[at] > sizes[x] and (best is None or asked[at] - sizes[x] > best[0]):
                best = (asked[at] - sizes[x], x, (asked[at],))
            for first in asked[:at]:
                rest = bisect_left(asked, free - first + 1) - 1
                if rest >= 0 and first + asked[rest] > sizes[x] and (best is None or first + asked[rest] - sizes[x] > best[0]):
                    if first != asked[rest] or sum(sizes[i] == first for i in left) > 1:
                        best = (first + asked[rest] - sizes[x], x, (first, asked[rest]))
            if best and best[0] == room:
                break
        if best:
            gain, out, sizes_in = best
            held.remove(out)
            for size in sizes_in:
                chosen = next(i for i in left if sizes[i] == size)
                left.remove(chosen)
                held.append(chosen)
            left.append(out)
            loads[k] = load + gain
    _best_fit(left, sizes, capacity, bins, loads)


def _cross(a: tuple, b: tuple, sizes: list[int], capacity: int, rng: np.random.Generator) -> tuple:
    """Whole bins of ``b``, mostly full ones, go into ``a``; what they displace is refitted."""
    full = sorted(range(len(b[1])), key=lambda i: -b[2][i])
    most = max(1, len(full) // 2)
    take = [i for i in full[:most] if rng.random() < 0.5] or full[:1]
    injected = {x for i in take for x in b[1][i]}
    bins, loads, displaced = [list(b[1][i]) for i in take], [b[2][i] for i in take], []
    poor = sorted(a[2])[: max(1, len(a[2]) // 10)][-1] if a[2] else 0
    for items, load in zip(a[1], a[2], strict=True):
        if not injected.isdisjoint(items):
            displaced += [x for x in items if x not in injected]
        elif load <= poor and load < capacity and rng.random() < 0.5:
            displaced += items
        else:
            bins.append(list(items))
            loads.append(load)
    _refit(displaced, sizes, capacity, bins, loads)
    return fill_quality(loads, capacity), bins, loads


#: A row of a packing: the item (numbered by ``row``, since ids may repeat) and its part, its group and island, and the bins its two elites put it in (-1: none).
ITEM = "grp bigint, island int, row bigint, item bigint, part bigint, size bigint, settled boolean, bin_no bigint, guest_bin bigint"


def _divided(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Items larger than a container as pieces: full ones and a remainder, numbered from 0."""
    big = pdf["size"] > capacity
    if not big.any():
        return pdf
    rows = [pdf[~big]]
    for _, row in pdf[big].iterrows():
        n = -(-int(row["size"]) // capacity)
        sizes = [capacity] * (n - 1) + [int(row["size"]) - (n - 1) * capacity]
        rows.append(pd.DataFrame({"grp": row["grp"], "row": row["row"], "item": row["item"], "part": np.arange(n), "size": sizes}))
    return pd.concat(rows, ignore_index=True)


def _bin_numbers(bins: list[list[int]], n: int) -> np.ndarray:
    numbers = np.full(n, -1, dtype=np.int64)
    for k, items in enumerate(bins):
        numbers[items] = k
    return numbers


def _sorted_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["size", "item", "part", "row"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)


def _first(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """A group packed by best fit; settled if no packing can need fewer containers."""
    pdf = _sorted_group(_divided(pdf, capacity))
    sizes = [int(x) for x in pdf["size"]]
    bins = first_packing(sizes, capacity)
    settled = len(bins) <= lower_bound(sizes, capacity)
    return pdf.assign(island=0, settled=settled, bin_no=_bin_numbers(bins, len(sizes)), guest_bin=-1)[_columns()]


def _columns() -> list[str]:
    return [c.split()[0] for c in ITEM.split(", ")]


def _bins_of(numbers: pd.Series) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        bins.setdefault(int(k), []).append(i)
    return [bins[k] for k in sorted(bins)] if -1 not in bins else []


def _island(pdf: pd.DataFrame, capacity: int, seed: int, generations: int) -> pd.DataFrame:
    """One epoch of one island, from its own elite and the one that came from its neighbour."""
    pdf = _sorted_group(pdf)
    sizes = [int(x) for x in pdf["size"]]
    elites = [e for e in (_bins_of(pdf["bin_no"]), _bins_of(pdf["guest_bin"])) if e]
    own_seed = abs(hash((seed, int(pdf["grp"].iloc[0]), int(pdf["island"].iloc[0]))))
    best = evolve(sizes, capacity, own_seed, elites, generations=generations)
    settled = len(best) <= lower_bound(sizes, capacity)
    return pdf.assign(settled=settled, bin_no=_bin_numbers(best, len(sizes)), guest_bin=-1)[_columns()]


def migrated(placed: DataFrame, islands: int) -> DataFrame:
    """Every island's rows with the elite of the island before it in the ring as ``guest_bin``."""
    guests = placed.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "row", "part", F.col("bin_no").alias("came"))
    key = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("grp", "island", "row", "part")]
    joined = placed.drop("guest_bin").alias("x").join(guests.alias("y"), key)
    return joined.select(*[F.col(f"x.{c}") for c in _columns()[:-1]], F.col("y.came").alias("guest_bin"))


def _evolved(open_groups: DataFrame, capacity: int, islands: int, epochs: int, seed: int, generations: int) -> DataFrame:
    """The best packing of every group that best fit left open."""
    spread = open_groups.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).select(*_columns())
    for epoch in range(epochs):
        if epoch:
            spread = migrated(spread, islands)
        fn = partial(_island, capacity=capacity, seed=seed + epoch, generations=generations)
        spread = written(spread.groupBy("grp", "island").applyInPandas(fn, ITEM), "islands")
    counts = spread.groupBy("grp", "island").agg((F.max("bin_no") + 1).alias("n"))
    best = counts.groupBy("grp").agg(F.min(F.struct("n", "island")).alias("b")).select("grp", F.col("b.island").alias("island"))
    return spread.join(best, ["grp", "island"], "left_semi")


def pack(sizes: DataFrame, capacity: int = 4096, group_items: int = 1024, rounds: int = 3, good: float = 0.995, islands: int = 3, epochs: int = 2, generations: int = 30, seed: int = 7) -> DataFrame:
    """``sizes`` has ``item`` (bigint) and ``size``; returns ``item, part, size, epoch, island, bin_no``.

    (epoch, island, bin_no) names a container: the round, group and bin that closed it. ``part`` counts the pieces
    of a divided item from 0; whole items have part 0 and all other parts do not exist.
    """
    items = sizes.select(F.coalesce(F.col("item").cast("bigint"), F.lit(-1)).alias("item"), F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"))
    # Rows that are alike in all columns stay apart: each has a number of its own.
    open_items = written(items.select("item", F.monotonically_increasing_id().alias("row"), F.lit(0).cast("bigint").alias("part"), "size"), "items")
    done = None
    for k in range(rounds):
        n = open_items.count()
        final = k == rounds - 1 or n <= group_items
        groups = max(1, -(-n // group_items))
        grouped = open_items.withColumn("grp", F.pmod(F.xxhash64("item", "part", F.when(F.col("item") < 0, F.col("row")), F.lit(seed + k)), F.lit(groups)).cast("bigint")).select("grp", "row", "item", "part", "size")
        first = written(grouped.groupBy("grp").applyInPandas(partial(_first, capacity=capacity), ITEM), "pack")
        hard = first.where("not settled")
        placed = first
        if hard.limit(1).count():
            placed = written(first.where("settled").unionByName(_evolved(hard, capacity, islands, epochs, seed + k, generations)), "packed")
        loads = placed.groupBy("grp", "bin_no").agg(F.sum("size").alias("load"))
        closed = loads if final else loads.where(F.col("load") >= good * capacity)
        kept = placed.join(closed, ["grp", "bin_no"], "left_semi").select("item", "part", "size", F.lit(k).alias("epoch"), F.col("grp").alias("island"), "bin_no")
        done = kept if done is None else done.unionByName(kept)
        if final:
            break
        open_items = written(placed.join(closed, ["grp", "bin_no"], "left_anti").select("row", "item", "part", "size"), "open")
    return done


def fill_report(placed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: items, pieces, containers, tokens and the share of the containers' room that is used."""
    bins = placed.groupBy("epoch", "island", "bin_no").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    return bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.count("*").alias("containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"), F.coalesce(F.max("load"), F.lit(0)).alias("fullest"), F.coalesce(F.sum("load") / (F.count("*") * capacity), F.lit(1.0)).alias("used_share"))


def divided_items(placed: DataFrame) -> DataFrame:
    """Items that stand in more than one container, read from the containers themselves."""
    bins = placed.select("item", F.struct("epoch", "island", "bin_no").alias("bin"))
    return bins.groupBy("item").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo <> hi").select("item")


def kept_items(placed: DataFrame, sizes: DataFrame, capacity: int = 4096) -> DataFrame:
    """``item, kept``: whether an item stands in containers with its whole size, none of them over capacity."""
    bins = placed.groupBy("epoch", "island", "bin_no").agg(F.sum("size").alias("load"))
    over = bins.where(F.col("load") > capacity).limit(1).count() > 0
    there = placed.groupBy("item").agg(F.sum("size").alias("placed"), F.count("*").alias("pieces"))
    asked = sizes.select(F.coalesce(F.col("item"), F.lit(-1)).alias("item"), F.coalesce("size", F.lit(0)).alias("size"))
    whole = (F.col("placed") == F.col("size")) & (F.col("pieces") == F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)))
    return asked.join(there, "item", "left").select("item", (F.coalesce(whole, F.lit(False)) & F.lit(not over)).alias("kept"))
