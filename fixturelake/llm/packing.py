"""Containers of fixed capacity: optimal length buckets over the global histogram, filled by token budget."""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixturelake.operators.skew import SALTS, dense_rank_in
from fixturelake.session import durable

#: Buckets per capacity.
BUCKETS = 1024


def bucket_bounds(histogram: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``most`` buckets of lengths 1..C that minimise total padding.

    histogram[s] = number of items of length s. Dynamic programming over the lengths that occur: a bucket of the
    lengths i to j costs its items times its bound less their tokens, a line in the bound for each i, so one sweep
    over a lower hull of lines finds the best buckets at a given price a bucket. The padding is convex in the number of buckets,
    so a search over whole prices finds the one at which ``most`` buckets are best; where several numbers of buckets are equally
    good at that price, the paths with fewer and with more are crossed to the exact number.
    """
    sizes = (np.flatnonzero(histogram[1:]) + 1).tolist()
    m = len(sizes)
    n = [int(histogram[s]) for s in sizes]
    items, tokens = [0, *accumulate(n)], [0, *accumulate(a * b for a, b in zip(n, sizes))]
    unit = m + 2  # padding counts in units that outweigh all buckets, so that ties fall to fewer or to more of them

    def path(price: int) -> list[int]:
        """Bounds of the cheapest buckets as numbers of lengths before them, from 0 to m."""
        best, before, hull, at = [0] * (m + 1), [0] * (m + 1), [], 0
        for j, s in enumerate(sizes):
            line = (-items[j] * unit, best[j] + tokens[j] * unit + price, j)
            while len(hull) - at >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
            while at + 1 < len(hull) and hull[at + 1][0] * s + hull[at + 1][1] <= hull[at][0] * s + hull[at][1]:
                at += 1
            best[j + 1] = hull[at][0] * s + hull[at][1] + (s * items[j + 1] - tokens[j + 1]) * unit
            before[j + 1] = hull[at][2]
        out = [m]
        while out[-1]:
            out.append(before[out[-1]])
        return out[::-1]

    low, high = 0, max(1, sizes[-1] * items[m] - tokens[m]) if m else 1
    while low < high:  # the least price at which no more than ``most`` buckets are worth it
        middle = (low + high) // 2
        if len(path(middle * unit + 1)) - 1 <= most:
            high = middle
        else:
            low = middle + 1
    few = path(low * unit + 1)
    many = path(low * unit - 1) if low and len(few) - 1 < most else few
    extra = min(most, len(many) - 1) - (len(few) - 1)
    if extra > 0:  # an edge of the shorter path that spans the edge of the longer one as many steps on
        i = next(i for i in range(len(few) - 1) if few[i] <= many[i + extra] and many[i + extra + 1] <= few[i + 1])
        few = many[: i + extra + 1] + few[i + 1 :]
    return np.array([sizes[k - 1] for k in few[1:]], np.int64)


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Containers as runs (first container, how many alike, [(bucket bound, items of it in each)]).

    A batch opens with as many items of the longest bucket left as the token budget holds; the room that stays
    is topped up from the next shorter buckets. Alike containers are made in one step, so the work grows with
    the number of buckets, never with the number of items.
    """
    left = {b: n for b, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    runs, first = [], 0
    while order:
        room, pattern = capacity, []
        for b in order:
            if b > room:
                continue
            take = min(left[b], room // b)
            if take:
                pattern.append((b, take))
                room -= take * b
            if room < order[-1]:
                break
        times = min(left[b] // k for b, k in pattern)
        for b, k in pattern:
            left[b] -= k * times
        runs.append((first, times, pattern))
        first += times
        order = [b for b in order if left[b] > 0]
    return runs


def pack(items: DataFrame, key: str, size: str, capacities: list[tuple[int, int]], buckets: int = BUCKETS, salts: int = SALTS) -> DataFrame:
    """(capacity_id, container_id, key, piece, first_token, n_tokens): every item's container for every capacity.

    An item longer than the capacity is cut into full pieces, each a container of its own, and a rest; no other
    item is cut. Lengths are counted in one global histogram (at most as many numbers as the largest capacity);
    bucket bounds and the filling plan follow from it alone, then each item takes the place its rank in its
    bucket gives it. Ranks are counted salt by salt, so one bucket may hold any share of the items. Items of
    length 0 or null (empty texts) need no room and lie in container 0. Capacities below 1 are refused. An
    empty table gives no rows.
    """
    spark = items.sparkSession
    if any(c is None or c < 1 for _, c in capacities):
        raise ValueError("a capacity below one token holds nothing")
    sized = durable(items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size")))
    caps = spark.createDataFrame(capacities or [(0, 1)], "capacity_id int, _cap long").limit(len(capacities))
    each = sized.crossJoin(F.broadcast(caps))
    rest = F.col("_size") % F.col("_cap")
    histogram = each.where(rest > 0).groupBy("capacity_id", rest.cast("int").alias("_len")).agg(F.count(F.lit(1)).alias("n")).collect()

    bounds_rows, plan_rows, next_free = [], [], {}
    for cid, cap in capacities:
        h = np.zeros(cap + 1, np.int64)
        for r in histogram:
            if r[0] == cid:
                h[r[1]] = r[2]
        bounds = bucket_bounds(h, buckets)
        counts, low = {}, 0
        for b in bounds.tolist():
            counts[b] = int(h[low + 1 : b + 1].sum())
            bounds_rows += [(cid, s, b) for s in range(low + 1, b + 1) if h[s]]
            low = b
        used = dict.fromkeys(counts, 0)
        runs = plan_containers(counts, cap)
        for first, times, pattern in runs:
            for b, k in pattern:
                plan_rows.append((cid, b, used[b], k, first, used[b] + k * times))
                used[b] += k * times
        next_free[cid] = max([1, *(f + t for f, t, _ in runs)])

    # bounded by the capacities, whatever the number of items
    bounds_df = F.broadcast(spark.createDataFrame(bounds_rows or [(-1, 0, 0)], "capacity_id int, _len int, _bucket int"))
    pieces = each.where(rest > 0).select("capacity_id", key, "_size", "_cap", rest.cast("int").alias("_len")).join(bounds_df, ["capacity_id", "_len"])
    ranked = dense_rank_in(pieces, ["capacity_id", "_bucket"], F.col(key), key, "_rank", salts)

    of_bucket: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    for r in plan_rows:
        of_bucket[r[0], r[1]].append(r[2:5])
    steps = {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for k, v in of_bucket.items()}
    shared = spark.sparkContext.broadcast(steps)

    key_type = items.schema[key].dataType
    schema = T.StructType([
        T.StructField("capacity_id", T.IntegerType()), T.StructField("container_id", T.LongType()), T.StructField(key, key_type),
        T.StructField("piece", T.LongType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])

    def place(batches):
        for b in batches:
            cid, bucket, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("capacity_id", "_bucket", "_rank"))
            out = np.zeros(len(cid), np.int64)
            pairs = cid.astype(np.int64) << 32 | bucket
            for p in np.unique(pairs):
                at = np.flatnonzero(pairs == p)
                start, per, first = shared.value[int(p >> 32), int(p & 0xFFFFFFFF)]
                run = np.searchsorted(start, rank[at], "right") - 1
                out[at] = first[run] + (rank[at] - start[run]) // per[run]
            n, full = b.column(b.schema.get_field_index("_len")), b.column(b.schema.get_field_index("_size")).to_numpy() - b.column(b.schema.get_field_index("_len")).to_numpy()
            cap = b.column(b.schema.get_field_index("_cap")).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("capacity_id")), pa.array(out), b.column(b.schema.get_field_index(key)), pa.array(full // cap), pa.array(full), n.cast(pa.int64())],
                names=schema.names,
            )

    rests = ranked.select("capacity_id", key, "_bucket", "_rank", "_len", "_size", "_cap").mapInArrow(place, schema)
    # full pieces: numbered after the planned containers, by the items' running number of pieces
    long = each.where(F.col("_size") >= F.col("_cap")).select("capacity_id", key, "_size", "_cap", (F.col("_size") / F.col("_cap")).cast("long").alias("_full"))
    salted = long.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    from pyspark.sql import Window as W

    totals = salted.groupBy("capacity_id", "_salt").agg(F.sum("_full").alias("_n"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy("capacity_id").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    running = F.coalesce(F.sum("_full").over(W.partitionBy("capacity_id", "_salt").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.create_map(*[F.lit(x) for cid, _ in capacities for x in (cid, next_free[cid])]) if capacities else F.create_map(F.lit(0), F.lit(1))
    fulls = (
        salted.withColumn("_before", running).join(F.broadcast(starts), ["capacity_id", "_salt"])
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
        .select(
            "capacity_id", (F.element_at(after, F.col("capacity_id")) + F.col("_start") + F.col("_before") + F.col("piece")).cast("long").alias("container_id"), key,
            "piece", (F.col("piece") * F.col("_cap")).alias("first_token"), F.col("_cap").alias("n_tokens"),
        )
    )
    zero = F.lit(0).cast("long")
    none = each.where("_size = 0").select("capacity_id", zero.alias("container_id"), key, zero.alias("piece"), zero.alias("first_token"), zero.alias("n_tokens"))
    return rests.unionByName(fulls).unionByName(none)
