"""Problem 7: texts -> containers of a fixed number of tokens with as little unused room as possible.

A text longer than the capacity gives full containers of its own and one remainder; nothing else is split. The rest is
bin packing, and only the *histogram* of lengths (at most ``capacity`` rows) matters for it:

1. the configuration linear program over the histogram (how often each pattern of lengths is used) is solved by
   multiplicative weights. The price of a length is its size times a weight. A round prices patterns by one knapsack
   dynamic program over the capacity, which gives for every length the best pattern that holds it; those within ``NEAR``
   of the best price are used until a length of theirs is covered. Within a pass the weight follows the uncovered share
   (``exp(STEP * share / mean share)``); a pass ends when all but ``REST`` of the volume is covered, however many rounds that
   takes (every round uses the best pattern). From pass to pass each weight is multiplied by ``exp(RATE * lateness)``, so
   lengths that were left over become dearer and are placed earlier. Passes end within ``GAP`` of the lower bound, or
   after ``PATIENCE`` passes without gain;
2. whole parts of the counts are kept, and what is left is priced and used in whole counts in the same way;
   a remnant in which no pattern comes near the best price any more is packed by best fit;
3. patterns are turned into slots: the k-th text of a length goes to a container computed from k. Ranks come from
   a two-level count (length, hash bucket), so a length that holds a third of all texts is never in one task, and a slot
   is found by binary search, so a text meets one slot and not all slots of its length.

``lower_bound`` proves the quality: the prices of any round, divided by the value of the best pattern, are a feasible dual,
as are the dual-feasible step functions (1 for lengths beyond capacity - k, 0 below k, else the share of the capacity).

Only the histogram and the patterns reach the driver; both are bounded by the capacity, not by the data.

Defined results: null and empty texts have no tokens and are in no container; every token of every other text is in
exactly one container; ties between texts of a length are ordered by hash and id; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekg.llm.tokens import n_tokens
from passagekg.runtime import stage_table

CAPACITY = 2_048
#: Exponents of the multiplicative weights: by the uncovered share within a pass, and by lateness from pass to pass.
STEP, RATE = 0.1, 0.2
#: How far below the best price a pattern may be, and the share of the volume at which a pass ends.
NEAR, REST = 0.05, 0.02
#: Gap to the lower bound at which passes end, and passes without gain after which they end as well.
GAP, PATIENCE = 0.005, 3
#: Near-ties between companions are broken at random within this share, so that they share the load; the seed of that.
BLUR, SEED = 0.01, 7
#: Texts per rank bucket.
BUCKET = 200_000

Pattern = tuple[tuple[int, int], ...]  # (length, copies), ascending


def price(lengths: np.ndarray, prices: np.ndarray, capacity: int, blur: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic program: (greatest value within every room 0..capacity, a length that reaches it).

    A choice of -2 leaves one unit of room unused, -1 ends. Among near-ties, ``blur`` picks.
    """
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    free = len(blur) - len(lengths)
    for room in range(1, capacity + 1):
        k = fits[room]
        best[room], choice[room] = best[room - 1], -2
        if k:
            gains = best[room - lengths[:k]] + prices[:k]
            top = gains.max()
            if top > best[room]:
                at = (shift + 523 * room) % free
                best[room], choice[room] = top, (gains * (1 - blur[at : at + k])).argmax()
    return best, choice


def patterns_through(lengths: np.ndarray, choice: np.ndarray, capacity: int) -> np.ndarray:
    """For every length one pattern that holds it: a matrix (length, length) of copies, by following ``choice``."""
    m = len(lengths)
    copies = np.eye(m, dtype=np.int32)
    room = capacity - lengths
    live = np.nonzero(room > 0)[0]
    while len(live):
        chosen = choice[room[live]]
        room[live[chosen == -2]] -= 1
        taking, taken = live[chosen >= 0], chosen[chosen >= 0]
        copies[taking, taken] += 1
        room[taking] -= lengths[taken]
        live = live[(room[live] > 0) & (chosen != -1)]
    return copies


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> float:
    """Containers that any packing needs, by the dual-feasible step functions."""
    sizes_ = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in sizes_], dtype=float)
    best = 0.0
    for k in range(capacity // 2 + 1):
        dual = np.where(sizes_ > capacity - k, 1.0, np.where(sizes_ >= k, sizes_ / capacity, 0.0))
        best = max(best, float(need @ dual))
    return best


def _cover(histogram: dict[int, float], learned: np.ndarray, capacity: int, whole: bool) -> tuple[dict[Pattern, float], dict[int, float], float, np.ndarray]:
    """One pass of rounds over ``histogram`` under the ``learned`` weights: (pattern counts, what is left, bound by duals, how late each length was covered).

    With ``whole``, counts are whole numbers and rounds end when no near-best pattern can be used once.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in lengths], dtype=float)
    left, late = need.copy(), np.zeros(len(lengths))
    volume = float(need @ lengths)
    rng = np.random.default_rng(SEED)
    blur = rng.random(8 * max(capacity, len(lengths))) * BLUR
    counts: dict[Pattern, float] = {}
    bound, mean = 0.0, 1.0
    while mean > (0.0 if whole else REST):
        open_ = np.nonzero(left >= 1.0 if whole else left > 1e-9 * need)[0]
        if not len(open_):
            break
        share = left / need
        prices = lengths / capacity * learned * np.exp(STEP * np.minimum(share / mean, 1 / REST))
        best, choice = price(lengths[open_], prices[open_], capacity, blur, int(rng.integers(len(blur) // 2)))
        if len(open_) == len(lengths):
            bound = max(bound, float(need @ prices) / best[capacity])
        copies = patterns_through(lengths[open_], choice, capacity)
        near = np.nonzero(copies @ prices[open_] >= (1 - NEAR) * best[capacity])[0]
        used = False
        for row in near[::-1]:  # from the longest
            held = np.nonzero(copies[row])[0]
            n = copies[row, held]
            at = open_[held]
            times = float((left[at] / n).min())
            times = np.floor(times) if whole else times
            if times < 1e-12:
                continue
            left[at] -= n * times
            key = tuple(zip(lengths[at].tolist(), n.tolist(), strict=True))
            counts[key] = counts.get(key, 0.0) + times
            used = True
        if not used:
            break
        before, mean = mean, float(left @ lengths) / volume
        late += (share + left / need) / 2 * (before - mean)
    return counts, {int(x): float(k) for x, k in zip(lengths, left, strict=True) if k > 1e-9}, bound, late


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[Pattern, float], float, float, np.ndarray]:
    """Solution of the configuration LP: (pattern counts, their sum with the remnant packed, lower bound, learned weights)."""
    learned = np.ones(len(histogram))
    bound, best, idle = lower_bound(histogram, capacity), None, 0
    while True:
        counts, left, dual, late = _cover(histogram, learned, capacity, False)
        bound = max(bound, dual)
        value = sum(counts.values()) + sum(k for _, k in best_fit(left, capacity, 0.0))
        if best is None or value < best[1]:
            best, idle = (counts, value, learned), 0
        else:
            idle += 1
        if value <= (1 + GAP) * bound or idle == PATIENCE:
            return best[0], best[1], bound, best[2]
        learned = learned * np.exp(RATE * (late - late.mean()))


def best_fit(histogram: dict[int, float], capacity: int = CAPACITY, least: float = 1.0) -> list[tuple[Pattern, float]]:
    """Containers filled one pattern at a time, largest first, then the largest that still fits."""
    left = {x: k for x, k in histogram.items() if k > 0}
    out: list[tuple[Pattern, float]] = []
    while left:
        room, pattern = capacity, Counter()
        for x in sorted(left, reverse=True):
            k = min(int(left[x]) if least else room // x, room // x)
            if k:
                pattern[x] += k
                room -= k * x
            if room < 1:
                break
        times = min(left[x] / k for x, k in pattern.items())
        times = float(int(times)) if least else times
        out.append((tuple(sorted(pattern.items())), times))
        for x, k in pattern.items():
            left[x] -= k * times
            if left[x] <= 1e-9:
                del left[x]
    return out


def patterns_of(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole pattern counts that use every item once: LP counts without their fractions, then the rest."""
    fractional, _, _, learned = solve(histogram, capacity)
    weight = dict(zip(sorted(histogram), learned, strict=True))
    left = dict(histogram)
    found: Counter = Counter()

    def take(pattern: Pattern, times: int) -> None:
        found[pattern] += times
        for x, k in pattern:
            left[x] -= k * times
            if not left[x]:
                del left[x]

    for pattern, times in fractional.items():
        if times >= 1:
            take(pattern, int(times))
    for pattern, times in _cover(left, np.array([weight[x] for x in sorted(left)]), capacity, True)[0].items() if left else ():
        take(pattern, int(times))
    for pattern, times in best_fit(left, capacity):
        take(pattern, int(times))
    return [(dict(p), k) for p, k in found.items()]


def pattern_slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, copies, first_container): where the texts of a length go, by rank."""
    at: Counter = Counter()
    rows, container = [], 0
    for pattern, times in patterns:
        for x, k in pattern.items():
            rows.append((x, at[x], at[x] + k * times, k, container))
            at[x] += k * times
        container += times
    return rows


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of every text with tokens."""
    return documents.select("doc_id", n_tokens(F.col("text")).alias("n_tokens")).where("n_tokens > 0")


def parts(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_ix, token_start, size): full containers of oversized texts, then the remainder."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(capacity).cast("bigint"))
    p = sized.select("doc_id", "n_tokens", F.posexplode(starts).alias("part_ix", "token_start"))
    return p.select("doc_id", "part_ix", "token_start", F.least(F.lit(capacity), F.col("n_tokens") - F.col("token_start")).cast("int").alias("size"))


def ranked(items: DataFrame, n_items: int) -> DataFrame:
    """Adds ``rank`` (from 0) among the items of one size, without a task that sees all items of a size."""
    n_buckets = max(1, -(-n_items // BUCKET))
    hashed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_ix"), F.lit(n_buckets)))
    counts = hashed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "part_ix"))
    return hashed.withColumn("inside", inside - 1).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")


def _slot_udf(shared):
    @F.pandas_udf(T.LongType())
    def slot(size: pd.Series, rank: pd.Series) -> pd.Series:
        base, starts, lo, copies, first = shared.value
        at = base[size.to_numpy()] + rank.to_numpy()
        i = np.searchsorted(starts, at, side="right") - 1
        return pd.Series(first[i] + (at - starts[i]) // copies[i])

    return slot


def slot_index(slots: list[tuple[int, int, int, int, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """``slots`` as arrays for binary search over (size, rank): a size's ranks follow those of the sizes below it."""
    rows = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    held = np.zeros(capacity + 2, dtype=np.int64)
    np.add.at(held, rows[:, 0] + 1, rows[:, 2] - rows[:, 1])
    base = np.cumsum(held)
    return base, base[rows[:, 0]] + rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]


def pack(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_ix, token_start, size, container): container of every part of every text."""
    spark = documents.sparkSession
    sized = stage_table(sizes(documents), "sizes")
    items = parts(sized, capacity)
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if not histogram:
        return items.withColumn("container", F.lit(0).cast("bigint"))
    n_items = sum(histogram.values())
    full = histogram.pop(capacity, 0)
    patterns = patterns_of(histogram, capacity) if histogram else []
    if full:
        patterns.append(({capacity: 1}, full))
    # a pattern has a count of at least one, and their number is bounded by rounds x lengths: it does not grow with the data
    shared = spark.sparkContext.broadcast(slot_index(pattern_slots(patterns), capacity))
    placed = ranked(items, n_items)
    return placed.select("doc_id", "part_ix", "token_start", "size", _slot_udf(shared)("size", "rank").alias("container"))


def summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill, least): containers used, share of room filled, least number possible."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"),
        F.ceil(F.sum("used") / capacity).alias("least"), F.max("used").cast("int").alias("fullest"),
    )


def placed(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, whole, fits) of every text: whether its parts make it up without gap or overlap, and no container of its parts is overfull."""
    used = F.sum("size").over(Window.partitionBy("container"))
    per = packed.withColumn("used", used).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("part_ix", "token_start").alias("parts"), F.min("token_start").alias("first"), F.max(F.col("token_start") + F.col("size")).alias("end"), F.sum("size").alias("tokens"),
        F.max("part_ix").alias("last"), F.max("used").alias("fullest"),
    )
    whole = (F.col("n") == F.col("parts")) & (F.col("last") == F.col("n") - 1) & (F.col("first") == 0) & (F.col("end") == F.col("tokens")) & (F.ceil(F.col("tokens") / capacity) == F.col("n"))
    return per.select("doc_id", whole.alias("whole"), (F.col("fullest") <= capacity).alias("fits"))
