"""Filling containers of fixed capacity with documents.

Method: Karmarkar-Karp multiway differencing. Partial partitions are merged
with opposing imbalances into near-equal windows; exchanges of single items
level what is left, and the number of windows rises while one of them exceeds
the capacity.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tokens import token_counts
from leadloom.session import cut

#: windows that a block of items should fill, and bounds on its items: a block is one group's memory
BLOCK_WINDOWS, LEAST_ITEMS, MOST_ITEMS = 160, 4_096, 16_384
OUT = "spec_id int, doc_id bigint, piece int, container_id string, place int, token_offset int, token_start bigint, n_tokens int"


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Items (by index, sizes positive) in k windows of near-equal sums.

    A partition keeps its window sums in falling order less their minimum, with
    empty windows left out. The two partitions of largest spread merge, the
    largest window of one with the smallest of the other. Until k windows are
    begun that lays the largest items side by side, which is where it starts.
    """
    n = len(sizes)
    if n <= k:
        return [[i] for i in range(n)]
    left, right = list(range(n)), [-1] * n  # nodes: an item (itself), or a union of two nodes
    order = np.argsort(-sizes, kind="stable")
    sums = (sizes[order[:k]] - sizes[order[k - 1]]).astype(np.int64)
    heap = [(-int(sums[0]), n, sums, order[:k])]
    heap += [(-int(sizes[i]), int(i), sizes[i : i + 1].astype(np.int64), np.array([i], dtype=np.int64)) for i in order[k:]]
    heapq.heapify(heap)
    turn = n + 1
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both <= 0 and b[0] <= a[-1]:  # already in order
            sums, nodes = np.concatenate([a, b]), np.concatenate([na, nb])
            heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), turn, sums - (sums[-1] if len(sums) == k else 0), nodes))
            turn += 1
            continue
        if both == 1 and len(b) == 1:  # one window of a changes: it moves to its new place
            left.append(int(na[-1]))
            right.append(int(nb[0]))
            value, rest = a[-1] + b[0], a[:-1]
            at = len(rest) - int(rest[::-1].searchsorted(value))
            sums, nodes = np.concatenate([rest[:at], [value], rest[at:]]), np.concatenate([na[:at], [len(left) - 1], na[at:-1]])
            heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums - sums[-1], nodes))
            turn += 1
            continue
        if both <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([na, nb])
        else:
            # the smallest windows of a (its last) meet the smallest of b in reverse, so that large meets small
            b, nb = b[::-1], nb[::-1]
            cut_at = len(a) - both
            first = len(left)
            left.extend(na[cut_at:].tolist())
            right.extend(nb[:both].tolist())
            sums = np.concatenate([a[:cut_at], a[cut_at:] + b[:both], b[both:]])
            nodes = np.concatenate([na[:cut_at], np.arange(first, first + both), nb[both:]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        if len(sums) == k and sums[-1] > 0:
            sums = sums - sums[-1]
            # windows of sum 0 keep their nodes: they are the smallest, not empty
        heapq.heappush(heap, (-spread, turn, sums, nodes))
        turn += 1
    out: list[list[int]] = []
    for node in heap[0][3].tolist() if heap else []:
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x], right[x])
        out.append(items)
    return out


def exchange(sizes: np.ndarray, found: list[list[int]], capacity: int) -> bool:
    """Levels what differencing left: items of windows over the capacity change
    places with smaller items of windows that have room for the difference.
    Changes ``found``; whether no window is over the capacity any more.
    """
    where, at = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for w, items in enumerate(found):
        where[items], at[items] = w, np.arange(len(items))
    sums = np.array([int(sizes[items].sum()) for items in found])
    for w in np.argsort(-sums, kind="stable").tolist():
        while sums[w] > capacity:
            over = int(sums[w]) - capacity
            best = None
            for a in found[w]:
                less = int(sizes[a]) - sizes  # what w loses and the other window gains
                room = capacity - sums[where]
                can = np.flatnonzero((less > 0) & (less <= room))
                if not len(can):
                    continue
                # as much of the excess as possible, and of equals the tightest room
                b = int(can[np.lexsort((room[can] - less[can], -np.minimum(less[can], over)))[0]])
                score = (min(int(less[b]), over), -int(room[b] - less[b]))
                if best is None or score > best[0]:
                    best = (score, a, b)
            if best is None:
                return False
            _, a, b = best
            v, i, j = int(where[b]), int(at[a]), int(at[b])
            found[w][i], found[v][j] = b, a
            where[a], where[b], at[a], at[b] = v, w, j, i
            sums[w] += sizes[b] - sizes[a]
            sums[v] += sizes[a] - sizes[b]
    return True


def least_windows(sizes: np.ndarray, capacity: int) -> int:
    """A number of windows that no packing can do without: by the sum of sizes; of
    items over a (p + 1)-th of the capacity a window holds p; items over half
    the capacity are apart, and those of size t or more can't join the ones over capacity - t."""
    down = np.sort(sizes)[::-1]
    total = np.concatenate([[0], np.cumsum(down)])
    least = -(-int(total[-1]) // capacity)
    if not len(down):
        return 0
    for p in range(1, capacity // int(down[-1]) + 1):
        over = int(np.searchsorted(-down, -capacity / (p + 1), side="left"))
        least = max(least, -(-over // p))
    big = int(np.searchsorted(-down, -capacity / 2, side="left"))  # down[:big] are over half
    for t in np.unique(down[down * 2 <= capacity]).tolist():
        alone = int(np.searchsorted(-down, -(capacity - t), side="left"))  # over capacity - t
        upto = int(np.searchsorted(-down, -t, side="right"))  # of size t or more
        rest = int(total[upto] - total[big]) - ((big - alone) * capacity - int(total[big] - total[alone]))
        least = max(least, big + max(0, -(-rest // capacity)))
    return least


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items (by index, sizes from 1 to capacity) in few windows.

    Differencing starts with as many windows as are needed at least; their
    number rises while exchanges can't bring all under the capacity. What the
    fullest window has above the mean says how many would do; from there
    growing steps, then halved ones, find a count that works while one less fails.
    """
    if not len(sizes):
        return []
    least, total = least_windows(sizes, capacity), int(sizes.sum())
    good: dict[int, list[list[int]]] = {}

    def fails(k: int) -> bool:
        found = difference(sizes, k)
        if exchange(sizes, found, capacity):
            good[k] = found
        return k not in good

    first = difference(sizes, least)
    above = max(int(sizes[w].sum()) for w in first) - total / least
    if exchange(sizes, first, capacity):
        return first
    low, high, step = least, least + 1, 1  # low fails
    if above < capacity:
        high = max(high, -(-total // max(1, int(capacity - above))))
    while fails(high):
        low, high, step = high, high + step, 2 * step
    step = 1
    while high - step > low and not fails(high - step):
        high, step = high - step, 2 * step
    low = max(low, high - step)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fails(middle) else (low, middle)
    return good[high]


def pack(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """The container of every document for every specification: spec_id,
    doc_id, piece, container_id, place (in the container, from 0), token_offset
    (in the container), token_start (of the piece in the document), n_tokens.

    A document is split only if it exceeds the capacity: its full pieces fill
    containers of their own, the rest is packed like any document. Documents
    without tokens take a place of size 0. Documents fall into blocks by hash
    of doc_id; blocks are equal in size, whatever the documents hold, and are
    packed independently. Specifications with capacity below 1 or null give no rows.
    """
    wanted = [r for r in specs.select("spec_id", "capacity_tokens", "tokenizer").collect() if (r[1] or 0) > 0]  # a specification per row: fixed, a handful
    spark = documents.sparkSession
    out = spark.createDataFrame([], OUT)
    for name in sorted({r["tokenizer"] for r in wanted}):
        sizes = cut(token_counts(documents, name))
        out = out.unionByName(_packed(sizes, [(r["spec_id"], r["capacity_tokens"]) for r in wanted if r["tokenizer"] == name]))
    return out


def _packed(sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    total = sizes.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).first()
    n, tokens = total["n"], max(total["tokens"] or 0, 1)

    def blocks(capacity: int) -> int:
        items = min(MOST_ITEMS, max(LEAST_ITEMS, int(BLOCK_WINDOWS * capacity * n / tokens)))
        return max(1, round(n / items))

    plan = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity"), F.lit(blocks(c)).alias("blocks")) for s, c in specs])
    each = sizes.select("doc_id", "n_tokens", F.inline(plan)).select(
        "spec_id", "capacity", "doc_id", "n_tokens",
        F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"),
        F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("int").alias("full"),
    )
    whole = each.filter("full > 0").select("spec_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    filled = whole.select(
        "spec_id", "doc_id", "piece", F.format_string("%d-d%d-%d", "spec_id", "doc_id", "piece").alias("container_id"), F.lit(0).alias("place"), F.lit(0).alias("token_offset"),
        (F.col("piece").cast("bigint") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"),
    )
    rest = each.withColumn("size", (F.col("n_tokens") - F.col("full") * F.col("capacity")).cast("int")).filter("size > 0 or full = 0")
    return filled.unionByName(rest.groupBy("spec_id", "block").applyInPandas(_pack_block, OUT))


def _pack_block(items: pd.DataFrame) -> pd.DataFrame:
    """Packs one block: at most a few times MOST_ITEMS rows, by the hash."""
    items = items.sort_values("doc_id", kind="stable").reset_index(drop=True)
    spec, block, capacity = int(items["spec_id"][0]), int(items["block"][0]), int(items["capacity"][0])
    sizes = items["size"].to_numpy(dtype=np.int64)
    some = np.flatnonzero(sizes > 0)
    groups = [[int(some[i]) for i in w] for w in windows(sizes[some], capacity)] or [[]]
    groups[0] += np.flatnonzero(sizes == 0).tolist()
    container, place, offset = np.zeros(len(sizes), int), np.zeros(len(sizes), int), np.zeros(len(sizes), int)
    for c, group in enumerate(groups):
        group = np.array(sorted(group), dtype=int)
        container[group], place[group] = c, np.arange(len(group))
        offset[group] = np.concatenate([[0], np.cumsum(sizes[group])[:-1]]) if len(group) else []
    return pd.DataFrame(
        {
            "spec_id": spec, "doc_id": items["doc_id"], "piece": items["full"], "container_id": [f"{spec}-b{block}-{c}" for c in container],
            "place": place, "token_offset": offset, "token_start": items["full"].astype("int64") * capacity, "n_tokens": sizes,
        }
    )
