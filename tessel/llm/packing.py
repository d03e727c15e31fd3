"""Sum-of-squares packing of documents into contexts of fixed capacity.

The state of a packing is the number of open contexts per residual gap. Each document goes where the sum of the squares of
these numbers becomes smallest: into an open context (its gap's number falls, the next smaller gap's rises) or a new one; this keeps
the gaps spread so that later documents find exact fits. A text longer than the capacity is cut into full contexts
and a rest that is packed like any other item.

Documents are spread over tasks by their hash, so no task grows with the data; the items of contexts that stay open at the
end of a task are packed again, over fewer tasks, until one task holds them or ``ROUNDS`` have passed. Every task's state has at
most ``capacity`` numbers, and what a task hands on is bounded by its open contexts.

Defined cases: null and empty texts (no token) get no context; a text of exactly the capacity fills one; ties go to the
smaller gap, an open context before a new one; equal input gives equal contexts whatever the partitioning, as items are
placed in an order given by a hash of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a task packs, on average.
PER_TASK = 20_000
#: Rounds after which open contexts stay as they are, for sizes that do not fit together.
ROUNDS = 3
SCHEMA = "doc_id bigint, piece_no int, start int, n_tokens int, context_id string, used int, closed boolean"


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The context of each item, in the order given, and each context's used tokens."""
    count = np.zeros(capacity + 1, "i8")  # count[g]: open contexts with gap g; [0] stays 0, full ones are closed
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, used = np.empty(len(sizes), "i8"), []
    far = np.iinfo("i8").min
    for i, size in enumerate(sizes.tolist()):
        # the change of the sum of squares by using gap g is 2 * (count[g - size] - count[g]) + 2, by an exact fit 1 - 2 * count[g]
        gain = count[size:capacity] - count[: capacity - size]
        gain = np.where(count[size:capacity] > 0, 2 * gain - 2, far)
        if len(gain) and count[size] > 0:
            gain[0] = 2 * count[size] - 1
        best = int(gain.argmax()) if len(gain) else -1
        new = -2 * count[capacity - size] - 1 if size < capacity else 0
        if best >= 0 and gain[best] != far and gain[best] >= new:
            gap = best + size
            context = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, context = capacity, len(used)
            used.append(0)
        used[context] += size
        where[i] = context
        if gap > size:
            count[gap - size] += 1
            stacks[gap - size].append(context)
    return where, np.array(used, "i8")


def _packer(capacity: int, name: str, last: bool, closed_from: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The items of one task, which are one partition."""
        rows = pa.Table.from_batches(every).to_pandas() if (every := list(batches)) else None
        if rows is None or not len(rows):
            return
        rows = rows.sort_values(["order", "doc_id", "piece_no"], kind="stable")
        where, used = place(rows["n_tokens"].to_numpy(), capacity)
        out = rows[["doc_id", "piece_no", "start", "n_tokens"]].copy()
        out["context_id"] = [f"{name}-{t}-{w}" for t, w in zip(rows["task"], where, strict=True)]
        out["used"] = used[where].astype("i4")
        out["closed"] = last | (out["used"] >= closed_from * capacity)
        yield from pa.Table.from_pandas(out, preserve_index=False).to_batches()

    return run


def pack(sizes: DataFrame, capacity: int = 512, per_task: int = PER_TASK, closed_from: float = 0.995) -> DataFrame:
    """(context_id, doc_id, piece_no, start, n_tokens, used): each document of (doc_id, n_tokens) with a token, whole if it fits.

    ``used`` is what the context holds in all, at most ``capacity``. The number of tasks comes from the number of items.
    """
    from tessel.session import cut

    items = sizes.where("doc_id is not null and n_tokens > 0").select("doc_id", F.col("n_tokens").cast("int").alias("all"))
    steps = F.sequence(F.lit(0), F.floor((F.col("all") - 1) / capacity).cast("int"))
    items = items.select("doc_id", "all", F.explode(steps).alias("piece_no")).select(
        "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("all") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"),
        F.xxhash64("doc_id", "piece_no").alias("order"),
    )
    items = cut(items)
    full = items.where(F.col("n_tokens") == capacity).select(
        F.concat(F.lit("full-"), "doc_id", F.lit("-"), "piece_no").alias("context_id"),
        "doc_id", "piece_no", "start", "n_tokens", F.col("n_tokens").alias("used"),
    )
    rest = items.where(F.col("n_tokens") < capacity)
    done, step = full, 0
    while True:
        tasks = max(1, -(-rest.count() // per_task))
        last = tasks == 1 or step == ROUNDS
        packed = (
            rest.withColumn("task", F.pmod(F.xxhash64("order", F.lit(step)), F.lit(tasks)).cast("int"))
            .repartitionById(tasks, F.col("task"))  # a task's items are a partition of their own, which is not merged with others
            .mapInArrow(_packer(capacity, f"r{step}", last, closed_from), SCHEMA)
        )
        if last:
            return done.unionByName(packed.select(*full.columns))
        packed = cut(packed)
        done = done.unionByName(packed.where("closed").select(*full.columns))
        rest = packed.where("not closed").select("doc_id", "piece_no", "start", "n_tokens", F.xxhash64("doc_id", "piece_no").alias("order"))
        step += 1


def context_fill(contexts: DataFrame, capacity: int = 512) -> DataFrame:
    """One row: number of contexts, tokens, and the share of unused tokens."""
    return contexts.agg(
        F.countDistinct("context_id").alias("contexts"), F.sum("n_tokens").cast("bigint").alias("tokens"), F.count("*").alias("items"),
    ).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("contexts") * capacity), 6))
