"""What changed between full snapshots: Merkle digests over hash ranges of the keys, row diffs only where they differ.

The rows of all snapshots of a feed are placed once by (feed, leaf), the leaf being a range of the key's hash. Removing
repeated rows, the leaf digests and the row diffs all work on that placement, so only digests are shuffled again. The
tree is compared from the root down: a level's nodes are compared only below nodes that differ, and rows only in
leaves whose digests differ. A feed with a third of all rows is spread over all its leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide.session import cut

LEVELS = 3
LEAF_ROWS = 256
MAX_BITS = 24
SUMS = ("h1", "h2", "h3")


def leaf_bits(df: DataFrame, feed: str, snapshot: str, levels: int = LEVELS, leaf_rows: int = LEAF_ROWS) -> int:
    """Bits of the key hash that name a leaf, so that a leaf of the largest snapshot has about leaf_rows rows."""
    largest = df.groupBy(feed, snapshot).count().agg(F.max("count")).first()[0] or 1
    bits = max(levels, (max(1, largest // leaf_rows) - 1).bit_length())
    return min(MAX_BITS, -(-bits // levels) * levels)


def _digest(count: str) -> list:
    """A node's digest: its rows and three sums of 31-bit row hashes, which fit a long for up to 2^32 rows."""
    return [F.sum(count).alias("n"), *(F.sum(s).alias(s) for s in SUMS)]


def snapshot_changes(
    df: DataFrame, feed: str, snapshot: str, keys: list, values: list[str], levels: int = LEVELS,
    leaf_rows: int = LEAF_ROWS, bits: int | None = None,
) -> DataFrame:
    """(feed, snapshot, <keys>, change_kind): records added, removed or changed since the delivered snapshot before.

    ``keys`` are column names or (name, expression) pairs, ``values`` the compared columns. The first snapshot of a
    feed gives no rows, missing numbers are skipped (a snapshot is compared with the delivered one before it), rows
    repeated in a snapshot or a snapshot delivered twice count once, and a null value differs from any other but not
    from null. Rows of one key with different values within a snapshot: the smallest values stand. Null keys are
    keys like others; rows with a null feed or snapshot number belong to no snapshot and are left out. Empty input
    gives no rows.
    """
    named = [(k, F.col(k)) if isinstance(k, str) else k for k in keys]
    names = [f"k{i}" for i in range(len(named))]
    rows = df.where(F.col(feed).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(feed).alias("feed"), F.col(snapshot).alias("snap"),
        *(e.alias(a) for a, (_, e) in zip(names, named)), F.struct(*values).alias("v"),
    )
    bits = bits or leaf_bits(rows, "feed", "snap", levels, leaf_rows)
    step = bits // levels
    rows = rows.withColumn("leaf", F.shiftrightunsigned(F.xxhash64(*names), 64 - bits).cast("int"))
    placed = (
        rows.repartition("feed", "leaf")
        .groupBy("feed", "leaf", "snap", *names).agg(F.min("v").alias("v"))
    )
    # xxhash64 skips nulls, so a null is hashed as a word of its own.
    told = [F.coalesce(F.col(f"v.{c}").cast("string"), F.lit("\x00null")) for c in values]
    what = [*(F.coalesce(F.col(n).cast("string"), F.lit("\x00null")) for n in names), *told]
    prints = placed.select("feed", "leaf", "snap", F.lit(1).alias("one"),
                           *((F.xxhash64(F.lit(i), *what) % (1 << 31)).alias(h) for i, h in enumerate(SUMS)))
    digests = cut(prints.groupBy("feed", "leaf", "snap").agg(*_digest("one")))

    snaps = digests.select("feed", "snap").distinct()
    pairs = snaps.withColumn("before", F.lag("snap").over(Window.partitionBy("feed").orderBy("snap"))).where("before is not null")
    open_nodes = pairs.select("feed", "snap", "before", F.lit(0).alias("node"))
    for level in range(0, levels + 1):  # root, inner nodes, leaves
        down = bits - level * step
        nodes = digests.groupBy("feed", "snap", F.shiftright("leaf", down).alias("node")).agg(*_digest("n"))
        if level:
            # the children of the nodes that differ, seen from either side
            open_nodes = open_nodes.select("feed", "snap", "before", F.explode(F.sequence(F.shiftleft("node", step), F.shiftleft(F.col("node") + 1, step) - 1)).alias("node"))
        now = nodes.select("feed", "snap", "node", F.struct("n", *SUMS).alias("now"))
        then = nodes.select("feed", F.col("snap").alias("before"), "node", F.struct("n", *SUMS).alias("then"))
        open_nodes = (
            open_nodes.join(now, ["feed", "snap", "node"], "left").join(then, ["feed", "before", "node"], "left")
            .where(~F.col("now").eqNullSafe(F.col("then"))).select("feed", "snap", "before", "node")
        )
    differ = cut(open_nodes.withColumnRenamed("node", "leaf"))
    side = lambda s, flag: placed.join(
        differ.select("feed", "leaf", F.col(s).alias("snap"), F.col("snap").alias("at")), ["feed", "leaf", "snap"]
    ).select("feed", "leaf", "at", *names, *(F.when(F.lit(flag == w), F.col("v")).alias(w) for w in ("now", "then")))
    both = side("snap", "now").unionByName(side("before", "then"))
    compared = both.groupBy("feed", "leaf", "at", *names).agg(F.max("now").alias("now"), F.max("then").alias("then"))
    # a difference between null and null is none; the hash above sees it the same way
    kind = (
        F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    )
    return (
        compared.withColumn("change_kind", kind).where("change_kind is not null")
        .select(F.col("feed").alias(feed), F.col("at").alias(snapshot), *(F.col(a).alias(n) for a, (n, _) in zip(names, named)), "change_kind")
    )
