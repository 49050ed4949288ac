"""Filling containers of fixed token capacity with whole texts: cost-balanced packing.

A container is a training sequence of ``capacity`` tokens. An item of n tokens costs ``n + n^2 / span``: linear work plus
attention within the item. Items are assigned in descending order to the sequence of lowest cost that still has room,
over as many sequences as the tokens need. Balance to the last item would leave a hole of the same size, smaller than
any item, in every sequence; so the smallest items, a stated share of the tokens, go where they leave the least room.
A text larger than a container is cut at container boundaries: its full parts fill containers of their own, its rest is
an item like others.

Items are packed in shards of bounded size, chosen by a hash of the row, so the work is spread evenly whatever ids
repeat, and a shard's only loss against packing all at once is part of its last sequences.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtide.session import cut

CAPACITY = 8192
SPAN = 4096
SHARD_ITEMS = 16_384
#: Share of the tokens, in the smallest items, that fills holes instead of balancing costs.
TAIL = 0.3


def tokenizer_file() -> str:
    """The default vocabulary: the public byte-level BPE ranks of the machine's tokenizer folder."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_tokenizer(path: str, pattern: str | None = None):
    """A tiktoken encoding from a file of ranks."""
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have 0 tokens."""
    path = tokenizer or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(path).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def pack(sizes: np.ndarray, capacity: int, span: int = SPAN, tail: float = TAIL) -> np.ndarray:
    """Container number of each item; sizes at most capacity. Ties go by position, so the result is determined."""
    out = np.full(len(sizes), -1, np.int64)
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    room = [capacity] * k
    by_cost = [(0.0, c) for c in range(k)]
    aside: list[tuple[int, float, int]] = []  # without room for the item at hand, most room first
    placed, order = 0, np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order) and placed + int(sizes[order[at]]) <= total * (1 - tail):
        n = int(sizes[order[at]])
        while aside and -aside[0][0] >= n:  # smaller items may fit again
            _, cost, c = heapq.heappop(aside)
            heapq.heappush(by_cost, (cost, c))
        while by_cost and room[by_cost[0][1]] < n:
            cost, c = heapq.heappop(by_cost)
            heapq.heappush(aside, (-room[c], cost, c))
        if not by_cost:
            break
        cost, c = by_cost[0]
        room[c] -= n
        out[order[at]] = c
        heapq.heapreplace(by_cost, (cost + n + n * n / span, c))
        placed += n
        at += 1
    holes = sorted((r, c) for c, r in enumerate(room))
    for i in order[at:]:
        n = int(sizes[i])
        x = bisect.bisect_left(holes, (n, -1))
        if x == len(holes):
            holes.append((capacity, len(room)))
            room.append(capacity)
        r, c = holes.pop(x)
        out[i] = c
        bisect.insort(holes, (r - n, c))
    return out


def pack_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, span: int = SPAN,
                   shard_items: int = SHARD_ITEMS, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece_no, token_from, n_tokens, container_id): every text in pieces, each in one container.

    Texts of at most ``capacity`` tokens are one piece; larger ones are cut at multiples of capacity. Null and empty
    texts are one piece of 0 tokens. A repeated document row is packed as often as it stands; a null id is kept. Other
    columns are ignored; an empty table gives no rows. token_from counts tokens of the text by the given tokenizer.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    counts = token_counts(documents, doc_id, text, tokenizer)
    counts = cut(counts.withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-counts.count() // shard_items))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)))
    pieces = counts.select("doc_id", "row", "n_tokens", F.explode(cuts).alias("piece_no")).withColumn("piece_no", F.col("piece_no").cast("int")).select(
        "doc_id", "row", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("token_from"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no").cast("long") * capacity).alias("n"))
    # a full piece needs no packing: its container is named by its row and number, below the shards' names
    whole = pieces.where(F.col("n") == capacity).select("doc_id", "piece_no", "token_from", "n", F.concat_ws("-", F.lit("w"), "row", "piece_no").alias("container_id"))
    rest = pieces.where(F.col("n") < capacity).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["row"], kind="stable")
        at = pack(b["n"].to_numpy(), capacity, span)
        return pd.DataFrame({"doc_id": b["doc_id"], "piece_no": b["piece_no"], "token_from": b["token_from"], "n": b["n"],
                             "container_id": [f"s{key[0]}-{c}" for c in at]})

    packed = rest.groupBy("shard").applyInPandas(run, "doc_id long, piece_no int, token_from long, n long, container_id string")
    return whole.unionByName(packed).withColumnRenamed("n", "n_tokens")


def containers(packed: DataFrame, span: int = SPAN) -> DataFrame:
    """(container_id, pieces, used, cost) of every container."""
    n = F.col("n_tokens")
    return packed.groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum(n).alias("used"), F.sum(n + n * n / span).alias("cost"))


def checked(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, contiguous, unsplit, fits) of packed texts with unique ids: whether the pieces follow each other from token
    0 without a gap, whether a text that a container can hold is one piece, and whether its containers hold no more than
    the capacity."""
    full = containers(packed).select("container_id", (F.col("used") <= capacity).alias("ok"))
    end = F.col("token_from") + F.col("n_tokens")
    return packed.join(full, "container_id").groupBy("doc_id").agg(
        ((F.min("token_from") == 0) & (F.sum("n_tokens") == F.max(end)) & (F.max("piece_no") + 1 == F.count_distinct("token_from"))).alias("contiguous"),
        ((F.count("*") == 1) | (F.max(end) > capacity)).alias("unsplit"), F.bool_and("ok").alias("fits"))
