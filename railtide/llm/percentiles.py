"""Percentiles of very large columns: mergeable rank-interval summaries with a certified error.

A summary of a group is a sorted list of values, each with the smallest and largest rank it can have among the group's n
values. Every partition summarizes its own rows; summaries are merged level by level, those of FAN_IN partitions at a
time: the rank interval of a value adds up from where it stands in the others, and so do the errors. A summary has error
E if neighbours keep hi - lo <= 2 E + 1, from which follows that every rank has a value within E. Keeping the values next
to every (2 e + 1)th rank makes that E + e, with e = floor(share of eps x n), so L levels of a share eps / L stay within
eps n exactly, roundings included, and a list has at most L / (2 eps) + 2 values. One of the levels is set aside for
groups with so many lists that a task has to fold some before it has seen all. All steps are deterministic in the rows of
the partitions, a summary can be stored, and summaries of days or files made apart are put together by the same merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 0.001
FAN_IN = 64
#: Rows a task holds before it summarizes them.
BUFFER_ROWS = 400_000
#: Lists of one group that a task merges at once; of more it folds WIDTH into one, level by level.
WIDTH = 1024
#: Levels of folding that the share set aside is split into: enough for WIDTH ** FOLDS lists.
FOLDS = 8

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]  # values, smallest ranks, largest ranks, n


def exact(values: np.ndarray) -> Summary:
    """The summary that keeps every value of a sorted array."""
    r = np.arange(1, len(values) + 1)
    return values, r, r, len(values)


def merge(parts: list[Summary]) -> Summary:
    """The summary of all rows of several summaries; no error is added beyond theirs."""
    if len(parts) == 1:
        return parts[0]
    n = sum(p[3] for p in parts)
    if all(len(p[0]) == p[3] for p in parts):
        return exact(np.sort(np.concatenate([p[0] for p in parts])))
    sizes = [len(p[0]) for p in parts]
    v, lo, hi = (np.concatenate([p[x] for p in parts]) for x in (0, 1, 2))
    ends = np.cumsum(sizes) - 1
    starts = ends + 1 - sizes
    # where a list's own ranks have got to before its next value
    lo_step = np.diff(lo, prepend=0)
    lo_step[starts] = lo[starts]
    nxt = np.append(hi[1:] - 1, 0)
    nxt[ends] = [p[3] for p in parts]
    hi_step = nxt - hi + 1
    order = np.lexsort((np.repeat(np.arange(len(parts)), sizes), v))  # of equal values those of earlier parts come first
    low = lo_step[order].cumsum()
    high = (hi[starts] - 1).sum() + hi_step[order].cumsum() - nxt[order] + hi[order]
    return v[order], np.maximum.accumulate(low), np.minimum.accumulate(high[::-1])[::-1], n


def pick(s: Summary, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values nearest to the ranks, and how far their rank intervals reach from them."""
    _, lo, hi, _ = s
    # the distance max(r - lo, hi - r) is least where lo + hi is next to 2 r
    middle = lo + hi
    at = np.clip(np.searchsorted(middle, 2 * ranks), 0, len(lo) - 1)
    before = np.maximum(at - 1, 0)
    far = lambda i: np.maximum(np.maximum(ranks - lo[i], hi[i] - ranks), 0)
    best = np.where(far(before) <= far(at), before, at)
    return best, far(best)


def compress(s: Summary, share: float) -> Summary:
    """The values next to every (2 e + 1)th rank and the extremes, e = floor(share n): the error grows by e at most."""
    v, lo, hi, n = s
    step = 2 * math.floor(share * n) + 1
    if step == 1 or len(v) <= 2:
        return s
    keep, _ = pick(s, np.arange(1, n + step, step).clip(max=n))
    keep = np.unique(np.r_[0, keep, len(v) - 1])
    return v[keep], lo[keep], hi[keep], n


def rank_error(s: Summary) -> int:
    """The largest distance of any rank to the nearest kept value's rank interval."""
    _, lo, hi, n = s
    if len(lo) == n:
        return 0
    inside = (hi[1:] - lo[:-1]) // 2
    return int(max([0, *inside, hi[0] - 1, n - lo[-1], *((hi - lo + 1) // 2)]))


def level_share(eps: float, levels: int) -> float:
    """Share of the rows that each of ``levels`` compressions, and the folds together, may add to the error."""
    return eps / (levels + 1)


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    kinds = {f.name: f.dataType for f in df.schema}
    return T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("part", T.LongType()), T.StructField("n", T.LongType()),
                         T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("lo", T.ArrayType(T.LongType())), T.StructField("hi", T.ArrayType(T.LongType()))])


def _row(s: Summary) -> tuple:
    v, lo, hi, n = s
    return (n, v, None, None) if len(v) == n else (n, v, lo, hi)  # ranks of complete lists go without saying


def _summary(n: int, v, lo, hi) -> Summary:
    v = np.asarray(v, float)
    return exact(v) if lo is None else (v, np.asarray(lo, np.int64), np.asarray(hi, np.int64), int(n))


def _depth(df: DataFrame) -> tuple[int, int]:
    """Partitions of the input, and levels of merging that they need."""
    parts, levels = max(1, df.rdd.getNumPartitions()), 1
    while FAN_IN**levels < parts:
        levels += 1
    return parts, levels


def summaries(df: DataFrame, keys: list[str], value: str, eps: float = EPS, levels: int | None = None) -> DataFrame:
    """One summary per group: (keys, part, n, v, lo, hi), to be stored or merged; lo and hi are null for complete lists.

    Null and NaN values are left out, and a group without any other value has no row. Null keys are keys like others.
    Repeated rows count as often as they stand. Infinite values are ordinary values. Columns of df named like the
    summary's own (part, n, v, lo, hi) can be neither keys nor lost: only keys and value are read. ``levels``
    is the number of compressions to plan for where more merges are to come later (default: those of this call).
    """
    if set(keys) & {"part", "n", "v", "lo", "hi"}:
        raise ValueError("keys can't be named part, n, v, lo or hi: rename them first")
    x = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    _, depth = _depth(x)
    share = level_share(eps, levels or depth + 1)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= BUFFER_ROWS:
                yield from _flush(held, keys, share, part)
                held, rows = [], 0
        yield from _flush(held, keys, share, part)

    first = x.mapInPandas(local, _schema(x, keys))
    return merge_levels(first, keys, share, depth)


def _flush(held: list[pd.DataFrame], keys: list[str], share: float, part: int) -> Iterator[pd.DataFrame]:
    if not sum(map(len, held)):
        return
    b = pd.concat(held, ignore_index=True)
    code = b.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(b), np.int64)
    v = b["v"].to_numpy(float)
    order = np.lexsort((v, code))
    code, v = code[order], v[order]
    edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
    lead = b.iloc[order[edge[:-1]]][keys].reset_index(drop=True)
    rows = [_row(compress(exact(v[i:j]), share)) for i, j in zip(edge[:-1], edge[1:])]
    for name, values in zip(("n", "v", "lo", "hi"), zip(*rows)):
        lead[name] = pd.Series(list(values), dtype="int64" if name == "n" else object)
    lead.insert(len(keys), "part", part)
    yield lead


def merge_levels(parts: DataFrame, keys: list[str], share: float, depth: int) -> DataFrame:
    """Merge the summaries of each group, those of FAN_IN parts at a time, until one is left."""
    for level in range(depth - 1, -1, -1):
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN) if level else F.lit(0).cast("long"))
        placed = parts.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "n", "v")
        parts = placed.mapInPandas(_merger(keys, share), _schema(parts, keys))
    return parts


class Fold:
    """The lists of one group: every WIDTH of a level become one of the next, at a small part of the share set aside."""

    def __init__(self, share: float) -> None:
        self.share = share
        self.levels: list[list[Summary]] = [[]]

    def add(self, s: Summary, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(s)
        if len(self.levels[level]) == WIDTH:
            full, self.levels[level] = self.levels[level], []
            self.add(compress(merge(full), self.share / FOLDS), level + 1)

    def close(self) -> Summary:
        return compress(merge([s for level in self.levels for s in level]), self.share)


def _merger(keys: list[str], share: float):
    by = [*keys, "part"]
    names = [*by, "n", "v", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: list[pd.DataFrame] = []  # rows of the group that the last batch ended with
        fold = Fold(share)  # and what was folded of it before
        for b in batches:
            b = pd.concat([*tail, b[names]], ignore_index=True) if tail else b[names]
            code = _runs(b, by)
            last = int(np.searchsorted(code, code[-1])) if len(b) else 0
            if last:
                yield from _close(b.iloc[:last], code[:last], by, names, fold)
                fold = Fold(share)
            rest = b.iloc[last:]
            if len(rest) > WIDTH:  # one of the rows stays to hold the key
                for row in rest.iloc[1:][["n", "v", "lo", "hi"]].itertuples(index=False, name=None):
                    fold.add(_summary(*row))
                rest = rest.iloc[:1]
            tail = [rest] if len(rest) else []
        if tail:
            yield from _close(tail[0], np.zeros(len(tail[0]), np.int64), by, names, fold)

    return run


def _runs(b: pd.DataFrame, by: list[str]) -> np.ndarray:
    """A number per run of equal keys of sorted rows; nulls are equal to each other."""
    if not len(b):
        return np.empty(0, np.int64)
    change = np.zeros(len(b), bool)
    for k in by:
        c, was = b[k], b[k].shift()
        change |= ~((c == was) | (c.isna() & was.isna())).fillna(False).to_numpy(bool)
    change[0] = False
    return change.cumsum()


def _close(b: pd.DataFrame, code: np.ndarray, by: list[str], names: list[str], first: Fold) -> Iterator[pd.DataFrame]:
    """One row per group; ``first`` has the lists of the first group that were folded before."""
    code = code - code[0]
    n = b["n"].to_numpy(np.int64)
    edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
    total = np.add.reduceat(n, edge[:-1])
    plain = (total * first.share < 1) & ~np.logical_or.reduceat(b["lo"].notna().to_numpy(), edge[:-1])
    plain[0] &= len(first.levels) == 1 and not first.levels[0]
    # groups that stay complete are merged all at once: their values sorted side by side
    if plain.any():
        rows = plain[code]
        flat = np.concatenate([np.asarray(v, float) for v in b["v"].to_numpy()[rows]])
        owner = np.repeat(code[rows], n[rows])
        flat = flat[np.lexsort((flat, owner))]
        out = b.iloc[edge[:-1][plain]][by].reset_index(drop=True)
        out["n"] = total[plain]
        out["v"] = pd.Series(np.split(flat, total[plain].cumsum()[:-1]), dtype=object)
        out["lo"] = out["hi"] = None
        yield out[names]
    rest = np.flatnonzero(~plain)
    for k in range(0, len(rest), 500):
        done = []
        for g in rest[k : k + 500]:
            rows = b.iloc[edge[g] : edge[g + 1]]
            fold = first if g == 0 else Fold(first.share)
            for row in rows[["n", "v", "lo", "hi"]].itertuples(index=False, name=None):
                fold.add(_summary(*row))
            done.append((*rows.iloc[0][by], *_row(fold.close())))
        yield pd.DataFrame(done, columns=names)


def merge_summaries(stored: list[DataFrame], keys: list[str], eps: float = EPS, levels: int = 2) -> DataFrame:
    """One summary per group from summaries made apart (days, files), each made with the same ``levels`` and eps."""
    parts = None
    for k, s in enumerate(stored):
        s = s.withColumn("part", F.lit(k).cast("long"))
        parts = s if parts is None else parts.unionByName(s)
    depth = 1
    while FAN_IN**depth < len(stored):
        depth += 1
    return merge_levels(parts, keys, level_share(eps, levels), depth)


def percentiles(summary: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """(keys, n, rank_error, one value per name): values of nearest rank ceil(q n), each off by at most rank_error ranks.

    rank_error is certified from the summary itself: 0 where the summary is complete, and at most eps n.
    """
    kinds = {f.name: f.dataType for f in summary.schema}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("n", T.LongType()), T.StructField("rank_error", T.LongType()),
                           *(T.StructField(x, T.DoubleType()) for x in qs)])

    share = np.array(list(qs.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(np.int64)
            ranks = np.maximum(1, np.ceil(share[None, :] * n[:, None] - 1e-9)).astype(np.int64)
            value, error = np.zeros(ranks.shape), np.zeros(len(b), np.int64)
            plain = b["lo"].isna().to_numpy()
            if plain.any():  # complete lists: the value of a rank stands at its place
                flat = np.concatenate([np.asarray(v, float) for v in b["v"].to_numpy()[plain]])
                value[plain] = flat[(np.r_[0, n[plain].cumsum()[:-1]])[:, None] + ranks[plain] - 1]
            for i in np.flatnonzero(~plain):
                s = _summary(n[i], b["v"].iat[i], b["lo"].iat[i], b["hi"].iat[i])
                at, far = pick(s, ranks[i])
                value[i], error[i] = s[0][at], far.max()
            out = b[keys].reset_index(drop=True)
            out["n"], out["rank_error"] = n, error
            for k, name in enumerate(qs):
                out[name] = value[:, k]
            yield out

    return summary.mapInPandas(run, schema)


def grouped_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], eps: float = EPS) -> DataFrame:
    """percentiles of summaries in one call."""
    return percentiles(summaries(df, keys, value, eps), keys, qs)
