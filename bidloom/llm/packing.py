"""Problem 7: filling containers of fixed capacity with texts, never splitting one that fits.

Sizes are tokens of a public tokenizer. A text above the capacity is cut into full pieces and a rest. The rests are packed by
patterns: few lengths that together (nearly) fill a container are enumerated, non-negative least squares fits how often each
pattern is repeated to the histogram of lengths, the counts are rounded and kept within what is left, and the residual
histogram is packed best-fit first. The plan works on the histogram alone, so it is as large for a thousand texts as for a
trillion. Texts are then numbered within their length and the plan says in which container each number goes.

Hot lengths: numbering runs within (length, salt), with offsets from the counts per (length, salt), so copies of one text may be
any share of all. Defined cases: null and empty texts have no tokens and are in no container; equal texts are packed each;
a text of exactly the capacity fills a container alone; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPACITY = 2048
SALTS = 64
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Long texts are encoded in stretches of about this many characters, so that they need little memory. They are cut where the tokenizer
#: itself always cuts, before a single blank between two letters, however far that is; so the counts are those of the whole text.
STRETCH = 200_000
CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@lru_cache(2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every text with at least one token; ``path``: the tokenizer's file, the same on every executor."""
    path = path or vocabulary_path()
    kind = dict(documents.dtypes)[key]

    def count(t: str | None) -> int:
        if not t:
            return 0
        enc, n, at = encoder(path), 0, 0
        while at < len(t):
            end = at + STRETCH
            if end < len(t):
                m = CUT.search(t, end)
                end = m.start() if m else len(t)
            n += len(enc.encode_ordinary(t[at:end].encode("utf-8", "replace").decode()))
            at = end
        return n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({key: pdf[key], "n_tokens": [count(t) for t in pdf[text]]})
            out = out[out["n_tokens"] > 0]
            if len(out):
                yield out

    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, n_tokens long")


def enumerate_patterns(lengths: np.ndarray, capacity: int, steps: int = 24) -> np.ndarray:
    """Patterns of two to four lengths (rows padded with 0): the last one is always the longest that still fits, and at most 1 % stays unused."""
    have = np.sort(lengths)
    quantiles = have[np.unique(np.linspace(0, len(have) - 1, min(steps, len(have))).astype(int))]
    partial = [np.stack([have, 0 * have, 0 * have], 1)]
    a, b = np.meshgrid(have, quantiles, indexing="ij")
    partial.append(np.stack([a.ravel(), b.ravel(), 0 * a.ravel()], 1))
    q = quantiles[:: max(1, len(quantiles) // 8)]
    a, b, c = np.meshgrid(have, q, q, indexing="ij")
    partial.append(np.stack([a.ravel(), b.ravel(), c.ravel()], 1))
    rows = np.concatenate(partial)
    left = capacity - rows.sum(1)
    at = np.searchsorted(have, left, "right") - 1
    rows, at, left = rows[at >= 0], at[at >= 0], left[at >= 0]
    last = have[at]
    rows = np.sort(np.column_stack([rows, last]), 1)[left - last <= capacity // 100]
    return np.unique(rows, axis=0)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 with the patterns' lengths, repeated, near the histogram (multiplicative updates)."""
    if not len(patterns):
        return np.zeros(0)
    weight = (patterns > 0).astype(float)
    h = histogram.astype(float).copy()
    h[0] = 0
    x = np.full(len(patterns), max(1e-9, h.sum() / weight.sum()))
    target = (h[patterns] * weight).sum(1)
    for _ in range(rounds):
        made = np.bincount(patterns.ravel(), (weight * x[:, None]).ravel(), minlength=len(h))
        x *= target / np.maximum((made[patterns] * weight).sum(1), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a container, repeats)] that hold exactly the histogram's items."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    some = np.flatnonzero(left)
    if len(some) > 1:
        patterns = enumerate_patterns(some, capacity)
        repeats = fit_repeats(patterns, left)
        for i in np.argsort(-repeats, kind="stable"):
            lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            n = min(int(np.ceil(repeats[i] - 1e-6)), int((left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= times * n
                out.append((tuple(int(x) for x in patterns[i] if x), n))
    have = [int(x) for x in np.flatnonzero(left)]
    while have:  # residual histogram: the longest item first, then always the longest that still fits
        room, chosen, used = capacity, [], {}
        at = len(have) - 1
        while at >= 0:
            x = have[at]
            take = min(room // x, int(left[x]))
            if take:
                chosen += [x] * take
                used[x] = take
                room -= take * x
            at = bisect_right(have, min(room, x - 1)) - 1
        n = min(int(left[x]) // k for x, k in used.items())
        out.append((tuple(chosen), n))
        for x, k in used.items():
            left[x] -= k * n
        have = [x for x in have if left[x]]
    return out


class Places:
    """Where the item numbered ``rank`` among those of its length goes, from a plan."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]]):
        self.starts: dict[int, list[int]] = {}
        self.parts: dict[int, list[tuple[int, int]]] = {}
        self.containers = 0
        used: dict[int, int] = {}
        for lengths, n in chosen:
            for x in set(lengths):
                times = lengths.count(x)
                self.starts.setdefault(x, []).append(used.get(x, 0))
                self.parts.setdefault(x, []).append((self.containers, times))
                used[x] = used.get(x, 0) + times * n
            self.containers += n

    def container(self, length: int, rank: int) -> int:
        at = bisect_right(self.starts[length], rank) - 1
        base, times = self.parts[length][at]
        return base + (rank - self.starts[length][at]) // times


def fill(sizes: DataFrame, key: str, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """(container, key, piece_no, n_tokens) for (key, n_tokens). The input should be cut from its lineage: it is read twice.

    What reaches the driver are counts per length and salt: at most ``capacity * salts`` rows."""
    slot = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
    rest = sizes.withColumn("piece_no", (F.floor(F.col("n_tokens") / capacity) + 1).cast("int")).withColumn("n_tokens", F.col("n_tokens") % capacity).filter("n_tokens > 0").withColumn("salt", slot)
    counts = rest.groupBy("n_tokens", "salt").count().collect()
    histogram: dict[int, int] = {}
    offset: dict[tuple[int, int], int] = {}
    for length, salt, n in sorted(map(tuple, counts)):
        offset[length, salt] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    places = Places(plan(histogram, capacity))

    @F.pandas_udf("long")
    def where(length: pd.Series, salt: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([places.container(x, offset[x, s] + r - 1) for x, s, r in zip(length.tolist(), salt.tolist(), at.tolist(), strict=True)], dtype="int64")

    order = Window.partitionBy("n_tokens", "salt").orderBy(key)
    rest = rest.withColumn("at", F.row_number().over(order)).withColumn("container", where("n_tokens", "salt", "at"))
    rest = rest.select("container", key, "piece_no", F.col("n_tokens").cast("int").alias("n_tokens"))
    # full pieces: one container each, numbered after the mixed ones from counts per salt
    full = sizes.filter(F.col("n_tokens") >= capacity).select(key, F.floor(F.col("n_tokens") / capacity).cast("long").alias("n"), slot.alias("salt"))
    before, base = {}, places.containers
    for salt, n in sorted(map(tuple, full.groupBy("salt").agg(F.sum("n")).collect())):
        before[salt] = base
        base += n
    starts = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    running = F.sum("n").over(Window.partitionBy("salt").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    full = full.withColumn("first", starts[F.col("salt").cast("long")] + F.coalesce(running, F.lit(0)))
    full = full.select("first", key, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("piece_no"))
    return rest.unionByName(full.select((F.col("first") + F.col("piece_no") - 1).alias("container"), key, "piece_no", F.lit(capacity).alias("n_tokens")))
