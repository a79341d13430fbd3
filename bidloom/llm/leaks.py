"""Problem 8: passages of held-out test items inside training documents.

Every shard of the corpus (a batch of documents inside a task) becomes an array of word numbers and a suffix array of it, sorted
to the depth that counts as a leak; suffixes that hold a word no test item has can't match and are left out. Every suffix of
every test item is looked up by binary search, which gives all verbatim matches with their places; matches that follow each
other extend to the longest one. Damaged copies are found exactly, too: a copy lacks at most a fifth of the item's words, so of any
of its words it holds all but so many; counted over the words of each item that are rarest in the shard, that leaves few documents
for an item. In these the longest common subsequence of the item and every passage of about its length decides; as it changes by at
most one from a passage to the next, passages that can't reach the limit are stepped over.

Only the test items, a fixed list whose size is checked, go to every executor; nothing of the corpus goes to the driver.
Defined cases: a null, empty or wordless text leaks nothing; items shorter than ``VERBATIM`` words are found by the second
rule only, items without words never; texts of any length are read whole; repeated documents each come out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bidloom.functions.fold import bare
from bidloom.functions.worker import Once

VERBATIM = 12
SHARE = 0.8
#: A passage "of about the item's length" has at most so many words for each word of the item.
STRETCH = 1.35
#: Test items that may be shipped to every executor, and words of a shard.
MOST_ITEMS = 100_000
SHARD_WORDS = 1_000_000
MARKUP = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->|&(?:[a-z]+|#\d+);", re.I | re.S)
INNER = re.compile(r"(?<=\d)[.,](?=\d)")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words without case, accents, punctuation and mark-up; a number with its separators is one word."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(INNER.sub("", bare.__wrapped__(text)))


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Index(Once):
    """The test items and the lookup of their suffixes in a shard."""

    def __init__(self, items: list[tuple[int, str]], verbatim: int = VERBATIM, share: float = SHARE):
        self.args = (items, verbatim, share)
        self.verbatim, self.share = verbatim, share
        self.ids = [i for i, _ in items]
        told = [words_of(t) for _, t in items]
        self.vocab: dict[str, int] = {}
        self.items = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws] for ws in told]
        line, owner, place = [], [], []
        for k, ws in enumerate(self.items):
            line += [*ws, 0]
            owner += [k] * (len(ws) + 1)
            place += range(len(ws) + 1)
        self.owner, self.place = np.array(owner, np.int64), np.array(place, np.int64)
        self.member = [np.unique(ws) for ws in self.items]
        self.least = [int(-(-len(ws) * share // 1)) for ws in self.items]
        self.tables: dict[int, np.ndarray] = {}
        self.deep = self._ranks(np.array(line, np.int64), verbatim, True)

    @staticmethod
    def _steps(depth: int) -> list[int]:
        out = [1]
        while out[-1] < depth:
            out.append(min(out[-1] * 2, depth))
        return out

    def _ranks(self, line: np.ndarray, depth: int, own: bool = False) -> np.ndarray:
        """Rank of the ``depth``-word prefix of every suffix among those of the test items, by prefix doubling; -1 where no item has it."""
        rank = np.where(line > 0, line, -1)
        steps = self._steps(depth)
        for a, b in zip(steps, steps[1:], strict=False):
            shift = b - a
            later = np.full_like(rank, -1)
            later[: len(rank) - shift] = rank[shift:]
            both = np.where((rank >= 0) & (later >= 0), rank * (len(self.owner) + len(self.vocab) + 2) + later, -1)
            if own:
                self.tables[depth * 1000 + b] = np.unique(both[both >= 0])
            table = self.tables[depth * 1000 + b]
            rank = np.full_like(rank, -1)
            some = np.flatnonzero(both >= 0)
            if len(table) and len(some):
                at = np.searchsorted(table, both[some])
                at[at == len(table)] = 0
                hit = table[at] == both[some]
                rank[some[hit]] = at[hit]
        return rank

    def _matches(self, rank: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, place in the items) of all equal prefixes: the shard's suffix array, searched for every test suffix."""
        there = np.flatnonzero(rank >= 0)
        suffixes = there[np.argsort(rank[there], kind="stable")]
        keys = rank[suffixes]
        mine = np.flatnonzero(own >= 0)
        lo, hi = np.searchsorted(keys, own[mine], "left"), np.searchsorted(keys, own[mine], "right")
        n = hi - lo
        some = n > 0
        mine, lo, n = mine[some], lo[some], n[some]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
        return suffixes[at], np.repeat(mine, n)

    def shard(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, float]]:
        """(text number, test id, longest verbatim match in words, share of the item found in order) of the leaks."""
        get = self.vocab.get
        lines, starts, size = [], [], 0
        for t in texts:
            ws = [get(w, 0) for w in words_of(t)]
            starts.append(size)
            lines.append(np.array([*ws, 0], np.int64))
            size += len(ws) + 1
        line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
        first = np.array(starts, np.int64)
        found: dict[tuple[int, int], int] = {}
        at, mine = self._matches(self._ranks(line, self.verbatim), self.deep)
        if len(at):
            doc = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((at, at - mine, self.owner[mine], doc))
            at, mine, doc = at[order], mine[order], doc[order]
            same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + 1) & (mine[1:] == mine[:-1] + 1)])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(~same, np.arange(len(at)), 0))
            for d, k, r in zip(doc, self.owner[mine], run, strict=True):
                found[int(d), int(k)] = max(found.get((int(d), int(k)), 0), self.verbatim + int(r))
        for (d, k), n in found.items():
            yield d, self.ids[k], n, min(1.0, n / len(self.items[k]))
        for d, k in self._likely(line, first):
            if (d, k) in found:
                continue
            hi = int(first[d + 1]) - 1 if d + 1 < len(first) else len(line) - 1
            best = self._in_order(k, line[int(first[d]) : hi])
            if best >= self.least[k]:
                yield d, self.ids[k], 0, best / len(self.items[k])

    def _likely(self, line: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(text number, item number) of all pairs that may hold a damaged copy, by the words of each item that are rarest in the shard."""
        often = np.bincount(line, minlength=len(self.vocab) + 1)
        word, item, times, need = [], [], [], np.zeros(len(self.items), np.int64)
        for k, ws in enumerate(self.items):
            if not ws:
                continue
            miss = len(ws) - self.least[k]
            rare = sorted(ws, key=lambda w: (often[w], w))[: miss + max(1, len(ws) // 3)]
            need[k] = len(rare) - miss
            for w, n in Counter(rare).items():
                word.append(w)
                item.append(k)
                times.append(n)
        if not word:
            return []
        word, item, times = np.array(word), np.array(item), np.array(times)
        order = np.argsort(word, kind="stable")
        word, item, times = word[order], item[order], times[order]
        wanted = np.zeros(len(self.vocab) + 1, bool)
        wanted[word] = True
        at = np.flatnonzero(wanted[line])
        doc = np.searchsorted(first, at, "right") - 1
        pair = np.unique(doc * (len(self.vocab) + 1) + line[at])
        doc, held = pair // (len(self.vocab) + 1), pair % (len(self.vocab) + 1)
        lo, hi = np.searchsorted(word, held, "left"), np.searchsorted(word, held, "right")
        n = hi - lo
        post = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
        both, where = np.unique(np.repeat(doc, n) * len(self.items) + item[post], return_inverse=True)
        got = np.bincount(where, times[post], minlength=len(both))
        return [divmod(int(x), len(self.items)) for x in both[got >= need[both % len(self.items)]]]

    def _in_order(self, k: int, text: np.ndarray) -> int:
        """Most words of the item found in order in a passage of about its length; exact if it reaches the limit, else at most the true number."""
        item, least = self.items[k], self.least[k]
        width = int(len(item) * STRETCH)
        mine = np.isin(text, self.member[k])
        upto = np.concatenate([[0], np.cumsum(mine)])
        starts = np.flatnonzero(mine)
        starts = starts[upto[np.minimum(starts + width, len(text))] - upto[starts] >= least]
        best, free = 0, 0
        for a in starts.tolist():
            if a < free:
                continue
            n = common(item, text[a : a + width].tolist())
            best = max(best, n)
            free = a + max(1, least - n)
        return best


def index(items: DataFrame, item_id: str, text: str) -> Index:
    rows = items.select(item_id, text).filter(f"{text} is not null").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} test items can't be shipped to every executor")
    return Index([(r[0], r[1]) for r in rows])


def leaks(documents: DataFrame, key: str, text: str, tests: Index) -> DataFrame:
    """(key, test_id, longest, share): each document with each test item it holds; longest 0 means found as a damaged copy only."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf[text].str.len().fillna(0).cumsum() // (5 * SHARD_WORDS)
            for _, part in pdf.groupby(size.to_numpy()):
                keys = part[key].tolist()
                out = [(keys[d], t, n, s) for d, t, n, s in tests.shard(part[text].tolist())]
                if out:
                    yield pd.DataFrame(out, columns=[key, "test_id", "longest", "share"])

    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, test_id long, longest int, share double")


def without_leaks(documents: DataFrame, key: str, text: str, tests: Index) -> DataFrame:
    """The documents that hold no test item."""
    return documents.join(leaks(documents, key, text, tests).select(key).distinct(), key, "left_anti")
