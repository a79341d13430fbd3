"""Problem 9: abusive, hateful or sexual content, scored per document with evidence.

A document is read passage by passage (sentences; long ones in overlapping windows). Disguises are undone first: letters split
by signs, digits and signs for letters, stretched letters, missing accents. Each passage is compared with labelled examples by
exact TF-IDF cosine over words and word pairs in a block-max inverted index: examples lie in blocks of like ones, the largest
weight of each term in a block bounds the cosine of the whole block, blocks go by falling bound, and the search ends at the
first block that can't beat the ``NEAREST``-th best so far. Their distance-weighted votes give the passage's vote, the document's
is its largest one, and isotonic regression on the reviewed documents (each without its own examples) turns it into a calibrated
score, by which a document counts as found.

Labelled examples are general seeds (``seeds``, made by rule) and the passages of reviewed documents. Those of documents marked
fine show acceptable talk. Which passages of a rejected document are the abusive ones follows from the other reviews (``judged``): the
rejected and the fine documents that hold the passage or one like it, or that no other document does; wrong verdicts are reckoned with.
At most ``MOST_MARKED`` reviewed documents are taken (by hash of their id), and as many of them as hold ``MOST_CHARACTERS``
together. Document frequencies are counted over all passages of all documents.

Defined cases: null, empty and wordless texts score 0; documents with contradicting reviews count by majority, a tie not
at all; texts of any length are read whole; repeated documents get equal scores; with fewer than ``LEAST_MARKED`` reviewed documents
votes aren't calibrated, without any only the seeds vote; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions.fold import bare
from bidloom.functions.worker import Once, bounded
from bidloom.llm import seeds as general

MOST_MARKED = 3000
MOST_CHARACTERS = 20_000_000
LEAST_MARKED = 50
NEAREST = 8
FLOOR = 0.25
BLOCK = 64
FOUND = 0.5
WINDOW, STEP = 18, 9
#: Passages of at least this similarity say the same.
ALIKE = 0.6
#: Share of right verdicts, and of abusive ones among all wordings, before anything is known.
TRUST, FEW = 0.9, 0.1
#: Share of all passages up to which a wording is as likely abuse as any; more common ones are less likely in proportion, down to a twentieth.
RARE = 2e-4
#: What acceptable talk votes against every passage, in units of the votes; weights of grammar words.
CALM, GRAMMAR_WEIGHT = 0.35, 0.2

MARKUP = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->|&(?:[a-z]+|#\d+);", re.I | re.S)
BREAK = re.compile(r"\n|(?<=[.!?;])\s")
NUMBER = re.compile(r"(?<![\w@$])\d+(?:[.,/:]\d+)*(?![\w@$])")
SPLIT_LETTERS = re.compile(r"(?<![a-z0-9])(?:[a-z][*.\-_])+[a-z](?![a-z0-9])")
LONG = re.compile(r"([a-z])\1\1+")
TOKEN = re.compile(r"[a-z0-9@$]+")
OTHER = re.compile(r"[^\x00-\x7f]+")
WORD = re.compile(r"[a-z]+|\d")
LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})


def undisguised(text: str) -> str:
    """A sentence with split letters joined, stretched letters shortened and accents dropped."""
    text = LONG.sub(r"\1", SPLIT_LETTERS.sub(lambda m: re.sub(r"[*.\-_]", "", m[0]), bare.__wrapped__(text)))
    return text if text.isascii() else OTHER.sub(" ", text)


def words(sentence: str) -> list[str]:
    """Words as they are meant: signs and digits among letters read as letters, numbers as 0, and runs of numbers as one."""
    out: list[str] = []
    for w in TOKEN.findall(sentence):
        if w.isalpha():
            out.append(w)
        elif not w.isdigit() and sum(c.isalpha() for c in w) * 2 >= len(w):
            out.append(w.translate(LEET))
        else:
            for part in WORD.findall(w):
                if not part.isdigit():
                    out.append(part)
                elif not out or out[-1] != "0":
                    out.append("0")
    return out


def _sentence(text: str) -> tuple[tuple[str, ...], ...]:
    ws = words(undisguised(text))
    if all(w == "0" for w in ws):
        return ()
    if len(ws) <= WINDOW + STEP:
        return (tuple(ws),)
    return tuple(tuple(ws[a : a + WINDOW]) for a in range(0, len(ws) - STEP, STEP))


#: Passages of a sentence; sentences that differ in numbers only are read once.
sentence = bounded(_sentence, 50_000)


def passages(text: str | None) -> Iterator[tuple[str, ...]]:
    """Words of each passage: sentences of any length, long ones in overlapping windows; numbers alone are no passage."""
    if not text:
        return
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    for s in BREAK.split(NUMBER.sub("0", text)):
        if s:
            yield from sentence(s)


def terms(ws: tuple[str, ...]) -> Counter:
    return Counter([*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))])


Example = tuple[tuple[str, ...], float, int | None]


class Index(Once):
    """Labelled examples under TF-IDF with block-max postings. ``examples``: (words, share of abuse 0..1, the document it comes from or None)."""

    def __init__(self, examples: list[Example], df: dict[str, int], n: int):
        self.args = (examples, df, n)
        # Abusive ones first, then by their words, so that like examples share blocks and the bounds are near.
        self.examples = sorted(examples, key=lambda e: (e[1] <= 0.5, e[0], -1 if e[2] is None else e[2]))
        self.label = [e[1] for e in self.examples]
        self.doc = [e[2] for e in self.examples]
        self.unseen = log(1 + max(n, 1))
        self.idf = {t: log((1 + max(n, 1)) / (1 + c)) for t, c in df.items()}
        count = -(-len(self.examples) // BLOCK)
        #: Blocks that hold an abusive example.
        self.abusive_blocks = -(-sum(y > 0.5 for y in self.label) // BLOCK)
        self.blocks: list[dict[str, list[tuple[int, float]]]] = [defaultdict(list) for _ in range(count)]
        for i, e in enumerate(self.examples):
            for t, w in self.vector(e[0]).items():
                self.blocks[i // BLOCK][t].append((i, w))
        most: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, block in enumerate(self.blocks):
            for t, ps in block.items():
                most[t].append((k, max(w for _, w in ps)))
        #: term → (blocks, its largest weight in each), and its largest weight in any abusive block
        self.most = {t: (np.array([k for k, _ in ps]), np.array([w for _, w in ps])) for t, ps in most.items()}
        self.most_abusive = {t: max(ws) for t, ps in most.items() if (ws := [w for k, w in ps if k < self.abusive_blocks])}
        self.vote = lru_cache(60_000)(self._vote)

    def vector(self, ws: tuple[str, ...]) -> dict[str, float]:
        raw = {}
        for t, c in terms(ws).items():
            w = self.idf.get(t, self.unseen)
            a, _, b = t.partition(" ")
            if a in general.GRAMMAR and (not b or b in general.GRAMMAR):
                w *= GRAMMAR_WEIGHT
            if w > 0:
                raw[t] = w if c == 1 else (1 + log(c)) * w
        norm = sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / norm for t, v in raw.items()}

    def nearest(self, ws: tuple[str, ...], without: int | None = None, k: int = NEAREST, q: dict[str, float] | None = None, floor: float = FLOOR) -> list[tuple[float, int]]:
        """The ``k`` examples of largest cosine, at least ``floor``, exactly; ties by place."""
        q = self.vector(ws) if q is None else q
        bound = np.zeros(len(self.blocks))
        for t, w in q.items():
            if t in self.most:
                ids, ms = self.most[t]
                bound[ids] += w * ms
        best: list[tuple[float, int]] = []
        least = floor
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] < least - 1e-12:
                break
            got = self._scored(int(b), q, without)
            best += [x for x in got if x[0] >= least]
            if len(best) >= k:
                best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
                least = best[-1][0]
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def _scored(self, b: int, q: dict[str, float], without: int | None) -> list[tuple[float, int]]:
        block, sums = self.blocks[b], {}
        for t, w in q.items():
            for i, x in block.get(t, ()):
                sums[i] = sums.get(i, 0.0) + w * x
        return [(s, i) for i, s in sums.items() if s >= FLOOR and (without is None or self.doc[i] != without)]

    def _vote(self, ws: tuple[str, ...], without: int | None = None) -> tuple[float, int]:
        """(vote of the nearest examples, the nearest abusive example or -1).

        Examples that aren't abusive vote 0, so without an abusive one of at least ``FLOOR`` the vote is 0 whatever the nearest are;
        that is told from the blocks of abusive examples alone, and most passages end there."""
        q = self.vector(ws)
        if sum(w * self.most_abusive[t] for t, w in q.items() if t in self.most_abusive) < FLOOR:
            return 0.0, -1
        bound = np.zeros(len(self.blocks))
        for t, w in q.items():
            if t in self.most:
                bound[self.most[t][0]] += w * self.most[t][1]
        if not any(self.label[i] > 0.5 for b in np.flatnonzero(bound[: self.abusive_blocks] >= FLOOR) for _, i in self._scored(int(b), q, without)):
            return 0.0, -1
        near = self.nearest(ws, without, q=q)
        weigh = [(s * s / (1.05 - s), self.label[i]) for s, i in near]
        abusive = [i for _, i in near if self.label[i] > 0.5]
        return sum(w * y for w, y in weigh) / (CALM + sum(w for w, _ in weigh)), abusive[0] if abusive else -1

    def score(self, text: str | None, without: int | None = None) -> tuple[float, str | None, int]:
        """(largest vote, the passage, the example nearest to it)."""
        best: tuple[float, str | None, int] = (0.0, None, -1)
        for ws in passages(text):
            v, i = self.vote(ws, without) if without is None else self._vote(ws, without)
            if v > best[0]:
                best = v, " ".join(ws), i
        return best


def seeds() -> list[Example]:
    return [(ws, label, None) for label, lines in ((1.0, general.abusive()), (0.0, general.acceptable())) for line in lines for ws in passages(line)]


def isotonic(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Pool-adjacent-violators steps (from, value); equal values of ``x`` are one step."""
    blocks: list[list[float]] = []
    at, where = np.unique(np.round(x, 9), return_inverse=True)
    for a, s, n in zip(at.tolist(), np.bincount(where, y).tolist(), np.bincount(where).tolist(), strict=True):
        blocks.append([a, s, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    return [(a, s / n) for a, s, n in blocks]


class Scorer(Once):
    """Index and calibration, as shipped to the executors."""

    def __init__(self, index: Index, steps: list[tuple[float, float]]):
        self.args = (index, steps)
        self.index, self.steps = index, steps

    def calibrated(self, vote: float) -> float:
        """The share of abusive ones among reviewed documents of such a vote; the vote itself without calibration."""
        at = 0.0
        for a, v in self.steps:
            if vote < a:
                break
            at = v
        return at if self.steps else vote


def spread(spark: SparkSession, rows: list[tuple], schema: str, run: Callable, out: str, parts: int = 24) -> list:
    """``run`` over bounded driver rows on the executors."""
    if not rows:
        return []
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema).repartition(min(parts, len(rows))).mapInPandas(run, out).collect()


def reviews(documents: DataFrame, key: str, text: str, marks: DataFrame, mark_key: str, verdict: str) -> list[tuple]:
    """[(key, text, rejected)] of the reviewed documents: at most ``MOST_MARKED``, and as many of them, in order of hash, as hold ``MOST_CHARACTERS``."""
    said = F.lower(F.trim(F.col(verdict)))
    told = marks.filter(F.col(mark_key).isNotNull()).groupBy(F.col(mark_key).alias(key)).agg(F.sum(F.when(said == "reject", 1).when(said == "ok", -1).otherwise(0)).alias("balance")).filter("balance <> 0")
    some = told.orderBy(F.xxhash64(key), key).limit(MOST_MARKED)
    held = documents.select(key, text).join(F.broadcast(some), key).dropDuplicates([key])
    # lengths first: at most MOST_MARKED rows of numbers; then the texts of those that are taken
    sized = held.select(key, F.length(text).alias("__n"))
    so_far = F.sum("__n").over(Window.orderBy(F.xxhash64(key), key).rowsBetween(Window.unboundedPreceding, 0))
    taken = {r[0] for r in sized.withColumn("__so_far", so_far).filter(F.col("__so_far") <= MOST_CHARACTERS).select(key).collect()}
    return [(r[0], r[1], r[2] > 0) for r in held.filter(F.col(key).isin(sorted(taken))).collect()] if taken else []


def frequencies(documents: DataFrame, text: str, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Number of passages of all documents that hold each term of the vocabulary, and of all passages."""
    known = Vocabulary(sorted(vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf[text]:
                seen.update(passages(t))
            if len(seen) > 200_000:
                _add(df, seen, known.terms)
        _add(df, seen, known.terms)
        if df:
            yield pd.DataFrame({"term": list(df), "n": list(df.values())})

    df = {t: n for t, n in documents.select(text).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}
    return df, df.pop("", 0)


class Vocabulary(Once):
    def __init__(self, some: list[str]):
        self.args = (some,)
        self.terms = set(some)


def _add(df: Counter, seen: Counter, vocabulary: set[str]) -> None:
    """Adds passage frequencies of the known terms; '' counts the passages."""
    for p, n in seen.items():
        df[""] += n
        for t in terms(p).keys() & vocabulary:
            df[t] += n
    seen.clear()


def judged(spark: SparkSession, read: list[tuple], df: dict[str, int], n: int) -> list[Example]:
    """Every passage of the reviewed documents with the chance that it is abusive, as the reviews together show it.

    A passage that is abusive stands in rejected documents but for wrong verdicts (``TRUST``), any other in as many as there are among
    all reviewed ones: so each rejected document with the passage, or one like it, speaks for abuse and each fine one against it.
    Of a rejected document's passages that no other document knows, as many as fine documents have on average are expected to be
    ordinary; but if nothing else explains the rejection, one of them does. Fewer than ``LEAST_MARKED`` reviews don't tell that."""
    owners: dict[tuple[str, ...], set] = defaultdict(set)
    bad = {k: b for k, _, b in read}
    for k, ps, _ in read:
        for p in ps:
            owners[p].add(k)
    rejected = {p: sum(bad[k] for k in ks) for p, ks in owners.items()}
    whole = Index([(p, 1.0, None) for p in owners], df, n)
    counts = [(rejected[e[0]], len(owners[e[0]]) - rejected[e[0]]) for e in whole.examples]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = [whole.nearest(tuple(p.split()), k=len(counts), floor=ALIKE) for p in pdf["p"]]
            yield pdf.assign(r=[sum(counts[i][0] for _, i in ns) for ns in near], f=[sum(counts[i][1] for _, i in ns) for ns in near])

    told = {tuple(r.p.split()): (r.r, r.f) for r in spread(spark, [(" ".join(p),) for p in sorted(owners)], "p string", run, "p string, r long, f long")}
    base = (sum(bad.values()) + 1) / (len(bad) + 20)  # drawn towards one in twenty while there are few reviews
    lone: dict[int, list] = defaultdict(list)
    for p, ks in owners.items():
        if sum(told[p]) == 1:
            lone[next(iter(ks))].append(p)
    ordinary = sum(len(ps) for k, ps in lone.items() if not bad[k]) / max(sum(not b for b in bad.values()), 1)
    # A wording that makes up a large share of all passages of the corpus is hardly abuse; its rarest term bounds the share, taken at its
    # lower bound of two deviations, so that small counts tell nothing.
    rarest = {p: min(df.get(t, 0) for t in terms(p)) for p in owners}
    common = {p: min(3.0, max(0.0, log(max(0.0, c - 2 * sqrt(c)) / max(n, 1) / RARE + 1e-9))) for p, c in rarest.items()}
    chance = {p: 1 / (1 + exp(min(500.0, common[p] + log((1 - FEW) / FEW) + r * log(base / TRUST) + f * log((1 - base) / (1 - TRUST))))) for p, (r, f) in told.items()}
    explained = {k for p, ks in owners.items() if chance[p] > 0.5 for k in ks}
    out = []
    for p, ks in owners.items():
        k = next(iter(ks)) if len(ks) == 1 else None
        y = chance[p]
        if len(bad) >= LEAST_MARKED and k is not None and bad[k] and p in lone.get(k, ()):
            y = TRUST * max(0.0 if k in explained else 1 / len(lone[k]), 1 - ordinary / len(lone[k]))
        out.append((p, y, k))
    return out


def fit(documents: DataFrame, key: str, text: str, marks: DataFrame, mark_key: str, verdict: str) -> Scorer:
    """Builds the index from seeds and reviews and calibrates it. The driver gets at most ``MOST_MARKED`` reviewed texts and the
    frequencies of their terms; searches run on the executors."""
    spark = documents.sparkSession
    held = reviews(documents, key, text, marks, mark_key, verdict)
    number = {k: i for i, (k, _, _) in enumerate(held)}  # keys of any type
    read = [(number[k], list(dict.fromkeys(passages(t))), bad) for k, t, bad in held]
    base = seeds()
    df, n = frequencies(documents, text, {t for ws, _, _ in base for t in terms(ws)} | {t for _, ps, _ in read for p in ps for t in terms(p)})
    known = {ws for ws, _, _ in base}
    index = Index(base + [e for e in judged(spark, read, df, n) if e[0] not in known], df, n)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["k"]].assign(v=[index.score(t, k)[0] for k, t in zip(pdf["k"], pdf["t"], strict=True)])

    if len(held) < LEAST_MARKED:
        return Scorer(index, [])
    own = {r.k: r.v for r in spread(spark, [(number[k], t) for k, t, _ in held], "k long, t string", votes, "k long, v double")}
    return Scorer(index, isotonic(np.array([own[number[k]] for k, _, _ in held]), np.array([float(b) for _, _, b in held])))


def scores(documents: DataFrame, key: str, text: str, scorer: Scorer, *keep: str) -> DataFrame:
    """(key, keep…, vote, score, evidence) of every document; evidence is the passage with the largest vote. Kept columns that are called like the added ones are replaced."""
    kinds = dict(documents.dtypes)
    keep = tuple(c for c in keep if c.lower() not in ("vote", "score", "evidence"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            got = [scorer.index.score(t) for t in pdf[text]]
            yield pdf[[key, *keep]].assign(vote=[g[0] for g in got], score=[scorer.calibrated(g[0]) for g in got], evidence=[g[1] for g in got])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, *keep))
    return documents.select(key, *keep, text).mapInPandas(run, f"{schema}, vote double, score double, evidence string")
