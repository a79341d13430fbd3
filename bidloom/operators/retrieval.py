"""Looking up similar references: by unit and text, and requirements for items, over an inverted index of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import similarity, text
from bidloom.functions.fold import words
from bidloom.operators import matching
from bidloom.operators.peers import top_per_group


def lookup(queries: DataFrame, references: DataFrame, query_id: str, ref_id: str, name: str = "description", unit: str = "unit", k: int = 5, least: float = 0.0) -> DataFrame:
    """For each query the ``k`` references of the same unit with the most similar text, itself aside: (query_id, ref_id, similarity, place).

    References that share no word aren't similar at all; ``least`` raises that. Words weigh their inverse frequency among the references. Within a unit, blocks of references are searched by an inverted index (``best_by_blocks``)."""
    prep = lambda d, key: d.select(F.col(key), text.normalize_unit(F.col(unit)).alias("u"), F.explode(text.token_set(F.col(name))).alias("word")).filter("u is not null")
    refs, asked = prep(references, ref_id), prep(queries, query_id)
    n = references.select(F.count("*").alias("n"))
    idf = refs.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    unknown = F.broadcast(n.select((F.log(1.0 + F.col("n")) + 1).alias("new")))
    rw = refs.join(idf, "word")
    qw = asked.join(idf, "word", "left").crossJoin(unknown).select(query_id, "u", "word", F.coalesce("idf", "new").alias("idf"))
    blocks = refs.groupBy("u").agg(F.ceil(F.count("*") / matching.BLOCK).alias("blocks"))

    def unit_vectors(d: DataFrame, key: str) -> DataFrame:
        norm = d.groupBy(key).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
        return d.join(norm, key).join(F.broadcast(blocks), "u").select(key, "u", F.col("word").alias("gram"), (F.col("idf") / F.col("norm")).alias("w"), "blocks")

    found = matching.best_by_blocks(unit_vectors(qw, query_id), unit_vectors(rw, ref_id), query_id, ref_id, k + 1, ["u"], least)
    return top_per_group(found.filter(F.col(query_id) != F.col(ref_id)), [query_id], k, F.desc(F.floor(F.col("similarity") * 1e9)), F.col(ref_id)).select(query_id, ref_id, "similarity", "place")


#: Texts of requirements that are shipped to the executors at once; more are taken in turns.
BLOCK = 20_000


class Requirements:
    """Requirements as (text of words, id), and the best of them for a text by exact score.

    For all requirements at once an upper bound of the score is found: ratios can't pass what the letters in common allow, the word
    overlap and the common words are counted. Requirements are scored by falling bound until the bound falls below the best score."""

    def __init__(self, rows: list[tuple[str, object]], least: float):
        self.rows, self.least = rows, least
        self.letters = np.array([self.counted(t) for t, _ in rows])
        self.length = np.array([len(t) for t, _ in rows], dtype=float)
        self.words = np.array([len(t.split()) for t, _ in rows], dtype=float)
        self.having: dict[str, list[int]] = {}
        for i, (t, _) in enumerate(rows):
            for w in t.split():
                self.having.setdefault(w, []).append(i)

    @staticmethod
    def counted(t: str) -> np.ndarray:
        """Letters in 64 classes; letters that share one only loosen the bound."""
        return np.bincount(np.fromiter((ord(c) % 64 for c in t), dtype=np.int64, count=len(t)), minlength=64)

    def bounds(self, x: str) -> tuple[np.ndarray, np.ndarray]:
        """(upper bound of the score, word overlap) of each requirement."""
        mine, n = x.split(), len(x)
        common = np.minimum(self.letters, self.counted(x)).sum(1)
        shared, letters = np.zeros(len(self.rows)), np.zeros(len(self.rows))
        for w in mine:
            if at := self.having.get(w):
                shared[at] += 1
                letters[at] += len(w) + 1
        overlap = shared / np.maximum(len(mine) + self.words - shared, 1)
        plain = 2 * common / (n + self.length)
        part = 2 * common / np.maximum(np.minimum(n, self.length) + common, 1)
        both = np.maximum(letters - 1, 0)
        token_set = np.where((shared > 0) & ((shared == len(mine)) | (shared == self.words)), 1.0, np.maximum(plain, np.maximum(2 * both / (both + n), 2 * both / (both + self.length))))
        share = np.maximum(n, self.length) / np.maximum(np.minimum(n, self.length), 1)
        tokens = 0.95 * np.where(shared > 0, 1.0, part)
        weighted = np.where(share < 1.5, np.maximum(plain, 0.95 * np.maximum(token_set, plain)), np.maximum(plain, np.where(share <= 8, 0.9, 0.6) * np.maximum(part, tokens)))
        return 0.72 * (0.35 * weighted + 0.35 * token_set + 0.30 * part) + 0.28 * overlap, overlap

    def best(self, x: str) -> tuple[object, float] | None:
        if not x:
            return None
        bound, overlap = self.bounds(x)
        found, least = None, self.least
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] < least - 1e-9:
                break
            y, key = self.rows[i]
            lexical = (0.35 * similarity.weighted_ratio(x, y) + 0.35 * similarity.token_set_ratio(x, y) + 0.30 * similarity.partial_ratio(x, y)) / 100
            score = min(1.0, 0.72 * lexical + 0.28 * float(overlap[i]))
            if score >= self.least and (found is None or (-score, key) < (-found[1], found[0])):
                found, least = (key, score), score
        return found


def best_requirement(items: DataFrame, requirements: DataFrame, item_id: str, requirement_id: str, item_text: str, requirement_text: str, least: float = 0.54) -> DataFrame:
    """For each item the best-scoring of all requirements: (item_id, requirement_id, score). Ties: smaller requirement id.

    score = 0.72 * (0.35 weighted + 0.35 token-set + 0.30 partial ratio) + 0.28 * word overlap. Distinct texts are compared, then joined
    back; no pair is left out but those whose score is proven to be too small (``Requirements``)."""
    joined = lambda c: F.array_join(text.token_set(F.col(c)), " ")
    asked = [tuple(r) for r in requirements.filter(F.col(requirement_text).isNotNull()).groupBy(joined(requirement_text).alias("r")).agg(F.min(requirement_id)).filter("r <> ''").collect()]
    named = items.filter(F.col(item_text).isNotNull()).select(item_id, joined(item_text).alias("t"))
    kind, texts = dict(requirements.dtypes)[requirement_id], named.select("t").distinct()

    def scored(block: list) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chosen = Requirements(block, least)
            for pdf in batches:
                got = [(t, *b) for t in pdf["t"] if (b := chosen.best(t))]
                if got:
                    yield pd.DataFrame(got, columns=["t", requirement_id, "score"])

        return texts.mapInPandas(run, f"t string, {requirement_id} {kind}, score double")

    out = scored(asked[:BLOCK]) if asked else items.sparkSession.createDataFrame([], f"t string, {requirement_id} {kind}, score double")
    for at in range(BLOCK, len(asked), BLOCK):
        out = out.unionByName(scored(asked[at : at + BLOCK]))
    if len(asked) > BLOCK:
        out = top_per_group(out, ["t"], 1, F.desc("score"), F.col(requirement_id)).select("t", requirement_id, "score")
    return named.join(out, "t").select(item_id, requirement_id, "score")


def names_agree(candidate: str | None, allowed: str | None, whole: float = 82, part: float = 90) -> bool:
    """one name holds the other, or they are alike as a whole or in part; blanks agree with nothing."""
    a, b = (" ".join(words(x)) for x in (candidate, allowed))
    if not a or not b:
        return False
    return a in b or b in a or similarity.ratio(a, b) >= whole or similarity.partial_ratio(a, b) >= part


def allowed(value: str, choices: str, groups: dict[str, list[str]] | None = None) -> Column:
    """whether a value is among an array of choices: the same name, or a member of a group that is a choice (continents, for instance). Null for null choices.

    Takes two column names; names are compared in Arrow batches."""
    members = {" ".join(words(k)): [" ".join(words(v)) for v in vs] for k, vs in (groups or {}).items()}

    @F.pandas_udf("boolean")
    def run(v: pd.Series, c: pd.Series) -> pd.Series:
        def one(value, options):
            if options is None:
                return None
            if not value:
                return False
            key = " ".join(words(value))
            return any(o and (names_agree(value, o) or any(m and m in key for m in members.get(" ".join(words(o)), ()))) for o in options)

        return pd.Series([one(a, b) for a, b in zip(v, c, strict=True)], dtype=object)

    return run(F.col(value), F.col(choices))
