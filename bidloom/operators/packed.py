"""Problem 6: several values packed in one field, split into one row per value with its position.

Dictionary-guided segmentation: a multi-pattern automaton finds every known whole value, the field is cut at every possible
delimiter and, where known values follow each other without one, between them; dynamic programming picks the best cover of the
pieces by known values, quoted values and single pieces; a delimiter inside a known value or inside quotes doesn't split.

Defined cases: null, empty and blank fields and sentences of prose give no values; a field that names one value gives
that one value (callers that want only packed fields ask for two); empty places between delimiters aren't counted, repeated
names are; a piece of prose (over ``PROSE`` words, unknown) is no value, and beside it only known values count, if there are two;
texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.fold import bare, osa
from bidloom.functions.worker import Once, bounded

#: Entries of a dictionary that may be collected and shipped to the executors.
MOST_ENTRIES = 200_000
LEGAL = r"(?:Ltd|JSC|Inc|LLC|Corp|GmbH|Co|S\.A|Pte|Ltda?|PLC)\b"
DELIMITER = re.compile(
    rf"\s*(?://|[;、|+•/\t\n\[\]]|,(?!\s*{LEGAL})|\((?=xuất xứ|origin|nước|made in|xx\b))\s*|\s+[-–—]+\s+|\s+(?:và|and|or|hoặc)\s+(?=\S)|\s+(?=\(\d{{1,2}}\)\s|\d{{1,2}}[.)]\s)", re.I
)
NUMBER = re.compile(r"\(\d{1,2}\)\s*|\d{1,2}[.)]\s+")
LABEL = re.compile(r"(thương hiệu|nhãn hiệu|hãng sản xuất|hãng sx|hãng|brands?|nsx(?=\s*:)|th(?=\s*:)|manufacturer|xuất xứ|origins?|nước sản xuất|made in|xx(?=\s*:))\b\s*[:=]?\s*", re.I)
ORIGIN_LABELS = ("xuất", "origin", "nước", "made", "xx")
EQUIVALENT = re.compile(r"[\s,;/(\[-]*(?:\b(?:hoặc|or|và/hoặc|and/or)\s+)?(?:các hãng\s+)?(?:tương đương|equivalent|equal)\b[\s).\]]*|\s+hoặc\s+t[^\s,;/|]{1,9}ng\s+[^\s,;/|]{1,12}ng\s*$", re.I)
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
LONE_DASH = re.compile(r"[-–—]+\s+")
DASH = re.compile(r"\s[-–—]+\s")
#: A field without any of these, one word that is, names at most one value.
MAYBE = r"[;,、|+•/\[\]&]|\S\s+\S"
TYPE = "array<struct<list_kind string, value_no int, value_text string>>"


@lru_cache(5_000)
def _fold_char(c: str) -> str:
    c = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c).lower())[:1]
    return "" if unicodedata.category(c) in ("Mn", "Cf") else "d" if c == "đ" else " " if c.isspace() else c


#: An unknown piece of more words is prose.
PROSE = 6


class Segmenter(Once):
    """Splits single fields. ``names``: (kind, name) of the dictionary; the first kind is the default one."""

    def __init__(self, names: list[tuple[str, str]]):
        import ahocorasick

        self.args = (names,)
        self.names = names
        self.kinds = list(dict.fromkeys(k for k, _ in names))
        self.known: dict[str, str] = {}
        for kind, name in names:
            self.known.setdefault(self.key(name), kind)
        self.auto = ahocorasick.Automaton()
        for kind, name in names:
            folded = "".join(map(_fold_char, name.strip()))
            self.auto.add_word(folded, (kind, len(folded)))
        if names:
            self.auto.make_automaton()
        self.inner = [self.key(n) for _, n in names if re.search(r"[,/&]", n)]
        #: No known value spans more pieces.
        self.most = 1 + max((len(self._scan(n)[0]) for _, n in names), default=0)
        self.split = bounded(self._split, 100_000)

    @staticmethod
    def key(text: str) -> str:
        return re.sub(r"[^a-z0-9]+", " ", bare(text)).strip()

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of known whole values at word ends."""
        folded, at = [], []
        for i, c in enumerate(text):
            if f := _fold_char(c):
                folded.append(f)
                at.append(i)
        line = "".join(folded)
        out = []
        if self.names:
            for end, (kind, size) in self.auto.iter(line):
                start = end + 1 - size
                if (start == 0 or not line[start - 1].isalnum()) and (end + 1 == len(line) or not line[end + 1].isalnum()):
                    out.append((at[start], at[end] + 1, kind))
        return out

    def kind_of(self, text: str) -> str | None:
        """The kind of a known value, also with a legal form or an addition in quotes after it; else None."""
        key = self.key(text)
        if key in self.known:
            return self.known[key]
        key = re.sub(r"\b(co ltd|co|ltd|jsc|inc|llc|corp|gmbh|vn|pro|plus|eco)\b", "", key).strip()
        return self.known.get(re.sub(" +", " ", key))

    def row(self, text: str) -> list[tuple[str, str]]:
        """Known values that follow each other with nothing but blanks between, and make up the whole text: the cover by the fewest; [] if there is none."""
        found = self.mentions(text)
        if len(found) < 2:
            return []
        ends: dict[int, tuple[int, list[tuple[str, str]]]] = {0: (0, [])}
        for start, end, kind in sorted(found):
            for at in [a for a in ends if a <= start and not text[a:start].strip()]:
                n, parts = ends[at]
                if end not in ends or n + 1 < ends[end][0]:
                    ends[end] = n + 1, [*parts, (text[start:end], kind)]
        return ends[len(text)][1] if len(text) in ends and ends[len(text)][0] > 1 else []

    def _near(self, text: str) -> bool:
        """A misspelt known value that holds a delimiter itself."""
        key = self.key(re.sub(rf"(?i)[\s,]*\b{LEGAL}\.?", "", text)).replace(" ", "")
        words = sorted(self.key(text).split())
        return any(osa(key, n.replace(" ", ""), 2) <= 2 or sorted(n.split()) == words for n in self.inner)

    def _scan(self, text: str) -> tuple[list[tuple[str, bool, int, int]], dict[int, str], set[int]]:
        """Pieces (text, quoted, start, end) in order; labels before a piece number; piece numbers that follow a dash or bracket."""
        pieces: list[tuple[str, bool, int, int]] = []
        labels: dict[int, str] = {}
        dashes: set[int] = set()
        at, fresh = 0, True
        while at < len(text):
            if m := DELIMITER.match(text, at):
                if m.end() > at:
                    if DASH.match(m[0]) or "[" in m[0] or "(" in m[0]:
                        dashes.add(len(pieces))
                    at, fresh = m.end(), True
                    continue
            if fresh and at and (m := LONE_DASH.match(text, at)):
                dashes.add(len(pieces))
                at = m.end()
                continue
            if fresh and (m := NUMBER.match(text, at)):
                at = m.end()
                continue
            if fresh and (m := LABEL.match(text, at)) and m.end() < len(text):
                labels[len(pieces)] = self.kinds[-1] if m[1].lower().startswith(ORIGIN_LABELS) else self.kinds[0]
                at = m.end()
                continue
            if text[at].isspace():
                at += 1
                continue
            close = QUOTES.get(text[at]) if fresh else None
            if close:
                end = at + 1
                while end < len(text):
                    if text[end] == close and close == '"' and text[end + 1 : end + 2] == '"':
                        end += 2
                    elif text[end] == close and (end + 1 == len(text) or not text[end + 1].isalnum()):
                        break
                    else:
                        end += 1
                if end < len(text):
                    pieces.append((text[at + 1 : end].replace(close * 2, close) if close == '"' else text[at + 1 : end], True, at, end + 1))
                    at, fresh = end + 1, False
                    continue
            m = DELIMITER.search(text, at + 1)
            while m and m.end() == m.start():
                m = DELIMITER.search(text, m.end() + 1)
            end = m.start() if m else len(text)
            pieces.append((text[at:end], False, at, end))
            at, fresh = end, True
        return pieces, labels, dashes

    def _split(self, text: str) -> list[tuple[str, int, str]]:
        """(kind, number within the kind, value as written) of one field."""
        if not text or not text.strip():
            return []
        cut = EQUIVALENT.sub(lambda m: " " if m.end() < len(m.string) else "", text) if re.search("(?i)tương đương|equivalent|equal|hoặc t", text) else text
        pieces, labels, dashes = self._scan(cut)
        spans = {(s, e): k for s, e, k in self.mentions(cut)}
        n = len(pieces)
        best: list[tuple[float, int, str | None]] = [(0.0, -1, None)]
        for j in range(1, n + 1):
            found = (-1e9, j - 1, None)
            for i in range(j - 1, max(-1, j - 1 - max(4, self.most)), -1):
                if i < j - 1 and not all(re.search(r"\w", pieces[k][0]) for k in (i, j - 1)) or i < j - 1 and any(k in labels or k in dashes or pieces[k][1] for k in range(i + 1, j)) or i < j - 1 and pieces[i][1]:
                    break
                raw = pieces[i][0].strip() if i == j - 1 else cut[pieces[i][2] : pieces[j - 1][3]].strip()
                kind = spans.get((pieces[i][2], pieces[j - 1][3])) or self.kind_of(raw)
                size = j - i
                if kind:
                    score = 2.0 * size + 0.5
                elif i == j - 1:
                    score = 0.0 if not raw else 1.0 if pieces[i][1] else 0.5 if len(raw.split()) <= PROSE else -1.0
                elif self.inner and self._near(raw):
                    score = 2.0 * size + 0.2
                else:
                    continue
                if best[i][0] + score > found[0]:
                    found = (best[i][0] + score, i, kind)
            best.append(found)
        cover, j = [], n
        while j > 0:
            _, i, kind = best[j]
            cover.append((i, j, kind))
            j = i
        values: list[tuple[int, str, str | None]] = []
        for i, j, kind in reversed(cover):
            raw = pieces[i][0] if j == i + 1 else cut[pieces[i][2] : pieces[j - 1][3]]
            raw = raw.strip().strip("[]").strip()
            if not pieces[i][1]:
                raw = raw.rstrip(") ") if "(" not in raw else raw
                raw = raw.strip(" .") if not re.search(rf"{LEGAL}\.$|®$", raw) else raw
            if "&" in raw and not kind and len(parts := [p.strip() for p in raw.split("&")]) > 1 and all(self.kind_of(p) for p in parts):
                values += [(i, p, self.kind_of(p)) for p in parts]
            elif raw and not kind and not pieces[i][1] and (parts := self.row(raw)):
                values += [(i, p, k) for p, k in parts]
            elif raw and re.search(r"\w", raw):
                values.append((i, raw, kind or ("" if pieces[i][1] else None)))
        if any(k is None and len(v.split()) > PROSE for _, v, k in values):
            values = [x for x in values if x[2]]
            values = values if len(values) > 1 else []
        if not values:
            return []
        if sum(bool(k) or bool(self.mentions(v)) for _, v, k in values) * 2 < len(values):
            return []
        out, section, counts = [], self.kinds[0], dict.fromkeys(self.kinds, 0)
        for x, (i, raw, kind) in enumerate(values):
            if i in labels:
                section = labels[i]
            elif i in dashes:
                ahead = [k for _, _, k in values[x:] if k]
                section = self.kinds[-1] if not ahead or ahead[0] == self.kinds[-1] else section
            if kind and not any(p in labels for p in range(i + 1)):
                section = kind
            elif kind:
                section = kind if kind != section and i not in labels and section == self.kinds[0] else section
            counts[section] += 1
            out.append((section, counts[section], raw))
        return out


def dictionary(brands: DataFrame, origins: DataFrame) -> list[tuple[str, str]]:
    """(kind, name) from the two list tables; their size is checked before they are collected. English names count as origins too."""
    both = brands.select(F.lit("brand").alias("k"), F.col("brand_name").alias("n")).union(origins.select(F.lit("origin"), F.explode(F.array("origin_name", "english_name"))))
    rows = both.filter("trim(n) <> ''").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a dictionary of more than {MOST_ENTRIES} entries can't be shipped to every executor")
    return [tuple(r) for r in rows]


def split_values(df: DataFrame, column: str, segmenter: Segmenter, least: int = 2) -> DataFrame:
    """One row per value of each field that names at least ``least`` values: the row's columns, list_kind, value_no, value_text.

    Columns of the input that are called like the last three are replaced by them."""

    @F.pandas_udf(TYPE)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"list_kind": k, "value_no": n, "value_text": v} for k, n, v in segmenter.split(t)] if t else [])

    some = df.filter(F.col(column).rlike(MAYBE)) if least > 1 else df.filter(F.col(column).isNotNull())
    got = some.withColumn("__values", run.asNondeterministic()(F.col(column))).filter(F.size("__values") >= least)
    return got.withColumn("__v", F.explode("__values")).select(*[c for c in df.columns if c.lower() not in ("list_kind", "value_no", "value_text")], "__v.*")


def is_packed(column: F.Column, segmenter: Segmenter) -> F.Column:
    """Whether a field names two or more values."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: bool(t) and len(segmenter.split(t)) >= 2)

    return F.when(column.rlike(MAYBE), run(F.when(column.rlike(MAYBE), column))).otherwise(F.lit(False))
