"""Problem 1: values typed freely, mapped to the entry of a reference list that is meant.

Values that are a name or alias as a whole are looked up. Otherwise a multi-pattern automaton over all canonical names and aliases
finds mentions embedded in the value; the longest one wins, and those that overlap it don't count. What remains goes to token-set
similarity: the value's words, in any order, against the entry's words with at most ``edits`` misspelt characters. Candidates come
from a deletion index, so no value is compared with the whole list. Values that no entry explains are reported with id -1.

Defined cases: null and blank values give no row; equal values give equal ids wherever they stand; two entries equally
near give -1; values of any length are searched for mentions, but one longer than every entry is no misspelling of one; an empty list maps every value to -1; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions.fold import SPACE, bare, osa, plain
from bidloom.functions.worker import Once, bounded

# Common other names of countries, by ISO code.
COUNTRY_ALIASES = {
    "VN": ["vnm", "việt", "hàng việt"], "CN": ["chn", "prc", "p r china", "p r c", "tq", "trung hoa", "people s republic of china", "mainland china"],
    "JP": ["jpn", "nhật", "nippon"], "KR": ["kor", "rok", "hàn", "nam hàn", "korea", "republic of korea", "hq", "đại hàn"], "TW": ["twn", "r o c", "taiwan roc"],
    "TH": ["tha", "thái"], "MY": ["mys", "mã lai"], "SG": ["sgp", "sing"], "IN": ["ind"], "ID": ["idn", "indo", "in đô nê xi a", "nam dương"], "TR": ["tur", "türkiye", "thổ"],
    "DE": ["deu", "ger", "deutschland", "chlb đức", "cộng hoà liên bang đức"], "FR": ["fra"], "IT": ["ita", "italia", "i ta li a"], "ES": ["esp", "españa"], "NL": ["nld", "holland", "the netherlands", "hoà lan"],
    "BE": ["bel", "belgique"], "AT": ["aut", "österreich"], "PL": ["pol", "polska"], "CH": ["che", "swiss", "thụy sĩ", "thụy sỹ", "thuỵ sỹ"], "SE": ["swe", "thụy điển"], "DK": ["dnk"], "FI": ["fin"],
    "GB": ["gbr", "uk", "u k", "england", "great britain", "vương quốc anh", "anh quốc"], "US": ["usa", "u s a", "u s", "mỹ", "america", "united states of america"], "AU": ["aus", "australian"],
}
#: Words around a name that don't belong to it, without accents.
NOISE = {
    "brand": r"^(cong ty( tnhh| co phan| cp)?|cty( cp| tnhh)?|ctcp|hang( san xuat)?|thuong hieu|nhan hieu|brand|nsx|th|tap doan)\b\s*|\b(co ltd|co|ltd|jsc|gmbh|corp|inc|llc|vn|chinh hang|group|company)$",
    "origin": r"^(made in|product of|origin|xuat xu|sx tai|san xuat tai|hang|nhap( khau)?( tu)?|nuoc|xx|country of origin)\b\s*|\b(nk|nhap khau|origin)$",
}


class Mapper(Once):
    """Maps single values to ids. ``entries``: (id, spelling); the first spelling of an id is its canonical name. ``aliases``: other names and codes."""

    def __init__(self, entries: list[tuple[int, str]], kind: str, aliases: list[tuple[int, str]] = (), edits: int = 2):
        self.args = (entries, kind, list(aliases), edits)
        self.kind, self.edits = kind, edits
        self.noise = re.compile(NOISE.get(kind, "$^"))
        self.accented: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        self.packed: dict[str, int] = {}
        self.bag: dict[str, int] = {}
        self.deleted: dict[str, set[int]] = {}
        self.names: list[tuple[int, str, str, tuple[str, ...]]] = []
        self.long, self.short = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.lexicon: set[str] = set()
        self.spellings = {n for _, n in entries}
        owners: dict[tuple[bool, str], set[int]] = {}
        for named, some in ((True, entries), (False, aliases)):
            for i, name in some:
                soft, key = self.soft(name), self.hard(name)
                self.accented.setdefault(soft, i)
                if not key:
                    continue
                self.whole.setdefault(key, i)
                self.packed.setdefault(key.replace(" ", ""), i)
                self.bag.setdefault(" ".join(sorted(key.split())), i)
                # Forms of up to four letters are words of many meanings without their accents and capitals, so these count there.
                owners.setdefault((len(key) > 4, key if len(key) > 4 else soft), set()).add(i)
                if not named:
                    continue
                self.lexicon.update(key.split())
                at = len(self.names)
                self.names.append((i, key.replace(" ", ""), soft.replace(" ", ""), tuple(key.split())))
                for form in {key.replace(" ", ""), "".join(sorted(key.split())), *(w for w in key.split() if len(w) > 3)}:
                    for d in self.deletes(form):
                        self.deleted.setdefault(d, set()).add(at)
        for (is_long, form), ids in owners.items():
            (self.long if is_long else self.short).add_word(f" {form} ", (tuple(sorted(ids)), form))
        for automaton in (self.long, self.short):
            if len(automaton):
                automaton.make_automaton()
        self.longest = max((len(n[1]) for n in self.names), default=0) + edits
        self.map = bounded(self._map, 100_000)

    @staticmethod
    def soft(text: str) -> str:
        """Lower case with accents, one blank between words."""
        return SPACE.sub(" ", re.sub(r"[^\w]+|_", " ", plain(text).lower())).strip()

    @staticmethod
    def hard(text: str) -> str:
        return re.sub(r"[^a-z0-9]+", " ", bare(text)).strip()

    def limit(self, n: int) -> int:
        return 0 if n <= 2 else 1 if n <= 5 else self.edits

    def deletes(self, word: str) -> set[str]:
        n = min(self.limit(len(word)) + (len(word) > 3), self.edits)
        return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(n + 1) for gone in combinations(range(len(word)), k)}

    def mention(self, value: str) -> int | None:
        """Id of the longest name or alias that stands in the value; mentions that overlap a longer one don't count. -1 if two entries are mentioned at equal length, None without a mention.

        A form of up to four letters counts with its accents, or, if it has none, in capitals or as it is spelt in the list."""
        found: list[tuple[int, tuple[int, ...]]] = []
        if len(self.long):
            found += [(len(form), ids) for _, (ids, form) in self.long.iter(f" {self.hard(value)} ")]
        if len(self.short):
            cased = f" {SPACE.sub(' ', re.sub(r'[^\w]+|_', ' ', plain(value))).strip()} "
            line = cased.lower()
            for end, (ids, form) in self.short.iter(line):
                seen = cased[end - len(form) : end] if len(cased) == len(line) else form
                if not form.isascii() or seen.isupper() or seen in self.spellings:
                    found.append((len(form), ids))
        if not found:
            return None
        most = max(n for n, _ in found)
        ids = {i for n, some in found if n == most for i in some}
        return ids.pop() if len(ids) == 1 else -1

    def matched(self, words: list[str], tokens: tuple[str, ...]) -> int | None:
        """Misspelt characters when every token of an entry is found among the value's words, in any order, each word once; None if one isn't found or a word is left."""
        if len(words) != len(tokens):
            return None
        left, total = list(words), 0
        for t in sorted(tokens, key=len, reverse=True):
            d, w = min(((osa(t, w, self.limit(len(t))), w) for w in left), default=(99, ""))
            if d > self.limit(len(t)):
                return None
            left.remove(w)
            total += d
        return total

    def similar(self, soft: str, key: str) -> int | None:
        """Id of the one entry of largest token-set similarity: words in any order, together or apart, with few misspelt characters; ties of two entries give None."""
        words = key.split()
        compact = key.replace(" ", "")
        if len(compact) > self.longest:
            return None  # further from every entry than misspellings go
        some: set[int] = set()
        for form in {compact, "".join(sorted(words)), *(w for w in words if len(w) > 3)}:
            for d in self.deletes(form):
                some |= self.deleted.get(d, set())
        best: dict[int, float] = {}
        accented = soft.replace(" ", "")
        for at in some:
            i, name, with_accents, tokens = self.names[at]
            most = max(self.limit(len(compact)), self.limit(len(name)))
            near = [osa(compact, name, most), osa("".join(sorted(words)), "".join(sorted(tokens)), most)]
            if (by_words := self.matched(words, tokens)) is not None:
                near.append(by_words)
            d = min(near)
            if d > most or not self.limit(len(compact)):
                continue  # too far, or too short to be told from a misspelling
            if d > 1 and any(w in self.lexicon and w not in tokens and len(w) > 1 for w in words):
                continue  # the word is another entry's, not a misspelling
            fine = osa(accented, with_accents, 6) / 10 if near[0] == d else 0.3
            # token-set ratio: letters that agree in both, of all letters
            ratio = 2 * (max(len(compact), len(name)) - d - fine) / (len(compact) + len(name))
            best[i] = max(best.get(i, -1.0), ratio)
        order = sorted(((-r, i) for i, r in best.items()))
        return None if not order or len(order) > 1 and order[0][0] == order[1][0] else order[0][1]

    def _map(self, value: str) -> int:
        soft = self.soft(value)
        if soft in self.accented:
            return self.accented[soft]
        for strip in (False, True):
            key = self.hard(value)
            if strip:
                for _ in range(3):
                    key = self.noise.sub("", key).strip()
                kept = len(key.split())
                words = soft.split()
                for a in range(len(words) - kept + 1):
                    if kept and self.hard(" ".join(words[a : a + kept])) == key and (part := " ".join(words[a : a + kept])) in self.accented:
                        return self.accented[part]
            for table, form in ((self.whole, key), (self.packed, key.replace(" ", "")), (self.bag, " ".join(sorted(key.split())))):
                if form and form in table:
                    return table[form]
        if (i := self.mention(value)) is not None:
            return i
        i = self.similar(soft, self.hard(value))
        if i is None and key != self.hard(value):
            kept = len(key.split())
            tail = soft.split()
            i = self.similar(" ".join(tail[len(tail) - kept :]) if self.hard(" ".join(tail[len(tail) - kept :])) == key else " ".join(tail[:kept]), key)
        return -1 if i is None else i


def brand_mapper(rows: list[tuple[int, str]]) -> Mapper:
    return Mapper(rows, "brand")


def origin_mapper(rows: list[tuple[int, str, str, str]]) -> Mapper:
    """From (id, name, English name, ISO code)."""
    names = [(i, n) for i, n, _, _ in rows if n] + [(i, e) for i, _, e, _ in rows if e]
    others = [(i, c) for i, _, _, c in rows if c] + [(i, a) for i, _, _, c in rows for a in COUNTRY_ALIASES.get(c or "", [])]
    mapper = Mapper(names, "origin", others, edits=2)
    mapper.canonical = {n for _, n, _, _ in rows if n}
    return mapper


def map_values(kind: Column, value: Column, mappers: dict[str, Mapper], exact: set[str], packed: Callable[[str], bool] | None = None, packed_kind: str | None = None) -> Column:
    """struct<list_id, exact, packed> of each value of a kind: the id of its entry (-1: none), whether it is an entry's name byte for byte, and,
    for ``packed_kind``, whether ``packed`` says that it holds several values (which then aren't mapped)."""

    def one(k: str, v: str) -> tuple[int | None, bool, bool]:
        if v in exact:
            return mappers[k].map(v), True, False
        if packed is not None and k == packed_kind and packed(v):
            return None, False, True
        return mappers[k].map(v), False, False

    @F.pandas_udf("struct<list_id long, exact boolean, packed boolean>")
    def run(k: pd.Series, v: pd.Series) -> pd.DataFrame:
        got = [one(a, b) if b is not None and b.strip() else (None, False, False) for a, b in zip(k, v, strict=True)]
        return pd.DataFrame({"list_id": pd.array([g[0] for g in got], "Int64"), "exact": [g[1] for g in got], "packed": [g[2] for g in got]})

    return run.asNondeterministic()(kind, value)


def map_column(column: Column, mapper: Mapper) -> Column:
    """The id of each value's entry; -1 for none, null for a null or blank value."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([mapper.map(v) if v is not None and v.strip() else None for v in s], dtype="Int64")

    return run(column)
