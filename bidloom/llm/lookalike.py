"""Problem 4: text that looks the same but differs in its characters.

Confusables skeleton: compose, replace every character by the prototype of its look, decompose. Originals with equal skeletons
look alike; the skeleton composed again is the one consistent form of its group, so whether a text is in that form needs no
gathering of the group. The look-alike table is the public Unicode confusables data as the JVM's ICU holds it (``confusables``):
each letter or sign whose look is that of an ASCII character gets that character, of the same case where it has one. Invisible
characters go, blanks of every width become plain ones, full-width and other compatibility forms their ordinary characters, letters
of other scripts among Latin ones their Latin look-alike. A run of words of another script that holds a letter without a Latin
look-alike is real text and stays.

Defined cases: null stays null, '' stays ''; texts of any length are handled whole; repeated rows each get their result;
an empty table gives an empty result; extra columns are kept, also if they are called like those added (those are replaced).
Where the JVM has no ICU the short table of ``bidloom.functions.fold`` serves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.fold import ASCII, BLANKS, INVISIBLE, KEEP, PROTOTYPE, UNKEEP, RowFinder
from bidloom.functions.worker import Once, bounded

#: Characters without an ordinary look-alike; texts of these alone are their own consistent form.
USUAL = ASCII + "".join(map(chr, [*range(0xC0, 0xD0), *range(0xD1, 0x100)])) + "ĂăĐđĨĩŨũƠơƯư" + "".join(map(chr, range(0x1EA0, 0x1EFA))) + "²³°±®©–—“”‘’•…™"


@lru_cache(1)
def finder() -> RowFinder:
    return RowFinder(USUAL)


@lru_cache(20_000)
def foreign(c: str) -> bool:
    """Whether a character is a letter of another script than Latin (full-width and mathematical forms count by what they stand for)."""
    return c.isalpha() and not unicodedata.name(unicodedata.normalize("NFKC", c)[:1] if not PROTOTYPE.get(ord(c)) else c, "").startswith("LATIN") and not unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH LATIN", "MATHEMATICAL"))


@lru_cache(4)
def confusables(spark: SparkSession) -> tuple[tuple[int, str], ...]:
    """(code, ASCII character of that look) of all characters of the basic plane, by ICU's skeletons; Latin letters with accents and usual signs aside."""
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        usual = set(USUAL)
        some = [chr(x) for x in range(0xA1, 0xFFFE) if not (0x3400 <= x <= 0x9FFF or 0xAC00 <= x <= 0xDFFF) and chr(x) not in usual and unicodedata.category(chr(x))[0] in "LPSN"]
        looks = lambda cs: checker.getSkeleton("\n".join(cs)).split("\n")
        plainly = [c for c in ASCII if c.isalnum() or c in "-./"]
        by_look: dict[str, list[str]] = {}
        for c, look in zip(plainly, looks(plainly), strict=True):
            by_look.setdefault(look, []).append(c)
        out = {k: v for k, v in PROTOTYPE.items() if not 0x370 <= k <= 0x52F}
        for c, look in zip(some, looks(some), strict=True):
            if look not in by_look or unicodedata.normalize("NFD", c)[0].isascii():
                continue
            kind = unicodedata.category(c)
            fit = [x for x in by_look[look] if (x.isupper() if kind == "Lu" else x.islower() if kind == "Ll" else x.isdigit() if kind[0] == "N" else not x.isalnum() if kind[0] in "PS" else x.isupper())]
            if fit and ord(c) not in out:
                out[ord(c)] = fit[0]
        return tuple(sorted(out.items()))
    except (TypeError, AttributeError, ValueError):  # no ICU there
        return tuple(sorted(PROTOTYPE.items()))


class Looks(Once):
    """Skeletons and consistent forms under a look-alike table."""

    def __init__(self, table: tuple[tuple[int, str], ...] = tuple(PROTOTYPE.items())):
        self.args = (table,)
        self.letters = {k: v for k, v in table if foreign(chr(k))}
        self.others = {k: v for k, v in table if k not in self.letters}
        self.skeleton = bounded(self._skeleton)

    def mixed(self, text: str) -> str:
        """Letters of other scripts become their Latin look-alikes in words that also hold Latin letters and in runs of words that look Latin as a whole."""

        def word(m: re.Match) -> str:
            w = m[0]
            strange = sum(map(foreign, w))
            return w if not strange or strange == len(w) else w.translate(self.letters)

        text = re.sub(r"[^\W\d_]+", word, text)
        kinds = "".join("f" if foreign(c) else " " if c.isspace() else "." for c in text)
        out, at = [], 0
        for m in re.finditer("f+(?: +f+)*", kinds):
            run = text[m.start() : m.end()]
            out += [text[at : m.start()], run.translate(self.letters) if all(c.isspace() or ord(c) in self.letters for c in run) else run]
            at = m.end()
        return "".join([*out, text[at:]])

    def _skeleton(self, text: str) -> str:
        """Decomposed text of prototypes; equal for texts that look alike."""
        if text.isascii():
            return text
        text = unicodedata.normalize("NFC", INVISIBLE.sub("", BLANKS.sub(" ", text)))
        if any(map(foreign, text)):
            text = self.mixed(text)
        text = unicodedata.normalize("NFKC", text.translate(self.others).translate(KEEP)).translate(UNKEEP)
        return unicodedata.normalize("NFD", text.translate(self.others))

    def unified(self, text: str) -> str:
        """The consistent form: the skeleton, composed."""
        return unicodedata.normalize("NFC", self.skeleton(text))


_short = Looks()


def skeleton(text: str) -> str:
    """The skeleton under the short table, where there is no session to ask for the full one."""
    return _short.skeleton(text)


def unified(text: str) -> str:
    return _short.unified(text)


def unify(df: DataFrame, column: str) -> DataFrame:
    """Adds ``unified``, the consistent form of the column."""

    looks = Looks(confusables(df.sparkSession))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        texts = s.tolist()
        return pd.Series([looks.unified(t) if odd else t for t, odd in zip(texts, finder().find(texts), strict=True)], dtype=object)

    return df.withColumn("unified", run(F.col(column)))


def disguised(df: DataFrame, column: str, also: Callable[[str], bool] | None = None) -> DataFrame:
    """Rows whose text isn't in its consistent form, with ``unified``; texts that ``also`` rejects are left out."""
    looks = Looks(confusables(df.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[finder().find(pdf[column].tolist())]
            forms = [looks.unified(t) for t in pdf[column]]
            hit = np.array([f != t and (also is None or also(t)) for f, t in zip(forms, pdf[column], strict=True)], bool)
            if hit.any():
                yield pdf[hit].assign(unified=[f for f, h in zip(forms, hit, strict=True) if h])

    kept = df.drop("unified")
    return kept.mapInPandas(run, kept.schema.simpleString()[7:-1] + ",unified:string")


def look_alikes(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Groups of at least two different originals with one look: ``by``, unified, spellings, n (rows).

    Rows are counted per original first, so a look that a third of all rows share is one row per original in the shuffle."""
    each = unify(df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n")), column)
    return each.groupBy(*by, "unified").agg(F.count("*").alias("spellings"), F.sum("n").alias("n")).filter("spellings > 1")
