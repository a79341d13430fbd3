"""Unicode folding shared by the operators: plain Python on single strings, to be called inside Arrow batches.

``plain`` gives one consistent spelling (what a reader sees), ``bare`` a search key without case and accents.
Null in gives null out for ``plain`` and '' for ``bare``.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

# Letters of other scripts that look like a Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝүьгп"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxhdqwybrn"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανικορτυχγ"
GREEK_AS = "ABEZHIKMNOPTYXavikoptuxy"
OTHER = "ƉÐɑıℓ‐‑‒−∕⁄․ꞏ"
OTHER_AS = "ĐĐaıl----//.·"
#: Only these Cyrillic and Greek letters look the same; the last ones of each list are looser and used for search keys only.
STRICT_CYRILLIC = set("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ")
STRICT_GREEK = set("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοιρκα")
PROTOTYPE = {ord(a): b for a, b in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True)} | {ord(a): b for a, b in zip(OTHER, OTHER_AS, strict=True)}
NEITHER_SCRIPT = {k: v for k, v in PROTOTYPE.items() if not 0x370 <= k <= 0x52F}
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
BLANKS = re.compile("[   -   　]")
MARKS = re.compile("[̀-ͯ]")
SPACE = re.compile(r"\s+")
#: These keep their look under compatibility mapping only as they stand.
KEEP = {ord(c): chr(0xE000 + i) for i, c in enumerate("²³¹™…½¼¾ºª´¨¸¯µ")}
UNKEEP = {ord(v): chr(k) for k, v in KEEP.items()}


def mixed_words(text: str) -> str:
    """Replaces look-alike letters by their Latin prototype in words that also hold Latin letters or stand among them.

    A run of words of one other script that holds a letter without a Latin look-alike is left alone."""

    def one(m: re.Match) -> str:
        run = m[0]
        if any(c.isalpha() and ord(c) not in PROTOTYPE for c in run):
            return run
        return run.translate(PROTOTYPE)

    def word(m: re.Match) -> str:
        w = m[0]
        foreign = sum("\u0370" <= c <= "\u052f" for c in w)
        return w if not foreign or foreign == sum(map(str.isalpha, w)) else w.translate(PROTOTYPE)

    text = re.sub(r"[^\W\d_]+", word, text)
    return re.sub(r"[\u0370-\u052f]+(?:\s+[\u0370-\u052f]+)*", one, text)


def plain(text: str | None) -> str | None:
    """The text as a reader sees it, in composed letters, ASCII punctuation look-alikes and plain blanks; case and accents stay."""
    if text is None or text.isascii():
        return text
    text = INVISIBLE.sub("", BLANKS.sub(" ", text))
    text = unicodedata.normalize("NFKC", text.translate(KEEP)).translate(UNKEEP)
    if re.search("[\u0370-\u052f]", text):
        text = mixed_words(text)
    return text.translate(NEITHER_SCRIPT)


#: Composed Latin letters without their accents, in lower case; whatever else isn't ASCII takes the long way.
SIMPLE = {c: m for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(m := MARKS.sub("", unicodedata.normalize("NFD", chr(c).lower())).replace("đ", "d").replace("ð", "d")) == 1 and m.isascii()}
LONG_WAY = re.compile("[^\\x00-\\x7F" + "".join(map(chr, SIMPLE)) + "]")
SIMPLE |= {c: chr(c).lower() for c in range(65, 91)}


@lru_cache(100_000)
def bare(text: str | None) -> str:
    """Search key: ``plain`` without case, accents and repeated blanks; đ counts as d."""
    if not text:
        return ""
    if text.isascii():
        text = text.lower()
    elif not LONG_WAY.search(text):  # letters with accents that come off, by C functions
        text = unicodedata.normalize("NFD", text.lower().replace("đ", "d").replace("ð", "d")).encode("ascii", "ignore").decode()
    else:
        text = plain(text).lower()
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFD", text)).replace("đ", "d").replace("ð", "d")
    return " ".join(text.split())


WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Words of the search key: runs of ASCII letters and digits."""
    return WORD.findall(bare(text))


def osa(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap neighbours); limit + 1 as soon as it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        least = i
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, two[j - 2] + 1)
            row.append(d)
            least = min(least, d)
        if least > limit:
            return limit + 1
        two, one = one, row
    return one[-1]


class RowFinder:
    """Finds, in a whole batch at once, the texts with a suspicious character or pair of neighbours.

    ``alphabet``: the characters that may be ordinary; any other is suspicious. ``suspicious``: a regular expression that is asked
    once for every pair of the alphabet. Null and empty texts are never found."""

    def __init__(self, alphabet: str, suspicious: str | None = None):
        chars = "".join(dict.fromkeys("\n" + alphabet))
        self.ids = np.zeros(0x10000, np.uint16)
        for i, c in enumerate(chars, 1):
            self.ids[ord(c)] = i
        n = len(chars) + 1
        self.pairs = np.zeros((n, n), bool)
        self.pairs[0, :] = True  # and none for the line break, which belongs to the text before it
        if suspicious:
            say = re.compile(suspicious).search
            for i, a in enumerate(chars[1:], 2):
                for j, b in enumerate(chars, 1):
                    self.pairs[i, j] = say(a + b) is not None if b != "\n" else say(a) is not None

    def find(self, texts) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        kept = [(t or "").replace("\n", " ") for t in texts]
        line = "\n".join(kept) + "\n"
        code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.where(code < 0x10000, self.ids[np.minimum(code, 0xFFFF)], 0)
        hits = np.flatnonzero(self.pairs[at[:-1], at[1:]])
        if len(hits):
            ends = np.flatnonzero(code == 10)
            out[np.unique(np.searchsorted(ends, hits))] = True
        return out


ASCII = "".join(map(chr, range(128)))
