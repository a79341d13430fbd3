"""Problem 2: text decoded with the wrong character encoding.

Every kind of swap is treated as a substitution cipher. A cipher (``CIPHERS``) says only how garbled text falls into
units: characters that stand for one letter. What a unit means is learnt: ``fit`` counts letter bigrams over all clean
rows and unit contexts over all suspicious rows in one pass, then expectation-maximisation per cipher finds
P(letter | unit) so that the deciphered text is likely under the bigrams. ``Repairer`` applies the mapping. Where the swap is a
known reversible codec pair, the bytes decide: their exact decoding goes before the learnt letter, which only fills units that don't decode.
Ciphers are learnt over all sources together, as one source holds several swaps and a mapping per source would grow with the data.
Double-byte code pages cut letters in two, so they are no substitution of letters; for them only the exact way exists.

Defined cases: null, empty and blank texts are not damaged and come back as they are; texts of any length are handled
whole; repeated rows each get their own result; an empty table gives an empty result; extra columns are kept by ``repair``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.fold import ASCII, RowFinder
from bidloom.functions.worker import Once, bounded

BASE = "aăâbcdđeêfghijklmnoôơpqrstuưvwxyz"
TONES = ["̀", "́", "̉", "̃", "̣"]
ACCENTED = sorted({unicodedata.normalize("NFC", v + t) for v in "aăâeêioôơuưy" for t in TONES} | set("ăâđêôơư"))
#: Letters of the bigram model; index 0 is anything else, 1 a digit.
LETTERS = list("abcdefghijklmnopqrstuvwxyz") + ACCENTED
INDEX = {c: i + 2 for i, c in enumerate(LETTERS)}
A = len(LETTERS) + 2
VIET = set(ACCENTED) | {c.upper() for c in ACCENTED}
V = "".join(sorted(VIET))
UP = "".join(c for c in V if c.isupper())
LOOKUP = np.zeros(0x2000, np.int64)
for _c, _i in INDEX.items():
    LOOKUP[ord(_c)] = _i
    if len(_c.upper()) == 1:
        LOOKUP[ord(_c.upper())] = _i
LOOKUP[48:58] = 1
ORDINARY = "²³×Ø°±–—“”‘’•…、®©"
VOWELS = "aăâeêioôơuưyãõý"
LOW = "".join(c for c in V if c.islower())
#: Neighbours that may mean damage; a superset, decided on later. Any character outside the alphabet counts too.
SUSPECT = rf"\?|[a-z{LOW}][{UP}]|[A-Za-z{V}][®©]|[®©×Ø°±][a-z{LOW}]|[aăâeêôơãõýAEĂÂÊÔƠ][{V}]|[uoiyUOIY][ìòùõÌÒÙÕ]"


@lru_cache(1)
def finder() -> RowFinder:
    return RowFinder(ASCII + V + ORDINARY, SUSPECT)


#: Places where a character is gone.
LOST = re.compile(r"�|(?<=\w)\?(?=\w)|\?\?|(?<=\w)\?(?= [^\W_A-Z]|[,;)\-])|(?<![\w?])\?(?=\w)")


def _images(codec: str) -> dict[int, str]:
    """Byte 128..255 → character; holes of the code page stay control characters, as decoders in practice leave them."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


IMAGES = {c: _images(c) for c in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251")}
BYTES = {c: {ch: b for b, ch in m.items()} for c, m in IMAGES.items()}
BYTES["cp1252"] = {chr(b): b for b in range(128, 160)} | BYTES["cp1252"]


def _units(codec: str) -> re.Pattern:
    """Units of text whose UTF-8 bytes were read in a one-byte code page: a lead byte and its continuation bytes."""
    chars = lambda lo, hi: "".join(re.escape(ch) for ch, b in BYTES[codec].items() if lo <= b <= hi)
    more = chars(0x80, 0xBF)
    return re.compile(f"[{chars(0xC2, 0xDF)}][{more}]|[{chars(0xE0, 0xEF)}][{more}]{{2}}")


U8 = {c: _units(c) for c in ("cp1252", "mac_roman", "cp437", "cp1251")}
MARKED = "ùøûõïåäëüáàâãéèêÙØÛÕÏÅÄËÜÁÀÂÃÉÈÊ"
#: How text falls into units under ciphers of letters: one character for a letter, or a vowel and a following mark.
LETTERWISE = {
    "mono": re.compile("[¡-®µ-ÿ]"),
    "vowel_mark": re.compile(f"[aeiouyôöAEIOUYÔÖ][{MARKED}]|[ñöôæóòîíìÑÖÔÆÓÒÎÍÌ]"),
    "vowel_tone": re.compile("[aăâeêioôơuưyãõýAĂÂEÊIOÔƠUƯYÃÕÝ][ìÌòÒÞþ]|[ðÐýÝõÕãÃ]"),
}
CIPHERS = {f"utf8_as_{c}": p for c, p in U8.items()} | LETTERWISE
TYPICAL = {
    "mono": re.compile(rf"[¡-¬®¯´-¾]|(?<=[a-z])[{UP}×Þ]|(?<=[A-Z])[{UP}](?=[a-z])|[A-Za-z]?[ÄÅÆÇËÎÏÑÖÜßäåæëîïñöûüþÿ÷](?=[a-z ]|$)"),
    "vowel_mark": re.compile("[aeiouyôöAEIOUYÔÖ][ùøûõïåäëüØÛÏÅÄËÜ]|[aeAE][áàâãéèê]|[oO][âêäå]|[ñöÑÖ]"),
    "vowel_tone": re.compile(f"[{VOWELS}AEOUYIÂĂÊÔƠƯ][ìÌòÒÞ]|[ðÐ](?=[{VOWELS}a-z])|ýõ"),
}
#: Letters that a unit may stand for; the bigrams around decide among them.
CHOICES = 5
TOKEN = re.compile(r"[^\s!-/:-@\[-`{-~]+|[^\s]*[\x80- ­][^\s]*")
BLANK = re.compile(r"[ \t\r\n]+")
NEUTRAL = set("²³×Ø°±–—“”‘’•…®©")
GOOD = set("²³×Ø°±–—“”‘’•…®©çÇ")
CJK = re.compile("[⺀-鿿豈-﫿가-힯︰-﹏ヽ゛]")


def _exact(text: str, codec: str) -> str:
    """``_decoded`` with a cache for texts of usual length."""
    return (_decoded if len(text) <= 2_000 else _decoded.__wrapped__)(text, codec)


@lru_cache(50_000)
def _decoded(text: str, codec: str) -> str:
    """Every unit of UTF-8 read as ``codec`` decoded from its bytes; the rest stays."""
    table = BYTES[codec]

    def one(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]

    return U8[codec].sub(one, text)


def _wide(text: str) -> str | None:
    """UTF-8 bytes read in a double-byte code page, decoded exactly; None if it doesn't come out as letters."""
    for codec in ("gb18030", "cp950"):
        try:
            raw = text.replace("�", "?").encode(codec, "replace")
        except UnicodeError:
            continue
        out = raw.decode("utf-8", "replace")
        good = sum(c in VIET for c in out)
        if good and not CJK.search(out) and good >= 0.5 * len(CJK.findall(text)):
            return out
    return None


def cipher_of(text: str) -> str | None:
    """The cipher whose units explain most of the text's unusual characters; None if none does."""
    best, most = None, 0
    for name, units in U8.items():
        n = sum(len(m) for m in units.findall(text))
        if n > most:
            best, most = f"utf8_as_{name}", n
    if most >= 2:
        return best
    for name, typical in TYPICAL.items():
        n = 2 * len(typical.findall(text))
        if n > most:
            best, most = name, n
    return best


def unit_contexts(text: str, cipher: str) -> Iterator[tuple[str, str, str]]:
    """(left, unit, right) for each unit; a neighbour is a lower-case letter, '#' a digit, '' neither, or another unit."""
    parts: list[tuple[bool, str]] = []
    at = 0
    for m in CIPHERS[cipher].finditer(text):
        parts += [(False, c) for c in text[at : m.start()]] + [(True, m[0])]
        at = m.end()
    parts += [(False, c) for c in text[at:]]

    def side(i: int) -> str:
        if not 0 <= i < len(parts):
            return ""
        unit, c = parts[i]
        return "=" + c if unit else "#" if c.isdigit() else c.lower() if c.lower() in INDEX else ""

    for i, (unit, c) in enumerate(parts):
        if unit:
            yield side(i - 1), c, side(i + 1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigrams of the clean texts ('lm' rows) and unit contexts of the others, counted over the partition."""
    pairs = np.zeros(A * A, np.int64)
    found: Counter = Counter()
    for pdf in batches:
        texts = pdf["text"].dropna()
        odd = finder().find(texts.tolist())
        clean = "\n".join(texts[~odd]) + "\n"
        code = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.where(code < 0x2000, LOOKUP[np.minimum(code, 0x1FFF)], 0)
        pairs += np.bincount(at[:-1] * A + at[1:], minlength=A * A)
        for t in texts[odd]:
            name = cipher_of(t)
            if name == "utf8_as_cp1252" and U8["cp1252"].search(inner := _exact(t, "cp1252")):
                t = inner
            if name:
                found.update((name, *c) for c in unit_contexts(t, name))
    rows = [(c, "lm", str(k // A), "", str(k % A), int(pairs[k])) for k in np.flatnonzero(pairs) for c in CIPHERS]
    rows += [(c, "unit", l, u, r, n) for (c, l, u, r), n in found.items()]
    yield pd.DataFrame(rows, columns=["cipher", "what", "l", "u", "r", "n"])


def _em(pdf: pd.DataFrame, rounds: int = 30) -> pd.DataFrame:
    """Expectation-maximisation for one cipher: P(letter | unit) from contexts and bigrams (counts, bounded by the alphabets)."""
    cipher = pdf["cipher"].iloc[0]
    lm = pdf[pdf["what"] == "lm"]
    table = np.full((A, A), 0.02)
    np.add.at(table, (lm["l"].astype(int).to_numpy(), lm["r"].astype(int).to_numpy()), lm["n"].to_numpy(float))
    given = table / table.sum(1, keepdims=True)
    out = [(cipher, "lm", l, "", r, float(n)) for l, r, n in zip(lm["l"], lm["r"], lm["n"], strict=True)] if cipher == next(iter(CIPHERS)) else []
    ctx = pdf[pdf["what"] == "unit"]
    if len(ctx):
        units = sorted(set(ctx["u"]) | {x[1:] for s in ("l", "r") for x in ctx[s] if x[:1] == "="})
        where = {u: i for i, u in enumerate(units)}
        u = ctx["u"].map(where).to_numpy()
        n = ctx["n"].to_numpy(float)
        code = lambda x: -1 - where[x[1:]] if x[:1] == "=" else 1 if x == "#" else INDEX.get(x, 0)
        left, right = ctx["l"].map(code).to_numpy(), ctx["r"].map(code).to_numpy()
        may = np.zeros(A)
        may[[INDEX[c] for c in ACCENTED]] = 1
        theta = np.tile(may / may.sum(), (len(units), 1))
        prior = table.sum(1) / table.sum()
        theta = theta * prior
        theta /= theta.sum(1, keepdims=True)
        weight = np.bincount(u, n, len(units))
        upper = np.array([x[0].isupper() and cipher != "mono" for x in units], bool)
        for step in range(rounds):
            ahead, behind = theta @ given, given @ theta.T
            pl = np.where((left < 0)[:, None], ahead[np.where(left < 0, -1 - left, 0)], given[np.maximum(left, 0)])
            pr = np.where((right < 0)[:, None], behind.T[np.where(right < 0, -1 - right, 0)], given.T[np.maximum(right, 0)])
            post = theta[u] * pl * pr + 1e-300
            post *= (n / post.sum(1))[:, None]
            theta = np.full_like(theta, 1e-6) * may
            np.add.at(theta, u, post)
            theta /= theta.sum(1, keepdims=True) + 1e-300
            if step >= rounds // 3:  # a cipher seldom has two units for one letter: units of one case compete for it
                mass = theta * weight[:, None]
                for case in (True, False):
                    own = upper == case
                    if own.any():
                        theta[own] *= (mass[own] + 1e-9) / (mass[own].sum(0, keepdims=True) + 1e-9)
                theta /= theta.sum(1, keepdims=True) + 1e-300
        best = np.argsort(-theta, 1)[:, :CHOICES]
        out += [(cipher, "unit", x, LETTERS[b - 2], str(int(w)), float(theta[i, b])) for i, (x, bs, w) in enumerate(zip(units, best, weight, strict=True)) for b in bs if b >= 2 and theta[i, b] >= 0.01]
    return pd.DataFrame(out, columns=["cipher", "what", "l", "u", "r", "p"])


class Repairer(Once):
    """Deciphers single texts with a learnt mapping. It holds the bigram counts and, per cipher, unit → (letter, probability)."""

    def __init__(self, rows: list[tuple], sure: float = 0.45):
        self.args = (rows, sure)
        self.sure = sure
        self.count = np.zeros((A, A))
        self.map: dict[str, dict[str, tuple[str, float]]] = {c: {} for c in CIPHERS}
        self.choices: dict[str, dict[str, list[tuple[str, float]]]] = {c: {} for c in CIPHERS}
        for cipher, what, l, u, r, p in rows:
            if what == "lm":
                self.count[int(l), int(r)] = p
            else:
                self.choices[cipher].setdefault(l, []).append((u, p))
        for cipher, units in self.choices.items():
            for unit, ls in units.items():
                ls.sort(key=lambda x: (-x[1], x[0]))
                self.map[cipher][unit] = ls[0]
        smooth = self.count + 0.05
        self.given = np.log(smooth / smooth.sum(1, keepdims=True))
        total = self.count.sum(0, keepdims=True) + 1
        #: A bigram is known if it makes up a share of its rarer letter's occurrences that chance spelling slips don't reach.
        self.known = self.count >= np.maximum(3, 2e-4 * np.minimum(self.count.sum(1, keepdims=True) + 1, total))
        self.repair = bounded(self._repair)

    def strange(self, word: str) -> int:
        """Number of neighbouring characters, one of them not ASCII, that clean text doesn't have."""
        at = [0, *(INDEX.get(c, 1 if c.isdigit() else 0) for c in word.lower()), 0]
        ascii_ = [True, *(c.isascii() or c in NEUTRAL for c in word), True]
        bad = sum(1 for i, c in enumerate(word) if not c.isascii() and c not in VIET and not (c in NEUTRAL and not (c in "×®©" and (word[i + 1 : i + 2].islower() or word[i - 1 : i].islower() and i))))
        bad += sum(1 for i in range(len(word) - 1) if word[i].islower() and word[i + 1] in UP)
        return bad + sum(1 for i in range(len(at) - 1) if not (ascii_[i] and ascii_[i + 1]) and not self.known[at[i], at[i + 1]])

    def decipher(self, word: str, cipher: str) -> str | None:
        """The word with every unit replaced by its most likely letter; None if a unit is unknown or unsure."""
        table = self.map[cipher]
        missing = False

        def one(m: re.Match) -> str:
            nonlocal missing
            letter, p = table.get(m[0], ("", 0.0))
            if not letter or p < self.sure:
                missing = True
                return m[0]
            around = word[max(0, m.start() - 1) : m.start()] + word[m.end() : m.end() + 1]
            return letter.upper() if m[0][0].isupper() and cipher == "vowel_mark" or around.isupper() and around.isascii() else letter

        out = CIPHERS[cipher].sub(one, word)
        if missing or out == word:
            return None
        likely = self.likeliest(word, cipher)
        return likely if likely and self.strange(likely) <= self.strange(out) else out

    def likeliest(self, word: str, cipher: str) -> str | None:
        """The likeliest letters for the word's units under unit probabilities and bigrams together (Viterbi)."""
        parts: list[list[tuple[str, float]]] = []
        at = 0
        for m in CIPHERS[cipher].finditer(word):
            parts += [[(c, 0.0)] for c in word[at : m.start()]]
            upper = m[0][0].isupper() and cipher == "vowel_mark" or (around := word[max(0, m.start() - 1) : m.start()] + word[m.end() : m.end() + 1]).isupper() and around.isascii()
            parts.append([(l.upper() if upper else l, float(np.log(p))) for l, p in self.choices[cipher].get(m[0], [])])
            at = m.end()
        parts += [[(c, 0.0)] for c in word[at:]]
        code = lambda c: INDEX.get(c.lower(), 1 if c.isdigit() else 0)
        paths = [(0.0, "", 0)]
        for options in [*parts, [("", 0.0)]]:
            paths = [max(((s + self.given[last, code(c) if c else 0] + e, done + c, code(c) if c else 0) for s, done, last in paths), key=lambda x: x[0]) for c, e in options]
            if not paths:
                return None
        return max(paths)[1]

    def _undo(self, text: str, cipher: str) -> str | None:
        """The text with UTF-8 units deciphered, twice if it was garbled twice; None if fewer than half of the units come out as letters.

        The letter of a unit is the learnt one; where its bytes decode to another one or it was too rare to learn, the bytes decide."""
        codec, best, now = cipher[8:], None, text
        for _ in range(2):
            units = U8[codec].findall(now)
            if not units:
                break
            new = U8[codec].sub(lambda m: self._unit(m[0], codec), now)
            good = sum(len(d) == 1 and (d in VIET or "Ѐ" <= d <= "ӿ" or d in GOOD) for d in (self._unit(u, codec) for u in units))
            if good >= 0.5 * len(units):
                best = new
            now = new
        return best

    def _unit(self, unit: str, codec: str) -> str:
        exact = _exact(unit, codec)
        learnt, p = self.map[f"utf8_as_{codec}"].get(unit, ("", 0.0))
        return learnt if exact == unit and p >= 0.95 else exact

    def _repair(self, text: str) -> tuple[str, str] | None:
        """(restored text, kind of damage) or None for a text that isn't damaged; kind 'lost' means characters are gone."""
        name = cipher_of(text)
        out, kind = text, None
        if name and name.startswith("utf8_as_") and (exact := self._undo(text, name)):
            out, kind = exact, name
        if kind is None and CJK.search(text) and (wide := _wide(text)):
            out, kind = wide, "utf8_as_double_byte"
        if kind is None:
            done: list[str] = []
            for name in ([name] if name in LETTERWISE else []) + [c for c in LETTERWISE if c != name]:
                if not TYPICAL[name].search(text):
                    continue
                parts, hits = [], 0
                for piece in re.split(r"([\s!-/:-@\[-`{-~]+)", text):
                    if piece.isascii() or not (before := self.strange("Đ" + piece[1:] if piece[0] == "Ð" else piece)):
                        parts.append(piece)
                        continue
                    new = self.decipher(piece, name)
                    if name == "vowel_tone":  # this swap is a codec pair, so its bytes can be asked
                        try:
                            exact = unicodedata.normalize("NFC", piece.encode("cp1252").decode("cp1258"))
                            new = exact if not self.strange(exact) or new is None else new
                        except UnicodeError:
                            pass
                    if new and not self.strange(new) and before and any(c in VIET for c in new):
                        parts.append(new)
                        hits += 1
                    else:
                        parts.append(piece)
                if hits and (not done or hits > int(done[2])):
                    done = ["".join(parts), name, str(hits)]
            if done:
                out, kind = done[0], done[1]
            elif any(self.strange(w) and sum(len(t.findall(w)) for t in TYPICAL.values()) >= 2 for w in BLANK.split(text) if not w.isascii()):
                kind = "undeciphered"
        if LOST.search(out) or "�" in text:
            return out, (kind + "+lost" if kind else "lost")
        return (out, kind) if kind else None


def fit(texts: DataFrame, column: str = "text") -> Repairer:
    """Learns bigrams and ciphers from every row of ``texts`` in one pass; what comes back to the driver is bounded by the alphabets."""
    rows = (
        texts.select(F.col(column).alias("text"))
        .mapInPandas(_count, "cipher string, what string, l string, u string, r string, n long")
        .groupBy("cipher", "what", "l", "u", "r")
        .agg(F.sum("n").alias("n"))
        .groupBy("cipher")
        .applyInPandas(lambda pdf: _em(pdf), "cipher string, what string, l string, u string, r string, p double")
        .collect()
    )
    return Repairer([tuple(r) for r in rows])


def repair(df: DataFrame, column: str, repairer: Repairer) -> DataFrame:
    """Adds ``restored`` and ``damage`` (null: not damaged) for the given text column; other columns stay as they are."""

    @F.pandas_udf("struct<restored string, damage string>")
    def run(s: pd.Series) -> pd.DataFrame:
        texts = s.tolist()
        out = [repairer.repair(t) if odd else None for t, odd in zip(texts, finder().find(texts), strict=True)]
        return pd.DataFrame({"restored": [o[0] if o else None for o in out], "damage": [o[1] if o else None for o in out]})

    got = "__repaired"
    return df.withColumn(got, run(F.col(column))).withColumn("restored", F.coalesce(F.col(f"{got}.restored"), F.col(column))).withColumn("damage", F.col(f"{got}.damage")).drop(got)


def damaged(df: DataFrame, column: str, repairer: Repairer) -> DataFrame:
    """Only the damaged rows, with ``restored`` and ``damage``; the others are found and dropped a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[finder().find(pdf[column].tolist())]
            out = [repairer.repair(t) for t in pdf[column]]
            hit = np.array([o is not None for o in out], bool)
            if hit.any():
                yield pdf[hit].assign(restored=[o[0] for o in out if o], damage=[o[1] for o in out if o])

    kept = df.drop("restored", "damage")
    return kept.mapInPandas(run, kept.schema.simpleString()[7:-1] + ",restored:string,damage:string")
