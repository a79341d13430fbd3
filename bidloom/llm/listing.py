"""What a catalogue listing says of its product: identifiers and measured attributes, in one form whatever the wording."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from bidloom.functions.fold import bare
from bidloom.llm import garbled

#: Repairs reversible garbling only (no learnt mapping is needed to read numbers and units).
EXACT = garbled.Repairer([])
ODD = re.compile(f"[^\\x00-\\x7F{garbled.V}²³×Ø°±©®–]")
POWERS = str.maketrans({"²": "2", "³": "3", "×": "x", "^": None, "Ø": " ", "®": " ", "©": " ", "±": " ", "°": " ", "–": "-"})
#: A run of letters and digits, with single signs inside; one of both, changing often enough, is a part number.
RUN = re.compile(r"[a-z0-9]+(?:[-./][a-z0-9]+)*")
GROUPS = re.compile(r"[a-z]+|\d+")
#: A number with a unit, a number, a word: what measures are made of, and part numbers aren't alone.
MEASURE = re.compile(r"\d+(?:[a-z]{1,3}\d?)?|[a-z]+")
#: Sides of a thing, as 20x30x2cm; a word, a number and a group of a letter and digits, as in "mc 719 x16b".
SIDES = re.compile(r"\d+(?:[.,]\d+)?[a-z]{0,2}(?:x\d+(?:[.,]\d+)?[a-z]{0,3}\d?)+")
SPACE_BETWEEN = re.compile(r" \d{2,6} [a-z]\d{2,4}[a-z]?(?![a-z0-9])")  # whatever SPACED finds has this
SPACED = re.compile(r"(?<![a-z0-9])[a-z]{1,4} \d{2,6} ([a-z]\d{2,4}[a-z]?)(?![a-z0-9])")
#: What part numbers are introduced with, groups with blanks between, and ones that make up a stretch between signs.
LABEL = re.compile(r"(?<![a-z0-9])(?:ma(?: hieu| so| hang| sp)?|ky hieu|model|type|p/?n|part (?:no|number)|ref|series|sku|art(?:icle)?)\b\s*[.:=#]?\s*")
GROUPED = re.compile(r"[a-z0-9]{1,6}(?: [a-z0-9]{1,6}){1,5}(?![a-z0-9])")
#: A stretch, and what stands before one; no group but the first is a word, as ``groups_of`` has it.
STRETCH = r" ?([a-z][a-z0-9]{0,3}(?: (?![a-z]{2,6}(?![a-z0-9]))[a-z0-9]{1,6}){1,5}) ?(?=[;()\[\]|,]| - |$)"
WHOLE_FIRST, WHOLE = re.compile(STRETCH), re.compile(r"[;()\[\]|,-](?:(?<=[;()\[\]|])|(?<=,) |(?<= -) )" + STRETCH)
#: Letters, digits and groups that a part number has at least, and characters at most.
LEAST_LETTERS, LEAST_DIGITS, LEAST_GROUPS, LONGEST = 2, 3, 3, 24
GTIN = re.compile(r"(?<!\d)(\d{8}|\d{12,14})(?!\d)")
# Units of measured attributes, their kind, and their size in SI units.
UNITS = {
    "length": {"mm": 1e-3, "cm": 1e-2, "dm": 0.1, "m": 1.0, "met": 1.0, "km": 1e3, "inch": 0.0254},
    "area": {"mm2": 1e-6, "cm2": 1e-4, "m2": 1.0}, "volume": {"m3": 1.0, "l": 1e-3, "lit": 1e-3, "liter": 1e-3, "ml": 1e-6, "dm3": 1e-3},
    "mass": {"kg": 1.0, "g": 1e-3, "gam": 1e-3, "tan": 1e3, "t": 1e3, "mg": 1e-6}, "power": {"w": 1.0, "kw": 1e3, "mw": 1e6, "hp": 745.7},
    "apparent": {"va": 1.0, "kva": 1e3, "mva": 1e6}, "pressure": {"pa": 1.0, "kpa": 1e3, "mpa": 1e6, "bar": 1e5, "mbar": 100.0, "n/mm2": 1e6, "kgf/cm2": 98066.5},
    "flow": {"m3/h": 1.0, "m3/gio": 1.0, "cmh": 1.0, "l/h": 1e-3, "lit/h": 1e-3, "l/s": 3.6, "m3/s": 3600.0, "l/phut": 0.06, "m3/phut": 60.0}, "current": {"a": 1.0, "ma": 1e-3, "ka": 1e3}, "voltage": {"v": 1.0, "kv": 1e3},
    "light": {"lm": 1.0, "lumen": 1.0, "klm": 1e3}, "cover": {"m2/l": 1.0, "m2/lit": 1.0}, "speed": {"rpm": 1.0, "v/ph": 1.0, "vong/phut": 1.0}, "sound": {"db": 1.0}, "heat": {"btu": 0.293071, "btu/h": 0.293071, "rt": 3516.85},
}
SIZE = {u: (k, f) for k, us in UNITS.items() for u, f in us.items()}
ANY = "|".join(sorted(map(re.escape, SIZE), key=len, reverse=True))
VALUE = re.compile(rf"(?<![a-z0-9.,/])(?:[a-z]{{0,4}}[=:]?\s?)?(\d+(?:[.,]\d+)?)\s?({ANY})(?![a-z0-9/=])")
NUMBER = r"\d+(?:[.,]\d+)?"
#: The numbers with units that VALUE finds in a text, as a search that begins at digits; the unit is the whole run of signs after a number.
LEADS = "|".join([r"(?<![a-z0-9.,/]\d)", *(rf"(?<=[a-z]{{{n}}}\d)(?<![a-z0-9.,/][a-z]{{{n}}}\d)" for n in range(1, 5))])
MEASURED = re.compile(rf"(\d(?:{LEADS})\d*+(?:[.,]\d++)?+)(?=\s?([a-z][a-z0-9/]*+)(?!=))")
DIMS = re.compile(rf"(?<![\d.,])({NUMBER})\s?(mm|cm|dm|m)?\s?[x*×]\s?({NUMBER})\s?(mm|cm|dm|m)?(?:\s?[x*×]\s?({NUMBER}))?\)?\s?(mm|cm|dm|m)?(?![a-z0-9])")
SIDE = re.compile(r"[x*×]\s?\d")  # whatever DIMS finds has this
# Phrases with numbers that measure nothing of the product: warranties, units of the bill, phases.
NOISE = re.compile(r"bao hanh \d+ thang|(?:dvt|don vi tinh|don vi|unit of measure|unit(?=:)|tinh theo|tinh bang|ghi theo|chao theo)\s*[:=]?\s*[^\];)\n]*|\b\d pha\b|\b[0-9]+ ?phase")
LABELLED_ID = re.compile(r"(?:ean|gtin|upc|barcode|ma vach)\D{0,4}(\d{8}|\d{12,14})(?!\d)")


LITRE, METRE, HOUR = re.compile(r"(?<=\d)\s?l[^\s\d]{1,3}t(?![a-z])"), re.compile(r"(?<=\d)\s?m[^\s\dx]{1,3}t(?![a-z])"), re.compile(r"(?<=[m3l])/gi[^\s\d;,]{0,5}")
TORN, TORN_HOUR = re.compile(r"\d\s?[lm](?!it|et)[^\s\dx]{1,3}t(?![a-z])"), re.compile(r"/gi(?!o(?![a-z]))")


def valid_gtin(digits: str) -> bool:
    """Whether an 8, 12, 13 or 14 digit trade number has the right check digit."""
    if len(digits) not in (8, 12, 13, 14):
        return False
    return sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(reversed(digits))) % 10 == 0


def part_number(text: str) -> str | None:
    """The part number that a text is, without its signs and blanks: letters and digits in at least three groups; no measures."""
    tight = text.replace("-", "").replace(".", "").replace("/", "").replace(" ", "")
    if not 6 <= len(tight) <= LONGEST or not (tight.isascii() and tight.isalnum()):
        return None
    digits = len(tight) - len(tight.encode().translate(None, b"0123456789"))
    if digits < LEAST_DIGITS or len(tight) - digits < LEAST_LETTERS or len(GROUPS.findall(tight)) < LEAST_GROUPS:
        return None
    if VALUE.fullmatch(text) or SIDES.fullmatch(text) or all(MEASURE.fullmatch(p) for p in re.split(r"[-./ ]", text)):
        return None
    return tight


def labelled_measure(group: str) -> bool:
    """A letter, a number and a unit of several letters, as in "c149mm"."""
    m = VALUE.fullmatch(group)
    return m is not None and (len(m[2]) > 1 or group[0].isdigit())


def groups_of(text: str) -> str | None:
    """The groups at the start of a text that may make up a part number: short ones, words only at the start, no measures."""
    groups = text.split()
    some = groups[:1]
    for g in groups[1:]:
        if g.isalpha() and len(g) > 1 or labelled_measure(g) or SIDES.fullmatch(g):
            break
        some.append(g)
    return " ".join(some) if len(some) > 1 and not some[0].isdigit() and len(some[0]) <= 4 else None


def part_numbers(line: str) -> dict[str, str]:
    """Part numbers of a text and how each is written there: runs without blanks anywhere; with blanks where a word, a number and a
    mixed group follow each other, after a label, or as a whole stretch."""
    out: dict[str, str] = {}
    for word in line.split():
        if len(word) >= 6 and not word.isalpha():
            for run in RUN.findall(word):
                if len(run) >= 6 and not run.isalpha() and not run.isdigit() and (found := part_number(run)):
                    out[found] = run
    if SPACE_BETWEEN.search(line) and SPACED.search(line):
        for m in SPACED.finditer(line):
            if not labelled_measure(m[1]) and (found := part_number(m[0])):
                out[found] = m[0]
        return out
    for m in LABEL.finditer(line):
        if (g := GROUPED.match(line, m.end())) and (text := groups_of(g[0])) and (found := part_number(text)):
            out[found] = text
    first = WHOLE_FIRST.match(line)
    for m in chain([first] if first else [], WHOLE.finditer(line, first.end() if first else 0)):
        if (text := groups_of(m[1])) == m[1] and (found := part_number(text)):
            out[found] = text
    return out


def measured(line: str) -> Iterator[tuple[str, str, int]]:
    """(number, unit, place of the unit) of the measures in a text, as VALUE finds them from left to right."""
    if not line.isascii():  # digits of other scripts: signs before and after a number are then told apart by VALUE only
        yield from ((m[1], m[2], m.start(2)) for m in VALUE.finditer(line))
        return
    end = -1
    for m in MEASURED.finditer(line):
        if m.start() > end and m[2] in SIZE:
            end = m.end(2)
            yield m[1], m[2], m.start(2)


def noisy(line: str) -> bool:
    """Whether NOISE may find something: all that it finds has one of these."""
    return "bao hanh" in line or "dvt" in line or "don vi" in line or "unit" in line or " theo" in line or "tinh bang" in line or " pha" in line or "phase" in line


def rounded(x: float) -> str:
    return f"{x:.5g}"


def describe(name: str | None, material: str | None, code: str | None) -> tuple[str | None, str | None]:
    """``_describe`` with a cache for texts of usual length."""
    return (_kept if len(name or "") + len(material or "") + len(code or "") <= 2_000 else _describe)(name, material, code)


def _describe(name: str | None, material: str | None, code: str | None) -> tuple[str | None, str | None]:
    """(identifier, attributes) of a listing; None for what it doesn't tell.

    The identifier is a check-digit-valid trade number or else the maker's part number without separators. The attributes are
    the sorted multiset of measured values in SI units, so neither unit nor order nor label wording matters."""
    text = " ; ".join(t for t in (name, material, code) if t)
    odd = not text.isascii() and ODD.search(text)
    if odd:
        like = garbled.cipher_of(text)
        for cipher in ("utf8_as_cp1252", "utf8_as_mac_roman", "utf8_as_cp437", "utf8_as_cp1251"):
            if like == cipher and (fixed := EXACT._undo(text, cipher)):
                text, like = fixed, garbled.cipher_of(fixed)
        if garbled.CJK.search(text) and (fixed := garbled._wide(text)):
            text = fixed
    if text.isascii():
        line = text.lower().replace("^", "")
    elif odd:
        line = bare.__wrapped__(text.translate(POWERS))
    else:  # the same by C functions: nothing here but Vietnamese letters and the usual signs
        line = text.lower().replace("đ", "d").replace("²", "2").replace("³", "3").replace("×", "x").replace("ø", " ").replace("^", "").replace("–", "-")
        line = unicodedata.normalize("NFD", line).encode("ascii", "ignore").decode()
    if TORN.search(line) or "/gi" in line and TORN_HOUR.search(line):  # letters of units may be lost or changed
        line = LITRE.sub("lit", METRE.sub("m", HOUR.sub("/gio", line)))
    found: str | None = None
    if ("ean" in line or "gtin" in line or "upc" in line or "barcode" in line or "ma vach" in line) and (m := LABELLED_ID.search(line)):
        found = "gtin:" + m[1].lstrip("0") if valid_gtin(m[1]) else None
    if found is None and code and (m := GTIN.fullmatch(code.strip())) and valid_gtin(m[1]):
        found = "gtin:" + m[1].lstrip("0")
    parts = part_numbers(line)
    if found is None and len(parts) == 1:
        found = next(iter(parts))
    elif found is None and parts:
        found = "?" + min(parts)
    for written in parts.values():
        line = line.replace(written, " ")
    if noisy(line):
        line = NOISE.sub(" ", line)
    values: list[tuple[str, float]] = []

    def dims(m: re.Match) -> str:
        numbers = [m[1], m[3], *([m[5]] if m[5] else [])]
        given = [m[2], m[4], *([m[6]] if m[5] else [])]
        last = m[6] or m[4] or m[2] or "mm"
        for n, u in zip(numbers, given, strict=False):
            values.append(("length", float(n.replace(",", ".")) * UNITS["length"][u or last]))
        return " "

    if SIDE.search(line):
        line = DIMS.sub(dims, line)
    for number, unit, at in measured(line):
        if line[at - 1] == " " and (unit in ("t", "v") or unit == "ma" and len(number) < 3):
            continue  # a word: "loại 1 mã …"
        kind, size = SIZE[unit]
        values.append((kind, float(number.replace(",", ".")) * size))
    return found, "|".join(sorted(f"{k}:{rounded(v)}" for k, v in values)) or None


_kept = lru_cache(20_000)(_describe)
