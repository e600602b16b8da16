"""Double Metaphone (L. Philips, 2000) over batches of strings.

Strings are read as UTF-8 bytes, upper-cased in ASCII.  The second code is the
first where a word has no alternative.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest code.
LONGEST = 32
_VOWELS = frozenset("AEIOUY")
_SILENT_STARTS = ("GN", "KN", "PN", "WR", "PS")
#: Letters with one sound of their own; a doubled letter is skipped.
_PLAIN = {"B": "P", "F": "F", "K": "K", "N": "N", "Q": "K", "V": "F"}


class _Word:
    """A word and the questions that the rules ask about places in it."""

    def __init__(self, text: str):
        raw = text.encode("utf-8", "surrogatepass").upper().decode("latin-1")
        self.size = len(raw)
        self.last = self.size - 1
        self.text = raw + " " * 8
        self.slavic = any(s in raw for s in ("W", "K", "CZ", "WITZ"))
        self.germanic = self.text.startswith(("VAN ", "VON ", "SCH"))

    def at(self, place: int, *options: str) -> bool:
        return 0 <= place < len(self.text) and self.text.startswith(options, place)

    def letter(self, place: int) -> str:
        return self.text[place] if 0 <= place < len(self.text) else ""

    def vowel(self, place: int) -> bool:
        return self.letter(place) in _VOWELS and self.letter(place) != ""


# Every rule takes a word and a place, and gives (first code, second code or None, letters to move on).


def _c(w: _Word, i: int):
    if i > 1 and not w.vowel(i - 2) and w.at(i - 1, "ACH") and w.letter(i + 2) != "I" and (w.letter(i + 2) != "E" or w.at(i - 2, "BACHER", "MACHER")):
        return "K", None, 2
    if i == 0 and w.at(i, "CAESAR"):
        return "S", None, 2
    if w.at(i, "CHIA"):
        return "K", None, 2
    if w.at(i, "CH"):
        return _ch(w, i)
    if w.at(i, "CZ") and not w.at(i - 2, "WICZ"):
        return "S", "X", 2
    if w.at(i + 1, "CIA"):
        return "X", None, 3
    if w.at(i, "CC") and not (i == 1 and w.letter(0) == "M"):
        if w.at(i + 2, "I", "E", "H") and not w.at(i + 2, "HU"):
            hard = (i == 1 and w.letter(0) == "A") or w.at(i - 1, "UCCEE", "UCCES")
            return ("KS" if hard else "X"), None, 3
        return "K", None, 2
    if w.at(i, "CK", "CG", "CQ"):
        return "K", None, 2
    if w.at(i, "CI", "CE", "CY"):
        return "S", ("X" if w.at(i, "CIO", "CIE", "CIA") else None), 2
    if w.at(i + 1, " C", " Q", " G"):
        return "K", None, 3
    if w.at(i + 1, "C", "K", "Q") and not w.at(i + 1, "CE", "CI"):
        return "K", None, 2
    return "K", None, 1


def _ch(w: _Word, i: int):
    if i > 0 and w.at(i, "CHAE"):
        return "K", "X", 2
    if i == 0 and w.at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not w.at(0, "CHORE"):
        return "K", None, 2
    greek = w.germanic or w.at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or w.at(i + 2, "T", "S")
    if greek or ((i == 0 or w.at(i - 1, "A", "O", "U", "E")) and w.at(i + 2, *"LRNMBHFVW ")):
        return "K", None, 2
    if i == 0:
        return "X", None, 2
    return ("K", None, 2) if w.at(0, "MC") else ("X", "K", 2)


def _d(w: _Word, i: int):
    if w.at(i, "DG"):
        return ("J", None, 3) if w.at(i + 2, "I", "E", "Y") else ("TK", None, 2)
    return "T", None, 2 if w.at(i, "DT", "DD") else 1


def _g(w: _Word, i: int):
    following = w.letter(i + 1)
    if following == "H":
        return _gh(w, i)
    if following == "N":
        if i == 1 and w.vowel(0) and not w.slavic:
            return "KN", "N", 2
        if not w.at(i + 2, "EY") and not w.slavic:
            return "N", "KN", 2
        return "KN", None, 2
    if w.at(i + 1, "LI") and not w.slavic:
        return "KL", "L", 2
    if i == 0 and w.at(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
        return "K", "J", 2
    if w.at(i + 1, "ER", "Y") and not w.at(0, "DANGER", "RANGER", "MANGER") and not w.at(i - 1, "E", "I") and not w.at(i - 1, "RGY", "OGY"):
        return "K", "J", 2
    if w.at(i + 1, "E", "I", "Y") or w.at(i - 1, "AGGI", "OGGI"):
        if w.germanic or w.at(i + 1, "ET"):
            return "K", None, 2
        return "J", (None if w.at(i + 1, "IER ") else "K"), 2
    return "K", None, 2 if following == "G" else 1


def _gh(w: _Word, i: int):
    if i > 0 and not w.vowel(i - 1):
        return "K", None, 2
    if i == 0:
        return ("J" if w.letter(2) == "I" else "K"), None, 2
    if any(i > k - 1 and w.at(i - k, *letters) for k, letters in ((2, "BHD"), (3, "BHD"), (4, "BH"))):
        return "", None, 2  # as in "hugh" and "bough"
    if i > 2 and w.letter(i - 1) == "U" and w.at(i - 3, *"CGLRT"):
        return "F", None, 2
    return ("K" if w.letter(i - 1) != "I" else ""), None, 2


def _h(w: _Word, i: int):
    return ("H", None, 2) if (i == 0 or w.vowel(i - 1)) and w.vowel(i + 1) else ("", None, 1)


def _j(w: _Word, i: int):
    saint = w.at(0, "SAN ")
    if w.at(i, "JOSE") or saint:
        return "H" if saint or (i == 0 and w.letter(4) == " ") else "J", "H", 1
    step = 2 if w.letter(i + 1) == "J" else 1
    if i == 0:
        return "J", "A", step
    if w.vowel(i - 1) and not w.slavic and w.letter(i + 1) in ("A", "O"):
        return "J", "H", step
    if i == w.last:
        return "J", "", step
    silent = w.at(i + 1, *"LTKSNMBZ") or w.at(i - 1, "S", "K", "L")
    return "" if silent else "J", None, step


def _l(w: _Word, i: int):
    if w.letter(i + 1) != "L":
        return "L", None, 1
    spanish = (i == w.size - 3 and w.at(i - 1, "ILLO", "ILLA", "ALLE")) or ((w.at(w.last - 1, "AS", "OS") or w.at(w.last, "A", "O")) and w.at(i - 1, "ALLE"))
    return "L", ("" if spanish else None), 2


def _m(w: _Word, i: int):
    dumb = w.at(i - 1, "UMB") and (i + 1 == w.last or w.at(i + 2, "ER"))
    return "M", None, 2 if dumb or w.letter(i + 1) == "M" else 1


def _p(w: _Word, i: int):
    if w.letter(i + 1) == "H":
        return "F", None, 2
    return "P", None, 2 if w.at(i + 1, "P", "B") else 1


def _r(w: _Word, i: int):
    step = 2 if w.letter(i + 1) == "R" else 1
    french = i == w.last and not w.slavic and w.at(i - 2, "IE") and not w.at(i - 4, "ME", "MA")
    return ("", "R", step) if french else ("R", None, step)


def _s(w: _Word, i: int):
    if w.at(i - 1, "ISL", "YSL"):
        return "", None, 1
    if i == 0 and w.at(0, "SUGAR"):
        return "X", "S", 1
    if w.at(i, "SH"):
        return ("S" if w.at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), None, 2
    if w.at(i, "SIO", "SIA"):
        return "S", (None if w.slavic else "X"), 3
    if (i == 0 and w.at(1, "M", "N", "L", "W")) or w.at(i + 1, "Z"):
        return "S", "X", 2 if w.at(i + 1, "Z") else 1
    if w.at(i, "SC"):
        if w.letter(i + 2) == "H":
            if w.at(i + 3, "ER", "EN"):
                return "X", "SK", 3
            if w.at(i + 3, "OO", "UY", "ED", "EM"):
                return "SK", None, 3
            return "X", ("S" if i == 0 and not w.vowel(3) and w.letter(3) != "W" else None), 3
        return ("S" if w.at(i + 2, "I", "E", "Y") else "SK"), None, 3
    step = 2 if w.at(i + 1, "S", "Z") else 1
    return ("", "S", step) if i == w.last and w.at(i - 2, "AI", "OI") else ("S", None, step)


def _t(w: _Word, i: int):
    if w.at(i, "TION", "TIA", "TCH"):
        return "X", None, 3
    if w.at(i, "TH", "TTH"):
        return ("T", None, 2) if w.at(i + 2, "OM", "AM") or w.germanic else ("0", "T", 2)
    return "T", None, 2 if w.at(i + 1, "T", "D") else 1


def _w(w: _Word, i: int):
    if w.at(i, "WR"):
        return "R", None, 2
    first = second = ""
    if i == 0 and (w.vowel(1) or w.at(0, "WH")):
        first, second = "A", ("F" if w.vowel(1) else "A")
    if (i == w.last and w.vowel(i - 1)) or w.at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.at(0, "SCH"):
        return first, second + "F", 1
    if w.at(i, "WICZ", "WITZ"):
        return first + "TS", second + "FX", 4
    return first, second, 1


def _x(w: _Word, i: int):
    if i == 0:
        return "S", None, 1
    french = i == w.last and (w.at(i - 3, "IAU", "EAU") or w.at(i - 2, "AU", "OU"))
    return "" if french else "KS", None, 2 if w.at(i + 1, "C", "X") else 1


def _z(w: _Word, i: int):
    if w.letter(i + 1) == "H":
        return "J", None, 2
    step = 2 if w.letter(i + 1) == "Z" else 1
    italian = w.at(i + 1, "ZO", "ZI", "ZA") or (w.slavic and i > 0 and w.letter(i - 1) != "T")
    return "S", ("TS" if italian else None), step


_RULES = {"C": _c, "D": _d, "G": _g, "H": _h, "J": _j, "L": _l, "M": _m, "P": _p, "R": _r, "S": _s, "T": _t, "W": _w, "X": _x, "Z": _z, "\xc7": lambda w, i: ("S", None, 1), "\xd1": lambda w, i: ("N", None, 1)}


def codes(text: str) -> tuple[str, str]:
    """The two codes of a string."""
    w = _Word(text)
    i = 1 if w.at(0, *_SILENT_STARTS) else 0
    first: list[str] = []
    second: list[str] = []
    while i < w.size:
        letter = w.letter(i)
        if letter in _VOWELS:
            a, b, step = ("A" if i == 0 else ""), None, 1
        elif letter in _PLAIN:
            a, b, step = _PLAIN[letter], None, 2 if w.letter(i + 1) == letter else 1
        elif letter in _RULES:
            a, b, step = _RULES[letter](w, i)
        else:
            a, b, step = "", None, 1
        first.append(a)
        second.append(a if b is None else b)
        i += step
    return "".join(first)[:LONGEST], "".join(second)[:LONGEST]


def _code_lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, tuple[str, str]] = {}

    def of(words):
        out: dict[str, None] = {}
        for word in words if words is not None else ():
            if word is None:
                continue
            if word not in known:
                if len(known) > 200_000:
                    known.clear()
                known[word] = codes(word)
            out.update((c, None) for c in known[word] if c)
        return list(out)

    for batch in batches:
        yield batch.map(of, na_action=None)


def double_metaphone(words: Column) -> Column:
    """Distinct non-empty codes of all strings in an array."""
    return F.pandas_udf(_code_lists, "array<string>")(words)
