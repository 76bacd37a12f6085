"""What letters say about the language or script of a text: the cost that legacy decodings have to lower.

A language is told by its letters beyond ASCII. The cost of a text under a language is the negative log-likelihood of
those letters and of the number of ASCII letters beside them; a text costs what its best language costs. A run of
characters under a script costs the mean number of bits of its letters a byte.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from math import log, log2

# Shares of the letters beyond ASCII in running text, in per mille of all letters.
LANGUAGES: dict[str, dict[str, float]] = {
    "fr": {"é": 19, "à": 4.9, "è": 2.7, "ê": 2.2, "ç": 0.85, "â": 0.5, "î": 0.45, "ô": 0.23, "û": 0.6, "ù": 0.58, "œ": 0.18, "ï": 0.05, "ë": 0.01},
    "de": {"ä": 5.8, "ö": 4.4, "ü": 9.9, "ß": 3.1},
    "es": {"á": 5, "é": 4.3, "í": 7.2, "ó": 8.3, "ú": 1.7, "ñ": 3.1, "ü": 0.1},
    "pt": {"ã": 7.3, "á": 1.2, "é": 3.4, "ê": 4.5, "ç": 5.3, "í": 1.3, "ó": 3, "õ": 0.4, "ú": 2, "à": 0.7, "â": 0.6, "ô": 0.6},
    "it": {"à": 6.3, "è": 2.6, "ò": 2, "ù": 1.7, "ì": 0.3, "é": 0.13},
    "da": {"æ": 8.7, "ø": 9.4, "å": 11.9, "é": 0.1},
    "sv": {"å": 13.4, "ä": 18, "ö": 13, "é": 0.1},
    "is": {"á": 18, "é": 6.5, "í": 15.7, "ó": 9.9, "ú": 6.1, "ý": 2.3, "ð": 43.9, "þ": 14.6, "æ": 8.7, "ö": 7.8},
    "en": {"é": 0.5, "ï": 0.1, "ç": 0.05, "ê": 0.05, "è": 0.05, "ñ": 0.05, "ö": 0.05, "ü": 0.05, "á": 0.05, "ô": 0.02},
    "pl": {"ą": 7, "ć": 4.5, "ę": 10, "ł": 21, "ń": 3.6, "ó": 11, "ś": 8.1, "ź": 0.8, "ż": 7.1},
    "cs": {"á": 8.7, "č": 4.6, "ď": 0.15, "é": 6.3, "ě": 12.2, "í": 16.4, "ň": 0.07, "ó": 0.24, "ř": 3.8, "š": 3.2, "ť": 0.06, "ú": 0.45, "ů": 2, "ý": 9.9, "ž": 7.2},
    "hu": {"á": 34, "é": 38, "í": 6, "ó": 10, "ö": 8, "ő": 9, "ú": 2.4, "ü": 6, "ű": 2},
    "ro": {"ă": 40, "â": 9, "î": 14, "ş": 15, "ș": 15, "ţ": 10, "ț": 10},
    "tr": {"ı": 51, "ğ": 11, "ş": 18, "ç": 12, "ö": 7.8, "ü": 18.5, "â": 0.1},
    "hr": {"č": 13, "ć": 8, "đ": 3, "š": 11, "ž": 6},
}
# Shares of letters in per mille; Russian in order of the alphabet with ё last, Greek with accented letters by the plain ones.
RUSSIAN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", (80, 16, 45, 17, 30, 85, 9, 17, 74, 12, 35, 44, 32, 67, 110, 28, 47, 55, 63, 26, 3, 10, 5, 14, 7, 4, 1, 19, 17, 3, 6, 20, 1), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", (105, 7, 16, 18, 73, 4, 45, 12, 72, 42, 29, 35, 67, 5, 82, 40, 42, 40, 41, 79, 38, 9, 12, 2, 17), strict=True))
GREEK |= {"ά": 15, "έ": 12, "ή": 12, "ί": 20, "ό": 16, "ύ": 8, "ώ": 8, "ϊ": 0.3, "ϋ": 0.1}
HEBREW = dict(zip("אבגדהוזחטיךכלםמןנסעףפץצקרשת", (49, 48, 13, 26, 109, 100, 13, 25, 12, 110, 8, 21, 74, 31, 47, 13, 28, 15, 32, 2, 17, 1, 12, 21, 56, 44, 50), strict=True))
ARABIC = dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهويةىءأإآؤئ", (116, 36, 38, 5, 14, 19, 9, 27, 8, 44, 6, 26, 10, 9, 6, 12, 2, 36, 5, 29, 25, 21, 110, 64, 64, 43, 58, 66, 28, 10, 4, 25, 10, 3, 2, 4), strict=True))
ALPHABETS: dict[str, Mapping[str, float]] = {"russian": RUSSIAN, "greek": GREEK, "hebrew": HEBREW, "arabic": ARABIC}
RARE = 1e-5
# Bits a byte of characters outside a script's letters.
FOREIGN = 14.0

_LETTER = {n: {c: -log(s / 1000) for c, s in t.items()} for n, t in LANGUAGES.items()}
_PLAIN = {n: -log(1 - sum(t.values()) / 1000) for n, t in LANGUAGES.items()}
_BITS = {n: {c: -log2(s / 1000) for c, s in t.items()} for n, t in ALPHABETS.items()}


def language_cost(odd: Counter[str], plain: int) -> float:
    """Cost of letters beyond ASCII (small ones) beside `plain` ASCII letters, under the language that costs least."""
    floor = -log(RARE)
    return min(sum(n * t.get(c, floor) for c, n in odd.items()) + plain * _PLAIN[lang] for lang, t in _LETTER.items())


def at_home(odd: set[str]) -> bool:
    """Whether one language has all these letters."""
    return any(odd <= t.keys() for t in _LETTER.values())


def alphabet_bits(text: str, alphabet: str) -> float:
    """Bits of all characters but blanks under an alphabet; a capital within a word after a small letter costs more."""
    t = _BITS[alphabet]
    small = text.lower()
    total = sum(n * t.get(c, FOREIGN) for c, n in Counter(small).items() if c != " ")
    if small == text:
        return total
    return total + sum(4.0 for a, b in zip(text, text[1:], strict=False) if b.isupper() and a.islower())


def paired_bits(run: bytes, codec: str) -> float:
    """Bits of a run of byte pairs under an East Asian encoding, by the row of each character."""
    total = 0.0
    for lead in run[::2]:
        if codec == "gb2312":
            total += 11.9 if 0xB0 <= lead <= 0xD7 else 12.5 if lead in (0xA1, 0xA3) else 16.0
        elif codec == "euc_kr":
            total += 11.2 if 0xB0 <= lead <= 0xC8 else 12.5 if lead in (0xA1, 0xA3) else 17.0
        else:
            total += 7.2 if lead == 0xA4 else 8.5 if lead == 0xA5 else 9.0 if lead == 0xA1 else 13.0 if 0xB0 <= lead <= 0xCF else 16.0
    return total
