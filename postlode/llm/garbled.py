"""Garbled text from wrong character encoding: find it, and restore the original where it can still be known.

Round-trip repair: characters are encoded again under a candidate legacy encoding and strictly decoded as the intended
one, layer by layer, as long as a garbling cost drops. Text may be garbled in part only, so the candidates are

* the sequences that would be valid UTF-8 under one of READ_AS; their cost is that of the characters themselves. Three or
  four bytes that decode to an assigned character are taken as such. Of two bytes, what decodes to a rare script or a
  lone letter of another one is left alone, and so are letters with only marks or letters after them: that is how
  quotation marks next to accented letters look;
* sentences of one legacy encoding read as another (ALPHABETIC, PAIRED, LATIN); their cost is that of their letters under
  the script or language that suits them best (scripts.py), before and after, and the candidate of least cost is taken;
* control characters of the range 80-9F.

Restored: the text after all layers. Not restorable: replacement characters (U+FFFD), whose bytes are gone, and control
characters of the range 80-9F that no encoding explains.

A text is one unit of work in a mapInArrow; nothing is shuffled. Only texts with a character beyond ASCII reach Python,
and whole texts are searched only for what their runs of such characters may hold.

Defined cases: NULL, blank and pure ASCII texts are not garbled; a long text is read whole; rows with the same id are
each judged and give one row; NULL ids give none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm.scripts import FOREIGN, alphabet_bits, at_home, language_cost, paired_bits

# Legacy encodings that UTF-8 is wrongly read as.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "cp1254", "cp1257", "koi8-r", "cp866", "iso8859-5")
# (read as, intended, alphabet) of an alphabet's encoding taken for another one.
ALPHABETIC = (
    ("cp1252", "cp1251", "russian"), ("cp1252", "koi8-r", "russian"), ("mac_roman", "cp1251", "russian"), ("cp1251", "koi8-r", "russian"), ("koi8-r", "cp1251", "russian"), ("cp866", "cp1251", "russian"),
    ("cp1251", "cp866", "russian"), ("cp1252", "cp1253", "greek"), ("cp1252", "cp1255", "hebrew"), ("cp1252", "cp1256", "arabic"),
)
# (read as, intended) of encodings in pairs of bytes taken for a Western one.
PAIRED = (("cp1252", "gb2312"), ("cp1252", "euc_kr"), ("cp1252", "euc_jp"))
# (read as, intended) of Latin alphabets taken for the Western one.
LATIN = (("cp1252", "cp1250"), ("latin-1", "iso8859-2"), ("cp1252", "cp1254"), ("cp1252", "cp1257"))
MOST_LAYERS = 5
# Bits a byte up to which a decoded sentence reads well, or needs no decoding; nats by which a
# language must gain, and bits by which one reading of an alphabet must beat another.
READS_WELL = 5.8
READS_BEST = 4.6
PAIRS_READ_WELL = 6.3
GAIN = 8.0
SCRIPT_GAIN = 5.0
# Encodings whose high characters are letters of running text, so that real words may look like sequences of bytes.
_CYRILLIC_READ = frozenset({"cp1251", "koi8-r", "cp866", "iso8859-5"})


def _high(codec: str) -> list[str]:
    """Characters of the bytes 80-FF under a legacy encoding; bytes it leaves open become control characters, as readers do."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


_HIGH = {c: _high(c) for c in READ_AS}
_BYTE = {c: {ch: 128 + i for i, ch in reversed(list(enumerate(h)))} for c, h in _HIGH.items()}


def _sequences(codec: str) -> re.Pattern[str]:
    h = _HIGH[codec]
    tail = _class(h[0x00:0x40])
    two, three, four = _class(h[0x42:0x60]), _class(h[0x60:0x70]), _class(h[0x70:0x75])
    return re.compile(f"(?:{two}{tail}|{three}{tail}{tail}|{four}{tail}{tail}{tail})+")


_SEQ = {c: _sequences(c) for c in READ_AS}
_LEAD = {c: frozenset(_HIGH[c][0x42:0x75]) for c in READ_AS}
_TAIL = {c: frozenset(_HIGH[c][0x00:0x40]) for c in READ_AS}
_LATIN = re.compile("[\u0020-\u007e\u00a0-\u017fƠơƯưƒˆ˜Ș-ț\u2010-\u2026‰′″‹›€№™\u2190-\u2193−✓ﬁﬂ]")
_CYRILLIC = re.compile("[ЁЄІЇА-яёєіїҐґ]")
_CYR_LETTER = re.compile("[Ѐ-ӿ]")
_GREEK = re.compile("[Ά-ώ]")
_CONTROL = re.compile("[\x80-\x9f]")
# Other scripts of two bytes: Armenian, Hebrew, Arabic, Syriac, Thaana.
_EASTERN = re.compile("[\u0531-\u07b1]")
# Marks of clean text that may follow an accented letter and look like the rest of a sequence of three or four bytes.
_MARKS = frozenset("\xa0«»‘’“”‚„…–—•‹›¿¡°")
_UPPER_THEN_MARK = re.compile("[A-ZÀ-Þ]Ã[’”…–—](?![A-Za-z])")
_ACCENT_WORD = re.compile("[À-ÿ¸¨]{4,}")
_CYR_WORD = re.compile("[Ѐ-џ]{4,}")
_ACCENT_RUN = re.compile("[À-ÿ¸¨]+")
_CYR_RUN = re.compile("[Ѐ-џ]+")
_POLISH_IN = re.compile("(?<=[^\\W\\d_])[¹³¿±¶¼¾£](?=[a-zà-ÿ¹³¿])|(?<=[a-z])œ(?=[æcnlmwp])|(?<=[a-zœ])æ(?!\\w)|(?<=[a-z])Ÿ(?=[a-z])")
_POLISH_EDGE = re.compile("(?<=[a-zà-ÿ]{3})[¹³](?![\\w.])|(?<!\\w)¿(?=[a-z])")
# Words of a sentence that look Polish, and letters that Polish lacks but its letters turn into.
_POLISH_LOOK = re.compile("\\w*(?:[csrd]z|ów|ych|iej)\\w*")
_POLISH_ALSO = re.compile("(?<=[a-z])[êñæœ]")
_ODD = re.compile("[^\x00-\x7f]+")
_ODD_LETTER = re.compile("(?<=[^\\W\\d_])[¹³¿±¶¼¾£]|[¿](?=[^\\W\\d_])|[^\\W\\d_\x00-\x7f]")
_ASCII_LETTER = re.compile("[A-Za-z]")
_WORDS = re.compile("[\\w¹³¿±¶¼¾£]+")
_PIECES = re.compile(r"((?<=[.!?])\s+|\n+)")
_POLISH_CHARS = frozenset("¹³¿±¶¼¾œŸæêñ")
_POUND_IN = re.compile("[^\\W\\d_]£[a-z]")
_POLISH_WORD = re.compile("[\\w¹³¿±¶¼¾£œŸ]+")


def cost(text: str) -> float:
    """Garbling cost: what a character beyond ASCII says against its text, less for letters than for odd symbols."""
    total = 0.0
    for c in text:
        o = ord(c)
        if o < 128:
            continue
        if c == "�":
            total += 8
        elif 0x80 <= o < 0xA0:
            total += 6
        elif c.islower():
            total += 1
        elif c.isupper():
            total += 1.5
        else:
            total += 2
    return total


def _decode(run: str, codec: str) -> str | None:
    try:
        return bytes(_BYTE[codec][c] for c in run).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return None


def _wide(c: str) -> bool:
    """An assigned character of three or four bytes in UTF-8."""
    return ord(c) >= 0x800 and category(c) not in ("Cn", "Co", "Cs")


def _plausible(found: str) -> bool:
    """Characters a text may hold: any assigned one of three or four bytes; of two bytes, letters of other scripts only in company."""
    rest = "".join(c for c in found if not _wide(c))
    latin, eastern = len(_LATIN.findall(rest)), len(_EASTERN.findall(rest))
    cyrillic, greek = len(_CYRILLIC.findall(rest)), len(_GREEK.findall(rest))
    return latin + cyrillic + greek + eastern == len(rest) and (not cyrillic or cyrillic > 1) and (not greek or greek > 2) and (not eastern or eastern > 2)


def _unsure(run: str, got: str) -> bool:
    """One letter and marks, or letters alone, as clean text may hold them, that decode to one character not in the list."""
    return len(got) == 1 and _wide(got) and not _LATIN.match(got) and run[0].isalpha() and (all(c in _MARKS for c in run[1:]) or run.isalpha())


def _lone(run: str, got: str) -> bool:
    """A single Greek or Cyrillic letter, shown as a capital and a sign that does not follow letters in clean text."""
    return len(run) == 2 and run[0].isupper() and not run[1].isalnum() and run[1] not in _MARKS and (_GREEK.match(got) or _CYRILLIC.match(got)) is not None


def _utf8(text: str, codec: str) -> tuple[str, int]:
    hits = 0
    if not _SEQ[codec].search(text):
        return text, 0
    runs = [(r, _decode(r, codec) or "") for r in _SEQ[codec].findall(text)]
    company = sum(1 for _, g in runs if len(_CYRILLIC.findall(g)) > 1) > 1
    eastern = sum(1 for _, g in runs if len(_EASTERN.findall(g)) > 1) > 1
    # a sequence that clean text cannot look like lets the ambiguous ones be read likewise
    sure = any(any(_wide(c) for c in g) and not _LATIN.fullmatch(g) and not _unsure(r, g) for r, g in runs)
    # real words of a Cyrillic text may look like sequences of bytes; without company all its letters must be such sequences
    real_words = codec in _CYRILLIC_READ and not company and _CYR_LETTER.search(_SEQ[codec].sub("", text)) is not None

    def fix(m: re.Match[str]) -> str:
        nonlocal hits
        run = m.group()
        if run[0] == "Ã" and len(run) == 2 and m.start() and _UPPER_THEN_MARK.match(text, m.start() - 1):
            return run
        got = _decode(run, codec)
        if got is None or cost(got) >= cost(run):
            return run
        if real_words:
            return run
        if codec in _CYRILLIC_READ:
            # only a whole word can be taken for a sequence of bytes
            if _CYR_LETTER.match(text[m.start() - 1 : m.start()]) or _CYR_LETTER.match(text[m.end() : m.end() + 1]):
                return run
        if _unsure(run, got) and not sure:
            return run
        if not _plausible(got) and not _lone(run, got):
            if _CONTROL.search(got):
                if not all(_LATIN.match(c) or _CONTROL.match(c) for c in got):
                    return run
            elif not (company and _CYRILLIC.fullmatch(got)) and not (eastern and all(_EASTERN.match(c) or _wide(c) or _LATIN.match(c) for c in got)):
                return run
        hits += len(run)
        return got

    return _SEQ[codec].sub(fix, text), hits


def _bytes(text: str, read: str) -> bytes | None:
    """Bytes that a reader of `read` showed as this text; bytes it leaves open are control characters."""
    try:
        return bytes(_BYTE[read][c] for c in text)
    except KeyError:
        return None


def _reread(run: str, read: str, meant: str) -> str:
    raw = _bytes(run, read)
    try:
        return run if raw is None else raw.decode(meant)
    except UnicodeDecodeError:
        return run


def _alphabetic(piece: str) -> tuple[float, str] | None:
    """(bits a byte, piece) of the best alphabet for a sentence whose letters were read in another encoding."""
    best = None
    western, cyrillic = " ".join(_ACCENT_WORD.findall(piece)), " ".join(_CYR_WORD.findall(piece))
    as_is = alphabet_bits(cyrillic, "russian") / _size(cyrillic) if cyrillic else 0.0
    for read, meant, alphabet in ALPHABETIC:
        shown = cyrillic if read in _CYRILLIC_READ else western
        if not shown or (shown is cyrillic and as_is <= READS_BEST):
            continue
        other = " ".join(_reread(w, read, meant) for w in shown.split())
        cost = alphabet_bits(other, alphabet) / _size(other)
        if cost <= READS_WELL and (shown is western or (as_is - cost) * _size(other) >= SCRIPT_GAIN) and (best is None or cost < best[0]):
            body = _CYR_RUN if shown is cyrillic else _ACCENT_RUN
            best = (cost, body.sub(lambda m: _reread(m.group(), read, meant), piece))  # noqa: B023
    return best


def _size(words: str) -> int:
    return len(words) - words.count(" ")


def _paired(piece: str) -> tuple[float, str] | None:
    """(bits a byte, piece) of the best encoding in pairs of bytes."""
    runs = [r for r in _ODD.findall(piece) if len(r) > 1]
    size = sum(map(len, runs))
    if size < 8 or size < 0.9 * sum(map(len, _ODD.findall(piece))):
        return None
    best = None
    for read, meant in PAIRED:
        total = 0.0
        for r in runs:
            raw = _bytes(r, read)
            if raw is None or len(raw) % 2 or _reread(r, read, meant) == r:
                total = float("inf")
                break
            total += paired_bits(raw, meant)
        if total / size <= PAIRS_READ_WELL and (best is None or total / size < best[0]):
            best = (total / size, _ODD.sub(lambda m: _reread(m.group(), read, meant), piece))  # noqa: B023
    return best


def _letters(piece: str) -> tuple[Counter[str], int]:
    """Letters beyond ASCII, with marks inside or before a word, and the number of ASCII letters."""
    odd = Counter(c for c in _ODD_LETTER.findall(piece.lower()) if c.isalpha() or not c.isalnum() or c in "¹³¼")
    return odd, len(_ASCII_LETTER.findall(piece))


def _latin(piece: str) -> str:
    """A sentence of another Latin alphabet read as Western, if the cost of its letters drops by GAIN."""
    odd, plain = _letters(piece)
    if not odd or at_home(set(odd)):
        return piece
    best, found = language_cost(odd, plain) - GAIN, piece
    for read, meant in LATIN:
        other = _WORDS.sub(lambda m: "".join(_reread(c, read, meant) if ord(c) > 127 else c for c in m.group()), piece)  # noqa: B023
        if other == piece:
            continue
        cost = language_cost(*_letters(other))
        if cost < best:
            best, found = cost, other
    return found


def _polish(text: str, pieces: list[str]) -> str:
    """Polish under a Western encoding, told by marks and letters within words that only it makes; a few letters in a
    text of another language are enough, if their cost drops."""
    inside, edge = len(_POLISH_IN.findall(text)), len(_POLISH_EDGE.findall(text))
    inside += sum(1 for piece in pieces if _POLISH_ALSO.search(piece) and len(_POLISH_LOOK.findall(piece)) > 1)
    if not inside and edge < 2:
        return text
    meant = "iso8859-2" if re.search("[a-z][±¶¼]", text) else "cp1250"
    found = _POLISH_WORD.sub(lambda m: "".join(_reread(c, "cp1252", meant) if ord(c) > 127 else c for c in m.group()), text)
    changed = [(a, b) for a, b in zip(_POLISH_WORD.findall(text), _POLISH_WORD.findall(found), strict=False) if a != b]
    before, after = " ".join(a for a, _ in changed), " ".join(b for _, b in changed)
    return found if language_cost(*_letters(after)) < language_cost(*_letters(before)) else text


def _legacy(text: str, runs: set[str]) -> str:
    """One legacy encoding read as another, sentence by sentence, as a text may be garbled in part."""
    pairs = any(len(r) > 3 and r[0] in _BYTE["cp1252"] for r in runs)
    scripts = pairs or any(_CYR_WORD.search(r) for r in runs)
    marks = any(not _POLISH_CHARS.isdisjoint(r) for r in runs) or _POUND_IN.search(text) is not None
    latin = not at_home({c for r in runs for c in r.lower() if "\xdf" <= c <= "\u017f"} - {"÷"})
    if not (scripts or marks or latin):
        return text
    pieces = _PIECES.split(text)
    fixed = list(pieces)
    for i, piece in enumerate(pieces):
        if piece.isascii():
            continue
        if scripts:
            found = [x for x in (_alphabetic(piece), _paired(piece) if pairs else None) if x]
            if found:
                fixed[i] = min(found)[1]
                continue
        if latin:
            fixed[i] = _latin(piece)
    if fixed != pieces:
        return "".join(fixed)
    return _polish(text, pieces) if marks else text


def _runs(text: str) -> set[str]:
    return set(_ODD.findall(text))


def restore(text: str) -> tuple[str, int]:
    """(text after all layers that lower the cost, number of layers)."""
    layers, last = 0, ""
    while layers < MOST_LAYERS:
        best, gain, used = text, 0.0, last
        runs = _runs(text)
        pool = "\n".join(r for r in runs if len(r) > 1)
        present = frozenset(pool)
        for codec in READ_AS:
            if not (present & _LEAD[codec] and present & _TAIL[codec]) or not _SEQ[codec].search(pool):
                continue
            # every changed sequence lowers the cost, so hits say that it drops
            fixed, hits = _utf8(text, codec)
            # nested layers mostly come from one encoding
            worth = hits * (1.5 if codec == last else 1.0)
            if worth > gain:
                best, gain, used = fixed, worth, codec
        last = used
        if runs and (not gain or any(_ACCENT_WORD.search(r) for r in runs)):
            # words of accented letters alone are another encoding's words, and what looks like sequences in them is none
            other = _legacy(text, runs)
            if not gain or (len(other) <= len(text) and sum(a != b for a, b in zip(text, other, strict=False)) > gain):
                best, last = other, ""
        if not gain and runs:
            if best == text and _CONTROL.search(text):
                best = _CONTROL.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "ignore") or m.group(), text)
        if best == text:
            break
        text, layers = best, layers + 1
    return text, layers


SCHEMA = "doc_id bigint, restored string, layers int, restorable boolean"


def garbled(df: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, layers, restorable) of each garbled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fixed, layers = restore(t)
                lost = "�" in t or _CONTROL.search(fixed) is not None
                if layers or lost:
                    out.append((i, fixed, layers, not lost))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_())], names=["doc_id", "restored", "layers", "restorable"])

    some = df.where(F.col(ids).isNotNull() & F.col(text).rlike("[^\\x00-\\x7f]")).select(F.col(ids).cast("bigint"), text)
    return some.mapInArrow(run, SCHEMA)
