"""The charset of undeclared bytes, by how coherent each reading's neighbouring characters are.

A single-byte reading is judged by the counts of its byte pairs, all of them at once: one histogram of 65,536 pairs times a
table with a row for each reading, a charset with the letters of a language.  A pair counts for a reading if both bytes are
letters that the language uses in an order of cases that words have, and against it if scripts mix within a word, a capital
follows a small letter, or a byte is a symbol or nothing.  A multi-byte reading is judged by its characters: those that are
the most frequent of the language, those of the standard's first level, and all others.
"""

from __future__ import annotations

import codecs
import re
import unicodedata

import numpy as np

# Letters beyond ASCII that texts of a language use, and the charsets that such texts are in; for scripts other
# than Latin in the order of how frequent they are.
LETTERS = (
    (("cp1252",), "éèàêçâîôûùëïœ"),  # French
    (("cp1252",), "äöüß"),  # German
    (("cp1252",), "áéíóúñü¿¡"),  # Spanish
    (("cp1252",), "ãõáéíóúâêôçà"),  # Portuguese
    (("cp1252",), "àèéìòù"),  # Italian
    (("cp1252",), "åäöæøé"),  # the North
    (("cp1250", "iso8859_2"), "ąćęłńóśźż"),  # Polish
    (("cp1250", "iso8859_2"), "áčďéěíňóřšťúůýžäľô"),  # Czech and Slovak
    (("cp1250", "iso8859_2"), "áéíóöőúüű"),  # Hungarian
    (("cp1254",), "çğıöşüâİ"),  # Turkish
    (("cp1251", "koi8_r", "cp866", "iso8859_5"), "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"),  # Russian
    (("cp1251",), "оаинвіертслкудмпзяьбгйчхжцїюєфшщґ"),  # Ukrainian
    (("cp1253", "iso8859_7"), "αοιετσνηυρπκμλωδγχθφβξζψςάέήίόύώ"),  # Greek
    (("cp1255",), "יוהלאשרתבמכנדחעקפגטזצסםןךףץ"),  # Hebrew
    (("cp1256",), "اليمنوترهبعدسفقكحجشصخطضذزغثظءأإآةىئؤ"),  # Arabic
)

# The most frequent characters of a language in its multi-byte charset.
FREQUENT = {
    "gb18030": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实",
    "cp950": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實",
    "cp949": "이다는의을에가고하한지를은기도로사어자나리서대인아시해그정있수들과보일으것게부라장주니전스상만구여동공제있적면연국안성",
    "cp932": "日本人一大年中会国上生出月時分者地自事後下学行前",
    "euc_jp": "日本人一大年中会国上生出月時分者地自事後下学行前",
}
#: Rows of double bytes of each standard's first level: charset, first and last lead byte.
LEVELS = {"gb18030": ("gb2312", 0xB0, 0xD7), "cp950": ("big5", 0xA4, 0xC6), "cp949": ("euc_kr", 0xB0, 0xC8), "cp932": ("euc_jp", 0xB0, 0xCF), "euc_jp": ("euc_jp", 0xB0, 0xCF)}

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))

DECLARED = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)|<\?xml[^>]{0,100}?encoding\s*=\s*[\"']([A-Za-z0-9_.:-]+)", re.IGNORECASE)

#: Without a reading of at least this coherence bytes are taken as FALLBACK.
LEAST, FALLBACK = 0.0, "cp1252"

#: Byte pairs that count for the first reading before any are seen: a letter or two don't decide for another.
PRIOR = 4.0

TYPED = "‘’“”„‚–—…•©®°«»·§№€"


def _pair_weights(charset: str, letters: str) -> np.ndarray:
    """What each byte pair says for a reading; pairs of ASCII say nothing."""
    chars = [bytes([b]).decode(charset, "replace") for b in range(256)]
    high = np.arange(256) >= 128
    kinds = [unicodedata.category(c) for c in chars]
    letter = np.array([k[0] == "L" for k in kinds])
    latin = np.array([c.isascii() or "LATIN" in unicodedata.name(c, "") for c in chars]) & letter
    lower, upper = np.array([k == "Ll" for k in kinds]), np.array([k == "Lu" for k in kinds])
    # a byte's own worth: letters in use, other letters, typed marks, all else
    own = unicodedata.name(letters[0], "").split()[0] == "LATIN"
    known = {c: 1.0 if own else 1 - 0.6 * k / len(letters) for k, c in enumerate(letters)}
    known = {c.upper(): w - 0.2 for c, w in known.items() if len(c.upper()) == 1} | known
    worth = np.array([known.get(c, -0.4 if k[0] == "L" else 0.3 if c in TYPED or c == "\xa0" else -1.0) for c, k in zip(chars, kinds, strict=True)])
    a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    # the worth of a pair is that of its high bytes
    n = high[a].astype(float) + high[b]
    out = np.where(high[a], worth[a], 0) + np.where(high[b], worth[b], 0)
    out = np.where(n > 0, out / np.maximum(n, 1), 0.0)
    within = letter[a] & letter[b]
    mixed = within & (latin[a] != latin[b])
    crowded = within & high[a] & high[b] & own  # letters with marks seldom meet
    out = np.where(crowded, np.minimum(out, 0.2) - 0.3, out)
    out = np.where(within & lower[a] & upper[b] & (n > 0), -1.0, out)
    out = np.where(mixed & (n > 0), -1.0, out)
    return np.where(n > 0, out, 0.0).astype(np.float32).reshape(-1)


READINGS = [(c, letters) for charsets, letters in LETTERS for c in charsets]
_TABLES: dict[str, np.ndarray] = {}


def _pair_table() -> np.ndarray:
    if "pairs" not in _TABLES:
        _TABLES["pairs"] = np.stack([_pair_weights(c, letters) for c, letters in READINGS])
    return _TABLES["pairs"]


def _worths(charset: str) -> np.ndarray:
    """The worth of each character of the basic plane for a multi-byte reading."""
    if charset not in _TABLES:
        out = np.full(65_536, -1.0, np.float32)
        standard, first, last = LEVELS[charset]
        for lead in range(first, last + 1):
            for trail in range(0x40, 0xFF):
                char = bytes([lead, trail]).decode(standard, "ignore")
                if len(char) == 1 and ord(char) >= 128:
                    out[ord(char)] = 0.3
        out[0x3000:0x3040] = out[0xFF01:0xFF5F] = 0.7  # punctuation and wide forms
        for c in TYPED:
            out[ord(c)] = 0.3
        if charset in ("cp932", "euc_jp"):
            out[0x3041:0x3100] = 1.0
        out[[ord(c) for c in FREQUENT[charset]]] = 1.0
        _TABLES[charset] = out
    return _TABLES[charset]


def _characters(content: bytes, charset: str) -> float | None:
    """Mean worth of a multi-byte reading's characters beyond ASCII; None where it is no valid reading."""
    try:
        text = content.decode(charset)
    except UnicodeDecodeError:
        return None
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    points = points[points >= 128]
    if not len(points):
        return None
    worth = np.where(points < 65_536, _worths(charset)[np.minimum(points, 65_535)], -1.0)
    kana = np.count_nonzero((points >= 0x3041) & (points < 0x3100)) / len(points)
    score = float(worth.sum()) / (len(points) + PRIOR / 2)
    if charset in ("cp932", "euc_jp"):
        return score if kana >= 0.1 else min(score, 0.1)
    return score - kana  # of other languages kana are none


def _wide(content: bytes) -> str | None:
    """UTF-16 or UTF-32 without a mark, by which bytes of their units are zero."""
    if len(content) < 4 or 0 not in content:
        return None
    units = np.frombuffer(content[: len(content) // 4 * 4], np.uint8).reshape(-1, 4)
    zero = (units == 0).mean(axis=0)
    names = []
    if zero[2] > 0.95 and zero[3] > 0.95:
        names.append("utf-32-le")
    if zero[0] > 0.95 and zero[1] > 0.95:
        names.append("utf-32-be")
    even, odd = (zero[0] + zero[2]) / 2, (zero[1] + zero[3]) / 2
    if odd > 0.02 and odd > 8 * even:
        names.append("utf-16-le")
    if even > 0.02 and even > 8 * odd:
        names.append("utf-16-be")
    for name in names:
        try:
            content.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return None


def _valid(content: bytes, name: str) -> bool:
    try:
        content.decode(name)
        return True
    except (UnicodeDecodeError, LookupError):
        return False


def coherence(content: bytes) -> list[tuple[float, str]]:
    """Each possible reading with its coherence, the best first; earlier ones among equals."""
    data = np.frombuffer(content, np.uint8).astype(np.int64)
    pairs = np.bincount(data[:-1] << 8 | data[1:], minlength=65_536).astype(np.float32)
    at = np.arange(65_536)
    high = ((at >> 8) >= 128) | ((at & 255) >= 128)
    total = float(pairs[high].sum())
    prior = np.zeros(len(READINGS), np.float32)
    prior[0] = PRIOR * 0.75
    scores = (_pair_table() @ pairs + prior) / (total + PRIOR)
    found = [(float(s), c) for s, (c, _) in zip(scores, READINGS, strict=True)]
    found += [(s, c) for c in FREQUENT if (s := _characters(content, c)) is not None]
    return sorted(found, key=lambda x: -x[0])


def detect(content: bytes) -> str:
    """The charset of a file: by its mark, as UTF-16 or UTF-32, as UTF-8, as declared, else the most coherent reading."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    if (name := _wide(content)) is not None:
        return name
    if b"\x1b$" in content and _valid(content, "iso2022_jp"):
        return "iso2022_jp"
    if _valid(content, "utf-8"):
        return "utf-8"
    for found in DECLARED.finditer(content):
        try:
            name = codecs.lookup((found[1] or found[2]).decode("ascii")).name
        except LookupError:
            continue
        if _valid(content, name):
            return name
    best = next(iter(coherence(content)), (LEAST, FALLBACK))
    return best[1] if best[0] > LEAST else FALLBACK


def decoded(content: bytes | None) -> str | None:
    """A file's text; never an error."""
    return None if content is None else content.decode(detect(content), "replace")
