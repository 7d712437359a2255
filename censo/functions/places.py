"""Names of centres, towns, postcodes and regions as people type them: repair and parse.

Pure functions on Python strings, used inside Arrow UDFs (``censo.functions.udf``): Spark has no Unicode decomposition, entity
decoding or typo-tolerant vocabulary lookup of its own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Stand-ins for "no value" (folded).
PLACEHOLDERS = frozenset(
    """- -- . .. ? n/a na n.a. n.d. n/d nd s/d sd sin datos sin dato no consta no disponible no aplica no procede nr n.r. none null nan
    desconocido desconocida unknown ninguno ninguna xx xxx""".split()
    + ["sin datos", "sin dato", "no consta", "no disponible", "no aplica", "no procede", "not available", "not applicable", "sin especificar", "no informado"]
)

MOJIBAKE = re.compile("[ÃÂ][\u0080-¿Œ-Ÿ‘-™]")


# The format characters (category Cf) of the Basic Multilingual Plane, and the blocks of combining marks.
INVISIBLE = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")
COMBINING = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


def repair(text: str | None) -> str:
    """Undo entity and double-UTF-8 damage, drop invisible characters, collapse white space; null gives ''."""
    if not text:
        return ""
    for _ in range(3):
        new = html.unescape(text) if "&" in text else text
        if new == text:
            break
        text = new
    if text.isascii():
        return " ".join(text.split())
    if MOJIBAKE.search(text):
        for codec in ("cp1252", "latin-1"):
            try:
                text = text.encode(codec).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    text = unicodedata.normalize("NFC", text)
    return " ".join(INVISIBLE.sub("", text).split())


def fold(text: str | None) -> str:
    """Repaired, without accents, case-folded; '?' and U+FFFD stand for an unreadable character."""
    text = repair(text).replace("�", "?")
    if text.isascii():
        return text.lower()
    return COMBINING.sub("", unicodedata.normalize("NFD", text)).casefold()


def is_missing(text: str | None) -> bool:
    """Null, blank or a stand-in for no value."""
    f = fold(text).strip(" ,;:")
    return not f or f in PLACEHOLDERS or not any(c.isalnum() for c in f)


@lru_cache(maxsize=200_000)
def damerau(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment distance, '?' matching any character for free; anything above ``most`` is ``most + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # only the band of cells that can hold a distance up to ``most``: cell o of row i stands for the first i + o - most letters of ``b``
    far, width = most + 1, 2 * most + 1
    before, row = [far] * (width + 1), [o - most if 0 <= o - most <= len(b) else far for o in range(width)] + [far]
    for i, x in enumerate(a, 1):
        new, left = [far] * (width + 1), far
        for o in range(max(0, most - i), min(width, len(b) - i + most + 1)):
            j = i + o - most
            if j == 0:
                d = i
            else:
                y = b[j - 1]
                d = row[o] if x == y or x == "?" or y == "?" else row[o] + 1
                d = min(d, row[o + 1] + 1, left + 1)
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                    d = min(d, before[o] + 1)
            new[o] = left = min(d, far)
        if min(new) > most:
            return far
        before, row = row, new
    return row[len(b) - len(a) + most]


# Kinds of centres and their abbreviations and translations.
KIND = {
    "hospital": "hospital", "hosp": "hospital", "htal": "hospital", "hptal": "hospital", "h": "hospital",
    "universitario": "universitario", "univ": "universitario", "universitari": "universitario", "university": "universitario",
    "general": "general", "gral": "general", "xeral": "general",
    "comarcal": "comarcal", "com": "comarcal", "comarc": "comarcal", "district": "comarcal", "zona": "zona",
    "clinica": "clinica", "clin": "clinica", "clca": "clinica", "cl": "clinica", "clinic": "clinica", "clinico": "clinico",
    "centro": "centro", "ctro": "centro", "centre": "centro", "center": "centro",
    "salud": "salud", "salut": "salud", "health": "salud", "saude": "salud",
    "especialidades": "especialidades", "espec": "especialidades", "especialitats": "especialidades", "specialist": "especialidades",
    "instituto": "instituto", "inst": "instituto", "institut": "instituto", "institute": "instituto",
    "investigacion": "investigacion", "inv": "investigacion", "invest": "investigacion", "research": "investigacion", "recerca": "investigacion",
    "complejo": "complejo", "asistencial": "complejo",
}
KIND_SHORT = {
    "hu": ("hospital", "universitario"), "hg": ("hospital", "general"), "hc": ("hospital", "comarcal"), "cs": ("centro", "salud"),
    "ce": ("centro", "especialidades"), "ii": ("instituto", "investigacion"), "hcu": ("hospital", "universitario"),
}
# Words that open a dedication and their abbreviations.
DEDICATION = {
    "doctor": "doctor", "dr": "doctor", "doctora": "doctora", "dra": "doctora", "san": "san", "sn": "san", "santa": "santa", "sta": "santa",
    "virgen": "virgen", "v": "virgen", "vrg": "virgen", "vgen": "virgen", "nuestra": "nuestra", "ntra": "nuestra", "nra": "nuestra", "nª": "nuestra",
    "senora": "senora", "sra": "senora", "sª": "senora", "rio": "rio", "montes": "montes", "puerta": "puerta", "ciudad": "ciudad",
}
DEPARTMENT = frozenset("dpto departamento servicio sº serv unidad reumatologia pediatria oncologia hematologia cardiologia neurologia farmacologia medicina interna ensayos clinicos".split())
DEPARTMENT_HEAD = frozenset("dpto departamento servicio sº serv unidad".split())
# Kinds of streets and their abbreviations.
STREET = {
    "calle": "calle", "c/": "calle", "clle": "calle", "avenida": "avenida", "av": "avenida", "avd": "avenida", "avda": "avenida",
    "paseo": "paseo", "pº": "paseo", "pso": "paseo", "plaza": "plaza", "pza": "plaza", "plza": "plaza", "pl": "plaza",
    "camino": "camino", "cno": "camino", "cmno": "camino", "cº": "camino", "carretera": "carretera", "carr": "carretera", "ctra": "carretera", "crta": "carretera",
}
STREET_REST = frozenset("bajo planta num nº numero n no piso".split())
# Adjectives that follow the noun of a street's name.
STREET_ADJECTIVE = frozenset("alta alto baja bajo ancha ancho larga largo honda hondo blanca blanco negra negro verde dulce vieja viejo clara claro nueva nuevo grande mayor menor real".split())
ABBREVIATIONS = frozenset({k for m in (KIND, DEDICATION, STREET) for k, v in m.items() if k != v} | set(KIND_SHORT) | {"c", "s", "n", "num", "nº", "ns", "dpto", "serv"})
STOP = frozenset("de del la las el los y i d da do das dos e a o al".split())

LONG_VOCABULARY = sorted({w for w in (*KIND, *DEDICATION, *STREET, *DEPARTMENT) if len(w) >= 5})
READABLE = sorted({w for w in (*KIND, *DEDICATION, *STREET, *DEPARTMENT, *STREET_REST) if len(w) >= 4 and w.isalpha()} | {"rio", "num"})
LONG_ABBREVIATIONS = [w for m in (KIND, DEDICATION, STREET) for w in sorted(m) if w in ABBREVIATIONS and len(w) >= 3]
BY_LENGTH: dict[int, list[str]] = {}
for _w in LONG_VOCABULARY:
    BY_LENGTH.setdefault(len(_w), []).append(_w)


def cuts(word: str, most: int) -> set[str]:
    """The word and its forms with up to ``most`` letters left out: words within ``most`` edits or swaps of each other share one."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


#: Words of LONG_VOCABULARY by their forms with one, and with up to two letters left out.
BY_CUT: dict[int, dict[str, list[str]]] = {1: {}, 2: {}}
for _w in LONG_VOCABULARY:
    for _most, _words in BY_CUT.items():
        for _c in cuts(_w, _most):
            _words.setdefault(_c, []).append(_w)
TOKEN = re.compile(r"c/|p\.º|n\.[ºª]|(?:[a-z]\.){2,}|[a-z?][a-z?'’]*[ºª]?|[0-9]+|[,;()]| - |\. |[.]$")


@lru_cache(maxsize=100_000)
def vocabulary_word(token: str) -> str:
    """The vocabulary word a mistyped long token, or one with unreadable characters, stands for, else the token itself."""
    if "?" in token and len(token) >= 3:
        fits = [w for w in READABLE if len(w) == len(token) and damerau(token, w, 0) == 0]
        if len(fits) == 1:
            return fits[0]
    if len(token) < 5 or token in KIND or token in DEDICATION or token in STREET or token in DEPARTMENT:
        return token
    allowed = 1 if len(token) < 9 else 2
    best, least = token, allowed + 1
    if "?" in token:  # fits any letter, so no form without a letter proves anything
        words = [word for n in range(len(token) - allowed, len(token) + allowed + 1) for word in BY_LENGTH.get(n, ())]
    else:
        by = BY_CUT[allowed]
        words = sorted({word for c in cuts(token, allowed) if c in by for word in by[c]}, key=lambda w: (len(w), w))
    for word in words:
        d = damerau(token, word, allowed)
        if d < least:
            best, least = word, d
    return best


class Centre(NamedTuple):
    """A parsed centre name. ``stems`` are the words that tell centres apart, in order; ``kind`` and ``opening`` sorted words."""

    kind: tuple[str, ...]
    opening: tuple[str, ...]
    stems: tuple[str, ...]
    tail: tuple[str, ...]
    street: tuple[str, ...]
    number: str
    named: bool


def tokens(text: str) -> list[str]:
    out = []
    for t in TOKEN.findall(text):
        if t in (". ", "."):
            out.append(".")
        elif t in (",", ";", "(", ")", " - "):
            out.append("|" if t != "(" else "(")
        elif t == "p.º":
            out.append("pº")
        elif t in ("n.º", "n.ª"):
            out.append("n" + t[-1])
        elif len(t) > 2 and t[1] == "." and t.endswith("."):
            out.append(t.replace(".", ""))
        else:
            out.append(t.replace("'", "").replace("’", "") or "?")
    return out


@lru_cache(maxsize=100_000)
def parse_centre(name: str | None, town: str | None = None) -> Centre:
    """Parse one centre name; words of ``town`` at the end of the name, or in a part of their own, go to ``tail``.

    A null, blank or stand-in name gives an empty, unnamed centre. Typos are tolerated in vocabulary words of six letters or more.
    """
    if is_missing(name):
        return Centre((), (), (), (), (), "", False)
    raw = tokens(re.sub(r"[’`´]", "'", fold(name)))
    raw = _join_dots(raw)
    town_words = [w for w in tokens(town_key(town)) if w not in STOP] if town else []
    segments: list[list[str]] = [[]]
    for t in raw:
        if t in ("|", "("):
            segments.append([])
        else:
            segments[-1].append(t)
    kind, opening, stems, tail, street, number = [], [], [], [], [], ""
    street_open, mark, whole = False, 0, False
    raw_parts = [s for s in segments if s]
    # a word of the row's own town is no slip of a vocabulary word: 'Monte' beside 'Montes'
    parts = [[t if t in town_words else vocabulary_word(t) for t in s] for s in raw_parts]
    for at, words in enumerate(parts):
        said = raw_parts[at]
        if at + 1 < len(parts) and (parts[at + 1][0].isdigit() or parts[at + 1][0] in STREET_REST) and words[0] in ("cl", "c", "co") and len(words) <= 4:
            words = ["calle", *words[1:]] if not any(w in DEDICATION for w in words) else words
        i, n = 0, len(words)
        if street_open and all(w.isdigit() or w in STREET_REST for w in words):
            number = number or next((w for w in words if w.isdigit()), "")
            continue
        street_open = False
        if words[0] in DEPARTMENT_HEAD and not _names_centre(words):
            continue
        if all(w.isdigit() or w in STREET_REST for w in words):
            number = number or next((w for w in words if w.isdigit()), "")
            street_open = True
            continue
        if any(_is_street(words, j) for j in range(n)) and _is_street(words, n - 1) and 1 < n <= 4 and not any(w in KIND for w in words[:-1]):
            street += [w for w in words[:-1] if w not in STOP]  # "Almendro (camino)" or "camino" in brackets
            street_open = True
            continue
        if n == 1 and words[0] in STREET and at:
            # "Portillo (paseo)": the street's name came just before
            before = len(stems) - mark
            take = 2 if before > 1 and stems[-1] in STREET_ADJECTIVE else 1
            if before and (len(stems) > take or whole):
                take = before if whole else take
                street += stems[len(stems) - take :]
                del stems[len(stems) - take :]
            street_open = True
            continue
        mark = len(stems)
        whole = not any(w in KIND or w in KIND_SHORT or w in DEDICATION for w in words)
        while i < n:
            w = words[i]
            if w in DEPARTMENT_HEAD and i and i + 1 < n and words[i + 1] in (DEPARTMENT | STOP):
                i += 1
                while i < n and words[i] in (DEPARTMENT | STOP):
                    i += 1
                continue
            if _is_street(words, i) and (i or at or _street_first(words)):
                street_open = True
                for x in words[i + 1 :]:
                    if x.isdigit():
                        number = number or x
                    elif x not in STREET_REST and x not in STOP:
                        street.append(x)
                break
            if w == "senora" and said[i] != w and (not i or words[i - 1] not in ("nuestra", "ntra", "nra", "nª", "n")):
                stems.append(said[i])  # a name that looks like the word, as in 'Santa Senona'
            elif w in KIND_SHORT:
                kind += KIND_SHORT[w]
            elif w == "c" and i + 1 < n and KIND.get(words[i + 1]) in ("salud", "especialidades"):
                kind.append("centro")
            elif w == "ns" or (w == "n" and i + 1 < n and words[i + 1] == "s"):
                opening += ["nuestra", "senora"]
                i += w == "n"
            elif w == "s":
                opening.append("san")
            elif w in KIND and not (w == "v"):
                kind.append(KIND[w])
            elif w in DEDICATION:
                opening.append(DEDICATION[w])
            elif w in STOP or w.isdigit() or w in STREET_REST or w in DEPARTMENT:
                number = number or (w if w.isdigit() else "")
            else:
                stems.append(w)
            i += 1
    # the short word of a kind mistyped: 'Centro de Sald', 'Inst. de Iv.'
    if len(stems) > 1 and set(kind) == {"centro"} and min(damerau(stems[0], "salud", 1), damerau(stems[0], "salut", 1)) <= 1:
        kind.append("salud")
        stems = stems[1:]
    elif len(stems) > 1 and set(kind) == {"instituto"} and len(stems[0]) <= 3 and damerau(stems[0], "inv", 1) <= 1:
        kind.append("investigacion")
        stems = stems[1:]
    if town_words and len(stems) > len(town_words) and _alike_words(stems[-len(town_words) :], town_words):
        tail = stems[-len(town_words) :]
        stems = stems[: -len(town_words)]
    named = bool(kind or opening) and bool(stems) or (bool(stems) and not street and not number)
    return Centre(tuple(sorted(set(kind) - {"zona", "clinico", "complejo"})), tuple(sorted(set(opening))), tuple(stems), tuple(tail), tuple(street), number, named)


@lru_cache(maxsize=50_000)
def abbreviation(token: str) -> tuple[str, ...]:
    """The abbreviations a token before a dot may stand for: those of three letters or more within one edit, of its own first letter first."""
    fits = [w for w in LONG_ABBREVIATIONS if abs(len(w) - len(token)) <= 1 and damerau(token, w, 1) <= 1]
    return tuple(sorted(fits, key=lambda w: (w[0] != token[0], -len(w))))


def _join_dots(raw: list[str]) -> list[str]:
    """Drop the dots that end an abbreviation; the others part the text."""
    out: list[str] = []
    for t in raw:
        if t == "." and out and out[-1] in ABBREVIATIONS:
            continue
        if t == "." and out and 3 <= len(out[-1]) <= 6:
            if vocabulary_word(out[-1]) in STREET_REST:
                continue
            near = [w for w in abbreviation(out[-1]) if w not in out[:-1]]
            if near and vocabulary_word(out[-1]) == out[-1]:
                out[-1] = near[0]
                continue
        out.append("|" if t == "." else t)
    return out


def _names_centre(words: list[str]) -> bool:
    rest = [w for w in words if w not in DEPARTMENT and w not in STOP]
    return any(w in KIND_SHORT or (w in KIND and w not in ("clinico", "general")) for w in rest)


def _is_street(words: list[str], i: int) -> bool:
    w = words[i]
    if w in STREET:
        return True
    if w in ("cl", "co") and i + 1 < len(words) and any(x.isdigit() for x in words[i + 1 :]) and not any(x in DEDICATION for x in words[i + 1 :]):
        return True
    if w == "cl" and words[i + 1 : i + 3] in (["de", "los"], ["de", "las"], ["de", "la"]):
        return True
    # "C. de Peñascal, 25": a lone c that opens no kind of centre
    return w == "c" and i + 1 < len(words) and KIND.get(words[i + 1]) not in ("salud", "especialidades") and words[i + 1] not in KIND


def _street_first(words: list[str]) -> bool:
    return not any(w in KIND or w in KIND_SHORT for w in words[1:]) or words[0] in STREET


def _alike_words(a: list[str], b: list[str]) -> bool:
    return len(a) == len(b) and all(damerau(x, y, 2) <= (2 if len(y) > 7 else 1) for x, y in zip(a, b))


# Articles that registers put after the name of a town.
ARTICLE_LAST = re.compile(r"^(.+?)\s*[,(]\s*(el|la|los|las|a|o|as|os|l)\s*['’]?\s*\)?$")


@lru_cache(maxsize=100_000)
def town_key(town: str | None) -> str:
    """A town as folded words: article in front, without the province in brackets or a second-language name; '' where missing."""
    if is_missing(town):
        return ""
    t = fold(town).strip(" .,;")
    m = ARTICLE_LAST.match(t)
    if m:
        t = f"{m[2]} {m[1]}"
    t = t.split("/")[0]
    t = re.sub(r"\(.*?\)", " ", t)
    t = t.split(",")[0]
    return " ".join(re.sub(r"[^a-z0-9?' -]", " ", t).split())


@lru_cache(maxsize=100_000)
def postcode(code: str | None) -> str | None:
    """Five digits of a postcode whose form can be mended, else null: stray points and spaces go, a lost leading zero comes back."""
    if code is None:
        return None
    t = re.sub(r"[\s.,;]", "", repair(code))
    if not re.fullmatch(r"[0-9]{4,5}", t):
        return None
    t = t.zfill(5)
    return None if t in ("00000", "99999") or not "01" <= t[:2] <= "52" else t


def is_foreign_code(code: str | None) -> bool:
    """A code of a form that is used abroad only."""
    t = fold(code).strip(" .,;")
    return bool(re.fullmatch(r"[a-z]{1,2}-?[0-9]{4,6}|[0-9]{4} ?[a-z]{2}|[a-z]{1,2}[0-9]{1,2}[a-z]? ?[0-9][a-z]{2}", t))


@lru_cache(maxsize=100_000)
def region_key(name: str | None) -> str:
    """A province or region as folded words; '' where missing."""
    return "" if is_missing(name) else " ".join(re.sub(r"[^a-z0-9?]", " ", fold(name)).split())
