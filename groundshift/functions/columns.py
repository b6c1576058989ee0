"""Column expressions: index algebra, text normalisation, id parsing."""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that make a pixel unusable (fixed values).
UNUSABLE_CLASSES = (0, 1, 3, 8, 9, 10, 11)
#: Code points that are folded: the planes with letters, and the compatibility ideographs.
FOLDED = (range(0x20000), range(0x2F800, 0x2FA20))
HANGUL = range(0xAC00, 0xD7A4)


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) in doubles; null where a band is null or the sum is zero, never NaN."""
    x, y = a.cast("double"), b.cast("double")
    return F.try_divide(x - y, x + y)


def ndvi(red: Column, nir: Column) -> Column:
    return ratio(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return ratio(green, nir)


def nbr(nir: Column, swir22: Column) -> Column:
    return ratio(nir, swir22)


def usable(*classes: Column) -> Column:
    """Usable in every given scene; a null class is not."""
    out = F.lit(True)
    for c in classes:
        out = out & F.coalesce(~c.isin(*UNUSABLE_CLASSES), F.lit(False))
    return out


def passes(value: Column, direction: str, threshold: float) -> Column:
    """A threshold rule; null never passes."""
    test = {"increase": value >= threshold, "decrease": value <= -threshold, "at_least": value >= threshold, "at_most": value <= threshold}[direction]
    return F.coalesce(test, F.lit(False))


def _fold(c: str) -> str:
    """Compatibility decomposition without combining marks, in folded case."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()


@cache
def _foldings(below: int) -> tuple[str, str]:
    """Letters below a code point that fold to one letter, and those letters; what follows them is dropped."""
    one, plain, dropped = [], [], []
    for c in map(chr, chain(*FOLDED)):
        if ord(c) >= below or ord(c) in HANGUL or 0xD800 <= ord(c) < 0xE000:
            continue
        f = _fold(c)
        if not f:
            dropped.append(c)
        elif len(f) == 1 and f != c:
            one.append(c)
            plain.append(f)
    return "".join(one + dropped), "".join(plain)


@cache
def _longer() -> tuple[str, str]:
    """Letters below U+0100 that fold to several, as members of a regex class; and for each 256 code points a map of those in it, as JSON."""
    pages = [{} for _ in range(FOLDED[-1].stop >> 8)]
    for c in map(chr, chain(*FOLDED)):
        if ord(c) not in HANGUL and not 0xD800 <= ord(c) < 0xE000 and len(_fold(c)) > 1:
            pages[ord(c) >> 8][c] = _fold(c)
    return "".join(f"\\x{{{ord(c):x}}}" for c in pages[0]), json.dumps(pages)


def _spelled(c: Column) -> Column:
    """A letter, or the several that it folds to. Hangul syllables are taken apart by rule."""
    code = F.ascii(c)
    at = code - HANGUL.start
    jamo = lambda first, n: F.array(*[F.lit(chr(first + i)) for i in range(n)])
    syllable = F.concat(F.get(jamo(0x1100, 19), F.floor(at / 588).cast("int")), F.get(jamo(0x1161, 21), F.floor(at % 588 / 28).cast("int")), F.when(at % 28 > 0, F.get(jamo(0x11A7, 28), at % 28)).otherwise(""))
    page = F.get(F.from_json(F.lit(_longer()[1]), "array<map<string,string>>"), F.shiftright(code, 8))
    return F.when(code.between(HANGUL.start, HANGUL.stop - 1), syllable).otherwise(F.coalesce(F.element_at(page, c), c))


def normalize_text(text: Column) -> Column:
    """Compatibility decomposition without combining marks, folded case, single spaces, trimmed; null stays null.

    Ligatures, fractions, Hangul syllables and the like become several letters. ASCII texts take
    the lower case only, those of Latin letters below U+0100 a table of those.
    """
    members, _ = _longer()
    one, plain = _foldings(FOLDED[-1].stop)
    long_way = F.translate(F.array_join(F.transform(F.split(text, ""), _spelled), ""), one, plain)
    bare = F.when(~F.rlike(text, F.lit(r"[^\x00-\x7f]")), F.lower(text)).when(~F.rlike(text, F.lit(rf"[^\x00-\xff]|[{members}]")), F.translate(text, *_foldings(0x100))).otherwise(long_way)
    return F.trim(F.regexp_replace(bare, r"[\s\x1c-\x1f\x85\x{1680}\x{2028}\x{2029}]+", " "))


def title_key(text: Column) -> Column:
    """Comparison key of a title: normalised, other than letters, digits and spaces as one space."""
    return F.trim(F.regexp_replace(normalize_text(text), "[^0-9a-z]+", " "))


def holds_term(hay: Column, needle: Column, tail: bool) -> Column:
    """Whether a folded text has a folded term from the beginning of a word on and, with ``tail``, to the end of one."""
    quoted = F.concat(F.lit(r"(?<![0-9a-z])\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + ("(?![0-9a-z])" if tail else "")))
    return (needle != "") & F.contains(hay, needle) & F.regexp_like(hay, quoted)


def _matches(text: Column, terms: Column, tail: bool) -> Column:
    # the text is folded once, as the start of a one-element list, and each term once
    folded = F.transform(terms, lambda t: F.struct(t.alias("term"), normalize_text(t).alias("needle")))
    hits = F.transform(F.array(normalize_text(text)), lambda hay: F.filter(folded, lambda t: holds_term(hay, t["needle"], tail)))
    return F.get(hits, 0)["term"]


def match_terms(text: Column, terms: Column) -> Column:
    """The terms that occur as whole words, in their order and original spelling; see ``operators.articles.term_hits`` for many rows and terms."""
    return _matches(text, terms, True)


def match_stems(text: Column, stems: Column) -> Column:
    """The stems that begin a word, in their order and original spelling."""
    return _matches(text, stems, False)


def epsg_of_tile(stac_id: Column) -> Column:
    """Native UTM zone of a scene id's tile; band letters below N lie south."""
    tile = F.get(F.split(stac_id, "_"), 1)
    return (F.when(F.upper(F.substring(tile, 3, 1)) < "N", 32700).otherwise(32600) + F.substring(tile, 1, 2).try_cast("int")).cast("int")


def capture_date(stac_id: Column) -> Column:
    return F.try_to_date(F.get(F.split(stac_id, "_"), 2), "yyyyMMdd")


#: Figures in claims (fixed patterns).
AREA = r"(\d[\d,]*(?:\.\d+)?)\s*(km²|km2|hectares?|ha|m²|m2|sq\s?m)(?![a-zA-Z])"
PERCENT = r"\d[\d,.]*\s*%"
ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_YEAR = rf"({'|'.join(MONTHS)}),?\s+(\d{{4}})"
REPORTED = r"\b(reports?|reported|reportedly|according to|regional news|local media|press reports?|news outlets?|coverage indicates|media reports?)\b"
OBSERVED = (
    r"\b(imagery (?:shows|confirms|reveals|indicates)|satellite (?:imagery |data )?(?:shows|confirms|reveals)|we (?:observe|observed|detect|detected)|detected|"
    r"is visible|are visible|analysis shows|the data shows|pixels? (?:show|confirm))\b"
)


def area_mentions(text: Column) -> Column:
    """Array of the quoted areas in square metres, in order."""
    values = F.regexp_extract_all(text, F.lit("(?i)" + AREA), F.lit(1))
    units = F.regexp_extract_all(text, F.lit("(?i)" + AREA), F.lit(2))

    def metres(v: Column, u: Column) -> Column:
        unit = F.regexp_replace(F.lower(u), r"\s", "")
        scale = F.when(unit.isin("km²", "km2"), 1e6).when((unit == "ha") | unit.startswith("hectare"), 1e4).otherwise(1.0)
        return F.replace(v, F.lit(","), F.lit("")).cast("double") * scale

    return F.zip_with(values, units, metres)


def iso_mentions(text: Column) -> Column:
    """Array of ISO dates as written, one- or two-digit parts."""
    return F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(0))


def iso_date(mention: Column) -> Column:
    """The date of an ISO mention, null if there is no such day."""
    p = F.split(mention, "-")
    return F.try_to_date(F.concat_ws("-", F.get(p, 0), F.lpad(F.get(p, 1), 2, "0"), F.lpad(F.get(p, 2), 2, "0")), "yyyy-MM-dd")


def month_mentions(text: Column) -> Column:
    """Array of month mentions as year * 100 + month."""
    names = F.regexp_extract_all(text, F.lit("(?i)" + MONTH_YEAR), F.lit(1))
    years = F.regexp_extract_all(text, F.lit("(?i)" + MONTH_YEAR), F.lit(2))
    number = F.array(*[F.lit(m.lower()) for m in MONTHS])
    return F.zip_with(names, years, lambda n, y: (y.cast("int") * 100 + F.array_position(number, F.lower(n))).cast("int"))


def has_quantity(text: Column) -> Column:
    return F.rlike(text, F.lit("(?i)" + AREA)) | F.rlike(text, F.lit(PERCENT)) | F.rlike(text, F.lit(ISO_DATE)) | F.rlike(text, F.lit("(?i)" + MONTH_YEAR))
