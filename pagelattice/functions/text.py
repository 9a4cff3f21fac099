"""Text, marker, font and page-field functions as Column expressions (Unicode-aware where it matters)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns that decide what counts as a list marker.
BULLETS = "•◦▪▫●○■□‣⁃⁌⁍➢➤➔✓✔"
NUMBER_BODY = r"(?:\d+(?:\.\d+)*|[A-Za-z]|[ivxlcdmIVXLCDM]+)"
BULLET_PATTERN = rf"(?U)^\s*([{BULLETS}])(?:\s+|$)"
NUMBER_PATTERN = rf"(?U)^\s*(\(\s*{NUMBER_BODY}\s*\)|{NUMBER_BODY}[.)])(?:\s+|$)"
# Symbol-font glyphs and the bullets they stand for; all bullets after replacement.
GLYPHS = {"": "•", "": "▪", "": "►", "‣": "•", "⁃": "•", "∙": "•", "●": "•"}
PLAIN_BULLETS = "•◦▪▫■□○●‣"
# Characters that take no blank before or after them.
NO_BLANK_BEFORE = ".,;:!?%)]}"
NO_BLANK_AFTER = "([{/\\–—"
PAGE_FIELD = r"(?Ui)^\s*(page\s*)?(\d+)(?:(\s*(?:of|/)\s*)(\d+))?(\s*)$"
# First style suffix that a font name ends with is removed, in this order.
STYLE_SUFFIXES = (
    "-BoldItalic", "-BoldOblique", "-Bold", "-Italic", "-Oblique", ",BoldItalic", ",Bold", ",Italic", "-ExtraBoldItalic",
    "-ExtraBold", "-SemiBoldItalic", "-SemiBold", "-MediumItalic", "-Medium", "-Regular", "-LightItalic", "-Light")
# The font family of each name that files use for one.
FONT_FAMILIES = {
    "ArialMT": "Arial",
    "Arial-BoldMT": "Arial",
    "Arial-ItalicMT": "Arial",
    "Arial-BoldItalicMT": "Arial",
    "Helvetica": "Arial",
    "Helvetica-Bold": "Arial",
    "Helvetica-Oblique": "Arial",
    "Helvetica-BoldOblique": "Arial",
    "HelveticaNeue": "Arial",
    "HelveticaNeue-Light": "Arial",
    "HelveticaNeue-UltraLight": "Arial",
    "HelveticaNeue-Italic": "Arial",
    "HelveticaNeue-LightItalic": "Arial",
    "HelveticaNeue-LightItali": "Arial",
    "HelveticaNeue-Bold": "Arial",
    "HelveticaNeue-BoldItalic": "Arial",
    "HelveticaNeue-Medium": "Arial",
    "Calibri": "Calibri",
    "Calibri-Bold": "Calibri",
    "Calibri-Italic": "Calibri",
    "Calibri-BoldItalic": "Calibri",
    "CenturySchoolbook": "Century Schoolbook",
    "CenturySchoolbook-Bold": "Century Schoolbook",
    "CenturySchoolbook-Italic": "Century Schoolbook",
    "CenturySchoolbook-BoldItalic": "Century Schoolbook",
    "CourierNewPSMT": "Courier New",
    "CourierNewPS-BoldMT": "Courier New",
    "CourierNewPS-ItalicMT": "Courier New",
    "CourierNewPS-BoldItalicMT": "Courier New",
    "TimesNewRomanPSMT": "Times New Roman",
    "TimesNewRomanPS-BoldMT": "Times New Roman",
    "TimesNewRomanPS-ItalicMT": "Times New Roman",
    "TimesNewRomanPS-BoldItalicMT": "Times New Roman",
    "Times-Roman": "Times New Roman",
    "Times-Bold": "Times New Roman",
    "Times-Italic": "Times New Roman",
    "Times-BoldItalic": "Times New Roman",
    "DMSans": "DM Sans",
    "DMSans-Regular": "DM Sans",
    "DMSans-Medium": "DM Sans",
    "DMSans-SemiBold": "DM Sans",
    "DMSans-Bold": "DM Sans",
    "DMSans-ExtraBold": "DM Sans",
    "DMSans-Italic": "DM Sans",
    "DMSans-BoldItalic": "DM Sans",
    "DM Sans": "DM Sans",
    "DM Sans Regular": "DM Sans",
    "DM Sans Medium": "DM Sans",
    "DM Sans Bold": "DM Sans",
    "Repo-ExtraBold": "Arial Black",
    "RepoExtraBold": "Arial Black",
    "Repo": "Arial Black",
}


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def collapse(c: str | Column) -> Column:
    return strip(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def inline_text(c: str | Column) -> Column:
    """Fixed-width blanks become plain ones, line and tab characters one blank, and runs collapse."""
    return F.regexp_replace(F.regexp_replace(F.translate(_c(c), "   ", "   "), r"[\t\r\n\f\x0b]+", " "), " {2,}", " ")


def normalize_glyphs(c: str | Column) -> Column:
    return F.translate(_c(c), "".join(GLYPHS), "".join(GLYPHS.values()))


def contains_bullet(c: str | Column) -> Column:
    return normalize_glyphs(c).rlike(f"[{PLAIN_BULLETS}]")


def is_bullet_only(c: str | Column) -> Column:
    return strip(normalize_glyphs(c)).rlike(f"^[{PLAIN_BULLETS}]$")


def text_marker(c: str | Column) -> Column:
    """Marker at the head of a text: a bullet, else a number or letter in brackets or with a stop; null without."""
    bullet, number = F.regexp_extract(_c(c), BULLET_PATTERN, 1), F.regexp_extract(_c(c), NUMBER_PATTERN, 1)
    return F.coalesce(F.nullif(bullet, F.lit("")), F.nullif(number, F.lit("")))


def marker_value_text(marker: Column) -> Column:
    """The marker without its brackets or stops."""
    m = strip(marker)
    inside = strip(F.regexp_replace(m, r"^\(|\)$", ""))
    return F.when(m.rlike(r"^\(.*\)$"), inside).otherwise(strip(F.regexp_replace(m, r"[.)]+$", "")))


def marker_kind(marker: Column) -> Column:
    """bullet, multilevel_decimal, decimal, lower/upper_roman, lower/upper_alpha or unknown; roman before alpha."""
    v = marker_value_text(marker)
    upper = v == F.upper(v)
    return (
        F.when(marker.isNull(), F.lit(None).cast("string"))
        .when(marker.rlike(f"^[{BULLETS}]$"), "bullet")
        .when(v.rlike(r"(?U)^\d+(\.\d+)+$"), "multilevel_decimal")
        .when(v.rlike(r"(?U)^\d+$"), "decimal")
        .when(v.rlike("(?i)^[ivxlcdm]+$"), F.when(upper, "upper_roman").otherwise("lower_roman"))
        .when(v.rlike(r"^\p{L}$"), F.when(upper, "upper_alpha").otherwise("lower_alpha"))
        .otherwise("unknown"))


def roman_value(v: Column) -> Column:
    """Subtractive sum from the right, without a check of validity; null for other letters or zero."""
    values = F.create_map(*[F.lit(x) for pair in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair])
    digits = F.reverse(F.split(F.lower(v), ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))

    def step(acc, ch):
        now = F.coalesce(F.try_element_at(values, ch), F.lit(0))
        smaller = now < acc["top"]
        return F.struct((acc["total"] + F.when(smaller, -now).otherwise(now)).alias("total"), F.when(smaller, acc["top"]).otherwise(now).alias("top"))

    total = F.aggregate(F.filter(digits, lambda x: x != ""), start, step)["total"]
    return F.when(v.rlike("(?i)^[ivxlcdm]+$"), F.nullif(total, F.lit(0)))


def marker_number(marker: Column) -> Column:
    """Numbers as they are, a single letter by its place in the alphabet, longer roman numerals by value."""
    v = marker_value_text(marker)
    letter = F.ascii(F.lower(v)) - F.ascii(F.lit("a")) + 1
    return F.when(v.rlike(r"^\d+$"), v.try_cast("int")).when(v.rlike("^[A-Za-z]$"), letter).otherwise(roman_value(v))


def marker_levels(marker: Column) -> Column:
    """1.2.3 as an array of numbers, else null."""
    v = marker_value_text(marker)
    return F.when(v.rlike(r"^\d+(\.\d+)+$"), F.transform(F.split(v, r"\."), lambda x: x.try_cast("int")))


def explicit_level(marker: Column, most: int = 8) -> Column:
    levels = marker_levels(marker)
    return F.when(levels.isNull(), 0).otherwise(F.least(F.size(levels) - 1, F.lit(most)))


def list_start(marker: Column) -> Column:
    found = F.regexp_extract(F.coalesce(marker, F.lit("")), r"^\s*(\d+)", 1).try_cast("int")
    return F.greatest(F.coalesce(found, F.lit(1)), F.lit(1))


def needs_blank(previous: Column, current: Column, gap: Column, font_size: Column) -> Column:
    """Whether a blank belongs between two pieces of a line, by their edges and the gap between them."""
    p, c = F.regexp_replace(previous, r"(?U)\s+$", ""), F.regexp_replace(current, r"(?U)^\s+", "")
    threshold = F.greatest(F.lit(0.5), F.greatest(font_size, F.lit(1.0)) * F.lit(0.04))
    return (
        F.when((previous == "") | (current == ""), False)
        .when(previous.rlike(r"(?U)\s$") | current.rlike(r"(?U)^\s"), True)
        .when(F.lit(NO_BLANK_BEFORE).contains(F.substring(c, 1, 1)) | F.lit(NO_BLANK_AFTER).contains(F.right(p, F.lit(1))), False)
        .otherwise((gap > 0) & (gap >= threshold)))


def needs_boundary_blank(previous: Column, current: Column) -> Column:
    """Whether a blank belongs between two wrapped lines."""
    return (
        F.when((previous == "") | (current == ""), False)
        .when(previous.rlike(r"(?U)\s$") | current.rlike(r"(?U)^\s"), False)
        .otherwise(~(F.lit(NO_BLANK_BEFORE).contains(F.substring(current, 1, 1)) | F.lit(NO_BLANK_AFTER + "-").contains(F.right(previous, F.lit(1))))))


def page_field(c: str | Column) -> Column:
    """Prefix, separator and whether a total follows, of texts such as `Page 3 of 9`; null for others."""
    t = strip(c)
    part = lambda k: F.regexp_extract(t, PAGE_FIELD, k)
    return F.when(t.rlike(PAGE_FIELD), F.struct(part(1).alias("prefix"), part(3).alias("separator"), part(5).alias("suffix"), (part(4) != "").alias("has_total")))


def signature(c: str | Column) -> Column:
    """Text that repeats on pages but for its numbers, as one signature; null text as empty.

    Compatibility forms (NFKC) have no built-in: the column comes through operators.unicode.nfkc where they count.
    """
    t = F.lower(collapse(F.coalesce(_c(c), F.lit(""))))
    number = r"(?:\d+|[ivxlcdm]+)"
    is_page = t.rlike(rf"(?U)^(?:page\s*)?{number}(?:\s*(?:of|/)\s*{number})?$")
    n = F.regexp_replace(t, r"(?U)\d+(?:[.,:/-]\d+)*", "<n>")
    n = collapse(F.regexp_replace(n, r"(?U)[^\w<>]+", " "))
    return F.when(t == "", "").when(is_page, "__page_number__").when(F.char_length(n) < 2, "").otherwise(n)


def font_family(c: str | Column) -> Column:
    """Family of a font name: without subset prefix and style, by alias or made readable."""
    name = F.regexp_replace(F.trim(F.coalesce(_c(c), F.lit(""))), r"^[A-Z]{6}\+", "")
    alias = F.create_map(*[F.lit(x) for pair in FONT_FAMILIES.items() for x in pair])
    bare = F.coalesce(*[F.when(name.endswith(s), F.substr(name, F.lit(1), F.char_length(name) - len(s))) for s in STYLE_SUFFIXES], name)
    readable = F.trim(F.regexp_replace(F.replace(bare, F.lit("_"), F.lit(" ")), "(?<=[a-z])(?=[A-Z])", " "))
    return F.when(name == "", "Arial").otherwise(F.coalesce(F.try_element_at(alias, name), F.try_element_at(alias, bare), readable))


def joined_lines(texts: Column) -> Column:
    """Stripped non-empty lines joined by a blank."""
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), " ")
