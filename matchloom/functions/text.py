"""Column functions for es-AR numbers, units, notes, descriptions and report text.  No Python runs per row."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Precomposed letters of the Latin, Greek and Cyrillic blocks, and their bases."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]]
    pairs = [(c, d[0]) for c, d in found if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _PLAIN = _accents()


def strip_accents(text: Column) -> Column:
    """Letters without their combining marks, precomposed or not."""
    # Text of one byte a character has none, and goes without the long table.
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{M}+", ""))


def folded(text: Column) -> Column:
    return F.lower(strip_accents(text))


def collapsed(text: Column) -> Column:
    """Single spaces for white space (no-break spaces too), none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cell_text(value: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(value.cast("string"), r"^(?U)\s+|\s+$", "")), F.lit(""))


def canon(value: Column) -> Column:
    return F.regexp_replace(folded(F.coalesce(value.cast("string"), F.lit(""))), "[^a-z0-9]", "")


def _bare_number(raw: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(raw, " ", " "), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^(ars|usd|\$|u\$s)\s*", ""), r"(?U)\s", "")


def number_is_unreadable(raw: Column) -> Column:
    """Whether text that isn't blank is no es-AR number."""
    bare = _bare_number(raw)
    return raw.isNotNull() & ~bare.isin("", "-") & parse_arg_number(raw).isNull()


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, which keeps generated code small where a text is used many times."""
    return F.transform(F.array(value), body)[0]


def parse_arg_number(raw: Column) -> Column:
    """es-AR text to double; null for null, blank, `-` and unreadable text.

    Of both separators the last is the decimal one.  A comma alone is decimal (of several the
    last); dots alone are thousands if there are several or if three digits follow.
    """
    return let(_bare_number(raw), lambda bare: let(F.regexp_replace(bare, "^[-+]", ""), lambda digits: _signed(bare, _plain_number(digits))))


def _signed(bare: Column, plain: Column) -> Column:
    return let(plain.try_cast("double"), lambda value: F.when(bare.startswith("-"), -value).otherwise(value))


def _plain_number(digits: Column) -> Column:
    """Digits with at most one decimal point, from digits, dots and commas; null for other text."""
    without_dots = F.replace(digits, F.lit("."))
    comma_decimal = F.replace(F.regexp_replace(without_dots, ",(?=.*,)", ""), F.lit(","), F.lit("."))
    return (
        F.when(~F.regexp_like(digits, F.lit("^[0-9.,]+$")), F.lit(None))
        .when(F.regexp_like(digits, F.lit(r"\..*,[^.]*$")), F.when(~F.regexp_like(digits, F.lit(",.*,")), comma_decimal))
        .when(F.regexp_like(digits, F.lit(r",.*\.[^,]*$")), F.when(~F.regexp_like(digits, F.lit(r"\..*\.")), F.replace(digits, F.lit(","))))
        .when(F.contains(digits, F.lit(",")), comma_decimal)
        .when(F.regexp_like(digits, F.lit(r"\..*\.|\.[0-9]{3}$")), without_dots)
        .otherwise(digits)
    )


def require_arg_number(raw: Column) -> Column:
    return F.coalesce(parse_arg_number(raw), F.raise_error(F.concat(F.lit("a number is needed: "), F.coalesce(raw, F.lit("null")))).cast("double"))


# Supplier words for units.
UNIT_WORDS = {
    "unit": ("unidad", "unidades", "un", "u", "uds", "ud", "c_u"),
    "meter": ("metro", "metros", "mts", "mt", "m", "ml"),
    "roll": ("rollo", "rollos", "rll"),
    "box": ("caja", "cajas", "cja"),
    "bag": ("bolsa", "bolsas"),
    "pack": ("paquete", "paquetes", "pack", "paq"),
    "pair": ("par", "pares"),
    "set": ("set", "sets", "juego"),
    "kit": ("kit", "kits"),
    "can": ("lata", "latas"),
    "bucket": ("balde", "baldes"),
    "drum": ("bidon", "bidones"),
    "liter": ("litro", "litros", "lt", "l"),
    "tube": ("tubo", "tubos"),
    "cartridge": ("cartucho", "cartuchos"),
    "sheet": ("hoja", "hojas"),
    "jar": ("pomo", "pomos"),
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


UNIT_OF_WORD = {word: unit for unit, words in UNIT_WORDS.items() for word in words}


def normalize_unit(raw: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.trim(folded(raw)), r"\.$", ""), r"\s+", "_")
    known = literal_map(UNIT_OF_WORD)
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.replace(key, F.lit("_"))))


# What notes say, on text without accents and in lower case.
NOTE_PATTERNS = {
    "technical_equivalent": r"equivalente\s+tecnic",
    "alternative_line": r"equivalente\s+alternativ|linea\s+alternativa|alternativa\s+para",
    "partial_stock": r"stock\s+parcial|disponibilidad\s+parcial|cantidad\s+(?:disponible\s+)?menor|menor\s+a\s+(?:la|lo)\s+solicitad",
    "min_order_qty": r"bulto\s+minimo|presentacion\s+comercial|minimo\s+de\s+venta",
    "brand_to_confirm": r"marca\s+a\s+confirmar",
    "extra_suggested": r"adicional\s+sugerido|adicional\s+no\s+pedido|sugerido\s+para\s+stock",
}
_PREFIX, _SUFFIX = r"^equivalente\s+tecnic[oa]s?\s+", r"\s+linea\s+alternativa$"


def parse_notes(raw: Column) -> Column:
    """Struct of flags, in order of first appearance, and of unrecognised fragments."""
    no_text = F.array().cast("array<string>")
    fragments = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[;|]"), lambda f: F.trim(f)), lambda f: F.length(f) > 0)

    def hits(fragment: Column) -> Column:
        plain = folded(fragment)
        return F.filter(F.array(*[F.when(plain.rlike(p), F.lit(flag)) for flag, p in NOTE_PATTERNS.items()]), lambda x: x.isNotNull())

    flags = F.array_distinct(F.flatten(F.transform(fragments, hits)))
    unknown = F.filter(fragments, lambda f: F.size(hits(f)) == 0)
    return F.struct(F.coalesce(flags, no_text).alias("flags"), F.coalesce(unknown, no_text).alias("unrecognized"))


def parse_description(raw: Column) -> Column:
    """Struct of the description without its markers, and the flags they stand for."""

    def cut(text: Column) -> Column:
        head = F.length(F.regexp_extract(folded(text), _PREFIX, 0))
        return F.struct((head > 0).alias("head"), F.trim(F.substring(text, head + 1, F.length(text))).alias("rest"))

    def ended(c: Column) -> Column:
        return let(F.length(F.regexp_extract(folded(c["rest"]), _SUFFIX, 0)), lambda tail: parsed(c, tail))

    def parsed(c: Column, tail: Column) -> Column:
        flags = F.filter(F.array(F.when(c["head"], "technical_equivalent"), F.when(tail > 0, "alternative_line")), lambda x: x.isNotNull())
        return F.struct(F.trim(F.substring(c["rest"], F.lit(1), F.length(c["rest"]) - tail)).alias("description"), flags.alias("flags"))

    return let(let(collapsed(raw), cut), ended)


def embedding_text(description: Column, unit: Column) -> Column:
    clean = F.trim(F.regexp_replace(folded(description), r"\s+", " "))
    return F.when(unit.isNotNull(), F.concat(clean, F.lit(" ["), unit, F.lit("]"))).otherwise(clean)


def normalize_date(value: Column) -> Column:
    """ISO day of an ISO start, a whole d/m/Y or d-m-Y, or a spreadsheet's day number; else null."""
    iso = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})", 1)
    serial = value.try_cast("double")
    day = F.when((serial > 20000) & (serial < 60000), F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")), "yyyy-MM-dd"))
    return F.when(iso != "", iso).otherwise(F.coalesce(_day_month_year(value, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"), day))


def normalize_iso_date(value: Column) -> Column:
    """As normalize_date, anywhere in the text, without day numbers."""
    iso = F.regexp_extract(value, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(iso != "", iso).otherwise(_day_month_year(value, r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"))


def _day_month_year(value: Column, pattern: str) -> Column:
    day, month, year = (F.regexp_extract(value, pattern, k) for k in (1, 2, 3))
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def es_number(value: Column, places: int) -> Column:
    return F.translate(F.format_number(value, places), ",.", ".,")


def money(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("$ "), es_number(value, 2)))


def qty(value: Column) -> Column:
    """At most three decimals."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.regexp_replace(F.regexp_replace(es_number(value, 3), r"(,\d*?)0+$", "$1"), ",$", ""))


def delta(value: Column) -> Column:
    sign = F.when(value > 0, F.lit("+")).otherwise(F.lit("-"))
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit("-")).otherwise(F.concat(sign, qty(F.abs(value))))


def pct(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", value.cast("double")), F.lit("%"))


def markdown_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def slug(code: Column, file: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat_ws("_", code, F.regexp_replace(file, r"\.[^.]+$", "")), "[^a-zA-Z0-9_.-]", "_"))
