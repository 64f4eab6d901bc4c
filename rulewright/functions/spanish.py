"""Numbers and amounts in Spanish words, as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish cardinals in the short form used before a noun, by the number they name.
CARDINALS = {
    1: "un", 2: "dos", 3: "tres", 4: "cuatro", 5: "cinco", 6: "seis", 7: "siete", 8: "ocho", 9: "nueve", 10: "diez", 11: "once", 12: "doce", 13: "trece", 14: "catorce",
    15: "quince", 16: "dieciséis", 17: "diecisiete", 18: "dieciocho", 19: "diecinueve", 20: "veinte", 21: "veintiún", 22: "veintidós", 23: "veintitrés", 24: "veinticuatro",
    25: "veinticinco", 26: "veintiséis", 27: "veintisiete", 28: "veintiocho", 29: "veintinueve", 30: "treinta", 40: "cuarenta", 50: "cincuenta", 60: "sesenta", 70: "setenta",
    80: "ochenta", 90: "noventa", 100: "ciento", 200: "doscientos", 300: "trescientos", 400: "cuatrocientos", 500: "quinientos", 600: "seiscientos", 700: "setecientos",
    800: "ochocientos", 900: "novecientos",
}
#: Size, its name alone (for one of it), its name after a count.
SCALES = ((1_000_000, "un millón", "millones"), (1_000, "mil", "mil"), (1, "un", None))


@cache
def spelled() -> tuple[str, ...]:
    """The words of 0 (none) to 999: the largest cardinal that fits, then what is left."""
    words = [""]
    for n in range(1, 1000):
        most = max(c for c in CARDINALS if c <= n)
        link = " y " if 30 <= most < 100 else " "
        words.append("cien" if n == 100 else link.join(filter(None, (CARDINALS[most], words[n - most]))))
    return tuple(words)


def number_words(n: Column) -> Column:
    """A whole number from 0 to 999,999,999 in words, group of three digits by group; null beyond."""
    n, table = n.cast("long"), F.lit(list(spelled()))
    groups = []
    for size, alone, name in SCALES:
        count = (F.floor(n / size) % 1000).cast("int")
        groups.append(F.when(count == 1, alone).when(count > 1, F.concat_ws(" ", F.get(table, count), F.lit(name))))
    return F.when(n == 0, "cero").when(n.between(1, 999_999_999), F.concat_ws(" ", *groups))


def amount_text(words: Column, cents: Column, link: Column) -> Column:
    """Words, link (null: none), unit and the fraction of a hundred, in capitals."""
    return F.when(words.isNotNull(), F.upper(F.concat_ws(" ", words, link, F.lit("pesos"), F.format_string("%02d/100 M.N.", cents))))


def money_words(amount: Column) -> Column:
    """An amount of pesos in capital words, cents as a fraction; halves of a cent round up."""
    in_cents = (amount.cast("decimal(18,2)") * 100).cast("long")
    pesos = F.floor(in_cents / 100).cast("long")
    whole_millions = (pesos > 0) & (pesos % SCALES[0][0] == 0)
    return amount_text(number_words(pesos), (in_cents % 100).cast("int"), F.when(whole_millions, "de"))
