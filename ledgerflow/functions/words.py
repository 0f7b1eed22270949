"""Amount in Spanish words for cheques and receipts, as native column expressions.

The amount is split into digit groups (millions, thousands, units, cents); each group is looked up in a table of the 1000 spellings of a group, built
once from the word lists below when the plan is made (a literal array that Catalyst
folds into a constant); the pieces are concatenated. Per row this is a handful of JVM
string functions and three array lookups inside whole-stage codegen — no Python runs on
the executors.

Rules (in order): amounts above 999,999,999.99 give ``---`` (and, here, also amounts
below -999,999,999.99, which the original spells from a text cut to 12 characters); the
amount is taken with two decimals and its sign remembered; hundreds read ``cien``
for exactly 100 and ``ciento`` for 1xx; 21 and 1 in the units group read ``veintiuno``
and ``un``, x1 above 30 ends in ``uno``; a thousands group of exactly 1 prints only
``mil``; cents print as `` con N/100``; nothing at all prints ``cero``. Currency 1 and 2
insert their name before ``con`` or append ``<name> exactos``; other currencies and NULL
amounts give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions._cols import as_col

# Number words 1..29, tens 1..9 (10 and 20 are spelled in the first list),
# hundreds 1..9, and the currency names by currency id.
UNITS = [
    "un", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez",
    "once", "doce", "trece", "catorce", "quince", "dieciseis", "diecisiete", "dieciocho",
    "diecinueve", "veinte", "veintiun", "veintidos", "veintitres", "veinticuatro",
    "veinticinco", "veintiseis", "veintisiete", "veintiocho", "veintinueve",
]
TENS = ["", "", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa"]
HUNDREDS = [
    "ciento", "doscientos", "trescientos", "cuatrocientos", "quinientos", "seiscientos",
    "setecientos", "ochocientos", "novecientos",
]
CURRENCIES = {1: "quetzales", 2: "dolares"}
MAX_AMOUNT = "999999999.99"


def spell_group(n: int, pos: int) -> str:
    """Words of one three-digit group ``n`` (0..999); ``pos`` 1 = millions, 2 = thousands,
    3 = units. Each word carries its leading space, as the pieces are concatenated."""
    h, r = divmod(n, 100)
    t, u = divmod(r, 10)
    out = ""
    if h:
        out += (" cien" if r == 0 else " ciento") if h == 1 else " " + HUNDREDS[h - 1]
    if 0 < r < 30:
        if pos == 3 and r == 21:
            out += " veintiuno"
        elif pos == 2 and n == 1:
            pass                                    # 1,000 reads "mil", not "un mil"
        else:
            out += " " + UNITS[r - 1]
    elif r >= 30:
        out += " " + TENS[t - 1]
        if u == 1 and pos == 3:
            out += " y uno"
        elif u:
            out += " y " + UNITS[u - 1]
    if n and pos == 1:
        out += " millón" if n == 1 else " millones"
    elif n and pos == 2:
        out += " mil"
    return out


def _group_table(pos: int) -> Column:
    """Array of the 1000 spellings of a group: one literal text split on ``;`` (a single
    call from Python; Catalyst folds it into a constant array)."""
    return F.split(F.lit(";".join(spell_group(n, pos) for n in range(1000))), ";")


def _group(n: Column, pos: int) -> Column:
    return F.element_at(_group_table(pos), n + 1)


def amount_in_words(amount, currency=1) -> Column:
    """Spanish words for ``amount`` in ``currency`` (1 quetzales, 2 dolares).

    The digit groups come from integer arithmetic on the exact two-decimal amount
    (cents, then ``div``/``%``), not from text, so each row costs a few integer operations
    and three array lookups. No number word contains ``con``, so the currency name goes
    before `` con N/100`` exactly when there are cents, else `` <name> exactos`` is
    appended; every piece of text is built once.
    """
    given = as_col(amount).try_cast("decimal(38,2)")
    limit = F.lit(MAX_AMOUNT).cast("decimal(38,2)")
    num = F.when(F.abs(given) <= limit, given).cast("decimal(12,2)")
    cur = as_col(currency) if not isinstance(currency, int) else F.lit(currency)
    cents_all = (F.abs(num) * 100).cast("bigint")
    whole = F.floor(cents_all / 100).cast("bigint")
    g1 = F.floor(whole / 1_000_000).cast("int")
    g2 = (F.floor(whole / 1000) % 1000).cast("int")
    g3 = (whole % 1000).cast("int")
    cents = (cents_all % 100).cast("int")
    body = F.when(whole == 0, F.lit(" cero")).otherwise(
        F.concat(_group(g1, 1), _group(g2, 2), _group(g3, 3)))
    name = None
    for cid, label in CURRENCIES.items():
        name = F.when(cur == cid, F.lit(label)) if name is None else name.when(cur == cid, F.lit(label))
    tail = F.when(cents > 0, F.concat(F.lit(" "), name, F.lit(" con "), cents.cast("string"), F.lit("/100"))) \
            .otherwise(F.concat(F.lit(" "), name, F.lit(" exactos")))
    sign = F.when(num < 0, F.lit("-")).otherwise(F.lit(""))
    words = F.concat(sign, F.ltrim(body), tail)
    return (F.when(given.isNull(), F.lit(None).cast("string"))
             .when(F.abs(given) > limit, F.lit("---"))
             .otherwise(words))
