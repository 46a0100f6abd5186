"""Spanish date text and month arithmetic.

Spark's ``date_format`` only speaks English, and the JDK's Spanish locale
abbreviates September as "sept"; the labels are therefore built from fixed
month-name arrays indexed by ``month()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# es_ES month names as the published pages print them.
MONTHS_ABBR_ES = ("ene", "feb", "mar", "abr", "may", "jun",
                  "jul", "ago", "sep", "oct", "nov", "dic")
MONTHS_FULL_ES = ("enero", "febrero", "marzo", "abril", "mayo", "junio",
                  "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _month_name(d: Column, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.month(d))


def _dd(d: Column) -> Column:
    return F.lpad(F.dayofmonth(d).cast("string"), 2, "0")


def _yyyy(d: Column) -> Column:
    return F.lpad(F.year(d).cast("string"), 4, "0")


def day_label(c) -> Column:
    """``%d %b %Y`` in Spanish: ``05 sep 2023``."""
    d = _col(c)
    return F.concat_ws(" ", _dd(d), _month_name(d, MONTHS_ABBR_ES), _yyyy(d))


def month_label(c) -> Column:
    """``%b %Y`` in Spanish: ``sep 2023``."""
    d = _col(c)
    return F.concat_ws(" ", _month_name(d, MONTHS_ABBR_ES), _yyyy(d))


def heading_label(c) -> Column:
    """``%d de %B del %Y`` in Spanish: ``05 de septiembre del 2023``."""
    d = _col(c)
    return F.concat(_dd(d), F.lit(" de "), _month_name(d, MONTHS_FULL_ES),
                    F.lit(" del "), _yyyy(d))


def tab_label(c) -> Column:
    """Sentence-cased full month name: ``Septiembre``."""
    from pozo.functions.text import sentence_case
    return sentence_case(_month_name(_col(c), MONTHS_FULL_ES))
