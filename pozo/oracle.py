"""Oracle SQL (DuckDB dialect) for every registered query.

Each statement rebuilds the four inputs from the driver's tables with the
same mapping as :mod:`pozo.sources.adapter`, then states the report in plain
SQL. Amounts are compared as DOUBLE, counts and positions as BIGINT.
"""

from __future__ import annotations

import datetime as _dt

from pozo.functions.dates import MONTHS_ABBR_ES, MONTHS_FULL_ES
from pozo.plans.display import CARD_TEMPLATE
from pozo.registry import (AS_OF, DEEP_PAGE_SPEC, DUES_SEARCH_QUERY, EXPENSE_PAGE_SPEC, PAGE_SPEC, REPORT_PARAMS,
                           SEARCH_QUERY, SORT_SPEC)


def _list(values) -> str:
    """A DuckDB list literal of strings."""
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def title(s: str) -> str:
    """Title case, character by character (DuckDB has no look-behind)."""
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({s}, i - 1, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}''.]') "
            f"THEN upper(substr({s}, i, 1)) ELSE lower(substr({s}, i, 1)) END), '')")


def _dd(d):
    return f"lpad(CAST(day({d}) AS VARCHAR), 2, '0')"


def _yyyy(d):
    return f"lpad(CAST(year({d}) AS VARCHAR), 4, '0')"


def day_label(d):
    """``%d %b %Y`` in Spanish, as :func:`pozo.functions.day_label`."""
    return f"({_dd(d)} || ' ' || {_list(MONTHS_ABBR_ES)}[month({d})] || ' ' || {_yyyy(d)})"


def month_label(d):
    """``%b %Y`` in Spanish."""
    return f"({_list(MONTHS_ABBR_ES)}[month({d})] || ' ' || {_yyyy(d)})"


def heading_label(d):
    """``%d de %B del %Y`` in Spanish."""
    return f"({_dd(d)} || ' de ' || {_list(MONTHS_FULL_ES)}[month({d})] || ' del ' || {_yyyy(d)})"


def tab_label(d):
    """Sentence-cased full month name."""
    n = f"{_list(MONTHS_FULL_ES)}[month({d})]"
    return f"(upper(substr({n}, 1, 1)) || lower(substr({n}, 2)))"


def _strip_zeros(s):
    return f"regexp_replace(regexp_replace({s}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def fmt_amount(x):
    """Amount text by R's rules, as :func:`pozo.functions.format_amount`."""
    places = f"greatest(0, least(2, 7 - length(CAST(CAST(floor(abs({x})) AS HUGEINT) AS VARCHAR))))"
    text = (f"CASE WHEN {places} = 0 THEN format('{{:,.0f}}', CAST(round_even({x}, 0) AS DOUBLE)) "
            f"WHEN {places} = 1 THEN format('{{:,.1f}}', CAST(round_even({x}, 1) AS DOUBLE)) "
            f"ELSE format('{{:,.2f}}', CAST({x} AS DOUBLE)) END")
    return _strip_zeros(text)


def js_number(x):
    """A decimal as the browser prints it (no trailing fraction zeros)."""
    return _strip_zeros(f"CAST({x} AS VARCHAR)")


INPUTS = f"""
aportes AS (
  SELECT {title('c.c_name')} AS miembro,
         CAST(o.o_orderdate AS DATE) AS fecha,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS aporte,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Técnica' WHEN '2-HIGH' THEN 'Multa técnica'
              WHEN '5-LOW' THEN 'Donación' ELSE 'Aporte' END AS concepto
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
miembros AS (
  SELECT c_name AS nombre_pago,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Inactivo'
              WHEN c_mktsegment <> 'MACHINERY' THEN 'Activo' END AS condicion,
         make_date(2000, CAST(c_custkey % 12 + 1 AS INTEGER), 1) AS fecha_inicio,
         c_name AS nombre,
         CASE WHEN c_acctbal >= 0 THEN 'avatars/' || CAST(c_custkey AS VARCHAR) || '.png' END AS avatar_img
  FROM customer),
gastos AS (
  SELECT CAST(l_shipdate AS DATE) AS fecha, l_returnflag || l_linestatus AS item,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS monto
  FROM lineitem),
multas AS (
  SELECT CAST(ts AS DATE) AS "Fecha", CAST(user_id AS VARCHAR) AS "Deudor",
         event_type AS "Concepto", CAST(value AS DECIMAL(18,2)) AS "Monto"
  FROM events)
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([INPUTS.strip(), *ctes]) + "\n"


def _summary_cte(name: str, where: str = "TRUE", base: str = "aportes") -> str:
    return (f"{name} AS (SELECT miembro, count(*) AS cantidad_aportes, "
            f"coalesce(sum(aporte), 0) AS total FROM {base} WHERE {where} GROUP BY miembro)")


def _month_bounds(as_of: str | None) -> str:
    cap = f"WHERE fecha <= DATE '{as_of}'" if as_of else ""
    return (f"led AS (SELECT * FROM aportes {cap}), "
            f"mb AS (SELECT CAST(date_trunc('month', max(fecha)) AS DATE) AS m FROM led)")


def _strict(cat: str) -> str:
    """Strict per-category sum: NULL when missing or when any amount is NULL."""
    f = f"FILTER (WHERE concepto = '{cat}')"
    return (f"CASE WHEN count(*) {f} > 0 AND count(aporte) {f} = count(*) {f} "
            f"THEN sum(aporte) {f} END")


# The categories the driver's orders map to.
CATEGORIES = ("Aporte", "Donación", "Multa técnica", "Técnica")


def _active_months(year: int, mode: str) -> str:
    if mode == "month_only":
        return "(nm.nmonth - (month(m.fecha_inicio) - 1))"
    return (f"(CASE WHEN m.fecha_inicio IS NULL OR nm.nmonth IS NULL THEN NULL "
            f"WHEN year(m.fecha_inicio) > {year} THEN 0 "
            f"ELSE greatest(0, nm.nmonth - (CASE WHEN year(m.fecha_inicio) < {year} THEN 1 "
            f"ELSE month(m.fecha_inicio) END - 1)) END)")


def _dues_ctes(year: int, mode: str = "month_only", as_of=None) -> list[str]:
    p = REPORT_PARAMS
    lo, hi = f"DATE '{year}-01-01'", f"DATE '{year + 1}-01-01'"
    if as_of is not None:
        hi = f"DATE '{(as_of + _dt.timedelta(days=1)).isoformat()}'" if as_of.year == year else hi
    cats = ", ".join(f'{_strict(c)} AS "{c}"' for c in CATEGORIES)
    return [
        f"y AS (SELECT * FROM aportes WHERE fecha >= {lo} AND fecha < {hi})",
        f"pv AS (SELECT miembro, {cats} FROM y GROUP BY miembro)",
        "nm AS (SELECT max(month(fecha)) AS nmonth FROM y)",
        f"""jd AS (SELECT {title('m.nombre_pago')} AS miembro, m.condicion, m.fecha_inicio,
                 pv."Técnica", pv."Multa técnica", coalesce(pv."Aporte", 0) AS "Aporte",
                 CASE WHEN m.condicion IS NULL OR m.condicion = '{p.inactive_label}' THEN 0
                      ELSE {_active_months(year, mode)} * {p.dues} END AS objetivo
          FROM miembros m LEFT JOIN pv ON {title('m.nombre_pago')} IS NOT DISTINCT FROM pv.miembro,
          nm)""",
        f"""du AS (SELECT *, CASE WHEN condicion = '{p.inactive_label}' THEN {p.inactive_balance}
                             ELSE "Aporte" - objetivo END AS balance FROM jd)""",
    ]


def oracle_sql() -> dict[str, str]:
    p = REPORT_PARAMS
    year = p.report_year()
    q: dict[str, str] = {}

    q["q_ledger_prep"] = _with() + """
SELECT miembro, fecha, CAST(aporte AS DOUBLE) AS aporte, concepto FROM aportes"""

    q["q_member_summary"] = _with(_summary_cte("s")) + """
SELECT miembro, cantidad_aportes, CAST(total AS DOUBLE) AS total FROM s"""

    q["q_member_detail"] = _with() + """
SELECT miembro,
       row_number() OVER (PARTITION BY miembro ORDER BY fecha DESC NULLS LAST,
                          aporte DESC NULLS LAST, concepto DESC NULLS LAST) AS pos,
       fecha, CAST(aporte AS DOUBLE) AS aporte, concepto
FROM aportes"""

    q["q_member_pages"] = _with(
        """d AS (SELECT miembro, row_number() OVER (PARTITION BY miembro ORDER BY fecha DESC NULLS LAST,
                   aporte DESC NULLS LAST, concepto DESC NULLS LAST) AS pos, fecha, aporte, concepto
                 FROM aportes)""") + f"""
SELECT miembro, CAST((pos - 1) // {p.page_size} + 1 AS INTEGER) AS pagina, count(*) AS filas,
       string_agg(concat_ws('|', CAST(pos AS VARCHAR), CAST(fecha AS VARCHAR),
                            CAST(aporte AS VARCHAR), concepto), ';' ORDER BY pos) AS detalle
FROM d GROUP BY 1, 2"""

    q["q_expand_member"] = _with("""d AS (SELECT row_number() OVER (ORDER BY fecha DESC NULLS LAST,
                   aporte DESC NULLS LAST, concepto DESC NULLS LAST) AS pos, *
                 FROM aportes WHERE miembro = 'Customer#000000001')""") + """
SELECT miembro, pos, fecha, CAST(aporte AS DOUBLE) AS aporte, concepto FROM d"""

    q["q_current_month"] = _with(_month_bounds(None), _summary_cte(
        "s", "fecha >= (SELECT m FROM mb)", "led")) + """
SELECT miembro, cantidad_aportes, CAST(total AS DOUBLE) AS total FROM s"""

    q["q_last_month"] = _with(_month_bounds(None), _summary_cte(
        "s", "fecha >= (SELECT m FROM mb) - INTERVAL 1 MONTH AND fecha < (SELECT m FROM mb)", "led")) + """
SELECT miembro, cantidad_aportes, CAST(total AS DOUBLE) AS total FROM s"""

    q["q_last_month_asof"] = _with(_month_bounds(AS_OF.isoformat()), _summary_cte(
        "s", "fecha >= (SELECT m FROM mb) - INTERVAL 1 MONTH AND fecha < (SELECT m FROM mb)", "led")) + """
SELECT miembro, cantidad_aportes, CAST(total AS DOUBLE) AS total FROM s"""

    q["q_last_month_detail"] = _with(_month_bounds(None)) + """
SELECT miembro,
       row_number() OVER (PARTITION BY miembro ORDER BY fecha DESC NULLS LAST, aporte DESC NULLS LAST) AS pos,
       fecha, CAST(aporte AS DOUBLE) AS aporte
FROM led WHERE fecha >= (SELECT m FROM mb) - INTERVAL 1 MONTH AND fecha < (SELECT m FROM mb)"""

    q["q_current_month_detail"] = _with(_month_bounds(None)) + """
SELECT miembro,
       row_number() OVER (PARTITION BY miembro ORDER BY fecha DESC NULLS LAST, aporte DESC NULLS LAST,
                          concepto DESC NULLS LAST) AS pos,
       fecha, CAST(aporte AS DOUBLE) AS aporte, concepto
FROM led WHERE fecha >= (SELECT m FROM mb)"""

    q["q_headline_kpis"] = _with(
        "i AS (SELECT max(fecha) AS fecha_max, coalesce(sum(aporte), 0) AS ingreso FROM aportes)",
        "g AS (SELECT coalesce(sum(monto), 0) AS gasto FROM gastos)") + """
SELECT fecha_max, CAST(ingreso AS DOUBLE) AS ingreso, CAST(gasto AS DOUBLE) AS gasto,
       CAST(ingreso - gasto AS DOUBLE) AS balance
FROM i, g"""

    q["q_formatted_kpis"] = _with(
        "i AS (SELECT max(fecha) AS fecha_max, coalesce(sum(aporte), 0) AS ingreso FROM aportes)",
        "g AS (SELECT coalesce(sum(monto), 0) AS gasto FROM gastos)",
        "k AS (SELECT fecha_max, ingreso, gasto, ingreso - gasto AS balance FROM i, g)") + f"""
SELECT {heading_label('fecha_max')} AS titulo, {tab_label('fecha_max')} AS pestana,
       {fmt_amount('ingreso')} AS ingreso_txt, {fmt_amount('gasto')} AS gasto_txt,
       {fmt_amount('balance')} AS balance_txt
FROM k"""

    cut = f"DATE '{AS_OF.isoformat()}'"
    q["q_kpis_asof"] = _with(
        f"i AS (SELECT max(fecha) AS fecha_max, coalesce(sum(aporte), 0) AS ingreso FROM aportes WHERE fecha <= {cut})",
        f"g AS (SELECT coalesce(sum(monto), 0) AS gasto FROM gastos WHERE fecha <= {cut})",
        "k AS (SELECT fecha_max, ingreso, gasto, ingreso - gasto AS balance FROM i, g)") + f"""
SELECT fecha_max, CAST(ingreso AS DOUBLE) AS ingreso, CAST(gasto AS DOUBLE) AS gasto,
       CAST(balance AS DOUBLE) AS balance,
       {heading_label('fecha_max')} AS titulo, {tab_label('fecha_max')} AS pestana,
       {fmt_amount('ingreso')} AS ingreso_txt, {fmt_amount('gasto')} AS gasto_txt,
       {fmt_amount('balance')} AS balance_txt
FROM k"""

    q["q_date_labels"] = _with("d AS (SELECT DISTINCT fecha FROM aportes WHERE fecha IS NOT NULL)") + f"""
SELECT fecha, {day_label('fecha')} AS label_dia, {month_label('fecha')} AS label_mes,
       {heading_label('fecha')} AS titulo, {tab_label('fecha')} AS pestana
FROM d"""

    for name, table, label in (("q_label_order", "aportes", day_label),
                               ("q_expense_label_order", "gastos", month_label)):
        q[name] = _with(f"""per AS (SELECT {label('fecha')} AS label,
            CAST(median(datediff('day', DATE '1970-01-01', fecha)) AS DOUBLE) AS mediana
            FROM {table} WHERE fecha IS NOT NULL GROUP BY 1)""") + """
SELECT label, mediana, row_number() OVER (ORDER BY mediana, label) AS orden FROM per"""

    q["q_title_case"] = _with() + f"""
SELECT nombre_pago, {title('nombre_pago')} AS miembro FROM miembros"""

    lo, hi = f"DATE '{year}-01-01'", f"DATE '{year + 1}-01-01'"
    cats = ", ".join(f'CAST({_strict(c)} AS DOUBLE) AS "{c}"' for c in CATEGORIES)
    q["q_category_pivot"] = _with() + f"""
SELECT miembro, {cats}
FROM aportes WHERE fecha >= {lo} AND fecha < {hi} GROUP BY miembro"""

    q["q_year_dues"] = _with(*_dues_ctes(year)) + """
SELECT miembro, CAST("Técnica" AS DOUBLE) AS "Técnica", CAST("Multa técnica" AS DOUBLE) AS "Multa técnica", CAST("Aporte" AS DOUBLE) AS "Aporte",
       CAST(objetivo AS DOUBLE) AS objetivo, CAST(balance AS DOUBLE) AS balance
FROM du"""

    q["q_year_dues_calendar"] = _with(*_dues_ctes(year, "calendar")) + """
SELECT miembro, CAST("Técnica" AS DOUBLE) AS "Técnica", CAST("Multa técnica" AS DOUBLE) AS "Multa técnica", CAST("Aporte" AS DOUBLE) AS "Aporte",
       CAST(objetivo AS DOUBLE) AS objetivo, CAST(balance AS DOUBLE) AS balance
FROM du"""

    q["q_year_dues_asof"] = _with(*_dues_ctes(AS_OF.year, as_of=AS_OF)) + """
SELECT miembro, CAST("Técnica" AS DOUBLE) AS "Técnica", CAST("Multa técnica" AS DOUBLE) AS "Multa técnica", CAST("Aporte" AS DOUBLE) AS "Aporte",
       CAST(objetivo AS DOUBLE) AS objetivo, CAST(balance AS DOUBLE) AS balance
FROM du"""

    q["q_debt_band"] = _with(*_dues_ctes(year)) + f"""
SELECT miembro, CAST(balance AS DOUBLE) AS balance,
       CASE WHEN balance < {p.red_below} THEN 'red' WHEN balance < {p.yellow_below} THEN 'yellow' END AS banda
FROM du"""

    three = p.dues * 3
    q["q_member_status"] = _with(*_dues_ctes(year)) + f"""
SELECT miembro, CAST(balance AS DOUBLE) AS balance,
       CAST(greatest(balance, -{three}) AS DOUBLE) AS balance_tope,
       CASE WHEN condicion = '{p.inactive_label}' THEN 'Inactivo'
            WHEN -balance >= {three} THEN 'Suspendido'
            WHEN -balance >= {p.dues} THEN 'En atraso'
            WHEN balance IS NOT NULL THEN 'Activo' END AS estado
FROM du"""

    q["q_expense_list"] = _with() + """
SELECT fecha AS "Fecha", item AS "Concepto", CAST(monto AS DOUBLE) AS "Monto" FROM gastos"""

    for name, (page, size) in (("q_expense_page", EXPENSE_PAGE_SPEC), ("q_expense_page_deep", DEEP_PAGE_SPEC)):
        q[name] = _with() + f"""
SELECT * FROM (
  SELECT row_number() OVER (ORDER BY fecha DESC NULLS LAST, item ASC NULLS FIRST, monto ASC NULLS FIRST) AS pos,
         fecha AS "Fecha", item AS "Concepto", CAST(monto AS DOUBLE) AS "Monto" FROM gastos)
WHERE pos BETWEEN {(page - 1) * size + 1} AND {page * size}"""

    q["q_fines_list"] = _with() + """
SELECT "Fecha", "Deudor", "Concepto", CAST("Monto" AS DOUBLE) AS "Monto" FROM multas"""

    q["q_member_directory"] = _with() + """
SELECT nombre_pago, nombre, condicion, fecha_inicio, avatar_img
FROM miembros WHERE avatar_img IS NOT NULL"""

    card = CARD_TEMPLATE.replace("'", "''")
    q["q_member_cards"] = _with() + f"""
SELECT nombre, avatar_img, printf('{card}', avatar_img, nombre) AS tarjeta
FROM miembros WHERE avatar_img IS NOT NULL"""

    sq = SEARCH_QUERY.lower()
    q["q_table_search"] = _with(_summary_cte("s")) + f"""
SELECT miembro, cantidad_aportes, CAST(total AS DOUBLE) AS total FROM s
WHERE coalesce(contains(lower(miembro), '{sq}'), FALSE)
   OR coalesce(starts_with(lower(CAST(cantidad_aportes AS VARCHAR)), '{sq}'), FALSE)
   OR coalesce(starts_with(lower({js_number('total')}), '{sq}'), FALSE)"""

    dq = DUES_SEARCH_QUERY.lower()
    num = [f'coalesce(starts_with(lower({js_number(c)}), \'{dq}\'), FALSE)'
           for c in ('"Técnica"', '"Aporte"', "objetivo", "balance")]
    q["q_dues_search"] = _with(*_dues_ctes(year)) + f"""
SELECT miembro, CAST("Técnica" AS DOUBLE) AS "Técnica", CAST("Multa técnica" AS DOUBLE) AS "Multa técnica", CAST("Aporte" AS DOUBLE) AS "Aporte",
       CAST(objetivo AS DOUBLE) AS objetivo, CAST(balance AS DOUBLE) AS balance
FROM du
WHERE coalesce(contains(lower(miembro), '{dq}'), FALSE) OR {" OR ".join(num)}"""

    by, desc = SORT_SPEC
    q["q_table_sort"] = _with(_summary_cte("s")) + f"""
SELECT row_number() OVER (ORDER BY {by} {'DESC NULLS LAST' if desc else 'ASC NULLS FIRST'},
                          miembro ASC NULLS FIRST) AS pos,
       miembro, cantidad_aportes, CAST(total AS DOUBLE) AS total FROM s"""

    page, size = PAGE_SPEC
    q["q_table_page"] = _with(_summary_cte("s")) + f"""
SELECT * FROM (
  SELECT row_number() OVER (ORDER BY total DESC NULLS LAST, miembro ASC NULLS FIRST) AS pos,
         miembro, cantidad_aportes, CAST(total AS DOUBLE) AS total FROM s)
WHERE pos BETWEEN {(page - 1) * size + 1} AND {page * size}"""

    days = [
        """f AS (SELECT fecha, aporte AS ingreso, CAST(NULL AS DECIMAL(18,2)) AS gasto FROM aportes
               UNION ALL SELECT fecha, CAST(NULL AS DECIMAL(18,2)), monto FROM gastos)""",
        """d AS (SELECT fecha, coalesce(sum(ingreso), 0) AS ingreso_dia, coalesce(sum(gasto), 0) AS gasto_dia
               FROM f GROUP BY fecha)"""]
    q["q_balance_timeline"] = _with(*days) + """
SELECT fecha, CAST(ingreso_dia AS DOUBLE) AS ingreso_dia, CAST(gasto_dia AS DOUBLE) AS gasto_dia,
       CAST(sum(ingreso_dia) OVER w AS DOUBLE) AS ingreso,
       CAST(sum(gasto_dia) OVER w AS DOUBLE) AS gasto,
       CAST(sum(ingreso_dia) OVER w - sum(gasto_dia) OVER w AS DOUBLE) AS balance
FROM d WINDOW w AS (ORDER BY fecha NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    q["q_balance_snapshots"] = _with(
        *days, "c AS (SELECT DISTINCT last_day(fecha) AS corte FROM gastos WHERE fecha IS NOT NULL)",
        """k AS (SELECT corte, max(fecha) AS fecha, coalesce(sum(ingreso_dia), 0) AS ingreso, coalesce(sum(gasto_dia), 0) AS gasto
               FROM c LEFT JOIN d ON d.fecha <= c.corte OR d.fecha IS NULL GROUP BY corte)""") + f"""
SELECT corte, fecha, CAST(ingreso AS DOUBLE) AS ingreso, CAST(gasto AS DOUBLE) AS gasto, CAST(ingreso - gasto AS DOUBLE) AS balance,
       {heading_label('fecha')} AS titulo, {tab_label('fecha')} AS pestana,
       {fmt_amount('ingreso')} AS ingreso_txt, {fmt_amount('gasto')} AS gasto_txt, {fmt_amount('(ingreso - gasto)')} AS balance_txt
FROM k"""
    return q
