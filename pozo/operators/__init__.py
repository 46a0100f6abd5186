"""Relational building blocks the reports share.

* :func:`positions` — row numbers within groups (or globally) that stay
  balanced when one group holds a large share of the rows.
* :func:`pivot_sums` — long-to-wide category sums in a single aggregation.
* :class:`Exact`, :func:`unique_names` — columns told apart letter for letter.
* :func:`search_rows`, :func:`sort_rows`, :func:`page_rows` — table search,
  sort and paging with the interactive table's rules.
"""

from pozo.operators.ranking import position_parts, positions
from pozo.operators.names import Exact, unique_names
from pozo.operators.pivot import pivot_sums, select_matching
from pozo.operators.tables import By, page_rows, search_rows, sort_rows, table_order

__all__ = ["By", "Exact", "unique_names", "positions", "position_parts", "pivot_sums", "select_matching",
           "search_rows", "sort_rows", "page_rows", "table_order"]
