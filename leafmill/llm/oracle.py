"""DuckDB statements for the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

P1_FOUND = """
SELECT row_id,
       CASE WHEN list_max([length(x) FOR x IN regexp_split_to_array(text, '[ \\t\\n。！？]')]) > 6000
            THEN 'forced' ELSE 'natural' END AS cut
FROM pages WHERE length(text) > 6000
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND}
