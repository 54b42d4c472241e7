"""The llm queries by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from sievestone.llm import (
    arc_convert,
    decontamination,
    hash_ring,
    html_extraction,
    language_id,
    line_dedup,
    packing,
    quality_rules,
    simhash_dedup,
    token_counts,
)

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_packing": packing.op2_packing,
    "op3_arc_convert": arc_convert.op3_arc_convert,
    "op4_hash_ring": hash_ring.op4_hash_ring,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_html_extraction": html_extraction.op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    # of equal pages one row is the response, whichever
    "op3_arc_convert": f"""WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, payload_bytes >= {arc_convert.MIN_BYTES} AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) > 1 AS again, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN best END AS refers_to FROM g""",
    # the pairs that share a half are compared at their first difference; r holds what each line reaches
    "op8_line_dedup": f"""WITH RECURSIVE ln AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
ds AS (SELECT line, length(line) AS n, min(row(doc_id, line_no)) AS place FROM ln WHERE trim(line) <> '' GROUP BY line),
k AS (SELECT line, n, 0 AS longer, unnest([row(n, 0, left(line, n // 2)), row(n, 1, right(line, n - n // 2))]) AS key FROM ds WHERE n >= {line_dedup.EDIT_CHARS}
UNION ALL SELECT line, n, 1, unnest([row(n - 1, 0, left(line, (n - 1) // 2)), row(n - 1, 1, right(line, n - 1 - (n - 1) // 2))]) FROM ds WHERE n > {line_dedup.EDIT_CHARS}),
p AS (SELECT DISTINCT a.line AS x, b.line AS y, b.longer, a.n FROM k a JOIN k b ON a.key = b.key AND a.longer = 0 AND (b.longer = 1 OR a.line < b.line)),
f AS (SELECT *, coalesce(list_filter(range(1, n + 1), lambda i: x[i] <> y[i])[1], n + 1) AS i FROM p),
e AS (SELECT x, y FROM f WHERE substring(x, i + 1 - longer) = substring(y, i + 1)), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, other) AS (SELECT x, x FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.other = b.x),
c AS (SELECT node AS line, min(place) AS near FROM r JOIN ds ON ds.line = r.other GROUP BY ALL),
o AS (SELECT doc_id, line_no, coalesce(near, place, row(doc_id, line_no)) AS first FROM ln LEFT JOIN ds USING (line) LEFT JOIN c USING (line))
SELECT doc_id, line_no, first[1] AS class_doc_id, first[2] AS class_line_no, first = row(doc_id, line_no) AS kept FROM o""",
}
