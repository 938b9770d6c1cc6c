"""SQL for the order-dependent operators, as recursions over one row at a time."""

from __future__ import annotations

from queries.views import SIGNATURE_LIMIT

CAPTION = r"(?i)^(fig(ure)?|table|image|photo|plate|chart|diagram|exhibit)\b[\s.:\-]*\d"


def reading(source: str) -> str:
    """CTEs `seq` and `step`: what is open, held and on top after each element of `source`."""
    return rf"""
    WITH seq AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY order_index) AS rn,
        regexp_matches(t, '[.!?:;)"”]$') AS closed FROM (
        SELECT *, trim(text) AS t, CASE WHEN element_type = 'heading' THEN 'H'
          WHEN element_type IN ('figure', 'table') THEN 'O' WHEN regexp_matches(trim(text), '{CAPTION}') THEN 'C'
          WHEN regexp_matches(trim(text), '(?i)^(example|exercises?|questions|problems)\b') THEN 'E' ELSE 'P' END AS k
        FROM ({source}))
      WHERE k IN ('H', 'O') OR t <> ''),
    step AS (
      SELECT DISTINCT document_id, 0::BIGINT AS rn, NULL::BIGINT AS order_index, '' AS k, '' AS open, false AS closed,
        NULL::BIGINT AS top, NULL::BIGINT AS held, NULL::BIGINT AS goes_to, NULL::BIGINT AS takes,
        NULL::BIGINT AS block, NULL::BIGINT AS section FROM seq
      UNION ALL
      SELECT s.document_id, s.rn, s.order_index, s.k,
        CASE WHEN s.k IN ('H', 'O') THEN '' WHEN s.k = 'C' THEN p.open WHEN s.k = 'E' OR p.open = 'E' THEN 'E' ELSE 'P' END,
        CASE WHEN s.k IN ('E', 'P') THEN s.closed ELSE p.closed END,
        CASE s.k WHEN 'O' THEN CASE WHEN p.held IS NULL THEN s.order_index END WHEN 'C' THEN NULL
          WHEN 'H' THEN CASE WHEN p.open = '' AND p.held IS NULL THEN p.top END
          WHEN 'E' THEN CASE WHEN p.open = '' THEN p.top END
          ELSE CASE WHEN NOT (p.open = 'P' AND p.closed) THEN p.top END END,
        CASE WHEN s.k IN ('H', 'O') THEN NULL WHEN s.k = 'C' AND p.top IS NULL THEN s.order_index ELSE p.held END,
        CASE WHEN s.k = 'C' THEN p.top END, CASE WHEN s.k IN ('H', 'O') THEN p.held END,
        CASE WHEN s.k IN ('O', 'E') OR (s.k = 'P' AND (p.open = '' OR (p.open = 'P' AND p.closed)))
          THEN s.order_index WHEN s.k = 'P' THEN p.block END,
        CASE WHEN s.k = 'H' THEN s.order_index + 1 ELSE p.section END
      FROM step p JOIN seq s ON s.document_id = p.document_id AND s.rn = p.rn + 1)"""


def blocks(source: str) -> str:
    """CTEs up to `blocks`: the readable blocks of the elements of `source`."""
    return f"""{reading(source)},
    texts AS (
      SELECT document_id, block AS place, min(s.order_index) AS start,
        replace(replace(string_agg(t, '␟' ORDER BY s.order_index), '-␟', ''), '␟', ' ') AS text,
        string_agg((s.order_index + 1)::VARCHAR, ',' ORDER BY s.order_index) AS source_ids
      FROM step JOIN seq s USING (document_id, rn) WHERE step.k IN ('E', 'P') GROUP BY document_id, block),
    loose AS (
      SELECT document_id, order_index AS place, takes AS note, page, NULL::BIGINT AS rn0, rn FROM (
        SELECT step.*, s.page FROM step JOIN seq s USING (document_id, rn)) WHERE k = 'H' AND takes IS NOT NULL
      UNION ALL
      SELECT document_id, order_index + 1, held, 0, NULL, rn + 1 FROM (
        SELECT *, max(rn) OVER (PARTITION BY document_id) AS final FROM step) WHERE rn = final AND held IS NOT NULL),
    blocks AS (
      SELECT x.document_id, x.start AS place, 1 AS turn, CASE WHEN s.k = 'P' THEN 'paragraph'
          WHEN regexp_matches(s.t, '(?i)^example') THEN 'example' ELSE 'exercise' END AS block_type,
        coalesce(step.section, 0) AS section_id, s.page, x.text, '' AS caption, x.source_ids
      FROM texts x JOIN seq s ON s.document_id = x.document_id AND s.order_index = x.start
      JOIN step ON step.document_id = s.document_id AND step.rn = s.rn
      UNION ALL
      SELECT o.document_id, o.order_index, 1, s.element_type, coalesce(o.section, 0), s.page, '',
        coalesce(h.t, j.t, ''), (o.order_index + 1)::VARCHAR || coalesce(',' || (coalesce(h.order_index, j.order_index) + 1)::VARCHAR, '')
      FROM step o JOIN seq s USING (document_id, rn)
      LEFT JOIN seq h ON h.document_id = o.document_id AND h.order_index = o.takes
      LEFT JOIN step g ON g.document_id = o.document_id AND g.goes_to = o.order_index
      LEFT JOIN seq j ON j.document_id = g.document_id AND j.rn = g.rn WHERE o.k = 'O'
      UNION ALL
      SELECT l.document_id, l.place, 0, 'paragraph', coalesce(b.section, 0), l.page, n.t, '', (l.note + 1)::VARCHAR
      FROM loose l JOIN seq n ON n.document_id = l.document_id AND n.order_index = l.note
      JOIN step b ON b.document_id = l.document_id AND b.rn = l.rn - 1)"""


def chosen(picked: str, sharp: str, cap: int) -> str:
    """Rows of `picked` (label, pos, vec_id, signature, sharpness, pixel_std) left by the quality filters."""
    return f"""
    WITH usable AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS rn FROM ({picked})
      WHERE pixel_std >= 4 AND {sharp} >= 60),
    grouped AS (
      SELECT label, rn, pos, vec_id, sharpness, signature AS base, rn AS g FROM usable WHERE rn = 1
      UNION ALL
      SELECT label, rn, pos, vec_id, sharpness, CASE WHEN far THEN signature ELSE base END, CASE WHEN far THEN rn ELSE g END
      FROM (SELECT u.*, p.base, p.g, list_sum(list_transform(generate_series(1, 64),
          lambda i: abs(u.signature[i]::DOUBLE - p.base[i]::DOUBLE))) / 64 > {SIGNATURE_LIMIT} AS far
        FROM grouped p JOIN usable u ON u.label = p.label AND u.rn = p.rn + 1)),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM (
        SELECT label, g, arg_max(pos, sharpness * 1000000 - pos) AS pos, arg_max(vec_id, sharpness * 1000000 - pos) AS vec_id
        FROM grouped GROUP BY label, g))
    SELECT label, pos, vec_id FROM best b
    WHERE n <= {cap} OR i IN (SELECT floor(j * (b.n / {cap}.0::DOUBLE))::BIGINT FROM generate_series(0, {cap - 1}) q(j))"""
