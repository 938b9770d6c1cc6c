"""D: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, rounded
from quillwork.functions.text import map_lookup, token_cost
from quillwork.operators import joins as ops

@query(
    "d1_parents_with_child_count",
    """SELECT document_id, title, n AS children FROM titles JOIN (
      SELECT document_id, count(*) AS n FROM elements GROUP BY ALL) USING (document_id)""",
)
def _(t):
    return ops.parents_with_child_count(t.titles, t.elements.df, "document_id")


@query(
    "d2_enrich_left",
    """SELECT n.document_id, id, node_type, coalesce(x.title, '') AS title FROM nodes n
    LEFT JOIN titles x USING (document_id)""",
)
def _(t):
    nodes = t.nodes.select("document_id", "id", "node_type")
    return ops.enrich_left(nodes, t.titles, "document_id", "title")


@query(
    "d3_breadcrumbs",
    """SELECT n.document_id, n.id, coalesce(string_agg(a.title, ' > ' ORDER BY a.depth), '') AS trail,
      count(a.id) AS depth
    FROM nodes n LEFT JOIN nodes a ON a.document_id = n.document_id AND a.id <> n.id
      AND list_contains(string_split(n.path, '/'), a.id::VARCHAR)
    GROUP BY n.document_id, n.id""",
)
def _(t):
    found = ops.breadcrumbs(t.nodes)
    trail = F.array_join("breadcrumb", " > ").alias("trail")
    return found.select("document_id", "id", trail, F.size("breadcrumb").cast("long").alias("depth"))


@query(
    "d4_nest_children",
    """SELECT s.document_id, s.id AS section_id, coalesce(part, 0) AS part, coalesce(items, '') AS items
    FROM (SELECT * FROM nodes WHERE node_type IN ('root', 'section')) s LEFT JOIN (
      SELECT document_id, parent_id, i // 5 AS part, string_agg(id::VARCHAR, ',' ORDER BY id) AS items
      FROM (SELECT *, row_number() OVER (PARTITION BY document_id, parent_id ORDER BY id) - 1 AS i
        FROM nodes WHERE node_type NOT IN ('root', 'section')) GROUP BY ALL) b
    ON b.document_id = s.document_id AND b.parent_id = s.id""",
)
def _(t):
    nodes = t.nodes
    section = F.col("node_type").isin("root", "section")
    parents = nodes.filter(section).select("document_id", F.col("id").alias("section_id"))
    blocks = nodes.filter(~section).select("document_id", F.col("parent_id").alias("section_id"), "id", "title")
    nested = ops.nest_children(parents, blocks, ["document_id", "section_id"], "id", ["id", "title"], part_rows=5)
    items = F.array_join(F.transform("children", lambda x: x["id"].cast("string")), ",").alias("items")
    return nested.select("document_id", "section_id", "part", items)


@query(
    "d5_asof_page_join",
    """SELECT document_id, order_index, coalesce(s.id, 0) AS section_id
    FROM (SELECT * FROM elements WHERE kind <> 'heading') e LEFT JOIN LATERAL (
      SELECT b.id FROM bookmarks b WHERE b.document_id = e.document_id AND b.page <= e.page
        ORDER BY b.page DESC, b.order_index DESC LIMIT 1) s ON true""",
)
def _(t):
    rows = t.elements.df.filter("element_type <> 'heading'")
    found = ops.asof_page_join(rows, t.bookmarks)
    return found.select("document_id", "order_index", "section_id")


@query(
    "d6_insert_missing",
    """SELECT book_code, title, status FROM shelf UNION ALL
    SELECT book_code, title, status FROM scanned WHERE book_code NOT IN (SELECT book_code FROM shelf)""",
)
def _(t):
    return ops.insert_missing(t.shelf, t.scanned, "book_code").select("book_code", "title", "status")


@query(
    "d7_entitlement_join",
    """SELECT user_id, CASE WHEN is_superuser THEN '*' ELSE coalesce(codes, '') END AS permissions,
      is_superuser OR coalesce(list_contains(string_split(codes, ','), 'ASIA'), false) AS may
    FROM users LEFT JOIN (SELECT role_id, string_agg(permission, ',' ORDER BY permission) AS codes
      FROM role_permissions GROUP BY ALL) USING (role_id)""",
)
def _(t):
    entitled = ops.entitlement_join(t.users, t.role_permissions)
    holders = ops.holders_of(entitled, "ASIA").select("user_id", F.lit(True).alias("may"))
    joined = entitled.join(holders, "user_id", "left")
    return joined.select(
        "user_id", F.array_join("permissions", ",").alias("permissions"),
        F.coalesce("may", F.lit(False)).alias("may"),
    )


LOCAL = "link <> '' AND NOT regexp_matches(link, '^(http://|https://|mailto:)')"


@query(
    "d8_broken_links",
    f"""SELECT path, link FROM links WHERE {LOCAL}
      AND ltrim(link, '/') NOT IN (SELECT ltrim(path, '/') FROM existing)
      AND 'site/' || ltrim(link, '/') NOT IN (SELECT ltrim(path, '/') FROM existing)""",
)
def _(t):
    local = t.links.filter((F.col("link") != "") & ~F.col("link").rlike(ops.EXTERNAL))
    return ops.broken_links(local.select("path", "link"), t.existing)


@query(
    "d9_orphan_docs",
    f"""SELECT path FROM (SELECT path FROM existing UNION SELECT path FROM links) d WHERE string_split(path, '/')[-1] NOT IN (
      SELECT string_split(link, '/')[-1] FROM links WHERE {LOCAL})""",
)
def _(t):
    local = t.links.filter((F.col("link") != "") & ~F.col("link").rlike(ops.EXTERNAL))
    docs = t.existing.select("path").union(t.links.select("path")).distinct()
    return ops.orphan_docs(docs, local)


@query(
    "d10_missing_docs",
    """SELECT name FROM (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS name FROM part
      UNION SELECT DISTINCT link[2:] FROM links) n
    WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM titles WHERE contains(lower(title), lower(name)))""",
)
def _(t):
    words = t.part.select(F.lower(F.split("p_name", " ").getItem(1)).alias("name"))
    names = words.union(t.links.select(F.expr("substring(link, 2)"))).distinct()
    return ops.missing_docs(names, t.titles, ["title"])


@query(
    "d11_detect_changed",
    """SELECT b.book_code, CASE WHEN b.downloaded AND s.version_hash <> b.version_hash
      THEN 'update_available' ELSE b.status END AS status
    FROM shelf b LEFT JOIN scanned s USING (book_code)""",
)
def _(t):
    return ops.detect_changed(t.shelf, t.scanned).select("book_code", "status")


COST = """input_tokens / 1000.0::DOUBLE * (CASE model WHEN 'gpt-4o-mini' THEN 0.00015 WHEN 'gpt-4o' THEN 0.0025
      ELSE 0 END)::DOUBLE + output_tokens / 1000.0::DOUBLE * (CASE model WHEN 'gpt-4o-mini' THEN 0.0006
      WHEN 'gpt-4o' THEN 0.01 ELSE 0 END)::DOUBLE"""


@query(
    "d12_price_lookup",
    f"SELECT session_id, document_id, model, {rounded(COST, 6)} AS estimated_cost FROM model_runs",
)
def _(t):
    cost = token_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return t.model_runs.select("session_id", "document_id", "model", cost.alias("estimated_cost"))


@query(
    "d13_map_lookup",
    """SELECT seq, CASE split_part(split_part(replace(subject, '(', ':'), ':', 1), '!', 1)
      WHEN 'feat' THEN 'Added' WHEN 'fix' THEN 'Fixed' WHEN 'perf' THEN 'Performance' ELSE 'Changed' END AS section
    FROM commits""",
)
def _(t):
    kind = F.regexp_extract("subject", r"^(\w+)", 1)
    sections = {"feat": "Added", "fix": "Fixed", "perf": "Performance"}
    return t.commits.select("seq", map_lookup(kind, sections, "Changed").alias("section"))


@query(
    "d14_route_by_prefix",
    """SELECT page_id, link, CASE WHEN link = '/the' OR starts_with(link, '/the/') THEN 'articles'
      WHEN link = '/de' OR starts_with(link, '/de/') OR link = '/und' OR starts_with(link, '/und/') THEN 'german'
      ELSE 'chore' END AS "group" FROM links""",
)
def _(t):
    groups = {"articles": ["/the"], "german": ["/de", "/und"]}
    routed = ops.route_by_prefix(t.links, "link", groups)
    return routed.select("page_id", "link", "group")


@query("d15_grant_all", "SELECT 7::BIGINT AS role_id, r_name AS permission FROM region")
def _(t):
    codes = t.region.select(F.col("r_name").alias("permission"))
    return ops.grant_all(codes, 7).withColumn("role_id", F.col("role_id").cast("long"))


@query(
    "d16_points_outside_boxes",
    """SELECT document_id, order_index FROM (SELECT * FROM spans WHERE kind NOT IN ('table', 'figure')) p
    WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.kind = 'table' AND b.document_id = p.document_id
      AND b.page = p.page AND (p.x0 + p.x1) / 2 BETWEEN b.x0 AND b.x1
      AND (p.y0 + p.y1) / 2 BETWEEN b.y0 AND b.y1)""",
)
def _(t):
    spans = t.spans
    free = ops.points_outside_boxes(
        spans.filter("element_type not in ('table', 'figure')"),
        spans.filter("element_type = 'table'"),
        ["document_id", "page"],
    )
    return free.select("document_id", "order_index")


@query(
    "d17_selected_members",
    """SELECT job_id, index, event_id FROM frames WHERE job_id = 3
      AND event_id IN (SELECT event_id FROM events WHERE event_type = 'click')""",
)
def _(t):
    listed = t.events.filter("event_type = 'click'")
    return ops.selected_members(t.frames.df, listed, "event_id", "job_id", 3).select("job_id", "index", "event_id")

