"""Queries said in SQL, once for both dialects: ``STATEMENTS[name](dialect)``."""

from __future__ import annotations

STATEMENTS: dict = {}


def statement(f):
    STATEMENTS[f.__name__] = f
    return f


# --- text ---------------------------------------------------------------


@statement
def boilerplate_strip(d):
    """Separators, page numbers, revision marks and hidden-text marks are taken out one after the other."""
    # Every 13th line on has a mark behind it, or is one.
    marks = ("' page 3 of 9'", "' ===== rev. 2'", "' <<hidden>>'", "' Page 1 of 2 <<<<a>> rev 7'")
    case = " ".join(f"WHEN {i} THEN concat(line, {m})" for i, m in enumerate(marks))
    planted = f"SELECT CASE (doc_id + paragraph_index) % 13 {case} WHEN 4 THEN '--------' ELSE line END AS line FROM ({d.lines}) o"
    step = "line"
    flags = []
    for tag, pattern in (("separator", "[*=-]{4,}"), ("page_number", "(?i)page [0-9]+ of [0-9]+"), ("revision_mark", "(?i)rev[.] ?[0-9]+"), ("hidden_text", "(?i)<<[^<>]*>>")):
        flags.append(f"CASE WHEN {d.like(step, pattern)} THEN '{tag};' ELSE '' END")
        step = d.gsub(step, pattern, "")
    return f"""
        SELECT tags, count(*) AS n_lines, CAST(sum(length(line) - length(kept)) AS BIGINT) AS removed_chars, CAST(sum(CASE WHEN trim(kept) = '' AND trim(line) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS emptied
        FROM (SELECT line, {step} AS kept, concat({', '.join(flags)}) AS tags FROM ({planted}) l) t GROUP BY tags"""


@statement
def visible_text_html(d):
    body = d.gsub("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    body = d.gsub(d.gsub(body, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return f"SELECT page_id, trim({d.gsub(body, '[ \t\r\n]+', ' ')}) AS visible FROM pages"


@statement
def redaction(d):
    x = d.gsub("text", "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "<email>")
    x = d.gsub(x, "[+]?[0-9]? ?[(]?[0-9]{3}[)]?[ -][0-9]{3}-[0-9]{4}", "<phone>")
    x = d.gsub(x, "(?i)(api_key|password|token|secret)[ ]*[=:][ ]*[^ \n]+", "<secret>")
    return f"SELECT doc_id, {d.sha256('r')} AS redacted_sha256, length(r) AS n_chars, r <> text AS touched FROM (SELECT doc_id, text, {x} AS r FROM documents) t"


@statement
def text_fingerprint(d):
    return f"SELECT doc_id, {d.sha256('text')} AS text_sha256, {d.sha256('substr(text, 1, 200)')} AS slim_sha256, length(text) > 200 AS was_truncated FROM documents"


# --- joins and sets -----------------------------------------------------


@statement
def pattern_resolve(d):
    """Numbering row -> definition -> level, an override winning over the definition."""
    return """
        SELECT l.l_returnflag AS flag, CAST(coalesce(CASE WHEN p.p_size % 7 = 0 THEN s.s_nationkey END, p.p_size) AS BIGINT) AS start_at, count(*) AS n
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2"""


@statement
def coverage(d):
    return "SELECT d.source, count(*) AS docs, count(l.doc_id) AS covered, CAST(floor(10000 * count(l.doc_id) / count(*)) AS BIGINT) AS basis_points FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source"


@statement
def coverage_missing(d):
    return "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


@statement
def ref_integrity(d):
    return """
        WITH refs AS (SELECT 'order' AS kind, l_orderkey AS k FROM lineitem UNION ALL SELECT 'part', l_partkey FROM lineitem UNION ALL SELECT 'supplier', l_suppkey FROM lineitem UNION ALL SELECT 'order', -1 UNION ALL SELECT 'part', -2)
        SELECT kind, k, count(*) AS uses FROM refs r
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'order' AS kind, o_orderkey AS k FROM orders UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier) t WHERE t.kind = r.kind AND t.k = r.k)
        GROUP BY kind, k"""


@statement
def multiset_diff(d):
    return f"SELECT line, count(*) AS extra FROM (SELECT line FROM ({d.lines}) a EXCEPT ALL SELECT text FROM benchmark) t GROUP BY line"


@statement
def disposition_union(d):
    return """
        SELECT disposition, count(*) AS n FROM (
          SELECT doc_id, 'toxic' AS disposition FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'low_quality' FROM labels WHERE toxic = 0 AND quality = 0
          UNION ALL SELECT doc_id, 'good' FROM labels WHERE toxic = 0 AND quality = 1 UNION ALL SELECT d.doc_id, 'unlabelled' FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL) t GROUP BY disposition"""


@statement
def merge_target_wins(d):
    return """
        SELECT coalesce(t.k, s.k) AS nation, coalesce(t.n, s.n) AS n, CASE WHEN t.k IS NULL THEN 'template' ELSE 'target' END AS origin
        FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) t FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) s ON t.k = s.k"""


# --- aggregates ---------------------------------------------------------


@statement
def signature_coverage(d):
    return """
        SELECT l.l_returnflag, l.l_linestatus, l.l_linenumber, count(*) AS n, count(o.o_orderkey) AS n_urgent
        FROM lineitem l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3"""


@statement
def profile_fd_check(d):
    """Brands that do not determine one type."""
    return f"SELECT p_brand, count(*) AS types, {d.joined('p_type', 'p_type')} AS listed FROM (SELECT DISTINCT p_brand, p_type FROM part) t GROUP BY p_brand HAVING count(*) > 1"


@statement
def id_allocation(d):
    """Free ids above all that are in use, in the order of the names."""
    return "SELECT n_name, (SELECT max(k) FROM (SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation) u) + row_number() OVER (ORDER BY n_name, n_nationkey) AS new_id FROM nation"


@statement
def diag_rollup(d):
    return "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(max(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS most, min(event_id) AS first_event FROM events GROUP BY event_type"


# --- windows ------------------------------------------------------------


@statement
def ref_inheritance(d):
    """An event without a value of its own kind takes the user's last one."""
    ignore = "last_value({x}) IGNORE NULLS OVER w" if d.name == "spark" else "last_value({x} IGNORE NULLS) OVER w"
    own = "CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN event_id END"
    return f"SELECT event_id, {ignore.format(x=own)} AS inherited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@statement
def monotone_ts(d):
    return f"SELECT event_id, {d.seconds('top')} AS at_seconds FROM (SELECT event_id, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events) t"


@statement
def interval_due(d):
    return f"""
        SELECT event_id, CASE WHEN prev IS NULL OR {d.seconds('ts')} - {d.seconds('prev')} >= 86400 THEN 1 ELSE 0 END AS due
        FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) t"""


@statement
def newest_valid(d):
    return "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE n_chars < 20000) t WHERE rn = 1"


@statement
def version_order(d):
    return """
        WITH v(name, ver) AS (SELECT n_name, concat('v', CAST(n_nationkey % 3 AS VARCHAR(9)), '.', CAST(n_nationkey AS VARCHAR(9)), CASE WHEN n_nationkey % 5 = 0 THEN '-rc1' ELSE '' END) FROM nation)
        SELECT name, ver, row_number() OVER (ORDER BY CAST(split_part(replace(replace(ver, 'v', ''), '-rc1', ''), '.', 1) AS INTEGER), CAST(split_part(replace(replace(ver, 'v', ''), '-rc1', ''), '.', 2) AS INTEGER), CASE WHEN ver LIKE '%-rc1' THEN 0 ELSE 1 END) AS pos FROM v"""


# --- recursion ----------------------------------------------------------


@statement
def dep_closure(d):
    return """
        WITH RECURSIVE up(k, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT k, CAST(floor(node / 7) AS BIGINT), depth + 1 FROM up WHERE node >= 7)
        SELECT k, count(*) AS nodes, CAST(min(node) AS BIGINT) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY k"""


@statement
def provenance(d):
    return """
        WITH RECURSIVE up(k, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT k, CAST(floor(node / 7) AS BIGINT), depth + 1 FROM up WHERE node >= 7),
        near AS (SELECT k, min(depth) AS depth FROM up WHERE node % 5 = 0 GROUP BY k)
        SELECT p.p_partkey AS k, CASE WHEN n.depth = 0 THEN 'direct' WHEN n.depth > 0 THEN 'style' WHEN p.p_size % 2 = 0 THEN 'text_literal' ELSE 'none' END AS provenance FROM part p LEFT JOIN near n ON p.p_partkey = n.k"""


# --- audits -------------------------------------------------------------


@statement
def audit_records(d):
    return f"""
        SELECT d.doc_id, {d.sha256('substr(d.text, 1, 200)')} AS slim_sha256, length(d.text) > 200 AS was_truncated,
               CASE WHEN l.doc_id IS NULL THEN 'unresolved' WHEN l.toxic = 1 THEN 'ignored' ELSE 'styled' END AS disposition
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


# --- stars: the driver tables' own reports ------------------------------


@statement
def report_pricing(d):
    return """
        SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2"""


@statement
def report_nation_revenue(d):
    return """
        SELECT n.n_name, CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"""
