"""Settings, policies, manifests and preflight checks said in SQL; they join the other statements."""

from __future__ import annotations

from ..sources.tables import OUTLINE
from .statements import statement


@statement
def merge_template_wins(d):
    """The template replaces or adds the keys it manages; the target's others stay, its own others are not copied."""
    return """
        WITH target AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), template AS (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 2 = 0)
        SELECT k, CAST(floor(v) AS BIGINT) AS v, origin FROM (
          SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.v ELSE t.v END AS v, CASE WHEN s.k IS NOT NULL THEN 'template' ELSE 'target' END AS origin
          FROM target t FULL OUTER JOIN (SELECT * FROM template WHERE k % 5 < 3) s ON t.k = s.k) u"""


@statement
def policy_plan(d):
    """Direct properties that leave a paragraph by mode: those its style supplies, numbering (4) as the mode says."""
    return """
        WITH direct AS (SELECT l_orderkey AS k, l_linenumber AS prop FROM lineitem GROUP BY 1, 2),
        supplied AS (SELECT l_orderkey AS k, l_linenumber AS prop FROM lineitem WHERE (l_orderkey + l_linenumber) % 2 = 0 GROUP BY 1, 2),
        told AS (SELECT d.k, d.prop, s.k IS NOT NULL AS taken_over FROM direct d LEFT JOIN supplied s ON s.k = d.k AND s.prop = d.prop)
        SELECT 'format_only' AS mode, k, prop, CASE WHEN prop <> 4 AND taken_over THEN 'stripped' ELSE 'kept' END AS fate FROM told
        UNION ALL SELECT 'convert', k, prop, CASE WHEN prop = 4 THEN 'converted' WHEN taken_over THEN 'stripped' ELSE 'kept' END FROM told"""


@statement
def bundle_check(d):
    """A manifest against the files it lists: missing, unlisted, of another size or another digest."""
    files = f"SELECT doc_id AS k, octet_length({'encode(text)' if d.name == 'duckdb' else 'text'}) AS size, {d.sha256('text')} AS sha FROM documents WHERE text IS NOT NULL AND doc_id % 97 <> 5"
    listed = f"SELECT doc_id AS k, octet_length({'encode(text)' if d.name == 'duckdb' else 'text'}) + CASE WHEN doc_id % 89 = 3 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 83 = 2 THEN {d.sha256('lang')} ELSE {d.sha256('text')} END AS sha FROM documents WHERE text IS NOT NULL AND doc_id % 79 <> 4"
    return f"""
        SELECT coalesce(m.k, f.k) AS file_id, CASE WHEN f.k IS NULL THEN 'missing' WHEN m.k IS NULL THEN 'unlisted' WHEN m.size <> f.size THEN 'size' ELSE 'digest' END AS fault
        FROM ({listed}) m FULL OUTER JOIN ({files}) f ON m.k = f.k
        WHERE m.k IS NULL OR f.k IS NULL OR m.size <> f.size OR m.sha IS DISTINCT FROM f.sha"""


@statement
def registry_preflight(d):
    """All that is wrong with a registry, one row a fault: references, defaults, ranges, exclusive owners."""
    return """
        SELECT 'part_without_supplier' AS code, p_partkey AS k FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey)
        UNION ALL SELECT 'customer_without_nation', c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey < 4)
        UNION ALL SELECT 'price_out_of_range', o_orderkey FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 400000
        UNION ALL SELECT 'status_unknown', o_orderkey FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')
        UNION ALL SELECT 'name_shared', min(s_suppkey) FROM supplier GROUP BY s_name HAVING count(*) > 1"""


@statement
def instruction_violations(d):
    """Instructions against their paragraphs: index out of range, blank, excluded, given twice or given to two styles."""
    return f"""
        WITH o AS ({OUTLINE}), n AS (SELECT doc_id, max(paragraph_index) AS last FROM o GROUP BY doc_id),
        given AS (SELECT doc_id, CASE WHEN paragraph_index % 29 = 7 THEN paragraph_index + 1000 ELSE paragraph_index END AS i, concat('S', CAST(paragraph_index % 4 AS VARCHAR(3))) AS style FROM o
          UNION ALL SELECT doc_id, paragraph_index, 'S9' FROM o WHERE paragraph_index % 31 = 3),
        told AS (SELECT g.doc_id, g.i, g.style, n.last, o.text FROM given g JOIN n ON n.doc_id = g.doc_id LEFT JOIN o ON o.doc_id = g.doc_id AND o.paragraph_index = g.i)
        SELECT doc_id, i AS paragraph_index, 'out_of_range' AS code FROM told WHERE i > last
        UNION ALL SELECT doc_id, i, 'blank' FROM told WHERE i <= last AND trim(text) = ''
        UNION ALL SELECT doc_id, i, 'excluded' FROM told WHERE text LIKE '[%'
        UNION ALL SELECT doc_id, i, 'two_styles' FROM told GROUP BY doc_id, i HAVING count(DISTINCT style) > 1"""


@statement
def conversion_preconditions(d):
    """Why a document's numbering can't be converted: lists shared with rows that stay, starts other than one, no hierarchy."""
    return f"""
        WITH o AS ({OUTLINE}), m AS (SELECT doc_id, paragraph_index, CASE WHEN {d.like('text', '^[A-Z][.] ')} THEN 3 WHEN {d.like('text', '^[0-9]+[.] ')} THEN 4 WHEN {d.like('text', '^[a-z][.] ')} THEN 5 END AS lvl, text FROM o),
        f AS (SELECT doc_id, lvl, min(paragraph_index) AS first_at FROM m WHERE lvl IS NOT NULL GROUP BY doc_id, lvl)
        SELECT f.doc_id, f.lvl, CASE WHEN p.doc_id IS NULL THEN 'no_parent_level' WHEN p.first_at > f.first_at THEN 'parent_comes_later' ELSE 'start_not_one' END AS code
        FROM f JOIN m ON m.doc_id = f.doc_id AND m.paragraph_index = f.first_at LEFT JOIN f p ON p.doc_id = f.doc_id AND p.lvl = f.lvl - 1
        WHERE (f.lvl > 3 AND (p.doc_id IS NULL OR p.first_at > f.first_at)) OR NOT {d.like('m.text', '^(A|1|a)[.] ')}"""


@statement
def json_from_prose(d):
    """The one JSON object in an answer, its fence stripped; several different ones or none are an error."""
    answer = "CASE WHEN event_id % 7 = 0 THEN concat('Sure: ', props, ' or {\"k\": -1}') WHEN event_id % 11 = 0 THEN 'none' ELSE concat('```json\\n', props, '\\n```') END"
    first, last = d.sub("answer", "([{][^{}]*[}])", 1), d.sub("answer", "([{][^{}]*[}])[^{}]*$", 1)
    return f"""
        SELECT event_id, CASE WHEN a = '' THEN 'none' WHEN a <> b THEN 'ambiguous' ELSE 'one' END AS found, CASE WHEN a = b AND a <> '' THEN a END AS object
        FROM (SELECT event_id, {first} AS a, {last} AS b FROM (SELECT event_id, {answer} AS answer FROM events) x) t"""


@statement
def final_dispositions(d):
    """Every row's one disposition, the branches asked in their order: table, empty, boilerplate, header without a role, role, unresolved."""
    return f"""
        WITH o AS ({OUTLINE}), r AS (SELECT doc_id, paragraph_index, text, doc_id % 2 = 0 AS has_header_role, lag(text) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS prev FROM o)
        SELECT doc_id, disposition, count(*) AS n FROM (
          SELECT doc_id, CASE WHEN paragraph_index % 37 = 36 THEN 'out_of_scope:table' WHEN trim(text) = '' THEN 'empty' WHEN text LIKE '[%]' THEN 'ignored:boilerplate'
            WHEN {d.like('text', '^SECTION [0-9]')} AND NOT has_header_role THEN 'ignored:section_header_no_role' WHEN {d.like('coalesce(prev, chr(32))', '^SECTION [0-9]')} AND NOT has_header_role AND text = upper(text) THEN 'ignored:section_title_no_role'
            WHEN {d.like('text', '^(SECTION|PART) |^[0-9]+[.][0-9]+ |^([A-Z]|[0-9]+|[a-z])[.] ')} THEN 'styled' ELSE 'unresolved' END AS disposition FROM r) t
        GROUP BY doc_id, disposition"""
