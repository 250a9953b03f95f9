"""Contract checks, audits and id maps said in SQL; they join the other statements.

Checks return what breaks the rule: an empty result is a pass.
"""

from __future__ import annotations

from ..sources.tables import OUTLINE
from .statements import statement

# --- sets and coverage --------------------------------------------------


@statement
def coverage_contract(d):
    """Expected against handled rows, both ways, and rows handled twice."""
    return """
        WITH expected AS (SELECT DISTINCT o_orderkey AS k FROM orders), handled AS (SELECT l_orderkey + CASE WHEN l_orderkey % 1009 = 0 THEN 100000000 ELSE 0 END AS k FROM lineitem GROUP BY 1),
        ignored AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 501 = 0)
        SELECT k, CASE WHEN e = 0 THEN 'unexpected' WHEN h + i = 0 THEN 'missing' ELSE 'overlap' END AS fault
        FROM (SELECT k, sum(e) AS e, sum(h) AS h, sum(i) AS i FROM (SELECT k, 1 AS e, 0 AS h, 0 AS i FROM expected UNION ALL SELECT k, 0, 1, 0 FROM handled UNION ALL SELECT k, 0, 0, 1 FROM ignored) u GROUP BY k) t
        WHERE e = 0 OR h + i = 0 OR h + i > 1"""


@statement
def coverage_ratio(d):
    """Handled over expected in basis points; 1.0 where nothing is expected."""
    return """
        SELECT n.n_name, count(s.s_suppkey) AS expected, CAST(coalesce(sum(CASE WHEN s.s_acctbal > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS handled,
               CAST(CASE WHEN count(s.s_suppkey) = 0 THEN 10000 ELSE floor(10000 * sum(CASE WHEN s.s_acctbal > 0 THEN 1 ELSE 0 END) / count(s.s_suppkey)) END AS BIGINT) AS basis_points
        FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name"""


@statement
def forced_exclusions(d):
    """A known exclusion is ignored whatever it was styled as; a stated reason wins over the known one."""
    return """
        WITH known AS (SELECT doc_id, 'toxic' AS reason FROM labels WHERE toxic = 1), stated AS (SELECT doc_id, 'low_quality' AS reason FROM labels WHERE quality = 0)
        SELECT x.doc_id, CASE WHEN k.doc_id IS NULL AND s.doc_id IS NULL THEN 'styled' ELSE 'ignored' END AS disposition, coalesce(s.reason, k.reason) AS reason
        FROM documents x LEFT JOIN known k ON x.doc_id = k.doc_id LEFT JOIN stated s ON x.doc_id = s.doc_id"""


@statement
def override_check(d):
    """Rows that two producers settle differently."""
    return """
        SELECT k, count(DISTINCT v) AS answers, min(v) AS low, max(v) AS high
        FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'X' ELSE o_orderstatus END FROM orders) u
        GROUP BY k HAVING count(DISTINCT v) > 1"""


@statement
def chunk_contract(d):
    """Files whose chunks are not exactly those announced."""
    return """
        SELECT o.o_orderkey, o.announced, coalesce(g.n, 0) AS n, coalesce(g.kinds, 0) AS kinds
        FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS announced FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS kinds FROM lineitem GROUP BY l_orderkey) g ON g.l_orderkey = o.o_orderkey
        WHERE coalesce(g.n, 0) <> o.announced OR coalesce(g.kinds, 0) <> o.announced"""


@statement
def reachable_parts(d):
    """Parts that some order reaches, each once."""
    return "SELECT p_partkey, p_name FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R')"


@statement
def json_contract(d):
    """Events whose properties are no object with exactly the key ``k`` and a value below 90."""
    return f"""
        SELECT event_id, CASE WHEN NOT {d.like('props', '^[{]"k": *[0-9]+[}]$')} THEN 'shape' ELSE 'range' END AS fault
        FROM events WHERE NOT {d.like('props', '^[{]"k": *[0-9]+[}]$')} OR TRY_CAST({d.sub('props', '"k": *([0-9]+)', 1)} AS BIGINT) >= 90"""


# --- signatures and consensus -------------------------------------------


@statement
def counter_conflict(d):
    """Signatures whose three marker keys a known role has too, but with another counter key."""
    return """
        WITH sig AS (SELECT DISTINCT p_brand AS a, p_type AS b, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 END AS c, p_size AS start_at FROM part),
        known AS (SELECT a, b, c, min(start_at) AS low, max(start_at) AS high FROM sig WHERE start_at % 3 = 0 GROUP BY a, b, c)
        SELECT s.a, s.b, s.c, s.start_at FROM sig s JOIN known k ON s.a IS NOT DISTINCT FROM k.a AND s.b IS NOT DISTINCT FROM k.b AND s.c IS NOT DISTINCT FROM k.c
        WHERE k.low <> s.start_at OR k.high <> s.start_at"""


@statement
def support_consensus(d):
    """A value seen at least twice counts; one such value is the answer, several are ambiguous."""
    return """
        SELECT conv_id, CASE WHEN count(*) = 1 THEN min(role) END AS answer, count(*) > 1 AS ambiguous, CAST(sum(n) AS BIGINT) AS seen
        FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role HAVING count(*) >= 2) t GROUP BY conv_id"""


@statement
def role_counts(d):
    """Rows of each role per target, and whether any style is mapped to it."""
    return """
        WITH mapped(role) AS (VALUES ('user'), ('assistant')), counted AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role)
        SELECT c.conv_id, c.role, c.n, m.role IS NOT NULL AS has_style FROM counted c LEFT JOIN mapped m ON c.role = m.role"""


@statement
def error_previews(d):
    """The first 5 violations of each kind, as a report shows them."""
    return """
        SELECT kind, pos, k FROM (SELECT l_returnflag AS kind, l_orderkey AS k, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) AS pos
          FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem WHERE l_quantity < 3) t) r WHERE pos <= 5"""


# --- order --------------------------------------------------------------


@statement
def paragraph_numbers(d):
    """Gapless numbers of the paragraphs that hold text."""
    return f"WITH o AS ({OUTLINE}) SELECT doc_id, paragraph_index, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS n FROM o WHERE trim(text) <> ''"


@statement
def first_after_header(d):
    """The first row after each section header that is no header itself."""
    return f"""
        WITH o AS ({OUTLINE}), h AS (SELECT doc_id, paragraph_index, text, CASE WHEN {d.like('text', '^(SECTION|PART) [0-9]')} THEN 1 ELSE 0 END AS head FROM o WHERE text <> ''),
        g AS (SELECT *, sum(CASE WHEN {d.like('text', '^PART [0-9]')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM h),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY paragraph_index) AS rn FROM g WHERE head = 0)
        SELECT doc_id, CAST(part AS BIGINT) AS part, paragraph_index, text FROM r WHERE rn = 1"""


@statement
def no_role_filters(d):
    """Header and title lines leave the job where the template has no role for them."""
    return f"""
        WITH o AS ({OUTLINE}), k AS (SELECT doc_id, paragraph_index, text, lag(text) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS prev FROM o WHERE trim(text) <> '')
        SELECT doc_id, paragraph_index, CASE WHEN {d.like('text', '^SECTION [0-9]')} THEN 'section_header' WHEN {d.like('prev', '^SECTION [0-9]')} AND text = upper(text) THEN 'section_title' ELSE 'end_of_section' END AS reason
        FROM k WHERE (doc_id % 2 = 0 AND {d.like('text', '^SECTION [0-9]')}) OR (doc_id % 3 = 0 AND {d.like('prev', '^SECTION [0-9]')} AND text = upper(text)) OR {d.like('text', '^END OF SECTION')}"""


@statement
def position_in_range(d):
    """Whether an event lies in a range that a purchase of its user opened; a running end stands for the range join."""
    at = d.seconds("ts")
    span = f"CASE WHEN event_type = 'purchase' THEN {at} + CAST(floor(abs(value) * 1000) AS BIGINT) END"
    return f"""
        SELECT event_id, coalesce(reach > at_seconds, false) AS inside
        FROM (SELECT event_id, {at} AS at_seconds, max({span}) OVER (PARTITION BY user_id ORDER BY {at} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM events) t"""


# --- names, ids and texts -----------------------------------------------


@statement
def shell_tokens(d):
    """Section numbers rewritten with their separators kept; the slots must be as many after as before."""
    pattern = "^(SECTION[ -]*)[0-9]{2}([ -]*)[0-9]{2}([ -]*)[0-9]{2}"
    to = "$109$291$313" if d.name == "spark" else "\\109\\291\\313"
    changed = d.gsub("text", pattern, to)
    return f"""
        WITH o AS ({OUTLINE}), c AS (SELECT doc_id, paragraph_index, text, {changed} AS made FROM o WHERE text LIKE 'SECTION%')
        SELECT doc_id, paragraph_index, made, {d.like('text', pattern)} = {d.like('made', pattern)} AND length(text) = length(made) AS slots_kept FROM c"""


@statement
def safe_identifier(d):
    stem = d.gsub("lower(url)", "[^a-z0-9]+", "-")
    return f"SELECT page_id, concat(substr({stem}, 1, 24), '__', substr({d.sha256('url')}, 1, 12), '__chunk', CAST(page_id % 3 AS VARCHAR(3))) AS custom_id FROM pages"


@statement
def relationship_targets(d):
    """Targets that stay inside the package, resolved against the folder of their part; others with the reason."""
    target = "CASE WHEN page_id % 5 = 0 THEN concat('../', p) WHEN page_id % 7 = 0 THEN url WHEN page_id % 11 = 0 THEN concat('/', p) ELSE concat('./', p) END"
    return f"""
        SELECT page_id, fault, CASE WHEN fault IS NULL THEN concat('word/', {d.gsub('t', '^([.]/)+', '')}) END AS part_name
        FROM (SELECT page_id, t, CASE WHEN {d.like('t', '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN 'scheme' WHEN {d.like('t', '[?#]')} THEN 'query' WHEN t LIKE '/%' THEN 'absolute' WHEN {d.like('t', '(^|/)[.][.](/|$)')} THEN 'parent' END AS fault
          FROM (SELECT page_id, {target} AS t FROM (SELECT page_id, url, {d.sub('url', '^[a-z]+://[^/]*/(.*)$', 1)} AS p FROM pages) a) b) c"""


@statement
def import_remap(d):
    """Definitions from a template get ids above the target's; references follow by a join."""
    return """
        WITH top AS (SELECT max(s_suppkey) AS m FROM supplier), fresh AS (SELECT n_nationkey AS old_id, (SELECT m FROM top) + row_number() OVER (ORDER BY n_nationkey) AS new_id FROM nation)
        SELECT c.c_custkey, f.new_id FROM customer c JOIN fresh f ON c.c_nationkey = f.old_id"""


@statement
def operational_log(d):
    """Events at or above a level, kinds of trouble ranked; untrusted text shown as a fingerprint only."""
    return f"""
        SELECT event_id, CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 ELSE 20 END AS level_no, concat('[withheld sha256=', substr({d.sha256('props')}, 1, 12), ']') AS shown
        FROM events WHERE CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 ELSE 20 END >= 30"""
