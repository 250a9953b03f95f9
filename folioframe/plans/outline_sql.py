"""SQL of another engine for the outline operators: the state machine row by row, counters by subqueries."""

from __future__ import annotations

from ..sources.tables import OUTLINE

CLEAN = "regexp_replace(coalesce({x}, ''), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
MARKER = """CASE WHEN regexp_matches(t, '^[A-Z][.)][ \\t\\x{00A0}]') THEN 'upper_alpha' WHEN regexp_matches(t, '^[0-9]+[.][ \\t\\x{00A0}]') THEN 'number'
    WHEN regexp_matches(t, '^[a-z][.][ \\t\\x{00A0}]') THEN 'lower_alpha' WHEN regexp_matches(t, '^[0-9]+[)][ \\t\\x{00A0}]') THEN 'deep_5' WHEN regexp_matches(t, '^[a-z][)][ \\t\\x{00A0}]') THEN 'deep_6'
    WHEN regexp_matches(t, '^[(][0-9]+[)][ \\t\\x{00A0}]') THEN 'deep_7' WHEN regexp_matches(t, '^[(][a-z][)][ \\t\\x{00A0}]') THEN 'deep_8' END"""
SIX = "[0-9]{2}([\\s\\x{00A0}]*[-\\x{2010}-\\x{2015}]?[\\s\\x{00A0}]*[0-9]{2}){2}"
FREE = f"""CASE WHEN regexp_matches(t, '(?i)^SECTION[\\s\\x{{00A0}}]*{SIX}\\b') THEN 'SectionID'
    WHEN regexp_matches(t, '(?i)^END[\\s\\x{{00A0}}]+OF[\\s\\x{{00A0}}]+(SECTION|DIVISION)([\\s\\x{{00A0}}]+{SIX})?[\\s\\x{{00A0}}]*[-.\\x{{2010}}-\\x{{2015}}]*[\\s\\x{{00A0}}]*$') THEN 'END_OF_SECTION'
    WHEN regexp_matches(t, '(?i)^PART[\\s\\x{{00A0}}]+([0-9]+|[IVXLCDM]+)([\\s\\x{{00A0}}]*[-:.\\x{{2010}}-\\x{{2015}}][\\s\\x{{00A0}}]*|[\\s\\x{{00A0}}]+)[^\\s\\x{{00A0}}]') THEN 'PART'
    WHEN regexp_matches(t, '^[0-9]{{1,2}}[.][0-9]{{2,3}}(\\s|$)') THEN 'ARTICLE' WHEN m = 'upper_alpha' THEN 'PARAGRAPH' END"""
MARKED = f"o AS ({OUTLINE}), p AS (SELECT doc_id, paragraph_index, {CLEAN.format(x='text')} AS t FROM o), q AS (SELECT *, {MARKER} AS m FROM p)"
LABEL = "regexp_extract(t, '^([(]?)([A-Za-z]|[0-9]+)[.)]+[ \\t]+', 2)"
NUMBER = f"CASE WHEN regexp_matches({LABEL}, '^[0-9]+$') THEN CAST({LABEL} AS BIGINT) ELSE CAST(ascii(upper({LABEL})) - 64 AS BIGINT) END"
# The state machine itself, row by row: alpha, numeric.
GATED = f"""RECURSIVE {MARKED}, e AS (SELECT *, {FREE} AS f FROM q),
  s(doc_id, i, alpha, num, role) AS (
    SELECT doc_id, CAST(-1 AS BIGINT), false, false, CAST(NULL AS VARCHAR) FROM e WHERE paragraph_index = 0
    UNION ALL
    SELECT doc_id, i, CASE WHEN role = 'PARAGRAPH' THEN true WHEN role IN ('SectionID', 'SectionTitle', 'PART', 'ARTICLE', 'END_OF_SECTION') THEN false ELSE alpha END,
           CASE WHEN role = 'SUBPARAGRAPH' THEN true WHEN role IN ('PARAGRAPH', 'SectionID', 'SectionTitle', 'PART', 'ARTICLE', 'END_OF_SECTION') THEN false ELSE num END, role
    FROM (SELECT e.doc_id, e.paragraph_index AS i, s.alpha, s.num,
      CASE WHEN e.f IS NOT NULL THEN e.f WHEN e.m = 'deep_5' AND alpha THEN 'SUBPARAGRAPH_LEVEL_5' WHEN e.m = 'deep_6' AND alpha THEN 'SUBPARAGRAPH_LEVEL_6' WHEN e.m = 'deep_7' AND alpha THEN 'SUBPARAGRAPH_LEVEL_7'
           WHEN e.m = 'deep_8' AND alpha THEN 'SUBPARAGRAPH_LEVEL_8' WHEN e.m = 'number' AND alpha THEN 'SUBPARAGRAPH' WHEN e.m = 'lower_alpha' AND num THEN 'SUBSUBPARAGRAPH' END AS role
      FROM s JOIN e ON e.doc_id = s.doc_id AND e.paragraph_index = s.i + 1) t)"""
COUNTED = f"""n AS (SELECT s.doc_id, s.i, s.role, q.t, CASE s.role WHEN 'PART' THEN TRY_CAST(regexp_extract(q.t, '^PART +([0-9]+)', 1) AS BIGINT) WHEN 'ARTICLE' THEN TRY_CAST(regexp_extract(q.t, '^[0-9]+[.]([0-9]+)', 1) AS BIGINT) ELSE {NUMBER.replace('(t,', '(q.t,').replace('CAST(', 'TRY_CAST(', 1)} END AS ord,
      CASE s.role WHEN 'PART' THEN 1 WHEN 'ARTICLE' THEN 2 WHEN 'PARAGRAPH' THEN 3 WHEN 'SUBPARAGRAPH' THEN 4 WHEN 'SUBSUBPARAGRAPH' THEN 5 WHEN 'SUBPARAGRAPH_LEVEL_5' THEN 6 WHEN 'SUBPARAGRAPH_LEVEL_6' THEN 7 WHEN 'SUBPARAGRAPH_LEVEL_7' THEN 8 WHEN 'SUBPARAGRAPH_LEVEL_8' THEN 9 ELSE 0 END AS lvl
      FROM s JOIN q ON q.doc_id = s.doc_id AND q.paragraph_index = s.i WHERE s.role IS NOT NULL),
    c AS (SELECT x.*, (SELECT count(*) FROM n y WHERE y.doc_id = x.doc_id AND y.i < x.i AND y.lvl < x.lvl) AS inst FROM n x WHERE x.lvl > 0)"""
