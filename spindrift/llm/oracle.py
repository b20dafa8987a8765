"""The same results in ANSI SQL, where SQL can express them on whole tables."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

ACT = """act AS (SELECT webpage_id, pagerank FROM (
  SELECT *, row_number() OVER (PARTITION BY webpage_id ORDER BY last_modified_date DESC NULLS LAST, is_active DESC, is_crawled DESC, size DESC NULLS LAST, pagerank DESC NULLS LAST) AS v FROM webpage
) WHERE v = 1 AND is_active AND is_crawled)"""


def live(index: str) -> str:
    return f"""SELECT webpage_id, word_id, frequency, normalized_tf FROM (
  SELECT *, row_number() OVER (PARTITION BY webpage_id, word_id ORDER BY indexed_at DESC, frequency DESC, normalized_tf DESC NULLS LAST) AS v FROM {index}
) WHERE v = 1 AND frequency > 0"""


_P2 = f"""WITH {ACT}, body AS ({live('body_index')}), title AS ({live('title_index')}),
words AS (SELECT webpage_id, word_id, max(b) AS body_tf, max(t) AS title_tf FROM (
  SELECT webpage_id, word_id, normalized_tf AS b, NULL AS t FROM body UNION ALL SELECT webpage_id, word_id, NULL, normalized_tf FROM title) GROUP BY ALL),
items AS (SELECT DISTINCT query_id, webpage_id, pagerank, body_tf, title_tf FROM probe_query JOIN words USING (word_id) JOIN act USING (webpage_id)),
pct AS (SELECT query_id, webpage_id,
  percent_rank() OVER (PARTITION BY query_id ORDER BY pagerank ASC NULLS FIRST) AS p_pagerank,
  percent_rank() OVER (PARTITION BY query_id ORDER BY body_tf ASC NULLS FIRST) AS p_body_tf,
  percent_rank() OVER (PARTITION BY query_id ORDER BY title_tf ASC NULLS FIRST) AS p_title_tf FROM items),
vec AS (SELECT *, list_sort([p_pagerank, p_body_tf, p_title_tf]) AS v FROM pct)
"""


@lru_cache(maxsize=1)
def _terms() -> str:
    """CTE term (word_id, term_id).  Compatibility characters are replaced by what they stand for, by a table made from the Unicode data; SQL composes the result."""
    stands_for = []
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.decomposition(c).startswith("<"):
            plain = unicodedata.normalize("NFKD", c).replace("'", "''")
            stands_for.append(f"({i}, '{plain}')")
    return f"""compat AS (SELECT * FROM (VALUES {', '.join(stands_for)}) AS t(c, d)), chars AS (SELECT word_id, word, unnest(string_split(word, '')) AS c, unnest(range(1, len(string_split(word, '')) + 1)) AS i FROM keyword WHERE word <> ''),
normal AS (SELECT word_id, trim(regexp_replace(lower(nfc_normalize(string_agg(coalesce(d, chars.c), '' ORDER BY i))), '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS t FROM chars LEFT JOIN compat ON unicode(chars.c) = compat.c GROUP BY word_id, word
  UNION ALL SELECT word_id, '' FROM keyword WHERE word = ''),
term AS (SELECT DISTINCT word_id, term_id FROM normal JOIN (SELECT t, min(word_id) AS term_id FROM normal GROUP BY 1) USING (t))"""


def _term_rows(index: str) -> str:
    """(record, term, frequency) over act pages."""
    return f"SELECT webpage_id AS record, coalesce(term_id, word_id) AS term, sum(frequency)::BIGINT AS frequency FROM ({live(index)}) LEFT JOIN term USING (word_id) WHERE webpage_id IN (SELECT webpage_id FROM act) GROUP BY ALL"


_SCORE = "frequency / length * ln((1.0 + (SELECT count(*) FROM act)) / (1.0 + df))"


def _scored(rows: str) -> str:
    return f"(SELECT record, term, frequency, df, {_SCORE} AS score FROM {rows} JOIN (SELECT record, sum(frequency) AS length FROM {rows} GROUP BY 1) USING (record) JOIN (SELECT term, count(*) AS df FROM {rows} GROUP BY 1) USING (term))"


def _counts() -> str:
    return f"""WITH {ACT}, {_terms()}, body AS ({_term_rows('body_index')}), counts AS (SELECT term_id AS word_id, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records FROM (SELECT DISTINCT term_id FROM term) LEFT JOIN (SELECT term AS term_id, sum(frequency)::BIGINT AS occurrences, count(*) AS records FROM body GROUP BY 1) USING (term_id)),
marked AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 3 >= (SELECT count(*) FROM act) THEN 'common' END AS mark FROM counts)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {ACT}, {_terms()}, body AS ({_term_rows('body_index')}) SELECT record AS webpage_id, term AS word_id
FROM (SELECT record, term, row_number() OVER (PARTITION BY record ORDER BY score DESC, term) AS r FROM {_scored('body')} WHERE record IN (SELECT webpage_id FROM probe_page)) WHERE r = 1""",
        "p1_scores": f"""WITH {ACT}, {_terms()}, body AS ({_term_rows('body_index')}), title AS ({_term_rows('title_index')})
SELECT 'body' AS field, record AS webpage_id, term AS word_id, frequency, df, round(score, 9) AS score FROM {_scored('body')} UNION ALL SELECT 'title', record, term, frequency, df, round(score, 9) FROM {_scored('title')}""",
        "p6_found": _counts() + " SELECT word_id, mark FROM marked WHERE mark IS NOT NULL",
        "p6_frequencies": _counts() + " SELECT * FROM marked",
        "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
        "p7_offsets": "SELECT doc_id, length(text) AS reach, 0::BIGINT AS first, true AS numbered FROM documents WHERE text <> ''",
        "p8_fill": "SELECT true AS whole, true AS fits, true AS tight",
        "p2_found": _P2 + "SELECT query_id, webpage_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, webpage_id) AS r FROM vec) WHERE r <= 3",
        "p2_percentiles": _P2
        + "SELECT query_id, webpage_id, round(p_pagerank, 9) AS p_pagerank, round(p_body_tf, 9) AS p_body_tf, round(p_title_tf, 9) AS p_title_tf, round(v[1], 9) AS v0, round(v[2], 9) AS v1, round(v[3], 9) AS v2 FROM vec",
        "p3_found": f"""WITH {ACT}, body AS ({live('body_index')})
SELECT webpage_id, word_id FROM (SELECT webpage_id, word_id, row_number() OVER (PARTITION BY webpage_id ORDER BY frequency DESC, word_id) AS r
  FROM body WHERE webpage_id IN (SELECT webpage_id FROM act)) WHERE r <= 5""",
        "p4_found": f"""WITH {ACT}, w AS (SELECT DISTINCT webpage_id, word_id FROM ({live('body_index')} UNION ALL {live('title_index')}) WHERE webpage_id IN (SELECT webpage_id FROM act)),
n AS (SELECT count(*) AS n FROM act), d AS (SELECT word_id, count(*) AS c FROM w GROUP BY 1),
f AS (SELECT webpage_id, word_id, c FROM w JOIN d USING (word_id), n WHERE c >= 7 AND c * 5 <= n),
p AS (SELECT a.word_id AS word1_id, b.word_id AS word2_id, a.c AS n1, b.c AS n2, count(*) AS n12 FROM f a JOIN f b ON a.webpage_id = b.webpage_id AND a.word_id < b.word_id GROUP BY ALL)
SELECT word1_id, word2_id FROM p, n WHERE n12 >= 7 AND n12 * 4 >= 3 * least(n1, n2) AND n12 * n >= 5 * n1 * n2""",
    }
