"""The queries of plans/queries.py in ANSI SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from spindrift.functions import porter
from spindrift.functions.text import PHRASE_STOPWORDS, STOPWORDS
from spindrift.plans.queries import ALL, ANY, NOT, SINCE, UNTIL

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_PUNCT = r"[!-/:-@\[-`{-~]"
_BLANK = r"[\x09-\x0d ]+"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{_PUNCT}', ' ', 'g'), '{_BLANK}', ' ', 'g'), ' ')"


def _tokens(c: str) -> str:
    return f"list_filter(string_split(lower({_squeeze(c)}), ' '), lambda x: x <> '')"


def _kept(c: str) -> str:
    return f"list_filter({_tokens(c)}, lambda x: x NOT IN ({_STOP}))"


def _phrases(c: str) -> str:
    marked = f"array_to_string(list_transform({_tokens(c)}, lambda x: CASE WHEN x IN ({_STOP}) THEN '|' ELSE x END), ' ')"
    return f"list_filter(list_transform(string_split({marked}, '|'), lambda r: trim(r, ' ')), lambda r: regexp_full_match(r, '[^ ]+( [^ ]+){{1,2}}'))"


def _form(x: str) -> str:
    """The word with i for a y that is a vowel (after a consonant, which a y after a vowel or at the start is)."""
    return f"regexp_replace(regexp_replace({x}, '([^aeiouy])y', '\\1i', 'g'), 'yy', 'yi', 'g')"


def _m(x: str, least: int) -> str:
    return f"regexp_matches({_form(x)}, '^[^aeiou]*" + "[aeiou]+[^aeiou]+" * (least - 1) + "[aeiou]+[^aeiou]')"


def _vowel(x: str) -> str:
    return f"regexp_matches({_form(x)}, '[aeiou]')"


def _cvc(x: str) -> str:
    return f"(length({x}) > 2 AND regexp_matches({_form(x)}, '[^aeiou][aeiou][^aeiou]$') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _double(x: str) -> str:
    return f"(length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND regexp_matches({_form(x)}, '[^aeiou]$'))"


def _suffixes(table: list[tuple[str, str]], condition: Callable[[str, str], str]) -> str:
    """The longest suffix that fits ends the step, whether or not it is replaced."""
    cases = " ".join(f"WHEN w LIKE '%{end}' THEN CASE WHEN {condition(f'left(w, -{len(end)})', end)} THEN left(w, -{len(end)}) || '{new}' ELSE w END" for end, new in sorted(table, key=lambda t: -len(t[0])))
    return f"CASE {cases} ELSE w END"


def _stems(words: str, n: str = "") -> str:
    """CTE stems (word, stem) of the distinct words of a query (word): the stemmer's steps of 1980, one after the other."""
    steps = [
        "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_m('left(w, -3)', 1)} THEN left(w, -1) ELSE w END WHEN w LIKE '%ed' THEN CASE WHEN {_vowel('left(w, -2)')} THEN left(w, -2) || '+' ELSE w END WHEN w LIKE '%ing' AND {_vowel('left(w, -3)')} THEN left(w, -3) || '+' ELSE w END",
        f"CASE WHEN w NOT LIKE '%+' THEN w WHEN regexp_matches(w, '(at|bl|iz)[+]$') THEN left(w, -1) || 'e' WHEN {_double('left(w, -1)')} AND left(right(w, 2), 1) NOT IN ('l', 's', 'z') THEN left(w, -2) WHEN {_m('left(w, -1)', 1)} AND NOT {_m('left(w, -1)', 2)} AND {_cvc('left(w, -1)')} THEN left(w, -1) || 'e' ELSE left(w, -1) END",
        f"CASE WHEN w LIKE '%y' AND {_vowel('left(w, -1)')} THEN left(w, -1) || 'i' ELSE w END",
        _suffixes(porter._STEP2, lambda x, _: _m(x, 1)),
        _suffixes(porter._STEP3, lambda x, _: _m(x, 1)),
        _suffixes([(e, "") for e in porter._STEP4], lambda x, e: _m(x, 2) + (f" AND right({x}, 1) IN ('s', 't')" if e == "ion" else "")),
        f"CASE WHEN w LIKE '%e' AND ({_m('left(w, -1)', 2)} OR {_m('left(w, -1)', 1)} AND NOT {_cvc('left(w, -1)')}) THEN left(w, -1) ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {_m('w', 2)} AND {_double('w')} THEN left(w, -1) ELSE w END",
    ]
    out = f"st{n}0 AS (SELECT DISTINCT word, word AS w FROM ({words}))"
    for i, step in enumerate(steps, 1):
        out += f", st{n}{i} AS (SELECT word, {step} AS w FROM st{n}{i - 1})"
    return f"{out}, stems{n} AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE w END AS stem FROM st{n}{len(steps)})"


_PARTING = ", ".join(f"'{w}'" for w in PHRASE_STOPWORDS)


def _text_terms(source: str, key: str, text: str, name: str = "") -> str:
    """CTE terms (key, term, frequency): stemmed words and phrases of the texts of a source; the stems are those of all its words."""
    n = name
    stems = _stems(f"SELECT word FROM seq{n}", n)
    return f"""tok{n} AS (SELECT {key}, {_tokens(text)} AS t FROM {source}), seq{n} AS (SELECT {key}, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM tok{n} WHERE t IS NOT NULL),
{stems},
counted{n} AS (SELECT {key}, stem AS term, count(*) AS frequency FROM seq{n} JOIN stems{n} USING (word) WHERE word NOT IN ({_STOP}) GROUP BY ALL),
parted{n} AS (SELECT {key}, word, stem, i, sum(CASE WHEN word IN ({_PARTING}) THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS run FROM seq{n} JOIN stems{n} USING (word)),
phrases{n} AS (SELECT DISTINCT {key}, phrase FROM (SELECT {key}, run, string_agg(stem, ' ' ORDER BY i) AS phrase, count(*) AS c FROM parted{n} WHERE word NOT IN ({_PARTING}) AND word NOT IN ({_STOP}) GROUP BY ALL) WHERE c BETWEEN 2 AND 3),
terms{n} AS (SELECT * FROM counted{n} UNION ALL SELECT {key}, phrase, min(frequency) FROM (SELECT {key}, phrase, unnest(string_split(phrase, ' ')) AS term FROM phrases{n}) JOIN counted{n} USING ({key}, term) GROUP BY ALL)"""


def _words(words) -> str:
    return f"(SELECT min(word_id) FROM keyword WHERE word IN ({', '.join(repr(w) for w in words)}) GROUP BY word)"


def _word(w: str) -> str:
    return f"(SELECT min(word_id) FROM keyword WHERE word = '{w}')"


_PAGE_ORDER = "last_modified_date DESC NULLS LAST, is_active DESC, is_crawled DESC, size DESC NULLS LAST, pagerank DESC NULLS LAST, title DESC NULLS LAST, url DESC"
_STANDING = f"standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY webpage_id ORDER BY {_PAGE_ORDER}) AS v FROM webpage) WHERE v = 1)"
_ACT = f"{_STANDING}, act AS (SELECT webpage_id, url, title, last_modified_date, size, pagerank FROM standing WHERE is_active AND is_crawled)"


def _posts(index: str) -> str:
    return f"(SELECT webpage_id, word_id, frequency, normalized_tf FROM (SELECT *, row_number() OVER (PARTITION BY webpage_id, word_id ORDER BY indexed_at DESC, frequency DESC, normalized_tf DESC NULLS LAST) AS v FROM {index}) WHERE v = 1)"


_POST = f"""{_ACT}, stand_t AS {_posts('title_index')}, stand_b AS {_posts('body_index')},
post AS (SELECT * FROM (SELECT 'title' AS field, * FROM stand_t UNION ALL SELECT 'body', * FROM stand_b) WHERE frequency > 0 AND webpage_id IN (SELECT webpage_id FROM act))"""
_IDF = f"""{_POST}, n AS (SELECT count(*) AS n FROM act),
idf AS (SELECT field, word_id, count(*) AS df, log10(any_value(n.n)::DOUBLE / count(*)) AS idf FROM post, n GROUP BY field, word_id),
idfc AS (SELECT * FROM (SELECT word_id, sum(CASE WHEN field = 'title' THEN 0.7 ELSE 0.3 END * idf) AS idf FROM idf GROUP BY word_id) WHERE idf > 0)"""
_VEC = f"""{_IDF}, vec AS (SELECT webpage_id, word_id, sum(CASE WHEN field = 'title' THEN 0.7 ELSE 0.3 END * coalesce(normalized_tf, 0) * idf) AS weight FROM post JOIN idf USING (field, word_id) GROUP BY ALL),
norms AS (SELECT webpage_id, sqrt(sum(weight * weight)) AS norm FROM vec GROUP BY 1)"""
_TOP = f"""{_VEC}, top AS (SELECT * FROM (SELECT webpage_id, word_id, round(weight, 9) AS weight, row_number() OVER (PARTITION BY webpage_id ORDER BY round(weight, 9) DESC, word_id) AS rank FROM vec) WHERE rank <= 5)"""


def _search(words_cte: str, must: str = "") -> str:
    """CTEs q (word_id, weight) and cand are given; gives scored (webpage_id, o)."""
    return f"""{words_cte}, qn AS (SELECT sqrt(sum(weight * weight)) AS qn FROM q),
cand AS (SELECT DISTINCT webpage_id FROM post WHERE word_id IN (SELECT word_id FROM anyw){must} AND webpage_id IN (SELECT webpage_id FROM norms)),
dots AS (SELECT webpage_id, sum(vec.weight * q.weight) AS dot FROM vec JOIN q USING (word_id) GROUP BY 1),
scored AS (SELECT webpage_id, coalesce(coalesce(dot, 0) / nullif(norm * qn, 0), 0) AS o FROM cand LEFT JOIN dots USING (webpage_id) LEFT JOIN norms USING (webpage_id), qn),
ends AS (SELECT min(pagerank) AS lo, max(pagerank) AS hi FROM standing)"""


def _tf(weights: dict[str, float]) -> str:
    rows = " UNION ALL ".join(f"SELECT {_word(w)} AS word_id, {v} AS tf" for w, v in weights.items())
    return f"tf AS (SELECT * FROM ({rows}) WHERE word_id IS NOT NULL), q AS (SELECT word_id, tf * idf AS weight FROM tf JOIN idfc USING (word_id))"


_TEXT_TF = {"crawler": 1.0, "museum": 0.5, "curator": 0.5}
_SCALED = "coalesce((pagerank - lo) / nullif(hi - lo, 0), 0)"


def _text_search() -> str:
    return f"WITH {_VEC}, {_tf(_TEXT_TF)}, anyw AS (SELECT word_id FROM tf), " + _search("dummy AS (SELECT 1)")


def _joined(body: str) -> str:
    out = f"WITH {_VEC}, ends AS (SELECT min(pagerank) AS lo, max(pagerank) AS hi FROM standing)"
    for i, words in enumerate((("crawler", "museum"), ("museum", "curator"))):
        rows = " UNION ALL ".join(f"SELECT {_word(w)} AS word_id" for w in words)
        out += f""", w{i} AS (SELECT * FROM ({rows}) WHERE word_id IS NOT NULL), q{i} AS (SELECT word_id, idf AS weight FROM w{i} JOIN idfc USING (word_id)),
l{i} AS (SELECT webpage_id, o, 0.7 * o + 0.3 * {_SCALED} AS m FROM (SELECT webpage_id, coalesce(coalesce(dot, 0) / nullif(norm * qn, 0), 0) AS o
  FROM (SELECT DISTINCT webpage_id FROM post WHERE word_id IN (SELECT word_id FROM w{i})) LEFT JOIN (SELECT webpage_id, sum(vec.weight * q{i}.weight) AS dot FROM vec JOIN q{i} USING (word_id) GROUP BY 1) USING (webpage_id) JOIN norms USING (webpage_id), (SELECT sqrt(sum(weight * weight)) AS qn FROM q{i})) JOIN act USING (webpage_id), ends)"""
    return f"{out} {body}"


def _pairs(field: str) -> str:
    above = 1 if field == "title" else 3
    return f"""s_{field} AS (SELECT webpage_id, word_id, frequency AS f FROM post WHERE field = '{field}' AND frequency > {above}),
f_{field} AS (SELECT word_id, sum(f) AS t FROM s_{field} GROUP BY 1), n_{field} AS (SELECT sum(frequency) AS n FROM post WHERE field = '{field}'),
p_{field} AS (SELECT a.word_id AS word1_id, b.word_id AS word2_id, a.webpage_id, least(a.f, b.f) AS m, fa.t AS t1, fb.t AS t2, n FROM s_{field} a JOIN s_{field} b ON a.webpage_id = b.webpage_id AND a.word_id < b.word_id
  JOIN f_{field} fa ON fa.word_id = a.word_id JOIN f_{field} fb ON fb.word_id = b.word_id, n_{field}),
pv_{field} AS (SELECT word1_id, word2_id, max(pmi) AS pmi FROM (SELECT word1_id, word2_id, round(log10((m * n)::DOUBLE / (t1 * t2)), 9) AS pmi FROM p_{field}) WHERE pmi > 0.3 GROUP BY ALL),
pp_{field} AS (SELECT * FROM (SELECT word1_id, word2_id, round(log10((sum(m) * any_value(n))::DOUBLE / (any_value(t1) * any_value(t2))), 9) AS pmi FROM p_{field} GROUP BY word1_id, word2_id) WHERE pmi > 0.3),
tl_{field} AS (SELECT word1_id, word2_id, pmi FROM (SELECT *, dense_rank() OVER (ORDER BY pmi DESC) AS r FROM pv_{field}) WHERE r <= 5),
tt_{field} AS (SELECT DISTINCT least(w, o) AS word1_id, greatest(w, o) AS word2_id, pmi FROM (SELECT *, dense_rank() OVER (PARTITION BY w ORDER BY pmi DESC) AS r FROM (SELECT word1_id AS w, word2_id AS o, pmi FROM pp_{field} UNION ALL SELECT word2_id, word1_id, pmi FROM pp_{field})) WHERE r <= 5)"""


def _expand(pmi: str, tf: str = "tf") -> str:
    """CTE co (word_id, weight) from a pair table and the query's tf."""
    return f"""dir AS (SELECT word1_id AS a, word2_id AS b, pmi FROM {pmi} UNION ALL SELECT word2_id, word1_id, pmi FROM {pmi}),
co AS (SELECT word_id, weight FROM (SELECT *, dense_rank() OVER (ORDER BY weight DESC) AS r FROM (SELECT b AS word_id, round(max(pmi / (SELECT max(pmi) FROM {pmi}) * 0.5 * {tf}.tf) * any_value(idfc.idf), 9) AS weight FROM dir JOIN {tf} ON dir.a = {tf}.word_id JOIN idfc ON idfc.word_id = dir.b
  WHERE b NOT IN (SELECT word_id FROM {tf}) GROUP BY b)) WHERE r <= 5)"""


_HISTORY = """numbered AS (SELECT webpage_id, row_number() OVER (ORDER BY webpage_id) - 1 AS k FROM act),
seen AS (SELECT user_id AS query_id, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 END AS relevance FROM events WHERE event_type IN ('click', 'purchase', 'error')),
inter AS (SELECT query_id, webpage_id, relevance FROM seen, n JOIN numbered ON numbered.k = event_id % n.n),
users AS (SELECT query_id, webpage_id FROM (SELECT DISTINCT query_id FROM seen), n JOIN numbered ON numbered.k = query_id % n.n),
past AS (SELECT query_id, word_id, weight FROM users JOIN top USING (webpage_id)),
psim AS (SELECT query_id, round(coalesce(sum(past.weight * q.weight) / nullif(any_value(pn) * (SELECT sqrt(sum(weight * weight)) FROM q), 0), 0), 3) AS similarity FROM past JOIN q USING (word_id) JOIN (SELECT query_id, sqrt(sum(weight * weight)) AS pn FROM past GROUP BY 1) USING (query_id) GROUP BY 1),
sim AS (SELECT query_id, similarity FROM (SELECT *, dense_rank() OVER (ORDER BY similarity DESC) AS r FROM psim WHERE similarity > 0) WHERE r <= 5),
r AS (SELECT webpage_id, relevance * similarity AS r FROM inter JOIN sim USING (query_id)),
rs AS (SELECT sum(r) FILTER (r > 0) AS pos, -sum(r) FILTER (r < 0) AS neg FROM r),
moved AS (SELECT word_id, sum(weight) AS weight FROM (SELECT word_id, weight FROM q UNION ALL SELECT word_id, top.weight * s FROM (SELECT webpage_id, sum(CASE WHEN r > 0 THEN r * 0.5 / pos ELSE r * 0.25 / neg END) AS s FROM r, rs WHERE r <> 0 GROUP BY 1) JOIN top USING (webpage_id)) GROUP BY 1)"""

_GRAPH = f"""{_ACT}, edges AS (SELECT DISTINCT parent_id, child_id FROM relationship WHERE is_active AND parent_id <> child_id AND parent_id IN (SELECT webpage_id FROM act) AND child_id IN (SELECT webpage_id FROM act)),
deg AS (SELECT parent_id, count(*) AS c FROM edges GROUP BY 1)"""


def _pagerank(rounds: int, literal: bool = False, start: str = "1.0", only: str = "") -> str:
    out = f"WITH {_GRAPH}, r0 AS MATERIALIZED (SELECT webpage_id, {start} AS r FROM act)"
    for i in range(1, rounds + 1):
        own = "r + " if literal else ""
        out += f""", r{i} AS MATERIALIZED (SELECT webpage_id, CASE WHEN s IS NULL THEN r ELSE {own}0.15 + 0.85 * s END AS r FROM r{i - 1} LEFT JOIN (SELECT child_id, sum(r / c) AS s FROM edges JOIN deg USING (parent_id) JOIN r{i - 1} ON webpage_id = parent_id {only} GROUP BY 1) ON child_id = webpage_id)"""
    return out + " "


_SPLIT_PAGES = f"""WITH {_STANDING}, old AS (SELECT webpage_id, url, title, size, is_active FROM standing),
new AS (SELECT webpage_id, url, upper(title) AS title, coalesce(size, 0) + 1 AS size, true AS is_active FROM old WHERE webpage_id % 2 = 0 UNION ALL SELECT webpage_id + 10000000, url || '?new', title, size, false FROM old WHERE webpage_id % 5 = 0)"""


def _frontier(levels: int) -> str:
    """Level by level; where a level exceeds what is left, its smallest ids are taken."""
    out = f"""WITH {_ACT}, most AS (SELECT greatest(1, count(*) // 2) AS m FROM act), links AS (SELECT DISTINCT parent_id, child_id FROM relationship WHERE is_active),
v0 AS MATERIALIZED (SELECT min(webpage_id) AS page_id, 0 AS depth FROM act)"""
    for i in range(1, levels + 1):
        out += f""", v{i} AS MATERIALIZED (SELECT * FROM v{i - 1} UNION ALL SELECT page_id, {i} FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r FROM (SELECT DISTINCT child_id AS page_id FROM links WHERE parent_id IN (SELECT page_id FROM v{i - 1} WHERE depth = {i - 1}) AND child_id NOT IN (SELECT page_id FROM v{i - 1}))) WHERE r <= (SELECT m FROM most) - (SELECT count(*) FROM v{i - 1}))"""
    return f"{out} SELECT page_id, depth FROM v{levels}"


def _bool(view: str, kind: str) -> str:
    words = {"any": ANY, "all": ALL, "not": NOT}[kind]
    field = "" if view == "page" else f"field = '{view}' AND "
    if kind == "all":
        return f"WITH {_POST} SELECT webpage_id FROM post WHERE {field}word_id IN {_words(words)} GROUP BY 1 HAVING count(DISTINCT word_id) = {len(words)}"
    having = f"(SELECT webpage_id FROM post WHERE {field}word_id IN {_words(words)})"
    return f"WITH {_POST} SELECT webpage_id FROM act WHERE webpage_id {'NOT ' if kind == 'not' else ''}IN {having}"


def _neighbours(pages: str = "act") -> str:
    return f"""near AS (SELECT webpage_id, kind, rank, neighbour_id, url FROM (SELECT *, row_number() OVER (PARTITION BY webpage_id, kind ORDER BY neighbour_id) AS rank FROM (
  SELECT parent_id AS webpage_id, 'child' AS kind, child_id AS neighbour_id FROM e UNION ALL SELECT child_id, 'parent', parent_id FROM e)) JOIN (SELECT webpage_id AS neighbour_id, url FROM {pages}) USING (neighbour_id) WHERE rank <= 5)"""


def _report(keywords: int = 10, relations: int = 5, parents: bool = True) -> str:
    """Neighbours are active pages, crawled or not."""
    return f"""WITH {_POST}, active AS (SELECT webpage_id, url FROM standing WHERE is_active), e AS (SELECT DISTINCT parent_id, child_id FROM relationship WHERE is_active),
near AS (SELECT webpage_id, kind, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY webpage_id, kind ORDER BY neighbour_id) AS rank FROM (
  SELECT parent_id AS webpage_id, 'child' AS kind, child_id AS neighbour_id FROM e UNION ALL SELECT child_id, 'parent', parent_id FROM e) SEMI JOIN act USING (webpage_id) JOIN (SELECT webpage_id AS neighbour_id, url FROM active) USING (neighbour_id)) WHERE rank <= {relations}),
tw AS (SELECT webpage_id, field, string_agg(word || ' ' || frequency, '; ' ORDER BY rank) AS s FROM (SELECT *, row_number() OVER (PARTITION BY webpage_id, field ORDER BY frequency DESC, word_id) AS rank FROM post) JOIN keyword USING (word_id) WHERE rank <= {keywords} GROUP BY ALL),
nw AS (SELECT webpage_id, kind, string_agg(url, chr(10) ORDER BY rank) AS s FROM near GROUP BY ALL)
SELECT act.webpage_id, concat_ws(chr(10), coalesce(title, ''), url, coalesce(strftime(last_modified_date, '%Y-%m-%d %H:%M:%S'), '-') || ', ' || coalesce(size, 0), coalesce(t.s, 'No Title Keyword Found'), coalesce(b.s, 'No Body Keyword Found'), coalesce(c.s, 'No Child Found'){", coalesce(p.s, 'No Parent Found')" if parents else ""}) AS block
FROM act LEFT JOIN (SELECT * FROM tw WHERE field = 'title') t USING (webpage_id) LEFT JOIN (SELECT * FROM tw WHERE field = 'body') b USING (webpage_id) LEFT JOIN (SELECT * FROM nw WHERE kind = 'child') c USING (webpage_id) LEFT JOIN (SELECT * FROM nw WHERE kind = 'parent') p USING (webpage_id)"""


def _text_index() -> str:
    """CTEs held (the act pages with a document), tpost (webpage_id, field, term, frequency, normalized_tf), tidf, tvec, tnorms."""
    latest = "(SELECT webpage_id, arg_max(coalesce(text, chr(0)), {'at': fetched_at, 'id': doc_id}) AS text FROM documents WHERE webpage_id IS NOT NULL GROUP BY 1)"
    return f"""{_ACT}, docs AS (SELECT webpage_id, nullif(text, chr(0)) AS text FROM {latest} SEMI JOIN act USING (webpage_id)), held AS (SELECT * FROM act SEMI JOIN docs USING (webpage_id)),
{_text_terms('docs', 'webpage_id', 'text', 'b')}, {_text_terms('held', 'webpage_id', 'title', 't')},
tpost AS (SELECT *, frequency / max(frequency) OVER (PARTITION BY webpage_id, field) AS normalized_tf FROM (SELECT 'body' AS field, * FROM termsb UNION ALL SELECT 'title', * FROM termst)),
tidf AS (SELECT field, term, log10((SELECT count(*) FROM held)::DOUBLE / count(*)) AS idf FROM tpost GROUP BY ALL), tboth AS (SELECT * FROM (SELECT term, sum(CASE WHEN field = 'title' THEN 0.7 ELSE 0.3 END * idf) AS idf FROM tidf GROUP BY 1) WHERE idf > 0),
tvec AS (SELECT webpage_id, term, sum(CASE WHEN field = 'title' THEN 0.7 ELSE 0.3 END * normalized_tf * idf) AS weight FROM tpost JOIN tidf USING (field, term) GROUP BY ALL), tnorms AS (SELECT webpage_id, sqrt(sum(weight * weight)) AS norm FROM tvec GROUP BY 1)"""


def _stem_search(tf: dict[str, float], some: str, must: str = "") -> str:
    rows = " UNION ALL ".join(f"SELECT '{w}' AS term, {v} AS tf" for w, v in tf.items())
    return f"""WITH {_text_index()}, tq AS (SELECT term, tf * idf AS weight FROM ({rows}) JOIN tboth USING (term)), tqn AS (SELECT sqrt(sum(weight * weight)) AS qn FROM tq),
tdots AS (SELECT webpage_id, sum(tvec.weight * tq.weight) AS dot FROM tvec JOIN tq USING (term) GROUP BY 1),
thits AS (SELECT webpage_id, coalesce(coalesce(dot, 0) / nullif(norm * qn, 0), 0) AS o FROM (SELECT DISTINCT webpage_id FROM tpost WHERE term IN ({some}){must}) LEFT JOIN tdots USING (webpage_id) JOIN tnorms USING (webpage_id), tqn),
ends AS (SELECT min(pagerank) AS lo, max(pagerank) AS hi FROM held)"""


_E = "e AS (SELECT DISTINCT parent_id, child_id FROM relationship WHERE is_active AND parent_id IN (SELECT webpage_id FROM act) AND child_id IN (SELECT webpage_id FROM act))"
_STRONG = "CASE WHEN length(word) >= {n} THEN ((length(word) - length(replace(word, '{t}', ''))) / {n})::BIGINT::DOUBLE / (length(word) - {n} + 1) ELSE 0 END"


def _fuzzy(terms: dict[str, float]) -> str:
    parts = [f"CASE WHEN contains(word, '{t}') THEN {v} * {_STRONG.format(t=t, n=len(t))} END" for t, v in sorted(terms.items())]
    value = parts[0] if len(parts) == 1 else f"greatest({', '.join(parts)})"
    return f"SELECT word_id, word, round({value}, 9) AS weight FROM keyword WHERE {value} IS NOT NULL AND word NOT IN ({', '.join(repr(t) for t in terms)})"


def _suggest() -> str:
    return f"""WITH {_TOP}, tf AS (SELECT * FROM (SELECT {_word('museum')} AS word_id, 1.0 AS tf) WHERE word_id IS NOT NULL), q AS (SELECT word_id, tf * idf AS weight FROM tf JOIN idfc USING (word_id)),
{_pairs('body')}, {_expand('tt_body')}, {_HISTORY}, fz AS ({_fuzzy({'museum': 1.0, 'craw': 1.0})}),
rel AS (SELECT word_id, round(weight, 9) AS weight FROM moved WHERE word_id NOT IN (SELECT word_id FROM q) AND round(weight, 9) >= 0 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT 'fuzzy' AS kind, word AS suggestion, round(weight, 6) AS value FROM (SELECT *, dense_rank() OVER (ORDER BY weight DESC) AS r FROM fz) WHERE r <= 5 AND weight > 0
UNION ALL SELECT 'co_occurring', word, round(weight, 6) FROM co JOIN keyword USING (word_id) WHERE weight > 0
UNION ALL SELECT 'relevant', word, round(weight, 6) FROM rel JOIN keyword USING (word_id)
UNION ALL SELECT 'similar', 'pages like ' || webpage_id, max(similarity) FROM sim JOIN users USING (query_id) GROUP BY webpage_id"""


def oracle_sql() -> dict[str, str]:
    o = {
        "q_tokenize": f"SELECT doc_id, coalesce(len(t), 0) AS n_tokens, coalesce(len(list_distinct(t)), 0) AS n_terms, coalesce(array_to_string(t, ' '), '') AS tokens FROM (SELECT doc_id, {_kept('text')} AS t FROM documents)",
        "q_postings_body": f"WITH {_text_terms('documents', 'doc_id', 'text')} SELECT doc_id, 'body' AS field, term, frequency, round(frequency / max(frequency) OVER (PARTITION BY doc_id), 9) AS normalized_tf FROM terms",
        "q_postings_title": f"WITH {_STANDING}, {_text_terms('standing', 'webpage_id', 'title')} SELECT webpage_id, 'title' AS field, term, frequency, round(frequency / max(frequency) OVER (PARTITION BY webpage_id), 9) AS normalized_tf FROM terms",
        "q_normalized_tf": f"WITH {_POST} SELECT webpage_id, field, word_id, round(frequency / max(frequency) OVER (PARTITION BY webpage_id, field), 9) AS normalized_tf FROM post",
        "q_keyword_dict": f"WITH {_text_terms('documents', 'doc_id', 'text')} SELECT term AS word, row_number() OVER (ORDER BY term) AS word_id FROM (SELECT DISTINCT term FROM terms)",
        "q_keyword_totals": f"""SELECT word_id, word, title_total, body_total, title_total + body_total AS total FROM (SELECT word_id, sum(t)::BIGINT AS title_total, sum(b)::BIGINT AS body_total FROM (SELECT word_id, frequency AS t, 0 AS b FROM {_posts('title_index')} WHERE frequency > 0 UNION ALL SELECT word_id, 0, frequency FROM {_posts('body_index')} WHERE frequency > 0) GROUP BY 1) JOIN keyword USING (word_id)""",
        "q_phrases_rake": f"SELECT doc_id, phrase, count(*) AS n FROM (SELECT doc_id, unnest({_phrases('text')}) AS phrase FROM documents) GROUP BY ALL",
        "q_porter_stem": f"WITH {_stems('SELECT word FROM keyword')} SELECT word_id, word, stem FROM keyword JOIN stems USING (word)",
        "q_quoted_phrases": """SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS phrase FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '"(.*?)"', 1), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)""",
        "q_substring_probability": f"""SELECT word_id, round({_STRONG.format(t='er', n=2)}, 9) AS p, ((length(word) - length(replace(word, 'er', ''))) / 2)::BIGINT AS n,
array_to_string(list_slice(list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(list_slice(parts, 1, i), lambda s: length(s))) + (i - 1) * 2), 1, len(parts) - 1), ',') AS at FROM (SELECT word_id, word, string_split(word, 'er') AS parts FROM keyword)""",
        "q_page_title": f"WITH {_ACT} SELECT webpage_id, trim(coalesce(title, '')) AS title FROM act",
        "q_extract_links": f"WITH {_ACT} SELECT DISTINCT p.url AS url, c.url AS child_url FROM relationship r JOIN act p ON p.webpage_id = parent_id JOIN standing c ON c.webpage_id = child_id WHERE r.is_active AND p.url <> c.url",
        "q_url_valid": r"SELECT DISTINCT webpage_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 1) <> '' AND regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2) <> '' AS valid, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2) AS host, false AS cut_valid FROM webpage",
        "q_html_text": f"""WITH {_ACT}, l AS (SELECT parent_id, count(*) AS n FROM (SELECT DISTINCT parent_id, child_id FROM relationship WHERE is_active) WHERE child_id IN (SELECT webpage_id FROM standing) GROUP BY 1)
SELECT webpage_id, trim(coalesce(title, ''), ' ') AS title, length(coalesce(title, '')) + length('On ' || webpage_id) + 2 * coalesce(n, 0) AS n_chars, coalesce(n, 0) AS n_links FROM act LEFT JOIN l ON parent_id = webpage_id""",
        "q_normalize_url": f"""WITH {_ACT}, u AS (SELECT webpage_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM act),
f AS (SELECT *, scheme || '://' || host AS base, list_filter(string_split(regexp_extract(path, '^(.*/)[^/]*$', 1), '/'), lambda x: x <> '') AS folder FROM u)
SELECT webpage_id, form, CASE form WHEN 0 THEN base || '/' || array_to_string(list_append(folder, 'next.htm'), '/') WHEN 1 THEN base || '/' || array_to_string(list_append(folder[:-2], 'up.htm'), '/') WHEN 2 THEN base || '/root/x.htm'
  WHEN 3 THEN scheme || '://other.example/p' WHEN 5 THEN 'http://abs.example/y?z#w' WHEN 6 THEN base || '/' || array_to_string(list_append(folder, 'b'), '/') WHEN 7 THEN base || path END AS resolved FROM f, (SELECT unnest(range(8)) AS form)""",
        "q_crawl_frontier": _frontier(30),
        "q_neighbors_topk": f"WITH {_ACT}, {_E}, {_neighbours()} SELECT * FROM near",
        "q_standing_pages": f"WITH {_STANDING} SELECT webpage_id, url, last_modified_date, size, round(pagerank, 6) AS pagerank, is_active, is_crawled FROM standing",
        "q_live_postings": f"WITH {_POST} SELECT field, count(*) AS n, count(DISTINCT webpage_id) AS pages, count(DISTINCT word_id) AS words, sum(frequency)::BIGINT AS total FROM post GROUP BY 1",
        "q_corpus_statistics": f"""WITH {_POST}, t AS (SELECT count(*) FILTER (field = 'title') AS title_postings, coalesce(sum(frequency) FILTER (field = 'title'), 0)::BIGINT AS title_total, count(*) FILTER (field = 'body') AS body_postings, coalesce(sum(frequency) FILTER (field = 'body'), 0)::BIGINT AS body_total FROM post),
p AS (SELECT count(*) AS pages, round(avg(pagerank), 4) AS avg_rank, round(min(pagerank), 4) AS min_rank, round(max(pagerank), 4) AS max_rank FROM act) SELECT * FROM p, t""",
        "q_df": f"WITH {_IDF} SELECT field, word_id, df FROM idf",
        "q_idf_title": f"WITH {_IDF} SELECT word_id, round(idf, 9) AS idf FROM idf WHERE field = 'title'",
        "q_idf_body": f"WITH {_IDF} SELECT word_id, round(idf, 9) AS idf FROM idf WHERE field = 'body'",
        "q_idf_combined": f"WITH {_IDF} SELECT word_id, round(idf, 9) AS idf FROM idfc",
        "q_doc_tfidf": f"WITH {_VEC} SELECT webpage_id, word_id, round(weight, 9) AS weight FROM vec",
        "q_doc_norm": f"WITH {_VEC} SELECT webpage_id, round(norm, 6) AS norm FROM norms",
        "q_top_tf_words": f"""WITH {_POST}, t AS (SELECT webpage_id, word_id, round(sum(CASE WHEN field = 'title' THEN 0.7 ELSE 0.3 END * coalesce(normalized_tf, 0)), 9) AS weight FROM post GROUP BY ALL)
SELECT webpage_id, word_id, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY webpage_id ORDER BY weight DESC, word_id) AS rank FROM t) WHERE rank <= 5""",
        "q_top_tfidf_words": f"WITH {_TOP} SELECT webpage_id, word_id, weight, rank FROM top",
        "q_bool_not_literal": f"WITH {_POST} SELECT webpage_id FROM act WHERE webpage_id NOT IN (SELECT webpage_id FROM post WHERE field = 'title' AND word_id NOT IN {_words(ALL)})",
        "q_bool_page_view_literal": f"WITH {_POST} SELECT DISTINCT webpage_id FROM (SELECT * FROM stand_t UNION ALL SELECT * FROM stand_b) WHERE word_id IN {_words(ANY)} AND webpage_id IN (SELECT webpage_id FROM act)",
        "q_bool_combined": f"""WITH {_ACT}, w AS (SELECT word, min(word_id) AS word_id FROM keyword WHERE word IN ('crawler', 'museum', 'search', 'curator') GROUP BY 1),
p AS (SELECT field, webpage_id, word FROM (SELECT 'title' AS field, * FROM {_posts('title_index')} UNION ALL SELECT 'body', * FROM {_posts('body_index')}) JOIN w USING (word_id) WHERE frequency > 0),
wanted AS (SELECT webpage_id FROM p GROUP BY 1 HAVING bool_or(word IN ('crawler', 'museum')) AND bool_or(field = 'body' AND word = 'search') AND NOT bool_or(field = 'title' AND word = 'crawler') AND NOT bool_or(word = 'curator'))
SELECT webpage_id FROM act SEMI JOIN wanted USING (webpage_id) WHERE last_modified_date >= TIMESTAMP '{SINCE}' AND last_modified_date < TIMESTAMP '{UNTIL}' + INTERVAL 1 DAY""",
        "q_date_range": f"WITH {_ACT} SELECT webpage_id, last_modified_date FROM act WHERE last_modified_date >= TIMESTAMP '{SINCE}' AND last_modified_date < TIMESTAMP '{UNTIL}' + INTERVAL 1 DAY",
        "q_query_vector": f"WITH {_IDF}, {_tf({**_TEXT_TF, 'gallery': -0.5})} SELECT word, word_id, round(weight, 9) AS weight FROM q JOIN keyword USING (word_id)",
        "q_cosine": f"{_text_search()} SELECT webpage_id, round(o, 6) AS original_score FROM scored",
        "q_search_ranked": f"""{_text_search()}, m AS (SELECT webpage_id, 0.7 * o + 0.3 * {_SCALED} AS m FROM scored JOIN act USING (webpage_id), ends)
SELECT row_number() OVER (ORDER BY round(m, 9) DESC, webpage_id) AS position, webpage_id, round(m, 6) AS modified_score FROM m ORDER BY round(m, 9) DESC, webpage_id LIMIT 50""",
        "q_search_hits": f"""{_text_search()}, m AS (SELECT webpage_id, url, 0.7 * o + 0.3 * {_SCALED} AS m FROM scored JOIN act USING (webpage_id), ends),
h AS (SELECT row_number() OVER (ORDER BY round(m, 9) DESC, webpage_id) AS position, webpage_id, url FROM m ORDER BY round(m, 9) DESC, webpage_id LIMIT 10), {_E}, {_neighbours()},
tw AS (SELECT webpage_id, word_id, sum(CASE WHEN field = 'title' THEN 0.7 ELSE 0.3 END * coalesce(normalized_tf, 0)) AS weight FROM post SEMI JOIN h USING (webpage_id) GROUP BY ALL),
tops AS (SELECT 'tf' AS kind, * FROM tw UNION ALL SELECT 'tfidf', webpage_id, word_id, weight FROM vec SEMI JOIN h USING (webpage_id)),
w AS (SELECT webpage_id, kind, string_agg(word, '|' ORDER BY r) AS s FROM (SELECT *, row_number() OVER (PARTITION BY webpage_id, kind ORDER BY round(weight, 9) DESC, word_id) AS r FROM tops) JOIN keyword USING (word_id) WHERE r <= 5 GROUP BY ALL),
nw AS (SELECT webpage_id, kind, string_agg(url, '|' ORDER BY rank) AS s FROM near GROUP BY ALL)
SELECT position, webpage_id, url, a.s AS top_tfs, b.s AS top_tfidfs, p.s AS parents, c.s AS children FROM h LEFT JOIN (SELECT * FROM w WHERE kind = 'tf') a USING (webpage_id) LEFT JOIN (SELECT * FROM w WHERE kind = 'tfidf') b USING (webpage_id) LEFT JOIN (SELECT * FROM nw WHERE kind = 'parent') p USING (webpage_id) LEFT JOIN (SELECT * FROM nw WHERE kind = 'child') c USING (webpage_id)""",
        "q_search_quoted": f"WITH {_VEC}, {_tf({'search': 1.0, 'crawler': 1.0})}, anyw AS (SELECT {_word('search')} AS word_id), "
        + _search("dummy AS (SELECT 1)", f" AND webpage_id IN (SELECT webpage_id FROM post WHERE word_id = {_word('crawler')})")
        + " SELECT webpage_id, round(o, 6) AS original_score FROM scored",
        "q_search_similar_pages": f"""WITH {_VEC}, pt AS (SELECT word_id FROM (SELECT word_id, row_number() OVER (ORDER BY round(weight, 9) DESC, word_id) AS r FROM (SELECT word_id, sum(CASE WHEN field = 'title' THEN 0.7 ELSE 0.3 END * coalesce(normalized_tf, 0)) AS weight FROM post WHERE webpage_id = (SELECT webpage_id FROM probe_page WHERE probe_id = 1) GROUP BY 1)) WHERE r <= 5),
tf AS (SELECT word_id, 1.0 AS tf FROM pt), q AS (SELECT word_id, tf * idf AS weight FROM tf JOIN idfc USING (word_id)), anyw AS (SELECT word_id FROM tf), """
        + _search("dummy AS (SELECT 1)")
        + " SELECT webpage_id, round(o, 6) AS original_score FROM scored",
        "q_search_modified_score": f"WITH {_TOP}, {_tf({'crawler': 1.0, 'museum': 1.0})}, anyw AS (SELECT word_id FROM tf), {_pairs('title')}, {_pairs('body')}, pmi AS (SELECT word1_id, word2_id, round(sum(p), 9) AS pmi FROM (SELECT word1_id, word2_id, pmi * 0.3 AS p FROM tl_title UNION ALL SELECT word1_id, word2_id, pmi * 0.7 FROM tl_body) GROUP BY ALL), {_expand('pmi')}, {_HISTORY}, mq AS (SELECT word_id, sum(weight) AS weight FROM (SELECT * FROM moved UNION ALL SELECT * FROM co) GROUP BY 1), "
        + _search("mqn AS (SELECT sqrt(sum(weight * weight)) AS mqn FROM mq), mdots AS (SELECT webpage_id, sum(vec.weight * mq.weight) AS mdot FROM vec JOIN mq USING (word_id) GROUP BY 1)")
        + f" SELECT webpage_id, round(o, 6) AS original_score, round(0.7 * coalesce(coalesce(mdot, 0) / nullif(norm * mqn, 0), 0) + 0.3 * {_SCALED}, 6) AS modified_score FROM scored LEFT JOIN mdots USING (webpage_id) JOIN norms USING (webpage_id) JOIN act USING (webpage_id), ends, mqn",
        "q_joined_merged": _joined("SELECT webpage_id, round(sum(o) / 2, 6) AS original_score, round(sum(m) / 2, 6) AS modified_score FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1) GROUP BY 1"),
        "q_joined_subquery": _joined("SELECT l0.webpage_id, round((l0.o + coalesce(l1.o, 0)) / 2, 6) AS original_score, round((l0.m + coalesce(l1.m, 0)) / 2, 6) AS modified_score FROM l0 LEFT JOIN l1 USING (webpage_id)"),
        "q_joined_subquery_strict": _joined("SELECT l0.webpage_id, round((l0.o + l1.o) / 2, 6) AS original_score, round((l0.m + l1.m) / 2, 6) AS modified_score FROM l0 JOIN l1 USING (webpage_id)"),
        "q_joined_vectors": _joined("SELECT word, word_id, round(sum(weight) / 2, 9) AS weight FROM (SELECT * FROM q0 UNION ALL SELECT * FROM q1) JOIN keyword USING (word_id) GROUP BY ALL"),
        "q_pmi_title": f"WITH {_POST}, {_pairs('title')} SELECT word1_id, word2_id, round(pmi, 6) AS pmi FROM pv_title",
        "q_pmi_body": f"WITH {_POST}, {_pairs('body')} SELECT word1_id, word2_id, round(pmi, 6) AS pmi FROM pv_body",
        "q_pmi_combined": f"WITH {_POST}, {_pairs('title')}, {_pairs('body')} SELECT word1_id, word2_id, round(round(sum(p), 9), 6) AS pmi FROM (SELECT word1_id, word2_id, pmi * 0.3 AS p FROM pp_title UNION ALL SELECT word1_id, word2_id, pmi * 0.7 FROM pp_body) GROUP BY ALL",
        "q_pmi_top_literal": f"WITH {_POST}, {_pairs('body')} SELECT word1_id, word2_id, round(pmi, 6) AS pmi FROM tl_body",
        "q_pmi_top_per_term": f"WITH {_POST}, {_pairs('body')} SELECT word1_id, word2_id, round(pmi, 6) AS pmi FROM tt_body",
        "q_pmi_expand": f"WITH {_IDF}, {_tf({'crawler': 1.0, 'museum': 1.0})}, {_pairs('body')}, {_expand('tt_body')} SELECT word_id, round(weight, 6) AS weight FROM co",
        "q_pmi_delete_affected": f"""WITH {_POST}, {_pairs('body')}, w AS (SELECT word_id FROM keyword WHERE word IN ({', '.join(repr(w) for w in ANY)})), hit AS (SELECT *, word1_id IN (SELECT word_id FROM w) OR word2_id IN (SELECT word_id FROM w) AS h FROM pv_body)
SELECT 'rest' AS kind, word1_id AS a, word2_id AS b FROM hit WHERE NOT h UNION ALL SELECT 'affected', a, 0 FROM (SELECT word1_id AS a FROM hit WHERE h UNION SELECT word2_id FROM hit WHERE h)""",
        "q_outdegree": f"WITH {_GRAPH} SELECT parent_id, c AS out_degree FROM deg",
        "q_pagerank_standard": _pagerank(20) + "SELECT webpage_id, round(r + 1e-9, 6) AS pagerank FROM r20",
        "q_pagerank_literal": _pagerank(20, literal=True) + "SELECT webpage_id, round(r + 1e-7, 3) AS pagerank FROM r20",
        "q_pagerank_subset": _pagerank(20, start="coalesce(pagerank / 1000, 1.0)", only=f"WHERE child_id IN (SELECT webpage_id FROM {_posts('title_index')} WHERE frequency > 0 AND word_id = {_word('search')})") + "SELECT webpage_id, round(r + 1e-9, 6) AS pagerank FROM r20",
        "q_pagerank_minmax": f"WITH {_ACT}, ends AS (SELECT min(pagerank) AS lo, max(pagerank) AS hi FROM act) SELECT webpage_id, round({_SCALED}, 9) AS scaled FROM act, ends",
        "q_fuzzy_terms": _fuzzy({"craw": 1.0, "use": 0.5}),
        "q_fuzzy_top": f"SELECT word_id, word, weight FROM (SELECT *, dense_rank() OVER (ORDER BY weight DESC) AS r FROM ({_fuzzy({'craw': 1.0, 'use': 0.5})})) WHERE r <= 5",
        "q_similar_queries": f"WITH {_TOP}, {_tf({'crawler': 1.0, 'museum': 1.0})}, {_HISTORY} SELECT query_id, similarity FROM sim",
        "q_relevance_feedback": f"WITH {_TOP}, {_tf({'crawler': 1.0, 'museum': 1.0})}, {_HISTORY} SELECT word_id, round(weight, 6) AS weight FROM moved",
        "q_relevant_words": f"WITH {_TOP}, {_tf({'crawler': 1.0, 'museum': 1.0})}, {_HISTORY} SELECT word_id, round(round(weight, 9), 6) AS weight FROM moved WHERE word_id NOT IN (SELECT word_id FROM q) AND round(weight, 9) >= 0 ORDER BY round(weight, 9) DESC, word_id LIMIT 5",
        "q_suggest": _suggest(),
        "q_interactions": "SELECT user_id AS query_id, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE -1 END::BIGINT AS relevance FROM events WHERE event_type IN ('click', 'purchase', 'error')",
        "q_history_page": "SELECT row_number() OVER (ORDER BY ts DESC, event_id DESC) AS row, event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5 OFFSET 10",
        "q_history_filter_type": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')",
        "q_history_search": "SELECT event_id FROM events WHERE contains(lower(props), '{\"k\": 7')",
        "q_history_antijoin": "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60 AND user_id IS NOT NULL)",
        "q_history_index_of": "SELECT min(n) AS first_purchase FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE event_type <> 'view') WHERE event_type = 'purchase'",
        "q_upsert": f"""{_SPLIT_PAGES} SELECT coalesce(o.webpage_id, n.webpage_id) AS webpage_id, coalesce(o.url, n.url) AS url, CASE WHEN n.webpage_id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.webpage_id IS NULL THEN o.size ELSE n.size END AS size, coalesce(o.is_active, n.is_active) AS is_active FROM old o FULL JOIN new n ON o.webpage_id = n.webpage_id""",
        "q_upsert_ignore": f"{_SPLIT_PAGES} SELECT * FROM old UNION ALL SELECT * FROM new WHERE webpage_id NOT IN (SELECT webpage_id FROM old)",
        "q_insert_returning": f"{_SPLIT_PAGES} SELECT url, webpage_id FROM new WHERE webpage_id NOT IN (SELECT webpage_id FROM old)",
        "q_assign_ids": f"""WITH w AS (SELECT DISTINCT unnest({_kept('text')}) AS word FROM documents)
SELECT word, word_id FROM w JOIN keyword USING (word) UNION ALL SELECT word, row_number() OVER (ORDER BY word) + (SELECT max(word_id) FROM keyword) FROM w WHERE word NOT IN (SELECT word FROM keyword)""",
        **{
            name: f"SELECT webpage_id, word_id, CASE WHEN word_id % 2 <> 0 THEN 0 ELSE frequency END AS frequency, round(normalized_tf, 9) AS normalized_tf FROM {_posts(table)}"
            for name, table in (("q_soft_delete_postings", "title_index"), ("q_soft_delete_body", "body_index"))
        },
        "q_deactivate_edges": """WITH old AS (SELECT parent_id, child_id, bool_or(is_active) AS is_active FROM relationship GROUP BY 1, 2), b AS (SELECT parent_id, child_id FROM old WHERE parent_id % 4 = 0 AND child_id % 2 = 0)
SELECT parent_id, child_id, CASE WHEN parent_id IN (SELECT parent_id FROM b) AND child_id % 2 <> 0 THEN false ELSE is_active END AS is_active FROM old""",
        "q_deactivate_pages": f"WITH {_STANDING} SELECT webpage_id, CASE WHEN webpage_id % 7 = 0 THEN false ELSE is_active END AS is_active FROM standing",
        "q_bulk_update": f"WITH {_ACT} SELECT webpage_id, round(CASE WHEN webpage_id % 2 = 1 THEN 0.5 ELSE pagerank END, 6) AS pagerank FROM act",
        "q_report": _report(),
        "q_report_limited": _report(keywords=3, relations=2, parents=False) + " WHERE act.webpage_id IN (SELECT webpage_id FROM act ORDER BY 1 LIMIT 20)",
        "q_text_index": f"WITH {_text_index()} SELECT webpage_id, field, term AS word, frequency, round(normalized_tf, 9) AS normalized_tf FROM tpost",
        "q_text_search": _stem_search({"search": 1.0, "museum": 1.0, "crawler": 1.0}, "'search', 'museum', 'crawler'") + f" SELECT webpage_id, round(o, 6) AS original_score, round(0.7 * o + 0.3 * {_SCALED}, 6) AS modified_score FROM thits JOIN held USING (webpage_id), ends",
        "q_text_search_vector": _stem_search({"search": 1.0, "museum": 1.0, "crawler": 1.0, "engrav": -1.0}, "''") + " SELECT term AS word, round(weight, 9) AS weight FROM tq",
        "q_text_search_quoted": _stem_search({"search": 1.0, "page": 1.0, "crawler": 1.0}, "'search', 'page'", " AND webpage_id IN (SELECT webpage_id FROM tpost WHERE term = 'crawler')") + " SELECT webpage_id, round(o, 6) AS original_score FROM thits",
        "q_combine_weight": f"SELECT webpage_id, word_id, round(0.7 * coalesce(t.normalized_tf, 0) + 0.3 * coalesce(b.normalized_tf, 0), 9) AS weight FROM (SELECT * FROM {_posts('title_index')} WHERE frequency > 0) t FULL JOIN (SELECT * FROM {_posts('body_index')} WHERE frequency > 0) b USING (webpage_id, word_id)",
    }
    for v in ("title", "body", "page"):
        for k in ("any", "all", "not"):
            o[f"q_bool_{v}_{k}"] = _bool(v, k)
    return o
