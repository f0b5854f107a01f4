"""DuckDB SQL shared by the checks of several queries."""

from __future__ import annotations

from quillstone.functions.tokens import SECTIONS, SLOT_UNITS, SLOTS, UNITS, WHITE
from quillstone.operators.draws import ADDED, FACTORS, MARGIN, MOST, PRIME, draw_sql
from quillstone.operators.rules import RULES

#: The tokens of an expression, and an expression without white space at its ends.
TOKENS = "list_filter(string_split_regex({0}, '" + WHITE.replace("{", "{{").replace("}", "}}") + "+'), lambda x: x <> '')"
TRIM = "regexp_replace({0}, '^" + WHITE.replace("{", "{{").replace("}", "}}") + "+|" + WHITE.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"

UNIT = f"(?s){'|'.join(UNITS)}|."
#: Entropy of the counts n of a group.
H = "greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n))"
HMAX = "(CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END)"

D = """WITH RECURSIVE raw_lines AS (SELECT doc_id, lang, source, (i - 1)::INTEGER AS n, doc_id * 1000000 + i - 1 AS line_ord, raw
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
"""
L = D + r""", marked AS (SELECT doc_id, line_ord, doc_id::VARCHAR AS folio, lang AS section, CASE WHEN doc_id % 7 = 0 AND raw <> '' THEN '{' || substr(raw, 1, 1) || '}' || substr(raw, 2) ELSE raw END AS raw_line
  FROM raw_lines),
lines AS (SELECT *, len(list_filter(tokens, lambda x: contains(x, '{') OR contains(x, '}'))) > 0 AS has_uncertainty
  FROM (SELECT *, """ + TOKENS.format("raw_line") + """ AS tokens FROM marked) WHERE len(tokens) > 0)
"""
T = L + """, raw AS (SELECT line_ord, folio, section, (pos - 1)::INTEGER AS pos, token, size, line_ord * 100000 + pos AS place
  FROM (SELECT line_ord, folio, section, len(tokens) AS size, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM lines)),
clean AS (SELECT * REPLACE (regexp_replace(token, '[{}]', '', 'g') AS token) FROM raw)
"""
V = T + """, raw_v AS (SELECT token, count(*) AS n, min(place) AS first FROM raw GROUP BY 1),
clean_v AS (SELECT token, count(*) AS n, min(place) AS first FROM clean GROUP BY 1)
"""
_SECTION = "CASE " + " ".join(f"WHEN k BETWEEN {a} AND {b} THEN '{s}'" for s, a, b in SECTIONS) + " ELSE 'unknown' END"
_FOLIO = f""", folio_lines AS (SELECT line_ord, tokens, 'f' || k || CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE 'v' END AS folio, {_SECTION} AS section
  FROM (SELECT *, doc_id % 120 + 1 AS k FROM lines)),
folio_tokens AS (SELECT r.* REPLACE (f.section AS section, f.folio AS folio) FROM raw r JOIN folio_lines f USING (line_ord))
"""
S = V + _FOLIO
#: Raw lines of which some are tagged, some begin with white space of other kinds than blanks, and some are comments behind a tab.
_TAGGED_RAW = """CASE WHEN n % 11 = 10 THEN chr(9) || '# ' || raw ELSE CASE WHEN n % 5 = 4 THEN chr(9) || chr(160) ELSE '' END
  || CASE WHEN n % 3 <> 0 THEN '<f' || doc_id || '.' || lang || '.' || n || ';' || source || '> ' ELSE '' END || raw END"""
TAGGED = D + f""", t AS (SELECT doc_id::VARCHAR AS file, n, {TRIM.format(_TAGGED_RAW)} AS raw, n % 3 <> 0 AND n % 11 <> 10 AS own, doc_id, lang, source FROM raw_lines),
k AS (SELECT *, CASE WHEN own THEN {{'folio': 'f' || doc_id, 'section': lang, 'line': n::VARCHAR, 'transcriber': source}} END AS tag
  FROM t WHERE raw <> '' AND NOT starts_with(raw, '#')),
f AS (SELECT *, last_value(tag IGNORE NULLS) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING) AS g FROM k),
x AS (SELECT *, {TOKENS.format("translate(CASE WHEN own THEN regexp_replace(raw, '^<[^>]*>', '') ELSE raw END, '.-', '  ')")} AS tokens FROM f)
SELECT file, n, coalesce(g.folio, 'unknown') AS folio, coalesce(g.section, 'unknown') AS section, coalesce(g.line, '0') AS line, coalesce(g.transcriber, 'unknown') AS transcriber,
  len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM x WHERE len(tokens) > 0"""
PLAIN = D + f"""SELECT doc_id::VARCHAR AS file, n, n::VARCHAR AS line, len(t) AS n_tokens FROM (SELECT *, {TOKENS.format("raw")} AS t
  FROM (SELECT doc_id, n, {TRIM.format("raw")} AS raw FROM raw_lines)
  WHERE raw <> '' AND NOT starts_with(raw, '#')) WHERE len(t) > 0"""
CONVERTED = D + f""", k AS (SELECT *, row_number() OVER (ORDER BY line_ord) AS i FROM raw_lines WHERE {TRIM.format("raw")} <> '' QUALIFY i <= 5001)
SELECT line_ord, 'auto_folio_' || i AS folio, i::VARCHAR AS line, substr({TRIM.format("raw")}, 1, 2000) AS raw_line, array_to_string(list_slice({TOKENS.format("raw")}, 1, 200), ' ') AS tokens
  FROM k"""
TURNS = f"""SELECT conv_id::VARCHAR AS folio, count(*) AS n_lines, sum(len(t))::BIGINT AS n_tokens FROM (SELECT conv_id, {TOKENS.format("text")} AS t
  FROM conversations) WHERE len(t) > 0 GROUP BY 1"""
CONDITIONAL = V + f""", p AS (SELECT token || '|' || lead(token) OVER (ORDER BY place) AS p FROM clean), q AS (SELECT p, count(*) AS n
  FROM p WHERE p IS NOT NULL GROUP BY 1)
SELECT round(greatest(0, (SELECT {H} FROM q) - (SELECT {H} FROM clean_v)), 6) AS conditional_entropy"""
CHARACTERS = T + f""", c AS (SELECT place, i, c FROM (SELECT place, unnest(regexp_extract_all(token, '(?s).')) AS c, generate_subscripts(regexp_extract_all(token, '(?s).'), 1) AS i
  FROM clean)),
p AS (SELECT c || '|' || lead(c) OVER (ORDER BY place, i) AS p FROM c), q AS (SELECT p, count(*) AS n FROM p WHERE p IS NOT NULL
  GROUP BY 1), u AS (SELECT c, count(*) AS n FROM c GROUP BY 1)
SELECT round({H}, 6) AS entropy, sum(n)::BIGINT AS n_characters, count(*) AS n_unique, round(greatest(0, (SELECT {H} FROM q) - {H}), 6) AS conditional_entropy FROM u"""
ZIPF = V + """, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM clean_v)
SELECT count(*) AS n_types, CASE WHEN count(*) >= 5 THEN round(-regr_slope(ln(n), ln(rank)), 6) END AS alpha, CASE WHEN count(*) >= 5 THEN CASE WHEN min(n) = max(n) THEN 0.0 ELSE round(regr_r2(ln(n),
  ln(rank)), 6) END END AS r_squared FROM r"""
RANKED = V + """, f AS (SELECT n, count(*) AS types FROM clean_v GROUP BY 1), g AS (SELECT n, types, coalesce(sum(types) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM f),
r AS (SELECT n, unnest(range(start + 1, start + types + 1)) AS rank FROM g), a AS (SELECT -regr_slope(ln(n), ln(rank)) AS a, max(n) AS top FROM r)
SELECT rank, n, round(top * pow(rank, -a.a), 4) AS fitted FROM r, a WHERE rank <= 50"""
_EVENT_LINES = """WITH lines AS (SELECT user_id AS line_ord, list(event_type ORDER BY ts, event_id) AS tokens FROM events GROUP BY 1),
raw_v AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM lines) GROUP BY 1),
g AS (SELECT line_ord, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i:i + 1])) AS gram, unnest(range(1, len(tokens))) AS pos
  FROM lines WHERE len(tokens) >= 2),
grams AS (SELECT gram, count(*) AS n, min(line_ord * 100000 + pos) AS first FROM g GROUP BY 1)
"""
EVENTS = """WITH e AS (SELECT event_type AS context, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS token
  FROM events) SELECT context, token, count(*) AS n FROM e WHERE token IS NOT NULL GROUP BY ALL"""


def edge(condition: str, k: int = 30) -> str:
    return f"""SELECT token, at_edge, total, round(at_edge / total, 4) AS rate FROM (SELECT token, count(*) FILTER (WHERE {condition}) AS at_edge,
  count(*) AS total, min(place) FILTER (WHERE {condition}) AS first FROM raw GROUP BY 1)
WHERE at_edge > 0 ORDER BY at_edge DESC, first LIMIT {k}"""


def grams(n: int) -> str:
    return V + f""", g AS (SELECT line_ord, unnest(list_transform(range(1, len(tokens) - {n - 2}), lambda i: tokens[i:i + {n - 1}])) AS gram,
  unnest(range(1, len(tokens) - {n - 2})) AS pos FROM lines WHERE len(tokens) >= {n}),
grams AS (SELECT gram, count(*) AS n, min(line_ord * 100000 + pos) AS first FROM g GROUP BY 1)
"""


def pmi(order: str, tie: str, sign: str, lines: str = "") -> str:
    return (lines or grams(2)) + f""", k AS (SELECT * FROM grams WHERE n >= 5), m AS (SELECT gram[1] AS w1, gram[2] AS w2, k.n, log2((k.n / (SELECT sum(n)
  FROM k)) / ((a.n / (SELECT sum(n) FROM raw_v)) * (b.n / (SELECT sum(n) FROM raw_v)))) AS pmi, k.first
  FROM k JOIN raw_v a ON a.token = gram[1] JOIN raw_v b ON b.token = gram[2])
SELECT w1, w2, n, round(pmi, 6) AS pmi FROM (SELECT * FROM m ORDER BY round(pmi, 9) {order}, {tie} LIMIT 30) WHERE round(pmi, 9) {sign}"""


PMI_LOW = pmi("", "first DESC", "< 0", _EVENT_LINES)


def markov(select: str, orders: int = 4) -> str:
    return markov_ctes(orders) + select


def markov_ctes(orders: int) -> str:
    per = " UNION ALL ".join(
        f"""SELECT {k}::INTEGER AS "order", held, array_to_string(tokens[i:i + {k - 1}], chr(1)) AS context, tokens[i + {k}] AS token
  FROM (SELECT tokens, held, unnest(range(1, len(tokens) - {k - 1})) AS i FROM split WHERE len(tokens) > {k})"""
        if k else """SELECT 0::INTEGER AS "order", held, '' AS context, unnest(tokens) AS token FROM split"""
        for k in range(orders + 1)
    )
    return V + f""", split AS (SELECT tokens, row_number() OVER (ORDER BY md5('42:' || line_ord)) <= greatest(1, (count(*) OVER () * 0.2)::DECIMAL(20, 1)::DOUBLE // 1) AS held
  FROM lines),
tr AS (SELECT "order", held, context, token, count(*) AS n FROM ({per}) GROUP BY ALL),
seen AS (SELECT * FROM tr WHERE NOT held), ctx AS (SELECT "order", context, sum(n) AS total FROM seen GROUP BY ALL),
voc AS (SELECT DISTINCT token, 1 AS known FROM seen WHERE "order" = 0), size AS (SELECT greatest(count(*), 1) AS v FROM voc),
contexts AS (SELECT "order", count(DISTINCT context) AS n_contexts FROM seen GROUP BY 1),
priced AS (SELECT a."order", a.held, a.n, log2((coalesce(s.n, 0) + 1.0) / (coalesce(c.total, 0) + 1.0 * v)) AS p, known
  FROM tr a LEFT JOIN seen s ON s."order" = a."order" AND s.context = a.context AND s.token = a.token LEFT JOIN ctx c ON c."order" = a."order" AND c.context = a.context
  LEFT JOIN voc ON voc.token = a.token, size),
result AS (SELECT "order", round(pow(2, -sum(n * p) / sum(n)), 4) AS perplexity, sum(n)::BIGINT AS n_tokens, sum(CASE WHEN known IS NULL THEN n ELSE 0 END)::BIGINT AS n_unknown
  FROM priced WHERE held GROUP BY 1),
trained AS (SELECT "order", round(pow(2, -sum(n * p) / sum(n)), 4) AS train_perplexity, sum(n)::BIGINT AS n_train_tokens, (SELECT v
  FROM size) AS vocab_size FROM priced WHERE NOT held GROUP BY 1)
"""


_SLOT = [f"^(?:(?:{'|'.join(p)})' || chr(1) || '){{1,{m}}}" for _, p, _, m in SLOTS]


def slot_ctes(source: str) -> str:
    return f""", s0 AS (SELECT token, n, first, regexp_matches(token, '[{{}}!?]') AS marks, regexp_replace(regexp_replace(token, '[{{}}!?]', '', 'g'), '((?s){'|'.join(SLOT_UNITS)}|.)', '\\1' || chr(1), 'g') AS a
  FROM {source}),
s1 AS (SELECT *, regexp_replace(a, '{_SLOT[0]}', '') AS b FROM s0), s2 AS (SELECT *, regexp_replace(b, '{_SLOT[1]}', '') AS c
  FROM s1), s3 AS (SELECT *, regexp_replace(c, '{_SLOT[2]}', '') AS d FROM s2), s4 AS (SELECT *, regexp_replace(d, '{_SLOT[3]}', '') AS e, d <> c AS core FROM s3),
checked AS (SELECT *, core AND e = '' AS is_valid, CASE WHEN a = '' THEN 'empty_token' WHEN NOT core THEN 'missing_required_slot' WHEN e <> '' THEN 'unconsumed_units' END AS category,
  CASE WHEN core AND e = '' THEN CASE WHEN marks THEN 'medium' ELSE 'high' END WHEN marks OR a = '' THEN 'low' ELSE 'medium' END AS confidence,
  list_filter([CASE WHEN b <> a THEN 'prefix' END, CASE WHEN c <> b THEN 'gallows' END, CASE WHEN core THEN 'core' END, CASE WHEN core AND e <> d THEN 'suffix' END],
  lambda x: x IS NOT NULL) AS matched FROM s4)
"""


SLOTS = S + slot_ctes("raw_v")
CLEAN_SLOTS = S + slot_ctes("clean_v")
_KNOWN = ", ".join(f"'{s}'" for s, _, _ in SECTIONS)


def chi(least_tokens: int, least_expected: float, least_shared: int, name: str = "x") -> str:
    """CTEs of each known section's statistic, named ``name``."""
    return f""", o{name} AS (SELECT section, regexp_replace(token, '[{{}}]', '', 'g') AS token, count(*) AS n FROM folio_tokens
  GROUP BY ALL), w{name} AS (SELECT token, sum(n) AS c FROM o{name} GROUP BY 1),
z{name} AS (SELECT section, sum(n) AS nt, count(*) AS k FROM o{name} WHERE section IN ({_KNOWN}) GROUP BY 1), e{name} AS (SELECT section, nt,
  k, n, nt * c / (SELECT sum(n) FROM o{name}) AS e FROM o{name} JOIN w{name} USING (token) JOIN z{name} USING (section)),
y{name} AS (SELECT section, nt, k, sum(CASE WHEN e > {least_expected} THEN (n - e) ** 2 / e ELSE 0 END) AS x FROM e{name} GROUP BY ALL),
{name} AS (SELECT section, nt::BIGINT AS n_tokens, k AS n_types, CASE WHEN nt >= {least_tokens} AND k >= {least_shared} THEN round(x, 4) END AS chi_square, CASE WHEN nt >= {least_tokens} AND k >= {least_shared} THEN k - 1 END AS df,
  CASE WHEN nt < {least_tokens} THEN 'INSUFFICIENT_DATA' WHEN k < {least_shared} THEN 'INSUFFICIENT_OVERLAP' ELSE 'TESTED' END AS status FROM y{name}),
p{name} AS (SELECT *, CASE WHEN df > 0 THEN 1 - list_sum(list_transform(range(0, (chi_square / 2 + 60 * sqrt(chi_square / 2 + df) + 200)::BIGINT),
    lambda i: exp((df / 2 + i) * ln(chi_square / 2) - chi_square / 2 - lgamma(df / 2 + i + 1)))) END AS p FROM {name})
"""


CHI = S + chi(30, 0.5, 5) + "SELECT section, n_tokens, n_types, chi_square, df, status FROM x"
CHI_P = S + chi(30, 0.5, 5) + "SELECT section, n_tokens, n_types, chi_square, df, status, p < 0.05 / (SELECT count(*) FROM x) AS significant, round(greatest(p, 0), 6) AS p_value FROM px"
#: (n_significant) of the rule engine's own test.
_RULE_CHI = "SELECT count(*) FROM pown WHERE coalesce(round(greatest(p, 0), 6), 1) < 0.05 / greatest((SELECT count(*) FROM own), 1)"

#: Random tokens: (id, len), the alphabet with its cumulative counts, and the tokens.
_MADE = f""", cs AS (SELECT sum(n)::BIGINT AS n, sum(n * length(token)) / sum(n) AS mean FROM clean_v), ch AS (SELECT c, sum(n)::BIGINT AS n
  FROM (SELECT n, unnest(regexp_extract_all(token, '(?s).')) AS c FROM clean_v) GROUP BY 1),
al AS (SELECT c, coalesce(sum(n) OVER (ORDER BY n DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM ch),
ids AS (SELECT id, greatest(1, trunc(mean + 1.5 * (sqrt(-2 * ln(greatest({draw_sql(42, "id", "1")}, 1e-300))) * cos(2 * pi() * {draw_sql(42, "id", "2")})))::BIGINT) AS size
  FROM (SELECT unnest(range(n)) AS id, mean FROM cs)),
spots AS (SELECT id, i, floor({draw_sql(42, "id", "i + 10")} * (SELECT sum(n) FROM ch))::BIGINT AS x FROM (SELECT id, unnest(range(1, size + 1)) AS i FROM ids)),
made AS (SELECT token, count(*) AS n FROM (SELECT id, string_agg(c, '' ORDER BY i) AS token FROM spots ASOF JOIN al ON spots.x >= al.low GROUP BY id) GROUP BY 1)
"""
BASELINE = V + _MADE + f"""SELECT b AS baseline_entropy, h AS entropy, round(b - h, 4) AS delta_bits FROM (SELECT round((SELECT {H}
  FROM made), 6) AS b, round((SELECT {H} FROM clean_v), 6) AS h)"""

_U = draw_sql("(142 + i)", "rep", "k", "size")
PERMUTED = T + f""", first AS (SELECT token, count(*) FILTER (WHERE pos = 0) AS at_edge, count(*) AS total, min(place) FILTER (WHERE pos = 0) AS first
  FROM raw GROUP BY 1),
top AS (SELECT * FROM first WHERE at_edge > 0 ORDER BY at_edge DESC, first LIMIT 5), best AS (SELECT token, row_number() OVER (ORDER BY at_edge DESC,
  first) - 1 AS i FROM top WHERE total >= 10),
own AS (SELECT token, i, line_ord, count(*) AS k, any_value(size) AS size, max((pos = 0)::INT) AS first FROM clean JOIN best USING (token) GROUP BY ALL),
g AS (SELECT token, i, k, size, count(*) AS m, sum(first) AS f FROM own GROUP BY ALL),
seen AS (SELECT token, i, sum(k * m)::BIGINT AS total, sum(f)::BIGINT AS observed FROM g GROUP BY ALL),
cdf AS (SELECT token, k, size, sum(exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * ln(k / size) + (m - j) * ln(1 - k / size))) OVER (PARTITION BY token,
  k, size ORDER BY j) AS c
  FROM (SELECT *, unnest(range(0, m + 1)) AS j FROM g WHERE k < size)),
u AS (SELECT token, k, size, m, rep, {_U} AS u FROM g, (SELECT unnest(range(1000)) AS rep)),
b AS (SELECT u.token, u.k, u.size, rep, CASE WHEN u.k = u.size THEN any_value(m) ELSE count(c) END AS x FROM u
  LEFT JOIN cdf ON cdf.token = u.token AND cdf.k = u.k AND cdf.size = u.size AND c < u GROUP BY u.token, u.k, u.size, rep),
r AS (SELECT token, rep, sum(x) AS x FROM b GROUP BY ALL)
SELECT token, round(observed / total, 4) AS observed_rate, total, observed, round(avg(x / total), 4) AS null_mean, round(stddev_pop(x / total), 4) AS null_std,
  round(avg((x >= observed)::INT), 4) AS p_value, avg((x >= observed)::INT) < 0.05 AS significant
FROM r JOIN seen USING (token) GROUP BY token, total, observed"""


# -- bootstrap: the draws of ``draws.Draws`` in arithmetic modulo 2**64 --------------

_WORD = 1 << 64


def _scrambled(x: str) -> str:
    mixed = f"list_reduce([({x})::UBIGINT, {int(FACTORS[0])}::UBIGINT, {int(FACTORS[1])}::UBIGINT], lambda x, c: (xor(x, x >> 33)::UHUGEINT * c::UHUGEINT % {_WORD}::UHUGEINT)::UBIGINT)"
    return f"list_transform([{mixed}], lambda x: xor(x, x >> 33))[1]"


def resampled(seed: int, resamples: int = 500) -> str:
    """CTEs up to f (rep, c, types): how many types each resample has c times. Types that occur in the same lines are counted together."""
    times = lambda x, c: f"(({x})::UHUGEINT * {int(c)}::UHUGEINT % {_WORD}::UHUGEINT)::UBIGINT"
    stream = lambda s: _scrambled(f"({s})::UBIGINT + {seed << 32}::UBIGINT")
    weight = " + ".join(f"(x > c{k})::INTEGER" for k in range(MOST + 1))
    cuts = ", ".join(f"max(c) FILTER (k = {k}) AS c{k}" for k in range(MOST + 1))
    return V + f""", ln AS MATERIALIZED (SELECT line_ord, row_number() OVER (ORDER BY line_ord) - 1 AS place FROM (SELECT DISTINCT line_ord FROM clean)),
nn AS MATERIALIZED (SELECT count(*) AS n, greatest(0, 1 - {MARGIN} / sqrt(count(*))) AS mean FROM ln),
cs AS (SELECT {cuts} FROM (SELECT k, sum(exp(-mean) * mean ** k / gamma(k + 1)) OVER (ORDER BY k) * {float(_WORD)} AS c FROM nn, (SELECT unnest(range({MOST + 1})) AS k))),
lw AS (SELECT line_ord, {_scrambled("line_ord")} AS h FROM ln),
rw AS (SELECT stream, {stream("stream")} AS h FROM (SELECT unnest(range({resamples + 64})) AS stream)),
yw AS (SELECT line_ord, stream, {times("xor(lw.h, rw.h)", FACTORS[0])} AS y FROM lw, rw), xw AS (SELECT line_ord, stream, {times("xor(y, y >> 32)", FACTORS[1])}::DOUBLE AS x FROM yw),
w0 AS MATERIALIZED (SELECT line_ord, stream, {weight} AS w FROM xw, cs WHERE x > c0),
ok AS MATERIALIZED (SELECT stream, row_number() OVER (ORDER BY stream) - 1 AS rep, n - s AS lacks FROM (SELECT stream, coalesce(sum(w), 0)::BIGINT AS s FROM rw LEFT JOIN w0 USING (stream) GROUP BY stream), nn WHERE s <= n QUALIFY rep < {resamples}),
ad AS (SELECT rep, {stream(f"stream + {ADDED}")} AS h, {_scrambled("j")} AS g FROM (SELECT rep, stream, unnest(range(lacks)) AS j FROM ok)),
ay AS (SELECT rep, {times("xor(g, h)", FACTORS[0])} AS y FROM ad), ax AS (SELECT rep, {times("xor(y, y >> 32)", FACTORS[1])} AS x FROM ay),
w AS MATERIALIZED (SELECT line_ord, rep::SMALLINT AS rep, sum(w)::INTEGER AS w FROM (SELECT line_ord, rep, w FROM w0 JOIN ok USING (stream)
  UNION ALL SELECT line_ord, rep, 1 FROM (SELECT rep, least(floor((x >> 11)::DOUBLE * {2.0**-53!r}::DOUBLE * n)::BIGINT, n - 1) AS place FROM ax, nn) JOIN ln USING (place)) GROUP BY 1, 2),
tl AS (SELECT token, line_ord, count(*) AS k FROM clean GROUP BY ALL),
sg AS (SELECT row_number() OVER () AS sig, count(*) AS m, ls, ks FROM (SELECT list(line_ord ORDER BY line_ord) AS ls, list(k ORDER BY line_ord) AS ks FROM tl GROUP BY token) GROUP BY ls, ks),
sl AS (SELECT sig::INTEGER AS sig, unnest(ls) AS line_ord, unnest(ks)::INTEGER AS k FROM sg),
c AS (SELECT sig, rep, sum(k * w)::BIGINT AS c FROM sl JOIN w USING (line_ord) GROUP BY 1, 2),
f AS (SELECT rep, c, sum(m)::BIGINT AS types FROM c JOIN sg USING (sig) GROUP BY 1, 2)
"""


_INTERVAL = "round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS resamples"
BOOTSTRAP_ENTROPY = resampled(42) + f""", e AS (SELECT greatest(0, log2(sum(c * types)) - sum(types * c * log2(c)) / sum(c * types)) AS v FROM f GROUP BY rep)
SELECT (SELECT round({H}, 6) FROM clean_v) AS point, {_INTERVAL} FROM e"""
#: Types of one frequency have neighbouring ranks, so their logarithms are differences of sums up to a rank.
BOOTSTRAP_ZIPF = resampled(43) + f""", lr AS (SELECT k, sum(ln(k)) OVER (ORDER BY k) AS s, sum(ln(k) ** 2) OVER (ORDER BY k) AS ss FROM (SELECT unnest(range(1, (SELECT count(*) FROM clean_v) + 1)) AS k)),
up AS (SELECT * FROM lr UNION ALL SELECT 0, 0, 0),
pl AS (SELECT *, coalesce(sum(types) OVER (PARTITION BY rep ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM f),
sx AS (SELECT rep, types, ln(c) AS y, b.s - a.s AS x, b.ss - a.ss AS xx FROM pl JOIN up a ON a.k = start JOIN up b ON b.k = start + types),
e AS (SELECT CASE WHEN sum(types) >= 5 THEN -(sum(types) * sum(x * y) - sum(x) * sum(types * y)) / (sum(types) * sum(xx) - sum(x) ** 2) END AS v FROM sx GROUP BY rep),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM clean_v)
SELECT (SELECT round(-regr_slope(ln(n), ln(rank)), 6) FROM r) AS point, {_INTERVAL} FROM e"""


EDGES = grams(2) + """, u AS (SELECT DISTINCT least(gram[1], gram[2]) AS a, greatest(gram[1], gram[2]) AS b FROM grams WHERE gram[1] <> gram[2])
"""


COMPONENTS = EDGES + """, e AS MATERIALIZED (SELECT a, b FROM u UNION SELECT b, a FROM u), c(node, r) USING KEY (node) AS (SELECT DISTINCT a, a FROM e
  UNION SELECT e.b, min(c.r) FROM c JOIN e ON e.a = c.node JOIN recurring.c AS k ON k.node = e.b WHERE c.r < k.r GROUP BY e.b)
SELECT node, r AS component FROM c"""


def rule_verdicts() -> str:
    return rules_ctes() + "SELECT * FROM verdicts"


def overall_verdict() -> str:
    fail = lambda s: f"count(*) FILTER (WHERE verdict = 'FAIL' AND severity = '{s}')"
    return rules_ctes() + f"""SELECT *, CASE WHEN critical > 0 THEN 'NOT_SUPPORTED' WHEN major >= 2 THEN 'CONDITIONAL' WHEN inconclusive > 0 THEN 'INCONCLUSIVE' ELSE 'SUPPORTED' END AS verdict
FROM (SELECT {fail("CRITICAL")} AS critical, {fail("MAJOR")} AS major, {fail("MINOR")} AS minor, count(*) FILTER (WHERE verdict = 'INCONCLUSIVE') AS inconclusive
  FROM verdicts)"""


def rules_ctes() -> str:
    """Measurements as one row, then a row for each rule."""
    measured = {
        "coverage": "SELECT round(sum(n * is_valid::INT) / sum(n), 6) FROM checked",
        "worst_failure": "SELECT max(s) FROM (SELECT round(sum(n) / (SELECT sum(n) FROM checked WHERE NOT is_valid), 6) AS s FROM checked WHERE NOT is_valid GROUP BY category)",
        "core_usage": "SELECT sum(n) FROM checked WHERE is_valid AND list_contains(matched, 'core')",
        "most_usage": "SELECT max(s) FROM (SELECT sum(n) AS s FROM (SELECT n, unnest(matched) AS slot FROM checked WHERE is_valid) GROUP BY slot)",
        "entropy": f"SELECT round({H}, 6) FROM clean_v",
        "conditional_entropy": f"SELECT round(greatest(0, (SELECT {H} FROM pq) - (SELECT {H} FROM clean_v)), 6)",
        "alpha": "SELECT round(-regr_slope(ln(n), ln(rank)), 6) FROM zr",
        "r_squared": "SELECT round(regr_r2(ln(n), ln(rank)), 6) FROM zr",
        "n_biased": f"SELECT count(*) FROM ({edge('pos = 0')}) WHERE rate >= 0.5 AND total >= 10",
        "jaccard": f"SELECT round(count(*) FILTER (WHERE k = 2) / greatest(count(*), 1), 6) FROM (SELECT token, count(*) AS k FROM (SELECT token FROM ({edge('pos = 0', 20)}) UNION ALL SELECT token FROM ({edge('pos = size - 1', 20)})) GROUP BY 1)",
        "baseline_entropy": f"SELECT round({H}, 6) FROM made",
        "n_significant": _RULE_CHI,
        "perplexity_0": 'SELECT perplexity FROM result WHERE "order" = 0',
        "perplexity_1": 'SELECT perplexity FROM result WHERE "order" = 1',
    }
    columns = ", ".join(f"({q})::DOUBLE AS {name}" for name, q in measured.items())
    rows = " UNION ALL ".join(
        f"SELECT '{i}' AS rule, '{s}' AS severity, {m}::DOUBLE AS measured_value, CASE WHEN {c} THEN 'PASS' WHEN NOT ({c}) THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM m" for i, s, m, c in RULES
    )
    return (
        markov_ctes(1) + _FOLIO + slot_ctes("clean_v") + _MADE + chi(50, 0.0, 0, "own")
        + f""", pp AS (SELECT token || '|' || lead(token) OVER (ORDER BY place) AS p FROM clean), pq AS (SELECT p, count(*) AS n
  FROM pp WHERE p IS NOT NULL GROUP BY 1), zr AS (SELECT n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM clean_v),
m0 AS (SELECT {columns}), m AS (SELECT *, round((perplexity_0 - perplexity_1) / perplexity_0, 6) AS perplexity_saved FROM m0), verdicts AS ({rows})
"""
    )


# -- matching blocks: of every pair the longest block, then what is left and right of it ----------

_BLOCK = """list_max(list_transform(range(1, length(a) + 1), lambda i: {'k': len(list_filter(range(1, length(a) - i + 2), lambda k: contains(b, substring(a, i, k)))), 'i': -i}))"""


def _blocks(name: str, first: str, second: str, pairs: str) -> str:
    """Recursive CTE: the blocks of every pair; ``name``_r has the ratio."""
    cut = "SELECT query, word, a, b, m.k AS k, -m.i AS i, strpos(b, substring(a, -m.i, m.k)) AS j FROM (SELECT *, " + _BLOCK + " AS m FROM OPEN_PAIRS WHERE a <> '' AND b <> '') WHERE m.k > 0"
    return f"""{name}(query, word, a, b, k) AS (SELECT query, word, {first}, {second}, 0 FROM {pairs}
  UNION ALL SELECT query, word, CASE side WHEN 0 THEN substring(a, 1, i - 1) ELSE substring(a, i + k) END, CASE side WHEN 0 THEN substring(b, 1, j - 1) ELSE substring(b, j + k) END,
    CASE side WHEN 0 THEN k ELSE 0 END FROM ({cut.replace("OPEN_PAIRS", name)}), (SELECT unnest([0, 1]) AS side)),
{name}_r AS (SELECT query, word, 2.0 * sum(k) / (length(query) + length(word)) AS ratio FROM {name} GROUP BY query, word)"""


FUZZY = V + f""", asked AS (SELECT DISTINCT lower(trim(r_name)) AS query FROM region),
pairs AS (SELECT query, token AS word FROM raw_v, asked), {_blocks("s", "word", "query", "pairs")},
best AS (SELECT query, word, row_number() OVER (PARTITION BY query ORDER BY ratio DESC, word DESC) AS rank FROM s_r WHERE ratio >= 0.3 QUALIFY rank <= 5),
{_blocks("t", "query", "word", "best")}
SELECT query, rank::INTEGER AS rank, word, round(ratio::DOUBLE, 3) AS similarity FROM best JOIN t_r USING (query, word)"""
