"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from veritext.llm import lines, mixing, quality, urls

WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# -- op1 --------------------------------------------------------------------------------------


def deduped(docs: str) -> str:
    """CTEs that end in ``dedup_out``: the columns of ``docs``, text without the dropped lines, and
    dropped_lines."""
    leaf = "[len(tk)::VARCHAR, tk[1], coalesce(tk[2], ''), coalesce(tk[3], '')]"
    near = ("100 * len(list_filter(list_zip(a.tk, b.tk), lambda z: z[1] = z[2])) "
            f">= {lines.SIMILAR} * len(a.tk)")
    return rf"""
 dd AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS doc, * FROM {docs}),
 ln AS (SELECT rid, doc, text, unnest(string_split(text, chr(10))) AS line,
   generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM dd WHERE text IS NOT NULL),
 mk AS (SELECT rid, doc, text, pos, m, string_split(m, ' ') AS tk FROM (SELECT *,
   regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '),
     '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS m FROM ln) WHERE m <> ''),
 g0 AS (SELECT m, tk, {leaf} AS leaf, min(doc) AS lo FROM mk GROUP BY m, tk),
 fr AS (SELECT a.m, min(b.lo) AS first FROM g0 a JOIN g0 b ON a.leaf = b.leaf AND b.lo <= a.lo AND {near} GROUP BY 1),
 gone AS (SELECT rid, list(pos) AS ps FROM mk JOIN fr USING (m) WHERE first < doc GROUP BY 1),
 dedup_out AS (SELECT dd.* EXCLUDE (rid, doc) REPLACE (CASE WHEN ps IS NULL THEN text ELSE array_to_string(
    list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(ps, i)), chr(10)) END AS text),
   coalesce(len(ps), 0)::BIGINT AS dropped_lines FROM dd LEFT JOIN gone USING (rid))"""


OP1 = f"""WITH {deduped('documents')}
SELECT doc_id, dropped_lines, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM dedup_out"""

# -- op2 --------------------------------------------------------------------------------------


def _share(i: int) -> str:
    return f"(CASE measure {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {f[i]}' for m, f in quality.FENCES.items())} END)"


def quality_measured(docs: str, text: str = "text") -> str:
    """doc_id, lang, source and the measures of ``docs``."""
    return rf"""
 base AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce({text}, '') AS t,
    {WORDS.format(text)} AS w,
    list_filter(string_split(coalesce({text}, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM {docs}),
 win AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM base WHERE len(w) >= 5)),
 twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
 covered AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM
   (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
 measured AS (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
   length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
   (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
   coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered USING (rid)),
 ruled AS (SELECT *, (n_words < {quality.MIN_WORDS} OR
     100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
   CASE WHEN n_words > 0 THEN (1000 * word_chars) // n_words ELSE 0 END AS word_len,
   CASE WHEN word_chars > 0 THEN (1000 * n_symbols) // word_chars ELSE 0 END AS symbols,
   CASE WHEN n_lines > 0 THEN (1000 * n_dup_lines) // n_lines ELSE 0 END AS dup_lines
  FROM measured),
 long AS (UNPIVOT (SELECT rid, lang, source, word_len, symbols, dup_lines FROM ruled WHERE NOT base_failed)
   ON word_len, symbols, dup_lines INTO NAME measure VALUE v),
 sketch AS (SELECT lang, source, measure, v - v % (10 ** greatest(length(v::VARCHAR) - 2, 0))::BIGINT AS b,
   count(*) AS n FROM long GROUP BY ALL),
 q_own AS (SELECT lang, source, measure, max(d) AS d, min(b) FILTER (100 * u >= {_share(0)} * d) AS q1, min(b) FILTER (100 * u >= {_share(1)} * d) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) AS u,
    sum(n) OVER (PARTITION BY lang, source, measure) AS d FROM sketch) GROUP BY ALL),
 s_lang AS (SELECT lang, measure, b, sum(n) AS n FROM sketch GROUP BY ALL),
 q_lang AS (SELECT lang, measure, max(d) AS d, min(b) FILTER (100 * u >= {_share(0)} * d) AS q1, min(b) FILTER (100 * u >= {_share(1)} * d) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, measure ORDER BY b) AS u,
    sum(n) OVER (PARTITION BY lang, measure) AS d FROM s_lang) GROUP BY ALL),
 s_all AS (SELECT measure, b, sum(n) AS n FROM s_lang GROUP BY ALL),
 q_all AS (SELECT measure, min(b) FILTER (100 * u >= {_share(0)} * d) AS q1, min(b) FILTER (100 * u >= {_share(1)} * d) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY measure ORDER BY b) AS u,
    sum(n) OVER (PARTITION BY measure) AS d FROM s_all) GROUP BY ALL),
 picked AS (SELECT o.lang, o.source, o.measure,
   CASE WHEN o.d >= {quality.MIN_GROUP} THEN o.q1 WHEN l.d >= {quality.MIN_GROUP} THEN l.q1 ELSE a.q1 END AS q1,
   CASE WHEN o.d >= {quality.MIN_GROUP} THEN o.q3 WHEN l.d >= {quality.MIN_GROUP} THEN l.q3 ELSE a.q3 END AS q3
  FROM q_own o JOIN q_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
  JOIN q_all a ON o.measure = a.measure),
 fence AS (SELECT *, {_share(2)} * (q3 - q1) AS reach FROM picked),
 outside AS (SELECT DISTINCT long.rid FROM long JOIN fence f ON long.measure = f.measure
   AND long.lang IS NOT DISTINCT FROM f.lang AND long.source IS NOT DISTINCT FROM f.source
  WHERE v < q1 - reach OR v > q3 + reach),
 quality_out AS (SELECT ruled.*, NOT base_failed AND outside.rid IS NULL AS kept
   FROM ruled LEFT JOIN outside USING (rid))"""


OP2 = f"""WITH {quality_measured('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM quality_out"""

# -- op5 --------------------------------------------------------------------------------------

_KINDS = ", ".join(f"'{s}'" for s in urls.SECOND_LEVEL)
_LONG = f"(regexp_matches(two, '^[^.]*[.][a-z][a-z]$') AND string_split(two, '.')[1] IN ({_KINDS}))"
_LOW, _HIGH = urls.STRENGTH


def _level(name: str, children: str) -> str:
    """Prior strength of ``children`` (n, bad, pm)."""
    return f"""{name} AS (SELECT CASE WHEN coalesce(pairs, 0) = 0 OR excess <= 0 THEN {_HIGH}
   ELSE least(greatest(pairs / excess - 1.0, {_LOW}), {_HIGH}) END AS s FROM (SELECT
   sum((bad - n * pm) * (bad - n * pm) - n * pm * (1 - pm)) AS excess,
   sum(n * pm * (1 - pm) * (n - 1)) AS pairs FROM {children}))"""


OP5 = rf"""WITH
 parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 known AS (SELECT doc_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
 outcomes AS (SELECT host, known.bad FROM parsed LEFT JOIN known
   ON TRY_CAST(nullif(regexp_extract(path, '([0-9]{{1,18}})(?:\.[A-Za-z]+)?/?$', 1), '') AS BIGINT) = known.doc_id),
 hosts AS (SELECT *, CASE WHEN {_LONG} THEN two ELSE regexp_extract(host, '[^.]*$') END AS suffix,
   CASE WHEN {_LONG} THEN regexp_extract(host, '(?:[^.]*\.)?[^.]*\.[^.]*$') ELSE two END AS domain FROM
   (SELECT host, regexp_extract(host, '(?:[^.]*\.)?[^.]*$') AS two, count(bad)::DOUBLE AS n,
     (count(*) FILTER (bad))::DOUBLE AS bad FROM outcomes GROUP BY host)),
 total AS (SELECT (coalesce(sum(bad), 0) + 0.1::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS m FROM hosts),
 suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(total.m) AS pm FROM hosts, total GROUP BY 1),
 {_level('s1', 'suf')},
 dom AS (SELECT domain, sum(hosts.n) AS n, sum(hosts.bad) AS bad,
    any_value((suf.bad + s1.s * suf.pm) / (suf.n + s1.s)) AS pm
   FROM hosts JOIN suf USING (suffix), s1 GROUP BY 1),
 {_level('s2', 'dom')},
 hp AS (SELECT host, hosts.n, hosts.bad, (dom.bad + s2.s * dom.pm) / (dom.n + s2.s) AS pm
   FROM hosts JOIN dom USING (domain), s2),
 {_level('s3', 'hp')},
 post AS (SELECT host, (bad + s3.s * pm) / (n + s3.s) AS mean, n + s3.s AS w, n, bad FROM hp, s3),
 judged AS (SELECT page_id, host, path, CASE
   {' '.join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r in ('www.example.com/en/', 'example.com/en/', 'net/es/', 'net/fr/', 'com/'))}
   END AS rule, mean - {urls.Z} * sqrt(mean * (1 - mean) / (w + 1)) AS low, mean, n, bad FROM parsed JOIN post USING (host))
SELECT page_id, host, path, rule, n::BIGINT AS host_labelled, bad::BIGINT AS host_bad, round(mean, 6) AS bad_rate,
  round(low, 6) AS bad_rate_low, CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'example.com/en/' THEN 'block'
  WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' WHEN 'com/' THEN 'allow'
  ELSE CASE WHEN low > total.m THEN 'block' ELSE 'allow' END END AS verdict FROM judged, total"""

# -- op6 --------------------------------------------------------------------------------------


def mixed(docs: str, size: str, most: int = mixing.MOST_REPEATS) -> str:
    """CTEs that end in ``mix_out``: the columns of ``docs`` with size, source_size, target, copies."""
    return rf"""
 sized AS (SELECT *, row_number() OVER () AS place, {size} AS size,
   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM {docs}),
 src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
 w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 + 1 AS wt,
   source_size * {most} AS cap FROM src),
 lv AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
     / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0))::DOUBLE) AS level,
   row_number() OVER (ORDER BY cap / wt, source IS NULL, source COLLATE "binary") AS pos FROM w
  WINDOW b AS (ORDER BY cap / wt, source IS NULL, source COLLATE "binary" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 common AS (SELECT arg_min(level, pos) AS level FROM lv WHERE cap >= level * wt),
 goal AS (SELECT source, source_size, CASE WHEN cap >= lv.level * wt THEN common.level * wt ELSE cap::DOUBLE END AS target
   FROM lv, common),
 parts AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {most}) ELSE 0 END AS reps FROM goal),
 budgets AS (SELECT *, target - reps * source_size AS budget FROM parts),
 run AS (SELECT source, h, place, size AS s, sum(size) OVER (PARTITION BY source ORDER BY h, place ROWS UNBOUNDED PRECEDING)
   - size AS before FROM sized),
 cuts AS (SELECT run.source, h AS cut, CASE WHEN s - (budget - before) < budget - before THEN place + 1 ELSE place END AS cut_place
   FROM run JOIN budgets ON run.source IS NOT DISTINCT FROM budgets.source
   WHERE before <= budget AND before + s > budget),
 mix_out AS (SELECT sized.*, source_size, target,
   least(reps + CASE WHEN h < coalesce(cut, 0) OR (h = cut AND place < cut_place) THEN 1 ELSE 0 END, {most})::BIGINT AS copies
  FROM sized JOIN budgets b ON sized.source IS NOT DISTINCT FROM b.source
  LEFT JOIN cuts c ON sized.source IS NOT DISTINCT FROM c.source)"""


OP6 = f"""WITH {mixed('documents', f"len({WORDS.format('text')})::BIGINT")}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mix_out"""

# -- op10 -------------------------------------------------------------------------------------

OP10 = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
 pairs AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q JOIN v ON q.rid <> v.rid AND len(q.e) = len(v.e)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

# -- op13 -------------------------------------------------------------------------------------


def _terms(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            r"'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')")


OP13 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_terms('text')} AS w FROM documents),
 size AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
 tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
 df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1),
 part AS (SELECT tf.rid, tf.term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w)::BIGINT * n_docs) // total))) AS part
  FROM tf JOIN df USING (term) JOIN d USING (rid), size),
 q AS (SELECT item_id, term, count(*)::BIGINT AS reps FROM (SELECT item_id, unnest({_terms('text')}) AS term
   FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
 scored AS (SELECT item_id, rid, sum(reps * part)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY ALL),
 ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank,
   doc_id, score FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""

ORACLES = {"op1_line_dedup": OP1, "op10_top_k": OP10, "op13_lexical_search": OP13,
           "op2_quality_rules": OP2, "op5_url_filters": OP5, "op6_mixing": OP6}
