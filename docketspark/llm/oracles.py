"""DuckDB SQL for the numbered queries that SQL can express."""

#: Reusable text of the word rule; DuckDB's regular expressions take the same class.
_WORD = r"'[^\x20\x09-\x0D]+'"

OP7 = rf"""
WITH s AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS k,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS h,
         coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size
  FROM documents
), t AS (
  SELECT k, source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM s GROUP BY k, source
), c AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size) / w AS ratio FROM t
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM c WINDOW b AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT k, source_size,
         CASE WHEN cap <= level * w THEN cap::DOUBLE
              ELSE max(CASE WHEN NOT cap <= level * w THEN level END) OVER () * w END AS target
  FROM f
), p AS (
  SELECT k, source_size, target, floor(target)::BIGINT AS words,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM g
), r AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.words - p.epochs * p.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN p USING (k)
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM r
"""

_RATES = {"symbols": ("n_symbols", "word_chars", 1000, 10, False), "word_length": ("word_chars", "n_words", 100, 60, True), "dup_lines": ("n_dup_lines", "n_lines", 1000, 150, False), "repeats": ("n_repeat_words", "n_words", 1000, 90, False)}
_RATE_ROWS = " UNION ALL ".join(
    f"SELECT lk, sk, '{k}' AS rate, {least} AS least, CASE WHEN {bottom} > 0 THEN ({scale} * {top}) // {bottom} END AS v FROM c WHERE NOT base_failed"
    for k, (top, bottom, scale, least, _) in _RATES.items()
)
_WITHIN = " AND ".join(
    f"(CASE WHEN {bottom} > 0 THEN ({scale} * {top}) // {bottom} END <= {k}_hi" + (f" AND ({scale} * {top}) // nullif({bottom}, 0) >= {k}_lo)" if low else ")")
    for k, (top, bottom, scale, _, low) in _RATES.items()
)
_LIMITS = ", ".join(f"max(CASE WHEN rate = '{k}' THEN q3 + 3 * greatest(q3 - q1, least) END) AS {k}_hi, max(CASE WHEN rate = '{k}' THEN q1 - 3 * greatest(q3 - q1, least) END) AS {k}_lo" for k in _RATES)


def _quartiles(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""
  SELECT {by}rate, max(total) AS n,
         min(CASE WHEN upto * 4 >= total THEN start END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN start END) AS q3
  FROM (SELECT {by}rate, start, sum(n) OVER (PARTITION BY {by}rate) AS total,
               sum(n) OVER (PARTITION BY {by}rate ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM (SELECT {by}rate, start, sum(n) AS n FROM h GROUP BY {by}rate, start))
  GROUP BY {by}rate"""


OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, {_WORD}) AS words FROM d
), u AS (
  SELECT id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win
  FROM (SELECT id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)
), hit AS (
  SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS k FROM u) WHERE k > 1
), rep AS (
  SELECT id, sum(least(8, i - before)) AS n
  FROM (SELECT id, i, coalesce(lag(i) OVER (PARTITION BY id ORDER BY i), i - 8) AS before FROM hit) GROUP BY id
), ln AS (
  SELECT id, count(*) AS lines, count(*) - count(DISTINCT x) AS n
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, {_WORD}) GROUP BY id
), c AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS lk, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS sk,
         len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(ln.lines, 0)::BIGINT AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(words) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(words) AS base_failed
  FROM w LEFT JOIN rep USING (id) LEFT JOIN ln USING (id)
), r AS ({_RATE_ROWS}), h AS (
  SELECT lk, sk, rate, CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS start, count(*) AS n
  FROM r WHERE v IS NOT NULL GROUP BY ALL
), least_of AS (SELECT DISTINCT rate, least FROM r), o AS ({_quartiles("lk, sk")}), l AS ({_quartiles("lk")}), a AS ({_quartiles("")}), q AS (
  SELECT o.lk, o.sk, o.rate, least,
         (o.n * o.q1 + 10 * ((l.n * l.q1 + 10 * a.q1) // (l.n + 10))) // (o.n + 10) AS q1,
         (o.n * o.q3 + 10 * ((l.n * l.q3 + 10 * a.q3) // (l.n + 10))) // (o.n + 10) AS q3
  FROM o JOIN l ON o.lk = l.lk AND o.rate = l.rate JOIN a ON o.rate = a.rate JOIN least_of ON o.rate = least_of.rate
), f AS (SELECT lk, sk, {_LIMITS} FROM q GROUP BY lk, sk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({_WITHIN}, false) AS kept
FROM c LEFT JOIN f USING (lk, sk)
"""

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS words
  FROM documents
), x AS (
  SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), y AS (
  SELECT id, word || ' ' || lead(word, 1) OVER k || ' ' || lead(word, 2) OVER k || ' ' || lead(word, 3) OVER k AS gram
  FROM x WINDOW k AS (PARTITION BY id ORDER BY i)
), g AS (
  SELECT DISTINCT id, gram FROM y WHERE gram IS NOT NULL
  UNION ALL SELECT id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 3
), t AS (
  SELECT id, doc_id, coalesce(n, 0)::BIGINT AS n FROM w LEFT JOIN (SELECT id, count(*) AS n FROM g GROUP BY id) USING (id)
), s AS (
  SELECT id, n, gram FROM g JOIN t USING (id)
), c AS (
  SELECT a.id AS a, b.id AS b, count(*) AS n FROM s a JOIN s b ON a.gram = b.gram AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN t x ON x.id = c.a JOIN t y ON y.id = c.b
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (
  SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a
)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
       doc_id <= coalesce(least, doc_id) AS kept
FROM t LEFT JOIN m USING (doc_id)
"""

OP8 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

#: Terms of ranked search; the class also leaves out all other ASCII.
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_TERM}) AS words FROM documents
), c AS (
  SELECT count(*)::BIGINT AS big_n, sum(len(words))::BIGINT AS big_l FROM d WHERE len(words) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_TERM})) AS term FROM benchmark
), p AS (
  SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term
), w AS (
  SELECT term, floor(1000 * ln(((2 * big_n + 2)::DOUBLE) / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c
), s AS (
  SELECT id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(words)::BIGINT * big_n) // big_l))) AS s
  FROM p JOIN w USING (term) JOIN d USING (id), c
), r AS (
  SELECT item_id, id, sum(s)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY item_id, id HAVING sum(s) > 0
), k AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank FROM r JOIN d USING (id)
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""

ORACLES = {"op5_adaptive_rules": OP5, "op6_near_duplicates": OP6, "op7_source_mix": OP7, "op8_warc_revisits": OP8, "op13_ranked_search": OP13}
