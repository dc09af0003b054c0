"""What DuckDB must find for the queries that SQL can express."""

MIX = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT + 1]::DOUBLE AS weight
  FROM sources
), ratios AS (
  SELECT *, 2 * source_size AS most, 2 * source_size / weight AS ratio FROM weighted
), held AS (
  SELECT *,
    coalesce(sum(most) OVER before, 0) AS most_before, coalesce(sum(weight) OVER before, 0) AS weight_before,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM ratios WINDOW before AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rate AS (
  SELECT (1.5::DOUBLE * total::DOUBLE - most_before::DOUBLE) / (weights - weight_before)::DOUBLE AS rate
  FROM held WHERE most > weight * ((1.5::DOUBLE * total::DOUBLE - most_before::DOUBLE) / (weights - weight_before)::DOUBLE)
  ORDER BY ratio, source LIMIT 1
), goals AS (
  SELECT source, source_size, CASE WHEN most <= weight * r.rate THEN most::DOUBLE ELSE weight * r.rate END AS target
  FROM ratios, (SELECT coalesce((SELECT rate FROM rate), 0.0::DOUBLE) AS rate) r
), placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(0, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM placed
"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), judged AS (
  SELECT k.*, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

WORDS = r"""
  SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM {table}
"""

CONTAMINATION = f"""
WITH items AS ({WORDS.format(id="item_id", table="benchmark")}), docs AS ({WORDS.format(id="doc_id", table="documents")}),
windows AS (
  SELECT item_id, words[i : i + 12] AS w FROM (SELECT *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT len(w) AS size FROM windows
), stretches AS (
  SELECT doc_id, i, size, words[i : i + size - 1] AS w
  FROM (SELECT d.*, s.size, unnest(range(1, len(d.words) - s.size + 2)) AS i FROM docs d, sizes s WHERE len(d.words) >= s.size)
), found AS (
  SELECT s.doc_id, s.i, s.size, b.item_id FROM stretches s JOIN windows b ON s.w = b.w
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""

ARCHIVES = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

AUDIT = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occurring AS (SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), groups AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM occurring JOIN kept USING (lang, term) GROUP BY lang, source, term
), kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
  SELECT lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v) AS p
  FROM totals t JOIN kept k USING (lang) JOIN kinds USING (lang) LEFT JOIN counts c USING (lang, source, term)
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS p
  FROM shares JOIN kinds USING (lang) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, ((s.p - w.p) * (s.p - w.p)) // w.p FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.p
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 200
"""

STATEMENTS = {"op11_audit": AUDIT, "op9_warc": ARCHIVES, "op1_mix": MIX, "op2_decontaminate": CONTAMINATION, "op7_lines": LINES}
