"""What SQL can express of the registered queries."""

from __future__ import annotations

MTREE = r"""
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

URL_FILTER = r"""
WITH rules(rule, host, path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN LATERAL (
  SELECT rule, verdict FROM rules
  WHERE (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
  ORDER BY length(rule) DESC LIMIT 1
) r ON true
"""

JACCARD_JOIN = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
    ELSE list_transform(range(1, len(words) - 3), lambda i: list_slice(words, i, i + 4)) END) AS shingle
  FROM split
), sizes AS (
  SELECT split.doc_id, count(shingle) AS n FROM split LEFT JOIN shingles ON split.doc_id = shingles.doc_id GROUP BY split.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), either AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, b AS other FROM either
  UNION
  SELECT reached.doc_id, either.b FROM reached JOIN either ON reached.other = either.a
)
SELECT sizes.doc_id, any_value(n) AS n_shingles, least(sizes.doc_id, coalesce(min(other), sizes.doc_id)) AS component_id
FROM sizes LEFT JOIN reached ON sizes.doc_id = reached.doc_id GROUP BY sizes.doc_id
"""

SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, spot, list_aggregate(list_slice(words, spot, spot + 19), 'string_agg', ' ') AS sequence
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS spot FROM split WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, spot FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY sequence ORDER BY doc_id, spot) AS turn FROM windows) WHERE turn > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(spot, spot + 20)) AS place FROM later
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split
), kept AS (
  SELECT placed.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM placed ANTI JOIN gone ON placed.doc_id = gone.doc_id AND placed.place = gone.place GROUP BY placed.doc_id
)
SELECT split.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.doc_id = kept.doc_id
"""

QUALITY_RULES = r"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER () AS row_no FROM split
), windows AS (
  SELECT row_no, spot, list_slice(words, spot, spot + 4) AS sequence
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 3)) AS spot FROM numbered WHERE len(words) >= 5)
), repeated AS (
  SELECT row_no, spot FROM (SELECT row_no, spot, count(*) OVER (PARTITION BY row_no, sequence) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_no, count(DISTINCT place) AS n FROM (SELECT row_no, unnest(range(spot, spot + 5)) AS place FROM repeated) GROUP BY row_no
), counts AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         coalesce(list_sum(list_transform(words, lambda w: length(w) - length(regexp_replace(w, '[#*$%&|<>]', '', 'g')))), 0)::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM numbered LEFT JOIN covered USING (row_no)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_rate,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate,
         CASE WHEN n_words > 0 THEN least(10 * word_chars // n_words, 1000) ELSE 0 END AS word_length
  FROM counts
), rates AS (
  SELECT lang, source, rate, bin FROM (
    UNPIVOT (SELECT lang, source, symbol_rate, dup_line_rate, repeat_rate, word_length FROM judged WHERE NOT base_failed)
    ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME rate VALUE bin)
  WHERE bin > 0 OR rate IN ('symbol_rate', 'word_length')
), groups AS (
  SELECT 2 AS depth, lang, source, rate, bin FROM rates UNION ALL SELECT 1, lang, NULL, rate, bin FROM rates UNION ALL SELECT 0, NULL, NULL, rate, bin FROM rates
), middle AS (
  SELECT depth, lang, source, rate, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM groups GROUP BY ALL
), own AS (
  SELECT m.depth, m.lang, m.source, m.rate, any_value(n) AS n, any_value(q1) AS q1, any_value(q3) AS q3,
         quantile_disc(bin, 0.25) FILTER (bin > q3) AS above
  FROM middle m JOIN groups g ON m.depth = g.depth AND m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source AND m.rate = g.rate
  GROUP BY m.depth, m.lang, m.source, m.rate
), ends AS (
  SELECT depth, lang, source, rate, n, q1, q3,
         CASE WHEN q3 > 0 THEN q3 + if(rate = 'word_length', 6, 3) * greatest(q3 - q1, q3 // 20, 1) ELSE coalesce(above, 0) // 2 END AS high,
         q1 - if(rate = 'word_length', 6, 3) * greatest(q3 - q1, q3 // 20, 1) AS low
  FROM own
), langs AS (
  SELECT l.lang, l.rate, (least(l.n, 50) * l.high + (50 - least(l.n, 50)) * e.high) // 50 AS high, (least(l.n, 50) * l.low + (50 - least(l.n, 50)) * e.low) // 50 AS low
  FROM ends l JOIN ends e ON l.rate = e.rate AND e.depth = 0 WHERE l.depth = 1
), fences AS (
  SELECT s.lang, s.source, s.rate, (least(s.n, 50) * s.high + (50 - least(s.n, 50)) * l.high) // 50 AS high, (least(s.n, 50) * s.low + (50 - least(s.n, 50)) * l.low) // 50 AS low
  FROM ends s JOIN langs l ON s.rate = l.rate AND s.lang IS NOT DISTINCT FROM l.lang WHERE s.depth = 2
), wide AS (
  SELECT lang, source,
         max(high) FILTER (rate = 'symbol_rate') AS symbol_high, max(high) FILTER (rate = 'dup_line_rate') AS dup_high,
         max(high) FILTER (rate = 'repeat_rate') AS repeat_high, max(high) FILTER (rate = 'word_length') AS length_high,
         max(low) FILTER (rate = 'word_length') AS length_low
  FROM fences GROUP BY lang, source
)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
       NOT j.base_failed AND symbol_rate <= coalesce(symbol_high, symbol_rate) AND dup_line_rate <= coalesce(dup_high, dup_line_rate)
           AND repeat_rate <= coalesce(repeat_high, repeat_rate)
           AND word_length BETWEEN coalesce(length_low, word_length) AND coalesce(length_high, word_length) AS kept
FROM judged j LEFT JOIN wide ON j.lang IS NOT DISTINCT FROM wide.lang AND j.source IS NOT DISTINCT FROM wide.source
"""

#: The checksum of short ASCII texts, which the SQL engine has no function for; ``of`` is an expression over a row that has the table's column ``t``.
CRC_TABLE = r"""
crc_table AS (
  SELECT list(list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)
)"""


def _crc(of: str) -> str:
    bytes_ = f"list_transform(string_split({of}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text, {_crc("key")} % 20 AS fate FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS previous,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), convs AS (
  SELECT row_number() OVER () AS conv, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
), rows_ AS (
  SELECT convs.conv, faulty.*, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more
  FROM faulty JOIN convs ON faulty.conv_id IS NOT DISTINCT FROM convs.conv_id
), counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv
), going AS (
  -- The least cost and audit from each state on, from the last row to the first: s0 nothing yet, s1 after s, s2 after u, s3 after a.
  SELECT conv, coalesce(n, 0) + 1 AS pos, {{'c': 0, 'a': ''}} AS s0, {{'c': 10, 'a': 'II'}} AS s1, {{'c': 5, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3
  FROM convs LEFT JOIN counts USING (conv)
  UNION ALL
  SELECT conv, pos,
         list_min([p0, {{'c': p2.c + 5, 'a': 'I' || p2.a}}, {{'c': p3.c + 10, 'a': 'II' || p3.a}}]), list_min([p1, {{'c': p2.c + 5, 'a': 'I' || p2.a}}, {{'c': p3.c + 10, 'a': 'II' || p3.a}}]),
         list_min([p2, {{'c': p3.c + 5, 'a': 'I' || p3.a}}]), list_min([p3, {{'c': p2.c + 5, 'a': 'I' || p2.a}}])
  FROM (
    SELECT conv, r.pos,
           list_min([{{'c': s0.c + 2, 'a': 'D' || s0.a}}, CASE WHEN NOT gone AND initial = 's' THEN {{'c': s1.c + more, 'a': 'K' || s1.a}} WHEN NOT gone AND initial = 'u' THEN {{'c': s2.c + more, 'a': 'K' || s2.a}} END,
                     CASE WHEN NOT gone THEN {{'c': s2.c + more + 1, 'a': 'R' || s2.a}} END]) AS p0,
           list_min([{{'c': s1.c + 2, 'a': 'D' || s1.a}}, CASE WHEN NOT gone AND initial = 'u' THEN {{'c': s2.c + more, 'a': 'K' || s2.a}} END, CASE WHEN NOT gone THEN {{'c': s2.c + more + 1, 'a': 'R' || s2.a}} END]) AS p1,
           list_min([{{'c': s2.c + 2, 'a': 'D' || s2.a}}, CASE WHEN NOT gone AND initial = 'a' THEN {{'c': s3.c + more, 'a': 'K' || s3.a}} END, CASE WHEN NOT gone THEN {{'c': s3.c + more + 1, 'a': 'R' || s3.a}} END]) AS p2,
           list_min([{{'c': s3.c + 2, 'a': 'D' || s3.a}}, CASE WHEN NOT gone AND initial = 'u' THEN {{'c': s2.c + more, 'a': 'K' || s2.a}} END, CASE WHEN NOT gone THEN {{'c': s2.c + more + 1, 'a': 'R' || s2.a}} END]) AS p3
    FROM going JOIN rows_ r USING (conv) WHERE r.pos = going.pos - 1
  )
), audited AS (
  SELECT conv, s0.c AS cost, s0.a AS audit FROM going WHERE pos = 1
), told AS (
  SELECT conv, 1 AS letter, 0 AS read, '' AS state, '' AS out, audit FROM audited
  UNION ALL
  SELECT t.conv, letter + 1, read + (audit[letter] <> 'I')::INTEGER,
         CASE audit[letter] WHEN 'D' THEN state WHEN 'K' THEN r.initial ELSE CASE state WHEN 'u' THEN 'a' ELSE 'u' END END,
         out || CASE WHEN audit[letter] = 'D' THEN '' ELSE CASE WHEN state = '' THEN '' ELSE chr(10) END
           || CASE WHEN audit[letter] = 'K' THEN r.role WHEN state = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN audit[letter] = 'I' THEN '' ELSE r.text END END,
         audit
  FROM told t LEFT JOIN rows_ r ON r.conv = t.conv AND r.pos = t.read + 1 AND audit[letter] <> 'I'
  WHERE letter <= length(audit)
)
SELECT convs.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audited.audit, sha256(out) AS repaired_sha256
FROM convs JOIN audited USING (conv) LEFT JOIN counts USING (conv) JOIN told ON told.conv = convs.conv AND letter = length(audited.audit) + 1
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MERKLE_MANIFEST = rf"""
WITH RECURSIVE {CRC_TABLE}, hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS changed
  FROM documents, crc_table
), langs AS (
  SELECT lang, n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT lang, count(*) AS n FROM hashed GROUP BY lang)
), leaves AS (
  SELECT doc_id, leaf, changed, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM hashed JOIN langs ON hashed.lang IS NOT DISTINCT FROM langs.lang
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
), subroots AS (
  SELECT tree, level AS height, digest AS subroot FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM subroots) AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n
), whole AS (
  SELECT digest AS root, level AS height FROM tops WHERE n = 1
), steps AS (
  SELECT l.tree, l.idx, s.level, CASE WHEN nodes.digest IS NULL THEN '-' WHEN nodes.idx < l.idx >> s.level THEN '<' || nodes.digest ELSE '>' || nodes.digest END AS step
  FROM leaves l JOIN subroots USING (tree), unnest(range(height)) s(level)
  LEFT JOIN nodes ON nodes.tree = l.tree AND nodes.level = s.level AND nodes.idx = xor(l.idx >> s.level, 1)
  UNION ALL
  SELECT l.tree, l.idx, 1000 + s.level, CASE WHEN tops.digest IS NULL THEN '-' WHEN tops.idx < l.tree >> s.level THEN '<' || tops.digest ELSE '>' || tops.digest END
  FROM leaves l, whole, unnest(range(height)) s(level)
  LEFT JOIN tops ON tops.level = s.level AND tops.idx = xor(l.tree >> s.level, 1)
), paths AS (
  SELECT tree, idx, list(step ORDER BY level) AS path FROM steps GROUP BY tree, idx
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_concat([''], coalesce(path, [])), lambda d, s: d || CASE WHEN s = '-' THEN '' ELSE s[2:] END)) AS proof_sha256,
         list_reduce(list_concat([changed], coalesce(path, [])), lambda d, s: sha256(CASE s[1] WHEN '<' THEN s[2:] || d WHEN '>' THEN d || s[2:] ELSE d END)) AS folded_root
  FROM leaves JOIN subroots USING (tree) CROSS JOIN whole LEFT JOIN paths USING (tree, idx)
)
SELECT *, folded_root = root AS verified FROM folded
"""

ORACLES = {
    "op1_mtree": MTREE,
    "op4_url_filter": URL_FILTER,
    "op5_jaccard_join": JACCARD_JOIN,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op7_quality_rules": QUALITY_RULES,
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_merkle_manifest": MERKLE_MANIFEST,
}
