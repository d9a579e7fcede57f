"""DuckDB SQL of the corpus queries that SQL can express, by brute force over all pairs and all prefixes."""

HARD_NEGATIVES = """
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS found_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM scaled a JOIN scaled c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, found_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, found_id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, found_id) AS INTEGER) AS rank,
    found_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT * FROM ranked WHERE rank <= 5
"""

PREFIX_TRIE = r"""
WITH turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM turns
), convs AS (
  SELECT conv_id, count(*) AS n, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, i: CASE WHEN d % 2 = 1 THEN xor(d // 2, CAST(3988292384 AS BIGINT)) ELSE d // 2 END)), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, place + 1 AS depth, digest, words FROM convs c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 20 AND place < h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + place - c.h + 1, digest, words FROM convs c JOIN own ON own.conv_id = c.conv_id AND place >= c.h LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), paths AS (
  SELECT conv_id, depth, words, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), reach AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM paths
), nodes AS (
  SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM reach GROUP BY node
), children AS (
  SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT p.node, CAST(count(*) FILTER (WHERE c.node IS NULL) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.node = n.node GROUP BY p.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes u ON u.node = n.up LEFT JOIN children c ON c.node = n.node
"""
