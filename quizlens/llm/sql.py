"""DuckDB SQL for the queries that SQL can express, written independently of their operators."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP2 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_PLAIN_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + 12], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN sizes WHERE len(w) >= n)),
found AS (SELECT r, n, k, item_id FROM places JOIN wins USING (n, win)),
hits AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT r, n, k FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""

OP10 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
places AS (SELECT r, doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS win FROM (SELECT *, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first FROM places GROUP BY win),
gone AS (SELECT r, list(DISTINCT x) AS xs FROM (SELECT r, unnest(range(k, k + 50)) AS x FROM places JOIN firsts USING (win) WHERE first < doc_id) GROUP BY r),
words AS (SELECT r, string_agg(word, ' ' ORDER BY x) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d) e
  ANTI JOIN (SELECT r, unnest(xs) AS x FROM gone) g USING (r, x) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN words USING (r)"""

# Greedy filling for one capacity after another is one recursion: a state holds the search's bounds, the capacity
# at hand, and how far its shards reach. CRC-32 is folded over the bytes with its table made on the spot.
OP3 = """WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
sized AS (SELECT r, doc_id, text, strlen(text) + 16 AS size FROM d),
groups_ AS (SELECT text, min(doc_id) AS head, sum(size)::BIGINT AS bytes FROM sized GROUP BY text),
ends AS (SELECT text, (sum(bytes) OVER (ORDER BY head, sha256(text)))::BIGINT AS e FROM groups_),
sums AS (SELECT list(e ORDER BY e) AS es, max(e) AS total FROM ends),
search AS (
  SELECT (total + 39) // 40 AS lo, total AS hi, ((total + 39) // 40 + total) // 2 AS mid, 0::BIGINT AS pos, 0 AS used FROM sums
  UNION ALL
  SELECT CASE WHEN bad THEN mid + 1 ELSE lo END, CASE WHEN good THEN mid ELSE hi END,
    CASE WHEN bad THEN (mid + 1 + hi) // 2 WHEN good THEN (lo + mid) // 2 ELSE mid END,
    CASE WHEN bad OR good THEN 0 ELSE nxt END, CASE WHEN bad OR good THEN 0 ELSE used + 1 END
  FROM (SELECT *, (nxt <= pos OR (used = 39 AND nxt < total)) AS bad, (nxt = total AND used <= 39) AS good
        FROM (SELECT s.*, total, coalesce((SELECT max(e) FROM ends WHERE e <= s.pos + s.mid), 0) AS nxt FROM search s, sums WHERE s.lo < s.hi))),
best AS (SELECT min(hi) AS cap FROM search),
cuts AS (
  SELECT 0 AS shard, (SELECT max(e) FROM ends WHERE e <= cap) AS until, cap FROM best WHERE cap IS NOT NULL
  UNION ALL
  SELECT shard + 1, (SELECT max(e) FROM ends WHERE e <= c.until + c.cap), cap FROM cuts c, sums WHERE c.until < total),
placed AS (SELECT r, doc_id, size, s.text, (SELECT min(shard) FROM cuts WHERE until >= e) AS shard FROM sized s JOIN ends USING (text)),
crc AS (SELECT text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM groups_, tab)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM placed JOIN crc USING (text)"""
