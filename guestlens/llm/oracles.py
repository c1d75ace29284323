"""SQL for DuckDB that the queries of the trie, the manifest and the exact duplicates must agree with, row by row."""

from __future__ import annotations

#: The table of CRC-32 with its usual polynomial, as a list of 256 numbers.
CRC_TABLE = (
    "crc AS MATERIALIZED (SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) "
    "ORDER BY i) AS t FROM range(256) r(i))"
)


def crc32(value: str) -> str:
    """CRC-32 of the digits of a whole number, in a query that has a row of ``crc`` at hand."""
    return (
        f"xor(list_reduce([4294967295] || list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), "
        "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    )


def exact_sql() -> str:
    return """
SELECT doc_id, keep_id, group_size, sha256(t) AS text_sha256, place = 1 AS kept FROM (
 SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place
 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def manifest_sql() -> str:
    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        parts = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
        return f"sha256({' || '.join(parts)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {leaf('text')} AS leaf,
  CASE WHEN {crc32('doc_id')} % 3 = 0 THEN {leaf(lowered)} END AS changed FROM documents, crc),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
low AS (SELECT 0 AS level, grp, place, leaf AS hash, count(*) OVER (PARTITION BY grp) AS n FROM ranked
  UNION ALL
  SELECT level + 1, grp, place // 8, sha256(string_agg(hash, '' ORDER BY place)), max((n + 7) // 8) FROM low WHERE n > 1 GROUP BY level, grp, place // 8),
subroots AS (SELECT grp, hash AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM low WHERE n = 1),
high AS (SELECT 0 AS level, place, subroot AS hash, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(hash, '' ORDER BY place)), max((n + 7) // 8) FROM high WHERE n > 1 GROUP BY level, place // 8),
low_steps AS (SELECT r.doc_id, r.grp, r.place AS row, l.level,
  coalesce(string_agg(l.hash, '' ORDER BY l.place) FILTER (WHERE l.place < r.place // CAST(8 ** l.level AS BIGINT)), '') AS before,
  coalesce(string_agg(l.hash, '' ORDER BY l.place) FILTER (WHERE l.place > r.place // CAST(8 ** l.level AS BIGINT)), '') AS after
  FROM ranked r JOIN low l ON l.grp = r.grp AND l.n > 1 AND l.place // 8 = r.place // CAST(8 ** (l.level + 1) AS BIGINT) GROUP BY ALL),
high_steps AS (SELECT s.grp, 1000 + h.level AS level,
  coalesce(string_agg(h.hash, '' ORDER BY h.place) FILTER (WHERE h.place < s.place // CAST(8 ** h.level AS BIGINT)), '') AS before,
  coalesce(string_agg(h.hash, '' ORDER BY h.place) FILTER (WHERE h.place > s.place // CAST(8 ** h.level AS BIGINT)), '') AS after
  FROM subroots s JOIN high h ON h.n > 1 AND h.place // 8 = s.place // CAST(8 ** (h.level + 1) AS BIGINT) GROUP BY s.grp, s.place, h.level),
steps AS (SELECT grp, row, level, before, after FROM low_steps
  UNION ALL SELECT r.grp, r.place, h.level, before, after FROM ranked r JOIN high_steps h USING (grp)),
paths AS (SELECT grp, row, list({{'before': before, 'after': after}} ORDER BY level) AS path FROM steps GROUP BY grp, row),
folded AS (SELECT r.doc_id, r.leaf, s.subroot, (SELECT hash FROM high WHERE n = 1) AS root,
  coalesce(array_to_string(list_transform(path, lambda p: p.before || p.after), ''), '') AS siblings,
  list_reduce([{{'before': coalesce(changed, leaf), 'after': ''}}] || coalesce(path, []),
    lambda h, p: {{'before': sha256(p.before || h.before || p.after), 'after': ''}}).before AS folded_root
  FROM ranked r JOIN subroots s USING (grp) LEFT JOIN paths p ON p.grp = r.grp AND p.row = r.place)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


def prefixes_sql() -> str:
    return f"""
WITH {CRC_TABLE},
said AS (SELECT conv_id, coalesce(role, '') AS who, coalesce(text, '') AS what, turn,
  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, mark, length(what) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS place FROM said),
heights AS (SELECT conv_id, {crc32('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
opened AS (SELECT c.conv_id, o.place, o.mark, o.size FROM heights c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.place <= h
  UNION ALL SELECT conv_id, place, mark, size FROM own JOIN heights USING (conv_id) WHERE place > h),
rebuilt AS (SELECT conv_id, mark, size, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM opened),
paths AS (SELECT conv_id, depth, size, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM heights),
lengths AS (SELECT conv_id, max(depth) AS turns FROM paths GROUP BY conv_id),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, p.path AS above FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth - 1))),
kids AS (SELECT above AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY above),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (path)),
below AS (SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
  FROM counted a JOIN counted b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM counted JOIN below USING (path)"""
