"""DuckDB SQL for the queries that SQL can express on whole tables: brute force, by other means than the operators'."""

from __future__ import annotations

from folia.llm import secrets, sharding

#: Links by counting the shingles that two documents share; components by reach.
NEAR_DUPLICATES = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
        FROM words WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
    links AS (
        SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
        JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
    FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id"""

#: Every 50-byte window with the least document that has it; runs of windows that are close enough to touch.
SUBSTRINGS = """
    WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    windows AS (SELECT doc_id, i, array_slice(b, i + 1, i + 50) AS s FROM docs, LATERAL (SELECT unnest(range(0, octet_length(b) - 49)) AS i)),
    firsts AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
    hits AS (SELECT doc_id, i, i > coalesce(lag(i) OVER w + 50, -1) AS new FROM windows JOIN firsts USING (s) WHERE d < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits) GROUP BY doc_id, k),
    cuts AS (SELECT doc_id, e AS first, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1099511627776) AS last FROM (FROM runs UNION ALL SELECT doc_id, -1, 0 FROM docs)),
    kept AS (SELECT doc_id, string_agg(hex(array_slice(b, first + 1, least(last, octet_length(b)))), '' ORDER BY first) AS h FROM cuts JOIN docs USING (doc_id) WHERE first < octet_length(b) GROUP BY doc_id),
    spans AS (SELECT doc_id, count(*) AS n, sum(e - a) AS removed FROM runs GROUP BY 1)
    SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
    FROM docs LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: The jumps one by one on 128-bit integers, CRC-32 byte by byte with a table made by its rule.
SHARDING = f"""
    WITH RECURSIVE crc_table AS (
        SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    docs AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h, xor(list_reduce(
            list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM documents, crc_table),
    jumps(doc_id, key, j) AS (
        SELECT DISTINCT doc_id, ('0x' || substr(h, 1, 16))::UBIGINT, 0::BIGINT FROM docs
        UNION ALL
        SELECT doc_id, k, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
        FROM (SELECT doc_id, j, ((key::HUGEINT * {(sharding.MULTIPLIER_HIGH << 32) + sharding.MULTIPLIER_LOW} + 1) % 18446744073709551616)::UBIGINT AS k FROM jumps WHERE j < 25)),
    shards AS (SELECT doc_id, max(j) FILTER (j < 24) AS s, max(j) FILTER (j < 25) AS g FROM jumps GROUP BY 1)
    SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, s::INT AS shard,
        row_number() OVER (PARTITION BY s ORDER BY ('0x' || substr(h, 17, 8))::BIGINT % (SELECT greatest({sharding.PIECES_PER_SHARD}, count(*) // (24 * {sharding.PIECE_ROWS})) FROM docs), doc_id, size, crc) - 1 AS slot, g::INT AS grown_shard
    FROM docs JOIN shards USING (doc_id)"""


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets() -> str:
    """Matches are marked in the text by control characters; places are lengths of what stands before."""
    words = "|".join(_letters(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
    patterns = {
        "assign": f"""(?:{words})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA([A-Z0-9]+)", "hex": "([0-9a-f]+)",
        **{k: f"({p.pattern})" for k, (_, p) in secrets.MORE.items()},
    }
    least = {"assign": f"length(own) >= {secrets.ASSIGN_LEAST}", "access": f"length(whole) >= {secrets.ACCESS_LEAST}", "hex": "length(whole) >= 24"}
    parts = []
    for k, (kind, pattern) in enumerate(patterns.items()):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, '{kind}' AS kind, {k} AS kind_order, start, start + length(whole) AS stop FROM (
                SELECT doc_id, p[1] AS whole, p[2] AS own, sum(length(p[1]) + length(coalesce(p[3], ''))) OVER (PARTITION BY doc_id ORDER BY nth) - length(p[1]) - length(coalesce(p[3], '')) AS start, nth
                FROM (SELECT doc_id, nth, CASE WHEN nth = 1 THEN [x, NULL, NULL] ELSE string_split(x, chr(2)) END AS p FROM (
                    SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS nth FROM (
                        SELECT doc_id, string_split(regexp_replace(text, '({quoted})', chr(1) || '\\1' || chr(2) || '\\2' || chr(2), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)))
            ) WHERE nth > 1 AND {least.get(kind, "true")}""")
    return f"""
        WITH spans AS ({" UNION ALL ".join(parts)}),
        joined AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) FILTER (kind_order < 3) AS base,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) AS spans FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN joined USING (doc_id)"""


#: The columns of the quality rules that are counts, without the estimates.
RULES_BASE = r"""
    WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    triples AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM words, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM triples) WHERE n > 1),
    repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(repeated.n, 0) > 50 * len(w) AS base_failed
    FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)"""

SQL = {"op2_minhash": NEAR_DUPLICATES, "op3_substrings": SUBSTRINGS, "op7_secrets": _secrets(), "op10_sharding": SHARDING, "rules_base_columns": RULES_BASE}
