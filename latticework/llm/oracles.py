"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from latticework.llm.url_templates import A_TO_Z, RULES, Settings

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def warc_sql() -> str:
    """Digests by 20-bit pieces of the SHA-1; the smallest page_id of a payload holds it."""
    piece = lambda i: f"CAST('0x' || substr(hex, {5 * i + 1}, 5) AS BIGINT)"
    digit = lambda i, shift: f"substr('{BASE32}', CAST(({piece(i)} >> {shift}) & 31 AS INT) + 1, 1)"
    digest = " || ".join(digit(i, shift) for i in range(8) for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {digest} AS payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""


def url_sql(settings: Settings = Settings(), rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The template tree level by level, as one chain of named subqueries."""
    s = settings
    parts = "string_split(regexp_replace(path, '^/', ''), '/')"
    text = f"""WITH k AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels GROUP BY 1),
    u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{A_TO_Z}', '{A_TO_Z.lower()}'), '') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    v AS (SELECT u.*, k.bad, {parts} AS p FROM u LEFT JOIN k ON k.doc_id = TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT)),
    t0 AS (SELECT page_id, host, path, bad, '' AS template,
      CASE WHEN len(p) <= {s.levels} THEN p ELSE list_append(p[1:{s.levels - 1}], array_to_string(p[{s.levels}:], '/')) END AS p FROM v)"""
    for i in range(s.levels):
        text += f""",
    c{i} AS (SELECT host, template, p[{i + 1}] AS part, count(*) AS n, count(bad) AS m, sum(coalesce(bad, 0)) AS b FROM t{i} WHERE len(p) > {i} GROUP BY 1, 2, 3),
    e{i} AS (SELECT host, template, sum(n) AS an, (sum(b) + 1) / CAST(sum(m) + 2 AS DOUBLE) AS rate FROM c{i} GROUP BY 1, 2),
    l{i} AS (SELECT host, template, part FROM c{i} JOIN e{i} USING (host, template) WHERE n >= {s.support} AND m > 0 AND NOT regexp_matches(part, '^[0-9]+(\\.[a-z]+)?$')
      AND n >= {s.share} * an AND abs(b - rate * m) >= {s.z} * sqrt(rate * (1 - rate) * m)),
    t{i + 1} AS (SELECT t.page_id, t.host, t.path, t.bad, CASE WHEN len(t.p) > {i} THEN t.template || '/' || coalesce(l.part, '*') ELSE t.template END AS template, t.p
      FROM t{i} t LEFT JOIN l{i} l ON l.host = t.host AND l.template = t.template AND l.part = t.p[{i + 1}])"""
    says = {column: "CASE " + " ".join(
        f"WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{value}'"
        for verdict, rule in sorted(rules, key=lambda r: -len(r[1])) for value in [rule if column == "rule" else verdict]
    ) + " END" for column in ("rule", "verdict")}
    return text + f""",
    g AS (SELECT host, template, count(bad) AS m, sum(coalesce(bad, 0)) AS b FROM t{s.levels} GROUP BY 1, 2),
    h AS (SELECT host, sum(m) AS hm, sum(b) AS hb FROM g GROUP BY 1), a AS (SELECT (sum(hb) + 1) / CAST(sum(hm) + 2 AS DOUBLE) AS everything FROM h),
    r AS (SELECT host, template, (b + {s.strength} * ((hb + {s.strength} * everything) / (hm + {s.strength}))) / (m + {s.strength}) AS bad_share FROM g JOIN h USING (host), a)
    SELECT page_id, host, path, {says['rule']} AS rule, coalesce({says['verdict']}, CASE WHEN bad_share >= {s.reject} THEN 'block' ELSE 'allow' END) AS verdict, template,
      round(bad_share, 6) AS bad_share FROM t{s.levels} JOIN r USING (host, template)"""


def jaccard_sql(k: int = 4, part: int = 85, whole: int = 100) -> str:
    """All pairs that share a shingle, then everything reachable from each document."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{A_TO_Z}', '{A_TO_Z.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle})) END AS g FROM w),
    x AS (SELECT doc_id, unnest(g) AS t FROM s), n AS (SELECT doc_id, len(g) AS n FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE {whole} * c >= {part} * (p.n + q.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS root, doc_id AS node FROM n UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node)
    SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id FROM n JOIN (SELECT root AS doc_id, min(node) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""


# the table of CRC-32 (reflected polynomial EDB88320), by its rule
CRC_TABLE = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, _k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
      FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))"""


def crc32_sql(text: str, table: str = "t") -> str:
    """CRC-32 of a text's UTF-8 bytes, with the list `table` of CRC_TABLE in scope."""
    hexed = f"hex(encode({text}))"
    return f"""xor(4294967295, list_reduce(list_transform(range(0, CAST(length({hexed}) AS BIGINT), 2), lambda i: CAST('0x' || substr({hexed}, CAST(i AS INT) + 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, {table}[CAST(xor(c, b) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)))"""


def variants_sql(least_symbols: int = 5, least_n: int = 3, of: int = 97, ratio: int = 2) -> str:
    """Near words by equal texts with one symbol taken out; forms followed step by step."""
    cut = f"{crc32_sql('key')} AS h"
    return f"""WITH RECURSIVE {CRC_TABLE},
    o AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
    k AS (SELECT run, c, CAST(doc_id AS VARCHAR) || ':' || run AS key, length(run) AS size FROM o),
    h AS (SELECT run, c, size, {cut} FROM k, crc_table),
    d AS (SELECT CASE WHEN h % {of} = 0 THEN substr(run, 1, CAST(h % size AS INT)) || substr(run, CAST(h % size AS INT) + 2) ELSE run END AS word, c FROM h),
    w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= {least_symbols} GROUP BY 1 HAVING sum(c) >= {least_n}),
    e AS (SELECT word, n, CAST(i AS INT) AS i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    p AS (SELECT DISTINCT * FROM (
      SELECT a.word, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION ALL SELECT a.word, b.word, b.n FROM e a JOIN w b ON a.less = b.word
      UNION ALL SELECT b.word, a.word, a.n FROM e a JOIN w b ON a.less = b.word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM p),
    f AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {ratio} * w.n THEN r.near END AS form, CASE WHEN r.near_n >= {ratio} * w.n THEN r.near_n END AS form_n
      FROM w LEFT JOIN r ON r.word = w.word AND r.k = 1),
    s AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL),
    z AS (SELECT s.word, s.at AS root FROM s JOIN f ON f.word = s.at WHERE f.form IS NULL)
    SELECT f.word, f.form, coalesce(z.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f LEFT JOIN z ON z.word = f.word"""


def runs_sql(least_words: int = 6, least_exponent: int = 4) -> str:
    """Equal words a period apart, joined to stretches; equal stretches keep the smallest period."""
    return f"""WITH {CRC_TABLE},
    a AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS o, CAST(doc_id AS VARCHAR) AS key FROM documents),
    b AS (SELECT doc_id, o, CAST(len(o) AS BIGINT) AS n, {crc32_sql('key')} AS h FROM a, crc_table),
    c AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS f, h % 10 = 0 AND n > 0 AS hit FROM b),
    d AS (SELECT *, CASE WHEN hit THEN 1 + (n - f) // (3 + (h // 10) % 8) END AS p FROM c),
    w AS (SELECT doc_id, n, i, CASE WHEN hit AND i >= f THEN o[f + (i - f) % p + 1] ELSE o[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM d)),
    e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {least_exponent} * (y.i - x.i) <= x.n),
    g AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k),
    r AS (SELECT doc_id, s, length, min(q) AS q FROM g WHERE length >= greatest({least_words}, {least_exponent} * q) GROUP BY ALL),
    t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
      first(s ORDER BY length DESC, s, q) AS start, first(length ORDER BY length DESC, s, q) AS length, first(q ORDER BY length DESC, s, q) AS period FROM r GROUP BY 1),
    z AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM r),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN z USING (doc_id, i) GROUP BY 1)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, CAST(length AS BIGINT) AS length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
      sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""


def repeats_sql(length: int = 400) -> str:
    """Digests of all windows of the hexadecimal text; overlapping repeated windows are joined to runs."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT doc_id, i, md5_number(substr(x, CAST(2 * i + 1 AS INT), {2 * length})) AS g FROM (SELECT doc_id, x, unnest(range(CAST(length(x) // 2 AS BIGINT) - {length - 1})) AS i FROM d)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
    b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length} THEN 0 ELSE 1 END AS new FROM r),
    s AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k),
    g AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM s),
    t AS (SELECT g.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(CASE WHEN k = 1 THEN substr(x, 1, CAST(2 * a AS INT)) ELSE '' END ||
      substr(x, CAST(2 * z + 1 AS INT), CAST(2 * (coalesce(next, length(x) // 2) - z) AS INT)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY 1)
    SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
