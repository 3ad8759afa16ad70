"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import BAND_PARTS, BANDS, CLASS_REFERENCE, COMMON_SHARE, COMMON_WORDS, MAX_DISTANCE

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = "translate(coalesce(text, ''), '" + _UPPER + "', '" + _UPPER.lower() + "')"

OP1 = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS g, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), size AS (
  SELECT DISTINCT n FROM win
), gram AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, gram.n AS n, item_id FROM gram JOIN win ON gram.g = win.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS k FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN size p ON p.doc_id = x.doc_id JOIN size q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""

_KEY = f"""translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_UPPER.lower()}')"""
OP8 = f"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut
), keyed AS (
  SELECT doc_id, i, line, {_KEY} AS k FROM lines
), first AS (
  SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (WHERE holder <> doc_id)::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN first USING (k) GROUP BY doc_id
"""

OP9 = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::bigint AS n FROM pages
), best AS (
  SELECT h, max(page_id) AS keeper FROM page WHERE n >= 1000 GROUP BY h
)
SELECT page_id, n AS payload_bytes, sha1(page.h) AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM page LEFT JOIN best ON page.h = best.h AND n >= 1000
"""



def _divergence(shares: list[str], reference: list[float]) -> str:
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN 0.5::double * {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
    return " + ".join(f"{half(p, f'{q!r}::double')} + {half(f'{q!r}::double', p)}" for p, q in zip(shares, reference))


_REFERENCE = {k: [x / sum(v) for x in v] for k, v in CLASS_REFERENCE.items()}
_CLASS = [f"(greatest({c}, 0)::double / greatest(whole, 1))" for c in ("letters", "upper", "digits", "space", "marks", "odd", "beyond")]
_CLASS_JS = "CASE l " + " ".join(f"WHEN '{k}' THEN {_divergence(_CLASS, v)}" for k, v in _REFERENCE.items()) + " ELSE 0 END"
_BAND = [f"(b{i}::double / n_words)" for i in range(BANDS)] + [f"((n_words - {' - '.join(f'b{i}' for i in range(BANDS))})::double / n_words)"]
_COMMON_JS = "CASE l " + " ".join(f"WHEN '{k}' THEN {_divergence(_BAND, [v * p for p in BAND_PARTS] + [1 - v])}" for k, v in COMMON_SHARE.items()) + " ELSE 0 END"
_WIDTH = 20 // BANDS


def _in_band(i: int) -> str:
    of = lambda words: ", ".join(f"'{w}'" for w in words[i * _WIDTH : (i + 1) * _WIDTH])
    return "CASE l " + " ".join(f"WHEN '{k}' THEN len(list_filter(w, lambda x: x IN ({of(v)})))" for k, v in COMMON_WORDS.items()) + f" ELSE 0 END AS b{i}"




def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(rest, '{pattern}'))"


_UPPERS, _DIGITS, _SYMBOLS, _BEYOND = (_count(x) for x in ("[A-Z]", "[0-9]", "[#*$%&|<>]", r"[^\x00-\x7F]"))
_MARKS = _count(r"""[.,;:!?''"()\-]""")
_ODD = _count(r"[\x00-\x08\x0E-\x1F#*$%&|<>+/=@\[\]\\^_`{}~\x7F]")
OP6 = f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t, lower(regexp_extract(coalesce(lang, ''), '^[^-_]*')) AS l, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         regexp_replace(coalesce(text, ''), '[a-z\\x20]+', '', 'g') AS rest, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), facts AS (
  SELECT doc_id, l, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
         length(t) AS n_chars, {_SYMBOLS}::bigint AS n_symbols, coalesce(repeated.n, 0)::bigint AS n_repeat_words,
         (len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::bigint AS n_dup_lines,
         {_UPPERS} AS upper, {_DIGITS} AS digits, {_MARKS} AS marks, {_ODD} AS odd, {_BEYOND} AS beyond,
         {', '.join(_in_band(i) for i in range(BANDS))}
  FROM doc LEFT JOIN repeated USING (doc_id)
), space AS (
  SELECT *, n_chars - word_chars AS space, n_chars - (upper + digits + n_chars - word_chars + marks + odd + beyond) AS letters FROM facts
), whole AS (
  SELECT *, greatest(letters, 0) + upper + digits + space + marks + odd + beyond AS whole, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM space
), judged AS (
  SELECT *, CASE WHEN n_chars >= 200 THEN {_CLASS_JS} ELSE 0 END AS class_js, CASE WHEN n_words >= 50 THEN {_COMMON_JS} ELSE 0 END AS common_js FROM whole
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND class_js + common_js <= {MAX_DISTANCE**2!r}::double AS kept FROM judged
"""

def _op12(rounds: int = 5) -> str:
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT id, vec_id, v, min(pair).c AS cluster, min(pair).d AS distance FROM (
    SELECT id, vec_id, kept.v, {{'d': list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - p.v[i]) * (kept.v[i] - p.v[i])))::bigint, 'c': p.c}} AS pair
    FROM kept, c{t} p) GROUP BY id, vec_id, v
)""")
        if t < rounds:
            steps.append(f"""
m{t} AS (
  SELECT cluster, i, sum(x)::bigint AS s, count(*)::bigint AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY cluster, i
), c{t + 1} AS MATERIALIZED (
  SELECT c, coalesce(w, v) AS v FROM c{t} LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM m{t} GROUP BY cluster) ON c = cluster
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::int AS c, v
  FROM (SELECT sha256('2:' || coalesce(vec_id::varchar, '')) AS h, v FROM kept ORDER BY h, v LIMIT 40)
), {",".join(steps)}, balls AS (
  SELECT cluster, sum(distance)::bigint AS cluster_inertia FROM a{rounds} GROUP BY cluster
)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(distance)::bigint FROM a{rounds}) AS inertia, sha256(array_to_string(p.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN balls USING (cluster) JOIN c{rounds} p ON p.c = cluster
"""


def _op13(levels: int = 6, top: int = 4) -> str:
    """Trees of up to 16 ** levels documents a source and 16 ** top sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar)::varchar || ':' || {c}::varchar END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps, rises = [], []

    def tree(name: str, height: int) -> None:
        # Level k + 1 joins runs of 16 where a tree has several nodes, and takes over the node where it has one.
        for k in range(height):
            steps.append(f"""
{name}r{k} AS MATERIALIZED (
  SELECT s, p // 16 AS p, any_value(n) AS n, string_agg(d, '' ORDER BY p) AS run FROM {name}{k} GROUP BY s, p // 16
), {name}{k + 1} AS MATERIALIZED (
  SELECT s, p, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS d FROM {name}r{k}
)""")

    def rise(name: str, height: int, key: str, at: str) -> None:
        for k in range(height):
            prior = f"t{len(rises)}"
            cut = f"64 * ((t.{at} // {16**k}) % 16)"
            left, right = (f"CASE WHEN r.n = 1 THEN '' ELSE {x} END" for x in (f"substr(run, 1, {cut})", f"substr(run, {cut} + 65)"))
            node = f"CASE WHEN r.n = 1 THEN folded ELSE sha256(({left}) || folded || ({right})) END"
            rises.append(f"""
t{len(rises) + 1} AS MATERIALIZED (
  SELECT t.* REPLACE (proof || ({left}) || ({right}) AS proof, {node} AS folded)
  FROM {prior} t JOIN {name}r{k} r ON r.s = t.{key} AND r.p = t.{at} // {16 ** (k + 1)}
)""")

    tree("v", levels)
    steps.append(f"""
w0 AS MATERIALIZED (
  SELECT 0 AS s, row_number() OVER (ORDER BY s) - 1 AS p, count(*) OVER () AS n, d, s AS source FROM v{levels}
)""")
    tree("w", top)
    rise("v", levels, "s", "p")
    rise("w", top, "zero", "q")
    return f"""
WITH crc AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(b))
), doc AS MATERIALIZED (
  SELECT *, CASE WHEN doc_id IS NULL THEN text WHEN xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0
         THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END AS shown FROM documents, crc
), leaf AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, {leaf("text")} AS d, {leaf("shown")} AS folded FROM doc
), v0 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY s) AS n FROM leaf
), {",".join(steps)}, t0 AS MATERIALIZED (
  SELECT doc_id, v0.s, v0.p, 0 AS zero, w0.p AS q, v0.d AS leaf, w0.d AS subroot, '' AS proof, folded FROM v0 JOIN w0 ON w0.source = v0.s
), {",".join(rises)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM t{levels + top}, w{top}
"""


ORACLES = {"op13_merkle_manifest": _op13(), "op12_ball_kmeans": _op12(), "op6_quality": OP6, "op1_decontamination": OP1, "op5_ngram_join": OP5, "op8_line_dedup": OP8, "op9_warc": OP9}
