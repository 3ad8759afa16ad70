"""DuckDB SQL with the results of plans/queries.py."""

from __future__ import annotations

import math

POOL = """pool AS (
  SELECT doc_id, 'pool/' || lpad(doc_id::varchar, 9, '0') || '.txt' AS path,
         CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN doc_id % 3 = 0 THEN 'fake' ELSE 'real' END AS class_name,
         strlen(text)::bigint AS size_bytes, md5(text) AS md5, source
  FROM documents
)"""


def _in_levels(rows: str, label: str, order: str, run: int = 1024, levels: int = 3) -> str:
    """The digest of lines in levels, for up to run ** levels rows."""
    out = f"l0 AS (SELECT row_number() OVER (ORDER BY {order}, line) - 1 AS p, sha256(line) AS d FROM (SELECT {order}, split || '/' || {label} || '/' || md5 AS line FROM {rows}))"
    for k in range(levels):  # the first level always counts, others only where there are several nodes
        joined = "sha256(string_agg(d, '' ORDER BY p))"
        keep = joined if not k else f"CASE WHEN (SELECT count(*) FROM l{k}) > 1 THEN {joined} ELSE any_value(d) END"
        out += f", l{k + 1} AS (SELECT p // {run} AS p, {keep} AS d FROM l{k} GROUP BY p // {run})"
    return out + f" SELECT (SELECT count(*) FROM l0)::bigint AS n_rows, d AS fingerprint FROM l{levels}"


PRIO = "CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"
DECIDED = POOL + f""", ranked AS (
  SELECT *, row_number() OVER w AS rk, first_value(split) OVER w AS first_split,
         min(class_name) OVER (PARTITION BY md5) AS lo, max(class_name) OVER (PARTITION BY md5) AS hi
  FROM pool WINDOW w AS (PARTITION BY md5 ORDER BY {PRIO}, lower(path), path)
), decided AS (
  SELECT *, CASE WHEN lo <> hi THEN 'cross_class' WHEN rk = 1 THEN 'kept' WHEN split = first_split THEN 'same_split' ELSE 'cross_split' END AS decision
  FROM ranked
)"""
GRID = "grid AS (SELECT * FROM (VALUES ('train'), ('validation'), ('test')) s(split), (VALUES ('real'), ('fake')) c(class_name))"
VOTES = ", ".join(f"CASE WHEN sum(((h >> {59 - i}) & 1) * 2 - 1) > 0 THEN {1 << (59 - i)}::bigint ELSE 0::bigint END" for i in range(60))
SIMHASH = f"""word AS (
  SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) AS w FROM documents
), digest AS (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::bigint AS h FROM word WHERE w <> ''
), simhash AS (
  SELECT doc_id, list_sum([{VOTES}])::bigint AS hash FROM digest GROUP BY doc_id
)"""
HASHED = f"{POOL}, {SIMHASH}, hashed AS (SELECT pool.*, simhash.hash FROM pool LEFT JOIN simhash USING (doc_id))"
COEF = """coef AS (
  SELECT vec_id AS key, CASE vec_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, low,
         list_sort(low)[32] AS med
  FROM (SELECT vec_id, embedding[2:64] AS low FROM embeddings)
), chash AS (
  SELECT key, split, list_sum([CASE WHEN low[i] > med THEN (1::bigint << (63 - i)) ELSE 0::bigint END FOR i IN range(1, 64)])::bigint AS hash FROM coef
)"""
PRED = "pred AS (SELECT quality::int AS actual, toxic::int AS predicted FROM labels)"
CELLS = f"""{PRED}, cells AS (
  SELECT a.i AS actual, p.i AS predicted, count(pred.actual)::bigint AS n
  FROM (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) p(i) LEFT JOIN pred ON pred.actual = a.i AND pred.predicted = p.i
  GROUP BY a.i, p.i
)"""
DIV = "CASE WHEN {1} = 0 THEN 0::double ELSE {0}::double / {1}::double END".format
CLASSES = f"""{CELLS}, sums AS (
  SELECT i AS index, (sum(n) FILTER (WHERE actual = i AND predicted = i))::bigint AS tp,
         (sum(n) FILTER (WHERE actual = i))::bigint AS support, (sum(n) FILTER (WHERE predicted = i))::bigint AS called
  FROM cells, (VALUES (0), (1)) k(i) GROUP BY i
), pr AS (
  SELECT index, {DIV('tp', 'called')} AS precision, {DIV('tp', 'support')} AS recall, support FROM sums
), classes AS (
  SELECT index, precision, recall, {DIV('(2 * precision * recall)', '(precision + recall)')} AS f1, support FROM pr
)"""
HISTORY = """hist AS (
  SELECT * FROM (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::int AS epoch, value AS val_loss FROM events)
  WHERE val_loss IS NOT NULL
)"""
SOURCES = POOL + ", groups AS (SELECT class_name, source, count(*)::bigint AS n FROM pool GROUP BY ALL)"
SHARED = POOL + ", shared AS (SELECT source, count(*) FILTER (WHERE class_name = 'real')::bigint AS n_real, count(*) FILTER (WHERE class_name = 'fake')::bigint AS n_fake FROM pool GROUP BY source)"
MANIFEST = HASHED + """, manifest AS (SELECT * FROM hashed WHERE doc_id % 4 <> 0), disk AS (
  SELECT doc_id, path, split, class_name, CASE WHEN doc_id % 13 <> 4 THEN hash END AS hash, CASE WHEN doc_id % 11 = 5 THEN md5(md5 || 'x') ELSE md5 END AS md5 FROM hashed WHERE doc_id % 7 <> 3
)"""
WALK = """o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || source), source) AS i, count(*) OVER () AS k FROM shared),
        tot AS (SELECT sum(n_real)::double AS r, sum(n_fake)::double AS f FROM shared),
        w AS (SELECT greatest(round_even(r * 0.7::double, 0), 1) AS r0, greatest(round_even(r * 0.15::double, 0), 1) AS r1, greatest(r - round_even(r * 0.7::double, 0) - round_even(r * 0.15::double, 0), 1) AS r2,
                     greatest(round_even(f * 0.7::double, 0), 1) AS f0, greatest(round_even(f * 0.15::double, 0), 1) AS f1, greatest(f - round_even(f * 0.7::double, 0) - round_even(f * 0.15::double, 0), 1) AS f2 FROM tot),
        walk(i, s, a0, a1, a2, b0, b1, b2) AS (
          SELECT 0::bigint, -1, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double
          UNION ALL
          SELECT i, s, a0 + CASE WHEN s = 0 THEN n_real ELSE 0 END, a1 + CASE WHEN s = 1 THEN n_real ELSE 0 END, a2 + CASE WHEN s = 2 THEN n_real ELSE 0 END,
                 b0 + CASE WHEN s = 0 THEN n_fake ELSE 0 END, b1 + CASE WHEN s = 1 THEN n_fake ELSE 0 END, b2 + CASE WHEN s = 2 THEN n_fake ELSE 0 END
          FROM (SELECT i, n_real, n_fake, a0, a1, a2, b0, b1, b2, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS s
                FROM (SELECT *, CASE WHEN must AND a0 + b0 > 0 THEN 1e300 ELSE (a0 + n_real) / r0 + (b0 + n_fake) / f0 END AS c0,
                             CASE WHEN must AND a1 + b1 > 0 THEN 1e300 ELSE (a1 + n_real) / r1 + (b1 + n_fake) / f1 END AS c1,
                             CASE WHEN must AND a2 + b2 > 0 THEN 1e300 ELSE (a2 + n_real) / r2 + (b2 + n_fake) / f2 END AS c2
                      FROM (SELECT o.i, n_real, n_fake, a0, a1, a2, b0, b1, b2, w.*, ((a0 + b0 = 0)::int + (a1 + b1 = 0)::int + (a2 + b2 = 0)::int) AS e, k,
                                   e > 0 AND k - o.i < e AS must
                            FROM walk JOIN o ON o.i = walk.i + 1 CROSS JOIN w))))"""
SEED = "('0x' || substr(sha256('42|' || split || '|' || class_name), 1, 12))::bigint"
HUMAN = "CASE WHEN {0} < 1024 THEN printf('%.1f B', {0}) WHEN {0} / 1024 < 1024 THEN printf('%.1f KB', {0} / 1024) WHEN {0} / 1024 / 1024 < 1024 THEN printf('%.1f MB', {0} / 1024 / 1024) WHEN {0} / 1024 / 1024 / 1024 < 1024 THEN printf('%.1f GB', {0} / 1024 / 1024 / 1024) ELSE printf('%.1f TB', {0} / 1024 / 1024 / 1024 / 1024) END".format
UPLOADS = """uploads AS (
  SELECT doc_id, 'u' || doc_id || (['.jpg', '.PNG', '.txt', '', '.jpeg', '.bmp'])[doc_id % 6 + 1] AS filename,
         CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 17 = 0 THEN 30000000 ELSE doc_id * 7 + 1 END AS size_bytes,
         CASE WHEN doc_id % 19 <> 0 THEN doc_id * 31 % 14000 END AS width, doc_id * 17 % 9000 + 20 AS height,
         CASE WHEN doc_id % 5 = 0 THEN 'GIF' ELSE 'JPEG' END AS format
  FROM documents
)"""
EXT = "CASE WHEN strpos({0}, '.') = 0 THEN '' ELSE '.' || lower(regexp_extract({0}, '[^.]*$')) END".format


def _near(values: str, threshold: int) -> str:
    return f"SELECT x.key AS a, y.key AS b, bit_count(xor(x.hash, y.hash))::int AS distance FROM {values} x JOIN {values} y ON x.key < y.key WHERE bit_count(xor(x.hash, y.hash)) <= {threshold}"


def _greedy(threshold: int) -> str:
    """Survivors by walking candidates in order, one at a time; state is the list of kept hashes."""
    return f"""
WITH RECURSIVE {HASHED}, {DECIDED.split("), ", 1)[1].replace("FROM pool", "FROM hashed")}, ord AS (
  SELECT path, hash, row_number() OVER (ORDER BY {PRIO}, lower(path), path) AS i FROM decided WHERE decision = 'kept' AND hash IS NOT NULL
), near AS (
  SELECT x.i AS earlier, y.i AS later FROM ord x JOIN ord y ON x.i < y.i WHERE bit_count(xor(x.hash, y.hash)) <= {threshold}
), later AS (
  SELECT later, list(earlier) AS earlier, row_number() OVER (ORDER BY later) AS k FROM near GROUP BY later
), walk(k, gone) AS (
  SELECT 0::bigint, []::bigint[]
  UNION ALL
  SELECT walk.k + 1, CASE WHEN len(list_filter(l.earlier, lambda e: NOT list_contains(walk.gone, e))) > 0 THEN list_append(walk.gone, l.later) ELSE walk.gone END
  FROM walk JOIN later l ON l.k = walk.k + 1
), lost AS (
  SELECT unnest(gone) AS i FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)
)
"""


_LEFT = "(SELECT count(*) FROM {0}) = 0".format
ORACLES: dict[str, str] = {
    "exact_dedup_stats": f"""WITH {DECIDED} SELECT count(*)::bigint AS scanned, count(*) FILTER (WHERE md5 IS NULL)::bigint AS unreadable,
        count(*) FILTER (WHERE decision = 'same_split')::bigint AS exact_same_class_same_split, count(*) FILTER (WHERE decision = 'cross_split')::bigint AS exact_cross_split,
        count(*) FILTER (WHERE decision = 'cross_class')::bigint AS exact_cross_class, count(*) FILTER (WHERE decision <> 'kept')::bigint AS removed_total FROM decided""",
    "exact_dedup_survivors": f"WITH {DECIDED} SELECT path, split, class_name, md5 FROM decided WHERE decision = 'kept'",
    "exact_dedup_decisions": f"WITH {DECIDED} SELECT path, decision FROM decided",
    "split_class_counts": f"WITH {POOL}, {GRID} SELECT grid.split, grid.class_name, count(path)::bigint AS n FROM grid LEFT JOIN pool USING (split, class_name) GROUP BY ALL",
    "split_class_rollup": f"WITH {POOL} SELECT CASE WHEN grouping(split) = 1 THEN '(all)' ELSE split END AS split, CASE WHEN grouping(class_name) = 1 THEN '(all)' ELSE class_name END AS class_name, count(*)::bigint AS n FROM pool GROUP BY ROLLUP (split, class_name)",
    "class_totals_grouping_sets": f"WITH {POOL} SELECT CASE WHEN grouping(split) = 1 THEN '(all)' ELSE split END AS split, CASE WHEN grouping(class_name) = 1 THEN '(all)' ELSE class_name END AS class_name, count(*)::bigint AS n FROM pool GROUP BY GROUPING SETS ((split), (class_name), ())",
    "size_summary": f"WITH {POOL}, s AS (SELECT count(*)::bigint AS n, sum(size_bytes)::bigint AS total_bytes FROM pool) SELECT n, total_bytes, {HUMAN('total_bytes::double')} AS human FROM s",
    "confusion_matrix": f"WITH {CELLS} SELECT actual, predicted, n FROM cells",
    "per_class_metrics": f"WITH {CLASSES} SELECT index, precision, recall, f1, support FROM classes",
    "macro_metrics": f"""WITH {CLASSES} SELECT (SELECT count(*) FROM pred)::bigint AS num_samples, {DIV('(SELECT count(*) FROM pred WHERE actual = predicted)', '(SELECT count(*) FROM pred)')} AS accuracy,
        avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM classes""",
    "positive_class_metrics": f"WITH {CLASSES} SELECT 'fake' AS positive_class, precision, recall, f1, support FROM classes WHERE index = 1",
    "row_share": f"WITH {CELLS}, s AS (SELECT actual, predicted, n, {DIV('n', 'sum(n) OVER (PARTITION BY actual)')} AS share FROM cells) SELECT actual, predicted, n, share, round_even(share * 3, 0)::int AS tone FROM s",
    "readiness": f"WITH {POOL}, {GRID}, c AS (SELECT grid.split, grid.class_name, count(path) AS n FROM grid LEFT JOIN pool USING (split, class_name) GROUP BY ALL) SELECT 'training' AS what, bool_and(n > 0) AS ready FROM c WHERE split <> 'test' UNION ALL SELECT 'evaluation', bool_and(n > 0) FROM c WHERE split = 'test'",
    "derived_seeds": f"WITH {POOL} SELECT DISTINCT split, class_name, {SEED} AS seed FROM pool",
    "seeded_cap": f"WITH {POOL} SELECT path FROM pool ORDER BY md5('42|' || path), path LIMIT 50",
    "stratified_quota_sample": f"""WITH {POOL}, r AS (SELECT split, class_name, path, row_number() OVER (PARTITION BY split, class_name ORDER BY md5({SEED}::varchar || '|' || path), path)::int AS rank FROM pool)
        SELECT split, class_name, path, rank FROM r WHERE rank <= CASE split WHEN 'train' THEN 20 ELSE 5 END""",
    "even_row_sample": """WITH v AS (SELECT conv_id, (count(*) * 7)::bigint AS total FROM conversations GROUP BY conv_id)
        SELECT DISTINCT conv_id, CASE WHEN total <= 10 THEN i ELSE round_even(i::double * ((total - 1)::double / 9::double), 0)::int END AS frame_index
        FROM v, (SELECT unnest(range(0, 10))::int AS i) WHERE i < total""",
    "prefix_sum_split": f"""WITH {SOURCES}, c AS (SELECT *, sum(n) OVER (PARTITION BY class_name ORDER BY md5('42|' || source), source) AS cum, sum(n) OVER (PARTITION BY class_name) AS total FROM groups),
        t AS (SELECT *, cum - n AS before, round_even(total::double * 0.7::double, 0) AS tr, round_even(total::double * 0.15::double, 0) AS va FROM c),
        g AS (SELECT *, CASE WHEN tr <= 0 THEN 0 ELSE coalesce(min(CASE WHEN cum >= tr THEN cum END) OVER (PARTITION BY class_name), total) END AS got FROM t)
        SELECT class_name, source, n, CASE WHEN before < tr THEN 'train' WHEN before - got < va THEN 'validation' ELSE 'test' END AS split FROM g""",
    "split_targets": f"""WITH {POOL}, t AS (SELECT class_name, count(*)::bigint AS total FROM pool GROUP BY class_name), r AS (SELECT *, round_even(total::double * 0.7::double, 0)::bigint AS train, round_even(total::double * 0.15::double, 0)::bigint AS validation FROM t)
        SELECT class_name, total, train, validation, total - train - validation AS test FROM r""",
    "group_outer_merge": f"WITH {SHARED} SELECT source, n_real, n_fake FROM shared",
    "grouped_greedy_split": f"""WITH RECURSIVE {SHARED}, {WALK}
        SELECT source, n_real, n_fake, (['train', 'validation', 'test'])[s + 1] AS split FROM walk JOIN o USING (i)""",
    "leakage_audit": f"WITH {POOL} SELECT md5, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM pool GROUP BY md5 HAVING count(DISTINCT split) > 1",
    "leakage_summary": f"WITH {POOL}, g AS (SELECT count(DISTINCT split) AS k FROM pool GROUP BY md5) SELECT count(*)::bigint AS group_count, count(*) FILTER (WHERE k > 1)::bigint AS leaked_count, count(*) FILTER (WHERE k > 1) = 0 AS ok FROM g",
    "split_intersections": f"""WITH {POOL}, g AS (SELECT DISTINCT source, split FROM pool)
        SELECT p.a || '|' || p.b AS pair, (SELECT count(*) FROM g x JOIN g y USING (source) WHERE x.split = p.a AND y.split = p.b)::bigint AS shared
        FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(a, b)""",
    "union_all_splits": f"WITH {POOL} SELECT CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS split_ord, path FROM pool",
    "hash_from_array": f"WITH {COEF} SELECT key, hash, lpad(lower(hex(hash)), 16, '0') AS hash_hex FROM chash",
    "word_hashes": f"WITH {SIMHASH} SELECT doc_id, hash FROM simhash",
    "band_keys": f"WITH {COEF} SELECT key, i::int AS band, (hash >> (48 - 16 * i)) & 65535 AS part FROM chash, (SELECT unnest(range(0, 4)) AS i)",
    "hamming_pairs_banded": f"""WITH {SIMHASH}, t AS (SELECT doc_id, hash, text FROM simhash JOIN documents USING (doc_id)), v AS (SELECT min(doc_id) AS key, hash, text FROM t GROUP BY hash, text)
        SELECT a, b, distance, false AS is_copy FROM ({_near('v', 3)})
        UNION ALL SELECT v.key AS a, t.doc_id AS b, 0 AS distance, true AS is_copy FROM v JOIN t ON t.hash = v.hash AND t.text = v.text AND t.doc_id <> v.key""",
    "hamming_pairs_wide": f"WITH {COEF} {_near('chash', 15)}",
    "min_cross_split_distance": f"""WITH {COEF} SELECT p.a || '|' || p.b AS pair, coalesce((SELECT min(bit_count(xor(x.hash, y.hash))) FROM chash x, chash y WHERE x.split = p.a AND y.split = p.b), -1)::bigint AS distance
        FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(a, b)""",
    "connected_components_near": f"""WITH RECURSIVE {SIMHASH}, v AS (SELECT doc_id AS key, hash FROM simhash), e AS ({_near('v', 7)}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(a, b) AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a""",
    "manifest_missing": f"WITH {MANIFEST} SELECT path FROM manifest WHERE path NOT IN (SELECT path FROM disk)",
    "manifest_extra": f"WITH {MANIFEST} SELECT path FROM disk WHERE path NOT IN (SELECT path FROM manifest)",
    "manifest_md5_mismatch": f"WITH {MANIFEST} SELECT m.path, m.md5 AS expected, d.md5 AS found FROM manifest m JOIN disk d USING (path) WHERE m.md5 <> d.md5",
    "extra_duplicates_manifest": f"WITH {MANIFEST}, x AS (SELECT * FROM disk WHERE path NOT IN (SELECT path FROM manifest)) SELECT path FROM x WHERE EXISTS (SELECT 1 FROM manifest m WHERE m.md5 = x.md5 OR bit_count(xor(m.hash, x.hash)) <= 3)",
    "manifest_projection": f"WITH {HASHED} SELECT split || '_' || class_name || '_' || lpad(doc_id::varchar, 9, '0') || '.txt' AS image_id, class_name AS label, split, split AS official_split, path AS source_file, size_bytes AS bytes, md5, lpad(lower(hex(hash)), 16, '0') AS phash_hex FROM hashed",
    "revalidation_checks": f"""WITH {MANIFEST}, {GRID}, c AS (SELECT grid.split, grid.class_name, count(path) AS n FROM grid LEFT JOIN manifest USING (split, class_name) GROUP BY ALL),
        x AS (SELECT * FROM disk WHERE path NOT IN (SELECT path FROM manifest))
        SELECT 'exact_counts_match_quota' AS check_name, (SELECT bool_and(n = CASE split WHEN 'train' THEN 20 ELSE 4 END) FROM c) AS passed
        UNION ALL SELECT 'classes_balanced_in_every_split', (SELECT bool_and(b) FROM (SELECT min(n) = max(n) AS b FROM c GROUP BY split))
        UNION ALL SELECT 'no_exact_duplicate_across_splits', NOT EXISTS (SELECT 1 FROM manifest GROUP BY md5 HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'no_item_under_both_labels', NOT EXISTS (SELECT 1 FROM manifest GROUP BY md5 HAVING count(DISTINCT class_name) > 1)
        UNION ALL SELECT 'split_maps_to_one_official_split', (SELECT count(DISTINCT split) = 3 FROM manifest)
        UNION ALL SELECT 'no_near_duplicate_across_splits', NOT EXISTS (SELECT 1 FROM manifest a JOIN manifest b ON a.split < b.split WHERE bit_count(xor(a.hash, b.hash)) <= 3)
        UNION ALL SELECT 'all_files_present', NOT EXISTS (SELECT 1 FROM manifest WHERE path NOT IN (SELECT path FROM disk))
        UNION ALL SELECT 'all_digests_match', NOT EXISTS (SELECT 1 FROM manifest m JOIN disk d USING (path) WHERE m.md5 <> d.md5)
        UNION ALL SELECT 'all_files_readable', NOT EXISTS (SELECT 1 FROM disk JOIN manifest USING (path) WHERE disk.hash IS NULL)
        UNION ALL SELECT 'no_unexpected_files', NOT EXISTS (SELECT 1 FROM x)
        UNION ALL SELECT 'no_extra_duplicates_manifest', NOT EXISTS (SELECT 1 FROM x JOIN manifest m ON m.md5 = x.md5 OR bit_count(xor(m.hash, x.hash)) <= 3)""",
    "dataset_fingerprint": f"WITH {POOL}, {_in_levels('pool', 'class_name', 'path')}",
    "dataset_summary": f"""WITH {POOL} SELECT split, count(*) FILTER (WHERE class_name = 'real')::bigint AS real, count(*) FILTER (WHERE class_name = 'fake')::bigint AS fake, count(*)::bigint AS total, sum(size_bytes)::bigint AS bytes,
        count(*)::double / (SELECT count(*) FROM pool)::double AS share FROM pool GROUP BY split""",
    "status_crosscheck": f"""WITH {MANIFEST}, {GRID}, r AS (SELECT split, class_name, (SELECT count(*) FROM manifest m WHERE m.split = grid.split AND m.class_name = grid.class_name)::bigint AS reported,
        (SELECT count(*) FROM disk d WHERE d.split = grid.split AND d.class_name = grid.class_name)::bigint AS found FROM grid) SELECT *, reported = found AS agrees FROM r""",
    "provenance_flatten": """SELECT row_number() OVER (ORDER BY conv_id, turn, role)::bigint AS manifest_index, conv_id, turn AS frame_index, role, (count(*) OVER (PARTITION BY conv_id))::bigint AS video_frame_count,
        'c' || conv_id || '__frame_' || lpad(turn::varchar, 6, '0') || '.png' AS frame_name FROM conversations""",
    "extraction_stats": "SELECT count(*)::bigint AS total, count(*) FILTER (WHERE role = 'user')::bigint AS by_user, count(*) FILTER (WHERE role = 'assistant')::bigint AS by_assistant, count(*) FILTER (WHERE length(text) = 0)::bigint AS skipped FROM conversations",
    "history_best_epoch": f"WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) AS k FROM hist) SELECT run_id, epoch AS best_epoch, val_loss AS best_loss FROM r WHERE k = 1",
    "history_early_stop": f"""WITH {HISTORY}, b AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM hist),
        i AS (SELECT *, sum((best IS NULL OR val_loss < best)::int) OVER (PARTITION BY run_id ORDER BY epoch) AS island FROM b),
        s AS (SELECT *, row_number() OVER (PARTITION BY run_id, island ORDER BY epoch) - 1 AS streak FROM i),
        g AS (SELECT run_id, min(epoch) FILTER (WHERE streak >= 3) AS stop_epoch, max(epoch) AS last FROM s GROUP BY run_id) SELECT run_id, stop_epoch, coalesce(stop_epoch, last) AS epochs_run FROM g""",
    "history_best_so_far": f"WITH {HISTORY}, b AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM hist) SELECT *, best_before IS NULL OR val_loss < best_before AS improved FROM b",
    "history_segments": f"WITH {HISTORY}, s AS (SELECT run_id, lag(epoch) OVER w AS x0, lag(val_loss) OVER w AS y0, epoch AS x1, val_loss AS y1 FROM hist WINDOW w AS (PARTITION BY run_id ORDER BY epoch)) SELECT * FROM s WHERE x0 IS NOT NULL",
    "history_rescaled": f"WITH {HISTORY}, w AS (SELECT *, max(epoch) OVER p AS m, min(val_loss) OVER p AS lo, max(val_loss) OVER p AS hi FROM hist WINDOW p AS (PARTITION BY run_id)) SELECT run_id, epoch, (epoch - 1)::double / greatest(m - 1, 1)::double AS x, {DIV('(val_loss - lo)', '(hi - lo)')} AS y FROM w",
    "history_consistency": f"""WITH {HISTORY}, g AS (SELECT run_id, min(epoch) AS said_best, min(val_loss) AS lo FROM hist GROUP BY run_id), b AS (SELECT run_id, epoch, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) AS k FROM hist)
        SELECT run_id, true AS same_count, b.epoch = said_best AS same_best, abs(lo - (lo + 0.0004::double)) <= 0.0005::double AS close_loss FROM g JOIN b USING (run_id) WHERE k = 1""",
    "weighted_epoch_means": f"""WITH {HISTORY}, r AS (SELECT run_id, round(val_loss)::double AS loss, (epoch % 8 + 1)::bigint AS n, epoch FROM hist)
        SELECT run_id, sum(loss * n) / greatest(sum(n), 1)::double AS mean_loss, sum(least(n, epoch % 5))::double / greatest(sum(n), 1)::double AS accuracy FROM r GROUP BY run_id""",
    "softmax_argmax": """WITH l AS (SELECT vec_id, list_transform(embedding, lambda v: v::double) AS x FROM embeddings), e AS (SELECT vec_id, x, list_max(x) AS m FROM l)
        SELECT vec_id, (list_position(x, m) - 1)::int AS label, round(1 / list_sum(list_transform(x, lambda v: exp(v - m))), 9) AS confidence FROM e""",
    "normalise_channels": "SELECT vec_id, i::int AS pixel, round((embedding[3 * i + 1]::double - 0.485::double) / 0.229::double, 9) AS r, round((embedding[3 * i + 2]::double - 0.456::double) / 0.224::double, 9) AS g, round((embedding[3 * i + 3]::double - 0.406::double) / 0.225::double, 9) AS b FROM embeddings, range(0, 21) t(i)",
    "array_value_range": "SELECT vec_id, list_min(embedding) AS low, list_max(embedding) AS high FROM embeddings",
    "validation_reject_reason": f"""WITH {UPLOADS}, e AS (SELECT *, {EXT('filename')} AS ext FROM uploads)
        SELECT doc_id, CASE WHEN ext = '' THEN 'no_extension' WHEN ext NOT IN ('.jpg', '.jpeg', '.png') THEN 'unsupported_extension' WHEN size_bytes <= 0 THEN 'empty' WHEN size_bytes > 26214400 THEN 'too_large'
        WHEN width IS NULL OR height IS NULL THEN 'undecodable' WHEN width < 32 OR height < 32 THEN 'too_small' WHEN width > 12000 OR height > 12000 THEN 'too_many_pixels' WHEN format NOT IN ('JPEG', 'PNG') THEN 'unsupported_format' END AS reject_reason FROM e""",
    "extension_parse": f"SELECT page_id, {EXT('url')} AS extension FROM pages",
    "group_key_parse": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE doc_id || '.x' END AS group_key FROM documents",
    "component_id_parse": "SELECT doc_id, source AS component_id, 1 AS frame_index FROM documents",
    "video_name_parse": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'manipulated' END AS kind, CASE WHEN doc_id % 3 < 2 THEN doc_id::varchar END AS sequence_id,
        CASE WHEN doc_id % 3 = 1 THEN n_chars::varchar END AS source_id FROM documents""",
    "human_bytes": f"WITH s AS (SELECT doc_id, pow(doc_id::double, 3) * 17 AS x FROM documents) SELECT doc_id, {HUMAN('x')} AS human FROM s",
    "size_kb": f"WITH {POOL} SELECT path, round_even(size_bytes / 1024.0::double, 2) AS size_kb FROM pool",
    "pair_flatten": "WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem) SELECT DISTINCT unnest([a || '_' || b, b || '_' || a]) AS pair FROM p",
}
_CAPPED = POOL + """, capped AS (
  SELECT path, class_name, source FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5(CASE class_name WHEN 'real' THEN '42|' ELSE '43|' END || path), path) AS k FROM pool) WHERE k <= 300
)"""
ORACLES["create_splits_per_class"] = f"""WITH {_CAPPED}, groups AS (SELECT class_name, source, count(*) AS n, CASE class_name WHEN 'real' THEN '42|' ELSE '43|' END || source AS o FROM capped GROUP BY class_name, source),
  c AS (SELECT *, sum(n) OVER (PARTITION BY class_name ORDER BY md5(o), source) AS cum, sum(n) OVER (PARTITION BY class_name) AS total FROM groups),
  t AS (SELECT *, cum - n AS before, round_even(total::double * 0.7::double, 0) AS tr, round_even(total::double * 0.15::double, 0) AS va FROM c),
  g AS (SELECT *, CASE WHEN tr <= 0 THEN 0 ELSE coalesce(min(CASE WHEN cum >= tr THEN cum END) OVER (PARTITION BY class_name), total) END AS got FROM t)
  SELECT class_name, CASE WHEN before < tr THEN 'train' WHEN before - got < va THEN 'validation' ELSE 'test' END AS split, sum(n)::bigint AS n FROM g GROUP BY ALL"""
ORACLES["create_splits_aligned"] = f"""WITH RECURSIVE {_CAPPED}, shared AS (SELECT source, count(*) FILTER (WHERE class_name = 'real')::bigint AS n_real, count(*) FILTER (WHERE class_name = 'fake')::bigint AS n_fake FROM capped GROUP BY source), {WALK}
  SELECT source, (['train', 'validation', 'test'])[s + 1] AS split, (n_real + n_fake)::bigint AS n FROM walk JOIN o USING (i)"""
ORACLES["problem_lines"] = "WITH r AS (" + ORACLES["validation_reject_reason"].replace("SELECT doc_id, CASE", "SELECT filename AS name, CASE") + ") SELECT reject_reason || ': ' || name AS problem, greatest((SELECT count(*) FROM r WHERE reject_reason IS NOT NULL) - 50, 0)::bigint AS more FROM r WHERE reject_reason IS NOT NULL ORDER BY reject_reason, name LIMIT 50"
ORACLES["status_messages"] = f"WITH {POOL}, {GRID}, c AS (SELECT grid.split, grid.class_name, count(path) AS n FROM grid LEFT JOIN pool USING (split, class_name) GROUP BY ALL) SELECT split, class_name, CASE WHEN n = 0 THEN 'Nothing is there yet.' WHEN n > 40 THEN printf('Ready with %d rows.', n) ELSE printf('Not ready: %d rows.', n) END AS message FROM c"
ORACLES["near_dedup_survivors"] = _greedy(7) + "SELECT path FROM ord WHERE i NOT IN (SELECT i FROM lost)"
_SAMPLE = _greedy(3) + f""", kept AS (
  SELECT h.* FROM ord JOIN hashed h USING (path) WHERE ord.i NOT IN (SELECT i FROM lost)
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY split, class_name ORDER BY md5({SEED}::varchar || '|' || path), path) AS rk FROM kept
), sel AS (
  SELECT * FROM drawn WHERE rk <= CASE split WHEN 'train' THEN 20 ELSE 4 END
)"""
ORACLES["full_build"] = _SAMPLE + " SELECT split || '_' || class_name || '_' || lpad(doc_id::varchar, 9, '0') || '.txt' AS image_id, class_name AS label, split, split AS official_split, path AS source_file, size_bytes AS bytes, md5, lpad(lower(hex(hash)), 16, '0') AS phash_hex FROM sel"
ORACLES["selection_audit_checks"] = _SAMPLE + f""", {GRID}, c AS (SELECT grid.split, grid.class_name, count(path) AS n FROM grid LEFT JOIN sel USING (split, class_name) GROUP BY ALL)
SELECT 'exact_counts_match_quota' AS check_name, (SELECT bool_and(n = CASE split WHEN 'train' THEN 20 ELSE 4 END) FROM c) AS passed
UNION ALL SELECT 'classes_balanced_in_every_split', (SELECT bool_and(b) FROM (SELECT min(n) = max(n) AS b FROM c GROUP BY split))
UNION ALL SELECT 'no_exact_duplicate_across_splits', NOT EXISTS (SELECT 1 FROM sel GROUP BY md5 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'no_item_under_both_labels', NOT EXISTS (SELECT 1 FROM sel GROUP BY md5 HAVING count(DISTINCT class_name) > 1)
UNION ALL SELECT 'split_maps_to_one_official_split', (SELECT count(DISTINCT split) = 3 FROM sel)
UNION ALL SELECT 'no_near_duplicate_across_splits', NOT EXISTS (SELECT 1 FROM sel a JOIN sel b ON a.split < b.split WHERE bit_count(xor(a.hash, b.hash)) <= 3)"""

ORACLES["identity_components"] = """SELECT node, component, n FROM (
  WITH e AS (SELECT o_custkey::bigint AS a, (o_orderkey + 10000000)::bigint AS b FROM orders), least_of AS (SELECT b, min(a) AS component FROM e GROUP BY b),
  nodes AS (SELECT DISTINCT a AS node, a AS component FROM e UNION SELECT b, component FROM least_of)
  SELECT node, component, (count(*) OVER (PARTITION BY component))::bigint AS n FROM nodes)"""
ORACLES["component_members"] = "WITH c AS (" + ORACLES["identity_components"] + ") SELECT component, string_agg(node::varchar, '_' ORDER BY node) AS members, count(*)::bigint AS n FROM c GROUP BY component"
ORACLES["component_assignment"] = "SELECT o_custkey::bigint AS sequence_id, (o_orderkey + 10000000)::bigint AS source_id, o_custkey::bigint AS component_id, true AS agrees FROM orders"
ORACLES["min_cross_split_distance_words"] = f"""WITH {HASHED} SELECT p.a || '|' || p.b AS pair, coalesce((SELECT min(bit_count(xor(x.hash, y.hash))) FROM hashed x, hashed y WHERE x.split = p.a AND y.split = p.b), -1)::bigint AS distance
  FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(a, b)"""
_STATS = f""", counters AS (
  SELECT count(*)::bigint AS scanned, count(*) FILTER (WHERE md5 IS NULL OR (decision = 'kept' AND hash IS NULL))::bigint AS unreadable,
         count(*) FILTER (WHERE decision = 'same_split' AND md5 IS NOT NULL)::bigint AS exact_same_class_same_split, count(*) FILTER (WHERE decision = 'cross_split' AND md5 IS NOT NULL)::bigint AS exact_cross_split,
         count(*) FILTER (WHERE decision = 'cross_class' AND md5 IS NOT NULL)::bigint AS exact_cross_class, (SELECT count(*) FROM lost)::bigint AS near_removed FROM decided
), stats AS (SELECT *, exact_same_class_same_split + exact_cross_split + exact_cross_class + near_removed AS removed_total FROM counters)"""
ORACLES["dedup_stats"] = _greedy(3) + _STATS + " SELECT * FROM stats"
_VERDICT = "SELECT bool_and(passed) AS passed, count(*) FILTER (WHERE NOT passed)::bigint AS n_failed, coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (WHERE NOT passed), '') AS failed FROM ({0})".format
ORACLES["selection_verdict"] = _VERDICT(ORACLES["selection_audit_checks"])
ORACLES["revalidation_verdict"] = _VERDICT(ORACLES["revalidation_checks"])
_CHECKS = ORACLES["selection_audit_checks"].removeprefix(_SAMPLE)
ORACLES["build_summary"] = _SAMPLE + _STATS + _CHECKS.split("\nSELECT 'exact_counts")[0] + ", checks AS (SELECT 'exact_counts" + _CHECKS.split("\nSELECT 'exact_counts")[1] + """)
SELECT stats.*, v.passed, v.n_failed, v.failed, (SELECT count(*) FROM sel)::bigint AS selected, (SELECT sum(size_bytes) FROM sel)::bigint AS selected_bytes
FROM stats, (SELECT bool_and(passed) AS passed, count(*) FILTER (WHERE NOT passed)::bigint AS n_failed, coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (WHERE NOT passed), '') AS failed FROM checks) v"""
ORACLES["manifest_unreadable"] = f"WITH {MANIFEST} SELECT path FROM manifest m JOIN disk d USING (path) WHERE d.hash IS NULL"
ORACLES["manifest_fingerprint"] = f"WITH {POOL}, m AS (SELECT *, split || '_' || class_name || '_' || lpad(doc_id::varchar, 9, '0') || '.txt' AS image_id FROM pool), {_in_levels('m', 'class_name', 'image_id')}"
ORACLES["dataset_status"] = f"""WITH {POOL}, c AS (
  SELECT 'raw' AS what, name, (SELECT count(*) FROM pool WHERE class_name = name)::bigint AS n FROM (VALUES ('real'), ('fake')) v(name)
  UNION ALL SELECT 'split', name, (SELECT count(*) FROM pool WHERE split = name)::bigint FROM (VALUES ('train'), ('validation'), ('test')) v(name)
  UNION ALL SELECT 'all', 'all', (SELECT count(*) FROM pool)::bigint) SELECT what, name, n, n > 0 AS present FROM c"""
ORACLES["any_image"] = f"WITH {POOL} SELECT name AS split, EXISTS (SELECT 1 FROM pool WHERE split = name) AS found FROM (VALUES ('train'), ('validation'), ('test'), ('none')) v(name)"
ORACLES["leakage_from_names"] = f"WITH {POOL} SELECT source AS component, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*)::bigint AS n_files, count(DISTINCT split) > 1 AS leaked FROM pool GROUP BY source"
ORACLES["provenance_manifest"] = "WITH f AS (" + ORACLES["provenance_flatten"] + """), r AS (
  SELECT conv_id, max(video_frame_count) AS total_frames, list({'manifest_index': manifest_index, 'frame_index': frame_index, 'label': role, 'rel_path': frame_name} ORDER BY manifest_index) AS frames FROM f GROUP BY conv_id)
SELECT 'c' || conv_id AS name, total_frames, to_json(frames)::varchar AS frames FROM r"""
ORACLES["extraction_by_label"] = """SELECT CASE WHEN grouping(role) = 1 THEN '(all)' ELSE role END AS label, count(DISTINCT conv_id)::bigint AS videos, count(*)::bigint AS frames, count(*) FILTER (WHERE length(text) = 0)::bigint AS skipped
  FROM conversations GROUP BY GROUPING SETS ((role), ())"""
_REPORT = f"""WITH {CLASSES}, report AS (
  SELECT (SELECT count(*) FROM pred)::bigint AS num_samples, {DIV('(SELECT count(*) FROM pred WHERE actual = predicted)', '(SELECT count(*) FROM pred)')} AS accuracy,
         avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, (SELECT string_agg(n::varchar, ',' ORDER BY actual, predicted) FROM cells) AS confusion_matrix,
         {", ".join(f"max({c}) FILTER (WHERE index = {i}) AS {c}_{k}" for i, k in enumerate(("real", "fake")) for c in ("precision", "recall", "f1", "support"))} FROM classes)"""
ORACLES["evaluation_report"] = _REPORT + " SELECT * FROM report"


def _rate(c: str) -> str:
    return f"printf('%.4f', round_even({c}, 4))"


_LINES = ["rpad('Test images', 17, ' ') || ': ' || num_samples", f"rpad('Accuracy', 17, ' ') || ': ' || {_rate('accuracy')}"]
_LINES += [f"rpad('{n} (fake)', 17, ' ') || ': ' || {_rate(n.lower() + '_fake')}" for n in ("Precision", "Recall", "F1")]
_LINES += [f"rpad('Macro {n}', 17, ' ') || ': ' || {_rate('macro_' + n)}" for n in ("precision", "recall", "f1")]
_LINES += [f"' {c}: precision=' || {_rate('precision_' + c)} || '  recall=' || {_rate('recall_' + c)} || '  f1=' || {_rate('f1_' + c)} || '  support=' || support_{c}" for c in ("real", "fake")]
_LINES += [f"'{c}' || lpad(split_part(confusion_matrix, ',', {2 * i + 1}), 10, ' ') || lpad(split_part(confusion_matrix, ',', {2 * i + 2}), 10, ' ')" for i, c in enumerate(("real", "fake"))]
ORACLES["evaluation_report_lines"] = _REPORT + ", x AS (SELECT [" + ", ".join(_LINES) + "] AS t FROM report) SELECT unnest(range(1, len(t) + 1))::int AS line, unnest(t) AS text FROM x"
ORACLES["first_rows"] = f"WITH {POOL} SELECT path, md5 FROM pool ORDER BY path LIMIT 25"
_BATCHES = "WITH {0}, r AS (SELECT path, row_number() OVER (ORDER BY {1}, path) - 1 AS k FROM pool) SELECT path, (k // 8)::bigint AS batch, (k % 8)::int AS place FROM r".format
ORACLES["sequential_batches"] = _BATCHES(POOL, "path")
ORACLES["shuffled_batches"] = _BATCHES(POOL, "md5('42|' || path)")
ORACLES["dct_hashes"] = """WITH n AS (SELECT unnest(range(0, 8)) AS i), px AS (
  SELECT vec_id, y.i AS y, x.i AS x, embedding[8 * y.i + x.i + 1]::double AS v FROM embeddings, n y, n x
), c AS (
  SELECT vec_id, u, w, s * (CASE WHEN u = 0 THEN sqrt(0.125) ELSE 0.5 END) * (CASE WHEN w = 0 THEN sqrt(0.125) ELSE 0.5 END) AS k
  FROM (SELECT vec_id, u.i AS u, w.i AS w, sum(v * cos(pi() * (2 * y + 1) * u.i / 16) * cos(pi() * (2 * x + 1) * w.i / 16)) AS s FROM px, n u, n w GROUP BY vec_id, u.i, w.i)
), low AS (SELECT vec_id, list(k ORDER BY u, w)[2:64] AS low FROM c GROUP BY vec_id), m AS (SELECT *, list_sort(low)[32] AS med FROM low)
SELECT vec_id AS key, lpad(lower(hex(list_sum([CASE WHEN low[i] > med THEN (1::bigint << (63 - i)) ELSE 0::bigint END FOR i IN range(1, 64)])::bigint)), 16, '0') AS hash_hex FROM m"""
ORACLES["pixel_planes"] = "SELECT vec_id, i::int AS pixel, embedding[3 * i + 3]::double / 255.0::double AS r, embedding[3 * i + 2]::double / 255.0::double AS g, embedding[3 * i + 1]::double / 255.0::double AS b FROM embeddings, (SELECT unnest(range(0, 21)) AS i)"


def _weights(name: str, size: int, target: int, kind: str) -> str:
    """A table (i, j, w): the weight of source place j in target place i."""
    scale, wide = size / target, max(size / target, 1.0)
    if kind == "area":
        raw = f"greatest(least((i + 1) * {scale!r}::double, j + 1) - greatest(i * {scale!r}::double, j), 0)"
    else:
        x, sinc = f"((j + 0.5::double - (i + 0.5::double) * {scale!r}::double) / {wide!r}::double)", "CASE WHEN {0} = 0 THEN 1 ELSE sin(pi() * {0}) / (pi() * {0}) END".format
        raw = f"greatest(0, 1 - abs({x}))" if kind == "bilinear" else f"CASE WHEN abs({x}) < 3 THEN ({sinc(x)}) * ({sinc(f'({x} / 3)')}) ELSE 0 END"
    return f"{name} AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM (SELECT i, j, {raw} AS w FROM range(0, {target}) a(i), range(0, {size}) b(j)))"


_PIXEL = "px AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, embedding[k + 1]::double AS v FROM embeddings, range(0, 64) r(k))"
_SIZES = [("area", 3, 5), ("bilinear", 6, 11), ("lanczos", 12, 4)]
ORACLES["resized_pictures"] = f"WITH {_PIXEL}, " + ", ".join(_weights(f"h{i}", 8, h, k) + ", " + _weights(f"w{i}", 8, w, k) for i, (k, h, w) in enumerate(_SIZES)) + " " + " UNION ALL ".join(
    f"SELECT vec_id, '{k}' AS kind, h{i}.i::int AS y, w{i}.i::int AS x, round(sum(h{i}.w * w{i}.w * v), 9) AS value FROM px JOIN h{i} ON h{i}.j = y JOIN w{i} ON w{i}.j = x WHERE h{i}.w <> 0 AND w{i}.w <> 0 GROUP BY ALL" for i, (k, _, _) in enumerate(_SIZES)
)
ORACLES["prepared_pictures"] = f"""WITH px AS (SELECT vec_id, k // 15 AS y, k // 3 % 5 AS x, k % 3 AS c, embedding[k + 1]::double * 200 + 127.5 AS v FROM embeddings, range(0, 60) r(k)),
  {_weights('h', 4, 6, 'bilinear')}, {_weights('w', 5, 7, 'bilinear')}, m AS (SELECT * FROM (VALUES (0, 0.485::double, 0.229::double), (1, 0.456::double, 0.224::double), (2, 0.406::double, 0.225::double)) t(c, mean, deviation))
  SELECT vec_id, c::int AS channel, h.i::int AS y, w.i::int AS x, round((sum(h.w * w.w * v) / 255 - any_value(mean)) / any_value(deviation), 9) AS value
  FROM px JOIN m USING (c) JOIN h ON h.j = y JOIN w ON w.j = x WHERE w.i < 6 GROUP BY vec_id, c, h.i, w.i"""
ORACLES["picture_hashes"] = f"""WITH {_PIXEL}, {_weights('w', 8, 32, 'lanczos')}, a AS (
    SELECT u, j, sum(w * cos(pi() * (2 * i + 1) * u / 64) * (CASE WHEN u = 0 THEN sqrt(1 / 32.0::double) ELSE sqrt(2 / 32.0::double) END)) AS k FROM w, range(0, 8) t(u) GROUP BY u, j
  ), c AS (SELECT vec_id, a.u AS u, b.u AS t, sum(a.k * b.k * v) AS k FROM px JOIN a ON a.j = y JOIN a b ON b.j = x GROUP BY ALL),
  low AS (SELECT vec_id, list(k ORDER BY u, t)[2:64] AS low FROM c GROUP BY vec_id), m AS (SELECT *, list_sort(low)[32] AS med FROM low)
  SELECT vec_id, lpad(lower(hex(list_sum([CASE WHEN low[i] > med THEN (1::bigint << (63 - i)) ELSE 0::bigint END FOR i IN range(1, 64)])::bigint)), 16, '0') AS hash_hex FROM m"""
_U = "(('0x' || substr(md5('42|' || vec_id || '|' || {0}), 1, 13))::bigint / 4503599627370496.0::double)".format
_SHARE, _RATIO = (f"{_U(chr(39) + x + chr(39) + ' || i')}" for x in ("share", "ratio"))
_LOW, _HIGH = math.log(3 / 4), math.log(4 / 3)
ORACLES["augmentation_draws"] = f"""WITH t AS (
    SELECT vec_id, i, 3072.0::double * (0.8::double + (1.0::double - 0.8::double) * {_SHARE}) AS area, exp({_LOW!r}::double + {_HIGH - _LOW!r}::double * {_RATIO}) AS ratio FROM embeddings, range(1, 11) r(i)
  ), s AS (SELECT vec_id, i, round_even(sqrt(area * ratio), 0)::int AS w, round_even(sqrt(area / ratio), 0)::int AS h FROM t),
  f AS (SELECT vec_id, arg_min({{'top': floor({_U("'top' || i")} * (48 - h + 1))::int, 'left': floor({_U("'left' || i")} * (64 - w + 1))::int, 'height': h, 'width': w}}, i) AS c FROM s WHERE h BETWEEN 1 AND 48 AND w BETWEEN 1 AND 64 GROUP BY vec_id)
  SELECT vec_id, coalesce(c.top, 0) AS top, coalesce(c."left", 0) AS "left", coalesce(c.height, 48) AS height, coalesce(c.width, 64) AS width, {_U("'flip'")} < 0.5 AS flip, round(({_U("'turn'")} * 2 - 1) * 10, 9) AS degrees
  FROM embeddings LEFT JOIN f USING (vec_id)"""
_LOGIT = """v AS (SELECT vec_id, label, i, embedding[i]::double AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT label AS class, i, avg(x) AS m FROM v GROUP BY label, i),
  b AS (SELECT class, -sum(m * m) / 2 AS b FROM m GROUP BY class), logit AS (SELECT vec_id, label, class, sum(x * m) + any_value(b) AS logit FROM v JOIN m USING (i) JOIN b USING (class) GROUP BY vec_id, label, class)"""
ORACLES["scored_logits"] = f"WITH {_LOGIT} SELECT vec_id, class, round(logit, 9) AS logit FROM logit"
ORACLES["scored_report"] = f"""WITH {_LOGIT}, p AS (SELECT vec_id, label AS actual, arg_max(class, logit) AS predicted FROM logit GROUP BY vec_id, label),
  g AS (SELECT a::int AS actual, b::int AS predicted, (SELECT count(*) FROM p WHERE p.actual = a AND p.predicted = b)::bigint AS n FROM range(0, 10) x(a), range(0, 10) y(b)),
  f AS (SELECT avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) AS f1 FROM (SELECT k, coalesce(sum(n) FILTER (WHERE actual = k AND predicted = k) / nullif(sum(n) FILTER (WHERE predicted = k), 0), 0) AS pr,
    coalesce(sum(n) FILTER (WHERE actual = k AND predicted = k) / nullif(sum(n) FILTER (WHERE actual = k), 0), 0) AS rc FROM g, range(0, 10) z(k) GROUP BY k))
  SELECT g.*, (SELECT count(*) FROM p)::bigint AS num_samples, round((SELECT count(*) FILTER (WHERE actual = predicted) / count(*)::double FROM p), 9) AS accuracy, round(f1, 9) AS macro_f1 FROM g, f"""
_TEXT = "translate(text, '*_`~[]()!\\' || chr(10) || chr(13), '')"
_DONE = {
    "a": "<strong>a</strong>", "de": "<em>de</em>", "der": "<em>der</em>", "la": "<del>la</del>", "und": "<strong><em>und</em></strong>", "of": "<code>of & **it**</code>", "to": "<code>to ` <b></code>",
    "in": '<a href="in.html">in</a>', "el": '<img alt="el" src="el.png">', "et": "2 * 3 * et", "is": "\\<em>is\\</em>", "en": "snake_en_case",
}
_HTML = f"replace(replace(replace({_TEXT}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
for _word, _done in _DONE.items():
    _done = _done.replace("of &", "of &amp;").replace("<b>", "&lt;b&gt;")
    _HTML = f"replace({_HTML}, ' {_word} ', ' {_done} ')"
ORACLES["markdown_inline"] = f"SELECT doc_id, {_HTML} AS html FROM documents"
ORACLES["iso_timestamps"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS plain FROM events"
ORACLES["throughput"] = "WITH r AS (SELECT user_id, count(*)::bigint AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY user_id) SELECT user_id, n, round(n::double / greatest(us / 1000000.0::double, 0.000001::double), 12) AS per_second FROM r"
_DOC_LINES = "lines AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) - 1 AS n FROM (SELECT doc_id, string_split(translate(text, '`' || chr(13), ''), chr(10)) AS t FROM documents))"
ORACLES["markdown_table_cells"] = f"""WITH {_DOC_LINES}, w AS (SELECT doc_id, n, string_split(replace(line, '|', ''), ' ') AS w FROM lines)
  SELECT doc_id, n::int AS n, CASE WHEN w[1] IS NULL OR w[1] = '' THEN '' ELSE trim(w[1]) || '/' END || '`' || coalesce(w[2], '') || '|' || coalesce(w[3], '') || '`/' || trim(coalesce(w[4], '') || ' x') AS cells FROM w"""
ORACLES["markdown_alignment"] = "SELECT doc_id, array_to_string([CASE x::int % 4 WHEN 1 THEN 'center' WHEN 2 THEN 'right' ELSE 'left' END FOR x IN string_split(doc_id::varchar, '')], ',') AS alignment FROM documents"
ORACLES["markdown_blocks"] = f"""WITH {_DOC_LINES}, k AS (SELECT doc_id, CASE
    WHEN regexp_matches(line, '^[ \\t\\x0B\\f]*~~~') THEN 'fence' WHEN regexp_matches(line, '^#{{1,6}}[ \\t\\x0B\\f]') THEN 'h' || length(regexp_extract(line, '^#+'))
    WHEN regexp_matches(line, '^[ \\t\\x0B\\f]*(-([ \\t\\x0B\\f]*-){{2,}}|\\*([ \\t\\x0B\\f]*\\*){{2,}}|_([ \\t\\x0B\\f]*_){{2,}})[ \\t\\x0B\\f]*$') THEN 'rule' WHEN regexp_matches(line, '^[ \\t\\x0B\\f]*>') THEN 'quote'
    WHEN regexp_matches(line, '^[ \\t\\x0B\\f]*([-*+]|[0-9]+[.)])[ \\t\\x0B\\f]') THEN 'item' WHEN regexp_matches(line, '^[ \\t\\x0B\\f]*\\|.*\\|[ \\t\\x0B\\f]*$') THEN 'row' WHEN regexp_matches(line, '^[ \\t\\x0B\\f]*$') THEN 'blank' ELSE 'text' END AS kind FROM lines)
  SELECT doc_id, kind, count(*)::bigint AS n FROM k GROUP BY doc_id, kind"""
ORACLES["class_counts"] = f"WITH {POOL} SELECT c AS class_name, (SELECT count(*) FROM pool WHERE split = 'validation' AND class_name = c)::bigint AS n FROM (VALUES ('real'), ('fake')) v(c)"
ORACLES["ordered_paths"] = f"""WITH {POOL}, p AS (SELECT CASE WHEN doc_id % 3 = 0 THEN upper(path) ELSE path END AS path FROM pool)
  SELECT path, (row_number() OVER (ORDER BY path) - 1)::bigint AS by_bytes, (row_number() OVER (ORDER BY lower(path), path) - 1)::bigint AS by_letters FROM p"""
ORACLES["group_members"] = """WITH r AS (SELECT conv_id, conv_id || '/' || lpad(turn::varchar, 6, '0') || '-' || role AS path FROM conversations)
  SELECT conv_id, count(*)::bigint AS n, string_agg(path, ',' ORDER BY path) AS members FROM r GROUP BY conv_id"""
ORACLES["hash_lookup"] = f"WITH {MANIFEST} SELECT path, d.hash, d.hash IS NOT NULL AS readable FROM manifest LEFT JOIN (SELECT path, hash FROM disk) d USING (path)"
ORACLES["frame_names"] = "SELECT conv_id, turn, 'c' || conv_id || '__' || conv_id || '_' || (conv_id + 1) || '__frame_' || lpad(turn::varchar, 6, '0') || '.png' AS name FROM conversations"
ORACLES["build_log"] = f"""WITH stats AS ({ORACLES["dedup_stats"]}), decided AS (WITH {DECIDED} SELECT * FROM decided), h AS (WITH {HASHED} SELECT * FROM hashed), one AS (
    SELECT (SELECT count(*) FROM decided) AS n, (SELECT sum(size_bytes) FROM decided)::bigint AS bytes, (SELECT count(*) FROM h WHERE hash IS NULL) AS unhashed, (SELECT scanned - unreadable - removed_total FROM stats) AS kept)
  SELECT 0 AS number, 'candidates' AS step, unnest(['rows', 'bytes', 'unhashed']) AS counter, unnest([n, bytes, unhashed])::bigint AS n FROM one
  UNION ALL SELECT 1, 'decided', unnest(['rows', 'kept', 'cross_class', 'same_split', 'cross_split']), unnest([count(*), count_if(decision = 'kept'), count_if(decision = 'cross_class'), count_if(decision = 'same_split'), count_if(decision = 'cross_split')])::bigint FROM decided
  UNION ALL SELECT 2, 'kept', 'rows', kept::bigint FROM one
  UNION ALL SELECT 3, 'selection', unnest(['rows', 'bytes']), unnest([count(*), sum(bytes)])::bigint FROM ({ORACLES["full_build"]})"""
ORACLES["provenance_frames"] = """WITH v AS (SELECT DISTINCT conv_id AS s FROM conversations), f AS (
    SELECT s, CASE WHEN s % 2 = 1 THEN s + 1 END AS source, CASE WHEN s % 2 = 1 THEN s WHEN EXISTS (SELECT 1 FROM v w WHERE w.s = v.s - 1) THEN s - 1 ELSE s END AS component FROM v
  ), r AS (SELECT *, s || CASE WHEN source IS NULL THEN '' ELSE '_' || source END AS name, CASE WHEN source IS NULL THEN 'real' ELSE 'fake' END AS label FROM f JOIN conversations c ON c.conv_id = s)
  SELECT row_number() OVER (ORDER BY s, turn, role) AS manifest_index, 'data/raw/' || label || '/' || component || '__' || name || '__frame_' || lpad(turn::varchar, 6, '0') || '.png' AS rel_path, 'videos' AS source_dataset, 'c23' AS compression,
    label, CASE WHEN source IS NULL THEN 'original' ELSE 'manipulated' END AS category, CASE WHEN source IS NOT NULL THEN 'Deepfakes' END AS method, name || '.mp4' AS source_video, s AS sequence_id, source AS source_id, component AS component_id,
    turn AS frame_index, count(*) OVER (PARTITION BY s) AS video_frame_count, name AS video_name FROM r"""
