"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _crc_table() -> list[int]:
    """What the checksum's polynomial makes of each byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def crc32(text: str) -> str:
    """SQL for the checksum of a text's UTF-8 bytes."""
    digit = "instr('0123456789ABCDEF', hex(encode({0}))[{1}]) - 1"
    byte = f"16 * ({digit.format(text, '2 * i + 1')}) + {digit.format(text, '2 * i + 2')}"
    step = f"xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform(range(strlen({text})), lambda i: CAST({byte} AS BIGINT)), lambda c, b: {step}, 4294967295), 4294967295)"


def _unit(text: str) -> str:
    return f"((CAST('0x' || substr(sha256({text}), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)"


def _cluster_round(k: int) -> str:
    """Assignment to the centroids c{k}, and the centroids after it."""
    return f"""
        a{k} AS MATERIALIZED (SELECT key, any_value(vec_id) AS vec_id, any_value(w) AS w, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT key, vec_id, v.w, c, CAST(list_inner_product(v.w, v.w) + list_inner_product(m.w, m.w) - 2 * list_inner_product(v.w, m.w) AS BIGINT) AS d FROM v, c{k} m) GROUP BY key),
        s{k} AS (SELECT c, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY c, i),
        c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n.w, o.w) AS w FROM c{k} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS w FROM s{k} GROUP BY c) n USING (c))"""


SQL = {
    "op1_decontaminate": f"""
        WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), i AS (SELECT item_id, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
        wins AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[k:k + 12], ' ') AS g FROM i, unnest(range(1, greatest(1, len(ws) - 12) + 1)) t(k) WHERE len(ws) > 0),
        sizes AS (SELECT DISTINCT n FROM wins),
        spans AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM w, sizes, unnest(range(1, len(ws) - n + 2)) t(k)),
        hits AS (SELECT doc_id, k, n, item_id FROM spans JOIN wins USING (g, n)),
        hit AS (SELECT DISTINCT doc_id, p FROM hits, unnest(range(k, k + n)) t(p)),
        runs AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit) GROUP BY doc_id, run),
        covered AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_hit, CAST(coalesce(sum(n) FILTER (WHERE n > 13), 0) AS BIGINT) AS n_cut FROM runs GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_cut, 0) AS n_cut FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
    "op11_clusters": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, w) - 1 AS c, w FROM (SELECT sha256('2:' || vec_id) AS h, w FROM v WHERE vec_id IS NOT NULL ORDER BY h, w LIMIT 40)), {",".join(map(_cluster_round, range(6)))},
        sums AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a5) AS inertia, sha256(array_to_string(list_transform(c5.w, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a5 JOIN sums USING (c) JOIN c5 USING (c)
    """,
    "op12_resample": f"""
        WITH d AS (SELECT row_number() OVER () AS key, doc_id, {WORDS} AS ws FROM documents), b AS (SELECT {WORDS} AS ws FROM benchmark),
        df AS MATERIALIZED (SELECT key, f, count(*) AS n FROM (SELECT key, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d) GROUP BY key, f),
        bf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b) GROUP BY f),
        named AS MATERIALIZED (SELECT f, {crc32("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
        counts AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE k = 0), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (WHERE k = 1), 0) AS BIGINT) AS t FROM (SELECT f, n, 0 AS k FROM df UNION ALL SELECT f, n, 1 FROM bf) JOIN named USING (f) GROUP BY bucket),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM counts),
        sums AS (SELECT key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS g FROM df JOIN named USING (f) JOIN gains USING (bucket) GROUP BY key),
        w AS (SELECT key, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight FROM d LEFT JOIN sums USING (key)),
        scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln({_unit("'7:' || coalesce(CAST(doc_id AS VARCHAR), '')")}))) AS BIGINT) AS score FROM w),
        placed AS (SELECT key, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (key)
    """,
    "op13_mix": f"""
        WITH d AS (SELECT row_number() OVER () AS key, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
        lv AS (SELECT row_number() OVER o AS k, 2.0::DOUBLE * source_size / weight AS full_at, (150 * sum(source_size) OVER () / 100.0::DOUBLE - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source)),
        aims AS (SELECT source, source_size, CASE WHEN 2 * source_size <= level * weight THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target FROM s, (SELECT level FROM lv WHERE full_at > level ORDER BY k LIMIT 1)),
        e AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0 END AS DECIMAL(20, 12)) AS expected, CAST({_unit("'13:source' || coalesce(':' || source, '')")} AS DECIMAL(20, 12)) AS start FROM aims),
        laid AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.expected, e.start, coalesce(sum(e.expected) OVER (PARTITION BY d.source ORDER BY d.size DESC, {_unit("'13' || coalesce(':' || d.doc_id, '')")}, d.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
        took AS (SELECT *, CAST(floor(before + expected + start) - floor(before + start) AS BIGINT) AS copies FROM laid)
        SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM took
    """,
}
