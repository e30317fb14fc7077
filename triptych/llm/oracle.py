"""SQL for the queries that SQL can express."""

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

ORACLE_SQL = {
    # Sources are filled in the order of limit over weight, to a common level.
    "op1_mix": rf"""
        WITH sizes AS (
            SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size,
                   md5('42' || coalesce(':' || CAST(doc_id AS VARCHAR), '')) AS spot
            FROM documents),
        total AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS BIGINT) * 3 AS most
            FROM sizes GROUP BY source),
        weighed AS (
            SELECT *, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS weight FROM total),
        levels AS (
            SELECT *, CAST((sum(source_size) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
                - coalesce(sum(most) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
                / CAST(sum(weight) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
            FROM (SELECT *, most / CAST(weight AS DOUBLE) AS r FROM weighed)),
        common AS (SELECT arg_min(level, (r, source)) AS level FROM levels WHERE level * weight < most),
        targets AS (
            SELECT source, source_size,
                   least(coalesce(common.level * weight, most), CAST(most AS DOUBLE)) AS target
            FROM levels, common),
        placed AS (
            SELECT doc_id, size, source_size, target,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY spot, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   CAST(round(target) AS BIGINT) AS budget
            FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
                    + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
        FROM placed""",
    "op2_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS words FROM starts),
        lowest AS (SELECT words, min(doc_id) AS low FROM windows GROUP BY words),
        repeats AS (SELECT doc_id, i FROM windows JOIN lowest USING (words) WHERE low < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM repeats),
        each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
            FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op3_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents),
        groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM texts JOIN groups USING (text_sha256)""",
}
