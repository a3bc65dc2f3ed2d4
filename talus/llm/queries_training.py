"""Queries: fill-in-middle, quality rules, dataset manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talus.llm import fill_middle, manifest, quality_rules
from talus.llm.common import stored, table
from talus.llm.registry import query

FILL_MIDDLE = """
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
    h AS (
        SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS y,
               ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM drawn),
    f AS (
        SELECT *, least(x, y) AS a, greatest(x, y) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM parts"""


@query(sql=FILL_MIDDLE)
def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.report(table(spark, folder, "documents"))


@query()
def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    # a fifth of the ids is never learned from, so that held-out rows can tell how good the rules are
    stats = stored(quality_rules.statistics(table(spark, folder, "documents")), "quality-statistics")
    known = quality_rules.labelled(stats, table(spark, folder, "labels"))
    rules = quality_rules.fit(known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    found = quality_rules.verdicts(stats, rules)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# crc32 of the decimal id: a byte is mixed in, then shifted out bit by bit (-1)
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

MANIFEST = f"""
    WITH RECURSIVE
    e AS (
        SELECT doc_id, '1' || coalesce(lang, '') AS tree_name, lang, n_chars,
               coalesce(octet_length(encode(doc_id::VARCHAR))::VARCHAR || ':' || doc_id::VARCHAR, '-')
               || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-')
               || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') AS head,
               coalesce(octet_length(encode(n_chars::VARCHAR))::VARCHAR || ':' || n_chars::VARCHAR, '-') AS size,
               coalesce(octet_length(encode((n_chars + 1)::VARCHAR))::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') AS more,
               coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-') AS tail
        FROM documents),
    leaves AS (
        SELECT doc_id, lang, sha256(head || size || tail) AS leaf,
               CASE WHEN doc_id IS NOT NULL AND {CRC} % 7 = 0 THEN sha256(head || more || tail) END AS changed FROM e),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
    nodes AS (
        SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
        UNION ALL
        SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
    subroots AS (
        SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS level, pos, n, subroot AS node FROM subroots
        UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
    siblings AS (
        SELECT p.lang, p.pos, o.level, (p.pos >> o.level) % 2 AS side, o.node
        FROM placed p JOIN nodes o ON o.lang IS NOT DISTINCT FROM p.lang AND o.pos = xor(p.pos >> o.level, 1) AND o.n > 1
        UNION ALL
        SELECT p.lang, p.pos, 1000 + o.level, (s.pos >> o.level) % 2, o.node
        FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops o ON o.pos = xor(s.pos >> o.level, 1) AND o.n > 1),
    heights AS (
        SELECT lang, pos, subroot, (SELECT max(level) FROM tops) AS top_levels, (SELECT node FROM tops WHERE n = 1) AS root,
               (SELECT max(level) FROM nodes o WHERE o.lang IS NOT DISTINCT FROM s.lang) AS height FROM subroots s),
    folded AS (
        SELECT p.lang, p.pos, h.height, h.top_levels, CASE WHEN h.height = 0 THEN 1000 ELSE 0 END AS level, coalesce(changed, leaf) AS node
        FROM placed p JOIN heights h ON h.lang IS NOT DISTINCT FROM p.lang
        UNION ALL
        SELECT f.lang, f.pos, f.height, f.top_levels, CASE WHEN f.level + 1 = f.height THEN 1000 ELSE f.level + 1 END,
               CASE WHEN s.node IS NULL THEN sha256(f.node) WHEN s.side = 0 THEN sha256(f.node || s.node) ELSE sha256(s.node || f.node) END
        FROM folded f LEFT JOIN siblings s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.level = f.level
        WHERE f.level < 1000 + f.top_levels),
    proofs AS (SELECT lang, pos, sha256(string_agg(node, '' ORDER BY level)) AS proof FROM siblings GROUP BY lang, pos)
    SELECT p.doc_id, p.leaf, h.subroot, h.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = h.root AS verified
    FROM placed p JOIN heights h ON h.lang IS NOT DISTINCT FROM p.lang
    JOIN folded f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND f.level = 1000 + f.top_levels
    LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos"""


@query(sql=MANIFEST)
def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.proofs(table(spark, folder, "documents"))
