"""The registered queries of the subpackage and the SQL statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.llm import byte_convnet, context_mixing, decontamination, mixing, ngram_join, part_codes, piece_codes, projection_forest, secret_scan, token_files, toxicity, turn_repair, warc_zip
from vitalgrid.llm.common import table


def op4_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_convnet.score(docs, byte_convnet.fit(docs, table(spark, sf_dir, "labels")))


def op2_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_zip.archive_and_read(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.search(table(spark, sf_dir, "embeddings"))


def op7_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op8_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def word_vocabulary() -> str:
    """Place of the public vocabulary file; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents"), word_vocabulary())


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.with_all(conversations, turn_repair.repair(turn_repair.damage(conversations)).report())


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_vocabulary()
    return piece_codes.digests(piece_codes.encode(table(spark, sf_dir, "documents"), model), model)


def op13_sliced_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_zip_archives": op3_zip_archives,
    "op7_randomness_battery": op7_randomness_battery,
    "op1_byte_convnet": op1_byte_convnet,
    "op2_nearest_examples": op2_nearest_examples,
    "op6_projection_forest": op6_projection_forest,
    "op8_prefix_tree_join": op8_prefix_tree_join,
    "op10_context_mixing": op10_context_mixing,
    "op9_direct_codes": op9_direct_codes,
    "op5_positional_index": op5_positional_index,
    "op4_entropy_balancing": op4_entropy_balancing,
    "op11_turn_repair": op11_turn_repair,
    "op12_distinct_words": op12_distinct_words,
    "op13_sliced_codes": op13_sliced_codes,
}

SQL: dict[str, str] = {}

SQL["op5_positional_index"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: Eight groups of 20 digest bits, each spelt as four base-32 letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)"
    for g in range(8) for shift in (15, 10, 5, 0))

SQL["op3_zip_archives"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last IS NULL OR page_id = last THEN NULL ELSE last END AS refers_to
FROM m
"""

SQL["op8_prefix_tree_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS to_id FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.to_id = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(to_id) AS component_id FROM r GROUP BY node) m USING (doc_id)
"""

def _codes_sql() -> str:
    """Two rounds of assigning and moving, then the last assignment."""
    steps = []
    for k in (0, 1, 2):
        steps.append(f"""
a{k} AS (SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e
         FROM (SELECT r, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{k} USING (p)) GROUP BY r, p)""")
        if k < 2:
            steps.append(f"""
s{k} AS (SELECT p, e, i, sum(v[i]) AS total, count(*) AS n FROM x JOIN a{k} USING (r, p), ks WHERE i <= len(v) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list(CAST((total - ((total % n) + n) % n) // n AS HUGEINT) ORDER BY i) AS c FROM s{k} GROUP BY p, e),
c{k + 1} AS (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
WITH k AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
w AS (SELECT r, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS HUGEINT)) AS v, len(embedding) // 16 AS n FROM k),
x AS MATERIALIZED (SELECT r, p, v[p * n + 1:(p + 1) * n] AS v FROM w, range(16) t(p)),
ks AS (SELECT unnest(generate_series(1, (SELECT max(n) FROM w))) AS i),
c0 AS (SELECT p, r - 1 AS e, v AS c FROM x WHERE r <= 64),{",".join(steps)},
f AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM k JOIN f USING (r)
"""


SQL["op13_sliced_codes"] = _codes_sql()


def _repair_sql() -> str:
    """Costs backward by a recursive walk over positions, edits forward by one over edits."""
    crc = "SELECT x, x AS c FROM range(256) t(x)"
    for _ in range(8):
        crc = f"SELECT x, xor(c >> 1, 3988292384 * (c & 1)) AS c FROM ({crc})"
    ends = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    inserted = "CASE q WHEN 'u' THEN 'a' ELSE 'u' END"
    at = lambda p, q: f"CASE {q} WHEN '' THEN {p}.e WHEN 's' THEN {p}.s WHEN 'u' THEN {p}.u ELSE {p}.a END"
    return f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY x) AS t FROM ({crc})),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT)) AS codes FROM conversations),
k AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, codes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM o, tab),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM k, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
n AS (SELECT g, d.*, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS i FROM d JOIN g ON d.conv_id IS NOT DISTINCT FROM g.conv_id),
r AS (SELECT *, left(role, 1) AS c, rtrim(text, {ends}) = '' AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again, right(rtrim(text, {ends}), 1) NOT IN ('.', '!', '?') AS cut,
             lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS before FROM n),
w AS (SELECT *, blank OR again AS must, CASE WHEN cut THEN 3 ELSE 0 END AS x FROM r),
f AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
             count(*) FILTER (cut AND NOT must) AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY g),
b AS (SELECT g, n + 1 AS i, 0 AS e, 6 AS s, 3 AS u, 0 AS a FROM f
      UNION ALL
      SELECT g, i, least(e, 3 + least(u, 3 + a)), least(s, 3 + least(u, 3 + a)), least(u, 3 + a), least(a, 3 + u) FROM (
        SELECT b.g, w.i,
          least(b.e + 4, CASE WHEN NOT must THEN 3 + x + b.u END, CASE WHEN NOT must AND c = 's' THEN x + b.s WHEN NOT must AND c = 'u' THEN x + b.u END) AS e,
          least(b.s + 4, CASE WHEN NOT must THEN 3 + x + b.u END, CASE WHEN NOT must AND c = 'u' THEN x + b.u END) AS s,
          least(b.u + 4, CASE WHEN NOT must THEN 3 + x + b.a END, CASE WHEN NOT must AND c = 'a' THEN x + b.a END) AS u,
          least(b.a + 4, CASE WHEN NOT must THEN 3 + x + b.u END, CASE WHEN NOT must AND c = 'u' THEN x + b.u END) AS a
        FROM b JOIN w ON w.g = b.g AND w.i = b.i - 1)),
p AS (SELECT g, CAST(1 AS BIGINT) AS i, '' AS q, '' AS audit, CAST([] AS VARCHAR[]) AS rows FROM f
      UNION ALL
      SELECT g, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN c ELSE {inserted} END, audit || edit,
             CASE edit WHEN 'D' THEN rows WHEN 'K' THEN list_append(rows, role || ':' || text) ELSE list_append(rows, CASE q WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE edit WHEN 'R' THEN text ELSE '' END) END
      FROM (SELECT p.*, w.c, w.role, w.text,
              CASE WHEN w.i IS NULL THEN CASE WHEN q IN ('s', 'u') THEN 'I' END
                   WHEN {at('h', 'q')} = 4 + {at('z', 'q')} THEN 'D'
                   WHEN {at('h', 'q')} = 3 + {at('h', f'({inserted})')} THEN 'I'
                   WHEN NOT must AND q || c IN ('s', 'u', 'su', 'ua', 'au') AND {at('h', 'q')} = x + {at('z', 'c')} THEN 'K' ELSE 'R' END AS edit
            FROM p JOIN b h ON h.g = p.g AND h.i = p.i LEFT JOIN w ON w.g = p.g AND w.i = p.i LEFT JOIN b z ON z.g = p.g AND z.i = p.i + 1) WHERE edit IS NOT NULL),
last AS (SELECT p.* FROM p JOIN f ON f.g = p.g AND p.i = f.n + 1 WHERE q IN ('', 'a'))
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.e, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rows, chr(10)), '')) AS repaired_sha256
FROM g LEFT JOIN f USING (g) LEFT JOIN b ON b.g = g.g AND b.i = 1 LEFT JOIN last ON last.g = g.g
"""


SQL["op11_turn_repair"] = _repair_sql()
