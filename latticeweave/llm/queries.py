"""The operators' queries under their contracts, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lm, mixing, quality, secrets, simhash, tokencount, toxicity, warc
from ._common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A conversation of control strings, added to the table.
CONTROL = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    added = added.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])
    formatted = chat.format_conversations(turns.unionByName(added))
    return digest_of_chats(formatted)


def digest_of_chats(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    back = formatted.select("conv_id", "formatted", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return digest_of_spans(found.select("doc.doc_id", "spans", "links"))


def digest_of_spans(found: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.joined(F.filter("spans", lambda s: s["kind"] != "weak"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), secrets.joined_links(F.col("links")).alias("links"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc.doc_id", "held_out", "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Only the id goes on beside what the operator itself derives from text and source.
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc.doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words", "base_failed", "kept", F.col("stats.bits").alias("bits_per_char"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("hits.items", ",").cast("binary"), 256)
    return found.select("doc.doc_id", "hits.n_words", "hits.n_hit", "hits.n_items", items.alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_chat, op3_lm, op4_secrets, op5_tokens, op6_toxicity, op7_mixing, op8_simhash, op9_quality, op10_decontam)}

_ESC = "replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     w AS (SELECT d, max(page_id) AS last_id FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN last_id IS NOT NULL AND page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id IS NOT NULL AND page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM p LEFT JOIN w USING (d)""",
    "op2_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
     t AS (SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM c
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
     f AS (SELECT *, CASE WHEN prev IS DISTINCT FROM role THEN length('<|im_start|><|im_sep|>') + length({_ESC.format("role")}) ELSE length('<|im_next|>') END
                  + length({_ESC.format("text")}) + CASE WHEN next IS DISTINCT FROM role THEN length('<|im_end|>') ELSE 0 END AS size FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""",
    "op4_secrets": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     k AS (SELECT r, kind, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS gs, pattern FROM d, (VALUES
       ('assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
       ('access', 'AKIA[A-Z0-9]{12,}'), ('hex', '[0-9a-f]{32,}'), ('weak', '[A-Za-z0-9+/_-]{24,}=*'),
       ('identifier', '(?:[Cc][Ll][Ii][Ee][Nn][Tt]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Aa][Cc][Cc][Ee][Ss][Ss]|[Uu][Ss][Ee][Rr])_?(?:[Kk][Ee][Yy]_?)?[Ii][Dd]["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{4,}'),
       ('endpoint', '(?:https?|ftp|s3|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[A-Za-z0-9.-]+')) p(kind, pattern)),
     e AS (SELECT r, kind, pattern, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM k),
     a AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i))::INT AS z FROM e),
     s AS (SELECT r, kind, z - length(m)::INT AS a, z, list_position(['assign', 'access', 'hex', 'weak'], kind) AS rank FROM a
           WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, pattern, 2)) >= 8 WHEN 'weak' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') ELSE true END),
     b AS (SELECT * FROM s WHERE rank <= 3),
     x AS (SELECT * FROM b WHERE kind <> 'access' UNION ALL SELECT * FROM s w WHERE kind = 'weak' AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = w.r AND b.a < w.z AND w.a < b.z)),
     p AS (SELECT r, a, z, CASE kind WHEN 'endpoint' THEN 2 ELSE 1 END AS role FROM s WHERE kind IN ('access', 'identifier', 'endpoint')),
     j AS (SELECT x.r, x.kind, x.rank, x.a, x.z, role, first(p.a || ':' || p.z ORDER BY CASE WHEN p.z <= x.a THEN x.a - p.z ELSE p.a - x.z END, p.a, p.z) AS near
           FROM x JOIN p ON p.r = x.r AND ((p.z <= x.a AND p.a >= x.a - 256) OR (p.a >= x.z AND p.a < x.z + 256)) GROUP BY ALL),
     l AS (SELECT r, kind, rank, a, z, coalesce(max(near) FILTER (role = 1), '') AS one, coalesce(max(near) FILTER (role = 2), '') AS two FROM j GROUP BY ALL),
     f AS (SELECT * FROM b UNION ALL SELECT r, kind, a, z, rank FROM l WHERE kind = 'weak'),
     n AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                  coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (kind <> 'weak'), '') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM f GROUP BY r),
     o AS (SELECT r, string_agg(kind || ':' || a || ':' || z || '>' || one || '>' || two, ',' ORDER BY a, rank) AS links FROM l GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
FROM d LEFT JOIN n USING (r) LEFT JOIN o USING (r)""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':7') AS h FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
     w AS (SELECT *, (1 + k % 3)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
     l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
           FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     t AS (SELECT *, least(coalesce((SELECT first(level ORDER BY cap / weight, source NULLS LAST) FROM l WHERE level * weight <= cap) * weight, cap), cap) AS target,
                  ('0x' || substr(md5(coalesce('+' || source, '') || ':7'), 1, 10))::BIGINT::DOUBLE / 1099511627776::DOUBLE AS u FROM l),
     r AS (SELECT d.*, t.source_size, target, u, CASE WHEN t.source_size > 0 THEN least(target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
                  row_number() OVER (PARTITION BY d.source ORDER BY size, h) AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN least(floor(place * rate + u) - floor((place - 1) * rate + u), 3) ELSE 0 END)::BIGINT * size AS taken FROM r""",
    "op10_decontam": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
     i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS p
            FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
     dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS p
            FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
     m AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, p)),
     h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS pos FROM m) GROUP BY r),
     s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)""",
}
