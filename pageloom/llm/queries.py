"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import ann, chat, divergence, exact_dedup, jaccard_join, langid, line_dedup, mixing, packing, sharding, toxicity, url_templates, vector_codes
from pageloom.llm.common import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = remainder(F.col("doc_id"), 3) == 1
    return toxicity.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    return langid.identify(docs, *langid.train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(rows, rows.where(F.col("vec_id") % 100 == 0))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("first_position", F.bround("first_position", 9))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    turns = rows.unionByName(more).withColumn("parts", chat.text_part(F.col("text")))
    return chat.read_back(chat.format_turns(turns))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_language_id, op3_url_templates, op4_retrieval_packing, op5_jaccard_join, op6_sharding, op7_hnsw, op8_line_dedup, op9_exact_dedup, op10_curriculum_mixing, op11_chat_formatting, op12_vector_codes, op13_source_divergence)
    return {f.__name__: f for f in ops}


def codes_sql() -> str:
    """Vector codes in SQL: the rounds are written out one after another."""
    gap = "list_sum(list_transform(range(1, len(a.part) + 1), lambda i: (a.part[i] - b.part[i]) * (a.part[i] - b.part[i])))"
    near = lambda books: f"SELECT vec_id, pos, any_value(part) AS part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT a.vec_id, a.pos, a.part, b.entry, CAST({gap} AS BIGINT) AS d FROM pieces a JOIN {books} b USING (pos)) GROUP BY vec_id, pos"
    rounds = ""
    for r in range(4):
        rounds += f"""
        , near{r} AS MATERIALIZED ({near(f"book{r}")}),
        mean{r} AS (SELECT pos, entry, list(s ORDER BY i) AS part FROM (
            SELECT pos, entry, i, CAST(sum(v) // count(*) - CASE WHEN sum(v) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS s
            FROM (SELECT pos, entry, unnest(part) AS v, generate_subscripts(part, 1) AS i FROM near{r}) GROUP BY ALL) GROUP BY ALL),
        book{r + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM book{r} b LEFT JOIN mean{r} m USING (pos, entry))"""
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024::DOUBLE * x) AS BIGINT)) AS ints FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pieces AS MATERIALIZED (
            SELECT vec_id, p.pos, ints[p.pos * len(ints) // 4 + 1 : (p.pos + 1) * len(ints) // 4] AS part FROM kept, range(4) p(pos)
        ), book0 AS MATERIALIZED (
            SELECT pos, entry, part FROM pieces JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256) USING (vec_id)
        ){rounds},
        given AS MATERIALIZED ({near("book4")}),
        whole AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM given GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(v, ',' ORDER BY pos, entry)) FROM (SELECT pos, entry, array_to_string(part, ',') AS v FROM book4)) AS codebooks_sha256
        FROM kept JOIN whole USING (vec_id)
    """


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op11_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
        ), e AS (
            SELECT *, [length(regexp_replace(replace(x, chr(92), chr(92) || chr(92)), '([<\[])(\||/?s>|</?SYS>>|/?INST\])', '\1' || chr(92) || chr(92) || '\2', 'g')) for x in [role, text]] AS sizes FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(list_sum(sizes) + length('<|turn|><|text|></s>')) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op12_vector_codes": codes_sql(),
    "op13_source_divergence": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT lang, source, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
        c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
        base AS MATERIALIZED (
            SELECT g.lang, g.source, coalesce(v.v, 0) + coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS m, coalesce(v.v + v.lang_n, 0) AS lang_m FROM g LEFT JOIN v USING (lang)
        ), rates AS MATERIALIZED (
            SELECT b.lang, b.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // b.m AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.total + 1)) // b.lang_m AS BIGINT) AS q
            FROM base b JOIN kept k USING (lang) LEFT JOIN c ON c.lang = b.lang AND c.source = b.source AND c.term = k.term
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), term AS (
            SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM rates WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op5_jaccard_join": rf"""
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM split
        ), one AS (SELECT doc_id, unnest(g) AS s FROM sets), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM one a JOIN one b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * k >= 90 * (len(x.g) + len(y.g) - k)
        ), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON r.c = ways.a)
        SELECT doc_id, CAST(len(any_value(g)) AS BIGINT) AS n_shingles, min(c) AS component_id FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
    """,
    "op10_curriculum_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM d GROUP BY source
        ), w AS (
            SELECT *, CAST(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(CASE kind WHEN 0 THEN -0.5 WHEN 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS slope FROM s
        ), o AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
                row_number() OVER (ORDER BY cap / weight, source) AS place FROM w
        ), l AS (SELECT arg_min(level, place) FILTER (level * weight < cap) AS level FROM o),
        t AS (SELECT source, source_size, slope, least(cap, weight * coalesce(l.level, 1e300)) AS target FROM w, l),
        c AS (
            SELECT d.*, source_size, target, slope, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), x AS (
            SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)) * size + greatest(0, least(size, floor(target - floor(target / nullif(source_size, 0)) * source_size) - before)), 0) AS BIGINT) AS taken,
                   least(1.0::DOUBLE, coalesce(before / nullif(target, 0), 0)) AS u FROM c
        )
        SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN
            round_even(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4.0::DOUBLE * slope * u) - (1 - slope)) / (2.0::DOUBLE * slope) END + 0.0::DOUBLE, 9) END AS first_position FROM x
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
    """,
    "op8_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, t.line, t.pos, trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, pos)
        ), gone AS (
            SELECT bare FROM lines WHERE bare <> ''
            GROUP BY bare HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 5
        ), kept AS (
            SELECT doc_id, count(*) AS n_lines, count(gone.bare) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone.bare IS NULL), '') AS text
            FROM lines LEFT JOIN gone USING (bare) GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(CAST(n_lines AS INTEGER), 0) AS n_lines, coalesce(CAST(n_removed AS INTEGER), 0) AS n_removed, md5(k.text) AS text_md5
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
}
