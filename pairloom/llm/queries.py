"""The operators of this subpackage as queries over the given tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import (
    alignment,
    conversation_trie,
    decontamination,
    hash_forest,
    langid,
    line_dedup,
    mixing,
    mtree,
    packing,
    secret_scan,
    sharding,
    simhash,
    token_counts,
)
from pairloom.llm.common import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op4_mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate"
    )


def op5_drop_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1)).alias("site")
    # The text is read twice, but taken out of the pages once.
    pages = table(spark, sf_dir, "pages").select("page_id", host, line_dedup.visible_lines("html").alias("text"))
    return line_dedup.drop_site_lines(saved(pages, "page-text"), F.col("site"), keep=["page_id"])


def op6_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op7_search_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"))


def op8_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op9_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "coverage")


def op10_search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_texts(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def op12_find_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_pack_documents": op1_pack_documents,
    "op2_scan_secrets": op2_scan_secrets,
    "op3_shard_documents": op3_shard_documents,
    "op4_mix_documents": op4_mix_documents,
    "op5_drop_site_lines": op5_drop_site_lines,
    "op6_count_tokens": op6_count_tokens,
    "op7_search_exactly": op7_search_exactly,
    "op8_simhash_classes": op8_simhash_classes,
    "op9_identify_language": op9_identify_language,
    "op10_search_nearest": op10_search_nearest,
    "op11_align_tokens": op11_align_tokens,
    "op12_find_benchmark": op12_find_benchmark,
    "op13_conversation_trie": op13_conversation_trie,
}

_VISIBLE = r"""
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<!--.*?(?:-->|\z)', '', 'g'),
    '(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|tr|td|th|table|article|section|header|footer|main|aside|title|body|head|html|form|blockquote|pre)(?:[\s/][^>]*)?(?:>|\z)', chr(10), 'g'),
    '<[A-Za-z/!?][^>]*(?:>|\z)', '', 'g'),
    '[ \t]*\n[ \t\n]*', chr(10), 'g'), chr(10))"""

_BLANKS = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"

_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.LOWER}'), "
    rf"'{decontamination.WORDS}')"
)

ORACLES: dict[str, str] = {
    "op5_drop_site_lines": f"""
        WITH p AS (
          SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, {_VISIBLE} AS text
          FROM pages),
        each AS (
          SELECT page_id, host, unnest(string_split(text, chr(10))) AS line FROM p),
        counted AS (
          SELECT host, line, count(*) AS line_pages
          FROM (SELECT DISTINCT page_id, host, trim(line, {_BLANKS}) AS line FROM each)
          WHERE line <> '' GROUP BY host, line),
        hosts AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
        lists AS (
          SELECT counted.host, list(line) AS dropped
          FROM counted JOIN hosts ON counted.host IS NOT DISTINCT FROM hosts.host
          WHERE line_pages >= {line_dedup.MIN_PAGES} AND line_pages > {line_dedup.MAX_RATIO} * host_pages
          GROUP BY counted.host),
        cut AS (
          SELECT page_id, p.host, text, string_split(text, chr(10)) AS lines,
                 list_filter(string_split(text, chr(10)),
                             lambda x: NOT list_contains(coalesce(dropped, []), trim(x, {_BLANKS}))) AS kept
          FROM p LEFT JOIN lists ON p.host IS NOT DISTINCT FROM lists.host)
        SELECT page_id, host, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
               CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
               CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped
        FROM cut""",
    "op7_search_exactly": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS u FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.u, c.u), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
          FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op12_find_benchmark": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
        b AS (SELECT item_id, words, least({decontamination.WINDOW}, len(words)) AS n
              FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
        w AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS phrase
              FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS s FROM b)),
        p AS (SELECT r, n, p, array_to_string(words[p:p + n - 1], ' ') AS phrase
              FROM (SELECT r, n, words, unnest(range(1, len(words) - n + 2)) AS p
                    FROM d CROSS JOIN (SELECT DISTINCT n FROM b))),
        m AS (SELECT DISTINCT r, n, p, phrase FROM p SEMI JOIN w USING (n, phrase)),
        h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS pos FROM m) GROUP BY r),
        i AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items
              FROM m JOIN w USING (n, phrase) WHERE item_id IS NOT NULL GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
               sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""",
}
