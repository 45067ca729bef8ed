"""SQL over the same tables that must give the same rows as each query."""

from __future__ import annotations

from pairloom import constants


def q(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


PROMPT_HEAD, PROMPT_MIDDLE, _ = constants.PROMPT_TEMPLATE.split("{}")

_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
_LENGTHS = "list_transform(" + _WORDS + ", lambda w: length(w)::integer)"


def words(expr: str) -> str:
    return _WORDS.format(expr)


def lengths(expr: str) -> str:
    return _LENGTHS.format(expr)


def text_of(array: str) -> str:
    return f"coalesce(array_to_string({array}, ','), '')"


def repeat(value: int, count: str) -> str:
    return f"list_transform(range(greatest({count}, 0)), lambda i: {value})"


ALIGNED = """
aligned AS (
  SELECT e.line_no, e.en, f.ko FROM
    (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, text AS en FROM documents WHERE lang = 'en') e
    JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, text AS ko FROM documents WHERE lang = 'fr') f
    USING (line_no))"""

PAIRS = """
aligned AS (
  SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, text AS en,
    lead(text) OVER (ORDER BY doc_id) AS ko FROM documents) WHERE ko IS NOT NULL)"""

EXAMPLES = """
examples AS (
  SELECT u.conv_id, u.turn, coalesce(u.text, '') AS input_text, coalesce(a.text, '') AS output_text
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""

# The fault rule depends on the row number only, so expected pairs need no JSON parser.
TASKS = """
numbered AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents),
tasks AS (
  SELECT *, rn // 10 AS b, rn % 10 AS pos, (rn // 10) % 13 = 0 AS broken, ((rn // 10) // 13) % 6 AS kind,
    (rn // 10) % 7 = 3 AND (rn // 10) % 13 <> 0 AS shorter,
    max(rn % 10) OVER (PARTITION BY rn // 10) AS last_pos
  FROM numbered)"""

REASONS = """CASE kind WHEN 0 THEN 'bad_json' WHEN 1 THEN 'bad_custom_id' WHEN 2 THEN 'no_choice'
  WHEN 3 THEN 'bad_inner_json' WHEN 4 THEN 'missing_key' ELSE 'not_array' END"""

PROMPT = f"{q(PROMPT_HEAD)} || en || {q(PROMPT_MIDDLE)} || ko"


def request_json(content: str, system: str) -> str:
    return f"""to_json({{'custom_id': 'task-' || batch_id, 'method': 'POST', 'url': '/v1/chat/completions',
      'body': {{'model': 'gpt-4o-mini', 'temperature': 0.7::double, 'response_format': {{'type': 'json_object'}},
        'messages': [{{'role': 'system', 'content': {q(system)}}}, {{'role': 'user', 'content': {content}}}]}}}})::varchar"""


BATCHES = """
batches AS (
  SELECT rn // 10 AS batch_id, count(*) AS n, string_agg(text, chr(10) ORDER BY rn) AS content
  FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) GROUP BY 1)"""


def hashed(columns: str, key: str, table: str, where: str = "true") -> str:
    return f"SELECT {columns}, md5('42:' || {key}) AS h FROM {table} WHERE {where}"


def chat_text(template: str, source: str = "input_text", target: str | None = "output_text", role: bool = False) -> str:
    layout = constants.CHAT_TEMPLATES[template]

    def header(name: str) -> str:
        return layout["header"].replace("{role}", name)

    text = (
        q(layout["begin"] + header("system") + constants.CHAT_SYSTEM_PROMPT + layout["end"] + header("user")
          + constants.CHAT_USER_PREFIX)
        + f" || {source} || "
    )
    if target is None:
        text += q(layout["end"])
    else:
        text += (
            q(layout["end"] + header("assistant") + constants.CHAT_ASSISTANT_PREFIX)
            + f" || {target} || "
            + q(layout["end"])
        )
    return text + (" || " + q(header("assistant")) if role else "")


def masked_chat(template: str, columns: str, limit: int | None = None) -> str:
    """Ids and labels of an example's chat, tokenised part by part."""
    layout = constants.CHAT_TEMPLATES[template]

    def header(name: str) -> str:
        return layout["header"].replace("{role}", name)

    masked = " || ".join(
        lengths(part)
        for part in (
            q(layout["begin"]),
            q(header("system")),
            q(constants.CHAT_SYSTEM_PROMPT + layout["end"]),
            q(header("user")),
            f"({q(constants.CHAT_USER_PREFIX)} || input_text || {q(layout['end'])})",
            q(header("assistant")),
        )
    )
    answer = lengths(f"({q(constants.CHAT_ASSISTANT_PREFIX)} || output_text || {q(layout['end'])})")
    return f"""
masked AS (SELECT {columns}, {masked} AS p, {answer} AS a FROM examples),
chat AS (SELECT {columns}, p || a AS ids, {repeat(-100, 'len(p)')} || a AS labels FROM masked)"""


def packed(source: str, block: int) -> str:
    """Token stream cut into full blocks: {source} gives (k, ids)."""
    return f"""WITH {source},
stream AS (
  SELECT tok, row_number() OVER (ORDER BY k, i) - 1 AS p FROM
    (SELECT k, unnest(ids) AS tok, generate_subscripts(ids, 1) AS i FROM rows_))
SELECT p // {block} AS block, string_agg(tok::varchar, ',' ORDER BY p) AS input_ids
FROM stream GROUP BY 1 HAVING count(*) = {block}"""


def split_sql(columns: str, inner: str, n_test: str) -> str:
    return f"""SELECT {columns}, CASE WHEN r <= {n_test} THEN 'test' ELSE 'train' END AS split
FROM ({inner})"""


_REQUEST_TEXTS = "(SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents WHERE length(text) >= 100)"

_CAUSAL = f"""
tok AS (
  SELECT line_no, {lengths('(' + PROMPT + ')')} AS body,
    len({words('(' + q(PROMPT_HEAD) + ' || en || ' + q(PROMPT_MIDDLE) + ')')}) AS p
  FROM pairs_),
full_ AS (SELECT line_no, [2] || body || [1] AS ids, p FROM tok),
padded AS (
  SELECT line_no, least(len(ids), {{L}}) AS n, least(p, {{L}}) AS m,
    list_slice(ids, 1, {{L}}) || {repeat(0, '{L} - len(ids)')} AS ids
  FROM full_)"""


def causal(pairs: str, max_length: int) -> str:
    return pairs + "," + _CAUSAL.replace("{L}", str(max_length))


_LABELS = f"{repeat(-100, 'm')} || list_slice(ids, m + 1, len(ids))"

_RESULT = "{0} || ': ' || {1}"

ORACLES: dict[str, str] = {
    "read_lines": r"""SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "align_lines": f"WITH {ALIGNED} SELECT line_no, en, ko FROM aligned",
    "read_csv_text": "SELECT page_id, url, html FROM pages",
    "write_csv_text": "SELECT text AS english FROM documents",
    "read_jsonl": """SELECT conv_id, turn, role, text, NULL::varchar AS _corrupt FROM conversations
      UNION ALL SELECT NULL, NULL, NULL, NULL,
        '{"conv_id":' || doc_id || ['} ' || lang, '}}', ',}', ']'][doc_id % 4 + 1] FROM documents""",
    "write_jsonl": f"""WITH {BATCHES} SELECT 'task-' || batch_id AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url,
        'gpt-4o-mini' AS model, 0.7::double AS temperature, 'json_object' AS format, 2::bigint AS n_messages,
        'system' AS system_role, {q(constants.TRANSLATION_SYSTEM_PROMPT_KO)} AS system, 'user' AS user_role, content FROM batches""",
    "save_split": """SELECT doc_id, text, CASE WHEN r <= (SELECT ceil(0.1 * count(*)) FROM documents) THEN 'test' ELSE 'train' END AS split
      FROM (SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents)""",
    "load_split": "SELECT page_id, url, html FROM pages",
    "read_documents": "SELECT text || chr(10) AS text, true AS has_path FROM benchmark",
    "strip": "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents",
    "min_length": "SELECT doc_id, text FROM documents WHERE length(text) >= 100",
    "project_text": "SELECT page_id, html AS text FROM pages",
    "head_rows": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 150",
    "row_range": "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 50 OFFSET 20",
    "full_batches": """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS r,
        count(*) OVER () AS n FROM conversations) WHERE r <= n - n % 10""",
    "max_examples": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 120",
    "profile": " UNION ALL ".join(
        f"""SELECT '{name}' AS corpus, count(*) AS n_rows, '{columns}' AS columns, count(*) - count({col}) AS n_null,
          min(length({col})) AS min_len, max(length({col})) AS max_len FROM {name}"""
        for name, col, columns in (
            ("documents", "text", "doc_id,text,lang,source,n_chars"),
            ("pages", "html", "page_id,url,html"),
            ("benchmark", "text", "item_id,text"),
            ("conversations", "text", "conv_id,turn,role,text"),
        )
    ),
    "preview": "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 3",
    "sample_n": f"SELECT doc_id, text FROM ({hashed('doc_id, text', 'doc_id', 'documents')}) ORDER BY h, doc_id LIMIT 100",
    "shuffle_head": f"""SELECT doc_id, text, row_number() OVER (ORDER BY h, doc_id) - 1 AS shuffle_rank
      FROM ({hashed('doc_id, text', 'doc_id', 'documents')}) ORDER BY h, doc_id LIMIT 150""",
    "split_fraction": split_sql(
        "doc_id",
        "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents",
        "(SELECT ceil(0.1 * count(*)) FROM documents)",
    ),
    "split_count": split_sql(
        "conv_id, turn",
        "SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn) AS r FROM conversations",
        "20",
    ),
    "concat_corpora": """SELECT row_number() OVER (ORDER BY source_ord, pos) - 1 AS rn, source_ord, pos, english FROM (
        SELECT source_ord, row_number() OVER (PARTITION BY source_ord ORDER BY doc_id) - 1 AS pos, text AS english
        FROM (SELECT *, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END::integer AS source_ord
          FROM documents))""",
    "mix_corpora": f"""SELECT row_number() OVER (ORDER BY source_ord, pos) - 1 AS rn, source_ord, pos, text FROM (
        (SELECT 0::integer AS source_ord, row_number() OVER (ORDER BY doc_id) - 1 AS pos, text
          FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 300)
        UNION ALL (SELECT 1, row_number() OVER (ORDER BY page_id) - 1, html FROM pages ORDER BY page_id LIMIT 100)
        UNION ALL (SELECT 2, row_number() OVER (ORDER BY item_id) - 1, text FROM benchmark)
        UNION ALL (SELECT 3, row_number() OVER (ORDER BY conv_id, turn) - 1, text FROM conversations)
        UNION ALL (SELECT 4, row_number() OVER (ORDER BY h, doc_id) - 1, text
          FROM ({hashed('doc_id, text', 'doc_id', 'documents', "lang IS DISTINCT FROM 'en'")}) ORDER BY h, doc_id LIMIT 50))""",
    "dedup_pairs": "SELECT lang, text, min(doc_id) AS doc_id FROM documents GROUP BY lang, text",
    "dense_index": "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS rn FROM documents",
    "prefix_sum": """SELECT doc_id, n_chars, (coalesce(sum(n_chars) OVER (ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS start FROM documents""",
    "batch_rows": f"WITH {BATCHES} SELECT batch_id, n, content FROM batches",
    "build_requests": f"""WITH batches AS (SELECT rn // 10 AS batch_id, string_agg(text, chr(10) ORDER BY rn) AS content
        FROM {_REQUEST_TEXTS} GROUP BY 1)
      SELECT 'task-' || batch_id AS custom_id, {request_json('content', constants.TRANSLATION_SYSTEM_PROMPT_KO)} AS request FROM batches""",
    "combined_requests": f"""WITH chosen AS (
        SELECT * FROM (SELECT 0 AS source_ord, doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r
          FROM documents WHERE lang = 'en' AND length(text) >= 100) WHERE r <= (SELECT count(*) // 5 FROM documents)
        UNION ALL
        SELECT * FROM (SELECT 1 AS source_ord, doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r
          FROM documents WHERE lang IS DISTINCT FROM 'en' AND length(text) >= 30) WHERE r <= (SELECT count(*) // 5 FROM documents)),
      batches AS (SELECT rn // 10 AS batch_id, string_agg(text, chr(10) ORDER BY rn) AS content
        FROM (SELECT text, row_number() OVER (ORDER BY source_ord, doc_id) - 1 AS rn FROM chosen) GROUP BY 1)
      SELECT 'task-' || batch_id AS custom_id, {request_json('content', constants.TRANSLATION_SYSTEM_PROMPT_MULTI)} AS request FROM batches""",
    "parse_responses": f"""WITH {TASKS} SELECT
        CASE WHEN broken AND kind = 0 THEN NULL WHEN broken AND kind = 1 THEN 'task' ELSE 'task-' || b END AS custom_id,
        CASE WHEN broken AND kind IN (0, 1) THEN NULL ELSE b END AS task_idx,
        CASE WHEN NOT broken THEN count(*) END AS n_en,
        CASE WHEN NOT broken THEN count(*) - CASE WHEN shorter THEN 1 ELSE 0 END END AS n_ko,
        CASE WHEN broken THEN {REASONS} END AS error,
        CASE WHEN NOT broken THEN string_agg(text, chr(10) ORDER BY pos) END AS en,
        CASE WHEN NOT broken THEN coalesce(string_agg('ko:' || text, chr(10) ORDER BY pos) FILTER (NOT shorter OR pos < last_pos), '') END AS ko
      FROM tasks GROUP BY b, broken, kind, shorter""",
    "explode_pairs": f"""WITH {TASKS} SELECT b AS task_idx, pos, text AS en, 'ko:' || text AS ko
      FROM tasks WHERE NOT broken AND (NOT shorter OR pos < last_pos)""",
    "quarantine": f"""WITH {TASKS},
      bad AS (SELECT b, kind, list(text ORDER BY pos) AS texts FROM tasks WHERE broken GROUP BY b, kind),
      content AS (SELECT b, kind, CASE kind
          WHEN 3 THEN to_json({{'sentences_en': texts, 'sentences_ko': list_transform(texts, lambda t: 'ko:' || t)}})::varchar || ' trailing'
          WHEN 4 THEN to_json({{'sentences_en': texts}})::varchar
          WHEN 5 THEN to_json({{'sentences_en': 'text', 'sentences_ko': list_transform(texts, lambda t: 'ko:' || t)}})::varchar
          ELSE to_json({{'sentences_en': texts, 'sentences_ko': list_transform(texts, lambda t: 'ko:' || t)}})::varchar END AS content FROM bad),
      lines AS (SELECT kind, to_json({{'custom_id': CASE kind WHEN 1 THEN 'task' ELSE 'task-' || b END,
          'response': {{'body': {{'choices': CASE kind WHEN 2 THEN [] ELSE [{{'message': {{'content': content}}}}] END}}}}}})::varchar AS line FROM content)
      SELECT CASE kind WHEN 0 THEN left(line, length(line) - 1) ELSE line END AS raw, {REASONS} AS reason FROM lines""",
    "build_pairs": f"""WITH {TASKS} SELECT text AS en, 'ko:' || text AS ko, min(b * 10000000000 + pos) AS first_seen
      FROM tasks WHERE NOT broken AND (NOT shorter OR pos < last_pos) GROUP BY text""",
    "missing_tasks": f"WITH {TASKS} SELECT DISTINCT 'task-' || b AS custom_id FROM tasks WHERE broken",
    "explode_multilingual": f"""WITH {TASKS} SELECT b AS task_idx, pos, lang, text AS source, lang || ':' || text AS target
      FROM tasks, (VALUES ('ko'), ('sp'), ('fr'), ('ja')) l(lang)
      WHERE NOT broken AND (NOT shorter OR pos < last_pos)""",
    "bidirectional_examples": f"""WITH {PAIRS}
      SELECT line_no, en AS input_text, ko AS output_text, 'en-ko' AS direction FROM aligned
      UNION ALL SELECT line_no, ko, en, 'ko-en' FROM aligned""",
    "format_prompt": f"WITH {PAIRS} SELECT line_no, {PROMPT} AS text FROM aligned",
    "prompt_only": f"SELECT doc_id, {q(PROMPT_HEAD)} || text || {q(PROMPT_MIDDLE)} AS text FROM documents",
    "append_eos": f"WITH {PAIRS} SELECT line_no, {PROMPT} || '<|end_of_text|>' AS text FROM aligned",
    "extract_answer": f"""SELECT doc_id, string_split({q(PROMPT_HEAD)} || text || {q(PROMPT_MIDDLE)},
        {q(constants.ANSWER_MARKER)})[-1] AS text FROM documents""",
    "build_messages": f"""WITH {EXAMPLES} SELECT conv_id, turn, to_json([
        {{'role': 'system', 'content': {q(constants.CHAT_SYSTEM_PROMPT)}}},
        {{'role': 'user', 'content': {q(constants.CHAT_USER_PREFIX)} || input_text}},
        {{'role': 'assistant', 'content': {q(constants.CHAT_ASSISTANT_PREFIX)} || output_text}}])::varchar AS messages FROM examples""",
    "template_for_model": """SELECT conv_id, turn, model, CASE
        WHEN lower(model) LIKE '%llama-3.1%' OR lower(model) LIKE '%llama-3.2%' THEN 'llama-3.1'
        WHEN lower(model) LIKE '%qwen2.5%' THEN 'qwen2.5' WHEN lower(model) LIKE '%deepseek%' THEN 'zephyr'
        ELSE 'llama-3.1' END AS template
      FROM (SELECT conv_id, turn, ['Llama-3.2-1B', 'meta-LLAMA-3.1-8B', 'QWEN2.5-7B', 'deepseek-r1', 'other'][conv_id % 5 + 1] AS model
        FROM conversations)""",
    "render_chat": f"""WITH {EXAMPLES} SELECT conv_id, turn, {chat_text('llama-3.1')} AS llama, {chat_text('qwen2.5')} AS qwen,
        {chat_text('zephyr')} AS zephyr, {chat_text('qwen2.5', role=True)} AS qwen_open FROM examples""",
    "tokenize": f"""SELECT doc_id, array_to_string({words('text')}, '|') AS words, len({words('text')}) + 2 AS n_tokens,
        {text_of('[2] || ' + lengths('text') + ' || [1]')} AS input_ids FROM documents""",
    "hash_tokens": f"SELECT doc_id, len({words('text')}) AS n_tokens FROM documents",
    "md5_tokens": f"""SELECT doc_id, {text_of("list_transform(" + words('text') + ", lambda w: " + " + ".join(
        f"(strpos('0123456789abcdef', substr(md5(w), {i}, 1)) - 1) * {16 ** (4 - i)}" for i in range(1, 5)) + ")")} AS input_ids FROM documents""",
    "truncate_before_end": f"""WITH t AS (SELECT doc_id, [2] || {lengths('text')} || [1] AS ids FROM documents)
      SELECT doc_id, {text_of("CASE WHEN len(ids) > 128 THEN list_slice(ids, 1, 127) || [1] ELSE ids || " + repeat(0, '128 - len(ids)') + " END")} AS input_ids FROM t""",
    "pad_truncate": f"""WITH t AS (SELECT doc_id, {lengths('text')} AS ids FROM documents)
      SELECT doc_id, {text_of('list_slice(ids, 1, 128) || ' + repeat(0, '128 - len(ids)'))} AS input_ids,
        {text_of(repeat(1, 'least(len(ids), 128)') + ' || ' + repeat(0, '128 - len(ids)'))} AS attention_mask FROM t""",
    "mask_prompt": f"""WITH {causal(PAIRS + ', pairs_ AS (SELECT * FROM aligned)', 512)}
      SELECT line_no, {text_of('ids')} AS input_ids,
        {text_of(repeat(1, 'n') + ' || ' + repeat(0, '512 - n'))} AS attention_mask, {text_of(_LABELS)} AS labels FROM padded""",
    "causal_datasets": f"""WITH {causal(PAIRS + ''', pairs_ AS (SELECT * FROM aligned ORDER BY line_no LIMIT (SELECT (count(*) - 1) // 2 FROM documents))''', 256)}
      SELECT line_no, {text_of(_LABELS)} AS ids,
        CASE WHEN row_number() OVER (ORDER BY md5('42:' || line_no), line_no) <= (SELECT count(*) // 20 FROM documents) THEN 'test' ELSE 'train' END AS split FROM padded""",
    "mask_responses_only": f"""WITH {EXAMPLES}, {masked_chat('qwen2.5', 'conv_id, turn')}
      SELECT conv_id, turn, {text_of('ids')} AS input_ids, {text_of('labels')} AS labels FROM chat""",
    "pack_sequences": packed(f"rows_ AS (SELECT doc_id AS k, {lengths('text')} AS ids FROM documents)", 2048),
    "packed_blocks": packed(
        f"{PAIRS}, rows_ AS (SELECT line_no AS k, {lengths('(' + PROMPT + chr(32) + '||' + chr(32) + q('<|end_of_text|>') + ')')} AS ids FROM aligned)",
        512,
    ),
    "pad_to_batch_max": f"""WITH t AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id, {lengths('text')} AS ids FROM documents),
      w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS w FROM t)
      SELECT doc_id, batch_id, {text_of('ids || ' + repeat(0, 'w - len(ids)'))} AS input_ids,
        {text_of(repeat(1, 'len(ids)') + ' || ' + repeat(0, 'w - len(ids)'))} AS attention_mask,
        {text_of('ids || ' + repeat(-100, 'w - len(ids)'))} AS labels FROM w""",
    "chat_batches": f"""WITH {EXAMPLES}, {masked_chat('llama-3.1', 'conv_id, turn')},
      cut AS (SELECT conv_id, turn, list_slice(labels, 1, 300) AS labels,
        (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch_id FROM chat),
      w AS (SELECT *, max(len(labels)) OVER (PARTITION BY batch_id) AS w FROM cut)
      SELECT conv_id, turn, batch_id, {text_of('labels || ' + repeat(-100, 'w - len(labels)'))} AS labels FROM w""",
    "batch_generate": "SELECT text AS input, 'echo: ' || text AS result FROM documents",
    "map_batches": "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w = reverse(w))) AS n FROM documents",
    "pair_quality": f"""WITH {PAIRS}, m AS (
        SELECT line_no, en, ko, length(en) AS a, length(ko) AS b, len(regexp_extract_all(ko, '[a-z]')) AS s FROM aligned),
      r AS (SELECT line_no, CASE WHEN a > 0 THEN b / a END AS len_ratio, a = 0 OR b = 0 AS is_empty, en = ko AS is_copy,
        CASE WHEN b > 0 THEN s / b ELSE 0.0 END AS share, least(a, b) / greatest(a, b) AS balance FROM m)
      SELECT line_no, round(len_ratio, 6) AS len_ratio, is_empty, is_copy, round(share, 6) AS target_script_share,
        round(CASE WHEN is_empty OR is_copy THEN 0.0 ELSE (balance + share) / 2 END, 6) AS score FROM r""",
    "filter_pairs": f"""WITH {PAIRS}, m AS (
        SELECT line_no, en, ko, length(en) AS a, length(ko) AS b, len(regexp_extract_all(ko, '[a-z]')) AS s FROM aligned)
      SELECT line_no, CASE WHEN a = 0 OR b = 0 THEN 'empty' WHEN en = ko THEN 'copy' WHEN least(a, b) < 30 THEN 'too_short'
          WHEN b / a > 3 OR b / a * 3 < 1 THEN 'length_ratio'
          WHEN (least(a, b) / greatest(a, b) + s / b) / 2 < 0.7 THEN 'low_score' END AS reason FROM m""",
    "aligned_pairs": r"""WITH lines AS (SELECT doc_id, row_number() OVER (PARTITION BY side ORDER BY doc_id, i) - 1 AS line_no, side,
        regexp_replace(line, '^\s+|\s+$', '', 'g') AS line
      FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'ko' END AS side, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
      SELECT min(line_no) AS line_no, e.line AS en, k.line AS ko FROM lines e JOIN lines k USING (line_no)
      WHERE e.side = 'en' AND k.side = 'ko' GROUP BY e.line, k.line""",
    "publish_pairs": f"""WITH {TASKS} SELECT text AS en, 'ko:' || text AS ko, 'pair' AS kind, count(*) * 0 + 1 AS n
      FROM tasks WHERE NOT broken AND (NOT shorter OR pos < last_pos) GROUP BY text
      UNION ALL SELECT NULL, {REASONS}, 'bad', count(DISTINCT b) FROM tasks WHERE broken GROUP BY 2""",
    "split_published": f"""WITH {PAIRS}, pairs AS (SELECT DISTINCT en, ko FROM aligned),
      ranked AS (SELECT en, ko, row_number() OVER (ORDER BY md5('42:' || md5(en) || ':' || md5(ko))) AS r FROM pairs)
      SELECT en, ko, CASE WHEN r <= (SELECT ceil(0.1 * count(*)) FROM pairs) THEN 'test' ELSE 'train' END AS split FROM ranked""",
    "limited_requests": f"""WITH batches AS (SELECT rn // 10 AS batch_id, string_agg(text, chr(10) ORDER BY rn) AS content
        FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)
        WHERE rn < (SELECT count(*) // 2 FROM documents) GROUP BY 1)
      SELECT 'task-' || batch_id AS custom_id, {request_json('content', constants.TRANSLATION_SYSTEM_PROMPT_KO)} AS request FROM batches""",
    "chat_texts": f"WITH {EXAMPLES} SELECT conv_id, turn, {chat_text('llama-3.1')} AS text FROM examples",
    "mask_text_responses": f"""WITH t AS (SELECT conv_id, turn, [{lengths("('Q: ' || text || ' A:')")}, {lengths("(' ' || text || ' ')")}, {lengths("'Q: more A:'")}, {lengths("' yes'")}] AS p FROM conversations)
      SELECT conv_id, turn, {text_of('flatten(p)')} AS input_ids,
        {text_of(repeat(-100, 'len(p[1])') + ' || p[2] || ' + repeat(-100, 'len(p[3])') + ' || p[4]')} AS labels FROM t""",
    "ingest_responses_stream": f"""WITH {TASKS} SELECT DISTINCT text AS en, 'ko:' || text AS ko
      FROM tasks WHERE NOT broken AND (NOT shorter OR pos < last_pos)""",
}

_MODELS = ["Llama-3.2-1B", "Llama-3.2-3B", "Qwen2.5-1.5B", "Qwen2.5-3B"]
ORACLES["fan_out_models"] = " UNION ALL ".join(
    f"SELECT {q(m)} AS model, text AS input, {q(m + ': ')} || text AS result FROM benchmark" for m in _MODELS
)
ORACLES["write_results"] = ORACLES["fan_out_models"]
ORACLES["evaluate_models"] = f"WITH {EXAMPLES} " + " UNION ALL ".join(
    f"""SELECT {q(m)} AS model, input_text AS input,
      {q(m + ': ')} || {chat_text('qwen2.5' if 'Qwen' in m else 'llama-3.1', target=None)} AS result FROM examples"""
    for m in _MODELS
)

# Queries whose rows SQL cannot give: least-cost paths by dynamic programming. They have tests of their own.
WITHOUT_SQL = {"align_drifted"}


def _model1(steps: int, part: int, floor: float = 1e-7) -> str:
    """Steps of expectation maximisation over the words of each line and of its other form."""
    text = rf"""
lines AS (
  SELECT doc_id * 1048576 + i - 1 AS key, list_filter(string_split_regex(lower(ls[i]), '\s+'), lambda w: w <> '') AS e
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))),
both_ AS (
  SELECT key, e, list_transform(list_filter(e, lambda w: length(w) > 2),
    lambda w: substring(w, 2) || substring(w, 1, 1) || 'ay') AS f FROM lines),
cut AS (
  SELECT *, greatest(1, ceil(greatest(len(e), len(f)) / {part}.0))::bigint AS parts FROM both_ WHERE len(f) > 0),
e_ AS (
  SELECT key, ((place - 1) * parts) // n AS part, e[place] AS e, count(*) AS n_e
  FROM (SELECT key, parts, e, len(e) AS n, unnest(range(1, len(e) + 1)) AS place FROM cut) GROUP BY ALL
  UNION ALL SELECT key, unnest(range(0, parts)), '', 1 FROM cut),
f_ AS (
  SELECT key, ((place - 1) * parts) // n AS part, f[place] AS f, count(*) AS n_f
  FROM (SELECT key, parts, f, len(f) AS n, unnest(range(1, len(f) + 1)) AS place FROM cut) GROUP BY ALL),
seen AS (SELECT * FROM e_ JOIN f_ USING (key, part))"""
    for step in range(1, steps + 1):
        known = "(SELECT *, 1.0::double AS t FROM seen)" if step == 1 else f"(SELECT * FROM seen JOIN t{step - 1} USING (e, f))"
        text += f""",
c{step} AS (
  SELECT e, f, sum(n_f * (n_e * t) / total) AS c
  FROM (SELECT *, sum(n_e * t) OVER (PARTITION BY key, part, f) AS total FROM {known}) GROUP BY e, f),
t{step} AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS t FROM c{step})"""
    return text + f""",
chances AS (
  SELECT key, n_f, greatest(sum(n_e * coalesce(t, 0)) / sum(n_e), {floor}) AS chance
  FROM seen LEFT JOIN t{steps} USING (e, f) GROUP BY key, part, f, n_f)"""


ORACLES["lexical_score"] = (
    f"WITH {_model1(2, 12)} SELECT key, round(sum(n_f * ln(chance)) / sum(n_f), 6) AS lexical FROM chances GROUP BY key"
)


def _kneser_ney(size: int) -> str:
    """Chances of all grams of a corpus whose own grams they are."""
    text = f"""
padded AS (SELECT doc_id, repeat(chr(2), {size - 1}) || coalesce(text, '') || chr(3) AS t FROM documents WHERE doc_id IS NOT NULL),
grams AS (
  SELECT doc_id, substring(t, place, {size}) AS gram, count(*) AS n
  FROM (SELECT doc_id, t, unnest(range(1, length(t) - {size - 2})) AS place FROM padded) GROUP BY ALL),
c{size} AS (SELECT gram, sum(n) AS c FROM grams GROUP BY gram)"""
    for order in range(size - 1, 0, -1):
        text += f""",
c{order} AS (SELECT substring(gram, 2) AS gram, count(*) AS c FROM c{order + 1} GROUP BY 1)"""
    for order in range(1, size + 1):
        below = f"p{order - 1}.p" if order > 1 else "(1.0 / (SELECT count(*) FROM c1))"
        lower = f"JOIN p{order - 1} ON p{order - 1}.gram = substring(x.gram, 2)" if order > 1 else ""
        text += f""",
d{order} AS (
  SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2.0 * n2) ELSE 0.5 END AS d
  FROM (SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2 FROM c{order})),
p{order} AS (
  SELECT x.gram, greatest(c - d, 0) / total + d * kinds / total * {below} AS p
  FROM (SELECT gram, c, sum(c) OVER w AS total, count(*) OVER w AS kinds
        FROM c{order} WINDOW w AS (PARTITION BY substring(gram, 1, {order - 1}))) x
  CROSS JOIN d{order} {lower})"""
    return text


ORACLES["text_fluency"] = f"""WITH {_kneser_ney(3)}
  SELECT doc_id, (sum(n) - 1)::bigint AS n_chars, round(sum(n * log2(p)) / sum(n), 6) AS fluency
  FROM grams JOIN p3 USING (gram) GROUP BY doc_id"""

ORACLES["split_groups"] = f"""WITH RECURSIVE {PAIRS},
  linked AS (
    SELECT DISTINCT a.line_no AS x, b.line_no AS y FROM aligned a JOIN aligned b ON a.en = b.en OR a.ko = b.ko),
  reached AS (SELECT x, y FROM linked UNION SELECT r.x, l.y FROM reached r JOIN linked l ON r.y = l.x),
  named AS (
    SELECT x AS line_no, min(least(md5('0:' || en), md5('1:' || ko))) AS g
    FROM reached JOIN aligned ON line_no = y GROUP BY x),
  wanted AS (SELECT ceil(0.1 * count(*)) AS n FROM aligned),
  sized AS (SELECT g, count(*) AS size FROM named GROUP BY g),
  filled AS (
    SELECT g, sum(size) OVER (ORDER BY md5('42:' || g)) AS until FROM sized WHERE size <= (SELECT n FROM wanted))
  SELECT line_no, CASE WHEN until <= (SELECT n FROM wanted) THEN 'test' ELSE 'train' END AS split
  FROM named LEFT JOIN filled USING (g)"""

ORACLES["read_csv_splits"] = "SELECT doc_id, nullif(text, '') AS text FROM documents"
ORACLES["resume_generate"] = ORACLES["batch_generate"]
ORACLES["token_batches"] = """WITH RECURSIVE
  numbered AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents WHERE doc_id IS NOT NULL),
  walk AS (
    SELECT rn, doc_id, 0::bigint AS batch_id, 1::bigint AS size, n AS top FROM numbered WHERE rn = 0
    UNION ALL
    SELECT b.rn, b.doc_id,
      CASE WHEN w.size < 64 AND (w.size + 1) * greatest(w.top, b.n) <= 50000 THEN w.batch_id ELSE w.batch_id + 1 END,
      CASE WHEN w.size < 64 AND (w.size + 1) * greatest(w.top, b.n) <= 50000 THEN w.size + 1 ELSE 1 END,
      CASE WHEN w.size < 64 AND (w.size + 1) * greatest(w.top, b.n) <= 50000 THEN greatest(w.top, b.n) ELSE b.n END
    FROM walk w JOIN numbered b ON b.rn = w.rn + 1)
  SELECT doc_id, rn, batch_id, max(top) OVER (PARTITION BY batch_id) AS batch_len FROM walk"""
ORACLES["profile_sketches"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS corpus, count(*) AS n_rows, count(*) - count({text}) AS n_null, coalesce(sum(length({text})), 0)::bigint AS n_chars,
      min(length({text})) AS min_len, max(length({text})) AS max_len, true AS near FROM {name}"""
    for name, text in (("documents", "text"), ("pages", "html"))
)
