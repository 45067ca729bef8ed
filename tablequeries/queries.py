"""One query per operator. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom import constants, schemas
from pairloom.functions import chat, text, tokens
from pairloom.operators import (
    budget,
    chats,
    combine,
    drift,
    features,
    fluency,
    generate,
    groups,
    lexical,
    order,
    quality,
    requests,
    responses,
    sample,
    select,
    sketches,
)
from pairloom.operators.combine import Source
from pairloom.plans import corpus, evaluation, training
from pairloom.session import scratch_dir
from pairloom.sources import csv_splits, readers, writers
from pairloom.streaming import responses as response_stream
from tablequeries import inputs
from tablequeries.inputs import joined, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Token id = word length, which any engine can compute.
LENGTH_TOKENS = tokens.word_tokenizer(F.length, bos_id=2, eos_id=1, pad_id=0)
# Bytes of text that go into one large CSV file.
CSV_BYTES = 256 << 20


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- Sources and sinks: write the table, read it back ------------------------------------------


@query
def read_lines(spark, sf_dir):
    path = scratch_dir(spark, "lines")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").write.text(path)
    return readers.read_lines(spark, path)


@query
def align_lines(spark, sf_dir):
    return inputs.aligned(spark, sf_dir)


@query
def read_csv_text(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    pages = table(spark, sf_dir, "pages")
    writers.write_csv_text(pages, path)
    return readers.read_csv_text(spark, path, pages.schema)


@query
def write_csv_text(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    docs = select.project_text(table(spark, sf_dir, "documents"), "text", "english")
    writers.write_csv_text(docs, path)
    return readers.read_csv_text(spark, path, schemas.ENGLISH)


@query
def read_jsonl(spark, sf_dir):
    path = scratch_dir(spark, "jsonl")
    turns = table(spark, sf_dir, "conversations")
    writers.write_jsonl(turns.select(F.struct("*").alias("row")), "row", path)
    # Lines that are nearly right, in four ways in turn.
    tail = F.array(F.concat(F.lit("} "), "lang"), F.lit("}}"), F.lit(",}"), F.lit("]"))
    docs = table(spark, sf_dir, "documents")
    bad = F.concat(F.lit('{"conv_id":'), "doc_id", F.get(tail, (F.col("doc_id") % 4).cast("int")))
    docs.select(bad.alias("value")).write.mode("append").text(path)
    return readers.read_jsonl(spark, path, turns.schema).select(*turns.columns, "_corrupt")


@query
def write_jsonl(spark, sf_dir):
    path = scratch_dir(spark, "requests")
    batches = requests.batch_rows(table(spark, sf_dir, "documents"), "text", order_by="doc_id")
    writers.write_jsonl(requests.build_requests(batches), "request", path, rows_per_file=50_000)
    lines = readers.read_jsonl(spark, path, schemas.REQUEST)
    return lines.select(
        "custom_id",
        "method",
        "url",
        F.col("body.model").alias("model"),
        F.col("body.temperature").alias("temperature"),
        F.col("body.response_format.type").alias("format"),
        F.array_size("body.messages").cast("bigint").alias("n_messages"),
        F.get("body.messages", F.lit(0))["role"].alias("system_role"),
        F.get("body.messages", F.lit(0))["content"].alias("system"),
        F.get("body.messages", F.lit(1))["role"].alias("user_role"),
        F.get("body.messages", F.lit(1))["content"].alias("content"),
    )


@query
def save_split(spark, sf_dir):
    base = scratch_dir(spark, "split")
    train, test = sample.split_fraction(table(spark, sf_dir, "documents"), 0.1, 42, "doc_id")
    writers.save_split(train, base, "documents", "train")
    writers.save_split(test, base, "documents", "test")
    parts = [readers.load_split(spark, base, "documents", name) for name in ("train", "test")]
    return _labelled(*parts, ["doc_id", "text"])


@query
def load_split(spark, sf_dir):
    base = scratch_dir(spark, "split")
    writers.save_split(table(spark, sf_dir, "pages"), base, "pages", "train")
    return readers.load_split(spark, base, "pages", "train")


@query
def read_documents(spark, sf_dir):
    path = scratch_dir(spark, "documents")
    items = table(spark, sf_dir, "benchmark").select("text")
    items.write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_documents(spark, path).select("text", F.col("path").like("%/part-%.txt").alias("has_path"))


@query
def write_results(spark, sf_dir):
    path = scratch_dir(spark, "results")
    writers.write_results(fan_out_models(spark, sf_dir), path)
    schema = "model string, input string, result string"
    return spark.read.schema(schema).json(path).select("model", "input", "result")


# --- Filters, projections, positions -----------------------------------------------------------


@query
def strip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    padded = F.concat(F.lit(" \t\n"), "text", F.lit("\r\n "))
    return docs.select("doc_id", text.strip(padded).alias("text"))


@query
def min_length(spark, sf_dir):
    return select.min_length(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 100)


@query
def project_text(spark, sf_dir):
    return select.project_text(table(spark, sf_dir, "pages"), "html", "text", keep=["page_id"])


@query
def head_rows(spark, sf_dir):
    return select.head_rows(table(spark, sf_dir, "documents"), 150, "doc_id").select("doc_id", "text")


@query
def row_range(spark, sf_dir):
    return select.row_range(table(spark, sf_dir, "conversations"), 20, 70, ["conv_id", "turn"])


@query
def full_batches(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return select.full_batches(turns, 10, ["conv_id", "turn"])


@query
def max_examples(spark, sf_dir):
    return select.max_examples(table(spark, sf_dir, "documents"), 120, "doc_id").select("doc_id", "lang")


@query
def profile(spark, sf_dir):
    names = {"documents": "text", "pages": "html", "benchmark": "text", "conversations": "text"}
    return select.profile({n: (table(spark, sf_dir, n), c) for n, c in names.items()})


@query
def preview(spark, sf_dir):
    return select.preview(table(spark, sf_dir, "pages"), 3, "page_id").select("page_id", "url")


# --- Samples and splits ------------------------------------------------------------------------


@query
def sample_n(spark, sf_dir):
    return sample.sample_n(table(spark, sf_dir, "documents"), 100, 42, "doc_id").select("doc_id", "text")


@query
def shuffle_head(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample.shuffle_head(docs, 150, 42, "doc_id")


def _labelled(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    return train.select(*columns, F.lit("train").alias("split")).unionByName(
        test.select(*columns, F.lit("test").alias("split"))
    )


@query
def split_fraction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _labelled(*sample.split_fraction(docs, 0.1, 42, "doc_id"), ["doc_id"])


@query
def split_count(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return _labelled(*sample.split_count(turns, 20, 42, ["conv_id", "turn"]), ["conv_id", "turn"])


# --- Unions and duplicates ---------------------------------------------------------------------


@query
def concat_corpora(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    named = ("en", "fr", "de", "es")
    others = ~F.coalesce(F.col("lang").isin(*named), F.lit(False))
    parts = [F.col("lang") == lang for lang in named] + [others]
    return combine.concat_corpora([(docs.filter(part), "text", "doc_id") for part in parts])


@query
def mix_corpora(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    turns = table(spark, sf_dir, "conversations")
    return combine.mix_corpora(
        [
            Source(docs.filter(F.col("lang") == "en"), "text", "doc_id", "head", 300),
            Source(table(spark, sf_dir, "pages"), "html", "page_id", "head", 100),
            Source(table(spark, sf_dir, "benchmark"), "text", "item_id"),
            Source(turns, "text", ["conv_id", "turn"]),
            Source(docs.filter(~inputs.english()), "text", "doc_id", "shuffle", 50),
        ],
        seed=42,
    )


@query
def dedup_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return combine.dedup_pairs(docs, ["lang", "text"], "doc_id")


# --- Numbering and requests --------------------------------------------------------------------


@query
def dense_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return order.dense_index(docs, ["lang", "doc_id"])


@query
def prefix_sum(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return order.prefix_sum(docs, "doc_id", F.col("n_chars"))


@query
def batch_rows(spark, sf_dir):
    return requests.batch_rows(table(spark, sf_dir, "documents"), "text", order_by="doc_id")


@query
def build_requests(spark, sf_dir):
    """The flagship: which request goes out for each run of ten long texts."""
    docs = table(spark, sf_dir, "documents")
    batches = requests.batch_rows(select.min_length(docs, "text", 100), "text", order_by="doc_id")
    return requests.build_requests(batches).select("custom_id", F.to_json("request").alias("request"))


@query
def combined_requests(spark, sf_dir):
    """Long lines of two corpora, sampled, combined, batched and wrapped."""
    docs = table(spark, sf_dir, "documents")
    subtitles = docs.filter(F.col("lang") == "en").select(F.col("doc_id").alias("line_no"), F.col("text").alias("line"))
    talks = docs.filter(~inputs.english()).select(F.col("doc_id").alias("line_no"), F.col("text").alias("en"))
    both = corpus.combined_english(subtitles, talks, n=docs.count() // 5)
    sent = corpus.translation_requests(
        both, "english", system_prompt=constants.TRANSLATION_SYSTEM_PROMPT_MULTI
    )
    return sent.select("custom_id", F.to_json("request").alias("request"))


# --- Responses ---------------------------------------------------------------------------------


@query
def parse_responses(spark, sf_dir):
    parsed = responses.parse_responses(inputs.responses(spark, sf_dir))
    return parsed.select(
        "custom_id",
        "task_idx",
        "n_en",
        "n_ko",
        "error",
        F.array_join("sentences_en", "\n").alias("en"),
        F.array_join("sentences_ko", "\n").alias("ko"),
    )


@query
def explode_pairs(spark, sf_dir):
    return responses.explode_pairs(responses.parse_responses(inputs.responses(spark, sf_dir)))


@query
def quarantine(spark, sf_dir):
    return responses.quarantine(responses.parse_responses(inputs.responses(spark, sf_dir)))


@query
def build_pairs(spark, sf_dir):
    pairs = responses.build_pairs(inputs.responses(spark, sf_dir), keep_order=True)
    return pairs.select("en", "ko", F.col("first_seen").cast("bigint").alias("first_seen"))


@query
def missing_tasks(spark, sf_dir):
    batches = requests.batch_rows(table(spark, sf_dir, "documents"), "text", order_by="doc_id")
    sent = requests.build_requests(batches).select("custom_id")
    return responses.missing_tasks(sent, responses.parse_responses(inputs.responses(spark, sf_dir)))


@query
def explode_multilingual(spark, sf_dir):
    lines = inputs.responses(spark, sf_dir, constants.MULTI_LANGS)
    parsed = responses.parse_responses(lines, constants.MULTI_LANGS)
    return responses.explode_multilingual(parsed)


@query
def bidirectional_examples(spark, sf_dir):
    return responses.bidirectional_examples(inputs.pairs(spark, sf_dir), keep=["line_no"])


# --- Prompts and chats -------------------------------------------------------------------------


@query
def format_prompt(spark, sf_dir):
    pairs = inputs.pairs(spark, sf_dir)
    return pairs.select("line_no", text.format_prompt("en", "ko").alias("text"))


@query
def prompt_only(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.prompt_only("text").alias("text"))


@query
def append_eos(spark, sf_dir):
    pairs = inputs.pairs(spark, sf_dir)
    prompt = text.format_prompt("en", "ko")
    return pairs.select("line_no", text.append_eos(prompt, "<|end_of_text|>").alias("text"))


@query
def extract_answer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.extract_answer(text.prompt_only("text")).alias("text"))


@query
def build_messages(spark, sf_dir):
    rows = chats.build_messages(inputs.examples(spark, sf_dir))
    return rows.select("conv_id", "turn", F.to_json("messages").alias("messages"))


@query
def template_for_model(spark, sf_dir):
    names = ["Llama-3.2-1B", "meta-LLAMA-3.1-8B", "QWEN2.5-7B", "deepseek-r1", "other"]
    turns = table(spark, sf_dir, "conversations")
    model = F.get(F.array(*[F.lit(n) for n in names]), (F.col("conv_id") % len(names)).cast("int"))
    return turns.select("conv_id", "turn", model.alias("model")).withColumn(
        "template", chat.template_for_model("model", default="llama-3.1")
    )


@query
def render_chat(spark, sf_dir):
    rows = chats.build_messages(inputs.examples(spark, sf_dir))
    return rows.select(
        "conv_id",
        "turn",
        *[chat.render_chat("messages", name).alias(alias) for name, alias in
          (("llama-3.1", "llama"), ("qwen2.5", "qwen"), ("zephyr", "zephyr"))],
        chat.render_chat("messages", "qwen2.5", add_generation_prompt=True).alias("qwen_open"),
    )


# --- Token features ----------------------------------------------------------------------------


@query
def tokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = features.tokenize(docs, "text", LENGTH_TOKENS, add_special=True)
    return rows.select(
        "doc_id",
        F.array_join(tokens.words("text"), "|").alias("words"),
        F.size("input_ids").cast("bigint").alias("n_tokens"),
        joined("input_ids").alias("input_ids"),
    )


@query
def hash_tokens(spark, sf_dir):
    """Default tokenizer; its ids are Spark hashes, so only counts and equality are compared."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = features.tokenize(docs, "text")
    return rows.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"))


def _md5_id(word):
    """The first four hexadecimal digits of the word's md5, as a number."""
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(word), i, 1)) - 1
    return digit(1) * 4096 + digit(2) * 256 + digit(3) * 16 + digit(4)


@query
def md5_tokens(spark, sf_dir):
    """A tokenizer with fixed ids that any engine can compute."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = features.tokenize(docs, "text", tokens.word_tokenizer(_md5_id))
    return rows.select("doc_id", joined("input_ids").alias("input_ids"))


@query
def truncate_before_end(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = features.tokenize(docs, "text", LENGTH_TOKENS, add_special=True)
    return features.pad_truncate(ids, 128, 0, keep_end=1).select("doc_id", joined("input_ids").alias("input_ids"))


@query
def pad_truncate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = features.pad_truncate(features.tokenize(docs, "text", LENGTH_TOKENS), 128, 0)
    return rows.select(
        "doc_id", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask")
    )


@query
def mask_prompt(spark, sf_dir):
    rows = training.causal_features(inputs.pairs(spark, sf_dir), LENGTH_TOKENS, max_length=512)
    return rows.select(
        "line_no",
        joined("input_ids").alias("input_ids"),
        joined("attention_mask").alias("attention_mask"),
        joined("labels").alias("labels"),
    )


@query
def causal_datasets(spark, sf_dir):
    """Cap, split off a validation set, then features with padding masked as well."""
    pairs, n = inputs.counted_pairs(spark, sf_dir)
    train, validation = training.causal_datasets(
        pairs,
        LENGTH_TOKENS,
        "line_no",
        max_examples=n // 2,
        n_validation=(n + 1) // 20,
        max_length=256,
        n_rows=n,
    )
    return _labelled(
        train.withColumn("ids", joined("labels")), validation.withColumn("ids", joined("labels")), ["line_no", "ids"]
    )


@query
def mask_responses_only(spark, sf_dir):
    rows = chats.build_messages(inputs.examples(spark, sf_dir))
    rows = features.mask_responses_only(rows, LENGTH_TOKENS, template="qwen2.5")
    return rows.select(
        "conv_id", "turn", joined("input_ids").alias("input_ids"), joined("labels").alias("labels")
    )


@query
def mask_text_responses(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    chat_text = F.concat(F.lit("Q: "), "text", F.lit(" A: "), "text", F.lit(" Q: more A: yes"))
    rows = features.mask_text_responses(turns.withColumn("chat", chat_text), "chat", "Q:", "A:", LENGTH_TOKENS)
    return rows.select("conv_id", "turn", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query
def chat_texts(spark, sf_dir):
    rows = training.chat_texts(inputs.examples(spark, sf_dir), "Llama-3.2-1B")
    return rows.select("conv_id", "turn", "text")


@query
def pack_sequences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = features.pack_sequences(features.tokenize(docs, "text", LENGTH_TOKENS), 2048, "doc_id")
    return rows.select("block", joined("input_ids").alias("input_ids"))


@query
def packed_blocks(spark, sf_dir):
    rows = training.packed_blocks(
        inputs.pairs(spark, sf_dir), LENGTH_TOKENS, "line_no", "<|end_of_text|>", block=512
    )
    return rows.select("block", joined("input_ids").alias("input_ids"))


@query
def pad_to_batch_max(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = features.tokenize(docs, "text", LENGTH_TOKENS).withColumn("labels", F.col("input_ids"))
    rows = features.pad_to_batch_max(ids, 16, "doc_id", pad_id=0)
    return rows.select(
        "doc_id",
        "batch_id",
        joined("input_ids").alias("input_ids"),
        joined("attention_mask").alias("attention_mask"),
        joined("labels").alias("labels"),
    )


@query
def chat_batches(spark, sf_dir):
    rows = training.chat_batches(
        inputs.examples(spark, sf_dir),
        LENGTH_TOKENS,
        "Llama-3.2-1B",
        ["conv_id", "turn"],
        batch_size=8,
        max_length=300,
    )
    return rows.select("conv_id", "turn", "batch_id", joined("labels").alias("labels"))


# --- Inference, quality, streaming -------------------------------------------------------------


def echo_generator(params):
    """Stands in for a model: gives the text back under the model's name."""
    name = params.get("model", "echo")
    return lambda texts: [f"{name}: {t}" for t in texts]


@query
def batch_generate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return generate.batch_generate(docs, "text", echo_generator, generate.settings_from_env({}))


@query
def fan_out_models(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return generate.fan_out_models(items, inputs.MODELS, "text", echo_generator)


@query
def evaluate_models(spark, sf_dir):
    test = inputs.examples(spark, sf_dir).select("input_text")
    return evaluation.evaluate_models(test, inputs.MODELS, echo_generator)


@query
def map_batches(spark, sf_dir):
    """Words that read the same backwards: a test per word in Python."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return generate.map_batches(
        docs,
        lambda batch: batch[["doc_id"]].assign(n=[sum(w == w[::-1] for w in t.split(" ")) for t in batch["text"].fillna("")]),
        "doc_id bigint, n bigint",
    )


@query
def pair_quality(spark, sf_dir):
    rows = quality.pair_quality(inputs.pairs(spark, sf_dir), script="[a-z]")
    return rows.select(
        "line_no",
        F.round("len_ratio", 6).alias("len_ratio"),
        "is_empty",
        "is_copy",
        F.round("target_script_share", 6).alias("target_script_share"),
        F.round("score", 6).alias("score"),
    )


@query
def filter_pairs(spark, sf_dir):
    kept, dropped = quality.filter_pairs(
        inputs.pairs(spark, sf_dir), min_score=0.7, min_chars=30, script="[a-z]"
    )
    return kept.select("line_no", F.lit(None).cast("string").alias("reason")).unionByName(
        dropped.select("line_no", "reason")
    )


@query
def aligned_pairs(spark, sf_dir):
    """Two line files, written from the documents, to distinct pairs."""
    base = scratch_dir(spark, "lines")
    docs = table(spark, sf_dir, "documents")
    for name, part in (("en", docs.filter(inputs.english())), ("ko", docs.filter(~inputs.english()))):
        part.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(
            "text"
        ).write.text(f"{base}/{name}")
    return corpus.aligned_pairs(spark, f"{base}/en", f"{base}/ko").select("line_no", "en", "ko")


@query
def align_drifted(spark, sf_dir):
    """Each document's lines with its lines in capitals, of which one in sixteen is lacking."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    left = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    digest = F.md5(F.concat_ws(":", "doc_id", "line_no"))
    kept = left.filter(~digest.startswith("0")).select("doc_id", "line_no", F.upper("line").alias("line"))
    in_file = Window.partitionBy("doc_id").orderBy("line_no")  # lines of one document
    right = kept.withColumn("line_no", F.row_number().over(in_file) - 1)
    found = drift.align_drifted(left, right, by=["doc_id"])
    return found.select("doc_id", "left_no", "n_left", "right_no", "n_right", "en", "ko")


@query
def read_csv_splits(spark, sf_dir):
    """Texts with quotes and line breaks, written to few large files and read in many tasks."""
    path = scratch_dir(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Two files, or as many as keep what one task reads and writes to a size.
    n_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    writers.write_csv_text(docs.coalesce(max(2, -(-n_bytes // CSV_BYTES))), path, rows_per_file=None)
    return csv_splits.read_csv_splits(spark, path, docs.schema)


@query
def token_batches(spark, sf_dir):
    """Documents in batches of 50,000 characters at most, counted with padding."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", "n_chars")
    return budget.token_batches(docs, 50_000, "doc_id", "n_chars", most_rows=64).drop("n_chars")


@query
def resume_generate(spark, sf_dir):
    """The second of two runs over one store, which finds all results there."""
    store = scratch_dir(spark, "store")
    docs = table(spark, sf_dir, "documents")
    generate.resume_generate(docs.filter("doc_id % 2 = 0"), "text", echo_generator, store).count()
    return generate.resume_generate(docs, "text", echo_generator, store)


@query
def profile_sketches(spark, sf_dir):
    """Merged profiles of parts of two tables; how many texts differ is within four deviations."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    parts = [docs.filter(F.pmod(F.xxhash64("text"), F.lit(3)) == i) for i in range(3)]
    rows = sketches.sketch(pages, "html", "pages")
    for part in parts:
        rows = rows.unionByName(sketches.sketch(part, "text", "documents"))
    exact = docs.agg(F.lit("documents").alias("corpus"), F.count_distinct("text").alias("n")).unionByName(
        pages.agg(F.lit("pages").alias("corpus"), F.count_distinct("html").alias("n"))
    )
    found = sketches.estimates(sketches.merge(rows)).join(exact, "corpus")
    near = F.abs(F.col("n_different") - F.col("n")) <= 0.033 * F.col("n") + 1
    return found.select("corpus", "n_rows", "n_null", "n_chars", "min_len", "max_len", near.alias("near"))


@query
def lexical_score(spark, sf_dir):
    """How well the words of each line and of its other form give each other, in parts of twelve words."""
    pairs = inputs.line_pairs(spark, sf_dir)
    found = lexical.score(pairs, lexical.learn(pairs, "key", steps=2, part=12), "key", part=12)
    return found.select("key", F.round("lexical", 6).alias("lexical"))


@query
def text_fluency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    found = fluency.score(docs, fluency.learn(docs, size=3), "doc_id")
    return found.select("doc_id", "n_chars", F.round("fluency", 6).alias("fluency"))


@query
def split_groups(spark, sf_dir):
    """Pairs of a document and the next one, those with a text in common on one side."""
    pairs = inputs.pairs(spark, sf_dir)
    return _labelled(*groups.split_groups(pairs, 42, fraction=0.1), ["line_no"])


@query
def publish_pairs(spark, sf_dir):
    """The saved pairs, and how many lines were set aside for each reason."""
    base = scratch_dir(spark, "published")
    inputs.responses(spark, sf_dir).select("value").write.text(f"{base}/in")
    pairs, bad = corpus.publish_pairs(spark, f"{base}/in", base, "pairs")
    counts = bad.groupBy(F.col("reason").alias("ko")).agg(F.count("*").alias("n"))
    return pairs.select("en", "ko", F.lit("pair").alias("kind"), F.lit(1).cast("bigint").alias("n")).unionByName(
        counts.select(F.lit(None).cast("string").alias("en"), "ko", F.lit("bad").alias("kind"), "n")
    )


@query
def split_published(spark, sf_dir):
    # Written, as the split reads its pairs three times.
    pairs = order.written(inputs.pairs(spark, sf_dir).select("en", "ko").distinct(), "pairs")
    return _labelled(*corpus.split_published(pairs, 42), ["en", "ko"])


@query
def limited_requests(spark, sf_dir):
    """Requests for the first half of a numbered corpus only."""
    docs = table(spark, sf_dir, "documents")
    numbered = order.dense_index(docs.select("doc_id", "text"), "doc_id")
    sent = corpus.translation_requests(numbered, "text", limit=docs.count() // 2)
    return sent.select("custom_id", F.to_json("request").alias("request"))


@query
def ingest_responses_stream(spark, sf_dir):
    base = scratch_dir(spark, "stream")
    lines = order.written(inputs.responses(spark, sf_dir), path=f"{base}/lines")
    in_dir, out_dir, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    for drop in (0, 1):
        part = lines.filter(F.col("batch_id") % 2 == drop).select("value")
        part.write.mode("append").text(in_dir, compression="gzip")
        response_stream.ingest_responses_stream(spark, in_dir, out_dir, checkpoint).awaitTermination()
    return response_stream.read_pairs(spark, out_dir)
