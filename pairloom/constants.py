"""Prompt texts, role markers and sizes that results depend on."""

from __future__ import annotations

# --- Fixed values (must stay exactly as they are) ---------------------------------------------

TRANSLATION_SYSTEM_PROMPT_KO = """
You are a professional translator, fluent in both English and Korean.
Your goal is to translate the following 10 sentences from English to Korean.
You will be provided with a list of 10 English sentences, and you will output a json object containing the Korean translation of each sentence.

{
    sentences_en: string[] // Array of 10 English sentences
    sentences_ko: string[] // Array of 10 Korean translations of the English sentences
}

Please produce translations that read naturally in Korean. Use polite, standard Korean (존댓말) and maintain the original context as much as possible.
"""

TRANSLATION_SYSTEM_PROMPT_MULTI = """
You are a professional translator, fluent in English, Korean, Spanish, French, and Japanese.
Your goal is to translate the following 10 sentences from English to other languages(Korean, Spanish, French, Japanese).
You will be provided with a list of 10 English sentences, and you will output json objects containing the translation of each sentence per language.

{
    sentences_en: string[] // Array of 10 English sentences
    sentences_ko: string[] // Array of 10 Korean translations of the English sentences
    sentences_sp: string[] // Array of 10 Spanish translations of the English sentences
    sentences_fr: string[] // Array of 10 French translations of the English sentences
    sentences_ja: string[] // Array of 10 Japanese translations of the English sentences
}

Adhere to the following guidelines during translation:

1. **Maintain Proper Nouns and Technical Terms**: Keep product names, brand names, and technical terms in their original form, or use established translations if available.
2. **Preserve Meaning**: Accurately convey the meaning of the original text while maintaining the style and tone.
3. **Ensure Consistency**: Refer to the translation glossary to guarantee consistent use of terminology.
4. **Consider Cultural and Linguistic Differences**: Reflect the cultural background and linguistic characteristics of the target language to ensure a natural translation. Add annotations or explanations if necessary.
5. **Understand Context**: Consider the surrounding context of the sentence to choose appropriate translation strategies (literal translation, free translation, transliteration, etc.).
"""

# Instruction template with a slot for the source and one for the target.
PROMPT_TEMPLATE = (
    "You are a professional English-to-Korean translator. "
    "Your task is to produce an accurate and natural-sounding Korean translation "
    "of the given English text while preserving the original meaning, tone, and context. "
    "Please do not add, remove, or alter any information.\n\n"
    "### English Text:\n"
    "{}\n\n"
    "### Korean Translation:\n"
    "{}"
)

ANSWER_MARKER = "information.\n\n"

# The missing space in "English.your" is part of the value.
CHAT_SYSTEM_PROMPT = (
    "You are a highly capable bilingual translation assistant, skilled in both Korean and English."
    "your task is to accurately translate the given text while preserving meaning, tone, and style. Follow these guidelines carefully:\n\n"
    "1. If the given text is in Korean, translate it into English. If the given text is in English, translate it into Korean.\n"
    "2. Preserve the original meaning, Maintain the tone and style of the given text.\n"
    "3. **Proper nouns** (e.g. names, places, organizations) should remain in their original form unless widely accepted translations exist."
)
CHAT_USER_PREFIX = "*** Input Text:\n"
CHAT_ASSISTANT_PREFIX = "*** Translation:\n"

# Chat layout per template: text before the first message, text around one message.
# {role} is replaced by the message's role.
CHAT_TEMPLATES = {
    "llama-3.1": {
        "begin": "<|begin_of_text|>",
        "header": "<|start_header_id|>{role}<|end_header_id|>\n\n",
        "end": "<|eot_id|>",
    },
    "qwen2.5": {"begin": "", "header": "<|im_start|>{role}\n", "end": "<|im_end|>\n"},
    "zephyr": {"begin": "", "header": "<|{role}|>\n", "end": "</s>\n"},
}

# Lower-case part of a model name -> template; the first match wins.
MODEL_ROUTES = [
    ("llama-3.1", "llama-3.1"),
    ("llama-3.2", "llama-3.1"),
    ("qwen2.5", "qwen2.5"),
    ("deepseek", "zephyr"),
]

# Evaluation knows fewer families and gives every other model this template.
EVALUATION_ROUTES = [
    ("llama-3.1", "llama-3.1"),
    ("llama-3.2", "llama-3.1"),
    ("qwen2.5", "qwen2.5"),
]
EVALUATION_DEFAULT = "llama-3.1"

IGNORE_INDEX = -100
REQUEST_MODEL = "gpt-4o-mini"
REQUEST_TEMPERATURE = 0.7
REQUEST_URL = "/v1/chat/completions"
BATCH_SIZE = 10
MULTI_LANGS = ("en", "ko", "sp", "fr", "ja")

# --- End of fixed values ------------------------------------------------------------------------
