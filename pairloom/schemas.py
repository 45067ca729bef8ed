"""Every schema the package reads or writes, fixed so that nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

ENGLISH = T.StructType([T.StructField("english", T.StringType())])
TEXT = T.StructType([T.StructField("text", T.StringType())])
PAIR = T.StructType([T.StructField("en", T.StringType()), T.StructField("ko", T.StringType())])

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)

REQUEST = T.StructType(
    [
        T.StructField("custom_id", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField(
            "body",
            T.StructType(
                [
                    T.StructField("model", T.StringType()),
                    T.StructField("temperature", T.DoubleType()),
                    T.StructField(
                        "response_format",
                        T.StructType([T.StructField("type", T.StringType())]),
                    ),
                    T.StructField("messages", MESSAGES),
                ]
            ),
        ),
    ]
)

# Only the part of a response line that is used; other fields are skipped by the JSON reader.
RESPONSE = T.StructType(
    [
        T.StructField("custom_id", T.StringType()),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField(
                        "body",
                        T.StructType(
                            [
                                T.StructField(
                                    "choices",
                                    T.ArrayType(
                                        T.StructType(
                                            [
                                                T.StructField(
                                                    "message",
                                                    T.StructType(
                                                        [T.StructField("content", T.StringType())]
                                                    ),
                                                )
                                            ]
                                        )
                                    ),
                                )
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)

RESULT = T.StructType(
    [T.StructField("input", T.StringType()), T.StructField("result", T.StringType())]
)


def sentences(langs) -> T.StructType:
    """Content object of a response: one array of strings per language."""
    return T.StructType(
        [T.StructField(f"sentences_{lang}", T.ArrayType(T.StringType())) for lang in langs]
    )
