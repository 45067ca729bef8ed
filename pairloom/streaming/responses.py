"""Response files that arrive over time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators import order, responses
from pairloom.streaming import history

# Below this many new pairs, their digests are broadcast to look them up in what is written.
BROADCAST_DIGESTS = 500_000

_PAIRS = "en string, ko string, digest binary, query string, batch_id bigint"


def pair_digest():
    """Digest of a pair; a null and an empty text differ."""
    return F.unhex(F.sha2(F.to_json(F.struct("en", "ko")), 256))


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that is kept beside a checkpoint; a new checkpoint gets a new one."""
    path = f"{checkpoint}/pairloom_id"
    try:
        return spark.read.text(path).first().value
    except AnalysisException:
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").write.text(path)
        return spark.read.text(path).first().value


def ingest_responses_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Pick up response files as they land; append new pairs and quarantined lines.

    Handles everything that is there and then stops (``availableNow``); run it again for later
    files. Pairs go to ``out_dir/pairs/query=<id>/batch_id=<n>``, bad lines to a like folder below
    ``quarantine``. The id belongs to the checkpoint folder: a replayed batch overwrites its own folders
    and ignores them when it looks for known pairs, so the result is the same, and a run with a new
    checkpoint adds to what is there.

    Digests of all pairs are kept in buckets below ``out_dir/history``, of which a batch reads those that
    its own digests fall into (see ``history``).
    """
    query = _query_id(spark, checkpoint)
    pairs_dir, bad_dir, seen_dir = (f"{out_dir}/{name}" for name in ("pairs", "quarantine", "history"))
    # An empty write creates the folder, so that the first batch can read it.
    spark.createDataFrame([], _PAIRS).write.mode("append").parquet(pairs_dir)
    history.start(spark.read.schema(_PAIRS).parquet(pairs_dir), seen_dir)

    def handle(lines: DataFrame, batch_id: int) -> None:
        session = lines.sparkSession
        own = f"query={query}/batch_id={batch_id}"
        parsed = responses.parse_responses(lines).persist()
        # Copies inside the batch fold before the shuffle.
        new = (
            responses.explode_pairs(parsed)
            .select("en", "ko")
            .distinct()
            .withColumn("digest", pair_digest())
            .persist()
        )
        try:
            digests = new.select("digest")
            if new.count() <= BROADCAST_DIGESTS:
                # What is read of the history is then only scanned, not shuffled.
                digests = F.broadcast(digests)
            known = history.candidates(new, seen_dir, query, batch_id).join(digests, "digest", "left_semi").distinct()
            known = order.written(known, "known-digests")
            if known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
                # The texts stay where they are.
                known = F.broadcast(known)
            new.join(known, "digest", "left_anti").write.mode("overwrite").parquet(f"{pairs_dir}/{own}")
            responses.quarantine(parsed).write.mode("overwrite").parquet(f"{bad_dir}/{own}")
            added = session.read.schema("digest binary").parquet(f"{pairs_dir}/{own}").select(
                "digest", F.lit(query).alias("query"), F.lit(batch_id).cast("bigint").alias("batch_id")
            )
            history.add(added, seen_dir, f"level0-{query}-{batch_id}")
        finally:
            new.unpersist()
            parsed.unpersist()

    stream = spark.readStream.schema("value string")
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return (
        stream.text(in_dir)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_pairs(spark: SparkSession, out_dir: str) -> DataFrame:
    """All pairs that the stream has written."""
    return spark.read.schema(_PAIRS).parquet(f"{out_dir}/pairs").select("en", "ko")


def read_quarantine(spark: SparkSession, out_dir: str) -> DataFrame:
    """All lines that the stream has set aside, with the reason."""
    return (
        spark.read.schema("raw string, reason string, query string, batch_id bigint")
        .parquet(f"{out_dir}/quarantine")
        .select("raw", "reason")
    )
