"""Registered queries with digests and with state over a stream, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import identity
from leafmill.session import cut, shared_dir, ship, table
from leafmill.streaming import attempts

_PHASES = ("extract", "translation", "render")


def _events(spark: SparkSession, d: str, select: list) -> DataFrame:
    """The events table as a stream."""
    batch = table(spark, d, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), *select)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"


def checkpoint_stream(spark, d):
    """Users as jobs, a phase for each six events of the table, what an event completes from its value."""
    ship(spark)
    phase = F.element_at(F.array(*map(F.lit, _PHASES)), (F.floor(F.col("event_id") / 600) % 3 + 1).cast("int"))
    rows = _events(spark, d, [F.col("user_id").alias("job"), phase.alias("phase"), F.floor("value").cast("long").alias("completed")])
    return attempts.drain(attempts.checkpoints(rows), _folder(spark, "checkpoints"))


def attempt_stream(spark, d):
    """Event types as renderers, users as iterations; a fingerprint is what an event's properties say."""
    ship(spark)
    rows = _events(spark, d, [(F.col("user_id") % 10).alias("iteration"), F.col("event_type").alias("renderer"), F.lit("b1").alias("build"), F.col("props").alias("fingerprint")])
    return attempts.drain(attempts.attempts(rows), _folder(spark, "attempts")).select("event_id", "iteration", "renderer", "attempt", "status")


def _conversation_leaves(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    v = c.groupBy("conv_id").agg(F.to_variant_object(F.struct(turns.alias("turns"))).alias("v"))
    return identity.leaves(v, "conv_id", "v")


def conversation_leaves(spark, d):
    out = _conversation_leaves(spark, d)
    return out.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.char_length("leaf")).alias("chars"))


def changed_paths(spark, d):
    """Digests of conversations, refreshed after every third one's last turn has another text: which paths changed."""
    leaves = cut(_conversation_leaves(spark, d))
    old = cut(identity.digests(leaves, "conv_id"))
    last = leaves.where("conv_id % 3 = 0 and path[2] = 'text'").groupBy("conv_id").agg(F.max("path").alias("path"))
    new = identity.refresh(old, last.withColumn("leaf", F.lit("s:changed")), "conv_id")
    return identity.differences(old, new, "conv_id").select("conv_id", F.array_join("path", "/").alias("path"), "change")


def inventory_keys(spark, d):
    docs = table(spark, d, "documents")
    key = identity.cache_key(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256), F.concat(F.lit("elements-v"), F.col("doc_id") % 3), F.concat(F.col("doc_id") % 2 + 1, F.lit(".24.9")))
    return docs.select("doc_id", key.alias("key"))


def build_identities(spark, d):
    files = table(spark, d, "documents").select("source", F.concat(F.lit("f"), F.col("doc_id")).alias("path"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256"))
    return identity.build_identity(files, ["source"])


QUERIES = {f.__name__: f for f in (checkpoint_stream, attempt_stream, conversation_leaves, changed_paths, inventory_keys, build_identities)}

ORACLES = {
    "checkpoint_stream": """WITH e AS (SELECT user_id AS job, event_id, ts, ['extract', 'translation', 'render'][event_id // 600 % 3 + 1] AS phase, floor(value)::BIGINT AS c FROM events),
        r AS (SELECT *, sum(CASE WHEN phase IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY ts, event_id) AS run FROM (SELECT *, lag(phase) OVER (PARTITION BY job ORDER BY ts, event_id) AS p FROM e))
        SELECT job, event_id, phase, max(c) OVER w AS completed, CASE WHEN c < max(c) OVER w THEN 'regression' ELSE 'accepted' END AS status FROM r WINDOW w AS (PARTITION BY job, run ORDER BY ts, event_id)""",
    "attempt_stream": """WITH e AS (SELECT event_id, ts, user_id % 10 AS iteration, event_type AS renderer, props AS f FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY iteration, renderer, f ORDER BY ts, event_id) AS nth FROM e), k AS (SELECT iteration, renderer, f, row_number() OVER (PARTITION BY iteration, renderer ORDER BY ts, event_id) AS attempt FROM n WHERE nth = 1)
        SELECT event_id, iteration, renderer, attempt, CASE WHEN nth = 1 THEN 'new' ELSE 'repeated' END AS status FROM n JOIN k USING (iteration, renderer, f)""",
    "conversation_leaves": """SELECT conv_id, 3 * count(*) AS n, sum(length('n:' || turn::DOUBLE::VARCHAR) + length('s:' || to_json(role)::VARCHAR) + length('s:' || to_json(coalesce(text, ''))::VARCHAR))::BIGINT AS chars FROM conversations GROUP BY 1""",
    "changed_paths": """WITH l AS (SELECT conv_id, count(*) - 1 AS k FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1)
        SELECT conv_id, unnest(['', 'turns', 'turns/' || lpad(k::VARCHAR, 9, '0'), 'turns/' || lpad(k::VARCHAR, 9, '0') || '/text']) AS path, 'changed' AS change FROM l""",
    "inventory_keys": """SELECT doc_id, sha256('{"analyzer_version": "source-structure-v1", "detector_version": "elements-v' || (doc_id % 3) || '", "pymupdf_major": "' || (doc_id % 2 + 1) || '", "source_sha256": "' || sha256(coalesce(text, '')) || '"}') AS key FROM documents""",
    "build_identities": """SELECT source, sha256(string_agg(DISTINCT 'f' || doc_id || chr(9) || sha256(coalesce(text, '')), chr(10) ORDER BY 'f' || doc_id || chr(9) || sha256(coalesce(text, '')))) AS build_id FROM documents GROUP BY 1""",
}
