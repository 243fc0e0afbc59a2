"""Steps that call a service or a model for each row: structure prediction with retries, and embedding."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.functions.sequences import effective_length


@dataclass(frozen=True)
class RetrySpec:
    """Attempts and pauses of one call; ``per_task_rate`` calls a second and task, so a job's rate is that times its tasks."""

    most_retries: int = 6
    base: float = 2.0
    cap: float = 120.0
    jitter: float = 0.2
    per_task_rate: float = 5.0
    seed: int = 0


# The words for status and reason, and the limits and pauses above.

#: A client takes a sequence and returns (HTTP status or 0 for a network error, body, seconds to wait or None).
Client = Callable[[str], tuple[int, str, float | None]]


def call(client: Client, seq: str, spec: RetrySpec, draw: random.Random, sleep: Callable[[float], None]) -> tuple[str, str | None, int, int, str | None]:
    """status, reason, last code, attempts and body of one prediction."""
    code, reason = 0, None
    for attempt in range(spec.most_retries + 1):
        code, body, wait = client(seq)
        if code == 200 and ("ATOM" in body or "HETATM" in body):
            return "ok", None, code, attempt + 1, body
        reason = {0: "network_error", 200: "unexpected_body", 429: "rate_limited_429"}.get(code) or (f"server_error_{code}" if code >= 500 else f"http_error_{code}")
        if not (code == 0 or code == 429 or code >= 500):
            return "failed", reason, code, attempt + 1, None
        if attempt < spec.most_retries:
            pause = wait if code == 429 and wait is not None else min(spec.cap, spec.base * 2**attempt)
            sleep(pause * (1 + draw.uniform(-spec.jitter, spec.jitter)))
    return "failed", reason, code, spec.most_retries + 1, None


def predict(sequences: DataFrame, done: DataFrame, make_client: Callable[[], Client], spec: RetrySpec = RetrySpec(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """variant_id, status (ok, failed or skipped), reason, status_code, attempts, elapsed_seconds, body for every sequence.

    ``sequences``: variant_id, sequence; ``done``: variant_id of structures that exist, which are skipped without a
    call. Each task makes one client. Write the result before use: reading it twice would call twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, draw = make_client(), random.Random(spec.seed)
        for pdf in batches:
            rows = []
            for name, seq in zip(pdf.variant_id, pdf.sequence, strict=True):
                sleep(1 / spec.per_task_rate)
                began = time.monotonic()
                status, reason, code, attempts, body = call(client, seq or "", spec, draw, sleep)
                rows.append((name, status, reason, code, attempts, time.monotonic() - began, body))
            yield pd.DataFrame(rows, columns=["variant_id", "status", "reason", "status_code", "attempts", "elapsed_seconds", "body"])

    schema = "variant_id string, status string, reason string, status_code int, attempts int, elapsed_seconds double, body string"
    exists = done.select("variant_id").distinct()
    called = sequences.join(exists, "variant_id", "left_anti").select("variant_id", "sequence").mapInPandas(run, schema)
    skipped = sequences.join(exists, "variant_id", "left_semi").selectExpr("variant_id", "'skipped' status", "'exists' reason", "0 status_code", "0 attempts", "cast(0 as double) elapsed_seconds", "cast(null as string) body")
    return called.unionByName(skipped)


def embed(sequences: DataFrame, done: DataFrame, make_model: Callable[[], Callable[[list[str]], list[np.ndarray]]], batch: int = 16, most: int | None = None) -> DataFrame:
    """Per-residue vectors of sequences that have none yet: variant_id, pos, vec, error.

    A model takes sequences and returns an array (length, d) for each; ``most`` tokens cut long sequences. A batch that
    fails gives rows with the error; vectors that are not finite are errors too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    found = model(list(part.sequence))
                    for name, a in zip(part.variant_id, found, strict=True):
                        if not np.isfinite(a).all():
                            raise ValueError(f"{name}: not finite")
                        yield pd.DataFrame({"variant_id": name, "pos": range(len(a)), "vec": list(np.asarray(a, np.float32)), "error": None})
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"variant_id": part.variant_id, "pos": None, "vec": None, "error": f"{type(e).__name__}: {e}"})

    todo = sequences.join(done.select("variant_id").distinct(), "variant_id", "left_anti")
    seq = F.coalesce("sequence", F.lit(""))
    return todo.select("variant_id", F.substring(seq, F.lit(1), effective_length(F.length(seq), most)).alias("sequence")).mapInPandas(run, "variant_id string, pos int, vec array<float>, error string")


def index_rows(sequences: DataFrame, vectors: DataFrame, existing: DataFrame, assigned: DataFrame | None, model: str, device: str, path: str) -> DataFrame:
    """One row per sequence for the index of vectors: variant_id, template_id, cluster_id, sequence_length, model_name, device, embedding_path, status, error.

    ``vectors``: variant_id, pos, error, as ``embed`` gives them; ``existing``: variant_id of vectors from before, which
    are skipped; ``assigned``: variant_id, template_id, cluster_id, row_id (the last row of a variant counts), null for
    none. A sequence with an error, or without any vector, failed.
    """
    done = vectors.groupBy("variant_id").agg(F.max("error").alias("error"), F.count("pos").alias("n"))
    rows = sequences.select("variant_id", F.coalesce(F.length("sequence"), F.lit(0)).alias("sequence_length")).join(done, "variant_id", "left")
    rows = rows.join(existing.select("variant_id").distinct().withColumn("_old", F.lit(True)), "variant_id", "left")
    if assigned is None:
        rows = rows.withColumns({"template_id": F.lit(None).cast("string"), "cluster_id": F.lit(None).cast("int")})
    else:
        last = assigned.where("variant_id is not null").groupBy("variant_id").agg(F.max(F.struct("row_id", "template_id", "cluster_id")).alias("_a"))
        rows = rows.join(last, "variant_id", "left").withColumns({"template_id": F.col("_a.template_id"), "cluster_id": F.col("_a.cluster_id")})
    failed = F.col("error").isNotNull() | F.col("n").isNull()
    status = F.when(F.col("_old"), "skipped").when(failed, "failed").otherwise("ok")
    error = F.when(F.col("_old"), "exists_valid").when(failed, F.coalesce("error", F.lit("no vector"))).otherwise("")
    return rows.select("variant_id", "template_id", "cluster_id", "sequence_length", F.lit(model).alias("model_name"), F.lit(device).alias("device"), F.concat(F.lit(f"{path}/"), "variant_id").alias("embedding_path"), status.alias("status"), error.alias("error"))


def index_problems(index: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Entries of an index whose stored vector doesn't fit: variant_id, path, problem (the first that applies).

    ``index``: variant_id, path and, where these are to be compared, sequence, model_name, layer, dtype, implementation;
    ``vectors``: path, vector, and stored_sequence, stored_model, stored_layer, stored_dtype, stored_implementation.
    """
    joined = index.join(vectors, "path", "left")
    problem = (
        F.when(F.col("vector").isNull(), "missing").when(F.size("vector") != dim, "wrong_length")
        .when(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
    )
    for own, stored, name in (("sequence", "stored_sequence", "other_sequence"), ("model_name", "stored_model", "other_model"), ("layer", "stored_layer", "other_layer"), ("dtype", "stored_dtype", "other_dtype"), ("implementation", "stored_implementation", "other_implementation")):
        if own in index.columns and stored in vectors.columns:
            problem = problem.when(~F.col(own).eqNullSafe(F.col(stored)), name)
    return joined.select("variant_id", "path", problem.alias("problem")).where("problem is not null")
