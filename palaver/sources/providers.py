"""The seam to external models: requests are rows, responses an input table keyed by request hash.

Without a provider a call fails at once; no answer is ever made up.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import request_key, strip_fence
from palaver.session import cut


class ModelProvider(Protocol):
    def respond(self, namespace: str, body: str) -> str:
        """The response body to one request; raises on failure."""


class NoProvider:
    #: nothing is called, so nothing is paced
    per_minute = float("inf")

    def respond(self, namespace: str, body: str) -> str:
        raise RuntimeError(f"no model provider is configured for {namespace}; give one, or a table of recorded responses")


# HTTP states that are worth another attempt, and those that never are.
RETRIED = {408, 409, 425, 429, 500, 502, 503, 504}
FATAL = {400, 401, 403, 404, 413}


class ModelError(Exception):
    """A failed call; status is that of the response, None for a connection or a time-out."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    @property
    def again(self) -> bool:
        return self.status is None or self.status in RETRIED or self.status >= 500 and self.status not in FATAL


class RateLimiter:
    """A partition's share of a number of calls a minute: the n-th call since it began is due n gaps after that.

    A partition that has waited long for its answers may catch up by BURST calls, and no further.
    """

    BURST = 2

    def __init__(self, per_minute: float):
        self.gap, self.began, self.calls = 60.0 / per_minute, time.monotonic(), 0

    def acquire(self) -> None:
        due = int((time.monotonic() - self.began) / self.gap) if self.gap else 0
        self.calls = max(self.calls, due - self.BURST)
        time.sleep(max(0.0, self.began + self.calls * self.gap - time.monotonic()))
        self.calls += 1


def backoff(attempt: int, draw: float, base: float = 1.5, most: float = 20.0) -> float:
    """Seconds before attempt + 1, with full jitter: draw is uniform in [0, 1)."""
    return draw * min(most, base * 2 ** (attempt - 1))


@dataclass(frozen=True)
class Policy:
    """How a partition calls: calls a minute of the whole job, partitions that share them, attempts, pauses."""

    per_minute: float = 240.0
    partitions: int = 6
    attempts: int = 4
    base: float = 1.5
    most: float = 20.0
    secret: str = ""

    def respond(self, provider: ModelProvider, limiter: RateLimiter, namespace: str, body: str) -> str:
        """The provider's response: paced, and tried again while the error is worth it. Any other error ends it."""
        for attempt in range(1, self.attempts + 1):
            limiter.acquire()
            try:
                return provider.respond(namespace, body)
            except ModelError as error:
                if not error.again or attempt == self.attempts:
                    raise
                time.sleep(backoff(attempt, random.random(), self.base, self.most))
        raise ModelError("no attempt was allowed")

    def shown(self, error: Exception) -> str:
        """The error as it may be stored: short, and without the secret."""
        text = str(error)
        return (text.replace(self.secret, "***") if self.secret else text)[:400]


def with_keys(requests: DataFrame, namespace: str) -> DataFrame:
    """Requests (body) with the hash that names their response."""
    return requests.withColumn("namespace", F.lit(namespace)).withColumn("request_sha256", request_key(body=F.col("body"), namespace=F.lit(namespace)))


def call(requests: DataFrame, namespace: str, recorded: DataFrame | Callable[[DataFrame], DataFrame], make: Callable[[], ModelProvider] = NoProvider, strict: bool = True, policy: Policy = Policy()) -> DataFrame:
    """Responses to requests (body): recorded ones first, the provider for distinct ones that are left.

    recorded is a table (namespace, request_sha256, body), or makes one of the keyed requests, as a look-up in a
    store does. A recorded body that is not JSON, or a model's response that was blocked, cut short or
    empty, counts as missing. What is left is dealt to the policy's number of
    partitions, each with a provider of its own and its share of the calls a minute (those of the policy,
    unless the provider has a per_minute itself). A failed request
    has a null response and its error in _error, and in strict mode any error raises one summary of all.
    Each request is made once: the responses are kept in the shared folder before they are used.
    """
    keyed = with_keys(requests, namespace)
    recorded = recorded(keyed) if callable(recorded) else recorded
    text, refused = said(F.col("body"))
    valid = recorded.where(F.col("namespace") == namespace).where(F.try_parse_json("body").isNotNull()).where(refused.isNull()).select("request_sha256", text.alias("response"))
    missing = keyed.select("request_sha256", "body").distinct().join(valid, "request_sha256", "left_anti")

    def run(batches):
        import pandas as pd

        provider = make()
        limiter = RateLimiter(getattr(provider, "per_minute", policy.per_minute) / policy.partitions)
        for pdf in batches:
            out = []
            for key, body in zip(pdf["request_sha256"], pdf["body"], strict=True):
                try:
                    out.append((key, policy.respond(provider, limiter, namespace, body), None))
                except Exception as error:  # noqa: BLE001  the error is the row's result
                    out.append((key, None, policy.shown(error)))
            yield pd.DataFrame(out, columns=["request_sha256", "response", "_error"])

    fresh = missing.repartition(policy.partitions, "request_sha256").mapInPandas(run, "request_sha256 string, response string, _error string")
    text, refused = said(F.col("response"))
    fresh = cut(fresh.select("request_sha256", text.alias("response"), F.coalesce("_error", refused).alias("_error")))
    every = valid.withColumn("_error", F.lit(None).cast("string")).unionByName(fresh)
    joined = keyed.join(every, "request_sha256", "left")
    if strict:
        failed = fresh.where("_error is not null").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("_error")), 1, 3).alias("some")).first()
        if failed.n:
            raise RuntimeError(f"{failed.n} requests of {namespace} failed: {'; '.join(failed.some)}" + ("; ..." if failed.n > 3 else ""))
    return joined


def said(body: Column) -> tuple[Column, Column]:
    """The text of a response and why there is none: that of a model's JSON response, and any other body as it is."""
    text, error = response_text(body)
    whole = F.coalesce(F.from_json(body, RESPONSE)["candidates"].isNotNull() | F.from_json(body, RESPONSE)["promptFeedback"].isNotNull(), F.lit(False))
    return F.when(whole, text).otherwise(body), F.when(whole, error)


def parsed(response: Column, schema: str) -> Column:
    """A response body under its declared schema, null where it doesn't parse."""
    return F.from_json(strip_fence(response), schema)


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors scaled to length one; a zero or non-finite one raises."""
    norm = F.sqrt(F.aggregate(F.transform(column, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    bad = F.isnan(norm) | (norm == 0) | (norm == float("inf"))
    safe = F.when(bad, F.raise_error(F.lit("a vector is zero or not finite"))).otherwise(norm)
    return vectors.withColumn("_norm", safe).withColumn(column, F.transform(column, lambda x: (x / F.col("_norm")).cast("float"))).drop("_norm")


# Dollars of a call by namespace, and of any other.
CALL_COST = {"transcribe": 0.012, "vision": 0.009, "faceverify": 0.007, "kg-extract": 0.007, "embed-batch": 0.0003, "roster-tamil": 0.004}
OTHER_COST = 0.004


def unit_cost(namespace: Column) -> Column:
    """Dollars of one call."""
    found = F.lit(OTHER_COST)
    for name, price in CALL_COST.items():
        found = F.when(namespace == name, F.lit(price)).otherwise(found)
    return found


def usage(calls: DataFrame) -> DataFrame:
    """Hits, misses, hit rate (0 for no call), tokens and estimated cost of calls (namespace, hit, tokens); hits cost nothing."""
    n, misses = F.count("*"), F.count_if(~F.col("hit"))
    counted = calls.groupBy("namespace").agg(F.count_if("hit").alias("hits"), misses.alias("misses"), F.round(F.count_if("hit") / F.greatest(n, F.lit(1)), 3).alias("rate"), F.sum(F.when(~F.col("hit"), F.col("tokens")).otherwise(0)).alias("tokens"))
    return counted.withColumn("cost", F.round(F.col("misses") * unit_cost(F.col("namespace")), 4))


RESPONSE = "promptFeedback struct<blockReason: string>, candidates array<struct<finishReason: string, content: struct<parts: array<struct<text: string, thought: boolean>>>>>"


def response_text(body: Column) -> tuple[Column, Column]:
    """The text of a model's JSON response, without its thoughts, and why there is none: blocked,
    truncated, empty or parse."""
    parsed_body = F.from_json(body, RESPONSE)
    first = F.get(parsed_body["candidates"], 0)
    parts = F.filter(F.coalesce(first["content"]["parts"], F.array().cast("array<struct<text:string,thought:boolean>>")), lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    reason = first["finishReason"]
    error = (
        F.when(F.try_parse_json(body).isNull(), "parse")
        .when(parsed_body["promptFeedback"]["blockReason"].isNotNull(), "blocked")
        .when(first.isNull(), "empty")
        .when(reason == "MAX_TOKENS", "truncated")
        .when(reason.isNotNull() & (reason != "STOP"), "blocked")
        .when(text == "", "empty")
    )
    return F.when(error.isNull(), text), error
