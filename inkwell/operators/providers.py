"""What providers of vectors say and need: messages, error classes, addresses, batch sizes, progress and the status that is shown."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.functions.text import collapse
from inkwell.operators.policy import redacted

# Default addresses and models, and the largest batch.
BASE_URLS = {"ollama": "http://localhost:11434", "mistral": "https://api.mistral.ai/v1", "openrouter": "https://openrouter.ai/api/v1"}
EMBEDDING_MODELS = {"ollama": "nomic-embed-text-v2-moe", "mistral": "mistral-embed", "openrouter": "openai/text-embedding-3-small"}
MOST_INPUTS, DEFAULT_INPUTS = 50, 10
#: Models that are offered: provider, kind, name, whether it runs locally.
MODELS = (
    ("ollama", "chat", "gemma4:e2b", True),
    ("ollama", "embedding", "nomic-embed-text-v2-moe", True),
    ("ollama", "embedding", "nomic-embed-text", True),
    ("mistral", "chat", "mistral-small-latest", False),
    ("mistral", "chat", "mistral-large-latest", False),
    ("mistral", "embedding", "mistral-embed", False),
    ("openrouter", "embedding", "openai/text-embedding-3-small", False),
)
MESSAGE_KEYS = ("message", "detail", "error", "code")


def short_message(message: Column, most: int = 300) -> Column:
    """A message on one line; null if nothing is left."""
    line = collapse(message)
    return F.when(line == "", F.lit(None)).when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def first_message(value: object) -> str | None:
    """The first text in nested JSON under the keys that hold messages, depth first; of a list, of its first item that has one."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return next((m for m in map(first_message, value) if m), None)
    if isinstance(value, dict):
        for key in MESSAGE_KEYS:
            if isinstance(value.get(key), str):
                return value[key]
            if found := first_message(value.get(key)):
                return found
    return None


@F.pandas_udf(StringType())
def _nested(replies: pd.Series) -> pd.Series:
    def one(reply: str | None) -> str | None:
        try:
            return None if reply is None else first_message(json.loads(reply))
        except ValueError:
            return None

    return replies.map(one)


def api_message(reply: Column) -> Column:
    """The first message of a reply, without secrets; null if there is none or it is no JSON."""
    return redacted(_nested(reply))


def missing_model(message: Column) -> Column:
    m = F.lower(message)
    return F.coalesce(m.contains("model") & reduce(lambda a, b: a | b, (m.contains(x) for x in ("not found", "does not exist", "not installed", "pull"))), F.lit(False))


def wrong_endpoint(status: Column, message: Column) -> Column:
    """Whether a status says that the address has no such service, rather than that a model is missing."""
    return ~missing_model(message) & status.isin(400, 404, 405, 422)


def base_url(url: Column, provider: str) -> Column:
    """A provider's address without slashes and service paths at its end; its default if there is none."""
    bare = lambda c: F.regexp_replace(F.trim(c), "/+$", "")
    default = BASE_URLS.get(provider, "")
    u = F.when(F.coalesce(bare(url), F.lit("")) == "", F.lit(default)).otherwise(bare(url))
    if provider == "ollama":
        return F.regexp_replace(u, r"(?i)/api(?:/(?:generate|chat|tags|embed|embeddings))?$", "")
    if provider == "mistral":
        u = F.regexp_replace(F.regexp_replace(u, r"(?i)/v1/(?:chat/completions|embeddings)$", "/v1"), r"(?i)/(?:chat/completions|embeddings)$", "")
        return F.when(F.lower(u) == "https://api.mistral.ai", default).otherwise(F.regexp_replace(u, "(?i)/v1/v1$", "/v1"))
    if provider == "openrouter":
        u = F.regexp_replace(F.regexp_replace(u, r"(?i)/(?:chat/completions|embeddings(?:/models)?)$", ""), "(?i)/api/v1/api/v1$", "/api/v1")
        return F.when(F.lower(u) == "https://openrouter.ai", default).otherwise(u)
    return bare(url)


def chosen_url(url: Column, provider: str) -> Column:
    """The provider's default where an address is blank or some provider's default, else the address."""
    known = reduce(lambda a, b: a | b, (base_url(url, p) == base_url(F.lit(default), p) for p, default in BASE_URLS.items()))
    return F.when((F.trim(url) == "") | known, BASE_URLS.get(provider, "")).otherwise(url)


def chosen_model(model: Column, provider: str, kind: str = "embedding") -> Column:
    """The provider's default model where a name is blank, or is another provider's or a default and not offered by this one, else the name."""
    offered = [m for p, k, m, _ in MODELS if k == kind]
    own = [m for p, k, m, _ in MODELS if k == kind and p == provider]
    name = F.trim(model)
    return F.when((name == "") | name.isin(*offered) & ~name.isin(*own or [""]), EMBEDDING_MODELS.get(provider, "") if kind == "embedding" else (own or [""])[0]).otherwise(model)


def batch_size(value: Column, fallback: int = DEFAULT_INPUTS) -> Column:
    """Inputs of a request: a whole number from 1 to 50; what is no number counts as the fallback."""
    number = value.try_cast("double")
    whole = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(fallback)).otherwise(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    return F.least(F.lit(MOST_INPUTS), F.greatest(F.lit(1), whole)).cast("int")


def progress(done: Column, total: Column) -> tuple[Column, Column]:
    """(count, percentage): a whole count within the total, and its whole percentage, null without a total."""
    floor = F.greatest(F.lit(0), F.floor(F.coalesce(done, F.lit(0.0))))
    count = F.when(total >= 0, F.least(floor, total)).otherwise(floor).cast("long")
    return count, F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(done / total * 100)))).cast("int")


def headline(operation: Column, ready: Column, work: Column, mode: Column, detailed: Column, available: Column) -> Column:
    """What is shown of the vectors' state: an operation that runs first, then what is missing, then what is to be done."""
    return (
        F.when(operation.isin("running", "cancelling"), "operation-active").when(~ready, "text-index-missing").when(work == "error", "error").when(work.isin("unknown", "dirty", "calculating"), work)
        .when(mode == "full-rebuild", "full-rebuild-required").when(~F.coalesce(detailed, F.lit(False)), "details-unavailable").when(available, "update-available").otherwise("up-to-date")
    )


def actions(operation: Column, ready: Column, mode: Column, detailed: Column, built: Column, available: Column) -> Column:
    """Names of what can be done, the refresh first."""
    active = operation.isin("running", "cancelling")
    second = (
        F.when(active, "cancel").when(~ready, F.lit(None)).when(mode == "full-rebuild", "rebuild").when(~F.coalesce(detailed, F.lit(True)), F.lit(None))
        .when(~built & ~F.coalesce(mode == "incremental", F.lit(False)), "generate").when(F.coalesce(available, F.lit(False)), "update")
    )
    return F.array_compact(F.array(F.lit("refresh-status"), second))
