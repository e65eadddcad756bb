"""Providers that answer over HTTP, as plug-ins for generation; how a request travels is up to a transport that is handed in."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from inkwell.operators.generation import Reply, ordered_vectors
from inkwell.operators.policy import OWN_FAULT, STATUSES
from inkwell.operators.providers import BASE_URLS, EMBEDDING_MODELS, first_message

#: (address, headers, body) to (status, text); a TimeoutError or OSError says that there was no answer.
Transport = Callable[[str, dict[str, str], dict], tuple[int, str]]

WRONG_PLACE = (400, 404, 405, 422)


def failed(category: str, message: str | None = None, own: bool = False, requests: int = 1) -> Reply:
    return Reply(category=category, scope="input" if own else "operation", fatal=not own, message=message, requests=requests)


def by_status(status: int, message: str | None, requests: int = 1) -> Reply:
    category = STATUSES.get(status, "connection" if status >= 500 else "unknown")
    return failed(category, message, category in OWN_FAULT, requests)


def names_missing_model(message: str | None) -> bool:
    said = (message or "").lower()
    return "model" in said and any(x in said for x in ("not found", "does not exist", "not installed", "pull"))


def checked(vectors: list | None, inputs: int, requests: int = 1) -> Reply:
    """A reply of vectors that are as many as the inputs, finite and of one length, or what is wrong with them."""
    if vectors is None or len(vectors) != inputs:
        return failed("invalid-response", requests=requests)
    if not all(isinstance(v, list) and v and all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in v) for v in vectors):
        return failed("invalid-vector", requests=requests)
    if len({len(v) for v in vectors}) > 1:
        return failed("dimension-mismatch", requests=requests)
    return Reply(vectors, requests=requests)


def parsed(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


@dataclass
class ItemProvider:
    """Services that answer with items of index and embedding, such as Mistral's and OpenRouter's."""

    transport: Transport
    base_url: str
    model: str
    api_key: str

    def __call__(self, inputs: list[str]) -> Reply:
        if not inputs or not self.api_key.strip():
            return failed("configuration", requests=0)
        try:
            status, text = self.transport(f"{self.base_url}/embeddings", {"Authorization": f"Bearer {self.api_key}"}, {"model": self.model, "input": inputs})
        except TimeoutError:
            return failed("timeout")
        except OSError as e:
            return failed("connection", str(e))
        data = parsed(text)
        if status != 200:
            return by_status(status, first_message(data))
        items = data.get("data") if isinstance(data, dict) else None
        if not isinstance(items, list) or len(items) != len(inputs) or not all(isinstance(x, dict) for x in items):
            return failed("invalid-response", first_message(data))
        # One item for one input needs no index.
        places = [x.get("index") if isinstance(x.get("index"), int) else 0 if len(inputs) == 1 else None for x in items]
        if None in places:
            return failed("invalid-response")
        return checked(ordered_vectors([(p, x.get("embedding")) for p, x in zip(places, items)], len(inputs)), len(inputs))


@dataclass
class BatchProvider:
    """A local service with one address for batches and an older one for single inputs, such as Ollama's.

    If the first has no such service or answers in another form, inputs go to the older one, one at a
    time; a missing model, or any other failure, is final.
    """

    transport: Transport
    base_url: str
    model: str

    def _ask(self, path: str, body: dict) -> tuple[int, object] | Reply:
        try:
            status, text = self.transport(f"{self.base_url}{path}", {}, {"model": self.model, **body})
        except TimeoutError:
            return failed("timeout")
        except OSError as e:
            return failed("connection", str(e))
        return status, parsed(text)

    def __call__(self, inputs: list[str]) -> Reply:
        if not inputs:
            return failed("configuration", requests=0)
        answer = self._ask("/api/embed", {"input": inputs})
        if isinstance(answer, Reply):
            return answer
        status, data = answer
        if status == 200:
            vectors = data.get("embeddings") if isinstance(data, dict) else None
            reply = checked(vectors if isinstance(vectors, list) else None, len(inputs))
            if reply.vectors is not None or reply.category == "dimension-mismatch":
                return reply
        else:
            message = first_message(data)
            if names_missing_model(message):
                return failed("model-not-found", message)
            if status not in WRONG_PLACE:
                return by_status(status, message)
        found, requests = [], 1
        for text in inputs:
            answer = self._ask("/api/embeddings", {"prompt": text})
            requests += 1
            if isinstance(answer, Reply):
                answer.requests = requests
                return answer
            status, data = answer
            if status != 200:
                message = first_message(data)
                return failed("model-not-found", message, requests=requests) if names_missing_model(message) else by_status(status, message, requests)
            found.append(data.get("embedding") if isinstance(data, dict) else None)
        return checked(found, len(inputs), requests)


@dataclass(frozen=True)
class Settings:
    """What a user has set: a provider's name, and what differs from its defaults. Addresses are cleaned by providers.base_url()."""

    provider: str
    base_url: str = ""
    model: str = ""
    api_key: str = ""


def dispatch(settings: Settings, transport: Transport) -> Callable[[list[str]], Reply]:
    """The provider that the settings name, whatever its case; one that nothing is known of answers that it isn't supported."""
    name = settings.provider.strip().lower()
    if name not in BASE_URLS:
        return lambda inputs: failed("unsupported-provider" if inputs else "configuration", f"no such provider: {settings.provider}", requests=0)
    url, model = settings.base_url.strip().rstrip("/") or BASE_URLS[name], settings.model.strip() or EMBEDDING_MODELS[name]
    return BatchProvider(transport, url, model) if name == "ollama" else ItemProvider(transport, url, model, settings.api_key)
