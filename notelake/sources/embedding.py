"""Embeddings from a service over HTTP, and the fixed size that local models want."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence

#: Texts of one request, attempts, the first pause in seconds (doubled each time), and tokens of a padded text.
BATCH, ATTEMPTS, PAUSE, TOKENS = 100, 4, 0.1, 512


class EmbeddingError(RuntimeError):
    pass


def post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


class ApiEmbedder:
    """A list of texts to a list of vectors, by requests of at most ``batch`` texts; goes to executors as it is.

    Server errors and lost connections are tried again after a pause; other refusals are not. The key is in no message and
    not in ``model_id``, so another key means no new embeddings. ``admit`` is called before each request and may refuse it.
    """

    def __init__(self, endpoint: str, model: str, key: str, *, batch: int = BATCH, timeout: float = 30.0, admit: Callable[[], None] | None = None, send=post, sleep=time.sleep):
        self.endpoint, self.model, self.key = endpoint, model, key
        self.batch, self.timeout, self.admit, self.send, self.sleep = max(1, min(batch, BATCH)), timeout, admit, send, sleep

    @property
    def model_id(self) -> str:
        return "api:" + hashlib.sha256((self.endpoint + self.model).encode()).hexdigest()

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = list(texts[at : at + self.batch])
            if self.admit:
                self.admit()
            try:
                vectors = [d["embedding"] for d in json.loads(self.request(json.dumps({"model": self.model, "input": part})))["data"]]
            except (ValueError, KeyError, TypeError) as e:
                raise EmbeddingError(f"not an answer: {type(e).__name__}") from None
            if len(vectors) != len(part):
                raise EmbeddingError(f"{len(vectors)} embeddings for {len(part)} texts")
            out += vectors
        return out

    def request(self, body: str) -> str:
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        for attempt in range(ATTEMPTS):
            last = attempt == ATTEMPTS - 1
            try:
                status, answer = self.send(self.endpoint, headers, body.encode(), self.timeout)
            except OSError as e:
                if last:
                    raise EmbeddingError(self.redacted(f"no connection: {e}")) from None
            else:
                if status < 300:
                    return answer
                if status < 500 or last:
                    raise EmbeddingError(f"refused with {status}: {self.redacted(answer)}")
            self.sleep(PAUSE * 2**attempt)
        raise AssertionError("not reached")

    def redacted(self, text: str) -> str:
        return text[:200].replace(self.key, "[REDACTED]") if self.key else text[:200]


def padded(ids: Sequence[int], size: int = TOKENS, pad: int = 0) -> tuple[list[int], list[int]]:
    """Ids cut or padded to a fixed size, and the mask that ``mean_pool`` takes."""
    own = list(ids)[:size]
    return own + [pad] * (size - len(own)), [1] * len(own) + [0] * (size - len(own))
