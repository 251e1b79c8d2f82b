"""Engine configuration: default models and the provider that answers requests; values, not globals inside tasks."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: The models used where none is named.
COMPLETION, EMBEDDING, RAG, MODERATION = "gpt-5-mini", "text-embedding-ada-002", "gpt-5-nano", "omni-moderation-latest"


@dataclass(frozen=True)
class EngineConfig:
    """Default models (None: the built-in ones) and a provider."""

    completion: str | None = None
    embedding: str | None = None
    provider: object | None = None

    @property
    def completion_model(self) -> str:
        return self.completion or COMPLETION

    @property
    def embedding_model(self) -> str:
        return self.embedding or EMBEDDING

    def rag_model(self, explicit: str | None = None) -> str:
        """Explicit, else configured, else the built-in model for retrieval metrics."""
        return explicit or self.completion or RAG

    def with_models(self, models: str | dict | None) -> EngineConfig:
        """A text names the completion model and resets the embedding model; a dict changes the keys it has; None resets both."""
        if models is None:
            return replace(self, completion=None, embedding=None)
        if isinstance(models, str):
            return replace(self, completion=models, embedding=None)
        return replace(self, completion=models.get("completion", self.completion), embedding=models.get("embedding", self.embedding))


_session = EngineConfig()


def init(models: str | dict | None = None, provider: object | None = None) -> EngineConfig:
    """Set and return the session's configuration; it is read on the driver when plans are built."""
    global _session
    _session = replace(_session.with_models(models), provider=provider)
    return _session


def current() -> EngineConfig:
    return _session
