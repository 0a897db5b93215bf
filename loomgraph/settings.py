"""The engine's settings, read from the session's configuration (spark.loomgraph.<name>)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators import retrieval

PREFIX = "spark.loomgraph."
#: What a choice may be, the default first.
CHOICES = {"retrieval_mode": ("hybrid_rerank", "dense", "sparse", "graph"), "vector_store": ("cells", "lexical"), "embedding_provider": ("hash", "given")}


@dataclass(frozen=True)
class Settings:
    """A choice is trimmed and lower-cased, a blank one is its default, an unknown one an error."""

    retrieval_mode: str = ""
    vector_store: str = ""
    embedding_provider: str = ""
    embedding_dim: int = 256
    adaptive_routing: bool = True
    least_confidence: float = 0.2
    top_k: int = 5
    tenant: str = "demo-tenant"
    drift_limit: float = 0.2
    freshness_hours: float = 24.0

    def __post_init__(self):
        for name, allowed in CHOICES.items():
            value = str(getattr(self, name) or "").strip().lower() or allowed[0]
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
            object.__setattr__(self, name, value)
        if self.embedding_dim < 8:
            raise ValueError("embedding_dim must be 8 at least")

    @classmethod
    def of(cls, spark: SparkSession, **given) -> Settings:
        """The session's values, and over them the given ones that are not None."""
        found = {}
        for f in fields(cls):
            if (text := spark.conf.get(PREFIX + f.name, None)) is not None:
                read = {"bool": lambda x: x.strip().lower() in ("true", "1", "yes"), "int": int, "float": float}.get(f.type, str)
                found[f.name] = read(text)
        return cls(**found | {k: v for k, v in given.items() if v is not None})

    def dense_store(self, embedder: retrieval.Embedder | None = None) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
        """What answers dense questions: embedding cells, or the sparse search of a lexical store."""
        if self.vector_store == "lexical":
            return retrieval.sparse_hits
        if self.embedding_provider == "given" and embedder is None:
            raise ValueError("the provider is to be given")
        chosen = embedder if self.embedding_provider == "given" else retrieval.embedding_cells
        return lambda chunks, asked, k: retrieval.dense_hits(chunks, asked, k, self.embedding_dim, embedder=chosen)
