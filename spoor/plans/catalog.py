"""All query modules, imported for their registrations."""

from . import (  # noqa: F401
    q_agent,
    q_confidence,
    q_corpus,
    q_entropy,
    q_metrics,
    q_names,
    q_phases,
    q_sources,
    q_streaming,
    q_text,
    q_voting,
)
from .registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
