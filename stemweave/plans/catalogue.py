"""All registered queries and their oracles."""

from __future__ import annotations

from . import coverage, domain, eras, extended, generation, hierarchy, identity, ingest, language, logs, naming, pages, relational, workflows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
