"""The registered queries of the core."""

from __future__ import annotations

from parallaxa.catalog import derived, hierarchies, incremental, payloads, relational, similarity, statistics, structure, tracks
from parallaxa.plans.registry import Registry


def core() -> Registry:
    parts = (hierarchies, relational, statistics, similarity, tracks, incremental, payloads, derived, structure)
    return Registry().merge(*(p.REGISTRY for p in parts))
