"""The tables of a library, and the fixed names its queries share."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# Names stored in the data.
ENTITY_TYPES = ("work", "dataset", "method", "idea", "claim", "topic", "organism", "modality")
ASSET_TYPES = ("dataset", "method", "idea", "claim")
SEARCH_TYPES = ("work", "dataset", "method", "idea", "claim", "topic")
TOPIC_COLUMNS = ("dataset", "method", "idea", "claim", "work")
HUB_TYPES = ("organism", "modality")
SOURCE_EDGES = ("proposes", "uses", "produces", "evaluates", "supports", "contradicts")
TOPIC_EDGES = ("about", "applicable_to")
EDGE_TYPES = ("proposes", "uses", "produces", "evaluates", "supports", "contradicts", "about", "applicable_to",
              "of_organism", "of_modality", "is_a", "extends", "cites", "relates_to")
STATUS_RANK = {"auto": 0, "confirmed": 1, "rejected": 2}


@dataclass(frozen=True)
class Library:
    """entity(id, type, key, canonical_name, external_id, status, origin, created_at, ...)
    alias(entity_key, type, alias, norm, lang, source)      work(entity_key, year, tier, ...)
    edge(src, dst, type, status, confidence, evidence, created_at, ...): src and dst are entity keys."""

    entity: DataFrame
    edge: DataFrame
    alias: DataFrame | None = None
    work: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> "Library":
        return replace(self, **tables)
