"""The text an entity is indexed by, and the definition text of a topic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes that join the name, by type of entity; attrs is map<string,string>, lists are one per line.
TEXT_ATTRS = {
    "work": ("tldr", "abstract"),
    "dataset": ("accession", "name", "organism", "tissue", "modality", "scale"),
    "method": ("io", "modality"),
    "idea": ("transfer_type", "transfer_to", "transfer_barrier"),
    "claim": ("boundary",),
    "topic": ("definition", "examples"),
}


def _filled(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def entity_text(etype: Column, name: Column, attrs: Column, abstract_chars: int | None = None) -> Column:
    """Name and attributes, one a line; ``abstract_chars`` bounds the part of an abstract that is taken."""
    out = F.when(F.lit(False), F.lit(""))
    for t, names in TEXT_ATTRS.items():
        parts = [_filled(F.substring(attrs[a], 1, abstract_chars) if a == "abstract" and abstract_chars else attrs[a]) for a in names]
        out = out.when(etype == t, F.concat_ws("\n", _filled(name), *parts))
    return out.otherwise(name)


def topic_definition(name: Column, attrs: Column) -> Column:
    def listed(key: str, label: str) -> Column:
        return F.concat(F.lit(label), F.replace(_filled(attrs[key]), F.lit("\n"), F.lit("; ")))
    return F.concat_ws("\n", _filled(name), _filled(attrs["definition"]), listed("examples", "Examples: "), listed("counter_examples", "Not: "))
