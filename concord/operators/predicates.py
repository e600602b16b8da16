"""Blocking predicates: what makes two records candidates for a match.

A predicate's identity is its text, which is also how it sorts and how equal
predicates of several variables are found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.keys import keys, truthy

#: Similarity families, and what each compares.
FAMILIES = ("TfidfText", "TfidfSet", "TfidfNGram", "Levenshtein")
MODES = ("Canopy", "Search")


@dataclass(frozen=True)
class Simple:
    """Keys by one key function of one field.  ``as_string`` cleans the value first; it isn't part of the identity."""

    function: str
    field: str
    as_string: bool = field(default=True, compare=False)

    def __repr__(self) -> str:
        return f"SimplePredicate: ({self.function}, {self.field})"

    def keys(self, schema: T.StructType, row: str | None = None) -> Column:
        return keys(self.function, F.col(f"{row}.{self.field}" if row else self.field), schema[self.field].dataType, self.as_string)

    def config(self) -> dict:
        return {"type": "Simple", "function": self.function, "field": self.field, "as_string": self.as_string}


@dataclass(frozen=True)
class Exists:
    """One key: whether the field counts."""

    field: str

    def __repr__(self) -> str:
        return f"ExistsPredicate: (Exists, {self.field})"

    def keys(self, schema: T.StructType, row: str | None = None) -> Column:
        x = F.col(f"{row}.{self.field}" if row else self.field)
        return F.array(F.when(truthy(x, schema[self.field].dataType), F.lit("1")).otherwise(F.lit("0")))

    def config(self) -> dict:
        return {"type": "Exists", "field": self.field}


@dataclass(frozen=True)
class Index:
    """Keys by similarity search over all values of a field."""

    family: str
    mode: str
    threshold: float
    field: str

    @property
    def kind(self) -> str:
        return f"{self.family}{self.mode}Predicate"

    def __repr__(self) -> str:
        shown = int(self.threshold) if self.family == "Levenshtein" else float(self.threshold)
        return f"{self.kind}: ({shown}, {self.field})"

    def config(self) -> dict:
        return {"type": "Index", "family": self.family, "mode": self.mode, "threshold": self.threshold, "field": self.field}


@dataclass(frozen=True)
class Compound:
    """Records that share a key of every part."""

    parts: tuple

    def __repr__(self) -> str:
        return f"CompoundPredicate: ({', '.join(map(repr, self.parts))})"

    def keys(self, schema: T.StructType, row: str | None = None) -> Column:
        return combine([p.keys(schema, row) for p in self.parts])

    def config(self) -> dict:
        return {"type": "Compound", "parts": [p.config() for p in self.parts]}


def combine(parts: list[Column]) -> Column:
    """All combinations of one key of each part, colons inside keys escaped; none if a part has none."""
    found = F.transform(parts[0], lambda k: F.replace(k, F.lit(":"), F.lit("\\:")))
    for part in parts[1:]:
        found = _times(found, part)
    return found


def _times(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit(":"), F.replace(b, F.lit(":"), F.lit("\\:"))))))


def from_config(c: dict):
    """The predicate that config() describes."""
    if c["type"] == "Simple":
        return Simple(c["function"], c["field"], c.get("as_string", True))
    if c["type"] == "Exists":
        return Exists(c["field"])
    if c["type"] == "Index":
        return Index(c["family"], c["mode"], c["threshold"], c["field"])
    if c["type"] == "Compound":
        return Compound(tuple(from_config(p) for p in c["parts"]))
    raise ValueError(f"no predicate is of type {c['type']}")


def parts_of(predicate) -> list:
    return list(predicate.parts) if isinstance(predicate, Compound) else [predicate]


def index_parts(predicates) -> list[Index]:
    """The similarity predicates among predicates and their parts, each once."""
    return sorted({p for q in predicates for p in parts_of(q) if isinstance(p, Index)}, key=repr)
