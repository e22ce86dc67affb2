"""Schemas of the graph model and its results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Keys of an entity that anything reads; ord is its position in the file.
ENTITY = """id string, name string, type string, is_declaration boolean, source_file string, file string,
start_line int, end_line int, code string, body string, scope string, ord long"""
RELATION = """head string, tail string, type string, call_line int, call_type string, target_type string,
field_path array<string>, context_var_id string, context_var_name string, resolution_type string,
visibility_checked boolean, ord long"""

ENTITY_COLUMNS = [c.split()[0] for c in ENTITY.replace("\n", " ").split(", ")]
RELATION_COLUMNS = [c.split()[0] for c in RELATION.replace("\n", " ").split(", ")]


@dataclass(frozen=True)
class Graph:
    """Entities and relations, with the columns above."""

    entities: DataFrame
    relations: DataFrame

    def of(self, kind: str) -> DataFrame:
        return self.entities.where(self.entities["type"] == kind)

    def rel(self, kind: str) -> DataFrame:
        return self.relations.where(self.relations["type"] == kind)
