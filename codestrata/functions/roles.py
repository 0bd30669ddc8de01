"""Class roles, access modifiers and change types as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Annotation -> role, in the order in which they decide.
BY_ANNOTATION = {"RestController": "CONTROLLER", "Controller": "CONTROLLER", "Service": "SERVICE", "Repository": "REPOSITORY", "RepositoryRestResource": "REP_REST_RSC", "Entity": "ENTITY", "Embeddable": "ENTITY", "FeignClient": "FEIGN_CLIENT"}
REPOSITORY_BASES = ["MongoRepository", "CrudRepository"]
BUCKETS = {"CONTROLLER": "controllers", "SERVICE": "services", "REPOSITORY": "repositories", "REP_REST_RSC": "repositories", "ENTITY": "entities", "FEIGN_CLIENT": "feignClients"}
CLASS_TYPE_OF_ROLE = {"FEIGN_CLIENT": "INTERFACE", "REP_REST_RSC": "INTERFACE"}


def class_role(annotations: Column, extended: Column) -> Column:
    """Role from an array of class-level annotation names in declared order, then from the extended types."""
    out = F.when(F.arrays_overlap(extended, F.array(*[F.lit(x) for x in REPOSITORY_BASES])), "REPOSITORY").otherwise("UNKNOWN")
    known = F.filter(annotations, lambda a: a.isin(list(BY_ANNOTATION)))
    first = F.get(known, 0)
    for k, v in BY_ANNOTATION.items():
        out = F.when(first == k, v).otherwise(out)
    return out


def mapped(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    """A CASE over the dictionary; null or another key gives the default."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def bucket(role: Column) -> Column:
    return mapped(role, BUCKETS, "unknowns")


def class_type_of_role(role: Column) -> Column:
    return mapped(role, CLASS_TYPE_OF_ROLE, "CLASS")


def access_modifier(word: Column) -> Column:
    return mapped(word, {"public": "PUBLIC", "protected": "PROTECTED", "private": "PRIVATE"}, "PACKAGE_PRIVATE")


def change_type(letter: Column) -> Column:
    """git's A, M, D. Renames and copies have no type: null (the diff is taken without rename detection)."""
    return mapped(letter, {"A": "ADD", "M": "MODIFY", "D": "DELETE"})
