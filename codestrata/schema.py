"""Column types of the tables that describe a system's source code.

Every table starts with the snapshot columns (repo, branch, commit). Components carry their own id, their parent's id and their ordinal in the
file, so that duplicates (overloads, repeated calls) survive; ``component_id`` is the readable id, in which they collide.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, L = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType()
STRINGS = T.ArrayType(S)
ATTRIBUTES = T.MapType(S, S)


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SNAPSHOT = {"repo": S, "branch": S, "commit": S}
LOCATION = struct(start_line=I, end_line=I)
ANNOTATION = struct(ordinal=I, name=S, attributes=ATTRIBUTES, owner_kind=S, owner_id=S, location=LOCATION)
IMPORT = struct(ordinal=I, package=S, object=S, is_static=B, location=LOCATION)
FIELD = struct(ordinal=I, component_id=S, name=S, field_type=S, protection=S, is_static=B, is_final=B, initializer=S, location=LOCATION)
PARAMETER = struct(ordinal=I, name=S, parameter_type=S, is_varargs=B, annotations=T.ArrayType(struct(name=S, attributes=ATTRIBUTES)))
METHOD = struct(
    ordinal=I, component_id=S, parent_component_id=S, name=S, return_type=S, protection=S, is_static=B, is_final=B, is_abstract=B, thrown=STRINGS,
    parameters=T.ArrayType(PARAMETER), annotations=T.ArrayType(struct(name=S, attributes=ATTRIBUTES)), location=LOCATION,
)
CALL = struct(ordinal=I, component_id=S, parent_component_id=S, name=S, object_name=S, object_type=S, called_from=S, arguments=S, url_argument=S, location=LOCATION)
CLASS = struct(
    package=S, name=S, class_type=S, protection=S, is_static=B, is_final=B, is_abstract=B, extended_types=STRINGS, implemented_types=STRINGS, enum_constants=STRINGS,
    class_annotations=T.ArrayType(struct(name=S, attributes=ATTRIBUTES)), annotations=T.ArrayType(ANNOTATION), imports=T.ArrayType(IMPORT), fields=T.ArrayType(FIELD),
    methods=T.ArrayType(METHOD), calls=T.ArrayType(CALL), parse_error=S,
)
REST_CALL = struct(component_id=S, parent_component_id=S, ordinal=I, called_from=S, object_type=S, arguments=S, url=S, http_method=S)
ENDPOINT = T.StructType([*METHOD.fields, T.StructField("role", S), T.StructField("url", S), T.StructField("http_method", S), T.StructField("required", STRINGS)])
FILES = struct(**SNAPSHOT, path=S, content=S)
SERVICES = struct(**SNAPSHOT, path=S, name=S)
CONFIG_FILE = struct(**SNAPSHOT, path=S, json=S)
FILE_CHANGE = struct(repo=S, branch=S, path=S, change_type=S)
COMPONENT_CHANGE = struct(
    repo=S, branch=S, path=S, kind=S, component_id=S, copy=I, change_type=S, old_parent_component_id=S, old_payload=S, new_parent_component_id=S, new_payload=S
)
CONFIG = struct(systemName=S, systemRepositories=T.ArrayType(struct(repoBranchPair=struct(repositoryURL=S, branchName=S), commitID=S)))


def json_schemas() -> dict[str, str]:
    """The exported tables' schemas as JSON."""
    from .plans.tables import TABLES

    return {name: schema.json() for name, schema in TABLES.items()}
