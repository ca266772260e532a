"""Schemas of the index tables and their controlled vocabularies. `seq` is the row's place in its source."""

from __future__ import annotations

from pyspark.sql import types as T


STEP = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "status", "detail")])
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "steps": T.ArrayType(STEP)}


def _schema(fields: str) -> T.StructType:
    """A schema from 'name type' pairs; no session is needed."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


SYMBOLS = _schema("id string, kind string, name string, containingType string, project string, file string, line int, accessibility string, attributes strings")
EDGES = _schema("from string, to string, kind string, file string, line int, via string")
ENTRY_POINTS = _schema("id string, type string, httpMethod string, route string, routeInferred boolean")
DI = _schema("service string, impl string")
FRONTEND_CALLS = _schema("id string, file string, line int, httpMethod string, rawUrl string, route string, feature string, confidence string, injectedBy strings, baseUrlDropped boolean")
API_LINKS = _schema("frontendId string, backendId string, matchKind string")
TICKETS = _schema("ticket string, commits strings, date string, message string, files strings")
CO_CHANGE = _schema("fileA string, fileB string, together int, totalA int, totalB int, strength double")
META = _schema("indexedAt string, gitCommit string, gitBranch string, solutionPath string, projectCount int, degradedProjects strings, symbolCount int, edgeCount int")
MARKER = _schema("schemaVersion int, syncId string, completedAt string, project string, gitCommit string, metaIndexedAt string, steps steps")
COMMITS = _schema("seq long, hash string, date string, message string, files strings, body string")

#: Members without which a row is malformed.
REQUIRED = {"symbols": ["id", "kind", "name", "project", "file", "line", "accessibility"], "edges": ["from", "to", "kind", "file", "line"]}

# The controlled vocabularies.
EDGE_KINDS = ["call", "new", "implements", "inherits", "read", "write"]
EDGE_VIAS = ["interface", "override", "mediatr", "delegate"]
SYMBOL_KINDS = ["Class", "Interface", "Struct", "Record", "Enum", "EnumMember", "Delegate", "Event", "Method", "Constructor", "Property", "Field"]
ENTRY_TYPES = ["http", "job", "handler"]
MATCH_KINDS = ["exact", "suffix", "ambiguous"]
STEP_STATUSES = ["ok", "partial", "failed", "skipped"]
