"""Stable identifiers and digests over canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with fields in alphabetical order and nulls kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def stable_id(prefix: str, **fields: Column) -> Column:
    digest = F.sha2(canonical_json(**fields), 256)
    return F.concat(F.lit(prefix + "_"), F.substring(digest, 1, 24))


def scope_key(tenant: Column, application: Column, knowledge_base: Column) -> Column:
    joined = F.concat_ws("\u0000", tenant, application, knowledge_base)
    return F.substring(F.sha2(joined, 256), 1, 24)


def envelope(payload_json: Column, schema_version: Column, upstream: Column) -> Column:
    """Canonical artifact text: payload, schema version and upstream digest."""
    return F.concat(
        F.lit('{"payload":'), payload_json,
        F.lit(',"schema_version":'), F.concat(F.lit("\""), schema_version, F.lit("\"")),
        F.lit(',"upstream_sha256":"'), upstream, F.lit('"}'),
    )
