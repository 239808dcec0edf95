"""Deterministic identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

UNIT_SEPARATOR = "\x1f"
# Fixed value: namespace of point identifiers.
POINT_NAMESPACE = "266db0a3-86b4-4d21-a61e-dbb1d37dc7f5"
# Fixed value: namespace of the older collections.
POINT_NAMESPACE_V1 = "d95a4f3e-4a3b-4f8e-9c2a-8e2f6b9a1d70"
UUID_TEXT = r"(?i)^(?:urn:)?(?:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("string"), 256)


def prefixed(prefix: str, *parts: Column, compose: bool = False) -> Column:
    """``prefix_`` and 24 hex digits of SHA-256 over the trimmed parts.

    Parts are hashes or text that was composed on the way in; pass
    ``compose=True`` for raw text.
    """
    clean = [tx.strip(tx.nfc(p) if compose else p.cast("string")) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.substring(sha256(F.concat_ws(UNIT_SEPARATOR, *clean)), 1, 24))


def document_id(
    title: Column,
    doc_type: Column,
    category: Column,
    authority: Column,
    act_number: Column,
    path: Column,
    compose: bool = False,
) -> Column:
    """Identity of a document, from the strongest evidence it has."""
    key = tx.identity_words(title, compose)

    def has(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return (
        F.when(has(authority) & has(act_number) & has(key), prefixed("doc", authority, act_number, key))
        .when(has(doc_type) & has(key), prefixed("doc", doc_type, key))
        .when(has(category) & has(key), prefixed("doc", category, key))
        .otherwise(prefixed("doc", path, compose=compose))
    )


def version_id(doc_id: Column, canonical_text: Column) -> Column:
    return prefixed("dver", doc_id, sha256(canonical_text))


def unit_id(doc_id: Column, kind: Column, locator: Column) -> Column:
    return prefixed("unit", doc_id, kind, locator)


def logical_chunk_id(doc_id: Column, units: Column, split_index: Column) -> Column:
    return prefixed("lchunk", doc_id, F.array_join(units, "|"), split_index.cast("string"))


def chunk_id(version: Column, logical: Column, content_hash: Column) -> Column:
    return prefixed("chunk", version, logical, content_hash)


def parent_id(version: Column, locator: Column, segment: Column) -> Column:
    return prefixed("parent", version, locator, segment.cast("string"))


def _dashed(hex32: Column) -> Column:
    return F.regexp_replace(hex32, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    raw = F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8"))
    h = F.sha1(raw)
    variant = F.substring(
        F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1)
    )
    return _dashed(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def point_id(chunk_id: Column, namespace: str = POINT_NAMESPACE) -> Column:
    return uuid5(chunk_id, namespace)


def point_id_v1(value: Column, namespace: str = POINT_NAMESPACE_V1, numeric: bool = False) -> Column:
    """Integer columns and valid UUIDs pass through; other text gets a name-based UUID."""
    text = value.cast("string")
    if numeric:
        return text
    hex32 = F.lower(F.regexp_replace(text, r"(?i)urn:|uuid:|[{}-]", ""))
    return F.when(text.rlike(UUID_TEXT), _dashed(hex32)).otherwise(uuid5(text, namespace))
