"""Deterministic identities: as Spark columns, and as Python for scalars and tests."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = re.compile(r"[0-9a-f]+")
_SAFE = 2**53 - 1


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- columns -----------------------------------------------------------------------------


def field(value: Column | str) -> Column:
    """``<bytes>:<value>``: length-prefixed, so that joined fields can't be mistaken for others."""
    v = _c(value)
    return F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)


def field_list(values: Column | str) -> Column:
    v = _c(values)
    return F.concat(F.size(v).cast("string"), F.lit(":"), F.array_join(F.transform(v, field), ""))


def sha256(text: Column | str) -> Column:
    return F.sha2(_c(text).cast("binary"), 256)


def _hex_only(value: Column | str, what: str) -> Column:
    v = _c(value)
    return F.when(v.rlike("^[0-9a-f]+$"), v).otherwise(F.raise_error(F.concat(F.lit(f"{what} is not lowercase hex: "), F.coalesce(v, F.lit("null")))))


def document_id(source_id: Column | str, normalized_key: Column | str) -> Column:
    return sha256(F.concat(F.lit("doc:"), field(source_id), field(normalized_key)))


def version_id(document: Column | str, content_hash: Column | str) -> Column:
    return sha256(F.concat(F.lit("ver:"), field(document), field(_hex_only(content_hash, "content hash"))))


def derivation_key(name: Column | str, version: Column | str, config_hash: Column | str, input_ids: Column | str) -> Column:
    """Of the inputs in byte order; a repeated input is an error."""
    ids = F.array_sort(_c(input_ids))
    ids = F.when(F.size(F.array_distinct(ids)) == F.size(ids), ids).otherwise(F.raise_error(F.lit("duplicate input id")))
    return sha256(F.concat(F.lit("der:"), field(name), field(version), field(config_hash), field_list(ids)))


def artifact_id(key: Column | str, ordinal: Column | str) -> Column:
    n = _c(ordinal)
    n = F.when(n >= 0, n).otherwise(F.raise_error(F.lit("ordinal must not be negative")))
    return sha256(F.concat(F.lit("art:"), field(key), field(n.cast("bigint").cast("string"))))


def outputs_hash(outputs: Column | str) -> Column:
    """Of an array of structs (ordinal, artifact_id, content_hash), in order of ordinal; empty arrays have a hash too."""
    pairs = F.transform(F.array_sort(_c(outputs)), lambda o: F.concat(o["artifact_id"], F.lit(":"), o["content_hash"]))
    return sha256(F.concat(F.lit("out:"), F.array_join(pairs, "\0")))


def contiguous(outputs: Column | str) -> Column:
    """Whether the ordinals of such an array are exactly 0 .. n - 1."""
    ordinals = F.transform(F.array_sort(_c(outputs)), lambda o: o["ordinal"].cast("bigint"))
    return F.coalesce(ordinals == F.when(F.size(ordinals) > 0, F.sequence(F.lit(0).cast("bigint"), (F.size(ordinals) - 1).cast("bigint"))).otherwise(ordinals), F.lit(False))


def blob_key(content_hash: Column | str) -> Column:
    return _hex_only(content_hash, "content hash")


def blob_path(root: str, key: Column | str) -> Column:
    """``<root>/<first two>/<rest>`` of a key of three or more lowercase hex digits."""
    k = _c(key)
    k = F.when(k.rlike("^[0-9a-f]{3,}$"), k).otherwise(F.raise_error(F.lit("malformed blob key")))
    return F.concat(F.lit(root.rstrip("/") + "/"), F.substring(k, 1, 2), F.lit("/"), k.substr(F.lit(3), F.length(k)))


def content_hash(content: Column | str) -> Column:
    """Of the raw bytes, never of a normalised text."""
    return F.sha2(_c(content).cast("binary"), 256)


def epoch_ms(value: Column | str) -> Column:
    """A whole number of milliseconds within the safe integers, or an error."""
    v = _c(value)
    fine = (v == F.floor(v)) & (F.abs(v) <= _SAFE)
    return F.when(fine, v.cast("bigint")).when(v.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("not a whole number of milliseconds")))


# --- Python twins ------------------------------------------------------------------------


def py_field(value: str) -> str:
    return f"{len(value.encode())}:{value}"


def py_field_list(values: Sequence[str]) -> str:
    return f"{len(values)}:" + "".join(map(py_field, values))


def _digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def py_document_id(source_id: str, normalized_key: str) -> str:
    return _digest("doc:" + py_field(source_id) + py_field(normalized_key))


def py_version_id(document: str, content: str) -> str:
    if not HEX.fullmatch(content):
        raise ValueError("content hash is not lowercase hex")
    return _digest("ver:" + py_field(document) + py_field(content))


def py_derivation_key(name: str, version: str, config_hash: str, input_ids: Iterable[str]) -> str:
    ids = sorted(input_ids, key=str.encode)
    if len(set(ids)) != len(ids):
        raise ValueError("duplicate input id")
    return _digest("der:" + py_field(name) + py_field(version) + py_field(config_hash) + py_field_list(ids))


def py_artifact_id(key: str, ordinal: int) -> str:
    if ordinal < 0:
        raise ValueError("ordinal must not be negative")
    return _digest("art:" + py_field(key) + py_field(str(ordinal)))


def py_outputs_hash(outputs: Iterable[tuple[int, str, str]]) -> str:
    rows = sorted(outputs)
    if [r[0] for r in rows] != list(range(len(rows))):
        raise ValueError("ordinals must be 0 .. n - 1")
    return _digest("out:" + "\0".join(f"{a}:{c}" for _, a, c in rows))


#: Marks an object's member as absent.
UNDEFINED = object()


def canonical_json(value: Any) -> str:
    """The one JSON text of a configuration.

    Null, booleans, safe whole numbers (1.0 is 1, -0 is 0), strings in NFC,
    arrays, and objects with NFC keys in byte order. Undefined members are left
    out; keys that meet after NFC, fractions, NaN and other types are errors.
    """
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and (not math.isfinite(value) or value != int(value)):
            raise ValueError("configuration numbers must be whole")
        if abs(value) > _SAFE:
            raise ValueError("configuration numbers must be safe integers")
        return str(int(value))
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value), ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        if any(v is UNDEFINED for v in value):
            raise ValueError("undefined array element")
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, Mapping):
        members: dict[str, str] = {}
        for k, v in value.items():
            if v is UNDEFINED:
                continue
            key = unicodedata.normalize("NFC", k)
            if key in members:
                raise ValueError("keys meet after NFC")
            members[key] = canonical_json(v)
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + members[k] for k in sorted(members, key=str.encode)) + "}"
    raise ValueError(f"not a configuration value: {type(value).__name__}")


def canonical_config_hash(config: Any) -> str:
    return _digest(canonical_json(config))
