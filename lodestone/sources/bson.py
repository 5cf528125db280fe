"""A reader and a writer of BSON documents, for use inside tasks."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple

#: A document's bytes, at most, and how deep documents may lie inside one another; deeper ones are skipped, each by itself.
LIMIT, DEPTH = 16 << 20, 100


class Malformed(ValueError):
    """Bytes that are no document; args: what is wrong, and where."""


class TooDeep(Malformed):
    """A document that is left out, while what follows it can be read."""


def _cstring(data: bytes, at: int, end: int) -> tuple[str, int]:
    stop = data.find(b"\0", at, end)
    if stop < 0:
        raise Malformed("unterminated name", at)
    return data[at:stop].decode("utf-8", "replace"), stop + 1


_STRUCTS = {k: struct.Struct(k) for k in ("<d", "<i", "<iB", "<12s", "<B", "<q", "<II")}


def _unpack(kind: str, data: bytes, at: int, end: int) -> tuple[tuple, int]:
    form = _STRUCTS[kind]
    if at + form.size > end:
        raise Malformed("unexpected end", at)
    return form.unpack_from(data, at), at + form.size


def _value(tag: int, data: bytes, at: int, end: int, depth: int) -> tuple[str, object, int]:
    """(type, value, place after it); documents and arrays hold fields as document() yields them."""
    if tag == 0x01:
        (v,), at = _unpack("<d", data, at, end)
        return "double", v, at
    if tag == 0x02:
        (n,), at = _unpack("<i", data, at, end)
        if n <= 0 or at + n > end:
            raise Malformed("bad string length", at)
        return "string", data[at : at + n - 1].decode("utf-8", "replace"), at + n
    if tag in (0x03, 0x04):
        fields, at = document(data, at, end, depth + 1)
        return ("document", fields, at) if tag == 0x03 else ("array", [(k, v) for _, k, v in fields], at)
    if tag == 0x05:
        (n, sub), at = _unpack("<iB", data, at, end)
        if n < 0 or at + n > end:
            raise Malformed("bad binary length", at)
        return "binary", (sub, data[at : at + n]), at + n
    if tag == 0x07:
        (v,), at = _unpack("<12s", data, at, end)
        return "objectId", v.hex(), at
    if tag == 0x08:
        (v,), at = _unpack("<B", data, at, end)
        return "bool", v != 0, at
    if tag == 0x09:
        (v,), at = _unpack("<q", data, at, end)
        return "datetime", v, at
    if tag == 0x0A:
        return "null", None, at
    if tag == 0x0B:
        pattern, at = _cstring(data, at, end)
        options, at = _cstring(data, at, end)
        return "regex", (pattern, options), at
    if tag == 0x10:
        (v,), at = _unpack("<i", data, at, end)
        return "int32", v, at
    if tag == 0x11:
        (i, t), at = _unpack("<II", data, at, end)
        return "timestamp", (t, i), at
    if tag == 0x12:
        (v,), at = _unpack("<q", data, at, end)
        return "int64", v, at
    raise Malformed(f"unsupported type 0x{tag:02x}", at)


def document(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> tuple[list[tuple[str, str, object]], int]:
    """The (name, type, value) fields of the document at a place, in order, and the place after it."""
    end = len(data) if end is None else end
    if depth > DEPTH:
        raise TooDeep("nested too deep", at)
    (size,), body = _unpack("<i", data, at, end)
    if not 5 <= size <= LIMIT or at + size > end:
        raise Malformed("bad document length", at)
    stop, fields = at + size, []
    while True:
        if body >= stop:
            raise Malformed("unexpected end", body)
        tag, body = data[body], body + 1
        if tag == 0:
            if body != stop:
                raise Malformed("document ends early", body)
            return fields, stop
        name, body = _cstring(data, body, stop)
        kind, value, body = _value(tag, data, body, stop, depth)
        fields.append((name, kind, value))


def stream(chunks: Iterable[bytes]) -> Iterator[tuple[int, list | None, str | None]]:
    """(offset, fields, error) of each document of a stream that comes in chunks. An error ends it, but for a document that is too deep.

    What is held is a chunk and the document that it cuts.
    """
    held, passed = bytearray(), 0
    for some in chunks:
        held += some
        low = 0
        while len(held) - low >= 4:
            (size,) = struct.unpack_from("<i", held, low)
            if 5 <= size <= LIMIT and len(held) - low < size:
                break
            try:
                yield passed + low, document(bytes(held[low : low + max(size, 5)]))[0], None
            except Malformed as e:
                yield passed + low, None, e.args[0]
                if not isinstance(e, TooDeep):
                    return
            low += size
        del held[:low]
        passed += low
    if held:
        yield passed, None, "unexpected end"


_MORE = frozenset(("document", "array", "double"))


def fingerprint(fields: list) -> str:
    """A digest that documents share if they have the same fields of the same types and values in the same order; -0.0 is 0.0, and one NaN is another."""

    def same(kind: str, value):
        if kind == "document":
            return [(k, t, same(t, v) if t in _MORE else v) for k, t, v in value]
        if kind == "array":
            return [(t, same(t, v) if t in _MORE else v) for t, v in value]
        return value + 0.0 if kind == "double" else value

    return hashlib.md5(repr(same("document", fields)).encode("utf-8", "surrogatepass")).hexdigest()


def display(kind: str, value) -> str:
    """A value in a line of text."""
    if kind in ("string", "objectId"):
        return value
    if kind == "document":
        return "{" + ", ".join(k for k, _, _ in value) + "}"
    if kind == "array":
        return f"[{len(value)} items]"
    if kind == "datetime":
        try:
            return datetime.fromtimestamp(value / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        except (ValueError, OverflowError, OSError):
            return str(value)
    if kind == "binary":
        return str(uuid.UUID(bytes=value[1])) if value[0] == 4 and len(value[1]) == 16 else f"<{len(value[1])} bytes>"
    if kind == "timestamp":
        return f"Timestamp({value[0]}, {value[1]})"
    if kind == "regex":
        return f"/{value[0]}/{value[1]}"
    if kind == "bool":
        return "true" if value else "false"
    return "null" if kind == "null" else str(value)


def plain(kind: str, value):
    """A value as JSON has it; of repeated names the last counts."""
    if kind == "document":
        return {k: v if t in _PLAIN else plain(t, v) for k, t, v in value}
    if kind == "array":
        return [v if t in _PLAIN else plain(t, v) for t, v in value]
    if kind == "objectId":
        return {"$oid": value}
    if kind == "datetime":
        return {"$date": display(kind, value)}
    if kind == "double":
        return value if value == value and abs(value) != float("inf") else None
    if kind == "binary":
        return {"$binary": base64.b64encode(value[1]).decode(), "$subtype": f"{value[0]:02x}"}
    if kind == "regex":
        return {"$regex": value[0], "$options": value[1]}
    if kind == "timestamp":
        return {"$timestamp": {"t": value[0], "i": value[1]}}
    return value


_json = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


def as_json(fields: list) -> str:
    return _json(plain("document", fields))


#: Types whose values are themselves in JSON.
_PLAIN = frozenset(("string", "int32", "int64", "bool", "null"))


def pretty(kind: str, value, most: int = 8) -> str:
    """As display(), with arrays of a few items in full."""
    if kind == "array" and len(value) <= most:
        return "[" + ", ".join(pretty(t, v, most) for t, v in value) + "]"
    return display(kind, value)


def redacted(fields: list, names: frozenset[str], mark: str) -> list:
    """The fields with each value whose name is one of the names replaced, at any depth of documents and arrays."""

    def inside(kind: str, value) -> tuple[str, object]:
        if kind == "document":
            return kind, redacted(value, names, mark)
        return (kind, [inside(t, v) for t, v in value]) if kind == "array" else (kind, value)

    return [(k, "string", mark) if k in names else (k, *inside(t, v)) for k, t, v in fields]


def named_paths(fields: list, names: frozenset[str], above: str = "") -> list[str]:
    """The dotted paths of fields with one of the names, in order; array items have their array's path."""
    out: list[str] = []

    def inside(kind: str, value, path: str) -> None:
        if kind == "document":
            out.extend(named_paths(value, names, path + "."))
        elif kind == "array":
            for t, v in value:
                inside(t, v, path)

    for k, t, v in fields:
        if k in names:
            out.append(above + k)
        else:
            inside(t, v, above + k)
    return out


class Typed(NamedTuple):
    """A value of a type that Python's own values don't tell, as document() yields them."""

    kind: str
    value: object


def _typed(kind: str, v) -> tuple[int, bytes]:
    if kind == "objectId":
        return 0x07, bytes.fromhex(v)
    if kind == "datetime":
        return 0x09, struct.pack("<q", v)
    if kind == "int64":
        return 0x12, struct.pack("<q", v)
    if kind == "regex":
        return 0x0B, b"".join(x.encode() + b"\0" for x in v)
    if kind == "timestamp":
        return 0x11, struct.pack("<II", v[1], v[0])
    if kind == "binary":
        return 0x05, struct.pack("<iB", len(v[1]), v[0]) + v[1]
    raise ValueError(f"no type {kind}")


def encode(fields: dict) -> bytes:
    """A document of strings, numbers, booleans, nulls, bytes, lists, dictionaries and Typed values."""
    out = b""
    for name, v in fields.items():
        key = name.encode() + b"\0"
        if isinstance(v, Typed):
            tag, raw = _typed(*v)
            out += bytes([tag]) + key + raw
        elif v is None:
            out += b"\x0a" + key
        elif isinstance(v, bool):
            out += b"\x08" + key + bytes([v])
        elif isinstance(v, int):
            out += (b"\x10" + key + struct.pack("<i", v)) if -(2**31) <= v < 2**31 else (b"\x12" + key + struct.pack("<q", v))
        elif isinstance(v, float):
            out += b"\x01" + key + struct.pack("<d", v)
        elif isinstance(v, str):
            raw = v.encode() + b"\0"
            out += b"\x02" + key + struct.pack("<i", len(raw)) + raw
        elif isinstance(v, bytes):
            out += b"\x05" + key + struct.pack("<iB", len(v), 0) + v
        elif isinstance(v, list):
            out += b"\x04" + key + encode({str(i): x for i, x in enumerate(v)})
        else:
            out += b"\x03" + key + encode(v)
    return struct.pack("<i", len(out) + 5) + out + b"\0"
