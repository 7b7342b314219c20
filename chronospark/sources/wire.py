"""Header and metablock of a recording: reading and writing."""

from __future__ import annotations

import gzip
import json
import re
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass, field
from typing import Any
from xml.sax.saxutils import quoteattr

from ..functions.types import ALIASES, CHANNEL_TYPES, REMOVED, SPECTRUM_TYPES, SUPPORTED
from .checksums import crc32c

# Fixed values of the format: identifiers, names of the JSON root, reserved channels, trailer.
IDENTIFIERS = {"OSF4": 4, "OCEAN_STREAM_FORMAT4": 4, "OCEAN_STREAMING_FORMAT4": 4, "OSF5": 5}
JSON_ROOT, JSON_FORMAT = "osf", "osf5"
EXTENSIONS = (".osf", ".osfz")
TRAILER_CHANNEL = 0xFFFF
SIGNATURE_CHANNEL = 0xFFFE
TRAILER_TAG = b"OSF_STREAM_END"
TRAILER_TAG_BYTES = 40
HEADER_LIMIT = 512
METABLOCK_LIMIT = 1 << 30
# Attribute names of channels, and ours.
CHANNEL_FIELDS = {
    "reference": "reference", "timeincrement": "time_increment_ns", "mimetype": "mime_type", "spectrumtype": "spectrum_type", "physicalunit": "physical_unit",
    "physicaldimension": "physical_dimension", "displayname": "display_name", "comment": "comment",
}
FILE_FIELDS = {
    "created_utc": "created_utc", "creator": "creator", "reason": "reason", "tag": "tag", "comment": "comment", "namespacesep": "namespace_sep",
    "created_at_latitude": "latitude", "created_at_longitude": "longitude", "created_at_altitude": "altitude", "latitude": "latitude", "longitude": "longitude", "altitude": "altitude",
}


# Channel fields of older versions that have no meaning any more.
DEPRECATED_FIELDS = ("scale", "offset", "physicalunit1", "physicalunit2", "physicalunit3", "physicaldimension1", "physicaldimension2", "physicaldimension3")


class FormatError(ValueError):
    """The bytes are no readable recording."""


@dataclass
class Channel:
    index: int
    name: str
    datatype: str
    channel_type: str = "scalar"
    size_of_length_value: int = 2
    time_increment_ns: int | None = None
    reference: str | None = None
    mime_type: str | None = None
    spectrum_type: str | None = None
    physical_unit: str | None = None
    physical_dimension: str | None = None
    display_name: str | None = None
    comment: str | None = None

    @property
    def supported(self) -> bool:
        return self.datatype in SUPPORTED


@dataclass
class Meta:
    version: int
    integrity: str = "none"
    crc: str | None = None
    compression: str = "none"
    header_bytes: int = 0
    metablock_bytes: int = 0
    info: dict[str, Any] = field(default_factory=dict)
    channels: list[Channel] = field(default_factory=list)
    infos: list[dict[str, Any]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) >= 2 and data[0] == 0x78 and data[1] in (0x01, 0x5E, 0x9C, 0xDA))


def head(data: bytes, size: int = HEADER_LIMIT) -> bytes:
    """The first plain bytes; of a compressed stream no more than these are unpacked."""
    if not compressed(data):
        return data[:size]
    try:
        return zlib.decompressobj(47).decompress(data, size)
    except zlib.error:
        return b""


def unpack(data: bytes) -> tuple[bytes, str, bool]:
    """Plain bytes, the compression found, and whether a compressed stream was cut."""
    if compressed(data):
        kind = "gzip" if data[0] == 0x1F else "zlib"
        out, rest, cut = [], data, False
        while rest:  # a gzip file may have several members
            d = zlib.decompressobj(47)
            try:
                out.append(d.decompress(rest))
            except zlib.error as e:
                if not out:
                    raise FormatError(f"broken {kind} stream: {e}") from e
                break
            cut = not d.eof
            rest = d.unused_data if d.eof and kind == "gzip" and d.unused_data[:2] == b"\x1f\x8b" else b""
        return out[0] if len(out) == 1 else b"".join(out), kind, cut
    return data, "none", False


def peek(data: bytes) -> int | None:
    """The version that the first bytes announce, or none."""
    word = data[:HEADER_LIMIT].split(b" ", 1)[0]
    return IDENTIFIERS.get(word.decode("latin-1"))


def parse_header(data: bytes) -> Meta:
    """The magic line: identifier, length of the metablock, tokens that must be known."""
    end = data.find(b"\n", 0, HEADER_LIMIT)
    if end < 0:
        raise FormatError("no header line")
    line = data[:end].removesuffix(b"\r").decode("latin-1")
    words = line.split(" ")
    if words[0] not in IDENTIFIERS:
        raise FormatError(f"unknown identifier {words[0][:40]!r}")
    if len(words) < 2 or "" in words:
        raise FormatError("the header's fields are separated by single spaces")
    if not re.fullmatch("[0-9]+", words[1]) or int(words[1]) > METABLOCK_LIMIT:
        raise FormatError(f"no length of a metablock: {words[1][:40]!r}")
    meta = Meta(IDENTIFIERS[words[0]], header_bytes=end + 1, metablock_bytes=int(words[1]))
    for word in words[2:]:
        key, colon, value = word.partition(":")
        if meta.version == 4:
            raise FormatError("this version has no header tokens")
        if not colon or key not in ("crc32c", "ed25519"):
            raise FormatError(f"unknown header token {key!r}")
        if key == "crc32c":
            if not re.fullmatch("[0-9A-F]{8}", value) or meta.integrity != "none":
                raise FormatError("malformed header token 'crc32c'")
            meta.integrity, meta.crc = "crc32c", value
        else:
            if not re.fullmatch("[0-9a-f]{16}", value) or meta.integrity != "crc32c":
                raise FormatError("malformed header token 'ed25519'")
            meta.integrity = "signed"
    return meta


def _text(v: Any) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v) if isinstance(v, (dict, list, bool)) else str(v)


def _number(v: Any) -> float | None:
    try:
        return None if v is None else float(v)
    except (TypeError, ValueError):
        return None


def _channel(get: Any, place: int, warnings: list[str]) -> Channel:
    index, name, datatype = get("index"), get("name"), get("datatype")
    warnings += [f"channel {place}: {x} is ignored" for x in DEPRECATED_FIELDS if get(x) is not None]
    if index is None or name is None or datatype is None:
        raise FormatError(f"channel {place} lacks its index, name or datatype")
    datatype = str(datatype)
    if datatype in REMOVED:
        raise FormatError(f"channel {name!r} has the removed datatype {datatype!r}")
    datatype = ALIASES.get(datatype, datatype)
    size = int(get("sizeoflengthvalue") or 2)
    if size not in (2, 4):
        raise FormatError(f"channel {name!r} has length fields of {size} bytes")
    more: dict[str, Any] = {ours: _text(get(theirs)) for theirs, ours in CHANNEL_FIELDS.items()}
    if more["time_increment_ns"] is not None:
        more["time_increment_ns"] = int(float(more["time_increment_ns"])) if re.fullmatch(r"-?[0-9.]+", more["time_increment_ns"]) else None
    if more["spectrum_type"] is not None:
        low = more["spectrum_type"].lower()
        more["spectrum_type"] = low if low in SPECTRUM_TYPES else SPECTRUM_TYPES[0]
    kind = str(get("channeltype") or CHANNEL_TYPES[0])
    return Channel(int(index), str(name), datatype, kind, size, **more)


def _info(get: Any) -> dict[str, Any]:
    return {"name": _text(get("name")), "value": _text(get("value")), "datatype": _text(get("datatype")) or "string", "unit": _text(get("physicalunit") or get("unit"))}


def _file_info(get: Any) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for theirs, ours in FILE_FIELDS.items():
        v = get(theirs)
        if v is not None and ours not in out:
            out[ours] = _number(v) if ours in ("latitude", "longitude", "altitude") else _text(v)
    return out


def parse_metablock(meta: Meta, raw: bytes) -> Meta:
    """XML or JSON by its first character; names of channels and of the file are filled in."""
    start = raw.lstrip()[:1]
    if start == b"{":
        try:
            top = json.loads(raw.decode("utf-8"))[JSON_ROOT]
            nested = top.get("file") or {}
            meta.info = _file_info(lambda k: nested.get(k, top.get(k)))
            meta.channels = [_channel(c.get, i, meta.warnings) for i, c in enumerate(top.get("channels") or [])]
            meta.infos = [_info(x.get) for x in top.get("infos") or []]
        except (KeyError, AttributeError, TypeError, UnicodeDecodeError, json.JSONDecodeError) as e:
            raise FormatError(f"broken JSON metablock: {e}") from e
    elif start == b"<" or raw[:3] == b"\xef\xbb\xbf":
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            raise FormatError("the metablock declares entities")
        try:
            root = ET.fromstring(raw.strip(b"\0"))
        except ET.ParseError as e:
            raise FormatError(f"broken XML metablock: {e}") from e
        if root.find("./channels") is None:  # the root's name differs between writers
            raise FormatError(f"no channels in the root element {root.tag!r}")
        meta.info = _file_info(root.get)
        meta.channels = [_channel(c.get, i, meta.warnings) for i, c in enumerate(root.findall("./channels/channel"))]
        meta.infos = [_info(lambda k, x=x: x.get(k) if k != "value" or x.get(k) is not None else x.text) for x in root.findall("./infos/info")]
    else:
        raise FormatError("the metablock is neither XML nor JSON")
    return meta


def read_meta(data: bytes) -> tuple[Meta, bytes, bool]:
    """Header and metablock, the plain bytes (as they came, if they were plain), and whether
    a compressed stream was cut."""
    data, compression, cut = unpack(data)
    meta = parse_header(bytes(data[:HEADER_LIMIT]))
    meta.compression = compression
    raw = bytes(data[meta.header_bytes : meta.header_bytes + meta.metablock_bytes])
    if len(raw) < meta.metablock_bytes:
        raise FormatError("the metablock is cut")
    if meta.crc is not None and f"{crc32c(raw):08X}" != meta.crc:
        raise FormatError("the metablock's checksum does not match")
    return parse_metablock(meta, raw), data, cut


def build_metablock(version: int, info: dict[str, Any], channels: list[Channel], infos: list[dict[str, Any]] = ()) -> bytes:
    back = {ours: theirs for theirs, ours in FILE_FIELDS.items() if theirs not in ("latitude", "longitude", "altitude")}
    top = {back[k]: v for k, v in info.items() if v is not None and k in back}
    rows = []
    for c in channels:
        row: dict[str, Any] = {"index": c.index, "name": c.name, "channeltype": c.channel_type, "datatype": c.datatype, "sizeoflengthvalue": c.size_of_length_value}
        row |= {theirs: getattr(c, ours) for theirs, ours in CHANNEL_FIELDS.items() if getattr(c, ours) is not None}
        rows.append(row)
    notes = [{"name": x["name"], "value": x["value"], "datatype": x.get("datatype") or "string"} | ({"physicalunit": x["unit"]} if x.get("unit") else {}) for x in infos]
    if version == 5:
        body: dict[str, Any] = {"format": JSON_FORMAT, "version": 5, "file": top, "channels": rows}
        return json.dumps({JSON_ROOT: body | ({"infos": notes} if notes else {})}, ensure_ascii=False, indent=1).encode()

    def element(name: str, values: dict[str, Any]) -> str:
        return f"<{name} " + " ".join(f"{k}={quoteattr(str(v))}" for k, v in values.items()) + "/>"

    head = f"<{JSON_ROOT} version=\"4\"" + "".join(f" {k}={quoteattr(str(v))}" for k, v in top.items()) + ">"
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', head, f'<channels count="{len(rows)}">', *(element("channel", r) for r in rows), "</channels>"]
    if notes:
        lines += ["<infos>", *(element("info", x) for x in notes), "</infos>"]
    return "\n".join([*lines, f"</{JSON_ROOT}>"]).encode()


def build_header(version: int, metablock: bytes, integrity: str = "none") -> bytes:
    name = next(k for k, v in IDENTIFIERS.items() if v == version)
    token = f" crc32c:{crc32c(metablock):08X}" if integrity == "crc32c" else ""
    return f"{name} {len(metablock)}{token}\n".encode()


def pack(data: bytes, compression: str | None) -> bytes:
    return gzip.compress(data, mtime=0) if compression == "gzip" else data
