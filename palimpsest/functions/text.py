"""Text, path, JSON and file-attribute functions as column expressions; the few that need code are Arrow UDFs."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SNIPPET = 300


def content_hash(data: Column) -> Column:
    """SHA-256 in lower-case hex of the bytes as they are, before any compression."""
    return F.sha2(data.cast("binary"), 256)


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data.cast("binary")))


def is_content_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def snippet(*texts: Column) -> Column:
    """The first 300 characters of the first text that is not null."""
    return F.substring(F.coalesce(*texts, F.lit("")), 1, SNIPPET)


def contains_ignoring_case(text: Column, needle: str, escape: bool = False) -> Column:
    """Substring match without regard to case; % and _ of the needle are wildcards unless escaped."""
    if escape:
        needle = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{needle}%")


def same(a: Column, b: Column) -> Column:
    """Equality that takes nulls as equal."""
    return a.eqNullSafe(b)


def optional(condition: Column | None) -> Column:
    """A predicate that holds where the argument it was built from is absent."""
    return F.lit(True) if condition is None else condition


def patched(given: object, current: Column) -> Column:
    """The given value, or the current one where none is given."""
    return F.coalesce(F.lit(given), current)


@pandas_udf(T.StringType())
def _base32_lower(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else base64.b32encode(b).decode().rstrip("=").lower())


def content_id(hash_hex: Column, size: Column) -> Column:
    """The version-1 raw content identifier of a single block, null from 262144 bytes on; a malformed hash is an error."""
    good = F.when(is_content_hash(hash_hex), hash_hex).otherwise(F.raise_error(F.concat(F.lit("not a SHA-256: "), F.coalesce(hash_hex, F.lit("null")))))
    raw = F.concat(F.unhex(F.lit("01551220")), F.unhex(good))
    return F.when(size < 262_144, F.concat(F.lit("b"), _base32_lower(raw)))


def tokenize_identifier(name: Column) -> Column:
    """Lower-case words of an identifier.

    Borders are the signs _ - . / : and blank, a capital after a small letter, and
    the last of several capitals before a small letter. Marks are put in by regular
    expressions, so the whole runs in the JVM.
    """
    camel = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", "\u0001")
    # a run of two signs or more before the capital that begins a word
    acronym = F.regexp_replace(camel, r"(?<=[^_\-./: \x01]{2})(?=\p{Lu}\p{Ll})", "\u0001")
    return F.filter(F.transform(F.split(acronym, r"[_\-./: \x01]"), F.lower), lambda t: t != "")


def detect_language(filename: Column) -> Column:
    """Language by what follows the last dot (the whole name if there is none)."""
    extension = F.lower(F.element_at(F.split(filename, r"\."), -1))
    # fixed values: extensions and languages
    known = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "json": "json"}
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[extension]


def file_type(mode: Column, is_dir: Column) -> Column:
    """Kind of file by the type bits of its mode; rows written before those bits were kept go by is_dir."""
    # fixed values: POSIX type bits
    kinds = {0o140000: "socket", 0o120000: "symlink", 0o100000: "file", 0o060000: "block", 0o040000: "directory", 0o020000: "char", 0o010000: "fifo"}
    bits = mode.bitwiseAND(F.lit(0o170000))
    out = F.when(is_dir, F.lit("directory")).otherwise(F.lit("file"))
    for value, kind in kinds.items():
        out = F.when(bits == value, F.lit(kind)).otherwise(out)
    return out


def stat_columns(size: str = "size", is_dir: str = "is_dir") -> dict[str, Column]:
    """What a stat call shows: no negative size, blocks of 512, two links for a directory."""
    shown = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    return {"st_size": shown, "st_blocks": F.ceil(shown / 512), "st_nlink": F.when(F.col(is_dir), 2).otherwise(1)}


def marker_name(seq: Column, hash_hex: Column) -> Column:
    return F.concat(F.lpad(seq.cast("string"), 20, "0"), F.lit("_"), hash_hex, F.lit(".json"))


def parse_marker_name(name: Column) -> tuple[Column, Column]:
    """Sequence and hash of a marker's file name; null where the name is malformed."""
    pattern = r"^([0-9]{20})_([0-9a-f]{64})\.json$"
    good = name.rlike(pattern)
    return F.when(good, F.regexp_extract(name, pattern, 1).cast("long")), F.when(good, F.regexp_extract(name, pattern, 2))


def age_seconds(created: Column, now: Column) -> Column:
    """Seconds, to the millisecond, since an RFC 3339 text; null if it can't be read."""
    return (F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.try_to_timestamp(created))) / 1000


def entries_for_memory(ram_bytes: Column) -> Column:
    """How many entries a cache may hold: a 64th of memory at 256 bytes each, within 1024 and 100000."""
    return F.greatest(F.lit(1024), F.least(F.lit(100_000), F.floor(ram_bytes / 64 / 256)))


def impl_target(header: Column) -> Column:
    """The type an impl block is for: what follows ``for``, or ``impl`` and its parameters, without its own."""
    body = F.regexp_replace(F.trim(header), r"^(unsafe\s+)?impl\s*(<[^{]*?>)?\s*", "")
    target = F.when(body.rlike(r"\bfor\s"), F.regexp_replace(body, r"^.*?\bfor\s+", "")).otherwise(body)
    return F.trim(F.regexp_extract(target, r"^([^<{\s]+)", 1))


def normalize_path(path: Column) -> Column:
    """Forward slashes, and from ``crates/`` on where that occurs."""
    slashed = F.regexp_replace(path, r"\\", "/")
    at = F.locate("crates/", slashed)
    return F.when(at > 0, F.substring(slashed, at, F.length(slashed))).otherwise(F.regexp_replace(slashed, r"^\./", ""))


def crate_of(path: Column) -> Column:
    """The folder after ``crates``, or the first one."""
    parts = F.split(normalize_path(path), "/")
    at = F.array_position(parts, "crates")
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int"))).otherwise(F.try_element_at(parts, F.lit(1)))


def json_contains(data: Column, wanted: object) -> Column:
    """Whether JSON text holds ``wanted``: objects as subsets, at any depth, all else by equality, arrays whole."""
    return _contains(F.try_parse_json(data), "$", wanted)


def _contains(data: Column, path: str, wanted: object) -> Column:
    if isinstance(wanted, dict):
        here = F.schema_of_variant(F.try_variant_get(data, path, "variant")).startswith("OBJECT")
        out = F.coalesce(here, F.lit(False))
        for key, value in wanted.items():
            out = out & _contains(data, f"{path}[{json.dumps(key)}]" if "'" in key else f"{path}['{key}']", value)
        return out
    found = F.to_json(F.try_variant_get(data, path, "variant"))
    return F.coalesce(found == F.to_json(F.parse_json(F.lit(json.dumps(wanted)))), F.lit(False))


def _strings(value: object, out: list[str]) -> None:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, list):
        for item in value:
            _strings(item, out)
    elif isinstance(value, dict):
        for key in sorted(value):
            _strings(value[key], out)


@pandas_udf(T.StringType())
def json_strings(texts: pd.Series) -> pd.Series:
    """All string values of JSON text, depth first with keys in order, joined by blanks; null if there is none."""

    def one(text):
        if text is None:
            return None
        try:
            found: list[str] = []
            _strings(json.loads(text), found)
        except ValueError:
            return None
        return " ".join(found) or None

    return texts.map(one)


def search_text(data: Column, special_data: Column) -> Column:
    """Text to search a version by: its bytes where they are UTF-8, else the strings of its JSON."""
    raw = data.cast("binary")
    return F.when(raw.isNotNull() & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(json_strings(special_data))


@pandas_udf(T.BinaryType())
def compress(data: pd.Series) -> pd.Series:
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    return data.map(lambda b: None if b is None else packer.compress(bytes(b)))


@pandas_udf(T.BinaryType())
def decompress(data: pd.Series) -> pd.Series:
    """The bytes of a frame; null where it can't be decoded."""
    import zstandard

    def one(b):
        try:
            return None if b is None else zstandard.ZstdDecompressor().decompressobj().decompress(bytes(b))
        except zstandard.ZstdError:
            return None

    return data.map(one)


def _rotated(x: int, k: int) -> int:
    x &= 0xFFFFFFFF
    return ((x << k) | (x >> (32 - k))) & 0xFFFFFFFF


def lock_hash(data: bytes) -> int:
    """The signed 32-bit hash that advisory locks are keyed by (Jenkins' lookup3, little-endian)."""
    mask = 0xFFFFFFFF
    a = b = c = (0x9E3779B9 + len(data) + 3923095) & mask
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data) - len(data) % 12, 4)]
    for i in range(0, len(words), 3):
        a, b, c = (a + words[i]) & mask, (b + words[i + 1]) & mask, (c + words[i + 2]) & mask
        for turn in (4, 6, 8, 16, 19, 4):
            a = ((a - c) ^ _rotated(c, turn)) & mask
            c = (c + b) & mask
            a, b, c = b, c, a
    tail = data[len(data) - len(data) % 12 :]
    a = (a + int.from_bytes(tail[:4], "little")) & mask
    b = (b + int.from_bytes(tail[4:8], "little")) & mask
    c = (c + (int.from_bytes(tail[8:], "little") << 8)) & mask
    for turn in (14, 11, 25, 16, 4, 14, 24):
        c = ((c ^ b) - _rotated(b, turn)) & mask
        a, b, c = b, c, a
    # after seven turns the last word written stands second
    return b - (1 << 32) if b >> 31 else b


@pandas_udf(T.IntegerType())
def lock_key(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else lock_hash(t.encode()))


def consolidation_lock_key(plugin_type: Column, model_id: Column) -> Column:
    return lock_key(F.concat(plugin_type, model_id)).cast("long")


@pandas_udf(T.ArrayType(T.FloatType()))
def test_embedding(texts: pd.Series, dims: pd.Series) -> pd.Series:
    """A unit vector made of a text's digest: deterministic noise to test with, no model."""
    return pd.Series([noise_vector(t or "", int(d)) for t, d in zip(texts, dims)])


def noise_vector(text: str, dim: int):
    import hashlib

    import numpy as np

    base = hashlib.sha256(text.encode()).digest()
    draws = np.array([int.from_bytes(hashlib.sha256(base + i.to_bytes(4, "little")).digest()[:4], "little") for i in range(dim)], dtype=np.float64)
    v = (draws / 0xFFFFFFFF * 2 - 1).astype(np.float32)
    length = np.sqrt((v * v).sum(dtype=np.float32))
    return v / length if length > 0 else v
