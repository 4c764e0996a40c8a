"""Admission, error and callback rules as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.text import strip
from voxloom.params import DEFAULTS

# Accepted extensions, permanent-error words, error classes.
EXTENSIONS = (".wav", ".mp3", ".flac", ".m4a", ".ogg")
PERMANENT_WORDS = (
    "corrupt",
    "unsupported format",
    "invalid audio",
    "cannot decode",
    "header corrupt",
    "not a valid audio",
    "bozuk",
    "desteklenmeyen",
)
PERMANENT_TYPES = ("PermanentJobError", "ValueError", "TypeError")

# IPv4 networks that callbacks must not reach (private, loopback, link-local, multicast, reserved).
BLOCKED_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
# Globally reachable addresses inside 192.0.0.0/24.
ALLOWED_V4 = ("192.0.0.9/32", "192.0.0.10/32")


def extension(file_name: Column) -> Column:
    """Lower-case suffix of the last path part; a leading dot alone is no suffix."""
    return F.lower(F.regexp_extract(file_name, r"[^/](\.[^./]+)$", 1))


def safe_extension(file_name: Column) -> Column:
    """Extension kept for storage keys, or ``.bin``."""
    ext = F.lower(F.regexp_extract(file_name, r"[^/.][^/]*?(\.[^./]*)$", 1))
    return F.when(ext.rlike(r"^\.[a-z0-9]{1,8}$"), ext).otherwise(".bin")


def uri_parts(uri: Column) -> Column:
    """Struct of scheme, bucket (s3 only), key and ``safe`` (disk keys must stay in their folder)."""
    scheme = F.regexp_extract(uri, r"^([a-z0-9]+)://", 1)
    rest = F.regexp_replace(uri, r"^[a-z0-9]+://", "")
    s3 = scheme == "s3"
    key = F.when(s3, F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)).otherwise(rest)
    unsafe = (scheme == "disk") & (rest.contains("..") | rest.contains("/") | rest.contains("\\"))
    return F.struct(
        scheme.alias("scheme"),
        F.when(s3, F.regexp_extract(rest, r"^([^/]*)", 1)).alias("bucket"),
        key.alias("key"),
        (~unsafe).alias("safe"),
    )


def _net(cidr: str) -> tuple[int, int]:
    address, bits = cidr.split("/")
    base = 0
    for octet in address.split("."):
        base = base * 256 + int(octet)
    return base, base + 2 ** (32 - int(bits)) - 1


def ipv4_number(ip: Column) -> Column:
    """Address as a number; null when it is not four octets."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
    value = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    ok = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, value)


def _v4_public(number: Column) -> Column:
    inside = lambda nets: _any([number.between(*_net(n)) for n in nets])
    return ~inside(BLOCKED_V4) | inside(ALLOWED_V4)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _v6_public(ip: Column) -> Column:
    """Global unicast (2000::/3) outside the special-purpose blocks."""
    hextet = lambda i: F.coalesce(
        F.conv(F.nullif(F.split_part(ip, F.lit(":"), F.lit(i)), F.lit("")), 16, 10).try_cast("bigint"), F.lit(0)
    )
    a, b, c = hextet(1), hextet(2), hextet(3)
    ok = ip.rlike("^[0-9A-Fa-f:]+$") & ip.contains(":") & a.between(0x2000, 0x3FFF)
    protocol = (a == 0x2001) & (b < 0x200)
    named = (b == 3) | ((b == 4) & (c == 0x112)) | b.between(0x20, 0x3F) | ip.isin("2001:1::1", "2001:1::2")
    special = (protocol & ~named) | ((a == 0x2001) & (b == 0xDB8)) | (a == 0x2002) | ((a == 0x3FFF) & (b < 0x1000))
    return ok & ~special


def ip_is_public(ip: Column) -> Column:
    plain = F.regexp_replace(ip, "(?i)^::ffff:(?=[0-9.]+$)", "")
    number = ipv4_number(plain)
    return F.coalesce(F.when(number.isNotNull(), _v4_public(number)).otherwise(_v6_public(plain)), F.lit(False))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(strip(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(strip(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    bare = F.regexp_replace(url_netloc(url), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r":\d*$", ""), r"^\[|\]$", ""))


def callback_allowed(
    url: Column, resolved_ips: Column, development: bool = False, allowed_hosts: list[str] | None = None
) -> Column:
    """Whether a callback may be used. ``resolved_ips`` are the host's addresses; none means unresolved.

    Blank is allowed; otherwise https (http in development), a listed host if
    a list is given, and public addresses only.
    """
    schemes = ["http", "https"] if development else ["https"]
    host = url_host(url)
    ok = url_scheme(url).isin(schemes) & (host != "")
    if allowed_hosts:
        ok = ok & host.isin([h.strip().lower() for h in allowed_hosts if h.strip()])
    ok = ok & F.coalesce(F.size(resolved_ips) > 0, F.lit(False)) & F.coalesce(F.forall(resolved_ips, ip_is_public), F.lit(False))
    return F.when(url.isNull() | (strip(url) == ""), True).otherwise(ok)


def reject_reason(callback_ok: Column, content_ok: Column, max_bytes: int = DEFAULTS.max_upload_bytes) -> Column:
    """First failing admission rule, or null; reads num_speakers, file_name and size_bytes."""
    return (
        F.when(~F.coalesce(F.col("num_speakers").between(1, 10), F.lit(True)), "num_speakers")
        .when(F.coalesce(F.col("file_name"), F.lit("")) == "", "file_name")
        .when(~extension(F.col("file_name")).isin(*EXTENSIONS), "extension")
        .when(F.col("size_bytes") > max_bytes, "too_large")
        .when(F.col("size_bytes") == 0, "empty")
        .when(~callback_ok, "callback_url")
        .when(~content_ok, "content")
    )


def reject_code(reason: Column) -> Column:
    return F.when(reason.isNull(), 202).when(reason == "too_large", 413).otherwise(400)


def error_is_transient(error_type: Column, message: Column) -> Column:
    words = F.lower(message).rlike("|".join(PERMANENT_WORDS))
    return (
        F.when(error_type == "TransientJobError", True)
        .when(error_type.isin(*PERMANENT_TYPES), False)
        .otherwise(~F.coalesce(words, F.lit(False)))
    )


def sanitise_error(error_type: Column, message: Column) -> Column:
    """Type name and message with absolute Windows and Unix paths masked."""
    out = F.regexp_replace(message, r"(?U)[A-Za-z]:\\[^\s:]+", "[FILE_PATH]")
    out = F.regexp_replace(out, r"(?U)/(?=[^\s:]+?/[^\s:])[^\s:]++", "[FILE_PATH]")
    return F.concat(error_type, F.lit(": "), out)


def client_key(api_key: Column, ip: Column) -> Column:
    digest = F.substring(F.sha2(strip(api_key), 256), 1, 16)
    return F.when(F.coalesce(strip(api_key), F.lit("")) != "", F.concat(F.lit("key_hash:"), digest)).otherwise(
        F.concat(F.lit("ip:"), F.coalesce(ip, F.lit("127.0.0.1")))
    )


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256; the key pads are made on the driver, the rest is native."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def sign(secret: str, timestamp: Column, body: Column) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(secret, F.concat(timestamp, F.lit("."), body)))


def signature_valid(
    secret: str, timestamp: Column, body: Column, signature: Column, now: Column, tolerance: int = 300
) -> Column:
    """Signature matches and the timestamp is a whole number within ``tolerance`` seconds of ``now``."""
    at = strip(timestamp).try_cast("bigint")
    fresh = F.abs(now - at) <= tolerance
    return F.coalesce(fresh & (sign(secret, timestamp, body) == signature), F.lit(False))


def webhook_backoff_seconds(attempts: Column) -> Column:
    return (F.pow(F.lit(2.0), attempts - 1) * 5).cast("long")


def worker_backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)))
