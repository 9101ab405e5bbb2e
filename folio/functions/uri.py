"""Addresses: data, file and web."""

from __future__ import annotations

import base64
import binascii
import os
from urllib.parse import unquote, unquote_to_bytes, urljoin, urlsplit
from urllib.request import url2pathname

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_data_uri(uri: str) -> tuple[str | None, dict[str, str], bytes]:
    """Media type, attributes and bytes of a data address."""
    if uri[:5].lower() != "data:":
        raise ValueError("not a data address")
    head, comma, body = uri[5:].partition(",")
    if not comma:
        raise ValueError("a data address without a comma")
    parts = head.split(";")
    packed = parts[-1] == "base64"
    parts = parts[:-1] if packed else parts
    mime = parts[0] if parts and parts[0] else None
    attributes = {k: v for p in parts[1:] for k, eq, v in [p.partition("=")] if k} if len(parts) > 1 else {}
    if packed:
        try:
            return mime, attributes, base64.b64decode(unquote(body))
        except binascii.Error as e:
            raise ValueError(f"bad base64 in a data address: {e}") from e
    return mime, attributes, unquote_to_bytes(body)


def file_uri_to_path(uri: str) -> tuple[str | None, str]:
    """Host, if any, and the absolute path of a file address."""
    u = urlsplit(uri)
    if u.scheme != "file":
        raise ValueError(f"not a file address: {uri}")
    return u.netloc or None, os.path.abspath(url2pathname(u.path))


def join(base: str, target: str) -> str | None:
    """Where a link leads; nothing unless it is the web."""
    target = target.strip()
    if not target:
        return None
    out = urljoin(base, target)
    return out if urlsplit(out).scheme in ("http", "https") else None


# -- as columns ---------------------------------------------------------------------------------


def data_uri_head(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^data:([^,]*),", 1)


def data_uri_mime(uri: Column) -> Column:
    m = F.regexp_extract(data_uri_head(uri), r"^([^;]*)", 1)
    return F.when((m != "") & (m != "base64"), m)


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a base64 data address; null for others and for bad ones."""
    packed = data_uri_head(uri).rlike(r"(^|;)base64$")
    return F.when(packed, F.try_to_binary(F.regexp_extract(uri, r"^data:[^,]*,(.*)$", 1), F.lit("base64")))


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def redirect_target(url: Column) -> Column:
    """The address in the ``u`` parameter of a search engine's redirect; the address itself without one."""
    u = F.try_parse_url(url, F.lit("QUERY"), F.lit("u"))
    raw = F.translate(F.regexp_replace(F.substring(u, 3, 4096), "=+$", ""), "-_", "+/")
    padded = F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), "=")
    return F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string"), url)
