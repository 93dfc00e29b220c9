"""File identity: URL / path parsing as pure column expressions.

Rules (fixed, they decide which rows share a key):
  * a URL is text starting with ``http://`` or ``https://`` (case-sensitive);
  * host containing ``youtube.com`` or ``youtube-nocookie.com``: first non-blank
    query value ``v`` (percent-decoded), first 11 characters; else, when the
    slash-trimmed path has at least two parts, the last part's first 11;
  * host containing ``youtu.be``: slash-trimmed path, first 11;
  * any other URL: every character outside ``[a-zA-Z0-9_-]`` becomes ``_``,
    first 32 characters (also used when the URL has no host at all);
  * not a URL: the path stem (last component without its last suffix).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonotable import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def is_url(text) -> Column:
    return _c(text).rlike(r"^https?://")


def url_host(url) -> Column:
    """Lower-cased host: authority without user info and port."""
    netloc = F.regexp_extract(_c(url), _SCHEME + r"([^/?#]*)", 1)
    host = F.regexp_extract(netloc, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    host = F.regexp_replace(host, r"^\[|\]$", "")
    return F.lower(host)


def url_path(url) -> Column:
    return F.regexp_extract(_c(url), _SCHEME + r"[^/?#]*([^?#]*)", 1)


def url_query(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def query_value(url, name: str) -> Column:
    """First non-blank value of a query parameter, percent-decoded (raw text if undecodable)."""
    raw = F.regexp_extract(url_query(url), r"(?:^|&)" + name + r"=([^&]+)", 1)
    dec = F.coalesce(F.try_url_decode(raw), raw)
    return F.when(raw != "", dec)


def _strip_slashes(path) -> Column:
    return F.regexp_replace(path, r"^/+|/+$", "")


def path_name(path) -> Column:
    """Last path component; empty and ``.`` components do not count (``a/b/``, ``a/.`` -> ``b``, ``a``)."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: (p != "") & (p != "."))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def path_stem(path) -> Column:
    """Last component without its last suffix; a leading dot is not a suffix."""
    name = path_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def sanitise(text, length: int = 32) -> Column:
    return F.substring(F.regexp_replace(_c(text), r"[^a-zA-Z0-9_-]", "_"), 1, length)


def video_id(url) -> Column:
    url = _c(url)
    host = url_host(url)
    parts = F.split(_strip_slashes(url_path(url)), "/")
    v = query_value(url, "v")
    yt = host.contains("youtube.com") | host.contains("youtube-nocookie.com")
    short = host.contains("youtu.be")
    return (
        F.when(yt & v.isNotNull(), F.substring(v, 1, 11))
        .when(yt & (F.size(parts) >= 2), F.substring(F.element_at(parts, -1), 1, 11))
        .when(short, F.substring(_strip_slashes(url_path(url)), 1, 11))
        .otherwise(sanitise(url))
    )


def file_id(source) -> Column:
    """Stable id of one input line (URL or path)."""
    source = _c(source)
    return F.when(is_url(source), video_id(source)).otherwise(path_stem(source))


def upload_id(name) -> Column:
    """Id of an uploaded file name: stem, spaces to ``_``, first 32."""
    return F.substring(F.replace(path_stem(name), F.lit(" "), F.lit("_")), 1, 32)


def artifact_path(root, kind: str, fid, suffix: str) -> Column:
    """``<root>/<kind dir>/<file_id><suffix>`` for kind in raw/audio/annotations/logs."""
    folder = {"raw": S.RAW_DIR, "audio": S.AUDIO_DIR, "annotations": S.ANNOTATIONS_DIR, "logs": S.LOGS_DIR}[kind]
    return F.concat(_c(root), F.lit(f"/{folder}/"), _c(fid), F.lit(suffix))
