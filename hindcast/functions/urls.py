"""URL and path expressions: canonical forms, sanitising, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast import fixed_values as fv

# scheme, user info (up to the last @ of the authority), host, port, path, query, fragment
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_EMBEDDED = r"(?i)https?://[^\s<>\"']+"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def _is_web(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://")


def sanitize_url(url: Column, strict: bool = True) -> Column:
    """Web URL without user info, query and fragment; scheme and host lower-cased.

    ``strict`` blanks other schemes and invalid ports; otherwise other text
    stays as it is and an invalid port is left out.
    """
    port = _part(url, 4)
    valid_port = port.rlike(r"^\d{1,5}$") & (port.try_cast("int") <= 65535)
    host = F.lower(_part(url, 3))
    clean = F.concat(
        F.lower(_part(url, 1)), F.lit("://"), host,
        F.when(valid_port, F.concat(F.lit(":"), port.try_cast("int").cast("string"))).otherwise(""),
        _part(url, 5),
    )
    web = F.coalesce(_is_web(url), F.lit(False))
    if strict:
        return F.when(web & ((port == "") | valid_port), clean).otherwise("")
    return F.when(web, clean).otherwise(url)


def canonical_watch_url(url: Column, video_id: Column) -> Column:
    """Canonical watch URL when ``url`` names exactly ``video_id``, else null."""
    text = F.trim(url)
    host, path, query = F.lower(_part(text, 3)), _part(text, 5), _part(text, 6)
    plain = (_part(text, 1) == "https") & (_part(text, 2) == "") & ~text.contains("#")
    values = F.regexp_extract_all(F.concat(F.lit("&"), query), F.lit(r"&v=([^&]+)"), F.lit(1))
    segments = F.split(F.regexp_replace(path, "/+$", ""), "/")
    found = (
        F.when(
            host.isin(fv.VIDEO_HOSTS),
            F.when(path == "/watch", F.when(F.size(values) == 1, F.get(values, F.lit(0)))).when(
                path.startswith("/shorts/") | path.startswith("/live/"), F.element_at(segments, -1)
            ),
        )
        .when(host == fv.SHORT_VIDEO_HOST, F.get(F.split(F.regexp_replace(path, "^/+", ""), "/"), F.lit(0)))
    )
    safe = video_id.rlike(f"^(?:{fv.VIDEO_ID_PATTERN})$")
    return F.when(plain & safe & (found == video_id), F.concat(F.lit(fv.WATCH_PREFIX), video_id))


def canonical_channel_url(url: Column) -> Column:
    """Canonical channel URL for the supported path forms, else null."""
    text = F.trim(url)
    host = F.lower(_part(text, 3))
    path = F.regexp_replace(_part(text, 5), "/+$", "")
    path = F.when(path.endswith("/videos"), F.regexp_replace(path, "/videos$", "")).otherwise(path)
    path = F.regexp_replace(path, "/+$", "")
    plain = (
        (_part(text, 1) == "https") & host.isin(fv.VIDEO_HOSTS) & (_part(text, 2) == "") & (_part(text, 6) == "")
        & (_part(text, 7) == "")
    )
    identifier = F.regexp_extract(path, r"^/(?:@|channel/|c/|user/)([^/\s\x00-\x1f]{1,128})$", 1)
    return F.when(plain & (identifier != ""), F.concat(F.lit(fv.CHANNEL_PREFIX), path))


def redact_text(value: Column, workspace: str | None = None, home: str | None = None) -> Column:
    """Embedded web URLs lose user info and query; local paths are masked.

    The text is cut at its URLs and re-assembled, so every URL is rewritten
    without a per-row function.
    """
    pieces = F.split(value, _EMBEDDED, -1)
    urls = F.regexp_extract_all(value, F.lit(_EMBEDDED), F.lit(0))
    rebuilt = F.array_join(
        F.zip_with(pieces, urls, lambda p, u: F.concat(p, F.coalesce(sanitize_url(u, strict=False), F.lit("")))), ""
    )
    text = F.when(value.rlike(r"(?i)https?://"), rebuilt).otherwise(value)
    for folder, mask in ((workspace, "<workspace>"), (home, "<home>")):
        if folder:
            text = F.replace(text, F.lit(folder.rstrip("/")), F.lit(mask))
    last = lambda v: F.regexp_extract(v, r"([^/]*)/*$", 1)
    masked = (
        F.when(text.rlike("(?i)^file://"), "<local-file>")
        .when(
            text.startswith("/"),
            F.when(last(text) == "", "<local-path>").otherwise(F.concat(F.lit("<local-path>/"), last(text))),
        )
        .when(text.rlike(r"^[A-Za-z]:[\\/]"), F.concat(F.lit("<local-path>/"), last(F.translate(text, "\\", "/"))))
        .otherwise(text)
    )
    return F.when(_is_web(value), sanitize_url(value, strict=False)).otherwise(masked)
