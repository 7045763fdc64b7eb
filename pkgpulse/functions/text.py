"""String helpers: input cleansing, number display, badges, JSON results."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings removed from a searched package name, in order.
CLEANSE_REMOVALS = ("'", '"', "\\", ";", "--", "/", "%")

# Badge template parts. The stats site and badge service are
# parameters; the query part of the badge link is the service's JSON API.
# Fixed value: the code-hosting address that marks a repository URL.
REPO_HOST = "github.com/"

BADGE_SERVICE = "https://img.shields.io/badge/dynamic/json"
DEFAULT_SITE = "https://badges.example.org"


def cleanse_name(col: Column | str) -> Column:
    """Trim (Unicode) whitespace, then drop quote, backslash, ``;``, ``--``,
    ``/`` and ``%`` one after another. Order matters: ``-/-`` ends as ``--``."""
    out = F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")
    for token in CLEANSE_REMOVALS:
        out = F.replace(out, F.lit(token), F.lit(""))
    return out


def with_thousands(col: Column | str) -> Column:
    """``1234567`` -> ``'1,234,567'`` (integers)."""
    return F.format_number(_c(col), 0)


def percent_text(col: Column | str) -> Column:
    """``12.5`` -> ``'12.50%'`` (two decimals, as the rounded value prints)."""
    return F.format_string("%.2f%%", _c(col))


def badge_markdown(name: Column | str, site: str = DEFAULT_SITE, service: str = BADGE_SERVICE) -> Column:
    """Markdown for a monthly-downloads badge linking to the package page.

    The badge service gets the (percent-encoded) API address with the name
    appended as given; the link goes to the package page."""
    api = quote(f"{site}/api/v1/monthly_downloads/", safe="")
    return F.concat(
        F.lit(f"[![Downloads]({service}?url={api}"),
        _c(name),
        F.lit("&query=total_requests&suffix=%2Fmonth&label=Downloads)]("),
        F.lit(f"{site}/pkg/"),
        _c(name),
        F.lit(")"),
    )


def canonical_uuid(col: Column | str) -> Column:
    """Registry UUIDs as stored: trimmed, lower-case text."""
    return F.lower(F.trim(_c(col).cast("string")))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_contains(col: Column | str, host: str = REPO_HOST) -> Column:
    """Keep URLs that contain ``host`` (plain substring, case-sensitive)."""
    return _c(col).contains(host)
