"""Platform strings: stored prefixes and the arch / OS labels of the reports.

Stored systems keep the first two ``-`` parts of a platform triplet
(``x86_64-linux-gnu`` -> ``x86_64-linux``), versions the first two ``.``
parts (``1.10.4`` -> ``1.10``). For display a stored system is canonicalized
and classified: when the whole string reads as a platform triplet, arch and
OS come from the triplet grammar below (with its aliases); otherwise arch is
the first ``-`` part and OS the second. All of it is built from native
column functions (``rlike``, ``replace``, ``split_part``), no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Textual fixes applied before classification, in this order.
CANONICAL_REPLACEMENTS = (
    ("unknown", "freebsd"),
    ("-apple", "-apple-darwin"),
    ("-w64", "-w64-mingw32"),
)

# Platform triplet grammar (public platform-triplet rules).
# Arch token patterns -> canonical arch name.
ARCH_PATTERNS = (
    ("x86_64", r"(x86_|amd)64"),
    ("i686", r"i\d86"),
    ("aarch64", r"(aarch64|arm64)"),
    ("armv7l", r"arm(v7l)?"),
    ("armv6l", r"armv6l"),
    ("powerpc64le", r"p(ower)?pc64le"),
)
# Rest-of-triplet patterns (starting at the first '-') -> OS name.
OS_PATTERNS = (
    ("macos", r"-apple-darwin[\d.]*"),
    ("freebsd", r"-(.*-)?freebsd[\d.]*"),
    ("windows", r"-w64-mingw32"),
    ("linux", r"-(.*-)?linux"),
)
# Optional tail after the OS: C library, then calling ABI.
TRIPLET_TAIL = r"(-gnu|-musl)?(eabihf|eabi)?"

SYSTEM_MODES = ("Full", "CPU Arch", "OS")


def system_prefix(col: Column | str) -> Column:
    """First two ``-`` parts; a string with fewer parts is kept whole."""
    return F.substring_index(_c(col), "-", 2)


def version_prefix(col: Column | str) -> Column:
    """First two ``.`` parts (``1.10.4`` -> ``1.10``); kept as a string."""
    return F.substring_index(_c(col), ".", 2)


def canonical_system(col: Column | str) -> Column:
    out = _c(col)
    for search, replacement in CANONICAL_REPLACEMENTS:
        out = F.replace(out, F.lit(search), F.lit(replacement))
    return out


def _classify(token: Column, patterns, tail: str = "") -> Column:
    expr = None
    for name, pattern in patterns:
        cond = token.rlike(f"^(?:{pattern}){tail}$")
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def _arch_os(canon: Column) -> tuple[Column, Column]:
    first = F.substring_index(canon, "-", 1)
    rest = F.substr(canon, F.length(first) + 1)
    arch = _classify(first, ARCH_PATTERNS)
    os_ = _classify(rest, OS_PATTERNS, TRIPLET_TAIL)
    parsed = arch.isNotNull() & os_.isNotNull()
    get_arch = F.when(parsed, arch).otherwise(F.split_part(canon, F.lit("-"), F.lit(1)))
    get_os = F.when(parsed, os_).otherwise(F.split_part(canon, F.lit("-"), F.lit(2)))
    return get_arch, get_os


def system_arch(col: Column | str) -> Column:
    return _arch_os(canonical_system(col))[0]


def system_os(col: Column | str) -> Column:
    return _arch_os(canonical_system(col))[1]


def system_label(col: Column | str, mode: str = "Full") -> Column:
    """``Full`` -> ``arch-os``; ``CPU Arch`` -> arch; ``OS`` -> os."""
    arch, os_ = _arch_os(canonical_system(col))
    if mode == "Full":
        return F.concat(arch, F.lit("-"), os_)
    if mode == "CPU Arch":
        return arch
    if mode == "OS":
        return os_
    raise ValueError(f"mode must be one of {SYSTEM_MODES}, got {mode!r}")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
