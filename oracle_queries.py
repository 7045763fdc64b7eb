"""DuckDB oracle SQL for every registered query.

Each statement starts from the raw test tables (pre-registered views) with
the fixture views of FIXTURES.md inlined as CTEs, then states the report in
plain SQL, independently of the Spark builders. Sums are cast to BIGINT
(DuckDB sums integers to HUGEINT); ratios are DOUBLE on both sides.
"""

from __future__ import annotations

FIXTURE_CTES = """
raw_requests AS (
SELECT concat('uuid-', user_id % 12) AS package_uuid,
       CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status,
       CASE event_type WHEN 'view' THEN 'user' WHEN 'signup' THEN 'user'
                       WHEN 'click' THEN 'ci' WHEN 'error' THEN 'user' END AS client_type,
       r.r_name AS region,
       CAST(ts AS DATE) AS date,
       concat('1.', 9 + event_id % 3, '.', event_id % 2) AS version_full,
       CASE event_id % 6 WHEN 0 THEN 'x86_64-linux-gnu' WHEN 1 THEN 'aarch64-apple-darwin14'
                         WHEN 2 THEN 'x86_64-w64-mingw32' WHEN 3 THEN 'x86_64-unknown-freebsd11'
                         WHEN 4 THEN 'x86_64-linux-musl' ELSE 'wasm32-emscripten-x' END AS system_full
FROM events JOIN region r ON r.r_regionkey = user_id % 5
),
packages AS (
SELECT DISTINCT CAST(user_id % 12 + 1 AS INT) AS package_id,
       concat('uuid-', user_id % 12) AS package_uuid,
       CASE user_id % 12 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'alpha' WHEN 3 THEN 'Three_jll'
                         WHEN 7 THEN 'Sevenjll' ELSE concat('Pkg', user_id % 12) END AS package_name
FROM events WHERE user_id % 12 < 11
),
client_types AS (
SELECT * FROM (VALUES ('user', 1), ('ci', 2), ('missing', 3)) t(client_type, client_type_id)
),
requests_by_date AS (
SELECT p.package_id, c.client_type_id, r.date, r.request_count
FROM (SELECT package_uuid, coalesce(client_type, 'missing') AS client_type, date,
             count(*) AS request_count
      FROM raw_requests WHERE status < 400 GROUP BY 1, 2, 3) r
JOIN packages p ON r.package_uuid = p.package_uuid
JOIN client_types c ON r.client_type = c.client_type
),
requests_by_region_date AS (
SELECT p.package_id, c.client_type_id, r.region, r.date, r.request_count
FROM (SELECT package_uuid, coalesce(client_type, 'missing') AS client_type, region, date,
             count(*) AS request_count
      FROM raw_requests WHERE status < 400 GROUP BY 1, 2, 3, 4) r
JOIN packages p ON r.package_uuid = p.package_uuid
JOIN client_types c ON r.client_type = c.client_type
),
requests_total AS (
SELECT package_id, client_type_id, CAST(sum(request_count) AS BIGINT) AS request_count
FROM requests_by_date GROUP BY 1, 2
),
systems_by_date AS (
SELECT concat(split_part(system_full, '-', 1), '-', split_part(system_full, '-', 2)) AS system,
       c.client_type_id, r.date, count(*) AS request_count
FROM raw_requests r JOIN client_types c ON r.client_type = c.client_type
GROUP BY 1, 2, 3
),
versions_by_date AS (
SELECT concat(split_part(version_full, '.', 1), '.', split_part(version_full, '.', 2)) AS version,
       c.client_type_id, r.date, count(*) AS request_count
FROM raw_requests r JOIN client_types c ON r.client_type = c.client_type
GROUP BY 1, 2, 3
)
"""


def _q(*ctes: str, body: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {FIXTURE_CTES.strip()}{extra}\n{body}"


def _asof(table: str) -> str:
    return f"(SELECT max(date) FROM {table})"


def _ct(ids=(1,)) -> str:
    ids = tuple(ids) or (4,)
    return f"client_type_id IN ({', '.join(str(i) for i in ids)})"




def _window(table: str, interval: str) -> str:
    return f"date > {_asof(table)} - INTERVAL '{interval}'"


def _top(interval: str) -> str:
    return _q(
        body=f"""
SELECT p.package_name, CAST(sum(b.request_count) AS BIGINT) AS total_requests,
       format('{{:,}}', CAST(sum(b.request_count) AS BIGINT)) AS total_requests_fmt
FROM requests_by_date b JOIN packages p ON b.package_id = p.package_id
WHERE b.{_window('requests_by_date', interval)} AND b.{_ct()}
GROUP BY p.package_name
ORDER BY total_requests DESC, package_name
LIMIT 100"""
    )


def _totals_by_toggles() -> str:
    """One scan of the month, summed per choice of client types."""
    choices = ["", "1", "2", "3", "1,2", "1,3", "2,3", "1,2,3"]
    rows = ", ".join(f"('{c}')" for c in choices)
    return _q(
        body=f"""
SELECT c.chosen, CAST(coalesce(sum(b.request_count), 0) AS BIGINT) AS total_requests
FROM (VALUES {rows}) c(chosen)
LEFT JOIN requests_by_date b ON list_contains(string_split(c.chosen, ','), CAST(b.client_type_id AS VARCHAR))
  AND b.{_window('requests_by_date', '30 day')}
GROUP BY c.chosen"""
    )


def _trending(ids=(1,)) -> str:
    """From the meaning of the report: give every qualifying row its age in
    days, and per package compare the ages 0..14 with the ages 14..27."""
    m = _asof("requests_by_date")
    allowed = ", ".join(str(i) for i in ids)
    return _q(
        f"aged AS (SELECT package_id, request_count AS n, date_diff('day', date, {m}) AS age FROM requests_by_date"
        f" WHERE request_count > 5 AND client_type_id IN ({allowed}))",
        """per_name AS (
  SELECT package_name,
         coalesce(sum(n) FILTER (age <= 14), 0) AS now_n, count(*) FILTER (age <= 14) AS now_rows,
         coalesce(sum(n) FILTER (age >= 14), 0) AS then_n, count(*) FILTER (age >= 14) AS then_rows
  FROM aged, packages
  WHERE age BETWEEN 0 AND 27 AND aged.package_id = packages.package_id
    AND NOT regexp_matches(package_name, '.jll$')
  GROUP BY package_name
)""",
        """growth AS (
  SELECT package_name, (20000 * (now_n - then_n) + then_n) // (2 * then_n) / 100.0::DOUBLE AS percent_change
  FROM per_name WHERE least(now_rows, then_rows) > 12 AND now_n > then_n AND then_n > 0
)""",
        body="""
SELECT package_name, percent_change, printf('%.2f%%', percent_change) AS percent_change_fmt
FROM growth ORDER BY percent_change DESC, package_name LIMIT 10""",
    )


def _requests_by_sql(table: str, cols: list[str], interval: str = "30 day", ids=(1,)) -> str:
    c = ", ".join(cols)
    return f"""
SELECT {c}, CAST(sum(request_count) AS BIGINT) AS total_requests
FROM {table}
WHERE {_window(table, interval)} AND {_ct(ids)}
GROUP BY {c}"""


def _requests_by(table: str, cols: list[str], interval: str = "30 day", ids=(1,)) -> str:
    return _q(body=_requests_by_sql(table, cols, interval, ids))


def _share_sql(series: str, parts: str = "date") -> str:
    return f"""
SELECT {parts}, {series}, total_requests,
       CAST(sum(total_requests) OVER (PARTITION BY {parts}) AS BIGINT) AS total_requests_day,
       total_requests / sum(total_requests) OVER (PARTITION BY {parts}) AS proportion
FROM t"""


def _share(table: str, series: str, interval: str = "30 day") -> str:
    return _q(f"t AS ({_requests_by_sql(table, [series, 'date'], interval)})", body=_share_sql(series))


# Arch / OS classification in SQL, stated from the same triplet grammar.
_ARCH = [
    ("x86_64", r"(x86_|amd)64"),
    ("i686", r"i\d86"),
    ("aarch64", r"(aarch64|arm64)"),
    ("armv7l", r"arm(v7l)?"),
    ("armv6l", r"armv6l"),
    ("powerpc64le", r"p(ower)?pc64le"),
]
_OS = [
    ("macos", r"-apple-darwin[\d.]*"),
    ("freebsd", r"-(.*-)?freebsd[\d.]*"),
    ("windows", r"-w64-mingw32"),
    ("linux", r"-(.*-)?linux"),
]
_TAIL = r"(-gnu|-musl)?(eabihf|eabi)?"


def system_sql(col: str, mode: str) -> str:
    canon = (
        f"replace(replace(replace({col}, 'unknown', 'freebsd'), '-apple', '-apple-darwin'),"
        " '-w64', '-w64-mingw32')"
    )
    first = f"split_part({canon}, '-', 1)"
    rest = f"substr({canon}, length({first}) + 1)"
    arch = "CASE " + " ".join(f"WHEN regexp_full_match({first}, '{p}') THEN '{n}'" for n, p in _ARCH) + " END"
    os_ = (
        "CASE "
        + " ".join(f"WHEN regexp_full_match({rest}, '(?:{p}){_TAIL}') THEN '{n}'" for n, p in _OS)
        + " END"
    )
    parsed = f"(({arch}) IS NOT NULL AND ({os_}) IS NOT NULL)"
    a = f"CASE WHEN {parsed} THEN {arch} ELSE split_part({canon}, '-', 1) END"
    o = f"CASE WHEN {parsed} THEN {os_} ELSE split_part({canon}, '-', 2) END"
    return {"Full": f"concat({a}, '-', {o})", "CPU Arch": a, "OS": o}[mode]


def _systems_sql(mode: str) -> str:
    return f"""
SELECT {system_sql('system', mode)} AS selected_system, date,
       CAST(sum(request_count) AS BIGINT) AS total_requests
FROM systems_by_date
WHERE {_window('systems_by_date', '30 day')} AND {_ct()}
GROUP BY 1, 2"""


_KPIS = (
    ("past_day_requests", "1 day"),
    ("past_week_requests", "7 day"),
    ("selected_timeframe_requests", "30 day"),
)


def _kpi_sums(prefix: str = "") -> str:
    m = _asof("requests_by_date")
    return ",\n       ".join(
        f"CAST(coalesce(sum(CASE WHEN {prefix}date > {m} - INTERVAL '{interval}'"
        f" THEN {prefix}request_count END), 0) AS BIGINT) AS {name}"
        for name, interval in _KPIS
    )


def _kpi_fmt(src: str) -> str:
    fmts = ", ".join(f"format('{{:,}}', {c}) AS {c}_fmt" for c, _ in _KPIS)
    return f"SELECT *, {fmts} FROM ({src}) k"


_PKG_KEYS = "(SELECT DISTINCT lower(package_name) AS package_key FROM packages)"


def _kpis_all() -> str:
    src = f"""SELECT {_kpi_sums()}
FROM requests_by_date WHERE {_window('requests_by_date', '30 day')} AND {_ct()}"""
    return _q(body=_kpi_fmt(src))


def _kpis_by_package() -> str:
    inner = f"""SELECT lower(p.package_name) AS package_key, {_kpi_sums('b.')}
FROM requests_by_date b JOIN packages p ON b.package_id = p.package_id
WHERE b.{_window('requests_by_date', '30 day')} AND b.{_ct()}
GROUP BY 1"""
    cols = ",\n       ".join(f"CAST(coalesce(a.{c}, 0) AS BIGINT) AS {c}" for c, _ in _KPIS)
    src = f"""SELECT k.package_key,
       {cols}
FROM {_PKG_KEYS} k LEFT JOIN ({inner}) a ON k.package_key = a.package_key"""
    return _q(body=_kpi_fmt(src))


def _package_by(table: str, cols: list[str], name: str | None = None) -> str:
    c = ", ".join(f"b.{x}" for x in cols)
    key = "" if name is not None else "lower(p.package_name) AS package_key, "
    where = f" AND lower(p.package_name) = lower('{name}')" if name is not None else ""
    n = len(cols) + (0 if name is not None else 1)
    return f"""
SELECT {key}{c}, CAST(sum(b.request_count) AS BIGINT) AS total_requests
FROM {table} b JOIN packages p ON b.package_id = p.package_id
WHERE b.{_window(table, '30 day')} AND b.{_ct()}{where}
GROUP BY {', '.join(str(i + 1) for i in range(n))}"""


_SUMMARY = f"""
SELECT package_id, client_type_id, CAST(sum(request_count) AS BIGINT) AS total_requests
FROM requests_by_date
WHERE {_window('requests_by_date', '1 month')}
GROUP BY 1, 2"""

# Requested names: every registered name upper-cased (case-insensitive hits,
# 'ALPHA' naming two packages) and 'Pkg0'..'Pkg13' (hits and misses).
_LOOKUPS = """
SELECT DISTINCT upper(package_name) AS package_name FROM packages
UNION
SELECT DISTINCT concat('Pkg', user_id % 14) FROM events"""


def _lookup(table: str, count_col: str) -> str:
    per_key = f"""
SELECT lower(p.package_name) AS package_key,
       CAST(arg_min(s.{count_col}, s.package_id) AS BIGINT) AS total_requests
FROM {table} s JOIN packages p ON s.package_id = p.package_id
WHERE s.client_type_id = 1
GROUP BY 1"""
    missing = "CAST(to_json({'package_name': a.package_name, 'total_requests': 0}) AS VARCHAR)"
    hit = "s.package_key IS NOT NULL"
    return _q(
        f"summary_t AS ({_SUMMARY})",
        f"per_key AS ({per_key})",
        f"asked AS ({_LOOKUPS})",
        body=f"""
SELECT a.package_name, {hit} AS found,
       CAST(coalesce(s.total_requests, 0) AS BIGINT) AS total_requests,
       CASE WHEN {hit} THEN CAST(to_json({{'total_requests': format('{{:,}}', s.total_requests)}}) AS VARCHAR)
            ELSE {missing} END AS json_v1,
       CASE WHEN {hit} THEN CAST(to_json({{'total_requests': s.total_requests}}) AS VARCHAR)
            ELSE {missing} END AS json_v2
FROM asked a LEFT JOIN per_key s ON lower(a.package_name) = s.package_key""",
    )


# table -> columns, column limits, unique keys, (column, dimension) references
_PACKAGE, _CLIENT = ("package_id", "packages"), ("client_type_id", "client_types")
QUALITY_TABLES = {
    "packages": (
        ["package_id", "package_uuid", "package_name"],
        {"package_uuid": 36, "package_name": 100},
        ["package_id", "package_uuid"],
        [],
    ),
    "requests_by_date": (
        ["package_id", "client_type_id", "date", "request_count"],
        {},
        ["package_id,client_type_id,date"],
        [_PACKAGE, _CLIENT],
    ),
    "requests_by_region_date": (
        ["package_id", "client_type_id", "region", "date", "request_count"],
        {"region": 10},
        ["package_id,client_type_id,region,date"],
        [_PACKAGE, _CLIENT],
    ),
    "systems_by_date": (
        ["system", "client_type_id", "date", "request_count"],
        {"system": 17},
        ["system,client_type_id,date"],
        [_CLIENT],
    ),
    "versions_by_date": (
        ["version", "client_type_id", "date", "request_count"],
        {"version": 4},
        ["version,client_type_id,date"],
        [_CLIENT],
    ),
    "requests_total": (
        ["package_id", "client_type_id", "request_count"],
        {},
        ["package_id,client_type_id"],
        [_PACKAGE, _CLIENT],
    ),
}


def _quality() -> str:
    """DQ checks stated in SQL, from the limits and keys above."""
    parts = []
    for name, (columns, limits, keys, references) in QUALITY_TABLES.items():
        for c in columns:
            parts.append(
                f"SELECT '{name}' AS table_name, 'not_null' AS check_name, '{c}' AS column_name,"
                f" CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS violations FROM {name}"
            )
        for c, n in limits.items():
            parts.append(
                f"SELECT '{name}', 'max_length', '{c}',"
                f" CAST(count(*) FILTER (WHERE length({c}) > {n}) AS BIGINT) FROM {name}"
            )
        for k in keys:
            parts.append(
                f"SELECT '{name}', 'unique', '{k}', CAST(count(*) AS BIGINT)"
                f" FROM (SELECT {k} FROM {name} GROUP BY {k} HAVING count(*) > 1) d"
            )
        for c, dim in references:
            parts.append(
                f"SELECT '{name}', 'foreign_key', '{c}', CAST(count(*) AS BIGINT) FROM {name} t"
                f" WHERE NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{c} = t.{c})"
            )
    return _q(body="\nUNION ALL\n".join(parts))


_SYSTEMS_FEED = """
SELECT system_full AS julia_system, client_type, date, count(*) AS request_count
FROM raw_requests GROUP BY 1, 2, 3"""

_KEEP_LAST = """
SELECT system, client_type_id, date, arg_max(request_count, julia_system) AS request_count
FROM (SELECT concat(split_part(f.julia_system, '-', 1), '-', split_part(f.julia_system, '-', 2)) AS system,
             c.client_type_id, f.date, f.request_count, f.julia_system
      FROM feed f JOIN client_types c ON f.client_type = c.client_type) x
GROUP BY 1, 2, 3"""

_INSERT_ABSENT = """
SELECT package_id, package_uuid, package_name FROM packages
UNION ALL
SELECT CAST((SELECT max(package_id) FROM packages) + row_number() OVER (ORDER BY package_uuid) AS INT),
       package_uuid, package_name
FROM (SELECT package_uuid, arg_min(package_name, rk) AS package_name
      FROM (SELECT package_uuid, upper(package_name) AS package_name, 0 AS rk FROM packages
            UNION ALL
            SELECT DISTINCT package_uuid, concat('Reg', substr(package_uuid, 6)), 1 FROM raw_requests) r
      GROUP BY 1) f
WHERE NOT EXISTS (SELECT 1 FROM packages p WHERE p.package_uuid = f.package_uuid)"""

_UPSERT = """
SELECT * FROM old_t o
WHERE NOT EXISTS (SELECT 1 FROM new_t n WHERE n.package_id = o.package_id
                  AND n.client_type_id = o.client_type_id AND n.date = o.date)
UNION ALL
SELECT * FROM new_t"""

_UPSERT_TOUCHED = """
SELECT * FROM old_t o
WHERE o.date IN (SELECT date FROM new_t)
  AND NOT EXISTS (SELECT 1 FROM new_t n WHERE n.package_id = o.package_id
                  AND n.client_type_id = o.client_type_id AND n.date = o.date)
UNION ALL
SELECT * FROM new_t"""

_SNAPSHOT = """
SELECT p.package_id, c.client_type_id, r.date, r.request_count
FROM (SELECT package_uuid, coalesce(client_type, 'missing') AS client_type, date,
             count(*) AS request_count
      FROM raw_requests WHERE {where} GROUP BY 1, 2, 3) r
JOIN packages p ON r.package_uuid = p.package_uuid
JOIN client_types c ON r.client_type = c.client_type"""

# The earlier load counted failed requests too; the new snapshot is the
# correct trailing two weeks.
_OLD = _SNAPSHOT.format(where="TRUE")
_NEW = _SNAPSHOT.format(
    where="status < 400 AND date > (SELECT max(date) FROM raw_requests) - INTERVAL 14 DAY"
)

_SERIES = f"""
SELECT region, count(*) AS n_points,
       CAST(to_json(list({{'date': date, 'total_requests': total_requests}} ORDER BY date)) AS VARCHAR) AS points_json
FROM ({_requests_by_sql('requests_by_region_date', ['region', 'date'])}) t
GROUP BY region"""


def _cleanse(col: str) -> str:
    out = f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"
    for token in ("''", '"', "\\", ";", "--", "/", "%"):
        out = f"replace({out}, '{token}', '')"
    return out


_BADGE = """
SELECT DISTINCT package_name,
       concat('[![Downloads](https://img.shields.io/badge/dynamic/json?url='
              || 'https%3A%2F%2Fbadges.example.org%2Fapi%2Fv1%2Fmonthly_downloads%2F',
              package_name,
              '&query=total_requests&suffix=%2Fmonth&label=Downloads)](https://badges.example.org/pkg/',
              package_name, ')') AS badge
FROM packages"""

_SYSTEM_LABELS = f"""
SELECT DISTINCT system,
       {system_sql('system', 'Full')} AS full_label,
       {system_sql('system', 'CPU Arch')} AS arch,
       {system_sql('system', 'OS')} AS os
FROM systems_by_date"""


_PACKAGE_SERIES = f"""
SELECT package_key, region, count(*) AS n_points,
       CAST(to_json(list({{'date': date, 'total_requests': total_requests}} ORDER BY date)) AS VARCHAR) AS points_json
FROM ({_package_by('requests_by_region_date', ['region', 'date'])}) t
GROUP BY package_key, region"""


def _update_job() -> str:
    """Both runs of the job at once: a key that the second run's feed holds
    has that feed's count, any other one the first run's."""

    def stored(*keys: str) -> str:
        k = ", ".join(("package_id", "client_type_id", *keys))
        return f"""SELECT {k}, CAST(if(new_n > 0, new_n, old_n) AS BIGINT) AS n
FROM (SELECT {k}, count(*) FILTER (good) AS new_n, count(*) FILTER (early) AS old_n FROM job_log GROUP BY {k}) g
WHERE new_n + old_n > 0"""

    def rows(name: str, source: str, package="package_id", client="client_type_id", label="''", date="''", n="n") -> str:
        return (
            f"SELECT '{name}' AS table_name, {package} AS package_id, {client} AS client_type_id, {label} AS label,"
            f" CAST({date} AS VARCHAR) AS date, CAST({n} AS BIGINT) AS n FROM {source}"
        )

    month = "(SELECT max(date) FROM job_by_date) - INTERVAL 1 MONTH"
    parts = [
        rows("packages", "job_packages", client="0", label="concat(package_uuid, ' ', package_name)", n="0"),
        rows("client_types", "client_types", package="0", label="client_type", n="0"),
        rows("requests_total", f"({stored()}) t"),
        rows("requests_by_date", "job_by_date", date="date"),
        rows("requests_by_region_date", f"({stored('region', 'date')}) t", label="region", date="date"),
        rows("systems_by_date", "systems_by_date", package="0", label="system", date="date", n="request_count"),
        rows("versions_by_date", "versions_by_date", package="0", label="version", date="date", n="request_count"),
        rows(
            "requests_last_month",
            f"(SELECT package_id, client_type_id, sum(n) AS n FROM job_by_date WHERE date > {month} GROUP BY ALL) t",
        ),
    ]
    return _q(
        """job_packages AS (
SELECT CAST(row_number() OVER (ORDER BY package_uuid) AS INT) AS package_id, package_uuid, package_name, true AS at_first
FROM packages
UNION ALL
SELECT CAST((SELECT count(*) FROM packages) + row_number() OVER (ORDER BY package_uuid) AS INT), package_uuid,
       concat('Reg', substr(package_uuid, 6)), false
FROM (SELECT DISTINCT package_uuid FROM raw_requests WHERE package_uuid NOT IN (SELECT package_uuid FROM packages)) r
)""",
        """job_log AS (
SELECT package_id, client_type_id, region, date, status < 400 AS good,
       at_first AND date <= (SELECT max(date) FROM raw_requests) - INTERVAL 10 DAY AS early
FROM raw_requests r JOIN job_packages USING (package_uuid)
JOIN client_types c ON coalesce(r.client_type, 'missing') = c.client_type
)""",
        f"job_by_date AS ({stored('date')})",
        body="\nUNION ALL\n".join(parts),
    )


def _spread(sql: str) -> str:
    """The same statement over the log spread over 150 dates."""
    return sql.replace("CAST(ts AS DATE) AS date", "CAST(ts AS DATE) - CAST(event_id % 5 * 30 AS INT) AS date")


def _windows_sql() -> str:
    windows = {"past_1d": "1 day", "past_7d": "7 day", "past_30d": "30 day", "past_120d": "120 day", "all_time": "100 years"}
    sums = ", ".join(
        f"CAST(coalesce(sum(b.request_count) FILTER (b.{_window('requests_by_date', t)}), 0) AS BIGINT) AS {name}"
        for name, t in windows.items()
    )
    return f"""
SELECT lower(p.package_name) AS package_key, {sums}
FROM packages p LEFT JOIN requests_by_date b ON b.package_id = p.package_id AND b.{_ct()} GROUP BY 1"""


def _spread_sql() -> dict[str, str]:
    """Reports over 150 dates, so that every window leaves rows out."""
    region_date = _package_by("requests_by_region_date", ["region", "date"])
    reports = {
        "spread_totals_30d": _requests_by("requests_by_date", ["date"]),
        "spread_totals_60d": _requests_by("requests_by_date", ["date"], "60 day"),
        "spread_totals_120d": _requests_by("requests_by_date", ["date"], "120 day"),
        "spread_totals_all": _requests_by("requests_by_date", ["date"], "100 years", ids=(1, 2, 3)),
        "spread_version_share": _share("versions_by_date", "version", "60 day"),
        "spread_region_share": _share("requests_by_region_date", "region", "120 day"),
        "spread_systems": _q(body=_systems_sql("Full")),
        "spread_top_month": _top("1 month"),
        "spread_kpis": _kpis_all(),
        "spread_package_by_date": _q(body=_package_by("requests_by_date", ["date"])),
        "spread_package_region_share": _q(f"t AS ({region_date})", body=_share_sql("region", "package_key, date")),
        "spread_summary_last_month": _q(body=_SUMMARY),
        "spread_monthly_downloads": _lookup("summary_t", "total_requests"),
        "summary_incremental": _q(body=_SUMMARY),
        "kpis_by_prefix": _q(body=_windows_sql()),
    }
    return {name: _spread(sql) for name, sql in reports.items()}


#: the systems feed with its row number; the last of a truncated platform's rows counts
_FEED_ORDER = """
SELECT system, c.client_type_id, date, CAST(request_count AS BIGINT) AS request_count
FROM (
  SELECT *, concat(split_part(julia_system, '-', 1), '-', split_part(julia_system, '-', 2)) AS system,
         row_number() OVER (ORDER BY md5(concat_ws('|', julia_system, coalesce(client_type, ''), CAST(date AS VARCHAR)))) AS nth
  FROM feed
) f JOIN client_types c ON f.client_type = c.client_type
QUALIFY row_number() OVER (PARTITION BY system, c.client_type_id, date ORDER BY nth DESC) = 1"""

_REJECTS = """
SELECT 'package_requests_by_date' AS feed,
       CASE event_id % 40 WHEN 1 THEN 'cast:status' WHEN 2 THEN 'null:status' WHEN 3 THEN 'cast:date' ELSE 'range:request_count' END AS reason,
       event_id, concat('uuid-', user_id % 12) AS package_uuid,
       CASE event_id % 40 WHEN 1 THEN 'ok' WHEN 2 THEN NULL ELSE if(event_type = 'error', '500', '200') END AS status,
       if(event_id % 40 = 3, '2024-02-30', CAST(CAST(ts AS DATE) AS VARCHAR)) AS date,
       CASE event_id % 40 WHEN 4 THEN '2147483648' WHEN 5 THEN '-1' ELSE '1' END AS request_count
FROM events JOIN region ON r_regionkey = user_id % 5
WHERE event_id % 40 BETWEEN 1 AND 5"""

#: two loads of the log: keys of either, the second load's counts first
_LOADED = """loaded AS (
SELECT package_id, client_type_id, {key}date, count(*) FILTER (status < 400) AS good,
       count(*) FILTER (date <= (SELECT max(date) FROM raw_requests) - INTERVAL 10 DAY) AS early
FROM raw_requests r JOIN packages USING (package_uuid)
JOIN client_types c ON coalesce(r.client_type, 'missing') = c.client_type GROUP BY ALL
),
kept AS (SELECT * EXCLUDE (good, early), if(good > 0, good, early) AS request_count FROM loaded WHERE good + early > 0)"""

_HISTORY = """
WITH listed AS (
  SELECT DISTINCT CAST(ts AS DATE) AS d, concat('uuid-', user_id % 97) AS package_uuid,
         concat('uuid-', user_id % 97, '-', day(ts) // 11) AS package_name
  FROM events WHERE event_type = 'purchase'
),
days AS (SELECT d, lead(d) OVER (ORDER BY d) AS following, lag(d) OVER (ORDER BY d) AS previous FROM (SELECT DISTINCT d FROM listed)),
-- a row starts a stretch unless the extract before it has the same row
marked AS (
  SELECT l.*, following, b.d IS NULL AS starts
  FROM listed l JOIN days USING (d)
  LEFT JOIN listed b ON b.d = previous AND b.package_uuid = l.package_uuid AND b.package_name = l.package_name
),
stretch AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY package_uuid, package_name ORDER BY d) AS s FROM marked)
SELECT package_uuid, package_name, min(d) AS valid_from, max(d) AS last_listed, arg_max(coalesce(following, DATE '9999-12-31'), d) AS x
FROM stretch GROUP BY package_uuid, package_name, s"""


def oracle_sql() -> dict[str, str]:
    return _spread_sql() | {
        "ingest_total": _q(body="SELECT * FROM requests_total"),
        "ingest_by_date": _q(body="SELECT * FROM requests_by_date"),
        "ingest_by_region_date": _q(body="SELECT * FROM requests_by_region_date"),
        "ingest_systems": _q(body="SELECT * FROM systems_by_date"),
        "ingest_versions": _q(body="SELECT * FROM versions_by_date"),
        "keep_last": _q(f"feed AS ({_SYSTEMS_FEED})", body=_KEEP_LAST),
        "insert_absent": _q(body=_INSERT_ABSENT),
        "upsert_replace": _q(f"old_t AS ({_OLD})", f"new_t AS ({_NEW})", body=_UPSERT),
        "upsert_touched_partitions": _q(f"old_t AS ({_OLD})", f"new_t AS ({_NEW})", body=_UPSERT_TOUCHED),
        "quality_violations": _quality(),
        "top_month": _top("1 month"),
        "top_week": _top("7 day"),
        "top_day": _top("1 day"),
        "trending": _trending(),
        "trending_all_clients": _trending((1, 2, 3)),
        "totals_by_date": _requests_by("requests_by_date", ["date"]),
        "totals_by_toggles": _totals_by_toggles(),
        "totals_all_time": _requests_by("requests_by_date", ["date"], "100 years", ids=(1, 2, 3)),
        "versions_by_date": _requests_by("versions_by_date", ["version", "date"]),
        "version_share": _share("versions_by_date", "version"),
        "regions_by_date": _requests_by("requests_by_region_date", ["region", "date"]),
        "region_share": _share("requests_by_region_date", "region"),
        "systems_full": _q(body=_systems_sql("Full")),
        "systems_arch": _q(body=_systems_sql("CPU Arch")),
        "systems_os": _q(body=_systems_sql("OS")),
        "system_share": _q(f"t AS ({_systems_sql('Full')})", body=_share_sql("selected_system")),
        "system_labels": _q(body=_SYSTEM_LABELS),
        "kpis_all": _kpis_all(),
        "kpis_by_package": _kpis_by_package(),
        "package_by_date": _q(body=_package_by("requests_by_date", ["date"])),
        "package_alpha_by_date": _q(body=_package_by("requests_by_date", ["date"], name="ALPHA")),
        "package_by_region": _q(body=_package_by("requests_by_region_date", ["region", "date"])),
        "package_region_share": _q(
            f"t AS ({_package_by('requests_by_region_date', ['region', 'date'])})",
            body=_share_sql("region", "package_key, date"),
        ),
        "summary_last_month": _q(body=_SUMMARY),
        "monthly_downloads": _lookup("summary_t", "total_requests"),
        "total_downloads": _lookup("requests_total", "request_count"),
        "badge_markdown": _q(body=_BADGE),
        "cleanse_name": f"SELECT page_id, {_cleanse('url')} AS cleansed FROM pages",
        "cleanse_props": f"SELECT event_id, {_cleanse('props')} AS cleansed FROM events",
        "chart_series": _q(body=_SERIES),
        "url_contains": "SELECT page_id, url FROM pages WHERE contains(url, 'example.org/')",
        "package_region_series": _q(body=_PACKAGE_SERIES),
        "update_job": _update_job(),
        "stream_ingest": _q(body="SELECT * FROM requests_by_date"),
        "stream_parts": _q(body="SELECT * FROM requests_by_date"),
        "keep_last_feed_order": _q(f"feed AS ({_SYSTEMS_FEED})", body=_FEED_ORDER),
        "quality_rejects": _REJECTS,
        "ledger_by_date": _q(
            _LOADED.format(key=""),
            body="SELECT date, count(*) AS table_rows, count(*) FILTER (good > 0) AS feed_rows FROM loaded"
            " WHERE good + early > 0 GROUP BY date",
        ),
        "top_month_stored": _q(
            _LOADED.format(key=""),
            body=f"""
SELECT package_name, CAST(sum(request_count) AS BIGINT) AS total_requests,
       format('{{:,}}', CAST(sum(request_count) AS BIGINT)) AS total_requests_fmt
FROM kept JOIN packages USING (package_id) WHERE {_window("kept", "1 month")}
GROUP BY package_name ORDER BY total_requests DESC, package_name LIMIT 100""",
        ),
        "package_alpha_stored": _q(
            _LOADED.format(key="region, "),
            f"t AS ({_package_by('kept', ['region', 'date'], name='ALPHA')})",
            body=_share_sql("region"),
        ),
        "top_page_display": f'SELECT package_name AS "Package Name", total_requests_fmt AS "Total Requests" FROM ({_top("1 month")})',
        "package_name_history": f"SELECT * EXCLUDE (x), nullif(x, DATE '9999-12-31') AS valid_to FROM ({_HISTORY})",
    }
