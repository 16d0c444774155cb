"""DuckDB SQL that reads the stamps of raw_window another way: by formats and the zones' own conversions."""

from __future__ import annotations

_ORDERLESS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M", "%Y-%jT%H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y%m%dT%H%M%S", "%d %b %Y %H:%M:%S", "%d-%b-%Y %H.%M.%S"]
_NUMERIC = ["{a}/{b}/%Y %H:%M", "{a}/{b}/%Y %H:%M:%S", "{a}/{b}/%Y %I:%M:%S %p", "{a}-{b}-%y %H:%M:%S"]

# Minutes east of UTC.
_EAST = {"UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def _formats(a: str, b: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in [*(f.format(a=a, b=b) for f in _NUMERIC), *_ORDERLESS]) + "]"


def _offset(day: int) -> str:
    """Milliseconds by which the zone is ahead of UTC a day before (-1) or after (1) a clock time."""
    at = f"loc + INTERVAL ({day}) DAY"
    return f"epoch_ms({at}) - epoch_ms(timezone(zone, {at}))"


def _instant(offset: str) -> str:
    """The clock time less an offset, if the zone's clock shows that time then."""
    u = f"epoch_ms(loc) - {offset}"
    return f"CASE WHEN epoch_ms(timezone(zone, make_timestamptz(({u}) * 1000))) = epoch_ms(loc) THEN {u} END"


#: (ingest_order, station_id, s0, s1, t_ms, n_ms): both stamps as instants; the stamps' notations in this project's data.
STAMPS = f"""
sx AS (SELECT ingest_order, station_id, unnest([0, 1]) AS k, trim(unnest([timestamp_utc, inserted_ts]), ' \n\t') AS s, unnest(['clock', 'relay']) AS side FROM raw_window),
sz AS (SELECT sx.*, CASE WHEN side = 'clock' THEN clock_zone ELSE relay_zone END AS zone, date_order,
  regexp_extract(s, '[0-9 ](Z|{"|".join(_EAST)}|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$', 1) AS z FROM sx LEFT JOIN station_clocks USING (station_id)),
sb AS (SELECT *, replace(replace(replace(replace(replace(replace(trim(regexp_replace(left(s, length(s) - length(z)), '^[A-Za-z]{{3}}, ', '')), ',', '.'), '-ene-', '-jan-'), '-abr-', '-apr-'), '-ago-', '-aug-'), '-dic-', '-dec-'), '-sept-', '-sep-') AS body FROM sz),
sl AS (SELECT *, CASE WHEN regexp_full_match(s, '[0-9]{{10}}') THEN make_timestamp(CAST(s AS BIGINT) * 1000000) WHEN regexp_full_match(s, '[0-9]{{13}}') THEN make_timestamp(CAST(s AS BIGINT) * 1000)
  WHEN date_order = 'mdy' THEN try_strptime(body, {_formats('%m', '%d')}) ELSE try_strptime(body, {_formats('%d', '%m')}) END AS whole FROM sb),
sm AS (SELECT *, date_trunc('millisecond', whole) AS loc, regexp_full_match(s, '[0-9]{{10}}|[0-9]{{13}}') OR z <> '' AS zoned,
  CASE WHEN z LIKE '+%' OR z LIKE '-%' THEN CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END * (CAST(substr(z, 2, 2) AS BIGINT) * 60 + coalesce(TRY_CAST(right(replace(z, ':', ''), 2) AS BIGINT) * CASE WHEN length(z) > 3 THEN 1 ELSE 0 END, 0)) {' '.join(f"WHEN z = '{k}' THEN {v}" for k, v in _EAST.items())} ELSE 0 END AS east FROM sl),
so AS (SELECT *, CASE WHEN NOT zoned THEN {_offset(-1)} END AS o1, CASE WHEN NOT zoned THEN {_offset(1)} END AS o2 FROM sm),
sc AS (SELECT *, CASE WHEN zoned THEN epoch_ms(loc) - east * 60000 ELSE {_instant('o1')} END AS c1, CASE WHEN NOT zoned AND o2 <> o1 THEN {_instant('o2')} END AS c2 FROM so),
sp AS (SELECT ingest_order, any_value(station_id) AS station_id, max(s) FILTER (WHERE k = 0) AS s0, max(s) FILTER (WHERE k = 1) AS s1, list_filter(list_sort([max(c1) FILTER (WHERE k = 0), max(c2) FILTER (WHERE k = 0)]), lambda x: x IS NOT NULL) AS ts, list_filter(list_sort([max(c1) FILTER (WHERE k = 1), max(c2) FILTER (WHERE k = 1)]), lambda x: x IS NOT NULL) AS ns FROM sc GROUP BY ingest_order),
sq_ AS (SELECT *, list_min(flatten(list_transform(ts, lambda a: list_transform(ns, lambda b: (b < a, abs(b - a), a, b))))) AS best FROM sp),
st_ AS (SELECT ingest_order, station_id, s0, s1, coalesce(best[3], ts[1]) AS t_ms, coalesce(best[4], ns[1]) AS n_ms FROM sq_)"""
EXACT = "'[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z'"

HOURS = STAMPS + """,
hr AS (SELECT s.station_id, s.t_ms, n_ms, ingest_order, precip_raw_mm AS v, t_ms // 3600000 * 60 AS start FROM st_ s JOIN raw_window USING (ingest_order) WHERE s.station_id IS NOT NULL AND t_ms IS NOT NULL AND n_ms IS NOT NULL AND precip_raw_mm IS NOT NULL),
hc AS (SELECT *, cut FROM hr, (SELECT unnest([10, 1440]) AS cut) WHERE n_ms <= (start + 60 + cut) * 60000),
hl AS (SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY station_id, t_ms, cut ORDER BY n_ms DESC, ingest_order DESC) = 1),
hs AS (SELECT station_id, start, cut, count(*) AS readings, sum(v) AS mm FROM hl GROUP BY ALL)"""

ORACLES = {
    "p1_instants": f"WITH {STAMPS} SELECT ingest_order, t_ms AS taken_ms, n_ms AS arrived_ms FROM st_",
    "p1_found": f"""WITH {STAMPS} SELECT ingest_order, 'timestamp_utc' AS field, t_ms AS utc_ms FROM st_ JOIN raw_window r USING (ingest_order) WHERE t_ms IS NOT NULL AND NOT regexp_full_match(r.timestamp_utc, {EXACT})
UNION ALL SELECT ingest_order, 'inserted_ts', n_ms FROM st_ JOIN raw_window r USING (ingest_order) WHERE n_ms IS NOT NULL AND NOT regexp_full_match(r.inserted_ts, {EXACT})""",
    "p2_hourly_rain": f"WITH {HOURS} SELECT station_id, start AS period_start_min, readings, round(mm, 4) AS rain_mm FROM hs WHERE cut = 1440",
    "p2_found": f"WITH {HOURS} SELECT station_id, start AS period_start_min FROM hs GROUP BY ALL HAVING coalesce(max(readings) FILTER (WHERE cut = 10), 0) <> coalesce(max(readings) FILTER (WHERE cut = 1440), 0) OR round(abs(coalesce(max(mm) FILTER (WHERE cut = 10), 0) - coalesce(max(mm) FILTER (WHERE cut = 1440), 0)), 6) > 0.05::DOUBLE",
    "p3_found": f"""WITH {STAMPS},
rd AS (SELECT DISTINCT s.station_id, CAST(floor(t_ms / 1800000) AS BIGINT) * 30 AS slot FROM st_ s JOIN raw_window USING (ingest_order) WHERE s.station_id IS NOT NULL AND t_ms IS NOT NULL AND precip_raw_mm IS NOT NULL),
dy AS (SELECT DISTINCT station_id, CAST(floor(slot / 1440) AS BIGINT) AS day FROM rd)
SELECT station_id, day * 1440 + k AS slot_start_min FROM dy, (SELECT unnest(range(0, 1440, 30)) AS k) EXCEPT SELECT station_id, slot FROM rd""",
}
