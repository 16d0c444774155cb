"""Problem 1 against a plain reader of the standard library, and its edge cases."""

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pluvion.operators import stamps
from pluvion.session import table

SCHEMA = "ingest_order bigint, station_id string, timestamp_utc string, inserted_ts string, t_ms string"
CLOCKS = [("a", "Europe/Madrid", "UTC", "dmy"), ("b", "America/New_York", "Europe/Madrid", "mdy"), ("c", "Nowhere/Land", None, None)]


def one(spark, rows, clocks=CLOCKS):
    ck = spark.createDataFrame(clocks, "station_id string, clock_zone string, relay_zone string, date_order string")
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], SCHEMA)
    return [(r["t_ms"], r["n_ms"]) for r in stamps.normalise_stamps(df, ck).orderBy("ingest_order").collect()]


def ms(*a, tz=UTC):
    return round(datetime(*a, tzinfo=tz).timestamp() * 1000)


def test_notations(spark):
    want = ms(2025, 10, 10, 1, 2, 3)
    texts = ["2025-10-10T01:02:03Z", "2025-10-10T03:02:03+02:00", "2025-10-10 03:02:03.000000+0200", " 2025-10-10 01:02:03,000 UTC ", "1760058123", "1760058123000", "1760058123000000", "2025-283T01:02:03Z", "Fri, 10 Oct 2025 03:02:03 +0200", "20251010T010203Z", "2025-10-10T03:02:03", "10 Oct 2025 03:02:03 CEST", "10-oct-2025 03.02.03", "2025-10-10T01:02:03+00", "10-10-25 03:02:03", "10/10/2025 3:02:03 AM", "2025/10/10 03:02:03"]
    assert dict(zip(texts, (r[0] for r in one(spark, [("a", text, None) for text in texts])))) == dict.fromkeys(texts, want)
    assert one(spark, [("a", "11/10/2025 02:00", None), ("b", "10/11/2025 02:00 PM", None)]) == [(ms(2025, 10, 11), None), (ms(2025, 10, 11, 18), None)]


UNREADABLE = [None, "", "n/a", "None", "--", "25:61", "2025-10-2x 11:00", "2025-02-30T10:00:00Z", "2024-13-07 11:20:00", "0000-00-00 00:00:00", "31/06/2024 07:15:00", "2025-366T00:00:00Z", "2025-10-10T24:00:00Z", "2025-10-10T10:60:00Z", "10/10/2025 13:00 PM", "10 Oct 2025 02:00:00 XYZ", "\u0001", "9" * 5000]


def test_unreadable(spark):
    assert one(spark, [("a", text, None) for text in UNREADABLE]) == [(None, None)] * len(UNREADABLE)


def test_clock_changes(spark):
    # 26 October 2025 02:30 in Madrid happened twice; 30 March 02:30 never
    rows = [("a", "2025-10-26 02:30:00", "2025-10-26T00:31:00Z"), ("a", "2025-10-26 02:30:00", "2025-10-26T01:31:00Z"), ("a", "2025-10-26 02:30:00", None), ("a", "2025-03-30 02:30:00", None), ("a", "2025-10-26 02:30:00", "2025-10-26T00:29:00Z"), ("b", "2025-11-02 01:30:00", "2025-11-02T06:40:00Z")]
    got = [r[0] for r in one(spark, rows)]
    assert got == [ms(2025, 10, 26, 0, 30), ms(2025, 10, 26, 1, 30), ms(2025, 10, 26, 0, 30), None, ms(2025, 10, 26, 0, 30), ms(2025, 11, 2, 6, 30)]


def test_unknown_station_zone_and_order(spark):
    rows = [("zz", "2025-10-10 01:00:00", "2025-10-10T01:00:00Z"), ("c", "2025-10-10 01:00:00", "10/10/2025 01:00"), (None, "2025-10-10T01:00:00Z", None)]
    assert one(spark, rows) == [(None, ms(2025, 10, 10, 1)), (None, None), (ms(2025, 10, 10, 1), None)]
    assert one(spark, [("a", "1760058123", None)] * 3, CLOCKS * 2) == [(1760058123000, None)] * 3  # clocks twice, rows thrice
    assert one(spark, []) == []


def plain(text, zone, order):
    """Candidates by the standard library, for the notations of the data."""
    if text is None:
        return []
    s = text.strip()
    if re.fullmatch(r"\d{10}|\d{13}", s):
        return [int(s) * (1000 if len(s) == 10 else 1)]
    s = s.replace(",", ".") if re.match(r"\d{4}-", s) else s
    zones = {"UTC": 0, "Z": 0, "CET": 60, "CEST": 120, "WET": 0, "WEST": 60, "EST": -300, "EDT": -240}
    m = re.search(r"\s*(Z|[A-Z]{3,4}|[+-]\d\d:?(?:\d\d)?)$", s) if not s.endswith(("AM", "PM")) else None
    off = None
    if m and not re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d-\d\d-\d\d", s) and (m[1] in zones or re.search(r"\d\d:?\d\d(:?\d\d)?(\.\d+)?\s*[+-]", s)):
        d = m[1]
        off = zones[d] if d in zones else (1 if d[0] == "+" else -1) * (int(d[1:3]) * 60 + int(d[3:].strip(":") or 0))
        s = s[: m.start()]
    day = "%d/%m" if order == "dmy" else "%m/%d"
    for f in ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%jT%H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S", "%d %b %Y %H:%M:%S", "%d-%b-%Y %H.%M.%S", f"{day}/%Y %H:%M", f"{day}/%Y %H:%M:%S", f"{day}/%Y %I:%M:%S %p", f"{day.replace('/', '-')}-%y %H:%M:%S"]:
        try:
            t = datetime.strptime(s, f)
            break
        except ValueError:
            continue
    else:
        return []
    if off is not None:
        return [round((t - timedelta(minutes=off)).replace(tzinfo=UTC).timestamp() * 1000)]
    out = set()
    for fold in (0, 1):
        u = t.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC)
        if u.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t:
            out.add(round(u.timestamp() * 1000))
    return sorted(out)


def test_against_plain_reader(spark, sf):
    raw, ck = table(spark, sf, "raw_window"), table(spark, sf, "station_clocks")
    clocks = {r["station_id"]: r for r in ck.collect()}
    got = {r["ingest_order"]: (r["t_ms"], r["n_ms"]) for r in stamps.normalise_stamps(raw, ck).collect()}
    for r in raw.collect():
        c = clocks[r["station_id"]]
        a, b = plain(r["timestamp_utc"], c["clock_zone"], c["date_order"]), plain(r["inserted_ts"], c["relay_zone"], c["date_order"])
        pairs = sorted(((n < t, abs(n - t), t, n) for t in a for n in b))
        want = (pairs[0][2], pairs[0][3]) if pairs else (a[0] if a else None, b[0] if b else None)
        assert got[r["ingest_order"]] == want, r


def test_found_leaves_out_exact_text(spark):
    df = spark.createDataFrame([(1, "a", "2025-10-10T01:02:03Z", "x"), (2, "a", "2025-10-10T01:02:03.000Z", "1760058123")], "ingest_order bigint, station_id string, timestamp_utc string, inserted_ts string")
    ck = spark.createDataFrame(CLOCKS, "station_id string, clock_zone string, relay_zone string, date_order string")
    assert sorted(map(tuple, stamps.found_stamps(df, ck).collect())) == [(2, "inserted_ts", 1760058123000), (2, "timestamp_utc", 1760058123000)]
