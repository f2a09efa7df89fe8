import random
from datetime import datetime, timezone

import pytest

from lumenfold.functions.timetext import CONTRADICTS, DMY, MDY, PLAIN, UNLIKELY, instants, interpretations, placed, zone_of
from lumenfold.operators import timeline as TL


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "text, wall, zone",
    [
        ("2020:01:02 03:04:05", us(2020, 1, 2, 3, 4, 5), None),
        ("  2020:01:02 03:04:05 ", us(2020, 1, 2, 3, 4, 5), None),
        ("2020-01-02T03:04:05.123456789Z", us(2020, 1, 2, 3, 4, 5) + 123456, 0),
        ("2020-01-02T03:04:05,5", us(2020, 1, 2, 3, 4, 5) + 500000, None),
        ("2020-01-02 03:04", us(2020, 1, 2, 3, 4), None),
        ("2020-01-02 03:04:05 +05:30", us(2020, 1, 2, 3, 4, 5), 330),
        ("2020-01-02T03:04:05.250-0330", us(2020, 1, 2, 3, 4, 5) + 250000, -210),
        ("2020-01-02 03:04:05 JST", us(2020, 1, 2, 3, 4, 5), 540),
        ("2020-01-02 03:04:05 utc", us(2020, 1, 2, 3, 4, 5), 0),
        ("2020-01-02 03:04:05 America/New_York", us(2020, 1, 2, 3, 4, 5), "America/New_York"),
        ("2020-01-02T03:04:05[Europe/Berlin]", us(2020, 1, 2, 3, 4, 5), "Europe/Berlin"),
        ("2020-01-02T03:04:05+01:00[Europe/Berlin]", us(2020, 1, 2, 3, 4, 5), 60),
        ("20200102030405", us(2020, 1, 2, 3, 4, 5), None),
        ("20200102T030405", us(2020, 1, 2, 3, 4, 5), None),
        ("20200102_030405", us(2020, 1, 2, 3, 4, 5), None),
        ("Thu, 02 Jan 2020 03:04:05 +0100", us(2020, 1, 2, 3, 4, 5), 60),
        ("2 Jan 2020 03:04:05", us(2020, 1, 2, 3, 4, 5), None),
        ("Jan 2, 2020 3:04:05 pm", us(2020, 1, 2, 15, 4, 5), None),
        ("Thu Jan  2 03:04:05 CET 2020", us(2020, 1, 2, 3, 4, 5), 60),
        ("1577934245", 1577934245_000000, 0),
        ("1577934245.25", 1577934245_250000, 0),
        ("1577934245123", 1577934245_123000, 0),
        ("1577934245123456", 1577934245_123456, 0),
    ],
)
def test_one_reading(text, wall, zone):
    assert [(r.wall_us, r.zone) for r in interpretations(text) if not r.cost] == [(wall, zone)]


@pytest.mark.parametrize("text", [None, "", "   ", "    :  :     :  :  ", "0000:00:00 00:00:00", "2021:13:01 00:00:00", "2021-02-30 10:00:00", "2021:01:01 27:61:00", "2021-01-01", "N/A", "unknown", "13/13/2020 01:02:03", "01/02/2020 13:00:00 PM", "2020-01-02 03:04:05 XYZT"])
def test_no_reading(text):
    assert interpretations(text) == []


def test_all_readings_are_kept():
    assert [r.form for r in interpretations("03/04/2020 01:02:03")] == [DMY, MDY]
    assert [r.form for r in interpretations("25/04/2020 01:02:03")] == [DMY]
    assert placed("25/04/2020 01:02:03", None, "UTC", "mdy") == [(DMY, us(2020, 4, 25, 1, 2, 3), CONTRADICTS)]
    assert placed("03/04/2020 01:02:03", None, "UTC", "mdy") == [(DMY, us(2020, 4, 3, 1, 2, 3), CONTRADICTS), (MDY, us(2020, 3, 4, 1, 2, 3), 0)]
    assert placed("1577934245", None, None, None) == [(PLAIN, 1577934245_000000, 0), (PLAIN, 1577934245_000, UNLIKELY), (PLAIN, 1577934245, UNLIKELY)]
    assert [u for _, u, _ in placed("2021-10-31 02:30:00", None, "Europe/Berlin", None)] == [us(2021, 10, 31, 0, 30), us(2021, 10, 31, 1, 30)]


def test_daylight_saving():
    assert instants(us(2021, 10, 31, 2, 30), "Europe/Berlin") == [(us(2021, 10, 31, 0, 30), 0), (us(2021, 10, 31, 1, 30), UNLIKELY)]
    assert instants(us(2021, 3, 28, 2, 30), "Europe/Berlin") == [(us(2021, 3, 28, 1, 30), 0)]  # skipped: offset before
    assert zone_of("+25:00") == "?" and zone_of("Mars/Base") == "?" and zone_of("../etc/passwd") == "?"


def test_offsets_by_stretches_of_time_agree_with_each_single_one():
    from lumenfold.functions.timetext import _EPOCH, _offsets

    rng = random.Random(5)
    for zone in ("Europe/Berlin", "America/St_Johns", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kolkata", "Pacific/Apia"):
        for _ in range(3000):
            wall = rng.randrange(us(1969, 1, 1), us(2037, 1, 1), 60_000_000)
            first, second = _offsets(wall, zone)
            assert [u for u, _ in instants(wall, zone)] == [wall - first] + [wall - second] * (second < first), (zone, wall, _EPOCH)


def test_zone_order():
    only = lambda *a: [u for _, u, _ in placed(*a)]
    assert only("2020-01-02 03:04:05 +02:00", "+05:00", "Asia/Tokyo", None) == [us(2020, 1, 2, 1, 4, 5)]
    assert only("2020-01-02 03:04:05", "+05:00", "Asia/Tokyo", None) == [us(2020, 1, 1, 22, 4, 5)]
    assert only("2020-01-02 03:04:05", "junk", "Asia/Tokyo", None) == [us(2020, 1, 1, 18, 4, 5)]
    assert only("2020-01-02 03:04:05", None, None, None) == []


def test_best_path_against_all_paths():
    from itertools import product

    rng = random.Random(3)
    for _ in range(200):
        cands = [[(f, rng.randrange(5), rng.choice([0, 0, 3])) for f in rng.sample([0, 1, 2], rng.randint(1, 2))] for _ in range(rng.randint(1, 6))]
        cost = lambda p: sum(c[i][2] for c, i in zip(cands, p)) + sum(TL.step_cost(a[i], b[j]) for (a, i), (b, j) in zip(zip(cands, p), list(zip(cands, p))[1:]))
        best = min(cost(p) for p in product(*[range(len(c)) for c in cands]))
        total, path = TL.best_path(cands)
        assert total == pytest.approx(best) and cost(path) == pytest.approx(best)
        ends = {(p[0], p[-1]): min(cost(q) for q in product(*[range(len(c)) for c in cands]) if (q[0], q[-1]) == (p[0], p[-1])) for p in product(*[range(len(c)) for c in cands])}
        got = TL.cost_matrix(cands)
        base = min(v for v in ends.values())
        low = min(min(r) for r in got)
        assert {(i, j): v - low for i, r in enumerate(got) for j, v in enumerate(r) if v < float("inf")} == pytest.approx({k: v - base for k, v in ends.items()})


def test_the_path_outweighs_nothing_known(spark):
    """The second occurrence and the other order are in the arrays, and are not taken where that is known to be wrong."""
    rows = [(1, "t", "2021-10-31 02:50:00"), (2, "t", "2021-10-31 02:10:00"), (3, "t", "25/12/2021 00:00:00"), (4, "t", "01/02/2022 00:00:00")]
    df = spark.createDataFrame([(*r, None, "cam", "Europe/Berlin", "mdy", "x") for r in rows], VALUES)
    got = {r.record: r.utc_us for r in TL.resolve(df).collect()}
    assert got == {1: us(2021, 10, 31, 0, 50), 2: us(2021, 10, 31, 0, 10), 4: us(2022, 1, 1, 23)}


VALUES = "record long, field string, text string, offset string, source string, zone_name string, date_order string, extra string"


def test_resolve_over_chunks(spark):
    """Ambiguous dates of a hot source follow their order in time, whatever the chunks."""
    rows, want = [], {}
    for i in range(1, 400):
        day, month = (i % 12) + 1, (i // 34) + 1
        rows.append((i, "taken_at", f"{month:02d}/{day:02d}/2020 00:00:{i % 60:02d}" if i != 1 else "01/25/2020 00:00:00", None, "hot", "UTC", None, "x"))
    rows += [(1000, "taken_at", "03/04/2020 01:02:03", None, None, "UTC", None, "x"), (1001, "taken_at", None, None, "hot", "UTC", None, "x"), (None, "taken_at", "2020-01-01 00:00", None, "hot", "UTC", None, "x")]
    rows += rows[:5]
    df = spark.createDataFrame(rows, VALUES)
    one = {(r.record, r.field): r.utc_us for r in TL.resolve(df, chunk_rows=10**6).collect()}
    many = TL.resolve(df, chunk_rows=25).collect()
    assert len(many) == len(one) == 400
    assert {(r.record, r.field): r.utc_us for r in many} == one
    assert one[1000, "taken_at"] == us(2020, 4, 3, 1, 2, 3)
    months = [datetime.fromtimestamp(one[i, "taken_at"] / 1e6, timezone.utc).month for i in range(2, 400)]
    assert months == [(i // 34) + 1 for i in range(2, 400)]
    assert TL.resolve(df.limit(0)).collect() == []
