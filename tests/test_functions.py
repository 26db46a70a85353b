from datetime import date, datetime

from pyspark.sql import functions as F

from contestlake.functions import calendars, names, rates, roles, texts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_period_numbers(spark):
    days = {date(2026, 3, 25): 1, date(2026, 3, 29): 1, date(2026, 3, 30): 2, date(2026, 4, 5): 2, date(2026, 4, 6): 3,
            date(2026, 8, 3): 20, date(2026, 3, 24): None, date(2027, 1, 1): None}
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r.d: r.n for r in df.select("d", calendars.SEASON.number(F.col("d")).alias("n")).collect()}
    assert got == days


def test_period_table_round_trip(spark):
    t = calendars.SEASON.table(spark)
    assert t.count() == 27
    first = t.where("number=1").first()
    assert (first.start_date, first.end_date) == (date(2026, 3, 25), date(2026, 3, 29))
    back = t.select("number", calendars.SEASON.number(F.col("start_date")).alias("s"), calendars.SEASON.number(F.col("end_date")).alias("e"))
    assert back.where("number<>s or number<>e").count() == 0
    assert t.where("is_final").count() == 1


def test_monday_is_settable(spark):
    assert one(spark, calendars.SEASON.next_open(F.lit(date(2026, 4, 6)))) == 3
    assert one(spark, calendars.SEASON.next_open(F.lit(date(2026, 4, 7)))) == 4


def test_sunday_pool_shows_next(spark):
    assert one(spark, calendars.SEASON.pool_target(F.lit(date(2026, 4, 5)))) == 3
    assert one(spark, calendars.SEASON.pool_target(F.lit(date(2026, 4, 4)))) == 2


def test_stamps(spark):
    assert one(spark, calendars.posted_at(F.lit("8/2/26 1:05 PM"))) == datetime(2026, 8, 2, 13, 5)
    assert one(spark, calendars.posted_at(F.lit("8/2/26 12:05 AM"))) == datetime(2026, 8, 2, 0, 5)
    assert one(spark, calendars.posted_at(F.lit("nonsense"))) is None
    assert one(spark, calendars.captured_at(F.lit("captured: 2026-08-02 ~11:35 ET"))) == datetime(2026, 8, 2, 12, 35)
    assert one(spark, calendars.short_date(F.lit("5/6/98"))) == date(1998, 5, 6)


def test_names(spark):
    for a, b in [("José Rodríguez", "jose rodriguez"), ("J.D. O'Neil  Jr.", "jd oneil jr"), ("Ａ", "Ａ".lower())]:
        assert one(spark, names.normalize_name(F.lit(a))) == b
    assert one(spark, names.strip_suffix(F.lit("ken griffey jr"))) == "ken griffey"
    key = one(spark, names.label_key(F.lit("S Ohta (Pitcher)")))
    assert tuple(key) == ("s", "ohta", "pitcher")
    assert one(spark, names.is_only(F.lit("SP,RP"), ["P", "SP", "RP"])) is True
    assert one(spark, names.is_only(F.lit("SP,OF"), ["P", "SP", "RP"])) is False
    assert one(spark, names.is_only(F.lit(None).cast("string"), ["P"])) is None


def test_uid_ignores_action_order_and_accents(spark):
    def uid(actions):
        arr = F.array(*[F.struct(F.lit(p).alias("player"), F.lit(a).alias("action")) for p, a in actions])
        return one(spark, names.transaction_uid(F.lit(datetime(2026, 8, 2)), F.lit("Beta"), arr))

    assert uid([("José A", "add"), ("B", "drop")]) == uid([("B", "drop"), ("Jose A", "add")])
    assert uid([("A", "add")]) != uid([("A", "drop")])


def test_rates(spark):
    assert one(spark, rates.innings_to_outs(F.lit("6.2"))) == 20
    assert one(spark, rates.innings_to_outs(F.lit("7"))) == 21
    assert one(spark, rates.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, rates.fixed(F.lit(2.5), 0)) == 3.0
    assert one(spark, rates.strength(F.lit(-9.0), 3.0)) == 1.0
    # Swap impacts from first principles: 60 innings, one run, 1,000 outs.
    assert abs(one(spark, rates.swap_impact(F.lit(60.0), F.lit(1.0), F.lit(3.0), F.lit(1000))) - 0.18) < 1e-12
    assert one(spark, rates.is_barrel(F.lit(98.0), F.lit(26.0))) is True
    assert one(spark, rates.is_barrel(F.lit(97.9), F.lit(28.0))) is False
    assert one(spark, rates.is_barrel(F.lit(116.0), F.lit(8.0))) is True


def test_texts(spark):
    assert one(spark, texts.return_weeks(F.lit("expected back in 4-to-6 weeks"))) == 5.0
    assert one(spark, texts.return_weeks(F.lit("2 to 3 months"))) == 10.0
    assert one(spark, texts.return_weeks(F.lit("day to day"))) is None
    assert [one(spark, texts.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == [
        "1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert one(spark, texts.finish_range(F.lit(5), F.lit(7), F.lit(9))) == "7th (5th-9th)"
    miss = one(spark, texts.pace(F.lit("no block"), 1300, 1000))
    assert miss.used is None and miss.headroom is None
    hit = one(spark, texts.pace(F.lit("Year to Date\t817.0\nOn Pace\t1203.2"), 1300, 1000))
    assert abs(hit.headroom - 96.8) < 1e-9 and hit.reaches_floor
    m = one(spark, texts.stat_map(F.array(F.lit("K=7.5"), F.lit("W=x"), F.lit("noise"))))
    assert m == {"K": 7.5, "W": None}
    assert [one(spark, texts.freshness(F.lit(x))) for x in (5, 20, 90)] == ["healthy", "stale", "down"]


def test_roles(spark):
    assert one(spark, roles.usage_role(F.lit("pit"), F.lit(3), F.lit(10), F.lit(6), F.lit(0), F.lit(0), F.lit(0))) == "starter"
    assert one(spark, roles.usage_role(F.lit("pit"), F.lit(3), F.lit(10), F.lit(0), F.lit(6), F.lit(2), F.lit(0))) == "closer"
    assert one(spark, roles.usage_role(F.lit("bat"), F.lit(0), F.lit(3), F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == "inactive"
    assert one(spark, roles.acceptance_tier(F.lit(1.0), F.lit(0.5), F.lit(5.0), F.lit(6.0))) == "win-win"
    assert one(spark, roles.acceptance_tier(F.lit(1.0), F.lit(-0.9), F.lit(6.0), F.lit(5.0))) == "needs-sweetener"
    assert one(spark, roles.acceptance_tier(F.lit(0.0), F.lit(5.0), F.lit(6.0), F.lit(5.0))) is None
    assert one(spark, roles.activity_status(F.lit(None).cast("int"), F.lit(None).cast("int"))) == "unverified"
