"""Hand vectors of the demand operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import changepoint, entities, events, grid, states, weather
from gridloom.sources import config
from gridloom.sources.demand import local_instant, project_demand

HOUR = 3600
DAY0 = 1704067200


def readings(spark, values, meter="M1", step=900, start=DAY0):
    return spark.createDataFrame(
        [(meter, start + i * step, v) for i, v in enumerate(values)], "meter_id string, ts_s long, demand_kw double"
    )


def test_gap_limited_interpolation(spark):
    df = readings(spark, [0.0, None, None, None, 40.0]).where("demand_kw is not null")
    got = grid.regularize(
        df.unionByName(readings(spark, [50.0, 60.0, 70.0], start=DAY0 + 5 * 900)), max_gap_minutes=60
    ).orderBy("ts_s").collect()
    assert [r.demand_kw for r in got][:5] == [0.0, 10.0, 20.0, 30.0, 40.0]
    assert [r.data_quality_flag for r in got][:3] == ["observed", "interpolated", "interpolated"]
    short = grid.regularize(
        df.unionByName(readings(spark, [50.0, 60.0, 70.0], start=DAY0 + 5 * 900)), max_gap_minutes=30
    ).orderBy("ts_s").collect()
    assert short[1].is_missing


def test_entity_sum_keeps_missing(spark):
    df = readings(spark, [10.0, 20.0, None, 40.0]).unionByName(readings(spark, [1.0, None, None, 4.0], "M2"))
    members = spark.createDataFrame([("E", "M1"), ("E", "M2")], "entity_id string, meter_id string")
    got = entities.entity_sum(df, members).orderBy("ts_s").collect()
    assert [r.demand_kw for r in got] == [11.0, 20.0, None, 44.0]
    assert [r.n_meters_reporting for r in got] == [2, 1, 0, 2]
    assert entities.entity_sum(df, members, min_count=0).orderBy("ts_s").collect()[2].demand_kw == 0.0


@pytest.mark.parametrize(
    ("values", "peaks"),
    [([1.0, 5.0, 1.0, -3.0, 1.0], [1]), ([1.0, 5.0, None, 1.0, 2.0], []), ([1.0, 5.0, 5.0, 1.0], [])],
)
def test_local_extrema(spark, values, peaks):
    got = events.local_extrema(readings(spark, values)).orderBy("ts_s").collect()
    assert [i for i, r in enumerate(got) if r.is_local_peak] == peaks


def naive_states(values, base, peak, entry=0.2, leave=0.15):
    state, out = "BASELINE", []
    for v in values:
        if v is None:
            out.append("UNKNOWN")
            continue
        if v >= base + entry * (peak - base):
            state = "OPERATING"
        elif v <= base + leave * (peak - base):
            state = "BASELINE"
        out.append(state)
    return out


def naive_persistence(raw, least=2):
    """Runs of fewer than ``least`` steps join the run before, until nothing changes."""
    runs = []
    for s in raw:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    i = 1
    while i < len(runs):
        if runs[i][0] != "UNKNOWN" and runs[i][1] - 1 < least:
            runs[i - 1][1] += runs.pop(i)[1]
            if i < len(runs) and runs[i][0] == runs[i - 1][0]:
                runs[i - 1][1] += runs.pop(i)[1]
        else:
            i += 1
    return [s for s, n in runs for _ in range(n)]


def test_states_against_loop(spark):
    import random

    r = random.Random(5)
    for _ in range(4):
        values = [None if r.random() < 0.05 else r.choice([50.0, 66.0, 69.0, 90.0, 150.0]) for _ in range(96)]
        df = readings(spark, values).withColumn(
            "local_date", F.to_date(F.timestamp_seconds("ts_s"))
        ).withColumn(
            "smooth_kw", F.col("demand_kw")
        ).withColumn("baseline_kw", F.lit(50.0)).withColumn("peak_kw", F.lit(150.0))
        got = states.persistence(states.hysteresis(df)).orderBy("ts_s").collect()
        raw = naive_states(values, 50, 150)
        assert [x.raw_state for x in got] == raw
        assert [x.state for x in got] == naive_persistence(raw)


def test_peak_events_bridge_gaps(spark):
    df = readings(spark, [float(i) for i in range(10)], step=HOUR)
    hits = lambda *at: F.col("demand_kw").isin(*map(float, at))
    got = lambda c, gap: [
        (r.event_id, r.n_intervals)
        for r in events.der_peak_events(df, c, definition="d", gap=gap).orderBy("start_s").collect()
    ]
    assert got(hits(2, 3, 4), 0) == [("M1_d_0001", 3)]
    assert got(hits(2, 4), 0) == [("M1_d_0001", 1), ("M1_d_0002", 1)]
    assert got(hits(2, 4), 1) == [("M1_d_0001", 3)]
    assert got(hits(0, 7), 3) == [("M1_d_0001", 1), ("M1_d_0002", 1)]


def test_asof_ties_go_back_and_tolerance_holds(spark):
    left = spark.createDataFrame([(DAY0 + 1800,), (DAY0 + 5 * HOUR,), (DAY0 + 20 * HOUR,)], "ts_s long")
    right = spark.createDataFrame(
        [(DAY0, 40.0), (DAY0 + HOUR, 60.0), (DAY0 + 5 * HOUR, 70.0)], "ts_s long, temperature_f double"
    )
    got = weather.asof_nearest(left, right, tolerance_seconds=1800).orderBy("ts_s").collect()
    assert [r.external_temperature_f for r in got] == [40.0, 70.0, None]


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (10.0, 40.0, 60.0, 75.0, 85.0, 95.0, 32.0, None)], "t double")
    assert [r[0] for r in df.select(weather.band(F.col("t"))).collect()] == [
        "below-32", "32-50", "50-65", "65-80", "80-90", "90-above", "below-32", None
    ]


def test_change_points_are_recovered(spark):
    xs = [20 + i for i in range(80)]
    line = lambda f: spark.createDataFrame(
        [("E", float(x), float(f(x))) for x in xs], "entity_id string, x double, y double"
    )
    cool = changepoint.fit_3p(line(lambda x: 30 + 2 * max(x - 65, 0)), "cooling").first()
    assert cool.breakpoints == [65.0] and cool.r_squared > 0.999
    heat = changepoint.fit_3p(line(lambda x: 30 + 2 * max(55 - x, 0)), "heating").first()
    assert heat.breakpoints == [55.0]
    five = changepoint.fit_5p(line(lambda x: 30 + 2 * max(50 - x, 0) + max(x - 70, 0))).first()
    assert five.breakpoints == [50.0, 70.0] and abs(five.params["heating_slope"] - 2) < 1e-6
    assert changepoint.select_model(line(lambda x: 10 + 0.5 * x)).first().model_type == "2P"


def test_ramps_start_at_the_second_sample(spark):
    v = [50.0] * 4 + [50.0 + 100 * i for i in range(1, 5)] + [450.0] * 4 + [50.0] * 4
    df = readings(spark, v, step=HOUR).withColumn(
        "local_date", F.to_date(F.timestamp_seconds("ts_s"))
    ).withColumn("smooth_kw", F.col("demand_kw"))
    got = [(r.start_kw, r.end_kw) for r in events.ramp_groups(df).orderBy("start_s").collect()]
    assert got == [(50.0, 450.0), (450.0, 50.0)]


def test_config_checks_and_groups():
    cfg = config.with_defaults(
        {
            "meters": [{"meter_id": m} for m in ("M1", "M2", "M3")],
            "meter_groups": [
                {"name": "a", "meters": ["M1", "M2"]}, {"name": "b", "meters": ["M3"], "child_groups": ["a"]}
            ],
            "portfolio": {"excluded_meters": ["M3"]},
        }
    )
    assert not config.validate(cfg).issues
    assert set(config.entity_members(cfg)) == {
        ("a", "M1"), ("a", "M2"), ("b", "M1"), ("b", "M2"), ("b", "M3"), ("Portfolio", "M1"), ("Portfolio", "M2")
    }
    assert config.find_cycle({"a": ["b"], "b": ["a"]}) == ["a", "b", "a"]
    cfg["meter_groups"][0]["child_groups"] = ["b"]
    with pytest.raises(config.ConfigError):
        config.entity_members(cfg)


@pytest.mark.parametrize(
    ("cfg", "path", "severity"),
    [
        ([], "<root>", "ERROR"),
        ({"input": {"unit": "MW"}}, "input.unit", "ERROR"),
        (
            {"data_quality": {"max_interpolation_gap_minutes": "x"}},
            "data_quality.max_interpolation_gap_minutes",
            "ERROR",
        ),
        (
            {"data_quality": {"max_interpolation_gap_minutes": -1}},
            "data_quality.max_interpolation_gap_minutes",
            "ERROR",
        ),
        ({"data_quality": {"min_completeness_fraction": None}}, "data_quality.min_completeness_fraction", "ERROR"),
        ({"data_quality": {"min_completeness_fraction": 1.2}}, "data_quality.min_completeness_fraction", "ERROR"),
        ({"data_quality": {"negative_demand_severity": "LOUD"}}, "data_quality.negative_demand_severity", "ERROR"),
        ({"start_detection": {"weight_a": 0.4}}, "start_detection.weight_*", "WARNING"),
        ({"meters": []}, "meters", "WARNING"),
        ({"meters": [{}]}, "meters[0]", "ERROR"),
        ({"meters": [{"meter_id": "A"}] * 2}, "meters[1].meter_id", "ERROR"),
        ({"meter_groups": [{}]}, "meter_groups[0]", "ERROR"),
        ({"meter_groups": [{"name": "g"}] * 2}, "meter_groups[1].name", "ERROR"),
        ({"meter_groups": [{"name": "g", "meters": ["Z"]}]}, "meter_groups[0].meters", "ERROR"),
        ({"meter_groups": [{"name": "g", "child_groups": ["g"]}]}, "meter_groups[0].child_groups", "ERROR"),
        ({"meter_groups": [{"name": "g", "child_groups": ["h"]}]}, "meter_groups[0].child_groups", "ERROR"),
        (
            {"meter_groups": [{"name": "g", "child_groups": ["h"]}, {"name": "h", "child_groups": ["g"]}]},
            "meter_groups",
            "ERROR",
        ),
        ({"portfolio": {"excluded_meters": ["Z"]}}, "portfolio.excluded_meters", "ERROR"),
    ],
)
def test_config_findings(cfg, path, severity):
    assert (severity, path) in {(i.severity, i.path) for i in config.validate(cfg).issues}


def test_settings_of_a_file(tmp_path):
    f = tmp_path / "own.toml"
    f.write_text(
        '[timezone]\ndefault_tz = "America/Chicago"\n[classification]\nearly_start_before_hour = 5\n[der.load_shape]\nflat_cv_max = 0.2\n[der.calendar.season_map]\n1 = "cold"\n[smoothing]\nwindow = 3\n'
    )
    with pytest.warns(UserWarning, match="smoothing.window is read by nothing"):
        cfg = config.load(f)
    assert cfg["classification"][
        "early_start_before_hour"
    ] == 5 and cfg["classification"]["long_operation_hours"] == 10.0
    assert cfg["der"]["load_shape"] == config.DEFAULTS["der"]["load_shape"] | {"flat_cv_max": 0.2} and config.get(
        cfg, "der", "nothing", default=7
    ) == 7
    f.write_text("[data_quality]\nmin_completeness_fraction = 3\n")
    with pytest.raises(config.ConfigError, match="min_completeness_fraction"):
        config.load(f)
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.toml")


def test_configured_run_from_files(spark, tmp_path):
    """Two meters of different resolution from CSV, a group, the portfolio and temperature; tables as CSV where a path is set."""
    from gridloom.plans import pipeline

    for name, step, n in (("a", 15, 96), ("b", 60, 24)):
        rows = "\n".join(
            f"2024-01-15 {i * step // 60:02}:{i * step % 60:02}:00,{50 + 300 * (8 <= i * step // 60 < 18) + 1000 * (name == 'a' and i == 20)}"
            for i in range(n)
        )
        (tmp_path / f"{name}.csv").write_text(f"datetime,demand_kw\n{rows}\n")
    (tmp_path / "w.csv").write_text("when,f\n2024-01-14 00:00:00,20.5\n2024-01-15 12:00:00,40.0\n")
    cfg = {
        "timezone": {"default_tz": "America/Chicago"},
        "meters": [
            {"meter_id": "A", "building_id": "B1", "source": str(tmp_path / "a.csv")},
            {"meter_id": "B", "source": str(tmp_path / "b.csv")},
        ],
        "meter_groups": [{"name": "g", "meters": ["A"]}],
        "der": {
            "temperature": {
                "source": str(tmp_path / "w.csv"), "column_mapping": {"timestamp": "when", "temperature_f": "f"}
            },
            "output": {"entity_daily_csv": "out/entity_daily"},
        },
        "output": {"daily_features_csv": "out/daily"},
    }
    meters, entities_ = pipeline.run_configured(spark, cfg)
    daily = {r.meter_id: r for r in meters.daily.collect()}
    assert (daily["A"].resolution_minutes, daily["A"].building_id, daily["B"].resolution_minutes) == (15.0, "B1", 60.0)
    assert daily["A"].probable_start_time.startswith(
        "2024-01-15T0"
    ) and daily["A"].probable_start_time.endswith("-06:00")
    spike = meters.interval.where("meter_id = 'A' and demand_kw > 1000").first()
    assert spike.analysis_demand_kw == 50.0
    frame = entities_.entity_interval.where("entity_id = 'Portfolio'").orderBy("ts_s").collect()
    assert len(frame) == 96 and frame[0].temperature_f == 40.0
    assert frame[-1].temperature_band == "32-50"
    assert {
        r.entity_id: (r.success, r.n_meters) for r in entities_.study_coincidence.collect()
    } == {"g": (False, 1), "Portfolio": (True, 2)}
    assert {r.entity_id for r in entities_.daily_coincidence.collect()} == {"Portfolio"}
    written = pipeline.export_configured(meters, cfg, str(tmp_path)) | pipeline.export_configured(
        entities_, cfg, str(tmp_path)
    )
    assert set(written) == {
        "daily", "entity_daily"
    } and spark.read.option("header", True).csv(written["daily"]).count() == 2


def test_keep_first_needs_an_order(spark):
    from gridloom.plans import pipeline

    df = spark.createDataFrame(
        [("M", DAY0, 9.0, 1), ("M", DAY0, 2.0, 2), ("M", DAY0 + 900, 3.0, 3), ("M", DAY0 + 1800, 3.0, 4)],
        "meter_id string, ts_s long, demand_kw double, ingest_seq long",
    )
    with pytest.raises(ValueError, match="ingest_seq"):
        pipeline.run_meters(df.drop("ingest_seq"))
    got = pipeline.run_meters(df).interval.orderBy("ts_s").collect()
    assert [r.demand_kw for r in got] == [9.0, 3.0, 3.0]
    both = df.withColumn("local_date", F.lit("2024-01-01").cast("date"))
    members = spark.createDataFrame([("E", "M")], "entity_id string, meter_id string")
    assert entities.coincidence(both, members, min_meters=1, order="ingest_seq").first().group_peak_kw == 9.0
    with pytest.raises(ValueError, match="negative"):
        pipeline.run_meters(df.withColumn("demand_kw", -F.col("demand_kw")))


def test_kwh_needs_a_positive_resolution(spark):
    df = readings(spark, [1.0, 2.0]).withColumn("resolution_minutes", F.lit(15.0))
    assert [r.demand_kw for r in grid.convert_units(df, "kWh").orderBy("ts_s").collect()] == [4.0, 8.0]
    with pytest.raises(Exception, match="more than 0 minutes"):
        grid.convert_units(df.withColumn("resolution_minutes", F.lit(0.0)), "kWh").collect()


def dayed(spark, values, step=900, **options):
    df = readings(spark, values, step=step, **options).withColumn(
        "local_date", F.to_date(F.timestamp_seconds("ts_s"))
    ).withColumn("is_interpolated", F.lit(False))
    return grid.smooth(df, window_minutes=60, resolution_minutes=step / 60)


def test_normalised_demand_goes_by_the_smoothed_peak(spark):
    values = [50.0] * 8 + [350.0] * 5 + [900.0] + [350.0] * 4 + [50.0] * 6
    s = dayed(spark, values, step=HOUR)
    s = grid.smooth(s.drop("smooth_kw"), window_minutes=180, resolution_minutes=60)
    n = states.normalize_demand(s, states.baseline(s))
    top = n.agg(F.max("normalized_demand")).first()[0]
    assert abs(top - 850 / 300) < 1e-9
    cfg = config.with_defaults()["peak_detection"]
    widths = events.peak_events(states.persistence(states.hysteresis(n)), cfg=cfg).where("rank = 1").first()
    assert (
        widths.width_70_hours, widths.width_80_hours, widths.width_90_hours, widths.peak_is_interpolated
    ) == (9.0, 9.0, 9.0, False)
    flat = dayed(spark, [100.0] * 96)
    f = states.normalize_demand(flat, states.baseline(flat))
    assert events.peak_events(f, cfg=cfg).count() == 0 and f.where("normalized_demand is not null").count() == 0


def test_ramps_within_one_state_are_no_transitions(spark):
    values = [50.0] * 8 + [300.0, 400.0, 500.0, 500.0, 450.0, 400.0, 500.0] + [500.0] * 4 + [50.0] * 5
    s = dayed(spark, values, step=HOUR).withColumn("smooth_kw", F.col("demand_kw"))
    st = states.persistence(states.hysteresis(states.normalize_demand(s, states.baseline(s))))
    got = events.ramp_events(st, cfg=config.with_defaults()["ramp_detection"]).orderBy("start_s").collect()
    assert [
        (r.start_kw, r.end_kw, r.is_operating_transition) for r in got
    ][:2] == [(50.0, 500.0, True), (500.0, 400.0, False)]


def test_peak_concentration_and_local_peak_time(spark):
    from gridloom.operators import features

    values = [100.0] * 40 + [200.0, 400.0, 200.0] + [100.0] * 53
    got = features.peak_concentration(dayed(spark, values)).first()
    total = sum(values)
    assert abs(
        got.peak_concentration_1hr - 1000 / total
    ) < 1e-12 and abs(got.peak_concentration_2hr - 1400 / total) < 1e-12
    tz = "America/Chicago"
    df = readings(
        spark, [1.0] * 10 + [5.0] + [1.0] * 13, step=HOUR, start=DAY0 + 6 * HOUR
    ).withColumnRenamed("meter_id", "entity_id")
    assert entities.daily_summary(entities.calendar(df, tz=tz), tz=tz).first().peak_time_minutes == 600


def test_autumn_hour_by_order(spark):
    wall = ["00:30", "01:00", "01:30", "01:00", "01:30", "02:00"]
    df = spark.createDataFrame(
        [(f"2024-11-03 {t}:00", float(i), i) for i, t in enumerate(wall)],
        "datetime string, demand_kw double, ingest_seq long",
    )
    got = project_demand(
        df, ts="datetime", demand="demand_kw", tz="America/Chicago", seq="ingest_seq"
    ).orderBy("ingest_seq").collect()
    assert [b.ts_s - a.ts_s for a, b in zip(got, got[1:], strict=False)] == [1800] * 5


def test_asof_without_a_limit(spark):
    left = spark.createDataFrame([(DAY0 - 90 * 86400,), (DAY0 + 40 * 86400,), (DAY0 + 400 * 86400,)], "ts_s long")
    right = spark.createDataFrame([(DAY0, 40.0), (DAY0 + 100 * 86400, 70.0)], "ts_s long, temperature_f double")
    assert [
        r.external_temperature_f for r in weather.asof_nearest(left, right).orderBy("ts_s").collect()
    ] == [40.0, 40.0, 70.0]


def test_two_parameter_fit_of_constant_x(spark):
    df = spark.createDataFrame([("E", 2.0, float(y)) for y in (1, 3, 5, 7)], "entity_id string, x double, y double")
    got = changepoint.fit_2p(df).first()
    assert got.success and abs(got.params["base"] - 0.8) < 1e-12 and abs(
        got.params["slope"] - 1.6
    ) < 1e-12 and got.r_squared == 0.0


def test_clusters_of_plain_shapes(spark):
    import numpy as np

    from gridloom.operators import clustering

    rng = np.random.default_rng(1)
    shapes = [
        np.r_[np.ones(8), 9 * np.ones(8), np.ones(8)],
        np.r_[9 * np.ones(8), np.ones(16)],
        np.r_[np.ones(16), 9 * np.ones(8)],
    ]
    rows = [
        ("E", "absolute", f"2024-01-{i + 1:02}", (shapes[i % 3] + rng.normal(0, 0.1, 24)).tolist()) for i in range(18)
    ] + [
        ("F", "absolute", f"2024-01-0{i}", [float(i)] * 24) for i in (1, 2, 3)
    ] + [("G", "absolute", "2024-01-01", [1.0] * 24)]
    m = spark.createDataFrame(
        rows, "entity_id string, profile_kind string, local_date string, profile array<double>"
    ).withColumn("local_date", F.to_date("local_date"))
    c = clustering.cluster_profiles(m).cache()
    got = {r.entity_id: r for r in c.collect()}
    assert [
        x.cluster_id for x in got["E"].labels
    ] == [i % 3 for i in range(18)] and got["E"].k == 3 and [s.k for s in got["E"].scores] == list(range(2, 9))
    assert (got["F"].k, got["F"].success, len(got["F"].scores), got["G"].success) == (1, True, 0, False)
    x, label = np.array([r[3] for r in rows[:18]]), np.array([i % 3 for i in range(18)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    plain = []
    for i in range(18):
        a = d[i][(label == label[i]) & (np.arange(18) != i)].mean()
        b = min(d[i][label == k].mean() for k in range(3) if k != label[i])
        plain.append((b - a) / max(a, b))
    assert abs(got["E"].scores[1].silhouette - np.mean(plain)) < 1e-9 and abs(
        clustering.silhouette(x, label, block=5) - np.mean(plain)
    ) < 1e-9
    stats = {(r.entity_id, r.cluster_id): r for r in clustering.cluster_stats(c, m).collect()}
    assert stats["E", 0].cluster_size == 6 and abs(stats["E", 0].percentage_of_days - 100 / 3) < 1e-9 and abs(
        stats["E", 0].representative_peak - x[label == 0].mean(0).max()
    ) < 1e-9


def test_projection_and_spring_gap(spark):
    with pytest.raises(ValueError, match="missing"):
        project_demand(spark.range(1), ts="t", demand="d")
    df = spark.createDataFrame(
        [("2024-03-10 02:30:00",), ("2024-03-10 01:30:00",)], "t string"
    ).withColumn("t", F.col("t").cast("timestamp"))
    a, b = (r[0] for r in df.select(local_instant(F.col("t"), "America/Chicago")).collect())
    assert (a, b) == (1710057600, 1710055800)


def test_dedup_and_resolution(spark):
    df = spark.createDataFrame(
        [
            ("M", DAY0 + x, v, s)
            for x, v, s in ((0, 1.0, 1), (0, 9.0, 2), (900, 2.0, 3), (2700, 3.0, 4), (3600, 4.0, 5))
        ],
        "meter_id string, ts_s long, demand_kw double, ingest_seq int",
    )
    assert {r.demand_kw for r in grid.dedup_first(df, "ingest_seq").collect()} == {1.0, 2.0, 3.0, 4.0}
    r = grid.validate_input(df).first()
    assert (r.duplicates, r.resolution_minutes, r.irregular_intervals) == (1, 15.0, 1)


def test_dst_days_have_92_and_100_intervals(spark):
    for day, n in (("2024-03-10", 92), ("2024-11-03", 100)):
        start = spark.sql(f"select unix_timestamp(to_utc_timestamp('{day}', 'America/Chicago'))").first()[0]
        df = spark.createDataFrame(
            [("M", start - 900, 1.0), ("M", start, 1.0), ("M", start + 900, 1.0), ("M", start + 30 * 3600, 1.0)],
            "meter_id string, ts_s long, demand_kw double",
        )
        got = grid.regularize(
            df, max_gap_minutes=0, tz="America/Chicago"
        ).groupBy("local_date").count().where(f"local_date = '{day}'").first()
        assert got["count"] == n


def test_kmeans_queries_cluster_all_entities_by_both_profiles(spark):
    from gridloom.plans import queries

    got = queries.QUERIES["select_k"](spark, "/root/testdata/sf0.01").collect()
    want = {(e, kind) for e in ("all", "interest", "sales") for kind in ("absolute", "normalized")}
    assert {(r.entity_id, r.profile_kind) for r in got} == want and {r.k for r in got} == set(range(2, 9))


def test_exact_percentiles(spark):
    rng = random.Random(3)
    values = {
        "ties": [float(rng.randint(0, 5)) for _ in range(3000)],
        "wide": [rng.gauss(0, 1e6) for _ in range(3000)],
        "heavy": [1.0] * 2000 + [rng.random() for _ in range(999)],
        "one": [7.5],
        "two": [1.0, 2.0],
        "holes": [None, 3.0, None, 4.0, 9.0],
    }
    rows = [(k, i, v) for k, xs in values.items() for i, v in enumerate(xs)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "entity_id string, ts_s long, demand_kw double")
    wanted = {"a": 0.9, "b": 0.5, "c": 0.0, "d": 1.0, "e": 0.333}
    got = {r.entity_id: r.asDict() for r in entities.exact_percentiles(df, wanted).collect()}
    assert set(got) == set(values)
    for k, xs in values.items():
        for name, p in wanted.items():
            want = np.percentile([x for x in xs if x is not None], 100 * p)
            assert got[k][name] == pytest.approx(want, rel=1e-12), (k, name)
    top = entities.demand_families(df, percentiles=(0.9,)).where("top_pct_0_9").groupBy("entity_id").count().collect()
    limit = {k: np.percentile([x for x in xs if x is not None], 90) for k, xs in values.items()}
    assert {r.entity_id: r["count"] for r in top} == {
        k: sum(x is not None and x >= limit[k] for x in xs) for k, xs in values.items()
    }


def test_refreshed_days(spark, tmp_path):
    """A stream of readings: each batch hands on all readings of the days that it touches."""
    from gridloom.streaming.refresh import refresh_days

    schema, source, out = "meter_id string, ts_s long, demand_kw double", str(tmp_path / "in"), []
    for i, rows in enumerate(([("M", DAY0, 1.0), ("M", DAY0 + 900, 2.0)], [("M", DAY0 + 1800, 3.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        refresh_days(
            stream,
            str(tmp_path / "store"),
            lambda df, _: out.append(sorted(r.demand_kw for r in df.collect())),
            checkpoint=str(tmp_path / "checkpoint"),
        ).awaitTermination()
    assert [x for x in out if x][0] == [1.0, 2.0] and [1.0, 2.0, 3.0] in out
