"""Orders and quantiles of whole frames, Unicode forms, maps, workbooks, settings."""

import io
import math
import random
import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions import periods, unicode
from tarnwell.operators import features, frames, ordered, profile, roles, shapes, topics
from tarnwell.plans import config, pack, pipeline, rules
from tarnwell.sources import files, messy, staged
from tarnwell.sources.storage import Storage


def numbers(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, x double").repartition(3)


@pytest.mark.parametrize("few", [1_000_000, 10, 2])
def test_quantiles_are_exact_however_far_ranges_are_narrowed(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    r = random.Random(3)
    for values in ([r.gauss(0, 1) for _ in range(500)], [r.randrange(5) for _ in range(400)], [1.0] * 50 + [2.0], [None, 4.0], [], [3.0, float("nan"), 5.0]):
        df = numbers(spark, values)
        real = [v for v in values if v is not None and v == v]
        shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
        got = ordered.quantiles(df, [(F.col("x"), q) for q in shares])
        assert got == [None] * 6 if not real else got == pytest.approx(np.quantile(real, shares))


def test_grouped_quantiles_are_exact(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), float(r.randrange(30))) for _ in range(300)] + [("d", 1.0), ("e", None)]
    got = {x.g: (x.q1, x.m) for x in ordered.grouped_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"q1": 0.25, "m": 0.5}).collect()}
    for g in "abcd":
        own = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(tuple(np.quantile(own, [0.25, 0.5])))
    assert set(got) == set("abcd")


def test_orders_go_on_from_slice_to_slice(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 7)
    values = [None, None, 1.0, None, 4.0, *[None] * 20, 2.0, None]
    df = numbers(spark, values)
    place = {r.i: r.n for r in ordered.numbered(df, ["i"], "n").collect()}
    assert place == {i: i + 1 for i in range(len(values))}
    assert {r.i: r.n for r in ordered.numbered(df, ["i"], "n", descending=True).collect()} == {i: len(values) - i for i in range(len(values))}
    take = lambda d, c: [r[c] for r in d.orderBy("i").collect()]
    assert take(frames.impute(df, "x", "ffill", ["i"]), "x") == [None, None, 1, 1, 4, *[4] * 20, 2, 2]
    assert take(frames.impute(df, "x", "bfill", ["i"]), "x") == [1, 1, 1, 4, 4, *[2] * 20, 2, None]
    line = take(frames.impute(df, "x", "interpolate", ["i"], limit_direction="forward"), "x")
    assert line[:5] == [None, None, 1, 2.5, 4] and line[-1] == 2 and line[5] == pytest.approx(4 - 2 / 21)
    some = numbers(spark, range(40))
    assert take(features.shifted(some, "x", ["i"], "o", step=3), "o") == [None] * 3 + list(range(37))
    assert take(features.shifted(some, "x", ["i"], "o", step=-2), "o") == [*range(2, 40), None, None]
    rolled = take(features.rolling(some, "x", ["i"], "o", 5, 2), "o")
    assert rolled[0] is None and rolled[1:] == [np.mean(range(max(0, k - 4), k + 1)) for k in range(1, 40)]
    monkeypatch.setattr(ordered, "BLOCK", 1000)
    y, want = 0.0, []
    for k in range(40):
        y = k if k == 0 else 0.8 * y + 0.2 * k
        want.append(y)
    assert take(features.ewm_mean(some, "x", ["i"], "o"), "o") == pytest.approx(want)
    assert ordered.numbered(df.limit(0), ["i"], "n").count() == 0


def test_unicode_forms_are_those_of_the_database(spark):
    texts = ["plain", "\ufb01n \u2460\u00bd", "e\u0301a\u0308", "\uff21\uff22 \u3000x", "Stra\u00dfe \u00c5ngstr\u00f6m", "\u212b\u2126", "\U0001d400x", "\u1e9b\u0323", "\u0132\u2026", "", None, "\u0915\u093c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", unicode.nfkc(F.col("t")).alias("c"), unicode.ascii_form(F.col("t")).alias("a")).orderBy("i").collect()
    for t, r in zip(texts, rows, strict=True):
        if t is None:
            assert r.c is None and r.a is None
        else:
            assert r.a == unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
            assert r.c == unicodedata.normalize("NFKC", t) or t in ("\u1e9b\u0323", "\u0915\u093c")  # marks in another order, and what is never composed


def test_cells_of_points_fill_their_box(spark):
    r = random.Random(6)
    points = [(i, r.random() * 10, r.random() * 4) for i in range(40)] + [(99, 0.5, 0.5), (98, 0.5, 0.5)]
    df = spark.createDataFrame(points, "k int, x double, y double")
    cells = {c.key: (c.area, c.polygon) for c in shapes.voronoi(df, "k", "x", "y").collect()}
    xs, ys = [p[1] for p in points], [p[2] for p in points]
    box = (max(xs) - min(xs)) * 1.1 * (max(ys) - min(ys)) * 1.1
    assert sum(a for k, (a, _) in cells.items() if k != 98) == pytest.approx(box) and cells[98] == cells[99]
    middle = np.mean(cells[3][1], axis=0)
    near = min(points, key=lambda p: math.dist(p[1:], middle))
    assert near[0] == 3


def test_circles_are_pushed_apart(spark):
    places = [(i, 10.0 + i % 3 * 0.01, 20.0 + i // 3 * 0.01, float(i + 1)) for i in range(9)]
    got = shapes.cartogram(spark.createDataFrame(places, "k int, lat double, lon double, v double"), "k", "lat", "lon", "v").collect()
    wide = math.cos(math.radians(np.mean([r.lat for r in got])))
    for a in got:
        for b in got:
            if a.place < b.place:
                assert math.hypot((a.lon - b.lon) * wide, a.lat - b.lat) >= (a.size + b.size) / 300 * 0.98
    assert shapes.cartogram(spark.createDataFrame([], "k int, lat double, lon double, v double"), "k", "lat", "lon", "v").count() == 0


def test_jitter_stays_within_its_width_and_repeats(spark):
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2]) for i in range(200)], "i int, v double, g string")
    one, two = ({r.key: r.position for r in shapes.strip(df, "v", "i", "g", 0.35).collect()} for _ in range(2))
    assert one == two and all(abs(p - k % 2) <= 0.35 for k, p in one.items()) and len(set(one.values())) > 150


def workbook(rows):
    shared, cells = [], []
    for i, row in enumerate(rows, 1):
        out = ""
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, str):
                shared.append(v)
                out += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
            else:
                out += f'<c r="{at}"><v>{v}</v></c>'
        cells.append(f'<row r="{i}">{out}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
    return made.getvalue()


def test_workbooks_are_read_with_other_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["id", "name", "amount"], [1, "x", 2.5], [2, None, 3]]))
    (tmp_path / "b.csv").write_text("id,amount\n3,4\n")
    made = files.bronze(files.read_union(spark, [str(tmp_path / "a.xlsx"), str(tmp_path / "b.csv")]))
    assert sorted((r.id, r.name, r.amount) for r in made.collect() if r.name is None) == [(2.0, None, 3.0), (3.0, None, 4.0)] and made.count() == 3


def test_storage_reaches_files_and_knows_roots(spark, tmp_path):
    store = Storage.of(spark, config.of(config.parse("[storage.local]\nraw_root='r'\ngold_root='g'\n[storage.minio]\nenabled=true\nendpoint='http://x'\nbucket='b'\nraw_prefix='raw/'")))
    store.write_bytes(f"{tmp_path}/d/a.txt", b"\x00abc")
    assert store.read_bytes(f"{tmp_path}/d/a.txt") == b"\x00abc" and store.exists(f"{tmp_path}/d") and not store.exists(f"{tmp_path}/e")
    assert [p.rsplit("/", 1)[-1] for p in store.ls(str(tmp_path))] == ["a.txt"] and store.ls(f"{tmp_path}/e") == []
    assert store.raw_path("s", "f.csv") == "r/s/f.csv" and store.raw_path("s", remote=True) == "s3a://b/raw/s"
    with pytest.raises(ValueError):
        Storage(spark).gold_path("x", remote=True)
    files.append_log(spark, f"{tmp_path}/log", [{"a": 1}])
    files.append_log(spark, f"{tmp_path}/log", [{"a": 2}])
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/log").collect()) == ['{"a": 1}', '{"a": 2}']


def test_settings_come_from_a_file_and_nothing_is_dropped(tmp_path):
    (tmp_path / "config").mkdir()
    text = "```toml\n[storage.local]\nraw_root = 'data/raw'\n[nlp.role_scoring]\nname_weight = 0.2\nunique_id_ratio = 0.9\n[cleaning.ids]\nzip_width = 7\n[cleaning.impute]\nnumeric_default = 'mean'\n[cleaning.outliers]\ndetect = 'iqr'\nhandle = 'drop'\n[cleaning.own]\nword = 'x'\n[topics.thresholds]\nmin_corr_for_scatter = 0.5\n[weights]\neffect_size = 9\n```"
    (tmp_path / "config" / "c.toml").write_text("\ufeff" + text)
    c = config.load(str(tmp_path / "config" / "c.toml"))
    assert c.raw_root == str(tmp_path / "data/raw") and c.roles == roles.RoleConfig(name_weight=0.2, unique_id=0.9) and c.thresholds.correlation == 0.5 and c.weights.effect == 9
    assert c.env["cleaning"]["ids"] == {"zip_width": 7, "pad_fillchar": "0", "pad_numeric_only": True} and c.env["numeric_default"] == "mean" and c.env["detect"] == "iqr" and c.env["handle"] == "drop"
    assert c.section("cleaning.own.word") == "x" and c.env["cleaning"]["own"]["word"] == "x" and c.rules == pack.RULES and c.section("no.where") is None
    for bad in ("a = ", "[[cleaning.rules]]\nid='x'\n"):
        with pytest.raises(config.ConfigError):
            config.of(config.parse(bad))


def test_small_whole_numbers_stay_as_they_are(spark):
    df = spark.createDataFrame([(i, i % 50 + 1, float(i % 7), i % 101, f"{i % 100:05d}") for i in range(300)], "row_id int, quantity int, line double, score int, zip_code string")
    made = rules.clean(df)
    got = {r.row_id: r for r in made.df.collect()}
    assert all(got[i].quantity == i % 50 + 1 and got[i].line == i % 7 and got[i].zip_code == f"{i % 100:05d}" for i in range(300))
    assert any(h.rule == "percents-by-range" for h in made.hits) is False and made.failures == []
    shares = spark.createDataFrame([(i, float(i % 90 + 5)) for i in range(200)], "row_id int, win_rate double")
    assert any(h.rule == "percents-by-range" for h in rules.clean(shares).hits)
    assert not any(h.rule == "percents-by-range" for h in rules.clean(shares, compat=True).hits)


def test_messy_files_become_a_clean_table_and_its_components(spark, tmp_path):
    files.write_any(messy.messy(spark, 400), str(tmp_path / "x.csv"))
    made = pipeline.to_silver(spark, [str(tmp_path / "x.csv")], "x", out=str(tmp_path / "silver"))
    kinds = dict(made.df.dtypes)
    assert kinds["event_date"] == "timestamp_ntz" and kinds["is_paid"] == "boolean" and made.df.count() == 400 and not made.failed
    assert {r.city for r in made.df.select("city").distinct().collect()} <= {"berlin", "lyon", "porto", "graz", "turin", "Unknown"}
    done = pipeline.to_gold(made.df, "x", made.schema, out=str(tmp_path / "gold"), recheck=True)
    assert done["manifest"]["charts"] and all((tmp_path / "gold" / "artifacts" / "charts" / f"{c['chart_id']}.json").exists() for c in done["manifest"]["charts"])
    boot = pipeline.bootstrap(spark, [str(tmp_path / "x.csv")], "x", out=str(tmp_path / "boot"))
    assert {c["name"] for c in boot["columns"]} >= {"amount_usd", "city"} and (tmp_path / "boot" / "nlp_bootstrap.json").exists()
    assert next(c for c in boot["columns"] if c["name"] == "city")["metrics"]["empty_token_candidates"] in (["-", "null"], ["null", "-"])
    empty = topics.Roles(None, None, [], [])
    assert topics.base_candidates(made.df, empty) == []


def test_frequencies_and_zones(spark):
    regular = spark.sql("SELECT timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, id) AS t FROM range(10) AS r(id)".replace("make_interval(0, 0, 0, 0, id)", "make_dt_interval(0, cast(id AS int))"))
    assert periods.is_regular(regular, "t") and periods.infer_frequency(regular, "t").first().gap == 3_600_000_000
    assert not periods.is_regular(regular.unionAll(regular.limit(1).select(F.col("t") + F.expr("INTERVAL 7 MINUTE"))), "t")


def test_staged_tables_can_be_released(spark):
    since = staged.mark()
    a, b = staged.stage(spark.range(3).toDF("x")), staged.stage(spark.range(4).toDF("x"))
    staged.release(spark, since, b)
    assert not Storage(spark).exists(a._staged) and b.count() == 4
    staged.release(spark, since)
    assert not Storage(spark).exists(b._staged)


def test_facts_without_rows(spark):
    f = profile.facts(spark.createDataFrame([], "a int, b string, c double"))
    assert all(x["rows"] == 0 and x["nunique"] == 0 for x in f.values()) and f["c"]["iqr"] is None


def _look_ahead(df) -> bool:
    """Whether a window of rows runs to its group's end, which Spark goes through anew for every row."""
    return "currentrow$(), unboundedfollowing$()" in df._jdf.queryExecution().optimizedPlan().toString()


def test_fills_of_whole_orders_look_ahead_in_one_pass(spark):
    df = spark.createDataFrame([(i, i // 4, float(i) if i % 3 == 0 else None) for i in range(60)], "i int, t int, x double").repartition(3)
    made = ordered.neighbours(df, ["t"], F.col("x"), "a", "b")  # four rows of each t are ties
    assert not _look_ahead(made) and not _look_ahead(frames.impute(df, "x", "bfill", ["t"]))
    rows = made.collect()
    assert len(rows) == 60 and all(r.x is None or r.a == r.b == r.x for r in rows)
    for r in rows:  # of ties, each one's neighbours are next to each other in the one order that all have
        assert r.x is not None or r.a is None or r.b is None or r.a != r.b
    assert [r.x for r in frames.impute(df, "x", "bfill", ["i"]).orderBy("i").collect()] == [float(i + -i % 3) if i < 58 else None for i in range(60)]


def test_interpolation_looks_ahead_in_one_pass(spark):
    df = spark.createDataFrame([(i, i % 2, float(i * i) if i % 6 < 2 else None) for i in range(40)], "i int, g int, x double").repartition(3)
    for by in (None, ["g"]):
        for method in ("interpolate", "bfill"):
            assert not _look_ahead(frames.impute(df, "x", method, ["i"], by=by))
        got = frames.impute(df, "x", "interpolate", ["i"], by=by).orderBy("i").collect()
        for part in ([got] if by is None else [[r for r in got if r.g == g] for g in (0, 1)]):
            known = [(k, float(r.i**2)) for k, r in enumerate(part) if r.i % 6 < 2]
            assert len(part) == 40 // (1 if by is None else 2)
            assert [r.x for r in part] == pytest.approx(list(np.interp(range(len(part)), *zip(*known, strict=True))))


def test_a_vertical_timeline_looks_ahead_in_one_pass(spark):
    values = [0.0, None, 4.0, None, None, 10.0]
    df = spark.createDataFrame([(i, i, v) for i, v in enumerate(values)], "k int, t int, v double").repartition(3)
    made = shapes.vertical_timeline(df, "t", "v", "k")
    assert not _look_ahead(made)
    at = {r.key: r.x for r in made.collect()}
    mean, width = 14 / 3, float(np.quantile([0.0, 4.0, 10.0], 0.97) - np.quantile([0.0, 4.0, 10.0], 0.03))
    assert [at[i] for i in range(6)] == pytest.approx([(v - mean) / (width / 2) * 0.9 for v in (0, 2, 4, 6, 8, 10)])


def test_a_whole_order_is_staged_once_and_not_at_all_without_gaps(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(ordered, "stage", lambda df, kept=ordered.stage: staged.append(kept(df)) or staged[-1])
    rows = [(i, i // 3, float(i * i) if i % 4 < 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t int, v double").repartition(5)
    for frame, times in ((df, 1), (df.withColumn("v", F.coalesce("v", F.lit(1.0))), 0)):
        staged.clear()
        got = shapes.vertical_timeline(frame, "t", "v", "k").orderBy("key").collect()
        assert len(staged) == times and len(got) == 60
        kept = [(r.k, r.v) for r in frame.orderBy("k").collect() if r.v is not None]
        values = [v for _, v in kept]
        width = float(np.quantile(values, 0.97) - np.quantile(values, 0.03)) or 1.0
        assert [r.x for r in got] == pytest.approx([(v - np.mean(values)) / (width / 2) * 0.9 for v in np.interp(range(60), *zip(*kept, strict=True))])


def test_few_values_on_many_rows_are_no_constant_as_shipped(spark):
    df = spark.range(40_000).select(F.col("id").alias("row_key"), (F.col("id") % 25).cast("int").alias("nation"), F.lit(7).alias("always"))
    assert rules.clean(df, compat=True).df.columns == rules.clean(df).df.columns == ["row_key", "nation"]
