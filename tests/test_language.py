"""The condition and action languages, and the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import profile, roles
from tarnwell.plans import actions, dsl, rules

FACTS = {"name": "amount", "type": "float", "role": "numeric", "missing_pct": 0.15, "cleaning": {"x": {"y": 3}}, "formats": ["a", "b"], "note": None}


@pytest.mark.parametrize(("text", "want"), [
    ("role == 'numeric' and missing_pct > 0.1", True), ("not (role == 'numeric') or false", False), ("true or false and false", True), ("name in ['amount', 'x']", True), ("name not in ['amount']", False),
    ("name notin ['x']", True), ("'mou' in name", True), ("note is null", True), ("note is not null", False), ("note == null", True), ("note > 3", False), ("missing_pct between 0.1 and 0.2", True),
    ("missing_pct not between 0.1 and 0.2", False), ("note between 1 and 2", False), ("note not between 1 and 2", True), ("name like 'am%t'", True), ("name like 'AM_unt'", False), ("name ilike 'AM_unt'", True), ("name not like 'x%'", True),
    ("name =~ '^am'", True), ("name !~ '^am'", False), ("name ~* 'MOUNT$'", True), ("name !~* 'MOUNT$'", False), ("name =~ '('", False), ("cleaning.x.y >= 3", True), ("cleaning.z.y == null", True),
    ("icontains(name, 'MOU') and len(formats) == 2", True), ("similar('McDonalds', 'mcdonald')", True), ("iin('A', formats)", True), ("boolish_ratio(['yes', 'no', 'x', null]) == 0.5", True), ("to_number('1e3', 0) == 1000", True),
    ("unique_count(['a', 'a', null]) == 2", True), ("null_ratio([1, null]) == 0.5", True), ("all_matches([], 'a')", False), ("name == \"amo\\\"unt\"", False), ("type > 3", False),
])
def test_conditions_on_facts(text, want):
    assert dsl.compile_facts(text)(FACTS) is want


@pytest.mark.parametrize("text", ["", "a ==", "(a", "a == 1 b", "[1,", "nosuch(1)", "a == 1 == 2", "a @ b"])
def test_what_is_no_condition(text):
    with pytest.raises(dsl.ConditionError):
        dsl.compile_facts(text)
    with pytest.raises(dsl.ConditionError):
        dsl.compile_facts("other == 1", allowed={"name"})


def test_conditions_on_rows_and_facts_agree(spark):
    rows = [(i, s, x) for i, (s, x) in enumerate([("Alpha", 1.0), ("beta", None), (None, 3.0), ("", -1.0), ("12", 5.0)])]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    for text in ("x > 0", "not (x > 0)", "s == null", "s != 'beta'", "s in ['Alpha', '']", "s notin ['Alpha']", "x between 0 and 3", "x not between 0 and 3", "s ilike 'a%'", "s =~ 'a$'", "startswith(s, 'be') or x >= 5", "len(s) == 0", "is_numeric(s)", "lower(s) == 'alpha'", "iin(s, ['ALPHA'])", "isnull(x)", "similarity(s, 'alpa') >= 0.8"):
        test = dsl.compile_facts(text)
        assert [r.i for r in df.where(dsl.compile_column(text)).orderBy("i").collect()] == [i for i, s, x in rows if test({"s": s, "x": x})], text


def test_every_condition_function_is_there():
    assert len(dsl.FUNCTIONS) >= 51


def test_actions_parse():
    assert actions.parse_then("outliers('iqr', 3, iqr_multiplier=1.5, winsor_limits=[0.1, 0.9])").params == {"method": "iqr", "zscore_threshold": 3, "iqr_multiplier": 1.5, "winsor_limits": [0.1, 0.9]}
    call = actions.parse_then("impute(cleaning.impute.numeric)")
    assert call.bound({"cleaning": {"impute": {"numeric": "mean"}}}) == {"method": "mean"} and call.bound({}) == {"method": None}
    assert actions.parse_then("drop_column").params == {}
    for text in ("nosuch()", "clip(1, 2, 3)", "clip(lo=1, 2)", "clip(1", "clip(q=1)", "", "clip(1) x"):
        with pytest.raises(actions.ActionError):
            actions.parse_then(text)
    assert len(actions.ACTIONS) >= 35 and all(actions.parse_then(r.then) and dsl.compile_facts(r.when) for r in rules.RULES) and len(rules.RULES) == 39


def test_rules_clean_a_frame(spark):
    rows = [(1, "2024-01-02", " Chocolate ", "1,234", "-12.99", 25, "Yes", "1234"), (2, "2024-01-03", "vanilla", "25", "8", 80, "no", "00123"), (3, "2024-01-04", "CHOCOLATE", "100", "1,234.50", 100, "TRUE", "90210"), (4, "2024-01-05", "Vanilla ", "2,500", "0", 0, "0", "94-105"), (5, "2024-01-06", "chocolate", "0", "19.99", 50, "False", None)]
    df = spark.createDataFrame(rows, "order_id int, baked_at string, cake_type string, slices_sold string, price_usd string, percent_icing int, bool_returned string, zip_code string")
    by = {"order_id": "id", "baked_at": "time", "cake_type": "categorical", "slices_sold": "numeric", "price_usd": "numeric", "percent_icing": "numeric", "bool_returned": "bool", "zip_code": "text"}
    made = rules.clean(df, schema=roles.Schema("cakes", [roles.ColumnSchema(c, "string", r, 1.0) for c, r in by.items()]))
    got = {r.order_id: r for r in made.df.collect()}
    assert made.dropped == [] and got[1].slices_sold == 1234 and got[3].price_usd == 1234.5 and got[1].price_usd == 0  # prices aren't negative
    assert got[1].baked_at == dt.datetime(2024, 1, 2) and {r.cake_type for r in got.values()} == {"chocolate", "vanilla"}
    assert got[1].bool_returned is True and got[4].bool_returned is False and got[1].zip_code == "01234" and got[4].zip_code == "94105"
    assert all(r.percent_icing is None or 0 <= r.percent_icing <= 1 for r in got.values())
    report = made.report()
    assert report["columns"]["type_changes"]["price_usd"] == ["string", "float"] and report["rules"]["total_applications"] == len(made.hits)


def test_rules_drop_and_survive_what_fails(spark):
    df = spark.createDataFrame([(i, "x", None if i else 1.0, i % 3 + 0.5) for i in range(20)], "tmp_a int, c_hash string, empty double, v double")
    bad = [rules.Rule("bad", 200, "((", "drop_column()"), rules.Rule("worse", 199, "true", "nosuch()"), rules.Rule("fails", 198, "name == 'v'", "dt_part('year')")]
    made = rules.apply_rules(df, bad + [r for r in rules.RULES if r.then == "drop_column()"], {"tmp_a": "numeric", "c_hash": "text", "empty": "numeric", "v": "numeric"})
    assert made.df.columns == ["v"] and set(made.dropped) == {"tmp_a", "c_hash", "empty"}


def test_roles(spark):
    rows = [(i, i % 3, "YN"[i % 2], "abc"[i % 3], f"tok{i} of some length", dt.datetime(2024, 1, 1), 1.5 * i, str(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "order_id int, few int, is_active string, letter string, words string, event_timestamp timestamp_ntz, lat double, digits string")
    got = roles.propose(df).roles()
    assert got == {"order_id": "id", "few": "numeric", "is_active": "bool", "letter": "categorical", "words": "text", "event_timestamp": "time", "lat": "geo", "digits": "numeric"}
    schema = roles.propose(df, "d")
    for again in (roles.Schema.from_json(schema.to_json()), roles.Schema.from_toml(schema.to_toml())):
        assert again.roles() == schema.roles() and again.confidence == pytest.approx(schema.confidence, abs=1e-4)
    nested = '[[columns]]\nname = "a"\n[columns.role_confidence]\nrole = "time"\nconfidence = 0.9\n'
    assert roles.Schema.from_toml(nested).roles() == {"a": "time"}


def test_follow_ups(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "a"), ("2", "x", None), (None, "2024-01-03", "b")], "amount_str string, dt_str string, cat string")
    found = profile.facts(df)
    got = rules.follow_ups(roles.propose(df, found=found), found)
    assert "coerce_numeric()" in got["amount_str"] and "parse_datetime_robust()" in got["dt_str"] and "impute_value('Unknown')" in got["cat"]


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "2024-01-01"), (2.0, "2024-01-02"), (3.0, "bad"), (4.0, None)], "num double, dtstr string")
    got = profile.facts(df)
    assert got["num"]["mean"] == 2.5 and got["num"]["std"] == pytest.approx(1.2909944487) and got["num"]["iqr"] == 1.5 and got["dtstr"]["datetime_parse_ratio"] == pytest.approx(2 / 3)
    assert profile.facts(df.limit(0))["num"]["missing_pct"] == 0
    assert df.where(dsl.compile_column("num >= 3")).select(F.max("num")).first()[0] == 4
