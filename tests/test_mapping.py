import pytest

from kinfold.plans.mapping import UNMAPPED, HeaderMapper, compatibility, indel_ratio, previews, sample_row, select_columns, slug, validate

MAPPER = HeaderMapper()


@pytest.mark.parametrize(
    ("header", "target"),
    [("email_id", "email"), ("contact_no", "phone"), ("full_name", "name"), ("emp_code", "member_id"), ("user_handle", "username"), ("contact_email", "email"), ("Followers Count", "followers"), ("catalog_sku", "sku"), ("gtin_barcode", "barcode"),
     ("last_login", UNMAPPED), ("", UNMAPPED), ("warehouse_bay", UNMAPPED), ("system_metric_001", UNMAPPED), ("store_name", "name"), ("job_title", "role"), ("billing_address", "address"), ("offer_price", "price")],
)
def test_one_header(header, target):
    assert MAPPER.propose_one(header).suggested_canonical == target


def test_collisions_leave_one_winner():
    got = MAPPER.propose(["handle", "screen_name", "email"])
    assert got["handle"].is_ambiguous and got["screen_name"].is_ambiguous and not got["email"].is_ambiguous
    assert sorted(p.suggested_canonical for p in got.values()) == ["email", UNMAPPED, "username"]


def test_validation():
    assert validate({"a": "email"}, ["a"]) == []
    assert len(validate({"a": "nothing", "b": "name", "c": "name"}, ["a", "b"])) == 4


def test_compatibility():
    assert compatibility({"x": {"a": "email"}}) == (True, [])
    assert compatibility({"x": {"a": "email", "b": "phone"}, "y": {"c": "email"}, "z": {"d": "phone"}}) == (True, ["email", "phone"])
    assert compatibility({"x": {"a": "email"}, "y": {"b": "name"}}) == (False, [])


def test_slug_and_likeness():
    assert slug("  E-Mail  Address ") == "e_mail_address"
    assert indel_ratio("abc", "abc") == 100 and indel_ratio("", "a") == 0 and indel_ratio("abcd", "abxd") == 75


def test_sample_is_first_filled_row(spark):
    df = spark.createDataFrame([("", None), ("x@y.z", "n/a")], "mail string, note string").coalesce(1)
    assert sample_row(df) == [("mail", "x@y.z"), ("note", "n/a")]
    assert sample_row(df.where("mail = 'none'")) == []


def test_columns_to_look_at(spark):
    got = MAPPER.propose(["handle", "screen_name", "email", "warehouse_bay"])
    assert select_columns(got, "review") == ["handle", "screen_name"] and select_columns(got, "mapped", "mail") == ["email"] and "warehouse_bay" in select_columns(got, "unmapped") and len(select_columns(got)) == 4
    df = spark.createDataFrame([("a", None), ("b", "n/a"), ("c", "x"), ("d", "y")], "u string, v string").coalesce(1)
    assert previews(df) == {"u": ["a", "b", "c"], "v": ["x", "y"]}
    late = spark.range(5000).coalesce(1).selectExpr("if(id >= 4000, concat('v', id), ' ') as x", "cast(null as int) as `a.b`")
    assert previews(late) == {"x": ["v4000", "v4001", "v4002"], "a.b": []} and previews(late.limit(0))["x"] == []
