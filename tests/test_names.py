import pytest

from sluicebox.functions.dates import dated_table, day_path, hour_name, parse_day, under
from sluicebox.functions.naming import check_distinct, column_name, keeps_path
from sluicebox.sources.layout import escape_value


@pytest.mark.parametrize(
    "path, name",
    [
        ("application.package_name", "package_name"),
        ("application.title", "app_title"),
        ("application.version_code", "app_version_code"),
        ("application.app_id", "app_id"),
        ("application.cognito_identity_pool_id", "cognito_identity_pool_id"),
        ("application.version_name", "app_version_name"),
        ("application.sdk.version", "sdk_version"),
        ("application.sdk.name", "sdk_name"),
        ("session.session_id", "session_id"),
        ("device.locale.country", "country"),
        ("device.locale.code", "device_locale_code"),
        ("device.locale.language", "language"),
        ("device.platform.version", "platform_version"),
        ("device.platform.name", "platform"),
        ("device.make", "make"),
        ("device.model", "model"),
        ("client.cognito_id", "cognito_id"),
        ("client.client_id", "client_id"),
        ("attributes.user_id", "user_id"),
        ("session.start_timestamp", "session_start_timestamp"),
        # Patterns match anywhere and their dots match any character.
        ("attributes.user_id_2", "user_id_2"),
        ("attributes.device_model", "attributes_model"),
        ("a.application_title.b", "a_app_title_b"),
        # Later rules see what earlier ones made.
        ("client.client.client_id", "client_client_id"),
        # Odd characters go, commas stay.
        ("q'x", "qx"),
        ("a-b", "ab"),
        ("a,b", "a,b"),
        ("d.o", "d_o"),
        ("abé", "ab"),
    ],
)
def test_column_name(path, name):
    assert column_name(path) == name


def test_locale_rule_can_be_mended():
    assert column_name("device.locale.code", fix_locale=True) == "locale"
    assert column_name("device.make", fix_locale=True) == "make"


@pytest.mark.parametrize(
    "path, kept",
    [
        ("a.b", True),
        ("a.B", False),
        ("A.b.c", False),
        ("a b", False),
        ("a\tb", False),
        ("a\u00a0b", False),
        ("abÉ", True),
        ("a-b", True),
    ],
)
def test_name_filter_looks_at_the_whole_path(path, kept):
    assert keeps_path(path) is kept


def test_colliding_names_are_an_error():
    check_distinct(["a", "b"], ["a", "b"])
    with pytest.raises(ValueError, match="platform"):
        check_distinct(["platform", "device.platform.name"], ["platform", "platform"])


def test_dates_and_paths():
    assert day_path("20180601") == "2018/06/01"
    assert hour_name(3) == "03"
    assert dated_table("test.user_info_test", "20180601") == "test.user_info_test_20180601"
    assert under("s3a://bucket/raw/", "2018/06/01", "00/") == "s3a://bucket/raw/2018/06/01/00"
    for wrong in ("2018-06-01", "20181301", ""):
        with pytest.raises(ValueError):
            parse_day(wrong)
    with pytest.raises(ValueError):
        hour_name(24)


def test_partition_values_are_escaped_as_spark_does(spark, tmp_path):
    values = ["c:d/e%", "plain", "a=b", "q'x", 'd"x', "[z]", "{y}", "x^y", "st*r?", "back\\slash", "h#", "é", "007"]
    rows = [(value, i) for i, value in enumerate(values)]
    spark.createDataFrame(rows, "et string, i int").write.partitionBy("et").json(str(tmp_path / "out"))
    found = {path.name for path in (tmp_path / "out").iterdir() if path.is_dir()}
    assert found == {f"et={escape_value(value)}" for value in values}
