from pyspark.sql import functions as F

from netloom.functions import text


def _map(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_shorthand(spark):
    got = _map(spark, text.expand_shorthand, ["4R7", "1k2", "3V3", "1A5", "33V", "60V", "10k"])
    assert got == ["4.7Ω", "1.2kΩ", "3.3V", "1.5A", "3.3V", "60V", "10k"]


def test_clean_reading(spark):
    assert _map(spark, text.clean_reading, [" 4 R 7\n", "0..1", "###a", "", "1k2"]) == ["4.7Ω", "0.1", "", "", "1.2kΩ"]


def test_netlist_values(spark):
    got = _map(spark, text.netlist_value, [None, "220Ω", "10kΩ", "4.7MΩ", "10μF", "1K", "±15V"])
    assert got == ["1", "220", "10k", "4.7Meg", "10u", "1", "±15V"]


def test_variants(spark):
    got = _map(spark, lambda c: F.transform(text.variants(c), lambda v: v["value"]), ["10H", "22k"])
    assert got == [["10H", "10kΩ", "10MΩ", "10Ω"], ["22k", "2.2k", "22kΩ"]]


def test_fits(spark):
    rows = [("10k", "Resistor", "10kΩ"), ("33", "V-DC", "3.3V"), ("x", "GND", None), ("5V", "Diode", "5V"), ("5V", "Resistor", None)]
    df = spark.createDataFrame(rows, "v string, n string, want string")
    assert all(r.got == r.want for r in df.select("want", text.fits(F.col("v"), F.col("n")).alias("got")).collect())


def test_json_extraction(spark):
    got = _map(spark, lambda c: text.first_json(text.strip_fences(c)), ['```json\n{"a":{"b":1}}\n```', '{"a":{"b":1}} tail', '{"a":1', "hello", '[1,[2]] x]', "```\n"])
    assert got == ['{"a":{"b":1}}', '{"a":{"b":1}}', "", "hello", "[1,[2]]", ""]


def test_led_saturation(spark):
    assert _map(spark, text.led_saturation, ["red, Vf=2.0V", None, "vf: 1.5", "Vf=1.2.3"]) == ["1e-15", "1e-15", "1e-14", "1e-15"]


def test_sequences(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 2],), ([0],), ([3, 3],)], "ids array<int>")
    assert [r[0] for r in df.select(text.decode(F.col("ids"))).collect()] == ["001", "", "2"]
    assert _map(spark, text.encode, ["01é", "é", ""]) == [[1, 2], [0], [0]]
