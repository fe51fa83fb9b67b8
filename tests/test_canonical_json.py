import json
import math
import random
import struct

from pyspark.sql import functions as F

from tessella.functions.canonical_json import canonical_json

TEXTS = [
    "{}", "[]", ' { "b" : [ ] , "a" : { } } ', "3", "-0", "-0.0", "0e5", "true", "null", '"x"', '""', "[[[1],2],{}]",
    '{"b":1,"a":{"d":null,"c":[true,false]}}', '{"10":1,"9":2,"":3,"A":4,"a":5,"_":6}',
    r'"\u001F\u007f\/\b\f\n\r\t\"\\ \\u001F \\\\u00e9"', '"é ß 中 😀   \u007f"', r'"😀 \\ud800"',
    '{"！":1,"😀":2,"z":3,"￿":4,"￿😀":5,"￿ ":6}', '{"k":{"！":1,"😀":{"￿":1,"a😀":2,"a":3}}}',
    '{"|":1,"1|":"2|","s":"|1|"}', r'["12|", 12, "\"12|", -12, 0, -0, "\\", "|", "\"|"]', r'{"a\"1|":"|","b":[1,2.50,"c"]}', "1234567890123456789012345678901234567890123456789", "1.50", "4.0", "1e5", "1E+2", "1e16",
    "123456789012345680.0", "1e-4", "0.0001", "0.00001", "1.5e-7", "1e22", "1e23", "5e-324", "4.9e-324", "2.4703282292062328e-324",
    "1.7976931348623157e308", "1e309", "-1e999", "1e-999", "0.1000000000000000055511151231257827", "9007199254740993.0",
    "0.30000000000000004", "2.2250738585072014e-308", "100000000000000000000000.0", "999999999999999999.9", "1e00000000005",
    "[" * 200 + "]" * 200,
    json.dumps({"t": 'line "quoted" \\ ' * 20000, "n": list(range(2000))}),
]
BROKEN = ["", " ", "{", '{"a":1,}', "{1:2}", "[01]", "[1.]", "[.5]", "[+1]", "NaN", '{"a":1,"a":2}', r'{"a":1,"a":2}', r'"\ud800"', r'"\ude00\ud83d"', None]


def python_form(text, without=()):
    value = json.loads(text)
    if without:
        value = {k: v for k, v in value.items() if k not in without}
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def spark_forms(spark, texts, without=()):
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = frame.select("k", canonical_json(F.col("t"), without).alias("c")).collect()
    return [r["c"] for r in sorted(rows)]


def test_equals_python(spark):
    for text, got in zip(TEXTS, spark_forms(spark, TEXTS), strict=True):
        assert got == python_form(text), text[:80]


def test_no_value(spark):
    assert spark_forms(spark, BROKEN) == [None] * len(BROKEN)
    assert spark.createDataFrame([], "t string").select(canonical_json(F.col("t"))).collect() == []


def random_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 0:
        number = struct.unpack("d", rng.randbytes(8))[0]
        return number if math.isfinite(number) else 0.5
    if kind == 1:
        return rng.choice([rng.uniform(-10, 10), round(rng.uniform(0, 1e6), 3), rng.random() * 10.0 ** rng.randrange(-8, 20)])
    if kind == 2:
        return rng.randrange(-(10**rng.randrange(1, 40)), 10**20)
    if kind < 5:
        return "".join(rng.choice('ab"\\/\n\t\x00\x1f\x7fé߿￿😀\U0010ffff|') for _ in range(rng.randrange(6)))
    if kind == 5:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {"".join(rng.choice("ab|￿😀\n") for _ in range(rng.randrange(4))): random_value(rng, depth + 1) for _ in range(rng.randrange(6))}


def test_random_values_equal_python(spark):
    rng = random.Random(5)
    texts = [json.dumps(random_value(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(1500)]
    for text, got in zip(texts, spark_forms(spark, texts), strict=True):
        assert got == python_form(text), text


def test_long_decimals_equal_python(spark):
    rng = random.Random(6)
    texts = [f"{rng.randrange(10**rng.randrange(1, 30))}.{rng.randrange(10**rng.randrange(1, 30))}e{rng.randrange(-30, 30)}" for _ in range(1500)]
    for text, got in zip(texts, spark_forms(spark, texts), strict=True):
        assert float(got) == float(text) and len(got) <= len(python_form(text)), text


def test_outer_keys_dropped(spark):
    texts = ['{"b":1,"a":{"b":2},"é":1.0}', '{"b":1}', '{"c":null}']
    assert spark_forms(spark, texts, ("b", "é")) == [python_form(t, ("b", "é")) for t in texts]
    assert spark_forms(spark, ["[1]", "3", None], ("b",)) == [None] * 3


def test_stays_in_the_jvm(spark):
    plan = spark.range(3).select(canonical_json(F.lit('{"a":1}').substr(F.lit(1), F.col("id").cast("int")), ("b",)))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Exchange" not in text


def test_plain_texts_take_the_short_way(spark):
    texts = ['{"b": [1, -0, true, null, {}], "a": {"z": "x:1.5", "y": "12e3"}}', '{"d": "sha256:1e5", "c": 123456789012345678}',
             '[9223372036854775808, 1]', '{"a": 1.50}', '{"a":[1,2e3]}', '{"a": "\x7f"}', '{"a" : 01}', "7", '{"a": 1, "a": 2}', '{"a": -5 }\n']
    from tessella.functions import canonical_json as module

    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", module._plain(F.col("t")).alias("plain"), canonical_json(F.col("t")).alias("c"))
    rows = {r["t"]: r for r in frame.collect()}
    for text in texts:
        bad = text in ('{"a" : 01}', '{"a": 1, "a": 2}')
        assert rows[text]["c"] == (None if bad else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))), text
    assert rows[texts[1]]["plain"] and not any(rows[t]["plain"] for t in texts[2:6])
