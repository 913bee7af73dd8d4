"""Several strings as one column and back."""

from pyspark.sql import functions as F

from martwright.functions.packing import ESCAPE, SEPARATOR, pack, packed_through, unpack

TEXTS = [None, "", "a", "b", ESCAPE, SEPARATOR, ESCAPE + "a", ESCAPE + "b", SEPARATOR + ESCAPE, ESCAPE * 2 + SEPARATOR * 2, "é\x00z"]


def test_any_texts_come_back(spark):
    three = [(x, y, z) for x in TEXTS for y in TEXTS for z in TEXTS]
    df = spark.createDataFrame(three, "x string, y string, z string")
    back = df.select(*"xyz", pack("xyz").alias("p")).select(*"xyz", *[unpack("p", i).alias(f"p{i}") for i in range(3)])
    got = [tuple(r) for r in back.collect()]
    assert len(got) == len(three) and all(r[:3] == r[3:] for r in got)
    # Packed rows differ where the rows do.
    assert df.select(pack("xyz").alias("p")).distinct().count() == len(three)


def test_bytes_that_are_no_text_come_back(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\x1f\xc3"), bytearray(b"\x1b\xe2"))], "x binary, y binary")
    df = df.select(*[F.col(c).try_cast("string").alias(c) for c in "xy"])
    back = df.select(pack("xy").alias("p")).select(*[F.hex(unpack("p", i)) for i in range(2)])
    assert tuple(back.first()) == ("FF1FC3", "1BE2")


def test_other_types_and_missing_columns_are_left_alone(spark):
    df = spark.createDataFrame([(1, "a", None, "k"), (2, None, "b", "k")], "n int, x string, y string, key string")
    seen = []

    def attach(rows):
        seen.append(rows.columns)
        return rows.withColumn("more", F.col("n") + 1)

    got = packed_through(df, ["y", "nope", "x", "n"], attach)
    assert seen == [["n", "key", "__packed"]] and got.columns == ["n", "x", "y", "key", "more"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", None, "k", 2), (2, None, "b", "k", 3)]
    assert packed_through(df, ["x"], attach).columns == ["n", "x", "y", "key", "more"] and seen[1] == df.columns
