from pyspark.sql import functions as F

from lamella.sources.text_files import decoded


def test_charsets(spark):
    thai = "สวัสดีครับ ที่นี่"
    every = bytes([*range(0xA1, 0xDB), *range(0xDF, 0xFC)])
    cases = [
        (thai.encode(), "detect", thai), (b"\xef\xbb\xbf" + thai.encode(), "detect", thai), (thai.encode("cp874"), "detect", thai),
        ("“ไทย” … €5".encode("cp874"), "detect", "“ไทย” … €5"), ("ไทย\x81\x85".encode("iso8859_11"), "detect", "ไทย\x81\x85"),
        (every, "thai", every.decode("cp874")), ("caf\xe9".encode("latin-1"), "detect", "café"), (thai.encode("cp874"), "latin", thai.encode("cp874").decode("latin-1")), (b"", "detect", ""),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, content binary")
    for kind in ("detect", "thai", "latin"):
        got = {r.i: r.t for r in rows.select("i", decoded(F.col("content"), kind).alias("t")).collect()}
        for i, (_, k, want) in enumerate(cases):
            if k == kind:
                assert got[i] == want
