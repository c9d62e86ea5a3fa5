"""Properties of NAM-1 on random names."""

import random

from ledgerlens.functions.names import normalize_name


def test_suffixes_spaces_and_marks_do_not_matter(spark):
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("bcdfghjkm\u00e9\u6f22") for _ in range(8)) + f" {i} zz" for i in range(200)]
    rows = [(x, rnd.choice(["", "  ", "\t"]) + x.replace(" ", rnd.choice([" ", "  ", " .", "-  "]))
             + (rnd.choice([" LTD", " plc", " Limited"]) if rnd.random() < 0.7 else "")) for x in plain]
    df = spark.createDataFrame(rows, "plain string, dressed string")
    for plain_name, once, twice in df.select("plain", normalize_name("dressed"), normalize_name(normalize_name("dressed"))).collect():
        assert once == plain_name and twice == once
