"""Level dictionaries of wide columns next to plain counts."""
from collections import Counter

from pyspark.sql import functions as F

from leadvane.operators import dictionary


def test_many_levels_with_a_heavy_one(spark):
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 1, None).when(F.col("id") % 103 == 2, "  ")
                               .otherwise(F.concat(F.lit("v"), F.floor(F.col("id") / 5))).alias("c"))
    rows = [(r.id, r.c) for r in df.collect()]
    counts = Counter(c for _, c in rows if c and c.strip())
    known = dictionary.level_dictionary(df, "c", 3)
    got = {r.level: (r.n, r.id, r.heavy) for r in known.collect()}
    order = sorted(((-k, c) for c, k in counts.items() if k >= 3))
    assert got == {c: (-k, i + 2, -k * 1000 > n) for i, (k, c) in enumerate(order)} and len(got) > 5000
    assert [c for c, v in got.items() if v[2]] == ["hot"]
    new = df.union(spark.createDataFrame([(n + 1, "never seen"), (n + 2, "missing")], "id long, c string"))
    ids = {r.id: r.level for r in dictionary.encode_ids(new, "c", known, "level").collect()}
    assert len(ids) == n + 2 and ids[n + 1] == dictionary.OTHER_ID
    for i, c in rows:
        assert ids[i] == (dictionary.MISSING_ID if not c or not c.strip() else got[c][1] if c in got else dictionary.OTHER_ID)
