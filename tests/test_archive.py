"""Path containment against the standard library's, recognised lines, and uploads that are turned away."""

import os
import random

from pyspark.sql import functions as F

from foliary.operators import archive


def test_contained_is_the_resolved_path(spark):
    rng = random.Random(4)
    part = lambda: rng.choice(["a", "b", "..", ".", "", "a-b"])
    rows = [("/" + "/".join(part() for _ in range(rng.randrange(4))), "/" + "/".join(part() for _ in range(rng.randrange(7)))) for _ in range(500)]
    rows += [("/a", "/ab"), ("/a", "/a"), ("/", "/x"), ("/a", None), (None, "/a"), ("/a", "a/b"), ("a", "a/b")]
    got = [r["x"] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, base string, target string").orderBy("k").select(archive.contained(F.col("base"), F.col("target")).alias("x")).collect()]

    def want(base, target):
        if not base or not target or base[0] != "/" or target[0] != "/":
            return False
        a, b = ("/" + os.path.normpath(p).lstrip("/") for p in (base, target))
        return b == a or b.startswith(a.rstrip("/") + "/")

    assert got == [want(*r) for r in rows]


def test_uploads(spark):
    uploads = spark.createDataFrame([(1, "t", "honor", "x.PNG"), (2, "t", "honor", "x.pdf"), (3, "t", "gold", "x.png"), (4, "t", "honor", "x.exe"), (5, "t", "honor", "../../../x.png"), (6, "u", None, "x.png"), (7, "u", "honor", "x.jpg")], "id long, tenant string, category string, file string")
    lines = spark.createDataFrame([(1, 0, 0, "MARK", 0.9), (1, 0, 1, "first page", None), (1, 1, 0, " MARK ", 0.8), (1, 1, 1, "second", 0.5), (1, 1, 2, "unsure", 0.49), (1, 1, 3, None, 0.9), (2, 0, 0, "MARK", 0.9), (3, 0, 0, "x", 0.9)], "id long, page_idx int, pos int, text string, score double")
    got = {r["id"]: r for r in archive.archived(uploads, lines, F.lit("/data")).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {1: None, 2: None, 3: "category", 4: "extension", 5: "path", 6: "category", 7: None}
    assert got[1]["text"] == "first page\nsecond" and got[2]["text"] == "MARK" and got[7]["text"] == "" and got[3]["text"] is None
    assert [got[k]["path"] for k in (1, 2, 7, 5)] == ["/data/t/honor/x.png", "/data/t/honor/x-1.png", "/data/u/honor/x.png", None]
