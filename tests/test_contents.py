"""Ratios, findings and packs against what the standard library and plain loops say."""

import difflib
import random
import re
import unittest.mock

from foliary.functions import text as T
from foliary.operators import files, packs, rules, templates
from foliary.plans import contents, records


def same(a, b, pages_a, pages_b):
    a, b = (re.sub(r"\s+", "", x or "")[:20_000] for x in (a, b))
    if not a and not b:
        return pages_a == pages_b
    if not a or not b or abs(pages_a - pages_b) > 2:
        return False
    return difflib.SequenceMatcher(None, a, b).ratio() >= 0.85


def test_same_content_is_the_ratio_of_text_without_spacing(spark):
    rng = random.Random(2)
    letters = "".join(chr(0x4E00 + k) for k in range(900))
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(None, 1, "", 1), ("", 1, " \n", 2), ("x", 1, "", 1), ("a b", 1, "ab", 3), ("a b", 1, "ab", 4), ("ab" * 150, 1, "ba" * 150, 1), ("ab" * 90, 1, "ba" * 90, 1)]
    for n in (30, 150, 400, 21_000):
        base = text(n)
        for share in (0.05, 0.12, 0.16, 0.3):
            edited = "".join(rng.choice(letters) if rng.random() < share else c for c in base)
            pairs += [(base, 1, edited, 1), (" ".join(base), 2, edited + "\n", 1), (base, 1, base[: int(n * (1 - share))], 1)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id long, a_text string, a_pages int, b_text string, b_pages int")
    got = {r["id"]: r["same"] for r in files.same_content(rows).collect()}
    want = {k: same(a, b, pa, pb) for k, (a, pa, b, pb) in enumerate(pairs)}
    assert got == want and {True, False} == set(want.values())
    # From 200 characters on frequent ones are left aside, as by default: a shifted copy of two letters is unlike.
    assert want[5] is False and want[6] is True


def test_a_rare_tail_asks_no_library():
    """a copy that is cut and ends in a row of one rare letter is settled by what both begin with."""
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(90)] + ["xylograph", "quick", "jazz"]
    base = "".join(rng.choice(words) for _ in range(3_000))
    assert difflib.SequenceMatcher(None, base[:14_000], base[:12_000] + "z" * 49).ratio() >= 0.85
    with unittest.mock.patch.object(files.difflib, "SequenceMatcher", side_effect=AssertionError):
        assert files.alike(base[:14_000], base[:12_000] + "z" * 49, 0.85)
        assert files.alike(base[:12_000] + "z" * 49, base[:14_000], 0.85)


def test_the_first_block_is_the_librarys():
    rng = random.Random(6)
    said = set()
    for _ in range(400):
        size, kinds = rng.choice([5, 30, 150, 250, 400]), rng.choice([2, 5, 20, 60, 300])
        letters = [chr(0x4E00 + k) for k in range(kinds)]
        base = rng.choices(letters, [1 / (k + 1) for k in range(kinds)], k=size)
        other = list(base)
        for _ in range(rng.choice([1, 3])):
            at, start = rng.randint(size * 6 // 10, size), rng.randrange(size)
            other[at:at] = rng.choice([[], [rng.choice(letters + ["z"])] * rng.randrange(30), base[start : start + 30]])
            other[at : at + rng.randrange(8)] = []
        a, b = rng.sample(["".join(base), "".join(other)], 2)
        head = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        found = difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b))
        got, want = files._starts_with_head(a, b, head), (found.a, found.b, found.size) == (0, 0, head)
        assert want or not got or not head, (a, b)
        assert files.alike(a, b, 0.85) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.85), (a, b)
        said.add((got, want))
    assert said == {(True, True), (False, False)}


def test_registered_pairs_are_the_standard_librarys(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r["same"] for r in contents.i4_ratio_content(spark, "/root/testdata/sf0.001").collect()}
    for k, text in docs.items():
        if len(text) < 4_000:
            cut = text[: int(len(text) * (60 + k % 40) / 100)]
            assert got[k] == same(text, cut.replace(" ", "  ") + " " + "z" * (k % 50), 1, 1 + k % 4), k
    assert len(got) == len(docs) and 0 < sum(got.values()) < len(got)


def test_i6_multiline_changes(spark):
    pairs = [("a\nb\nc", "a\nB\nc"), ("a\nb", "b\na"), ("", "x"), ("x\ny", ""), ("a\n" * 300, "a\n" * 299 + "b"), ("same", "same"), ("one", "two")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id int, a string, b string")
    from pyspark.sql import functions as F

    got = {r["id"]: r["n"] for r in rows.select("id", templates.changes(F.col("a"), F.col("b")).alias("n")).collect()}
    count = lambda a, b: sum(x.startswith(("+", "-")) and not x.startswith("+++") for x in difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm=""))
    assert got == {k: count(a, b) for k, (a, b) in enumerate(pairs)}


def test_comparison_has_every_kind_of_finding(spark):
    name = "p string, chapter string, pos int, text string"
    parsed = spark.createDataFrame([("x", "01-投标函", 0, "a"), ("x", "01-投标函", 1, "b"), ("x", "02-other", 0, "same"), ("x", "03-lone", 0, "z"), ("x", "04-marks", 0, "{{n}}"), ("x", "05-long", 0, "1\n2\n3\n4\n5"), ("x", "06-table", 0, "| a |\n|---|\n| b |")], name)
    template = spark.createDataFrame([("x", "t1", 0, "a!"), ("x", "t1", 1, "b!"), ("x", "t2", 0, "same"), ("x", "t4", 0, "{{n}} {{m}}"), ("x", "t5", 0, "6\n7\n8\n9"), ("x", "t6", 0, "| a |\n|---|"), ("x", "unused", 0, "u"), ("y", "unused", 0, "u")], name)
    named = spark.createDataFrame([("x", "01-投标函", "t1"), ("x", "02-other", "t2"), ("x", "03-lone", None), ("x", "04-marks", "t4"), ("x", "05-long", "t5"), ("x", "06-table", "t6"), ("x", "07-absent", "t2")], "p string, chapter string, template string")
    got = sorted((tuple(r) for r in templates.comparison(named, parsed, template, "p").collect()), key=repr)
    assert got == sorted([
        ("x", "01-投标函", "paragraph", 0, 3, "high", "update", False, False), ("x", "01-投标函", "paragraph", 1, 3, "high", "replace", False, True),
        ("x", "03-lone", "unmatched", None, None, "high", "manual_review", False, False), ("x", "unused", "unmatched", None, None, "high", "keep", False, False), ("y", "unused", "unmatched", None, None, "high", "keep", False, False),
        ("x", "04-marks", "mechanical", None, None, "high", "update", True, False), ("x", "04-marks", "paragraph", 0, 3, "high", "update", False, False), ("x", "05-long", "paragraph", 0, 10, "low", "update", False, False),
        ("x", "06-table", "mechanical", None, None, "high", "manual_review", True, False), ("x", "06-table", "paragraph", 0, 2, "high", "update", False, False),
    ], key=repr)


def test_the_packaged_pack_is_the_expressions(spark):
    lines = ["投标文件不超过50页，保证金 3.5 万元", "服务期限为 12 个月，近3个月社保", "正本1份副本 4份", "社会保险缴纳满 6 个月 期限 6 个月", "金额 12元 12元", "无", " ", None, "控制在 3 页 不得超过4页", "质保 2年 预算100万元"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "id int, text string")
    got = sorted((r["id"], r["kind"], r["value"]) for r in packs.packed_constraints(rows, packs.pack(spark), ["id"]).collect())
    assert got == sorted((r["id"], r["kind"], r["value"]) for r in rules.constraint_rows(rows, ["id"]).collect())
    assert len(got) > 12 and {k for _, k, _ in got} == set(T.CONSTRAINTS)


def test_literals_only_spare_work(spark):
    rng = random.Random(1)
    own = (packs.Rule("a", "A", r"x(\d+)y?", None, ("x",), "{1}"), packs.Rule("b", "B", r"xz|yz", "q", ("xz", "yz")), packs.Rule("c", "C", r"(\d)(\d)?", None, (), "{2|1}"), packs.Rule("d", "D", r"zx\dq", None, ("zx",)))
    bare = tuple(packs.Rule(r.kind, r.label, r.pattern, r.hint, (), r.value) for r in own)
    lines = ["".join(rng.choice("xyzq12 ") for _ in range(rng.randrange(20))) for _ in range(400)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "id int, text string")
    said = lambda pack: sorted(map(tuple, packs.packed_constraints(rows, packs.pack(spark, pack), ["id"]).collect()))
    assert said(own) == said(bare) and {r[1] for r in said(own)} == {"a", "b", "c", "d"}


def test_alike_is_the_librarys_ratio():
    rng = random.Random(12)
    for k in range(600):
        chars = ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzABCDEFG0123456789" + "".join(map(chr, range(0x4E00, 0x4F00))))[k % 3]
        a = "".join(rng.choices(chars, k=rng.randrange(500)))
        b = a[: rng.randrange(len(a) + 1)] + rng.choice(chars) * rng.randrange(30) if k % 2 else "".join(c for c in a if rng.random() < 0.9)
        for x, y in ((a, b), (b, a)):
            assert files.alike(x, y, 0.85) == (difflib.SequenceMatcher(None, x, y).ratio() >= 0.85)


def test_texts_are_shortened_once(spark):
    """Each mention of a text in the plan made it anew."""
    pairs = spark.createDataFrame([("a b" + chr(0x3000) + "c", 1, "abc", 1)], "a_text string, a_pages int, b_text string, b_pages int")
    found = files.same_content(pairs)
    assert found.first()["same"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


def test_unlike_long_texts_take_no_blocks():
    """Nor do copies that are cut."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) + rng.choice(",;.QXZ") for _ in range(3000)]
    a, b = ("".join(rng.choices(words, k=2000)) for _ in range(2))
    with unittest.mock.patch.object(files.difflib, "SequenceMatcher", side_effect=AssertionError):
        assert not files.alike(a, b, 0.85)
        assert files.alike(a, a[:10000], 0.85)


def test_equal_files_are_equal_to_their_ends(spark, tmp_path):
    """texts with the same first 20,000 characters were equal, whatever came after."""
    long = "ab c\n" * 7_000
    texts = {3: long + "x", 5: long + "y", 9: long + "x", 11: long.replace(" ", "  ") + "x\n", 15: "", 17: " ", 21: "a", 23: ""}
    spark.createDataFrame([(k, "en", texts.get(k, "t")) for k in range(24)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, records.c12_equal_files(spark, str(tmp_path)).collect()))
    bare = {k: "en" if k % 2 == 0 else re.sub(r"\s", "", texts.get(k, "t")) for k in range(24)}
    assert got == [(a, b) for a in range(24) for b in range(a + 1, 24) if a // 3 == b // 3 and bare[a] == bare[b]]
    assert (9, 11) in got and (15, 17) in got and (3, 5) not in got


def test_the_ratio_is_of_whole_texts(spark):
    """texts with the same first 20,000 characters were alike, whatever came after."""
    rng = random.Random(8)
    text = lambda n, first: "".join(chr(first + rng.randrange(900)) for _ in range(n))
    base = text(20_000, 0x4E00)
    pairs = [(base + text(20_000, 0x5600), base + text(20_000, 0x5E00)), (base + text(9_000, 0x5600), base), (base + text(5_000, 0x5600), base), (text(300, 0x5600) + base + text(5_000, 0x5E00), base)]
    rows = spark.createDataFrame([(k, a, 1, b, 1) for k, (a, b) in enumerate(pairs)], "id int, a_text string, a_pages int, b_text string, b_pages int")
    got = {r["id"]: r["same"] for r in files.same_content(rows).collect()}
    assert got == {k: difflib.SequenceMatcher(None, a, b).ratio() >= 0.85 for k, (a, b) in enumerate(pairs)} == {0: False, 1: False, 2: True, 3: True}


def test_registered_long_pairs_are_the_standard_librarys(spark, tmp_path):
    """of a text of over 20,000 characters and a copy that is cut behind them, both beginnings were the same."""
    rng = random.Random(9)
    texts = {k: " ".join("".join(rng.choices("etaoinshrdlu", [9, 8, 7, 6, 5, 4, 3, 2, 2, 1, 1, 1], k=6)) + rng.choice("XQ;:") for _ in range(4_000)) for k in (10, 14, 38)}
    spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["same"] for r in contents.i4_ratio_content(spark, str(tmp_path)).collect()}
    bare = {k: t.replace(" ", "") for k, t in texts.items()}
    other = {k: t[: int(len(t) * (60 + k % 40) / 100)].replace(" ", "") + "z" * (k % 50) for k, t in texts.items()}
    want = {k: k % 4 < 3 and difflib.SequenceMatcher(None, bare[k], other[k]).ratio() >= 0.85 for k in texts}
    assert got == want == {10: False, 14: True, 38: True} and min(map(len, bare.values())) > 20_000
