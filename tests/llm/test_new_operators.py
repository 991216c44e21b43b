"""Personal data, centroid clustering and source divergence against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliary.llm import divergence, personal_data, registry, yinyang

CLASH = "doc_id long, text string, lang string, source string, id string, spans string, label string, term string, n string, p string, value string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "s", "l", "t", "n", "p", "v") for r in rows], CLASH)


# ---- personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    """The patterns as they are written, kind by kind."""
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(only(m.group())) <= 19 and luhn(only(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(only(m.group())) <= 15]
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789  ..--@@+()ab é\n") for _ in range(rng.randrange(70)))
        assert personal_data.base_spans(text) == plain_spans(text), text
    cards = "4111 1111 1111 1111 4111-1111-1111-1111"
    assert personal_data.base_spans(cards) == plain_spans(cards)
    assert personal_data.base_spans("0001.002.255.0 1.2.3.256 1.2.3.4.5.6.7.8.9") == plain_spans("0001.002.255.0 1.2.3.256 1.2.3.4.5.6.7.8.9")


def test_base_spans_are_linear_in_the_text():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "a@" * 500_000, "+1" * 500_000, "+1 (" + " " * 1_000_000):
        personal_data.base_spans(text)  # a quadratic pattern would take hours


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    number = lambda: f"+1 ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    some = [(k, f"word {number()} word w{k}.x@mail{k % 9}.example.com word {rng.randrange(255)}.{rng.randrange(255)}.7.{rng.randrange(255)} on {rng.randrange(2000, 2030)} {rng.randrange(10**15)} 4111111111111111 x", "en", "s") for k in range(100, 220)]
    some += [(k, t[::1] + " and " + t, a, b) for k, t, a, b in some[:60]]
    own = [
        (1, None, "en", None), (2, "", "en", ""), (3, "Call +1 (377) 555-0271 today. Later dial 555-0271 or 377-555-0271.", None, "s"), (4, "only 555-0271 and 377-555-0271 here", "en", "s"),
        (5, "host 10.20.30.40, then 10-20-30-40; 10203040 is a sum", "en", "s"), (None, "a@b.c", "en", "s"), (None, "a@b.c", "en", "s"), (6, "漢字 é x@y.zz é", "en", "s"), (7, "9" * 30_000 + " " + "w1 " * 5_000 + "+49 30 1234567", "en", "s"),
    ]
    return frame(spark, own + some)


@pytest.fixture(scope="module")
def field(people):
    return personal_data.learn(people)


def test_personal_data_keeps_base_spans_and_adds_similar_words(people, field):
    got = personal_data.personal_data(people, field).collect()
    texts = [r["text"] for r in people.collect()]
    assert len(got) == len(texts)
    want = Counter(repr(plain_spans(t or "")) for t in texts)
    assert Counter(repr([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]) for r in got) == want
    by = {r["id"]: r["spans"] for r in got}
    said = {i: {t[s["start"] : s["end"]] for s in by[i] if not s["base"]} for i, t in ((3, texts[2]), (4, texts[3]), (5, texts[4]))}
    assert "555-0271" in said[3] and "377-555-0271" in said[3]
    assert said[4] == set()  # nothing in the text tells that it is a phone
    assert said[5] <= {"10-20-30-40"}  # eight digits in one are no address
    assert by[1] == by[2] == []
    for r in got:  # added spans never overlap base ones
        held = [(s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert not any(a < s["end"] and s["start"] < b for s in r["spans"] if not s["base"] for a, b in held)


def test_messages_are_exact_on_a_chain(field):
    """Without skip edges the passed marginals are those of summing over all labellings."""
    rows = np.stack([np.arange(12) * 7 + k for k in range(4)])
    free = np.zeros(4, int)
    near = np.array([True, True, True, False])
    got = field.marginals(rows, free, near, [], passes=60)
    score = field.unary[rows].sum(1)
    score[0] += field.chain[0]
    score[-1] += field.chain[:, 0]
    want, n = np.zeros((4, 7)), 7
    for code in range(n**4):
        y = [code // n**k % n for k in range(4)]
        w = np.exp(sum(score[k, y[k]] for k in range(4)) + sum(field.chain[y[k], y[k + 1]] for k in range(3)))
        for k in range(4):
            want[k, y[k]] += w
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_a_long_text_goes_in_sections(field, monkeypatch):
    text = "Call +1 (377) 555-0271. " + "year 2020 2021 w1 " * 40 + "dial 555-0271 now"
    (words,) = personal_data.words_of(pa.array([text]))
    whole = personal_data.added_spans(words, field)
    monkeypatch.setattr(personal_data, "SECTION", 10)
    assert [text[a:b] for _, a, b in personal_data.added_spans(words, field)] == [text[a:b] for _, a, b in whole] == ["555-0271"]


def test_links_over_sections_count(field, monkeypatch):
    """Similar and neighbouring words are linked however far apart, and observed ones of several kinds all count."""
    rows = np.arange(30)[:, None] * 11 + np.arange(3)
    free, near = np.zeros(30, int), np.arange(30) < 29
    similar = [[0, 25], [3, 17, 29]]
    whole = field.marginals(rows, free, near, similar)
    monkeypatch.setattr(personal_data, "SECTION", 7)
    assert np.allclose(field.marginals(rows, free, near, similar), whole, atol=1e-6)
    label, apart = np.zeros(30, int), np.zeros(30, bool)
    label[[4, 9]] = personal_data.PHONE, personal_data.CARD
    one, two = (field.marginals(rows, label, apart, [places])[20] for places in ([4, 9, 20], [9, 4, 20]))
    assert np.allclose(one, two)


def test_personal_data_of_nothing(spark, people):
    none = frame(spark, [])
    model = personal_data.learn(none)
    assert personal_data.personal_data(none, model).collect() == []
    assert all(s["base"] for r in personal_data.personal_data(people, model).collect() for s in r["spans"])


def test_op11_query_derives_its_columns(spark):
    rows = registry.QUERIES["op11_pii"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x[0] for x in base) for k in personal_data.KINDS]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


# ---- centroid clustering


def lloyd(vectors, k, rounds, width):
    """All distances of all vectors, with Python's whole numbers."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(cs)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), cs


@pytest.mark.parametrize(("k", "group", "rounds"), [(13, 3, 6), (40, 10, 5), (1, 10, 2), (500, 10, 1)])
def test_yinyang_is_lloyd(spark, k, group, rounds):
    rng = np.random.default_rng(k)
    middle = rng.normal(0, 1, (9, 6))
    vectors = [(i, (middle[i % 9] + rng.normal(0, 0.4, 6)).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(i, [0.25, -0.25, 0.0, 0.0, 0.5, 1.0]) for i in range(300, 320)]  # ties
    vectors += [(3, [1.0] * 6), (None, [2.0] * 6), (None, [2.0] * 6), (400, None), (401, [1.0] * 5), (402, []), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("nan")] * 6), (405, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in vectors], "vec_id long, embedding array<float>, cluster string, id string").repartition(3)
    found, centroids = yinyang.yinyang(df, k=k, rounds=rounds, width=6, group=group)
    want, cs = lloyd(vectors, k, rounds, 6)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert centroids.tolist() == cs


def test_yinyang_leaves_most_distances_out():
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 400, (40, 16))
    x = (middle[rng.integers(0, 40, 4000)] + rng.normal(0, 30, (4000, 16))).astype(np.int64)
    cs, before, scanned = x[:40].copy(), None, []
    groups = yinyang.groups_of(cs)
    own, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros((len(x), groups.max() + 1))
    for _ in range(6):
        step = yinyang.Round(cs, groups, before)
        own, upper, lower = step.assign(x, own, upper, lower)
        assert (own == yinyang.squared(x, cs).argmin(1)).all()
        scanned.append(step.scanned)
        sums = yinyang._sums(x, own, 40)
        before, cs = cs, np.where(sums[:, :1] > 0, sums[:, 1:] // np.maximum(sums[:, :1], 1), cs)
    assert scanned[0] == 40 * len(x) and scanned[-1] < scanned[0] / 3


def test_yinyang_distances_stay_whole_beyond_doubles():
    x = np.array([[(1 << 26) + 1, 3], [1, 2]], np.int64)
    assert yinyang.squared(x, x)[0, 1] == (1 << 52) + 1


def test_yinyang_of_nothing_and_of_too_large(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert yinyang.yinyang(none)[0].collect() == []
    large = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="would not fit"):
        yinyang.yinyang(large)


# ---- source divergence


def plain_divergence(rows, least=3, ranks=200):
    """Every kept term for every pair, without supports."""
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(la or "", so or "", terms.findall((te or "").translate(low))) for _, te, la, so in rows]
    seen, n, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for la, so, words in docs:
        seen[la].update(set(words))
        n[la, so].update(words)
        whole[la].update(words)
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for la, so in {d[:2] for d in docs}:
        kept = sorted(t for t, c in seen[la].items() if c >= least)
        p = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[x] for x in kept) + len(kept)) for t in kept}
        own, all_ = p(n[la, so]), p(whole[la])
        found = [("pair", b, sum(f(own[t], q[t]) for t in kept)) for b in {d[1] for d in docs if d[0] == la and d[1] != so} for q in [p(n[la, b])]]
        found += [("term", t, f(own[t], all_[t])) for t in kept if n[la, so][t] and own[t] > all_[t]]
        for part, some in groupby(sorted(found, key=lambda x: (x[0], -x[2], x[1].encode())), key=lambda x: x[0]):
            out += [(la, so, part, item, value, k) for k, (_, item, value) in enumerate(some, 1) if part == "pair" or k <= ranks]
    return sorted(out)


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(6)
    words = [f"w{a}{b}".translate(str.maketrans("0123456789", "abcdefghij")) for a in range(30) for b in range(10)] + ["Été", "漢字", "ÉTÉ", "x"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([20, 100, 304])]) for _ in range(n))
    rows = [(k, text(rng.randrange(1, 60)), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"])) for k in range(120)]
    rows += [(200, None, "en", "empty"), (201, "", "xx", "a"), (202, "12 34 _", "xx", "b"), (203, "lone", "yy", "a"), (204, "A-b1c", "en", "a"), (None, "same Same", "zz", "s"), (None, "same Same", "zz", "s"), (None, "same Same", "zz", "t")]
    return [*rows, (300, "long " * 30_000, "en", "b")]


def test_divergence_is_the_dense_sum(spark, audited):
    got = divergence.source_divergence(frame(spark, audited).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(audited)


def test_divergence_in_small_blocks_and_ranks(spark, audited, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 50)
    monkeypatch.setattr(divergence, "FLUSH", 40)
    got = divergence.source_divergence(frame(spark, audited).repartition(3), ranks=4)
    assert sorted(map(tuple, got.collect())) == plain_divergence(audited, ranks=4)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, [])).collect() == []


def test_shares_of_large_counts(spark):
    n, total = 9_000_000_001, 9_100_000_000
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(5))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + 5)
