"""Personal data (11): patterns, and a skip-chain conditional random field that carries their labels to similar tokens.

Patterns find emails, addresses, cards and phones; they are the base. A field over the words of a document adds to them:
a word's label depends on its shape, on the labels of its neighbours (chain) and on those of words that say the same
elsewhere in the document, in another spelling too (skip edges: the same digits, or the same local part of an email).
Loopy message passing over both kinds of edges gives each word's marginals, so a number that is written out as a phone
once is one where only its end stands. Words without a digit or @ are never personal data: they are observed, and so
are words of base spans, which keeps the field small. Its weights are learned here, by pseudo-likelihood on base spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Labels of words: outside, the two kinds within a word, first and further words of the others; and each label's kind.
OUT, EMAIL, IP, CARD, CARD_MORE, PHONE, PHONE_MORE = range(7)
LABELS, KIND_OF = 7, np.array([-1, 0, 1, 2, 2, 3, 3])
FIRST_LABEL = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
MORE_LABEL = {"email": EMAIL, "ip": IP, "card": CARD_MORE, "phone": PHONE_MORE}
#: Rows that the weights are learned from, bytes of such a text and its words in question at most; hashed features.
SAMPLE, SAMPLE_TEXT, SAMPLE_WORDS, WIDTH = 2000, 1 << 16, 500, 1 << 12
#: Rounds of learning and of message passing, share of the old message, edges passed at once, marginal of an added word.
ROUNDS, PASSES, DAMPING, SECTION, SURE = 200, 10, 0.3, 100_000, 0.5

# The base patterns. Possessive repeats and lookups by @ keep them linear in a text's length.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS, ADDRESS = re.compile(r"[0-9][0-9.]*+"), re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Marks around a word that aren't part of a span.
MARKS = ",;:!?.\"'<>[]{}*#$%&=|"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def small(part: str) -> bool:
    """At most 255, however many zeros come first."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap within a kind; failing ones are dropped."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        if tail := DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = tail.end()
                out.append(("email", start, last))
        at = text.find("@", at + 1)
    for run in NUMBERS.finditer(text):
        if run.group().count(".") > 2:
            out += [("ip", run.start() + m.start(), run.start() + m.end()) for m in ADDRESS.finditer(run.group()) if all(map(small, m.group().split(".")))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() > 12 and 13 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in DIAL.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def shape(word: str) -> str:
    """Digits as 9, ASCII letters as a, others beyond ASCII as u, repeats once, marks as they are."""
    kinds = ["9" if "0" <= c <= "9" else "a" if c.isascii() and c.isalpha() else c if c.isascii() else "u" for c in word[:64]]
    return "".join(c for k, c in enumerate(kinds) if not k or c != kinds[k - 1])


def features(word: str, digits: str, run_digits: str, run_first: str) -> list[int]:
    """Hashed features of a word: its shape and borders, and digits of the run of words in question that it is in."""
    parts = word.strip(",;:!?.\"'").split(".")
    address = len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)
    said = (
        f"shape {shape(word)}", f"first {shape(word[:1])}", f"last {shape(word[-1:])}", f"digits {min(len(digits), 20)}",
        f"at {'@' in word} {'.' in word.rpartition('@')[2]}", f"letters {any(c.isalpha() for c in word[:256])}", f"address {address}",
        f"luhn {13 <= len(digits) <= 19 and luhn(digits)}", f"run luhn {13 <= len(run_digits) <= 19 and luhn(run_digits)}",
        f"run {min(len(run_digits), 24)} {run_first}", f"dots {min(word.count('.'), 5)}", "bias",
    )
    return [zlib.crc32(x.encode()) % WIDTH for x in said]


def similar_key(word: str, digits: str) -> str | None:
    """What words that say the same have in common: the local part of an email, the four numbers of an address, or the
    last seven digits."""
    if "@" in word:
        return "@" + word.lstrip("(<[\"'").partition("@")[0].lower() if word[0] != "@" else None
    if len(digits) < 13 and len(parts := NOT_DIGIT.split(word.strip(MARKS))) == 4 and all(parts) and all(map(small, parts)):
        return ".".join(parts)
    return digits[-7:] if len(digits) >= 7 else None


class Words:
    """The words in question of one text, those with a digit or @, with all that the field needs of them."""

    def __init__(self, text: str, spans: np.ndarray, number: np.ndarray):
        """spans: start and end of each word in code points; number: its place among all words of the text."""
        self.spans, self.number = spans, number
        self.words = [text[a:b] for a, b in spans.tolist()]
        self.digits = [NOT_DIGIT.sub("", w) for w in self.words]
        self.base = base_spans(text)
        self.next_is_near = np.append(np.diff(number) == 1, False) if len(number) else np.zeros(0, bool)
        self.label = np.full(len(number), OUT)
        for kind, a, b in reversed(self.base):  # the first kind has the last word
            i, j = np.searchsorted(spans[:, 1], a, "right"), np.searchsorted(spans[:, 0], b)
            if i < j:
                self.label[i:j] = MORE_LABEL[kind]
                if spans[i, 1] > a:
                    self.label[i] = FIRST_LABEL[kind]

    def rows(self) -> np.ndarray:
        out = np.zeros((len(self.words), 12), np.int32)
        i = 0
        while i < len(self.words):
            j = i
            while self.next_is_near[j] and j - i < 8:
                j += 1
            run = "".join(self.digits[i : j + 1])
            for k in range(i, j + 1):
                out[k] = features(self.words[k], self.digits[k], run[:64], self.words[i][:1] if self.words[i][:1] in "+(" else "")
            i = j + 1
        return out

    def similar(self) -> dict[str, list[int]]:
        """Places of the words by key, for keys that occur again."""
        found: dict[str, list[int]] = {}
        for k, (word, digits) in enumerate(zip(self.words, self.digits, strict=True)):
            if key := similar_key(word, digits):
                found.setdefault(key, []).append(k)
        return {k: v for k, v in found.items() if len(v) > 1}


def words_of(column: pa.Array) -> Iterator[Words | None]:
    """The words in question of each text of a column; None where there are none."""
    data, offsets = textops.utf8(column)
    starts, ends, first = textops.word_spans(data, offsets)
    asked = np.zeros(256, bool)
    asked[48:58] = asked[64] = True
    upto = np.concatenate([[0], np.cumsum(asked[data], dtype=np.int32)])
    hit = np.flatnonzero(upto[ends] > upto[starts])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    bounds = np.searchsorted(hit, first)
    for k in range(len(offsets) - 1):
        own = hit[bounds[k] : bounds[k + 1]]
        if not len(own):
            yield None
            continue
        zero = points[offsets[k]]
        yield Words(column[k].as_py(), np.stack([points[starts[own]] - zero, points[ends[own]] - zero], 1).astype(np.int64), own - first[k])


def soft(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


class SkipChain:
    """Weights of the field: features by label, neighbours' labels in order, labels of similar words (symmetric)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def learned(cls, rows: np.ndarray, label: np.ndarray, near: np.ndarray, links: np.ndarray, rounds: int = ROUNDS, rate: float = 0.05, decay: float = 1e-5, copies: int = 4, seed: int = 11) -> SkipChain:
        """Pseudo-likelihood: each word's label given its features and its neighbours' labels, by full-batch Adam.

        near: whether the next row is the next word of the same text. links: pairs of similar words (a row each way).
        Base spans are told by shape alone, so beside each word stand ``copies`` of it that lack some of their features,
        the last one all; there only the neighbours tell the label, which is what their weights are for.
        """
        n = len(rows)
        before, after = np.full(n, OUT), np.full(n, OUT)
        at = np.flatnonzero(near[:-1]) if n else np.zeros(0, np.int64)
        before[at + 1], after[at] = label[at], label[at + 1]
        # Labels of the similar words, as shares, so that a word of many copies is no heavier than one of a few.
        others = np.zeros((n, LABELS))
        if len(links):
            np.add.at(others, (links[:, 0], label[links[:, 1]]), 1)
            others /= np.maximum(1, others.sum(1, keepdims=True))
        rng, width = np.random.default_rng(seed), rows.shape[1]
        drop = [np.zeros(rows.shape, bool), *[rng.random(rows.shape) < (k + 1) / copies for k in range(copies)]]
        rows = np.concatenate([np.where(d, WIDTH, rows) for d in drop])  # WIDTH: the feature without weight
        label, before, after, others = np.tile(label, copies + 1), np.tile(before, copies + 1), np.tile(after, copies + 1), np.tile(others, (copies + 1, 1))
        n = len(rows)
        truth, hot = np.zeros((n, LABELS)), np.eye(LABELS)
        truth[np.arange(n), label] = 1
        shares = truth.sum(0)
        weight = (1 / np.maximum(shares, 1))[label]
        weight = weight / max(weight.sum(), 1e-9)
        w = [np.zeros((WIDTH + 1, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
        one, two = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for t in range(1, rounds + 1):
            p = soft(w[0][rows].sum(1) + w[1][before] + w[1].T[after] + others @ w[2])
            d = (p - truth) * weight[:, None]
            g0 = np.zeros_like(w[0])
            np.add.at(g0, rows.reshape(-1), np.repeat(d, width, 0))
            g0[WIDTH] = 0
            g2 = others.T @ d
            grads = [g0, hot[before].T @ d + (hot[after].T @ d).T, (g2 + g2.T) / 2]
            for k, g in enumerate(grads):
                g = g + decay * w[k]
                one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.999 * two[k] + 0.001 * g * g
                w[k] = w[k] - rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
        return cls(w[0][:WIDTH].astype(np.float32), *[x.astype(np.float32) for x in w[1:]])

    def marginals(self, rows: np.ndarray, label: np.ndarray, near: np.ndarray, similar: list[list[int]], passes: int = PASSES) -> np.ndarray:
        """Each word's marginals after loopy message passing. Words that base spans hold (label not OUT) are observed."""
        n = len(rows)
        score = np.empty((n, LABELS), np.float32)
        for a in range(0, n, SECTION):
            score[a : a + SECTION] = self.unary[rows[a : a + SECTION]].sum(1)
        # The word before and after: one that isn't in question is observed as outside.
        score[np.concatenate([[True], ~near[:-1]])] += self.chain[OUT]
        score[~near] += self.chain[:, OUT]
        pairs = []
        for places in similar:
            known = [k for k in places if label[k] != OUT]
            free = [k for k in places if label[k] == OUT]
            if known and free:
                # An observed word's message is its row of the potential, whatever comes back; of several, as shares, as learned.
                score[free] += self.skip[label[known]].mean(0)
            pairs += zip(free[:-1], free[1:], strict=True)
        seen = label != OUT
        score[seen] = -1e4
        score[seen, label[seen]] = 0
        at = np.flatnonzero(near[:-1])
        return self._passed(score, np.stack([at, at + 1], 1), np.array(pairs, np.int64).reshape(-1, 2), passes)

    def _passed(self, score: np.ndarray, chain: np.ndarray, skips: np.ndarray, passes: int) -> np.ndarray:
        """The marginals after messages over all edges, however far apart their ends. What is made for an edge on the way is
        held for SECTION edges at once; what stays are two messages for each direction of an edge."""
        if not len(chain) + len(skips):
            return soft(score)
        # Each edge in both directions; potential[kind] is indexed by (sender's label, receiver's label).
        frm = np.concatenate([chain[:, 0], chain[:, 1], skips[:, 0], skips[:, 1]])
        to = np.concatenate([chain[:, 1], chain[:, 0], skips[:, 1], skips[:, 0]])
        c, s = len(chain), len(skips)
        back = np.concatenate([np.arange(c, 2 * c), np.arange(c), np.arange(2 * c + s, 2 * c + 2 * s), np.arange(2 * c, 2 * c + s)])
        potential = [(0, c, self.chain), (c, 2 * c, self.chain.T), (2 * c, 2 * c + 2 * s, self.skip)]
        parts = [(slice(a, min(a + SECTION, last)), p) for first, last, p in potential for a in range(first, last, SECTION)]
        order = np.argsort(to, kind="stable")
        heads = np.flatnonzero(np.diff(to[order], prepend=-1))
        met = to[order][heads]
        message, new = np.zeros((len(frm), LABELS), np.float32), np.empty((len(frm), LABELS), np.float32)

        def beliefs() -> np.ndarray:
            belief = score.copy()
            for label in range(LABELS):
                belief[met, label] += np.add.reduceat(message[:, label][order], heads)
            return belief

        for _ in range(passes):
            belief = beliefs()
            for part, p in parts:
                cavity = belief[frm[part]] - message[back[part]]
                for label in range(LABELS):
                    x = cavity + p[:, label]
                    top = x.max(1, keepdims=True)
                    new[part, label] = (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]
                new[part] -= new[part].max(1, keepdims=True)
                new[part] *= 1 - DAMPING
                new[part] += DAMPING * message[part]
            message, new = new, message
        return soft(beliefs())


def added_spans(words: Words, model: SkipChain, sure: float = SURE) -> list[tuple[str, int, int]]:
    """Spans of words in a row that the field labels as one kind, each at least ``sure``, and that a similar word of that
    kind elsewhere in the text supports. Words of base spans aren't among them; marks around a span are left out."""
    similar = words.similar()
    # Where no similar word is known or free words can't gain one, nothing can be added.
    if not any((words.label[v] != OUT).any() and (words.label[v] == OUT).any() for v in map(np.array, similar.values())):
        return []
    p = model.marginals(words.rows(), words.label, words.next_is_near, list(similar.values()))
    top = p.argmax(1)
    kind = np.where((words.label == OUT) & (1 - p[:, OUT] >= sure), KIND_OF[top], -1)
    known = [{KIND_OF[words.label[k]] for k in v if words.label[k] != OUT} for v in similar.values()]
    support = {k: kinds for v, kinds in zip(similar.values(), known, strict=True) for k in v}
    out, i = [], 0
    while i < len(kind):
        j = i
        while kind[i] > 1 and words.next_is_near[j] and kind[j + 1] == kind[i]:
            j += 1
        if kind[i] >= 0 and any(kind[i] in support.get(k, ()) for k in range(i, j + 1)):
            a, b = int(words.spans[i, 0]), int(words.spans[j, 1])
            head, tail = words.words[i], words.words[j]
            a += len(head) - len(head.lstrip(MARKS))
            b -= len(tail) - len(tail.rstrip(MARKS))
            if a < b:
                out.append((KINDS[kind[i]], a, b))
        i = j + 1
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_text: int = SAMPLE_TEXT, sample_words: int = SAMPLE_WORDS) -> SkipChain:
    """Learns the field on ``sample`` distinct rows at most, of texts with a digit or @ of ``sample_text`` bytes and
    ``sample_words`` words in question at most, picked by a hash. Without any, all weights are 0 and nothing is added."""
    texts = docs.where((F.octet_length(text_col) <= sample_text) & F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(F.col(id_col).cast("string"), F.crc32(text_col), F.octet_length(text_col)).alias("key"), F.col(text_col).alias("text"))
    keys = texts.select("key").distinct().orderBy("key").limit(sample)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.batches(source, most=1 << 20):
            out = []
            for key, w in zip(batch.column(0).to_pylist(), words_of(batch.column(1)), strict=True):
                if w is not None and len(w.words) <= sample_words:
                    links = [(a, b) for v in w.similar().values() for a, b in zip(v[:-1], v[1:], strict=True)]
                    links += [(b, a) for a, b in links]
                    out.append((key, w.rows().astype("<i4").tobytes(), w.label.astype("<i4").tobytes(), w.next_is_near.astype("<i4").tobytes(), np.array(links, "<i4").tobytes()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64()] + [pa.binary()] * 4, strict=True)], names=["key", "rows", "label", "near", "links"])

    # The keys are ``sample`` longs at most.
    picked = texts.join(F.broadcast(keys), "key").mapInArrow(run, "key long, rows binary, label binary, near binary, links binary").dropDuplicates(["key"])
    found = sorted(picked.toLocalIterator(), key=lambda r: r["key"])
    if not found:
        return SkipChain(np.zeros((WIDTH, LABELS), np.float32), np.zeros((LABELS, LABELS), np.float32), np.zeros((LABELS, LABELS), np.float32))
    get = lambda k: [np.frombuffer(r[k], "<i4").astype(np.int64) for r in found]
    label = get("label")
    first = np.cumsum([0, *map(len, label)])
    links = [x.reshape(-1, 2) + first[k] for k, x in enumerate(get("links"))]
    return SkipChain.learned(np.concatenate(get("rows")).reshape(-1, 12), np.concatenate(label), np.concatenate(get("near")).astype(bool), np.concatenate(links))


def personal_data(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """(id, spans): spans is array<struct<kind, start, end, base>> of code points, end exclusive, by kind, then start.

    One row per input row; null and empty texts have no spans; repeated rows and null ids are rows like others. Whole
    texts are read, however long; a text's messages go over all its links, computed for ``SECTION`` of them at once. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    place = {k: i for i, k in enumerate(KINDS)}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.batches(source, most=1 << 21):
            out = []
            for w in words_of(batch.column(1)):
                spans = [(*s, True) for s in w.base] if w is not None else []
                if w is not None and w.base:
                    spans += [(*s, False) for s in added_spans(w, model, sure)]
                spans.sort(key=lambda s: (place[s[0]], s[1]))
                out.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            yield pa.record_batch([batch.column(0), pa.array(out, kinds)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, learn(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found_of = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(found_of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    # The counts, like base_sha256, are of base spans; spans holds what the field adds too.
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
