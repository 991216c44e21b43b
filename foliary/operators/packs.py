"""Constraint packs as rows: patterns of any domain, met only by lines that hold what they can't do without."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import CONSTRAINTS

PACK = "kind string, label string, pattern string, hint string, literals array<string>, value string"
#: Rows of a pack at most: every task holds it compiled. Characters of a line that are reported.
MOST, SHOWN = 10_000, 200
GROUP = re.compile(r"\{([\d|]+)\}")


@dataclass(frozen=True)
class Rule:
    """A pattern; a hint that the line must match too; literals of which a line that matches holds one at least (none: all
    lines are tried); and the value, in which {1} is a group and {1|2} the first of them that has matched."""

    kind: str
    label: str
    pattern: str
    hint: str | None = None
    literals: tuple[str, ...] = ()
    value: str = "{0}"


# The packaged kinds' labels, what their lines can't do without, and how their values are written.
PACKAGED = {
    "page_limit": ("页数上限", ("页",), "{1}页"),
    "amount": ("金额", ("元",), "{1}{2}"),
    "period": ("期限", ("日", "月", "年", "天"), "{1}{2}"),
    "social_security": ("社保月份", ("社保", "社会保险"), "{1|2}个月"),
    "quantity": ("数量份数", ("份",), "{0}"),
}
RULES = tuple(Rule(kind, PACKAGED[kind][0], pattern, hint, PACKAGED[kind][1], PACKAGED[kind][2]) for kind, (pattern, hint) in CONSTRAINTS.items())


def pack(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.label, r.pattern, r.hint, list(r.literals), r.value) for r in rules], PACK)


class Compiled:
    """All literals in one alternation, longest first, so that a line is read once to learn which rules it may meet."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern), re.compile(r.hint) if r.hint else None, [(m.span(), [int(x) for x in m[1].split("|")]) for m in GROUP.finditer(r.value)]) for r in rules]
        self.always = [k for k, r in enumerate(rules) if not r.literals]
        self.holders: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            for literal in r.literals:
                self.holders.setdefault(literal, []).append(k)
        # A literal within another one is found with it.
        for literal, own in self.holders.items():
            own += [k for other, some in self.holders.items() if other != literal and other in literal for k in some]
        words = sorted(self.holders, key=lambda x: (-len(x), x))
        # A lookahead takes no characters, so literals that overlap are all found.
        self.any = re.compile("(?=(" + "|".join(map(re.escape, words)) + "))") if words else None

    def found(self, line: str) -> Iterator[tuple[str, str, str]]:
        asked = set(self.always)
        if self.any:
            for word in {m[1] for m in self.any.finditer(line)}:
                asked.update(self.holders[word])
        for k in sorted(asked):
            rule, pattern, hint, groups = self.rules[k]
            if hint is None or hint.search(line):
                for m in pattern.finditer(line):
                    value, at = "", 0
                    for (a, b), names in groups:
                        value += rule.value[at:a] + next((m[n] for n in names if m[n]), "")
                        at = b
                    yield rule.kind, rule.label, value + rule.value[at:]


def packed_constraints(lines: DataFrame, rules: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key.., kind, label, value, text): what the rules find in lines, each kind and value once for a line's text and key.

    Lines are trimmed; null and empty ones have nothing. Repeated lines of a key count once. ``text`` is cut at 200
    characters. The pack has MOST rows at most, else this fails."""
    rows = rules.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a pack has {MOST} rules at most")
    held = [Rule(r["kind"], r["label"], r["pattern"], r["hint"], tuple(r["literals"] or ()), r["value"]) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Compiled(held)
        for batch in batches:
            at, out = [], []
            for k, line in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if line := (line or "").strip():
                    for found in dict.fromkeys(compiled.found(line)):
                        at.append(k)
                        out.append((*found, line))
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            yield pa.record_batch([*own, *(pa.array([o[i] for o in out], pa.string()) for i in range(4))], names=[*key, "kind", "label", "value", "text"])

    kinds = dict(lines.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", kind string, label string, value string, text string"
    found = lines.select(*key, text).mapInArrow(run, schema)
    return found.dropDuplicates([*key, "kind", "value", "text"]).withColumn("text", F.substring("text", 1, SHOWN))
