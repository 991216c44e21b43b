"""Names of material files: built from a category and its fields, and taken apart again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.text import compact_date

# Prefixes of material kinds.
CERTIFICATES = {"注册证书": "zcs", "岗位证书": "gwz", "职称证书": "zc", "身份证": "sfz", "毕业证": "byz", "学位证": "xww", "个人荣誉": "ry", "退休证": "tti", "返聘协议": "fp", "简历": "jl"}
PERFORMANCES = {"监理合同": "jlst", "竣工报告": "jg", "备案证书": "ba"}
FINANCES = {"中小企业声明函": "zxxq", "审计报告": "smbg", "财务报表": "cwbb"}
HONOR = "ry"


def short(c: Column) -> Column:
    """Without white space, 30 characters at most; null where nothing is left."""
    return F.nullif(F.substring(F.regexp_replace(c, r"(?U)\s+", ""), 1, 30), F.lit(""))


def _prefix(kind: Column, known: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), kind), F.lit(other))


def file_name(category: Column, name: Column, fields: dict[str, Column], page: Column) -> Column:
    """The name without extension; fields that are null or empty are left out, but for dates, which have a word for none."""
    f = lambda k: fields.get(k, F.lit(None).cast("string"))
    year = F.substring(F.nullif(f("year"), F.lit("")), 1, 4)
    person = F.concat_ws("_", _prefix(f("cert_type"), CERTIFICATES, "zc"), short(f("person")), short(f("id_no")), compact_date(f("valid_until")))
    done = F.concat_ws("_", _prefix(f("perf_type"), PERFORMANCES, "xm"), short(f("project")), compact_date(f("contract_date")), short(f("supervisor")))
    honor = F.concat_ws("_", F.lit(HONOR), short(f("honor")), short(f("issuer")), year)
    finance = F.concat_ws("_", _prefix(f("fin_type"), FINANCES, "cw"), year)
    stem = F.when(category.isin("qualification", "personnel"), person).when(category == "performance", done).when(category == "honor", honor).when(category == "finance", finance).otherwise(F.coalesce(short(name), F.lit("unnamed")))
    return F.substring(F.concat(stem, F.when(page > 0, F.concat(F.lit("_P"), page.cast("string"))).otherwise("")), 1, 120)


def parsed_name(c: Column) -> Column:
    """struct(page, valid_until, kind, type, rest): a trailing page, the last whole date, and the type of the longest prefix."""
    page = F.regexp_extract(c, r"_P(\d+)$", 1)
    body = F.regexp_replace(c, r"_P\d+$", "")
    # Parts that end at a mark: dates don't share their marks with the next, as in a search from left to right.
    days = F.regexp_extract_all(body, F.lit(r"(?:^|_)(\d{8})(?:$|_)"), F.lit(1))
    known = {p: (kind, name) for kind, table in (("cert_type", CERTIFICATES), ("perf_type", PERFORMANCES), ("fin_type", FINANCES)) for name, p in reversed(table.items())}
    found = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("type"), F.lit("").alias("rest")))
    for p in sorted(known, key=len, reverse=True):
        kind, name = known[p]
        found = found.when(F.startswith(body, F.lit(f"{p}_")), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("type"), F.substring(body, len(p) + 2, 200).alias("rest")))
    return F.struct(F.nullif(page, F.lit("")).cast("int").alias("page"), F.try_to_date(F.try_element_at(days, F.lit(-1)), "yyyyMMdd").alias("valid_until"), found["kind"].alias("kind"), found["type"].alias("type"), found["rest"].alias("rest"))
