"""Column expressions for document text; all stay on the JVM side, inside code generation where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of numbered headings, lines of a table of contents and body noise.
CHAPTER = r"^\s*(第\s*[0-9零一二三四五六七八九十百]+\s*[章节篇卷]|第\s*[0-9零一二三四五六七八九十百]+\s*部分)\s*[:：.、]?\s*(.*)$"
DOTTED = r"^\s*(\d+(?:\.\d+)+)\s*[.、．]?\s*(.+)$"
CN_NUMBER = r"^\s*([一二三四五六七八九十百]+)\s*[、.．]\s*(.+)$"
CN_PAREN = r"^\s*[（(]\s*([一二三四五六七八九十百]+)\s*[）)]\s*(.+)$"
NUMBER = r"^\s*(\d+)\s*[.、．]\s*(.+)$"
BARE_TITLES = ("投标函", "投标函附录", "法定代表人身份证明", "授权委托书", "投标保证金", "开标一览表", "资格证明文件", "商务响应文件", "技术响应文件", "报价一览表", "投标文件格式", "投标人须知", "招标公告", "投标邀请书", "投标邀请", "采购需求", "评标办法", "评分办法", "合同条款", "合同协议书", "工程量清单", "封面")
TOC_LEADER = r"(?:\.{2,}|…{1,}|·{2,}|—{2,})\s*\d+\s*$"
TOC_PAGE = r"\s\d{1,3}\s*$"
SENTENCE_END = r"[。；！？]$"
FORM_MARK, BODY_TAIL, FORM_ENUM = r"[□☑☒√✓]", r"[：:、，,。；！？）)]\s*$", r"^[（(]\s*\d+\s*[）)]"
TITLE_NOISE = r"[\s　.．。:：、,，;；()（）]"

# What tells the kinds of tender documents apart, in order of preference.
DOC_TYPES = {
    "招标": (r"招标(项目|公告|文件|投标|投标人)", r"(投标人|投标文件|投标函|中标)"),
    "采购": (r"采购(文件|项目|需求|公告|人)", r"(供应商|响应文件|报价函|成交)"),
    "询比价": (r"询比价", r"比价(采购|响应)"),
}

# Constraint kinds, each with its pattern, the groups of each way to match, and the words that a line must have.
CONSTRAINTS = {
    "page_limit": (r"(?:不超过|不得超过|不得多于|控制在|限制在)\s*(\d{1,4})\s*页", None),
    "amount": (r"(\d+(?:\.\d+)?)\s*(万元|元)", r"保证金|限价|预算|报价|金额|费用|合同额|投资额"),
    "period": (r"(\d{1,4})\s*个?(日历日|工作日|日历天|个月|月|年|天|日)", r"期限|工期|服务期|有效期|截止|日内|天内|个月|质保"),
    "social_security": (r"(?:近|连续)\s*(\d{1,2})\s*个月(?:的)?(?:社保|社会保险)|(?:社保|社会保险)[^\n]{0,15}?(\d{1,2})\s*个月", None),
    "quantity": (r"(正本|副本)\s*(\d{1,2})\s*份|(\d{1,2})\s*份", r"份|正本|副本"),
}

# Threshold kinds.
THRESHOLDS = {
    "date": r"近\s*(\d{1,2})\s*年|(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日|(\d{1,2})\s*年内",
    "amount": r"(?:合同金额|合同额|单项合同|造价|投资额|金额)[^\n]{0,10}?(?:≥|不低于|不少于|超过|以上|达到)?\s*(\d+(?:\.\d+)?)\s*(万元|元)|(?:≥|不低于|不少于)\s*(\d+(?:\.\d+)?)\s*(万元|元)",
    "quantity": r"(?:≥|不少于|至少|不低于)\s*(\d{1,3})\s*(个|项|人|份|名)|(\d{1,3})\s*(个|项|人)\s*(?:以上|及以上)",
}

# What a section's title says of its nature, in order of preference.
NATURES = {
    "tech": r"监理大纲|技术方案|实施方案|技术参数|技术规格|技术指标|服务方案|施工组织|技术响应",
    "business": r"供应商介绍|供应商简介|投标人介绍|投标人简介|人员力量|人员配备|业绩|荣誉|获奖|财务状况|财务报表|服务承诺|承诺函|售后服务|公司介绍|企业简介",
}

# Words of each kind of document.
TERMS = {
    "招标": {"主体": "投标人", "文件": "投标文件", "函件": "投标函", "中标": "中标"},
    "采购": {"主体": "供应商", "文件": "响应文件", "函件": "报价函", "中标": "成交"},
    "询比价": {"主体": "供应商", "文件": "询比价响应文件", "函件": "报价函", "中标": "成交"},
}

# Titles of chapters that other systems make.
EXTERNAL = ("开标一览表", "投标报价", "分项报价表", "报价表", "报价函", "投标函附录", "法定代表人授权书")


def title_key(c: Column) -> Column:
    """A title without white space and punctuation, for comparisons."""
    return F.regexp_replace(c, TITLE_NOISE, "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s　]+", "")


def anchored(snippet: Column, source: Column) -> Column:
    """Whether the snippet occurs in the source but for white space; an empty snippet doesn't."""
    return (F.length(squeeze(snippet)) > 0) & F.contains(squeeze(source), squeeze(snippet))


def heading(c: Column) -> Column:
    """struct(level, number, title), null where the text is no heading. A pattern that matches decides, even for null."""
    body = lambda p: F.trim(F.regexp_extract(c, p, 2))
    one = lambda p: F.regexp_extract(c, p, 1)
    shape = lambda level, number, title: F.struct(level.cast("int").alias("level"), number.alias("number"), title.alias("title"))
    held = lambda p, most: (F.length(body(p)) > 0) & (F.length(body(p)) <= most)
    dots = F.length(one(DOTTED)) - F.length(F.replace(one(DOTTED), F.lit("."), F.lit("")))
    return (
        F.when((F.length(c) > 60) | c.rlike(SENTENCE_END), None)
        .when(c.rlike(CHAPTER), F.when(held(CHAPTER, 40), shape(F.lit(1), F.replace(one(CHAPTER), F.lit(" "), F.lit("")), body(CHAPTER))))
        .when(c.rlike(DOTTED), shape(2 + dots, one(DOTTED), body(DOTTED)))
        .when(c.rlike(CN_NUMBER), F.when(held(CN_NUMBER, 45), shape(F.lit(2), F.concat(one(CN_NUMBER), F.lit("、")), body(CN_NUMBER))))
        .when(c.rlike(CN_PAREN), F.when(held(CN_PAREN, 45), shape(F.lit(3), F.concat(F.lit("（"), one(CN_PAREN), F.lit("）")), body(CN_PAREN))))
        .when(c.rlike(NUMBER), F.when(held(NUMBER, 45), shape(F.lit(3), F.concat(one(NUMBER), F.lit(".")), body(NUMBER))))
        .when(F.trim(c).isin(*BARE_TITLES), shape(F.lit(1), F.lit(""), F.trim(c)))
    )


def toc_line(c: Column) -> Column:
    return c.rlike(TOC_LEADER) | c.rlike(TOC_PAGE)


def body_noise(c: Column) -> Column:
    s = F.trim(c)
    return s.rlike(FORM_MARK) | s.rlike(BODY_TAIL) | s.rlike(FORM_ENUM) | (s.rlike("[%％]$") & (F.length(s) <= 12))


def doc_type(c: Column) -> Column:
    """The kind whose patterns match most often; of equal ones the first, 未知 without any match."""
    counts = [sum((F.regexp_count(c, F.lit(p)) for p in ps), F.lit(0)) for ps in DOC_TYPES.values()]
    most = F.greatest(*counts)
    out = F.when(most == 0, "未知")
    for name, n in zip(DOC_TYPES, counts, strict=True):
        out = out.when(n == most, name)
    return out


def _matches(line: Column, pattern: str, groups: list[int], shape) -> Column:
    """Of each match in order: shape of its groups as columns, an unmatched group being the empty string."""
    every = [F.regexp_extract_all(line, F.lit(f"(?U){pattern}"), F.lit(k)) for k in groups]
    return F.transform(F.arrays_zip(*[x.alias(f"g{k}") for k, x in zip(groups, every, strict=True)]), lambda m: shape(*[m[f"g{k}"] for k in groups]))


def _either(*parts: Column) -> Column:
    """The first part that isn't empty."""
    return F.coalesce(*[F.when(p != "", p) for p in parts])


def _named(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def constraints(line: Column) -> Column:
    """array of struct(kind, value) of a line, each once, in the order of kinds and then of places."""
    shapes = {
        "page_limit": ([1], lambda n: F.concat(n, F.lit("页"))),
        "amount": ([1, 2], F.concat),
        "period": ([1, 2], F.concat),
        "social_security": ([1, 2], lambda a, b: F.concat(_either(a, b), F.lit("个月"))),
        "quantity": ([0], lambda whole: whole),
    }
    found = []
    for kind, (pattern, hint) in CONSTRAINTS.items():
        values = _named(kind, _matches(line, pattern, *shapes[kind]))
        none = F.array().cast("array<struct<kind:string,value:string>>")
        found.append(F.when(line.rlike(hint), values).otherwise(none) if hint else values)
    return F.array_distinct(F.flatten(F.array(*found)))


def thresholds(line: Column) -> Column:
    """array of struct(kind, value): dates, amounts and quantities that a line demands, each once."""
    day = lambda near, y, m, d, within: F.when(near != "", F.concat(near, F.lit("年"))).when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.concat(within, F.lit("年内")))
    two = lambda a, b, c, d: F.concat(_either(a, c), _either(b, d))
    shapes = {"date": ([1, 2, 3, 4, 5], day), "amount": ([1, 2, 3, 4], two), "quantity": ([1, 2, 3, 4], two)}
    found = [_named(kind, _matches(line, p, *shapes[kind])) for kind, p in THRESHOLDS.items()]
    return F.array_distinct(F.flatten(F.array(*found)))


def nature(title: Column) -> Column:
    """tech before business by the words of a title, else general."""
    out = F.when(F.lit(False), "")
    for name, pattern in NATURES.items():
        out = out.when(title.rlike(pattern), name)
    return out.otherwise("general")


def term(kind: Column, label: Column) -> Column:
    """The word of a document kind for a label; unknown kinds have those of the first, unknown labels stand for themselves."""
    words = F.create_map(*[F.lit(x) for k, v in TERMS.items() for a, b in v.items() for x in (f"{k}/{a}", b)])
    known = F.when(kind.isin(*TERMS), kind).otherwise(next(iter(TERMS)))
    return F.coalesce(F.try_element_at(words, F.concat_ws("/", known, label)), label)


def external(title: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in EXTERNAL]), lambda w: F.contains(title, w))


def heading_level(given: Column, matched: Column) -> Column:
    """The parser's level where no pattern matches, held to 1..4; a parser's 1 overrides a deeper match."""
    return F.when(matched.isNull(), F.least(F.greatest(given, F.lit(1)), F.lit(4))).when((given == 1) & (matched > 1), 1).otherwise(matched)


def snippet_after(c: Column, keyword: str, more: int = 20) -> Column:
    """From the keyword's first place to ``more`` characters past it; null without it."""
    at = F.instr(c, F.lit(keyword))
    return F.when(at > 0, F.substring(c, at, F.lit(len(keyword) + more)))


def cjk_words(c: Column, least: int) -> Column:
    """Runs of at least ``least`` ideographs, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"([\x{{4e00}}-\x{{9fff}}]{{{least},}})"), F.lit(1)))


def fenced_json(c: Column, schema: str) -> Column:
    """The object in a reply: of its first ```json block, else of its first block, else the whole; null where it doesn't parse."""
    named, plain = F.regexp_extract(c, r"(?s)```json\s*(.*?)```", 1), F.regexp_extract(c, r"(?s)```\s*(.*?)```", 1)
    body = F.when(F.contains(c, F.lit("```json")), F.when(named != "", named).otherwise(c)).when(plain != "", plain).otherwise(c)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def chapter_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^[\d.\s]+", ""), r"\s+", ""))


def clean(c: Column) -> Column:
    """Without control characters (line ends among them), white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), r"\s+", " "))


def file_stem(c: Column) -> Column:
    """Name without extension and -1 like suffix, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), r"-\d+$", "")))


def safe_name(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(s.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"), F.concat(F.lit("_"), s)).otherwise(s), 1, 180)


def page_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"_[Pp]\d+$", "")


def compact_date(c: Column) -> Column:
    """YYYYMMDD of an ISO or compact date, else ``changqi`` (no end)."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    plain = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
    return F.coalesce(F.date_format(F.coalesce(iso, plain), "yyyyMMdd"), F.lit("changqi"))


def placeholders(c: Column) -> Column:
    """Distinct names in {{ name }}, in order, with control flow left out."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(c, r"(?s)\{[%+\-].*?[%+\-]\}", ""), F.lit(r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}"), F.lit(1)))


def placeholder_class(name: Column, known_b: list[str]) -> Column:
    return F.when(F.startswith(name, F.lit("img_")), "image").when(name.isin(*known_b), "b_class").otherwise("a_class")


def syntax_errors(c: Column) -> Column:
    """array of what is wrong with a template text."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    return F.filter(
        F.array(
            F.when(n(r"\{%\s*for\b") != n(r"\{%\s*endfor\b"), "for"),
            F.when(n(r"\{%\s*if\b") != n(r"\{%\s*endif\b"), "if"),
            F.when(n(r"\{\{[^}]*\}\}") != n(r"\{\{\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\}\}"), "name"),
        ),
        lambda x: x.isNotNull(),
    )


def markdown_rows(c: Column) -> Column:
    """Rows of trimmed cells of a pipe table; separator rows go."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y)))


def html_rows(c: Column) -> Column:
    """Rows of trimmed cells of flat tables; rows without text go."""
    rows = F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))))
    return F.filter(rows, lambda r: F.exists(r, lambda x: F.length(x) > 0))
