"""The knowledge table: rows from parsed sources, unions, normalising, upserts, writing."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscan.functions.text import first_match_label, join_tags, keyword_tags, strip
from claimscan.functions.work import small_rows
from claimscan.sources.markdown import range_label

# Chapters of the law by article number, tags by keyword, names of industries.
CHAPTERS = [("总则", 1, 7), ("广告内容准则", 8, 28), ("广告行为规范", 29, 45), ("监督管理", 46, 53), ("法律责任", 54, 73), ("附则", 74, 75)]
LAW_TAGS = {
    "极限用语": ["最高级", "最佳", "国家级", "最便宜", "销量第一"],
    "虚假广告": ["虚假", "引人误解", "欺骗"],
    "医疗广告": ["医疗", "药品", "医疗器械", "医疗机构"],
    "保健食品": ["保健食品", "保健"],
    "烟草广告": ["烟草"],
    "未成年人": ["未成年"],
    "代言": ["代言", "推荐", "证明"],
    "专利": ["专利"],
    "竞争": ["贬低", "竞争"],
    "处罚": ["罚款", "处罚", "法律责任"],
}
INDUSTRIES = {
    "医疗器械": "medical_device",
    "医疗": "medical",
    "药品": "pharma",
    "保健食品": "health_food",
    "食品": "food",
    "化妆品": "cosmetic",
    "教育培训": "education",
    "教育": "education",
    "金融投资": "finance",
    "金融": "finance",
    "房地产": "real_estate",
    "烟草": "tobacco",
    "酒类": "alcohol",
}
SOURCE_CONFIDENCE = {"user": 0.6, "user-explicit": 0.6, "lesson": 0.7, "auto-lesson": 0.7, "auto": 0.4, "auto-preference": 0.4}

RULES = "word string, pattern string, category string, regulation_ref string"


def _row(df: DataFrame, source: str, key: Column, value: Column, tags: Column) -> DataFrame:
    return df.select(F.concat(F.lit(source + ":"), key).alias("key"), value.alias("value"), F.lit(source).alias("source"), tags.alias("tags"))


@dataclass(frozen=True)
class Maps:
    """What a law and its trades are called; the defaults are those of the advertising law."""

    chapters: Sequence[tuple[str, int, int]] = tuple(CHAPTERS)
    law_tags: Mapping[str, list[str]] = field(default_factory=lambda: LAW_TAGS)
    industries: Mapping[str, str] = field(default_factory=lambda: INDUSTRIES)


def to_knowledge_rows(parsed: DataFrame, kind: str, maps: Maps = Maps()) -> DataFrame:
    """(key, value, source, tags) from parsed rows of one kind.

    Sections have heading, body and value (see ``markdown.split_sections``); table kinds have cells and section.
    """
    c, cell = F.col, lambda i: F.get(F.col("cells"), F.lit(i))
    note = lambda name, x: F.when(x != "", F.concat(F.lit(f" | {name}: "), x)).otherwise(F.lit(""))
    if kind in ("law", "bold_law"):
        ranges = parsed.sparkSession.createDataFrame(list(maps.chapters), "label string, lo int, hi int")
        df = range_label(parsed, "heading", ranges, "chapter")
        found = keyword_tags(c("value"), maps.law_tags)
        tags = F.concat_ws(",", join_tags(F.lit("广告法"), c("heading"), c("chapter")), F.when(F.size(found) > 0, F.array_join(found, ",")))
        return _row(df, "ad_law" if kind == "law" else "ad_law_team", c("heading"), c("value"), tags)
    if kind == "case":
        tag = lambda name: strip(F.regexp_extract("body", rf"\*\*{name}\*\*[：:][ \t]*([^\n]+)", 1))
        return _row(parsed, "penalty_case", c("heading"), F.concat(F.lit("### 案例 "), c("heading"), F.lit("\n"), c("body")), join_tags(F.lit("处罚案例"), tag("行业"), tag("违规类型")))
    if kind in ("industry", "industry_team"):
        source, marks = ("industry_rule", "行业规则") if kind == "industry" else ("industry_rule_team", "行业规则,队友版")
        return _row(parsed, source, first_match_label(c("heading"), maps.industries), F.concat(F.lit("行业: "), c("heading"), F.lit("\n\n"), c("body")), join_tags(F.lit(marks), c("heading")))
    if kind == "general":
        return _row(parsed, "industry_rule_team", F.lit("general"), F.concat(c("heading"), F.lit("\n\n"), c("body")), F.lit("行业规则,队友版,通用禁令"))
    if kind == "banned_word":
        return parsed.select(F.concat(F.lit("banned:"), "word").alias("key"), c("word").alias("value"), F.lit("banned_word").alias("source"), c("category").alias("tags"))
    if kind == "banned_word_team":
        value = F.concat(F.lit("禁用词: "), cell(1), F.lit(" | 类别: "), cell(2), F.lit(" | 替代建议: "), cell(3))
        rows = _row(parsed.filter(F.size("cells") == 4), "banned_word_team", cell(1), value, join_tags(F.lit("禁用词"), F.lit("队友版"), cell(2), c("section")))
        return rows.withColumn("key", F.regexp_replace("key", "^banned_word_team:", "banned_team:"))
    if kind == "replacement":
        df = parsed.filter((F.size("cells") == 3) & ~cell(0).contains("---") & (cell(0) != "禁用词"))
        return _row(df, "replacement", cell(0), F.concat(F.lit("禁用词: "), cell(0), F.lit(" → 替代词: "), cell(1), note("说明", cell(2))), join_tags(F.lit("替代映射"), c("section"), cell(0)))
    if kind == "replacement_team":
        df = parsed.filter(F.size("cells") == 4)
        return _row(df, "replacement_team", cell(1), F.concat(F.lit("禁用词: "), cell(1), F.lit(" → 替代词: "), cell(2), note("使用场景", cell(3))), join_tags(F.lit("替代映射,队友版"), c("section")))
    if kind == "penalty_case_team":
        df = parsed.filter(F.size("cells") == 5)
        value = F.concat(F.lit("案例: "), cell(1), F.lit("\n违法内容: "), cell(2), F.lit("\n处罚金额: "), cell(3), F.lit("\n处罚机关: "), cell(4))
        return _row(df, "penalty_case_team", cell(0), value, join_tags(F.lit("处罚案例,队友版"), c("section")))
    raise ValueError(f"unknown kind {kind}")


def build_knowledge_base(inputs: dict[str, DataFrame], maps: Maps = Maps()) -> DataFrame:
    """All kinds' rows in one table."""
    out = None
    for kind, parsed in inputs.items():
        rows = to_knowledge_rows(parsed, kind, maps)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def load_rules(source: str | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(rule_idx, word, pattern, category, regulation_ref) in dictionary order; rules whose pattern does not compile are dropped.

    ``source`` is a path of JSON arrays or a DataFrame with these columns and, for an order, ``rule_idx``.
    """
    df = spark.read.schema(RULES).json(source, multiLine=True) if isinstance(source, str) else source
    rows = small_rows(df)
    if "rule_idx" in df.columns:
        rows = sorted(rows, key=lambda r: r.rule_idx)
    out = []
    for i, r in enumerate(rows):
        pattern = r.pattern if r.pattern is not None else r.word
        try:
            re.compile(pattern or "", re.IGNORECASE)
        except re.error:
            continue
        out.append((getattr(r, "rule_idx", i), r.word or "", pattern or "", r.category or "", r.regulation_ref or ""))
    return df.sparkSession.createDataFrame(out, "rule_idx int, " + RULES)


def union_memories(entities: DataFrame, relations: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """One table (key, value, source, importance, tags) of graph entities (name, kind, observations), relations
    (from_name, to_name, relation), rows (key, value, level) and files (path, content)."""
    pick = lambda df, key, value, source, level, tags: df.select(key.alias("key"), value.alias("value"), F.lit(source).alias("source"), level.alias("importance"), tags.alias("tags"))
    c, long = F.col, F.lit("long")
    front = F.regexp_extract("content", r"(?s)^---(.*?)---", 1)
    kind = strip(F.regexp_extract(front, r"(?dm)^[ \t]*type:(.*)$", 1))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    parts = [
        pick(entities, c("name"), F.array_join("observations", "\n"), "knowledge-graph", long, c("kind")),
        pick(relations, F.concat_ws(":", F.lit("rel"), "from_name", "to_name"), F.concat(c("from_name"), F.lit(" --["), c("relation"), F.lit("]--> "), c("to_name")), "knowledge-graph", long, F.lit("relation")),
        pick(rows, F.concat(F.lit("evo:"), "key"), c("value"), "evolution", F.coalesce("level", F.lit("")), F.lit("evolution-memory")),
        pick(files.filter(F.lower(name) != "memory"), F.concat(F.lit("file:"), name), c("content"), "file-memory", long, join_tags(F.lit("file-memory"), kind)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normalise_memory(df: DataFrame) -> DataFrame:
    """Current column names and tags as an array; a table that is already so stays as it is."""
    df = df.drop("access_count")
    if "level" in df.columns and "importance" not in df.columns:
        df = df.withColumnRenamed("level", "importance")
    if "tags" in df.columns and dict(df.dtypes)["tags"] == "string":
        json = F.from_json("tags", "array<string>")
        plain = F.filter(F.transform(F.split("tags", ","), strip), lambda t: t != "")
        df = df.withColumn("tags", F.coalesce(F.when(strip(F.col("tags")).startswith("["), json), plain, F.array().cast("array<string>")))
    return df


def initial_confidence(source: Column) -> Column:
    """Confidence that a memory starts with, by source."""
    table = F.create_map(*[F.lit(x) for pair in SOURCE_CONFIDENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(0.5))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "key", order_col: str = "updated_at") -> DataFrame:
    """Last write per key wins, of equally late ones that with the greatest other values; the first ``created_at`` and an existing ``confidence`` stay."""
    others = [f.name for f in incoming.schema if f.name not in (key, order_col) and f.dataType.typeName() not in ("map", "variant")]
    w = W.partitionBy(key).orderBy(F.desc(order_col), *map(F.desc, others))
    last = incoming.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    a, b = current.alias("a"), last.alias("b")
    out = []
    for name in current.columns:
        old, new = F.col(f"a.{name}"), F.col(f"b.{name}") if name in incoming.columns else F.lit(None)
        there = F.col(f"b.{key}").isNotNull()
        if name == key or name == "created_at":
            out.append(F.coalesce(old, new).alias(name))
        elif name == "confidence":
            start = initial_confidence(F.col("b.source")) if "source" in incoming.columns else F.lit(0.5)
            out.append(F.coalesce(old, new, F.when(there, start)).alias(name))
        elif name in incoming.columns:
            out.append(F.when(there, new).otherwise(old).alias(name))
        else:
            out.append(old.alias(name))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*out)


def write_knowledge(df: DataFrame, path: str, format: str = "parquet") -> DataFrame:
    """Write one folder per source and return what was written."""
    df.write.partitionBy("source").format(format).save(path)
    return df.sparkSession.read.schema(df.schema).format(format).load(path)
