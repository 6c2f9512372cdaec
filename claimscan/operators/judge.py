"""Context judgement of hits: text signals, a decision table per category family, feedback, and parsed model replies."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscan.functions.text import clamp
from claimscan.functions.work import small_side

# Types by category; families by what a category contains; signals and their patterns.
VIOLATION_TYPES = {
    "极限用语": "EXTREME_WORDS",
    "绝对化用语": "EXTREME_WORDS",
    "虚假宣传": "FALSE_PROMOTION",
    "效果承诺": "FALSE_PROMOTION",
    "虚假数据": "FALSE_PROMOTION",
    "诱导焦虑": "FALSE_PROMOTION",
    "资质虚构": "FALSE_PROMOTION",
    "对比贬低": "COMPETITION_DENIGRATE",
    "贬低同行": "COMPETITION_DENIGRATE",
    "行业禁区": "INDUSTRY_PROHIBITION",
    "医疗违规": "INDUSTRY_PROHIBITION",
    "金融违规": "INDUSTRY_PROHIBITION",
    "教育违规": "INDUSTRY_PROHIBITION",
    "房地产违规": "INDUSTRY_PROHIBITION",
    "食品违规": "INDUSTRY_PROHIBITION",
    "化妆品违规": "INDUSTRY_PROHIBITION",
}
FAMILIES = {
    "EXTREME_WORDS": ["极限用语", "绝对化"],
    "FALSE_PROMOTION": ["虚假宣传", "诱导焦虑", "资质虚构"],
    "COMPETITION_DENIGRATE": ["对比贬低", "贬低"],
    "INDUSTRY_PROHIBITION": ["行业禁区", "违规"],
}
SIGNALS = {
    "marketing": r"买到就是赚到|限时|特惠|立即购买|点击购买|推荐|赶紧|手慢|错过|优惠|品质有保障|放心选购|安心之选|明智之选|销量|热销|爆款",
    "personal": r"我个人觉得|我觉得|个人认为|我用过觉得|我喝过|我用着|个人体验|个人感受",
    "objective": r"\d+\s*(ghz|mhz|mb|gb|tb|mah|w|v|a|hz|nm|inch|英寸|毫米|厘米|克|千克|毫克)|处理器|型号|规格|参数|容量|频率|支持\s*\d+|速率|接口|版本",
    "qualifier": r"可能|之一|相对|大概|约|差不多|我觉得|个人觉得|好像|感觉",
    "backed": r"第三方|sgs|检测报告|临床验证|认证|国家标准|行业标准|权威机构",
    "quantified": r"\d+\s*(%|斤|元|天|个月|年|倍|个)",
    "guarantee": r"无效退款|包退|包换|保证|无效.*退|不.*不要钱",
    "cure": r"治愈|根治|治疗|治愈率|有效率|永不复发",
    "ingredient": r"含|添加|成分|维生素|烟酰胺|蛋白质|碳水",
    "feeling": r"感觉|好像|个人觉得|我觉得|用着",
    "denigrating": r"垃圾|吊打|碾压|完爆|黑心|劣质|骗人|虚假",
    "named": r"xx品牌|a品牌|某品牌|其他家|同行|竞品",
    "data": r"sgs|第三方|检测机构|检测报告",
    "illness": r"治疗|治愈|根治|糖尿病|血压|三高",
    "finance": r"保本保息|零风险|稳赚|年化收益|收益.*%",
    "education": r"保过|不过退款|命题组|押题命中",
    "natural": r"纯天然|零添加|有机",
    "word_of_mouth": r"都说好|回购率|口碑",
    "comparing": r"相比|更高效|更高",
    "sales": r"销量|遥遥领先|百万",
}


def violation_type(category: Column) -> Column:
    """By exact category; else by the first known one that contains or is contained; else EXTREME_WORDS."""
    table = F.create_map(*[F.lit(x) for pair in VIOLATION_TYPES.items() for x in pair])
    near = [F.when(category.contains(k) | F.lit(k).contains(category), F.lit(v)) for k, v in VIOLATION_TYPES.items()]
    return F.coalesce(F.try_element_at(table, category), *near, F.lit("EXTREME_WORDS"))


def text_signals(text: Column, signals: Mapping[str, str] = SIGNALS) -> Column:
    """A struct of booleans, one per signal; computed once per document."""
    return F.struct(*[F.coalesce(text.rlike(f"(?iuU){p}"), F.lit(False)).alias(name) for name, p in signals.items()])


@dataclass(frozen=True)
class Rule:
    """A row of the decision table. In ``evidence``, {w} stands for the hit word; a pair adds the text only if the signal is on."""

    when: str  # signals joined by &, ! negates, "" is always
    violation: bool
    severity: str
    confidence: float
    evidence: list
    mitigating: list = field(default_factory=list)
    v1: tuple = ()  # confidence, and, if they differ, violation and severity


# Confidences and wording of the judgements.
TABLE: dict[str, list[Rule]] = {
    "EXTREME_WORDS": [
        Rule("objective&!marketing", False, "pass", 0.9, ["纯客观技术参数陈述"], ["无营销推广意图"]),
        Rule("personal", False, "pass", 0.85, ["个人主观评价表达"], ["非商业广告主身份"]),
        Rule("marketing&qualifier", True, "low", 0.65, ['存在营销意图：使用了"{w}"等宣传用语', ("v2", "极限用语即使加限定词仍属违规")], ["使用了限定词软化绝对化表述"], (0.5,)),
        Rule("marketing", True, "high", 0.95, ['营销语境中使用极限用语"{w}"', "存在明确的促销推广意图"], [], (0.8,)),
        Rule("", True, "medium", 0.6, ['发现禁用词"{w}"'], [], (0.5,)),
    ],
    "FALSE_PROMOTION": [
        Rule("ingredient&!quantified&!guarantee&!cure", False, "pass", 0.85, ["成分功能的客观陈述"], ["未作效果承诺"]),
        Rule("feeling&!quantified&!guarantee", False, "pass", 0.75, ["个人感受的模糊表达"], ["未作确定性承诺"], (0.55, True, "medium")),
        Rule("cure", True, "high", 0.95, ['存在虚假宣传：使用"{w}"等表述', "涉及医疗效果宣称", ("guarantee", "存在效果保证承诺")], [], (0.8,)),
        Rule("guarantee", True, "high", 0.95, ['存在虚假宣传：使用"{w}"等表述', "存在效果保证承诺"], [], (0.8,)),
        Rule("quantified&marketing", True, "medium", 0.75, ["量化陈述配合营销推广"], ["未明确说明数据来源"], (0.6,)),
        Rule("", True, "medium", 0.7, ['存在宣传性表述："{w}"'], [], (0.5,)),
    ],
    "COMPETITION_DENIGRATE": [
        Rule("data&named&!denigrating", False, "pass", 0.8, ["有第三方数据支撑的参数对比"], ["未使用贬义词"], (0.6, True, "medium")),
        Rule("backed&named&!denigrating", False, "pass", 0.8, ["有第三方数据支撑的参数对比"], ["未使用贬义词"], (0.6, True, "medium")),
        Rule("denigrating", True, "high", 0.95, ['使用强烈贬义词"{w}"贬低竞争对手', ("named", "明确指向竞争对手")], [], (0.8,)),
        Rule("named&!data&!backed", True, "medium", 0.8, ["与竞争对手作比较但缺乏数据支撑"], [], (0.65,)),
        Rule("", True, "medium", 0.7, ["存在对比性宣传表述"], ["未明确点名具体竞争对手"], (0.5,)),
    ],
    "INDUSTRY_PROHIBITION": [
        *[
            Rule(s, True, "high", 0.95, ['行业禁区内容："{w}"', ("illness", "涉及疾病治疗功能宣称"), ("finance", "涉及保本保息承诺"), ("education", "涉及保过承诺")], [], (0.8,))
            for s in ("illness", "finance", "education")
        ],
        Rule("natural", True, "medium", 0.75, ['使用无法证明的表述"{w}"'], ["属于模糊性宣称，需进一步核实"], (0.6,)),
        Rule("", True, "medium", 0.7, [], [], (0.5,)),
    ],
}
# What version 1 overlooks: type, severity, signals, confidence, evidence.
OVERLOOKED = [
    ("FALSE_PROMOTION", "medium", "!quantified&!guarantee&word_of_mouth", 0.4, "统一 prompt 无法识别口碑型虚假宣传"),
    ("COMPETITION_DENIGRATE", "medium", "!named&comparing", 0.35, "统一 prompt 无法识别隐性对比贬低"),
    ("EXTREME_WORDS", "low", "qualifier", 0.4, "统一 prompt 误认为有限定词就不违规"),
    ("INDUSTRY_PROHIBITION", "medium", "natural", 0.35, "统一 prompt 无法识别模糊性宣称违规"),
    ("FALSE_PROMOTION", "medium", "quantified&!cure&sales", 0.4, "统一 prompt 误将营销数据当客观事实"),
]


def _holds(signals: Column, condition: str) -> Column:
    parts = [~signals[s[1:]] if s[0] == "!" else signals[s] for s in condition.split("&") if s]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _texts(items: list, word: Column, signals: Column, version: str) -> Column:
    def one(x):
        if isinstance(x, tuple):
            on, text = x
            return (F.lit(text) if version == on else F.lit(None)) if on in ("v1", "v2") else F.when(signals[on], F.lit(text))
        before, *after = x.split("{w}")
        return F.concat(F.lit(before), word, F.lit(after[0])) if after else F.lit(x)

    return F.array_compact(F.array(*[one(x).cast("string") for x in items])) if items else F.array().cast("array<string>")


def judgement(category: Column, word: Column, signals: Column, version: str = "v2") -> Column:
    """The judgement of a hit as a struct; nested conditions only, so it stays in generated code."""

    def struct(violation, severity, confidence, kind, evidence, mitigating):
        return F.struct(
            F.lit(violation).alias("is_violation"), F.lit(severity).alias("suggested_severity"), F.lit(float(confidence)).alias("confidence"),
            F.lit(kind).alias("violation_type"), evidence.alias("evidence"), mitigating.alias("mitigating_factors"),
        )

    none = F.array().cast("array<string>")
    out = None
    for kind, marks in FAMILIES.items():
        branch = None
        for r in TABLE[kind]:
            violation, severity, confidence = r.violation, r.severity, r.confidence
            if version == "v1" and r.v1:
                confidence = r.v1[0]
                violation, severity = r.v1[1:] or (violation, severity)
            mitigating = _texts(r.mitigating, word, signals, version)
            made = struct(violation, severity, confidence, kind, _texts(r.evidence, word, signals, version), mitigating)
            if version == "v1":
                for type_, level, condition, missed, text in OVERLOOKED:
                    if type_ == kind and level == severity:
                        made = F.when(_holds(signals, condition), struct(False, "pass", missed, kind, F.array(F.lit(text)), mitigating)).otherwise(made)
            branch = F.when(_holds(signals, r.when), made) if branch is None else branch.when(_holds(signals, r.when), made)
        in_family = reduce(lambda a, b: a | b, [category.contains(m) for m in marks])
        out = F.when(in_family, branch) if out is None else out.when(in_family, branch)
    return out.otherwise(struct(False, "medium", 0.5, "EXTREME_WORDS", none, none))


def judge_context(hits: DataFrame, version: str = "v2", signals: Mapping[str, str] = SIGNALS, text: str = "text") -> DataFrame:
    """Adds the judgement columns to hits (word, category, and the document's text or its ``signals``)."""
    df = hits if "signals" in hits.columns else hits.withColumn("signals", text_signals(F.col(text), signals))
    df = df.withColumn("j", judgement(F.col("category"), F.col("word"), F.col("signals"), version))
    c = F.col("j.confidence")
    return df.select(
        *[x for x in hits.columns if x != "signals"],
        F.col("j.is_violation").alias("is_violation"),
        F.lit(f"基于{version}判断规则分析").alias("reasoning"),
        c.alias("confidence"),
        F.round(c * 0.9, 3).alias("violation_type_confidence"),
        F.round(c * 0.85, 3).alias("severity_confidence"),
        F.when(F.col("signals.marketing"), 0.85).otherwise(0.4).alias("context_relevance"),
        "j.evidence",
        "j.mitigating_factors",
        "j.suggested_severity",
        "j.violation_type",
    )


def parse_judgments(df: DataFrame, raw_col: str, default_type: str = "EXTREME_WORDS") -> DataFrame:
    """Adds the judgement columns from a model's raw replies; ``unparsed`` has the reply where it is no JSON object."""
    body = F.regexp_extract(F.coalesce(F.col(raw_col), F.lit("")), r"(?s)\{.*\}", 0)
    m = F.from_json(F.when(body != "", body), "map<string,string>", {"mode": "PERMISSIVE"})
    df = df.withColumn("__m", m)
    key = lambda k: F.try_element_at(F.col("__m"), F.lit(k))
    number = lambda k, other: F.coalesce(key(k).try_cast("double"), other)
    overall = number("overall_confidence", number("confidence", F.lit(0.5)))
    bad = F.col("__m").isNull() | reduce(
        lambda a, b: a | b,
        [key(k).isNotNull() & key(k).try_cast("double").isNull() for k in ("overall_confidence", "confidence", "violation_type_confidence", "severity_confidence", "context_relevance")],
    )
    texts = lambda k: F.when(key(k).isNull(), F.array().cast("array<string>")).when(key(k).rlike(r"^\s*\["), F.from_json(key(k), "array<string>")).otherwise(F.array(key(k)))
    severity = F.lower(F.coalesce(key("suggested_severity"), F.lit("medium")))
    off = key("is_violation").isin("false", "0", "", "null") | (F.map_contains_key("__m", F.lit("is_violation")) & key("is_violation").isNull())
    good = lambda c: F.when(~F.coalesce(bad, F.lit(True)), c)
    return df.withColumns(
        {
            "is_violation": good(~F.coalesce(off, F.lit(False))),
            "reasoning": good(F.coalesce(key("reasoning"), F.lit(""))),
            "confidence": good(clamp(overall)),
            "violation_type_confidence": good(clamp(number("violation_type_confidence", overall * 0.9))),
            "severity_confidence": good(clamp(number("severity_confidence", overall * 0.85))),
            "context_relevance": good(clamp(number("context_relevance", overall * 0.8))),
            "evidence": good(texts("evidence")),
            "mitigating_factors": good(texts("mitigating_factors")),
            "suggested_severity": good(F.when(severity.isin("high", "medium", "low", "pass"), severity).otherwise("medium")),
            "violation_type": good(F.coalesce(key("violation_type"), F.lit(default_type))),
            "unparsed": F.when(F.coalesce(bad, F.lit(True)), F.col(raw_col)),
        }
    ).drop("__m")


def feedback_counts(feedback: DataFrame, by: str = "word") -> DataFrame:
    """Per word: confirm, dismiss, modify, total; an unknown action counts in the total only."""
    return feedback.groupBy(by).agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("confirm", "dismiss", "modify")], F.count("*").alias("total"))


@dataclass(frozen=True)
class Shift:
    """What past feedback on a word does to its judgements: lowers or raises confidences, and lets a doubtful violation pass."""

    confirm: Column
    dismiss: Column
    total: Column
    minimum: int = 8

    def moved(self, confidence: Column) -> Column:
        no, yes = self.dismiss / self.total, self.confirm / self.total
        down = F.coalesce((self.total >= self.minimum) & (no >= 0.8), F.lit(False))
        up = F.coalesce((self.total >= self.minimum) & (yes >= 0.8), F.lit(False))
        lower, higher = F.least(F.lit(0.3), no * 0.5), F.least(F.lit(0.2), yes * 0.3)
        return F.when(down, F.greatest(F.lit(0.1), confidence - lower)).when(up, F.least(F.lit(0.99), confidence + higher)).otherwise(confidence)

    def passes(self, is_violation: Column, confidence: Column) -> Column:
        down = F.coalesce((self.total >= self.minimum) & (self.dismiss / self.total >= 0.8), F.lit(False))
        return down & is_violation & (self.moved(confidence) < 0.4)

    def note(self) -> Column:
        return F.concat(F.lit("根据 "), self.total.cast("string"), F.lit(" 次历史反馈中 "), self.dismiss.cast("string"), F.lit(" 次被驳回，系统自动调整为不违规"))


def adjust_by_feedback(judgments: DataFrame, counts: DataFrame, minimum: int = 8) -> DataFrame:
    """Lowers confidences of words that are mostly dismissed (a violation below 0.4 passes) and raises those of words mostly confirmed."""
    df = judgments.join(small_side(counts.select("word", "confirm", "dismiss", "total")), "word", "left")
    c = F.col
    shift = Shift(c("confirm"), c("dismiss"), c("total"), minimum)
    passes = shift.passes(c("is_violation"), c("confidence"))
    return df.select(
        *[
            {
                "confidence": shift.moved(c("confidence")).alias("confidence"),
                "violation_type_confidence": shift.moved(c("violation_type_confidence")).alias("violation_type_confidence"),
                "is_violation": (c("is_violation") & ~passes).alias("is_violation"),
                "suggested_severity": F.when(passes, "pass").otherwise(c("suggested_severity")).alias("suggested_severity"),
                "mitigating_factors": F.when(passes, F.array_append("mitigating_factors", shift.note())).otherwise(c("mitigating_factors")).alias("mitigating_factors"),
            }.get(x, c(x))
            for x in judgments.columns
        ]
    )


# The placeholder and the reasons of suggestions.
BY_HAND, FROM_TABLE, NOT_FOUND = "[需人工替换]", "从合规映射表匹配", "映射表无匹配"


def first_alternatives(replacements: DataFrame) -> DataFrame:
    """(prohibited, first): one alternative a word. Of several rows of a word with alternatives the last by ``updated_at`` counts, if
    there is such a column; of equals the one whose first alternative sorts first."""
    rows = replacements.select("prohibited", F.try_element_at("alternatives", F.lit(1)).alias("first"), *[c for c in ("updated_at",) if c in replacements.columns]).filter("first IS NOT NULL")
    if "updated_at" in rows.columns:
        last = rows.groupBy("prohibited").agg(F.max("updated_at").alias("last"))
        rows = rows.join(last, "prohibited").filter(F.col("updated_at").eqNullSafe(F.col("last")))
    return rows.groupBy("prohibited").agg(F.min("first").alias("first"))


def suggest_replacements(violations: DataFrame, replacements: DataFrame, word: str = "word") -> DataFrame:
    """Adds ``replacement``, the first alternative (prohibited, alternatives), and ``replacement_reason``."""
    first = first_alternatives(replacements).withColumnRenamed("first", "__first")
    df = violations.join(small_side(first), violations[word] == first["prohibited"], "left").drop("prohibited")
    return df.withColumn("replacement", F.coalesce("__first", F.lit(BY_HAND))).withColumn("replacement_reason", F.when(F.col("__first").isNotNull(), FROM_TABLE).otherwise(NOT_FOUND)).drop("__first")
