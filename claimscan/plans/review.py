"""The review job: documents in, one verdict per document out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscan.functions.text import short_hash
from claimscan.operators.judge import BY_HAND, SIGNALS, Shift, feedback_counts, first_alternatives, judgement, text_signals
from claimscan.operators.scan import find_hits, highlight
from claimscan.operators.search import classify_queries, encode_hashed, format_citations, retrieve

RISKS = ["pass", "low", "medium", "high"]


def word_notes(replacements: DataFrame | None, citations: DataFrame | None, feedback: DataFrame | None) -> DataFrame | None:
    """(word, suggestion, law_content, confirm, dismiss, total), as far as the tables are given: all that is known of a word."""
    parts = []
    if replacements is not None:
        parts.append(first_alternatives(replacements).select(F.col("prohibited").alias("word"), F.col("first").alias("suggestion")))
    if citations is not None:
        parts.append(citations.groupBy("word").agg(F.max("law_content").alias("law_content")))
    if feedback is not None:
        parts.append(feedback_counts(feedback).select("word", "confirm", "dismiss", "total"))
    out = None
    for p in parts:
        p = p.filter("word IS NOT NULL")
        out = p if out is None else out.join(p, "word", "full")
    return None if out is None else out.select("word", *[c if c in out.columns else F.lit(None).cast("string").alias(c) for c in ("suggestion", "law_content")], *[c for c in ("confirm", "dismiss", "total") if c in out.columns])


def cite(words: DataFrame, corpus: DataFrame, now: float, patterns: DataFrame, k: int = 3, lexicon: list[tuple[str, float]] = (), dim: int = 512, index: DataFrame | None = None) -> DataFrame:
    """(word, law_content): the k best sources for each distinct word, as labelled extracts. One query a word, however many hits it has.

    ``words`` may bring their own ``embedding``; else they are encoded like the corpus, with ``lexicon`` and ``dim``. ``index`` is a full-text index of the corpus,
    else one is made.
    """
    asked = words.filter("word IS NOT NULL").dropDuplicates(["word"]).withColumns({"query_id": F.col("word"), "text": F.col("word")})
    if "embedding" not in words.columns:
        asked = encode_hashed(asked, "text", list(lexicon), dim)
    found = retrieve(classify_queries(asked, patterns), corpus, now, k, index=index)
    cited = format_citations(found.join(corpus.select("key", "source", "value"), "key"))
    return cited.select(F.col("query_id").alias("word"), F.col("citation").alias("law_content"))


def review(
    docs: DataFrame,
    rules: DataFrame,
    replacements: DataFrame | None = None,
    citations: DataFrame | None = None,
    feedback: DataFrame | None = None,
    version: str = "v2",
    signals: Mapping[str, str] = SIGNALS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: status, overall_risk, counts of hits, confirmed and rejected, violations, marked text, summary.

    The hits of a document stay in an array beside it, from the scan to the verdict, so nothing is
    shuffled. Documents without a hit stay, as safe. ``replacements`` (prohibited, alternatives), ``citations`` (word,
    law_content) and ``feedback`` (word, action) are small or become so by counting; what they say of a word is joined into one
    table of notes, which the scan looks up by the matched text. Feedback adjusts the judgements before the verdict.
    """
    notes = word_notes(replacements, citations, feedback)
    # the signals' patterns run over documents with hits only
    found = find_hits(docs.select(key, text), rules, text, notes).withColumn("signals", F.when(F.size("hits") > 0, text_signals(F.col(text), signals)))
    note = lambda h, name, other: F.coalesce(h["note"][name], F.lit(other)) if notes is not None else F.lit(other)

    def violation(h):
        j = h["j"]
        return F.struct(
            F.concat(F.lit("v-"), short_hash(h["word"])).alias("id"),
            h["word"].alias("text"),
            h["start"].alias("start"),
            h["end"].alias("end"),
            F.when(j["confidence"] > 0.8, "high").otherwise("medium").alias("severity"),
            h["category"].alias("category"),
            j["confidence"].alias("confidence"),
            h["regulation_ref"].alias("law_article"),
            note(h, "law_content", "").alias("law_content"),
            F.lit(f"基于{version}判断规则分析").alias("explanation"),
            note(h, "suggestion", BY_HAND).alias("suggestion"),
        )

    def judge(h):
        j = judgement(h["category"], h["word"], F.col("signals"), version)
        if feedback is None:
            return h.withField("j", j)
        shift = lambda j: Shift(h["note"]["confirm"], h["note"]["dismiss"], h["note"]["total"])
        moved = F.transform(F.array(j), lambda j: j.withField("is_violation", j["is_violation"] & ~shift(j).passes(j["is_violation"], j["confidence"])).withField("confidence", shift(j).moved(j["confidence"])))
        return h.withField("j", moved[0])

    judged = F.transform("hits", judge)
    df = found.withColumn("judged", judged).withColumn("violations", F.transform(F.filter("judged", lambda h: h["j"]["is_violation"]), violation))
    level = F.array_max(F.transform("violations", lambda v: F.array_position(F.array(*map(F.lit, RISKS)), v["severity"])))
    n, hits = F.size("violations"), F.size("hits")
    risk = F.coalesce(F.get(F.array(*map(F.lit, RISKS)), level.cast("int") - 1), F.lit("pass"))
    df = highlight(df, "violations", text)
    # Wording of the summary.
    summary = (
        F.when(n > 0, F.concat(F.lit("检测到 "), n.cast("string"), F.lit(" 处违规，最高风险等级："), risk))
        .when(hits > 0, F.concat(F.lit("检测到 "), hits.cast("string"), F.lit(" 个疑似禁用词，经语境分析均不构成违规。")))
        .otherwise("未发现违规内容。")
    )
    return df.select(
        key,
        F.when(n > 0, "violation_found").otherwise("safe").alias("status"),
        risk.alias("overall_risk"),
        hits.cast("long").alias("n_hits"),
        n.cast("long").alias("n_confirmed"),
        (hits - n).cast("long").alias("n_rejected"),
        "violations",
        "highlighted_text",
        summary.alias("summary"),
    )
