"""Dictionary scan: hits of restricted terms in documents."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from claimscan.functions.text import occurrences
from claimscan.functions.work import small_rows, stash

HIT = "struct<rule_idx: int, word: string, category: string, start: int, end: int, regulation_ref: string>"
#: Words with notes that go to the tasks; rules that are one built-in pattern of ``flag_documents``.
MAX_NOTES, MAX_PATTERN = 100_000, 200
# Background colours of marked violations by severity.
COLOURS = {"high": "#ff4444", "medium": "#ffaa00", "low": "#ffdd00"}


def _entries(rules: DataFrame) -> list[tuple]:
    return [(r.rule_idx, r.pattern, r.category, r.regulation_ref) for r in sorted(small_rows(rules), key=lambda r: r.rule_idx)]


def _combined(patterns: list[str]) -> tuple[re.Pattern, set[str]]:
    """A pattern that is found where any of ``patterns`` is, and those that can't be in it: with groups, whose numbers it would shift, or flags."""
    apart = set()
    for p in patterns:
        try:
            if re.compile(f"(?:{p})").groups:
                apart.add(p)
        except re.error:
            apart.add(p)
    return re.compile("|".join(f"(?:{p})" for p in patterns if p not in apart) or r"(?!)", re.IGNORECASE), apart


@cache
def _fold_table() -> np.ndarray:
    """For each code point one that all letters which differ by case only share; it may join others too."""
    every = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):  # no letters with case lie beyond
        folded = "" if 0xD800 <= c < 0xE000 else chr(c).casefold()
        if folded:
            every[c] = ord(folded[0])
    every[[0x130, 0x131]] = ord("i")
    return every


#: A pattern that stands for itself: no special characters but escaped ones.
LITERAL = re.compile(r"(?:[^\\.^$*+?{}\[\]|()]|\\[^\w\s])+")


class Dictionary:
    """The rules of a scan: literal ones in one Aho-Corasick automaton, whatever their number, the others as regular expressions."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.patterns, self.compiled = patterns, {}
        self.words = {n: re.sub(r"\\(.)", r"\1", p) for n, p in enumerate(patterns) if LITERAL.fullmatch(p)}
        rest = [n for n in range(len(patterns)) if n not in self.words]
        self.any_rule, apart = _combined([patterns[n] for n in rest])
        self.rest, self.always = rest, [n for n in rest if patterns[n] in apart]
        owners: dict[str, list[int]] = {}
        for n, w in self.words.items():
            owners.setdefault(self.fold(w), []).append(n)
        self.automaton = ahocorasick.Automaton()
        for w, own in owners.items():
            self.automaton.add_word(w, (len(w), own))
        self.automaton.make_automaton()

    def fold(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tobytes().decode("utf-32-le", "surrogatepass")

    def rule(self, n: int) -> re.Pattern:
        if n not in self.compiled:
            self.compiled[n] = re.compile(self.patterns[n], re.IGNORECASE)
        return self.compiled[n]

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, start, end) of what each rule's pattern finds, one after the other without overlap, in the order of rules and places."""
        out = []
        if self.words:
            found = sorted((n, end + 1 - size, end + 1) for end, (size, own) in self.automaton.iter(self.fold(text)) for n in own)
            last, upto = -1, 0
            for n, start, end in found:
                upto = upto if n == last else 0
                last = n
                # the folding may be too coarse; with ASCII on both sides it is not
                if start >= upto and ((text[start:end].isascii() and self.words[n].isascii()) or self.rule(n).fullmatch(text, start, end)):
                    out.append((n, start, end))
                    upto = end
        for n in self.rest if self.rest and self.any_rule.search(text) else self.always:
            out += [(n, *m.span()) for m in self.rule(n).finditer(text)]
        return sorted(out) if self.words and self.rest else out


def find_hits(docs: DataFrame, rules: DataFrame, text: str = "text", notes: DataFrame | None = None) -> DataFrame:
    """Adds ``hits``: all matches of all rules, in dictionary order and then by place.

    A span is reported once, by the earliest rule; spans of different rules may overlap. Offsets are
    half-open and count code points. The rules go to the tasks with the code: literal ones are looked for by one automaton, for the others a combined
    pattern passes over documents without any match. ``notes`` (word and further columns) are looked up by
    the matched text and added to each hit as ``note``: in the tasks up to MAX_NOTES words, by a join of the hits beyond that.
    """
    return _with_hits(docs, _entries(rules), text, notes)


def _with_hits(docs: DataFrame, entries: list[tuple], text: str, notes: DataFrame | None = None) -> DataFrame:
    if notes is not None:
        notes = stash(notes, "notes")
        if notes.count() > MAX_NOTES:
            return _noted(_with_hits(docs, entries, text), notes)
    known = {} if notes is None else {r["word"]: {k: v for k, v in r.asDict(True).items() if k != "word"} for r in notes.collect()}
    sent = docs.sparkSession.sparkContext.broadcast((entries, known))
    note = None if notes is None else to_arrow_schema(notes.drop("word").schema)

    def run(batches):
        entries, known = sent.value
        dictionary = Dictionary([p for _, p, _, _ in entries])
        fields = [("rule_idx", pa.int32()), ("word", pa.string()), ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("regulation_ref", pa.string())]
        kind = pa.list_(pa.struct(fields if note is None else [*fields, ("note", pa.struct(list(note)))]))
        for batch in batches:
            out = []
            for s in batch.column(text).to_pylist():
                found: dict[tuple[int, int], dict] = {}
                for n, start, end in dictionary.matches(s) if s else ():
                    if (start, end) not in found:
                        i, _, c, ref = entries[n]
                        word = s[start:end]
                        found[start, end] = {"rule_idx": i, "word": word, "category": c, "start": start, "end": end, "regulation_ref": ref} | ({} if note is None else {"note": known.get(word)})
                out.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "hits"])

    docs = docs.drop("hits")
    hit = HIT if notes is None else HIT.removesuffix(">") + f", note: {notes.drop('word').schema.simpleString()}>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, hits array<{hit}>")


def _noted(found: DataFrame, notes: DataFrame) -> DataFrame:
    """``found`` with the note of each hit's word, joined by word; only documents with hits take part."""
    rows = stash(found.withColumn("__row", F.monotonically_increasing_id()), "found")
    each = rows.select("__row", F.posexplode("hits").alias("__at", "h"))
    note = notes.select(F.col("word").alias("__word"), F.struct(*[c for c in notes.columns if c != "word"]).alias("note"))
    each = each.join(note, each["h"]["word"] == note["__word"], "left").select("__row", F.struct("__at", F.col("h").withField("note", F.col("note")).alias("h")).alias("x"))
    again = each.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]).alias("__hits"))
    empty = F.array().cast(dict(again.dtypes)["__hits"])
    return rows.join(again, "__row", "left").withColumn("hits", F.coalesce("__hits", empty)).drop("__row", "__hits")


def scan_terms(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per hit: key, rule_idx, word, category, start, end, regulation_ref."""
    return find_hits(docs.select(key, text), rules, text).select(key, F.inline("hits"))


#: What both regular expression dialects read alike: no groups but plain ones, no escapes but digits and punctuation, no nested sets.
ALIKE = re.compile(r"(?:[^\\(\[]|\\[dD]|\\[^\w\s]|\((?!\?)|\(\?:|\[(?:[^\\\[\]&]|\\[dD]|\\[^\w\s])+\])*")


def flag_documents(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``flagged``: the document has a hit. Rules that Java reads as Python does are one built-in pattern, unless they are many; others are scanned for."""
    entries = _entries(rules)
    alike = [e for e in entries if ALIKE.fullmatch(e[1])] if len(entries) <= MAX_PATTERN else []
    others = [e for e in entries if e not in alike]
    pattern = "|".join(f"(?:{p})" for _, p, _, _ in alike) or "(?!)"
    flagged = F.coalesce(F.col(text).rlike(f"(?iuUd){pattern}"), F.lit(False))
    if others:
        names = [c for c in docs.columns if c != "flagged"]
        rows = _with_hits(docs.select(F.struct(*names).alias("row"), F.col(text).alias("text")), others, "text").select("row.*", (F.size("hits") > 0).alias("__hit"))
        return rows.withColumn("flagged", flagged | F.col("__hit")).drop("__hit")
    return docs.withColumn("flagged", flagged)


def keyword_weights(docs: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``weight``: the sum over the lexicon (keyword, weight) of weight times occurrences."""
    total = F.lit(0.0)
    for r in small_rows(lexicon):
        total = total + occurrences(F.col(text), r.keyword) * F.lit(float(r.weight))
    return docs.withColumn("weight", F.coalesce(total, F.lit(0.0)))


def highlight(docs: DataFrame, violations: str = "violations", text: str = "text", out: str = "highlighted_text") -> DataFrame:
    """Adds the text with every violation (text, start, end, severity, category, explanation) in a mark.

    A span that overlaps one kept to its left is left out.
    """
    v = F.array_sort(F.transform(F.col(violations), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x.alias("v"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    colour = lambda x: F.coalesce(F.create_map(*[F.lit(y) for p in COLOURS.items() for y in p])[x["severity"]], F.lit(COLOURS["low"]))

    def add(s, y):
        x = y["v"]
        mark = F.concat(F.lit('<mark style="background:'), colour(x), F.lit('" title="'), x["category"], F.lit(": "), x["explanation"], F.lit('">'), x["text"], F.lit("</mark>"))
        between = F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"])
        return F.when(x["start"] >= s["at"], F.struct(F.concat(s["done"], between, mark).alias("done"), x["end"].alias("at"))).otherwise(s)

    whole = F.aggregate(v, start, add, lambda s: F.concat(s["done"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))))
    return docs.withColumn(out, F.when(F.size(violations) > 0, whole).otherwise(F.col(text)))
