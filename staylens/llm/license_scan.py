"""License detection by ordered signature rules (operator 8).

Rules are regular expressions over normalised words (each followed by one
space), so punctuation, line breaks and case do not matter. A document is split
into words only if one of the rules' keywords occurs in it, and a rule runs only
if its own keyword does. A match inside the interval of a match of higher rank
is suppressed. Everything is column expressions on one row: no shuffle, no
Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from staylens.llm.common import text_or_empty

# Words after lower-casing, and the phrases of the base scan.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str
    base: bool = False


L = "licen[cs]e"
# Label, name in running text, identifier, keyword of the name.
FAMILIES = [
    ("mit", f"(?:mit|expat) {L}", "mit", "licen"),
    ("mit-0", f"mit no attribution(?: {L})?|mit 0", "mit 0", "mit "),
    ("apache-1.1", f"apache (?:software )?{L} (?:version |v ?)?1 1", "apache 1 1", "apache"),
    ("apache-2", f"apache (?:software )?{L}(?: version| v)? ?2(?: 0)?", "apache 2 0", "apache"),
    ("bsd-2-clause", f"(?:simplified|freebsd|2 clause|two clause) bsd {L}|bsd 2 clause(?: {L})?", "bsd 2 clause", "bsd"),
    ("bsd-3-clause", f"(?:new|modified|revised|3 clause|three clause) bsd {L}|bsd 3 clause(?: {L})?", "bsd 3 clause", "bsd"),
    ("bsd-4-clause", f"(?:original|4 clause|four clause) bsd {L}|bsd 4 clause(?: {L})?", "bsd 4 clause", "bsd"),
    ("0bsd", f"zero clause bsd(?: {L})?|0bsd", "0bsd", "bsd"),
    ("isc", f"isc {L}", "isc", "isc "),
    ("zlib", f"zlib(?: libpng)? {L}", "zlib", "zlib"),
    ("boost-1", f"boost software {L}(?: version)?(?: 1 0)?", "bsl 1 0", "boost"),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", f"do what the fuck you want to public {L}|wtfpl", "wtfpl", "public"),
    ("gpl-1", f"(?:gnu )?general public {L}(?: version| v)? ?1(?: 0)?|gnu gpl v?1", "gpl 1 0", "g"),
    ("gpl-2", f"(?:gnu )?general public {L}(?: version| v)? ?2(?: 0)?|gnu gpl v? ?2", "gpl 2 0", "g"),
    ("gpl-3", f"(?:gnu )?general public {L}(?: version| v)? ?3(?: 0)?|gnu gpl v? ?3", "gpl 3 0", "g"),
    ("gpl", f"gnu general public {L}|gnu gpl", "gpl", "gnu"),
    ("lgpl-2", f"(?:gnu )?(?:library|lesser) general public {L}(?: version| v)? ?2(?: 0)?", "lgpl 2 0", "general"),
    ("lgpl-2.1", f"(?:gnu )?lesser general public {L}(?: version| v)? ?2 1", "lgpl 2 1", "general"),
    ("lgpl-3", f"(?:gnu )?lesser general public {L}(?: version| v)? ?3(?: 0)?", "lgpl 3 0", "general"),
    ("agpl-3", f"(?:gnu )?affero general public {L}(?: version| v)?(?: ?3)?(?: 0)?", "agpl 3 0", "affero"),
    ("fdl", f"(?:gnu )?free documentation {L}(?: version| v)?(?: 1 [123])?", "gfdl 1 3", "documentation"),
    ("mpl-1.1", f"mozilla public {L}(?: version| v)? ?1 1", "mpl 1 1", "mozilla"),
    ("mpl-2", f"mozilla public {L}(?: version| v)?(?: ?2)?(?: 0)?", "mpl 2 0", "mozilla"),
    ("epl-1", f"eclipse public {L}(?: version| v)? ?1(?: 0)?", "epl 1 0", "eclipse"),
    ("epl-2", f"eclipse public {L}(?: version| v)? ?2(?: 0)?", "epl 2 0", "eclipse"),
    ("cddl", f"common development and distribution {L}", "cddl 1 0", "distribution"),
    ("eupl", f"european union public {L}", "eupl 1 2", "european"),
    ("artistic-2", f"artistic {L}(?: version)?(?: 2)?(?: 0)?", "artistic 2 0", "artistic"),
    ("psf-2", f"python software foundation {L}", "psf 2 0", "python"),
    ("odbl", f"open (?:data commons )?(?:open )?database {L}", "odbl 1 0", "database"),
    ("ofl", f"sil open font {L}", "ofl 1 1", "font"),
    ("cc0", "cc0|creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", "cc0 1 0", "c"),
    ("cc-by", f"creative commons attribution(?: [1-4] [05])?(?: international)?(?: {L})?|cc by [1-4] [05]", "cc by 4 0", "c"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: [1-4] [05])?|cc by sa(?: [1-4] [05])?", "cc by sa 4 0", "c"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?|cc by nd(?: [1-4] [05])?", "cc by nd 4 0", "c"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: [1-4] [05])?|cc by nc(?: [1-4] [05])?", "cc by nc 4 0", "c"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?|cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0", "c"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?|cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0", "c"),
]
# Phrasings around a license's name or identifier, from strong to
# weak: priority, weight, keyword (none: that of the name), pattern.
PHRASINGS = [
    (900, 1.0, "spdx", "spdx license identifier {id}"),
    (800, 0.95, " under ", "(?:(?:is|are|be|made) )?(?:dual )?(?:licen[cs]ed|released|distributed|available|provided|published|issued|shared) under (?:the )?(?:(?:terms|conditions)(?: and conditions)? of (?:the )?)?(?:{name})"),
    (700, 0.9, "subject", "subject to (?:the )?(?:(?:terms|conditions) of (?:the )?)?(?:{name})"),
    (650, 0.9, "governed", "governed by (?:the )?(?:(?:terms|conditions) of (?:the )?)?(?:{name})"),
    (600, 0.85, "licen", "licen[cs]es? (?:is |type |name )?{id}"),
    (500, 0.7, "", "(?:{name})"),
]
# Notices that belong to no family.
NOTICES = [
    Rule("all-rights-reserved", 300, 0.6, "rights", "all rights reserved"),
    Rule("proprietary", 300, 0.6, "proprietary", "proprietary and confidential"),
    Rule("public-domain", 400, 0.7, "domain", "(?:in|into|to) the public domain"),
    Rule("permissive-notice", 450, 0.7, "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("permissive-notice", 450, 0.7, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    Rule("permissive-notice", 450, 0.7, "purpose", "permission to use copy modify and or distribute this software for any purpose"),
]
#: Documents with none of these hold no match; the last two need a closer look.
GATE = ["licen", "spdx", "rights", "proprietary", "domain", "granted", "redistribution", "purpose", "gnu",
        "commons", "cc0", "bsd", "wtfpl"]
CLOSER = {"cc": r"(?i)cc[^0-9a-z\x80-\x{10FFFF}]+by", "mit": r"(?i)mit[^0-9a-z\x80-\x{10FFFF}]+(?:no|0)"}


def gate(text: Column) -> Column:
    """Whether a text can hold a match: plain substring searches first."""

    def within(low: Column) -> Column:
        found = F.contains(low, F.lit(GATE[0]))
        for word in GATE[1:]:
            found = found | F.contains(low, F.lit(word))
        for word, pattern in CLOSER.items():
            found = found | (F.contains(low, F.lit(word)) & low.rlike(pattern))
        return found

    return F.get(F.transform(F.array(F.lower(text)), within), F.lit(0))


def rules() -> list[Rule]:
    found = [Rule(label, 1000, 1.0, phrase.split()[-2], phrase, True) for phrase, label in BASE.items()]
    for label, name, identifier, keyword in FAMILIES:
        for priority, weight, word, pattern in PHRASINGS:
            found.append(Rule(label, priority, weight, word or keyword,
                              pattern.replace("{name}", name).replace("{id}", identifier)))
    return found + NOTICES


def _words(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def count_words(text: Column) -> Column:
    """Number of words, from the pieces between separators (empty only at the ends)."""

    def count(pieces: Column) -> Column:
        ends = (F.get(pieces, F.lit(0)) == "").cast("int") + (F.element_at(pieces, -1) == "").cast("int")
        return F.greatest(F.size(pieces) - ends, F.lit(0)).cast("long")

    return F.get(F.transform(F.array(F.split(text, BETWEEN_WORDS, -1)), count), F.lit(0))


def _matches(norm: Column, known: Column) -> Column:
    """All matches of the rules whose keyword occurs in a normalised text."""

    def of_rule(rule: Column) -> Column:
        gaps = F.split(norm, rule["pattern"], -1)
        found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("spans"))

        def step(state: Column, pair: Column) -> Column:
            first = state["at"] + _words(pair["gap"])
            n = _words(pair["found"])
            return F.struct(
                (first + n).alias("at"),
                F.array_append(state["spans"], F.struct(first.alias("start"), n.alias("n"))).alias("spans"),
            )

        pairs = F.transform(found, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), m.alias("found")))
        return F.transform(F.aggregate(pairs, start, step)["spans"], lambda s: F.struct(
            s["start"].alias("start"), s["n"].alias("n"), rule["label"].alias("label"),
            rule["priority"].alias("priority"), rule["weight"].alias("weight"), rule["base"].alias("base"),
        ))

    return F.flatten(F.transform(F.filter(known, lambda r: F.contains(norm, r["keyword"])), of_rule))


def _kept(matches: Column) -> Column:
    """Matches that no match of higher rank contains; base matches always stay."""

    def outranked(m: Column) -> Column:
        return F.exists(matches, lambda o: (
            (o["start"] <= m["start"]) & (o["start"] + o["n"] >= m["start"] + m["n"])
            & ((o["priority"] > m["priority"]) | ((o["priority"] == m["priority"]) & (o["n"] > m["n"])))
        ))

    return F.filter(matches, lambda m: m["base"] | ~outranked(m))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words and the spans found, in words from 0.

    ``spans`` holds start, n, label, priority, weight and whether it is a base
    phrase. Null and empty texts have no words and no spans. Repeated rows and
    null ids pass through; an empty table gives an empty result; other columns
    are ignored.
    """
    known = F.array(*[
        F.struct(
            F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"),
            F.lit(r.keyword).alias("keyword"), F.lit(f"(?<![^ ])(?:{r.pattern}) ").alias("pattern"),
            F.lit(r.base).alias("base"),
        )
        for r in rules()
    ])
    text = F.col("body")
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    norm = F.concat(F.array_join(words, " "), F.lit(" "))
    # One-element arrays bind a value to a name, so that it is computed once.
    spans = F.get(F.transform(F.array(norm), lambda n: F.get(
        F.transform(F.array(_matches(n, known)), _kept), F.lit(0))), F.lit(0))
    nothing = F.array().cast(
        "array<struct<start:int,n:int,label:string,priority:int,weight:double,base:boolean>>")
    return df.select(F.col(id_col), text_or_empty(text_col).alias("body")).select(
        F.col(id_col), count_words(text).alias("n_words"),
        F.when(gate(text), spans).otherwise(nothing).alias("spans"),
    )


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels and base places per document."""

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    def of(spans: Column) -> Column:
        base = F.filter(spans, lambda m: m["base"])
        starts = F.transform(base, lambda m: m["start"].cast("long"))
        return F.struct(
            F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(spans).alias("labels"),
            F.coalesce(F.array_max(F.transform(spans, lambda m: m["weight"])), F.lit(0.0)).alias("score"),
        )

    found = F.get(F.transform(F.array("spans"), of), F.lit(0))
    return scanned.select(id_col, "n_words", found.alias("found")).select(id_col, "n_words", "found.*")
