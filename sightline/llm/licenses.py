"""License scans: ordered signature rules over word text, gated by keywords, with overlaps resolved by priority.

Texts are lower-cased (A to Z) words joined by one space. A cheap test for a few substrings gates the rules; of those
each is tried only where its own keyword stands. Matches begin and end at words. They are taken by rank: the better priority,
then the longer one, the first, and by label. One that lies in a match that stays, or overlaps it, goes; what lies only in
matches that go stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import fresh, let

#: Fixed by contract: what separates words, and the base phrases with their labels.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Rule:
    """priority: smaller is better; trust: how sure a match is, 0 to 1."""

    label: str
    keyword: str
    regex: str
    priority: int
    trust: float


def rules() -> list[Rule]:
    """The signature rules in order; families with versions and parts are spelled out by loops."""
    out: list[Rule] = []

    def add(label: str, keyword: str, regex: str, priority: int, trust: float) -> None:
        out.append(Rule(label, keyword, regex, priority, trust))

    # the GNU family: the version, and whether later ones are granted
    later = r"(?: (?:or|and) (?:at your option )?any later version| or later)"
    for name, tag, versions in (("general public license", "gpl", ("1", "2", "3")), ("lesser general public license", "lgpl", ("2 1", "3")), ("library general public license", "lgpl", ("2",)), ("affero general public license", "agpl", ("1", "3")), ("free documentation license", "gfdl", ("1 1", "1 2", "1 3"))):
        add(tag, name, rf"(?:gnu )?{name}", 50, 0.7)
        add(tag, name, rf"under the terms of the (?:gnu )?{name}(?: as published by the free software foundation)?", 30, 0.9)
        for v in versions:
            add(f"{tag}-{v.replace(' ', '.')}", name, rf"(?:gnu )?{name} (?:version |v ?)?{v}(?: 0)?(?! \d)", 20, 0.95)
            add(f"{tag}-{v.replace(' ', '.')}", name, rf"version {v}(?: 0)? of the (?:gnu )?{name}", 20, 0.95)
            add(f"{tag}-{v.replace(' ', '.')}-or-later", name, rf"(?:gnu )?{name} (?:version |v ?)?{v}(?: 0)?{later}", 10, 0.97)
            add(f"{tag}-{v.replace(' ', '.')}-or-later", name, rf"version {v}(?: 0)? of the (?:gnu )?{name}{later}", 10, 0.97)
            add(f"{tag}-{v.replace(' ', '.')}", tag, rf"(?:gnu )?{tag} ?(?:version |v ?)?{v}(?: 0)?(?! \d)", 25, 0.85)
    # Creative Commons: parts, version, and three ways to write them
    parts = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:s|atives)", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:s|atives)"}
    for short, long in parts.items():
        label = "cc-" + short.replace(" ", "-")
        add(label, "cc by", rf"cc {short}", 55 - len(short), 0.7)
        add(label, "creative commons", rf"creative commons {long}(?: license)?", 45 - len(short), 0.9)
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            full = f"{label}-{v.replace(' ', '.')}"
            add(full, "cc by", rf"cc {short} (?:version |v ?)?{v}", 25, 0.95)
            add(full, "creative commons", rf"creative commons {long} (?:license )?(?:version |v ?)?{v}(?: international| unported| generic)?(?: license)?", 15, 0.97)
            add(full, "creativecommons", rf"creativecommons org licenses {short} {v}", 12, 0.98)
    add("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 30, 0.9)
    add("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 12, 0.98)
    # Apache, Mozilla, Eclipse and others with numbered versions
    for name, tag, versions in (("apache (?:software )?license", "apache", ("1 0", "1 1", "2 0")), ("mozilla public license", "mpl", ("1 0", "1 1", "2 0")), ("eclipse public license", "epl", ("1 0", "2 0")), ("european union public licen[cs]e", "eupl", ("1 0", "1 1", "1 2")), ("common development and distribution license", "cddl", ("1 0", "1 1")), ("common public license", "cpl", ("1 0",)), ("artistic license", "artistic", ("1 0", "2 0")), ("academic free license", "afl", ("2 1", "3 0")), ("open software license", "osl", ("2 1", "3 0")), ("boost software license", "bsl", ("1 0",)), ("sil open font license", "ofl", ("1 0", "1 1")), ("open database license", "odbl", ("1 0",)), ("python software foundation license", "psf", ("2",)), ("zope public license", "zpl", ("2 0", "2 1"))):
        keyword = name.split(" ")[0]
        add(tag, keyword, rf"(?:the )?{name}", 50, 0.75)
        add(tag, keyword, rf"(?:released|licensed|distributed|available|published) under (?:the (?:terms of the )?)?{name}", 35, 0.9)
        for v in versions:
            add(f"{tag}-{v.replace(' ', '.')}", keyword, rf"{name} (?:version |v ?)?{v}(?! \d)", 20, 0.95)
            add(f"{tag}-{v.replace(' ', '.')}", keyword, rf"(?:released|licensed|distributed|available|published) under (?:the (?:terms of the )?)?{name} (?:version |v ?)?{v}(?! \d)", 15, 0.97)
            add(f"{tag}-{v.replace(' ', '.')}", f"{tag} {v}", rf"{tag} {v}", 40, 0.8)
    # short permissive ones by name and by their own sentences
    for tag, name in (("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("bsd", "bsd"), ("ncsa", "ncsa"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("postgresql", "postgresql"), ("x11", "x11"), ("beerware", "beerware"), ("json", "json")):
        add(tag, name, rf"(?:the )?{name} licen[cs]e", 50, 0.75)
        add(tag, name, rf"(?:released|licensed|distributed|available|published) under (?:the (?:terms of the )?)?{name}(?: licen[cs]e)?", 35, 0.9)
    for k, word in (("2", "two|simplified"), ("3", "three|new|modified|revised"), ("4", "four|original")):
        add(f"bsd-{k}-clause", "bsd", rf"(?:bsd {k} clause|(?:{k}|{word})(?: clause)? bsd)(?: licen[cs]e)?", 25, 0.95)
    add("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 10, 0.99)
    add("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 10, 0.99)
    add("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 10, 0.97)
    add("zlib", "warrant", r"this software is provided as is without any express or implied warranty", 15, 0.9)
    add("wtfpl", "do what the", r"do what the \w+ you want to public license", 10, 0.99)
    add("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 30, 0.85)
    add("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 10, 0.99)
    add("proprietary", "rights reserved", r"all rights reserved", 60, 0.5)
    add("proprietary", "permission", r"(?:may not be|no part of this \w+ may be) (?:reproduced|copied|distributed)[^\x01]{0,60}? without (?:the )?(?:prior )?(?:written )?permission", 40, 0.8)
    # SPDX identifiers
    for label in ("mit", "isc", "zlib", "unlicense", "wtfpl", "apache-2.0", "apache-1.1", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0-only", "agpl-3.0-or-later", "bsd-2-clause", "bsd-3-clause", "mpl-2.0", "epl-2.0", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "bsl-1.0", "ofl-1.1"):
        add(label, "spdx", "spdx license identifier " + label.replace("-", " ").replace(".", " "), 5, 1.0)
    return out


def gate() -> list[str]:
    """A text without any of these substrings has no match: the rules' keywords without those that hold another."""
    words = sorted({r.keyword for r in rules()})
    return [w for w in words if not any(x != w and x in w for x in words)]


def word_text(text: Column) -> Column:
    """Words of the contract joined by one space, with one before and one after; null is empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NON_WORD, " ")), F.lit(" "))


_SPAN = "struct<start:int,end:int,priority:int,trust:double,label:string>"


def _rule_spans(norm: Column, rule: Column) -> Column:
    """The matches of one rule, from word to word: the text is marked where a match begins and ends, and the marked
    words give the places."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), rule["regex"], F.lit(")(?= )")), F.lit("\x01$0\x02"))

    def places(w: Column) -> Column:
        index = F.transform(w, lambda x, i: F.struct(x.startswith("\x01").alias("s"), x.endswith("\x02").alias("e"), i.alias("i")))
        starts = F.transform(F.filter(index, lambda x: x["s"]), lambda x: x["i"])
        ends = F.transform(F.filter(index, lambda x: x["e"]), lambda x: x["i"] + 1)
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end"), rule["priority"].alias("priority"), rule["trust"].alias("trust"), rule["label"].alias("label")))

    return let(F.split(F.trim(marked), " "), places)


def _resolved(spans: Column) -> Column:
    """spans by rank (priority, then the longest, the first and its label), each unless it overlaps one that stays; by start."""
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(x["priority"], (x["start"] - x["end"]).alias("length"), x["start"], x["label"], x.alias("x"))))

    def step(kept: Column, o: Column) -> Column:
        x = o["x"]
        taken = F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(x)))

    return F.array_sort(F.aggregate(ranked, F.array().cast(f"array<{_SPAN}>"), step))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, detections, labels and score.

    detections: array of (start, end, priority, trust, label) in words, overlaps resolved. labels: the distinct ones of
    base phrases and detections, sorted and joined by commas. score: the greatest trust of a detection, 0.7 at least if
    a base phrase stands in the text, else 0. A null text is an empty one: no words, counts 0, labels ''.
    """
    norm, passed = fresh(docs, "lic_norm", "lic_gate")
    some = F.lit(False)
    for g in gate():
        some = some | F.col(norm).contains(g)
    made = docs.withColumn(norm, word_text(F.col(text))).withColumn(passed, some)
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority"), F.lit(r.trust).alias("trust")) for r in rules()])
    hits = F.filter(table, lambda r: F.contains(F.col(norm), r["keyword"]))
    found = F.flatten(F.transform(hits, lambda r: _rule_spans(F.col(norm), r)))
    none = F.array().cast(f"array<{_SPAN}>")
    detections = F.when(F.col(passed), let(found, _resolved)).otherwise(none)

    def base(w: Column) -> Column:
        def at(i: Column) -> Column:
            out = F.lit(None).cast("string")
            for phrase, label in BASE:
                same = F.lit(True)
                for j, p in enumerate(phrase.split(" ")):
                    same = same & (F.get(w, i + j) == p)
                out = F.when(F.coalesce(same, F.lit(False)), F.lit(label)).otherwise(out)
            return out

        return F.filter(F.transform(w, lambda x, i: F.struct(i.cast("long").alias("i"), at(i).alias("label"))), lambda x: x["label"].isNotNull())

    phrase = F.lit(False)
    for p, _ in BASE:
        phrase = phrase | F.col(norm).contains(f" {p} ")
    places, n = fresh(docs, "lic_places", "lic_n")
    empty = F.array().cast("array<struct<i:bigint,label:string>>")
    words = F.split(F.trim(F.col(norm)), " ")
    made = made.select("*", F.when(F.trim(F.col(norm)) == "", 0).otherwise(F.length(norm) - F.length(F.replace(F.col(norm), F.lit(" "), F.lit(""))) - 1).cast("long").alias(n), F.when(phrase, let(words, base)).otherwise(empty).alias(places), detections.alias(fresh(docs, "detections")[0]))
    labels = lambda c: F.transform(F.col(c), lambda x: x["label"])
    det = fresh(docs, "detections")[0]
    names = fresh(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    best = F.coalesce(F.array_max(F.transform(F.col(det), lambda x: x["trust"])), F.lit(0.0))
    values = (
        F.col(n),
        F.size(places).cast("long"),
        F.array_min(F.transform(F.col(places), lambda x: x["i"])),
        F.array_max(F.transform(F.col(places), lambda x: x["i"])),
        F.array_join(F.array_sort(F.array_distinct(labels(places))), ","),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels(places), labels(det)))), ","),
        F.greatest(best, F.when(F.size(places) > 0, 0.7).otherwise(0.0)),
    )
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], det, *[v.alias(k) for k, v in zip(names, values)])
