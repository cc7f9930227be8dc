"""License detection by ordered signature rules, in built-in functions only.

A text becomes its words (A-Z in lower case; any ASCII but digits and letters is a
break) with one blank around each. A rule is a regex over that line with a label, a
priority and a keyword; it is tried only where the keyword stands in the text. Each rule
gives every place where it matches as words [start, end). A detection is suppressed when
one of the same or a higher priority contains it (of equal ones the higher priority, then
the first label stays), so the longest reading of a passage wins and details under it go.

Base phrases are looked for apart from the rules, and all their places count.

Everything happens within a row: no shuffle, no join, no Python. A null or empty text,
or one without words, has no places, empty labels and score 0. Repeated rows and ids do
not matter; other columns go through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def rule_table() -> list[tuple[str, int, str, str]]:
    """(keyword, priority, label, regex): texts and notices (3), names with versions (2), names and hints (1).

    Versions and variants are spelled out from lists, a regex each.
    """
    out: list[tuple[str, int, str, str]] = []
    add = out.append
    # The GNU family.
    gnu = {"gpl": ("gnu general public license", ("1", "2", "3")), "lgpl": ("gnu (?:lesser|library) general public license", ("2", "2 1", "3")), "agpl": ("gnu affero general public license", ("1", "3"))}
    for short, (name, versions) in gnu.items():
        add(("affero" if short == "agpl" else "general", 1, short, name))
        add((short, 1, short, f"{short} licensed?"))
        for v in versions:
            dotted = v.replace(" ", ".")
            add(("general", 2, f"{short}-{dotted}", f"{name}(?: as published by the free software foundation)?(?: either)? (?:version|v) {v}(?: 0)?"))
            add(("general", 2, f"{short}-{dotted}", f"{name} v{v}"))
            add(("later", 3, f"{short}-{dotted}-or-later", f"{name}(?: as published by the free software foundation)?(?: either)? version {v}(?: 0)?(?: of the license)? or (?:at your option )?any later version"))
            add(("only", 3, f"{short}-{dotted}-only", f"{name} version {v}(?: 0)? only"))
            add((short, 2, f"{short}-{dotted}", f"{short} (?:version |v )?{v}(?: 0)?"))
            add((f"{short}v{v[:1]}", 2, f"{short}-{dotted}", f"{short}v{v}"))
            for spdx, ending in (("only", "only"), ("or later", "or-later")):
                add(("spdx", 3, f"{short}-{dotted}-{ending}", f"spdx license identifier {short} {v}(?: 0)? {spdx}"))
    # Creative Commons.
    long = {"by": "attribution", "nc": "noncommercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s"}
    for kind in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        label = f"cc-{kind.replace(' ', '-')}"
        spelled = " ".join(long[k] for k in kind.split())
        add(("cc", 1, label, f"cc {kind}"))
        add(("creative", 1, label, f"creative commons {spelled}"))
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            dotted = v.replace(" ", ".")
            add(("cc", 2, f"{label}-{dotted}", f"cc {kind} {v}(?: international| unported)?"))
            add(("creative", 3, f"{label}-{dotted}", f"creative commons {spelled} (?:version )?{v}(?: international| unported| generic)?(?: license)?"))
            add(("spdx", 3, f"{label}-{dotted}", f"spdx license identifier cc {kind} {v}"))
            add(("creativecommons", 3, f"{label}-{dotted}", f"creativecommons org licenses {kind} {v}"))
    for regex in ("cc0(?: 1 0)?(?: universal)?", "creative commons zero", "creativecommons org publicdomain zero 1 0"):
        add((regex.split(" ")[0].split("(")[0], 2, "cc0-1.0", regex))
    # Apache.
    for v in ("1 0", "1 1", "2 0"):
        dotted = v.replace(" ", ".")
        add(("apache", 2, f"apache-{dotted}", f"apache (?:software )?license (?:version |v )?{v}"))
        add(("apache", 2, f"apache-{dotted}", f"apache {v}"))
        add(("apache", 3, f"apache-{dotted}", f"licensed under the apache license version {v}(?: the license you may not use this file except in compliance with the license)?"))
        add(("spdx", 3, f"apache-{dotted}", f"spdx license identifier apache {v}"))
    add(("apache", 1, "apache", "apache (?:software )?license"))
    add(("asf", 2, "apache-2.0", "licensed to the apache software foundation asf"))
    # BSD.
    for n, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        add(("bsd", 2, f"bsd-{n}-clause", f"bsd (?:{n}|{word}) clause(?: license)?"))
        add(("bsd", 2, f"bsd-{n}-clause", f"(?:{n}|{word}) clause bsd(?: license)?"))
        add(("spdx", 3, f"bsd-{n}-clause", f"spdx license identifier (?:0bsd|bsd {n} clause)" if n == "0" else f"spdx license identifier bsd {n} clause"))
    for kind, label in (("simplified", "bsd-2-clause"), ("free ?bsd", "bsd-2-clause"), ("new", "bsd-3-clause"), ("modified", "bsd-3-clause"), ("revised", "bsd-3-clause"), ("original", "bsd-4-clause")):
        add(("bsd", 2, label, f"{kind} bsd(?: license)?"))
    add(("bsd", 1, "bsd", "bsd(?: style)? license"))
    add(("redistribution", 3, "bsd", "redistribution and use in source and binary forms with or without modification are permitted"))
    # MIT and the like.
    for regex in ("permission is hereby granted free of charge to any person obtaining a copy", "(?:released|licensed|distributed|available) under the (?:terms of the )?mit license", "spdx license identifier mit"):
        add(("spdx" if "spdx" in regex else "hereby" if "hereby" in regex else "mit", 3, "mit", regex))
    for regex in ("mit license", "mit licensed", "expat license"):
        add(("expat" if "expat" in regex else "mit", 1, "mit", regex))
    add(("x11", 2, "x11", "x11 license"))
    add(("isc", 1, "isc", "isc license"))
    add(("purpose", 3, "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"))
    # Licenses with versions: short name, spelled name, versions.
    for key, short, name, versions in (
        ("mozilla", "mpl", "mozilla public license", ("1 0", "1 1", "2 0")),
        ("eclipse", "epl", "eclipse public license", ("1 0", "2 0")),
        ("development", "cddl", "common development and distribution license", ("1 0", "1 1")),
        ("artistic", "artistic", "artistic license", ("1 0", "2 0")),
        ("boost", "bsl", "boost software license", ("1 0",)),
        ("european", "eupl", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
        ("common", "cpl", "common public license", ("1 0",)),
        ("academic", "afl", "academic free license", ("1 1", "2 0", "2 1", "3 0")),
        ("open", "osl", "open software license", ("1 0", "2 0", "2 1", "3 0")),
        ("microsoft", "ms-pl", "microsoft public license", ()),
        ("microsoft", "ms-rl", "microsoft reciprocal license", ()),
        ("zope", "zpl", "zope public license", ("1 1", "2 0", "2 1")),
        ("python", "psf", "python software foundation license", ("2", "2 0")),
        ("php", "php", "php license", ("3 0", "3 01")),
        ("q", "qpl", "q public license", ("1 0",)),
        ("latex", "lppl", "latex project public license", ("1 0", "1 1", "1 2", "1 3")),
        ("ibm", "ipl", "ibm public license", ("1 0",)),
        ("nasa", "nasa", "nasa open source agreement", ("1 3",)),
        ("font", "ofl", "open font license", ("1 0", "1 1")),
        ("free", "gfdl", "gnu free documentation license", ("1 1", "1 2", "1 3")),
        ("database", "odbl", "open (?:data commons open )?database license", ("1 0",)),
        ("attribution", "odc-by", "open data commons attribution license", ("1 0",)),
        ("dedication", "pddl", "public domain dedication and license", ("1 0",)),
        ("government", "ogl", "open government licen[cs]e", ("1 0", "2 0", "3 0")),
        ("business", "busl", "business source license", ("1 1",)),
        ("elastic", "elastic", "elastic license", ("2 0",)),
        ("server", "sspl", "server side public license", ("1",)),
        ("responsible", "rail", "responsible ai license", ()),
    ):
        add((key, 1, short, name))
        words = short.replace("-", " ")
        for v in versions:
            label = f"{short}-{v.replace(' ', '.')}"
            add((key, 2, label, f"{name} (?:version |v )?{v}"))
            add((words.split(" ")[0], 2, label, f"{words} (?:version |v )?{v}"))
            add(("spdx", 3, label, f"spdx license identifier {words} {v}"))
    for key, label, regex in (
        ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl(?: version 2)?"), ("zlib", "zlib", "zlib(?: libpng)? license"),
        ("domain", "public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"), ("domain", "public-domain", "public domain"),
        ("reserved", "proprietary", "all rights reserved"), ("confidential", "proprietary", "proprietary and confidential"),
        ("postgresql", "postgresql", "postgresql license"), ("vim", "vim", "vim license"), ("ruby", "ruby", "ruby license"),
        ("openssl", "openssl", "openssl license"), ("curl", "curl", "curl license"), ("beerware", "beerware", "beerware(?: license)?"),
        ("json", "json", "json license"), ("good", "json", "software shall be used for good not evil"), ("ncsa", "ncsa", "ncsa open source license"),
        ("unicode", "unicode", "unicode license agreement"), ("w3c", "w3c", "w3c software (?:notice and )?license"), ("historical", "hpnd", "historical permission notice and disclaimer"),
    ):
        add((key, 1, label, regex))
    return out


def normal(text: Column) -> Column:
    """The words of a text with one blank around each; a single blank if there are none."""
    text = F.coalesce(text, F.lit(""))
    # These two characters alone have an ASCII letter in their Unicode lower case.
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    low = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.concat(F.lit(" "), F.regexp_replace(low, BREAKS, " "), F.lit(" "))


def blanks(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))).cast("long")


def places(line: Column, regex: Column) -> Column:
    """Every match of a regex of words as struct(start, end), in words.

    The line is split at the blank before each match: the words of the parts before it
    add up to the number of its first word. No match of a rule begins within another of
    the same rule, so rules begin with a fixed word.
    """
    parts = F.split(line, F.concat(F.lit(" (?="), regex, F.lit(" )")), -1)
    span = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(blanks(F.element_at(parts, 1)).alias("n"), F.array().cast(span).alias("found"))
    anchored = F.concat(F.lit("^("), regex, F.lit(") "))
    return F.when(F.size(parts) > 1, F.aggregate(
        F.slice(parts, 2, F.size(parts) - 1), start,
        lambda a, p: F.struct(
            (a.n + blanks(p) + 1).alias("n"),
            F.concat(a.found, F.array(F.struct(
                a.n.alias("start"),
                (a.n + blanks(F.call_function("regexp_extract", F.concat(p, F.lit(" ")), anchored, F.lit(1))) + 1).alias("end"),
            ))).alias("found"),
        ),
        lambda a: a.found,
    )).otherwise(F.array().cast(span))


def detections(line: Column) -> Column:
    """All matches of all rules whose keyword stands in the text, with priority and label."""
    by: dict[str, list[tuple[int, str, str]]] = {}
    for keyword, priority, label, regex in rule_table():
        by.setdefault(keyword, []).append((priority, label, regex))
    table = F.array(*[
        F.struct(F.lit(keyword).alias("keyword"), F.array(*[
            F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(regex).alias("regex")) for p, label, regex in rules
        ]).alias("rules")) for keyword, rules in sorted(by.items())
    ])
    hit = F.filter(table, lambda k: F.contains(line, F.concat(F.lit(" "), k.keyword, F.lit(" "))))
    return F.flatten(F.transform(F.flatten(F.transform(hit, lambda k: k.rules)), lambda r: F.transform(
        places(line, r.regex), lambda s: F.struct(s.start.alias("start"), (-s.end).alias("minus_end"), (-r.priority).alias("minus_priority"), r.label.alias("label")),
    )))


def kept(found: Column) -> Column:
    """Detections that no other of the same or a higher priority contains, in order of start."""
    far = F.lit(-1).cast("long")
    kind = "array<struct<start:bigint,end:bigint,priority:int,label:string>>"
    start = F.struct(far.alias("p1"), far.alias("p2"), far.alias("p3"), F.array().cast(kind).alias("out"))

    def step(a: Column, d: Column) -> Column:
        end, p = -d.minus_end, -d.minus_priority
        # What came before starts no later, so it contains this one if it ends no earlier.
        inside = (a.p3 >= end) | ((p <= 2) & (a.p2 >= end)) | ((p <= 1) & (a.p1 >= end))
        one = F.array(F.struct(d.start.alias("start"), end.alias("end"), p.cast("int").alias("priority"), d.label.alias("label")))
        new = [F.when(~inside & (p == i), F.greatest(a[f"p{i}"], end)).otherwise(a[f"p{i}"]).alias(f"p{i}") for i in (1, 2, 3)]
        return F.struct(*new, F.when(inside, a.out).otherwise(F.concat(a.out, one)).alias("out"))

    return F.aggregate(F.array_sort(found), start, step, lambda a: a.out)


def labelled(spans: Column, label: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(label).alias("label")))


def scan(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with n_words, base ``places`` (start, label), rule ``detections`` and ``score``.

    The score is the share of words inside detections or base phrases, 1 at most.
    """
    line = F.col("_line")
    base = F.concat(*[labelled(places(line, F.lit(phrase)), label) for phrase, label in BASE.items()])
    kind = "array<struct<start:bigint,end:bigint,label:string>>"
    gate = F.contains(line, F.lit(" license ")) | F.contains(line, F.lit(" cc by "))
    out = docs.withColumn("_line", F.regexp_replace(normal(F.col(f"`{text}`")), "^  +", " ")).withColumn("_line", F.regexp_replace("_line", "  +$", " "))
    out = out.withColumns({
        "n_words": F.greatest(blanks(line) - 1, F.lit(0).cast("long")),
        "places": F.when(gate, base).otherwise(F.array().cast(kind)),
        "detections": kept(detections(line)),
    })
    words = F.aggregate(
        F.array_sort(F.concat(F.transform("places", lambda d: F.struct(d.start.alias("start"), d.end.alias("end"))), F.transform("detections", lambda d: F.struct(d.start.alias("start"), d.end.alias("end"))))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last")),
        lambda a, d: F.struct((a.n + F.greatest(d.end - F.greatest(d.start, a.last), F.lit(0).cast("long"))).alias("n"), F.greatest(a.last, d.end).alias("last")),
        lambda a: a.n,
    )
    share = F.when(F.col("n_words") > 0, F.least(F.lit(1.0), words / F.col("n_words"))).otherwise(F.lit(0.0))
    return out.drop("_line").withColumn("score", share)
