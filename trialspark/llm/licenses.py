"""License scans: ordered signature rules behind a keyword prefilter, as DataFrame expressions only.

A text is its words, lower-cased, joined by single spaces. A rule is a regular expression over them; it is tried only where
its keyword stands in the text (or begins a word of it, where a version may be glued to it). Of overlapping detections, one inside another of the same or a stronger priority goes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels; every place counts, and no rule takes their label away.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: (label, priority, keyword, pattern). Priority 1: an exact license and version or a tell-tale sentence; 2: a license by
#: name; 3: a family; 4: a mention of licensing. Keywords are single words of the pattern.
SIGNATURES = (
    ("gpl-1.0", 1, "gnu", r"gnu general public license (?:as published by the free software foundation )?(?:version|v) ?1(?: 0)?"),
    ("gpl-2.0", 1, "gnu", r"gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2(?: 0)?"),
    ("gpl-3.0", 1, "gnu", r"gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?"),
    ("gpl-2.0", 1, "gpl", r"gpl ?(?:version |v)?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", 1, "gpl", r"gpl ?(?:version |v)?3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", 1, "gplv2", r"gplv2"),
    ("gpl-3.0", 1, "gplv3", r"gplv3"),
    ("lgpl-2.0", 1, "library", r"gnu library general public license(?: version 2(?: 0)?)?"),
    ("lgpl-2.1", 1, "lesser", r"gnu lesser general public license (?:version|v) ?2 1"),
    ("lgpl-3.0", 1, "lesser", r"gnu lesser general public license (?:version|v) ?3(?: 0)?"),
    ("lgpl", 2, "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl", 2, "lgpl", r"lgpl(?: ?v?[23](?: [01])?)?"),
    ("agpl-3.0", 1, "affero", r"gnu affero general public license (?:version|v) ?3(?: 0)?"),
    ("agpl", 2, "affero", r"(?:gnu )?affero general public license"),
    ("agpl", 2, "agpl", r"agpl(?: ?v?3(?: 0)?)?"),
    ("gfdl", 2, "documentation", r"gnu free documentation license(?: version 1 [123])?"),
    ("gfdl", 3, "gfdl", r"gfdl"),
    ("gpl", 2, "gnu", r"gnu (?:general public license|gpl)"),
    ("gpl", 3, "gpl", r"gpl(?:ed)?"),
    ("gpl-exception", 1, "classpath", r"classpath exception"),
    ("gpl-exception", 1, "linking", r"(?:as a special exception .{0,80} )?linking exception"),
    ("apache-1.0", 1, "apache", r"apache (?:software )?license (?:version )?1 0"),
    ("apache-1.1", 1, "apache", r"apache (?:software )?license (?:version )?1 1"),
    ("apache-2.0", 1, "apache", r"apache (?:software )?license (?:version |v)?2(?: 0)?"),
    ("apache-2.0", 1, "apache", r"apache 2(?: 0)?(?: license)?"),
    ("apache-2.0", 1, "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 1, "licenses", r"www apache org licenses license 2 0"),
    ("apache", 2, "apache", r"apache (?:software )?license"),
    ("mit", 1, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 2, "mit", r"(?:the )?mit license"),
    ("mit", 2, "expat", r"expat license"),
    ("mit", 2, "mit", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit"),
    ("mit-0", 1, "mit", r"mit no attribution(?: license)?"),
    ("x11", 2, "x11", r"x11 license"),
    ("bsd-2-clause", 1, "bsd", r"(?:simplified|freebsd|(?:2|two) clause) bsd(?: license)?"),
    ("bsd-2-clause", 1, "bsd", r"bsd (?:2|two) clause(?: license)?"),
    ("bsd-3-clause", 1, "bsd", r"(?:modified|new|revised|(?:3|three) clause) bsd(?: license)?"),
    ("bsd-3-clause", 1, "bsd", r"bsd (?:3|three) clause(?: license)?"),
    ("bsd-4-clause", 1, "bsd", r"(?:original|(?:4|four) clause) bsd(?: license)?"),
    ("bsd-4-clause", 1, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", 1, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 1, "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("0bsd", 1, "bsd", r"(?:zero clause|0) bsd(?: license)?"),
    ("0bsd", 1, "0bsd", r"0bsd(?: license)?"),
    ("0bsd", 1, "clausebsd", r"zero clausebsd(?: license)?"),
    ("bsd", 2, "bsd", r"bsd license"),
    ("bsd", 3, "bsd", r"bsd style(?: license)?"),
    ("isc", 2, "isc", r"isc license"),
    ("isc", 1, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-1.0", 1, "mozilla", r"mozilla public license (?:version |v)?1 0"),
    ("mpl-1.1", 1, "mozilla", r"mozilla public license (?:version |v)?1 1"),
    ("mpl-2.0", 1, "mozilla", r"mozilla public license (?:version |v)?2 0"),
    ("mpl-2.0", 1, "mpl", r"mpl (?:version |v)?2(?: 0)?"),
    ("mpl", 2, "mozilla", r"mozilla public license"),
    ("epl-1.0", 1, "eclipse", r"eclipse public license (?:version |v)?1 0"),
    ("epl-2.0", 1, "eclipse", r"eclipse public license (?:version |v)?2 0"),
    ("epl", 2, "eclipse", r"eclipse public license"),
    ("edl", 2, "eclipse", r"eclipse distribution license"),
    ("cddl-1.0", 1, "distribution", r"common development and distribution license (?:version )?1 0"),
    ("cddl", 2, "distribution", r"common development and distribution license"),
    ("cddl", 3, "cddl", r"cddl"),
    ("cpl-1.0", 2, "common", r"common public license(?: version 1 0)?"),
    ("eupl-1.1", 1, "european", r"european union public licen[cs]e (?:version |v)?1 1"),
    ("eupl-1.2", 1, "european", r"european union public licen[cs]e (?:version |v)?1 2"),
    ("eupl", 2, "european", r"european union public licen[cs]e"),
    ("eupl", 3, "eupl", r"eupl"),
    ("artistic-1.0", 1, "artistic", r"artistic license (?:version )?1 0"),
    ("artistic-2.0", 1, "artistic", r"artistic license (?:version )?2 0"),
    ("artistic", 2, "artistic", r"artistic license"),
    ("perl", 2, "perl", r"same terms as perl itself"),
    ("python-2.0", 2, "python", r"python software foundation license(?: version 2)?"),
    ("php-3.0", 2, "php", r"php license(?: version 3 0[01]?)?"),
    ("ruby", 2, "ruby", r"ruby license"),
    ("zlib", 2, "zlib", r"zlib(?: libpng)? license"),
    ("zlib", 1, "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", 2, "libpng", r"libpng license"),
    ("boost-1.0", 1, "boost", r"boost software license (?:version )?1 0"),
    ("boost", 2, "boost", r"boost software license"),
    ("unlicense", 1, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", 2, "wtfpl", r"wtfpl"),
    ("wtfpl", 1, "fuck", r"do what the fuck you want to public license"),
    ("cc0-1.0", 1, "cc0", r"cc0 1 0(?: universal)?"),
    ("cc0-1.0", 2, "cc0", r"cc0"),
    ("cc0-1.0", 1, "creative", r"creative commons (?:cc0|public domain dedication)"),
    ("public-domain", 2, "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", 3, "domain", r"public domain"),
    ("ofl-1.1", 1, "font", r"sil open font license(?: version)? 1 1"),
    ("ofl", 2, "font", r"(?:sil )?open font license"),
    ("odbl-1.0", 2, "database", r"open (?:data commons open )?database license(?: 1 0)?"),
    ("odc-by-1.0", 2, "commons", r"open data commons attribution license(?: 1 0)?"),
    ("pddl-1.0", 2, "commons", r"open data commons public domain dedication and license"),
    ("cdla-permissive", 2, "community", r"community data license agreement permissive"),
    ("cdla-sharing", 2, "community", r"community data license agreement sharing"),
    ("ogl-uk-3.0", 1, "government", r"open government licen[cs]e (?:version |v)?3 0"),
    ("ogl-uk", 2, "government", r"open government licen[cs]e"),
    ("postgresql", 2, "postgresql", r"postgresql license"),
    ("openssl", 2, "openssl", r"openssl license"),
    ("sleepycat", 2, "sleepycat", r"sleepycat license"),
    ("ncsa", 2, "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("ms-pl", 2, "microsoft", r"microsoft public license"),
    ("ms-rl", 2, "microsoft", r"microsoft reciprocal license"),
    ("osl-3.0", 2, "software", r"open software license(?: version)?(?: 3 0)?"),
    ("afl-3.0", 2, "academic", r"academic free license(?: version)?(?: 3 0)?"),
    ("qpl-1.0", 2, "q", r"q public license(?: version 1 0)?"),
    ("ipl-1.0", 2, "ibm", r"ibm public license(?: version 1 0)?"),
    ("lppl", 2, "latex", r"latex project public license(?: version 1 3c?)?"),
    ("cecill", 2, "cecill", r"cecill(?: [bc])?(?: license)?"),
    ("beerware", 2, "beerware", r"beerware(?: license)?"),
    ("json", 1, "evil", r"the software shall be used for good not evil"),
    ("bsl-1.1", 2, "business", r"business source license(?: 1 1)?"),
    ("sspl-1.0", 2, "server", r"server side public license(?: version 1)?"),
    ("elastic-2.0", 2, "elastic", r"elastic license(?: 2 0)?"),
    ("commons-clause", 1, "clause", r"commons clause(?: license condition)?"),
    ("polyform", 2, "polyform", r"polyform (?:noncommercial|small business|shield|strict)(?: license)?"),
    ("hippocratic", 2, "hippocratic", r"hippocratic license"),
    ("openrail", 2, "openrail", r"(?:creativeml )?openrail(?: [ms])?"),
    ("llama", 2, "llama", r"llama [234] community license"),
    ("proprietary", 1, "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 2, "unauthorized", r"unauthorized copying of this (?:file|software) .{0,40}is strictly prohibited"),
    ("all-rights-reserved", 3, "rights", r"all rights reserved"),
    ("all-rights-reserved", 3, "derechos", r"todos los derechos reservados"),
    ("all-rights-reserved", 3, "droits", r"tous droits r[eé]serv[eé]s"),
    ("all-rights-reserved", 3, "rechte", r"alle rechte vorbehalten"),
    ("cc", 3, "creative", r"creative commons(?: licen[cs]e)?"),
    ("license-notice", 4, "licensed", r"licensed under"),
    ("license-notice", 4, "license", r"see (?:the )?license(?: file)?(?: for details)?"),
    ("license-notice", 4, "terms", r"under the terms of the"),
    ("copyright-notice", 4, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
)

_CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_SPDX = (
    "0bsd aal afl-3.0 agpl-3.0 apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 "
    "cc-by-sa-4.0 cddl-1.0 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 "
    "lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 postgresql python-2.0 ruby unlicense upl-1.0 vim w3c "
    "wtfpl x11 zlib zpl-2.1"
).split()

#: Keywords to which a version or an ending may be glued (lgplv3, gpl2, gpled): the word need only begin with them.
GLUED = ("gpl", "lgpl", "agpl")

#: Confidence of a detection by its priority, and of a base phrase.
CONFIDENCE = (1.0, 0.9, 0.6, 0.3)
BASE_CONFIDENCE = 0.8


def signature_rules() -> list[tuple[str, int, str, str]]:
    """All rules: those written out, and those that follow from the names of license families."""
    rules = list(SIGNATURES)
    for kind, name in _CC.items():
        short = "cc " + kind.replace("-", " ")
        rules.append((f"cc-{kind}", 2, "cc", short))
        rules.append((f"cc-{kind}", 2, "creative", f"creative commons {name}"))
        for version in _VERSIONS:
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            rules.append((label, 1, "cc", f"{short} {version}"))
            rules.append((label, 1, "creative", f"creative commons {name} {version}"))
            rules.append((label, 1, "creativecommons", f"creativecommons org licenses {kind.replace('-', ' ')} {version}"))
    for name in _SPDX:
        rules.append((name, 1, "spdx", "spdx license identifier " + name.replace("-", " ").replace(".", " ")))
    return rules


def normal(text) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text, A-Z lower-cased, each between single spaces."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def _spaces(text):
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def gate_mark(word):
    """What a text must hold for a rule with this keyword to be tried."""
    return f" {word}" if word in GLUED else f" {word} "


def _any_word(text, words):
    """Whether one of the words stands in the text; each test is a plain search."""
    marks = {gate_mark(word) for word in words}
    out = F.lit(False)
    for mark in sorted(m for m in marks if not any(o != m and o in m for o in marks)):
        out = out | F.contains(text, F.lit(mark))
    return out


def _rule_hits(text, rule):
    """(start, end, priority, label) in words of every match of one rule."""
    found, between = F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.split(text, rule["pattern"])

    def step(acc, k):
        start = acc["at"] + _spaces(F.get(acc["between"], k)) - 1
        end = start + _spaces(F.get(acc["found"], k)) + 1
        hit = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), acc["found"].alias("found"), acc["between"].alias("between"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    zero = F.struct(F.lit(0).alias("at"), found.alias("found"), between.alias("between"), F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>").alias("hits"))
    places = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, zero, step, lambda acc: acc["hits"])


def _kept(hits):
    """The detections that lie in no other of the same or a stronger priority, in order of place.

    In order of start, then of falling end, whatever contains a detection comes before it, so it is enough to remember per
    priority how far the detections so far reach.
    """
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), h["priority"].alias("priority"), h["label"].alias("label"))))

    def step(acc, h):
        end, free = -h["back"], F.lit(True)
        for p in range(1, 5):
            free = free & ~((h["priority"] >= p) & (acc[f"p{p}"] >= end))
        reach = [F.when(h["priority"] == p, F.greatest(acc[f"p{p}"], end)).otherwise(acc[f"p{p}"]).alias(f"p{p}") for p in range(1, 5)]
        out = F.struct(h["start"].alias("start"), end.alias("end"), h["priority"].alias("priority"), h["label"].alias("label"))
        return F.struct(*reach, F.when(free, F.concat(acc["kept"], F.array(out))).otherwise(acc["kept"]).alias("kept"))

    zero = F.struct(*[F.lit(0).alias(f"p{p}") for p in range(1, 5)], F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>").alias("kept"))
    return F.aggregate(ordered, zero, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, keep=("doc_id",), base=BASE, rules=None) -> DataFrame:
    """Columns `keep` plus n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Everything is computed in the row, whatever its text's length; nothing is shuffled, and only texts with a keyword are
    searched. A null text is an empty one: no words, null first_word and last_word, no labels, score 0.
    """
    rules = signature_rules() if rules is None else rules
    # One entry per keyword, so that a text is searched once for each, whatever the number of its rules.
    by_word = {}
    for label, priority, word, pattern in rules:
        rule = F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"))
        by_word.setdefault(gate_mark(word), []).append(rule)
    table = F.array(*[F.struct(F.lit(word).alias("word"), F.array(*own).alias("rules")) for word, own in by_word.items()])
    words = docs.select(*keep, normal(F.col("text")).alias("_text"))
    gate = _any_word(F.col("_text"), [r[2] for r in rules] + [phrase.split()[-1] for phrase, _ in base])
    words = words.withColumn("n_words", F.when(F.col("_text") == "  ", 0).otherwise(_spaces(F.col("_text")) - 1).cast("long"))
    # Texts without any keyword go on as an empty one: from here on they cost nothing.
    words = words.withColumn("_text", F.when(gate, F.col("_text")).otherwise("  ")).withColumn("_wide", F.replace(F.col("_text"), F.lit(" "), F.lit("  ")))
    for k, (phrase, _) in enumerate(base):
        mark = F.lit(" " + phrase.replace(" ", "  ") + " ")
        n = ((F.octet_length("_wide") - F.octet_length(F.replace(F.col("_wide"), mark, F.lit("")))) / F.octet_length(mark)).cast("long")
        words = words.withColumn(f"_n{k}", F.when(F.contains("_wide", mark), n).otherwise(0).cast("long"))
        before, after = ((_spaces(F.substring_index("_wide", " " + phrase.replace(" ", "  ") + " ", side)) - 1) / 2 for side in (1, -1))
        words = words.withColumn(f"_first{k}", F.when(F.col(f"_n{k}") > 0, before.cast("long")))
        words = words.withColumn(f"_last{k}", F.when(F.col(f"_n{k}") > 0, F.col("n_words") - after.cast("long") - len(phrase.split())))
    tried = F.flatten(F.transform(F.filter(table, lambda w: F.contains(F.col("_text"), w["word"])), lambda w: w["rules"]))
    hits = F.flatten(F.transform(tried, lambda r: _rule_hits(F.col("_text"), r)))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    words = words.withColumn("_hits", F.when(F.length("_text") > 2, hits).otherwise(none))
    words = words.withColumn("detections", F.when(F.size("_hits") > 0, _kept(F.col("_hits"))).otherwise(none))
    every = range(len(base))
    base_labels = F.array_compact(F.array(*[F.when(F.col(f"_n{k}") > 0, F.lit(base[k][1])) for k in every]))
    own = F.transform("detections", lambda d: d["label"])
    sure = F.array_max(F.transform("detections", lambda d: F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), d["priority"])))
    return words.select(
        *keep,
        "n_words",
        sum((F.col(f"_n{k}") for k in every), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[F.col(f"_first{k}") for k in every]).alias("first_word"),
        F.greatest(*[F.col(f"_last{k}") for k in every]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        F.greatest(F.coalesce(sure, F.lit(0.0)), F.when(F.size(base_labels) > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        "detections",
    )
