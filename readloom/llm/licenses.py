"""License scans: ordered signature rules over a text's words, in DataFrame functions only.

A text becomes its words (A-Z lowered; letters, digits and all beyond ASCII) with single blanks. Rules are regular
expressions over that, each with a keyword; a text that has no keyword at all, as most, is through after one pass, and
a rule runs only where its keyword stands. A detection is an interval of words. It's suppressed if an interval of
higher priority contains it, or one of equal priority that is longer or, at equal length, of an earlier rule.
What moves is a narrow row for each document or detection, never text; containment is a running maximum for
each priority over a document's intervals in order, so a document of very many detections sorts and does not pair them.

A null text is empty. Repeated rows are documents of their own; null ids stay null; empty tables give no rows. A very
long text is matched whole. Rows are told by a number that is stored with them; other columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: The phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, how a text names the license (a regular expression over words), versions or none.
FAMILIES = [
    ("agpl", "gnu affero general public license", ("1", "3")),
    ("lgpl", "gnu (?:lesser|library) general public license", ("2", "2 1", "3")),
    ("gpl", "gnu general public license", ("1", "2", "3")),
    ("gfdl", "gnu free documentation license", ("1 1", "1 2", "1 3")),
    ("apache", "apache (?:software )?license", ("1 0", "1 1", "2 0")),
    ("mit", "mit license", ()),
    ("mit-0", "mit no attribution", ()),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd license", ()),
    ("bsd-3-clause", "(?:new|modified|revised|3 clause|three clause) bsd license", ()),
    ("bsd-4-clause", "(?:original|4 clause|four clause) bsd license", ()),
    ("0bsd", "(?:zero clause bsd|bsd zero clause) license", ()),
    ("isc", "isc license", ()),
    ("mpl", "mozilla public license", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public license", ("1 0", "2 0")),
    ("cddl", "common development and distribution license", ("1 0", "1 1")),
    ("cpl", "common public license", ("1 0",)),
    ("eupl", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic license", ("1 0", "2 0")),
    ("bsl", "boost software license", ("1 0",)),
    ("zlib", "zlib license", ()),
    ("unlicense", "the unlicense", ()),
    ("wtfpl", "do what the fuck you want to public license", ("1", "2")),
    ("afl", "academic free license", ("2 0", "2 1", "3 0")),
    ("osl", "open software license", ("1 0", "2 0", "2 1", "3 0")),
    ("ofl", "sil open font license", ("1 0", "1 1")),
    ("psf", "python software foundation license", ("2 0",)),
    ("php", "php license", ("3 0", "3 01")),
    ("postgresql", "postgresql license", ()),
    ("openssl", "openssl license", ()),
    ("ms-pl", "microsoft public license", ()),
    ("ms-rl", "microsoft reciprocal license", ()),
    ("ncsa", "university of illinois ncsa open source license", ()),
    ("upl", "universal permissive license", ("1 0",)),
    ("cecill", "cecill free software license agreement", ("1 0", "2 0", "2 1")),
    ("odbl", "open (?:data commons open )?database license", ("1 0",)),
    ("odc-by", "open data commons attribution license", ("1 0",)),
    ("vsl", "vovida software license", ("1 0",)),
    ("w3c", "w3c software (?:notice and )?license", ()),
    ("zpl", "zope public license", ("1 1", "2 0", "2 1")),
    ("elastic", "elastic license", ("1 0", "2 0")),
    ("busl", "business source license", ("1 0", "1 1")),
    ("sspl", "server side public license", ("1",)),
    ("polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter) license", ("1 0 0",)),
    ("openrail", "(?:creativeml )?(?:open )?(?:rail m|openrail) license", ()),
]
#: The parts of Creative Commons licenses, and their versions.
COMMONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
COMMONS_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non ?commercial"}
#: Notices, exceptions, choices, conditions and denials as texts word them: label, pattern, keyword, priority.
WRITTEN = [
    # whole notices of permissive licenses
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:the )?software to deal in the software without restriction", "permission is hereby granted", 3),
    ("mit", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", "above copyright notice", 3),
    ("x11", "except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale", "except as contained in this notice", 3),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use", 1),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "permission to use", 3),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "permission to use", 3),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", "permission to use", 3),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 1),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code", 2),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions in binary form", 2),
    ("bsd-3-clause", "neither the names? of .{1,80}? (?:nor the names of (?:its|their) contributors )?may be used to endorse or promote products", "neither the name", 3),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials", 3),
    ("bsd-3-clause", "use of this source code is governed by a bsd style license", "use of this source code", 3),
    ("bsd-2-clause", "you may use this file under the terms of the simplified bsd license", "simplified bsd", 4),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "provided as is", 2),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "must not be misrepresented", 3),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "permission is hereby granted", 3),
    ("bsl-1.0", "see accompanying file license 1 0 txt", "see accompanying file license", 3),
    ("unlicense", "this is free and unencumbered software", "unencumbered", 1),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 4),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "everyone is permitted", 3),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "if we meet some day", 4),
    ("beerware", "the beer ?ware license", "the beer", 3),
    ("json", "the software shall be used for good not evil", "used for good", 4),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use", 4),
    ("ftl", "the freetype project license", "freetype project", 3),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg group", 4),
    ("libpng", "this code is released under the libpng license", "libpng license", 4),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl project", 4),
    ("php", "this product includes php software", "this product includes php", 3),
    ("python", "psf license agreement for python", "psf license agreement", 3),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation", "authors hereby grant", 3),
    ("unicode", "unicode inc license agreement data files and software", "unicode inc license", 4),
    ("icu", "icu license icu 1 8 1 and later", "icu license", 4),
    # apache
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license", 4),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance with the license", 2),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law", 2),
    ("apache-2.0", "http (?:www )?apache org licenses license 2 0", "apache org", 4),
    ("apache-2.0", "asl ?2 0", "asl", 2),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation", 3),
    # copyleft
    ("gpl", "this program is free software you can redistribute it and or modify it", "this program is free software", 3),
    ("gpl-2.0-or-later", "either version 2 of the license or at your option any later version", "either version 2", 3),
    ("gpl-3.0-or-later", "either version 3 of the license or at your option any later version", "either version 3", 3),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "this library is free software", 3),
    ("lgpl-2.1-or-later", "either version 2 1 of the license or at your option any later version", "either version 2 1", 4),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "you should have received a copy", 4),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", "you should have received a copy", 4),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", "you should have received a copy", 4),
    ("gpl", "gnu gpl", "gnu gpl", 2),
    ("gpl-2.0", "gnu gpl ?v(?:ersion )?2", "gnu gpl", 3),
    ("gpl-3.0", "gnu gpl ?v(?:ersion )?3", "gnu gpl", 3),
    ("gpl-2.0", "gpl ?v2", "gpl", 2),
    ("gpl-3.0", "gpl ?v3", "gpl", 2),
    ("lgpl", "gnu lgpl", "gnu lgpl", 2),
    ("agpl-3.0", "agpl ?v3", "agpl", 2),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted to copy", 4),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form", 4),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file are subject", 4),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "contents of this file are subject", 4),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials", 4),
    ("cecill", "this software is governed by the cecill (?:b |c )?license", "governed by the cecill", 4),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "redistributions in any form", 4),
    # exceptions
    ("gpl-with-classpath-exception", "(?:gnu general public license|gpl).{0,80}? with (?:the )?classpath exception", "classpath exception", 4),
    ("classpath-exception", "(?:with (?:the )?)?classpath exception(?: 2 0)?", "classpath exception", 3),
    ("classpath-exception", "linking this library statically or dynamically with other modules is making a combined work", "linking this library", 4),
    ("gcc-exception", "gcc runtime library exception", "gcc runtime library", 4),
    ("bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton", 4),
    ("autoconf-exception", "as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts", "configure scripts", 4),
    ("font-exception", "as a special exception if you create a document which uses this font", "uses this font", 4),
    ("openssl-exception", "permission to link the code of portions of this program with the openssl library", "with the openssl library", 4),
    ("linux-syscall-note", "with linux syscall note", "linux syscall note", 4),
    ("llvm-exception", "apache license v2 0 with llvm exceptions", "llvm exceptions", 4),
    ("exception", "as a special exception", "as a special exception", 1),
    # choices of the receiver
    ("mit-or-apache-2.0", "licensed under either of (?:the )?apache license version 2 0 .{0,120}? mit license .{0,80}?at your option", "licensed under either of", 4),
    ("mit-or-apache-2.0", "(?:dual )?licensed under (?:the )?(?:mit (?:license )?(?:and|or) apache|apache(?: 2 0)? (?:and|or) mit)(?: 2 0)?(?: licenses?)?", "licensed under", 4),
    ("mit-or-gpl", "dual licensed under the mit (?:and|or) gpl(?: version 2)? licenses?", "dual licensed", 4),
    ("gpl-or-artistic", "under the same terms as perl itself", "same terms as perl", 4),
    ("mpl-or-gpl-or-lgpl", "mpl 1 1 gpl 2 0 lgpl 2 1", "mpl 1 1", 4),
    ("gpl-or-commercial", "(?:gnu general public license|gpl) or (?:a )?commercial license", "commercial license", 4),
    ("dual", "dual licensed", "dual licensed", 1),
    # data and content
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 1),
    ("cc0", "to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "to the extent possible under law", 4),
    ("public-domain", "(?:released into|dedicated to|placed in|in) the public domain", "public domain", 1),
    ("pddl", "public domain dedication and license", "public domain dedication", 4),
    ("cc", "some rights reserved", "some rights reserved", 1),
    ("cc", "this work is licensed under a creative commons", "creative commons", 2),
    ("ogl-uk", "contains public sector information licensed under the open government licence", "open government licence", 4),
    # not free, and denials
    ("proprietary", "all rights reserved", "all rights reserved", 1),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 3),
    ("proprietary", "unauthorized copying of this file (?:via any medium )?is strictly prohibited", "unauthorized copying", 4),
    ("proprietary", "no part of this (?:publication|work|document) may be reproduced", "no part of this", 3),
    ("proprietary", "may not be (?:copied|reproduced|distributed|published) without (?:the )?(?:prior )?(?:express )?(?:written )?permission", "may not be", 3),
    ("commercial", "(?:requires|under) a commercial license", "commercial license", 3),
    ("no-commercial-use", "(?:for )?non commercial (?:use|purposes) only", "non commercial", 3),
    ("no-commercial-use", "free for (?:personal|academic|educational|research) use only", "free for", 3),
    ("no-license", "(?:is |are )?not licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu general public license|gpl|apache license|mit license)", "not licensed under", 4),
    ("no-license", "(?:is |are )?not released under (?:the )?(?:terms of )?(?:the )?(?:gnu general public license|gpl|apache license|mit license)", "not released under", 4),
    ("no-license", "no license (?:is|express or implied) (?:is )?granted", "no license", 4),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 1),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int  # 1 to 4; its share of 4 is the score


def literal(pattern: str) -> str:
    """The longest run of letters, digits and blanks that each match of a pattern has, rather than just the word license."""
    return max((x.strip() for x in re.split(r"\(\?:[^()]*\)\??|\[[^]]*\]|\w ?\?", pattern)), key=lambda x: (x != "", x != "license", len(x)))


def rules() -> list[Rule]:
    """The contract's phrases, then what the families give: a grant, a name with each version, a name, an SPDX tag; then WRITTEN."""
    out = [Rule(label, phrase, phrase, 2) for phrase, label in BASE.items()]
    for label, name, versions in FAMILIES:
        word = literal(name)
        grant = r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?"
        out.append(Rule(label, f"{name}", word, 2))
        out.append(Rule(label, f"{grant}{name}", word, 4))
        for v in versions:
            tail = rf" (?:version |v ?)?{v}(?! [0-9])" if " " not in v else f" (?:version |v ?)?{v}"
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", f"{name}{tail}", word, 3))
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", f"{grant}{name}{tail}", word, 4))
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", f"spdx license identifier {label.replace('-', ' ')} {v}(?: (?:only|or later))?", "spdx license identifier", 4))
        out.append(Rule(label, f"spdx license identifier {label.replace('-', ' ')}", "spdx license identifier", 3))
    for parts in COMMONS:
        label, spoken = "cc-" + parts.replace(" ", "-"), " ".join(COMMONS_WORDS[p] for p in parts.split())
        out.append(Rule(label, f"cc {parts}", f"cc {parts}", 2))
        out.append(Rule(label, f"creative commons {spoken}(?: licen[cs]e)?", "creative commons", 3))
        for v in COMMONS_VERSIONS:
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", f"(?:licensed under )?(?:spdx license identifier )?cc {parts} {v}", f"cc {parts}", 4))
    return out + [Rule(*r[:3], priority=r[3]) for r in WRITTEN]


RULES = rules()
TOP = max(r.priority for r in RULES)


def any_of(words: set[str]) -> str:
    """A regular expression that finds a text if one of the words begins there: words that begin with another are left to it, and what some begin with is tried once."""
    if "" in words:
        return ""
    parts = []
    for c in sorted({w[0] for w in words}):
        rest = any_of({w[1:] for w in words if w[0] == c})
        parts.append(re.escape(c) + rest)
    return f"(?:{'|'.join(parts)})" if len(parts) > 1 else parts[0]


def words_of(text: Column) -> Column:
    """A text's words with a blank before, between and after them."""
    inner = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.concat(F.lit(" "), inner, F.lit(" "))


def detections(docs: DataFrame, known: list[Rule] = RULES) -> DataFrame:
    """row, doc_id, n_words, and rule, label, priority, start, end, each detection of a document; nulls if it has none."""
    # one literal table, parsed as one expression: an expression for each rule takes longer to plan than most inputs take to scan
    row = "struct({} as rule, r'{}' as label, {} as priority, r'{}' as keyword, r'(?<= )(?:{})(?= )' as pattern)"
    table = F.expr(f"array({', '.join(row.format(k, r.label, r.priority, r.keyword, r.pattern) for k, r in enumerate(known))})")
    gate = any_of({r.keyword for r in known})
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), words_of(F.col("text")).alias("p"))
    spaces = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")
    # matches and what lies between them, each found once for a rule; a place is the blanks before it, less the first
    pairs = lambda r: F.arrays_zip(F.split(F.col("p"), r["pattern"], -1).alias("gap"), F.regexp_extract_all("p", r["pattern"], F.lit(0)).alias("hit"))
    each = lambda r: F.transform(F.filter(pairs(r), lambda x: x["hit"].isNotNull()), lambda x, i: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), i.alias("nth"), spaces(x["gap"]).alias("gap"), spaces(x["hit"]).alias("hit")))
    empty = F.expr("cast(array() as array<struct<rule:int,label:string,priority:int,nth:int,gap:bigint,hit:bigint>>)")
    found = F.when(F.col("p").rlike(f" {gate}"), F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("p"), r["keyword"])), each))).otherwise(empty)
    rows = rows.select("row", "doc_id", F.greatest(F.lit(0).cast("long"), F.when(F.col("p") == "  ", 0).otherwise(spaces(F.col("p")) - 1)).alias("n_words"), F.explode_outer(found).alias("d"))
    rows = stored(rows.select("row", "doc_id", "n_words", "d.*"))  # from here on a row keeps its number
    before = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(before))
    return rows.select("row", "doc_id", "n_words", "rule", "label", "priority", (F.col("end") - F.col("hit") - 1).alias("start"), "end")


def resolved(found: DataFrame) -> DataFrame:
    """detections() with stays: not contained in an interval that comes before it."""
    ahead = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    cover = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(ahead)) for p in range(1, TOP + 1)], F.lit(-1).cast("long"))
    return found.withColumn("stays", F.col("rule").isNotNull() & (cover < F.col("end")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of docs."""
    base = F.col("rule") < len(BASE)
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    out = resolved(detections(docs)).groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(base | F.col("stays"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(base | F.col("stays"), F.col("priority"))) / TOP, F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
