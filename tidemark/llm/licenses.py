"""License scans by ordered signature rules, with DataFrame functions only.

A text is lower-cased (A-Z) and cut into words. Rules are regexes over the words, each with a keyword,
a label and a priority: 1 for wording that licenses share, 2 for names without a version, 3 for
names with one, 4 for identifiers, whole notices, exceptions and choices. Texts in which neither a
rule nor a ``BASE`` phrase can occur (``gate``) are passed over; for the rest, only rules whose
keyword occurs are tried. A match that lies within a match of at least its priority is suppressed, so
a notice that quotes its license's name counts once, and an identifier with its version hides the
bare one. All of it happens within the row: there is no shuffle.

``BASE`` phrases are found wherever their words stand consecutively; suppression doesn't
touch them.

Defined results: a null or empty text has no words and no labels (score 0); repeated rows
get the same result; columns named as those that the operator adds are replaced.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, named

#: What lies between words of a text, and of one in lower case.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Name, SPDX name in words, label, versions. Fixed facts about public licenses.
FAMILIES = (
    ("gnu general public license", "gpl", "gpl", ("1", "2", "3")),
    ("gnu lesser general public license", "lgpl", "lgpl", ("2 1", "3")),
    ("gnu library general public license", "lgpl", "lgpl", ("2",)),
    ("gnu affero general public license", "agpl", "agpl", ("1", "3")),
    ("gnu free documentation license", "gfdl", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache license", "apache", "apache", ("1 0", "1 1", "2", "2 0")),
    ("apache software license", "apache", "apache", ("1 0", "1 1", "2 0")),
    ("mozilla public license", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("eclipse public license", "epl", "epl", ("1 0", "2 0")),
    ("common development and distribution license", "cddl", "cddl", ("1 0", "1 1")),
    ("common public license", "cpl", "cpl", ("1 0",)),
    ("european union public licence", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("boost software license", "bsl", "bsl", ("1 0",)),
    ("artistic license", "artistic", "artistic", ("1 0", "2 0")),
    ("academic free license", "afl", "afl", ("1 1", "2 0", "2 1", "3 0")),
    ("open software license", "osl", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("sil open font license", "ofl", "ofl", ("1 0", "1 1")),
    ("microsoft public license", "ms pl", "ms-pl", ()),
    ("mit license", "mit", "mit", ()),
    ("isc license", "isc", "isc", ()),
    ("zlib license", "zlib", "zlib", ()),
    ("bsd license", "bsd", "bsd", ()),
    ("bsd 2 clause license", "bsd 2 clause", "bsd-2", ()),
    ("bsd 3 clause license", "bsd 3 clause", "bsd-3", ()),
    ("creative commons attribution", "cc by", "cc-by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("creative commons attribution sharealike", "cc by sa", "cc-by-sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("creative commons attribution noncommercial", "cc by nc", "cc-by-nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("creative commons attribution noncommercial sharealike", "cc by nc sa", "cc-by-nc-sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("creative commons attribution noncommercial noderivatives", "cc by nc nd", "cc-by-nc-nd", ("2 0", "2 5", "3 0", "4 0")),
    ("creative commons attribution noderivatives", "cc by nd", "cc-by-nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("creative commons zero", "cc0", "cc0", ("1 0",)),
)
#: Signatures of notices, headers, openings of full texts, exceptions, choices and marks: keyword, regex
#: over words, label, priority. A keyword begins a word. Fixed wording of public licenses.
SINGLE = (
    # Wording that many licenses share
    ("warranty", " provided as is without (?:any )?warranty", "as-is", 1),
    ("warranties", " without warranties or conditions of any kind", "as-is", 1),
    ("warranty", " without any warranty without even the implied warranty", "as-is", 1),
    ("merchantability", " merchantability (?:and|or) fitness for a particular purpose", "as-is", 1),
    ("rights reserved", " all rights reserved", "all-rights-reserved", 1),
    ("rights reserved", " some rights reserved", "some-rights-reserved", 1),
    ("licen", " licen[sc]ed under the terms of", "licensed", 1),
    ("licen", " (?:released|distributed|licen[sc]ed|published) under (?:the |a )?(?!terms)", "licensed", 1),
    ("source code is governed", " use of this source code is governed by a", "licensed", 1),
    ("subject to the terms", " this source code form is subject to the terms", "licensed", 1),
    ("public domain", " (?:released|placed|dedicated) (?:in|into|to) the public domain", "public-domain", 2),
    ("public domain", " this (?:file|work|software) is (?:in|hereby placed in) the public domain", "public-domain", 2),
    ("disclaims copyright", " the author disclaims copyright to this source code", "public-domain", 2),
    ("confidential", " proprietary and confidential", "proprietary", 2),
    ("unauthorized", " unauthorized copying of this file", "proprietary", 2),
    ("trade secret", " contains trade secrets? (?:of|and)", "proprietary", 2),
    ("internal use", " for internal use only", "proprietary", 2),
    ("non commercial", " for non commercial (?:use|purposes) only", "noncommercial", 2),
    ("academic", " for academic (?:and|or) research (?:use|purposes) only", "research-only", 2),
    ("evaluation", " for evaluation purposes only", "evaluation-only", 2),
    # Permissive full texts
    ("permission is hereby granted", " permission is hereby granted free of charge to any person", "mit", 2),
    ("without restriction including", " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "mit", 2),
    ("above copyright notice and this permission notice", " the above copyright notice and this permission notice shall be included in all copies", "mit", 2),
    ("permission to use copy modify", " permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 4),
    ("permission to use copy modify", " permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "isc", 4),
    ("permission to use copy modify", " permission to use copy modify and distribute this software and its documentation for any purpose", "hpnd", 4),
    ("redistribution and use", " redistribution and use in source and binary forms", "bsd", 2),
    ("neither the name", " neither the name of .{0,120}?nor the names of its contributors may be used", "bsd-3", 4),
    ("advertising materials", " all advertising materials mentioning features or use of this software", "bsd-4", 4),
    ("views and conclusions", " the views and conclusions contained in the software and documentation are those of the authors", "bsd-2-views", 4),
    ("this software is provided as is", " this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 4),
    ("altered source versions", " altered source versions must be plainly marked as such", "zlib", 4),
    ("free and unencumbered", " this is free and unencumbered software released into the public domain", "unlicense", 4),
    ("do what the", " do what the f.ck you want to public license", "wtfpl", 4),
    ("buy me a beer", " you can buy me a beer in return", "beerware", 4),
    ("beer ware", " the beer ware license", "beerware", 4),
    ("boost software", " boost software license version 1 0 august 17th 2003", "bsl-1", 4),
    ("obtaining a copy of the software and accompanying", " obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1", 4),
    ("university of illinois", " university of illinois ncsa open source license", "ncsa", 4),
    ("python software foundation", " python software foundation license(?: version 2)?", "psf-2", 3),
    ("openssl", " openssl license", "openssl", 2),
    ("php license", " (?:the )?php license version 3 01", "php-3.01", 3),
    ("w3c", " w3c software (?:notice and license|and document notice)", "w3c", 3),
    ("unicode", " unicode inc license agreement data files and software", "unicode", 3),
    ("curl", " copyright c 1996 .{0,40}?daniel stenberg", "curl", 3),
    ("upl", " universal permissive license(?: upl)?(?: version)? 1 0", "upl-1", 3),
    ("universal permissive", " universal permissive license", "upl", 2),
    ("blue oak", " blue oak model license(?: 1 0 0)?", "blueoak", 3),
    ("zero clause bsd", " zero clause bsd(?: license)?", "0bsd", 3),
    ("0bsd", " 0bsd(?= )", "0bsd", 3),
    ("x11", " x11 license", "x11", 2),
    ("expat", " expat license", "mit", 2),
    ("postgresql", " postgresql licen[sc]e", "postgresql", 2),
    ("ruby license", " (?:the )?ruby license", "ruby", 2),
    ("vim license", " vim license", "vim", 2),
    ("libpng", " libpng license(?: version 2)?", "libpng", 2),
    ("freetype", " freetype (?:project )?license", "ftl", 2),
    ("imagemagick", " imagemagick license", "imagemagick", 2),
    # Copyleft notices and openings
    ("gnu general public", " free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 2),
    ("gnu general public", " gnu general public license as published by the free software foundation either version 1(?= )", "gpl-1-or-later", 4),
    ("gnu general public", " gnu general public license as published by the free software foundation either version 2(?= )", "gpl-2-or-later", 4),
    ("gnu general public", " gnu general public license as published by the free software foundation either version 3(?= )", "gpl-3-or-later", 4),
    ("gnu general public", " gnu general public license version 2 as published by the free software foundation", "gpl-2-only", 4),
    ("gnu general public", " gnu general public license version 3 as published by the free software foundation", "gpl-3-only", 4),
    ("gnu general public", " gnu general public license version 2 june 1991", "gpl-2", 4),
    ("gnu general public", " gnu general public license version 3 29 june 2007", "gpl-3", 4),
    ("gnu lesser", " gnu lesser general public license as published by the free software foundation either version 2 1(?= )", "lgpl-2.1-or-later", 4),
    ("gnu lesser", " gnu lesser general public license as published by the free software foundation either version 3(?= )", "lgpl-3-or-later", 4),
    ("gnu lesser", " gnu lesser general public license version 2 1 february 1999", "lgpl-2.1", 4),
    ("gnu library", " gnu library general public license as published by the free software foundation either version 2(?= )", "lgpl-2-or-later", 4),
    ("gnu affero", " gnu affero general public license as published by the free software foundation either version 3(?= )", "agpl-3-or-later", 4),
    ("gnu affero", " gnu affero general public license version 3 19 november 2007", "agpl-3", 4),
    ("gnu free documentation", " permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 4),
    ("server side public", " server side public license(?: version 1)?", "sspl-1", 3),
    ("business source", " business source license(?: 1 1)?", "busl", 3),
    ("elastic license", " elastic license (?:version )?2 0", "elastic-2", 3),
    ("commons clause", " commons clause license condition", "commons-clause", 4),
    ("polyform", " polyform (?:noncommercial|small business|shield|strict) license", "polyform", 3),
    ("mozilla public", " this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", 4),
    ("mozilla public", " the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 4),
    ("incompatible with secondary", " incompatible with secondary licenses", "mpl-2-no-copyleft-exception", 4),
    ("eclipse public", " made available under the terms of the eclipse public license(?: v)? 2 0", "epl-2", 4),
    ("eclipse public", " made available under the terms of the eclipse public license(?: v)? 1 0", "epl-1", 4),
    ("eclipse distribution", " eclipse distribution license(?: v)? 1 0", "bsd-3", 3),
    ("common development and distribution", " subject to the terms of the common development and distribution license", "cddl", 4),
    ("sleepycat", " sleepycat license", "sleepycat", 2),
    ("q public", " q public license(?: version)? 1 0", "qpl-1", 3),
    ("cecill", " cecill b(?= )", "cecill-b", 3),
    ("cecill", " cecill c(?= )", "cecill-c", 3),
    ("cecill", " cecill(?: free software)? license agreement", "cecill", 2),
    ("mulan", " mulan psl v2", "mulan-psl-2", 3),
    ("mulan", " mulan permissive software license version 2", "mulan-psl-2", 3),
    ("microsoft reciprocal", " microsoft reciprocal license", "ms-rl", 2),
    ("ibm public", " ibm public license version 1 0", "ipl-1", 3),
    ("apple public source", " apple public source license(?: version)? 2 0", "apsl-2", 3),
    ("nokia open", " nokia open source license", "nokia", 2),
    ("sun public", " sun public license version 1 0", "spl-1", 3),
    ("netscape public", " netscape public license version 1 1", "npl-1.1", 3),
    ("latex project", " latex project public license(?: version 1 3)?", "lppl", 3),
    ("open data commons", " open data commons open database license", "odbl", 3),
    ("open data commons", " open data commons attribution license", "odc-by", 3),
    ("open data commons", " open data commons public domain dedication", "pddl", 3),
    ("community data license", " community data license agreement permissive", "cdla-permissive", 3),
    ("community data license", " community data license agreement sharing", "cdla-sharing", 3),
    ("open government", " open government licen[sc]e(?: v| version)? ?3", "ogl-3", 3),
    ("open government", " open government licen[sc]e", "ogl", 2),
    ("etalab", " (?:licence ouverte|open licence) etalab", "etalab", 3),
    # Apache notices
    ("licensed under the apache", " licensed under the apache license version 2 0 the license you may not use this file except in compliance", "apache-2", 4),
    ("apache org licenses", " apache org licenses license 2 0", "apache-2", 4),
    ("apache software foundation", " licensed to the apache software foundation asf under one or more contributor license agreements", "apache-2", 4),
    # Addresses of license texts
    ("opensource org licenses", " opensource org licenses mit", "mit", 3),
    ("opensource org licenses", " opensource org licenses bsd", "bsd", 3),
    ("gnu org licenses", " gnu org licenses gpl 3 0", "gpl-3", 3),
    ("gnu org licenses", " gnu org licenses (?:old licenses )?gpl 2 0", "gpl-2", 3),
    ("gnu org licenses", " gnu org licenses lgpl", "lgpl", 2),
    ("gnu org licenses", " gnu org licenses agpl", "agpl", 2),
    ("gnu org licenses", " gnu org licenses(?= )", "gnu", 1),
    ("mozilla org mpl", " mozilla org mpl 2 0", "mpl-2", 3),
    ("eclipse org legal", " eclipse org legal epl 2 0", "epl-2", 3),
    ("eclipse org legal", " eclipse org legal epl v ?10", "epl-1", 3),
    ("creativecommons org", " creativecommons org licenses by 4 0", "cc-by-4", 3),
    ("creativecommons org", " creativecommons org licenses by 3 0", "cc-by-3", 3),
    ("creativecommons org", " creativecommons org licenses by sa 4 0", "cc-by-sa-4", 3),
    ("creativecommons org", " creativecommons org licenses by sa 3 0", "cc-by-sa-3", 3),
    ("creativecommons org", " creativecommons org licenses by nc 4 0", "cc-by-nc-4", 3),
    ("creativecommons org", " creativecommons org licenses by nc sa 4 0", "cc-by-nc-sa-4", 3),
    ("creativecommons org", " creativecommons org licenses by nc nd 4 0", "cc-by-nc-nd-4", 3),
    ("creativecommons org", " creativecommons org licenses by nd 4 0", "cc-by-nd-4", 3),
    ("creativecommons org", " creativecommons org publicdomain zero 1 0", "cc0-1", 3),
    ("creativecommons org", " creativecommons org publicdomain mark 1 0", "public-domain", 3),
    ("scripts sil org", " scripts sil org ofl", "ofl", 2),
    ("unlicense org", " unlicense org(?= )", "unlicense", 3),
    # Exceptions
    ("classpath", " gnu classpath exception", "classpath-exception", 4),
    ("classpath exception", " classpath exception 2 0", "classpath-exception", 4),
    ("linking this library", " linking this library statically or dynamically with other modules", "classpath-exception", 4),
    ("gcc runtime library", " gcc runtime library exception", "gcc-exception", 4),
    ("autoconf", " autoconf configure script exception", "autoconf-exception", 4),
    ("bison", " special exception to the gnu general public license .{0,60}?bison", "bison-exception", 4),
    ("font exception", " font exception 2 0", "font-exception", 4),
    ("llvm exception", " llvm exceptions?(?= )", "llvm-exception", 4),
    ("linux syscall note", " linux syscall note", "linux-syscall-note", 4),
    ("openssl exception", " openssl(?: linking)? exception", "openssl-exception", 4),
    ("universal foss", " universal foss exception", "foss-exception", 4),
    # Choices
    ("dual licen", " dual licen[sc]ed under (?:the )?(?:mit|bsd|apache|gpl)", "dual-licensed", 4),
    ("gpl", " (?:gpl and|gpl or|gpl) commercial license", "dual-licensed", 4),
    ("at your option", " licensed under either of .{0,60}?apache license version 2 0 .{0,60}?mit license .{0,40}?at your option", "apache-2-or-mit", 4),
    ("mit or apache", " mit or apache 2 0", "apache-2-or-mit", 4),
    ("apache 2 0 or mit", " apache 2 0 or mit", "apache-2-or-mit", 4),
    ("gpl 2 0 or", " gpl 2 0 or (?:mit|bsd|apache)", "dual-licensed", 4),
    ("same terms as perl", " under the same terms as perl itself", "artistic-or-gpl", 4),
    ("mpl 1 1 gpl 2 0 lgpl", " mpl 1 1 gpl 2 0 lgpl 2 1", "mpl-gpl-lgpl", 4),
)


#: Bare identifiers that say a license only beside a word like it (the German "mit" doesn't), and their labels. Fixed facts.
BARE = {"mit": "mit", "isc": "isc", "bsd": "bsd", "zlib": "zlib", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mpl": "mpl", "cc0": "cc0", "unlicense": "unlicense", "wtfpl": "wtfpl"}

#: What follows a bare identifier must not be the rest of a longer name.
ALONE = "(?= (?!licen|public|general|software|version|clause|style|v[0-9 ]|[0-9]))"


def rules() -> list[tuple[str, str, str, int]]:
    """All rules: keyword, regex over words that starts at a space, label, priority."""
    out = list(SINGLE)
    for name, short, label, versions in FAMILIES:
        key = name.rsplit(" ", 1)[0]
        out.append((key, f" {name}(?= )", label, 2))
        out.append(("spdx", f" spdx license identifier {short}(?= )", label, 2))
        for v in versions:
            mark, later = f"{label}-{v.replace(' ', '.').removesuffix('.0')}", "(?: or (?:any |at your option any )?later(?: version)?)?"
            out.append((key, f" {name} (?:version |v ?)?{v}{later}(?= )", mark, 3))
            out.append((short.split(" ")[0], f" {short} (?:v ?)?{v}(?: only| or later)?(?= )", mark, 3))
            out.append(("spdx", f" spdx license identifier {short} {v}(?: only| or later)?(?= )", mark, 4))
            if " " not in short:  # the name and its version in one word
                joined = v.removesuffix(" 0") + ("(?: 0)?" if v.endswith(" 0") else "")
                out.append((f"{short}{v[0]}", f" {short}{joined}(?: only| or later)?(?= )", mark, 3))
                out.append((f"{short}v{v[0]}", f" {short}v{joined}(?: only| or later)?(?= )", mark, 3))
    for short, label in BARE.items():
        for beside in ("license", "licence", "license type", "licensed under", "licensed under the", "released under", "released under the"):
            out.append((f"{beside} {short}", f" {beside} {short}{ALONE}", label, 2))
        out.append((f"{short} licensed", f" {short} licensed(?= )", label, 2))
    out.append(("cc0", f" cc0{ALONE}", "cc0", 2))
    return list(dict.fromkeys(out))


def _needed(rule: str, key: str) -> str:
    """What a rule can't do without: its keyword, or the words its regex starts with, whichever says more."""
    m = re.match(r" [a-z0-9 ]+(?![?*{])", rule)
    return max(m[0] if m else "", f" {key}", key=len)


def _tree(words: list[str]) -> str:
    """One pattern for all of the words, laid out by their characters: where none begins, that shows at once."""
    node: dict = {}
    for word in words:
        at = node
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def branches(at: dict) -> str:
        if "" in at:  # what goes on behind a word needn't be looked at
            return ""
        return either([(c, (BETWEEN if c == " " else c) + branches(rest)) for c, rest in sorted(at.items())])

    def either(parts: list[tuple[str, str]]) -> str:
        if len(parts) < 5 or parts[0][0] == " ":
            return parts[0][1] if len(parts) == 1 else f"(?:{'|'.join(p for _, p in parts)})"
        # Of many branches a look at the next character leaves half.
        low, high = parts[: len(parts) // 2], parts[len(parts) // 2 :]
        return f"(?:(?=[{''.join(c for c, _ in low)}]){either(low)}|{either(high)})"

    return branches(node)


def gate() -> str:
    """A pattern that finds what some rule or base phrase can't do without in a lower-cased text."""
    needed = {_needed(rule, key) for key, rule, _, _ in rules()} | {f" {phrase}" for phrase in BASE}
    return f"(?:^|{BETWEEN.removesuffix('+')}){_tree([n.lstrip() for n in needed])}"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _found(norm: Column, regex: Column, label: Column, priority: Column) -> Column:
    """An array of start, -end, -priority, label for the matches of one rule."""
    texts, gaps = F.regexp_extract_all(norm, regex, F.lit(0)), F.split(norm, regex, -1)
    empty = F.expr("array_remove(array(named_struct('start', 0, 'end', 0, 'priority', 0, 'label', '')), named_struct('start', 0, 'end', 0, 'priority', 0, 'label', ''))")

    def step(acc: Column, both: Column) -> Column:
        start = acc["at"] + F.length(both["gap"])
        end = start + F.length(both["text"])
        one = F.struct(start.alias("start"), (-end).alias("end"), (-priority).alias("priority"), label.alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(texts)), texts, lambda g, t: F.struct(g.alias("gap"), t.alias("text")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("all")), step, lambda acc: acc["all"])


def _surviving(found: Column) -> Column:
    """Labels and best priority of what no earlier, at least as important match contains."""
    none = F.expr("array_remove(array(''), '')")
    start = F.struct(*[F.lit(0).alias(f"e{k}") for k in (1, 2, 3, 4)], none.alias("labels"), F.lit(0).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        end, p = -d["end"], -d["priority"]
        within = F.when(p == 4, acc["e4"]).when(p == 3, acc["e3"]).when(p == 2, acc["e2"]).otherwise(acc["e1"]) >= end
        reach = [F.when(~within & (p >= k), F.greatest(acc[f"e{k}"], end)).otherwise(acc[f"e{k}"]).alias(f"e{k}") for k in (1, 2, 3, 4)]
        labels = F.when(within, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"])))
        return F.struct(*reach, labels.alias("labels"), F.when(within, acc["best"]).otherwise(F.greatest(acc["best"], p)).alias("best"))

    # Sorted by start, then the longest and the most important first.
    return F.aggregate(F.array_sort(found), start, step)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = docs.select([named(c) for c in docs.columns if c.lower() not in added or c == text])
    norm_name, kept = (fresh(docs.columns, n) for n in ("_norm", "_kept"))
    raw = F.coalesce(named(text), F.lit(""))
    # "^ word word ... " for texts that may hold a license, else null. To pass a text over, all letters may be in lower case.
    low = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    cut = docs.withColumn(norm_name, F.when(F.lower(raw).rlike(gate()), F.concat(F.lit("^ "), F.trim(F.regexp_replace(low, BETWEEN, " ")), F.lit(" "))))
    norm = F.col(norm_name)
    phrases = [fresh(docs.columns, f"_phrase{i}") for i in range(len(BASE))]
    for name, phrase in zip(phrases, BASE):
        cut = cut.withColumn(name, F.split(norm, f"(?= {phrase} )", -1))
    parts = [F.col(n) for n in phrases]
    count = [F.coalesce(F.size(p) - 1, F.lit(0)) for p in parts]
    first = F.array_min(F.array(*[F.when(n > 0, _spaces(p[0])) for n, p in zip(count, parts)]))
    last = F.array_max(F.array(*[F.when(n > 0, _spaces(norm) - _spaces(F.element_at(p, -1))) for n, p in zip(count, parts)]))
    base = F.array_sort(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, label in zip(count, BASE.values())])))
    # Each keyword is looked for once, and brings its rules.
    keyed: dict[str, list[Column]] = {}
    for key, rule, label, priority in rules():
        keyed.setdefault(key, []).append(F.struct(F.lit(rule).alias("regex"), F.lit(label).alias("label"), F.lit(priority).alias("priority")))
    table = F.array(*[F.struct(F.lit(f" {key}").alias("key"), F.array(*own).alias("rules")) for key, own in keyed.items()])
    tried = F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, r["key"])), lambda r: r["rules"]))
    found = F.flatten(F.transform(tried, lambda r: _found(norm, r["regex"], r["label"], r["priority"])))
    out = cut.withColumn(kept, F.when(norm.isNotNull(), _surviving(found)))
    labels = F.array_sort(F.array_union(F.coalesce(F.col(kept)["labels"], F.expr("array_remove(array(''), '')")), base))
    n_base = sum(count[1:], count[0])
    return out.select(
        *[named(c) for c in docs.columns if c.lower() not in added],
        F.when(norm.isNull(), F.size(F.array_remove(F.split(raw, APART, -1), ""))).otherwise(F.when(F.length(norm) > 3, _spaces(norm) - 1).otherwise(0)).cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        first.cast("long").alias("first_word"),
        last.cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.8), F.lit(0.95), F.lit(0.99)), F.coalesce(F.col(kept)["best"], F.lit(0)) + 1)).alias("score"),
    )
