"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by containment and priority.

A text is lower-cased (A-Z) and cut into words; signatures are regular expressions over its words. Cheap substring tests
decide which rules may match; only their expressions run. A detection that lies within one of its own or a higher priority is
suppressed (of equal ones, the later rule's); labels that say little (`proprietary`, `gnu`) are kept only where nothing else is found. So what says
more, a sentence or a name with its version, is never lost to a longer phrase that says less. A license has one label, however it is written: its
identifier in lower case, without "-only" and with "-or-later" where the text says so in words or by a plus sign.
Signs are no words; where a plus sign follows a number, or a colon or equals sign the word license, a second copy of the words
carries marks, and the rules about such signs read that copy.
All is one map-only DataFrame expression, linear in a text's words: texts are neither shuffled nor collected, whatever their source.

Null text counts as empty: no words, no labels, score 0. Null ids and repeated rows are scanned like others; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import table, text_of

NAME = "op3_license_scan"
ORACLE_SQL = None

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: What may follow a family's name, and what may follow its version, as words of a signature.
VERSION = "(?: version)?(?: v)?"
LATER = " or (?:at your option )?(?:any )?later(?: versions?)?"

#: Marks on words of the second copy: a plus sign after a number, and a colon or equals sign after the word license.
PLUS, FIELD = "\ue000", "\ue001"

#: Labels that say little: they stay only where no other is found.
VAGUE = ["proprietary", "gnu"]

#: Fixed values. Families of signatures: keyword, then label prefix, name expression and versions (words). One rule is built for each
#: version, of priority 2 and weight 0.95, and one for the bare name, of priority 1 and weight 0.8. The first eight also come with later versions, of priority 3.
FAMILIES = [
    ("general public", "gpl", "(?:gnu |(?<!gnu )(?<!lesser )(?<!library )(?<!affero ))general public license", ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("general public", "lgpl", "(?:gnu )?(?:lesser|library) general public license", ["2", "2 0", "2 1", "3", "3 0"]),
    ("affero", "agpl", "(?:gnu )?affero general public license", ["1", "3", "3 0"]),
    ("gnu", "gfdl", "gnu free documentation license", ["1 1", "1 2", "1 3"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1", "3", "3 0"]),
    ("gfdl", "gfdl", "(?:gnu )?gfdl", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", "apache(?: software)? license", ["1 0", "1 1", "2", "2 0"]),
    ("mozilla", "mpl", "mozilla public license", ["1 0", "1 1", "2", "2 0"]),
    ("mpl", "mpl", "mpl", ["1 0", "1 1", "2", "2 0"]),
    ("eclipse", "epl", "eclipse public license", ["1 0", "2 0"]),
    ("epl", "epl", "epl", ["1 0", "2 0"]),
    ("distribution license", "cddl", "common development and distribution license", ["1 0", "1 1"]),
    ("cddl", "cddl", "cddl", ["1 0", "1 1"]),
    ("common public", "cpl", "common public license", ["1 0"]),
    ("european union", "eupl", "european union public licen[cs]e", ["1 0", "1 1", "1 2"]),
    ("eupl", "eupl", "eupl", ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", "artistic license", ["1 0", "2 0"]),
    ("academic free", "afl", "academic free license", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("open software", "osl", "open software license", ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("boost", "bsl", "boost software license", ["1 0"]),
    ("business source", "busl", "business source license", ["1 0", "1 1"]),
    ("python software", "psf", "python software foundation license", ["2", "2 0"]),
    ("open font", "ofl", "sil open font license", ["1 0", "1 1"]),
    ("zope", "zpl", "zope public license", ["1 1", "2 0", "2 1"]),
    ("php license", "php", "php license", ["3 0", "3 01"]),
    ("microsoft", "ms-pl", "microsoft public license", []),
    ("microsoft", "ms-rl", "microsoft reciprocal license", []),
    ("server side", "sspl", "server side public license", ["1", "1 0"]),
    ("open data commons", "odbl", "open data commons open database license", ["1 0"]),
    ("open data commons", "odc-by", "open data commons attribution license", ["1 0"]),
    ("open data commons", "pddl", "open data commons public domain dedication(?: and license)?", ["1 0"]),
    ("open government", "ogl", "open government licen[cs]e", ["1 0", "2 0", "3 0"]),
    ("lppl", "lppl", "lppl", ["1 0", "1 1", "1 2", "1 3", "1 3a", "1 3c"]),
    ("latex project", "lppl", "latex project public license", ["1 0", "1 1", "1 2", "1 3", "1 3a", "1 3c"]),
    ("cc by", "cc-by", "cc by", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc by", "cc-by-sa", "cc by sa", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc by", "cc-by-nd", "cc by nd", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc by", "cc-by-nc", "cc by nc", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc by", "cc-by-nc-sa", "cc by nc sa", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc by", "cc-by-nc-nd", "cc by nc nd", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("creative commons", "cc-by", "creative commons attribution", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("creative commons", "cc-by-sa", "creative commons attribution share ?alike", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("creative commons", "cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("creative commons", "cc-by-nc", "creative commons attribution non ?commercial", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("creative commons", "cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("creative commons", "cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc0", "cc0", "cc0", ["1 0"]),
    ("mit license", "mit", "mit license", []),
    ("bsd", "bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license", []),
    ("bsd", "bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) license", []),
    ("bsd", "bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd) license", []),
    ("bsd", "bsd", "bsd(?: style)? license", []),
    ("isc license", "isc", "isc license", []),
    ("zlib", "zlib", "zlib(?: libpng)? license", []),
    ("unlicense", "unlicense", "unlicense", []),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?", []),
    ("openssl", "openssl", "openssl license", []),
    ("vim license", "vim", "vim license", []),
    ("postgresql", "postgresql", "postgresql licen[cs]e", []),
    ("beerware", "beerware", "beerware(?: license)?", []),
]

#: Fixed values. Identifiers as they stand behind "SPDX-License-Identifier:" or "license:"; the label is the identifier in lower case. Priority 3, weight 1.
SPDX = """
MIT MIT-0 X11 ISC Zlib Unlicense WTFPL BSL-1.0 0BSD BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSD-2-Clause-Patent
Apache-1.0 Apache-1.1 Apache-2.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later GPL-2.0 GPL-3.0
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LGPL-2.1 LGPL-3.0
AGPL-1.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 GFDL-1.1 GFDL-1.2 GFDL-1.3 MPL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0
EUPL-1.0 EUPL-1.1 EUPL-1.2 Artistic-1.0 Artistic-2.0 AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0
PSF-2.0 Python-2.0 OFL-1.0 OFL-1.1 ZPL-1.1 ZPL-2.0 ZPL-2.1 PHP-3.0 PHP-3.01 MS-PL MS-RL SSPL-1.0 BUSL-1.1 NCSA OpenSSL Vim PostgreSQL Ruby Beerware
ODbL-1.0 ODC-By-1.0 PDDL-1.0 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c CC0-1.0 CC-PDDC
CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0
CC-BY-ND-2.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0
"""

#: Fixed values. Short forms: keyword, label, expression. Priority 2, weight 0.9.
SHORT = [
    ("gplv", "gpl-1.0", "(?:gnu )?gplv1(?: 0)?"),
    ("gplv", "gpl-2.0", "(?:gnu )?gplv2(?: 0)?"),
    ("gplv", "gpl-3.0", "(?:gnu )?gplv3(?: 0)?"),
    ("gplv", "lgpl-2.0", "(?:gnu )?lgplv2(?: 0)?"),
    ("gplv", "lgpl-2.1", "(?:gnu )?lgplv2 1"),
    ("gplv", "lgpl-3.0", "(?:gnu )?lgplv3(?: 0)?"),
    ("gplv", "agpl-3.0", "(?:gnu )?agplv3(?: 0)?"),
    (" gpl2 ", "gpl-2.0", "gpl2"),
    (" gpl3 ", "gpl-3.0", "gpl3"),
    ("apache 2", "apache-2.0", "apache 2(?: 0)?"),
    ("apache v2", "apache-2.0", "apache v2(?: 0)?"),
    ("apache2", "apache-2.0", "apache2"),
    ("asl 2 0", "apache-2.0", "asl 2 0"),
    ("2 clause", "bsd-2-clause", "bsd 2 clause(?: license)?|2 clause bsd(?: license)?"),
    ("3 clause", "bsd-3-clause", "bsd 3 clause(?: license)?|3 clause bsd(?: license)?"),
    ("4 clause", "bsd-4-clause", "bsd 4 clause(?: license)?|4 clause bsd(?: license)?"),
    ("0bsd", "0bsd", "0bsd"),
    (" bsd licensed ", "bsd", "bsd licensed"),
    (" mit licensed ", "mit", "mit licensed"),
    (" mit x11 ", "mit", "mit x11(?: license)?"),
    ("expat license", "mit", "expat license"),
    ("x11 license", "x11", "x11 license"),
    ("licensed under mit", "mit", "licensed under mit"),
    ("licensed under bsd", "bsd", "licensed under bsd"),
    ("licensed under gpl", "gpl", "licensed under gpl"),
    ("licensed under apache", "apache", "licensed under apache"),
    ("mplv", "mpl-1.1", "mplv1 1"),
    ("mplv", "mpl-2.0", "mplv2(?: 0)?"),
    ("cc0", "cc0-1.0", "cc0 1 0 universal"),
    ("cc zero", "cc0", "cc zero"),
    ("creative commons zero", "cc0", "creative commons zero"),
    ("creative commons", "cc-pdm", "creative commons public domain mark"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license"),
    ("ruby license", "ruby", "ruby license"),
    ("perl", "artistic-or-gpl", "same terms as perl(?: 5)? itself"),
    ("json license", "json", "json license"),
    ("free for non commercial", "non-commercial", "free for non ?commercial use"),
    ("for non commercial use only", "non-commercial", "for non ?commercial use only"),
    ("for research purposes only", "research-only", "for research purposes only"),
    ("for personal use only", "personal-only", "for personal use only"),
    ("do not distribute", "proprietary", "do not distribute"),
]

#: Fixed values. Sentences of license texts and notices: keyword, label, expression. Priority 3, weight 1.
TEXTS = [
    ("permission is hereby granted", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("the above copyright notice and this permission", "mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("permission to use", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("redistribution and use", "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("neither the name", "bsd-3-clause", "neither the name of .{1,80} nor the names of its contributors may be used"),
    ("all advertising materials", "bsd-4-clause", "all advertising materials mentioning features or use of this software"),
    ("released into the public domain", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("altered source versions", "zlib", "altered source versions must be plainly marked as such"),
    ("licensed under the apache", "apache-2.0", "licensed under the apache license version 2(?: 0)?"),
    ("licensed to the apache software foundation", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("under the terms of the gnu", "gpl", "under the terms of the gnu general public license"),
    ("under the terms of the gnu", "gpl-2.0", "under the terms of the gnu general public license version 2(?: 0)?"),
    ("under the terms of the gnu", "gpl-3.0", "under the terms of the gnu general public license version 3(?: 0)?"),
    ("either version 2 of the license", "gpl-2.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("either version 3 of the license", "gpl-3.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("under the terms of the gnu", "lgpl", "under the terms of the gnu (?:lesser|library) general public license"),
    ("either version 2 1 of the license", "lgpl-2.1-or-later", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("under the terms of the gnu", "agpl", "under the terms of the gnu affero general public license"),
    ("source code form", "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("source code form", "mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("eclipse public license", "epl-2.0", "made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("eclipse public license", "epl-1.0", "made available under the terms of the eclipse public license v1 0"),
    ("boost software license", "bsl-1.0", "distributed under the boost software license version 1 0"),
    ("released under the mit", "mit", "released under the mit license"),
    ("licensed under cc", "cc-by", "licensed under cc by"),
    ("licensed under a creative commons", "cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("licensed under a creative commons", "cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("software is provided", "mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("software is provided", "isc", "the software is provided as is and the author disclaims all warranties"),
    ("software is provided by", "bsd", "this software is provided by .{1,80} as is and any express or implied warranties"),
    ("as is basis", "apache-2.0", "distributed on an as is basis without warranties or conditions of any kind"),
    ("in the hope that it will be useful", "gnu", "distributed in the hope that it will be useful but without any warranty"),
    ("dedicated to the public domain", "public-domain", "dedicated to the public domain"),
    ("in the public domain", "public-domain", "(?:is|placed) in the public domain"),
]

#: Fixed values. What says only that rights are kept: priority 1, weight 0.5.
RESERVED = [("all rights reserved", "proprietary", "all rights reserved"), ("confidential and proprietary", "proprietary", "confidential and proprietary"), ("proprietary license", "proprietary", "proprietary license")]


def _version(words: str) -> str:
    """A version's words as in an identifier: 2 and 2 0 are both 2.0."""
    return words.replace(" ", ".") if " " in words else f"{words}.0"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, label, expression over words, priority, weight) in order: base phrases, signs, identifiers, sentences, families by version, short forms, bare names, reserved rights.
    Rules whose keyword holds a mark read the marked words."""
    out = [(phrase, label, phrase, 0, 0.7) for phrase, label in BASE.items()]
    spdx = [(name.lower().replace("-", " ").replace(".", " "), name.lower().removesuffix("-only")) for name in SPDX.split()]
    later = [(f"{name}{VERSION} v?{v}", f"{label}-{_version(v)}-or-later") for _, label, name, versions in FAMILIES[:8] for v in versions]
    later += [(text, f"{label}-or-later") for keyword, label, text in SHORT if keyword == "gplv"]
    gnu = [(words, label) for words, label in spdx if "gpl" in label and label[-1].isdigit()]
    field = f"(?:spdx license identifier|licen[cs]es?){FIELD}"
    out += [(f"{FIELD} {words}{PLUS}", f"{label}-or-later", f"{field} {words}{PLUS}", 3, 1.0) for words, label in gnu]
    out += [(f"{FIELD} {words}", label, f"{field} {words}", 3, 1.0) for words, label in spdx]
    out += [(PLUS, label, text + PLUS, 3, 0.95) for text, label in later]
    out += [("spdx license identifier", label, f"spdx license identifier {words}", 3, 1.0) for words, label in spdx]
    out += [(keyword, label, text, 3, 1.0) for keyword, label, text in TEXTS]
    out += [(" later ", label, text + LATER, 3, 0.95) for text, label in later]
    for keyword, label, name, versions in FAMILIES:
        out += [(keyword, f"{label}-{_version(v)}", f"{name}{VERSION} v?{v}(?: only)?", 2, 0.95) for v in versions]
    out += [(keyword, label, text, 2, 0.9) for keyword, label, text in SHORT]
    out += [(keyword, label, name, 1, 0.8) for keyword, label, name, _ in FAMILIES]
    return out + [(keyword, label, text, 1, 0.5) for keyword, label, text in RESERVED]


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _words(lower: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _marked(lower: Column) -> Column:
    """The words with marks, or nothing where there is no such sign. A mark belongs to the word before it, so places are the same."""
    own = F.translate(lower, PLUS + FIELD, "\ue002\ue002")
    plus = F.regexp_replace(own, r"(?<=[0-9])\+(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])", PLUS)
    both = F.regexp_replace(plus, "(?<=licen[cs]es?|identifier)[\"']?[ \\t]*[:=]", FIELD + " ")
    found = F.when(lower.contains("+") | lower.rlike("(?:licen[cs]es?|identifier)[\"']?[ \\t]*[:=]"), _words(both))
    return F.when(found.contains(PLUS) | found.contains(FIELD), found).otherwise("")


def _places(words: Column, expression: Column) -> Column:
    """Start and end (words from 0, end excluded) of every match, from the places of the words that open and close marked matches."""
    marked = F.regexp_replace(words, F.concat(F.lit("(?<= )((?:"), expression, F.lit("))(?= )")), F.lit("\u0001$1\u0002"))

    def of(text: Column) -> Column:
        at = lambda mark, more: F.filter(F.transform(F.split(text, " "), lambda w, i: F.when(w.contains(mark), i + more)), lambda i: i.isNotNull())
        pairs = F.zip_with(at("\u0001", -1), at("\u0002", 0), lambda a, b: F.struct(a.alias("s"), b.alias("e")))
        return F.when(text.contains("\u0001"), pairs).otherwise(F.array().cast("array<struct<s:int,e:int>>"))

    return F.flatten(F.transform(F.array(marked), of))


def _hits() -> Column:
    """The rules whose keyword a text's words hold: each keyword is looked for once."""
    grouped: dict[str, list[dict]] = {}
    for i, (keyword, label, text, priority, weight) in enumerate(rules()):
        grouped.setdefault(keyword, []).append({"label": label, "x": text, "p": priority, "w": weight, "i": i, "m": PLUS in keyword or FIELD in keyword})
    groups = [{"k": k, "m": each[0]["m"], "rules": each} for k, each in grouped.items()]
    # One literal: hundreds of expressions would be analysed again and again.
    groups = F.from_json(F.lit(json.dumps(groups)), "array<struct<k:string,m:boolean,rules:array<struct<label:string,x:string,p:int,w:double,i:int,m:boolean>>>>")
    hit = F.filter(groups, lambda g: F.when(g["m"], F.col("_m").contains(g["k"])).otherwise(F.col("_w").contains(g["k"])))
    return F.flatten(F.transform(hit, lambda g: g["rules"]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base detections (n_base, first_word, last_word, base_labels), labels, n_detections, score."""
    lower = F.translate(text_of(docs), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    read = docs.select("doc_id", lower.alias("_t")).select("doc_id", _words(F.col("_t")).alias("_w"), _marked(F.col("_t")).alias("_m"))
    read = read.withColumn("n_words", F.when(F.col("_w") == "  ", 0).otherwise(_spaces(F.col("_w")) - 1).cast("long"))
    places = lambda r: _places(F.when(r["m"], F.col("_m")).otherwise(F.col("_w")), r["x"])
    each = F.transform(_hits(), lambda r: F.transform(places(r), lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("e"), (-r["p"]).alias("p"), r["i"].alias("i"), r["label"].alias("label"), r["w"].alias("weight"))))
    read = read.withColumn("_d", F.flatten(each))
    # In the order of start, length and priority a detection within an earlier one ends no later; `reach` holds how far those of each priority go.
    ordered = F.array_sort(F.filter("_d", lambda d: d["p"] < 0))
    none = F.struct(F.array(F.lit(0), F.lit(0), F.lit(0)).alias("reach"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def kept(a: Column, d: Column) -> Column:
        end, level = -d["e"], -d["p"]
        free = end > F.array_max(F.slice(a["reach"], level, 4 - level))
        reach = F.transform(a["reach"], lambda x, k: F.when(k + 1 == level, F.greatest(x, end)).otherwise(x))
        return F.when(free, F.struct(reach.alias("reach"), (a["n"] + 1).alias("n"), F.array_union(a["labels"], F.array(d["label"])).alias("labels"), F.greatest(a["score"], d["weight"]).alias("score"))).otherwise(a)

    read = read.withColumn("_b", F.filter("_d", lambda d: d["p"] == 0)).withColumn("_s", F.aggregate(ordered, none, kept)).withColumn("_l", F.array_distinct(F.transform("_b", lambda d: d["label"])))
    every = F.array_union("_l", F.col("_s.labels"))
    clear = F.array_except(every, F.array(*map(F.lit, VAGUE)))
    read = read.withColumn("_a", F.when(F.size(clear) > 0, clear).otherwise(every))
    starts = F.transform("_b", lambda d: d["s"])
    return read.select(
        "doc_id",
        "n_words",
        F.size("_b").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort("_l"), ",").alias("base_labels"),
        F.array_join(F.array_sort("_a"), ",").alias("labels"),
        F.col("_s.n").cast("long").alias("n_detections"),
        F.greatest(F.col("_s.score"), F.when(F.size("_b") > 0, 0.7).otherwise(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
