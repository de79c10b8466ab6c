"""Licence scans by sentence rules: normalised sentences become known identifiers, and sequences of identifiers
are matched against ordered rules.

Texts that have none of KEYWORDS, one of which each sentence of the table has, have no licence sentence. Others are cut into sentences twice, line by line and
with lines joined into paragraphs; the cut that gives more known sentences counts (ties: lines). Rules are tried in
order; a rule whose identifiers stand next to each other takes them, wherever and as often as they occur, so that
longer and more specific rules come first and a sentence serves one rule. All is DataFrame expressions in one
scan, without a shuffle; the sentence table is a literal of fixed size.

Sentences of licence texts and notices stand in SENTENCES as they are printed. References ("licensed under ...") and
SPDX tags are made from the names of LICENSES, the GNU and the Creative Commons families by rule.
"""

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Identifier -> sentences of licence texts and notices.
SENTENCES = {
    "ApacheUse": ["You may not use this file except in compliance with the License."],
    "ApacheCopy": ["You may obtain a copy of the License at"],
    "ApacheAsIs": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License."],
    "ApacheText": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "MitGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "MitAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "ZeroGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "IscAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "ZlibAsIs": ["This software is provided 'as-is', without any express or implied warranty."],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BoostGrant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BsdAdvert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GplHope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GplSee": ["See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."],
    "GplPreamble": ["The licenses for most software are designed to take away your freedom to share and change it."],
    "Gpl2Text": ["By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."],
    "Gpl3Text": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "Agpl3Text": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "Lgpl3Text": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "MplRef": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "MplCopy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EplRef": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "Epl1Ref": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "Cc0Text": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "UnlicenseUse": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "PublicDomain": ["This work is dedicated to the public domain.", "This work is in the public domain.", "This file is in the public domain.", "This code is in the public domain."],
    "AllRights": ["All rights reserved."],
}
#: SPDX identifier -> the names under which references speak of a licence.
LICENSES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "Apache 2.0", "Apache-2.0"),
    "MIT": ("MIT License", "MIT", "MIT License (MIT)", "Expat License", "X11/MIT License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "zlib/libpng License", "zlib"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL-1.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0", "EPL-2.0"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "Eclipse Public License 1.0", "EPL 1.0", "EPL-1.0"),
    "CDDL-1.0": ("Common Development and Distribution License, version 1.0", "Common Development and Distribution License", "CDDL 1.0", "CDDL"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero", "Creative Commons CC0 1.0 Universal"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "0BSD": ("Zero-Clause BSD License", "0BSD", "BSD Zero Clause License"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL 1.1"),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License", "PSF License"),
    "EUPL-1.2": ("European Union Public Licence, version 1.2", "EUPL 1.2", "EUPL v1.2"),
    "ODbL-1.0": ("Open Database License 1.0", "Open Data Commons Open Database License v1.0", "ODbL 1.0"),
}
#: The GNU family: SPDX stem, names, versions.
GNU = (
    ("GPL", ("GNU General Public License", "GNU GPL", "GPL"), ("1.0", "2.0", "3.0")),
    ("LGPL", ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL"), ("2.0", "2.1", "3.0")),
    ("AGPL", ("GNU Affero General Public License", "GNU AGPL", "AGPL"), ("3.0",)),
)
#: The Creative Commons family: short and long names, versions.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
#: Rules in order, identifiers -> licence. References and tags have a rule each, after these.
RULES = (
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse"), "BSD-4-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("Ref:Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"), "Apache-2.0"),
    (("Ref:Apache-2.0", "ApacheUse"), "Apache-2.0"),
    (("ApacheText",), "Apache-2.0"),
    (("MitGrant", "MitNotice", "MitAsIs"), "MIT"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("IscGrant", "IscAsIs"), "ISC"),
    (("ZeroGrant", "IscAsIs"), "0BSD"),
    (("IscGrant",), "ISC"),
    (("ZlibAsIs", "ZlibGrant"), "Zlib"),
    (("BoostGrant",), "BSL-1.0"),
    (("GplPreamble", "Gpl2Text"), "GPL-2.0-only"),
    (("Gpl3Text", "GplPreamble"), "GPL-3.0-only"),
    (("Gpl3Text",), "GPL-3.0-only"),
    (("Agpl3Text",), "AGPL-3.0-only"),
    (("Lgpl3Text",), "LGPL-3.0-only"),
    (("MplRef", "MplCopy"), "MPL-2.0"),
    (("MplRef",), "MPL-2.0"),
    (("EplRef",), "EPL-2.0"),
    (("Epl1Ref",), "EPL-1.0"),
    (("Cc0Text",), "CC0-1.0"),
    (("Unlicense", "UnlicenseUse"), "Unlicense"),
    (("Unlicense",), "Unlicense"),
    (("Wtfpl",), "WTFPL"),
    (("PublicDomain",), "LicenseRef-public-domain"),
    (("AllRights",), "LicenseRef-all-rights-reserved"),
)
#: What normalising takes for the same, in order: spellings, versions, signs, later versions, holders.
SPELLINGS = (
    (r"\blicence(d|s)?\b", "license$1"), (r"(?:\bversion|\bv|(?<=gpl)v)[. ]*(?=[0-9])", " "), (r"(?<=[0-9])\+", " or later "), (r"[^a-z0-9.]+", " "), (r"(?<![0-9])\.|\.(?![0-9])", " "), (r"(?<=[0-9])\.0(?![0-9.])", ""), (r" +", " "),
    (r"\bor (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?(?: of the license)?\b", "or later"), (r"\bneither the names? of .{1,100}? nor the names? of (?:its|any|their) contributors\b", "neither the name of the copyright holder nor the names of its contributors"),
)
#: The ways to begin a reference that are taken for "licensed under".
LEADS = (r"^(?:(?:this|the) (?:[a-z0-9]+ ){0,3}(?:is|are) )?(?:(?:re)?licensed|released|distributed|made available|available|published) under (?:the terms of )?(?:the |an? )?", "licensed under ")
#: What an SPDX tag begins with, in any case, and the words between the licences of its expression.
TAG, BETWEEN = r"(?i)SPDX-License-Identifier:[ \t]*", r"(?<=\bspdx [A-Za-z0-9.()+ -]{0,200})[ \t]+(?:OR|AND|WITH)[ \t]+"
#: Words and phrases in lower case, of which each sentence of SENTENCES has one, with any lead.
KEYWORDS = ("licen", "copyright", "warrant", "redistribut", "permission", "permitted", "public domain", "all rights reserved", "ed under", "able under", "anyone is free", "advertising materials", "terms and conditions", "of the mpl", "spdx")


def normalised(sentence: Column) -> Column:
    """Lower case, one spelling, no signs but those inside versions, single spaces, one form of reference."""
    out = F.lower(sentence)
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(F.trim(out), *LEADS))


def key(sentence: str) -> str:
    """`normalised` of a sentence of the table."""
    out = sentence.lower()
    for pattern, to in SPELLINGS:
        out = re.sub(pattern, to.replace("$", "\\"), out)
    return re.sub(LEADS[0], LEADS[1], out.strip(" ")).strip(" ")


def named_licenses() -> dict[str, set[str]]:
    """SPDX identifier -> all names of a licence, those of the families made by rule."""
    out = {spdx: set(names) for spdx, names in LICENSES.items()}
    for stem, names, versions in GNU:
        for name, version in product(names, versions):
            out.setdefault(f"{stem}-{version}-only", set()).update({f"{name} v{version}", f"{name} v{version} only"})
            out.setdefault(f"{stem}-{version}-or-later", set()).add(f"{name} v{version} or later")
    for (short, long), version in product(COMMONS.items(), COMMONS_VERSIONS):
        scopes = {"4.0": (" International", " International Public"), "3.0": (" Unported",)}.get(version, (" Generic",))
        ways = {f"CC {short} {version}", *(f"Creative Commons {long} {version}{scope}" for scope in ("", *scopes)), *(f"CC {short} {version}{scope}" for scope in scopes)}
        out[f"CC-{short}-{version}"] = ways
    return out


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier: those of SENTENCES, each name after "licensed under", with and without
    "license" at the end, and each SPDX tag."""
    out = {key(text): name for name, texts in SENTENCES.items() for text in texts}
    for spdx, names in named_licenses().items():
        tags = {spdx, spdx.removesuffix("-only"), spdx.replace("-or-later", "+")}
        out |= {key(f"spdx {tag}"): f"Ref:{spdx}" for tag in tags}
        for name in names:
            out |= {key(f"Licensed under the {name}{end}"): f"Ref:{spdx}" for end in ("", " License")}
    # The GNU notice: "This program is free software: you can redistribute it and/or modify it under the terms of ...".
    for stem, (long, *_), versions in GNU:
        for what, version in product(("program", "library", "software"), versions):
            notice = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation"
            out[key(f"{notice}; either version {version} of the License, or (at your option) any later version")] = f"Ref:{stem}-{version}-or-later"
            out[key(f"{notice}, either version {version} of the License, or (at your option) any later version")] = f"Ref:{stem}-{version}-or-later"
            for only in (f"{notice}, version {version}", f"{notice}; version {version} of the License", f"{notice}; version {version}"):
                out[key(only)] = f"Ref:{stem}-{version}-only"
    return out


#: Normalised sentence -> identifier.
TABLE = sentence_table()
#: All rules: a notice of the GNU family with what follows it, those above, and a reference by itself.
ALL_RULES = (
    *((((f"Ref:{spdx}", "GplHope", "GplSee")), spdx) for spdx in named_licenses() if "GPL" in spdx),
    *RULES,
    *(((f"Ref:{spdx}",), spdx) for spdx in named_licenses()),
)


def hinted(low: Column) -> Column:
    """Whether a text in lower case has a keyword."""
    out = low.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        out = out | low.contains(word)
    return out


def known_sentences(parts: Column) -> Column:
    """The identifiers of an array of sentences, in order; unknown ones are left out."""
    table = F.create_map(*(F.lit(x) for pair in TABLE.items() for x in pair))
    told = F.filter(parts, lambda s: let(F.lower(s), hinted))  # others can't be known, and needn't be normalised
    return F.filter(F.transform(told, lambda s: F.try_element_at(table, normalised(s))), lambda i: i.isNotNull())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, sentences (identifiers in order), licenses (distinct, in the order of the rules).

    Null and empty texts have none; texts are read whole; repeated rows are judged each; an empty table gives an
    empty one; other columns are not read.
    """
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = let(F.lower(text), hinted)
    # An SPDX expression is a line for each of its licences.
    tagged = F.regexp_replace(F.regexp_replace(text, TAG, "spdx "), BETWEEN, "\nspdx ")
    text = F.when(F.contains(F.lower(text), F.lit("spdx")), tagged).otherwise(text)
    # A sentence ends before white space, but not within 'v. 2.0', nor before a lower-case letter after a semicolon.
    ends = r"(?<=[.:!?]|;(?=[ \t]+\p{Lu}))(?!(?<=\b[vV]\.)[ \t]+[0-9])(?!(?<=software:)[ \t]+you can)[ \t]+"
    by_line = F.flatten(F.transform(F.split(text, r"\r?\n"), lambda line: F.split(line, ends)))
    joined = F.flatten(F.transform(F.split(text, r"(?:\r?\n[ \t]*){2,}"), lambda part: F.split(F.regexp_replace(part, r"[ \t]*\r?\n[ \t#*/;-]*", " "), ends)))
    both = F.struct(known_sentences(by_line).alias("lines"), known_sentences(joined).alias("joined"))
    found = F.when(some, let(both, lambda b: F.when(F.size(b["joined"]) > F.size(b["lines"]), b["joined"]).otherwise(b["lines"]))).otherwise(none)

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["ids"])
        return F.struct(F.when(hit, F.replace(acc["left"], rule["ids"], F.lit(",|,"))).otherwise(acc["left"]).alias("left"), F.when(hit, F.array_union(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"))

    # Identifiers are set between commas of their own, so that neighbouring rules don't share one.
    listed = F.concat(F.lit(","), F.array_join("sentences", ",,"), F.lit(","))
    spaced = F.array(*(F.struct(F.lit("," + ",,".join(ids) + ",").alias("ids"), F.lit(name).alias("name")) for ids, name in ALL_RULES))
    licenses = F.aggregate(spaced, F.struct(listed.alias("left"), none.alias("names")), apply, lambda acc: acc["names"])
    out = docs.select(F.col(id_col), found.alias("sentences"))
    return out.select(id_col, "sentences", F.when(F.size("sentences") > 0, licenses).otherwise(none).alias("licenses"))
