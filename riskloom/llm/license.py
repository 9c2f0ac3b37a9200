"""Licence scans by canonical digests, in DataFrame operations only.

A text is normalised: lower case, copyright lines gone, every run of marks and white space one space, equivalent spellings
one spelling. Its SHA-256 then joins the digests of known licences, so that two texts are the same licence exactly if
they normalise to the same words. The table of known licences is fixed and small, which bounds the broadcast. A line that
speaks of a licence, or of what something is under, is looked up in the same way among known notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings and what stands for them.
SPELLINGS = (
    ("licence", "license"), ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("authorise", "authorize"), ("recognise", "recognize"), ("initialise", "initialize"), ("analyse", "analyze"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("whilst", "while"), ("per cent", "percent"), ("https", "http"),
)
COPYRIGHT = r"^[^\p{L}\n]*(?:copyright\s*(?:\(c\)|©|[0-9]{4}|<|\[|\{)|\(c\)\s*[0-9]{4}|©|all rights reserved)[^\n]*$"

# Texts of short public licences, without their copyright lines.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_BODY = f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
# Headings that a text stands under, the usual one first, and the text. Each may also stand without one.
_BODIES = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"), _MIT_BODY),
    ("MIT-0", ("MIT No Attribution", "MIT No Attribution License", "MIT-0 License"), f"{_MIT}. {_AS_IS}"),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC License (ISCL)"), f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC}"),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "Zero Clause BSD License (0BSD)", "BSD Zero Clause License (0BSD)", "0BSD License", "0BSD"), f"{_ISC_GRANT}. {_ISC}"),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License"), f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Revised BSD License", "Modified BSD License", "BSD License", "The BSD License"), f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
)
TEXTS = tuple((name, text) for name, heads, body in _BODIES for text in (*(f"{h} {body}" for h in heads), body))
# Notices of one line are a subject or none, a verb, "under", and a name with or without "the terms of".
# NOTICES spells all of them out; _said makes one lead of these leads, so that the scan compares names alone.
_SUBJECTS = ("", *(f"This {x} is " for x in ("work", "project", "software", "file", "document", "text", "code", "source code", "program", "library", "package", "module", "repository", "dataset")))
_VERBS = ("licensed", "released", "distributed", "available", "made available", "published", "provided")
_NAMES = (
    ("Apache-2.0", ("the Apache License, Version 2.0", 'the Apache License, Version 2.0 (the "License")', "the Apache License 2.0", "the Apache 2.0 License", "Apache-2.0")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL, version 3", "the GPLv3 license", "GPL-3.0")),
    ("GPL-2.0", ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL, version 2", "the GPLv2 license", "GPL-2.0")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "the CC BY-NC 4.0 license", "the Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-4.0", ("CC BY 4.0", "the CC BY 4.0 license", "the Creative Commons Attribution 4.0 International License")),
    ("MIT", ("the MIT License", "MIT License", "an MIT License", "MIT")),
    ("ISC", ("the ISC License", "ISC License", "ISC")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0")),
)
_SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0", "ISC", "0BSD", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0")
NOTICES = (
    *((name, f"{who}{verb} under {terms}{form}") for name, forms in _NAMES for form in forms for who in _SUBJECTS for verb in _VERBS for terms in ("", "the terms of ")),
    *((x, f"SPDX-License-Identifier: {x}") for x in _SPDX),
)
# Digests of the normalised texts of longer public licences.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
)


def normalise(text: Column) -> Column:
    """The words that a licence text is known by; null is empty."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT, "")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def digest(text: Column) -> Column:
    return F.sha2(normalise(text), 256)


def known(spark) -> DataFrame:
    """digest, license: one row for each known normal form."""
    texts = spark.createDataFrame(list(TEXTS), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    longer = spark.createDataFrame(list(DIGESTS), "license string, digest string").select("digest", "license")
    return texts.unionByName(longer).dropDuplicates(["digest"])


def _said(line: Column) -> Column:
    """A line's normal form, with the lead of a notice as one lead."""
    lead = rf"^(?:{'|'.join(x.strip().lower() for x in _SUBJECTS if x)})? ?(?:{'|'.join(_VERBS)}) under (?:the terms of )?"
    return F.regexp_replace(normalise(line), lead, "licensed under ")


def known_notices() -> list[tuple[str, list[Column]]]:
    """Each licence in order of name, with the digests that its notices have by _said: a fixed table of literals."""
    said = [(n, f"licensed under {form}") for n, forms in _NAMES for form in forms] + [(x, f"SPDX-License-Identifier: {x}") for x in _SPDX]
    return [(name, [F.sha2(_said(F.lit(t)), 256) for n, t in said if n == name]) for name in sorted({n for n, _ in said})]


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, norm_sha256, license (null if the whole text is no known licence) and notices (the known ones among its
    lines, distinct and in order of name, comma-joined) for every row. An empty or null text has the empty text's digest
    and no licence."""
    spark = docs.sparkSession
    spoken = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.lower(x).rlike("licen|under"))
    own = F.transform(spoken, lambda x: F.sha2(_said(x), 256))
    d = docs.select(*keep, digest(F.col(text_col)).alias("norm_sha256"), own.alias("_own"))
    among = lambda digests: F.exists("_own", lambda x: x.isin(digests))
    said = [F.when(among(digests), F.lit(name)) for name, digests in known_notices()]
    d = d.withColumn("notices", F.when(F.size("_own") > 0, F.concat_ws(",", *said)).otherwise("")).drop("_own")
    k = known(spark).select(F.col("digest").alias("_d"), "license")
    return d.join(F.broadcast(k), F.col("norm_sha256") == F.col("_d"), "left").drop("_d")
