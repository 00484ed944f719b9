r"""License scans by canonical digest.

A text is normalised: lower case; lines that state a copyright dropped;
everything but ASCII letters and digits to single spaces; British and other
equivalent spellings to one.  The SHA-256 of what is left is joined with the
digests of known licences, for whole texts and for each line that speaks of a
licence or has its SPDX tag.  Known are the usual licences in their published
wording: short ones as texts, long ones as digests.  Native DataFrame expressions; known licences are a table of any size:
its join is a broadcast only where Spark measures it as small.

Null and empty texts, and texts with nothing left, have the digest of the empty
text and match nothing.  Repeated rows get a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings.
SPELLINGS = {"licence": "license", "sublicence": "sublicense", "noninfringement": "non infringement", "merchantibility": "merchantability", "organisation": "organization", "favour": "favor", "honour": "honor", "acknowledgement": "acknowledgment", "per cent": "percent", "owner": "holder"}
# Short licences and notices in their published wording.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_AUTHOR = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Id, titles that may stand ahead, text.
TEXTS = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"], _MIT),
    ("ISC", ["ISC License", "The ISC License"], f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR}"),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD"], f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_AUTHOR}"),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License"], _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The 3-Clause BSD License"], _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", ["zlib License"], _ZLIB),
    ("BSL-1.0", ["Boost Software License - Version 1.0 - August 17th, 2003"], _BOOST),
    ("Unlicense", [], _UNLICENSE),
    ("Unlicense", [], f"{_UNLICENSE} For more information, please refer to <https://unlicense.org>"),
    ("Unlicense", [], f"{_UNLICENSE} For more information, please refer to <http://unlicense.org/>"),
]
#: Lines by which a document names its licence.
NOTICES = {
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
}
IDENTIFIED = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "ISC", "LGPL-2.1-only", "LGPL-3.0-only", "MIT", "MPL-2.0", "Unlicense", "Zlib", "0BSD", "BSL-1.0"]
KNOWN = {}
for _id, _titles, _text in TEXTS:
    KNOWN.setdefault(_id, []).extend([_text, *(f"{t} {_text}" for t in _titles)])
for _id, _lines in NOTICES.items():
    KNOWN.setdefault(_id, []).extend(_lines)
for _id in IDENTIFIED:
    KNOWN.setdefault(_id, []).append(f"SPDX-License-Identifier: {_id}")
# Canonical digests of long licences as published; the second is of the text up to the end of its terms, without what explains how to apply it.
DIGESTS = {
    "Apache-2.0": ["ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd"],
    "Artistic-1.0-Perl": ["66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39"],
    "CC0-1.0": ["de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c"],
    "GFDL-1.2": ["835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"],
    "GFDL-1.3": ["2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"],
    "GPL-1.0": ["8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"],
    "GPL-2.0": ["b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"],
    "GPL-3.0": ["f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"],
    "LGPL-2.0": ["9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"],
    "LGPL-2.1": ["cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"],
    "MPL-2.0": ["95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"],
}


def canonical(text: Column) -> Column:
    """The normalised text; null as empty."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", "")
    x = F.concat(F.lit(" "), F.regexp_replace(x, "[^a-z0-9]+", " "), F.lit(" "))
    for other, one in SPELLINGS.items():
        x = F.replace(x, F.lit(f" {other} "), F.lit(f" {one} "))
        x = F.replace(x, F.lit(f" {other}s "), F.lit(f" {one}s "))
    return F.trim(F.regexp_replace(x, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, known: dict[str, list[str]] | None = None, digests: dict[str, list[str]] | None = None) -> DataFrame:
    """(license_id, known_digest), one row per digest: the least id that has it.  From texts and digests by id; without any, those of this module."""
    own = known is None and digests is None
    texts = [(name, text) for name, ts in ((KNOWN if own else known) or {}).items() for text in ts]
    ready = [(name, d) for name, ds in ((DIGESTS if own else digests) or {}).items() for d in ds]
    rows = spark.createDataFrame(texts, "license_id string, text string").select("license_id", digest(F.col("text")).alias("known_digest"))
    return rows.unionByName(spark.createDataFrame(ready, "license_id string, known_digest string")).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest, license_id (of the whole text, or null), n_notices and notice_ids (of its lines, sorted, distinct), a row per input row."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.lower(x).rlike("licen[cs]"))
    rows = docs.select(F.col(key), digest(F.col(text)).alias("digest"), F.transform(lines, digest).alias("lines"))
    whole = rows.join(known, rows["digest"] == known["known_digest"], "left").drop("known_digest")
    own = [F.col(c).alias(f"_{k}") for k, c in enumerate([key, "digest", "license_id", "lines"])]  # what a row is known by: equal rows are one, with a count
    some = whole.filter(F.size("lines") > 0).groupBy(*own).agg(F.count("*").alias("_times"))
    line = known.select(F.col("known_digest").alias("line"), F.col("license_id").alias("notice"))
    by = [*[f"_{k}" for k in range(4)], "_times"]
    found = some.withColumn("line", F.explode("_3")).join(line, "line", "left").groupBy(*by).agg(F.count("notice").alias("n_notices"), F.array_sort(F.collect_set("notice")).alias("notice_ids"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).withColumnsRenamed({"_0": key, "_1": "digest", "_2": "license_id"})
    none = whole.filter(F.size("lines") == 0).select(key, "digest", "license_id", F.lit(0).cast("long").alias("n_notices"), F.array().cast("array<string>").alias("notice_ids"))
    return none.unionByName(found.select(*none.columns))
