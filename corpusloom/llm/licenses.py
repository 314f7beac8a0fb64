"""Licence scan by digest of the canonical form of a whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A notice of ownership: a line that opens with "copyright ... year", "(c)", the sign, or "all rights reserved".
NOTICE = r"(?m)^[^a-z0-9\n]*(?:copyright[^\n]*[0-9]{4}|copyright \(c\)|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Spellings that mean the same, as words of the canonical form.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("merchantibility", "merchantability"), ("organisation", "organization"),
    ("sub  license", "sublicense"), ("non  commercial", "noncommercial"), ("per  cent", "percent"), ("whilst", "while"), ("https", "http"),
)

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TOP = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Known texts of public licences, keyed by their usual short names.
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "ISC": _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END,
    "0BSD": _GRANT + ".\n\n" + _ISC_END,
    "BSD-2-Clause": _BSD_TOP + _BSD_END,
    "BSD-3-Clause": _BSD_TOP + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS,
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS.replace(" COPYRIGHT HOLDERS", "").replace("AUTHORS OR BE", "AUTHORS BE") + "\n\nFor more information, please refer to <https://unlicense.org>",
}
#: Digests of the canonical forms of long licences, from the files that Debian installs in /usr/share/common-licenses.
DIGESTS = {
    "Apache-2.0": "0e46a6982816aaf9a9b89623a901102ee2121356b3780699508866bf034d006c",
    "Artistic-1.0": "75d8bb51111812905babb1524051a9f53e8ad8d1a10cbc8903e4916ea402869b",
    "CC0-1.0": "5caa6b96e2c9f66e9ca02d726096312a8662a9c4fea6446ff24fee66902e58dc",
    "GFDL-1.2": "e91eb5f9d5d9856213578f733f5ae52f5692c9fc3cc1b05d048aff37a05aaeea",
    "GFDL-1.3": "5e719d42b044f5a2be4336c9e91d4860266cc46522216361f4c9ccbb621b3657",
    "GPL-1.0": "869d156f07824e4287a2959e638586941efcb3774b5e407be30ff180ac13548b",
    "GPL-2.0": "64a86f1d3531a8b5c1d2f564c01882c63b58c93fbfb517279bfaa9a261cb1796",
    "GPL-3.0": "fbf4c7854913caaf09c170805455959454d9447e36e4d6495f74d232da3fc175",
    "LGPL-2.0": "4921f4e1e5e73369d202e5c7683c965b4d275ba35f23c50d389e92705d9cc84e",
    "LGPL-2.1": "a65b75d251fb56c535ec7079440f5d167ec95725dd20f1d16677176defe487a3",
    "LGPL-3.0": "572947626844a56d29ace510237040204d4085696621f319533ca366aa897913",
    "MPL-1.1": "3e1d583b23b6d724af773ca0ceabeb4e31fc565080dfee40ad0701a48af1a915",
    "MPL-2.0": "1f9b7661552309dc69cee928f7d32ed3280cbc918bfeced108b8b7d3f68f5452",
}


def canonical(text: Column) -> Column:
    """Lower case, without notices of ownership, every run of other characters as two blanks, one spelling of each word."""
    out = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(F.lower(text), NOTICE, ""), NOT_WORD, "  "), F.lit("  "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The same in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"'  ' || regexp_replace(regexp_replace(lower({text}), {quote(NOTICE)}, '', 'g'), {quote(NOT_WORD)}, '  ', 'g') || '  '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out}, ' ')"


def digests_of(texts: DataFrame) -> DataFrame:
    """license_id and digest of a table of known texts (license_id, body); of texts that share a canonical form the first name stays."""
    return texts.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).filter("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def texts_in(spark, folder: str) -> DataFrame:
    """license_id (the file's name without its suffix) and body of the licence files in a folder."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.(txt|md)$", "")
    return spark.read.text(folder, wholetext=True).select(name.alias("license_id"), F.col("value").alias("body"))


def known_digests(spark, known: dict[str, str] = KNOWN, digests: dict[str, str] | None = None) -> DataFrame:
    """license_id and digest of the known texts, and of ``digests`` where given."""
    rows = digests_of(spark.createDataFrame(sorted(known.items()), "license_id string, body string"))
    return rows.unionByName(spark.createDataFrame(sorted(digests.items()), "license_id string, digest string")) if digests else rows


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the whole text's canonical form, license_id (null: not a known licence).

    ``known`` has license_id and digest.  A null text has a null digest and no licence; an empty text has the digest of nothing,
    which is no licence unless ``known`` says so.  Repeated rows are answered each.  A narrow projection and one equi-join
    on the digest; Spark broadcasts the known side by its measured size, and hot digests are split by adaptive execution."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(canonical(F.col(f"`{text_col}`")), 256).alias("digest"))
    return texts.join(known.select("digest", "license_id"), "digest", "left").select("doc_id", "digest", "license_id")


def scan_sql(known: dict[str, str] = KNOWN, digests: dict[str, str] | None = None) -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(known.items()))
    more = "".join(f" UNION ALL SELECT '{v}' AS digest, '{k}' AS license_id" for k, v in sorted((digests or {}).items()))
    return f"""WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({canonical_sql('body')}) AS digest FROM (VALUES {rows}) t(license_id, body)) GROUP BY digest{more}),
texts AS (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM texts LEFT JOIN known USING (digest)"""
