"""Texts that are, as a whole, a known licence: canonical form, digest, hash join.

The canonical form drops what does not change a licence: case, a heading, copyright lines, list marks, spelling variants,
punctuation and white space. Its SHA-256 joins the digests of the known licences, a table of a few rows that the caller
may replace by any other; the texts themselves are compared nowhere. ``STEPS`` lists the replacements once, for the
DataFrame and for the SQL form.

Results for odd input: a null text is an empty one; empty texts have the digest of the empty text and are no licence.
Known licences of equal canonical form count under the smallest name. Null and repeated ids are rows like any other. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement) in order, on lower-cased text. Java's and RE2's meaning is the same.
STEPS = [
    (r"\r\n?", "\n"),
    (r"^\s*[^\n]{0,60}licen[cs]e[^\n]{0,30}\n", ""),  # a heading
    (r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<|\[)|\(c\)[ \t]|©)[^\n]*$", ""),
    (r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", ""),
    (r"(?m)^[ \t]*(?:[0-9]{1,2}[.)]|[-*•]|\([a-z0-9]\))[ \t]+", ""),
    (r"[^\p{L}\p{N}]+", " "),
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non infring", "noninfring"),
    ("isation", "ization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("http ", "https "),
]

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
   disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
# The published texts of common licences, the long ones from the files of ``licence_texts``.
LONG = ["Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0"]
KNOWN = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _NO_WARRANTY,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_NAMES + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _NO_WARRANTY,
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

"""
    + _AS_IS,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
   you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
   required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
}
KNOWN |= {name: pkgutil.get_data(__package__, f"licence_texts/{name}").decode() for name in LONG}


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new) if not pattern.isascii() or any(c in pattern for c in "\\[(") else F.replace(out, F.lit(pattern), F.lit(new))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"lower(coalesce({text}, ''))"
    for pattern, new in STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"trim({out})"


def matched(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license) of every row; ``known`` has (name, text), few rows."""
    digests = known.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "name").where(canonical(F.col("text")) != "").groupBy("digest").agg(F.min("name").alias("license"))
    return docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(digests, "digest", "left").select("doc_id", "digest", "license")


def matched_sql() -> str:
    """SQL of ``matched`` over the table documents with the licences of ``KNOWN``."""
    rows = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in KNOWN.items())
    return f"""
    with known(name, body) as (values {rows}),
    digests as (select sha256({canonical_sql("body")}) as digest, min(name) as license from known group by 1)
    select d.doc_id, d.digest, k.license
    from (select doc_id, sha256({canonical_sql("text")}) as digest from documents) d left join digests k using (digest)
    """
