"""Licence scans by canonical digests, in built-in functions only.

Method. A text is made canonical: ASCII lower case, copyright lines left out, punctuation blanked, equivalent spellings
made one, white space collapsed. The SHA-256 of the whole canonical text is joined to those of known licence texts: short
ones are here as texts and go through the same expression, long ones as their digests, and a table of further texts may
be given. The constants may be broadcast, a given table is joined as its size asks for. Licence statements of one
sentence are looked up by digest for each line, since that is where they stand alone.

Defined cases: null text is empty; an empty canonical text matches nothing. Repeated rows and null ids get rows like
others, and an empty table gives an empty one. A text that several ids are known by (only where a table is given) has the
least of them. A very long text is one value of its row, as in any expression. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and statements as published.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"]}
STATEMENTS = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "Released under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "Released under CC BY-SA 4.0."],
}
# Canonical digests of licences as published, whole and without what follows their terms.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"],
    "Artistic-1.0-Perl": ["e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "CC-BY-SA-4.0": ["4dd2d8faa991a43111f73718974d1a9133ba1453cd76d174da75d163e35fa974", "8721697c8796e3ca83d1366740f03e7fa90872bdcb2e655f1a517076e6f35f6d"],
    "GFDL-1.2": ["94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"],
    "GFDL-1.3": ["a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"],
    "GPL-1.0": ["ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"],
    "GPL-2.0": ["331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88", "4727d78b5ad02fa15169ba8c7c27fbe69d5180e9d08aa9e2b6cf6f99b3eb97de", "4005f8f040a757bea42817c94ba8b813517beb0cae30a5eb43ae82e76d91a81a", "170a20f822f4b6582bc5aa7fb89056a62ff92891161df3b323edb8d6f3c753e9"],
    "GPL-3.0": ["eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"],
    "LGPL-2.0": ["61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"],
    "MPL-2.0": ["f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"],
    "NCSA": ["bb6c44416437f5ab412ca9d762d4bdae1dc4e6a9c5afc9ac0965eb5e57b4e055"],
    "OFL-1.1": ["a4915a2dcd67c648b73ad8364858cba28bbfb700e62ca5847e2c30544066e01a"],
    "Unicode-3.0": ["53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8"],
    "GCC-exception-3.1": ["9bce034e324d85802308158ead50159b25a080055c75973cdd78a4b8eabfa8d4"],
    "LLVM-exception": ["3158d7f530df4a18514bfffd613285c6e66e314351bea4b9ba3f7edfa52087de"],
}
# Spellings that count as one, as whole words between blanks.
LICENCES = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencee": "licensee", "licencees": "licensees", "sublicence": "sublicense", "sublicences": "sublicenses", "sublicenced": "sublicensed", "sublicencee": "sublicensee", "sublicencees": "sublicensees"}
SPELLINGS = {"acknowledgement": "acknowledgment", "merchantibility": "merchantability", "favour": "favor", "honour": "honor", "organisation": "organization", "authorised": "authorized", "fulfil": "fulfill", "noncommercial": "non commercial", "https": "http"}
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names a copyright: its mark, or the word with a mark or year (or the place for one) after it.
_COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|[\[{<](yyyy|year)[\]}>])|\(c\)|©)[^\n]*"
#: The same for a text with a (b): there a (c) alone is the next letter of a list.
_LISTED = _COPYRIGHT.replace(r"|\(c\)|©)[^", "|©)[^")
_BLANK = r"[^a-z0-9\n\x{A0}-\x{10FFFF}]|[\x{A0}\x{2010}-\x{2027}]"


def canonical_lines(text: Column) -> Column:
    """The canonical text, line by line; each line has a blank on both sides."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWERED)
    t = F.when(F.contains(t, F.lit("(b)")), F.regexp_replace(t, _LISTED, "$1")).otherwise(F.regexp_replace(t, _COPYRIGHT, "$1"))
    t = F.regexp_replace(t, _BLANK, " ")
    t = F.regexp_replace(F.concat(F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" \n ")), F.lit(" ")), " {2,}", " ")
    spelt = t
    for a, b in LICENCES.items():
        spelt = F.replace(spelt, F.lit(f" {a} "), F.lit(f" {b} "))
    t = F.when(F.contains(t, F.lit("licenc")), spelt).otherwise(t)
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return t


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), r"[ \n]+", " "))


def known_texts() -> list[tuple[str, str]]:
    """Every known whole text with its id: texts with and without their titles, and statements."""
    titled = [(k, f"{title}\n\n{TEXTS[k]}") for k, titles in TITLES.items() for title in titles]
    return [*TEXTS.items(), *titled, *((k, t) for k, ts in STATEMENTS.items() for t in ts)]


def known(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the known whole texts, statements among them; a constant of this module."""
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("t")) for k, t in known_texts()]))
    digests = F.inline(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(d).alias("digest")) for k, ds in DIGESTS.items() for d in ds]))
    one = spark.range(1)
    return one.select(rows).select("license_id", F.sha2(canonical(F.col("t")), 256).alias("digest")).unionByName(one.select(digests)).distinct()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest of the canonical text, license_id of the whole text, statements in it.

    license_id is null where the text as a whole is no known licence; statements are ids, sorted and comma-joined.
    more: (license_id, text) of further whole texts.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    digest = F.sha2(F.trim(F.regexp_replace("lines", r"[ \n]+", " ")), 256)
    said = F.create_map(*[x for k, ts in STATEMENTS.items() for t in ts for x in (F.sha2(F.trim(canonical_lines(F.lit(t))), 256), F.lit(k))])
    # a line can only be a statement if it holds a word that all statements hold
    lines = F.filter(F.split("lines", "\n"), lambda x: F.contains(x, F.lit(" license ")) | F.contains(x, F.lit(" licensed ")) | F.contains(x, F.lit(" released ")))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(said, F.sha2(F.trim(x), 256))), lambda x: x.isNotNull())
    held = own.select("doc_id", digest.alias("digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("statements"))
    texts = F.broadcast(known(docs.sparkSession))
    if more is not None:
        given = more.select("license_id", F.sha2(canonical(F.col("text").cast("string")), 256).alias("digest")).where(F.col("digest") != F.sha2(F.lit(""), 256))
        texts = known(docs.sparkSession).unionByName(given).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return held.join(texts, "digest", "left").select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", "statements")


def scan_sql(table: str = "documents") -> str:
    """The same scan in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(x: str) -> str:
        t = f"translate(coalesce({x}, ''), '{_UPPER}', '{_LOWERED}')"
        t = rf"CASE WHEN contains({t}, '(b)') THEN regexp_replace({t}, {quote(_LISTED)}, '\1', 'g') ELSE regexp_replace({t}, {quote(_COPYRIGHT)}, '\1', 'g') END"
        t = f"regexp_replace({t}, {quote(_BLANK)}, ' ', 'g')"
        t = f"regexp_replace(' ' || replace({t}, chr(10), ' ' || chr(10) || ' ') || ' ', ' {{2,}}', ' ', 'g')"
        for a, b in (LICENCES | SPELLINGS).items():
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return t

    whole = lambda x: f"sha256(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')))"
    texts = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in known_texts())
    digests = ", ".join(f"({quote(k)}, {quote(d)})" for k, ds in DIGESTS.items() for d in ds)
    said = ", ".join(f"({quote(k)}, {quote(t)})" for k, ts in STATEMENTS.items() for t in ts)
    return f"""
WITH known AS (SELECT DISTINCT id, {whole(lines("t"))} AS digest FROM (VALUES {texts}) AS v(id, t) UNION SELECT * FROM (VALUES {digests}) AS w(id, digest)),
said AS (SELECT id, trim({lines("t")}) AS line FROM (VALUES {said}) AS v(id, t)),
own AS (SELECT doc_id, {lines("text")} AS lines FROM {table}),
hits AS (SELECT o.doc_id, string_agg(DISTINCT s.id, ',' ORDER BY s.id) AS statements
         FROM (SELECT doc_id, trim(unnest(string_split(lines, chr(10)))) AS line FROM own) o JOIN said s USING (line) GROUP BY 1)
SELECT o.doc_id, {whole("o.lines")} AS canonical_sha256, k.id AS license_id, coalesce(h.statements, '') AS statements
FROM own o LEFT JOIN known k ON k.digest = {whole("o.lines")} LEFT JOIN hits h ON h.doc_id = o.doc_id
"""
