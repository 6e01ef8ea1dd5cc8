"""Licence scan by sentence rules.

The text is normalised with its boundaries kept: sentence ends and blank lines are hard, line ends and ';' are soft. A known licence
sentence is found where it stands between two boundaries of either kind; inside it a soft boundary is a space, so sentences wrapped over
lines (also behind comment signs) are found like single-line notices. The identifiers found, in the order of the text, are matched against ordered
rules. A rule is one or more sequences of identifiers; unknown sentences between two known ones break a sequence of several. The
longest sequences come first and consume what they match, so a text can carry several licences.

Only texts that hold a word of the known sentences' vocabulary are looked at. The table of sentences is a
fixed parameter of some dozen rows.

Defined cases: null and empty texts have no licence and no row; a row that repeats gives a row again; very long texts are scanned
whole; list marks ('1.', 'a)') and lines without letters are no sentences; known sentences that no rule uses are reported as ``unmatched``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import columns

_GPL = "* is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
#: Sentence: identifier. Fixed values, the wording of well-known licences and of short references to them; '*' stands for one to eight words.
SENTENCES = {
    "Licensed under CC BY-NC 4.0": "CCBYNC4",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CCBYNC4",
    "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License": "CCBYNC4",
    "Licensed under CC BY 4.0": "CCBY4",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "CCBY4",
    "This work is licensed under the Creative Commons Attribution 4.0 International License": "CCBY4",
    "Licensed under CC BY-SA 4.0": "CCBYSA4",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CCBYSA4",
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License": "CCBYSA4",
    "This work is licensed under the GNU General Public License, version 3": "GPL3",
    "This work is licensed under the GNU General Public License, version 2": "GPL2",
    f"{_GPL}, either version 3 of the License, or (at your option) any later version": "GPL3",
    f"{_GPL}, version 3 of the License": "GPL3",
    f"{_GPL}, either version 2 of the License, or (at your option) any later version": "GPL2",
    f"{_GPL}; version 2 of the License": "GPL2",
    "* is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "GPLHOPE",
    "See the GNU General Public License for more details": "GPLSEE",
    "You should have received a copy of the GNU General Public License along with *": "GPLCOPY",
    "If not, see <https://www.gnu.org/licenses/>": "GPLWHERE",
    "If not, see <http://www.gnu.org/licenses/>": "GPLWHERE",
    "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA": "GPLWHERE",
    "if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA": "GPLWHERE",
    "Licensed under the Apache License, Version 2.0": "APACHE2",
    'Licensed under the Apache License, Version 2.0 (the "License")': "APACHE2",
    "you may not use this file except in compliance with the License": "APACHEUSE",
    "You may obtain a copy of the License at": "APACHECOPY",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "APACHECOPYURL",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0": "APACHECOPYURL",
    "http://www.apache.org/licenses/LICENSE-2.0": "APACHEURL",
    "https://www.apache.org/licenses/LICENSE-2.0": "APACHEURL",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied': "APACHEASIS",
    "See the License for the specific language governing permissions and limitations under the License": "APACHESEE",
    "Released under the MIT License": "MITREF",
    "Released under the BSD License": "BSDREF",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "MITGRANT",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions': "MITGRANT",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "MITNOTICE",
    "The software is provided as is, without warranty of any kind": "MITASIS",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT': "MITASIS",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE": "MITLIABLE",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDGRANT",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDSOURCE",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer": "BSDBINARY",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDBINARY",
    "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDNAME",
    'THIS SOFTWARE IS PROVIDED BY * "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED': "BSDASIS",
    "IN NO EVENT SHALL * BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE": "BSDLIABLE",
    "All rights reserved": "RESERVED",
}
_NOTICE = ("GPLHOPE", "GPLSEE", "GPLCOPY", "GPLWHERE")
#: Licence: sequences of identifiers. Fixed values.
RULES = {
    "MIT": (("MITGRANT", "MITNOTICE", "MITASIS", "MITLIABLE"), ("MITGRANT", "MITNOTICE", "MITASIS")),
    "BSD-2-Clause": (("BSDGRANT", "BSDSOURCE", "BSDBINARY", "BSDASIS", "BSDLIABLE"), ("BSDGRANT", "BSDSOURCE", "BSDBINARY"), ("BSDSOURCE", "BSDBINARY")),
    "BSD-3-Clause": (("BSDGRANT", "BSDSOURCE", "BSDBINARY", "BSDNAME", "BSDASIS", "BSDLIABLE"), ("BSDGRANT", "BSDSOURCE", "BSDBINARY", "BSDNAME"), ("BSDSOURCE", "BSDBINARY", "BSDNAME")),
    "CC-BY-NC-4.0": (("CCBYNC4",),),
    "CC-BY-4.0": (("CCBY4",),),
    "CC-BY-SA-4.0": (("CCBYSA4",),),
    "GPL-3.0": tuple(("GPL3", *_NOTICE[:n]) for n in (4, 3, 2, 0)),
    "GPL-2.0": tuple(("GPL2", *_NOTICE[:n]) for n in (4, 3, 2, 0)),
    "Apache-2.0": (
        ("APACHE2", "APACHEUSE", "APACHECOPY", "APACHEURL", "APACHEASIS", "APACHESEE"), ("APACHE2", "APACHEUSE", "APACHECOPYURL", "APACHEASIS", "APACHESEE"), ("APACHE2",),
    ),
    "MIT-reference": (("MITREF",),),
    "BSD-reference": (("BSDREF",),),
}
_GAP = r"[\s*#/]+"
HINT = "(?i)" + "|".join(
    p.replace(" ", _GAP)
    for p in ("licen[sc]ed", r"licenses?\b", "permission is", "copyright notice", "provided .?as is", "provided by", "redistributions?", "rights reserved", "in no event", "free software", "in the hope that")
)
_QUOTES = "[\"'“”‘’]"
#: Applied in this order to lower-case text without quotes; a form feed is a hard boundary, a line feed a soft one.
_STEPS = (
    (r"(?m)^([ \t*#/-]*)\(?(?:\d{1,2}|[a-z])[.)][ \t]+", "$1"),
    (r"[.!?]+[)\]>]*(?=\s|$)", "\f"),
    (r";[ \t]*(?:\r\n?|\n)?|\r\n?", "\n"),
    (r"[^\p{L}\p{N}.\n\f]+", " "),
    (r"\.(?!\p{N})|(?<!\p{N})\.", " "),
    (r" *\n *", "\n"),
    (r"[ \n]*\f[ \n\f]*|\n{2,}", "\f"),
    (r" {2,}", " "),
)


def normalised(text: Column) -> Column:
    """Lower-case words and numbers, one space between two, with the boundaries of sentences and lines."""
    out = F.regexp_replace(F.lower(text), _QUOTES, "")
    for pattern, to in _STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return F.concat(F.lit("\f"), F.regexp_replace(out, "^[ \n\f]+|[ \n\f]+$", ""), F.lit("\f"))


def _pattern(sentence: str) -> str:
    plain = re.sub(_QUOTES, "", sentence.lower())
    words = re.sub(r"\.(?!\d)|(?<!\d)\.|[^\w.*]+", " ", plain).split()
    return r"[ \n]".join(r"[^ \n\f]+(?:[ \n][^ \n\f]+){0,7}?" if w == "*" else re.escape(w) for w in words)


def licence_ids(docs: DataFrame) -> DataFrame:
    """doc_id and ``ids``: the known identifiers and '-' for what stands between them, joined by spaces."""
    found = normalised(F.col("text"))
    # longest first, so that a line end inside a sentence does not leave a shorter one; '#' is in no normalised text
    for sentence in sorted(SENTENCES, key=lambda s: -len(s)):
        found = F.regexp_replace(found, F.lit(f"(?<=[\\n\\f]){_pattern(sentence)}(?=[\\n\\f])"), F.lit(f"#{SENTENCES[sentence]}"))
    pieces = F.filter(F.split(found, "[\n\f]+"), lambda s: ~s.rlike(r"^(?:|\p{N}{1,2}|[a-z])$"))
    pieces = F.transform(pieces, lambda s: F.when(s.startswith("#"), F.substr(s, F.lit(2))).otherwise("-"))
    hinted = columns(docs, "doc_id", "text").where(F.col("text").rlike(HINT))
    line = F.regexp_replace(F.concat(F.lit(" "), F.array_join(pieces, " "), F.lit(" ")), r"(?: -)+ ", " - ")
    return hinted.select("doc_id", line.alias("ids")).where(F.col("ids").rlike("[A-Z]"))


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (array, in the order of RULES), matches (their number), unmatched (identifiers that no rule consumed)."""
    got = licence_ids(docs).withColumn("counts", F.array())
    rest, columns_ = F.col("ids"), dict.fromkeys(RULES, F.lit(0))
    for name, sequence in sorted(((n, q) for n in RULES for q in RULES[n]), key=lambda x: -len(x[1])):
        pattern = "(?<= )" + " ".join(sequence) + "(?= )"
        columns_[name] = columns_[name] + F.regexp_count(rest, F.lit(pattern))
        rest = F.regexp_replace(rest, pattern, "-")
    hits = F.array(*[F.struct(F.lit(n).alias("licence"), columns_[n].alias("n")) for n in RULES])
    hits = F.filter(hits, lambda h: h["n"] > 0)
    return got.select(
        "doc_id",
        F.transform(hits, lambda h: h["licence"]).alias("licences"),
        F.aggregate(hits, F.lit(0), lambda a, h: a + h["n"]).cast("long").alias("matches"),
        F.array_join(F.filter(F.split(F.trim(rest), " "), lambda x: x.rlike("[A-Z]")), " ").alias("unmatched"),
    )
