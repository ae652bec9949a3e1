"""License scan by canonical digest lookup (operator 2), in DataFrame operations only.

A text and every known licence are brought to the same canonical form (case, copyright
lines, equivalent spellings, punctuation and white space), and the SHA-256 digests of the
whole canonical texts are joined.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, in the order in which they are replaced, after
# punctuation has become blanks.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"),
    ("merchantibility", "merchantability"),
    ("http ", "https "),
)

# The texts of public licences and the notices that name one.  More whole licences
# are in the folder ``licenses`` beside this file, each named by its id.
LICENSES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any "
        "source distribution.",
    ),
)

# Title lines with which files of a licence begin.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause Simplified License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause New or Revised License", "New BSD License", "Modified BSD License", "BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License"),
}


#: A copyright notice is a line that begins with "©", or with "copyright" or "(c)" and goes on with a sign,
#: a place for a name or "by", or has a year; a sentence that is wrapped before the word is none.
#: Rules (pattern, replacement) are applied in order after lower-casing; both engines read them alike.
RULES = (
    (r"(^|\n)[ \t]*(©|(copyright|\(c\))(([ \t:]*(copyright[ \t]*)?(\(c\)|©|<|\[|\{|by |yyyy))|[^\n]*[12][0-9][0-9][0-9]))[^\n]*", "\n"),
    (r"(^|\n)[ \t]*all rights reserved[^\n]*", "\n"),
)
#: What counts as punctuation or white space, but for line ends.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’©]+"


def _replacements() -> list[tuple[str, str]]:
    """``SPELLINGS``, and those of two words with a line end between them, which stays."""
    out = []
    for a, b in SPELLINGS:
        out.append((a, b))
        if " " in a.strip():
            first, second = a.split()
            out.append((f"{first}\n{second}", b.replace(" ", "\n") if " " in b else f"{b}\n"))
    return out


def canonical_lines(text: Column) -> Column:
    """Canonical form of a text in which line ends still stand; null stays null."""
    c = F.lower(text)
    for pattern, to in RULES:
        c = F.regexp_replace(c, pattern, to)
    c = F.regexp_replace(c, MARKS, " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    for a, b in _replacements():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def one_line(canonical: Column) -> Column:
    """Canonical form of the whole text."""
    return F.trim(F.regexp_replace(canonical, r"[\n ]+", " "))


def _bodies(name: str, text: str) -> list[str]:
    """Forms in which the whole text of a licence is in use, without titles."""
    out = [text]
    if name == "ISC":
        out.append(text.replace("and/or distribute", "and distribute"))
    if name.startswith("BSD"):  # the clauses as a list without numbers
        out.append(re.sub(r"(?m)^ *\d\. ", "", text))
    if "END OF TERMS AND CONDITIONS" in text:  # without the appendix, and without that line, too
        terms = text[: text.index("END OF TERMS AND CONDITIONS")]
        out += [terms, f"{terms}END OF TERMS AND CONDITIONS"]
    return out


def license_texts() -> list[tuple[str, str]]:
    """(id, text) of all known licences and notices, in each form."""
    whole = [x for x in LICENSES if not x[0].endswith("-notice")]
    isc = dict(whole)["ISC"]
    whole.append(("0BSD", re.sub(r", provided that [^.]*\.", ".", isc)))
    for file in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        whole.append((file.name.removesuffix(".txt"), file.read_text("utf-8")))
    out = list(LICENSES)
    for name, text in whole:
        for body in _bodies(name, text):
            out += [(name, body), *[(name, f"{title}\n\n{body}") for title in TITLES.get(name, ())]]
    return list(dict.fromkeys(out))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(license_texts(), "license_id string, license_text string")


def license_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id), one row per digest; of licences with one canonical text the least id."""
    text = one_line(canonical_lines(F.col("license_text")))
    d = licenses.select("license_id", text.alias("text")).where("text != ''")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, digest, license_id, n_notices, notices).

    ``digest`` is of the whole canonical text and ``license_id`` the licence with that digest,
    or null.  Each line is looked up as a whole text, too: ``n_notices`` counts the lines that
    are a licence or notice and ``notices`` has their ids, sorted, distinct, joined by commas
    (null if none).  Null text counts as empty, which matches nothing.  Null ids and repeated
    rows pass through; other columns of the input are ignored.
    The licence side is a table of licences, not of documents; Spark broadcasts it while it is
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond.
    """
    licenses = known_licenses(docs.sparkSession) if licenses is None else licenses
    known = license_digests(licenses)
    base = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("sha"), canonical_lines(F.coalesce(text_col, F.lit(""))).alias("text"))
    # the digest of the text is made before its lines are rows, else it would be made for each line
    base = base.select("doc_id", "sha", F.sha2(one_line(F.col("text")), 256).alias("digest"), F.split("text", "\n", -1).alias("all"))
    lines = base.select("doc_id", "sha", "digest", F.posexplode("all").alias("at", "line"))
    lines = lines.select("doc_id", "sha", "digest", "at", F.sha2(F.trim("line"), 256).alias("line_digest"))
    lines = lines.join(known.select(F.col("digest").alias("line_digest"), F.col("license_id").alias("notice")), "line_digest", "left")
    lines = lines.where("at = 0 or notice is not null")
    texts = lines.groupBy("doc_id", "sha", "digest").agg(F.count_if(F.col("at") == 0).alias("rows"), F.count("notice").alias("n"), F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"))
    out = texts.join(known, "digest", "left").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("doc_id", "digest", "license_id", (F.col("n") / F.col("rows")).cast("long").alias("n_notices"), F.when(F.col("n") > 0, F.col("notices")).alias("notices"))


def canonical(text: str) -> str:
    """The canonical form in plain Python, for the SQL."""
    c = text.lower()
    for pattern, to in RULES:
        c = re.sub(pattern, to, c)
    c = re.sub(" ?\n ?", "\n", re.sub(MARKS, " ", c))
    for a, b in _replacements():
        c = c.replace(a, b)
    return re.sub("[\n ]+", " ", c).strip(" ")


def oracle_sql() -> str:
    """The scan in SQL; the digests of the known licences are in it as values, worked out without Spark."""
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def canon(c: str) -> str:
        c = f"lower({c})"
        for pattern, to in RULES:
            c = f"regexp_replace({c}, '{pattern}', {quote(to)}, 'g')"
        c = f"regexp_replace(regexp_replace({c}, '{MARKS}', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
        for a, b in _replacements():
            c = f"replace({c}, {quote(a)}, {quote(b)})"
        return f"trim(regexp_replace({c}, '[\\n ]+', ' ', 'g'))"

    known: dict[str, str] = {}
    for name, text in license_texts():
        digest = hashlib.sha256(canonical(text).encode()).hexdigest()
        known[digest] = min(name, known.get(digest, name))
    rows = ", ".join(f"('{d}', {quote(i)})" for d, i in sorted(known.items()))
    return f"""
WITH known AS (SELECT * FROM (VALUES {rows}) v(digest, license_id)),
base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
          FROM lines JOIN known ON sha256({canon("line")}) = digest GROUP BY 1)
SELECT b.doc_id, b.digest, k.license_id, coalesce(f.n, 0) AS n_notices, f.notices
FROM (SELECT doc_id, sha256({canon("text")}) AS digest FROM base) b
LEFT JOIN known k USING (digest) LEFT JOIN found f USING (doc_id)"""
