"""Licence scans by canonical digests.

A text is brought to a canonical form (lower case; copyright signs spelled
out; everything but letters and digits a blank; equivalent spellings made
one; copyright lines left out), and entire texts are looked up by the digest
of that form in a table of known licences: every run of consecutive
paragraphs (a single paragraph and the whole document among them) and every
line. Only runs whose length is that of a known text are looked at, so the
work grows with the paragraphs, not with their pairs. The lookup is a hash
join of digests.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvtide.llm.license_texts import KNOWN_TEXTS

# Spellings that count as the same word in licence texts.
EQUIVALENTS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"),
    ("noncommercial", "non commercial"), ("sharealike", "share alike"), ("noninfringement", "non infringement"),
    ("owner", "holder"), ("owners", "holders"), ("whilst", "while"), ("wilful", "willful"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("https", "http"),
    ("v2", "version 2"), ("v3", "version 3"),
)
SIGNS = r"©|\(c\)|&copy;"
NOT_ALPHANUMERIC = r"[^\p{L}\p{N}]+"
# A copyright line starts with the word and goes on to a year, a placeholder or a name,
# or reserves all rights; "copyright notice ..." is licence text.
COPYRIGHT_LINE = r"^((copyright )+(\d{4}|year|yyyy|by )|copyright .* all rights reserved$|all rights reserved$)"
# A first line of at most this many words is a known text's title.
TITLE_WORDS = 4
KNOWN_SCHEMA = "digest string, license_id string, length int"
# Every built-in text holds one of these (``known_rows`` checks it), and a word of a
# canonical form stands in the text itself, so a text with none of them matches nothing.
ANCHORS = ("licen", "permission", "redistribution", "software")
# Known texts are broadcast up to this many rows (about 60 bytes each).
BROADCAST_ROWS = 1_000_000
# Paragraphs whose lengths are added up at a time.
CHUNK = 64


def canonical_line(line: Column) -> Column:
    """The canonical form of one line."""
    x = F.regexp_replace(F.lower(line), SIGNS, " copyright ")
    # Two blanks between words: each keeps its own, so neighbours can both be replaced.
    x = F.concat(F.lit(" "), F.regexp_replace(x, NOT_ALPHANUMERIC, "  "), F.lit(" "))
    for variant, plain in EQUIVALENTS:
        x = F.replace(x, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {plain.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(x, " +", " "))


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, copyright lines left out, blank ones kept."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)
    return F.filter(lines, lambda x: ~x.rlike(COPYRIGHT_LINE))


def whole_of(lines: Column) -> Column:
    """The canonical form of a whole text."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def _bind(value: Column, body) -> Column:
    """``body`` applied to ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _running_sums(numbers: Column) -> Column:
    """Running sums of an array, in chunks: no step copies a long array."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    firsts = F.when(F.size(numbers) > 0, F.sequence(F.lit(1), F.size(numbers), F.lit(CHUNK))).otherwise(
        F.expr("cast(array() as array<int>)"))
    chunks = F.transform(firsts, lambda i: F.slice(numbers, i, CHUNK))
    start = F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("before"))

    def summed(cs):
        before = F.aggregate(cs, start, lambda a, c: F.struct(
            (a["sum"] + total(c)).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")))["before"]
        return F.flatten(F.zip_with(cs, before, lambda c, base: F.transform(
            c, lambda _, i: base + total(F.slice(c, F.lit(1), i + 1)))))

    return _bind(chunks, summed)


def paragraphs_of(lines: Column) -> Column:
    """Canonical paragraphs of a text, parted by blank lines; empty ones left out."""
    paragraphs = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"),
                             lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))))
    return F.filter(paragraphs, lambda x: x != "")


def units_of(lines: Column, lengths: Column) -> Column:
    """Digests of the entire texts in a text that are as long as a known one:
    runs of consecutive paragraphs, and lines.

    ``lengths``: the distinct lengths of known texts. In the paragraphs laid
    end to end, a run of that length begins where one paragraph begins and
    the place ``length`` further on is the end of another.
    """
    def runs(v):
        found = lambda n: F.transform(
            F.array_intersect(F.transform(v["starts"], lambda s: s + n + 1), v["ends"]),
            lambda e: v["whole"].substr(e - n, n))
        return F.flatten(F.transform(lengths, found))

    def placed(paragraphs):
        sizes = F.transform(paragraphs, lambda x: F.length(x) + 1)
        return _bind(F.struct(paragraphs.alias("p"), _running_sums(sizes).alias("ends")), lambda v: F.struct(
            F.zip_with(v["ends"], v["p"], lambda e, x: e - F.length(x) - 1).alias("starts"), v["ends"].alias("ends"),
            F.array_join(v["p"], " ").alias("whole")))

    texts = _bind(_bind(paragraphs_of(lines), placed), runs)
    filled = F.filter(lines, lambda x: (x != "") & F.array_contains(lengths, F.length(x)))
    return F.transform(F.array_distinct(F.concat(texts, filled)), lambda x: F.md5(x.cast("binary")))


def canonical(text: str) -> str:
    """``whole_of(canonical_lines(text))`` in Python, for known texts and tests."""
    out = []
    for line in text.split("\n"):
        x = re.sub(SIGNS, " copyright ", line.lower())
        x = " " + re.sub(r"[\W_]+", "  ", x) + " "
        for variant, plain in EQUIVALENTS:
            x = x.replace(f" {variant.replace(' ', '  ')} ", f" {plain.replace(' ', '  ')} ")
        x = re.sub(" +", " ", x).strip(" ")
        if x and not re.search(COPYRIGHT_LINE, x):
            out.append(x)
    return " ".join(out)


def known_rows(texts=KNOWN_TEXTS) -> list[tuple[str, str, int]]:
    """``(digest, license_id, length)`` of known texts, with and without a title line."""
    found = {}
    for license_id, text in texts:
        title, _, rest = text.partition("\n")
        for form in (text, rest) if rest and len(title.split()) <= TITLE_WORDS else (text,):
            plain = canonical(form)
            found.setdefault(hashlib.md5(plain.encode()).hexdigest(), (license_id, len(plain), plain))
    if texts is KNOWN_TEXTS:
        for license_id, _, plain in found.values():
            if not any(a in plain for a in ANCHORS):
                raise ValueError(f"a text of {license_id} holds none of {ANCHORS}")
    return sorted((digest, license_id, n) for digest, (license_id, n, _) in found.items())


def known_digests(texts=KNOWN_TEXTS) -> list[tuple[str, str]]:
    """``(digest, license_id)`` of known texts."""
    return [(digest, license_id) for digest, license_id, _ in known_rows(texts)]


def known_frame(spark: SparkSession, texts=KNOWN_TEXTS) -> DataFrame:
    return spark.createDataFrame(known_rows(texts), KNOWN_SCHEMA)


def known_from_files(spark: SparkSession, path: str) -> DataFrame:
    """The known table of a folder of full licence texts, one per file.

    ``license_id`` is the file's name without ``.txt`` or ``.md``; a text
    counts with and without a first line of at most four words (its title).
    Files without a letter or digit are left out; of equal texts the first
    name counts.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.(txt|md)$", "").alias("license_id"),
        F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    title, rest = F.substring_index("text", "\n", 1), F.regexp_replace("text", r"^[^\n]*\n?", "")
    titled = (F.size(F.regexp_extract_all(title, F.lit(r"(\S+)"))) <= TITLE_WORDS) & (rest != "")
    forms = F.when(titled, F.array("text", rest)).otherwise(F.array("text"))
    plain = (files.select("license_id", F.explode(forms).alias("text"))
             .select("license_id", whole_of(canonical_lines(F.col("text"))).alias("plain")).filter("plain <> ''"))
    return plain.groupBy(F.md5(F.col("plain").cast("binary")).alias("digest")).agg(
        F.min("license_id").alias("license_id"), F.first(F.length("plain")).alias("length"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  anchors=None) -> DataFrame:
    """The known licences among the entire texts of every document.

    Returns ``doc_id``, ``licenses`` (identifiers found in the document, its
    runs of consecutive paragraphs or its lines, sorted, comma-separated;
    empty if none) and ``whole_license`` (that of the whole text, else null),
    one row per input row.

    ``known``: ``digest, license_id, length`` (characters of the canonical
    form), as ``known_frame`` and ``known_from_files`` give it; its distinct
    lengths go to the driver. ``anchors``: parts of words one of which every
    known text holds, in lower case; only texts that hold one are brought to
    canonical form. The built-in table has ANCHORS; without, every text is.

    Defined cases: a null text is empty, and an empty canonical form matches
    no licence; a digest that ``known`` repeats gives each of its licences
    once; an empty ``known`` finds nothing; repeated rows and null ids are
    reported row by row; an empty table gives an empty result; other columns
    are ignored. Matches are found per distinct text, so copies add nothing
    to the join.
    """
    sizes = [r[0] for r in known.select("length").filter("length > 0").distinct().orderBy("length").collect()]
    # One text for any number of lengths, which the optimiser turns into one array literal.
    lengths = F.split(F.lit(",".join(map(str, sizes)) or "0"), ",").cast("array<int>")
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"),
                       F.md5(text.cast("binary")).alias("text_md5"))
    scanned = rows
    if anchors:
        low = F.lower("text")
        scanned = rows.filter(reduce(or_, [F.contains(low, F.lit(a)) for a in anchors]))
    lined = scanned.select("text_md5", canonical_lines(F.col("text")).alias("lines"))
    lined = lined.select("text_md5", F.md5(whole_of(F.col("lines")).cast("binary")).alias("whole_md5"),
                         units_of(F.col("lines"), lengths).alias("units"))
    # explode would make the optimiser filter on the number of units, computing them a second
    # time for that; explode_outer does not, and its null digests join nothing.
    hits = (lined.select("text_md5", "whole_md5", F.explode_outer("units").alias("digest"))
            .join(known, "digest")
            .groupBy("text_md5").agg(
                F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"),
                F.max(F.when(F.col("digest") == F.col("whole_md5"), F.col("license_id"))).alias("whole_license")))
    return (rows.select("doc_id", "text_md5").join(hits, "text_md5", "left")
            .select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), "whole_license"))


def oracle_sql() -> str:
    """The scan of ``documents`` against the built-in texts, in DuckDB SQL."""
    x = f"regexp_replace(lower(line), '{SIGNS}', ' copyright ', 'g')"
    x = f"' ' || regexp_replace({x}, '{NOT_ALPHANUMERIC}', '  ', 'g') || ' '"
    for variant, plain in EQUIVALENTS:
        x = f"replace({x}, ' {variant.replace(' ', '  ')} ', ' {plain.replace(' ', '  ')} ')"
    x = f"trim(regexp_replace({x}, ' +', ' ', 'g'))"
    known = ", ".join(f"('{d}', '{i}', {n})" for d, i, n in known_rows())
    return f"""
        with known(digest, license_id, n) as (values {known}),
        lined as (
            select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda line: {x}),
                                       lambda l: not regexp_matches(l, '{COPYRIGHT_LINE}')) as lines
            from documents),
        unit as (
            select doc_id, list_filter(lines, lambda l: l <> '') as filled, array_to_string(lines, chr(10)) as joined
            from lined),
        texts as (
            select doc_id, array_to_string(filled, ' ') as whole, filled,
                   list_filter(list_transform(string_split_regex(joined, '\\n\\n+'),
                                              lambda p: trim(replace(p, chr(10), ' '))), lambda p: p <> '') as paras
            from unit),
        paras as (
            select doc_id, whole, through - length(p) - 1 as first, through
            from (select doc_id, whole, p, sum(length(p) + 1) over (partition by doc_id order by i) as through
                  from (select doc_id, whole, unnest(paras) as p, generate_subscripts(paras, 1) as i from texts))),
        runs as (
            select a.doc_id, a.whole, substring(a.whole, cast(a.first + 1 as bigint), z.n) as u
            from paras a cross join (select distinct n from known) z
            join paras b on b.doc_id = a.doc_id and b.through = a.first + z.n + 1),
        hits as (
            select doc_id, whole, license_id, u
            from (select doc_id, whole, u from runs union select doc_id, whole, unnest(filled) from texts)
            join known on md5(u) = digest)
        select t.doc_id, coalesce(string_agg(distinct license_id, ',' order by license_id), '') as licenses,
               max(case when u = h.whole then license_id end) as whole_license
        from texts t left join hits h on t.doc_id = h.doc_id group by t.doc_id"""
