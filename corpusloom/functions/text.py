"""Text expressions: all are built-in Spark functions, so they stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\x09-\x0D\x20]"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}]+"
#: Function words that a lexical query does without.
STOP_WORDS = tuple(
    "your you would with will why who which where when what were we was very up too to this they these their the that than such some so "
    "should she shall over out our other or only on of not no might more may just its it is into in i how his her he have has had from for "
    "each does do did could can by but both being been be at as are any and an all after about a".split()
)
#: What a company's name carries besides the name.
COMPANY_WORDS = ("co", "company", "corp", "corporation", "group", "holding", "holdings", "inc", "incorporated", "limited", "llc", "ltd", "plc")


def _accents() -> tuple[str, str]:
    pairs = {}
    for cp in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0].isascii() and chr(cp) == chr(cp).lower():
            pairs[chr(cp)] = parts[0].lower()
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def fold(c: Column) -> Column:
    """Lower case without diacritics of the Latin letters."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def words(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def token_count(c: Column) -> Column:
    """The default token counter; white space is never a token, so counts of parts add up to the count of their join."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))), F.lit(0))


def compact_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: strip(x) != ""), "\n")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def slug_tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(slug(c), "_")))


def dedup_key(slugged: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(slugged, "_"))), "_")


def long_enough(slugged: Column) -> Column:
    return (F.length(slugged) >= 4) & ~slugged.rlike("^[0-9_]*$")


def is_own_name(phrase: Column, title: Column) -> Column:
    """Is the phrase nothing but the title's words, company words aside?  False without a title."""
    company = F.array(*[F.lit(w) for w in COMPANY_WORDS])
    rest = F.array_except(F.split(slug(phrase), "_"), company)
    return F.coalesce((F.size(rest) > 0) & (F.size(F.array_except(rest, F.split(slug(title), "_"))) == 0) & (F.length(title) > 0), F.lit(False))


def is_noise(c: Column) -> Column:
    """Dot leaders, blanks, and spans of which less than half is letters."""
    solid = F.regexp_replace(c, r"\s", "")
    return c.rlike(r"(?:\.\s?){4,}") | (F.length(solid) == 0) | (F.regexp_count(c, F.lit(r"\p{L}")) * 2 < F.length(solid))


def sentences(c: Column) -> Column:
    """Lines, then table cells, then sentence ends; trimmed, noise dropped."""
    parts = F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), r"[\n\r|\u0001]")
    return F.filter(F.transform(parts, strip), lambda x: (x != "") & ~is_noise(x))


def sentence_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0)))


def overlap_similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, shared / (F.ln(F.size(a) + 1) + F.ln(F.size(b) + 1) + 1e-9)).otherwise(0.0)


def query_terms(c: Column) -> Column:
    """Words of a query without function words; all of them if nothing else is left."""
    every = F.filter(F.split(F.regexp_replace(c, r"[^a-zA-Z0-9\-\s]", " "), r"\s+"), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    rest = F.filter(every, lambda w: ~F.array_contains(stop, F.lower(w)))
    return F.when(F.size(rest) > 0, rest).otherwise(every)


def all_terms(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"[^a-zA-Z0-9\-\s]", " "), r"\s+"), lambda w: w != "")


def raw_terms(c: Column) -> Column:
    """Terms of the plain baselines: quotes go, white space splits."""
    return F.filter(F.split(F.replace(c, F.lit('"'), F.lit(" ")), r"\s+"), lambda w: w != "")


def links(c: Column) -> Column:
    """Raw targets of inline, reference-style and wiki links, in this order."""
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"\[[^\]]*\]\(([^)#?\s]+)[^)]*\)", r"(?m)^[ \t]*\[[^\]]+\]:[ \t]*(\S+)", r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]")]
    return F.concat(*found)


def is_external(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def base_name(c: Column) -> Column:
    clean = F.regexp_replace(c, r"[#?].*$", "")
    return F.trim(F.element_at(F.split(clean, "/"), -1))


def human_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", ""), "_", " ")


FILE_TYPES = {"md": "markdown", "txt": "txt", "csv": "csv", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "html": "html", "htm": "html"}


def file_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("other"))


def squeeze(c: Column, most: int = 40) -> Column:
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def readable_title(path: Column, section_path: Column, first_row: Column, last_row: Column) -> Column:
    """File name, the last two sections, rows."""
    tail = F.when(F.size(section_path) > 1, F.slice(section_path, -2, 2)).otherwise(section_path)
    rows = F.when(first_row.isNotNull(), F.concat(F.lit("rows "), first_row.cast("string"), F.lit("-"), last_row.cast("string")))
    return F.concat_ws(" > ", F.element_at(F.split(path, "/"), -1), F.array_join(tail, " > "), rows) if rows is not None else path


def citation(path: Column, page: Column, first_row: Column, last_row: Column, section: Column) -> Column:
    """Source, page, rows and section, as far as they are given."""
    return F.concat_ws(
        ", ", path, F.when(page > 0, F.concat(F.lit("page "), page.cast("string"))), F.when(first_row.isNotNull(), F.concat(F.lit("rows "), first_row.cast("string"), F.lit("-"), last_row.cast("string"))), F.when(F.length(section) > 0, section)
    )


#: Invisible characters that can carry text past a reader.  Isolates (2066-2069) are legitimate in mixed-direction text.
HIDDEN = {"tag": "[\\x{E0000}-\\x{E007F}]", "zero_width": "[\\x{200B}-\\x{200D}\\x{FEFF}]", "deprecated_format": "[\\x{206A}-\\x{206F}]", "bidi_override": "[\\x{202A}-\\x{202E}]"}


def hidden_counts(c: Column) -> dict[str, Column]:
    return {name: F.regexp_count(c, F.lit(p)) for name, p in HIDDEN.items()}


def cost(tokens: Column, per_million: float = 0.25) -> Column:
    return tokens / 1e6 * per_million
