"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the lexical ranker leaves out.
STOPWORDS = (
    "a an and are as at be been but by for from has have how in into is it its of on or that the their there these this to was were what when which who why will with "
    "study studies patient patients effect effects result results conclusion conclusions background methods objective purpose using used use based"
).split()
#: A token, and a DOI.
TOKEN = r"[a-z0-9][a-z0-9\-]{1,}"
DOI = r"(?i)10\.\d{4,9}/[^\s?#]+"
#: A token that isn't digits alone: these are told by the pattern, not by a second one for each token.
WORD = rf"(?![0-9]++(?![a-z0-9\-])){TOKEN}"
#: A title key must have this many characters to be an identity.
MIN_TITLE = 15


def tokenize(text: Column) -> Column:
    """Lower-case tokens without stopwords and bare numbers; hyphens stay inside."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def extract_doi(url: Column) -> Column:
    """The bare DOI in lower case, or null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), DOI, 0)
    return F.nullif(F.lower(F.regexp_replace(found, r"[).]+$", "")), F.lit(""))


def normalize_title(title: Column) -> Column:
    words = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def url_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "/+$", ""))


def identity_key(url: Column, title: Column) -> Column:
    """The preferred identity: DOI, else a title of at least 15 characters, else the url; '' without any."""
    name = normalize_title(title)
    return F.coalesce(
        F.concat(F.lit("doi:"), extract_doi(url)), F.when(F.length(name) >= MIN_TITLE, F.concat(F.lit("title:"), name)), F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), url_key(url))), F.lit("")
    )


def identity_keys(url: Column, title: Column) -> Column:
    """All identities a record can match on; without DOI and title the url."""
    name = normalize_title(title)
    both = F.array_compact(F.array(F.concat(F.lit("doi:"), extract_doi(url)), F.when(F.length(name) >= MIN_TITLE, F.concat(F.lit("title:"), name))))
    alone = F.array_compact(F.array(F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), url_key(url)))))
    return F.when(F.size(both) > 0, both).otherwise(alone)


def paper_id(url: Column) -> Column:
    """The id by which a citation graph knows a paper: 40-hex, preprint archive, PubMed or DOI; else null."""
    low = F.lower(F.coalesce(url, F.lit("")))
    some = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
    return F.coalesce(
        some(r"semanticscholar\.org/paper/([0-9a-f]{40})"), F.concat(F.lit("ARXIV:"), some(r"arxiv\.org/abs/([\w.\-]+?)(?:v\d+)?/?$")),
        F.concat(F.lit("PMID:"), some(r"(?:pubmed\.ncbi\.nlm\.nih\.gov|/med/)/?(\d{4,9})")), F.concat(F.lit("DOI:"), extract_doi(low)),
    )


def host(url: Column) -> Column:
    """Host in lower case without one leading www.; null if there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def host_suffixes(name: Column) -> Column:
    """A host and all domains above it."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def fold_space(text: Column) -> Column:
    """White space runs as one blank, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def quote_grounded(content: Column, quote: Column) -> Column:
    """Whether a quote stands in a text, apart from case and white space; an empty quote doesn't."""
    return (fold_space(quote) != "") & F.contains(fold_space(content), fold_space(quote))


def html_to_text(html: Column, least: int = 150, most: int = 150_000) -> Column:
    """Readable text: script, style and page furniture out, headings as lines of ``## ``, tags out, white space folded; '' if under ``least`` characters."""
    text = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "nav", "header", "footer"):
        text = F.regexp_replace(text, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]>", "\x01$1\x02")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " ")
    text = F.trim(F.regexp_replace(text, "\x01([^\x01\x02]*)\x02", "\n## $1\n"))
    return F.when(F.length(text) < least, "").otherwise(F.substring(text, 1, most))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def redact(text: Column, patterns: tuple[str, ...], known: tuple[str, ...] = ()) -> Column:
    """Known values, and what follows the first group of each pattern, replaced by [redacted]."""
    for value in known:
        text = F.replace(text, F.lit(value), F.lit("[redacted]"))
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "$1[redacted]")
    return text


def query_key(query: Column, source: Column, options: Column | None = None) -> Column:
    """Hash of a query without punctuation and word order, with its provider and options."""
    words = F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}_\s]", ""), r"\s+"), lambda w: w != ""))
    parts = [source, F.lit(":"), F.array_join(words, " ")] + ([F.lit("|"), options] if options is not None else [])
    return F.sha2(F.concat(*parts), 256)


def sections(text: Column) -> Column:
    """Lossless split before every line that starts with ``## ``; the preamble is the first part if it isn't empty."""
    parts = F.split(F.regexp_replace(text, r"(?m)^(##[ \t]+\S)", "\x01$1"), "\x01")
    return F.filter(parts, lambda p: p != "")


def section_name(section: Column) -> Column:
    return F.trim(F.regexp_extract(section, r"^##[ \t]+([^\n]+)", 1))


def citation_chunks(paragraph: Column) -> Column:
    """Chunks of a paragraph, each ended by the cluster of [k] that cites for it; trailing prose is an uncited chunk."""
    parts = F.split(F.regexp_replace(paragraph, r"((?:\[\d+\]\s*)+[.,;:!?]?)", "$1\x01"), "\x01")
    trimmed = F.transform(parts, lambda p: F.trim(p))
    return F.filter(trimmed, lambda p: F.trim(F.regexp_replace(p, r"((?:\[\d+\]\s*)+[.,;:!?]?)", "")) != "")


def cited(chunk: Column) -> Column:
    return F.transform(F.regexp_extract_all(chunk, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda d: d.cast("int"))


#: Section names by priority for papers and for guidelines, and sections that never count.
BIOMED_PRIORITY = ("result", "finding", "outcome", "efficacy", "discussion", "conclusion", "method", "material", "introduction", "background")
GUIDELINE_PRIORITY = ("recommendation", "evidence to decision", "rationale", "implementation")
SKIPPED_SECTIONS = ("reference", "bibliography", "acknowledg", "conflict of interest", "funding", "author contribution", "supplementary", "data availability")


def section_priority(name: Column, order: tuple[str, ...] = BIOMED_PRIORITY, skipped: tuple[str, ...] = SKIPPED_SECTIONS) -> Column:
    """Place of the first word of ``order`` that a heading holds, the length of ``order`` for none, null for a section to skip."""
    low, rank = F.lower(F.coalesce(name, F.lit(""))), F.lit(len(order))
    for k, word in reversed(list(enumerate(order))):
        rank = F.when(F.contains(low, F.lit(word)), k).otherwise(rank)
    skip = F.lit(False)
    for word in skipped:
        skip = skip | F.contains(low, F.lit(word))
    return F.when(~skip, rank)


def pick_section(text: Column, name: Column) -> Column:
    """The first section whose heading holds ``name``, in any case; null if none does."""
    return F.try_element_at(F.filter(sections(text), lambda s: F.contains(F.lower(section_name(s)), F.lower(name))), F.lit(1))
