"""Text expressions: every function takes and returns Columns, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skein.config import DEFAULTS

# The characters Unicode-aware trimming removes, as character-class ranges; the same
# set without newline; and the line boundaries a text is cut at.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INLINE_WHITESPACE = WHITESPACE.replace(r"\t-\r", r"\t\x0b-\r")
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
_TRIM_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace on both ends (``trim`` only knows the blank)."""
    return F.btrim(text, F.lit(_TRIM_CHARS))


def estimate_tokens(text: Column) -> Column:
    """About four characters per token, at least one."""
    return tokens_of(F.length(text))


def tokens_of(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / F.lit(DEFAULTS.chars_per_token)).cast("int"))


def slug(name: Column, ident: Column) -> Column:
    """``lower-case-words-<id>``: a number stands whole, of any other id the first 8 characters do."""
    words = F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "-")
    return F.concat(F.regexp_replace(words, r"\A-+|-+\z", ""), F.lit("-"),
                    F.when(ident.cast("string").rlike(r"\A-?[0-9]+\z"), ident.cast("string")).otherwise(F.substring(ident.cast("string"), 1, 8)))


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, LINE_BREAK, 2), 1)


def first_line_summary(text: Column) -> Column:
    """First line; longer than 80 characters becomes 77 plus an ellipsis."""
    line = first_line(text)
    return F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 77), F.lit("..."))).otherwise(line)


def excerpt(content: Column, max_chars: int = 200) -> Column:
    """First paragraph, cut at a word boundary and marked with dots when too long."""
    para = strip(F.substring_index(content, "\n\n", 1))
    head = F.substring(para, 1, max_chars)
    words = F.regexp_extract(head, r"(?s)\A(.+) ", 1)
    cut = F.when(words != "", words).otherwise(head)
    return F.when(F.length(para) <= max_chars, para).otherwise(F.concat(cut, F.lit("...")))


def title_case(text: Column) -> Column:
    """Capitalise every run of letters (``initcap`` only looks at blanks)."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
    return F.array_join(cased, "")


def is_caps_or_colon_heading(line: Column) -> Column:
    """ALL-CAPS of 4 to 99 characters, or ending in a colon."""
    caps = (
        F.length(line).between(4, 99)
        & F.regexp_like(line, F.lit(r"\p{Lu}"))
        & ~F.regexp_like(line, F.lit(r"[\p{Ll}\p{Lt}]"))
    )
    return caps | F.endswith(line, F.lit(":"))


def txt_sections(text: Column) -> Column:
    """Plain-text sections as an array.

    Two or more blank lines end a section and a heading line opens one. Sections hold no blank
    line, so a blank line can serve as the seam: mark the seams in one string, split once.
    """
    blocks = F.split(strip(text), rf"\n(?:[{INLINE_WHITESPACE}]*+\n){{2,}}+")

    def cut(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")
        seamed = F.transform(
            lines,
            lambda x, i: F.when((i > 0) & is_caps_or_colon_heading(x), F.concat(F.lit("\n"), x)).otherwise(x),
        )
        return F.split(F.array_join(seamed, "\n"), "\n\n")

    return F.flatten(F.transform(blocks, cut))


def md_sections(text: Column) -> Column:
    """Markdown sections: split before every ``#`` … ``######`` heading line, lines kept as they are."""
    heading = rf"[{INLINE_WHITESPACE}]*#{{1,6}}[{INLINE_WHITESPACE}]+[^{WHITESPACE}]"
    return F.split(strip(text), rf"\n(?={heading})")


def paragraphs(text: Column) -> Column:
    """Non-empty stripped paragraphs; the whole text when there are none."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


# Fixed values: "##" headings of wiki pages and the section tag each one stands for.
SECTION_TAGS = {
    "relations": "relationships",
    "relationships": "relationships",
    "contradictions": "contradictions",
    "sources": "sources",
    "chunks": "sources",
    "pages created or updated": "pages_created",
    "key relations introduced": "key_relations",
    "ingest history": "ingest_history",
}
# Order in which sections of an entity page and of a source page enter the context.
ENTITY_SECTION_ORDER = ["entity_prose", "relationships", "contradictions", "sources", "other"]
SOURCE_SECTION_ORDER = ["entity_prose", "pages_created", "key_relations", "contradictions", "ingest_history",
                        "sources", "other"]


def heading_tag(heading: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for pair in SECTION_TAGS.items() for x in pair])
    return F.coalesce(F.try_element_at(tags, heading), F.lit("other"))


def wiki_sections(content: Column) -> Column:
    """``array<struct<tag,text>>`` of the page, cut before every line that starts with ``## ``."""
    lines = F.regexp_replace(F.regexp_replace(content, LINE_BREAK, "\n"), r"\n\z", "")
    parts = F.split(lines, r"\n(?=## )")

    def tagged(part: Column, i: Column) -> Column:
        head = F.lower(strip(F.substring(F.substring_index(part, "\n", 1), 4, 1 << 30)))
        return F.struct(
            F.when(F.startswith(part, F.lit("## ")), heading_tag(head)).otherwise(F.lit("entity_prose")).alias("tag"),
            part.alias("text"),
        )

    return F.when(F.length(content) > 0, F.transform(parts, tagged)).otherwise(F.expr("array()"))


def section_priority(tag: Column, order: list[str] = ENTITY_SECTION_ORDER) -> Column:
    """Index of the tag in the order; unknown tags come first."""
    return F.greatest(F.lit(0), (F.array_position(F.array(*[F.lit(t) for t in order]), tag) - 1).cast("int"))


# Fixed value: characters that force a YAML scalar into quotes.
_YAML_SPECIAL = r"""[:#{}\[\],>|"'%@`]"""


def yaml_field(key: str, value: Column) -> Column:
    """``key: value`` with quoting; several lines become a block scalar; NULL stays NULL."""
    block = F.concat(
        F.lit(f"{key}: |\n"),
        F.array_join(
            F.transform(F.split(F.regexp_replace(value, rf"({LINE_BREAK})\z", ""), LINE_BREAK),
                        lambda x: F.concat(F.lit("  "), x)), "\n"),
    )
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return (
        F.when(F.contains(value, F.lit("\n")), block)
        .when(F.regexp_like(value, F.lit(_YAML_SPECIAL)), F.concat(F.lit(f'{key}: "'), quoted, F.lit('"')))
        .otherwise(F.concat(F.lit(f"{key}: "), value))
    )


def lock_key(name: Column) -> Column:
    """MD5 folded to a positive 63-bit number: a stable partition key for a name."""
    wide = F.conv(F.substring(F.md5(name.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    return (wide % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint")


def json_payload(text: Column) -> Column:
    """Strip a Markdown code fence (and its ``json`` tag) around a model's JSON answer."""
    body = strip(text)
    fenced = F.regexp_replace(F.element_at(F.split(body, "```"), 2), r"\Ajson", "")
    return F.when(F.startswith(body, F.lit("```")), strip(fenced)).otherwise(body)
