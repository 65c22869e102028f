"""Text functions as Column expressions: everything stays in the JVM, inside whole-stage codegen where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{IsAlphabetic}\p{N}]"
WORD = r"[\p{L}\p{N}]+"
#: Brackets and quotes, a full stop between letters or digits, a comma between digits.
_DROPPED = r"""[()\[\]{}"'`]|(?<=%s)\.(?=%s)|(?<=[0-9]),(?=[0-9])""" % (ALNUM, ALNUM)
_SPACE = r"(?U)\s+"

_OPEN, _CLOSE = chr(0xE000), chr(0xE001)
_ENTITY = r"&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7});"
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}
_RAW = r"<(script|style)(?![A-Za-z0-9])(?:.*?</\%d[^>]*(?:>|\z)|.*\z)"


def normalize(text: Column) -> Column:
    """Text as it is indexed: ``401(k)`` is ``401k``, ``U.S.A.`` is ``USA.`` and ``1,000`` is ``1000``."""
    return F.regexp_replace(text, _DROPPED, "")


def tokens(text: Column) -> Column:
    """Words of the normalised text in lower case, in order, with repeats; a null text has none."""
    return F.regexp_extract_all(F.lower(normalize(F.coalesce(text, F.lit("")))), F.lit(WORD), F.lit(0))


def query_terms(text: Column) -> Column:
    """Sorted distinct words of a query."""
    return F.array_sort(F.array_distinct(tokens(text)))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def included_text(text: Column) -> Column:
    """The query without its ``-word`` parts; a lone ``-`` is kept."""
    return F.array_join(F.filter(_split(text), lambda w: ~(w.startswith("-") & (F.length(w) > 1))), " ")


def excluded_text(text: Column) -> Column:
    """The words that the query excludes, without their ``-``."""
    words = F.filter(_split(text), lambda w: w.startswith("-") & (F.length(w) > 1))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 2, 1 << 30)), " ")


def or_groups(text: Column) -> Column:
    """One array of terms for each group: the parts of ``a|b`` share a group, any other term is its own."""
    def groups(word: Column) -> Column:
        parts = F.filter(F.split(word, r"\|"), lambda p: p != "")
        merged = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, tokens))))
        single = F.transform(query_terms(word), lambda t: F.array(t))
        return F.when(F.size(parts) >= 2, F.array(merged)).otherwise(single)

    return F.filter(F.flatten(F.transform(_split(text), groups)), lambda g: F.size(g) > 0)


def phrases(text: Column) -> Column:
    """The words of each closed ``"..."`` run that isn't blank."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))
    return F.filter(F.transform(quoted, tokens), lambda p: F.size(p) > 0)


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def snippet(text: Column, chars: int = 320) -> Column:
    """The first ``chars`` characters with white space collapsed."""
    return collapse_space(F.substring(text, 1, chars))


def truncate(text: Column, chars: int = 200) -> Column:
    """At most ``chars`` characters, and an ellipsis where some are left out."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlight_words(query: Column) -> Column:
    """Lower-case words of a query, split at anything but letters, digits, ``_`` and ``-``."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{IsAlphabetic}\p{N}_\-]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^-+", "")), lambda w: w != ""))


def highlight(text: Column, words: Column) -> Column:
    """The escaped text with ``<mark>`` around every whole word, the longest word first."""
    longest = F.array_sort(words, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    # letters, digits, _ and - need no quoting in a pattern
    pattern = F.concat(F.lit(f"(?iu)(?<!{ALNUM})("), F.array_join(longest, "|"), F.lit(f")(?!{ALNUM})"))
    marked = F.when(F.size(words) > 0, F.regexp_replace(text, pattern, F.lit(f"{_OPEN}$1{_CLOSE}"))).otherwise(text)
    return F.replace(F.replace(html_escape(marked), F.lit(_OPEN), F.lit("<mark>")), F.lit(_CLOSE), F.lit("</mark>"))


def split_words(text: Column) -> Column:
    """Runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}']+"), F.lit(0))


def one_deletions(word: Column) -> Column:
    """The word without each of its characters in turn."""
    cut = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1 << 30)))
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), cut)).otherwise(F.array().cast("array<string>"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion or substitution at most parts the words; a swap is two."""
    return F.levenshtein(a, b, 1) >= 0


def _entity(e: Column) -> Column:
    body = F.lower(F.regexp_extract(e, "#([xX]?[0-9a-fA-F]+);", 1))
    hexed = body.startswith("x")
    code = F.when(hexed, F.conv(F.substring(body, 2, 8), 16, 10)).otherwise(body).cast("bigint")
    sound = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv]), e)
    return F.when(e.startswith("&#"), F.when(sound, char).otherwise(e)).otherwise(named)


def decode_entities(text: Column) -> Column:
    """Named and numeric entities become characters, once: ``&amp;lt;`` gives ``&lt;``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), _entity)
    between = F.split(text, _ENTITY)
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def strip_html(text: Column) -> Column:
    """Visible text: comments go, tags and the bodies of script and style become blanks, entities are decoded.

    What follows a ``<``, a comment or a script that is never closed goes too.
    """
    # comments first, but not those that only look so inside a tag or a script, which $1 puts back
    text = F.regexp_replace(text, rf"(?is)({_RAW % 2}|<(?!!--)[^>]*(?:>|\z))|<!--(?:.*?-->|.*\z)", "$1")
    text = F.regexp_replace(text, rf"(?is){_RAW % 1}|<[^>]*(?:>|\z)", " ")
    return collapse_space(decode_entities(text))


def strip_markdown(text: Column) -> Column:
    """Text without fences and what they hold, line markers, links, code ticks and emphasis."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"(?m)^[^\S\n]*(```|~~~)[^\n]*(?:\n(?s:.*?)^[^\S\n]*\1[^\n]*$|(?s:.*))", "")
    text = F.regexp_replace(text, r"(?m)^[^\S\n]*#*(?:>[^\S\n]*)*(?:[*\-+][^\S\n]+)?(?:[0-9]+[.)][^\S\n]*)?", "")
    text = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.replace(text, F.lit("`"), F.lit(""))
    return collapse_space(F.regexp_replace(text, r"\*|(?<![A-Za-z0-9])_|_(?![A-Za-z0-9])", ""))


def markup_kind(text: Column) -> Column:
    """``html``, ``markdown`` or ``plain``, by the first 2,048 characters."""
    head = F.substring(text, 1, 2048)
    html = head.rlike("<p>|<div|<br|<html|<body|<script|</")
    return F.when(html, "html").when(head.rlike(r"(?m)^[^\S\n]*(# |```|\* |- )"), "markdown").otherwise("plain")


def clean(text: Column) -> Column:
    """The text without the markup that it seems to hold."""
    kind = markup_kind(text)
    return F.when(kind == "html", strip_html(text)).when(kind == "markdown", strip_markdown(text)).otherwise(text)
