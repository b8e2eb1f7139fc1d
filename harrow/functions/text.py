"""Text functions on columns. Patterns are literals, so each is compiled once per expression."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with a diacritic and the letters without, in the same places.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"

# Named references that feeds use, and their characters.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

#: Blanks that are not a space, runs of blanks, and what a folded text has no place for: letters one by one, as such a
#: class is a table look-up and one of ranges a chain of comparisons.
_OTHER_BLANKS = ("\t", "\f", "\x0b", "\u00a0", "\u2009", "\u202f")
_BLANK = r"[\t\f\x0B\x{00A0}\x{2009}\x{202F} ]+"
_NOT_FOLDED = "[^abcdefghijklmnopqrstuvwxyz0123456789+#.]+"
#: Characters that a pattern of ``found_in`` may match before its needle, at most.
REACH = 64


def _holds(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def _where(value: Column, needles: tuple[str, ...], change) -> Column:
    """``change(value)`` for texts that hold one of ``needles``; the others are not touched."""
    return bound(value, lambda v: F.when(_holds(v, needles), change(v)).otherwise(v))


def found_in(text: Column, pattern: str, *needles: str) -> Column:
    """Does the pattern match a text? It must hold one of ``needles`` wherever it does, no more than REACH characters from its start.

    A search for a few bytes costs a small part of what a pattern with word borders does. Texts without needles are not
    matched at all, others from shortly before the first one. Without ``needles`` the whole text is matched.
    """
    if not needles:
        return text.rlike(pattern)
    places = [F.when(text.contains(n), F.position(F.lit(n), text)) for n in needles]
    first = F.least(*places) if len(places) > 1 else places[0]
    near = F.substr(text, F.greatest(first - REACH, F.lit(1)))
    return _holds(text, needles) & near.rlike(pattern)


def _chain(value: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), steps, value)


def decode_entities(value: Column) -> Column:
    """Named references, then decimal, then hexadecimal ones; each is read once.

    A reference's number becomes a character by its code point; one that is no code point stays as it is.
    """
    pattern = "&(?:" + "|".join(name[1:-1] for name, _ in ENTITIES) + ");"
    named = F.create_map(*[F.lit(x) for pair in ENTITIES for x in pair])

    def decoded(text: Column) -> Column:
        text = _replaced(text, pattern, lambda m: F.try_element_at(named, m))
        text = _replaced(text, r"&#\d{1,7};", lambda m: _code_point(F.regexp_extract(m, r"(\d+)", 1), 10))
        return _replaced(text, r"&#[xX][0-9a-fA-F]{1,6};", lambda m: _code_point(F.regexp_extract(m, r"[xX]([0-9a-fA-F]+)", 1), 16))

    return _where(value, ("&",), decoded)


def _code_point(digits: Column, base: int) -> Column:
    """The character of a code point, from its big-endian UTF-32 form."""
    code = F.conv(digits, base, 16)
    fits = (F.length(code) <= 6) & (code.cast("string") != "0") & (F.conv(code, 16, 10).cast("long") <= 0x10FFFF) & ~code.rlike("^D[89A-F]..$")
    return F.when(fits, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))


def _replaced(value: Column, pattern: str, to) -> Column:
    """``value`` with every match m replaced by ``to(m)``, or kept where that is null. Texts without a match pay one test."""

    def changed(text: Column) -> Column:
        parts, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(parts, found, lambda part, m: F.concat(part, F.when(m.isNull(), F.lit("")).otherwise(F.coalesce(to(m), m))))
        return F.when(text.rlike(pattern), F.array_join(pairs, "")).otherwise(text)

    return bound(value, changed)


def bound(value: Column, to) -> Column:
    """``to(value)`` where ``to`` uses its argument more than once: it is evaluated once and the expression stays small."""
    return F.element_at(F.transform(F.array(value), to), 1)


def normalize_whitespace(value: Column) -> Column:
    """One space for blanks, one line end for several, none at the edges of lines and text."""
    value = _where(value, ("\r",), lambda v: F.replace(v, F.lit("\r"), F.lit("")))
    value = _where(value, ("  ", *_OTHER_BLANKS), lambda v: F.regexp_replace(v, _BLANK, " "))
    value = _where(value, (" \n", "\n "), lambda v: F.regexp_replace(v, r" ?\n ?", "\n"))
    value = _where(value, ("\n\n",), lambda v: F.regexp_replace(v, r"\n{2,}", "\n"))
    # the pattern's end may also stand before one last line terminator
    edged = lambda v: v.startswith("\n") | F.right(v, F.lit(2)).contains("\n")
    return F.trim(bound(value, lambda v: F.when(edged(v), F.regexp_replace(v, r"^\n|\n$", "")).otherwise(v)))


def html_to_text(value: Column) -> Column:
    """Lines for blocks; scripts, styles and tags go; markup that was escaped as a whole is decoded first."""
    escaped = lambda v: ~v.rlike(r"<[a-zA-Z]") & v.rlike(r"&lt;[a-zA-Z]")
    value = bound(F.coalesce(value, F.lit("")), lambda v: F.when(escaped(v), decode_entities(v)).otherwise(v))
    tags = (
        (r"(?is)<script\b[^>]*>.*?</script>", ""),
        (r"(?is)<style\b[^>]*>.*?</style>", ""),
        (r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|h[1-6]|tr|section|article|blockquote)\s*>", "\n"),
        (r"<[^>]*>", ""),
    )
    value = _where(value, ("<",), lambda v: _chain(v, *tags))
    return normalize_whitespace(decode_entities(value))


def strip_accents(value: Column) -> Column:
    return F.translate(value, ACCENTED, PLAIN)


def fold(value: Column) -> Column:
    """Lower case without accents; letters, digits and ``+ # .`` in words with one space between."""
    # a text of single bytes has no accents
    plain = bound(F.lower(value), lambda v: F.when(F.length(v) == F.octet_length(v), v).otherwise(strip_accents(v)))
    return F.trim(F.regexp_replace(plain, _NOT_FOLDED, " "))


# What is not part of a role's name (on the title as it is), spellings of one word and legal forms (folded).
TITLE_NOISE = (
    r"(?i)\((?:h|f)\s*[/|]\s*(?:f|h)(?:\s*[/|]\s*[a-z]+)?\)",
    r"(?i)\b(?:h|f)\s*[/|]\s*(?:f|h)(?:\s*[/|]\s*[a-z]+)?\b",
    r"(?i)\((?:m|w)\s*[/|]\s*(?:w|m)(?:\s*[/|]\s*d)?\)",
    r"(?i)[-–—|/]\s*(?:cdi|full[\s-]?remote|remote|télétravail|teletravail)\s*$",
    r"(?i)\((?:cdi|full[\s-]?remote|remote)\)",
    r"[\x{1F1E6}-\x{1F1FF}]",
)
TITLE_WORDS = (
    (r"\bfront end\b", "frontend"),
    (r"\bfull stack\b", "fullstack"),
    (r"\bback end\b", "backend"),
    (r"\bdevelopp?(?:eur|euse)(?: euse| se)?\b|\bdevelopper\b", "developpeur"),
    (r"\bnext js\b|\bnextjs\b", "next.js"),
)
LEGAL_FORMS = r"\b(?:sas|sasu|sarl|eurl|sa|sca|snc|scop|inc|llc|ltd|limited|gmbh|ag|bv|nv|plc|corp|corporation|co|group|groupe|france)\b"


def normalize_title(value: Column) -> Column:
    value = reduce(lambda c, noise: F.regexp_replace(c, noise, " "), TITLE_NOISE, value)
    return F.trim(_chain(fold(value), *TITLE_WORDS, (r" {2,}", " ")))


def normalize_company(value: Column) -> Column:
    """Folded, dots as spaces, without legal forms; a name made of those only becomes empty."""
    return F.trim(_chain(F.replace(fold(value), F.lit("."), F.lit(" ")), (LEGAL_FORMS, " "), (r" {2,}", " ")))


def non_empty(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def truncated(value: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.left(value, F.lit(n))


def slice_description(value: Column, start: Column, end: Column) -> Column:
    """From the first ``start`` marker to the end of the last ``end`` marker; the whole text if that fails."""
    first = F.when(start != "", F.position(start, value))
    after = F.position(F.reverse(end), F.reverse(value))  # what follows the last end marker, and one
    last = F.when((end != "") & (after > 0), F.length(value) - after + 1)
    found = (first > 0) & (last - F.length(end) + 1 > first)
    return F.when(found, F.substr(value, first, last - first + 1)).otherwise(value)


def page_title(value: Column) -> Column:
    """What stands before the first spaced bar or dash."""
    head = F.trim(F.element_at(F.split(value, r" [|\x{2013}-] "), 1))
    return F.coalesce(F.nullif(head, F.lit("")), value)


def join_present(sep: str, *values: Column) -> Column:
    """The values that are not null or empty, joined."""
    return F.array_join(F.filter(F.array(*values), lambda x: x.isNotNull() & (x != "")), sep)


def render(template: str, **values: Column) -> Column:
    """``{{name}}`` placeholders; a missing or null value is an error."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    unknown = [name for name in parts[1::2] if name not in values]
    if unknown:
        raise KeyError(f"no value for {', '.join(unknown)}")
    strict = lambda name: F.coalesce(values[name], F.raise_error(F.lit(f"{name} is null")).cast("string"))
    return F.concat(*[strict(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
