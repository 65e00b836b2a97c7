"""Text functions as Column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the model output and of category names.
INSTRUCTION_END = "[/INST]"
ASSISTANT_MARK = "ASSISTANT:"
CATEGORY_MARK = "Category:"

# The rule that drops table-like lines.
NUMERIC_SHARE = 0.4

# Words that open a question; ours, as the classifier of the model hook is not part of this library.
QUESTION_WORDS = (
    "what", "who", "whom", "whose", "which", "when", "where", "why", "how",
    "is", "are", "was", "were", "do", "does", "did", "can", "could", "will", "would", "should",
)


# White space in the sense of Unicode, with the four separator controls.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a lambda variable so that `body` may use it many times,
    also inside other lambdas, while it is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_equals(text: Column) -> Column:
    """Remove `=` at both ends; spaces inside stay."""
    return F.btrim(text, F.lit("="))


def clean(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def words(text: Column) -> Column:
    """Words of a text that went through `clean`."""
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of any text; the default token count."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+"))


def drop_numeric_lines(text: Column, share: float = NUMERIC_SHARE) -> Column:
    """Drop lines in which more than `share` of the words hold a digit, unless
    the line ends with a full stop. Most texts and lines hold no digit and are
    passed on after one look."""

    def keep(line: Column) -> Column:
        with_digit = F.regexp_count(line, F.lit(r"[^ \t\n\r\f]*\p{Nd}[^ \t\n\r\f]*"))
        table_like = line.rlike(r"\p{Nd}") & ~strip(line).endswith(".") & (with_digit > F.lit(share) * word_count(line))
        return ~table_like

    kept = F.array_join(F.filter(F.split(text, r"\r\n|\n|\r", -1), keep), "\n")
    return F.when(text.rlike(r"\p{Nd}"), kept).otherwise(text)


def sentences(text: Column) -> Column:
    """Sentences of a cleaned text: one ends at `.`, `!` or `?` before a space."""
    return F.split(text, r"(?<=[.!?]) ", -1)


def after_first(text: Column, mark: str) -> Column:
    """What follows the first `mark`; null if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text)))


def category_name(category: Column) -> Column:
    """`...Category:X` to `X`."""
    return after_first(category, CATEGORY_MARK)


def after_last_colon(text: Column) -> Column:
    return F.substring_index(text, ":", -1)


def percent_encode(text: Column) -> Column:
    """Percent-encoding that leaves `/` and `~` alone and writes a space as `%20`."""
    encoded = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def answer_after(raw: Column, mark: str = INSTRUCTION_END) -> Column:
    """Second piece of the model output cut at `mark`; null without a mark."""
    quoted = "".join("\\" + c if c in "[]/" else c for c in mark)
    return F.try_element_at(F.split(raw, quoted, -1), F.lit(2))


def answer_matched(raw: Column) -> Column:
    """All text after the instruction block, or the raw text if there is none."""
    pattern = r"(?s)\[INST\].*?\[/INST\]\s*(.*)"
    return F.when(raw.rlike(pattern), F.regexp_extract(raw, pattern, 1)).otherwise(raw)


def fill_template(template: str, **values: Column) -> Column:
    """Put columns in the `{name}` places of a template."""
    parts, rest = [], template
    while True:
        places = [(rest.find("{" + name + "}"), name) for name in values]
        places = [p for p in places if p[0] >= 0]
        if not places:
            break
        at, name = min(places)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts, F.lit(rest))


def trim_ends(text: Column) -> Column:
    """Drop the first and the last character; a single character stays."""
    size = F.length(text)
    return F.when(size <= 1, text).otherwise(F.substring(text, F.lit(2), size - 2))


def decode_unicode(text: Column) -> Column:
    r"""Turn `\uXXXX` into the character; any other backslash stays as it is."""
    lower = F.regexp_replace(text, r"\\U(?=[0-9a-fA-F]{4})", r"\\u")
    kept = F.regexp_replace(lower, r"\\(?!u[0-9a-fA-F]{4})", r"\\\\")
    quoted = F.replace(kept, F.lit('"'), F.lit('\\"'))
    record = F.concat(F.lit('{"v":"'), quoted, F.lit('"}'))
    return F.from_json(record, "v string", {"allowUnquotedControlChars": "true"})["v"]


def line_breaks(text: Column) -> Column:
    r"""A backslash followed by `n` becomes `<br>`."""
    return F.replace(text, F.lit("\\n"), F.lit("<br>"))


def display(answer: Column) -> Column:
    """The clean-up an answer gets before it is shown."""
    return line_breaks(decode_unicode(trim_ends(answer)))


def legacy_record(text: Column, schema: str) -> Column:
    """Parse metadata saved as the text of a Python dict; `nan` and `None` are null."""
    nulled = F.regexp_replace(text, r"(?<=: )(?:nan|None)(?=[,}])", "null")
    escaped = F.regexp_replace(nulled, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    return F.from_json(
        escaped, schema, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    )


def text_class(text: Column, openers: Sequence[str] = QUESTION_WORDS) -> Column:
    """`question` if the text ends with `?` or opens with an interrogative word, else `statement`."""
    first = F.regexp_extract(F.lower(clean(text)), r"^([a-z]+)", 1)
    return F.when(clean(text).endswith("?") | first.isin(*openers), "question").otherwise("statement")
