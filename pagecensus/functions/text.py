"""Text helpers as Spark SQL expressions.

Every helper takes and returns SQL text, for ``selectExpr`` and ``F.expr``. A page's facts are some
hundred nested calls; as text they reach the parser in one piece, and all of them run in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

# The characters the web platform counts as white space. Java's \s is narrower.
WHITESPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS_SET = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{WS_SET}]"

# Web word boundaries are ASCII, Java's are not, so they are spelled out.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"

# Either quote sign, and anything else, without quoting trouble in SQL.
QUOTE = r"[\x22\x27]"
NO_QUOTE = r"[^\x22\x27]"

# Characters that start neither a tag nor white space.
_ORDINARY = r"!-;=-~\u00A1-\u167F"
# A run of tags and white space. It starts with a quick look that passes over ordinary characters and
# over single spaces between them, which would only be replaced by themselves. Possessive, so that
# long runs neither backtrack nor recurse.
_TAGS_AND_SPACE = rf"(?![{_ORDINARY}]| [{_ORDINARY}])(?:<[^>]++>|{WS}++)++"

_TRIMMED = "".join(f"\\u{ord(char):04x}" for char in WHITESPACE_CHARS)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def pattern(regex: str) -> str:
    """A regular expression as a raw SQL literal."""
    return f"r'{regex}'"


def bind(value: str, name: str, body: Callable[[str], str] | str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    text = body if isinstance(body, str) else body(name)
    return f"get(transform(array({value}), {name} -> {text}), 0)"


def trim_space(text: str) -> str:
    return f"trim(BOTH '{_TRIMMED}' FROM {text})"


def strip_tags(text: str) -> str:
    """Tags and white space become single spaces, the ends are trimmed."""
    return f"trim(regexp_replace({text}, {pattern(_TAGS_AND_SPACE)}, ' '))"


def strip_document(html: str) -> str:
    """``strip_tags`` for whole documents.

    Behind the last ``>`` no tag can close. When that tail holds ``<`` signs, searching a tag at
    each of them costs quadratic time, so the tail then only gets its white space collapsed.
    """
    tail = f"substring_index({html}, '>', -1)"
    head = f"substring({html}, 1, length({html}) - length({tail}))"
    spaced = f"concat(regexp_replace({head}, {pattern(_TAGS_AND_SPACE)}, ' '), {tail})"
    guarded = f"trim(regexp_replace({spaced}, {pattern(WS + '++')}, ' '))"
    return f"CASE WHEN contains({tail}, '<') THEN {guarded} ELSE {strip_tags(html)} END"


_UP_TO = r"(?i)^([\s\S]*END)"


def up_to_last(end_tag: str, html: str) -> str:
    """The document up to its last ``end_tag``, empty if there is none.

    Elements end there at the latest. Without the cut, each opening tag behind it is searched for an
    end tag up to the end of the document, which is quadratic for documents that never close them.
    """
    return f"regexp_extract({html}, {pattern(_UP_TO.replace('END', end_tag))}, 1)"


def utf16_length(text: str) -> str:
    """Length in UTF-16 units, the length the web platform reports."""
    return f"CAST(length(encode({text}, 'UTF-16BE')) DIV 2 AS INT)"


def attribute(attrs: str, name: str) -> str:
    """Quoted value of the first ``name=`` in a tag's attribute text, else an empty string.

    There is no boundary on the left (``data-src`` answers for ``src``), and the value ends at
    whichever quote sign comes first.
    """
    regex = rf"(?i){name}{WS}*={WS}*{QUOTE}({NO_QUOTE}+){QUOTE}"
    return trim_space(f"regexp_extract({attrs}, {pattern(regex)}, 1)")


def meta_content(metas: str, name: str) -> str:
    """Content of the first meta tag named ``name``; ``property`` only counts if no name does."""

    def first_with(key: str) -> str:
        regex = rf"(?i){WORD_START}{key}={QUOTE}{name}{QUOTE}"
        return f"get(filter({metas}, m -> m RLIKE {pattern(regex)}), 0)"

    return attribute(f"coalesce({first_with('name')}, {first_with('property')}, '')", "content")


def decode_entities(text: str) -> str:
    """The five XML entities, the ampersand first, so that doubly encoded text loses two layers."""
    # Entity and character, in the order they apply.
    for entity, char in (
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
    ):
        text = f"replace({text}, {quoted(entity)}, {quoted(char)})"
    return text


def table_cell(text: str) -> str:
    """Text made safe for a Markdown table cell."""
    return f"replace(replace({text}, '|', {quoted(chr(92) + '|')}), '\\n', ' ')"


def url_count(n: str) -> str:
    """``1 URL``, ``2 URLs``."""
    return f"concat({n}, CASE WHEN {n} = 1 THEN ' URL' ELSE ' URLs' END)"


def iso_timestamp(ts: str) -> str:
    return f"""date_format({ts}, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")"""


def bullets(texts: str) -> str:
    """Markdown list of an array of texts."""
    return f"array_join(transform({texts}, t -> concat('- ', t)), '\\n')"
