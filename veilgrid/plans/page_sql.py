"""SQL of what pages show, for pages whose markup is made of tags, comments, scripts and styles without nesting surprises."""

from __future__ import annotations

from veilgrid.functions.patterns import re2
from veilgrid.sources.html import BLOCK, SILENT

_BLOCKS = "|".join(sorted(BLOCK, key=lambda t: (-len(t), t)))


def _lit(pattern: str) -> str:
    return "'" + re2(pattern).replace("'", "''") + "'"


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_lit(pattern)}, '{by}', 'gs')"


def entities(text: str) -> str:
    """The entities that the pages have; the ampersand last, which may lack its end."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", "\xa0"), ("copy", "©"), ("middot", "·")):
        text = f"replace({text}, '&{name};', '{char}')"
    return f"replace(replace(replace({text}, '&amp;', chr(4)), '&amp', chr(4)), chr(4), '&')"


def _title() -> str:
    return f"trim({entities(f'regexp_extract(html, {_lit("(?is)<title[^>]*>(.*?)</title>")}, 1)')})"


def _visible() -> str:
    body = f"regexp_extract(html, {_lit('(?is)<body[^>]*>(.*?)(?:</body>|$)')}, 1)"
    bare = _replace(body, r"(?i)<!--.*?-->", "")
    for tag in sorted(SILENT):
        bare = _replace(bare, rf"(?i)<{tag}\b[^>]*>.*?</{tag}>", "\x01")
    # a mark for each start of a block or row, a break, a cell; any other tag ends a piece of text
    marked = _replace(bare, rf"(?i)<(?:{_BLOCKS}|br)\b[^>]*>", "\x02")
    marked = _replace(marked, r"(?i)<t[dh]\b[^>]*>", "\x03")
    marked = _replace(marked, r"</?[A-Za-z][^>]*>", "\x01")
    return marked


#: Text of a page's pieces, each trimmed, with a newline at marks but for the first, joined by blanks; then blanks and blank lines are reduced.
_JOINED = f"""list_filter(list_transform(string_split(replace(replace({_visible()}, chr(2), chr(1) || chr(2) || chr(1)), chr(3), chr(1) || chr(3) || chr(1)), chr(1)), lambda x: trim({entities("x")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"""
_LINES = "array_to_string(list_transform(CASE WHEN list_position(l, chr(2)) > 0 THEN list_concat(l[1:list_position(l, chr(2)) - 1], l[list_position(l, chr(2)) + 1:]) ELSE l END, lambda x: CASE x WHEN chr(2) THEN chr(10) WHEN chr(3) THEN chr(9) ELSE x END), ' ')"
_REDUCED = f"regexp_replace(regexp_replace({_LINES}, {_lit('(\\n{s}*){3,}')}, chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g')"

PAGE_TEXT = f"SELECT page_id, title, trim({_REDUCED}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible_text FROM (SELECT page_id, {_title()} AS title, {_JOINED} AS l FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"
