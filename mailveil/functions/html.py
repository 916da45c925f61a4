"""HTML to text without links or images, and the choice of a message body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.binding import let
from mailveil.functions.references import decode_references, tree
from mailveil.functions.text import collapse_newlines, holds_any, strip_invisible

# Elements that start and end a line.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "main", "nav", "ol", "p", "section", "table", "tr", "ul",
)
# Openings that tell HTML from plain text.
HTML_SIGNS = ("<html", "<body", "<div")

# Control characters that mark what was found; none is left in the text before.
OPEN, CLOSE, ITEM, BREAK, CELL, PRE, PRE_END = "\x01\x02\x03\x04\x05\x06\x07"
MARKS, MARK_CHARACTERS = "\x01-\x07", "\x01\x02\x03\x04\x05\x06\x07"
BLANKS = r"[ \t\n\f\r]"

# One automaton over comments, raw text, tags with quoted attributes, and declarations. What a
# comment or raw element does not close goes to the end of the text, and a tag always finds
# its end (``closable``), so no character is looked at again for each opening before it.
# Repetitions of groups are possessive, which Java matches without recursion.
RAW = "|".join(rf"<{tag}(?:{BLANKS}|[/>]).*?(?:</{tag}(?:(?:{BLANKS}|/)[^>]*+)?+>|\z)"
               for tag in ("script", "style"))
# What is written for a tag, by its name. Those met most stand first, as a table is read from there.
WRITTEN = {
    "<p": BREAK, "</p": BREAK, "<li": ITEM, "</li": "", "<div": BREAK, "</div": BREAK, "<br": BREAK,
    "<td": "", "</td": CELL, "<th": "", "</th": CELL,
    **{f"<{slash}{name}": BREAK for name in BLOCK_TAGS for slash in ("", "/")},
    "<pre": PRE, "</pre": PRE_END, "<head": "", "</head": "",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The name of such a tag, kept as a group; of others none is. Not in a look ahead, where Java would
# keep it for the next match if no tag follows.
NAME = rf"(</?{tree(sorted({name.strip('</') for name in WRITTEN}))}(?=[ \t\n\f\r/>]))"
TAG = rf"""(?:{NAME}|</?[a-z])(?:[^>=]++|={BLANKS}*+"[^"]*+"|={BLANKS}*+'[^']*+'|=)*+>"""
COMMENT = r"<!---?+>|<!--.*?-->|<!--.*\z"
# The sign that all begin with stands alone in front: elsewhere one look is enough.
MARKUP = rf"(?is)(?=<)(?:{COMMENT}|{RAW}|{TAG}|<[!?][^>]*+>)"


def _marked(name: str) -> str:
    return f"{OPEN}<{name}{CLOSE}"


# A head that is not closed ends where the body begins.
HEAD = rf"(?is){_marked('head')}.*?(?:{_marked('/head')}|({_marked('body')})|\z)"
KEPT_SPACE = f"(?s){PRE}.*?(?:{PRE_END}|\\z)"


def closable(text: Column) -> Column:
    """The text in which every ``<`` of a tag has a ``>`` somewhere after it.

    Behind the last ``>`` nothing can be a tag; a ``<`` there becomes a reference.
    """
    def split(t: Column) -> Column:
        # All of a text without a ">".
        return let(F.substring_index(t, ">", -1), lambda tail: F.when(
            F.contains(tail, F.lit("<")), F.concat(
                F.substr(t, F.lit(1), F.length(t) - F.length(tail)),
                F.regexp_replace(tail, "<(?!!--)", "&lt;"))).otherwise(t))

    return let(text, split)


def unmarked(text: Column) -> Column:
    """The text without the control characters that mark what is found."""
    return let(text, lambda t: F.when(holds_any(t, MARK_CHARACTERS), F.regexp_replace(
        t, f"[{MARKS}]", "")).otherwise(t))


def written_tags(text: Column) -> Column:
    """The text with what is written for each marked name, all names in one pass."""
    table = F.create_map(*[F.lit(x) for pair in WRITTEN.items() for x in pair])

    def written(name: Column) -> Column:
        # As in patterns, only letters of ASCII have two cases.
        return F.coalesce(F.try_element_at(table, name), F.try_element_at(
            table, F.translate(name, UPPER, LOWER)), F.lit(""))

    # Texts and names in turn.
    return F.array_join(F.transform(
        F.split(text, f"[{OPEN}{CLOSE}]", -1), lambda piece, i: F.when(
            (i % 2 == 1) & (piece != ""), written(piece)).otherwise(piece)), "")


def rare_marks(text: Column) -> Column:
    """The text with what stands for the marks that most texts have none of."""
    shown = text
    for mark, written in ((PRE, "\n"), (PRE_END, "\n"), (ITEM, "\n* "), (CELL, " ")):
        shown = F.replace(shown, F.lit(mark), F.lit(written))
    return F.when(holds_any(text, PRE + PRE_END + ITEM + CELL), shown).otherwise(text)


def fold_spaces(text: Column) -> Column:
    """Runs of blanks as one space, but in preformatted text."""
    def folded(part: Column) -> Column:
        # A space alone is left as it is.
        return F.regexp_replace(part, rf"[\t\n\f\r]{BLANKS}*+| {BLANKS}++", " ")

    def around(t: Column) -> Column:
        # Other text and preformatted text in turn.
        cut = F.split(F.regexp_replace(t, KEPT_SPACE, f"{OPEN}$0{OPEN}"), OPEN, -1)
        return F.array_join(F.transform(cut, lambda part, i: F.when(
            i % 2 == 1, part).otherwise(folded(part))), "")

    return F.when(F.contains(text, F.lit(PRE)), around(text)).otherwise(folded(text))


def html_to_text(html: Column) -> Column:
    """The text of a document or a piece of one; null stays null.

    Comments, scripts, styles and the head go; what they do not close ends with the text. A
    ``>`` inside a quoted attribute ends no tag. White space counts once unless preformatted.
    """
    text = closable(unmarked(html))
    text = F.regexp_replace(text, MARKUP, f"{OPEN}$1{CLOSE}")
    text = written_tags(F.regexp_replace(text, HEAD, "$1"))
    text = let(text, lambda t: let(decode_references(t), fold_spaces))
    text = let(text, rare_marks)
    text = F.replace(text, F.lit(BREAK), F.lit("\n"))
    return collapse_newlines(strip_invisible(text))


def looks_like_html(text: Column) -> Column:
    return let(F.lower(text), lambda t: F.contains(t, F.lit(HTML_SIGNS[0])) | F.contains(
        t, F.lit(HTML_SIGNS[1])) | F.contains(t, F.lit(HTML_SIGNS[2])))


def clean_if_html(text: Column) -> Column:
    return let(text, lambda t: F.when(
        F.contains(t, F.lit("<")) & looks_like_html(t), html_to_text(t)).otherwise(t))


def truncate_body(body: Column, n: int) -> Column:
    return F.substring(body, 1, n)


def select_body(plain: Column, body: Column, html: Column, headers: Column) -> Column:
    """First that is not empty: plain text, body, cleaned HTML, transport headers."""

    def filled(c: Column) -> Column:
        return c.isNotNull() & (c != "")

    return (
        F.when(filled(plain), plain)
        .when(filled(body), body)
        .when(filled(html), html_to_text(html))
        .otherwise(F.coalesce(headers, F.lit("")))
    )


def message_body(plain: Column, body: Column, html: Column, headers: Column,
                 max_body: int | None = None) -> Column:
    """The cleaned body, whole unless a length is given. A number that the cut leaves in part
    is not found, so a length does not protect what stands at its edge."""
    whole = clean_if_html(select_body(plain, body, html, headers))
    return whole if max_body is None else truncate_body(whole, max_body)
