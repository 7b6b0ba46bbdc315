"""Column functions on text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything a Unicode-aware strip removes; SQL trim would take spaces only.
WHITE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
         r"\x{205f}\x{3000}]")
REPLACEMENT = "\ufffd"
# While bad bytes are being dropped, genuine replacement characters are written as this escape
# with a 1 behind it, and the escape itself with a 0, so that no text can be mistaken.
ESCAPE = "\ue000"


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def rtrim_white(text: Column) -> Column:
    return F.regexp_replace(text, f"{WHITE}+$", "")


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def unix_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF, as universal-newline reading does."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def any_newlines(text: Column) -> Column:
    """Every line terminator of the Unicode set becomes LF; plain LF text passes untouched."""
    # Plain searches for bytes; a character class would decode and walk every text.
    exotic = text.contains("\r")
    for terminator in ("\x0b", "\x0c", "\x85", "\u2028", "\u2029"):
        exotic = exotic | text.contains(terminator)
    return F.when(exotic, F.regexp_replace(text, r"\R", "\n")).otherwise(text)


def file_lines(text: Column) -> Column:
    """Lines of a text, keeping a trailing empty one."""
    return F.split(text, "\n", -1)


def read_lines(text: Column) -> Column:
    """Lines without the empty one after a final newline (and none for an empty text)."""
    parts = F.split(text, "\n", -1)
    whole = F.when(text.endswith("\n") | (text == ""), F.lit(1)).otherwise(F.lit(0))
    return F.slice(parts, F.lit(1), F.size(parts) - whole)


def decode_replacing(data: Column) -> Column:
    """UTF-8 text of a binary column, bad bytes as U+FFFD, newlines unified."""
    return unix_newlines(F.make_valid_utf8(data.cast("string")))


def decode_dropping(data: Column) -> Column:
    """UTF-8 text of a binary column without its bad bytes; real U+FFFD characters stay."""
    mark, none = F.lit(REPLACEMENT), F.lit("")
    own, kept = F.lit(ESCAPE + "0"), F.lit(ESCAPE + "1")
    raw = F.replace(F.replace(data.cast("string"), F.lit(ESCAPE), own), mark, kept)
    clean = F.replace(F.make_valid_utf8(raw), mark, none)
    return unix_newlines(F.replace(F.replace(clean, kept, mark), own, F.lit(ESCAPE)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(
        path
    )


def extension(path: Column) -> Column:
    """Lower-case text from the last dot of the base name, '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def suffix(path: Column) -> Column:
    """As ``extension``, but a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def below_any(path: Column, dirs: list[str]) -> Column:
    """True when a directory of the relative path has one of the names."""
    names = "|".join(d.replace(".", r"\.") for d in dirs)
    return path.rlike(rf"(^|/)({names})/")


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                          ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
