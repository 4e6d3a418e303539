"""Small glob language of the project rules, compiled once to a regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\{(?P<options>[^}]*)\}|(?P<text>[^{]+|\{)", re.S)
FLAGS = "(?s)"
_WILD = {"*": "[^/]*", "?": "[^/]"}
_PLAIN = re.compile(r"[*?]|[^*?]+")


def _quote(char: str) -> str:
    return char if char.isalnum() or char == "_" or ord(char) > 127 else "\\" + char


def _words(text: str) -> str:
    # Case is ignored in what is spelled out only: a wildcard that ignores it folds every character it passes.
    return "".join(_WILD.get(part) or f"(?iu:{''.join(map(_quote, part))})" for part in _PLAIN.findall(text))


def glob_to_regex(glob: str) -> str:
    """Whole-string, case-insensitive Java regex for ``glob``.

    ``*`` any run without a slash, ``?`` one such character, ``{a,b}``
    alternatives (blanks around each are ignored); an unclosed brace is literal.
    """
    out = []
    for token in _TOKEN.finditer(glob):
        if token["options"] is None:
            out.append(_words(token["text"]))
        else:
            out.append("(?:" + "|".join(_words(o.strip()) for o in token["options"].split(",")) + ")")
    return FLAGS + r"\A" + "".join(out) + r"\z"


def glob_in_path(glob: str) -> str:
    """Java regex that holds in a path where a whole folder name like ``glob`` starts."""
    body = glob_to_regex(glob).removeprefix(FLAGS + r"\A").removesuffix(r"\z")
    # No name holds a slash.
    return "(?=" + body.replace(r"\/", "(?!)") + "/)"


def glob_match(column, glob: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.rlike(glob_to_regex(glob))
