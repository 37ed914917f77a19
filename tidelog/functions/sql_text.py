"""Statement texts: split, with literals as variables, with the directives of their comments."""

from __future__ import annotations

import re

_PIECE = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|\#[^\n]*|/\*.*?\*/|;|[^'"`\-\#/;]+|.""", re.S)


def statements(text: str) -> list[str]:
    """The statements of a text; semicolons in quotes and comments part nothing, empty ones are left out."""
    out = [""]
    for piece in _PIECE.findall(text):
        if piece == ";":
            out.append("")
        else:
            out[-1] += piece
    return [s.strip() for s in out if re.sub(r"--[^\n]*|#[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()]


def normalized(sql: str, prefix: str = "v") -> tuple[str, dict[str, object]]:
    """(template, variables): literals become variables, equal ones the same, IN lists one list each."""
    values: dict[str, object] = {}
    names: dict[tuple, str] = {}

    def name_of(value: object) -> str:
        key = (type(value), str(value))
        if key not in names:
            names[key] = f"{prefix}{len(names) + 1}"
            values[names[key]] = value
        return names[key]

    def literal(text: str) -> object:
        if text[0] in "'\"":
            q = text[0]
            return re.sub(r"\\(.)", r"\1", text[1:-1].replace(q * 2, q))
        return float(text) if re.search(r"[.eE]", text) else int(text)

    item = r"""(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|(?<![\w`.:])\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w`]))"""
    lists = re.compile(rf"(\bin\s*)\(\s*({item}(?:\s*,\s*{item})*)\s*\)", re.I)
    sql = lists.sub(lambda m: f"{m[1]}::{name_of([literal(x) for x in re.findall(item, m[2])])}", sql)
    sql = re.sub(rf"`(?:[^`]|``)*`|(?<!:):{{1,2}}\w+|{item}", lambda m: m[0] if m[0][0] in "`:" else f":{name_of(literal(m[0]))}", sql)
    return sql, values


def directives(sql: str) -> dict[str, object]:
    """`/*vt+ A=1 B */`-style directives of the comment behind a statement's first word."""
    m = re.match(r"\s*\w+\s*/\*\w*\+(.*?)\*/", sql, re.S)
    out: dict[str, object] = {}
    for part in (m[1].split() if m else ()):
        name, _, value = part.partition("=")
        out[name] = True if not value else int(value) if re.fullmatch(r"-?\d+", value) else {"true": True, "false": False}.get(value.lower(), value)
    return out


def probe(select: str) -> str:
    """A select that has the statement's columns and no rows."""
    return f"select * from ({select}) t where 1 != 1"
