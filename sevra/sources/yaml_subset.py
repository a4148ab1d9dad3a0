"""The part of YAML that rubric files use: mappings and lists by indentation, scalars plain or quoted, folded texts, flow lists, comments."""

from __future__ import annotations

import json
import re

_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s"'#\-\[{][^:#]*?|-?\d+))\s*:(?:\s+(.*))?$""")
_INT = re.compile(r"[-+]?[0-9]+$")
_REAL = re.compile(r"[-+]?[0-9]+[.][0-9]+$")
_WORDS = {"true": True, "false": False, "null": None, "~": None, "": None}


class YamlError(ValueError):
    """What is wrong, in which file and line."""


def _scalar(text: str, fail):
    text = text.strip()
    if text[:1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            fail("a quoted text that doesn't end")
    if text[:1] == "'":
        if len(text) < 2 or not text.endswith("'") or text[1:-1].replace("''", "").count("'"):
            fail("a quoted text that doesn't end")
        return text[1:-1].replace("''", "'")
    if text[:1] == "[":
        if not text.endswith("]"):
            fail("a list that doesn't end")
        return [_scalar(x, fail) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+?)\s*(?:,|$)""", text[1:-1])]
    if text[:1] in ("{", "&", "*", "!", "%", "@", "`"):
        fail(f"{text[0]!r} is outside of what rubric files use")
    if text in _WORDS:
        return _WORDS[text]
    return int(text) if _INT.match(text) else float(text) if _REAL.match(text) else text


def _without_comment(line: str) -> str:
    """A line up to a # that stands at its start or after white space, and not in a quoted text."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _lines(text: str, name: str) -> list[tuple[int, int, str]]:
    """(number, indentation, text) of the lines that are not blank or comments."""
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        body = _without_comment(line).rstrip()
        if body.strip() and body.strip() not in ("---", "..."):
            indent = len(body) - len(body.lstrip())
            if "\t" in body[:indent]:
                raise YamlError(f"{name}, line {number}: a tab in the indentation")
            out.append((number, indent, body.strip()))
    return out


def parsed_yaml(text: str, name: str = "yaml"):
    """What a text says, as dicts, lists and scalars; keys are text. An error names the file and the line."""
    lines, at = _lines(text, name), 0

    def fail(what: str, number: int | None = None):
        raise YamlError(f"{name}, line {number or lines[min(at, len(lines) - 1)][0]}: {what}")

    def folded(indent: int, sep: str) -> str:
        nonlocal at
        parts = []
        while at < len(lines) and lines[at][1] > indent:
            parts.append(lines[at][2])
            at += 1
        return sep.join(parts)

    def value(rest: str | None, indent: int):
        nonlocal at
        if rest in (">", ">-", "|", "|-"):
            return folded(indent, " " if rest[0] == ">" else "\n")
        if rest:
            out = _scalar(rest, lambda what: fail(what, lines[at - 1][0]))
            if at < len(lines) and lines[at][1] > indent:
                fail("more indented than what it belongs to")
            return out
        if at < len(lines) and (lines[at][1] > indent or lines[at][1] == indent and lines[at][2].startswith("- ")):
            return block(lines[at][1])
        return None

    def block(indent: int):
        nonlocal at
        is_list = lines[at][2].startswith("- ")
        out = [] if is_list else {}
        while at < len(lines) and lines[at][1] >= indent:
            number, deep, line = lines[at]
            if deep != indent:
                fail("bad indentation", number)
            if line.startswith("- ") != is_list:
                if is_list:
                    break
                fail("a list item among keys", number)
            at += 1
            if is_list:
                out.append(value(line[2:].strip(), indent))
                continue
            m = _KEY.match(line)
            if not m:
                fail("neither a key nor a list item", number)
            key = str(_scalar(f'"{m[1]}"', fail)) if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[3].strip()
            if key in out:
                fail(f"the key {key!r} twice", number)
            out[key] = value(m[4], indent)
        return out

    if not lines:
        return {}
    out = block(lines[0][1])
    if at < len(lines):
        fail("bad indentation")
    return out


def as_json(text: str, name: str = "yaml") -> str:
    """A rubric's text as JSON, whether it is JSON (which starts with a brace) or YAML."""
    return text if text.lstrip("\ufeff \t\r\n").startswith("{") else json.dumps(parsed_yaml(text, name))
