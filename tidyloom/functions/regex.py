"""Python regular expressions and replacements in Java's dialect.

Rules are written with Python's ``re`` in mind; Spark runs ``java.util.regex``.
Translated: Unicode classes and line ends by the flags (?dU), ``\\s`` and ``\\S``
with the four separators that Python counts as white space, ``\\Z``, named groups
and back-references, nested ``[`` inside classes, and ``\\1`` or ``\\g<1>`` in
replacements. What Java can't say (conditional groups) is refused, as is what
Python itself refuses (flags that are not at the start).
"""

from __future__ import annotations

import re

SPACES = r"\s\x1c-\x1f"
FLAGS = re.compile(r"\(\?([aiLmsux]+)\)")
JAVA_FLAGS = {"i": "iu", "m": "m", "s": "s", "x": "x", "u": "", "a": ""}


class UnsupportedPattern(ValueError):
    pass


def _group_name(name: str) -> str:
    return "".join(c if c.isalnum() else f"U{ord(c):x}" for c in name)


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise UnsupportedPattern(f"not a pattern: {e}") from e
    flags, unicode_classes = {"d"}, True
    if m := FLAGS.match(pattern):
        if "L" in m[1]:
            raise UnsupportedPattern("locale flag")
        unicode_classes = "a" not in m[1]
        for f in m[1]:
            flags.update(JAVA_FLAGS[f])
        pattern = pattern[m.end() :]
    if ignore_case:
        flags.update("iu")
    if unicode_classes:
        flags.add("U")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            c2 = pattern[i + 1]
            i += 2
            if c2 == "Z":
                out.append(r"\z")
            elif c2 == "s":
                out.append(SPACES if in_class else f"[{SPACES}]")
            elif c2 == "S":
                if in_class:
                    out.append(rf"&&[^{SPACES}]") if out[-1] == "[" else out.append(r"\S")
                else:
                    out.append(f"[^{SPACES}]")
            else:
                out.append("\\" + c2)
        elif in_class:
            if c == "]" and pattern[i - 1 : i] != "[" and not pattern[: i].endswith("[^"):
                in_class = False
                out.append(c)
            else:
                out.append("\\" + c if c in "[&]" else c)
            i += 1
        elif c == "[":
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
        elif pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            out.append(f"(?<{_group_name(pattern[i + 4 : end])}>")
            i = end + 1
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"\k<{_group_name(pattern[i + 4 : end])}>")
            i = end + 1
        elif pattern.startswith("(?(", i):
            raise UnsupportedPattern("conditional group")
        elif pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
        else:
            out.append(c)
            i += 1
    return f"(?{''.join(sorted(flags))})" + "".join(out)


def java_replacement(replacement: str) -> str:
    out, i = [], 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\" and i + 1 < len(replacement):
            if m := re.match(r"\\g<(\w+)>", replacement[i:]):
                out.append("$" + m[1] if m[1].isdigit() else f"${{{_group_name(m[1])}}}")
                i += m.end()
                continue
            if m := re.match(r"\\([1-9]\d?)", replacement[i:]):
                out.append(f"${m[1]}")
                i += m.end()
                if replacement[i : i + 1].isdigit():
                    out.append("\\" + replacement[i])  # Java would read it as part of the number
                    i += 1
                continue
            escaped = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "\\": "\\\\"}.get(replacement[i + 1])
            if escaped is None and replacement[i + 1].isalnum():
                raise UnsupportedPattern(f"escape \\{replacement[i + 1]} in a replacement")
            out.append(escaped if escaped is not None else "\\\\" + ("\\$" if replacement[i + 1] == "$" else replacement[i + 1]))
            i += 2
        elif c in "$\\":
            out.append("\\" + c)
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def search(pattern: str, ignore_case: bool = False) -> str:
    return java_pattern(pattern, ignore_case)


def _anchored(pattern: str, ignore_case: bool, end: str) -> str:
    java = java_pattern(pattern, ignore_case)
    close = java.index(")") + 1
    return f"{java[:close]}\\A(?:{java[close:]}){end}"


def match(pattern: str, ignore_case: bool = False) -> str:
    return _anchored(pattern, ignore_case, "")


def fullmatch(pattern: str, ignore_case: bool = False) -> str:
    return _anchored(pattern, ignore_case, r"\z")
