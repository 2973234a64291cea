"""Rule patterns are written in the RE2 dialect; Spark runs java.util.regex.

The two differ in ways that leak data silently: ``\\b`` and ``\\s`` cover other
characters, ``$`` also matches before a final newline, ``.`` stops at more line
ends, and ``(?i)`` folds ASCII only.
"""

from __future__ import annotations

import re

from pyspark import SparkContext

ASCII_BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
NOT_BOUNDARY = r"(?:(?<!\w)(?!\w)|(?<=\w)(?=\w))"
_GROUP = re.compile(r"\$\{(\w+)\}|\$(\w+)")
_FLAGS = re.compile(r"\(\?([imsU]+)(?=[:)\-])")


def spark_pattern(pattern: str) -> str:
    """Rewrite an RE2 pattern so that Java matches the same text."""
    multiline = "m" in "".join(_FLAGS.findall(pattern))
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append("\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]")
            elif nxt == "S" and not in_class:
                out.append("[^\\t\\n\\f\\r ]")
            elif nxt == "b" and not in_class:
                out.append(ASCII_BOUNDARY)
            elif nxt == "B" and not in_class:
                out.append(NOT_BOUNDARY)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            out.append("\\[" if ch == "[" and pattern[i:i + 2] != "[:" else ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            # A leading ``]`` (also after ``^``) is a literal.
            if pattern[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1:i + 2] == "]":
                out.append("\\]")
                i += 1
        elif ch == "$" and not multiline:
            out.append("\\z")
        else:
            out.append(ch)
        i += 1
    text = _FLAGS.sub(lambda m: "(?" + m.group(1).replace("i", "iu"), "".join(out))
    return "(?d)" + text


def python_regex(pattern: str) -> re.Pattern:
    """A pattern of ``spark_pattern``, or one of the built-in ones, for Python's ``re``.

    Classes stay ASCII and case folding Unicode, as in Java, which one flag of ``re`` cannot say:
    the classes are written out.
    """
    body = pattern.removeprefix("(?d)").replace("(?iu", "(?i")
    out, in_class, i = [], False, 0
    while i < len(body):
        pair = body[i:i + 2]
        if body[i] == "\\" and len(pair) == 2:
            ascii_class = {"\\d": "0-9", "\\w": "0-9A-Za-z_"}.get(pair)
            other = {"\\D": "[^0-9]", "\\W": "[^0-9A-Za-z_]", "\\z": "\\Z"}.get(pair)
            out.append((ascii_class if in_class else f"[{ascii_class}]") if ascii_class else other if other and not in_class else pair)
            i += 2
            continue
        if body[i] in "[]":
            in_class = body[i] == "["
        out.append(body[i])
        i += 1
    return re.compile("".join(out))


def spark_replacement(text: str) -> str:
    """``${1}`` and ``$1`` name groups; every other ``$`` or backslash is literal."""
    out, i, after_group = [], 0, False
    while i < len(text):
        m = _GROUP.match(text, i)
        if m:
            name = m.group(1) or m.group(2)
            # ``$1x`` names the group "1x", which no numbered pattern has: empty.
            if name.isdigit():
                out.append(f"${name}")
                after_group = True
            i = m.end()
            continue
        ch = text[i]
        out.append("\\" + ch if ch in "\\$" or (after_group and ch.isdigit()) else ch)
        after_group = False
        i += 1
    return "".join(out)


def compiles(pattern: str) -> bool:
    """Whether Java accepts the pattern; checked once on the driver at load."""
    sc = SparkContext._active_spark_context
    try:
        if sc is not None:
            sc._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern.removeprefix("(?d)").replace("(?iu", "(?i").replace("\\z", "\\Z"))
        return True
    except Exception:
        return False
