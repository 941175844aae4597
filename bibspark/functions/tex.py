"""TeX special characters of a field value: where they stand, in what context, and how to escape them.

One pass keeps a stack of groups. The context of a character is the strictest around it: URL arguments, then math, then the
argument of a command, then plain text. Escaped characters and verbatim commands are passed over.
"""

from __future__ import annotations

# Specials and their replacements, and the commands with raw or verbatim arguments.
REPLACEMENTS = {"%": r"\%", "&": r"\&", "#": r"\#", "_": r"\_", "^": r"\textasciicircum{}", "$": r"\$"}
URL_COMMANDS = {"url", "nolinkurl", "path"}
VERBATIM = {"verb", "Verb", "lstinline"}
MATH_OPEN, MATH_CLOSE = {"(": ")", "[": "]"}, {")", "]"}
PLAIN, COMMAND, MATH, URL = _STRICT = ["plain", "command", "math", "url"]


def specials(text: str) -> list[tuple[int, str, str]]:
    """(index, character, context) of every unescaped special; a closed "$...$" pair counts as delimiters, a lone one as a special."""
    found: list[tuple[int, str, str]] = []
    groups: list[tuple[str, str]] = []  # of each open brace: what it brings itself, and the strictest context inside it
    dollar: tuple[int, int, int] | None = None  # place, depth and number of finds of an open $
    control: int | None = None  # depth of an open \( or \[
    pending: str | None = None  # context of a brace that follows a command
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            j = i + 1
            while j < n and (text[j].isascii() and text[j].isalpha() or text[j] == "@"):
                j += 1
            name = text[i + 1 : j]
            if not name:
                mark = text[i + 1 : i + 2]
                if mark in MATH_OPEN and control is None and dollar is None:
                    control = len(groups)
                elif mark in MATH_CLOSE and control == len(groups):
                    control = None
                i, pending = i + 2, None
                continue
            if name in VERBATIM and j < n and not text[j].isspace():
                start = j + (text[j] == "*")
                end = text.find(text[start], start + 1) if start < n else -1
                line = text.find("\n", start)
                if end >= 0 and (line < 0 or end < line):
                    i, pending = end + 1, None
                    continue
            pending = URL if name in URL_COMMANDS else MATH if name == "ensuremath" else COMMAND
            i = j
            continue
        if c == "{":
            own, around = pending or PLAIN, groups[-1][1] if groups else PLAIN
            groups.append((own, max(own, around, key=_STRICT.index)))
            pending = None
        elif c == "}":
            closed = groups.pop()[0] if groups else PLAIN
            pending = COMMAND if closed == COMMAND else None
            if dollar is not None and len(groups) < dollar[1]:
                found.insert(dollar[2], (dollar[0], "$", _context(groups, False)))
                dollar = None
            if control is not None and len(groups) < control:
                control = None
        elif c == "$" and not (groups and groups[-1][1] == URL):
            if dollar is not None and dollar[1] == len(groups):
                # what lies between was math
                found[dollar[2] :] = [(p, s, MATH if x in (PLAIN, COMMAND) else x) for p, s, x in found[dollar[2] :]]
                dollar = None
            elif dollar is None and control is None:
                dollar = (i, len(groups), len(found))
            else:
                found.append((i, c, MATH))
            pending = None
        elif c in REPLACEMENTS:
            found.append((i, c, _context(groups, control is not None)))
            pending = None
        elif not c.isspace() and c != "*":
            pending = None
        i += 1
    if dollar is not None:
        found.insert(dollar[2], (dollar[0], "$", _context(groups, False)))
    return found


def _context(groups: list[tuple[str, str]], math: bool) -> str:
    inside = groups[-1][1] if groups else PLAIN
    return MATH if math and inside != URL else inside


def verdict(char: str, context: str) -> str:
    """safe (can be escaped), review or ignore."""
    if context == URL:
        return "ignore"
    if context == MATH:
        return "review" if char in "%#$" else "ignore"
    return "review" if context == COMMAND or char in "^$" else "safe"


def escaped(text: str) -> str:
    """`text` for export: % and # escaped everywhere but in URLs, & and _ and ^ not in math, a lone $ always; white space in one line."""
    out, at = [], 0
    for i, c, context in specials(text):
        if context == URL or (context == MATH and c in "&_^"):
            continue
        out += [text[at:i], REPLACEMENTS[c]]
        at = i + 1
    joined = "".join([*out, text[at:]]).replace("\r", "")
    return " ".join(joined.replace("\n", " ").replace("\t", " ").split(" ")) if "\n" not in joined and "\t" not in joined else " ".join(joined.split())
