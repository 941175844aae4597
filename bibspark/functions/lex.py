"""A lossless BibTeX lexer over UTF-8 bytes.

`parse` covers the whole source with blocks in order: text, comment, string, preamble, entry, failed. All places are half-open
byte ranges. Nothing raises: what can't be read becomes a failed block up to the next line that starts with "@", with a code.
"""

from __future__ import annotations

# Codes of syntax problems.
UNCLOSED, NO_KEY, NO_EQUALS, NO_VALUE, NO_DELIMITER = "UNCLOSED", "NO_KEY", "NO_EQUALS", "NO_VALUE", "NO_DELIMITER"
MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), "January February March April May June July August September October November December".split(), strict=True))
_WS = b" \t\r\n"
_NAME_END = b" \t\r\n=,{}()\"#%"
DEPTH = 256


# Rule codes of syntax problems, by what is wrong.
RULES = {
    "other": "BIB-SYNTAX-101", "missing entry key": "BIB-SYNTAX-102", "missing field separator": "BIB-SYNTAX-103", "expected field name": "BIB-SYNTAX-104", "empty field value": "BIB-SYNTAX-105",
    "expected value atom": "BIB-SYNTAX-106", "bad field boundary": "BIB-SYNTAX-107", "bad value boundary": "BIB-SYNTAX-108", "unclosed entry": "BIB-SYNTAX-109", "unclosed braced value": "BIB-SYNTAX-110",
    "unclosed quoted value": "BIB-SYNTAX-111", "unreadable source": "BIB-SYNTAX-112",
}


class Problem(Exception):
    """What stops a block: a coarse code, the place, and what is wrong."""

    def __init__(self, code: str, at: int, wrong: str = "other"):
        self.code, self.at, self.wrong = code, at, wrong


def _skip(b: bytes, i: int) -> int:
    """Past white space and percent comments."""
    while i < len(b):
        if b[i] in _WS:
            i += 1
        elif b[i] == 0x25:
            end = b.find(b"\n", i)
            i = len(b) if end < 0 else end + 1
        else:
            break
    return i


def _group(b: bytes, i: int, close: int) -> int:
    """Place after the `close` that ends the group opened before `i`; braces nest, a backslash takes the next byte along."""
    depth = 0
    while i < len(b):
        c = b[i]
        if c == 0x5C:
            i += 2
            continue
        if c == close and depth == 0:
            return i + 1
        if c == 0x7B:
            depth += 1
        elif c == 0x7D:
            depth -= 1
            if depth < 0:
                break
        i += 1
    raise Problem(UNCLOSED, i, "unclosed quoted value" if close == 0x22 else "unclosed braced value")


def value(b: bytes, i: int) -> tuple[list[dict], int]:
    """Atoms of a value that starts at `i`, joined by #, and where it ends."""
    atoms = []
    while True:
        i = _skip(b, i)
        if i >= len(b):
            raise Problem(NO_VALUE, i, "expected value atom" if atoms else "empty field value")
        start = i
        if b[i] == 0x7B:
            i = _group(b, i + 1, 0x7D)
            atoms.append({"kind": "braced", "start": start, "end": i, "content_start": start + 1, "content_end": i - 1})
        elif b[i] == 0x22:
            i = _group(b, i + 1, 0x22)
            atoms.append({"kind": "quoted", "start": start, "end": i, "content_start": start + 1, "content_end": i - 1})
        else:
            while i < len(b) and b[i] not in _NAME_END:
                i += 1
            if i == start:
                raise Problem(NO_VALUE, i, "expected value atom" if atoms else "empty field value" if b[i] in b",})" else "expected value atom")
            word = b[start:i]
            kind = "number" if word.isdigit() else "macro" if not word[:1].isdigit() else "invalid"
            atoms.append({"kind": kind, "start": start, "end": i, "content_start": start, "content_end": i})
        after = _skip(b, i)
        if after < len(b) and b[after] == 0x23:
            i = after + 1
            continue
        return atoms, i


def _fields(b: bytes, i: int, close: int) -> tuple[list[dict], bool, int]:
    """Fields up to the closing delimiter, whether the last has a comma, and the place after the delimiter."""
    out, comma = [], True
    while True:
        i = _skip(b, i)
        if i >= len(b):
            raise Problem(UNCLOSED, i, "unclosed entry")
        if b[i] == close:
            return out, comma and bool(out), i + 1
        start = i
        while i < len(b) and b[i] not in _NAME_END:
            i += 1
        if i == start:
            raise Problem(NO_EQUALS, i, "bad value boundary" if out and not comma else "expected field name")
        name_end = i
        i = _skip(b, i)
        if i >= len(b) or b[i] != 0x3D:
            raise Problem(NO_EQUALS, i, "unclosed entry" if i >= len(b) else "bad field boundary")
        equals = i
        first = _skip(b, i + 1)
        atoms, end = value(b, first)
        out.append({"name": b[start:name_end].decode("utf-8", "replace"), "start": start, "end": end, "name_start": start, "name_end": name_end, "equals_start": equals, "value_start": first, "value_end": end, "raw": b[first:end].decode("utf-8", "replace"), "atoms": atoms})
        i = _skip(b, end)
        comma = i < len(b) and b[i] == 0x2C
        if comma:
            i += 1


def _command(b: bytes, at: int) -> tuple[dict, int]:
    """The block that starts with the "@" at `at`."""
    i = at + 1
    while i < len(b) and chr(b[i]).isalpha() and b[i] < 128:
        i += 1
    name = b[at + 1 : i].decode().lower()
    i = _skip(b, i)
    if not name or i >= len(b) or b[i] not in b"{(":
        raise Problem(NO_DELIMITER, i)
    close = 0x7D if b[i] == 0x7B else 0x29
    block = {"start": at, "entry_type": name, "delimiter": "brace" if close == 0x7D else "parenthesis", "fields": [], "trailing_comma": False, "citation_key": None}
    if name == "comment":
        end = _group(b, i + 1, close)
        return block | {"kind": "comment", "end": end}, end
    if name == "preamble":
        atoms, end = value(b, i + 1)
        end = _skip(b, end)
        if end >= len(b) or b[end] != close:
            raise Problem(UNCLOSED, end, "unclosed entry" if end >= len(b) else "bad value boundary")
        return block | {"kind": "preamble", "end": end + 1, "fields": [{"name": "", "start": i + 1, "end": end, "name_start": i + 1, "name_end": i + 1, "equals_start": i + 1, "value_start": i + 1, "value_end": end, "raw": b[i + 1 : end].decode("utf-8", "replace"), "atoms": atoms}]}, end + 1
    if name == "string":
        fields, comma, end = _fields(b, i + 1, close)
        return block | {"kind": "string", "end": end, "fields": fields, "trailing_comma": comma}, end
    key_start = i = _skip(b, i + 1)
    while i < len(b) and b[i] not in b",{}()\"=#% \t\r\n":
        i += 1
    key = b[key_start:i].decode("utf-8", "replace")
    i = _skip(b, i)
    if not key or i >= len(b) or b[i] not in (0x2C, close):
        raise Problem(NO_KEY, i, "unclosed entry" if key and i >= len(b) else "missing entry key" if not key else "bad field boundary")
    if b[i] == close:
        return block | {"kind": "entry", "end": i + 1, "citation_key": key, "key_start": key_start}, i + 1
    fields, comma, end = _fields(b, i + 1, close)
    return block | {"kind": "entry", "end": end, "citation_key": key, "key_start": key_start, "fields": fields, "trailing_comma": comma}, end


def _text(b: bytes, start: int, end: int) -> list[dict]:
    """Text between commands, with lines whose first visible character is % as comments."""
    out: list[dict] = []
    at = start
    while at < end:
        stop = b.find(b"\n", at, end)
        stop = end if stop < 0 else stop + 1
        kind = "comment" if b[at:stop].lstrip(b" \t").startswith(b"%") else "text"
        if out and out[-1]["kind"] == kind == "text":
            out[-1]["end"] = stop
        else:
            out.append({"kind": kind, "start": at, "end": stop})
        at = stop
    return out


def _in_comment(b: bytes, at: int) -> bool:
    line = b.rfind(b"\n", 0, at) + 1
    return b[line:at].lstrip(b" \t").startswith(b"%")


def parse(source: str, before: str = "") -> list[dict]:
    """The blocks of a source; macros that `before` defines, as if it stood in front, have their values here too."""
    b = source.encode("utf-8")
    blocks = cut(b)
    for block in blocks:
        if block["kind"] == "entry":
            block["comments"] = inline_comments(b, block)
    outer = before.encode("utf-8")
    return resolve(b, blocks, [(outer, cut(outer))] if outer else [])


def cut(b: bytes) -> list[dict]:
    """Blocks with their fields and atoms, nothing resolved."""
    blocks: list[dict] = []
    done = at = 0
    while True:
        at = b.find(b"@", at)
        if at < 0:
            break
        if _in_comment(b, at):
            at += 1
            continue
        try:
            block, end = _command(b, at)
        except Problem as p:
            if p.code == NO_DELIMITER:  # an "@" in running text
                at += 1
                continue
            end = b.find(b"\n@", at + 1)
            end = len(b) if end < 0 else end + 1
            block = {"kind": "failed", "start": at, "end": end, "code": p.code, "wrong": p.wrong, "at": min(p.at, end)}
        blocks += _text(b, done, at)
        blocks.append(block)
        done = at = end
    return blocks + _text(b, done, len(b))


def diagnostics(b: bytes, blocks: list[dict]) -> list[tuple[str, int, int, str]]:
    """(rule code, start, end, message) of what is wrong in the blocks of `cut`, in order of place, each once: failed blocks, and fields
    without a comma between them, which the blocks tolerate."""
    found = []
    for block in blocks:
        if block["kind"] == "failed":
            found.append((RULES[block["wrong"]], block["at"], min(block["at"] + 1, block["end"]), block["wrong"]))
        for f, g in zip(block.get("fields", []), block.get("fields", [])[1:], strict=False):
            if b[_skip(b, f["end"])] != 0x2C:
                found.append((RULES["missing field separator"], f["end"], g["start"], "missing field separator"))
    return sorted(set(found), key=lambda x: (x[1], x[2], x[0]))


#: Values kept of a macro that is defined more than once, and the longest expansion in characters.
CANDIDATES, LONGEST = 32, 1 << 20


class Macros:
    """The macros of a document. The last definition is the selected one; every definition gives candidates. Months come first.

    Each name is worked out once. A name that leads back to itself, or deeper than `DEPTH`, or grows beyond `LONGEST`, has no value.
    """

    def __init__(self, parts: list[tuple[bytes, list[dict]]]):
        self.defined, self.known = {}, {}
        for b, blocks in parts:
            for block in blocks:
                if block["kind"] == "string":
                    for f in block["fields"]:
                        self.defined.setdefault(f["name"].strip().lower(), []).append((b, f["atoms"]))

    def name(self, raw: str, depth: int) -> tuple[str | None, list[str], list[str]]:
        """(selected value, candidates, names without a value)."""
        low = raw.strip().lower()
        if low in MONTHS:
            return MONTHS[low], [MONTHS[low]], []
        if low not in self.defined or depth >= DEPTH:
            return None, [], [raw]
        if low not in self.known:
            self.known[low] = (None, [], [low])  # what a cycle finds
            found = [self.value(b, atoms, depth + 1) for b, atoms in self.defined[low]]
            every = distinct([c for _, cs, _ in found for c in cs], str.strip)
            self.known[low] = (found[-1][0], every[:CANDIDATES], distinct([u for *_, us in found for u in us]))
        return self.known[low]

    def value(self, b: bytes, atoms: list[dict], depth: int = 0) -> tuple[str | None, list[str], list[str]]:
        chosen, every, lost = "", [""], []
        for a in atoms:
            raw = b[a["content_start"] : a["content_end"]].decode("utf-8", "replace")
            if a["kind"] == "macro":
                one, some, missing = self.name(raw, depth)
                lost += missing
            else:
                one, some = (None, []) if a["kind"] == "invalid" else (raw, [raw])
            chosen = None if chosen is None or one is None or len(chosen) + len(one) > LONGEST else chosen + one
            every = [x + y for x in every for y in some if len(x) + len(y) <= LONGEST][:CANDIDATES]
        return chosen, every, distinct(lost)


def distinct(values: list[str], key=lambda x: x) -> list[str]:
    """Values once each, in order, by `key`; empty ones go."""
    return [v for v in dict.fromkeys(map(key, values)) if v]


def resolve(b: bytes, blocks: list[dict], before: list[tuple[bytes, list[dict]]]) -> list[dict]:
    """Give every field its text with macros expanded, the other values it may have, the macros without one, and names as people."""
    macros = Macros([*before, (b, blocks)])
    for block in blocks:
        for f in block.get("fields", []):
            f["resolved"], every, f["unresolved"] = macros.value(b, f["atoms"])
            f["candidates"] = distinct(every, str.strip) if any(a["kind"] == "macro" for a in f["atoms"]) else []
            if block["kind"] == "entry" and f["name"].lower() in PEOPLE_FIELDS:
                f["people"] = people(f["resolved"] or "")
    return blocks


# Fields that list people.
PEOPLE_FIELDS = ("author", "editor", "translator")


def _top_level(text: str, at_break) -> list[str]:
    """`text` cut where `at_break(i)` gives a length outside braces; a backslash takes the next character along."""
    out, start, i, depth = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c in "{}":
            depth = depth + 1 if c == "{" else max(0, depth - 1)
            i += 1
        elif depth == 0 and (n := at_break(i)):
            out.append(text[start:i].strip())
            i = start = i + n
        else:
            i += 1
    return [*out, text[start:].strip()]


_SPACE = " \t\n\r\x0c"


def people(text: str) -> list[dict]:
    """The people of a name list: cut at "and" outside braces."""

    def and_(i: int) -> int:
        return 3 if text[i : i + 3].lower() == "and" and (i == 0 or text[i - 1] in _SPACE) and (i + 3 == len(text) or text[i + 3] in _SPACE) else 0

    return [person(x) for x in _top_level(text, and_) if x]


def _upper(word: str) -> bool:
    letters = [c for c in word.lstrip("{\\") if c.isascii() and c.isalpha()]
    return bool(letters) and letters[0].isupper()


def _whole_group(text: str) -> bool:
    """Whether one pair of braces holds all of `text`."""
    if not (text.startswith("{") and text.endswith("}")):
        return False
    depth, i = 0, 0
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0 and i < len(text) - 1:
            return False
        i += 1
    return depth == 0


def person(raw: str) -> dict:
    """A name in its parts: {literal}, "family, given", "family, suffix, given" or "given prefix family"."""
    if _whole_group(raw):
        return {"raw": raw, "given": [], "prefix": [], "family": [], "suffix": [], "literal": raw[1:-1]}
    parts = _top_level(raw, lambda i: 1 if raw[i] == "," else 0)
    suffix: list[str] = []
    if len(parts) == 1:
        words = raw.split()
        capital = [i for i, w in enumerate(words) if _upper(w)]
        last = capital[-1] if capital else max(len(words) - 1, 0)
        before = [i for i in capital if i < last]
        first = before[-1] + 1 if before else 0
        given, prefix, family = words[:first], words[first:last], words[last:]
    else:
        words = parts[0].split()
        at = next((i for i, w in enumerate(words) if _upper(w)), max(len(words) - 1, 0))
        prefix, family = words[:at], words[at:]
        given = parts[2 if len(parts) > 2 else 1].split()
        suffix = parts[1].split() if len(parts) > 2 else []
    return {"raw": raw, "given": given, "prefix": prefix, "family": family, "suffix": suffix, "literal": None}


def inline_comments(b: bytes, block: dict) -> list[dict]:
    """Ranges of percent comments inside an entry: unescaped, outside its values, to the end of their lines."""
    values = [(f["value_start"], f["value_end"]) for f in block.get("fields", [])]
    out, i = [], block["start"]
    while (i := b.find(b"%", i, block["end"])) >= 0:
        inside = next((end for start, end in values if start <= i < end), None)
        slashes = len(b[block["start"] : i]) - len(b[block["start"] : i].rstrip(b"\\"))
        if inside is not None:
            i = inside
        elif slashes % 2:
            i += 1
        else:
            end = b.find(b"\n", i, block["end"])
            end = block["end"] if end < 0 else end
            out.append({"start": i, "end": end})
            i = end
    return out


def apply_edits(source: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Replace byte ranges that don't overlap and lie within the source."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        out += [source[at:start], new]
        at = end
    return b"".join([*out, source[at:]])


def edit_problem(source: bytes, edits: list[tuple[int, int, bytes]]) -> str | None:
    """Why `edits` can't be applied: out of bounds, inside a character, not UTF-8, or overlapping."""
    at = 0
    for start, end, new in sorted(edits):
        if not 0 <= start <= end <= len(source):
            return "out_of_bounds"
        if start < at:
            return "overlap"
        if any(i < len(source) and source[i] & 0xC0 == 0x80 for i in (start, end)):
            return "inside_character"
        try:
            new.decode()
        except UnicodeDecodeError:
            return "not_utf8"
        at = end
    return None
