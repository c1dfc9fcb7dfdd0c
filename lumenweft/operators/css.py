"""The text of style sheets: rules, declarations of backgrounds, selectors.

@media all and screen, @supports and @layer groups hold, other at-rules do not (layers count by place). A selector with
pseudo-classes other than :root, with pseudo-elements or of no known form names nothing; rules nested in rules are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

def best_background(inner: str) -> str | None:
    """The candidate of an image-set with the highest resolution, the last of as high ones."""
    best, top = None, -1.0
    for m in re.finditer(r"""(?:url\(\s*(['"]?)(.*?)\1\s*\)|(['"])(.*?)\3)(?:\s*([\d.]+)\s*(?:x|dppx))?""", inner, re.I):
        found = m[2] or m[4]
        if found:
            res = float(m[5] or 1) or 1.0
            if res >= top:
                best, top = found, res
    return best


def backgrounds(value: str | None) -> list[str]:
    """URLs of a background-image: the best of each image-set, then the plain layers. Parentheses are balanced."""
    sets, plain, at, value = [], [], 0, value or ""
    for m in re.finditer(r"(?:-webkit-)?image-set\(", value, re.I):
        if m.start() < at:
            continue
        plain.append(value[at : m.start()])
        depth, i = 1, m.end()
        while i < len(value) and depth:
            depth += {"(": 1, ")": -1}.get(value[i], 0)
            i += 1
        sets.append(best_background(value[m.end() : i - (depth == 0)]))
        at = i
    plain.append(value[at:])
    return [s for s in sets if s] + [m[2] for p in plain for m in re.finditer(r"""url\(\s*(['"]?)(.*?)\1\s*\)""", p) if m[2]]


_STRING = r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'"
_COMMENT = re.compile(rf"({_STRING})|/\*.*?(?:\*/|\Z)", re.S)
_TOKEN = re.compile(rf"""{_STRING}|(?i:url)\(\s*[^"'\s)][^)]*\)|[{{}};]|\\.|[^"'{{}};\\uU]+|.""", re.S)
_GROUPS = re.compile(r"@(?:supports|layer)\b", re.I)


def applies(media: str | None) -> bool:
    """Whether a list of media holds for a screen of unknown size."""
    return not (media or "").strip() or any(re.fullmatch(r"(?i)(?:only\s+)?(?:all|screen)", m.strip()) for m in media.split(","))


def rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold, in order. What is left open ends with the sheet."""
    css = _COMMENT.sub(lambda m: m[1] or " ", css.replace("<!--", " ").replace("-->", " "))
    blocks: list[list] = []  # kind (group, rule, skip), selectors, pieces
    held: list[str] = []
    for m in _TOKEN.finditer(css):
        token = m[0]
        inside = blocks[-1][0] if blocks else "group"
        if token == "{":
            head, held = "".join(held).strip(), []
            if inside == "group" and head[:1] != "@":
                blocks.append(["rule", head, []])
            elif inside == "group" and head[:1] == "@" and (_GROUPS.match(head) or (head[:6].lower() == "@media" and applies(head[6:]))):
                blocks.append(["group", "", []])
            else:
                blocks.append(["skip", "", []])
        elif token == "}":
            if blocks:
                kind, head, pieces = blocks.pop()
                if kind == "rule":
                    yield head, "".join([*pieces, *held])
            held = []
        elif token == ";":
            if inside == "rule":
                blocks[-1][2] += [*held, ";"]
            held = []
        else:
            held.append(token)
    for kind, head, pieces in reversed(blocks):
        if kind == "rule":
            yield head, "".join([*pieces, *held])


def declared(text: str) -> list[tuple[bool, list[str]]]:
    """(important, addresses) of the declarations of a background image or of a whole background, in order."""
    out, held = [], []
    for token in [*(m[0] for m in _TOKEN.finditer(_COMMENT.sub(lambda m: m[1] or " ", text))), ";"]:
        if token != ";":
            held.append(token)
            continue
        name, _, value = "".join(held).partition(":")
        held = []
        if name.strip().lower() in ("background", "background-image") and value.strip():
            plain = re.sub(r"(?i)!\s*important\s*$", "", value.strip())
            out.append((plain != value.strip(), backgrounds(plain)))
    return out


_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\.)+"
_PART = re.compile(
    rf"""(?P<comb>\s*[>+~]\s*|\s+)|(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|(?P<root>:root(?![\w(-]))
    |\[\s*(?P<name>{_NAME})\s*(?:(?P<how>[~|^$*]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s\]"']+))\s*)?\]""",
    re.X,
)


def _plain(name: str) -> str:
    """A name without its escapes."""
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", lambda m: chr(min(int(m[1], 16), 0x10FFFF)) if m[1] else m[2], name)


def selector(text: str) -> tuple[tuple[int, int, int], list[dict]] | None:
    """Specificity and compounds of one selector; None where it has parts that no element of a stored page can be told to have."""
    parts, at, fresh = [dict(comb="", tag=None, id=None, classes=[], tests=[])], 0, True
    ids = classes = tags = 0
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if m is None:
            return None
        at, part = m.end(), parts[-1]
        if m["comb"] is not None:
            if fresh:
                return None
            parts.append(dict(comb=m["comb"].strip() or " ", tag=None, id=None, classes=[], tests=[]))
            fresh = True
            continue
        if m["tag"] is not None:
            if not fresh:
                return None
            if m["tag"] != "*":
                part["tag"], tags = _plain(m["tag"]).lower(), tags + 1
        elif m["id"] is not None:
            ids += 1
            if part["id"] not in (None, _plain(m["id"])):
                return None
            part["id"] = _plain(m["id"])
        elif m["cls"] is not None:
            part["classes"].append(_plain(m["cls"]))
            classes += 1
        else:
            classes += 1
            test = ("", "root", "") if m["root"] else (_plain(m["name"]).lower(), m["how"] or "has", next((m[g] for g in "abc" if m[g] is not None), ""))
            part["tests"].append(dict(zip(("name", "how", "value"), test, strict=True)))
        fresh = False
    if fresh:
        return None
    for part in parts:
        part["key"] = f"#{part['id']}" if part["id"] else f".{part['classes'][0]}" if part["classes"] else part["tag"] or "*"
    return (ids, classes, tags), parts


def listed(text: str) -> list[str]:
    """The selectors of a list; commas in brackets, parentheses and strings part nothing."""
    out, depth, held = [], 0, []
    for m in re.finditer(rf"{_STRING}|\\.|.", text, re.S):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(m[0], 0)
        if m[0] == "," and depth <= 0:
            out.append("".join(held))
            held = []
        else:
            held.append(m[0])
    return [*out, "".join(held)]


def named_keys(css: str) -> set[str]:
    """The keys of all compounds of the selectors that declare backgrounds."""
    return {p["key"] for heads, body in rules(css) if declared(body) for s in map(selector, listed(heads)) if s is not None for p in s[1]}


def element_keys(tag: str, attrs: dict[str, str]) -> list[str]:
    """The keys by which a compound may name an element: #id, .class, tag and *."""
    return [*(f"#{i}" for i in [attrs.get("id")] if i), *dict.fromkeys(f".{c}" for c in re.split(r"[ \t\n\f\r]+", attrs.get("class", "")) if c), tag, "*"]
