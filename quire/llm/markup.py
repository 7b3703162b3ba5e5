"""Tags of web pages, by one scan whose time grows with the page's length."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_TAG = re.compile(
    r"""<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>"""
)
_PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>")  # looks at no quotes
RAW = {
    tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in ("script", "style", "noscript", "template", "svg", "textarea", "iframe")
}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_BEYOND = re.compile(r"&#[0-9]{8,};?")  # no character has such a number

_BROKEN_TAGS = 16  # tags without an end that are looked for up to the page's end


def decoded(text: str) -> str:
    """``text`` with its character references replaced, numbers of any length among them."""
    if "&#" in text:
        text = _BEYOND.sub("\ufffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


def attributes(rest: str) -> dict[str, str]:
    """Names in lower case and decoded values of a tag's attributes; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), decoded("".join(values)))
    return found


def tags_of(source: str) -> Iterator[tuple[str, str, bool, str]]:
    """text before, tag in lower case, whether it ends an element, and its attributes as written.

    Comments, declarations and the end of the page come with an empty tag. What scripts, styles and the like hold does not
    come at all. A tag that never ends is text; a quoted value may hold ``>``, unless its quote is never closed.
    """
    last, broken, text, at = source.rfind(">"), 0, 0, 0
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            found = source.find("-->", at + 4)
            end = found + 3 if found >= 0 else len(source)
            yield source[text:at], "", False, ""
            text = at = end
            continue
        if at > last:  # nothing ends any more but a comment
            at = source.find("<!--", at)
            if at < 0:
                break
            continue
        if source[at + 1] in "!?":
            yield source[text:at], "", False, ""
            text = at = source.index(">", at) + 1
            continue
        found = _TAG.match(source, at) if broken < _BROKEN_TAGS else None
        if found is None:
            found = _PLAIN_TAG.match(source, at)
            broken += found is not None
        if found is None:
            at += 1
            continue
        before, tag, ends = source[text:at], found["tag"].lower(), found["end"] != ""
        text = at = found.end()
        if tag in RAW and not ends:
            closing = RAW[tag].search(source, source.index(">", found.start()))
            text = at = closing.end() if closing else len(source)
        yield before, tag, ends, found["rest"]
    if text < len(source):
        yield source[text:], "", False, ""
