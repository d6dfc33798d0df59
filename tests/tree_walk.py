"""Text of a page by walking its elements with the standard library's parser:
the independent version that the column expressions are held to."""

import re
from html.parser import HTMLParser

from sitelens.functions.html import DROPPED_ELEMENTS, INVISIBLE_ELEMENTS, VOID_ELEMENTS


class _Walk(HTMLParser):
    def __init__(self, visible):
        super().__init__(convert_charrefs=True)
        self.visible, self.open, self.parts = visible, [], []
        self.dropped = set(DROPPED_ELEMENTS) | (set(INVISIBLE_ELEMENTS) if visible else set())

    def handle_starttag(self, tag, attrs):
        if tag not in VOID_ELEMENTS:
            a = dict(attrs)
            hidden = self.visible and (re.search(r"display\s*:\s*none", a.get("style") or "", re.I)
                                       or re.search("hidden", a.get("class") or "", re.I))
            self.open.append((tag, bool(hidden) or tag in self.dropped))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag):]

    def handle_data(self, data):
        if not any(gone for _, gone in self.open):
            self.parts.append(data)


def extract_text(html, visible_only=False):
    walk = _Walk(visible_only)
    walk.feed(html or "")
    walk.close()
    return " ".join("".join(walk.parts).split())
