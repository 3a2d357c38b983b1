"""What a reader sees of a raw e-mail, and where each character of it stands in the raw text.

Headers, plain, quoted-printable and HTML bodies become text; base64 bodies, encoded header words and the values of
identifier headers don't. A view keeps its pieces as (start in the view, start in the raw text, length in the raw
text), so a place found in the view can be replaced in the raw text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

#: Header lines whose values are identifiers of messages and parts, not of people.
IDENTIFIERS = re.compile(r"^(?:Message-ID|In-Reply-To|References|Content-ID)[ \t]*:[^\n]*(?:\n[ \t][^\n]*)*", re.I | re.M)
ENCODED_WORD = re.compile(r"=\?[^?\s]+\?[bBqQ]\?[^?\s]*\?=")
HEADER_LINE = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
BLANK_LINE = re.compile(r"\r?\n[ \t]*\r?\n")
BOUNDARY = re.compile(r"boundary=\"?([^\"\s;]+)", re.I)
ENCODING = re.compile(r"^Content-Transfer-Encoding:[ \t]*([\w-]+)", re.I | re.M)
KIND = re.compile(r"^Content-Type:[ \t]*([\w./+-]+)(?:[^\n]*?charset=\"?([\w-]+))?", re.I | re.M)
SOFT = re.compile(r"=[ \t]*\r?\n|(?:=[0-9A-Fa-f]{2})+")
MARKUP = re.compile(r"<!--.*?-->|<(?:style|script)\b.*?</(?:style|script)>|</?[A-Za-z][^<>]*>|&#?\w+;", re.I | re.S)
BLOCK = re.compile(r"</?(?:p|div|br|tr|li|h\d|table|body|html|blockquote)\b", re.I)


class View:
    """Visible text with its pieces."""

    __slots__ = ("chunks", "starts", "raws", "lengths", "size", "text")

    def __init__(self) -> None:
        self.chunks: list[str] = []
        self.starts: list[int] = []
        self.raws: list[int] = []
        self.lengths: list[int] = []
        self.size = 0
        self.text = ""

    def add(self, shown: str, raw: int, length: int) -> None:
        if shown:
            self.chunks.append(shown)
            self.starts.append(self.size)
            self.raws.append(raw)
            self.lengths.append(length)
            self.size += len(shown)

    def close(self) -> View:
        self.text = "".join(self.chunks)
        return self

    def raw_span(self, start: int, end: int) -> tuple[int, int]:
        """The raw stretch that shows as ``text[start:end]``."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        first = self.raws[i] + (start - self.starts[i] if len(self.chunks[i]) == self.lengths[i] else 0)
        last = self.raws[j] + (end - self.starts[j] if len(self.chunks[j]) == self.lengths[j] else self.lengths[j])
        return first, last


def _without(view: View, text: str, start: int, end: int, pattern: re.Pattern) -> None:
    at = start
    for m in pattern.finditer(text, start, end):
        view.add(text[at : m.start()], at, m.start() - at)
        view.add("\n", m.start(), 0)
        at = m.end()
    view.add(text[at:end], at, end - at)


def _decoded(escaped: str, charset: str) -> str:
    data = bytes.fromhex(escaped.replace("=", ""))
    for name in (charset or "utf-8", "latin-1"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    return ""


def _body(view: View, text: str, start: int, end: int, encoding: str, kind: str, charset: str) -> None:
    if encoding == "base64":
        return
    pieces = [(text[start:end], start, end - start)]
    if encoding == "quoted-printable" and "=" in pieces[0][0]:
        pieces, at = [], start
        for m in SOFT.finditer(text, start, end):
            pieces.append((text[at : m.start()], at, m.start() - at))
            if m[0][1:2] not in " \t\r\n":
                pieces.append((_decoded(m[0], charset), m.start(), len(m[0])))
            at = m.end()
        pieces.append((text[at:end], at, end - at))
    if kind != "text/html":
        for p in pieces:
            view.add(*p)
        return
    inner = View()
    for p in pieces:
        inner.add(*p)
    shown, at = inner.close().text, 0

    def copy(a: int, b: int) -> None:
        while a < b:
            i = bisect_right(inner.starts, a) - 1
            stop = min(b, inner.starts[i] + len(inner.chunks[i]))
            first, last = inner.raw_span(a, stop)
            view.add(shown[a:stop], first, last - first)
            a = stop

    for m in MARKUP.finditer(shown):
        copy(at, m.start())
        if m[0][0] == "&":
            first, last = inner.raw_span(m.start(), m.end())
            view.add(html.unescape(m[0]), first, last - first)
        elif BLOCK.match(m[0]) and shown[m.end() : m.end() + 1] not in ("\n", "\r"):
            view.add("\n", inner.raw_span(m.start(), m.end())[0], 0)
        at = m.end()
    copy(at, len(shown))


def _entity(view: View, text: str, start: int, end: int) -> None:
    """A message or a part: headers, then a body."""
    head_end = start
    if HEADER_LINE.match(text, start):
        m = BLANK_LINE.search(text, start, end)
        head_end = m.start() if m else end
    head = text[start:head_end]
    if head:
        at = start
        for m in IDENTIFIERS.finditer(text, start, head_end):
            _without(view, text, at, m.start(), ENCODED_WORD)
            view.add("\n", m.start(), 0)
            at = m.end()
        _without(view, text, at, head_end, ENCODED_WORD)
    if head_end >= end:
        return
    encoding, kind = ENCODING.search(head), KIND.search(head)
    name = kind[1].lower() if kind else "text/plain"
    if not head and start and not kind:
        name = "text/plain"
    if name.startswith(("text/", "multipart/", "message/")):
        _body(view, text, head_end, end, encoding[1].lower() if encoding else "", name, (kind[2] or "") if kind else "")


def visible(text: str) -> View:
    view = View()
    cuts = []
    if "oundary=" in text:
        for name in dict.fromkeys(BOUNDARY.findall(text)):
            mark, at = "--" + name, 0
            while (at := text.find(mark, at)) >= 0:
                if at == 0 or text[at - 1] == "\n":
                    stop = text.find("\n", at)
                    stop = len(text) if stop < 0 else stop + 1
                    if text[at + len(mark) : stop].strip() in ("", "--"):
                        cuts.append((at, stop))
                at += len(mark)
        cuts.sort()
    at = 0
    for start, stop in [*cuts, (len(text), len(text))]:
        if start > at:
            _entity(view, text, at, start)
            view.add("\n\n", start, 0)
        at = max(at, stop)
    return view.close()
