"""Text functions that need Python: normal forms, HTML, whole-document normalisation, as Arrow-batched UDFs.

Texts that a native test shows to need no work don't travel to Python: they are sent as null and taken
from the JVM's own column afterwards.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ship
from .text import foreign

#: Tags whose content isn't seen, tags that end a line where they open and where they close.
UNSEEN = ("script", "style", "noscript")
BREAK_BEFORE = ("p", "div", "br", "li", "h1", "h2", "h3", "tr")
BREAK_AFTER = ("p", "div", "li", "h1", "h2", "h3", "tr")
TAG = r"</?[a-zA-Z][^>]*>"
#: Markers of an e-book's frame and of the boilerplate that ends an article.
BOOK_START = r"(?im)^\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\*\*\*\s*$"
BOOK_END = r"(?im)^\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\*\*\*\s*$"
BOILERPLATE = (
    r"(?im)^\s*(?:оставить комментарий|читать дальше|читайте также|похожие статьи|"
    r"поделиться|все права защищены|all rights reserved|subscribe to our newsletter)\b.*$"
)
_PHRASES = BOILERPLATE[BOILERPLATE.index("(?:") + 3 : BOILERPLATE.index(")\\b")].split("|")
#: ASCII that a document must hold for its normal form to need more than blanks and line ends (the phrases in any case).
SIGNS, FRAMES = ("<", "&"), ("all rights reserved", "subscribe to our newsletter", "project gutenberg ebook")
#: What blanks and line ends must be for a text's normal form to need more than its ends trimmed.
UNTIDY = r"[\r\x0b\x0c\x1c-\x1f]|[ \t]\n|\n\n\n"
#: White space of ASCII as Python counts it.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"

#: A reference that its semicolon ends, and an ampersand that begins none.
_ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_BARE = re.compile(f"&(?!{_ENDED.pattern[1:]})")

_BOOK_START, _BOOK_END, _BOILERPLATE, _TAG = (re.compile(p) for p in (BOOK_START, BOOK_END, BOILERPLATE, TAG))
#: What an event does: +1 and -1 change the depth of unseen content, a line end is written.
_EVENTS: dict[tuple[str, bool], int | str] = {(t, True): 1 for t in UNSEEN} | {(t, False): -1 for t in UNSEEN}
_EVENTS |= {(t, True): "\n" for t in BREAK_BEFORE} | {(t, False): "\n" for t in BREAK_AFTER}


class _Events(HTMLParser):
    """Turns tags and data into one list of events; an empty-element tag is an opening and a closing one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, bool] | str] = []
        self.handle_data = self.seen.append

    def handle_starttag(self, tag, attrs) -> None:
        self.seen.append((tag, True))

    def handle_endtag(self, tag) -> None:
        self.seen.append((tag, False))


def _resolved(reference: re.Match[str]) -> str:
    found = reference[0]
    return html.unescape(found) if found[1] == "#" or found[1:] in html5 else found


def _known(reference: re.Match[str]) -> str:
    """A reference, escaped if its name isn't one."""
    found = reference[0]
    return found if found[1] == "#" or found[1:] in html5 else f"&amp;{found[1:]}"


def unescape_ended(text: str) -> str:
    """Resolve the references that end with a semicolon; others, cut ones say, stay as they are."""
    return _ENDED.sub(_resolved, text)


def visible_text(source: str | None, ended: bool = False) -> str | None:
    """What a reader of a page sees, with line ends where block tags open and close; references are resolved once more at the end.

    `ended`: only references that end with a semicolon are resolved."""
    if source is None:
        return None
    unescape = unescape_ended if ended else html.unescape
    if not _TAG.search(source):
        return unescape(source)
    parser = _Events()
    #: The parser resolves once, whatever follows a name; escaped, what isn't to be resolved is left by it.
    parser.feed(_BARE.sub("&amp;", _ENDED.sub(_known, source)) if ended else source)
    parser.close()
    depth, out = 0, []
    for event in parser.seen:
        what = event if isinstance(event, str) else _EVENTS.get(event, "")
        if isinstance(what, int):
            depth = max(0, depth + what)
        elif not depth or isinstance(event, tuple):
            out.append(what)
    return unescape("".join(out))


def ended_text(source: str | None) -> str | None:
    return visible_text(source, ended=True)


def nfc_text(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFC", text)


def folded_text(text: str | None) -> str | None:
    """Compatibility form, case folded."""
    if text is None:
        return None
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def normal_document(text: str | None) -> str | None:
    """The whole normalisation of a document; the native path gives the same where `_needs_python` doesn't hold."""
    if text is None:
        return None
    text = visible_text(nfc_text(text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")))
    plain = text.casefold()  # finds the few texts that the patterns are worth a try for
    if "project gutenberg ebook" in plain:
        if found := _BOOK_START.search(text):
            text = text[found.end() :]
        if found := _BOOK_END.search(text):
            text = text[: found.start()]
    if any(x in plain for x in _PHRASES):
        late = int(len(text) * 0.75)
        text = text[: next((m.start() for m in _BOILERPLATE.finditer(text) if m.start() >= late), len(text))]
    text = "\n".join(line.rstrip() for line in text.splitlines())
    return nfc_text(re.sub(r"\n{3,}", "\n\n", text)).strip()


def _mapped(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())


_visible, _ended, _nfc, _folded, _document = map(_mapped, (visible_text, ended_text, nfc_text, folded_text, normal_document))


def _where(needed: Column, python, native: Column, text: Column) -> Column:
    ship(SparkSession.active())
    return F.when(needed, python(F.when(needed, text))).otherwise(native)


def _needs_python(text: Column) -> Column:
    #: Put into lower case once, in an array, for all the phrases.
    framed = F.transform(F.array(F.lower(text)), lambda low: reduce(Column.__or__, (low.contains(x) for x in FRAMES)))[0]
    return reduce(Column.__or__, (text.contains(x) for x in SIGNS), foreign(text)) | framed


def strip_html(text: Column, ended: bool = False) -> Column:
    """Visible text of an HTML column; texts without tags and references stay in the JVM.

    `ended`: only references that end with a semicolon are resolved."""
    return _where(text.rlike("<[a-zA-Z/]|&"), _ended if ended else _visible, text, text)


def nfc(text: Column) -> Column:
    """Normal form C of a text column; ASCII stays in the JVM."""
    return _where(foreign(text), _nfc, text, text)


def folded(text: Column) -> Column:
    """NFKC and case folding; ASCII stays in the JVM."""
    return _where(foreign(text), _folded, F.lower(text), text)


def dedup_key(text: Column) -> Column:
    """Folded text with single blanks for runs of white space, none at the ends."""
    return F.btrim(F.regexp_replace(folded(text), r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_text(text: Column) -> Column:
    """Byte-order mark, line ends, NFC, HTML, e-book frame, late boilerplate, blanks at line ends, runs of blank lines."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x0b\x0c\x1c-\x1e]", "\n")
    ends = F.regexp_replace(lines, r"[ \t\x1f]+(?=\n|\z)", "")
    tidy = F.when(text.rlike(UNTIDY), F.regexp_replace(ends, "\n{3,}", "\n\n")).otherwise(text)
    native = F.btrim(tidy, F.lit(BLANKS))
    return _where(_needs_python(text), _document, native, text)
