"""Structure of one HTML page: title, headings, paragraphs, links and tables."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import quote, urldefrag, urljoin, urlsplit, urlunsplit

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Start tags that end an open paragraph.
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CAPTURED = frozenset(("title", "h1", "h2", "h3", "p", "th", "td"))
# An element of the first kind ends an open one of the second kinds inside the same table.
TABLE_ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}


class PageParser(HTMLParser):
    """Collects text per element of interest; unclosed and nested tags follow the usual recovery rules."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str] | None]] = []
        self.texts: dict[str, list[list[str]]] = {"title": [], "heading": [], "p": []}
        self.links: list[str] = []
        self.tables: list[dict] = []
        self.open_tables: list[dict] = []

    def _pop_to(self, tags, stop=()) -> bool:
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth][0]
            if tag in tags:
                while len(self.stack) > depth:
                    closed = self.stack.pop()[0]
                    if closed == "table" and self.open_tables:
                        self.open_tables.pop()
                return True
            if tag in stop:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.links.append(href)
        if tag in CLOSES_PARAGRAPH:
            self._pop_to(("p",), stop=("td", "th", "table", "button"))
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.stack.pop()
        if tag in TABLE_ENDS:
            self._pop_to(TABLE_ENDS[tag], stop=("table",))
        if tag in VOID:
            return
        buffer = [] if tag in CAPTURED else None
        if tag in ("h1", "h2", "h3"):
            self.texts["heading"].append(buffer)
        elif tag in ("title", "p"):
            self.texts[tag].append(buffer)
        elif tag == "table":
            table = {"headers": [], "rows": []}
            self.tables.append(table)
            self.open_tables.append(table)
        elif tag == "tr":
            for table in self.open_tables:
                table["rows"].append([])
        elif tag == "th":
            for table in self.open_tables:
                table["headers"].append(buffer)
        elif tag == "td":
            for table in self.open_tables:
                if table["rows"]:
                    table["rows"][-1].append(buffer)
        self.stack.append((tag, buffer))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "p" and not any(t == "p" for t, _ in self.stack):
            self.texts["p"].append([])  # a stray end tag makes an empty paragraph
            return
        self._pop_to(HEADINGS if tag in HEADINGS else (tag,), stop=() if tag == "table" else ("table",))

    def handle_data(self, data):
        for _, buffer in self.stack:
            if buffer is not None:
                buffer.append(data)


def parse_page(html: str) -> dict:
    """Texts are trimmed; a table keeps the rows whose cell count equals its header count."""
    parser = PageParser()
    parser.feed(html)
    parser.close()

    def text(buffer):
        return "".join(buffer).strip()

    tables = []
    for table in parser.tables:
        headers = [text(h) for h in table["headers"]]
        rows = [[text(c) for c in row] for row in table["rows"] if headers and len(row) == len(headers)]
        if rows:
            tables.append((headers, rows))
    return {
        "title": text(["".join(b) for b in parser.texts["title"]]),
        "headings": [text(b) for b in parser.texts["heading"]],
        "paragraphs": [text(b) for b in parser.texts["p"]],
        "links": parser.links,
        "tables": tables,
    }


def resolve_link(base: str, href: str) -> tuple[str, str] | None:
    """Absolute URL and lower-case host of a link, or None where it is not a valid URL."""
    try:
        absolute = urljoin(base, href.strip())
        parts = urlsplit(absolute)
        if not parts.scheme or not parts.hostname:
            return None
        keep = "!$%&'()*+,;=:@/~[]|^"
        address, fragment = urldefrag(
            urlunsplit((parts.scheme, parts.netloc.lower(), quote(parts.path or "/", safe=keep), quote(parts.query, safe=keep + "?`{}"), parts.fragment))
        )
        return address + (f"#{quote(fragment, safe=keep + '?#')}" if fragment else ""), parts.hostname.lower()
    except ValueError:
        return None
