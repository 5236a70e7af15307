"""Pages against the library parser, hostile pages against the clock."""

import time
import uuid
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from ocuspark.llm import warc
from ocuspark.llm.text import table

SMALL = "/root/testdata/sf0.01"


class Reader(HTMLParser):
    """Links, title and words of a page by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs, self.words, self.title, self.skip, self.in_title, self.lang = [], [], [], None, False, ""

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in ("script", "style", "noscript", "template") and self.skip is None:
            self.skip = tag
        if self.skip is None:
            self.in_title = self.in_title or tag == "title"
            if tag == "a" and values.get("href"):
                self.hrefs.append(values["href"])
            if tag == "html":
                self.lang = (values.get("lang") or "").lower()

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.skip is None:
            self.words += data.split()
            if self.in_title:
                self.title += data.split()


def test_records_equal_the_library_parser(spark):
    pages = table(spark, SMALL, "pages")
    given = {r["page_id"]: r for r in pages.collect()}
    records = {(r["page_id"], r["warc_type"]): r for r in warc.derive(warc.responses(pages)).collect()}
    assert len(records) == 2 * len(given)
    for page_id, row in given.items():
        reader = Reader()
        reader.feed(row["html"] or "")
        reader.close()
        text, facts = records[page_id, "conversion"], records[page_id, "metadata"]
        assert "".join(text["block"].split()) == "".join(reader.words)
        lines = [x.split(": ", 1) for x in facts["block"].split("\r\n") if x]
        assert [v for k, v in lines if k == "outlink"] == list(dict.fromkeys(urljoin(row["url"], h.strip()) for h in reader.hrefs))
        assert dict(lines)["title"] == " ".join(reader.title) and dict(lines)["language"] == reader.lang
        name = f"response {page_id} {row['url'] or ''}"
        assert facts["refers_to"] == text["refers_to"] == f"<urn:uuid:{uuid.uuid5(uuid.UUID('6ba7b811-9dad-11d1-80b4-00c04fd430c8'), name)}>"


@pytest.mark.parametrize("opening", ["<a href", "<a href=\"", "<", "<!--", "<script>", "<style", "<p", "</", "<title>", "<html lang", "<a href ", "&#", "&#9", "9"])
def test_a_megabyte_of_unclosed_markup_is_linear(opening):
    page = ("&#" if opening == "9" else "") + opening * (1_000_000 // len(opening))
    start = time.monotonic()
    read = warc.scan_page(page)
    warc.plain_text(read)
    warc.metadata(read, "http://e.org/a/")
    assert time.monotonic() - start < 5  # about a second at most; a quadratic walk takes minutes


def test_odd_markup():
    page = "<HTML LANG=De><Title>a <b>&amp;</b></TITLE><p>1 < 2</p><A class=x HREF='/u?a=1&amp;b'>l</A><noscript>no</noscript>İ<br>end<!-- x"
    read = warc.scan_page(page)
    assert warc.metadata(read, "http://e.org/d") == {"title": "a &", "lang": "de", "links": ["http://e.org/u?a=1&b"]}
    assert warc.plain_text(read) == "a &\n1 < 2\nl İ\nend"
