"""XML, HTML and MIME. Element trees are strings of JSON lists [tag, {attributes}, child, ...], children being trees or text."""

from __future__ import annotations

import json
from email import message_from_string
from html import escape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["#document", {}]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}]
        self.stack[-1].append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if data.strip():
            self.stack[-1].append(data)


def html_tree(source: str) -> list:
    parser = _Tree()
    parser.feed(source)
    parser.close()
    return parser.root


def xml_tree(source: str) -> list | None:
    """Null for XML that isn't well formed."""

    def of(e) -> list:
        out: list = [e.tag, dict(e.attrib)]
        if e.text and e.text.strip():
            out.append(e.text)
        for c in e:
            out.append(of(c))
            if c.tail and c.tail.strip():
                out.append(c.tail)
        return out

    try:
        return of(ElementTree.fromstring(source))
    except ElementTree.ParseError:
        return None


def _json_udf(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            tree = None if x is None else f(x)
            return None if tree is None else json.dumps(tree, ensure_ascii=False)

        return s.map(one)

    return run


def parse_html(s) -> Column:
    """PARSE-HTML, PARSE-HTMLR."""
    return _json_udf(html_tree)(_c(s))


def parse_xml(s) -> Column:
    """PARSE-XML, PARSE-XML-STRICT."""
    return _json_udf(xml_tree)(_c(s))


def xml_get(s, tag: str) -> Column:
    """XML-GET on well-formed XML: text of the child elements of the root with a tag, inside the JVM."""
    return F.xpath(_c(s), F.lit(f"/*/{tag}/text()"))


def xml_attribute(s, name: str) -> Column:
    return F.xpath_string(_c(s), F.lit(f"/*/@{name}"))


def xml_getall(s, tag: str) -> Column:
    """XML-GETALL: text of all descendants with a tag."""
    return F.xpath(_c(s), F.lit(f"//{tag}/text()"))


def xml_tag(s) -> Column:
    """XML-TAG."""
    return F.xpath_string(_c(s), F.lit("name(/*)"))


def xml_content(s) -> Column:
    return F.xpath_string(_c(s), F.lit("/*"))


def html_get(s, tag: str) -> Column:
    """XML-GET over loose HTML: inner markup of elements with a tag that don't nest, by pattern, inside the JVM."""
    return F.regexp_extract_all(_c(s), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))


def html_attributes(s, tag: str, name: str) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(rf"(?is)<{tag}\b[^>]*?\b{name}\s*=\s*\"([^\"]*)\""), F.lit(1))


def html_text(s) -> Column:
    """Markup dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(s), r"(?s)<!--.*?-->|<[^>]*>", " "), r"\s+", " "))


def unparse(tree: list | str) -> str:
    if isinstance(tree, str):
        return escape(tree, quote=False)
    tag, attributes, *children = tree
    head = "".join(f' {k}="{escape(v)}"' for k, v in attributes.items())
    inner = "".join(map(unparse, children))
    return inner if tag == "#document" else f"<{tag}{head}>{inner}</{tag}>" if children else f"<{tag}{head}/>"


@F.pandas_udf(StringType())
def unparse_markup(s: pd.Series) -> pd.Series:
    """UNPARSE-XML, UNPARSE-HTML."""
    return s.map(lambda x: None if x is None else unparse(json.loads(x)))


@F.pandas_udf(MapType(StringType(), StringType()))
def read_mime(s: pd.Series) -> pd.Series:
    """READ-MIME, PARSE-RFC822: headers in lower case, and the body under "content"."""

    def one(x):
        if x is None:
            return None
        m = message_from_string(x)
        body = m.get_payload() if not m.is_multipart() else "\n".join(str(p.get_payload()) for p in m.get_payload())
        return {k.lower(): str(v) for k, v in m.items()} | {"content": body}

    return s.map(one)


def make_element(tag: str, content, **attributes) -> Column:
    """Element generation: a string column."""
    head = "".join(f' {k}="{v}"' for k, v in attributes.items())
    safe = F.replace(F.replace(F.replace(_c(content), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit(f"<{tag}{head}>"), safe, F.lit(f"</{tag}>"))


def xml_attributes(s) -> Column:
    """XML-ATTRIBUTES of the root, as a map."""

    @F.pandas_udf(MapType(StringType(), StringType()))
    def attributes(x: pd.Series) -> pd.Series:
        def one(v):
            tree = None if v is None else xml_tree(v)
            return None if tree is None else tree[1]

        return x.map(one)

    return attributes(_c(s))


def xmltag_name(tag) -> Column:
    """XMLTAG-NAME of "prefix:name" or "{namespace}name"."""
    return F.regexp_extract(_c(tag), r"([^:}]*)$", 1)


def xmltag_namespace(tag) -> Column:
    """XMLTAG-NAMESPACE; null without one."""
    return F.nullif(F.regexp_extract(_c(tag), r"^(?:\{([^}]*)\}|([^:]*):)", 1), F.lit(""))


def xmltag_match(a, b) -> Column:
    """XMLTAG-MATCH?: the same name, whatever the case."""
    return F.lower(xmltag_name(a)) == F.lower(xmltag_name(b))
