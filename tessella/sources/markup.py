"""Markup in one pass: a tokenizer with a stack of open elements, and what is read off it.

Broken markup is taken as it comes: elements that are not closed end with their parent, closing tags without an
opening one are left out, and a page may end anywhere.  Comments go, CDATA is text, entities of any kind are resolved.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*)>|(?P<text>[^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ENTITY = re.compile("&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Elements without content, elements whose content is no markup, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
VERBATIM = frozenset(("script", "style"))
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Elements that are no part of a page's text.
APART = frozenset("head script style nav footer header aside".split())
#: What an opening tag ends: a row ends the cell before it, and so on.
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "tbody": {"table"}, "p": BLOCKS - {"p"}, "dt": {"dl"}, "dd": {"dl"}}


def resolved(text: str) -> str:
    """Entities that end in a semicolon as their characters; others, as at a cut, stay."""
    return _ENTITY.sub(lambda m: entities.unescape(m[0]), text) if "&" in text else text


def tokens(text: str, xml: bool = False, resolve: bool = True) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("open", tag, attributes) and ("close", tag, {}), in order; void elements open and close.

    Entities in text stay as they are where ``resolve`` is false.
    """
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        if not m:  # a tag that the page's end cuts off
            return
        at = m.end()
        if m["text"] is not None:
            yield "text", resolved(m["text"]) if resolve else m["text"], {}
        elif m["raw"] is not None:
            yield "text", m["raw"], {}
        elif m["tag"]:
            tag = m["tag"] if xml else m["tag"].lower()
            if m["end"]:
                yield "close", tag, {}
                continue
            rest = m["rest"]
            own = {k.lower(): resolved(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)}
            yield "open", tag, own
            if xml and rest.endswith("/") or not xml and tag in VOID:
                yield "close", tag, {}
            elif not xml and tag in VERBATIM:
                end = re.compile(f"</{tag}", re.I).search(text, at)
                at = end.start() if end else n


def nested(text: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """Tokens whose elements are well nested; the last value of a closing one says whether the page closed it itself."""
    stack: list[str] = []
    for kind, value, own in tokens(text):
        if kind == "open":
            if ends := ENDS.get(value):
                scope = _SCOPE.get(value, set())
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in ends or stack[i] in scope), -1)
                while depth >= 0 and stack[depth] in ends:
                    while len(stack) > depth:
                        yield "close", stack.pop(), {}, False
                    depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in ends or stack[i] in scope), -1)
            stack.append(value)
            yield kind, value, own, True
        elif kind == "close":
            if value in stack:
                while stack[-1] != value:
                    yield "close", stack.pop(), {}, False
                stack.pop()
                yield kind, value, {}, True
        else:
            yield kind, value, own, True
    while stack:
        yield "close", stack.pop(), {}, False


def squeezed(text: str) -> str:
    """Blanks and line ends as Markdown has them."""
    text = re.sub(" ?\n ?", "\n", re.sub("[ \t]+", " ", text))
    return re.sub("\n{3,}", "\n\n", text).strip()


_INLINE = {"strong": ("**", "**"), "b": ("**", "**"), "em": ("_", "_"), "i": ("_", "_")}


def markdown(text: str) -> str:
    """Headings, links, lists, emphasis, code and tables' text of a page as Markdown, without what stands apart from it.

    Inline elements that the page does not close itself leave no mark.
    """
    out: list[str] = []
    open_: list[tuple[str, int, dict[str, str]]] = []
    for kind, value, own, said in nested(text):
        if kind == "text":
            out.append(value)
        elif kind == "open":
            if value in ("br", "ul", "ol", "table"):
                out.append("\n\n")
            open_.append((value, len(out), own))
        else:
            tag, at, own = open_.pop()
            if tag in APART:
                if said:
                    del out[at:]
                    out.append(" ")
                continue
            within = any(t == "pre" for t, _, _ in open_)
            if tag in ("p", "div", "tr", "ul", "ol", "table") or tag == "li" and not said:
                out.append("\n\n")
            if not said:
                continue
            if tag == "pre":
                out[at:] = ["\n\n```\n", *out[at:], "\n```\n\n"]
            elif tag == "code" and not within:
                out[at:] = ["`", *out[at:], "`"]
            elif tag in _INLINE:
                out[at:] = [_INLINE[tag][0], *out[at:], _INLINE[tag][1]]
            elif tag == "a" and "href" in own:
                out[at:] = ["[", *out[at:], f"]({own['href']})"]
            elif re.fullmatch("h[1-6]", tag):
                out[at:] = ["\n\n", "#" * int(tag[1]), " ", *out[at:], "\n\n"]
            elif tag == "li":
                out[at:] = ["\n- ", *out[at:], "\n"]
    return squeezed("".join(out))


#: Words in a class or id that speak for or against an element.
_AGAINST, _FOR = re.compile("(?i)(^|[-_ ])(ad|ads|advert|banner|comment|cookie|footer|menu|meta|nav|promo|related|share|sidebar|social|sponsor)"), re.compile("(?i)article|body|content|entry|main|post|story|text")


def readable(text: str) -> tuple[str, int, int]:
    """(the main text, blocks kept, blocks left out) of a page.

    A block is the text between two ends of block elements.  It scores by its length and commas, less the share
    that stands in links; the element around it and that one's parent get the score, and more or less by the names of
    their class and id.  Kept are the blocks under the best element which are not mostly links.
    """
    blocks: list[tuple[str, float, tuple[int, ...]]] = []
    path: list[tuple[str, int, float]] = []  # tag, number, favour
    number, part, linked, apart = 0, [], 0, 0

    def cut() -> None:
        nonlocal linked
        block = " ".join("".join(part).split())
        part.clear()
        if block:
            share = min(1.0, linked / len(block))
            ids = tuple(n for t, n, _ in path if t in BLOCKS)
            blocks.append((block, -1.0 if apart else share, ids))
        linked = 0

    favour: dict[int, float] = {}
    for kind, value, own, _ in nested(text):
        if kind == "text":
            part.append(value)
            if any(t == "a" for t, _, _ in path):
                linked += len(" ".join(value.split()))
        elif kind == "open":
            if value in BLOCKS or value == "br":
                cut()
            number += 1
            names = f"{own.get('class', '')} {own.get('id', '')}"
            favour[number] = (25.0 if value in ("article", "main") else 0.0) + (25.0 if _FOR.search(names) else 0.0) - (50.0 if _AGAINST.search(names) else 0.0)
            path.append((value, number, favour[number]))
            apart += value in APART
        else:
            if value in BLOCKS:
                cut()
            tag, _, _ = path.pop()
            apart -= tag in APART
    cut()
    scores: dict[int, float] = {}
    for block, share, ids in blocks:
        if share < 0 or len(block) < 25:
            continue
        score = (1 + block.count(",") + min(3.0, len(block) / 100)) * (1 - share)
        around = [i for i in ids if i in favour][::-1]
        for weight, i in zip((0.5, 1.0, 0.5), around, strict=False):  # the block's own element, the one around it, and its parent
            scores[i] = scores.get(i, favour[i]) + weight * score
    if not scores:
        kept = [b for b, share, _ in blocks if 0 <= share < 0.5]
    else:
        best = max(scores, key=lambda i: (scores[i], -i))
        kept = [b for b, share, ids in blocks if best in ids and 0 <= share < 0.5]
    return "\n".join(kept), len(kept), len(blocks) - len(kept)


def tables(text: str) -> list[list[list[tuple[str, str]]]]:
    """Every table with cells, in order of its end: rows of (text, first link).  A nested table is one of its own."""
    done, stack = [], []
    for kind, value, own, _ in nested(text):
        if kind == "open" and value == "table":
            stack.append({"rows": [], "cell": None, "head": 0})
        elif not stack:
            continue
        elif kind == "open":
            top = stack[-1]
            if value == "tr":
                top["rows"].append([])
            elif value == "td":
                if not top["rows"]:
                    top["rows"].append([])
                top["cell"] = [[], ""]
            elif value == "a" and top["cell"] and not top["cell"][1]:
                top["cell"][1] = own.get("href", "")
        elif kind == "text":
            if stack[-1]["cell"]:
                stack[-1]["cell"][0].append(value)
        elif value == "td" and stack[-1]["cell"]:
            parts, link = stack[-1]["cell"]
            stack[-1]["rows"][-1].append(("".join(parts).strip(), link))
            stack[-1]["cell"] = None
        elif value == "table":
            rows = [r for r in stack.pop()["rows"] if r]
            if rows:
                done.append(rows)
    return done


def items(text: str, tag: str, fields: Sequence[str], resolve: bool = True) -> list[dict[str, list[str]]]:
    """Of every element ``tag`` of an XML text the texts of its fields, and under ``field@attribute`` their attributes.

    A field counts by its name alone, at any depth of the item.
    """
    done: list[dict[str, list[str]]] = []
    now: dict[str, list[str]] | None = None
    inside: list[tuple[str, list[str]]] = []
    for kind, value, own in tokens(text, True, resolve):
        if kind == "open":
            if value == tag:
                now, inside = {}, []
            elif now is not None and value in fields:
                inside.append((value, []))
                for k, v in own.items():
                    now.setdefault(f"{value}@{k}", []).append(v)
        elif kind == "text":
            for _, parts in inside:
                parts.append(value)
        elif now is not None and value == tag:
            done.append(now)
            now = None
        elif now is not None and any(f == value for f, _ in inside):
            while inside:
                f, parts = inside.pop()
                now.setdefault(f, []).append("".join(parts))
                if f == value:
                    break
    return done


def parsed(df: DataFrame, text: str, keep: Sequence[str], parse: Callable[[str], list[tuple[Any, ...]]], kinds: str) -> DataFrame:
    """``keep`` columns and a row for each tuple that ``parse`` gives for a text, named by ``kinds``; nulls count as empty."""
    own = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = T._parse_datatype_string(kinds).fields
    schema = T.StructType([*(own.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 128) for whole in batches for at in range(0, whole.num_rows, 128)):
            rows, found = [], []
            for i, t in enumerate(batch.column("_text")):
                for row in parse(t.as_py()):
                    rows.append(i)
                    found.append(row)
            at = pa.array(rows, pa.int64())
            kept = [batch.column(c).take(at).cast(arrow.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[j] for r in found], arrow.field(f.name).type) for j, f in enumerate(fields))], schema=arrow)

    return own.mapInArrow(run, schema)
