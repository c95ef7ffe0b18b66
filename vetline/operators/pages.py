"""Page extraction job and markdown clean-up.

Spark has no HTML parser, so one Arrow-batched ``mapInPandas`` pass parses
each page once with the standard-library ``html.parser`` and yields every
field (title candidates, company, description block, markdown, result
cards).  The markdown clean-up after it (X9-X11) is plain column work.
The per-page helper is small on purpose: a light tree, a few selector forms
and a converter; everything else (joins, routing, naming) stays in Spark.
"""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import text as tx
from vetline.operators.sequence import spread

# ------------------------------------------------------------------ tree
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "source", "track", "wbr"}
_SKIP_TEXT = {"script", "style", "head", "title", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5",
          "h6", "header", "footer", "nav", "table", "tr", "br", "hr", "main", "aside",
          "blockquote", "pre", "dl", "dt", "dd", "form", "figure"}
# Tags whose open element is closed by a new one of these (implied end tags).
_IMPLIED = {"p": _BLOCK - {"br", "hr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
            "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        while self.cur.tag in _IMPLIED and tag in _IMPLIED[self.cur.tag]:
            self.cur = self.cur.parent
        n = Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(n)
        if tag not in _VOID:
            self.cur = n

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:  # unmatched end tags are ignored
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse_dom(html: str) -> Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # malformed markup: keep what was built
        pass
    return b.root


def walk(node: Node):
    """Elements in document order."""
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, Node):
            if n.tag != "#root":
                yield n
            stack.extend(reversed([c for c in n.children if isinstance(c, Node)]))


def inner_text(node: Node) -> str:
    out = []

    def rec(n):
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in _SKIP_TEXT:
                if c.tag in _BLOCK:
                    out.append("\n")
                rec(c)
                if c.tag in _BLOCK:
                    out.append("\n")
    rec(node)
    s = re.sub(r"[ \t\r\f\v]+", " ", "".join(out))
    return re.sub(r"\s*\n\s*", "\n", s).strip()


def _attr_str(attrs):
    return "".join(f' {k}="{v}"' for k, v in attrs.items())


def inner_html(node: Node) -> str:
    from html import escape
    out = []

    def rec(n):
        for c in n.children:
            if isinstance(c, str):
                out.append(escape(c, quote=False))
            else:
                out.append(f"<{c.tag}{_attr_str(c.attrs)}>")
                if c.tag not in _VOID:
                    rec(c)
                    out.append(f"</{c.tag}>")
    rec(node)
    return "".join(out)


_SEL = re.compile(r"^(?P<tag>[a-z0-9]+)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\])*)$")
_PART = re.compile(r"([.#])([\w-]+)|\[(\w+)(\*?=)'?\"?([^'\"\]]*)'?\"?\]")


@functools.lru_cache(maxsize=256)
def matcher(selector: str):
    """Predicate for one simple selector: tag, .class, #id, [attr*=v], [attr=v]."""
    m = _SEL.match(selector.strip())
    if not m:
        raise ValueError(selector)
    tag, tests = m.group("tag"), []
    for kind, name, attr, op, val in _PART.findall(m.group("rest")):
        if kind == ".":
            tests.append(lambda n, v=name: v in n.attrs.get("class", "").split())
        elif kind == "#":
            tests.append(lambda n, v=name: n.attrs.get("id") == v)
        elif op == "*=":
            tests.append(lambda n, a=attr, v=val: v in n.attrs.get(a, ""))
        else:
            tests.append(lambda n, a=attr, v=val: n.attrs.get(a) == v)
    return lambda n: (tag is None or n.tag == tag) and all(t(n) for t in tests)


def select_all(root: Node, selector: str, nodes: list | None = None):
    pred = matcher(selector)
    return [n for n in (nodes if nodes is not None else walk(root)) if pred(n)]


def first_text(root: Node, selectors, nodes: list | None = None) -> str:
    """First selector whose first match has non-empty text."""
    for sel in selectors:
        hits = select_all(root, sel, nodes)
        if hits:
            t = inner_text(hits[0]).strip()
            if t:
                return t
    return ""


# FIXED VALUES: selectors and patterns the extraction must use.
TITLE_SELECTORS = ["h1.job-details-jobs-unified-top-card__job-title", "h1[class*='job-title']", "h1"]
COMPANY_SELECTORS = ["a[href*='/company/'][href*='/life/']",
                     ".job-details-jobs-unified-top-card__company-name",
                     "[class*='company-name']", ".jobs-unified-top-card__company-name"]
DESC_SELECTORS = ["#job-details", ".jobs-description__content",
                  ".jobs-description-content__text", ".description__text",
                  "[class*='description__text']", ".jobs-box__html-content", "article"]
CARD_COMPANY_SELECTORS = ["[class*='company-name']", "[class*='primary-description']",
                          "[class*='subtitle']"]
RESULT_COUNT_PATTERN = r"(?i)\b(\d+)\s+results?\b"
CARD_HREF_PATTERN = r"/jobs/view/(\d+)"


def title_by_anchor(root: Node, nodes: list | None = None) -> str:
    """Company link as anchor; climb at most 6 parents; first <p> with over
    10 characters of text (X4)."""
    hits = select_all(root, "a[href*='/company/'][href*='/life/']", nodes)
    if not hits:
        return ""
    el = hits[0]
    for _ in range(fixed.TITLE_ANCHOR_MAX_CLIMB):
        el = el.parent
        if el is None or el.tag == "#root":
            break
        ps = [n for n in walk(el) if n.tag == "p"]
        if ps and len(inner_text(ps[0]).strip()) > fixed.TITLE_ANCHOR_MIN_TEXT:
            return inner_text(ps[0]).strip()
    return ""


def _raw_text_lengths(root: Node) -> dict:
    """Visible raw text length of every element, bottom-up in one pass."""
    out, stack = {}, [(root, False)]
    while stack:
        n, done = stack.pop()
        if done:
            total = 0
            for c in n.children:
                if isinstance(c, str):
                    total += len(c) + 2
                elif c.tag not in _SKIP_TEXT:
                    total += out[id(c)] + 2
            out[id(n)] = total
        else:
            stack.append((n, True))
            stack.extend((c, False) for c in n.children if isinstance(c, Node))
    return out


def description_html(root: Node, nodes: list | None = None) -> str:
    """Ordered selectors, first whose inner HTML exceeds 200 characters (X6);
    else the div/section/article with the longest text under 20000
    characters and under 30 children, over 200 characters; first wins ties (X7, O4)."""
    nodes = nodes if nodes is not None else list(walk(root))
    for sel in DESC_SELECTORS:
        hits = select_all(root, sel, nodes)
        if hits:
            h = inner_html(hits[0]).strip()
            if len(h) > fixed.DESCRIPTION_MIN_HTML:
                return h
    raw = _raw_text_lengths(root)
    best, best_len = None, 0
    for n in nodes:
        # the raw text length bounds the normalised one from above, so a node
        # that cannot beat the current best is skipped without building text
        if n.tag in ("div", "section", "article") and raw[id(n)] > best_len:
            t = inner_text(n)
            kids = sum(1 for c in n.children if isinstance(c, Node))
            if best_len < len(t) < fixed.FALLBACK_BLOCK_MAX_TEXT and kids < fixed.FALLBACK_BLOCK_MAX_CHILDREN:
                best, best_len = n, len(t)
    if best is not None and best_len > fixed.DESCRIPTION_MIN_HTML:
        return inner_html(best)
    return ""


def html_to_markdown(html: str) -> str:
    """Markdown without links, images or wrapping (X8): headings, paragraphs,
    bold/italic, inline code, line breaks, rules, nested lists, blockquotes,
    preformatted blocks and table rows."""
    root = parse_dom(html)
    out: list[str] = []

    def inline(n) -> str:
        parts = []
        for c in n.children:
            if isinstance(c, str):
                parts.append(re.sub(r"\s+", " ", c))
            elif c.tag in _SKIP_TEXT or c.tag == "img":
                continue
            elif c.tag == "br":
                parts.append("  \n")
            elif c.tag in ("b", "strong"):
                t = inline(c).strip()
                parts.append(f"**{t}**" if t else "")
            elif c.tag in ("i", "em"):
                t = inline(c).strip()
                parts.append(f"_{t}_" if t else "")
            elif c.tag == "code":
                t = inline(c).strip()
                parts.append(f"`{t}`" if t else "")
            elif c.tag in ("ul", "ol"):
                continue  # nested lists are emitted as blocks by the list item
            else:
                parts.append(inline(c))
        return "".join(parts)

    def raw_text(n) -> str:
        return "".join(c if isinstance(c, str) else raw_text(c) for c in n.children
                       if isinstance(c, str) or c.tag not in _SKIP_TEXT)

    def lst(n, depth):
        items = [x for x in n.children if isinstance(x, Node) and x.tag == "li"]
        for i, li in enumerate(items):
            mark = f"{i + 1}. " if n.tag == "ol" else "* "
            out.append("  " * (depth + 1) + mark + inline(li).strip())
            for sub in (x for x in li.children if isinstance(x, Node) and x.tag in ("ul", "ol")):
                lst(sub, depth + 1)

    def block(n):
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    out.append(re.sub(r"\s+", " ", c).strip())
                continue
            t = c.tag
            if t in _SKIP_TEXT or t == "img":
                continue
            if t in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.extend(["", "#" * int(t[1]) + " " + inline(c).strip(), ""])
            elif t == "p":
                out.extend(["", inline(c).strip(), ""])
            elif t == "hr":
                out.extend(["", "* * *", ""])
            elif t in ("ul", "ol"):
                out.append("")
                lst(c, 0)
                out.append("")
            elif t == "blockquote":
                start = len(out)
                block(c)
                inner = out[start:]
                del out[start:]
                while inner and not inner[0]:
                    inner.pop(0)
                while inner and not inner[-1]:
                    inner.pop()
                quoted = [("> " + x) if x else ">" for x in inner]
                out.extend(["", *quoted, ""])
            elif t == "pre":
                out.extend(["", *["    " + x for x in raw_text(c).strip("\n").split("\n")], ""])
            elif t == "tr":
                cells = [inline(x).strip() for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
                out.append(" | ".join(cells))
            elif t in _BLOCK or t in ("table", "thead", "tbody", "tfoot"):
                block(c)
            else:
                text = inline(c).strip()
                if text:
                    out.append(text)
    block(root)
    md = "\n".join(out)
    return re.sub(r"\n{3,}", "\n\n", md).strip()


def result_cards(root: Node, nodes: list | None = None) -> list[dict]:
    """Job cards on a result page: canonical URL, first text line as title,
    company from the closest list item (default LinkedIn); unique by URL (X1, F12)."""
    seen, cards = set(), []
    for a in select_all(root, "a[href*='/jobs/view/']", nodes):
        m = re.search(CARD_HREF_PATTERN, a.attrs.get("href", ""))
        if not m:
            continue
        url = fixed.CANONICAL_URL_PREFIX + m.group(1) + fixed.CANONICAL_URL_SUFFIX
        title = (inner_text(a).strip().split("\n") or [""])[0].strip()
        if not title:
            continue
        li = a.parent
        while li is not None and li.tag != "li":
            li = li.parent
        company = ""
        if li is not None:
            for sel in CARD_COMPANY_SELECTORS:
                hits = select_all(li, sel)
                if hits:
                    company = (inner_text(hits[0]).strip().split("\n") or [""])[0].strip()
                    break
        if url not in seen:
            seen.add(url)
            cards.append({"title": title, "company": company or fixed.DEFAULT_SOURCE, "url": url})
    return cards


def expected_results(root: Node, nodes: list | None = None):
    """First leaf text of at most 60 characters holding ``N result(s)`` (A3)."""
    for n in (nodes if nodes is not None else walk(root)):
        if any(isinstance(c, Node) for c in n.children) or n.tag in _SKIP_TEXT:
            continue
        t = inner_text(n)
        if len(t) > 60:
            continue
        m = re.search(RESULT_COUNT_PATTERN, t)
        if m:
            return int(m.group(1))
    return None


def extract_page(html: str) -> dict:
    root = parse_dom(html)
    nodes = list(walk(root))
    text = inner_text(root)
    desc = description_html(root, nodes)
    return {
        "title_sel": first_text(root, TITLE_SELECTORS, nodes),
        "title_anchor": title_by_anchor(root, nodes),
        "company": first_text(root, COMPANY_SELECTORS, nodes),
        "desc_html": desc,
        "desc_md": html_to_markdown(desc) if desc else None,
        "results_end": fixed.RESULTS_END_SENTINEL in text,
        "no_results": any(m in text for m in fixed.NO_RESULTS_MARKERS),
        "expected": expected_results(root, nodes),
        "cards": result_cards(root, nodes),
    }


PAGE_FIELDS = ("title_sel string, title_anchor string, company string, desc_html string, "
               "desc_md string, results_end boolean, no_results boolean, expected int, "
               "cards array<struct<title:string, company:string, url:string>>")


def parse_pages(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """One parse per page, all fields at once (X1-X8, A3).  ``key`` plus
    ``url`` (when present) are passed through."""
    keep = [key] + (["url"] if "url" in pages.columns and key != "url" else [])
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep) + ", " + PAGE_FIELDS

    def run(batches):
        for pdf in batches:
            rows = [extract_page(h) for h in pdf[html_col].tolist()]
            out = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in PAGE_FIELDS.split(", ")])
            for c in reversed(keep):
                out.insert(0, c, pdf[c].values)
            yield out

    return spread(pages.select(*keep, html_col)).mapInPandas(run, schema)


def listing_fields(parsed: DataFrame, stem_col: str | None = None) -> DataFrame:
    """Title/company with fallbacks (P10) and the listing document (P11, K3);
    failed extractions are flagged for quarantine (K12)."""
    title = tx.default_if_blank("title_sel", F.nullif(F.col("title_anchor"), F.lit("")))
    company = F.coalesce(F.col("company"), F.lit(""))
    if stem_col is not None:
        placeholder = F.col(stem_col).contains(fixed.EMAIL_PLACEHOLDER_MARK)
        from_stem = tx.parse_stem(F.col(stem_col))
        use_stem = title.isNull() & ~placeholder & (from_stem["title"] != "")
        company = F.when(use_stem & (company == ""), from_stem["company"]).otherwise(company)
        title = F.when(use_stem, from_stem["title"]).otherwise(title)
    md = clean_markdown(F.col("desc_md"))
    heading = F.coalesce(title, F.col(stem_col) if stem_col else F.col("url"))
    doc = F.concat_ws("\n", F.concat(F.lit("# "), heading), F.lit(""),
                      F.when(company != "", F.concat(F.lit("**Company:** "), company, F.lit("\n"))),
                      F.concat(F.lit("**URL:** "), F.col("url")), F.lit(""), F.lit("---"), F.lit(""),
                      F.coalesce(md, F.lit("(description not found)")), F.lit(""))
    return parsed.select("*", title.alias("title"), company.alias("company_final"),
                         doc.alias("body_md"),
                         (title.isNull() | F.col("desc_html").isNull() | (F.col("desc_html") == ""))
                         .alias("quarantine"))


# ------------------------------------------------------------------ markdown
def cut_at_marker(md, marker: str = fixed.ALERT_CUT_MARKER) -> Column:
    """Everything from the marker on is dropped."""
    c = md if isinstance(md, Column) else F.col(md)
    return tx.trim_ws(F.substring_index(c, marker, 1))


def cut_preamble(md, separators=fixed.RULE_SEPARATORS) -> Column:
    """Drop everything up to and including the first separator, trying the
    separators in list order (not by position) (X10)."""
    c = md if isinstance(md, Column) else F.col(md)
    chain = None
    for sep in separators:
        pos = F.instr(c, sep)
        after = tx.trim_ws(F.substr(c, pos + F.lit(len(sep))))
        chain = F.when(pos > 0, after) if chain is None else chain.when(pos > 0, after)
    return chain.otherwise(c)


def strip_sections(md, headings=fixed.STRIP_HEADINGS) -> Column:
    """Drop blacklisted sections: a heading whose lower-cased text is listed
    starts a skip that ends at the next heading of the same or higher level;
    a listed heading inside a skip restarts it at its own level (X11, Q20)."""
    c = md if isinstance(md, Column) else F.col(md)
    black = F.array(*[F.lit(h) for h in headings])
    # a section starts at a line that looks like a heading; the fold goes over sections, not lines
    sections = F.split(F.regexp_replace(c, r"\r\n|\r", "\n"), r"\n(?=#{1,6}\s)")
    init = F.struct(F.lit(False).alias("skip"), F.lit(0).alias("lvl"), F.array().cast("array<boolean>").alias("keep"))

    def step(acc, section):
        line = F.substring_index(section, "\n", 1)
        lvl = F.length(F.regexp_extract(line, r"^(#{1,6})\s+", 1))
        head = lvl > 0
        txt = F.lower(tx.trim_ws(F.regexp_extract(line, r"^#{1,6}\s+(.*)", 1)))
        starts = head & F.array_contains(black, txt)
        ends = head & acc["skip"] & (lvl <= acc["lvl"])
        skip = F.when(starts, F.lit(True)).when(ends, F.lit(False)).otherwise(acc["skip"])
        return F.struct(skip.alias("skip"), F.when(starts, lvl).otherwise(acc["lvl"]).alias("lvl"),
                        F.array_append(acc["keep"], ~skip).alias("keep"))

    flags = F.aggregate(sections, init, step)["keep"]
    kept = F.filter(F.arrays_zip(sections.alias("s"), flags.alias("k")), lambda x: x["k"])
    return tx.trim_ws(F.array_join(F.transform(kept, lambda x: x["s"]), "\n"))


def clean_markdown(md) -> Column:
    """X9 -> X10 -> X11 in the order of the original clean-up."""
    return strip_sections(cut_preamble(cut_at_marker(md)))
