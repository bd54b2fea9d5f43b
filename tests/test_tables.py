"""Tables of pages against a plain walk over the page: spans, nested tables, missing closing tags."""

import html.parser
import random
import re

from scorefield.sources import readers as R


class Walk(html.parser.HTMLParser):
    """Rows of the outermost tables, as lists of [text, colspan, rowspan]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.tables, self.open = 0, [], False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
                self.open = False
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
            self.open = False
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            a = dict(attrs)
            number = lambda n, most: min(int(a[n]) if re.fullmatch(r"-?\d+", a.get(n) or "") and int(a[n]) else 1, most)
            self.tables[-1][-1].append(["", number("colspan", 30), number("rowspan", 400)])
            self.open = True

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data):
        if self.depth and self.open:
            self.tables[-1][-1][-1][0] += data


def place(t, rows):
    """Each cell fills its own row, and leaves itself for the rows below, which take it when they come to its column."""
    out, waiting = [], {}
    for r, cells in enumerate(rows):
        row, col = [], 0

        def fill(col):
            while waiting.get(col) and waiting[col][1] > 0:
                row.append((col, waiting[col][0]))
                waiting[col][1] -= 1
                col += 1
            return col

        for text, columns, down in cells:
            col = fill(col)
            for c in range(col, col + max(0, columns)):
                row.append((c, text))
                if down > 1:
                    waiting[c] = [text, down - 1]
            col += max(0, columns)
        fill(col)
        out += [(t, r, c, re.sub(r"\s+", " ", x.replace("\xa0", " ")).strip(" ")) for c, x in sorted(dict(row).items())]
    return out


def page(r):
    def cell(depth):
        tag = r.choice(["td", "td", "th"])
        span = "".join(f" {n}={q}{r.randint(0, 3)}{q}" for n in ("rowspan", "colspan") for q in [r.choice(["", "'", '"'])] if r.random() < 0.35)
        inner = r.choice(["a", "b &amp; c", "<b>x</b>  y\n", "", "1 < 2", "é&nbsp;ü"]) + (table(depth + 1) if depth < 2 and r.random() < 0.15 else "")
        return f"<{tag}{span}>{inner}" + (f"</{tag}>" if r.random() < 0.8 else "")

    def table(depth):
        rows = "".join(r.choice(["<tr>", "<TR class='k'>"]) + "".join(cell(depth) for _ in range(r.randint(0, 4))) + ("</tr>" if r.random() < 0.8 else "") for _ in range(r.randint(0, 4)))
        return f"<table>{rows}</table>" if r.random() < 0.5 else f"<Table id=t><tbody>\n{rows}</tbody></Table>"

    return "".join(r.choice(["<p>text</p>", "plain", table(1), table(1)]) for _ in range(r.randint(0, 3)))


def test_tables_of_pages(spark):
    r = random.Random(8)
    pages = [(i, page(r), "t", 1) for i in range(300)] + [(300, None, "t", 1), (301, "", "t", 1), (302, "<table>", "t", 1), (303, "<table><td>outside</td></table>", "t", 1)]
    pages += [pages[1]]
    want = sorted((k, *x) for k, p, _, _ in pages for x in (place_of(p)))
    df = spark.createDataFrame(pages, "k int, html string, text string, table int")
    got = sorted(tuple(x) for x in R.extract_page_tables(df, "k", "html").collect())
    assert got == want and len(got) > 1000


def place_of(p):
    walk = Walk()
    walk.feed(p or "")
    walk.close()
    return [x for t, rows in enumerate(walk.tables) for x in place(t, rows)]


def test_rows_that_share_a_cell_all_have_it():
    rows = [[("T1", 1, 2), ("a", 1, 1), ("9", 1, 2)], [("b", 1, 1)], [("3", 1, 1), ("c", 2, 1)]]
    assert R.spread_spans(rows) == [(0, 0, "T1"), (0, 1, "a"), (0, 2, "9"), (1, 0, "T1"), (1, 1, "b"), (1, 2, "9"), (2, 0, "3"), (2, 1, "c"), (2, 2, "c")]
