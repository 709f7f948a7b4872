"""The two passes against a plain classifier, on the test pages and on made ones."""

import re
import time

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import html as H

from ..conftest import SMALL
from .test_html import LONG

PAGES = pq.read_table(SMALL.replace("0.001", "0.01") + "/pages.parquet", columns=["html"]).column(0).to_pylist()


def plain_labels(blocks):
    """Straight from the rules: every open block looks at every other."""
    told = []
    for b in blocks:
        words = [w for w in re.split(r"[\W\d_]+", b.text.lower()) if w]
        stops = len([w for w in words if w in H.STOP_WORDS])
        long, dense = len(b.text) >= 80, b.linked / len(b.text) > 0.4
        good = long and words and stops / len(words) >= 0.25
        empty = long and words and b.linked and stops / len(words) < 0.25 / 3
        told.append("no" if b.aside or dense else "yes" if good else "no" if empty else "?")
    found = [t == "yes" and b.main for t, b in zip(told, blocks, strict=True)]
    apart = any(found) or not [b for b in blocks if not b.main and not b.aside]
    out = []
    for i, (t, b) in enumerate(zip(told, blocks, strict=True)):
        if apart and not b.main:
            out.append(False)
        elif t != "?":
            out.append(t == "yes")
        else:
            near = [(abs(i - j), (j < i) == b.heading, told[j]) for j, c in enumerate(blocks)
                    if told[j] != "?" and not c.aside and (c.main or not apart)]
            out.append(min(near)[2] == "yes" if near else True)
    return out


BLOCK = st.builds(
    lambda text, share, main, aside, heading: H.Block(text, int(share * len(text)), main, aside, heading),
    st.sampled_from([LONG, "short", "%%% ###", "Tariff 12.5 " * 12, "menu " * 20, "of the and"]), st.sampled_from([0, 0, 0.1, 1]),
    st.booleans(), st.booleans(), st.booleans(),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(BLOCK, max_size=12))
def test_as_the_plain_classifier(blocks):
    assert H.labels(blocks) == plain_labels(blocks)


def test_as_the_plain_classifier_on_pages():
    for page in PAGES:
        blocks = H.blocks_of(page or "")
        assert H.labels(blocks) == plain_labels(blocks)


def test_element_names_do_not_decide():
    """The article's element renamed: the densities find the same text."""
    renamed = [re.sub(r"<(/?)(?:article|main)\b", r"<\1div", p or "") for p in PAGES]
    same = sum(H.main_text(a) == H.main_text(b or "") != "" for a, b in zip(renamed, PAGES, strict=True))
    assert same >= 0.95 * len(PAGES)


def test_the_passes_change_labels():
    """Blocks of one element fall apart by density, and short ones follow their neighbours."""
    links = "<p>" + " ".join(f'<a href="/{i}">some link {i}</a>' for i in range(12)) + "</p>"
    for tag in ("div", "article", "main"):
        page = f"<body><{tag}><h1>Title</h1><p>{LONG}</p><p>Short.</p>{links}<p>more</p>{links}</{tag}></body>"
        assert H.main_text(page) == f"Title\n{LONG}\nShort."
    menu = f"<body><main>{links}</main><div><h2>Title</h2><p>{LONG}</p></div></body>"
    assert H.main_text(menu) == f"Title\n{LONG}"


def test_unmatched_end_tags_take_time_in_proportion():
    def seconds(n):
        t = time.process_time()
        for page in ("<div>" * n + "</b>" * n, "<p><div>" + "<ul>" * n + "</p>" * n, "<div>x" * n, "</div>" * n, '<div class="ad">x' * 50 + "<p>y" * n):
            H.main_text(page)
        return time.process_time() - t

    seconds(100)
    assert seconds(8000) < 16 * seconds(2000) and seconds(8000) < 10
