"""Which parts of pages with style sheets are shown."""

import pytest

from sitegrain.llm.html_text import visible_text
from sitegrain.llm.style_sheets import on_screen

CASES = {
    ("@media print{nav,.sidebar{display:none}}", "<nav>a</nav><p class=sidebar>b"): "a b",
    ("@media (max-width: 600px){nav{display:none}} @media (min-width:600px){.m{display:none}}", "<nav>a</nav><p class=m>b"): "a",
    (".tab{display:none} .tab.active{display:block}", "<div class=tab>a</div><div class='tab active'>b</div>"): "b",
    (".x{display:none}.x{display:block}", "<p class=x>a"): "a",
    (".x{display:block}.x{display:none}", "<p class=x>a"): "",
    (".x{display:none!important}.x{display:block}", "<p class=x>a<p class=x style='display:block'>b"): "",
    ("#i{display:none}.x{display:block}", "<p id=i class=x>a<p class=x>b"): "b",
    ("ul ul{display:none} li.on > ul{display:block}", "<ul><li>a<ul><li>b</ul><li class=on>c<ul><li>d</ul></ul>"): "- a - c - d",
    (".h{visibility:hidden} .h b{visibility:visible}", "<p class=h>a <b>b</b> c"): "b",
    (".hidden{display:none} @media (min-width:768px){.md\\:block{display:block}}", "<p class='hidden md:block'>a<p class=hidden>b"): "a",
    ("p{display:none;color:red} /* p{display:block} */ p:not(.k){display:block}", "<p class=k>a<p>b"): "b",
    ("@layer base{.x{display:none}} .y{display:none} @layer base{p.y.y{display:block}}", "<p class=x>a<p class=y>b<p>c"): "c",
    ("@supports (display:grid){.x{display:none} .z{color:red}}", "<p class=x>a<p class=z>b"): "b",
    (".a{color:red; .b{display:none} &.c{display:none}}", "<div class=a><p class=b>x<p>y</div><p class=b>z<p class='a c'>w"): "y z",
    ("li:nth-child(2n){display:none} li:hover{display:none}", "<ol><li>a<li>b<li>c<li>d</ol>"): "1. a 2. c",
    ("p + p{display:none}", "<p>a<p>b<div>c</div><p>d"): "a c d",
    ("[data-x^='q;}']{display:none} .u{content:'}.t{display:none}'} .t{background:url(a;display:none)}", "<p data-x='q;}r'>a<p class=t>b<p class=u>c"): "b c",
    ("p:has(b){display:none}", "<p>a<b>b</b>"): "ab",
    ("body > p{display:none} table > tbody > tr.h{display:none}", "<p>a<table><tr class=h><td>b<tr><td>c</table>"): "c",
    ("@keyframes k{from{display:none}} @font-face{font-family:x} p:before{display:none}", "<p>a"): "a",
    ("p{display:none", "<p>a<div>b"): "b",
    ("p{display:sideways} .x{display:flex}", "<p>a<p hidden>b<p hidden class=x>c"): "a c",
}


@pytest.mark.parametrize("sheet, body", CASES)
def test_shown(sheet, body):
    assert " ".join(visible_text(f"<style>{sheet}</style>{body}").split()) == CASES[sheet, body]


def test_media():
    assert all(map(on_screen, ["", "all", "screen and (min-width:40em)", "not print", "print, screen", "only screen and (orientation: landscape)", "(400px <= width <= 1400px)", "not all and (max-width:3px)", "(hover)"]))
    assert not any(map(on_screen, ["print", "speech", "not screen", "(max-width: 599.98px)", "screen and (width < 1000px)", "(prefers-reduced-motion)", "(min-width:1px) and (prefers-color-scheme:dark)", "(odd"]))
    assert visible_text("<style media=print>p{display:none}</style><template><style>p{display:none}</style></template><p>a") == "a"


def test_large_sheets_take_linear_time():
    page = "<style>" + "".join(f".c{i} p ~ p .d{i % 7}{{display:none}}" for i in range(1000)) + "x{" * 12 + "</style>" + "<p class=d1>w" * 5000
    assert len(visible_text(page).split()) == 5000


@pytest.mark.parametrize("sheet", ["x{" * 5000, "&&{" * 5000, ":is(" * 5000 + "p{display:none}", "@media " + "(" * 5000 + "{p{display:none}}", "@media (min-width:1.2.3px), (aspect-ratio:1/0), (width<){p{display:none}}", "p:nth-child(" + "9" * 5000 + "){display:none}", "}}}{;;\\", "p[", "p:not({display:none}"])
def test_odd_sheets_hide_nothing(sheet):
    assert visible_text(f"<style>{sheet}</style><p>a") == "a"
