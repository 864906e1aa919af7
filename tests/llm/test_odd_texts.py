"""Inputs that once crashed an operator or took it quadratic time."""

import time

import numpy as np
import public_tokenizers as P
import pytest

from residuum.llm import htmltext, langid, tokencount

N = 60_000
PAGES = {"quotes": '<a "' * N, "starts": "<a " * N, "divs": "<div>x" * N, "paragraphs": "<p>x" * N, "tables": "<table><tr><td>x" * 9000, "lists": "<ul><li>x" * N, "comments": "<!-- " * N,
         "mixed": "<a '\"" * N, "wide": "<table><tr><td>" + "y" * 50_000 + "<td>a" + "<tr><td>b<td>c" * 1000, "spans": "<table>" + "<tr><td colspan=99999>x<td>y" * 200}


@pytest.mark.parametrize("name", PAGES)
def test_odd_pages_are_rendered_in_seconds(name):
    start = time.time()
    shown = htmltext.visible_text(PAGES[name])
    assert time.time() - start < 20 and len(shown) < 60 * len(PAGES[name])
    assert shown.count("x") == PAGES[name].count("x") and shown.count("y") == PAGES[name].count("y")


@pytest.mark.parametrize("page, want", [
    ('<ol start="--5"><li>a</ol>', "1. a"), ('<ol start="²"><li>a</ol>', "1. a"), ('<ol start="' + "9" * 5000 + '"><li>a</ol>', "1. a"), ("<ol start=-3><li>a<li>b</ol>", "-3. a\n-2. b"),
    ("<math><mi>x</mi></math>", "x"), ("<svg><title>t</title><g><text>Hi</text></g><defs><text>no</text></defs></svg>", "Hi"), ("<select><option>one<option selected>two</select>", "two"),
    ("<select><option>one<option>two</select>", "one"), ('<div style="visibility:hidden">no<b style="visibility:visible">yes</b></div>', "yes"), ('<div style="display:none">no<b style="visibility:visible">no</b></div>', ""),
    ('<table><tr><td colspan="2">ab<td>c<tr><td>1<td>2<td>3</table>', "ab     c\n1  2  3"), ("a<table><tr><td>b<table><tr><td>c<td>d</table></table>e", "a\n\nb  c  d\n\ne"), ('x <a "y', 'x <a "y')])
def test_small_odd_pages(page, want):
    assert htmltext.visible_text(page) == want


def test_five_hundred_nested_tables():
    assert htmltext.visible_text("<table><tr><td>a" * 500).split() == ["a"] * 500


def test_long_blank_runs_are_counted_like_short_ones():
    counter = tokencount.Counter(P.path("byte_bpe_50k.tiktoken"))
    for run in (" " * 37, "\n \t" * 20, "\t" * 9 + " ", " " * 1000):
        assert tokencount.merged_lengths(run.encode(), counter.ranks) == counter._lengths(run).tolist()
    ends = counter.spans("a" + " " * 1_500_000 + "b" + "\n" * tokencount.LONG_BLANKS)
    assert ends[-1] == 1_500_002 + tokencount.LONG_BLANKS and (np.diff(ends) > 0).all()


def test_numbers_are_no_letters():
    assert not any(map(langid.has_letter, ("½", "123 ²", "Ⅷ 9", "", "_-_")))
    assert all(map(langid.has_letter, ("½ a", "é", "ß9", "中")))
