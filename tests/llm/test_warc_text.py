"""Folding of white space in the plain text of pages, against plain substitutions."""

import html
import random
import re

from tsfold.llm import warc


def test_white_space_as_by_substitutions():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\r", "\t", " ", " ", "\x1c", "\x85", "　", "&nbsp;", "&#10;", "&#13;", "a", "é", "<p>", "</p>", "<b>", "<br>", "x<y", ""]
    for _ in range(20000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        folded = re.sub(r"\s+", " ", page)
        assert warc._folded(page) == folded
        text = html.unescape(warc._TAG.sub(warc._without_tag, warc._BLOCK.sub("\n", folded))).replace("\r", " ")
        assert warc.plain_text(page) == re.sub(r" ?\n[\n ]*", "\n", re.sub(r"[^\S\n]+", " ", text)).strip()
