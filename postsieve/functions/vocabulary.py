"""Default vocabularies and formats.

Everything here is a default argument of some operator; pass other values to screen
for other words.
"""

from __future__ import annotations

import json
from html.entities import html5

# The word lists that decide which postings are kept.
INCLUDE_TERMS = [
    "graduate", "entry level", "entry-level", "associate", "0-1 year",
    "0-2 year", "new grad", "trainee", "fresher", "junior", "internship",
    "campus", "early career", "recent graduate",
]
VETO_TERMS = [
    "director", "senior", "sr.", "sr ", "staff", "principal", "lead",
    "manager", "head of", "vice president", "vp,", "vp ", "chief",
    "president", "executive", "years of experience", "years experience",
    "3+ year", "5+ year", "7+ year", "10+ year",
]
PLACE_TERMS = [
    "india", "bengaluru", "bangalore", "hyderabad", "pune", "chennai",
    "mumbai", "gurgaon", "gurugram", "noida", "delhi", "kolkata",
    "ahmedabad", "kochi", "coimbatore", "indore", "navi mumbai",
]

# Path words of pages that are articles, not postings.
ARTICLE_PATH_WORDS = ["blog", "news", "stories", "insights", "article"]

# Sizes used by the paged view, the row id and the short title.
PAGE_SIZE = 10
ID_TITLE_CHARS = 40
SHORT_TITLE_CHARS = 50

# Display formats and labels.
DISPLAY_DATE_FORMAT = "MMM d, HH:mm"
PLACEHOLDER = "—"
NEVER = "never"

# Characters the source data model treats as blank (Unicode white space plus the four
# information separators) and as line ends. Written as regex class members that
# java.util.regex and RE2 both read.
BLANK_CLASS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_END_CLASS = r"\x{0a}-\x{0d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
BLANK_CHARS = "".join(
    chr(c)
    for lo, hi in [
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ]
    for c in range(lo, hi + 1)
)

# A word character: any letter, any number, underscore.
WORD_CLASS = r"\p{L}\p{N}_"

# The named HTML references, as the standard library lists them, by the first two letters of their names; "&amp;" is decoded apart, last.
_REFERENCES = {name[:-1]: char for name, char in html5.items() if name.endswith(";") and name not in ("amp;", "AMP;")}
HTML_REFERENCES_JSON = json.dumps({
    start: {name: char for name, char in _REFERENCES.items() if name[:2] == start} for start in sorted({name[:2] for name in _REFERENCES})
})

# HTML elements that begin and end a line of visible text.
BLOCK_ELEMENTS = [
    "address", "article", "aside", "blockquote", "br", "caption", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tr", "ul",
]
