"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each has its words and link density, those of its neighbours, and where it
stands (in an article, in a page part such as a menu, under a telling class or id). A decision tree, trained on the
small labelled table below, decides for each block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text.
DROPPED = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "video", "audio",
           "textarea", "select", "button", "title", "datalist")
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "img", "nobr", "rb", "rt", "rp"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Parts of a page that are not its article.
PARTS = frozenset(("nav", "aside", "footer", "form", "menu", "dialog", "header"))
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are followed from their start to their end tag.
FOLLOWED = PARTS | ARTICLE | frozenset(("div", "section", "ul", "ol", "dl", "table", "figure", "fieldset", "p", "span", "center", "details"))
#: Words of class, id and role. What these stand on is no text of an article, though an article may stand in it;
HARD = frozenset((
    "ad", "ads", "adbox", "adsense", "advert", "advertisement", "adverts", "banner", "bottombar", "breadcrumb", "breadcrumbs", "byline", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "copyright", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "paywall", "popup", "promo",
    "promotion", "share", "sharing", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar"))
#: these are doubtful, and a block's own words, links and neighbours decide;
SOFT = frozenset((
    "alert", "author", "dialog", "form", "legal", "notification", "search", "tags", "toc", "tracking", "warning", "widget"))
#: in these, articles are others' articles.
NEVER_ARTICLE = frozenset((
    "comment", "comments", "commentlist", "discussion", "disqus", "recommended", "related", "remark", "remarks", "replies", "reply", "respond", "sidebar", "thread"))
OTHER_OUTSIDE = frozenset(("header", "masthead", "sitename", "logo"))
OWN = frozenset(("article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"))

FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "in article", "in part", "heading", "named", "beside an article")
#: The labelled table: a row for each block, with FEATURES and whether it is main text. named is 1 where a paragraph's own
#: class, id or role has a doubtful word, 2 where that of an element around it has, 3 where either has a hard one; the last
#: feature is 1 for blocks outside the article of a page that has one.
LABELLED = (
    (120, 0.00, 60, 0.00, 80, 0.00, 1, 0, 0, 0, 0, 1), (45, 0.05, 120, 0.00, 30, 0.00, 1, 0, 0, 0, 0, 1), (12, 0.00, 0, 0.00, 90, 0.00, 1, 0, 1, 0, 0, 1),
    (3, 0.00, 80, 0.00, 1, 0.00, 1, 0, 0, 0, 0, 1), (1, 0.00, 3, 0.00, 60, 0.00, 1, 0, 0, 0, 0, 1), (1, 0.00, 4, 1.00, 2, 0.00, 1, 0, 1, 0, 0, 1),
    (2, 0.00, 9, 0.00, 9, 0.20, 1, 0, 0, 0, 0, 1), (20, 0.60, 90, 0.00, 70, 0.00, 1, 0, 0, 0, 0, 1), (6, 1.00, 40, 0.00, 50, 0.00, 1, 0, 0, 0, 0, 1),
    (4, 1.00, 70, 0.00, 0, 0.00, 1, 0, 0, 0, 0, 1), (200, 0.02, 0, 0.00, 0, 0.00, 1, 0, 0, 0, 0, 1), (8, 0.00, 2, 1.00, 15, 0.00, 1, 0, 1, 0, 0, 1),
    (5, 0.00, 60, 0.00, 0, 0.00, 1, 0, 0, 0, 0, 1), (2, 0.00, 20, 0.00, 0, 0.00, 1, 0, 0, 0, 0, 1), (18, 0.10, 3, 1.00, 2, 1.00, 1, 0, 0, 0, 0, 1),
    (1, 0.00, 2, 1.00, 1, 1.00, 1, 0, 0, 0, 0, 1), (4, 0.50, 1, 1.00, 3, 1.00, 1, 0, 0, 0, 0, 1), (9, 0.00, 0, 0.00, 0, 0.00, 1, 0, 1, 0, 0, 1),
    (60, 0.00, 50, 0.00, 1, 1.00, 1, 0, 0, 0, 0, 1), (7, 0.80, 3, 1.00, 4, 0.90, 1, 0, 0, 0, 0, 1), (2, 1.00, 2, 1.00, 0, 0.00, 1, 0, 0, 0, 0, 0),
    (33, 0.00, 5, 1.00, 0, 0.00, 1, 0, 0, 0, 0, 1), (3, 0.00, 4, 0.00, 5, 0.60, 1, 0, 1, 0, 0, 1), (1, 0.00, 0, 0.00, 6, 1.00, 1, 0, 0, 0, 0, 1),
    (80, 0.00, 1, 1.00, 0, 0.00, 0, 0, 0, 0, 0, 1), (60, 0.00, 40, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 1), (1, 1.00, 0, 0.00, 1, 1.00, 0, 1, 0, 0, 0, 0),
    (2, 1.00, 1, 1.00, 2, 1.00, 0, 1, 0, 0, 0, 0), (1, 1.00, 1, 1.00, 12, 0.00, 0, 1, 0, 0, 0, 0), (9, 0.00, 1, 1.00, 10, 0.00, 0, 1, 0, 0, 0, 0),
    (40, 0.00, 90, 0.00, 35, 0.00, 0, 1, 0, 0, 0, 0), (65, 0.02, 30, 0.00, 80, 0.00, 0, 1, 0, 0, 0, 0), (14, 0.00, 50, 0.00, 0, 0.00, 0, 1, 0, 0, 0, 0),
    (5, 0.00, 0, 0.00, 60, 0.00, 0, 1, 1, 0, 0, 0), (30, 0.10, 60, 0.00, 25, 0.00, 1, 1, 0, 0, 0, 0), (7, 0.00, 40, 0.00, 30, 0.00, 1, 1, 0, 0, 0, 0),
    (3, 1.00, 80, 0.00, 2, 1.00, 1, 1, 0, 0, 0, 0), (4, 0.00, 30, 0.00, 6, 0.50, 1, 1, 1, 0, 0, 0), (110, 0.00, 30, 0.00, 70, 0.00, 0, 0, 0, 0, 0, 1),
    (60, 0.04, 8, 0.00, 45, 0.00, 0, 0, 0, 0, 0, 1), (35, 0.10, 90, 0.00, 55, 0.02, 0, 0, 0, 0, 0, 1), (25, 0.20, 3, 1.00, 60, 0.00, 0, 0, 0, 0, 0, 1),
    (22, 0.00, 40, 0.00, 3, 1.00, 0, 0, 0, 0, 0, 1), (18, 0.00, 50, 0.00, 60, 0.00, 0, 0, 0, 0, 0, 1), (9, 0.00, 40, 0.00, 70, 0.00, 0, 0, 0, 0, 0, 1),
    (5, 0.00, 60, 0.00, 40, 0.00, 0, 0, 0, 0, 0, 1), (7, 0.00, 2, 1.00, 80, 0.00, 0, 0, 1, 0, 0, 1), (10, 0.00, 1, 1.00, 45, 0.00, 0, 0, 1, 0, 0, 1),
    (4, 0.00, 55, 0.00, 65, 0.00, 0, 0, 1, 0, 0, 1), (2, 0.00, 30, 0.00, 90, 0.00, 0, 0, 1, 0, 0, 1), (21, 0.05, 3, 0.00, 2, 0.00, 0, 0, 0, 0, 0, 1),
    (14, 0.00, 3, 1.00, 5, 0.00, 0, 0, 0, 0, 0, 1), (16, 0.00, 20, 0.00, 25, 0.00, 0, 0, 0, 0, 0, 1), (13, 0.10, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 1),
    (30, 0.20, 2, 1.00, 1, 1.00, 0, 0, 0, 0, 0, 1), (19, 0.00, 1, 0.00, 4, 1.00, 0, 0, 0, 0, 0, 1), (3, 0.00, 21, 0.00, 22, 0.00, 0, 0, 0, 0, 0, 1),
    (2, 0.00, 25, 0.00, 18, 0.00, 0, 0, 0, 0, 0, 1), (3, 0.00, 0, 0.00, 21, 0.05, 0, 0, 1, 0, 0, 1), (5, 0.00, 3, 1.00, 16, 0.00, 0, 0, 1, 0, 0, 1),
    (25, 0.60, 20, 0.00, 20, 0.00, 0, 0, 0, 0, 0, 0), (20, 0.50, 2, 1.00, 30, 0.00, 0, 0, 0, 0, 0, 0), (4, 0.00, 20, 0.00, 2, 1.00, 0, 0, 0, 0, 0, 0),
    (8, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 0, 0), (3, 0.90, 21, 0.00, 22, 0.00, 0, 0, 0, 0, 0, 0), (6, 0.00, 4, 0.00, 3, 0.00, 0, 0, 0, 0, 0, 1),
    (7, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 1), (9, 0.10, 5, 0.50, 4, 0.00, 0, 0, 0, 0, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0, 0, 0),
    (2, 1.00, 60, 0.00, 2, 1.00, 0, 0, 0, 0, 0, 0), (3, 1.00, 2, 1.00, 40, 0.00, 0, 0, 0, 0, 0, 0), (30, 0.90, 5, 1.00, 20, 0.80, 0, 0, 0, 0, 0, 0),
    (45, 0.85, 60, 0.00, 3, 0.00, 0, 0, 0, 0, 0, 0), (4, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 0, 0), (6, 0.00, 1, 1.00, 4, 0.50, 0, 0, 0, 0, 0, 0),
    (8, 0.40, 70, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 0), (5, 0.00, 60, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 1), (3, 0.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0, 0, 0),
    (2, 0.00, 1, 1.00, 2, 1.00, 0, 0, 1, 0, 0, 0), (3, 0.00, 2, 0.00, 1, 1.00, 0, 0, 1, 0, 0, 0), (19, 0.00, 60, 0.00, 80, 0.00, 1, 0, 0, 2, 0, 1),
    (60, 0.02, 30, 0.00, 70, 0.00, 1, 0, 0, 2, 0, 1), (3, 1.00, 40, 0.00, 2, 1.00, 1, 0, 0, 2, 0, 0), (150, 0.00, 9, 0.00, 20, 0.00, 1, 0, 0, 2, 0, 1),
    (12, 0.00, 0, 0.00, 40, 0.00, 0, 0, 0, 2, 0, 1), (80, 0.00, 40, 0.00, 60, 0.00, 0, 0, 0, 2, 0, 1), (5, 0.40, 3, 1.00, 3, 1.00, 0, 0, 0, 2, 0, 0),
    (4, 0.00, 90, 0.00, 6, 0.00, 0, 0, 1, 2, 0, 0), (24, 0.00, 60, 0.00, 45, 0.00, 1, 0, 0, 1, 0, 1), (70, 0.05, 12, 0.00, 30, 0.00, 1, 0, 0, 1, 0, 1),
    (35, 0.10, 3, 1.00, 50, 0.00, 0, 0, 0, 1, 0, 1), (18, 0.00, 40, 0.00, 40, 0.00, 1, 0, 0, 1, 0, 1), (4, 0.00, 60, 0.00, 45, 0.00, 1, 0, 0, 1, 0, 0),
    (9, 0.00, 20, 0.00, 70, 0.00, 1, 0, 0, 1, 0, 0), (12, 0.00, 50, 0.00, 30, 0.00, 1, 0, 0, 1, 0, 1), (30, 0.80, 60, 0.00, 45, 0.00, 1, 0, 0, 1, 0, 0),
    (20, 0.60, 60, 0.00, 30, 0.00, 1, 0, 0, 1, 0, 0), (6, 0.00, 30, 0.00, 3, 1.00, 0, 0, 0, 1, 0, 0), (25, 0.50, 3, 1.00, 2, 1.00, 0, 0, 0, 1, 0, 0),
    (2, 1.00, 40, 0.00, 9, 0.00, 1, 0, 0, 1, 0, 0), (80, 0.00, 1, 1.00, 0, 0.00, 0, 0, 0, 0, 1, 0), (60, 0.00, 40, 0.00, 0, 0.00, 0, 0, 0, 0, 1, 0),
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 1, 0, 0, 1, 0), (2, 1.00, 1, 1.00, 2, 1.00, 0, 1, 0, 0, 1, 0), (1, 1.00, 1, 1.00, 12, 0.00, 0, 1, 0, 0, 1, 0),
    (9, 0.00, 1, 1.00, 10, 0.00, 0, 1, 0, 0, 1, 0), (40, 0.00, 90, 0.00, 35, 0.00, 0, 1, 0, 0, 1, 0), (65, 0.02, 30, 0.00, 80, 0.00, 0, 1, 0, 0, 1, 0),
    (14, 0.00, 50, 0.00, 0, 0.00, 0, 1, 0, 0, 1, 0), (5, 0.00, 0, 0.00, 60, 0.00, 0, 1, 1, 0, 1, 0), (110, 0.00, 30, 0.00, 70, 0.00, 0, 0, 0, 0, 1, 0),
    (60, 0.04, 8, 0.00, 45, 0.00, 0, 0, 0, 0, 1, 0), (35, 0.10, 90, 0.00, 55, 0.02, 0, 0, 0, 0, 1, 0), (25, 0.20, 3, 1.00, 60, 0.00, 0, 0, 0, 0, 1, 0),
    (22, 0.00, 40, 0.00, 3, 1.00, 0, 0, 0, 0, 1, 0), (18, 0.00, 50, 0.00, 60, 0.00, 0, 0, 0, 0, 1, 0), (9, 0.00, 40, 0.00, 70, 0.00, 0, 0, 0, 0, 1, 0),
    (5, 0.00, 60, 0.00, 40, 0.00, 0, 0, 0, 0, 1, 0), (7, 0.00, 2, 1.00, 80, 0.00, 0, 0, 1, 0, 1, 0), (10, 0.00, 1, 1.00, 45, 0.00, 0, 0, 1, 0, 1, 0),
    (4, 0.00, 55, 0.00, 65, 0.00, 0, 0, 1, 0, 1, 0), (2, 0.00, 30, 0.00, 90, 0.00, 0, 0, 1, 0, 1, 0), (21, 0.05, 3, 0.00, 2, 0.00, 0, 0, 0, 0, 1, 0),
    (14, 0.00, 3, 1.00, 5, 0.00, 0, 0, 0, 0, 1, 0), (16, 0.00, 20, 0.00, 25, 0.00, 0, 0, 0, 0, 1, 0), (13, 0.10, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1, 0),
    (60, 0.00, 40, 0.00, 30, 0.00, 0, 0, 0, 3, 0, 0), (60, 0.00, 40, 0.00, 30, 0.00, 1, 0, 0, 3, 0, 0), (12, 0.00, 5, 0.00, 80, 0.00, 0, 0, 0, 3, 0, 0),
    (12, 0.00, 5, 0.00, 80, 0.00, 1, 0, 0, 3, 0, 0), (90, 0.02, 0, 0.00, 20, 0.00, 0, 0, 0, 3, 0, 0), (90, 0.02, 0, 0.00, 20, 0.00, 1, 0, 0, 3, 0, 0),
    (3, 1.00, 2, 1.00, 60, 0.00, 0, 0, 0, 3, 0, 0), (3, 1.00, 2, 1.00, 60, 0.00, 1, 0, 0, 3, 0, 0), (25, 0.00, 60, 0.00, 45, 0.00, 0, 0, 0, 3, 0, 0),
    (25, 0.00, 60, 0.00, 45, 0.00, 1, 0, 0, 3, 0, 0), (5, 0.00, 40, 0.00, 9, 0.00, 0, 0, 0, 3, 0, 0), (5, 0.00, 40, 0.00, 9, 0.00, 1, 0, 0, 3, 0, 0),
    (3, 1.00, 3, 1.00, 4, 1.00, 1, 0, 0, 0, 0, 0), (2, 1.00, 50, 0.00, 3, 1.00, 1, 0, 0, 0, 0, 0), (4, 0.95, 3, 1.00, 60, 0.00, 1, 0, 0, 0, 0, 0),
    (1, 1.00, 1, 1.00, 2, 1.00, 1, 0, 0, 0, 0, 0), (5, 1.00, 4, 1.00, 0, 0.00, 1, 0, 0, 0, 0, 0), (6, 0.92, 2, 1.00, 7, 0.90, 1, 0, 0, 0, 0, 0),
    (3, 1.00, 60, 0.00, 40, 0.00, 1, 0, 0, 0, 0, 1), (5, 1.00, 20, 0.10, 70, 0.00, 1, 0, 0, 0, 0, 1), (9, 0.50, 3, 0.40, 30, 0.00, 1, 0, 0, 0, 0, 1),
    (20, 0.95, 70, 0.00, 60, 0.00, 1, 0, 0, 0, 0, 1), (15, 0.93, 22, 0.95, 18, 0.90, 1, 0, 0, 0, 0, 1), (7, 0.60, 30, 0.00, 6, 0.60, 1, 0, 0, 0, 0, 1),
    (5, 0.00, 6, 0.00, 7, 0.00, 0, 0, 0, 0, 0, 1), (4, 0.00, 0, 0.00, 6, 0.00, 0, 0, 0, 0, 0, 1), (7, 0.00, 5, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 1),
    (3, 0.00, 8, 0.00, 2, 0.00, 0, 0, 0, 0, 0, 1), (6, 0.00, 6, 0.10, 5, 0.00, 0, 0, 0, 0, 0, 1), (2, 0.00, 3, 0.00, 9, 0.00, 0, 0, 0, 0, 0, 1),
    (10, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 1), (30, 0.00, 40, 0.00, 30, 0.00, 0, 0, 0, 1, 0, 1), (30, 0.00, 40, 0.00, 30, 0.00, 1, 0, 0, 1, 0, 1),
    (30, 0.00, 40, 0.00, 30, 0.00, 0, 0, 0, 2, 0, 1), (30, 0.00, 40, 0.00, 30, 0.00, 1, 0, 0, 2, 0, 1), (14, 0.10, 3, 1.00, 50, 0.00, 0, 0, 0, 1, 0, 1),
    (14, 0.10, 3, 1.00, 50, 0.00, 1, 0, 0, 1, 0, 1), (14, 0.10, 3, 1.00, 50, 0.00, 0, 0, 0, 2, 0, 1), (14, 0.10, 3, 1.00, 50, 0.00, 1, 0, 0, 2, 0, 1),
    (22, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1, 0, 1), (22, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0, 1, 0, 1), (22, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 2, 0, 1),
    (22, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0, 2, 0, 1), (60, 0.05, 9, 0.00, 12, 0.00, 0, 0, 0, 1, 0, 1), (60, 0.05, 9, 0.00, 12, 0.00, 1, 0, 0, 1, 0, 1),
    (60, 0.05, 9, 0.00, 12, 0.00, 0, 0, 0, 2, 0, 1), (60, 0.05, 9, 0.00, 12, 0.00, 1, 0, 0, 2, 0, 1), (11, 0.00, 30, 0.00, 25, 0.00, 0, 0, 0, 1, 0, 1),
    (11, 0.00, 30, 0.00, 25, 0.00, 1, 0, 0, 1, 0, 1), (11, 0.00, 30, 0.00, 25, 0.00, 0, 0, 0, 2, 0, 1), (11, 0.00, 30, 0.00, 25, 0.00, 1, 0, 0, 2, 0, 1),
    (3, 0.00, 40, 0.00, 60, 0.00, 0, 0, 0, 1, 0, 0), (3, 0.00, 40, 0.00, 60, 0.00, 1, 0, 0, 1, 0, 0), (3, 0.00, 40, 0.00, 60, 0.00, 0, 0, 0, 2, 0, 0),
    (3, 0.00, 40, 0.00, 60, 0.00, 1, 0, 0, 2, 0, 0), (2, 1.00, 3, 1.00, 2, 1.00, 0, 0, 0, 1, 0, 0), (2, 1.00, 3, 1.00, 2, 1.00, 1, 0, 0, 1, 0, 0),
    (2, 1.00, 3, 1.00, 2, 1.00, 0, 0, 0, 2, 0, 0), (2, 1.00, 3, 1.00, 2, 1.00, 1, 0, 0, 2, 0, 0), (6, 0.50, 30, 0.00, 3, 1.00, 0, 0, 0, 1, 0, 0),
    (6, 0.50, 30, 0.00, 3, 1.00, 1, 0, 0, 1, 0, 0), (6, 0.50, 30, 0.00, 3, 1.00, 0, 0, 0, 2, 0, 0), (6, 0.50, 30, 0.00, 3, 1.00, 1, 0, 0, 2, 0, 0),
    (8, 0.00, 70, 0.00, 5, 0.00, 0, 0, 0, 1, 0, 0), (8, 0.00, 70, 0.00, 5, 0.00, 1, 0, 0, 1, 0, 0), (8, 0.00, 70, 0.00, 5, 0.00, 0, 0, 0, 2, 0, 0),
    (8, 0.00, 70, 0.00, 5, 0.00, 1, 0, 0, 2, 0, 0), (15, 0.80, 20, 0.00, 30, 0.00, 0, 0, 0, 1, 0, 0), (15, 0.80, 20, 0.00, 30, 0.00, 1, 0, 0, 1, 0, 0),
    (15, 0.80, 20, 0.00, 30, 0.00, 0, 0, 0, 2, 0, 0), (15, 0.80, 20, 0.00, 30, 0.00, 1, 0, 0, 2, 0, 0),
)

TOKEN = re.compile(
    r"<!--.*?(?:--\s*>|\Z)|<(" + "|".join(DROPPED) + r")\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PLAIN = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=100_000)
def _said(attributes: str) -> tuple[int, bool]:
    """(how surely it tells of other things, does so outside an article only) by class, id, role and hiding.

    0 not at all, 1 by a doubtful word, 2 by a hard one, 3 by a word of what may hold articles of its own, or by hiding. A
    name of several words is what its last word says ("main-nav" is a nav, "entry-content" is content), or else what its
    others say; names that begin with has, with, no or is tell of the page. Of several names on one element, one that tells
    of the article itself by its last word outweighs doubtful ones alone.
    """
    if not attributes or attributes.isspace():
        return 0, False
    if HIDDEN.search(attributes):
        return 3, False
    level, own, outside = 0, False, False
    for m in NAMED.finditer(attributes):
        for name in m[1].strip("\"'").split():
            parts = PLAIN.findall(CAMEL.sub(" ", name).lower())
            if not parts or len(parts) > 1 and parts[0] in ("has", "with", "no", "is"):
                continue
            kinds = [3 if p in NEVER_ARTICLE else 2 if p in HARD else 1 if p in SOFT else 0 for p in parts]
            outside |= bool(OTHER_OUTSIDE.intersection(parts))
            if parts[-1] in OWN:
                # "comment-text" is no text of the article, "legal-text" may be.
                said = 3 if 3 in kinds else int(1 in kinds)
                level, own = max(level, said), own or not said
            else:
                level = max(level, kinds[-1] or max(kinds))
    return (0 if own and level == 1 else level), outside and not own


def flat_blocks(page: str) -> list[tuple[str, float, int, int, int, int]]:
    """(text, link density, in article, in another part, heading, named) of each text block in page order."""
    out: list[tuple[str, float, int, int, int, int]] = []
    # Of open elements: name, and what it adds to the counts of articles, parts, doubtful words around and on a paragraph, and hard words.
    stack: list[tuple[str, int, int, int, int, int]] = []
    article = part = named = own = hard = 0
    heading = in_link = False
    texts: list[str] = []
    links: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            inside = " ".join(html.unescape(" ".join(links)).split())
            out.append((text, min(1.0, len(inside) / len(text)), int(article > 0), int(part > 0), int(heading), 3 if hard else 2 if named else int(own > 0)))
        texts.clear()
        links.clear()

    def close(k: int) -> None:
        nonlocal article, part, named, own, hard
        for _, a, p, c, o, h in stack[k:]:
            article, part, named, own, hard = article - a, part - p, named - c, own - o, hard - h
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            data = page[at:m.start()]
            texts.append(data)
            if in_link:
                links.append(data)
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not m[2]
            if name != "span" or not (stack and m[2]) and not m[4]:
                continue
        if name == "br":
            texts.append(" ")
            continue
        if name != "span":
            end()
            in_link = False
        if name in HEADINGS:
            heading = not m[2]
        if name not in FOLLOWED:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name == "span" and any(stack[k][1:]):
                        end()
                    close(k)
                    break
                if name in ("p", "span") and stack[k][0] not in ("p", "span"):
                    break
        elif not m[4].endswith("/"):
            if name == "p":
                while stack and stack[-1][0] in ("p", "span"):
                    close(len(stack) - 1)
            other, outside = _said(m[4])
            a, p, c, o, h = int(name in ARTICLE), 0, 0, 0, 0
            if name in ARTICLE:
                # Words on what wraps the page's article say nothing of the article.
                if other < 3 and not article and not part:
                    c, h = -named, -hard
            else:
                p = int(other == 3 or name in PARTS and not (name == "header" and article))
                if not p and (other == 2 or outside and not article):
                    h = 1
                elif not p and other:
                    c, o = (0, 1) if name == "p" else (1, 0)
            if name == "span" and (p or c or h):
                end()
            if name not in ("p", "span") or p or c or o or h:
                stack.append((name, a, p, c, o, h))
                article, part, named, own, hard = article + a, part + p, named + c, own + o, hard + h
    if at < len(page):
        texts.append(page[at:])
    end()
    return out


def block_features(blocks: list[tuple[str, float, int, int, int, int]]) -> np.ndarray:
    n = len(blocks)
    words = np.array([b[0].count(" ") + 1 for b in blocks], float)
    links, article, part, heading, named = (np.array([b[k] for b in blocks], float) for k in (1, 2, 3, 4, 5))
    before = lambda x: np.concatenate([[0.0], x[:-1]]) if n else x
    after = lambda x: np.concatenate([x[1:], [0.0]]) if n else x
    beside = (article == 0) & bool(((article == 1) & (part == 0)).any())
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), article, part, heading, named, beside])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a share of ones, or (feature, threshold, tree at or below, tree above)."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, t, low)
    if best is None:
        return float(y.mean())
    _, f, t, low = best
    return f, float(t), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def decide(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    f, t, low, high = node
    below = x[:, f] <= t
    out = np.empty(len(x))
    out[below], out[~below] = decide(low, x[below]), decide(high, x[~below])
    return out


def main_text(page: str | None) -> str:
    blocks = flat_blocks(page or "")
    if not blocks:
        return ""
    keep = decide(tree(), block_features(blocks)) >= 0.5
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, whole pages in, whole texts out.

    Null and empty html, and pages without main text, give an empty text. Repeated rows are extracted each; null ids
    and urls are passed on. Only the three named columns are read. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(
        run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
