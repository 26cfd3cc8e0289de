"""Ordered classification rules as Spark ``Column`` builders.

Each rule list is evaluated top to bottom and the first match wins, which is
exactly a chained ``CASE WHEN``. The lists are data; ``_first_match`` turns
them into one ``F.when`` chain that stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference classification for identical
# results; they are listed plainly and in the order they are applied.
#
# Regex note: "$" of the original patterns is written "\z" here, because a
# Java "$" also matches before a trailing newline while RE2's does not.
# ---------------------------------------------------------------------------
ASSET_PATTERN = r"\.(axd|js|css|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot)(\?|\z)"
CART_WORDS = ["basket", "cart"]
CHECKOUT_WORDS = ["checkout", "payment", "revieworder"]
CONFIRMATION_WORDS = ["ordercompleted", "orderconfirm", "order-confirm", "thankyou", "thank-you"]
SEARCH_WORDS = ["/search", "?q=", "&q=", "asearch"]
SEARCH_PARAM_PATTERN = r"[?&](query|keyword|search)="
QUICKVIEW_WORDS = ["quickview", "quick-view"]
STORE_LOCATOR_WORDS = ["storelocator", "store-locator", "findstore", "find-store"]
STORE_LOCATOR_PAIR = ["store", "locator"]
ACCOUNT_WORDS = ["signin", "sign-in", "login", "log-in", "account", "myaccount",
                 "my-account", "register", "signup"]
DEPTH3_PATTERN = r"^/[^/]+/[^/]+/[^/]+"
DEPTH2_PATTERN = r"^/[^/]+/[^/]+/?\z"
DEPTH1_PATTERN = r"^/[^/]+/?\z"
FUNCTIONAL_PATTERN = r"(basket|cart|checkout|search|account|login|signin)"
NOT_TOP_CATEGORY = ["/home", "/home/"]
HOMEPAGE_PATHS = ["/", "/home", "/home/"]
HOMEPAGE_PATHS_ANY_CASE = ["/index.html", "/index.htm", "/default.aspx"]

DIRECT_SOURCES = ["(direct)", "(not set)"]
SOURCE_GROUPS = [  # (group label, lower-cased substrings)
    ("google", ["google"]),
    ("bing", ["bing"]),
    ("facebook", ["facebook", "fb"]),
    ("twitter", ["twitter"]),
    ("youtube", ["youtube"]),
    ("instagram", ["instagram"]),
    ("linkedin", ["linkedin"]),
]

PAGE_TEMPLATES = ["Asset", "Cart", "Checkout", "OrderConfirmation", "SearchResults",
                  "ProductQuickview", "StoreLocator", "Account", "ProductDetail",
                  "CategoryPage", "TopCategory", "Homepage", "Other"]
# ---------------------------------------------------------------------------


def _contains_any(text: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = text.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def _first_match(rules: list[tuple[str | Column, Column]], default: Column | str) -> Column:
    expr = None
    for label, cond in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    default_col = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(default_col)


def page_template(path: Column | str) -> Column:
    """Classify a page path (query string included) into one of 13 templates."""
    p = F.col(path) if isinstance(path, str) else path
    low = F.lower(p)
    not_functional = ~low.rlike(FUNCTIONAL_PATTERN)
    rules = [
        ("Asset", p.rlike(ASSET_PATTERN)),
        ("Cart", _contains_any(low, CART_WORDS)),
        ("Checkout", _contains_any(low, CHECKOUT_WORDS)),
        ("OrderConfirmation", _contains_any(low, CONFIRMATION_WORDS)),
        ("SearchResults", _contains_any(low, SEARCH_WORDS) | low.rlike(SEARCH_PARAM_PATTERN)),
        ("ProductQuickview", _contains_any(low, QUICKVIEW_WORDS)),
        ("StoreLocator", _contains_any(low, STORE_LOCATOR_WORDS)
         | (low.contains(STORE_LOCATOR_PAIR[0]) & low.contains(STORE_LOCATOR_PAIR[1]))),
        ("Account", _contains_any(low, ACCOUNT_WORDS)),
        ("ProductDetail", p.rlike(DEPTH3_PATTERN) & not_functional),
        ("CategoryPage", p.rlike(DEPTH2_PATTERN) & not_functional),
        ("TopCategory", p.rlike(DEPTH1_PATTERN) & not_functional & ~low.isin(*NOT_TOP_CATEGORY)),
        ("Homepage", p.isin(*HOMEPAGE_PATHS) | low.isin(*HOMEPAGE_PATHS_ANY_CASE)),
    ]
    return _first_match(rules, "Other")


def source_group(source: Column | str) -> Column:
    """Normalise a raw traffic source; unmatched values pass through unchanged."""
    s = F.col(source) if isinstance(source, str) else source
    low = F.lower(s)
    rules: list[tuple[str | Column, Column]] = [("direct", s.isNull() | s.isin(*DIRECT_SOURCES))]
    rules += [(label, _contains_any(low, words)) for label, words in SOURCE_GROUPS]
    return _first_match(rules, s)


def channel_group(medium: Column | str) -> Column:
    """Marketing channel of a session's first medium."""
    m = F.col(medium) if isinstance(medium, str) else medium
    return _first_match(
        [
            ("Paid Search", m == "cpc"),
            ("Organic Search", m == "organic"),
            ("Referral", m.isin("referral")),
            ("Direct", (m == "(none)") | m.isNull()),
        ],
        "Other",
    )


def source_type(grouped_source: Column | str) -> Column:
    """google-touched / direct / other source, from a grouped source."""
    g = F.col(grouped_source) if isinstance(grouped_source, str) else grouped_source
    return _first_match(
        [
            ("google-touched", F.lower(g) == "google"),
            ("direct", g.isNull() | (g == "direct")),
        ],
        "other source",
    )
