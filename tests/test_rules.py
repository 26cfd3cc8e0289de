"""Classification rule tables (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from journeykit.functions.rules import PAGE_TEMPLATES, channel_group, page_template, source_group
from journeykit.operators.flatten import TOP_CATEGORY_PATTERN

TEMPLATE_CASES = [
    ("/x/app.js?v=1", "Asset"), ("/x/app.json", "CategoryPage"), ("/APP.JS", "TopCategory"),
    ("/basket.html", "Cart"), ("/cartoons", "Cart"), ("/checkout/thankyou", "Checkout"),
    ("/ordercompleted.html", "OrderConfirmation"), ("/search", "SearchResults"),
    ("/x?q=a", "SearchResults"), ("/asearch.html", "SearchResults"), ("/x?keyword=a", "SearchResults"),
    ("/a/b/c/quickview", "ProductQuickview"), ("/our-stores/locator", "StoreLocator"),
    ("/signin.html", "Account"), ("/registering", "Account"), ("/a/b/c", "ProductDetail"),
    ("/a?u=x/y/z", "ProductDetail"), ("/google+redesign/bags/backpacks/home", "ProductDetail"),
    ("/a/b", "CategoryPage"), ("/a/b/", "CategoryPage"), ("/a", "TopCategory"),
    ("/index.html", "TopCategory"), ("/home?x=1", "TopCategory"), ("/?x=1", "TopCategory"),
    ("/", "Homepage"), ("/home", "Homepage"), ("/home/", "Homepage"), ("/HOME", "Other"),
    ("/a//b", "Other"), ("/a/research/x", "Other"), (None, "Other"),
    # one row per value of the word lists not met above
    *[(f"/x/app.{e}", "Asset") for e in ("axd", "js", "css", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2",
                                         "ttf", "eot")],
    ("/p/cart", "Cart"), ("/p/payment", "Checkout"), ("/p/revieworder", "Checkout"),
    ("/p/orderconfirm", "OrderConfirmation"), ("/p/order-confirm", "OrderConfirmation"),
    ("/p/thankyou", "OrderConfirmation"), ("/p/thank-you", "OrderConfirmation"),
    ("/p?a=b&q=c", "SearchResults"), ("/p?query=a", "SearchResults"), ("/p?a=b&search=c", "SearchResults"),
    ("/p/quick-view", "ProductQuickview"), ("/p/storelocator", "StoreLocator"), ("/p/store-locator", "StoreLocator"),
    ("/p/findstore", "StoreLocator"), ("/p/find-store", "StoreLocator"),
    *[(f"/p/{w}", "Account") for w in ("signin", "sign-in", "login", "log-in", "account", "myaccount", "my-account",
                                       "register", "signup")],
    ("/home/x", "CategoryPage"),
    # Java "$" would also match before a final newline: the asset rule must not
    # fire; the one-segment rule then matches ("[^/]" takes the newline).
    ("/a.js\n", "TopCategory"),
]

SOURCE_CASES = [
    (None, "direct"), ("(direct)", "direct"), ("(not set)", "direct"),
    ("mail.google.com", "google"), ("GOOGLE", "google"), ("m.facebook.com", "facebook"),
    ("fb", "facebook"), ("offbeat", "facebook"), ("youtube.com", "youtube"), ("bing", "bing"),
    ("twitter.com", "twitter"), ("instagram", "instagram"), ("linkedin.com", "linkedin"),
    ("t.co", "t.co"), ("Partners", "Partners"), ("", ""),
]


def test_page_templates(spark):
    df = spark.createDataFrame([(p,) for p, _ in TEMPLATE_CASES], "p STRING")
    got = {r.p: r.t for r in df.select("p", page_template(F.col("p")).alias("t")).collect()}
    for path, expected in TEMPLATE_CASES:
        assert got[path] == expected, (path, got[path], expected)
    assert set(got.values()) <= set(PAGE_TEMPLATES)


def test_source_groups(spark):
    df = spark.createDataFrame([(s,) for s, _ in SOURCE_CASES], "s STRING")
    rows = df.select("s", source_group(F.col("s")).alias("g")).collect()
    got = {r.s: r.g for r in rows}
    for src, expected in SOURCE_CASES:
        assert got[src] == expected, (src, got[src])


@pytest.mark.parametrize("medium,group", [
    ("cpc", "Paid Search"), ("organic", "Organic Search"), ("referral", "Referral"),
    ("(none)", "Direct"), (None, "Direct"), ("affiliate", "Other"), ("(not set)", "Other"),
])
def test_channel_group(spark, medium, group):
    df = spark.createDataFrame([(medium,)], "m STRING")
    assert df.select(channel_group(F.col("m")).alias("g")).first().g == group


def test_product_category(spark):
    cases = [("Home/Apparel/Kid's/Kids-Youth/", "Apparel"), ("Apparel", None),
             ("(not set)", None), (None, None)]
    df = spark.createDataFrame(cases, "c STRING, e STRING")
    out = df.select(F.nullif(F.regexp_extract("c", TOP_CATEGORY_PATTERN, 1), F.lit("")).alias("g"), "e")
    for r in out.collect():
        assert r.g == r.e
