from pyspark.sql import functions as F

from pricewren.functions import html as H, text as T


def test_normalisation(evaluate):
    assert evaluate(T.normalize_ascii, s="BRANÍK světlé  výčepní, 0,5 l") == "branik svetle vycepni 0 5 l"
    assert evaluate(T.normalize_ascii, s="été") == "ete"
    assert evaluate(T.normalize_search, s="Straße Žluťoučký — 12") == "straße zlutoucky 12"
    assert evaluate(T.normalize_loose, s="  Máslo  82 %  ") == "maslo 82 %"
    assert evaluate(T.normalize_for_index, s="Káva – ABC") == "kava - abc"
    assert evaluate(T.normalize_text, s=" a —\tb\r\nc ") == "a – b\nc"
    assert evaluate(T.normalize_line, s="- káva   10 g") == "káva 10 g"
    assert evaluate(T.normalize_line, s="•káva") == "• káva"
    assert evaluate(T.compact_text, s="a\r\nb  c") == "a | b c"


def test_accent_table_follows_unicode(evaluate):
    assert evaluate(T.fold_accents, s="ěščřžýáíéůúňťďóäöüçñêàõøß") == "escrzyaieuuntdoaoucneao" + "øß"


def test_decode_url(evaluate):
    assert evaluate(T.decode_url, s="a%2520b+c") == "a b+c"
    assert evaluate(T.decode_url, s="100 %% k%C3%A1va") == "100 %% k%C3%A1va"


def test_snippets(evaluate):
    got = evaluate(lambda s: T.snippet(s, F.lit("kava"), 3), s="xxxxx KÁVA zzzzz")
    assert got == "xx KÁVA zz"
    assert evaluate(lambda s: T.snippet(s, F.lit("čaj"), 3), s="xxxxx KÁVA zzzzz") == ""
    pos = evaluate(lambda s, w: T.flexible_position(s, w), s="GEL na praní ... WOOLITE", w="gel woolite")
    assert pos == 1
    assert evaluate(lambda s, w: T.flexible_position(s, w), s="nothing", w="gel woolite") == 0
    assert evaluate(lambda s: T.context_around(s, F.lit(5), 2), s="abcdefgh") == "cdef"


def test_page_noise(evaluate):
    got = evaluate(
        lambda s: T.remove_page_noise(s, F.lit(20)),
        s="20 nízké ceny hezky česky < Nejnižší cena za posledních 30 dní CAMEMBERT 100 g",
    )
    assert got == "CAMEMBERT 100 g"
    assert evaluate(T.longest_price_line, a=["x", "12,90 Kč", "CENA 12,90 Kč x"]) == "CENA 12,90 Kč x"


def test_html_entities(evaluate):
    assert evaluate(H.decode_html, s="K&#269; &#x10D; &amp;&lt;&nbsp;&#39;&quot;") == "Kč č &< '\""
    assert evaluate(H.decode_html, s="a &#128512; b &#0; c") == "a \U0001F600 b &#0; c"
    assert evaluate(H.decode_html, s="a\\u002Fb\\/c\\u0026\\u003D") == "a/b/c&="


def test_html_lines(evaluate):
    html = (
        "<html><script>var x='<p>';</script><h2 class='t'>Káva <b>A</b></h2><ul><li>12,90 Kč</li><li>100 g</li></ul>"
        "<p>od 1. 5.<br>do 2. 5.</p></html>"
    )
    assert evaluate(H.html_to_lines, s=html) == ["### Káva A", "12,90 Kč", "100 g", "od 1. 5.", "do 2. 5."]
    assert evaluate(H.strip_tags, s=html) == "Káva A 12,90 Kč 100 g od 1. 5. do 2. 5."


def test_paragraphs(evaluate):
    html = "<p>" + "a" * 60 + "</p><pre>x</pre><p>short</p><p>" + "b" * 60 + " schema.org</p>"
    got = evaluate(H.extract_paragraphs, s=html)
    assert got == ["a" * 60]
    long_body = "<div>" + "c " * 200 + "</div>"
    assert evaluate(H.extract_paragraphs, s=long_body) == [("c " * 200).strip()]


def test_attributes_links_assets(evaluate):
    html = """<a href="/x?a=1&amp;b=2" class='k'>Le <b>ták</b></a><img src="i.jpg" srcset="s1.png 1x, s2.png 2x">"""
    attrs = evaluate(H.extract_attributes, s=html)
    assert [(a["name"], a["value"]) for a in attrs][:2] == [("href", "/x?a=1&b=2"), ("class", "k")]
    links = evaluate(lambda s: H.extract_links(s, F.lit("https://a.cz/p/q.html")), s=html)
    assert [(l["href"], l["text"]) for l in links] == [("https://a.cz/x?a=1&b=2", "Le ták")]
    assert evaluate(H.extract_asset_urls, s=html) == ["/x?a=1&b=2", "i.jpg", "s1.png", "s2.png"]


def test_resolve_url(evaluate):
    base = "https://a.cz/p/q/r.html?x=1#f"
    cases = {
        "http://b.cz/y": "http://b.cz/y", "//c.cz/z": "https://c.cz/z", "/root": "https://a.cz/root",
        "s.html": "https://a.cz/p/q/s.html", "../up": "https://a.cz/p/up", "./same": "https://a.cz/p/q/same",
        "../../../far": "https://a.cz/far", "?q=2": "https://a.cz/p/q/r.html?q=2",
        "#g": "https://a.cz/p/q/r.html?x=1#g", "t/../u?k=../v": "https://a.cz/p/q/u?k=../v", "mailto:a@b": "mailto:a@b",
    }
    for href, want in cases.items():
        assert evaluate(lambda h, b: H.resolve_url(h, b), h=href, b=base) == want, href


def test_embedded_json_and_hints(evaluate):
    html = (
        """<script type="application/ld+json">{"a": 1}</script><script id="__NEXT_DATA__" type="x">{"b":2}</script>"""
        """<script>window.__STATE__ = {"""
        + "k" * 120
        + """};</script><a data-x="/api/offers">x</a> storeName=CZ2450"""
    )
    kinds = [b["kind"] for b in evaluate(H.extract_embedded_json, s=html)]
    assert kinds == ["script-json", "next-data", "window-state"]
    assert "/api/offers" in evaluate(H.endpoint_hints, s=html)
    assert evaluate(H.store_hints, s=html) == ["CZ2450"]


def test_percent_fragments_and_meta(evaluate):
    html = """<meta content="20 k%C3%A1va %C4%8Derstv%C3%A1 199,90 K%C4%8D"><a href="https://a.cz/k%C3%A1va-dlouh%C3%A1-adresa-cz">"""
    got = [(f["kind"], f["value"]) for f in evaluate(H.extract_percent_fragments, s=html)]
    assert ("url", "https://a.cz/káva-dlouhá-adresa-cz") in got
    assert evaluate(H.extract_meta_text, s=html) == "20 káva čerstvá 199,90 Kč"


def test_match_positions(evaluate):
    got = evaluate(lambda s: H.match_positions(s, r"\d+"), s="1a22bb333")
    assert [(m["pos"], m["match"]) for m in got] == [(0, "1"), (2, "22"), (6, "333")]
    assert evaluate(lambda s: H.match_positions(s, r"\d+"), s="none") == []


def test_addresses(evaluate):
    assert evaluate(H.classify_image, s="https://x/logo.png") == "decorative-or-cover"
    assert evaluate(H.classify_image, s="https://x/page-1.png") == "page-or-leaflet-image"
    assert evaluate(H.classify_image, s="https://x/products/1.png") == "possible-product-image"
    assert evaluate(H.classify_asset, s="https://x/a.pdf?v=1") == ["pdf"]
    assert evaluate(H.canonical_image_url, s="https://x/a.jpg?w=1") == "https://x/a.jpg"
    urls = ["https://v/1/2/pages/a-at400.jpg", "https://v/1/2/pages/a-at1600.jpg", "https://v/x-at2400.png"]
    assert evaluate(H.best_page_image, a=urls) == urls[1]
    assert evaluate(lambda a, b: H.page_number(a, address=b), a=0, b="https://x/23/index.html") == 23
    url = "https://x/p.html?kloffer-week=current&amp;kloffer-category=0042_Ovoce__zelenina_a%20dal"
    assert evaluate(H.category_from_url, s=url) == "Ovoce / zelenina a dal"
    assert evaluate(H.category_from_url, s="https://x/p.html") == "Akční nabídka"


def test_tile_diagnostics(evaluate):
    html = """<a class="k-product-tile" href="?kloffer-articleID=12"><img alt="x"><div class="k-price-tag__price">1</div></a>"""
    got = evaluate(H.tile_diagnostics, s=html * 2)
    assert (got["article_ids"], got["distinct_article_ids"], got["anchor_tiles"], got["image_alts"]) == (2, 1, 2, 2)
