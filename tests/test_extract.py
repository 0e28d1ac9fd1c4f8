import pytest
from pyspark.sql import functions as F

from pricewren.operators import extract as X, reconcile as R


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_heading_blocks(spark):
    html = """
    <h1>Akční nabídka</h1><h2>Káva Alfa</h2><p>250 g</p><p>1 kg 399,60 Kč</p><li>23,90 Kč</li><p>s PENNY kartou</p>
    <p>99,90 Kč 139,90 Kč</p><p>100 g 39,96 Kč</p><p>od st 13. 5.</p><p>do út 19. 5.</p>
    <h2>Bez ceny</h2><p>nic</p><h3>Mléko <b>1 l</b></h3><p>19,90 Kč</p>"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = rows(X.extract_heading_blocks(df), "product", "packageSize", "price", "priceType", "unitPrice", "unit", "validFrom")
    assert got == [
        ("Káva Alfa", "250 g", 99.9, "s kartou", 39.96, "Kč/100 g", "od st 13. 5."),
        ("Mléko 1 l", "", 19.9, "akční cena", 19.9, "Kč/ks", ""),
    ]


def test_unit_segments_and_reconciliation(spark):
    line = (
        "20 nízké ceny hezky česky 69,90 279,90/ 25% 9,90 KÁVA ALFA různé druhy 210 g 100 g 33,29 Kč "
        "NÁPOJ BETA různé druhy 500 ml 100 ml 19,80 Kč < 8,90 Kč BANÁNY cena za 1 kg SÝR GAMA 80/100 g 100 g 29,90/23,90 Kč "
        "od středy 13. 5. 2026 do úterý 19. 5. 2026"
    )
    df = spark.createDataFrame([(1, 20, line)], "page_id int, page_number int, line string")
    segments = X.extract_unit_segments(df)
    got = rows(segments, "ordinal", "product", "packageSize", "unitBase", "unitPrices", "leadPrices")
    assert got == [
        (0, "KÁVA ALFA", "210 g", "100 g", [33.29], [69.9, 9.9]),
        (1, "NÁPOJ BETA", "500 ml", "100 ml", [19.8], [69.9, 9.9]),
        (2, "SÝR GAMA", "80/100 g", "100 g", [29.9, 23.9], [69.9, 9.9]),
    ]
    final = {r["product"]: r for r in R.reconcile_segments(segments).collect()}
    assert final["KÁVA ALFA"]["price"] == 69.9 and final["KÁVA ALFA"]["confidence"] == "high"
    assert final["NÁPOJ BETA"]["price"] == 9.9 and final["NÁPOJ BETA"]["debug"]["source"] == "computed-adjusted-unit-price"
    assert final["NÁPOJ BETA"]["suspect"] is False
    assert str(final["KÁVA ALFA"]["validTo"]) == "2026-05-19"


def test_bullet_blocks(spark):
    text = (
        "AKČNÍ NABÍDKA\nKáva Alfa\nzrnková\n199,90\n• vybrané druhy\n• 500 g\n• 1 kg = 399,80 Kč\nSUPER CENA\nSýr\n• 100 g od 7,83 Kč\n"
        "• 270–280 g\nbez balení\n• pouze text\n"
    )
    df = spark.createDataFrame([(1, 3, text)], "page_id int, page_number int, text string")
    got = rows(X.extract_bullet_blocks(df), "product", "packageSize", "price", "priceText", "confidence", "suspectReasons")
    assert got == [
        ("Káva Alfa zrnková", "500 g", pytest.approx(199.9), "199,90 Kč", "medium", []),
        ("Sýr", "100 g", pytest.approx(7.83), "7,83 Kč", "medium", []),
    ]


def test_bullet_pattern(spark):
    text = "Káva Alfa • zrnková • 500 g • 1 kg = 399,80 Kč 199,90 Kč • Sýr • plátky • 100 g • 100 g = 2019,90 Kč •"
    df = spark.createDataFrame([(1, text)], "page_id int, text string")
    got = rows(X.extract_bullet_pattern(df), "product", "description", "packageSize", "price", "unitPrice", "unit")
    assert got[0] == ("Káva Alfa", "zrnková", "500 g", 199.9, 399.8, "Kč/1 kg")


def test_windows(spark):
    text = "AAA\n12,90 Kč\n100 g\nBBB\nCCC\nDDD\nEEE\nFFF\nGGG\nHHH"
    df = spark.createDataFrame([(1, text)], "page_id int, text string")
    got = rows(X.extract_line_windows(df), "priceText", "packageSize", "rawContext")
    assert len(got) == 5 and got[0] == ("12,90 Kč", "100 g", "AAA 12,90 Kč 100 g BBB CCC")
    text = "Káva Alfa • 500 g • 1 kg = 399,80 Kč • 199,90 Kč"
    df = spark.createDataFrame([(1, text)], "page_id int, text string")
    got = rows(X.extract_by_unit_window(df), "product", "packageSize", "price", "unitPrice")
    assert [g[1:] for g in got] == [("500 g", 199.9, 399.8)]
    got = rows(X.extract_bullet_neighbourhood(df), "part", "product", "packageSize", "price")
    assert got[0] == (0, "Káva Alfa", "500 g", 199.9)


def test_price_marker_candidates(spark):
    text = "Dnes PIVO ALFA světlé 0,5 l plech < 12,90 Kč SÝR BETA plátky 100 g za 29,90 Kč"
    df = spark.createDataFrame([(20, text)], "page_number int, text string")
    got = rows(X.extract_price_marker_candidates(df), "product", "price", "kind", "category", "score")
    assert got[0][1:] == (12.9, "action-lt", "pivo", 9)
    assert got[1][0] == "SÝR BETA plátky"


def test_dictionary_blocks(spark):
    text = "úvod KÁVA ALFA 100 g < 59,90 Kč Káva Alfa Extra 250 g 100 g 20,00 Kč < 49,90 Kč SÝR < 9,90 Kč"
    df = spark.createDataFrame([(1, text)], "page_id int, text string")
    starts = ["KÁVA ALFA", "KÁVA ALFA EXTRA", "SYR", "MLÉKO"]
    blocks = X.extract_dictionary_blocks(df, starts)
    assert rows(blocks, "pos", "start") == [(5, "KÁVA ALFA"), (32, "KÁVA ALFA EXTRA"), (text.index("SÝR"), "SYR")]
    offers = rows(X.dictionary_offers(blocks), "product", "packageSize", "price", "unitPrice")
    assert offers == [("KÁVA ALFA", "100 g", 59.9, None), ("Káva Alfa Extra", "250 g", 49.9, 20.0), ("SÝR < 9,90 Kč", "", 9.9, None)]
    assert rows(X.missing_starts(blocks, starts), "start") == [("MLÉKO",)]


def test_ordinal_pairing_and_upper_lines(spark):
    text = "12,90\nKÁVA ALFA ZRNKOVÁ\nrůzné druhy\n250 g\n< 9,90 Kč\nSÝR BETA PLÁTKY\n100 g\n100 g 29,90 Kč"
    df = spark.createDataFrame([(1, 23, text)], "page_id int, page_number int, text string")
    got = rows(X.extract_uppercase_lines(df), "product", "packageSize", "price", "lowest30dPrice", "category")
    assert got[0] == ("KÁVA ALFA ZRNKOVÁ různé druhy 250 g", "250 g", 12.9, 9.9, "káva")
    lines = rows(X.page_product_lines(df), "ordinal", "product")
    assert ("KÁVA ALFA ZRNKOVÁ" in [l[1] for l in lines]) and lines[0][0] == 0
    paired = X.pair_by_ordinal(df, X.current_prices("text"), F.array(F.lit("a"), F.lit("b")))
    assert rows(paired, "ordinal", "product", "price", "countMismatch") == [(0, "a", 12.9, False), (1, "b", 29.9, False)]


def test_tiles(spark):
    tile = """<a class="tile k-product-tile" href="/detail?kloffer-articleID=77&amp;kloffer-category=0042_Ovoce_a_zelenina">
      <img class="k-product-tile__main-image" alt="Jablka &amp; hrušky" src="/i/a.jpg?w=1"><div class="k-price-tag__discount">-25%</div>
      <div class="k-price-tag__price">29,90</div><span class="k-price-tag__old-price-line-through">39,90</span>
      <div class="k-product-tile__unit-price">1 kg</div><div class="k-product-tile__base-price">(=1 kg 29,90)</div></a>"""
    df = spark.createDataFrame([(1, "https://a.cz/p.html", "<div>" + tile + "<a class='x'>no</a></div>")], "page_id int, url string, html string")
    r = X.extract_product_tiles(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["klNr"], r["product"], r["price"], r["oldPrice"], r["packageSize"], r["priceType"]) == ("77", "Jablka & hrušky", 29.9, 39.9, "1 kg", "-25%")
    assert (r["unitPrice"], r["unit"], r["category"], r["imageUrl"]) == (29.9, "Kč/1 kg", "Ovoce a zelenina", "https://a.cz/i/a.jpg")


def test_json_and_known_products(spark):
    df = spark.createDataFrame([(1, '{"title": " Máslo ", "currentPrice": "49,90", "articleId": 5}'), (2, '{"x": 1}')], "seq int, item string")
    assert rows(X.map_json_offers(df), "seq", "product", "price", "unitPrice", "klNr") == [(1, "Máslo", 49.9, 49.9, "5")]
    pages = spark.createDataFrame([(20, "PIVO BRANÍK světlé 12,90 Kč")], "page_number int, text string")
    facts = spark.createDataFrame([(20, "Braník světlé", 12.9), (20, "Braník tmavé", 12.9), (20, "Braník světlé", 13.9)], "page_number int, product string, price double")
    assert rows(X.extract_known_products(pages, facts), "product", "price") == [("Braník světlé", 12.9)]
