import datetime

import pytest
from pyspark.sql import functions as F

from pricewren.functions import money as M, package as K


@pytest.mark.parametrize(
    "text,want",
    [("11,90 Kč", 11.9), ("1 299,00 Kč", 1299.0), ("12,-", 12.0), ("12.90", 12.9), ("Kč", None), ("", None), (None, None)],
)
def test_parse_money(evaluate, text, want):
    assert evaluate(lambda s: M.parse_money(s.cast("string")), s=text) == want


def test_money_helpers(evaluate):
    assert evaluate(M.repair_ocr_money, s="2016,90") == 16.9
    assert evaluate(M.repair_ocr_money, s="0129,90 Kč") == 129.9
    assert evaluate(M.money_text, p=1234.5) == "1 234,50 Kč"
    assert evaluate(M.money_text, p=12.0) == "12 Kč"
    assert evaluate(lambda p: M.money_text(p, 2), p=12.0) == "12,00 Kč"
    assert evaluate(M.number_text, p=69.0) == "69"
    assert evaluate(M.number_text, p=12.9) == "12.9"
    assert evaluate(M.line_price, s="11,90 Kč 23,90 Kč") == 11.9
    assert evaluate(M.to_number, s="NaN") is None


def test_rounding(evaluate):
    for price, want in [(69.91, 69.9), (21.92, 21.9), (12.97, 13.0), (12.03, 12.0), (12.5, 12.5), (0.995, 1.0)]:
        assert evaluate(M.round_retail, p=price) == pytest.approx(want)
    assert evaluate(M.snap_tenth, p=1.98) == 2.0
    assert evaluate(M.snap_tenth, p=1.94) == 1.94


def test_price_literals(evaluate):
    assert evaluate(M.extract_prices, s="od 12,90 Kč nebo 12,- a 99 Kč, 12,90 Kč, 5.50") == ["12,90 Kč", "12,-", "99 Kč", "5.50"]
    markers = evaluate(M.price_markers, s="A < 12,90 Kč B za 5,50 Kč zaza 1,00 Kč")
    assert [(m["pos"], m["price"], m["kind"]) for m in markers] == [(2, 12.9, "action-lt"), (15, 5.5, "za-price")]


def test_current_price_is_not_the_lowest(evaluate):
    context = "PROSECCO bílé perlivé 0,75 l < 59,90 Kč 69,90"
    assert evaluate(lambda s: M.pick_current_price(M.classify_price(s)), s=context + " Kč") == 69.9
    assert evaluate(lambda s: M.pick_current_price(M.classify_price(s), allow_lowest30=True), s=context) == 59.9
    flags = {p["price"]: p for p in evaluate(M.classify_price, s="záloha 3,00 " + "x" * 80 + " 100 g 12,90 Kč " + "y" * 80 + " 1 00,00")}
    assert flags[3.0]["isDeposit"] and flags[12.9]["isUnitPrice"]


def test_card_price_wins(evaluate):
    got = evaluate(M.pick_card_price, a=["23,90 Kč", "s PENNY kartou", "11,90 Kč 23,90 Kč"])
    assert (got["pos"], got["price"], got["priceType"]) == (3, 11.9, "s kartou")
    got = evaluate(M.pick_card_price, a=["x", "23,90 Kč"])
    assert (got["pos"], got["price"], got["priceType"]) == (2, 23.9, "akční cena")
    assert evaluate(M.pick_card_price, a=["x"]) is None


def test_unit_prices(evaluate):
    got = evaluate(M.parse_unit_price, s="• 100 g = 33,29 Kč")
    assert (got["unitPrice"], got["unit"], got["unitText"]) == (33.29, "Kč/100 g", "100 g = 33,29 Kč")
    assert evaluate(M.parse_unit_line, s="1 kg 129,90 Kč")["unit"] == "Kč/1 kg"
    multi = evaluate(M.parse_unit_multi, s="100 g 12,90/14,90 Kč")
    assert (multi["unitBase"], multi["unitPrices"]) == ("100 g", [12.9, 14.9])
    assert evaluate(M.parse_base_price, s="(=1 kg 129,90)")["unitPrice"] == 129.9
    assert evaluate(M.parse_unit_price, s="nic") is None


def test_packages(evaluate):
    def variants(s):
        rows = evaluate(K.parse_package, s=s)
        return None if rows is None else [(r["amount"], r["unit"]) for r in rows]

    assert variants("6 x 0,5 l") == [(3.0, "l")]
    assert variants("80/100 g") == [(80.0, "g"), (100.0, "g")]
    assert variants("270–280 g") == [(270.0, "g"), (280.0, "g")]
    assert variants("cena za 1 kg") == [(1.0, "kg")]
    assert variants("plech") is None
    assert evaluate(K.extract_package, s="Káva 3 x 100 g a 200 g") == "3 x 100 g"
    assert evaluate(K.extract_package, s="Káva 270–280 g") == "270–280 g"
    assert evaluate(K.last_package, s="A 100 g B 250 g") == "250 g"
    assert evaluate(K.preferred_package, s="2 role 3 m 500 ml") == "500 ml"
    assert evaluate(K.is_package, s="0,5 l") and not evaluate(K.is_package, s="0,5 l navíc")
    assert evaluate(K.base_amount, s="4 x 0,5 l") == 2000.0
    assert evaluate(K.base_amount, s="270–280 g") == 280.0
    assert evaluate(lambda s: K.base_amount(s, ranges=False), s="270 g") == 270.0


def test_pack_price(evaluate):
    assert evaluate(lambda u, n, p: K.pack_price(u, n, p), u=33.29, n="Kč/100 g", p="210 g") == pytest.approx(69.9)
    assert evaluate(lambda u, n, p: K.pack_price(u, n, p), u=7.83, n="Kč/100 g", p="270–280 g") == pytest.approx(21.9)


def test_candidates_repair_and_snap(evaluate):
    best = evaluate(
        lambda p, b, u, r: K.best_candidate(K.price_candidates(p, b, u, r)), p="500 ml", b="100 ml", u=[19.8], r=[9.9, 79.9]
    )
    assert (best["unitPrice"], best["price"], best["nearest"], best["adjusted"]) == (2.0, 10.0, 9.9, 1)
    assert best["diff"] <= 0.15


def test_validity_and_leads(evaluate):
    got = evaluate(M.parse_validity, s="od středy 13. 5. do úterý 19. 5. 2026")
    assert got["validTo"] == datetime.date(2026, 5, 19)
    got = evaluate(M.parse_validity, s="body do 2. 6. 2026 platí od 13. 5. 2026 do 19. 5. 2026")
    assert (got["validFrom"], got["validTo"]) == (datetime.date(2026, 5, 13), datetime.date(2026, 5, 19))
    assert evaluate(M.lead_prices, s="209,90 279,90/ 25%") == [209.9]


def test_conflicts(evaluate):
    args = dict(p=249.2, c="Káva 199,90 Kč 1 kg = 498,40 Kč", u=498.4)
    assert evaluate(lambda p, c, u: M.price_conflict(p, c, u), **args) is True
    assert evaluate(lambda p, c, u: M.price_conflict(p, c, u), **{**args, "p": 199.9}) is False
    assert evaluate(lambda a, b: K.package_conflict(a, b), a="Šampon 400 ml", b="250 ml") is True
    assert evaluate(lambda a, b: K.package_conflict(a, b), a="Šampon 250 ml", b="250 ml") is False
    assert evaluate(M.action_price_plausible, p=12.9) and not evaluate(M.action_price_plausible, p=253.12)
    assert evaluate(lambda a, b: M.discount_share(a, b), a=75.0, b=100.0) == pytest.approx(0.25)
