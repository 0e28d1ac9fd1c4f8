"""Word lists, patterns and thresholds that decide the results.

These are data, not logic.  Every operator takes its table as an argument and
uses the value below only as the default, so other leaflets can bring their own.
"""

from pricewren.functions.patterns import UPPER, exactly, starts, word

# --- fixed values: text ------------------------------------------------------
PAGE_SLOGANS = (
    "nízké ceny hezky česky",
    r"<\s*Nejnižší cena za posledních 30 dní",
    "Nejnižší cena za posledních 30 dní",
    "ilustrační foto",
    "Made with FlippingBook",
    r"RkJQdWJsaXNoZXIy\s*NTcyMjUw",
)
BOILERPLATE = r"(?iu)Made with FlippingBook|schema\.org"
BODY_FOOTER = r"(?isu)Made with FlippingBook.*$"
META_STOPLIST = exactly(
    "IE=edge", "text/html", "image/jpeg", "width=device-width", "summary_large_image",
    "@flippingbook", "article", "FlippingBook", "yes", "EBook",
)
VIEWER_WORDS = (
    "leaflet", "prospekt", "brozura", "brožura",
    "prohlednout", "prohlédnout", "catalog", "katalog",
)
ENDPOINT_WORDS = ("api", "graphql", "product", "products", "offers", "leaflet", "catalog", "brochure")
STORE_HINT_KEYS = ("storeName", "storename", "store-name", "storeId", "storeID", "market", "branch", "filiale", "store")
STORE_ENDPOINT_WORDS = ("kloffers", "klxtra", "offer", "offers", "leaflet", "filiale", "storeName", "store")
LEAFLET_LINK_WORDS = ("letak", "leták", "prolistovat")
LEAFLET_WORDS = ("leaflet", "catalog", "brochure", "prospekt")

# --- fixed values: units and prices ------------------------------------------
UNIT_BASES = (r"100\s*g", r"1\s*kg", r"1\s*l", r"100\s*ml", r"1\s*ks", r"100\s*ks", r"1\s*role", r"1\s*dávka", r"0,5\s*l")
SEGMENT_BASES = (r"100\s*g", r"1\s*kg", r"1\s*l", r"100\s*ml", r"1\s*ks", r"100\s*ks", r"1\s*m")
SEGMENT_UNITS = ("g", "kg", "ml", "l", "ks", "m", "svazek", "balení")
PACKAGE_UNITS = ("g", "kg", "ml", "l", "ks", "role", "dávek")
RETAIL_CENTS = (0, 90, 99)
COMPUTED_CENTS = (0, 20, 21, 22, 23, 24, 25, 91, 92, 93, 94)
CLOSE_PRICE = 0.11
SNAP_PRICE = 0.15
SAME_PRICE = 0.001

# --- fixed values: product names ---------------------------------------------
NAME_PREFIXES = ("KUCHYNĚ", "AKČNÍ NABÍDKA", "NASTYLUJTE", r"TR\s+O")
FIRST_PRODUCT_MARKERS = (
    r"KUŘECÍ\s+ZADNÍ", r"ZÁVIN\s+KARLOVA", "CAMEMBERT", r"SALÁT\s+VLAŠSKÝ", r"OLOMOUCKÝ\s+TVAROH",
    r"PROTEINOVÝ\s+NÁPOJ", r"ZMRZLINA\s+MINI", r"ZELENINOVÁ\s+SMĚS", r"MISTROVSKÁ\s+DUŠENÁ",
    r"VEPŘOVÉ\s+MASO", r"BRAMBOROVÉ\s+NOKY", r"OBALOVANÝ\s+SÝR", r"TYČINKA\s+MARGOT", r"MÁSLO\s+82", "APEROL",
)
DESCRIPTORS = (
    "různé druhy", "různé barvy", "chlazené", "mražené", "balené", "volná", "volné", "krájený", "krájená",
    "přírodní", "uzený", "uzená", "neochucené", "polotučné", "nízkotučné", "světlý", "s příchutí",
    "ze zmrazeného", "cena za",
)
SEGMENT_BAD_NAMES = exactly(
    "BIO", "NOVINKA", "MAX", "CENA", "ZA", "PŘI", "KOUPI", "BALENÍ", "V BALENÍ", "A VÍCE", "MASA", "KČ"
)
BULLET_BAD_NAMES = exactly(
    "od", "do", "kg", "g", "ml", "l", "ks", "role", "cena", "za", "bez", "aplikace", "vybrané druhy",
    "různé druhy", "nápoj", "voda", "víno", "druhy",
)
PATTERN_BAD_NAMES = exactly(
    "od", "do", "www", "albert", "cz", "kč", "kg", "g", "ml", "l", "ks", "cena", "za", "bez", "vybrané druhy",
    "různé druhy", "chlazené", "chlazená", "balené", "balená",
)
HEADING_BAD_NAMES = r"(?iu)akční nabídka|chcete nás poznat|penny market|kontaktujte nás|sledujte penny"
LOYALTY_LINE = r"(?iu)^s PENNY kartou$"
# Names that are rejected outright, and those that only make a name doubtful.
REJECTED_NAMES = (
    r"^záloha na lahev(?![\p{L}\p{N}_])", "^tuku$", "^pomeranč$", r"^cm\s+\d+\s+balení(?![\p{L}\p{N}_])",
    r"^různé typy\s+\d+\s+balení(?![\p{L}\p{N}_])", r"^Kč(?![\p{L}\p{N}_])", r"^Nabídka(?![\p{L}\p{N}_])",
    r"^Nejnižší(?![\p{L}\p{N}_])", "^ilustrační foto$",
)
CANDIDATE_BAD_NAMES = (*REJECTED_NAMES, r"^MAX\.")
DESCRIPTION_STOPWORDS = (
    r"(?iu)^(vybrané druhy|různé druhy|bez Aplikace|od \d|záloha|cena za|limitovaná edice|Francie|Itálie|"
    r"Moldávie|Chile|Španělsko)$"
)
MARKETING_LINE = starts(
    "NEPORAZITELNÉ", "BĚŽNÁ CENA", "BEZ", "APLIKACE", "NOVINKA", "VÍCE AKCÍ", "PLATÍ", "POUZE",
    r"www\.albert\.cz", r"Od \d", "A$", "▼", "Tato nabídka", "Nelze garantovat", "produktů označených",
    "NEPORA ZITELNÉ produkty", "S APLIKACÍ", "KUPÓNY", "KREDITY", "JEŠTĚ NEMÁTE", "NABÍDKA PRO NEJMENŠÍ",
    "VE ZNAČKOVÉ KVALITĚ", "AKČNÍ NABÍDKA", "SUPER CENA", "NAŠE RECEPTURA", "VYBER SI", "HI T MĚSÍCE", "PLATNÉM DO",
)
PRICE_ONLY_LINE = (
    r"(?iu)^(\d{1,4}(?:[,.]\d{2})?|\d{1,4},-|[-+]?\d+\s*%|S \d+ BODY|Cena bez bodů:.*|\d{1,2}\s+\d{2})$"
)
NOISE_PREFIXES = (
    "FANDÍME HOKEJI", "Nápoje 90 potraviny 29", "Nápoje", "NAVÍC 1 BOD", "BOD NAVÍC", "KREDIT NAVÍC",
    "PŘI KOUPI 2 ks A VÍCE 10990", "NABÍDKA PRO NEJMENŠÍ", "VE ZNAČKOVÉ KVALITĚ", "AKČNÍ NABÍDKA", "SUPER CENA",
    "NAŠE RECEPTURA", "VEZMĚTE SI Z REGÁLU", "VEZMĚTE SI", "CENA BEZ BODŮ", "S BODY", r"A MUŽEŠ JÍ\(S\)T",
)
NAME_STOPWORDS = ("druhy", "nápoj", "voda", "víno", "potraviny", "svačinka", "impuls")
NAME_NOISE_WORDS = ("BEZ APLIKACE", "APLIKACE", "BĚŽNÁ CENA", "NEPORAZITELNÉ", "NOVINKA", "VÍCE AKCÍ")
PAGE_NOISE_WORDS = (
    "BEZ APLIKACE", "APLIKACE", "BĚŽNÁ CENA", "NEPORAZITELNÉ", "VÍCE AKCÍ", "SUPER CENA",
    "FANDÍME HOKEJI", "NOVINKA", "KREDITY NAVÍC", "AKČNÍ NABÍDKA", "Trvanlivé", "potraviny", "Nápoje", "Drogerie",
    "Zvířata", "Nature", "Akce", "Nabídka",
)
PRODUCT_LINE_STOPS = (
    "<", "00,", "00", "nabídka", "jedinečná", "super", "cena", "nejnižší", "platí", "penny", "moje penny", "www",
    "info@", r"max\.", "cena za", "používejte", "před použitím",
)
PRODUCT_LINE_STOPS_WIDE = ("nabídka", "jedinečná", "super cena", "nejnižší cena", "platí", r"www\.", "cena za", "běžně za")

# --- fixed values: quality ---------------------------------------------------
MARKETING_CONTEXT = word(
    "NASTYLUJTE", "VEZMĚTE SI", "Z REGÁLU", r"A MUŽEŠ JÍ\(S\)T", "PLATNÉM DO", "HI T MĚSÍCE", "SUPER CENA",
    "AKČNÍ NABÍDKA", "KREDIT NAVÍC", "CENA BEZ BODŮ", "Více informací najdete", r"albert\.cz/Freshbistro",
)
MARKETING_NAME = r"(?iu)^\s*(NASTYLUJTE|VEZMĚTE SI|VÍCE INFORMACÍ|HI T MĚSÍCE|PLATNÉM DO)(?![\p{L}\p{N}_])"
QUALITY_LABELS = {
    "high": "vysoká jistota", "medium": "střední jistota", "low": "nízká jistota", "suspect": "ke kontrole",
}
QUALITY_MODES = {
    "all": ("high", "medium", "low", "suspect"),
    "high": ("high",),
    "review": ("low", "suspect"),
    "trusted": ("high", "medium"),
}
NOISY_NAME = word(
    "MASA", "FANDÍME HOKEJI", "BOD NAVÍC", "KREDIT NAVÍC", "NAVÍC", "KTERÉ ZÍSKÁTE", "PŘI KOUPI", "AKCE NEJEN",
    "NABÍDKA PRO NEJMENŠÍ", "VE ZNAČKOVÉ KVALITĚ", "NOVINKY", "NEPORAZITELNÉ", "BĚŽNÁ CENA", "VÍCE AKCÍ",
    "Soutěž probíhá", r"www\..*", "Tato nabídka", "glutamanu sodného", "stejného druhu",
    "Y O D R O K U", "potraviny", "AKČNÍ NABÍDKA", "SUPER CENA", "HI T MĚSÍCE", "PLATNÉM DO", "NAŠE RECEPTURA",
    "VYBER SI", "Více informací", "VEZMĚTE SI Z REGÁLU", "VEZMĚTE SI", "Z REGÁLU", "CENA BEZ BODŮ", "S BODY", "BODY",
    r"A MUŽEŠ JÍ\(S\)T", r"JÍ\(S\)T",
)
HARD_MARKETING = (
    r"(?iu)^(HI T MĚSÍCE|PLATNÉM DO|VYBER SI|AKČNÍ NABÍDKA|SUPER CENA|NAŠE RECEPTURA)|"
    + word("SUPER CENA", "HI T MĚSÍCE", "PLATNÉM DO", "AKČNÍ NABÍDKA", "VYBER SI", "NAŠE RECEPTURA", "Více informací")
)
MERGED_NAMES = (
    "Free From Trvanlivé mléko Albert Meruňky", "Gambrinus Patron 12 Tiger Bohemia Chips",
    "Staropramen 11 Havlík Tyčinky", "Braník 10 Radegast Ratar Havlík Tyčinky",
    "Mléčný řez Müllermilch Mléčný nápoj", "Cornetto Müller Riso Protein", "Proteinová tyčinka Ricola",
    "Vodka Baileys Irish Cream", "Kojenecká výživa BEBA Comfort Kojenecká výživa",
    "Ovocná svačinka Hami Masozeleninový příkrm", "Magnum pinta Míša Tvarohový mls", "Milka Sušenky Chupa Chups",
    "Heinz Fazole Knorr Jíška", "Strážnické brambůrky Březňák",
)
# product pattern, price literal in the context, the price the offer must have, label
KNOWN_PRICES = (
    ("Dolce Gusto Kapsle", "199 Kč", 199.0, "finální filtr: Dolce Gusto cena konflikt"),
    ("Pampers Plenkové kalhotky", "279 Kč", 279.0, "finální filtr: Pampers cena konflikt"),
    ("Johnnie Walker Red Label", "329 Kč", 329.0, "finální filtr: Johnnie Walker cena konflikt"),
    ("Captain Morgan", "319 Kč", 319.0, "finální filtr: Captain Morgan cena konflikt"),
    ("Ben & Jerry", "159 Kč", 159.0, "finální filtr: Ben & Jerry cena konflikt"),
    ("Jar Platinum", "599 Kč", 599.0, "finální filtr: Jar cena konflikt"),
)
# product pattern, the only verified price, label
VERIFIED_PRICES = (
    ("woolite", 199.9, "Woolite má v aktuálních ověřených datech jinou cenu; kandidát nepouštět automaticky"),
)
STRICT_LABELS = {
    "confidence": "není high confidence z V3",
    "price": "cena nevypadá jako akční cena {chain}; pravděpodobně jednotková cena",
    "price_text": "chybí priceText",
    "package": "chybí balení",
    "product": "název produktu je moc obecný, krátký, slepený nebo obsahuje podezřelé znaky",
    "category": "kategorie neodpovídá produktu nebo jde o známý chybný vzor",
    "context": "kontext obsahuje zálohu, nejnižší cenu nebo patičkový text",
    "cents": "haléře neodpovídají běžné akční ceně, pravděpodobně jednotková cena",
}
BUCKET_LABELS = {
    "rejected": "zjevný šum v názvu produktu",
    "attached": "blok obsahuje přilepenou další položku, chce ještě rozdělit",
    "targeted": "cílený parser stránky {page}",
    "package": "pravděpodobně špatně převzaté balení z předchozí položky",
    "review": "obsahuje promo/limitní text nebo složený kontext",
    "safe": "obecný kandidát prošel základním filtrem",
    "other": "obecný parser zatím nechávám ke kontrole",
}
REVIEW_PATTERNS = (
    word("za posledních 30 dní"), word(r"osoba/nákup/\s*den"), word("nabídka Jedinečná"),
    word(r"MAX\.\s*ks"), word(r"\d+\s*/\s*\d+\s*g"),
)
SAFE_CATEGORIES = ("pivo", "alkohol", "mléčné", "mražené", "uzeniny", "drogerie", "nápoje", "ovoce zelenina")
# product pattern, package pattern that cannot belong to it
PACKAGE_MISMATCHES = (
    (r"(?iu)FIDORKA|KREKRY|SUŠENKY|ČOKOLÁDA|CEREÁLIE|CAPPUCCINO|KÁVA|SIRUP|OLEJ|CUKR|MOUKA",
     r"(?iu)0,75 l|0,5 l|3 kg|500 g|1,1 kg"),
    (r"(?iu)FILETY PRO PSY", r"(?iu)5 l"),
    (r"(?iu)BARVY NA VLASY", r"(?iu)10 ks"),
)
# category pattern, product pattern that cannot belong to it
CATEGORY_MISMATCHES = (
    (r"(?iu)ovoce|zelenina|maso", r"(?iu)toaletní papír|ooops|káva|marila"),
    (r"(?iu)sladkosti|snacky", r"(?iu)pivo|bažant|relax|víno|veltlínské|frankovka|riesling|müller|nowaco"),
    (r"(?iu)nápoje|alkohol", r"(?iu)koči|pes|pistácie|rozinky|oříšky|kojenecká voda"),
    (r"(?iu)drogerie", r"(?iu)woolite.*299,90|gel na praní$"),
)
FRAGMENT_NAMES = (
    exactly("SVĚTOVÝ DEN", "KOKTEJLŮ", "A VÍCE", "ZNAČKA", "NOVINKA", "EXKLUZIVNĚ", "SALÁM", "ŠUNKA", "PLÁTKY",
            "KORUNA", "KARLOVA", "ŘEZNÍKŮV", "TALÍŘ", "MLÉČNÁ", "ZMRZLINA", "SANDWICH", "GRILOVACÍ", "UHLÍ",
            "BRIKETY", "SOLÁRNÍ", "ZÁVĚSNÁ", "PAPÍROVÉ", "PROSTŘEDEK", "NA MYTÍ", "POVRCHŮ", "MISTROVSKÁ",
            "DUŠENÁ", "ŠUNKOVÝ", "PRAŽSKÁ", "HERKULES", "KLADENSKÁ", "UZENÁ", "JIHOČESKÝ", "SEDLČANSKÝ",
            "GOTHAJSKÝ", "BIO SNACK", "DRŮBEŽÍ", "LÁZEŇSKÝ"),
    r"(?iu)(?<![\p{L}\p{N}_])ID:\s*\d+",
)
# id, pattern, severity, field
NOISE_RULES = (
    ("starts-with-price-fragment", r"(?iu)^(á|a)\s+\d{1,4}[,.]\d{1,2}(?![\p{L}\p{N}_])", "high", "product"),
    ("deposit-in-product-name", word("záloha na lahev"), "high", "product"),
    ("product-contains-price-marker", r"(?iu)<\s*\d{1,4}[,.]\d{1,2}\s*Kč|nabídka\s+Jedinečná\s+\d", "medium", "product"),
    ("product-contains-footer", r"(?iu)Nabídka platná|Používejte biocidy|Před použitím si vždy přečtěte", "high", "product"),
)
NOISE_REMOVE_IDS = ("deposit-in-product-name", "starts-with-price-fragment", "product-contains-footer")
NOISE_FIX_IDS = ("empty-price-text-with-known-imported-page", "missing-category")
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}

# --- fixed values: enrichment ------------------------------------------------
BEER_WORDS = word("pivo", "ležák", "výčepní", r"nealko\s*pivo", r"světlý\s*ležák", r"světlé\s*výčepní")
BEER_BRANDS = (
    "Krušovice", "Gambrinus", "Kozel", "Velkopopovický Kozel", "Staropramen", "Braník", "Budweiser", "Budvar",
    "Radegast", "Birell", "Svijany", "Svijanský", "Heineken", "Pilsner", "Plzeňský", "Bernard", "Litovel",
    "Zlatopramen", "Mustang", "Hořký",
)
BEER_KINDS = (
    (r"(?iu)(?<![\p{L}\p{N}_])nealko|nealkoholick", "nealkoholické pivo"),
    (word("11", "12", "ležák", "lezak"), "světlý ležák"),
    (word("10", "výčepní", "vycepni"), "světlé výčepní pivo"),
)
BEER_DEFAULT = "pivo"
BEER_IN_DESCRIPTION = word("pivo", "ležák", "výčepní")
BEER_SEARCH_TERMS = ("pivo", "beer", "ležák", "výčepní")
COMPARE_STOPWORDS = (
    "pivo", "svetle", "svetly", "vycepni", "lezak", "nealkoholicke", "nealko", "akcni", "cena", "vybrane", "druhy"
)
NEAR_DUPLICATE_STOPWORDS = (
    "svetly", "svetle", "lezak", "vycepni", "plech", "ruzne", "druhy", "instantni", "mleta", "zrnkova"
)
CATEGORY_RULES = (
    ("pivo", ("pivo", "ležák", "výčepní", "braník", "staropramen", "krušovice", "gambrinus", "radegast", "budvar",
              "kozel", "svijanský", "březňák", "mustang", "zubr", "holba", "staročech", "ostravar", "zlatý bažant")),
    ("alkohol", ("whisky", "brandy", "rum", "vodka", "gin", "sekt", "prosecco", "víno", "frankovka", "veltlin",
                 "rulandské", "% alk")),
    ("uzeniny", ("šunka", "salám", "klobása", "párek", "slanina", "řezníkův talíř", "uzené")),
    ("maso", ("kuře", "kuřecí", "vepřová", "hovězí", "krkovice", "maso", "mleté")),
    ("mléčné", ("mléko", "jogurt", "sýr", "gouda", "brie", "máslo", "tvaroh", "smetana", "mozzarella")),
    ("ovoce zelenina", ("jablka", "banány", "rajčata", "okurka", "brambory", "salát", "paprika", "mrkev")),
    ("pečivo", ("chléb", "rohlík", "bageta", "houska", "koláč")),
    ("mražené", ("mražené", "zmrzlina", "filé", "hranolky", "krokety")),
    ("drogerie", ("toaletní papír", "osvěžovač", "prací", "aviváž", "šampon", "zubní pasta", "jar", "tablety",
                  "cif", "sidolux", "palette")),
    ("nápoje", ("limonáda", "minerální voda", "ondrášovka", "relax", "džus", "sirup", "cola", "kofola", "vinea")),
    ("káva", ("káva", "espresso", "cappuccino", "nescafé", "dolce gusto", "kapsle", "casablanca", "eduscho", "lavazza")),
)
# first page, last page, category, search terms
PAGE_CATEGORIES = (
    (1, 2, "ovoce, zelenina a maso", ("ovoce", "zelenina", "maso")),
    (3, 8, "chlazené, mléčné a pečivo", ("mléko", "sýr", "jogurt", "pečivo", "chlazené")),
    (9, 12, "mražené a trvanlivé", ("mražené", "trvanlivé", "potraviny")),
    (13, 17, "sladkosti a snacky", ("sladkosti", "snacky", "sušenky")),
    (18, 22, "nápoje a alkohol", ("nápoje", "alkohol", "pivo", "víno")),
    (23, 23, "káva", ("káva", "kapsle", "instantní káva")),
    (24, 25, "drogerie", ("drogerie", "praní", "hygiena", "úklid")),
    (26, 26, "zvířata a domácnost", ("zvířata", "kočka", "pes", "domácnost")),
    (27, 29, "zahrada a domácnost", ("zahrada", "domácnost", "gril")),
    (30, 32, "víkend a speciální nabídky", ("víkend", "speciální nabídka")),
    (33, 35, "drogerie", ("drogerie", "praní", "úklid", "hygiena")),
    (37, 37, "časopis", ("časopis",)),
)
# pattern over the normalised product, category, search terms
TEXT_CATEGORIES = (
    ("mleko|jogurt|syr|tvaroh|smetan", "mléčné", ("mléko", "jogurt", "sýr")),
    ("pivo|lezak|vino|prosecco|alk", "nápoje a alkohol", ("nápoje", "alkohol")),
    ("kava|jacobs|casablanca|nescafe|lavazza", "káva", ("káva",)),
    ("prani|woolite|calgon|jar|mycky|sprchovy|sampon", "drogerie", ("drogerie",)),
)
CATEGORY_TERMS = (
    ("pivo", ("pivo", "světlé pivo", "ležák", "výčepní pivo")),
)
PRODUCT_TERMS = (
    ("nealko|nealkohol", ("nealkoholické",)),
    ("cool", ("radler", "míchaný nápoj")),
    ("sekt|prosecco", ("sekt", "šumivé víno")),
    ("máslo|ghi|ghí", ("máslo",)),
)
IMAGE_FIELDS = (
    "imageUrl", "image", "imageSrc", "img", "thumbnail", "thumbnailUrl", "picture", "pictureUrl",
    "productImage", "productImageUrl", "pageImage",
)
STORE_FIELDS = ("chain", "storeName", "storeId", "source", "sourceName")
PRODUCT_SEARCH_FIELDS = ("product", "name", "title", "brand", "description", "category", "searchTerms", "compareKey")
SEARCH_FIELDS = (*PRODUCT_SEARCH_FIELDS, "packageSize", "storeName", "storeId", "chain")
REQUIRED_FIELDS = ("id", "storeId", "chain", "storeName", "product", "price")
UPPER_LINE = rf"^[{UPPER}0-9][{UPPER}0-9\s,&./()+\-*]+$"
