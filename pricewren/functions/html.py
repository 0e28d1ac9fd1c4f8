"""HTML columns (rows T7, T9-T18, E12-E16, D23 of the inventory).

All of these are plain Column expressions: a page is one row, so nothing here
shuffles.  Arrays are returned so that the caller decides when to explode.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricewren import rules
from pricewren.functions.patterns import EDGE_L, EDGE_R
from pricewren.functions.text import (
    col, decode_url, first_text, let, not_blank, single_line, squeeze, strip, text_of,
)

_SCRIPT = r"(?is)<script.*?</script>"
_STYLE = r"(?is)<style.*?</style>"
_TAG = r"<[^>]+>"
_NAMED = (("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
_SCRIPT_ESCAPES = ((r"\u002F", "/"), (r"\u0026", "&"), (r"\u003D", "="), (r"\/", "/"))
_NUMERIC = r"&#(?:[xX][0-9a-fA-F]+|[0-9]+);"


def _code_point(piece: Column) -> Column:
    """The character of a numeric entity at the start of ``piece``."""
    digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+);", 1)
    number = F.when(
        piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)
    ).otherwise(digits).try_cast("bigint")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decode_html(c: Column | str, script_escapes: bool = True) -> Column:
    """Named, decimal and hexadecimal entities, plus script escapes.

    Numeric entities are cut apart and rebuilt with ``decode(.., 'UTF-32')``,
    which keeps the whole decoder on the JVM (no Python UDF).
    """
    value = text_of(c)
    for entity, char in _NAMED + (_SCRIPT_ESCAPES if script_escapes else ()):
        value = F.replace(value, F.lit(entity), F.lit(char))

    def rebuild(piece: Column) -> Column:
        decoded = F.concat(_code_point(piece), F.regexp_replace(piece, f"^{_NUMERIC}", ""))
        return F.when(piece.rlike(f"^{_NUMERIC}"), F.coalesce(decoded, piece)).otherwise(piece)

    return let(
        value,
        lambda v: F.when(
            F.contains(v, F.lit("&#")),
            F.array_join(F.transform(F.split(v, f"(?={_NUMERIC})"), rebuild), ""),
        ).otherwise(v),
    )


def drop_code(c: Column | str, by: str = " ") -> Column:
    """Remove script and style elements."""
    return F.regexp_replace(F.regexp_replace(text_of(c), _SCRIPT, by), _STYLE, by)


def strip_tags(c: Column | str) -> Column:
    """Visible text of a fragment as one line."""
    return single_line(decode_html(F.regexp_replace(drop_code(c), _TAG, " ")))


def clean_fragment(c: Column | str) -> Column:
    """T9 variant: decode first, then drop comments and tags."""
    value = F.regexp_replace(decode_html(c, script_escapes=False), r"(?s)<!--.*?-->", "")
    return squeeze(F.regexp_replace(value, _TAG, " "))


def html_line_text(c: Column | str) -> Column:
    """T10 as one text: a line break stands around every line, some lines may be empty.

    Blanks and bullets are cut in the whole text, as a pattern on every line costs far more.
    """
    value = drop_code(c, "")
    for pattern, by in (
        (r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "\n### $1\n"),
        (r"(?i)<li[^>]*>", "\n* "),
        (r"(?i)</li>|<br\s*/?>|</(?:p|div|section|article|ul|ol|a)>", "\n"),
        (_TAG, " "),
    ):
        value = F.regexp_replace(value, pattern, by)
    # Of blanks only runs and odd ones are found; the line break itself is no blank here.
    blanks = r"(?U:[\s\ufeff&&[^\n ]][\s\ufeff&&[^\n]]*| [\s\ufeff&&[^\n]]+)"
    spaced = F.regexp_replace(decode_html(value, script_escapes=False), blanks, " ")
    return F.regexp_replace(F.concat(F.lit("\n"), spaced, F.lit("\n")), r" ?\n[ \n]*(?:[-*] ?)?", "\n")


def html_to_lines(c: Column | str) -> Column:
    """Non-empty text lines; headings carry ``### ``, bullets are bare."""
    return F.filter(F.split(html_line_text(c), "\n"), lambda line: line != "")


def block_lines(c: Column | str) -> Column:
    """T10 variant: every block end, span and anchor end is a line break."""
    value = drop_code(c, "\n")
    value = F.regexp_replace(value, r"(?i)<br\s*/?>|</(?:p|div|section|article|li|h1|h2|h3|h4|span|a)>", "\n")
    lines = F.split(decode_html(F.regexp_replace(value, _TAG, " "), script_escapes=False), r"\n+")
    return F.filter(F.transform(lines, squeeze), lambda line: line != "")


def tag_lines(c: Column | str) -> Column:
    """T10 variant: every tag is a line break."""
    value = F.regexp_replace(drop_code(c, ""), _TAG, "\n")
    lines = F.split(decode_html(value, script_escapes=False), r"\n+")
    return F.filter(F.transform(lines, squeeze), lambda line: line != "")


def extract_paragraphs(c: Column | str, shortest: int = 50, longest_body: int = 300) -> Column:
    """Decoded paragraph texts, plus the whole body when it is long."""

    def texts(decoded: Column) -> Column:
        bodies = F.regexp_extract_all(decoded, F.lit(rf"(?is)<p{EDGE_R}[^>]*>(.*?)</p>"), F.lit(1))
        paragraphs = F.filter(
            F.transform(bodies, strip_tags),
            lambda p: (F.length(p) >= shortest) & ~p.rlike(rules.BOILERPLATE),
        )
        body = strip(F.regexp_replace(strip_tags(decoded), rules.BODY_FOOTER, " "))
        whole = F.filter(F.array(body), lambda b: F.length(b) > longest_body)  # bound once by the array
        return F.array_distinct(F.concat(paragraphs, whole))

    return let(decode_url(decode_html(c)), texts)


def extract_attributes(c: Column | str) -> Column:
    """``array<struct<name, raw, value>>`` of the quoted attributes."""
    pattern = F.lit(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*["']([^"']+)["']""")
    names = F.regexp_extract_all(text_of(c), pattern, F.lit(1))
    values = F.regexp_extract_all(text_of(c), pattern, F.lit(2))
    return F.zip_with(
        names, values,
        lambda n, v: F.struct(n.alias("name"), v.alias("raw"), single_line(decode_url(decode_html(v))).alias("value")),
    )


def extract_meta_text(c: Column | str) -> Column:
    """Attribute texts that are prose rather than links, joined."""
    pattern = F.lit(
        r"""(?i)(?:content|title|alt|aria-label|href|src|data-[\w-]+)\s*=\s*["']([^"']+)["']"""
    )

    def prose(raw: Column) -> Column:
        value = decode_url(decode_html(raw))
        value = F.regexp_replace(value, r"(?i)^https?://[^/]+/[^/]+/[^/]+/[^/]+/[^/]+/\d+/", "")
        value = F.regexp_replace(value, r"(?i)/files/assets/.*$", "")
        # A first word that contains a slash is an address, not prose.
        return single_line(F.regexp_replace(value, r"^[^ ]*/[^ ]*", ""))

    kept = F.filter(
        F.transform(F.regexp_extract_all(text_of(c), pattern, F.lit(1)), prose),
        lambda v: (F.length(v) > 12) & ~v.rlike(rules.META_STOPLIST),
    )
    return F.array_join(F.array_distinct(kept), " ")


def extract_percent_fragments(c: Column | str) -> Column:
    """Addresses and percent-encoded runs, decoded, over 30 characters."""
    decoded = decode_html(c)
    urls = F.regexp_extract_all(decoded, F.lit(r"""(?i)https?://[^\s"'<>]+"""), F.lit(0))
    runs = F.regexp_extract_all(
        decoded, F.lit(r"""(?:[^"'\s<>%]*+%[0-9A-Fa-f]{2}){4,}+[^"'\s<>]*"""), F.lit(0)
    )

    def tagged(values: Column, kind: str) -> Column:
        return F.transform(
            values, lambda v: F.struct(F.lit(kind).alias("kind"), single_line(decode_url(v)).alias("value"))
        )

    both = F.concat(tagged(urls, "url"), tagged(runs, "percent-fragment"))
    return F.filter(both, lambda f: F.length(f["value"]) > 30)


def extract_scripts(c: Column | str) -> Column:
    """Decoded script bodies over 30 characters (a text source of J9)."""
    bodies = F.regexp_extract_all(text_of(c), F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(
        F.transform(bodies, lambda b: single_line(decode_url(decode_html(b)))), lambda b: F.length(b) > 30
    )


def extract_links(c: Column | str, base: Column | None = None) -> Column:
    """``array<struct<href, text>>``; resolved when ``base`` is given."""
    pattern = F.lit(rf"""(?is)<a{EDGE_R}[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>""")
    hrefs = F.regexp_extract_all(text_of(c), pattern, F.lit(1))
    texts = F.regexp_extract_all(text_of(c), pattern, F.lit(2))

    def link(href: Column, text: Column) -> Column:
        target = decode_html(strip(href), script_escapes=False)
        label = decode_html(squeeze(F.regexp_replace(text, _TAG, " ")), script_escapes=False)
        return F.struct((target if base is None else resolve_url(target, base)).alias("href"), label.alias("text"))

    return F.zip_with(hrefs, texts, link)


def extract_asset_urls(c: Column | str) -> Column:
    """Distinct src/href/data/srcset/literal addresses of a page."""

    def found(decoded: Column) -> Column:
        attributes = F.regexp_extract_all(
            decoded,
            F.lit(r"""(?i)(?:src|href|data-src|data-href|data-url|data-lazy|data-original|data-image|content|poster)\s*=\s*["']([^"']+)["']"""),
            F.lit(1),
        )
        sets = F.regexp_extract_all(decoded, F.lit(r"""(?i)(?:srcset|data-srcset)\s*=\s*["']([^"']+)["']"""), F.lit(1))
        set_urls = F.transform(
            F.flatten(F.transform(sets, lambda s: F.split(s, ","))), lambda p: F.split(F.trim(p), r"\s+")[0]
        )
        literals = F.transform(
            F.regexp_extract_all(decoded, F.lit(r"""(?i)https?://[^"'\\\s)<>]+"""), F.lit(0)),
            lambda u: F.regexp_replace(u, "[;,]+$", ""),
        )
        cleaned = F.transform(F.concat(attributes, set_urls, literals), lambda u: F.replace(F.trim(u), F.lit("\\"), F.lit("")))
        return F.array_distinct(F.filter(cleaned, lambda u: u != ""))

    return let(decode_html(c), found)


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute form of ``href`` seen from page ``base``.

    Covers absolute, protocol-relative, root-relative, query, fragment and
    relative references, with ``.`` and ``..`` segments folded.
    """
    # Both texts are read by nearly every branch, so each is bound once.
    return let(strip(text_of(href)), lambda ref: let(text_of(base), lambda page: _resolved(ref, page)))


def _resolved(ref: Column, page: Column) -> Column:
    origin = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    bare = F.regexp_replace(page, r"[?#].*$", "")
    path = F.substring(bare, F.length(origin) + 1, F.length(bare))
    folder = F.regexp_extract(path, r"^(.*/)", 1)

    def fold(target: Column) -> Column:
        tail = F.regexp_extract(target, r"([?#].*)$", 1)
        segments = F.split(F.regexp_replace(target, r"[?#].*$", ""), "/")
        folded = F.aggregate(
            segments, F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
            .when(s == ".", done).otherwise(F.concat(done, F.array(s))),
        )
        closing = F.when(target.rlike(r"/\.{1,2}(?:[?#].*)?$"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.array_join(folded, "/"), closing, tail)

    relative = F.when(ref.startswith("/"), ref).otherwise(F.concat(F.coalesce(not_blank(folder), F.lit("/")), ref))
    return (
        F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref == "", bare)
        .when(ref.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(bare, ref))
        .otherwise(F.concat(origin, let(relative, fold)))
    )


def extract_embedded_json(c: Column | str) -> Column:
    """``array<struct<kind, body>>`` of structured data inside a page."""
    kinds = (
        ("script-json", r"""(?is)<script[^>]+type=["']application/(?:ld\+)?json["'][^>]*>(.*?)</script>"""),
        ("next-data", r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""),
        ("window-state", r"(?is)(?:window\.__[^=]+|window\.[A-Z0-9_]+)\s*=\s*(\{.{100,}?\});"),
    )

    def tagged(kind: str, pattern: str) -> Column:
        bodies = F.regexp_extract_all(text_of(c), F.lit(pattern), F.lit(1))
        return F.transform(bodies, lambda body: F.struct(F.lit(kind).alias("kind"), single_line(body).alias("body")))

    return F.concat(*[tagged(kind, pattern) for kind, pattern in kinds])


def match_positions(c: Column | str, pattern: str) -> Column:
    """``array<struct<pos, match>>`` with 0-based positions of every match.

    ``regexp_extract_all`` gives no offsets; the pieces between the matches do.  ``\\G`` holds
    them together; ``split`` would compile the pattern again for every text.  A dot for any character
    is one cheap test, a class of two is not.
    """

    def located(value: Column) -> Column:
        matches = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
        gaps = F.regexp_extract_all(value, F.lit(rf"\G((?s:.*?))(?:{pattern})"), F.lit(1))
        spans = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        start = F.struct(
            F.lit(0).alias("end"), F.array().cast("array<struct<pos:int,match:string>>").alias("found")
        )

        def step(state: Column, span: Column) -> Column:
            at = state["end"] + F.length(span["gap"])
            return F.struct(
                (at + F.length(span["match"])).alias("end"),
                F.concat(state["found"], F.array(F.struct(at.alias("pos"), span["match"].alias("match")))).alias("found"),
            )

        return F.aggregate(spans, start, step, lambda state: state["found"])

    return let(text_of(c), located)


# --- addresses ---------------------------------------------------------------
_IMAGE_FILE = r"(?iu)\.(?:jpg|jpeg|png|webp)(?:[?#].*)?$"


def classify_image(url: Column | str, leaflet_words: tuple[str, ...] = ()) -> Column:
    """What an image address most likely shows; ``leaflet_words`` adds local words for leaflets."""
    u = text_of(url)
    leaflet = "|".join(("leaflet", "page", "publication", "catalog", "brochure", "prospekt", *leaflet_words))
    return (
        F.when(u.rlike("(?iu)logo|icon|sprite|favicon|placeholder|pagestub|fbthumb|cover"), F.lit("decorative-or-cover"))
        .when(u.rlike(f"(?iu){leaflet}"), F.lit("page-or-leaflet-image"))
        .when(u.rlike("(?iu)product|media|image|img|asset|cdn|usercontent"), F.lit("possible-product-image"))
        .otherwise(F.lit("unknown-image"))
    )


def classify_asset(url: Column | str, leaflet_words: tuple[str, ...] = ()) -> Column:
    """Every asset kind an address falls under, in a fixed order; ``leaflet_words`` adds local words."""
    leaflet = "|".join(("leaflet", "page-", "page_", "catalog", "brochure", "prospekt", *leaflet_words))
    u = text_of(url)
    kinds = (
        ("html", r"(?iu)\.html?(?:[?#].*)?$|/\d+/?$"),
        ("script", r"(?iu)\.js(?:[?#].*)?$"),
        ("style", r"(?iu)\.css(?:[?#].*)?$"),
        ("json", r"(?iu)\.json(?:[?#].*)?$|/api/|\.api|manifest|data"),
        ("pdf", r"(?iu)\.pdf(?:[?#].*)?$"),
        ("image", _IMAGE_FILE),
        ("text", r"(?iu)\.(?:txt|xml)(?:[?#].*)?$"),
        ("leaflet", f"(?iu){leaflet}"),
    )
    return F.array_compact(F.array(*[F.when(u.rlike(p), F.lit(kind)) for kind, p in kinds]))


def canonical_image_url(url: Column | str) -> Column:
    """The address without its query."""
    return F.trim(F.substring_index(text_of(url), "?", 1))


def page_image_size(url: Column | str) -> Column:
    """Pixel size encoded as ``-at1600.jpg`` (0 when absent)."""
    return F.coalesce(F.regexp_extract(text_of(url), r"(?i)-at(\d+)\.jpg", 1).try_cast("int"), F.lit(0))


def best_page_image(urls: Column) -> Column:
    """The largest ``-atN`` page image among addresses (first on a tie)."""
    pages = F.filter(urls, lambda u: u.rlike(r"(?i)/pages/.+-at(?:400|800|1200|1600|2400)\.jpg"))
    ranked = F.transform(
        pages, lambda u, pos: F.struct(page_image_size(u).alias("size"), (-pos).alias("rank"), u.alias("url"))
    )
    return F.coalesce(F.array_max(ranked)["url"], F.lit(""))


def page_number(*candidates: Column | str, address: Column | str | None = None) -> Column:
    """First positive of the candidate fields, else from ``/N/index.html``."""
    numbers = [F.when(col(c).try_cast("double") > 0, col(c).try_cast("double").cast("int")) for c in candidates]
    if address is not None:
        numbers.append(F.regexp_extract(text_of(address), r"(?i)/(\d+)/index\.html", 1).try_cast("int"))
    return F.coalesce(*numbers)


def category_from_url(url: Column | str, parameter: str = "kloffer-category", fallback: str = "Akční nabídka",
                      top: str = "0001_TopArticle") -> Column:
    """Category name carried by an address parameter."""
    clean = F.replace(text_of(url), F.lit("&amp;"), F.lit("&"))
    raw = F.regexp_extract(clean, rf"[?&]{parameter}=([^&#]*)", 1)
    name = F.coalesce(F.try_url_decode(raw), raw)
    name = F.regexp_replace(F.regexp_replace(name, r"^\d+_?", ""), "__", " / ")
    return F.when((raw == "") | (raw == top), F.lit(fallback)).otherwise(F.trim(F.replace(name, F.lit("_"), F.lit(" "))))


# --- counts used by the source audits ----------------------------------------
def endpoint_hints(c: Column | str, words: tuple[str, ...] = rules.ENDPOINT_WORDS) -> Column:
    """Quoted strings that look like data endpoints, distinct, of any length."""
    pattern = F.lit(rf"""(?iu)["']([^"']*(?:{'|'.join(words)})[^"']*)["']""")
    return F.array_distinct(F.regexp_extract_all(text_of(c), pattern, F.lit(1)))


def store_hints(c: Column | str) -> Column:
    """Store identifiers assigned anywhere in a page, distinct."""
    keys = "|".join(rules.STORE_HINT_KEYS)
    pattern = F.lit(rf"""(?i)(?:{keys})\s*[:=]\s*["']?([a-z0-9_-]{{2,80}})""")
    return F.array_distinct(F.regexp_extract_all(text_of(c), pattern, F.lit(1)))


def tile_diagnostics(c: Column | str, tile: str = "k-product-tile", price: str = "k-price-tag__price",
                     key: str = "kloffer-articleID") -> Column:
    """Occurrence counts that show whether a tile page parsed well."""
    html = text_of(c)
    keys = F.regexp_extract_all(html, F.lit(rf"(?i){key}=([0-9]+)"), F.lit(1))
    return F.struct(
        F.size(keys).alias("article_ids"),
        F.size(F.array_distinct(keys)).alias("distinct_article_ids"),
        F.regexp_count(html, F.lit(f"(?i){tile}")).alias("tile_classes"),
        F.regexp_count(html, F.lit(rf"""(?i)<a{EDGE_R}[^>]*class=["'][^"']*{tile}""")).alias("anchor_tiles"),
        F.regexp_count(html, F.lit(f"(?i){price}")).alias("price_tags"),
        F.regexp_count(html, F.lit(rf"(?i)<img{EDGE_R}[^>]*alt=")).alias("image_alts"),
    )


def product_like(line: Column) -> Column:
    """Q19: the line shows a price, or a unit in a short text."""
    priced = line.rlike(r"(?iu)\d{1,4}(?:\s?\d{3})*,\d{2}\s*Kč")
    unit = line.rlike(rf"(?iu){EDGE_L}(?:kg|g|l|ml|ks){EDGE_R}")
    return priced | (unit & (F.length(line) > 6) & (F.length(line) < 120))


def first_image_url(*fields: Column | str) -> Column:
    """First non-empty image address."""
    return first_text(*fields)
