"""Column expressions for numbers, texts, JSON values, URLs and HTML, with the semantics that the product data expects.

Rounding is half up on the binary value, white space is Unicode's, and numbers in text follow a strict grammar. All of it
stays inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text normalisation sees it, for a regular expression's class.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same, as characters.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
MAX_SAFE_INTEGER = 9007199254740991


# --- numbers


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def round1(x: Column) -> Column:
    """To tenths, half up on the value times ten."""
    return F.floor(x * 10 + 0.5) / 10


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """NaN stays NaN and null stays null."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def fixed1(x: Column) -> Column:
    """The exact binary value to one decimal, half away from zero (for magnitudes up to 2^20).

    20 x is compared with the odd number at the tie: x is split in two so that both products are exact."""
    y = F.abs(x)
    k = F.floor(y * 10).cast("double")
    high = F.floor(y * 67108864.0).cast("double") / 67108864.0
    beyond = (high * 20 - (k * 2 + 1)) + (y - high) * 20 >= 0
    return F.signum(x) * (k + beyond.cast("double")) / 10


def weight(x: Column, whole: bool = False) -> Column:
    """A weight within 0 to 10."""
    return clamp(round_half_up(x).cast("double") if whole else x, 0.0, 10.0)


def number_text(x: Column) -> Column:
    """A double as text, integral ones without a fraction."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def to_number(text: Column) -> Column:
    """A text as double: blank is 0, what is no number is null."""
    s = trim(text)
    return F.when(text.isNull(), None).when(s == "", 0.0).when(s.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"), s.try_cast("double")).when(s.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(s, 3, 16), 16, 10).cast("double"))


def positive_integer(text: Column, safe: bool = True) -> Column:
    """A text as a positive integer, else null; `safe` refuses what a double can't hold exactly."""
    x = to_number(text)
    good = (x == F.floor(x)) & (x > 0)
    return F.when(good & (x <= MAX_SAFE_INTEGER) if safe else good, x.cast("bigint"))


def truthy_ids(text: Column) -> Column:
    """The non-zero numbers of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), to_number), lambda x: x.isNotNull() & (x != 0))


def requested_reviews(x: Column) -> Column:
    """How many reviews to collect: 20 if unspecified, 1 to 100."""
    return F.least(F.greatest(F.coalesce(F.floor(x), F.lit(20)), F.lit(1)), F.lit(100))


def page_count(reviews: Column, size: int = 20) -> Column:
    return F.ceil(reviews / size)


def count_score(n: Column, most: Column) -> Column:
    """A count against the greatest one, as 0 to 100."""
    return F.when(most <= 0, 0.0).otherwise(F.least(F.lit(100.0), n / most * 100))


def or_default(x: Column, default: float) -> Column:
    """Zero, null and NaN give the default."""
    return F.coalesce(F.nullif(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(default))


# --- JSON values


def json_number(value: Column) -> Column:
    """A variant's number as double; null for every other kind, numeric strings included."""
    kind = F.schema_of_variant(value)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def usable_score(x: Column) -> Column:
    """The score if it is within 0 to 100, else null."""
    return F.when(~F.isnan(x) & x.between(0, 100), x)


def score_number(value: Column) -> Column:
    """The number that a JSON value gives as a score, not yet rounded; null for null, missing and what is no number."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "int").cast("double")).when(kind == "STRING", to_number(text)).when(kind != "VOID", json_number(value))


def whole_score(x: Column) -> Column:
    """A number as a whole score of 0 to 100. The number stands in several places: make it a column of its own first."""
    return clamp(round_half_up(x).cast("double"))


def json_coerced(value: Column) -> Column:
    """A JSON value as a number: 0 if missing or null, texts as numbers where they are such, else NaN."""
    kind = F.schema_of_variant(value)
    x = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "int").cast("double")).when(kind == "STRING", to_number(F.try_variant_get(value, "$", "string"))).otherwise(json_number(value))
    return F.when(kind.isNull() | (kind == "VOID"), 0.0).otherwise(F.coalesce(x, F.lit(float("nan"))))


def json_texts(value: Column, limit: int) -> Column:
    """The first texts of a JSON array, trimmed; other elements, empty ones and other values are left out."""
    own = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    texts = F.transform(F.filter(own, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: trim(F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.slice(F.filter(texts, lambda t: t != ""), 1, limit), F.array().cast("array<string>"))


def json_points(value: Column, limit: int) -> Column:
    """`topic: summary` of the first points of a JSON array, whichever of the two there is."""
    own = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    part = lambda v, name: F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    points = F.transform(own, lambda v: F.concat_ws(": ", part(v, "topic"), part(v, "summary")))
    return F.coalesce(F.slice(F.filter(points, lambda t: t != ""), 1, limit), F.array().cast("array<string>"))


def strip_code_fence(text: Column) -> Column:
    """Model output without the fence around its JSON."""
    s = F.regexp_replace(text, rf"(?i)\A```json[{WS}]*", "")
    s = F.regexp_replace(s, rf"\A```[{WS}]*", "")
    return trim(F.regexp_replace(s, r"```\z", ""))


# --- texts


def trim(text: Column) -> Column:
    """Without white space at its ends; by characters, as a search for it at every place of the text takes many times as long."""
    return F.btrim(text, F.lit(WS_CHARS))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{WS}]+", " "))


def matches(query: str, *columns: Column) -> Column:
    """Whether any column contains the trimmed query, case aside; an empty query matches all."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return out


def display_date(text: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy. MM. dd."), F.lit("-"))


def grouped(x: Column) -> Column:
    """A number with separators of thousands, up to three decimals."""
    return F.call_function("format_number", x, F.lit("#,##0.###"))


# --- URLs


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def protocol(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))


def is_web_url(url: Column) -> Column:
    return F.coalesce(protocol(url).isin("http", "https"), F.lit(False))


def allowed_url(url: Column, hosts: list[str], subdomains: bool = True, protocols: tuple[str, ...] = ("https",)) -> Column:
    """Whether the URL is on one of these hosts (or below one)."""
    h = host(url)
    on = h.isin(*hosts)
    for x in hosts if subdomains else ():
        on = on | h.endswith("." + x)
    return F.coalesce(protocol(url).isin(*protocols) & on, F.lit(False))


def normalized_url(url: Column) -> Column:
    """Without query, fragment, default port and one final slash; scheme and host in lower case."""
    bare = F.regexp_replace(trim(url), r"(?s)[?#].*\z", "")
    scheme, rest = F.lower(F.regexp_extract(bare, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(bare, r"\A[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(rest, r"\A([^/]*)", 1)
    port = F.when(scheme == "https", ":443").when(scheme == "http", ":80").otherwise("")
    at = F.lower(place)
    at = F.when((port != "") & at.endswith(port), F.regexp_replace(at, r":\d+\z", "")).otherwise(at)
    return F.regexp_replace(F.concat(scheme, F.lit("://"), at, F.substring(rest, F.length(place) + 1, F.length(rest))), r"/\z", "")


def url_text(text: Column) -> Column:
    """Percent-encoded, spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


# --- HTML

#: The references that product pages use, in the order in which they are replaced.
ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]


def decoded(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return trim(text)


def _first(html: Column, pattern: str) -> Column:
    return F.regexp_extract(html, pattern, 1)


def meta_content(html: Column, attribute: str, value: str) -> Column:
    """The content of a meta tag, the attribute before or behind it; an empty content is null, and is not looked for again."""
    import re

    named = rf"{attribute}=[\"']{re.escape(value)}[\"']"
    before = rf"(?i)<meta[^>]+{named}[^>]+content=[\"']([^\"']*)[\"'][^>]*>"
    behind = rf"(?i)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+{named}[^>]*>"
    found = F.when(html.rlike(before), _first(html, before)).otherwise(_first(html, behind))
    return F.when(found != "", decoded(found))


def title_text(html: Column) -> Column:
    """The raw text of the title, null if there is none or it is empty."""
    return F.nullif(_first(html, r"(?i)<title[^>]*>([\s\S]*?)</title>"), F.lit(""))


def page_title(html: Column) -> Column:
    return decoded(title_text(html))


#: Shop names that end page titles.
SHOP_SUFFIXES = ("네이버", "쿠팡")


def product_name(title: Column, shops: tuple[str, ...] = SHOP_SUFFIXES) -> Column:
    """A title without the shop's suffix."""
    for shop in shops:
        title = F.regexp_replace(title, rf"(?i)[{WS}]*[:|\-][{WS}]*{shop}[^\n\r\u2028\u2029]*\z", "")
    return F.nullif(collapse(title), F.lit(""))


#: How a refused page says so.
BLOCK_MARKERS = ("비정상적인 접근", "접근이 제한", "Access Denied")


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return F.coalesce(out, F.lit(False))


# --- dates


def epoch_ms(text: Column) -> Column:
    """A date text as milliseconds since 1970 in UTC, null where it is none of these: ISO years, months and days (in UTC); ISO
    times with T or a space (with an offset, or in the session's zone); `2024/01/02`, `Jan 2, 2024`, `2 Jan 2024` and these with a
    time; `Tue, 02 Jan 2024 03:04:05 GMT` and the same with an offset."""
    t = trim(text)
    day, time = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
    iso_day = F.when(t.rlike(rf"^({day}|\d{{4}}(-\d{{2}})?)$"), F.concat(F.rpad(t, 10, "-01-01").substr(1, 10), F.lit("T00:00:00Z")))
    seconds = F.regexp_replace(t, r"([T ]\d{2}:\d{2})( ?([Z+-].*)?)$", "$1:00$2")
    full_offset = F.regexp_replace(seconds, r"([+-]\d{2})$", "$1:00")
    iso_time = F.when(t.rlike(rf"^{day}[T ]{time}( ?(Z|[+-]\d{{2}}(:?\d{{2}})?))?$"), full_offset)
    parsed = lambda x, form: F.try_to_timestamp(x, F.lit(form))
    at = [F.coalesce(iso_day, iso_time).try_cast("timestamp")]
    for pattern, form in (
        (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"), (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "y/M/d H:mm:ss"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, y"),
        (r"^[A-Z][a-z]{2} \d{1,2}, \d{4} \d{1,2}:\d{2}:\d{2}$", "MMM d, y H:mm:ss"), (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM y"), (r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{1,2}:\d{2}:\d{2}$", "d MMM y H:mm:ss"),
    ):
        at.append(parsed(F.when(t.rlike(pattern), t), form))
    # the name of the weekday is not checked against the date
    mail = F.when(t.rlike(r"^([A-Z][a-z]{2}, )?\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC|Z|[+-]\d{4})$"), F.regexp_replace(F.regexp_replace(t, r"^[A-Z][a-z]{2}, ", ""), "(GMT|UTC|Z)$", "+0000"))
    return F.unix_millis(F.coalesce(*at, parsed(mail, "d MMM y HH:mm:ss Z")))
