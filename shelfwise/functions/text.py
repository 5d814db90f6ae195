"""Column functions on names, prices, dates, addresses and technical attributes of products. Null in gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import rules as R

SPACES = r"(?U)\s+"


def nonempty(c: Column) -> Column:
    """Empty text as null."""
    return F.when(c != "", c)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract with null for no match."""
    return nonempty(F.regexp_extract(text, pattern, group))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def format_color_name(c: Column) -> Column:
    """Null gives ''."""
    spaced = F.replace(F.replace(F.replace(c, F.lit("_"), F.lit("/")), F.lit("dark"), F.lit(" Dark")), F.lit("light"), F.lit(" Light"))
    parts = F.filter(F.transform(F.split(spaced, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.array_join(F.transform(parts, capitalize), "/"), F.lit(""))


def parse_price(c: Column) -> Column:
    """Number of a price text with dots for thousands; null where none can be read (keep the text beside it)."""
    digits = F.regexp_extract(F.replace(c, F.lit("€"), F.lit("")), r"[\d.,]+", 0)
    return F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def price_to_int(c: Column) -> Column:
    """Dots and commas drop out, so "999.00" counts as 99900."""
    digits = F.regexp_extract(F.translate(c, "€.", ""), r"[\d,]+", 0)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("bigint")


def price_text(text: Column) -> Column:
    """The first euro amount of a page text."""
    return R.first_match(text, [r"€\s*\d{1,3}(?:\.\d{3})*(?:,\d{2})?", r"\d{1,3}(?:\.\d{3})*(?:,\d{2})?\s*€", r"€\s*\d+(?:,\d{2})?", r"\d+(?:,\d{2})?\s*€"])


def base_url(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def sku_from_url(url: Column) -> Column:
    base = base_url(url)
    return F.when(base.endswith(".html"), found(base, r"/([0-9]+)[.html]*$"))


def is_product_url(url: Column, host: str, section: str, excluded: list[str] = R.EXCLUDED_PATHS, min_digits: int = 4) -> Column:
    """Null gives false."""
    base = base_url(url)
    good = url.contains(host) & base.endswith(".html") & url.contains(section) & base.rlike(rf"/[0-9]{{{min_digits},}}[.html]*$")
    return F.coalesce(good & ~R.contains_any(url, excluded), F.lit(False))


def absolutise_url(url: Column, host: str) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(host), url)).otherwise(url)


def category_from_url(url: Column, rules: list = R.CATEGORY_RULES, default: str = "Road Bikes") -> Column:
    return R.first_rule(F.lower(url), rules, default)


def fit_from_url(url: Column, rules: list = R.URL_FIT_RULES) -> Column:
    return R.first_rule(F.lower(url), rules)


def fit_from_name_category(name: Column, category: Column) -> Column:
    """Missing texts count as empty."""
    clean = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(R.first_rule(clean(name), R.NAME_FIT_RULES), R.first_rule(clean(category), R.CATEGORY_FIT_RULES))


def predict_bottom_bracket(name: Column) -> Column:
    return R.first_rule(F.lower(name), R.BOTTOM_BRACKET_RULES)


def predict_chain(rear: Column, cassette: Column) -> Column:
    """Missing texts count as empty."""
    a, b = F.lower(F.coalesce(rear, F.lit(""))), F.lower(F.coalesce(cassette, F.lit("")))
    out = F.lit(None).cast("string")
    for in_rear, in_cassette, chain in reversed(R.CHAIN_RULES):
        out = F.when(R.contains_all(a, in_rear) & R.contains_all(b, in_cassette), chain).otherwise(out)
    return out


def mark_prediction(value: Column, extracted: Column, predicted: Column) -> Column:
    """Stated, else extracted, else predicted with a star."""
    return F.coalesce(nonempty(value), nonempty(extracted), F.concat(nonempty(predicted), F.lit("*")))


def extract_weight_limit(c: Column) -> Column:
    return F.coalesce(found(c, r"(?i)(\d+(?:[.,]\d+)?\s*kg)"), found(c, r"(?i)(\d+(?:[.,]\d+)?\s*lbs?)"), F.trim(c))


def clean_weight(c: Column, per_pair: bool = False) -> Column:
    """Pairs of kg and lbs become the first kg value of the text, or each its own with per_pair."""
    text, pair = F.trim(c), r"(?i)(\d+(?:[.,]\d+)?\s*kg)\s*/\s*\d+(?:[.,]\d+)?\s*lbs"
    first = F.regexp_extract(text, r"(?i)(\d+(?:[.,]\d+)?\s*kg)", 1)
    return F.regexp_replace(text, F.lit(pair), F.lit("$1") if per_pair else first)


def size_in_weight(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.contains("cm"), text).otherwise(F.regexp_replace(text, r"(\d+)\s*-\s*(\d+(?:[.,]\d+)?\s*kg)", "$1 cm - $2"))


def clean_shifter_sizes(c: Column) -> Column:
    text = F.trim(c)
    numbers, letters = r"(?i)^Maat:\s*\d+(?:\s*,\s*\d+)*\s+", r"(?i)^Maat:\s*[A-Z]+(?:\s*,\s*[A-Z]+)*\s+"
    return F.trim(F.when(text.rlike(numbers), F.regexp_replace(text, numbers, "")).otherwise(F.regexp_replace(text, letters, "")))


def shifter_speed(c: Column) -> Column:
    said = F.coalesce(*[found(c, p) for p in (r"(?i)(\d+)\s*speed", r"(?i)(\d+)-speed", r"(?i)(\d+)\s*versnellingen")])
    twelve = c.contains("SRAM RED AXS E1") | (c.contains("SRAM AXS") & c.contains("draadloze"))
    return F.when(said.isNotNull(), F.concat(said, F.lit("-speed"))).when(twelve, "12-speed").when(c.contains("Shimano Dura-Ace") & c.contains("Di2"), "11-speed")


def strip_shifter_speed(c: Column) -> Column:
    out = F.trim(c)
    for p in (r"(?i),?\s*\d+\s*speed\s*,?", r"(?i),?\s*\d+-speed\s*,?", r"(?i),?\s*\d+\s*versnellingen\s*,?"):
        out = F.regexp_replace(out, p, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r",\s*,", ","), r"\s+", " "), F.lit(" ,"))


def strip_component_speed(c: Column) -> Column:
    out = c
    for p in (r"(?i),\s*\d+[-\s]*speed\b", r"(?i),\s*\d+s\b", r"(?i)\b\d+[-\s]*speed\b", r"(?i)\b\d+s\b"):
        out = F.regexp_replace(out, p, "")
    return F.trim(F.rtrim(F.trim(out), F.lit(",")))


def frame_material(c: Column) -> Column:
    text = F.trim(c)
    known = F.coalesce(*[found(text, f"(?i)({p})") for p in R.FRAME_MATERIALS])
    first = F.trim(F.substring_index(text, ",", 1))
    cut = nonempty(F.trim(F.regexp_replace(first, r"(?i)^Frame[:\s]*", "")))
    return F.coalesce(F.initcap(F.regexp_replace(known, r"\s+", " ")), F.when(F.length(first) < 100, cut), text)


def is_double_chainring(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\d+/\d+|\d+x\d+"), F.lit(False))


def is_single_chainring(c: Column) -> Column:
    teeth = F.regexp_extract(c, r"(?i)\b(\d+)t\b", 1).try_cast("int")
    single = R.any_pattern(c, R.SINGLE_RING_PATTERNS) | F.coalesce(teeth.between(38, 46), F.lit(False))
    return F.coalesce(~c.rlike(r"(?i)\d+/\d+|\d+x\d+") & single, F.lit(False))


def cassette_range(c: Column) -> Column:
    part = lambda g: F.regexp_extract(c, r"(\d+)-(\d+)", g).try_cast("bigint")
    return part(2) - part(1)


def is_wide_cassette(c: Column) -> Column:
    return F.coalesce(R.contains_any(c, R.WIDE_CASSETTES) | F.coalesce(cassette_range(c) >= 30, F.lit(False)), F.lit(False))


def is_1x_derailleur(c: Column) -> Column:
    return F.coalesce(R.any_pattern(c, R.ONE_BY_DERAILLEURS), F.lit(False))


def is_1x_name(c: Column) -> Column:
    return F.coalesce(R.any_pattern(c, R.ONE_BY_NAMES), F.lit(False))


def score_1x(crank: Column, cassette: Column, rear: Column, name: Column) -> Column:
    """Texts in lower case, none null."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        points(is_single_chainring(crank), 3) + points(is_wide_cassette(cassette), 2) + points(is_1x_derailleur(rear), 2) + points(is_1x_name(name), 1)
        + points(rear.contains("cues") & R.contains_any(cassette, ["11-48", "11-50"]), 2) + points(rear.contains("apex") & R.contains_any(cassette, ["11-42", "11-44"]), 2)
    )


def classify_drivetrain(chainring: Column, crank: Column, cassette: Column, rear: Column, name: Column) -> Column:
    """The reason why a drivetrain has one chainring, null if it doesn't look so. Texts in lower case, none null."""
    wide = F.when(cassette_range(cassette).isNotNull(), F.concat(F.lit("wide cassette range ("), cassette_range(cassette).cast("string"), F.lit(" teeth)")))
    return (
        F.when(is_double_chainring(crank), F.lit(None))
        .when(chainring.contains("x") & ~chainring.contains("2x"), "1x-only chainring specification")
        .when(is_single_chainring(crank), "single chainring in crankstel")
        .when(is_wide_cassette(cassette), wide)
        .when(is_1x_derailleur(rear), "1x-specific rear derailleur")
        .when(is_1x_name(name), "1x setup in bike category")
    )


def fill_front_derailleur(front: Column, reason: Column, score: Column, crank: Column) -> Column:
    one = "1x, geen voorderailleur"
    empty = F.trim(F.coalesce(front, F.lit(""))) == ""
    return F.when(reason.isNotNull(), one).when(~empty, front).when(score >= 3, one).when(is_double_chainring(crank), "2x systeem, voorderailleur aanwezig")


def normalise_spec_key(c: Column) -> Column:
    return F.concat(F.lit("spec_"), F.translate(c, " /", "__"))


def spec_to_meta_name(c: Column) -> Column:
    return F.concat(F.lit("meta:"), F.replace(c, F.lit("spec_"), F.lit("")))


def image_file_name(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    name = F.when(last == "", "image.jpg").when(last.contains("."), last).otherwise(F.concat(last, F.lit(".jpg")))
    return F.regexp_replace(name, r"(?U)[^\w\-.]", "_")


def image_numbered_name(file: Column, pos: Column, n: Column) -> Column:
    stem, ext = F.regexp_extract(file, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(file, r"^(.+?)(\.[^.]*)?$", 2)
    return F.when(n > 1, F.concat(stem, F.lit("_"), F.lpad(pos.cast("string"), 2, "0"), ext)).otherwise(file)


def image_local_path(brand: Column, name: Column, file: Column, base: str = "images", style: str = "strip") -> Column:
    """style 'strip' drops special characters and joins words; 'replace' turns slash and space into underscores."""
    if style == "strip":
        clean = F.regexp_replace(F.trim(F.regexp_replace(name, r"(?U)[^\w\-\s]", "")), SPACES, "_")
    else:
        clean = F.translate(name, "/ ", "__")
    return F.concat_ws("/", F.lit(base), brand, clean, file)


def clean_image_url(url: Column, cdn: str) -> Column:
    """The address behind '=' with a scheme, if it belongs to the image host; else null."""
    inner = F.when(url.contains("=") & url.contains("//"), F.regexp_extract(url, r"=(.*)$", 1)).otherwise(url)
    full = F.when(inner.startswith("//"), F.concat(F.lit("https:"), inner)).otherwise(inner)
    return F.when(full.startswith(cdn), full)


def image_base_path(url: Column) -> Column:
    return F.regexp_replace(url, r"/image/upload/[^/]+/", "/image/upload/")


def image_quality(url: Column) -> Column:
    return F.when(R.contains_any(F.lower(url), R.REJECTED_IMAGES) | R.contains_any(url, R.PLACEHOLDER_IMAGES), "reject").when(R.contains_any(url, R.HIGH_QUALITY_IMAGES), "high").when(R.contains_any(url, R.MEDIUM_QUALITY_IMAGES), "medium").otherwise("none")


def to_dd_mm_yyyy(c: Column, as_of: str) -> Column:
    """as_of: yyyy-MM-dd, for texts that are no date."""
    day = F.date_format(F.to_date(F.lit(as_of)), "dd-MM-yyyy")
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    turned = F.concat_ws("-", F.regexp_extract(c, iso, 3), F.regexp_extract(c, iso, 2), F.regexp_extract(c, iso, 1))
    return F.when(c.isNull() | (c == "Unknown"), "Unknown").when(c.rlike(r"^\d{2}-\d{2}-\d{4}$"), c).when(c.rlike(iso), turned).otherwise(day)


def clean_field(c: Column) -> Column:
    """Null gives ''; white space of every kind collapses."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def fill_brand(c: Column, brand: str) -> Column:
    return F.coalesce(nonempty(c), F.lit(brand))


def price_label(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit("€"), c.cast("string"))).otherwise("Price N/A")


def word_count(c: Column) -> Column:
    """Null and blank texts have 0 words."""
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0)).cast("bigint")


def map_drop_empty(specs: Column) -> Column:
    return F.map_filter(specs, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")


def required_spec_defaults(specs: Column, names: list[str] = [*R.REQUIRED_SPECS, *R.EXTRA_SPECS]) -> list[Column]:
    return [F.coalesce(F.try_element_at(specs, F.lit(n)), F.lit("")).alias(n) for n in names]


def merge_specs_fill_empty(a: Column, b: Column, names: list[str]) -> Column:
    """Keys of `names` whose value in a is missing or empty take that of b; other keys of b are not added."""
    known = F.map_filter(b, lambda k, v: k.isin(names))
    merged = F.map_zip_with(a, known, lambda k, x, y: F.coalesce(nonempty(x), y, x))
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def is_track_product(name: Column, url: Column) -> Column:
    return F.coalesce(F.lower(name).contains("track"), F.lit(False)) | F.coalesce(F.lower(url).contains("track"), F.lit(False))


def page_material(text: Column, keywords: list[str] = R.MATERIALS) -> Column:
    return F.coalesce(*[F.when(text.contains(k), k) for k in keywords])


def page_weight(text: Column) -> Column:
    return F.concat(F.replace(found(text, r"(\d+[,.]?\d*)\s*kg"), F.lit(","), F.lit(".")), F.lit(" kg"))


def page_speed(text: Column) -> Column:
    return F.concat(found(text, r"(\d+)\s*(?:speed|versnellingen|Speed)"), F.lit(" speed"))


def page_fork(text: Column, patterns: list[str] = R.FORK_PATTERNS, min_len: int = 10, cut: int = 100) -> Column:
    hit = R.first_match(F.lower(text), patterns, min_len, ignore_case=False)
    return F.when(F.length(hit) > cut, F.concat(F.substring(hit, 1, cut), F.lit("..."))).otherwise(hit)


def page_bottom_bracket(text: Column, patterns: list[str] = R.BOTTOM_BRACKET_PATTERNS, min_len: int = 5, cut: int = 100) -> Column:
    return F.substring(R.first_match(text, patterns, min_len), 1, cut)


def page_chain(text: Column, patterns: list[str] = R.CHAIN_PATTERNS, min_len: int = 5, cut: int = 100) -> Column:
    return F.substring(R.first_match(text, patterns, min_len), 1, cut)


def component_speed(text: Column) -> Column:
    """The largest speed over 5 of the first pattern family that hits."""
    low = F.lower(text)
    most = lambda p: F.array_max(F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), lambda x: x.try_cast("int")))
    top = [F.when(most(p) > 5, most(p)) for p in (r"(\d+)[-\s]*speed", r"(\d+)[-\s]*versnellingen")]
    return F.concat(F.coalesce(*top).cast("string"), F.lit(" speed"))
