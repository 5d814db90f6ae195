"""Page extraction: fetched pages to listing items, links, images, texts. No shuffle but where a rule says 'last wins'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import rules as R
from shelfwise.functions import text as T

_ITEM = "map<string,string>"


def _items(pages: DataFrame, pattern: str) -> DataFrame:
    """page_id, items: the objects of the first JSON array that the pattern captures, as JSON texts."""
    body = F.regexp_replace(F.regexp_extract("html", pattern, 1), r"\s+", " ")
    objects = F.filter(F.from_json(F.when(body != "", body), "array<string>"), lambda x: x.startswith("{"))
    return pages.select("page_id", "html", F.coalesce(objects, F.array().cast("array<string>")).alias("items"))


def extract_listing_items(pages: DataFrame, marker: str = "impressions", name_key: str = "name") -> DataFrame:
    """(page_id, ord, item map) of the first array behind the marker; items without a name drop out."""
    found = _items(pages, rf'(?s)"{marker}"\s*:\s*(\[.*?\])')
    rows = found.select("page_id", F.posexplode("items").alias("ord", "json")).select("page_id", "ord", F.from_json("json", _ITEM).alias("item"))
    return rows.where(F.coalesce(F.try_element_at("item", F.lit(name_key)), F.lit("")) != "")


def extract_listing_items_fallback(pages: DataFrame, marker: str = "impressions") -> DataFrame:
    """The first form, and only for pages without such items the `ecommerce ... items: [...]` form with item_ keys."""
    first = extract_listing_items(pages, marker)
    rest = pages.join(first.select("page_id").distinct(), "page_id", "left_anti")
    found = _items(rest, r"(?s)ecommerce.*?items[\"']?\s*:\s*(\[.*?\])")
    rows = found.select("page_id", F.posexplode("items").alias("ord", "json")).select("page_id", "ord", F.from_json("json", _ITEM).alias("item"))
    plain = F.map_from_entries(F.transform(F.map_entries("item"), lambda e: F.struct(F.regexp_replace(e["key"], "^item_", "").alias("k"), e["value"].alias("v"))))
    rows = rows.select("page_id", "ord", plain.alias("item")).where(F.coalesce(F.try_element_at("item", F.lit("name")), F.lit("")) != "")
    return first.unionByName(rows)


def default_listing_fields(items: DataFrame, brand: str, url_tpl: str) -> DataFrame:
    """Missing fields are '', the brand has a default, the address is made from the id ({id}), the colour from the variant."""
    get = lambda k, d="": F.coalesce(F.try_element_at("item", F.lit(k)), F.lit(d)).alias(k)
    rows = items.select("page_id", "ord", get("name"), get("price"), get("category"), get("brand", brand), get("id"), get("variant"))
    before, after = url_tpl.split("{id}")
    return rows.withColumn("url", F.concat(F.lit(before), "id", F.lit(after))).withColumn("color", T.format_color_name(F.col("variant"))).withColumnRenamed("id", "sku")


def extract_color_variants(pages: DataFrame) -> DataFrame:
    """(name, colors): the last colour list of each name, plain or with quotes as entities."""
    text = F.replace(F.col("html"), F.lit("&#034;"), F.lit('"'))
    blocks = F.regexp_extract_all(text, F.lit(r'"name"\s*:\s*"[^"]+"[^\[\]{}]*?"color"\s*:\s*\[[^\]]*\]'), F.lit(0))
    rows = pages.select("page_id", F.posexplode(blocks).alias("ord", "block"))
    colors = F.from_json(F.regexp_extract("block", r'"color"\s*:\s*(\[[^\]]*\])', 1), "array<string>")
    rows = rows.select(F.regexp_extract("block", r'"name"\s*:\s*"([^"]+)"', 1).alias("name"), colors.alias("colors"), F.struct("page_id", "ord").alias("o"))
    return rows.groupBy("name").agg(F.max_by("colors", "o").alias("colors"))


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags out, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def extract_name(html: Column, min_len: int = 3) -> Column:
    h1 = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", ""))
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(F.when(F.length(h1) > min_len, h1), F.when(F.length(title) > min_len, title))


def extract_paragraph_fallback(html: Column, skip: list[str] = R.SKIP_PHRASES) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))
    good = lambda x: (F.length(x) > 100) & (F.length(x) < 1000) & ~R.contains_any(F.lower(x), skip)
    return F.get(F.filter(found, good), F.lit(0))


def extract_price_text(html: Column) -> Column:
    """The amount of the first price block, else of the first euro amount of the page text."""
    block = F.regexp_extract(html, r'(?is)<[^>]*class="[^"]*price[^"]*"[^>]*>([^<]*)', 1)
    return F.coalesce(T.parse_price(block), T.parse_price(T.price_text(page_text(html))))


def extract_links(pages: DataFrame, host: str) -> DataFrame:
    """(page_id, ord, href, text): all a[href], absolute."""
    tags = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("ord", "tag"))
    href = T.absolutise_url(F.regexp_extract("tag", r'(?is)href="([^"]*)"', 1), host)
    return rows.select("page_id", "ord", href.alias("href"), F.trim(F.regexp_replace("tag", r"(?s)<[^>]*>", "")).alias("text"))


def filter_product_links(links: DataFrame, host: str, section: str, **rules) -> DataFrame:
    return links.where(T.is_product_url(F.col("href"), host, section, **rules))


def link_display_name(text: Column, heading: Column, near: Column, href: Column) -> Column:
    """Link text, else heading, else a name nearby, else the address slug in title case."""
    good = F.when((F.length(text) > 3) & ~F.lower(text).rlike("more|view|meer|bekijk"), text)
    parts = F.split(F.regexp_replace(T.base_url(href), r"\.html$", ""), "/")
    slug = F.initcap(F.translate(F.get(parts, F.size(parts) - 2), "-_", "  "))
    return F.coalesce(good, T.nonempty(heading), T.nonempty(near), slug)


def extract_series_links(pages: DataFrame, host: str, words: list[str], section: str = "") -> DataFrame:
    """(series, url): the last link of each series name, which is the last segment of its path."""
    links = extract_links(pages, host).where(R.contains_any(F.col("href"), words) & F.col("href").contains(section))
    name = F.regexp_extract("href", r"([^/?#]+)/?(?:[?#].*)?$", 1)
    return links.groupBy(name.alias("series")).agg(F.max_by("href", F.struct("page_id", "ord")).alias("url"))


def extract_series_products(pages: DataFrame, host: str, section: str, suffix: str = ".html") -> DataFrame:
    """(series page_id, ord, name, url) of the product links of a section, the first of each url."""
    from shelfwise.operators.dedupe import first_by

    links = extract_links(pages, host).where(F.col("href").endswith(suffix) & F.col("href").contains(section))
    named = links.select("page_id", F.struct("page_id", "ord").alias("ord"), F.coalesce(T.nonempty(F.col("text")), F.regexp_extract("href", r"([^/]+)$", 1)).alias("name"), F.col("href").alias("url"))
    return first_by(named, ["url"], "ord").select("page_id", F.col("ord.ord").alias("ord"), "name", "url")


def extract_image_sources(pages: DataFrame, host: str, site: str = "", n: int = 10) -> DataFrame:
    """(page_id, ord, src): distinct images of the site in page order, n at most."""
    tags = F.regexp_extract_all("html", F.lit(r'(?is)<img\s[^>]*?(?:data-)?src="([^"]*)"'), F.lit(1))
    full = F.transform(tags, lambda s: T.absolutise_url(s, host))
    good = F.filter(full, lambda s: s.contains(site) & F.lower(s).rlike(r"\.(jpg|jpeg|png|webp)"))
    return pages.select("page_id", F.posexplode(F.slice(F.array_distinct(good), 1, n)).alias("ord", "src"))


def extract_cdn_images(pages: DataFrame, cdn: str) -> DataFrame:
    """(page_id, ord, url): every address on the image host, page order, entities resolved."""
    text = F.col("html")
    for entity, char in (("&quot;", '"'), ("&#034;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    escaped = "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in cdn)
    found = F.regexp_extract_all(text, F.lit(rf"""(?:https?:)?//{escaped}[^\s"'<>\\\]]+"""), F.lit(0))
    return pages.select("page_id", F.posexplode(found).alias("ord", "raw")).select("page_id", "ord", T.absolutise_url(F.col("raw"), "").alias("url"))


def extract_canonical_url(html: Column) -> Column:
    tag = F.regexp_extract(html, r'(?is)<link[^>]*rel="canonical"[^>]*>', 0)
    return T.found(tag, r'(?is)href="([^"]*)"')


def page_profile(pages: DataFrame, patterns: dict[str, str], words: list[str], marker: str = "dataLayer") -> DataFrame:
    """Per page: scripts, scripts with the marker, matches of each pattern, presence of each word."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>.*?</script>"), F.lit(0))
    hits = [F.regexp_count("html", F.lit(p)).cast("long").alias(f"n_{k}") for k, p in patterns.items()]
    flags = [F.col("html").contains(w).alias(f"has_{w}") for w in words]
    return pages.select("page_id", F.size(scripts).cast("long").alias("scripts"), F.size(F.filter(scripts, lambda s: s.contains(marker))).cast("long").alias("marked_scripts"), *hits, *flags)


def clean_key(key: Column) -> Column:
    return F.translate(F.lower(F.replace(key, F.lit(":"), F.lit(""))), "-", " ")


def map_key(key: Column, rules: list = R.SPEC_KEY_RULES, longest_match: bool = False) -> Column:
    """The field of the first rule (or the longest pattern) that the key contains."""
    ordered = sorted(rules, key=lambda r: -len(r[0])) if longest_match else rules
    return R.first_rule(clean_key(key), ordered)


def map_spec_key(specs: DataFrame, rules: list = R.SPEC_KEY_RULES, longest_match: bool = False, key: str = "key") -> DataFrame:
    return specs.withColumn("field", map_key(F.col(key), rules, longest_match))


def map_component_title(components: DataFrame, rules: list = R.COMPONENT_TITLE_RULES, title: str = "title") -> DataFrame:
    return components.withColumn("field", R.first_rule(F.lower(title), rules))


def join_color_variants(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Products with the colour lists of their names, and how many colours."""
    return products.join(variants, "name", "left").withColumn("n_colors", F.coalesce(F.array_size("colors"), F.lit(0)))


def assemble_product(listing: DataFrame, detail: DataFrame, how: str = "left") -> DataFrame:
    """Detail values go before listing values where they are given; joined on url."""
    shared = [c for c in detail.columns if c != "url" and c in listing.columns]
    more = [c for c in detail.columns if c != "url" and c not in listing.columns]
    joined = listing.alias("l").join(detail.alias("d"), F.col("l.url") == F.col("d.url"), how)
    keep = [c for c in listing.columns if c not in shared]
    return joined.select(*[F.col(f"l.{c}") for c in keep], *[F.coalesce(T.nonempty(F.col(f"d.{c}")), F.col(f"l.{c}")).alias(c) for c in shared], *[F.col(f"d.{c}") for c in more])


def component_special_rules(components: DataFrame) -> DataFrame:
    """(page_id, field, value) for components whose fields need more than a title: page_id, title, name, features."""
    title = F.lower("title")
    hit = lambda p: F.get(F.filter("features", lambda f: F.lower(f).rlike(p)), F.lit(0))
    pair = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    material = F.trim(F.regexp_replace(hit("materiaal:"), "(?i)^.*materiaal:", ""))
    wheel, axle = title.rlike("wiel|wheel"), title.rlike("steekas|through axle")
    front, rear = F.exists("features", lambda f: f.contains("12x100")), F.exists("features", lambda f: f.contains("12x142"))
    pairs = F.when(title == "frame", F.array(pair("Frame", F.coalesce(material, "name")), pair("Material", F.coalesce(material, "name"))))
    pairs = pairs.when(title.contains("cockpit"), F.array(pair("Stuur", F.col("name"))))
    pairs = pairs.when(title.rlike("handlebar|stuur"), F.array(pair("Stuur", F.substring_index("name", " - ", 1))))
    pairs = pairs.when(title.rlike("crank"), F.array(pair("Crankstel", F.col("name")), pair("Maximale_maat_kettingblad", hit("kettingblad|chainring"))))
    pairs = pairs.when(wheel, F.array(pair("Naaf_voor", F.when(front, F.col("name"))), pair("Naaf_achter", F.when(rear, F.col("name"))), pair("Velg", F.col("name"))))
    pairs = pairs.when(axle, F.array(pair("As_voorwiel", F.when(front, F.col("name"))), pair("As_achter", F.when(rear, F.col("name")))))
    return components.select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.field", "p.value").where("value is not null")


def enrich_specs(products: DataFrame) -> DataFrame:
    """products(name, category, text, specs map): page text and predictions fill the map, then the value rules run, in this order.

    New values are worked out as columns and go into the map once; empty ones change nothing.
    """
    get = lambda k: F.coalesce(F.try_element_at("specs", F.lit(k)), F.lit(""))
    low = lambda k: F.lower(get(k))
    name = F.lower(F.coalesce("name", F.lit("")))
    parts = (low("Crankstel"), low("Cassette"), low("Achterderailleur"), name)
    none = F.lit(None).cast("string")
    first = {
        "Voorvork": T.page_fork(F.col("text")),
        "Framefit": T.mark_prediction(get("Framefit"), none, T.fit_from_name_category(F.col("name"), F.col("category"))),
        "Bottom bracket": T.mark_prediction(get("Bottom bracket"), T.page_bottom_bracket(F.col("text")), T.predict_bottom_bracket(F.col("name"))),
        "Ketting": T.mark_prediction(get("Ketting"), T.page_chain(F.col("text")), T.predict_chain(get("Achterderailleur"), get("Cassette"))),
        "Frame": T.frame_material(T.nonempty(get("Frame"))),
        "Gewichtslimiet": T.extract_weight_limit(T.nonempty(get("Gewichtslimiet"))),
        "Gewicht": T.size_in_weight(T.clean_weight(T.nonempty(get("Gewicht")))),
    }
    sized = T.clean_shifter_sizes(T.nonempty(get("Shifter")))
    second = {
        "Shifter_speed": T.shifter_speed(F.col("__shifter")),
        "Shifter": T.strip_shifter_speed(F.col("__shifter")),
        "Voorderailleur": T.fill_front_derailleur(get("Voorderailleur"), F.col("__reason"), T.score_1x(*parts), low("Crankstel")),
    }
    df = products.withColumn("specs", F.coalesce("specs", F.create_map().cast("map<string,string>")))
    df = df.withColumns({"__shifter": sized, "__reason": T.classify_drivetrain(low("Voortandwiel"), *parts)})
    values = {**first, **second}
    pairs = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    df = df.withColumn("__new", F.map_filter(pairs, lambda k, v: v != ""))
    rest = F.map_filter("specs", lambda k, v: ~F.array_contains(F.map_keys("__new"), k))
    return df.withColumn("specs", F.map_concat(rest, "__new")).drop("__shifter", "__reason", "__new")
