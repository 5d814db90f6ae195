"""Registered queries of the catalog operators, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import rules as R
from shelfwise.functions import text as T
from shelfwise.functions.automaton import first_word
from shelfwise.operators import dedupe as D
from shelfwise.operators import export as X
from shelfwise.operators import extract as E
from shelfwise.operators import html_blocks as H
from shelfwise.operators import key_filter
from shelfwise.operators import lifecycle as L
from shelfwise.operators import overlap as O
from shelfwise.operators import reshape as W
from shelfwise.operators import summary as S
from shelfwise.operators.reshape import filter_brands
from shelfwise.plans import adaptors as A
from shelfwise.sources import files as IO
from shelfwise.sources import store
from shelfwise.sources.scratch import scratch
from shelfwise.streaming import jobs

AS_OF = "2025-08-03"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    _QUERIES[name], _SQL[name] = query, sql


def add_frame(name: str, source: str, make: Callable[[DataFrame], DataFrame], sql: str, deal: bool = False) -> None:
    """A query on one adaptor; {t} in the SQL is the input."""
    add(name, lambda spark, d: make(A.frame(spark, d, source, deal)), sql.replace("{t}", A.duck(source)))


def add_column(name: str, out: Callable[[], Column], sql: str, source: str = A.SPECS, key: str = "k") -> None:
    """A query that applies one Column function to every row; `sql` is an expression over the same input."""
    add_frame(name, source, lambda df: df.select(key, out().alias("out")), f"SELECT {key}, {sql} AS out FROM {{t}} t")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def case(text: str, rules: list, default: str = "NULL") -> str:
    """first_rule as SQL."""
    when = [f"WHEN {' AND '.join(f'contains({text}, {w!r})' for w in ([ws] if isinstance(ws, str) else ws))} THEN '{v}'" for ws, v in rules]
    return f"CASE {' '.join(when)} ELSE {default} END"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def first_hit(text: str, patterns: list[str], min_len: int, options: str = "i") -> str:
    """first_match as SQL."""
    hit = [f"trim(regexp_extract({text}, '({p})', 1, '{options}'))" for p in patterns]
    return "coalesce(" + ", ".join(f"CASE WHEN length({h}) > {min_len} THEN {h} END" for h in hit) + ")"


# --- scalar functions -------------------------------------------------------------------------------------------
c = F.col
_COLOR = "coalesce(array_to_string([upper(x[1:1]) || lower(x[2:]) FOR x IN [trim(y) FOR y IN string_split(replace(replace(replace(variant, '_', '/'), 'dark', ' Dark'), 'light', ' Light'), '/')] IF x <> ''], '/'), '')"
_DIGITS = "replace(replace(regexp_extract(replace(price, '€', ''), '[\\d.,]+', 0), '.', ''), ',', '.')"
_INT = "TRY_CAST(replace(regexp_extract(replace(replace(price, '€', ''), '.', ''), '[\\d,]+', 0), ',', '') AS BIGINT)"
_BASE = "split_part(url, '?', 1)"
_RANGE = "(TRY_CAST(regexp_extract(cassette, '(\\d+)-(\\d+)', 2) AS BIGINT) - TRY_CAST(regexp_extract(cassette, '(\\d+)-(\\d+)', 1) AS BIGINT))"
_DOUBLE = "regexp_matches(crank, '\\d+/\\d+|\\d+x\\d+')"
_SINGLE = f"(NOT {_DOUBLE} AND (regexp_matches(crank, '{'|'.join(R.SINGLE_RING_PATTERNS)}') OR coalesce(TRY_CAST(regexp_extract(crank, '\\b(\\d+)t\\b', 1) AS INT) BETWEEN 38 AND 46, false)))"
_WIDE = f"({any_of('cassette', R.WIDE_CASSETTES)} OR coalesce({_RANGE} >= 30, false))"
_REAR1 = f"regexp_matches(rear, '{'|'.join(R.ONE_BY_DERAILLEURS)}')"
_NAME1 = f"regexp_matches(name, '{'|'.join(R.ONE_BY_NAMES)}')"
_SCORE = f"(CASE WHEN {_SINGLE} THEN 3 ELSE 0 END + CASE WHEN {_WIDE} THEN 2 ELSE 0 END + CASE WHEN {_REAR1} THEN 2 ELSE 0 END + CASE WHEN {_NAME1} THEN 1 ELSE 0 END + CASE WHEN contains(rear, 'cues') AND {any_of('cassette', ['11-48', '11-50'])} THEN 2 ELSE 0 END + CASE WHEN contains(rear, 'apex') AND {any_of('cassette', ['11-42', '11-44'])} THEN 2 ELSE 0 END)"
_REASON = f"CASE WHEN {_DOUBLE} THEN NULL WHEN contains(chainring, 'x') AND NOT contains(chainring, '2x') THEN '1x-only chainring specification' WHEN {_SINGLE} THEN 'single chainring in crankstel' WHEN {_WIDE} THEN 'wide cassette range (' || {_RANGE} || ' teeth)' WHEN {_REAR1} THEN '1x-specific rear derailleur' WHEN {_NAME1} THEN '1x setup in bike category' END"
_LAST = "regexp_extract(regexp_replace(regexp_replace(image, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]+)/*$', 1)"
_FILE = f"regexp_replace(CASE WHEN {_LAST} = '' THEN 'image.jpg' WHEN contains({_LAST}, '.') THEN {_LAST} ELSE {_LAST} || '.jpg' END, '[^\\p{{L}}\\p{{N}}_\\-.]', '_', 'g')"
_PAIR = "(\\d+(?:[.,]\\d+)?\\s*kg)\\s*/\\s*\\d+(?:[.,]\\d+)?\\s*lbs"
_CLEAN = "trim(regexp_replace(coalesce(note, ''), '[\\s\\x{A0}]+', ' ', 'g'))"
_SPEED = "coalesce(" + ", ".join(f"nullif(regexp_extract(shifter, '{p}', 1, 'i'), '')" for p in ("(\\d+)\\s*speed", "(\\d+)-speed", "(\\d+)\\s*versnellingen")) + ")"
_DDMM = "CASE WHEN seen IS NULL OR seen = 'Unknown' THEN 'Unknown' WHEN regexp_matches(seen, '^\\d{2}-\\d{2}-\\d{4}$') THEN seen WHEN regexp_matches(seen, '^\\d{4}-\\d{2}-\\d{2}$') THEN seen[9:10] || '-' || seen[6:7] || '-' || seen[1:4] ELSE '03-08-2025' END"


def _chain_sql() -> str:
    when = []
    for rear, cassette, chain in R.CHAIN_RULES:
        conds = [f"contains(rear, '{w}')" for w in rear] + [f"contains(cassette, '{w}')" for w in cassette]
        when.append(f"WHEN {' AND '.join(conds)} THEN '{chain}'")
    return f"CASE {' '.join(when)} END"


def _strip(text: str, patterns: list[str]) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '', 'gi')"
    return text


add_column("format_color_name", lambda: T.format_color_name(c("variant")), _COLOR, A.DUPLICATES, "ord")
add_column("parse_price", lambda: T.parse_price(c("price")), f"TRY_CAST(nullif({_DIGITS}, '') AS DOUBLE)")
add_column("price_to_int", lambda: T.price_to_int(c("price")), _INT)
add_column("base_url", lambda: T.base_url(c("url")), _BASE)
add_column("sku_from_url", lambda: T.sku_from_url(c("url")), f"CASE WHEN ends_with({_BASE}, '.html') THEN nullif(regexp_extract({_BASE}, '/([0-9]+)[.html]*$', 1), '') END")
_PRODUCT = f"(contains(url, 'shop.example') AND ends_with({_BASE}, '.html') AND contains(url, '/') AND regexp_matches({_BASE}, '/[0-9]{{3,}}[.html]*$') AND NOT {any_of('url', R.EXCLUDED_PATHS)})"
add_column("is_product_url", lambda: T.is_product_url(c("url"), "shop.example", "/", min_digits=3), _PRODUCT)
add_column("absolutise_url", lambda: T.absolutise_url(c("image"), "https://h.example"), "CASE WHEN starts_with(image, '//') THEN 'https:' || image WHEN starts_with(image, '/') THEN 'https://h.example' || image ELSE image END")
add_column("category_from_url", lambda: T.category_from_url(c("url")), case("lower(url)", R.CATEGORY_RULES, "'Road Bikes'"))
add_column("fit_from_url", lambda: T.fit_from_url(c("url")), case("lower(url)", R.URL_FIT_RULES))
add_column("fit_from_name_category", lambda: T.fit_from_name_category(c("name"), c("category")), f"coalesce({case('lower(name)', R.NAME_FIT_RULES)}, {case('lower(category)', R.CATEGORY_FIT_RULES)})", A.MODELS)
add_column("predict_bottom_bracket", lambda: T.predict_bottom_bracket(c("name")), case("lower(name)", R.BOTTOM_BRACKET_RULES), A.MODELS)
add_column("predict_chain", lambda: T.predict_chain(c("rear"), c("cassette")), _chain_sql())
add_column("mark_prediction", lambda: T.mark_prediction(c("spec_a"), c("spec_b"), c("rear")), "coalesce(nullif(spec_a, ''), nullif(spec_b, ''), rear || '*')")
add_column("extract_weight_limit", lambda: T.extract_weight_limit(c("weight_limit")), "coalesce(nullif(regexp_extract(weight_limit, '(\\d+(?:[.,]\\d+)?\\s*kg)', 1, 'i'), ''), nullif(regexp_extract(weight_limit, '(\\d+(?:[.,]\\d+)?\\s*lbs?)', 1, 'i'), ''), trim(weight_limit))")
add_column("clean_weight", lambda: T.clean_weight(c("weight")), f"replace(regexp_replace(weight, '{_PAIR}', '@', 'g'), '@', regexp_extract(weight, '(\\d+(?:[.,]\\d+)?\\s*kg)', 1))")
add_column("size_in_weight", lambda: T.size_in_weight(c("weight")), "CASE WHEN contains(weight, 'cm') THEN weight ELSE regexp_replace(weight, '(\\d+)\\s*-\\s*(\\d+(?:[.,]\\d+)?\\s*kg)', '\\1 cm - \\2', 'g') END")
add_column("clean_shifter_sizes", lambda: T.clean_shifter_sizes(c("shifter")), "trim(CASE WHEN regexp_matches(shifter, '(?i)^Maat:\\s*\\d+(?:\\s*,\\s*\\d+)*\\s+') THEN regexp_replace(shifter, '(?i)^Maat:\\s*\\d+(?:\\s*,\\s*\\d+)*\\s+', '') ELSE regexp_replace(shifter, '(?i)^Maat:\\s*[A-Z]+(?:\\s*,\\s*[A-Z]+)*\\s+', '') END)")
add_column("shifter_speed", lambda: T.shifter_speed(c("shifter")), f"CASE WHEN {_SPEED} IS NOT NULL THEN {_SPEED} || '-speed' WHEN contains(shifter, 'SRAM RED AXS E1') OR (contains(shifter, 'SRAM AXS') AND contains(shifter, 'draadloze')) THEN '12-speed' WHEN contains(shifter, 'Shimano Dura-Ace') AND contains(shifter, 'Di2') THEN '11-speed' END")
add_column("strip_shifter_speed", lambda: T.strip_shifter_speed(c("shifter")), "trim(regexp_replace(regexp_replace(" + _strip("trim(shifter)", [",?\\s*\\d+\\s*speed\\s*,?", ",?\\s*\\d+-speed\\s*,?", ",?\\s*\\d+\\s*versnellingen\\s*,?"]) + ", ',\\s*,', ',', 'g'), '\\s+', ' ', 'g'), ' ,')")
add_column("strip_component_speed", lambda: T.strip_component_speed(c("shifter")), "trim(rtrim(trim(" + _strip("shifter", [",\\s*\\d+[-\\s]*speed\\b", ",\\s*\\d+s\\b", "\\b\\d+[-\\s]*speed\\b", "\\b\\d+s\\b"]) + "), ','))")
add_column(
    "frame_material",
    lambda: T.frame_material(c("frame")),
    "coalesce((SELECT array_to_string([upper(x[1:1]) || lower(x[2:]) FOR x IN string_split(regexp_replace(m, '\\s+', ' ', 'g'), ' ')], ' ') FROM (SELECT coalesce(" + ", ".join(f"nullif(regexp_extract(t.frame, '({p})', 1, 'i'), '')" for p in R.FRAME_MATERIALS) + ") AS m)), CASE WHEN length(trim(split_part(frame, ',', 1))) < 100 THEN nullif(trim(regexp_replace(trim(split_part(frame, ',', 1)), '(?i)^Frame[:\\s]*', '')), '') END, trim(frame))",
)
add_column("is_double_chainring", lambda: T.is_double_chainring(c("crank")), _DOUBLE)
add_column("is_single_chainring", lambda: T.is_single_chainring(c("crank")), _SINGLE)
add_column("is_wide_cassette", lambda: T.is_wide_cassette(c("cassette")), _WIDE)
add_column("is_1x_derailleur", lambda: T.is_1x_derailleur(c("rear")), _REAR1)
add_column("is_1x_name", lambda: T.is_1x_name(c("name")), f"coalesce({_NAME1}, false)", A.MODELS)
add_column("score_1x", lambda: T.score_1x(c("crank"), c("cassette"), c("rear"), F.coalesce("name", F.lit(""))), _SCORE, A.MODELS)
add_column("classify_drivetrain", lambda: T.classify_drivetrain(c("chainring"), c("crank"), c("cassette"), c("rear"), F.coalesce("name", F.lit(""))), _REASON, A.MODELS)
_ARGS = ("crank", "cassette", "rear", "name")
add_column(
    "fill_front_derailleur",
    lambda: T.fill_front_derailleur(c("front"), T.classify_drivetrain(c("chainring"), *map(c, _ARGS)), T.score_1x(*map(c, _ARGS)), c("crank")),
    f"CASE WHEN ({_REASON}) IS NOT NULL THEN '1x, geen voorderailleur' WHEN trim(coalesce(front, '')) <> '' THEN front WHEN {_SCORE} >= 3 THEN '1x, geen voorderailleur' WHEN {_DOUBLE} THEN '2x systeem, voorderailleur aanwezig' END",
)
add_column("normalise_spec_key", lambda: T.normalise_spec_key(c("spec_key")), "'spec_' || replace(replace(spec_key, ' ', '_'), '/', '_')")
add_column("spec_to_meta_name", lambda: T.spec_to_meta_name(F.concat(F.lit("spec_a_spec_"), "name")), "'meta:' || replace('spec_a_spec_' || name, 'spec_', '')")
add_column("image_file_name", lambda: T.image_file_name(c("image")), _FILE)
add_column("image_numbered_name", lambda: T.image_numbered_name(T.image_file_name(c("image")), c("k") % 90 + 1, c("k") % 3), f"CASE WHEN k % 3 > 1 THEN regexp_extract({_FILE}, '^(.+?)(\\.[^.]*)?$', 1) || '_' || lpad((k % 90 + 1)::VARCHAR, 2, '0') || regexp_extract({_FILE}, '^(.+?)(\\.[^.]*)?$', 2) ELSE {_FILE} END")
add_column("image_local_path", lambda: T.image_local_path(c("brand"), c("note"), T.image_file_name(c("image"))), f"'images/' || brand || '/' || regexp_replace(regexp_replace(regexp_replace(note, '[^\\p{{L}}\\p{{N}}_\\-\\s]', '', 'g'), '^ +| +$', '', 'g'), '\\s+', '_', 'g') || '/' || {_FILE}")
_IN = "CASE WHEN contains(image, '=') AND contains(image, '//') THEN regexp_extract(image, '=(.*)$', 1) ELSE image END"
_FULL = f"CASE WHEN starts_with({_IN}, '//') THEN 'https:' || {_IN} ELSE {_IN} END"
add_column("clean_image_url", lambda: T.clean_image_url(c("image"), "https://img.example"), f"CASE WHEN starts_with({_FULL}, 'https://img.example') THEN {_FULL} END")
add_column("image_base_path", lambda: T.image_base_path(c("image")), "regexp_replace(image, '/image/upload/[^/]+/', '/image/upload/', 'g')")
_QUALITY = f"CASE WHEN {any_of('lower(image)', R.REJECTED_IMAGES)} OR {any_of('image', R.PLACEHOLDER_IMAGES)} THEN 'reject' WHEN {any_of('image', R.HIGH_QUALITY_IMAGES)} THEN 'high' WHEN {any_of('image', R.MEDIUM_QUALITY_IMAGES)} THEN 'medium' ELSE 'none' END"
add_column("image_quality", lambda: T.image_quality(c("image")), _QUALITY)
add_column("to_dd_mm_yyyy", lambda: T.to_dd_mm_yyyy(c("seen"), AS_OF), _DDMM)
add_column("clean_field", lambda: T.clean_field(c("note")), _CLEAN)
add_column("fill_brand", lambda: T.fill_brand(c("front"), "Acme"), "coalesce(nullif(front, ''), 'Acme')")
add_column("price_label", lambda: T.price_label(c("spec_b")), "CASE WHEN spec_b IS NOT NULL THEN '€' || spec_b ELSE 'Price N/A' END")
add_column("word_count", lambda: T.word_count(c("text")), "coalesce(len(regexp_extract_all(text, '[^\\s\\x{A0}]+')), 0)::BIGINT", "SELECT doc_id, text FROM {documents}", "doc_id")
_MAP = lambda: F.create_map(F.lit("Frame"), c("spec_a"), F.lit("Rem"), c("spec_b"))
_JOINED = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~"))))), "|")
add_column("map_drop_empty", lambda: _JOINED(T.map_drop_empty(_MAP())), "concat_ws('|', CASE WHEN spec_a <> '' THEN 'Frame=' || spec_a END, CASE WHEN spec_b <> '' THEN 'Rem=' || spec_b END)")
add_column("required_spec_defaults", lambda: F.concat_ws("|", *T.required_spec_defaults(_MAP(), ["Frame", "Rem", "Zadel"])), "concat(coalesce(spec_a, ''), '|', coalesce(spec_b, ''), '|')")
add_column("merge_specs_fill_empty", lambda: _JOINED(T.merge_specs_fill_empty(_MAP(), F.create_map(F.lit("Frame"), c("rear"), F.lit("Rem"), c("crank"), F.lit("Other"), c("name")), ["Frame", "Rem"])), "'Frame=' || coalesce(nullif(spec_a, ''), rear) || '|Rem=' || coalesce(nullif(spec_b, ''), crank)")
add_column("is_track_product", lambda: T.is_track_product(c("name"), c("url")), "coalesce(contains(lower(name), 'track'), false) OR contains(lower(url), 'track')", A.MODELS)
add_column("component_speed", lambda: T.component_speed(c("shifter")), "coalesce(" + ", ".join(f"(SELECT CASE WHEN max(x::INT) > 5 THEN max(x::INT) END FROM unnest(regexp_extract_all(lower(t.shifter), '{p}', 1)) u(x))" for p in ("(\\d+)[-\\s]*speed", "(\\d+)[-\\s]*versnellingen")) + ")::VARCHAR || ' speed'")
add_column("map_spec_key", lambda: E.map_key(c("spec_key")), case("replace(lower(replace(spec_key, ':', '')), '-', ' ')", R.SPEC_KEY_RULES))
_CLEAN_KEY_SQL = "replace(lower(replace(spec_key, ':', '')), '-', ' ')"
add_column("map_spec_key_automaton", lambda: first_word(E.clean_key(c("spec_key")), R.SPEC_KEY_RULES), case(_CLEAN_KEY_SQL, R.SPEC_KEY_RULES))
add_column("map_spec_key_longest", lambda: E.map_key(c("spec_key"), longest_match=True), case(_CLEAN_KEY_SQL, sorted(R.SPEC_KEY_RULES, key=lambda r: -len(r[0]))))
add("component_words_in_documents", lambda s, d: table(s, d, "documents").select("doc_id", first_word(F.lower("text"), R.COMPONENT_TITLE_RULES).alias("field")), f"SELECT doc_id, {case('lower(text)', R.COMPONENT_TITLE_RULES)} AS field FROM documents")
add_column("map_component_title", lambda: R.first_rule(F.lower("spec_key"), R.COMPONENT_TITLE_RULES), case("lower(spec_key)", R.COMPONENT_TITLE_RULES))

# --- page texts ---------------------------------------------------------------------------------------------------
_DOCS = "SELECT doc_id, text FROM {documents}"
add_column("page_material", lambda: T.page_material(c("text"), ["License", "MIT", "the"]), "CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, 'MIT') THEN 'MIT' WHEN contains(text, 'the') THEN 'the' END", _DOCS, "doc_id")
add_column("page_weight", lambda: T.page_weight(c("weight")), "replace(nullif(regexp_extract(weight, '(\\d+[,.]?\\d*)\\s*kg', 1), ''), ',', '.') || ' kg'")
add_column("page_speed", lambda: T.page_speed(c("shifter")), "nullif(regexp_extract(shifter, '(\\d+)\\s*(?:speed|versnellingen|Speed)', 1), '') || ' speed'")
_P1 = ["license[^.]*", "the [^.]*of[^.]*", "password=[^.]*"]
_HIT = first_hit("lower(text)", _P1, 10, "c")
add_column("page_fork", lambda: T.page_fork(c("text"), _P1), f"(SELECT CASE WHEN length(h) > 100 THEN h[1:100] || '...' ELSE h END FROM (SELECT {_HIT.replace('text', 't.text')} AS h))", _DOCS, "doc_id")
_P2 = ["(?:License|Version)[^.]*?(?:[0-9]|MIT)[^.]*", "released[^.]*"]
add_column("page_bottom_bracket", lambda: T.page_bottom_bracket(c("text"), _P2), f"({first_hit('text', _P2, 5)})[1:100]", _DOCS, "doc_id")
_P3 = ["(?:Apache|GNU)\\s+[^.]*?(?:\\d+)", "mail[0-9]\\.[^.]*com"]
add_column("page_chain", lambda: T.page_chain(c("text"), _P3), f"({first_hit('text', _P3, 5)})[1:100]", _DOCS, "doc_id")

# --- pages ----------------------------------------------------------------------------------------------------------
_PAGES = "SELECT page_id, url, html FROM {pages}"
add("read_pages", lambda s, d: IO.read_pages(s, f"{d}/pages.parquet"), "SELECT page_id, url, html FROM pages")
_TEXT_H1 = "trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'))"
_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
add_column("extract_name", lambda: E.extract_name(c("html")), f"CASE WHEN length({_TEXT_H1}) > 3 THEN {_TEXT_H1} WHEN length({_TITLE}) > 3 THEN {_TITLE} END", _PAGES, "page_id")
_PARAS = "[x FOR x IN [trim(regexp_replace(y, '<[^>]*>', '', 'g')) FOR y IN regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1)] IF length(x) > 100 AND length(x) < 1000 AND NOT " + any_of("lower(x)", R.SKIP_PHRASES) + "]"
add_column("extract_paragraph_fallback", lambda: E.extract_paragraph_fallback(c("html")), f"({_PARAS})[1]", _PAGES, "page_id")
add_column("extract_canonical_url", lambda: E.extract_canonical_url(c("html")), "nullif(regexp_extract(regexp_extract(html, '(?is)<link[^>]*rel=\"canonical\"[^>]*>', 0), '(?is)href=\"([^\"]*)\"', 1), '')", A.LISTING, "page_id")
add_column("extract_price_text", lambda: E.extract_price_text(c("html")), "TRY_CAST(nullif(replace(replace(regexp_extract(replace(regexp_extract(html, 'class=\"[^\"]*price[^\"]*\"[^>]*>([^<]*)', 1), '€', ''), '[\\d.,]+', 0), '.', ''), ',', '.'), '') AS DOUBLE)", A.LISTING, "page_id")
_LINKS = "(SELECT page_id, i - 1 AS ord, tag FROM (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"[^\"]*\"[^>]*>.*?</a>') AS l FROM pages)))"
_HREF = "regexp_extract(tag, '(?is)href=\"([^\"]*)\"', 1)"
_ABS = f"CASE WHEN starts_with({_HREF}, '//') THEN 'https:' || {_HREF} WHEN starts_with({_HREF}, '/') THEN 'https://h.example' || {_HREF} ELSE {_HREF} END"
_LINKED = f"(SELECT page_id, ord, {_ABS} AS href, trim(regexp_replace(tag, '(?s)<[^>]*>', '', 'g')) AS text FROM {_LINKS})"
add("extract_links", lambda s, d: E.extract_links(table(s, d, "pages"), "https://h.example"), f"SELECT page_id, ord::INT AS ord, href, text FROM {_LINKED}")
add_frame("filter_product_links", A.SPECS, lambda df: E.filter_product_links(df.select("k", c("url").alias("href")), "shop.example", "/", min_digits=3), f"SELECT k, url AS href FROM {{t}} WHERE {_PRODUCT}")
add_column("link_display_name", lambda: E.link_display_name(F.substring("name", 1, c("k").cast("int") % 8), c("spec_a"), c("spec_b"), c("url")), f"coalesce(CASE WHEN length(name[1:k % 8]) > 3 AND NOT regexp_matches(lower(name[1:k % 8]), 'more|view|meer|bekijk') THEN name[1:k % 8] END, nullif(spec_a, ''), nullif(spec_b, ''), array_to_string([upper(x[1:1]) || lower(x[2:]) FOR x IN string_split(replace(replace(string_split(regexp_replace({_BASE}, '\\.html$', ''), '/')[-2], '-', ' '), '_', ' '), ' ')], ' '))")
add("extract_series_links", lambda s, d: E.extract_series_links(table(s, d, "pages"), "https://h.example", ["/"]), f"SELECT regexp_extract(href, '([^/?#]+)/?(?:[?#].*)?$', 1) AS series, arg_max(href, (page_id, ord)) AS url FROM {_LINKED} WHERE contains(href, '/') GROUP BY 1")
add("extract_series_products", lambda s, d: E.extract_series_products(table(s, d, "pages"), "https://h.example", "/", suffix=""), f"SELECT page_id, ord::INT AS ord, name, url FROM (SELECT page_id, ord, coalesce(nullif(text, ''), regexp_extract(href, '([^/]+)$', 1)) AS name, href AS url, row_number() OVER (PARTITION BY href ORDER BY page_id, ord) AS n FROM {_LINKED} WHERE contains(href, '/')) WHERE n = 1")
_IMGS = "list_distinct([CASE WHEN starts_with(x, '//') THEN 'https:' || x WHEN starts_with(x, '/') THEN 'https://h.example' || x ELSE x END FOR x IN regexp_extract_all(html, '(?is)<img\\s[^>]*?(?:data-)?src=\"([^\"]*)\"', 1)])"
add_frame("extract_image_sources", A.LISTING, lambda df: E.extract_image_sources(df, "https://h.example", "example").select("page_id", "src"), f"SELECT page_id, unnest({_IMGS}) AS src FROM {{t}}")
add_frame("extract_cdn_images", A.LISTING, lambda df: E.extract_cdn_images(df, "cdn.example"), "SELECT page_id, (i - 1)::INT AS ord, 'https:' || u AS url FROM (SELECT page_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '//cdn\\.example[^\\s\"<>]+') AS l FROM {t}))")
_OBJ = "json_extract_string(o, '$.{}')"
_FIRST = "(SELECT page_id, (i - 1)::INT AS ord, o FROM (SELECT page_id, unnest(l) AS o, generate_subscripts(l, 1) AS i FROM (SELECT page_id, [x FOR x IN from_json(nullif(regexp_extract(html, '(?s)\"impressions\"\\s*:\\s*(\\[.*?\\])', 1), ''), '[\"JSON\"]') IF json_type(x) = 'OBJECT'] AS l FROM {t})))"
_SECOND = "(SELECT page_id, (i - 1)::INT AS ord, o FROM (SELECT page_id, unnest(l) AS o, generate_subscripts(l, 1) AS i FROM (SELECT page_id, [x FOR x IN from_json(nullif(regexp_extract(html, '(?s)ecommerce.*?items\"\\s*:\\s*(\\[.*?\\])', 1), ''), '[\"JSON\"]') IF json_type(x) = 'OBJECT'] AS l FROM {t})))"
_listed = lambda df: df.select("page_id", "ord", c("item")["name"].alias("name"), c("item")["id"].alias("id"), c("item")["variant"].alias("variant"))
_L1 = f"SELECT page_id, ord, {_OBJ.format('name')} AS name, {_OBJ.format('id')} AS id, {_OBJ.format('variant')} AS variant FROM {_FIRST} WHERE coalesce({_OBJ.format('name')}, '') <> ''"
_L2 = f"{_L1} UNION ALL SELECT page_id, ord, {_OBJ.format('item_name')}, {_OBJ.format('item_id')}, {_OBJ.format('item_variant')} FROM {_SECOND}"
_more = lambda prefix: ", ".join(f"{_OBJ.format(prefix + n)} AS {n}" for n in ("name", "id", "variant", "price", "category", "brand"))
_L3 = f"SELECT page_id, ord, {_more('')} FROM {_FIRST} WHERE coalesce({_OBJ.format('name')}, '') <> '' UNION ALL SELECT page_id, ord, {_more('item_')} FROM {_SECOND}"
add_frame("extract_listing_items", A.LISTING, lambda df: _listed(E.extract_listing_items(df)), _L1)
add_frame("extract_listing_items_fallback", A.LISTING, lambda df: _listed(E.extract_listing_items_fallback(df)), _L2)
add_frame("default_listing_fields", A.LISTING, lambda df: E.default_listing_fields(E.extract_listing_items_fallback(df), "Acme", "https://shop.example/p/{id}/"), f"SELECT page_id, ord, name, coalesce(price, '') AS price, coalesce(category, '') AS category, coalesce(brand, 'Acme') AS brand, id AS sku, coalesce(variant, '') AS variant, 'https://shop.example/p/' || id || '/' AS url, {_COLOR} AS color FROM ({_L3})")
add_frame("extract_color_variants", A.LISTING, lambda df: E.extract_color_variants(df).select("name", F.array_join("colors", "|").alias("colors")), "SELECT regexp_extract(html, '\"name\":\"([^\"]+)\"', 1) AS name, arg_max(regexp_extract(html, '\"color\":\\[\"([^\"]*)\"', 1), page_id) AS colors FROM {t} WHERE contains(html, '\"color\":[') GROUP BY 1")
add("page_profile", lambda s, d: E.page_profile(table(s, d, "pages"), {"links": "<a ", "paragraphs": "<p"}, ["footer", "nav"], "var"), "SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>'))::BIGINT AS scripts, len([x FOR x IN regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>') IF contains(x, 'var')])::BIGINT AS marked_scripts, len(regexp_extract_all(html, '<a '))::BIGINT AS n_links, len(regexp_extract_all(html, '<p'))::BIGINT AS n_paragraphs, contains(html, 'footer') AS has_footer, contains(html, 'nav') AS has_nav FROM pages")
_LIST_A = "SELECT p_partkey AS k, concat('u', cast(p_partkey AS STRING)) AS url, p_name AS name, p_type AS category FROM {part}"
_DETAIL = "SELECT concat('u', cast(p_partkey AS STRING)) AS url, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS category, p_size AS size FROM {part} WHERE p_partkey % 2 = 0"
add("assemble_product", lambda s, d: E.assemble_product(A.frame(s, d, _LIST_A), A.frame(s, d, _DETAIL)), f"SELECT l.k, l.url, l.name, coalesce(nullif(d.category, ''), l.category) AS category, d.size FROM {A.duck(_LIST_A)} l LEFT JOIN {A.duck(_DETAIL)} d ON l.url = d.url")

# --- files ----------------------------------------------------------------------------------------------------------
_LATEST = "SELECT concat(replace(lower(p_brand), '#', '_'), CASE WHEN p_partkey % 2 = 0 THEN '_bikes_latest.csv' ELSE '_bikes_20250718_102343.csv' END) AS file_name, p_partkey AS k FROM {part}"
add_frame("detect_brand_snapshots", _LATEST, IO.detect_brand_snapshots, "SELECT file_name, k, array_to_string([upper(x[1:1]) || lower(x[2:]) FOR x IN string_split(replace(regexp_extract(file_name, '^(.+)_bikes_latest\\.csv$', 1), '_', ' '), ' ')], ' ') AS brand FROM {t} WHERE ends_with(file_name, '_bikes_latest.csv')")


def _parsed(df: DataFrame) -> DataFrame:
    brand, ts = IO.parse_snapshot_name(c("file_name"))
    return df.select("path", brand.alias("brand"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("snapshot_ts"))


add_frame("parse_snapshot_name", A.MANIFEST, _parsed, "SELECT path, nullif(regexp_extract(file_name, '^(.+)_bikes_', 1), '') AS brand, strftime(try_strptime(nullif(regexp_extract(file_name, '_bikes_(\\d{8}_\\d{6})\\.', 1), ''), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS snapshot_ts FROM {t}")
add_frame("retention_per_pattern", A.MANIFEST, lambda df: D.retention(df.withColumn("pattern", D.by_pattern(c("file_name"))), 3, ["pattern"]).select("path", "archive"), "SELECT path, row_number() OVER (PARTITION BY regexp_replace(file_name, '_\\d{8}_\\d{6}', '') ORDER BY mtime DESC, path DESC) > 3 AS archive FROM {t}")
add_frame("retention_global", A.MANIFEST, lambda df: D.retention(df, 5, []).select("path", "archive"), "SELECT path, row_number() OVER (ORDER BY mtime DESC, path DESC) > 5 AS archive FROM {t}")
add_frame("newest_files", A.MANIFEST, lambda df: S.newest_files(df).select("path", "file_name"), "SELECT path, file_name FROM {t}")
_SCORED = "SELECT brand, regexp_extract(file_name, '(2025.*)\\.csv', 1) AS snapshot, sum(n_rows * n_cols)::BIGINT AS score FROM {t} GROUP BY 1, 2"
add_frame("best_archive", A.MANIFEST, lambda df: D.best_archive(df.groupBy("brand", F.regexp_extract("file_name", r"(2025.*)\.csv", 1).alias("snapshot")).agg(F.sum(c("n_rows") * c("n_cols")).alias("score"))), f"SELECT brand, snapshot FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, snapshot DESC) AS n FROM ({_SCORED})) WHERE n = 1 AND score > 0")
add_frame("snapshot_scores", A.MANIFEST, lambda df: S.snapshot_scores(df.select("brand", c("file_name").alias("snapshot"), "path", "n_rows")), "SELECT brand, file_name AS snapshot, (count(*) * 4)::BIGINT AS score FROM {t} GROUP BY 1, 2")
add_frame("archive_target_name", A.MANIFEST, lambda df: D.archive_target_name(df.select("path", "file_name", "brand"), df.where("brand in ('b1', 'b2')"), "20250803"), "SELECT path, file_name, brand, CASE WHEN brand IN ('b1', 'b2') THEN regexp_replace(file_name, '\\.csv$', '_archived_20250803.csv') ELSE file_name END AS target FROM {t}")

# --- first, last, longest -------------------------------------------------------------------------------------------
_row1 = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ord) AS n FROM {{t}}) WHERE n = 1"
add_frame("first_by_name", A.DUPLICATES, lambda df: D.first_by_name(df).select("name", "ord", "variant"), _row1.format(cols="name, ord, variant", by="name"))
add_frame("first_by_base_url", A.DUPLICATES, lambda df: D.first_by_base_url(df).select("name", "ord", "url"), _row1.format(cols="name, ord, url", by=_BASE))
add_frame("first_by_url", A.DUPLICATES, lambda df: D.first_by_url(df).select("ord", "url"), _row1.format(cols="ord, url", by="url"))
add_frame("last_value_by_key", A.DUPLICATES, lambda df: D.last_value_by_key(df, ["name", "category"], "variant"), "SELECT name, category, arg_max(variant, ord) AS variant FROM {t} GROUP BY 1, 2")
add_frame("first_value_by_key", A.DUPLICATES, lambda df: D.first_value_by_key(df, ["name", "category"], "variant"), "SELECT name, category, arg_min(variant, ord) AS variant FROM {t} GROUP BY 1, 2")
add_frame("longest_value_by_key", A.DUPLICATES, lambda df: D.longest_value_by_key(df, ["name"], "variant"), "SELECT name, arg_max(variant, (length(variant), -ord)) AS variant FROM {t} GROUP BY 1")
_IMAGES = "SELECT brand AS product, k AS ord, image AS url FROM (" + A.SPECS + ") x"
add_frame("image_medium_cap", _IMAGES, D.image_medium_cap, f"SELECT product, ord, url FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ord) AS n FROM (SELECT product, ord, url, {_QUALITY.replace('image', 'url').replace('/url/', '/image/')} AS q FROM {{t}}) WHERE q IN ('high', 'medium')) WHERE q = 'high' OR n <= 10")
add_frame("image_dedupe", _IMAGES, D.image_dedupe, "SELECT product, ord, url FROM (SELECT *, row_number() OVER (PARTITION BY product, regexp_replace(url, '/image/upload/[^/]+/', '/image/upload/', 'g') ORDER BY ord) AS n FROM {t}) WHERE n = 1")
add_frame("image_position", _IMAGES, D.image_position, "SELECT product, ord, url, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ord) AS position FROM {t}) WHERE position <= 10")

# --- summaries --------------------------------------------------------------------------------------------------------
add_frame("model_and_variant_counts", A.DUPLICATES, S.model_and_variant_counts, "SELECT count(DISTINCT name) AS models, count(*) AS variants FROM {t}")
add_frame("multi_color_models", A.DUPLICATES, S.multi_color_models, "SELECT name, count(*) AS variants FROM {t} GROUP BY name HAVING count(*) > 1")
add_frame("variants_by_model", A.DUPLICATES, lambda df: S.variants_by_model(df).select("name", F.size("variants").cast("long").alias("n"), F.array_join(F.transform("variants", lambda x: x["variant"]), "|").alias("variants")), "SELECT name, count(*) AS n, string_agg(variant, '|' ORDER BY ord) AS variants FROM {t} GROUP BY name")
add_frame("variants_in_order", A.DUPLICATES, S.variants_in_order, "SELECT name, ord, color, variant, price, url FROM {t}")
add_frame("price_range", A.DUPLICATES, S.price_range, f"SELECT min({_INT}) AS min_price, max({_INT}) AS max_price FROM {{t}}")
add_frame("category_counts", A.DUPLICATES, S.category_counts, "SELECT coalesce(category, 'Unknown') AS category, count(*) AS n FROM {t} GROUP BY 1")
add_frame("color_counts", A.DUPLICATES, S.color_counts, "SELECT color, count(*) AS n, count(*) OVER () AS colors FROM {t} WHERE color <> '' GROUP BY color")
add_frame("brand_share", A.DUPLICATES, S.brand_share, "SELECT brand, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM {t} GROUP BY brand")
add_frame("image_coverage", A.DUPLICATES, S.image_coverage, "SELECT count(*) AS products, count_if(n_images > 0)::BIGINT AS with_images, sum(n_images)::BIGINT AS images, round(100.0 * count_if(n_images > 0) / count(*), 4)::DOUBLE AS coverage FROM {t}")
add_frame("image_stats_by_brand", A.DUPLICATES, S.image_stats_by_brand, "SELECT brand, count_if(n_images > 0)::BIGINT AS with_images, sum(n_images)::BIGINT AS images, round(avg(n_images), 4) AS average FROM {t} GROUP BY brand")
add_frame("column_fill", A.DUPLICATES, lambda df: S.column_fill(df.select("name", "color", "price")), "SELECT 'name' AS column_name, count(nullif(name, '')) AS filled FROM {t} UNION ALL SELECT 'color', count(nullif(color, '')) FROM {t} UNION ALL SELECT 'price', count(nullif(price, '')) FROM {t}")
add_frame("skus_by_name", A.DUPLICATES, lambda df: S.skus_by_name(df).select("name", F.array_join("skus", "|").alias("skus")), "SELECT name, string_agg(DISTINCT sku, '|' ORDER BY sku) AS skus FROM {t} GROUP BY name")
add_frame("top_price", A.DUPLICATES, lambda df: S.top_price(df).select("name", "ord", "price_int"), f"SELECT name, ord, {_INT} AS price_int FROM {{t}} WHERE {_INT} IS NOT NULL ORDER BY 3 DESC, ord LIMIT 5")
add_frame("first_n_multi_color", A.DUPLICATES, S.first_n_multi_color, "SELECT name, variants, first_ord, greatest(total - 5, 0) AS remaining FROM (SELECT name, count(*) AS variants, min(ord) AS first_ord, count(*) OVER () AS total FROM {t} GROUP BY name HAVING count(*) > 1) ORDER BY first_ord LIMIT 5")
add_frame("join_color_variants", A.DUPLICATES, lambda df: E.join_color_variants(df.select("name", "ord"), df.where("color <> ''").groupBy("name").agg(F.array_sort(F.collect_set("color")).alias("colors"))).select("name", "ord", "n_colors"), "SELECT a.name, a.ord, coalesce(b.n, 0)::INT AS n_colors FROM {t} a LEFT JOIN (SELECT name, count(DISTINCT color) AS n FROM {t} WHERE color <> '' GROUP BY name) b ON a.name = b.name")

# --- lifecycle ---------------------------------------------------------------------------------------------------------
KEYS = ["brand", "name"]


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return A.frame(spark, d, A.CURRENT), A.frame(spark, d, A.ARCHIVE), A.frame(spark, d, A.MASTER)


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return L.lifecycle_join(*_sides(spark, d), KEYS)


def _master(spark: SparkSession, d: str) -> DataFrame:
    return L.update_master(*_sides(spark, d), KEYS, AS_OF)


_C, _A, _M = A.duck(A.CURRENT), A.duck(A.ARCHIVE), A.duck(A.MASTER)
_ALIGNED = f"""(SELECT n.brand, n.name, c.name IS NOT NULL AS in_current, a.name IS NOT NULL AS in_archive, m.name IS NOT NULL AS in_master,
  c.price AS c_price, a.price AS a_price, m.price AS m_price, c.category AS c_category, a.category AS a_category, m.category AS m_category, a.snapshot_date, m.first_seen_date AS m_first, m.last_seen_date AS m_last
  FROM (SELECT brand, name FROM {_C} UNION SELECT brand, name FROM {_A} UNION SELECT brand, name FROM {_M}) n
  LEFT JOIN {_C} c ON n.name = c.name AND n.brand = c.brand LEFT JOIN {_A} a ON n.name = a.name AND n.brand = a.brand LEFT JOIN {_M} m ON n.name = m.name AND n.brand = m.brand)"""
_STATUS = "CASE WHEN in_current AND NOT in_master THEN 'New' WHEN in_current THEN 'Available' ELSE 'Discontinued' END"
_FIRSTSEEN = f"CASE WHEN {_STATUS} = 'New' THEN '03-08-2025' WHEN {_STATUS} = 'Available' THEN {_DDMM.replace('seen ', 'm_first ').replace('seen,', 'm_first,').replace('seen[', 'm_first[')} WHEN in_archive THEN snapshot_date ELSE coalesce(m_first, 'Unknown') END"
_LASTSEEN = f"CASE WHEN {_STATUS} <> 'Discontinued' THEN '03-08-2025' WHEN in_archive THEN snapshot_date ELSE coalesce(m_last, 'Unknown') END"
_PRICE = "CASE WHEN in_current THEN c_price WHEN in_archive THEN a_price ELSE m_price END"
_CATEGORY = "CASE WHEN in_current THEN c_category WHEN in_archive THEN a_category ELSE m_category END"
_UPDATED = f"(SELECT brand, name, {_PRICE} AS price, {_CATEGORY} AS category, {_STATUS} AS status, {_FIRSTSEEN} AS first_seen_date, {_LASTSEEN} AS last_seen_date, '{AS_OF}' AS last_updated FROM {_ALIGNED})"
add("lifecycle_join", lambda s, d: _aligned(s, d).select("brand", "name", "in_current", "in_archive", "in_master", c("cur.price").alias("c_price"), c("mas.price").alias("m_price")), f"SELECT brand, name, in_current, in_archive, in_master, c_price, m_price FROM {_ALIGNED}")
add("known_names", lambda s, d: L.known_names(_sides(s, d)[0], _sides(s, d)[2], ["name"]), f"SELECT DISTINCT name FROM {_C} WHERE name IN (SELECT name FROM {_M})")
add("new_names", lambda s, d: L.new_names(_sides(s, d)[0], _sides(s, d)[2], ["name"]), f"SELECT DISTINCT name FROM {_C} WHERE name NOT IN (SELECT name FROM {_M})")
add("archived_missing", lambda s, d: L.archived_missing(_sides(s, d)[1], _sides(s, d)[0], ["name"]), f"SELECT DISTINCT name FROM {_A} WHERE name NOT IN (SELECT name FROM {_C})")
add("master_missing", lambda s, d: L.master_missing(_sides(s, d)[2], _sides(s, d)[0], _sides(s, d)[1], ["name"]), f"SELECT DISTINCT name FROM {_M} WHERE name NOT IN (SELECT name FROM {_C}) AND name NOT IN (SELECT name FROM {_A})")
add("all_names", lambda s, d: L.all_names(*_sides(s, d), ["name"]), f"SELECT name FROM {_C} UNION SELECT name FROM {_A} UNION SELECT name FROM {_M}")
add("names_minus", lambda s, d: L.names_minus(_sides(s, d)[1], _sides(s, d)[0], ["name"]), f"SELECT name FROM {_A} EXCEPT SELECT name FROM {_C}")
add("lifecycle_status", lambda s, d: L.lifecycle_status(_aligned(s, d)).select("brand", "name", "status"), f"SELECT brand, name, {_STATUS} AS status FROM {_ALIGNED}")
add("lifecycle_dates", lambda s, d: L.lifecycle_dates(L.lifecycle_status(_aligned(s, d)), AS_OF).select("name", "first_seen_date", "last_seen_date"), f"SELECT name, {_FIRSTSEEN} AS first_seen_date, {_LASTSEEN} AS last_seen_date FROM {_ALIGNED}")
add("lifecycle_dates_of_master", lambda s, d: L.lifecycle_dates(L.lifecycle_status(_aligned(s, d)), AS_OF, prefer_master_dates=True).select("name", "first_seen_date", "last_seen_date"), f"SELECT name, {_FIRSTSEEN} AS first_seen_date, {_LASTSEEN} AS last_seen_date FROM {_ALIGNED}".replace("WHEN in_archive THEN", "WHEN in_archive AND NOT in_master THEN"))
add("record_precedence", lambda s, d: L.record_precedence(_aligned(s, d), ["price", "category"]).select("name", "price", "category"), f"SELECT name, {_PRICE} AS price, {_CATEGORY} AS category FROM {_ALIGNED}")
add("update_master", _master, f"SELECT * FROM {_UPDATED}")
add("update_all_brands", lambda s, d: L.update_all_brands(*_sides(s, d), AS_OF), f"SELECT * FROM {_UPDATED}")


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    """The master is written in buckets, then updated where it lies."""
    base, (current, archive, master) = scratch(spark, "bucketed"), _sides(spark, d)
    store.start_master(master, base, KEYS, 64, "2025-08-01")
    store.roll_master(current, archive, base, AS_OF)
    return store.read_bucketed(spark, base)[0]


def _filtered(find: Callable, side: int) -> Query:
    """Names of one side looked up in a bucketed master behind the filter that is kept with it."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        base, sides = scratch(spark, "filtered"), _sides(spark, d)
        store.start_master(sides[2], base, ["name"], 64, "2025-08-01", filter_words=key_filter.words_for(1 << 20))
        words, n = store.read_filter(spark, base)
        return find(sides[side], store.read_bucketed(spark, base)[0], ["name"], words, n)

    return query


add("known_names_filtered", _filtered(key_filter.known_names, 0), f"SELECT DISTINCT name FROM {_C} WHERE name IN (SELECT name FROM {_M})")
add("new_names_filtered", _filtered(key_filter.new_names, 0), f"SELECT DISTINCT name FROM {_C} WHERE name NOT IN (SELECT name FROM {_M})")
add("archive_minus_master_filtered", _filtered(key_filter.new_names, 1), f"SELECT DISTINCT name FROM {_A} WHERE name NOT IN (SELECT name FROM {_M})")
add("update_all_brands_bucketed", _rolled, f"SELECT * FROM {_UPDATED}")
_NOARC = _UPDATED.replace(A.duck(A.ARCHIVE), f"(SELECT * FROM {_A} WHERE false)")
add("update_master_two_way", lambda s, d: L.update_master_two_way(_sides(s, d)[0], _sides(s, d)[2], KEYS, AS_OF), f"SELECT * FROM {_NOARC}")
add("sort_by_status_name", lambda s, d: L.sort_by_status_name(_master(s, d)).select("status", "name"), f"SELECT status, name FROM {_UPDATED}")
add("status_reports", lambda s, d: L.status_lines(_master(s, d)), f"SELECT name, '€' || price AS price_label, CASE WHEN status = 'New' THEN first_seen_date ELSE last_seen_date END AS date, status AS report FROM {_UPDATED}")
add("status_counts", lambda s, d: S.status_counts(_master(s, d)), f"SELECT status, count(*) AS n FROM {_UPDATED} GROUP BY status")
add("brand_status_summary", lambda s, d: S.brand_status_summary(_master(s, d)), f"SELECT brand, count(*) AS total, count_if(status = 'New')::BIGINT AS new, count_if(status = 'Available')::BIGINT AS available, count_if(status = 'Discontinued')::BIGINT AS discontinued, grouping(brand)::INT AS is_total FROM {_UPDATED} GROUP BY ROLLUP (brand)")
add_frame("lifecycle_replay", A.SNAPSHOTS, lambda df: L.lifecycle_replay(df, KEYS), "SELECT brand, name, first_seen, last_seen, CASE WHEN last_seen < newest THEN 'Discontinued' WHEN first_seen = newest THEN 'New' ELSE 'Available' END AS status FROM (SELECT brand, name, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen FROM {t} GROUP BY 1, 2) JOIN (SELECT brand, max(snapshot_date) AS newest FROM {t} GROUP BY 1) USING (brand)")
# The registered tables have fewer names a brand than a sketch of 2^20 holds, so its counts are the exact ones of the SQL.
_LG = 20


def _overlaps(df: DataFrame) -> DataFrame:
    pairs = O.successive(O.snapshot_sketches(df, ["brand", "snapshot_date"], ["name"], _LG), ["brand"], "snapshot_date")
    return O.overlap_counts(pairs.drop("variants"), lg_k=_LG).drop("error")


_DAYS = "(SELECT DISTINCT brand, snapshot_date, name FROM {t})"
_DATES = "(SELECT brand, snapshot_date, lag(snapshot_date) OVER (PARTITION BY brand ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT brand, snapshot_date FROM {t}))"
add_frame("snapshot_overlap", A.SNAPSHOTS, _overlaps, f"""WITH s AS {_DAYS}, d AS {_DATES}, now AS (SELECT d.brand, d.snapshot_date, s.name FROM d JOIN s ON s.brand = d.brand AND s.snapshot_date = d.snapshot_date),
  old AS (SELECT d.brand, d.snapshot_date, s.name FROM d JOIN s ON s.brand = d.brand AND s.snapshot_date = d.before)
  SELECT coalesce(now.brand, old.brand) AS brand, coalesce(now.snapshot_date, old.snapshot_date) AS snapshot_date, count(now.name) AS models, count(*) FILTER (old.name IS NULL) AS added,
  count(*) FILTER (now.name IS NOT NULL AND old.name IS NOT NULL) AS kept, count(*) FILTER (now.name IS NULL) AS gone, count(*) AS either
  FROM now FULL JOIN old ON now.brand = old.brand AND now.snapshot_date = old.snapshot_date AND now.name = old.name GROUP BY 1, 2""")  # fmt: skip
add_frame("model_counts_by_sketch", A.DUPLICATES, lambda df: O.model_counts(O.snapshot_sketches(df, ["brand"], ["name"], _LG), _LG).drop("error"), "SELECT brand, count(*) AS variants, count(DISTINCT name) AS models FROM {t} GROUP BY brand")
add_frame("model_and_variant_counts_by_sketch", A.DUPLICATES, lambda df: O.model_counts(O.merged(O.snapshot_sketches(df, ["brand"], ["name"], _LG), [], _LG), _LG).drop("error"), "SELECT count(*) AS variants, count(DISTINCT name) AS models FROM {t}")

# --- reshape and export ---------------------------------------------------------------------------------------------------
_SNAP = "SELECT k, CASE WHEN k % 13 = 0 THEN NULL ELSE name END AS name, brand, price, url, spec_a AS spec_frame, spec_b AS spec_rem, CASE WHEN k % 2 = 0 THEN image END AS hero_image_1_url, CASE WHEN k % 2 = 0 THEN 'p' END AS hero_image_1_path, CASE WHEN k % 4 = 0 THEN concat('https://img.example/', cast(k AS STRING)) END AS hero_image_2_url, CASE k % 4 WHEN 1 THEN 'New' WHEN 2 THEN 'Discontinued' ELSE 'Available' END AS status, seen AS first_seen_date, seen AS last_seen_date, concat('2025-08-0', cast(k % 7 + 1 AS STRING)) AS last_updated FROM (" + A.SPECS + ") x"
_specs = lambda df: df.select("k", _MAP().alias("specs"))
add_frame("specs_to_wide_dynamic", A.SPECS, lambda df: W.specs_to_wide_dynamic(_specs(df)), "SELECT k, spec_a AS spec_Frame, spec_b AS spec_Rem FROM {t}")
# Of three keys the most frequent becomes a column; the other two are read back from the overflow.
_three = lambda df: df.select("k", F.create_map(F.lit("Frame"), c("spec_a"), F.lit("Rem"), c("spec_b"), F.lit("Wheel size"), c("price")).alias("specs"))
add_frame("specs_to_wide_hot", A.SPECS, lambda df: W.specs_to_wide_hot(_three(df), 1).select("k", "spec_Wheel_size", W.overflow_value("Frame").alias("frame"), W.overflow_value("Rem").alias("rem")), "SELECT k, price AS \"spec_Wheel_size\", spec_a AS frame, spec_b AS rem FROM {t}")
add_frame("specs_to_wide_fixed", A.SPECS, lambda df: W.specs_to_wide_fixed(_specs(df), ["Frame", "Rem"]), "SELECT k, coalesce(spec_a, '') AS spec_Frame, coalesce(spec_b, '') AS spec_Rem, '' AS spec_Material, '' AS spec_Weight FROM {t}")
add_frame("images_to_wide", A.SPECS, lambda df: W.images_to_wide(df.select("k", F.slice(F.array(F.struct(c("image").alias("url"), c("brand").alias("local_path"), c("name").alias("filename")), F.struct(c("url"), c("price").alias("local_path"), c("rear").alias("filename"))), F.lit(1), (c("k") % 3).cast("int")).alias("images")), 2), "SELECT k, " + ", ".join(f"CASE WHEN k % 3 >= {i} THEN {v} END AS hero_image_{i}_{n}" for i, vs in ((1, ("image", "brand", "name")), (2, ("url", "price", "rear"))) for n, v in zip(("url", "path", "filename"), vs)) + " FROM {t}")
add_frame("explode_colors", A.SPECS, lambda df: W.explode_colors(df.select("k", F.when(c("k") % 2 == 0, F.array("brand", "rear")).alias("colors"))), "SELECT k, brand AS color FROM {t} WHERE k % 2 = 0 UNION ALL SELECT k, rear FROM {t} WHERE k % 2 = 0 UNION ALL SELECT k, '' FROM {t} WHERE k % 2 <> 0")
_IMPORT = "name AS post_title, price AS regular_price, brand, url AS product_url, 'publish' AS post_status, 'product' AS post_type, spec_frame AS \"meta:frame\", spec_rem AS \"meta:rem\""
add_frame("wide_to_meta", _SNAP, lambda df: W.wide_to_meta(df.drop("k"), {"meta:x": "y"}), f"SELECT {_IMPORT}, 'y' AS \"meta:x\" FROM {{t}}")
add_frame("meta_images", _SNAP, lambda df: df.select("k", *W.meta_images(df.withColumn("hero_image_3_url", F.lit(None).cast("string")), 10, only_filled=True)), 'SELECT k, hero_image_1_url AS images, hero_image_1_path AS "meta:image_1_local_path", hero_image_2_url AS "meta:additional_image_2" FROM {t}')
add_frame("date_discontinued_second", _SNAP, lambda df: W.date_discontinued_second(df.select("k", "name", "last_seen_date")), "SELECT k, last_seen_date AS date_discontinued, name, last_seen_date FROM {t}")
add_frame("specs_to_long", _SNAP, lambda df: W.specs_to_long(df, ["k"]), "SELECT k, 'frame' AS key, spec_frame AS value FROM {t} WHERE spec_frame IS NOT NULL UNION ALL SELECT k, 'rem', spec_rem FROM {t} WHERE spec_rem IS NOT NULL")
_MORE = "SELECT k, name, brand, weight AS extra FROM (" + A.SPECS + ") x"
add("unify_brands", lambda s, d: W.unify_brands([A.frame(s, d, _SNAP).select("k", "name", "brand", "price"), A.frame(s, d, _MORE)]), f"SELECT k, name, brand, price, NULL AS extra FROM {A.duck(_SNAP)} UNION ALL SELECT k, name, brand, NULL, extra FROM {A.duck(_MORE)}")
add_frame("filter_brands", _SNAP, lambda df: W.filter_brands(df, ["Brand#11", "Brand#12"]).select("k", "brand"), "SELECT k, brand FROM {t} WHERE brand IN ('Brand#11', 'Brand#12')")
add_frame("distinct_brands", _SNAP, W.distinct_brands, "SELECT DISTINCT brand FROM {t}")
add_frame("available_only", _SNAP, lambda df: X.available_only(df).select("k", "status"), "SELECT k, status FROM {t} WHERE status = 'Available'")
add_frame("drop_untitled", _SNAP, lambda df: X.drop_untitled(df.select("k", c("name").alias("post_title"))), "SELECT k, name AS post_title FROM {t} WHERE name IS NOT NULL")
_STATE = 'status AS "meta:availability_status", first_seen_date AS "meta:first_seen_date", last_seen_date AS "meta:last_seen_date", last_updated AS "meta:last_updated"'
_IMG1 = 'hero_image_1_url AS images, hero_image_1_path AS "meta:image_1_local_path"'
_IMG2 = 'hero_image_2_url AS "meta:additional_image_2"'
add_frame("export_single", _SNAP, lambda df: X.export_single(df.drop("k"), AS_OF, "shop"), f"SELECT {_IMPORT}, {_IMG1}, {_IMG2}, '{AS_OF}' AS \"meta:import_date\", 'shop' AS \"meta:import_source\" FROM {{t}} WHERE name IS NOT NULL")
_BRANDS = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"]
_UNIFIED = f"SELECT {_IMPORT}, {_STATE}, {_IMG1}, {_IMG2}, '{AS_OF}' AS \"meta:import_date\", '{', '.join(_BRANDS)}' AS \"meta:import_brands\" FROM {{t}} WHERE name IS NOT NULL AND status = 'Available' AND brand IN ({', '.join(repr(b) for b in _BRANDS)})"
add_frame("export_unified", _SNAP, lambda df: X.export_unified(df.drop("k"), _BRANDS, AS_OF), _UNIFIED)


def _exported(spark: SparkSession, d: str) -> DataFrame:
    """Written by brand, then read back brand by brand and as a whole."""
    base, master = scratch(spark, "export"), A.frame(spark, d, _SNAP).drop("k")
    X.export_per_brand_and_all(filter_brands(master, _BRANDS), base, AS_OF)
    found = spark.read.parquet(base)
    return found.select(c("brand").cast("string").alias("brand"), *[f"`{x}`" for x in found.columns if x != "brand"])


add("export_per_brand_and_all", _exported, _UNIFIED.replace("{t}", A.duck(_SNAP)))

# --- HTML blocks ------------------------------------------------------------------------------------------------------------
_TABLE = "SELECT page_id, 'Frame' AS key, 'Carbon' || p_size AS value FROM p UNION ALL SELECT page_id, 'Rem', {rem} FROM p"
_P = "WITH p AS (SELECT p_partkey AS page_id, * FROM part) "
_blocks = lambda df, *kinds: H.extract_blocks(df, kinds)
add_frame("extract_spec_table", A.DETAIL_PAGES, lambda df: H.extract_spec_table(_blocks(df, "table")), _P + _TABLE.format(rem="'Disc ' || p_type"), deal=True)
add_frame("extract_spec_dl", A.DETAIL_PAGES, lambda df: H.extract_spec_dl(_blocks(df, "table", "dl")), _P + _TABLE.format(rem="CASE WHEN page_id % 2 = 0 THEN 'Hydraulic' ELSE 'Disc ' || p_type END") + " UNION ALL SELECT page_id, 'Weight', p_size || ' kg' FROM p WHERE page_id % 2 = 0", deal=True)
add_frame("extract_spec_rows_mapped", A.DETAIL_PAGES, lambda df: H.extract_spec_rows_mapped(_blocks(df, "table", "dl")), _P + _TABLE.format(rem="CASE WHEN page_id % 2 = 0 THEN 'Hydraulic' ELSE 'Disc ' || p_type END").replace("AS key", "AS field") + " UNION ALL SELECT page_id, 'Weight', p_size || ' kg' FROM p WHERE page_id % 2 = 0", deal=True)
add_frame("extract_components", A.DETAIL_PAGES, lambda df: H.extract_components(_blocks(df, "component")).select("page_id", "title", "name", F.array_join("features", "|").alias("features")), _P + "SELECT page_id, 'Wiel' AS title, p_brand AS name, CASE WHEN page_id % 3 = 0 THEN '12x100' ELSE '12x142' END AS features FROM p", deal=True)
add_frame("component_special_rules", A.DETAIL_PAGES, lambda df: E.component_special_rules(H.extract_components(_blocks(df, "component"))), _P + "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Naaf_voor' ELSE 'Naaf_achter' END AS field, p_brand AS value FROM p UNION ALL SELECT page_id, 'Velg', p_brand FROM p", deal=True)
add_frame("extract_description", A.DETAIL_PAGES, lambda df: H.extract_description(_blocks(df, "block")), _P + "SELECT page_id, 'A long enough description of this very good bicycle ' || p_name || '.' AS description FROM p", deal=True)
add_frame("extract_color_picker", A.DETAIL_PAGES, lambda df: H.extract_color_picker(_blocks(df, "color")).select("page_id", F.array_join(F.transform("colors", lambda x: F.concat_ws(":", x["id"], x["name"], x["url"])), "|").alias("colors")), _P + "SELECT page_id, page_id || ':Red:/r' AS colors FROM p", deal=True)
add_frame("extract_classification_limit", A.DETAIL_PAGES, lambda df: H.extract_classification_limit(_blocks(df, "classification")), _P + "SELECT page_id, (100 + p_size) || ' kg' AS weight_limit FROM p", deal=True)


def _enriched(df: DataFrame) -> DataFrame:
    specs = F.create_map(*[x for k in ("cassette", "crank", "rear", "weight", "shifter", "frame", "weight_limit") for x in (F.lit(_SPEC_NAMES[k]), c(k))])
    rows = E.enrich_specs(df.select("k", "name", "category", c("note").alias("text"), specs.alias("specs")))
    return rows.select("k", *[c("specs")[n].alias(n) for n in ("Gewicht", "Gewichtslimiet", "Frame", "Shifter_speed", "Ketting", "Voorderailleur")])


_SPEC_NAMES = {"cassette": "Cassette", "crank": "Crankstel", "rear": "Achterderailleur", "weight": "Gewicht", "shifter": "Shifter", "frame": "Frame", "weight_limit": "Gewichtslimiet"}
# Composed of the functions above, so its SQL is composed of theirs.
_sql_of = lambda name: _SQL[name].split(", ", 1)[1].rsplit(" AS out FROM", 1)[0]
_SIZED = _sql_of("size_in_weight").replace("weight", "w1")
_REASON0 = _REASON.replace("contains(chainring, 'x') AND NOT contains(chainring, '2x')", "false")
add_frame(
    "enrich_specs",
    A.SPECS,
    _enriched,
    f"SELECT k, (SELECT {_SIZED} FROM (SELECT {_sql_of('clean_weight').replace('weight', 't.weight')} AS w1)) AS Gewicht, {_sql_of('extract_weight_limit')} AS Gewichtslimiet, {_sql_of('frame_material')} AS Frame, {_sql_of('shifter_speed')} AS Shifter_speed, {_sql_of('predict_chain')} || '*' AS Ketting, CASE WHEN ({_REASON0}) IS NOT NULL OR {_SCORE} >= 3 THEN '1x, geen voorderailleur' WHEN {_DOUBLE} THEN '2x systeem, voorderailleur aanwezig' END AS Voorderailleur FROM {{t}} t",
    deal=True,
)

# --- writers and readers: each query writes to a shared scratch folder and reads back -----------------------------------------
_ROWS = "SELECT cast(p_partkey AS STRING) AS k, concat('a \"', p_name, '\", b', chr(10), 'c') AS name, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_type END AS note, p_brand AS brand FROM {part}"
_BACK = "SELECT k, name, nullif(note, '') AS note, brand FROM {t}"


def _round_trip(write: Callable, read: Callable) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        path = scratch(spark, "catalog")
        write(A.frame(spark, d, _ROWS), path)
        return read(spark, path)

    return query


for _name, _write in (("read_snapshot_csv", IO.write_csv_quote_all), ("write_csv_quote_all", IO.write_csv_quote_all), ("write_csv_minimal", IO.write_csv_minimal)):
    add(_name, _round_trip(_write, IO.read_snapshot_csv), _BACK.replace("{t}", A.duck(_ROWS)))
add("write_json_records", _round_trip(IO.write_json_records, lambda s, p: s.read.schema("k string, name string, note string, brand string").json(p)), f"SELECT * FROM {A.duck(_ROWS)}")
# Three snapshots of each brand, of different rows and columns.
_ARCHIVED = {"20250718_102343": ("p_partkey % 5 <> 0", ["name", "price"]), "20250718_102836": ("p_partkey % 2 = 0", ["name", "price", "category"]), "20250719_101500": ("p_partkey % 3 = 0", ["name", "category"])}
_ARCHIVE_ROWS = "SELECT lower(replace(p_brand, '#', '_')) AS brand_name, p_partkey, concat('a \"', p_name, '\", b', chr(10), p_partkey) AS name, cast(p_size AS STRING) AS price, p_type AS category FROM {part}"


def _best_archives(spark: SparkSession, d: str) -> DataFrame:
    base, rows = scratch(spark, "archives"), A.frame(spark, d, _ARCHIVE_ROWS)
    for ts, (where, columns) in _ARCHIVED.items():
        named = rows.where(where).select(F.concat("brand_name", F.lit(f"_bikes_{ts}.csv")).alias("f"), *columns)
        named.repartition("f").write.mode("append").partitionBy("f").option("header", True).option("escape", '"').csv(base)
    return IO.read_best_archives(spark, f"{base}/*", columns=["name", "price", "category"])


_SNAPS = " UNION ALL ".join(f"SELECT brand_name, '{ts}' AS snapshot, name, {', '.join(x if x in cols else f'NULL AS {x}' for x in ('price', 'category'))}, {len(cols)} AS n_cols FROM {A.duck(_ARCHIVE_ROWS)} WHERE {where}" for ts, (where, cols) in _ARCHIVED.items())
add("best_archive_rows", _best_archives, f"WITH s AS ({_SNAPS}), b AS (SELECT brand_name, snapshot, row_number() OVER (PARTITION BY brand_name ORDER BY count(*) * max(n_cols) DESC, snapshot DESC) AS place FROM s GROUP BY 1, 2) SELECT s.brand_name, s.snapshot, substr(s.snapshot, 10) AS snapshot_date, s.name, s.price, s.category FROM s JOIN b ON s.brand_name = b.brand_name AND s.snapshot = b.snapshot AND place = 1")
# Arrays of bounded size, a row for a brand and 1,000 part keys; those of 100,000 keys are written as one array, a file, whose parts are never together in memory.
_ARRAY = "SELECT p_brand AS brand, p_partkey div 1000 AS part_range, concat('[', array_join(array_sort(collect_list(concat('{{\"name\": \"', p_name, ' ', p_partkey, '\", \"price\": ', p_size, ', \"specifications\": {{\"Frame\": \"', p_type, '\"}}}}'))), ','), ']') AS value FROM {part} GROUP BY p_brand, p_partkey div 1000"


def _json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    IO.write_json_arrays(A.frame(spark, d, _ARRAY).withColumn("ranges", F.expr("part_range div 100")), path, ["brand", "ranges"], "part_range")
    return IO.read_snapshot_json(spark, path).select("name", "price", c("specifications")["Frame"].alias("frame"))


add("read_snapshot_json", _json, "SELECT p_name || ' ' || p_partkey AS name, p_size::VARCHAR AS price, p_type AS frame FROM part")


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    base, df = scratch(spark, "versions"), A.frame(spark, d, _ROWS)
    IO.write_versioned_latest(df.withColumn("note", F.lit("old")), base, "20250718_102343")
    IO.write_versioned_latest(df.where("note is not null"), base, "20250718_102836")
    return IO.read_latest(spark, base)


add("write_versioned_latest", _versioned, f"SELECT * FROM {A.duck(_ROWS)} WHERE note IS NOT NULL")
add("write_by_brand", _round_trip(IO.write_by_brand, lambda s, p: s.read.parquet(p).groupBy(c("brand").cast("string").alias("brand")).agg(F.count("*").alias("n"))), f"SELECT brand, count(*) AS n FROM {A.duck(_ROWS)} GROUP BY brand")

# --- streaming: each query runs its stream to the end ---------------------------------------------------------------------------


def _first_users(spark: SparkSession, d: str) -> DataFrame:
    schema, out = spark.read.parquet(f"{d}/events.parquet").schema, scratch(spark, "stream")
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    try:
        firsts = jobs.stream_first_by_key(spark.readStream.schema(schema).parquet(f"{d}/events*.parquet"), ["user_id"], ord_col="event_id", delay="2 days", keep="1 day")
        firsts.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(jobs.ROCKSDB[0], before)
    return spark.read.schema(schema).parquet(f"{out}/rows")


# A user is new again after a day without events; what is younger than the watermark at the end has not come out yet.
add(
    "stream_first_by_key",
    _first_users,
    "SELECT * EXCLUDE (before) FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE (before IS NULL OR ts > before + INTERVAL 1 DAY) AND ts < (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
)


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "master")
    schema = "brand string, name string, price string, category string, as_of string"
    for day, source in (("2025-08-01", A.CURRENT), ("2025-08-02", A.ARCHIVE)):
        A.frame(spark, d, source).select("brand", "name", "price", "category", F.lit(day).alias("as_of")).write.mode("append").parquet(f"{base}/in")
        jobs.stream_master_update(spark, f"{base}/in", f"{base}/out", schema, KEYS).awaitTermination()
    return jobs.latest_master(spark, f"{base}/out")


add(
    "stream_master_update",
    _streamed,
    f"SELECT n.brand, n.name, coalesce(a.price, c.price) AS price, coalesce(a.category, c.category) AS category, CASE WHEN a.name IS NULL THEN 'Discontinued' WHEN c.name IS NULL THEN 'New' ELSE 'Available' END AS status, CASE WHEN c.name IS NULL THEN '02-08-2025' ELSE '01-08-2025' END AS first_seen_date, CASE WHEN a.name IS NULL THEN '01-08-2025' ELSE '02-08-2025' END AS last_seen_date, '2025-08-02' AS last_updated FROM (SELECT brand, name FROM {_C} UNION SELECT brand, name FROM {_A}) n LEFT JOIN {_C} c ON n.name = c.name AND n.brand = c.brand LEFT JOIN {_A} a ON n.name = a.name AND n.brand = a.brand",
)
_FIELDS = {"meta:additional_image_2": "hero_image_2_url", "meta:frame": "spec_frame", "meta:image_1_local_path": "hero_image_1_path", "meta:import_date": f"'{AS_OF}'", "meta:import_source": "'shop'", "meta:rem": "spec_rem"}
add(
    "sorted_custom_fields",
    lambda s, d: W.custom_field_counts(X.export_single(A.frame(s, d, _SNAP).drop("k"), AS_OF, "shop")),
    "SELECT field, place, filled FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {i}::BIGINT AS place, count(*) FILTER (trim({v}) <> '') AS filled FROM {A.duck(_SNAP)} WHERE name IS NOT NULL" for i, (f, v) in enumerate(_FIELDS.items()))
    + ")",
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
