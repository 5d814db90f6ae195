"""Rule tables: ordered vocabularies that turn free text into standard fields. All are plain data and can be replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.automaton import MANY_WORDS, first_word

# The standard vocabularies of the shop exports, in their order (the first rule that fits wins).
SPEC_KEY_RULES = [
    ("frame", "Frame"), ("kader", "Frame"), ("frameset", "Frame"), ("framefit", "Framefit"), ("frame fit", "Framefit"),
    ("gewicht", "Gewicht"), ("weight", "Weight"), ("massa", "Gewicht"), ("gewichtslimiet", "Gewichtslimiet"),
    ("weight limit", "Gewichtslimiet"), ("maximum weight", "Gewichtslimiet"), ("max gewicht", "Gewichtslimiet"),
    ("shifter", "Shifter"), ("schakelhendel", "Shifter"), ("schakelaar", "Shifter"), ("voorderailleur", "Voorderailleur"),
    ("front derailleur", "Voorderailleur"), ("achterderailleur", "Achterderailleur"), ("rear derailleur", "Achterderailleur"),
    ("derailleur achter", "Achterderailleur"), ("derailleur voor", "Voorderailleur"), ("crankstel", "Crankstel"),
    ("crankset", "Crankstel"), ("crank", "Crankstel"), ("bottom bracket", "Bottom_bracket"), ("trapas", "Bottom_bracket"),
    ("cassette", "Cassette"), ("tandwielcassette", "Cassette"), ("ketting", "Ketting"), ("chain", "Ketting"),
    ("pedaal", "Pedaal"), ("pedal", "Pedaal"), ("pedalen", "Pedaal"), ("kettingblad", "Maximale_maat_kettingblad"),
    ("chainring", "Maximale_maat_kettingblad"), ("naaf voor", "Naaf_voor"), ("front hub", "Naaf_voor"), ("voornaaf", "Naaf_voor"),
    ("as voorwiel", "As_voorwiel"), ("front axle", "As_voorwiel"), ("vooras", "As_voorwiel"), ("naaf achter", "Naaf_achter"),
    ("rear hub", "Naaf_achter"), ("achternaaf", "Naaf_achter"), ("velg", "Velg"), ("rim", "Velg"), ("velgen", "Velg"),
    ("buitenband", "Buitenband"), ("tire", "Buitenband"), ("band", "Buitenband"), ("bandenmaaat", "Maximale_bandenmaat"),
    ("tire size", "Maximale_bandenmaat"), ("max tire", "Maximale_bandenmaat"), ("max band", "Maximale_bandenmaat"),
    ("zadel", "Zadel"), ("saddle", "Zadel"), ("zitting", "Zadel"), ("zadelpen", "Zadelpen"), ("seatpost", "Zadelpen"),
    ("zadelstam", "Zadelpen"), ("stuur", "Stuur"), ("handlebar", "Stuur"), ("handlebars", "Stuur"), ("stuurlint", "Stuurlint"),
    ("bar tape", "Stuurlint"), ("tape", "Stuurlint"), ("stuurpen", "Stuurpen"), ("stem", "Stuurpen"), ("voorstam", "Stuurpen"),
    ("balhoofdstel", "Balhoofdstel"), ("headset", "Balhoofdstel"), ("rem", "Rem"), ("brake", "Rem"), ("remmen", "Rem"),
    ("brakes", "Rem"), ("speed", "Shifter_speed"), ("versnellingen", "Shifter_speed"), ("aantal versnellingen", "Shifter_speed"),
    ("material", "Material"), ("materiaal", "Material"),
]
COMPONENT_TITLE_RULES = [
    ("schakel / remhendel", "Shifter"), ("voorderailleur", "Voorderailleur"), ("achterderailleur", "Achterderailleur"),
    ("crankstel", "Crankstel"), ("trapas", "Bottom_bracket"), ("bottom bracket", "Bottom_bracket"), ("cassette", "Cassette"),
    ("ketting", "Ketting"), ("chain", "Ketting"), ("pedaal", "Pedaal"), ("pedalen", "Pedaal"),
    ("kettingblad", "Maximale_maat_kettingblad"), ("chainring", "Maximale_maat_kettingblad"), ("wiel", "Wiel"), ("wheel", "Wiel"),
    ("steekas", "Steekas"), ("through axle", "Steekas"), ("voornaaf", "Naaf_voor"), ("naaf voor", "Naaf_voor"),
    ("front hub", "Naaf_voor"), ("vooras", "As_voorwiel"), ("as voorwiel", "As_voorwiel"), ("front axle", "As_voorwiel"),
    ("achternaaf", "Naaf_achter"), ("naaf achter", "Naaf_achter"), ("rear hub", "Naaf_achter"), ("velg", "Velg"),
    ("velgen", "Velg"), ("rim", "Velg"), ("band", "Buitenband"), ("buitenband", "Buitenband"), ("tire", "Buitenband"),
    ("tyre", "Buitenband"), ("zadel", "Zadel"), ("saddle", "Zadel"), ("zadelpen", "Zadelpen"), ("seatpost", "Zadelpen"),
    ("stuur", "Stuur"), ("cockpit", "Stuur"), ("handlebar", "Stuur"), ("handlebars", "Stuur"), ("stuurlint", "Stuurlint"),
    ("bar tape", "Stuurlint"), ("tape", "Stuurlint"), ("stuurpen", "Stuurpen"), ("stem", "Stuurpen"),
    ("balhoofdstel", "Balhoofdstel"), ("headset", "Balhoofdstel"), ("rem", "Rem"), ("remmen", "Rem"), ("brake", "Rem"),
    ("brakes", "Rem"), ("frame", "Frame"), ("kader", "Frame"),
]
REQUIRED_SPECS = [
    "Frame", "Framefit", "Gewicht", "Gewichtslimiet", "Shifter", "Voorderailleur", "Achterderailleur", "Crankstel",
    "Bottom_bracket", "Cassette", "Ketting", "Pedaal", "Maximale_maat_kettingblad", "Naaf_voor", "As_voorwiel", "Naaf_achter",
    "Velg", "Buitenband", "Maximale_bandenmaat", "Zadel", "Zadelpen", "Stuur", "Stuurlint", "Stuurpen", "Balhoofdstel", "Rem",
    "Shifter_speed",
]
EXTRA_SPECS = ["Material", "Weight"]
MATERIALS = ["Carbon CFR", "Carbon CF SLX", "Carbon CF", "Aluminium AL", "Carbon", "Aluminium"]
SKIP_PHRASES = ["cookie", "privacy", "newsletter", "copyright", "terms", "conditions"]
EXCLUDED_PATHS = ["/blog-content/", "/koopgids-", "/wielren-blog", "/news/", "/stories/", "/campaign/", "/promo/", "/service/", "/support/"]
#: (all of these words, value); the first that fits wins.
CATEGORY_RULES = [(["endurance"], "Endurance"), (["endurace"], "Endurance"), (["ultimate"], "Race"), (["aeroad"], "Aero"), (["aero"], "Aero"), (["speedmax"], "Time Trial"), (["inflite"], "Cyclocross")]
URL_FIT_RULES = [
    (["frame-and-brake-kit"], "framesets"), (["frs"], "framesets"), (["track"], "track"), (["young-hero"], "youth"), (["allroad"], "allroad"),
    (["all-road"], "allroad"), (["endurace", "aero"], "allroad"), (["endurace", "grc"], "allroad"), (["endurace", "arc"], "allroad"),
    (["aeroad"], "race"), (["ultimate"], "race"), (["endurace"], "endurance"), (["speedmax"], "triathlon"), (["inflite"], "comfort"),
]
NAME_FIT_RULES = [(["domane"], "Endurance"), (["checkpoint"], "Endurance"), (["madone"], "H1.5 Race"), (["émonda"], "H1.5 Race"), (["speed concept"], "Triatlon"), (["boone"], "H1.5 Race"), (["fx"], "Comfort")]
CATEGORY_FIT_RULES = [(["performance"], "H1.5 Race"), (["gravel"], "Endurance"), (["cyclocross"], "Endurance"), (["fitness"], "Comfort"), (["triathlon"], "Triatlon")]
BOTTOM_BRACKET_RULES = [
    *[([s, "axs"], "SRAM DUB, T47 met schroefdraad, interne lagers") for s in ("slr", "sl 6", "sl 7", "sl 8", "sl 9")],
    *[(["checkpoint", s], "SRAM DUB Wide, T47 met schroefdraad, interne lagers") for s in ("alr", "sl")],
    *[([s], "Praxis, T47 met schroefdraad, interne lagers") for s in ("domane", "émonda", "madone")],
    (["fx"], "Shimano RS500, 86 mm, PressFit"), *[([s], "Shimano RS501 BSA") for s in ("al 2", "al 4", "al 5")],
]
#: (words in the rear derailleur, words in the cassette, chain).
CHAIN_RULES = [
    (["sram", "apex"], ["12"], "SRAM Apex, 12-speed"), (["sram", "apex"], [], "SRAM PC-1130, 11-speed"),
    (["sram", "rival"], ["13"], "SRAM Rival, 13-speed"), (["sram", "rival"], [], "SRAM Rival, 12-speed"),
    (["sram", "force"], ["13"], "SRAM Force E1, 12/13-speed"), (["sram", "force"], [], "SRAM Force, 12-speed"),
    (["sram", "red"], [], "SRAM RED D1, 12-speed"), (["shimano", "ultegra"], [], "Shimano XT M8100, 12-speed"),
    (["shimano", "xt"], [], "Shimano XT M8100, 12-speed"), (["shimano", "105"], [], "Shimano SLX M7100, 12-speed"),
    (["shimano", "cues"], [], "Shimano CN-LG500, 10-speed"), ([], ["11"], "SRAM PC-1130, 11-speed"),
    ([], ["12"], "Shimano SLX M7100, 12-speed"), ([], ["10"], "Shimano CN-LG500, 10-speed"),
]
FRAME_MATERIALS = [
    r"\d+\s+Series\s+OCLV\s+Carbon", r"OCLV\s+Carbon\s+\d+", r"OCLV\s+Carbon", r"Ultralicht\s+\d+\s+Series\s+Alpha\s+Aluminium",
    r"\d+\s+Series\s+Alpha\s+Aluminium", r"Alpha\s+Aluminium\s+\d+", r"Alpha\s+Aluminium", r"Carbon\s+fiber", "Steel", "Titanium", "Chromoly",
]
FORK_PATTERNS = ["carbon voorvork[^.]*", "voorvork[^.]*carbon[^.]*", "fork[^.]*carbon[^.]*", "carbon fork[^.]*"]
BOTTOM_BRACKET_PATTERNS = [
    r"(?:SRAM DUB|Praxis|Shimano RS\d+)[^.]*?(?:T47|BSA|PressFit)[^.]*", r"(?:T47|BSA|PressFit)[^.]*?(?:SRAM DUB|Praxis|Shimano RS\d+)[^.]*",
    r"Bottom bracket[^.]*(?:SRAM|Praxis|Shimano)[^.]*", r"(?:SRAM|Praxis|Shimano)[^.]*bottom bracket[^.]*",
]
CHAIN_PATTERNS = [
    r"(?:SRAM|Shimano|KMC)\s+(?:PC-\d+|HG\d+|CN\d+|XT M\d+|Ultegra|105)[^.]*?(?:\d+-)?\d+-speed", r"(?:SRAM|Shimano|KMC)\s+[^.]*?(?:\d+-)?\d+-speed[^.]*chain",
    r"chain[^.]*(?:SRAM|Shimano|KMC)[^.]*(?:\d+-)?\d+-speed", r"(?:\d+-)?\d+-speed[^.]*(?:SRAM|Shimano|KMC)[^.]*chain",
]
SINGLE_RING_PATTERNS = [r"\b40t\b.*ring", r"\b42t\b.*ring", r"\b40t\b.*kettingblad", r"\b42t\b.*kettingblad", "narrow-wide.*kettingblad", "apex 1", "force.*1", "single.*chainring"]
WIDE_CASSETTES = ["10-50", "10-52", "11-50", "11-52", "10-44", "10-46", "11-44", "11-46", "10-48", "11-48", "10-42", "11-42"]
ONE_BY_DERAILLEURS = ["apex 1", "apex.*xplr", "force.*xplr", "red.*xplr", "rival.*xplr", "grx.*1x", "cues.*gs"]
ONE_BY_NAMES = ["checkpoint.*alr.*[345]", "fx.*sport", "checkmate", "boone.*5"]
REJECTED_IMAGES = ["thumb", "icon", "logo", "badge", "w_50", "w_100", "w_150", "h_50", "h_100"]
PLACEHOLDER_IMAGES = ["default-no-image", "CyclingTips"]
HIGH_QUALITY_IMAGES = ["w_1360", "w_1200", "w_690", "w_800", "w_1000", "Primary", "Hero", "Detail", "Gallery", "Portrait", "h_1020", "h_800", "h_600"]
MEDIUM_QUALITY_IMAGES = ["w_400", "w_500", "w_600", "h_300", "h_400", "h_518"]


def contains_all(text: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & text.contains(w)
    return out


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_rule(text: Column, rules: list, default: str | None = None) -> Column:
    """The value of the first rule whose words (a string or a list of strings) are all in the text.

    From MANY_WORDS rules of one word on, one walk of an automaton instead of a chain of CASE.
    """
    if len(rules) >= MANY_WORDS and all(isinstance(words, str) or len(words) == 1 for words, _ in rules):
        return first_word(text, [(words if isinstance(words, str) else words[0], value) for words, value in rules], default)
    out = F.lit(default).cast("string")
    for words, value in reversed(rules):
        out = F.when(contains_all(text, [words] if isinstance(words, str) else words), value).otherwise(out)
    return out


def any_pattern(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(patterns))


def first_match(text: Column, patterns: list[str], min_len: int = 0, ignore_case: bool = True) -> Column:
    """The first hit of the first pattern (in order) whose hit is longer than min_len, trimmed."""
    found = [F.trim(F.regexp_extract(text, f"({'(?i)' if ignore_case else ''}{p})", 1)) for p in patterns]
    return F.coalesce(*[F.when(F.length(x) > min_len, x) for x in found])
