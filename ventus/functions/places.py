"""Place names: normalised text, group keys, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("region", "country", "state", "district")
#: Levels that make up a place's key and its label, by level.
KEY_PARTS = {"region": ("region",), "country": ("region", "country"), "state": ("country", "state"), "district": ("country", "state", "district")}
LABEL_PARTS = {"region": ("region",), "country": ("country",), "state": ("state", "country"), "district": ("district", "state", "country")}

# Tokens of place names that stand for another.
TOKEN_ALIASES = {
    "mayammar": "myanmar",
    "myamar": "myanmar",
    "myanmmar": "myanmar",
    "burma": "myanmar",
}

# Entries of country level that are no sovereign countries.
TERRITORIES = (
    "american samoa", "anguilla", "aruba", "bermuda", "british virgin islands",
    "aland", "aland islands", "antarctica", "ashmore and cartier islands", "bonaire sint eustatius and saba",
    "bouvet island", "british indian ocean territory", "cayman islands", "christmas island", "clipperton island",
    "cocos islands", "cook islands", "coral sea islands territory", "curacao", "faroe islands", "falkland islands",
    "french guiana", "french polynesia", "french southern territories", "gibraltar", "greenland", "guadeloupe", "guam", "guernsey", "hong kong",
    "heard island and mcdonald islands",
    "isle of man", "jersey", "macao", "martinique", "mayotte", "montserrat", "new caledonia",
    "niue", "norfolk island", "northern mariana islands", "paracel islands", "pitcairn islands", "puerto rico", "reunion", "saint barthelemy",
    "saint helena ascension and tris", "saint helena ascension and tristan da cunha", "saint martin", "saint pierre and miquelon", "sint maarten", "south georgia and the south sandwich islands", "spratly islands", "svalbard and jan mayen",
    "tokelau", "turks and caicos islands", "united states minor outlying islands", "united states virgin islands",
    "virgin islands u s", "wallis and futuna", "western sahara",
)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_place(c: Column | str) -> Column:
    """Trimmed, and null if nothing is left."""
    t = F.trim(_column(c))
    return F.when(t != "", t)


def normalize_place(c: Column | str) -> Column:
    """Lower case, other than a-z and 0-9 as one space, aliases put in place of their tokens."""
    text = F.trim(F.regexp_replace(F.lower(_column(c)), r"[^a-z0-9]+", " "))
    aliases = F.create_map(*[F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair])
    return F.when(text.rlike(r"\b(" + "|".join(TOKEN_ALIASES) + r")\b"), F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(aliases[t], t)), " ")).otherwise(text)


def usable_label(c: Column | str) -> Column:
    """Neither missing nor a word for missing."""
    return F.coalesce(~F.lower(F.trim(_column(c))).isin("", "na", "n/a", "n-a", "null", "none", "unknown", "-"), F.lit(False))


def place_key(level: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(normalize_place(p), F.lit("")) for p in KEY_PARTS[level]])


def place_label(level: str, with_parents: bool = True) -> Column:
    parts = LABEL_PARTS[level] if with_parents else LABEL_PARTS[level][: 2 if level == "district" else 1]
    return F.concat_ws(", ", *[F.col(p) for p in parts])


def is_exact(level: str) -> Column:
    """The row is of this level itself: it names no place of a deeper level."""
    deeper = LEVELS[LEVELS.index(level) + 1 :]
    out = F.col(level).isNotNull()
    for d in deeper:
        out = out & F.col(d).isNull()
    return out


def is_territory(c: Column | str) -> Column:
    return F.coalesce(normalize_place(c).isin(*TERRITORIES), F.lit(False))
