"""Parsers of tool, service and config texts, all as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from prismlake.functions.media import first_filled
from prismlake.functions.text import trim_unicode

_PROBE = "struct<format:struct<duration:string,tags:map<string,string>>,streams:array<struct<codec_type:string,width:int,height:int,tags:map<string,string>>>>"
#: Reasoning text is cut to so many characters.
LONGEST = 240
EMPTY_REASONING = "[no description came back]"


def container_metadata(text: Column) -> Column:
    """duration, creation_time, location, width, height of a container probe's JSON."""
    j = F.from_json(text, _PROBE)
    tags = j["format"]["tags"]
    times = F.filter(F.transform(j["streams"], lambda s: s["tags"]["creation_time"]), lambda t: t.isNotNull())
    video = F.try_element_at(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    return F.struct(
        j["format"]["duration"].try_cast("double").alias("duration"),
        F.coalesce(tags["creation_time"], F.try_element_at(times, F.lit(1))).alias("creation_time"),
        F.coalesce(tags["com.apple.quicktime.location.ISO6709"], tags["location"]).alias("location"),
        video["width"].alias("width"), video["height"].alias("height"),
    )


def iso6709(text: Column) -> Column:
    """lat and lon of a text like +48.1351+011.5820+123.4/; null if the latitude or longitude is no number."""
    body = F.regexp_replace(text, "/+$", "")
    lat = F.regexp_extract(body, r"^([+-]?[0-9.]+)([+-][0-9.]+)", 1).try_cast("double")
    lon = F.regexp_extract(body, r"^([+-]?[0-9.]+)([+-][0-9]*\.?[0-9]*)", 2).try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"))


def _labelled(lines: Column, label: str) -> Column:
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(label))), lambda x: trim_unicode(F.substr(x, F.lit(len(label) + 1))))


def structured_response(text: Column) -> Column:
    """description, tags, ocr_text of a response with DESCRIPTION:, TAGS: and TEXT: lines; the last of each counts.

    A TEXT that is empty or none doesn't count; without a description the whole response is one.
    """
    lines = F.transform(F.split(text, "\r?\n"), trim_unicode)
    last = lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(""))
    seen = F.filter(_labelled(lines, "TEXT:"), lambda x: (x != "") & (F.lower(x) != "none"))
    return F.struct(first_filled(last(_labelled(lines, "DESCRIPTION:")), trim_unicode(text)).alias("description"), last(_labelled(lines, "TAGS:")).alias("tags"), last(seen).alias("ocr_text"))


def reasoning_tail(text: Column) -> Column:
    """The last line that isn't blank, without leading numbering, cut to LONGEST characters and an ellipsis."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), trim_unicode), lambda x: x != "")
    line = F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), r"^[0-9. *]+", "")
    cut = F.when(F.length(line) > LONGEST, F.concat(F.substr(line, F.lit(1), F.lit(LONGEST)), F.lit("…"))).otherwise(line)
    return first_filled(cut, F.lit(EMPTY_REASONING))


def chat_response(body: Column) -> Column:
    """description, tags, ocr_text of a chat completion's JSON: its content, else the tail of its reasoning."""
    content = trim_unicode(F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit("")))
    reasoning = reasoning_tail(F.coalesce(F.get_json_object(body, "$.choices[0].message.reasoning_content"), F.lit("")))
    return F.when(content != "", structured_response(content)).otherwise(F.struct(reasoning.alias("description"), F.lit("").alias("tags"), F.lit("").alias("ocr_text")))


def ollama_response(body: Column) -> Column:
    return structured_response(F.coalesce(F.get_json_object(body, "$.response"), F.lit("")))


def key_values(text: Column) -> Column:
    """Map of a config text's key=value lines: blank and # lines are skipped, keys and values trimmed, the last key counts."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), trim_unicode), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(trim_unicode(F.regexp_extract(x, "^([^=]*)=", 1)).alias("k"), trim_unicode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def place_name(body: Column) -> Column:
    """Place, country or both of a reverse geocoder's JSON, else its display name, else null; values that aren't text, and empty ones, are skipped."""
    parsed = F.try_parse_json(body)

    def only(path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING"
        return F.when(is_text, F.nullif(F.try_variant_get(parsed, path, "string"), F.lit("")))

    local = F.coalesce(*(only(f"$.address.{k}") for k in ("city", "town", "village", "municipality", "county")))
    country = only("$.address.country")
    return F.when(local.isNotNull() & country.isNotNull(), F.concat(local, F.lit(", "), country)).otherwise(F.coalesce(local, country, only("$.display_name")))
