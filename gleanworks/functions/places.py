"""Places and stated eligibility: what a location string says with confidence, else null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks.functions import text, vocab

US = r"(?i)(?<![a-z])(?:u\.?s\.?a?|us|united states(?: of america)?)(?![a-z])"


def _names(words: object, guard: str = "(?<!new )") -> str:
    return rf"(?<![a-z]){guard}(?:" + "|".join(text.java_quote(w) for w in sorted(words, key=len, reverse=True)) + ")(?![a-z])"


COUNTRY = _names(vocab.COUNTRIES)
STATE = _names(vocab.STATES, "")
REGION = _names(vocab.REGIONS)


def countries_in(low: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"({COUNTRY})"), F.lit(1)))


def placeless(head: Column) -> Column:
    h = F.trim(F.regexp_replace(F.lower(head), r"\s+", " "))
    rest = F.regexp_replace(h, "^(?:" + "|".join(vocab.INTENSIFIERS) + ") (?=.)", "")
    return rest.isin(*vocab.PLACELESS)


SPLIT = "(?s)^(.*),([^,]*)$"


def split_place(raw: Column) -> Column:
    """(city, state, country). ``City, ST``, ``City, Country``, ``City, ST, CC`` or a country alone; else nulls."""
    none = F.lit(None).cast("string")

    def triple(city: Column, state: Column, country: Column) -> Column:
        return F.struct(city.cast("string").alias("city"), state.cast("string").alias("state"), country.cast("string").alias("country"))

    def choose(x: Column) -> Column:
        s, head, tail, inner, outer, up = (x[c] for c in ("s", "head", "tail", "inner", "outer", "up"))
        three = ~s.contains(";") & ~s.contains("|") & head.contains(",") & up.isin(*sorted(set(vocab.COUNTRIES.values()))) & (inner != "")
        named = F.when(F.length(tail) > 2, vocab.country_code(tail))
        alone = F.when(~F.lower(s).isin(*vocab.STATES), vocab.lookup(vocab.COUNTRIES, F.lower(s)))
        return (
            F.when(~s.contains(","), triple(none, none, alone))
            .when((head == "") | (tail == ""), triple(none, none, none))
            .when(three, triple(inner, F.when((up == "US") & outer.isin(*vocab.STATE_CODES), outer), up))
            .when(up.isin(*vocab.STATE_CODES), triple(head, up, F.lit("US")))
            .when(named.isNotNull(), triple(head, none, named))
            .otherwise(triple(none, none, none))
        )

    def real(x: Column) -> Column:
        city = x["city"]
        return triple(F.when(~placeless(city) & (F.size(countries_in(F.lower(city))) < 2), city), x["state"], x["country"])

    def parts(x: Column) -> Column:
        s, head, tail = x["s"], x["head"], x["tail"]
        return F.struct(
            s.alias("s"), head.alias("head"), tail.alias("tail"), F.trim(F.regexp_extract(head, SPLIT, 1)).alias("inner"),
            F.upper(F.trim(F.regexp_extract(head, SPLIT, 2))).alias("outer"), F.upper(tail).alias("up")
        )

    s = F.trim(text.empty_if_null(raw))
    first = text.bound(
        s,
        lambda x: F.struct(x.alias("s"), F.trim(F.regexp_extract(x, SPLIT, 1)).alias("head"), F.trim(F.regexp_extract(x, SPLIT, 2)).alias("tail"))
    )
    return text.bound(text.bound(text.bound(first, parts), choose), real)


def remote_scope(raw: Column) -> Column:
    """(areas, regions): null unstated, areas [] stated as anywhere, else sorted codes and tokens."""
    empty = F.array().cast("array<string>")
    null = F.lit(None).cast("array<string>")

    def read(x: Column) -> Column:
        s, low, bare = x["s"], x["low"], x["bare"]
        # a region inside a country's name isn't a region: blank the names first
        rest = F.regexp_replace(low, COUNTRY, "#")
        zone = F.when(s.rlike("(?i)(?<![a-z])(?:utc|gmt|est|pst|cst|cet)(?![a-z])"), F.array(F.lit("TIMEZONE"))).otherwise(empty)
        regions = F.array_sort(F.array_union(F.transform(F.regexp_extract_all(rest, F.lit(f"({REGION})"), F.lit(1)), F.upper), zone))
        named = F.array_union(
            F.transform(countries_in(low), lambda c: vocab.lookup(vocab.COUNTRIES, c)),
            F.when(s.rlike(US), F.array(F.lit("US"))).otherwise(empty)
        )
        anywhere = s.rlike("(?i)(?<![a-z])(?:anywhere|world[- ]?wide|globally|global|any location)(?![a-z])")
        return F.struct(
            regions.alias("regions"), named.alias("named"), low.rlike(STATE).alias("state_named"), (anywhere & (s != "")).alias("anywhere"),
            F.when(F.upper(bare).isin(*vocab.STATE_CODES), F.upper(bare)).alias("bare_state"), split_place(bare).alias("place")
        )

    def areas_of(x: Column) -> Column:
        state = F.coalesce(x["bare_state"], x["place"]["state"])
        states = F.when(state.isNotNull(), F.array(F.concat(F.lit("US-"), state))).otherwise(empty)
        areas = F.when(x["place"]["city"].isNull(), F.array_sort(F.array_union(x["named"], states))).otherwise(empty)
        return F.struct(
            areas.alias("areas"), x["regions"].alias("regions"), ((F.size(x["named"]) > 0) | x["state_named"]).alias("guarded"),
            x["anywhere"].alias("anywhere")
        )

    def settle(x: Column) -> Column:
        some = (F.size(x["areas"]) > 0) | (F.size(x["regions"]) > 0)
        areas = F.when(some, F.when(F.size(x["areas"]) > 0, x["areas"])).when(~x["guarded"] & x["anywhere"], empty).otherwise(null)
        return F.struct(areas.alias("areas"), F.when(some & (F.size(x["regions"]) > 0), x["regions"]).otherwise(null).alias("regions"))

    s = F.trim(text.empty_if_null(raw))
    texts = F.struct(s.alias("s"), F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " ")).alias("low"), text.strip_arrangement(s).alias("bare"))
    return text.bound(text.bound(text.bound(texts, read), areas_of), settle)


ANYWHERE = "(?:anywhere|world[- ]?wide|globally|global|any location)"
REGION_TOKENS = sorted({r.upper() for r in vocab.REGIONS} | {"TIMEZONE"})
SUBDIVISION = "^[A-Z]{2}-[A-Z0-9]{1,3}$"
#: What names no place: a search for it is a search for an arrangement.
NO_PLACES = ("", "remote", "anywhere", "any")


def is_placeless_query(location: Column) -> Column:
    return F.lower(F.trim(text.empty_if_null(location))).isin(*NO_PLACES)


def legal_scope(token: Column) -> Column:
    """Whether a policy's token is an area, a region, or one of the two words that stand for none."""
    up = F.upper(token)
    return up.rlike("^[A-Z]{2}(-[A-Z0-9]{1,3})?$") | up.isin(*REGION_TOKENS, "UNSTATED", "ANY")


def stated_scope(raw: Column) -> Column:
    """(areas, regions, raw) of a vendor's own list of places where one may live: a JSON list, or text.

    Null says nothing, and so does blank text or a list of blanks; an empty list, or names that all mean anywhere,
    is the whole world (areas []). Text is looked up whole before its commas cut it. Names that map to nothing
    leave areas null: unknown is never unbounded. raw is the text as sent, or the list joined."""
    codes = sorted(set(vocab.iso_names().values()))
    none, nothing = F.lit(None).cast("array<string>"), F.lit(None).cast("string")

    def result(areas: Column, regions: Column, said: Column) -> Column:
        return F.struct(areas.cast("array<string>").alias("areas"), regions.cast("array<string>").alias("regions"), said.cast("string").alias("raw"))

    def code(n: Column) -> Column:
        up = F.upper(n)
        return F.coalesce(
            vocab.iso_code(n), F.when(up.rlike(SUBDIVISION) & F.left(up, F.lit(2)).isin(*codes), up),
            F.when(up.isin(*codes) & ~up.isin(*vocab.AMBIGUOUS), up)
        )

    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))
    clean = lambda a: F.filter(F.transform(a, lambda n: F.trim(F.regexp_replace(n, r"(?U)\s+", " "))), lambda n: F.coalesce(n, F.lit("")) != "")
    parts = F.when(listed.isNotNull(), listed).when(vocab.iso_code(raw).isNotNull(), F.array(raw)).otherwise(F.split(raw, ","))
    first = F.struct(raw.alias("raw"), listed.isNotNull().alias("is_list"), F.size(parts).alias("sent"), clean(parts).alias("names"))

    def read(x: Column) -> Column:
        each = F.transform(x["names"], lambda n: F.struct(code(n).alias("code"), F.upper(n).alias("up")))
        return F.struct(
            x["raw"].alias("raw"), x["is_list"].alias("is_list"), x["sent"].alias("sent"), F.size(x["names"]).alias("named"), F.array_join(x["names"], ", ").alias("joined"),
            F.forall(x["names"], lambda n: F.lower(n).rlike(f"^{ANYWHERE}$")).alias("anywhere"),
            F.array_sort(F.array_distinct(F.transform(F.filter(each, lambda e: e["code"].isNotNull()), lambda e: e["code"]))).alias("areas"),
            F.array_sort(
                F.array_distinct(F.transform(F.filter(each, lambda e: e["code"].isNull() & e["up"].isin(*REGION_TOKENS)), lambda e: e["up"]))
            ).alias("regions"),
        )

    def settle(x: Column) -> Column:
        empty = F.array().cast("array<string>")
        said = F.when(x["is_list"], F.nullif(x["joined"], F.lit(""))).otherwise(x["raw"])
        return (
            F.when(x["raw"].isNull() | (~x["is_list"] & (F.trim(x["raw"]) == "")), result(none, none, nothing))
            .when(x["sent"] == 0, result(empty, none, nothing))
            .when(x["named"] == 0, result(none, none, F.when(~x["is_list"], x["raw"])))
            .when(x["anywhere"], result(empty, none, said))
            .otherwise(result(F.when(F.size(x["areas"]) > 0, x["areas"]), F.when(F.size(x["regions"]) > 0, x["regions"]), said))
        )

    return text.bound(text.bound(first, read), settle)


def excluded(title: Column, location: Column, tokens: tuple[str, ...] = vocab.EXCLUDED_PLACES) -> Column:
    """Whether title or location names an excluded place and the location doesn't name the US."""
    if not tokens:
        return F.lit(False)
    blob = F.lower(F.concat_ws(" ", text.empty_if_null(title), text.empty_if_null(location)))
    return blob.rlike(_names(tokens, "")) & ~text.empty_if_null(location).rlike(US)


def scope_allowed(areas: Column, regions: Column, allowed: list[str] | None) -> Column:
    """Whether a stated boundary meets the policy; unstated only where UNSTATED is allowed."""
    if not allowed:
        return F.lit(True)
    up = sorted({a.upper() for a in allowed})
    inclusive = bool(set(up) & set(vocab.US_INCLUSIVE))
    of_us = "US" in up
    area_ok = F.exists(areas, lambda a: F.upper(a).isin(*up) | (F.lit(of_us) & F.upper(a).startswith("US-")))
    region_ok = F.exists(regions, lambda r: F.upper(r).isin(*up) | (F.lit(inclusive) & F.upper(r).isin(*vocab.US_INCLUSIVE)))
    return F.when(areas.isNull() & regions.isNull(), F.lit("UNSTATED" in up)).otherwise(
        (F.coalesce(F.size(areas) == 0, F.lit(False))) | F.coalesce(area_ok, F.lit(False)) | F.coalesce(region_ok, F.lit(False))
    )
