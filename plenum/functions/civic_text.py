"""What a card's text says: its subject, its class, the interest it deserves, and what the official record did with it.

Words of subjects stand in plain lists, with ``*`` for any ending; a text has a word or phrase if it holds it between word bounds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import folded, money_score

# Subjects of daily life and their points; actions that bind; points of categories and statuses.
DAILY_LIFE = [
    (30, "housing, affordable housing, rent, renter, renters, tenant, tenants, eviction, homeless, homelessness, shelter, accessory dwelling, adu, adus"),
    (26, "tax, taxes, fee, fees, rate, rates, fine, fines, assessment, assessments, surcharge, utility bill"),
    (22, "budget, funding, appropriation, appropriations, spending, revenue, deficit, shortfall, fiscal, reserve, reserves"),
    (26, "traffic, parking, road, roads, street, streets, sidewalk, sidewalks, crosswalk, crosswalks, bike, bicycle, pedestrian, transit, bus, rail, train, speed limit, intersection"),
    (26, "police, fire, emergency, crime, ambulance, paramedic, disaster, evacuation, flood, flooding, wildfire, earthquake"),
    (24, "zoning, rezon*, general plan, land use, subdivision, construction, building height, density, development agreement"),
    (24, "water, sewer, storm drain, garbage, trash, recycling, utility, utilities, electricity, power, solar, energy, broadband, internet, wifi, wi-fi"),
    (20, "climate, emissions, air quality, groundwater, drought, sea level"),
    (24, "school, schools, student, students, classroom, classrooms, teacher, teachers, childcare, child care, preschool, playground, youth program"),
    (22, "health, clinic, hospital, mental health, food, nutrition, senior, seniors, disabilit*, accessib*"),
    (18, "park, parks, trail, trails, library, libraries, pool, community center, open space, tree, trees"),
]
DAILY_LIFE_MOST = 62
BINDING = [(16, "ordinance, public hearing, ballot measure, bond measure, moratorium"), (14, "capital improvement")]
CATEGORY_POINTS = {
    "Housing": 34, "Budget & Taxes": 32, "Transportation": 30, "Public Safety": 30, "Schools & Youth": 26, "Teaching & Learning": 28, "Students & Families": 26,
    "School Buildings & Grounds": 24, "School Funding": 32, "Teachers & Staff": 26, "Safety & Wellness": 30, "Enrollment & Boundaries": 28, "Board & Administration": 22,
    "City Services": 24, "Business & Development": 22, "Parks & Environment": 20,
}
CATEGORY_MOST = 44
STATUS_POINTS = {"Upcoming vote": 32, "Routine approval": -20, "Under discussion": 22, "Passed": 10, "Information only": -8}
COMMENT_POINTS = 4
# Patterns of cards that are no subject of a listing, by class; those of announcements are for the agenda item alone.
ANNOUNCEMENT = [
    r"^\s*(?:notice of\s+)?(?:an?\s+)?(?:special|regular|adjourned|closed|joint|annual)\s+(?:session|meeting)\b",
    r"^\s*meeting of the\b",
    r"^\s*(?:call|notice) of\s+(?:a\s+)?(?:special|closed)\b",
]
ROUTINE = [
    r"\b(consent calendar minutes|approve (?:the )?(?:consent calendar )?minutes|meeting minutes)\b",
    r"\b(call to order|roll call|pledge of allegiance|adjournment|approval of agenda)\b",
    r"\b(recognize|recognition|proclamation|commendation|certificate)\b",
    r"\bnational .+ month\b",
    r"\bpresentation only\b",
    r"\b(introduce and welcome|swearing[- ]in|oath of office|installation of officers)\b",
]
PROCEDURAL = [
    r"\b(ad hoc|nominating|appoint(?:ment)?s?|appoint commissioners?|committee appointments?|officer election|bylaws?|rules of procedure|work ?plans?)\b",
    r"\b(elect|select) (?:a )?(?:new )?(?:chair|vice chair|president|secretary)\b",
    r"\b(orientation|annual report|receive and file|informational (?:item|update|report)|status update|(?:monthly|quarterly|mid-?year) report)\b",
    r"\b(meeting end time|item rollover|terms? and limits?|term limits?|meeting schedule|calendar of meetings)\b",
    r"\bmeeting notice\b",
    r"\bnotice of (?:a |an )?(?:special|joint|regular|adjourned|closed)\b[^.]{0,24}\bmeeting\b",
    r"\bspecial joint (?:commission|committee|board)\b",
]
WITHDRAWN = [r"\bwithdrawn\b", r"\bremoved from (?:the )?agenda\b", r"\bno action taken\b"]
CANCELLED = [r"\bcancell?ed\b", r"\bcancellation\b", r"\bnotice of cancellation\b"]
CLASS_POINTS = {"announcement": -100, "routine": -140, "procedural": -80, "withdrawn": -90, "cancelled": -70}
THRESHOLD, MONEY_REASON = 58, 12
RECENCY_DAYS, RECENCY_MOST, STALE_DAYS, STALE_LEAST = 60, 24, 180, 0.5
#: First words of a structured result, and what they signal; and the card's status for each signal.
RESULTS = [
    ("continued", "continued, postponed, tabled, deferred, referred"), ("failed", "fail, failed, denied, rejected, defeated"),
    ("no_action", "no action"), ("approved", "pass, passed, adopted, approved, carried, accepted, authorized"),
]
SIGNAL_STATUS = {"withdrawn": "Cancelled", "continued": "Tabled", "approved": "Passed", "failed": "Information only", "no_action": "Information only"}
# How titles of agenda items are respelled before their words are compared, words that don't tell items apart, and
# words that only reword a title.
RESPELLED = [
    (r"\bcapital improvement program\s*\(\s*cip\s*\)", "cip"),
    (r"\bcapital improvement program\b", "cip"),
    (r"\bpublic works\s*(?:and|&)\s*transportation commission\b", "pwtc"),
    (r"\beast palo alto sanitary district\s*\(\s*epasd\s*\)", "epasd"),
    (r"\beast palo alto sanitary district\b", "epasd"),
    (r"\bsenate bill\b", "sb"),
    (r"\brates?\b", "rate"),
    (r"\bincreases?\b", "increase"),
    (r"\bdisruptions?\b", "disruption"),
    (r"\btemporar(?:y|ily)\b", " "),
    (r"\bwork[\s-]+plan\b", "workplan"),
    (r"&", " and "),
]
NOT_IDENTITY = (
    "a ad advisory an and adoption annual approving change compliance conduct consider for get hoc hearing maximum near of on public receive resolution review the to vote with "
    "adjustments during in informational presentation discussion"
).split()
REWORDING = "accept approve consistency law replace state update".split()


def words_pattern(words: str) -> str:
    """A pattern for any of the words and phrases of a list, between word bounds, in any case."""
    spelled = [w.strip().replace("*", r"\w+") for w in words.split(",")]
    return r"(?i)\b(?:" + "|".join(spelled) + r")\b"


def has_words(text: Column, words: str) -> Column:
    return F.coalesce(text.rlike(words_pattern(words)), F.lit(False))


def card_text(*parts: Column) -> Column:
    """The parts that are there, joined by one space, white space collapsed."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))


def _points(text: Column, lists: list[tuple[int, str]]) -> Column:
    return sum((F.when(has_words(text, words), n).otherwise(0) for n, words in lists), F.lit(0))


def daily_life_score(text: Column) -> Column:
    """The points of all subjects that the text names, so many at most."""
    return F.least(F.lit(DAILY_LIFE_MOST), _points(text, DAILY_LIFE))


def has_any(text: Column, patterns: list[str]) -> Column:
    """Whether a text holds any of the patterns, in any case."""
    return F.coalesce(text.rlike("(?i)" + "|".join(patterns)), F.lit(False))


def card_classes(text: Column, item: Column) -> dict[str, Column]:
    """The classes of cards that aren't for listings, each as a boolean."""
    patterns = {"routine": ROUTINE, "procedural": PROCEDURAL, "withdrawn": WITHDRAWN, "cancelled": CANCELLED}
    return {"announcement": has_any(F.trim(item), ANNOUNCEMENT), **{name: has_any(text, p) for name, p in patterns.items()}}


def interest_score(text: Column, item: Column, categories: Column, status: Column, has_comment: Column, is_fallback: Column) -> Column:
    """How much a card matters: capped points of its categories and subjects, money, binding actions and status, less those of its classes."""
    worth = lambda value, points: sum((F.when(value == name, n).otherwise(0) for name, n in points.items()), F.lit(0))
    by_category = F.least(F.lit(CATEGORY_MOST), F.aggregate(categories, F.lit(0), lambda acc, c: acc + worth(c, CATEGORY_POINTS)))
    classes = card_classes(text, item)
    lost = sum((F.when(is_so, CLASS_POINTS[name]).otherwise(0) for name, is_so in classes.items()), F.lit(0))
    extra = F.when(has_comment, COMMENT_POINTS).otherwise(0) + F.when(is_fallback, -60).otherwise(0)
    return by_category + worth(F.coalesce(status, F.lit("")), STATUS_POINTS) + daily_life_score(text) + money_score(text) + _points(text, BINDING) + extra + lost


def is_public_interest(score: Column, text: Column, item: Column, status: Column, is_fallback: Column) -> Column:
    """Whether a card may head a listing: of no such class, told in plain words, with a reason and enough points."""
    of_class = F.lit(False)
    for is_so in card_classes(text, item).values():
        of_class = of_class | is_so
    reason = (daily_life_score(text) > 0) | (money_score(text) >= MONEY_REASON) | F.coalesce(status == "Upcoming vote", F.lit(False))
    return ~of_class & ~is_fallback & reason & (score >= THRESHOLD)


def ranking_score(score: Column, at: Column, now: Column) -> Column:
    """The score, faded with age to a half at least, and a bonus for what is near in time."""
    age = (F.unix_micros(now) - F.unix_micros(at)) / 86_400e6
    fresh = F.when(at.isNull() | (age <= 0), 1.0).otherwise(F.greatest(F.lit(STALE_LEAST), 1 - age / STALE_DAYS))
    recent = F.when(at.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), RECENCY_MOST * (1 - F.abs(age) / RECENCY_DAYS)))
    return score * fresh + recent


def official_signal(action: Column, result: Column) -> Column:
    """What the structured fields say was done: withdrawn, else by the first words of the result, else a motion that passed; null for nothing."""
    act, res = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (action, result))
    gone = lambda c: F.regexp_replace(c, r"^item\s+", "").rlike(r"^withdrawn\b")
    first = {signal: "^" + words_pattern(words).removeprefix("(?i)\\b") for signal, words in RESULTS}
    bare = F.regexp_replace(res, r"^motion\s+", "")
    said = F.when(gone(act) | gone(res), "withdrawn")
    for signal, pattern in first.items():
        said = said.when((bare if signal in ("failed", "approved") else res).rlike(pattern), signal)
    return said.when(act.rlike(r"\bmotion passed\b"), "approved")


def official_status(signal: Column) -> Column:
    """The status of a card whose item has that signal; null leaves the card's own."""
    out = F
    for name, status in SIGNAL_STATUS.items():
        out = out.when(signal == name, status)
    return out


def _start(pattern: str) -> str:
    """The plain characters that each match of a pattern of ``RESPELLED`` starts with."""
    plain = re.match(r"[a-z &]+", pattern.removeprefix(r"\b"))[0]
    # the last one may be optional
    return plain[:-1] if pattern.removeprefix(r"\b")[len(plain):].startswith(("?", "*")) else plain


def item_tokens(title: Column) -> Column:
    """Distinct words that identify an agenda item, respelled and without marks."""

    def respelled(text: Column) -> Column:
        out = text
        for pattern, word in RESPELLED:
            out = F.regexp_replace(out, pattern, word)
        # most titles have none of these words, and a search for what a pattern starts with tells before the pattern is tried
        found = F.lit(False)
        for pattern, _ in RESPELLED:
            found = found | (F.contains(text, F.lit(_start(pattern))) & text.rlike(pattern))
        return F.when(found, out).otherwise(text)

    text = F.transform(F.array(folded(title)), respelled)[0]
    words = F.regexp_extract_all(text, F.lit(r"[a-z0-9.]+"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in NOT_IDENTITY]))


def agenda_number(number: Column) -> Column:
    """The number of an agenda item without white space around it and full stops at its end, in upper case; null for none."""
    bare = F.upper(F.regexp_replace(F.trim(number), r"[.\s]+$", ""))
    return F.when(bare != "", bare)


def item_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


def numbers_differ(left: Column, right: Column) -> Column:
    """Whether both token lists have tokens with digits and those aren't the same."""
    numbers = lambda t: F.filter(t, lambda x: x.rlike("[0-9]"))
    missing = lambda a, b: F.size(F.array_except(a, b))
    return (F.size(numbers(left)) > 0) & (F.size(numbers(right)) > 0) & (missing(numbers(left), numbers(right)) + missing(numbers(right), numbers(left)) > 0)


def same_item(left: Column, right: Column) -> Column:
    """Whether two token lists name one item: equal; or, without a conflict of numbers, nearly equal but for rewording, or one expands the other."""
    least, shared = F.least(F.size(left), F.size(right)), F.size(F.array_intersect(left, right))
    differing = F.concat(F.array_except(left, right), F.array_except(right, left))
    reworded = (least >= 5) & (shared >= 0.8 * least) & (F.size(F.array_except(differing, F.array(*[F.lit(w) for w in REWORDING]))) == 0)
    expands = (F.size(left) != F.size(right)) & (least >= 3) & (shared == least)
    there = (F.size(left) > 0) & (F.size(right) > 0)
    return there & ((item_key(left) == item_key(right)) | ~numbers_differ(left, right) & (reworded | expands))
