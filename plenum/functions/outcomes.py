"""What the official record says was decided: kinds, headlines, votes, next steps, result sentences, numbered blocks and consent sections.

An ordered decision list over the words of an action and a result: terms under a negation are masked first, then the first rule that
fits decides.  All of it is expressions; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Terms of outcomes, what negates them, and the patterns of results in minutes.
OUTCOME = (
    r"approved|adopted|pass(?:ed)?|carried|accepted|authorized|confirmed|denied|rejected|fail(?:ed)?|defeated|continued|postponed|tabled|deferred|referred|amended|determined|reported|directed|"
    r"provided direction|gave direction|received and filed|introduced and waived(?: the)? reading|no action(?: taken)?"
)
APPROVAL = r"approved|adopted|pass(?:ed)?|carried|accepted|authorized|confirmed"
FAILURE = r"\b(?:denied|rejected|fail(?:ed)?|defeated)\b"
NEGATED = r"(?:\bnot\b|\bnever\b|\bnor\b|n['’]t\b)(?:\s+(?:be|been|being|yet))?\s+"
WITHDRAWN_ITEM = r"^(?:item\s+)?withdrawn\b|\bwithdraw(?:n|al)\b[^.]{0,40}?\b(?:from\s+(?:the\s+)?(?:agenda|calendar|consideration)|by\s+(?:staff|the\s+applicant|the\s+petitioner|the\s+sponsor))\b"
RESCINDED_VOTE = r"\brescind(?:ed|ing|s)?\b[^.]{0,40}?\b(?:previous|prior|earlier)\b|\b(?:previous|prior|earlier)\s+(?:vote|motion|action)\b[^.]{0,40}?\brescind"
RECONSIDERED_VOTE = r"\b(?:motion|moved|move)\b[^.]{0,40}?\breconsider"
RESULT_MARKER = rf"\b(?:action|result|decision|motion)\s*[:\-]\s*(?:(?!\n\n)[\s\S]){{0,700}}?(?:{OUTCOME})(?:(?!\n\n)[\s\S]){{0,350}}"
NO_ACTION_LINE = r"(?:^|\n)\s*(no action(?: taken)?)[.!]?\s*(?=\n|$)"
DIRECTION = r"\b(?:city\s+)?(?:council|board|commission|committee|authority|supervisors?)\s+(?:directed|provided direction|gave direction)\b[\s\S]{0,680}"
CLEAR_RESULT = rf"\b(?:motion|council|board|commission|committee|authority|supervisors?)\b[^.]{{0,360}}\b(?:{OUTCOME})\b[^.]{{0,600}}"
ITEM_RESULT = rf"(?:^|[.!?]\s+)([^.!?]{{0,220}}\b(?:item|motion|ordinance|resolution|application|contract|proposal|consent calendar)\b[^.!?]{{0,260}}\b(?:{OUTCOME})\b[^.!?]{{0,260}}[.!?]?)"
MINUTES_APPROVED = r"\b(?:these|the)\s+(?:meeting\s+)?minutes\s+(?:were|are|have been)\s+approved\b"
ROLL_CALL_END = (
    r"[.;]|\b(?:no(?:es)?|nay(?:s)?|absent|excused|abstain(?:ed|ing|tions?)?|recused|vacant|motion|moved|move|seconded?|enactment|resolution|ordinance|proclamation|session|closed|item|file|attachment)\b"
)
ITEM_LINE = r"^\s*(?:agenda\s+)?(?:item\s+)?([A-Z]?\d{1,2}(?:\.\d{1,3})?)\s*(?:[.)]|:\s+(?!\d)|-\s+(?!\d)|\s+)\s*\S"
SECTION_LINE = r"^\s*[A-Z]\s*[.)-]\s+[A-Z][\s\S]{1,120}$"
SECTION_START = r"^[A-Z]\s*[.):-]\s*[A-Z][\s\S]{1,100}$"
SECTION_CAPITALS = r"^[A-Z][A-Z0-9/&,'’() -]{3,100}[.:]?$"
SEPARATED = r"\b(?:pulled|removed|separate(?:ly)?|continued)\b"
LONGEST = 700
# What a listing says comes next, by what was done.
WITHDRAWN_STEP = "The item was withdrawn, so the body did not act on it."
RESCINDED_STEP = "The earlier vote was undone, so the item may return for another vote."
RECONSIDERED_STEP = "The body reopened its earlier vote on this item."
ADVICE_STEP = "This is an advisory recommendation, not a final county decision."
ADVISORY_STEP = "This is an advisory action, not a final county decision."
BOARD_STEP = "This was a committee action, not final approval by the Board of Supervisors."
COMMITTEE_STEP = "This was a committee action, not final approval by the next legislative body."
FAILED_STEP = "The recommendation did not advance."
TO_BOARD_STEP = "The item advances to the full Board of Supervisors for further action."
ONWARD_STEP = "The item advances to the next legislative body for further action."


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def clean(text: Column) -> Column:
    """White space as single spaces, trimmed; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " "))


def normal_lines(text: Column) -> Column:
    """A text with plain line breaks and spaces, at most one empty line in a row, trimmed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    for pattern, by in ((r" ", " "), (r"[ \t]{2,}|\t", " "), (r" +\n *|\n +", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """A record's text on one line without page marks and its opening label, cut at a word before ``LONGEST`` characters."""
    bare = F.regexp_replace(clean(text), r"(?i)===\s*PAGE\s+\d+\s*===", " ")

    def cut(bare: Column) -> Column:
        short = F.left(bare, F.lit(LONGEST - 3))
        word = F.regexp_extract(short, r"^(.{501,}) [^ ]*$", 1)
        return F.when(F.length(bare) <= LONGEST, bare).otherwise(F.concat(F.when(word != "", word).otherwise(short), F.lit("...")))

    return _bind(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)^(?:action|result|decision|motion)\s*[:\-]\s*", ""), r"\s+", " ")), cut)


def kind(text: Column) -> Column:
    """approved, rejected, continued, amended or other: negated terms don't count, but a negated approval is a rejection."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    negated = _has(lower, NEGATED + rf"(?:{APPROVAL})\b")
    left = F.regexp_replace(lower, NEGATED + rf"(?:{OUTCOME})\b", " ")
    failed = _has(left, FAILURE)
    return (
        F.when(_has(left, r"\bamend(?:ed|ment|ments)?\b") & ~failed, "amended")
        .when(_has(left, r"\b(?:continued|postponed|tabled|deferred|referred)\b"), "continued")
        .when(failed | negated, "rejected")
        .when(_has(left, rf"\b(?:{APPROVAL})\b"), "approved")
        .otherwise("other")
    )


def headline(of: Column, text: Column) -> Column:
    """What a listing says of an outcome of that kind."""
    has = lambda pattern: _has(text, pattern)
    with_all = F.when(has(r"\bunanim(?:ous|ously|ity)\b"), " unanimously").otherwise("")
    date = F.regexp_extract(text, r"(?i)\bcontinued\s+to\s+([A-Z][a-z]+\s+\d{1,2})(?:,\s*\d{4})?", 1)
    continued = F.when(has(r"\bpostponed\b"), "Postponed").when(has(r"\breferred\b"), "Referred").when(date != "", F.concat(F.lit("Continued to "), date)).otherwise("Continued")
    rejected = F.when(has(r"\bdenied\b"), "Denied").when(has(r"\bfail(?:ed)?\b|\bdefeated\b"), "Motion failed").otherwise("Rejected")
    approved = F.when(has(r"\badopted\b"), F.concat(F.lit("Adopted"), with_all)).when(has(r"\bapproved\b|\bauthorized\b|\bconfirmed\b"), F.concat(F.lit("Approved"), with_all)).otherwise(F.concat(F.lit("Passed"), with_all))
    other = (
        F.when(has(r"\bno action(?: taken)?\b"), "No action taken").when(has(r"\b(?:directed|provided direction|gave direction)\b"), "Direction provided")
        .when(has(r"\breceived and filed\b"), "Received and filed").when(has(r"\bintroduced and waived(?: the)? reading\b"), "Introduced").otherwise("Outcome recorded")
    )
    amended = F.when(has(r"\b(?:approved|adopted|pass(?:ed)?|carried)\b"), F.concat(F.lit("Approved with amendments"), with_all)).otherwise("Amended")
    return F.when(of == "amended", amended).when(of == "continued", continued).when(of == "rejected", rejected).when(of == "approved", approved).otherwise(other)


def next_step(text: Column, of: Column) -> Column:
    """When a continued item returns; null for others."""
    to = F.regexp_extract(compact(text), r"(?i)\bcontinued\s+to\s+(.{1,120})$", 1)
    return F.when((of == "continued") & (to != ""), F.concat(F.lit("This item returns "), F.regexp_replace(clean(to), r"[.;,]+$", ""), F.lit(".")))


def _roll_call(text: Column, label: str) -> Column:
    rest = F.regexp_extract(text, rf"(?is)^.*?\b(?:{label})\s*:\s*(.*)$", 1)
    names = clean(F.regexp_extract(rest, rf"(?is)^(.*?)(?:{ROLL_CALL_END}|$)", 1))
    bare = F.regexp_replace(names, r"[\s,;:\-–—]+$", "")
    return F.when(bare != "", F.left(bare, F.lit(160)))


def vote_detail(text: Column) -> Column:
    """The first tally of numbers, else the roll call, else whether it was unanimous; null for none."""
    tally = r"\b(\d{1,2})\s*[-–—]\s*(\d{1,2})(?:\s*[-–—]\s*(\d{1,2}))?\b"

    def of_whole(whole: Column) -> Column:
        numbers = F.array_join(F.filter(F.array(*[F.regexp_extract(whole, tally, i) for i in (1, 2, 3)]), lambda x: x != ""), "–")
        ayes, noes = _roll_call(whole, "ayes?|yes"), _roll_call(whole, "noes?|nays?|no")
        called = F.left(F.concat(F.lit("Ayes: "), ayes, F.lit("; Noes: "), F.coalesce(noes, F.lit("None"))), F.lit(260))
        return F.when(numbers != "", numbers).when(ayes.isNotNull(), called).when(_has(whole, r"\bunanim(?:ous|ously|ity)\b"), "Unanimous")

    return _bind(compact(text), of_whole)


def interpret(action: Column, result: Column, title: Column, is_advisory: Column, full_board: Column) -> Column:
    """(kind, status, headline, next_step) of an official action with its recorded result.

    What took the item off, or undid a vote, comes before the flag that the motion passed; then what an advisory body or a
    recommendation can decide; then failures of changes; then what a committee passed; then the words themselves.
    """
    def of_texts(t: Column) -> Column:
        source = F.array_join(F.filter(F.array(t["act"], t["res"]), lambda x: x != ""), " | ")
        return _bind(source, lambda whole: _bind(F.struct(t["act"].alias("act"), t["res"].alias("res"), whole.alias("source"), kind(whole).alias("kind")), decide))

    def decide(t: Column) -> Column:
        return _decided(t["act"], t["res"], t["source"], t["kind"], title, is_advisory, full_board)

    return _bind(F.struct(compact(action).alias("act"), compact(result).alias("res")), of_texts)


def _decided(act: Column, res: Column, source: Column, of: Column, title: Column, is_advisory: Column, full_board: Column) -> Column:
    failed = _has(source, FAILURE)
    told = lambda k, status, head, step: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), (F.lit(head) if isinstance(head, str) else head).alias("headline"), (F.lit(step).cast("string") if step is None or isinstance(step, str) else step).alias("next_step"))
    not_final = F.when(full_board, BOARD_STEP).otherwise(COMMITTEE_STEP)
    onward = F.when(failed, FAILED_STEP).when(full_board, TO_BOARD_STEP).otherwise(ONWARD_STEP)
    none = _has(source, r"\bno action(?: taken)?\b")
    passed_in_committee = _has(title, r"\bcommittee\b") & _has(source, r"\bpass(?:ed)?\b")
    plain = F.when(of != "other", of).when(none, "no_action").when(_has(source, r"\b(?:directed|provided direction|gave direction)\b"), "direction").otherwise("recorded")
    return (
        F.when(_has(source, WITHDRAWN_ITEM), told("other", "withdrawn", "Withdrawn from the agenda", WITHDRAWN_STEP))
        .when(_has(source, RESCINDED_VOTE), told("other", "rescinded", "Previous vote rescinded", RESCINDED_STEP))
        .when(_has(source, RECONSIDERED_VOTE), told("other", "reconsidered", "Previous vote reconsidered", RECONSIDERED_STEP))
        .when(is_advisory & (of == "continued"), told("continued", "continued", headline(F.lit("continued"), source), next_step(source, F.lit("continued"))))
        .when(is_advisory & (of == "approved"), told("other", "recommended", "Recommended approval", ADVICE_STEP))
        .when(is_advisory & (of == "rejected"), told("other", "recommended", "Recommended denial", ADVICE_STEP))
        .when(is_advisory & (of == "amended"), told("other", "recommended", "Recommendation amended", ADVICE_STEP))
        .when(is_advisory, told("other", "recorded", F.when(none, "No recommendation made").otherwise("Advisory action recorded"), ADVISORY_STEP))
        .when(_has(act, r"\brecommend(?:ed|ation)?\b"), told("other", "recommended", F.when(failed, "Recommendation failed").otherwise("Recommended for approval"), onward))
        .when(_has(act, r"\bheard\s+and\s+filed\b"), told("other", "heard_and_filed", "Heard and filed", None))
        .when(_has(source, r"\b(?:amend(?:ed|ment|ments)?|continued|postponed|tabled|deferred|referred)\b") & _has(res, FAILURE), told("rejected", "rejected", headline(F.lit("rejected"), res), None))
        .when(passed_in_committee & (of == "amended"), told("amended", "amended", "Amended in committee", not_final))
        .when(passed_in_committee & (of == "approved"), told("other", "committee_action", "Committee motion passed", not_final))
        .otherwise(told(of, plain, headline(of, source), next_step(source, of)))
    )


def result_text(text: Column) -> Column:
    """The sentence of a record that tells a result, by the first of five patterns; null for none, and for minutes that were approved."""
    def of_whole(whole: Column) -> Column:
        found = []
        for pattern, group in ((RESULT_MARKER, 0), (NO_ACTION_LINE, 1), (DIRECTION, 0), (CLEAR_RESULT, 0), (ITEM_RESULT, 1)):
            found.append(F.nullif(F.regexp_extract(whole, f"(?i){pattern}", group), F.lit("")))
        told = _bind(compact(F.coalesce(*found)), lambda told: F.when((told != "") & ~_has(told, MINUTES_APPROVED), told))
        return F.when(_has(whole, rf"\b(?:{OUTCOME})\b"), told)

    return _bind(normal_lines(text), of_whole)


def item_number(line: Column) -> Column:
    """The agenda number that a line opens with, in lower case; null for none."""
    number = F.lower(F.regexp_extract(line, f"(?i){ITEM_LINE}", 1))
    return F.when(number != "", number)


def numbered_blocks(text: Column) -> Column:
    """Array of (number, nth, block): from the line that opens with a number until one with another number, or a section, opens.

    Lines with the same number go on with the block.  Row by row, without a shuffle, in time linear in the lines.
    """
    def of_lines(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("at"), item_number(line).alias("number"), line.rlike(SECTION_LINE).alias("section"))), lambda m: m["number"].isNotNull() | m["section"])
        def of_marks(marks: Column) -> Column:
            changed = lambda m, j: m["section"] | ~F.coalesce(m["number"].eqNullSafe(F.get(marks, j - 1)["number"]), F.lit(False)) | (j == 0)
            opening = F.filter(marks, changed)

            def cut(opening: Column) -> Column:
                until = lambda k: F.coalesce(F.get(opening, k + 1)["at"], F.size(lines))
                block = lambda m, k: F.struct(m["number"].alias("number"), k.alias("nth"), F.trim(F.array_join(F.slice(lines, m["at"] + 1, until(k) - m["at"]), "\n")).alias("block"))
                return F.filter(F.transform(opening, block), lambda b: b["number"].isNotNull())

            return _bind(opening, cut)

        return _bind(marks, of_marks)

    return _bind(F.split(normal_lines(text), "\n"), of_lines)


def section_block(text: Column, title: str) -> Column:
    """The lines of a text from one that is only the title, perhaps after a letter, until the next section; null without it."""
    heading = rf"(?i)^(?:[A-Z]\s*[.):-]\s*)?{title}\s*$"

    def of_lines(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(heading)), True)
        rest = F.slice(lines, F.greatest(F.lit(1), start + 1).cast("int"), F.size(lines))
        end = F.array_position(F.transform(rest, lambda x: F.trim(x).rlike(SECTION_START) | F.trim(x).rlike(SECTION_CAPITALS)), True)
        own = F.when(end > 0, F.slice(rest, 1, (end - 1).cast("int"))).otherwise(rest)
        return F.when(start > 0, F.array_join(F.concat(F.array(F.get(lines, (start - 1).cast("int"))), own), "\n"))

    return _bind(F.split(normal_lines(text), "\n"), of_lines)


def separations(section: Column) -> Column:
    """The lines of a consent section that say that something was pulled, removed, taken separately or continued."""
    return F.array_join(F.filter(F.split(section, "\n"), lambda line: _has(line, SEPARATED)), "\n")


def was_separated(number: Column, lines: Column) -> Column:
    """Whether the ``separations`` of a section name the item with that number."""
    quoted = F.regexp_replace(number, r"([^A-Za-z0-9])", r"\\$1")
    item = F.concat(F.lit(r"\b(?:item\s+)?"), quoted, F.lit(r"\b"))
    pattern = F.concat(F.lit("(?i)"), item, F.lit(r"[^.\n]{0,180}" + SEPARATED + "|" + SEPARATED + r"[^.\n]{0,180}"), item)
    return F.coalesce(F.regexp_like(lines, pattern), F.lit(False))
