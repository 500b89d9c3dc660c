"""Outcomes: the cases that decide the order of the rules, numbered blocks and the consent calendar."""

import re

import pytest
from pyspark.sql import functions as F

from plenum.functions import outcomes
from plenum.operators import consent
from plenum.plans import civic_outcomes

DATA = "/root/testdata/sf0.001"


def each(spark, f, *values):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    width = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"v{k} string" for k in range(width)))
    return [r.out for r in df.select("i", f(*[F.col(f"v{k}") for k in range(width)]).alias("out")).orderBy("i").collect()]


def test_kinds(spark):
    cases = {
        "ADOPTED; Result: Pass": "approved", "Pass": "approved", "Motion denied by a 3-2 vote": "rejected", "Continued to August 4": "continued", "Approved as amended": "amended",
        "The motion did not pass.": "rejected", "Motion to approve was not adopted.": "rejected", "The item has not been adopted by the Council.": "rejected",
        "The ordinance will not be approved this cycle.": "rejected", "The motion didn't pass.": "rejected", "No action taken.": "other",
        "Meeting adjourned for lack of a quorum; no action taken.": "other", "The motion was not approved; the item was continued to June 10.": "continued",
        "The amendment was denied.": "rejected", "Motion to approve as amended failed 2-3.": "rejected", "Approved the contract, as amended, 5-0.": "amended",
    }
    assert each(spark, outcomes.kind, *cases) == list(cases.values())


def test_headlines(spark):
    cases = {
        ("approved", "Pass"): "Passed", ("approved", "Approved unanimously"): "Approved unanimously", ("other", "The City Council directed staff to revise the plan."): "Direction provided",
        ("other", "No action."): "No action taken", ("continued", "Continued to August 4, 2026"): "Continued to August 4", ("rejected", "defeated"): "Motion failed", ("amended", "As amended"): "Amended",
    }
    assert each(spark, outcomes.headline, *cases) == list(cases.values())


def test_votes(spark):
    cases = {
        "Motion passed on a 5-0 vote": "5–0", "The motion carried unanimously": "Unanimous", "Passed 4-0-1": "4–0–1", "Heard": None,
        "motion carried by the following vote: Ayes: 3 - Chan, Dorsey, Chen Excused: 3 - Sauter, Walton, Mandelman Chair Chan, seconded by Vice Chair Dorsey moved to RESCIND the previous vote": "Ayes: 3 - Chan, Dorsey, Chen; Noes: None",
        "Ayes: Speier, Corzo, Mueller, Gauthier, and Canepa5 - No: 0 Enactment No: Resolution-081627 CLOSED SESSION 53": "Ayes: Speier, Corzo, Mueller, Gauthier, and Canepa5; Noes: 0",
        "Ayes: Astrawinata, Ayala, Taylor ABSENT: Brammer, Kitchiner": "Ayes: Astrawinata, Ayala, Taylor; Noes: None",
        "AYES: Arenas, Duong, Lee, Ellenberg, Abe-Koga. NOES: Simitian.": "Ayes: Arenas, Duong, Lee, Ellenberg, Abe-Koga; Noes: Simitian",
    }
    assert each(spark, outcomes.vote_detail, *cases) == list(cases.values())


def test_interpretation_order(spark):
    def told(action, result, title, slug):
        out = outcomes.interpret(action, result, title, (slug == "santa-barbara-county") & title.rlike("(?i)planning commission"), slug == "san-francisco")
        return F.concat_ws("|", out["kind"], out["status"], out["headline"], out["next_step"])

    board, council = "Board of Supervisors Regular Meeting", "City Council"
    onward = "The item advances to the full Board of Supervisors for further action."
    cases = {
        ("Withdrawn from the agenda", "Pass", board, "x"): "other|withdrawn|Withdrawn from the agenda|The item was withdrawn, so the body did not act on it.",
        ("Approve the withdrawal of $2,000,000 from the Capital Reserve Fund", "Pass", board, "x"): "approved|approved|Passed",
        ("Authorize withdrawal from the regional joint powers authority", "Pass", board, "x"): "approved|approved|Passed",
        ("Chair Chan, seconded by Vice Chair Dorsey moved to RESCIND the previous vote", "Pass", board, "san-francisco"): "other|rescinded|Previous vote rescinded|The earlier vote was undone, so the item may return for another vote.",
        ("Adopt an ordinance rescinding Resolution No. 41-22 concerning parking fees", "Pass", board, "x"): "approved|approved|Passed",
        ("Councilmember Lee moved to reconsider the vote on Item 12", "Pass", board, "x"): "other|reconsidered|Previous vote reconsidered|The body reopened its earlier vote on this item.",
        ("Adopt", "Passed", "County Planning Commission", "santa-barbara-county"): "other|recommended|Recommended approval|This is an advisory recommendation, not a final county decision.",
        ("Hear", "No action taken", "County Planning Commission", "santa-barbara-county"): "other|recorded|No recommendation made|This is an advisory action, not a final county decision.",
        ("RECOMMENDED", "Pass", "Budget Committee", "san-francisco"): f"other|recommended|Recommended for approval|{onward}",
        ("HEARD AND FILED", "Pass", "Budget Committee", "san-francisco"): "other|heard_and_filed|Heard and filed",
        ("AMENDED", "Fail", council, "x"): "rejected|rejected|Motion failed",
        ("AMENDED", "Pass", "Budget Committee", "x"): "amended|amended|Amended in committee|This was a committee action, not final approval by the next legislative body.",
        ("Approve", "Passed", "Budget Committee", "x"): "other|committee_action|Committee motion passed|This was a committee action, not final approval by the next legislative body.",
        (None, "The motion did not pass.", council, "x"): "rejected|rejected|Rejected",
        (None, "Continued to August 4, 2026.", council, "x"): "continued|continued|Continued to August 4|This item returns August 4, 2026.",
        (None, None, council, "x"): "other|recorded|Outcome recorded",
    }
    assert each(spark, told, *cases) == list(cases.values())


def test_result_texts(spark):
    cases = {
        "ACTION: Councilmember Lee moved to approve the contract. Motion passed 5-0.": "Councilmember Lee moved to approve the contract. Motion passed 5-0.",
        "Recommended action: Approve the contract and authorize the city manager.": None, "Assistant City Clerk. These minutes were approved at the June 9 meeting.": None, "No action.": "No action", "": None,
        "The City Council directed staff to revise the capital plan.": "City Council directed staff to revise the capital plan.",
        "ACTION\n: Motion and second (Taylor/ Combs), to approve the consent calendar, passed 4-0-1 (Wise \nabsent).\n\nG. Study Session": "Motion and second (Taylor/ Combs), to approve the consent calendar, passed 4-0-1 (Wise absent).",
        "ACTION: Commissioners voted to approve the item; passed 5-0 with Commissioners Ferrick and\nDoe absent.\n\nH. Informational Items": "Commissioners voted to approve the item; passed 5-0 with Commissioners Ferrick and Doe absent.",
    }
    assert each(spark, outcomes.result_text, *cases, None) == [*cases.values(), None]
    long = "The council " + "considered many words of it and then " * 9 + "adopted " + "all that was said " * 40
    told = each(spark, outcomes.result_text, long)[0]
    assert len(told) <= 700 and long.startswith(told.removesuffix("...").strip() if told.startswith("The") else "The")


TEXT = """A. CALL TO ORDER
1. First item of the evening
more of it
1. again the first
2) Second thing
B. PUBLIC HEARINGS
2. after the section
no number here
Item 3.1 Third thing: 5
"""


def test_numbered_blocks(spark):
    blocks = [tuple(b) for b in each(spark, outcomes.numbered_blocks, TEXT)[0]]
    assert [(n, b) for n, _, b in blocks] == [("1", "1. First item of the evening\nmore of it\n1. again the first"), ("2", "2) Second thing"), ("2", "2. after the section\nno number here"), ("3.1", "Item 3.1 Third thing: 5")]
    assert each(spark, outcomes.numbered_blocks, "", None, "no numbers") == [[], [], []]
    many = "\n".join(f"{i % 90 + 1}. line {i}" for i in range(20_000))
    assert len(each(spark, outcomes.numbered_blocks, many)[0]) == 20_000


MINUTES = """A. Call to Order
Consent Calendar
4.1 Approve library roof repair contract
4.2 Approve street tree planting plan for Elm Avenue
4.3 Accept quarterly investment report of the treasurer
Item 4.2 was pulled by Councilmember Lee.
ACTION: Motion to approve the consent calendar passed 5-0.
C. Public Hearings
5. Rezoning hearing of Oak Street"""


def test_consent_results(spark):
    minutes = spark.createDataFrame([(1, MINUTES), (2, "no consent here"), (3, None)], "meeting int, text string")
    items = spark.createDataFrame(
        [
            (1, 1, "4", "Consent Calendar", None), (2, 1, "4.1", "Library roof repair contract", None), (3, 1, "4.2", "Street tree planting plan for Elm Avenue", None),
            (4, 1, "4.3", "Quarterly investment report of the treasurer", None), (5, 1, "5", "Rezoning hearing of Oak Street", None), (6, 1, "9", "Library roof repair contract", "Consent Calendar item"),
            (7, 1, None, "Library roof repair contract", "Consent Calendar"), (8, 1, "4.9", "Entirely different matter about ferries", None), (9, 2, "4.1", "Library roof repair contract", "Consent Calendar"),
        ],
        "item int, meeting int, number string, title string, item_type string",
    )
    out = {r.item: r.result for r in consent.consent_results(minutes, items, "meeting", "item").collect()}
    assert set(out) == {2, 4, 6}
    assert set(out.values()) == {"Motion to approve the consent calendar passed 5-0."}


@pytest.mark.parametrize("said_so, expected", [("Item 4.2 was pulled", True), ("pulled: item 4.2", True), ("Item 4.21 was pulled", False), ("Item 4.2. All were pulled", False), (None, False)])
def test_separated(spark, said_so, expected):
    assert each(spark, lambda s: outcomes.was_separated(F.lit("4.2"), outcomes.separations(s)), said_so) == [expected]


def _compact(text):
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"\s+", " ", re.sub(r"(?i)^(?:action|result|decision|motion)\s*[:\-]\s*", "", text)).strip()
    if len(text) <= 700:
        return text
    cut = text[:697]
    return (cut[: cut.rfind(" ")] if cut.rfind(" ") > 500 else cut) + "..."


def test_result_texts_of_whole_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", civic_outcomes.minutes_of()).collect()
    want = {}
    for doc_id, text in docs:
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text).replace("\xa0", " ")))).strip()
        found = None
        if re.search(rf"(?i)\b(?:{outcomes.OUTCOME})\b", text):
            for pattern, group in ((outcomes.RESULT_MARKER, 0), (outcomes.NO_ACTION_LINE, 1), (outcomes.DIRECTION, 0), (outcomes.CLEAR_RESULT, 0), (outcomes.ITEM_RESULT, 1)):
                hit = re.search(f"(?i){pattern}", text)
                if hit and hit[group]:
                    found = _compact(hit[group])
                    break
        want[doc_id] = None if found and re.search(f"(?i){outcomes.MINUTES_APPROVED}", found) else found
    found = {r.doc_id: r.result for r in civic_outcomes.result_texts(spark, DATA).collect()}
    assert {k: found[k] for k in want if found[k] != want[k]} == {}
    assert sum(v is not None for v in want.values()) > 50


def test_large_sections_meet_their_items_by_word(spark, monkeypatch):
    text = "A. Call to Order\nConsent Calendar\n4.1 Lease of the harbor office\n4.2 Paint of bridge rails\nACTION: Motion to approve the consent calendar passed 5-0.\n\nC. Public Hearings"
    minutes = spark.createDataFrame([("m", text)], "meeting string, text string")
    rows = [("m", "a", "4.1", "Lease of the harbor office", "Consent Calendar"), ("m", "b", "4.2", "Purchase of fire engines abroad", "Consent Calendar")]
    items = spark.createDataFrame(rows, "meeting string, item string, number string, title string, item_type string")
    found = []
    for most in (0, 2_000):
        monkeypatch.setattr(consent, "WHOLE_SECTION", most)
        found.append([tuple(r) for r in consent.consent_results(minutes, items, "meeting", "item").collect()])
    assert found[0] == found[1] and [r[0] for r in found[0]] == ["a"]
