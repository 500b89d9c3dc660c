"""Pseudonyms: round trips, valid formats, stable links, and a plain-Python network."""

import hashlib
import hmac
import re
from datetime import date

import xxhash

from plenum.llm import pii

SCHEMA = "doc_id long, text string"
TEXTS = [
    (1, None), (2, ""), (3, "nothing private, version 4.0. and 1.2.3"), (4, "mail jo.doe+x7@mail3.example.com, twice: jo.doe+x7@mail3.example.com."),
    (5, "ip 10.0.0.1 and 255.255.255.255 but 256.1.1.1 and 1.2.3.4.5 no"), (6, "card 4111111111111111 or 4111 1111 1111 1111; not 4111111111111112"),
    (7, "call +1 (212) 555-0143 or (212) 555-0143 or 212-555-0143"), (8, "born 1984-02-29, 12/31/1999, 31/12/1999, 30/11/1990, 29/02/2000; not 2023-02-29 nor 1700-01-01"),
    (9, "ssn 123-45-6789, not 000-12-3456 nor 666-12-3456"), (10, "iban DE89370400440532013000 not DE88370400440532013000"),
    (11, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" x'), (12, "jo.doe+x7@mail3.example.com again"), (13, "word " * 50_000 + "10.0.0.1"), (4, "jo.doe+x7@mail3.example.com"),
    (14, "é.x@y.example and ÄÖ@z.example"), (None, "10.0.0.1"),
]


def texts(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_round_trip_and_counts(spark):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in TEXTS], SCHEMA + ", n_ip string, found int")
    out = pii.pseudonymize(df, "key")
    assert texts(pii.restore(out.select("doc_id", "text"), "key")) == texts(df)
    assert texts(pii.restore(out.select("doc_id", "text"), "other")) != texts(df)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[3].text == TEXTS[2][1]
    assert [rows[i][f"n_{k}"] for i, k in ((5, "ip"), (6, "card"), (7, "phone"), (8, "date"), (9, "ssn"), (10, "iban"), (11, "secret"), (14, "email"))] == [2, 2, 3, 5, 1, 1, 1, 2]
    assert rows[3].found == 5


def test_formats_stay_valid_and_values_linked(spark):
    rows = {}
    for r in pii.pseudonymize(spark.createDataFrame(TEXTS, SCHEMA), "key").collect():
        rows.setdefault(r.doc_id, []).append(r.text)
    mails = {m for i in (4, 12) for t in rows[i] for m in re.findall(r"\S+@mail3\.example\.com", t)}
    assert len(mails) == 1 and re.fullmatch(r"[a-z]{2}\.[a-z]{3}\+[a-z]\d@mail3\.example\.com", *mails) and "jo.doe+x7@mail3.example.com" not in mails
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", rows[6][0])
    assert luhn(cards[0]) and luhn(cards[1]) and cards[2] == "4111111111111112" and "4111111111111111" not in rows[6][0]
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", rows[5][0])
    assert all(int(o) < 256 for ip in ips[:2] for o in ip.split(".")) and "256.1.1.1" in rows[5][0] and "1.2.3.4.5" in rows[5][0]
    assert rows[13][0].endswith(ips[0]) and rows[None][0] == ips[0]
    days = re.findall(r"\d+[/-]\d+[/-]\d+", rows[8][0])
    date.fromisoformat(days[0])
    month, day, year = map(int, days[1].split("/"))
    date(year, month, day)
    for d in days[2:5]:
        day, month, year = map(int, d.split("/"))
        assert date(year, month, day) and day > 12
    assert days[5:] == ["2023-02-29", "1700-01-01"]
    iban = re.search(r"DE(\d\d)(\d{18})", rows[10][0])
    assert int(iban[2] + "1314" + iban[1]) % 97 == 1 and "DE88370400440532013000" in rows[10][0]
    area, group, serial = map(int, re.search(r"(\d{3})-(\d\d)-(\d{4})", rows[9][0]).groups())
    assert 0 < area < 900 and area != 666 and group and serial and "000-12-3456" in rows[9][0]


def plain_network(values, radices, kind, key):
    half, x = len(radices) // 2, list(values)
    for r in range(1, pii.ROUNDS + 1):
        odd = r % 2 == 1
        other = x[half:] if odd else x[:half]
        seed = hmac.new(key.encode(), "|".join([kind, str(r), ",".join(map(str, other))]).encode(), hashlib.sha256).hexdigest()
        for j in range(len(x)):
            if (j < half) == odd:
                h = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(seed.encode(), seed=42))
                h -= (1 << 64) * (h >> 63)
                x[j] = (x[j] + h % radices[j]) % radices[j]
    return x


def test_against_a_plain_network(spark):
    df = spark.createDataFrame([(i, f"{i}.{i * 3 % 256}.{i * 7 % 256}.9") for i in range(200)], SCHEMA)
    for r in pii.pseudonymize(df, "secret").collect():
        i = r.doc_id
        assert [int(o) for o in r.text.split(".")] == plain_network([i, i * 3 % 256, i * 7 % 256, 9], [256] * 4, "ip", "secret")


def test_empty_table(spark):
    assert pii.pseudonymize(spark.createDataFrame([], SCHEMA), "key").count() == 0


def test_cards_beside_digits_and_spaced_ibans(spark):
    rows = ["card 4111 1111 1111 1111 12/27", "order 12 4111 1111 1111 1111", "4111-1111-1111-1111 123 and 3782 822463 10005 99", "pay DE89 3704 0044 0532 0130 00 EUR or GB29 NWBK 6016 1331 9268 19"]
    df = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    out = pii.pseudonymize(df, "k" * 100)
    found = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.n_card for r in found] == [1, 1, 2, 0] and found[3].n_iban == 2
    assert found[0].text.endswith(" 12/27") and found[1].text.startswith("order 12 ") and " 123 and " in found[2].text and " EUR or GB" in found[3].text
    assert not any(x in r.text for r in found for x in ("1111 1111", "1111-1111", "822463", "3704 0044", "NWBK"))
    assert texts(pii.restore(out.select("doc_id", "text"), "k" * 100)) == texts(df)


def test_key_is_not_in_the_plan_and_names_are_free(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", "a", "b")], SCHEMA + ", pii__ string, pii_secret string")
    out = pii.pseudonymize(df, "a secret of its own")
    plan = out._jdf.queryExecution().toString()
    assert "a secret of its own" not in plan and "611612061" not in plan.lower() and out.first().pii__ == "a" and out.columns[:4] == df.columns
    assert pii.pseudonymize(df.limit(0), "k").count() == 0
