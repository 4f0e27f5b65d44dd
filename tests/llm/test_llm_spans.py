"""Secrets and personal data against plain patterns."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
from cases import AWKWARD, documents
from pyspark.sql import functions as F

from gaugeworks.llm import pii, secrets
from gaugeworks.llm.base import table

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def plain_secrets(text):
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(values)) % 10 == 0


def plain_pii(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    found += [("ip", *m.span()) for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    return found + [("phone", *m.span()) for m in phones if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def noise(seed, parts, count):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(count)]


SECRET_PARTS = ["password", "PASSWD", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH01234567", "deadbeef0123",
                "0f" * 12, "\n\n", "user: bob", "https://a.b/c", "Zx9Kq2Lm4Np6Rs8Tu0Vw", "ſ", "é", "\U0001f600", "ASIA", "host=db1"]
PII_PARTS = ["a.b", "@", "x-y.com", ".", "1", "23", "255", "256", "0", "4111 1111 1111 1111", "4111-1111-1111-111", "+1 (555) 010-9999", "+", "-", " ", "_%",
             "é", "\U0001f600", "\n", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "ssn 123-45-6789", "(", ")", "12.34", "1.2.3.4.5.6.7.8"]


def test_secrets_of_the_tables_and_of_noise(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    for row in secrets.op4_secret_scan(spark, sf_dir).collect():
        want = plain_secrets(dict(rows)[row["doc_id"]])
        assert row["base_sha256"] == digest(want)
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
    for text in noise(1, SECRET_PARTS, 3000) + [t for _, t in AWKWARD]:
        found = secrets.find(text)
        assert [s for s in found if s[0] in ("assign", "access", "hex")] == plain_secrets(text)
        assert found == sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_weak_parts_count_only_together():
    key = "9aB3xZ81kLmNoPqRsTuVwXyZ0123"
    assert secrets.find(f"see {key} there") == []
    assert secrets.find("user: bob at https://a.example/x") == []
    assert secrets.find("ASIAABCDEFGHIJKLMNOP alone") == []
    kinds = [s[0] for s in secrets.find(f"user: bob, https://a.example/x and {key}")]
    assert kinds == ["identifier", "endpoint", "secret"]
    assert secrets.find(f"user: bob\n\n{key}") == []
    assert secrets.find("user: bob" + " z" * 300 + f" {key}") == []


def test_many_parts_in_one_text_stay_cheap():
    text = "user: bob 9aB3xZ81kLmNoPqRsTuVwXyZ0123 " * 20_000
    assert len(secrets.find(text)) == 40_000


def test_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark, [*AWKWARD, (50, "my token = abcdef12 and deadbeefdeadbeefdeadbeef99 é")])
    done = secrets.redact(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    row = done.filter("doc_id = 50").first()
    assert row["text"] == "my [ASSIGN] and [HEX] é" and row["n_chars"] == len(row["text"])
    assert {r["text"] for r in done.filter("doc_id in (3, 4)").collect()} == {None, ""}
    assert secrets.redact(documents(spark, [])).collect() == [] == secrets.scan(documents(spark, [])).collect()


def test_redaction_returns_texts_once_and_few_at_a_time(spark):
    seen = []

    class Rows:
        schema = documents(spark, []).schema
        columns = schema.names

        def mapInArrow(self, run, schema):
            seen.append([f.name for f in schema.fields if f.dataType == schema["text"].dataType])
            batch = pa.RecordBatch.from_pylist([{c: "token = abcdef12" if c == "text" else None for c in self.columns}] * 1000)
            seen.extend(run(iter([batch])))
            return documents(spark, []).withColumn(schema.names[-1], F.lit(True))

    secrets.redact(Rows())
    fields, *out = seen
    assert fields == [f.name for f in Rows.schema.fields if f.dataType == Rows.schema["text"].dataType]
    assert max(b.num_rows for b in out) <= 256
    assert [t for b in out for t in b.column("text").to_pylist()] == ["[ASSIGN]"] * 1000


def test_personal_data_of_noise(spark):
    texts = noise(2, PII_PARTS, 3000) + [t for _, t in AWKWARD] + ["1 " * 3000, "a" * 5000 + "@", "1.2.3.4 " * 700, "a@b.co" * 300, "9" * 30_000]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["spans"] for r in pii.spans(documents(spark, rows)).collect()}
    for key, text in rows:
        spans = [(s["kind"], s["start"], s["end"]) for s in got[key]]
        assert [s for s in spans if s[0] not in ("iban", "ssn")] == plain_pii(text), repr(text)
        assert all(0 <= s["score"] <= 1 for s in got[key])


def test_checksums_and_context(spark):
    rows = [(1, "pay to DE89 3704 0044 0532 0130 00 now"), (2, "pay to DE88 3704 0044 0532 0130 00 now"), (3, "123-45-6789"), (4, "my SSN is 123-45-6789"),
            (5, "card 4111 1111 1111 1111"), (6, "4111 1111 1111 1111")]
    got = {r["doc_id"]: r["spans"] for r in pii.spans(documents(spark, rows)).collect()}
    assert [s["kind"] for s in got[1]] == ["iban"] and got[2] == [] and got[3] == []
    assert [s["kind"] for s in got[4]] == ["ssn"]
    assert got[5][0]["score"] > got[6][0]["score"]
    assert len(pii.spans(documents(spark, AWKWARD)).collect()) == len(AWKWARD)
    assert pii.spans(documents(spark, [])).collect() == []


def test_codes_before_a_capital_and_context_beyond_a_neighbour(spark):
    code = "DE89 3704 0044 0532 0130 00"
    rows = [(1, f"IBAN {code} Please pay"), (2, f"{code.replace(' ', '')} Please"), (3, f"{code} A b"), (4, f"{code}, {code} Or"),
            (5, "social security numbers 123-45-6789, 987-65-4321"), (6, "123-45-6789, 987-65-4321: social security"),
            (7, "ssn 123-45-6789" + " x" * 21 + " 987-65-4321"), (8, "é 😀 ssn 123-45-6789,987-65-4321,111-22-3333,444-55-6666,555-66-7777")]
    got = {r["doc_id"]: r["spans"] for r in pii.spans(documents(spark, rows)).collect()}
    found = {key: [rows[key - 1][1][s["start"] : s["end"]] for s in spans if s["kind"] in ("iban", "ssn")] for key, spans in got.items()}
    assert found[1] == [code] and found[2] == [code.replace(" ", "")] and found[4] == [code, code]
    assert found[3] == [code]  # the country's length ends it, so the capital A is no part
    assert found[5] == found[6] == ["123-45-6789", "987-65-4321"]
    assert found[7] == ["123-45-6789"]
    assert found[8] == ["123-45-6789", "987-65-4321", "111-22-3333", "444-55-6666"]


def test_personal_data_runs_no_python(spark, sf_dir):
    plan = pii.op10_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_linked(text, radius=secrets.RADIUS):
    """Every pair of parts compared, with the rule as it is written."""
    base = plain_secrets(text)
    paragraph = lambda at: sum(m.start() < at for m in secrets.PARAGRAPH.finditer(text))
    overlaps = lambda spans, a, b: any(x < b and a < y for x, y in spans)

    def near(parts, a, b):
        return any(
            (x, y) != (a, b) and x - b <= radius and a - y <= radius and paragraph(x) == paragraph(a) for x, y in parts
        )

    taken = [(a, b) for _, a, b in base]
    weak = [m.span() for pattern in (secrets.TEMPORARY, secrets.IDENTIFIER) for m in pattern.finditer(text)]
    ids = weak + [(a, b) for k, a, b in base if k == "access"]
    opaque = [
        m.span() for m in secrets.OPAQUE.finditer(text)
        if not overlaps(taken + ids, *m.span()) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and secrets.entropy(m[0]) >= secrets.LEAST_BITS
    ]
    keys = opaque + [(a, b) for k, a, b in base if k != "access"]
    found = [("identifier", *s) for s in weak if near(keys, *s) and not overlaps(taken, *s)]
    found += [("secret", *s) for s in opaque if near(ids, *s)]
    found += [("endpoint", *m.span()) for m in secrets.ENDPOINT.finditer(text) if near(ids, *m.span()) and near(keys, *m.span())]
    return sorted(set(base + found), key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def test_linked_spans_equal_comparing_all_pairs():
    links = 0
    for seed, radius in ((3, 400), (4, 12), (5, 40)):
        for text in noise(seed, [*SECRET_PARTS, "login=", "account_id: 77x", " z" * 20, "\n \n", ".", "server: s3.eu", "0f" * 12 + "."], 1500):
            found = secrets.find(text, radius)
            assert found == plain_linked(text, radius), repr(text)
            links += sum(s[0] in ("identifier", "secret", "endpoint") for s in found)
    assert links > 500


def test_a_long_span_over_many_short_ones():
    dotted = ".".join("0123456789abcdef01234567" for _ in range(6))
    text = f"user: bob secret={dotted}.Zx9Kq2Lm4Np6Rs8Tu0Vw0Ab1"
    assert secrets.find(text) == plain_linked(text)
    assert not [s for s in secrets.find(text) if s[0] == "secret"]


def test_long_runs_that_are_no_endpoint_take_linear_time():
    import time

    head = "user: bob 9aB3xZ81kLmNoPqRsTuVwXyZ0123 "
    began = time.time()
    for body in ("a-" * 500_000, "a." * 500_000, "\n " * 500_000, "key_id" * 150_000, "-" * 1_000_000):
        assert secrets.find(head + body)[0][0] == "identifier"
    assert time.time() - began < 30


def test_account_codes_end_where_their_country_has_it(spark):
    german, british = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    found = {german: f"IBAN {german} AND pay", british: f"account {british} 2024 x", "NO9386011117947": "NO9386011117947 THEN NO1"}
    for code, text in found.items():
        spans = pii.spans(documents(spark, [(1, text)])).collect()[0]["spans"]
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in spans] == [("iban", code)]
    assert pii.spans(documents(spark, [(1, f"{german}1 and {german[:-1]}1 AND")])).collect()[0]["spans"] == []


def test_very_many_matches_are_placed_right(spark):
    spans = pii.spans(documents(spark, [(1, "call 10.0.0.1 now " * 5000)])).collect()[0]["spans"]
    assert [s["start"] for s in spans] == [5 + 18 * k for k in range(5000)]
