import re

from auditloom.operators import pii
from auditloom.session import scratch_path

TEXTS = [
    (1, "s1", "Mail ann@example.com or bob@example.com, again ann@example.com."),
    (2, "s1", "token = 'abcd1234efgh' and password: abcd1234efgh from 10.0.0.12"),
    (3, "s1", "card 4111 1111 1111 1111 phone +1 (523) 555-1055, secret \"zz-top-99999\""),
    (4, "s2", "nothing here"),
    (5, "s1", "bob@example.com wrote; key 10.0.0.12"),
    (6, "s2", ""),
]


def _expected(rows):
    """Number values in reading order, one mapping for the whole list of texts."""
    names, counts, out = {}, {}, []
    for text in rows:
        for kind, pattern in pii.PII_PATTERNS:
            def swap(match, kind=kind):
                label, value = ("", match.group(0)) if kind != "API_KEY" else (match.group(1), match.group(2).strip("'\""))
                if value not in names:
                    counts[kind] = counts.get(kind, 0) + 1
                    names[value] = f"[[{kind}_{counts[kind]}]]"
                return label + names[value]

            text = re.sub(pattern, swap, text)
        out.append(text)
    return out


def _frame(spark):
    return spark.createDataFrame(TEXTS, "id BIGINT, scope STRING, text STRING")


def test_mask_per_row_and_back(spark):
    masked = pii.mask_pii(_frame(spark))
    rows = {r["id"]: r for r in pii.unmask_pii(masked).collect()}
    for key, _, text in TEXTS:
        assert rows[key]["masked"] == _expected([text])[0]
        assert rows[key]["unmasked"] == text.replace("'abcd1234efgh'", '"abcd1234efgh"').replace(
            "password: abcd1234efgh", 'password: "abcd1234efgh"'
        )
    # The pattern takes a final full stop into the address, which makes it a third value.
    assert rows[1]["masked"] == "Mail [[EMAIL_1]] or [[EMAIL_2]], again [[EMAIL_3]]"


def test_mask_per_scope(spark):
    masked, mapping = pii.mask_pii_scope(_frame(spark), "scope", "id")
    got = {r["id"]: r["masked"] for r in masked.collect()}
    for scope in ("s1", "s2"):
        keys = [k for k, s, _ in TEXTS if s == scope]
        want = _expected([t for _, s, t in TEXTS if s == scope])
        assert [got[k] for k in keys] == want
    restored = pii.unmask_pii_scope(masked, mapping, "scope", "id")
    back = {r["id"]: r["unmasked"] for r in restored.collect()}
    assert back[1] == TEXTS[0][2] and back[4] == "nothing here" and back[6] == ""
    cleared = pii.clear_scope(mapping, "scope", spark.createDataFrame([("s1",)], "scope STRING"))
    assert cleared.count() == 0


def test_numbering_across_buckets(spark):
    rows = [(i, "hot", f"user{i % 40}@example.com") for i in range(200)]
    df = spark.createDataFrame(rows, "id BIGINT, scope STRING, text STRING")
    extracted = pii.extract_pii(df)
    numbers = pii.pii_first_seen_number(extracted, "scope", "id", rows_per_bucket=7).collect()
    assert {(r["value"], r["n"]) for r in numbers} == {(f"user{i}@example.com", i + 1) for i in range(40)}


def test_leak_check(spark):
    parts = spark.createDataFrame([("a", "ok"), ("a", "ann@example.com"), ("b", None)], "case_id STRING, text STRING")
    got = dict(pii.pii_leak_check(parts, "case_id", "text", ["ann@example.com"]).collect())
    assert got == {"a": True, "b": False}


def test_placeholders_stay_over_loads(spark):
    folder = scratch_path(spark, "placeholders")
    schema = "team STRING, no BIGINT, text STRING"
    one = spark.createDataFrame([("a", 5, "x@y.com or b@c.org, 555-123-4567"), ("b", 6, "x@y.com"), ("a", 7, None)], schema)
    masked, first = pii.mask_pii_load(one, "team", "no", folder, 0)
    entries = lambda d: {(r["team"], r["value"]): r["placeholder"] for r in d.collect()}
    before = entries(first)
    assert {r["no"]: r["masked"] for r in masked.collect()}[5].startswith(before["a", "x@y.com"])
    # smaller row numbers, known and new values, a scope of its own
    two = spark.createDataFrame([("a", 1, "new@z.net then b@c.org"), ("a", 2, "x@y.com"), ("c", 3, "x@y.com"), ("b", 4, "new@z.net")], schema)
    for _ in range(2):  # the second time is a replay
        masked, second = pii.mask_pii_load(two, "team", "no", folder, 1)
        after = entries(second)
        assert {k: after[k] for k in before} == before and second.count() == len(after) == len(before) + 3
        assert after["a", "new@z.net"] == "[[EMAIL_3]]" and after["b", "new@z.net"] == "[[EMAIL_2]]" and after["c", "x@y.com"] == "[[EMAIL_1]]"
        assert {r["no"]: r["masked"] for r in masked.collect()} == {1: "[[EMAIL_3]] then [[EMAIL_2]]", 2: "[[EMAIL_1]]", 3: "[[EMAIL_1]]", 4: "[[EMAIL_2]]"}
    back = pii.unmask_pii_scope(masked, second, "team", "no")
    assert {r["no"]: r["unmasked"] for r in back.collect()} == {r["no"]: r["text"] for r in two.collect()}
    masked, third = pii.mask_pii_load(two.limit(0), "team", "no", folder, 2)
    assert masked.count() == 0 and entries(third) == after
