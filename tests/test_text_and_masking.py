import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from helpers import logs, norm
from logwarden.config import MaskPolicy, MaskRule, mask_rules
from logwarden.functions import crypto, pii, regex, text
from logwarden.operators import masking, normalize, validate


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("o")).first().o


def pii_rules(*names):
    return [MaskRule("PII_TYPE", category=n) for n in names]


@pytest.mark.parametrize("raw, categories, want", [
    ("Contact admin@example.com", ["EMAIL"], "Contact [MASKED_EMAIL]"),
    ("Card: 4111 1111 1111 1111", ["CREDIT_CARD"], "Card: [MASKED_CREDIT_CARD]"),
    ("Call 090-1234-5678", ["PHONE"], "Call [MASKED_PHONE]"),
    ("ID: 123456789012", ["GOVERNMENT_ID"], "ID: [MASKED_GOVERNMENT_ID]"),
    ("番号123456789012です", ["GOVERNMENT_ID"], "番号[MASKED_GOVERNMENT_ID]です"),
    ("口座 1234-567-1234567。", ["JAPAN_ACCOUNT"], "口座 [MASKED_JAPAN_ACCOUNT]。"),
    ("〒123-4567", ["POSTAL_CODE"], "[MASKED_POSTAL_CODE]"),
    ("x123456789012", ["GOVERNMENT_ID"], "x123456789012"),
    ("20260101", ["HEALTH_INSURANCE"], "[MASKED_HEALTH_INSURANCE]"),
    ("a@b.co 1", ["NO_SUCH"], "a@b.co 1"),
    ("", ["EMAIL"], ""),
])
def test_mask_pii(spark, raw, categories, want):
    assert one(spark, raw, lambda c: pii.mask_pii(c, categories)) == want


def test_rules_apply_in_order(spark):
    rules = [MaskRule("REGEX", pattern=r"secret-\d+", replacement="[HIDDEN]"),
             MaskRule("REGEX", pattern=r"\[HIDDEN\]", replacement="[DOUBLE]")]
    assert one(spark, "a secret-123", lambda c: pii.mask_text(c, rules)) == "a [DOUBLE]"


@pytest.mark.parametrize("raw, pattern, repl, want", [
    ("ab12", r"(\w)(\d)", "${2}$1", "a1b2"),
    ("x1", r"x(\d)", "$1x", ""),
    ("x1", r"x(\d)", r"\$", r"\$"),
    ("x1", r"x(\d)", "${1}0", "10"),
    ("cost 5", r"5", "$", "cost $"),
    ("a\nb", r"a.b", "-", "a\nb"),
    ("a\rb", r"a.b", "-", "-"),
    ("end\n", r"end$", "-", "end\n"),
    ("ÉCOLE école", r"(?i)école", "-", "- -"),
    ("a\x0bb", r"a\sb", "-", "a\x0bb"),
    ("日x日", r"\bx\b", "-", "日-日"),
    ("a]b", r"[]]", "-", "a-b"),
])
def test_regex_dialect(spark, raw, pattern, repl, want):
    assert one(spark, raw, lambda c: pii.mask_regex(c, pattern, repl)) == want


def test_bad_patterns(spark):
    assert mask_rules([{"type": "REGEX", "pattern": "("}, {"type": "PII_TYPE", "category": "EMAIL"}]) == pii_rules("EMAIL")
    assert regex.compiles(regex.spark_pattern("a+")) and not regex.compiles(regex.spark_pattern("[a"))


def test_mask_all_leaves_nothing_and_repeats(spark):
    samples = ["a@b.co", "4111-1111-1111-1111", "+8190 1234 5678", "123456789012", "12345678", "1234-567-1234567",
               "〒100-0001", "a 0312345678 b@c.de 99887766"]
    df = spark.createDataFrame([(s,) for s in samples], "s string").select("s", pii.mask_all_pii(F.col("s")).alias("m"))
    out = df.select("m", pii.mask_all_pii(F.col("m")).alias("again"), pii.contains_pii(F.col("s")).alias("before"),
                    pii.contains_pii(F.col("m")).alias("after")).collect()
    assert all(r.m == r.again and r.before and not r.after for r in out)


def test_mask_log_fields_and_preserve(spark):
    df = norm(spark, {"message": "m a@b.co", "actor_id": "a@b.co", "input": "i a@b.co", "details": {"k": "a@b.co", "p": "a@b.co"},
                      "tags": [("mail", "a@b.co"), ("ip", "a@b.co")],
                      "ai_context": ("a", "t", 0, "m", 0.5, "r a@b.co"),
                      "agent_back_log": [("a", "x", None, "b a@b.co", "success")]})
    out = masking.mask_log(df, pii_rules("EMAIL"), ["actorId", "ip", "p"]).first()
    m = "[MASKED_EMAIL]"
    assert (out.message, out.actor_id, out.input) == (f"m {m}", "a@b.co", f"i {m}")
    assert [t.category for t in out.tags] == [m, "a@b.co"] and out.details == {"k": m, "p": "a@b.co"}
    assert out.ai_context.reasoning_trace == f"r {m}" and out.agent_back_log[0].result == f"b {m}"


def test_policies_unite_and_fall_back(spark):
    policies = [MaskPolicy("a", tuple(pii_rules("EMAIL")), log_types=("SECURITY",)),
                MaskPolicy("b", tuple(pii_rules("PHONE")), min_level=5, preserve_extra=("k",)),
                MaskPolicy("c", (MaskRule("KEY_MATCH", keys=("secret",)),), log_types=("DEBUG",))]
    text_ = "a@b.co 090-1234-5678"
    rows = [dict(trace_id="both", type="SECURITY", level=5), dict(trace_id="one", type="SECURITY", level=2),
            dict(trace_id="none", type="INFRA", level=2), dict(trace_id="key", type="DEBUG", level=2)]
    df = norm(spark, *[dict(r, message=text_, details={"k": text_, "secret": "s"}) for r in rows])
    out = {r.trace_id: r for r in masking.mask_with_policies(df, policies, pii_rules("GOVERNMENT_ID")).collect()}
    assert out["both"].message == "[MASKED_EMAIL] [MASKED_PHONE]" and out["both"].details["k"] == text_
    assert out["one"].message == "[MASKED_EMAIL] 090-1234-5678" and out["none"].message == text_
    assert out["key"].details == {"k": text_, "secret": "[MASKED_KEY]"} and out["none"].details["secret"] == "s"


def test_leaks_and_remask(spark):
    df = norm(spark, {"message": "x " + "a" * 60 + "@b.co", "actor_id": "a@b.co", "tags": [("k", "090-1234-5678")],
                      "agent_back_log": [("a", "x", None, "ok", "s"), ("a", "x", None, "c@d.ef", "s")]})
    got = {(r.field_name, r.category): r.snippet for r in masking.pii_leaks(df, categories=["EMAIL", "PHONE"]).collect()}
    assert set(got) == {("message", "EMAIL"), ("actorId", "EMAIL"), ("tags[k]", "PHONE"), ("agentBackLog[1].result", "EMAIL")}
    assert got[("message", "EMAIL")] == "a" * 50 + "..."
    out = masking.remask_leaks(df, ["actorId"]).first()
    assert out.message == "x [MASKED_EMAIL]" and out.actor_id == "a@b.co" and out.tags[0].category == "090-1234-5678"


def test_json_text_depth_and_client_limits(spark):
    deep = {"a": {"b": {"c": "a@b.co"}}, "keep": "a@b.co", "list": ["a@b.co"] * 3, "n": 1}
    server = masking.json_leaves_masker(["EMAIL"], preserve=["keep"], max_depth=3)
    client = masking.json_leaves_masker(["EMAIL"], keys={"n": "[K]"}, max_depth=2, client=True, max_array=2)
    s, c = (json.loads(one(spark, json.dumps(deep), f)) for f in (server, client))
    assert s["a"]["b"]["c"] == "[MAX_DEPTH_EXCEEDED]" and s["keep"] == "a@b.co" and s["list"] == ["[MASKED_EMAIL]"] * 3
    assert c["a"]["b"] == "[CIRCULAR_REFERENCE_OR_TOO_DEEP]" and c["list"] == ["[MASKED_EMAIL]"] * 2 and c["n"] == "[K]"
    assert one(spark, "not json a@b.co", server) == "not json [MASKED_EMAIL]"


def test_typed_nested_depth(spark):
    df = spark.createDataFrame([((("a@b.co",),),)], "n struct<x:struct<y:string>>")
    shallow = masking.mask_nested(df, ["n"], pii_rules("EMAIL"), max_depth=2).first()
    assert shallow.n.x.y == "[MAX_DEPTH_EXCEEDED]"
    assert masking.mask_nested(df, ["n"], pii_rules("EMAIL")).first().n.x.y == "[MASKED_EMAIL]"


@pytest.mark.parametrize("message, reason", [
    ("  　\t\n", normalize.EMPTY_MESSAGE), (None, normalize.EMPTY_MESSAGE),
    ("a" * 65537, "sanitize(message): exceeds max length 65536"), ("é" * 32769, "sanitize(message): exceeds max length 65536"),
    ("a\x00b", "sanitize(message): contains null bytes"), (" ok ", None), ("a" * 65536, None),
])
def test_reject_reasons(spark, message, reason):
    assert normalize.with_reject_reason(logs(spark, {"message": message})).first().reject_reason == reason


def test_invalid_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe"),)], "b binary").select(F.col("b").cast("string").alias("message"))
    assert normalize.with_reject_reason(df).first().reject_reason == "sanitize(message): invalid UTF-8"


def test_normalize_defaults(spark):
    r = norm(spark, {"type": None, "level": 9, "origin": None, "boundary": None, "message": " \x07 a\x1b[0m\tb\n ", "tags": None,
                     "timestamp": None, "logical_clock": 0, "trace_id": "", "is_critical": None}).first()
    assert (r.type, r.level, r.origin, r.boundary, r.service_id) == ("SYSTEM", 3, "SYSTEM", "unknown", "svc")
    # Trimming comes first, so the blank behind the dropped character stays.
    assert r.message == " a[0m\tb" and r.tags == [] and r.timestamp and r.logical_clock > 10**12 and len(r.trace_id) == 64
    again = norm(spark, {"trace_id": "", "message": "x"}, {"trace_id": None, "message": "x"}).collect()
    assert again[0].trace_id == again[1].trace_id


def test_limits(spark):
    r = norm(spark, {"tags": [(f"k{i}", "v") for i in range(150)], "resource_ids": [str(i) for i in range(150)],
                     "details": {f"k{i:03d}": "v\x00" + "é" * 40000 for i in range(60)}}).first()
    assert len(r.tags) == 100 and len(r.resource_ids) == 100 and len(r.details) == 50 and "k049" in r.details
    assert all(len(v.encode()) <= 65540 and "\x00" not in v for v in r.details.values())


def test_strict_rules(spark):
    big = [("k" * 129, "v"), ("k", "v" * 1025)]
    rows = [dict(trace_id="tags", tags=big), dict(trace_id="many", tags=[("k", "v")] * 101),
            dict(trace_id="depth", ai_context=("a", "t", -1, "m", 0.1, "")), dict(trace_id="ok"),
            dict(trace_id="absent", message=None, type=None, level=None, origin=None, tags=None),
            dict(trace_id="res", resource_ids=["r"] * 101), dict(trace_id="emoji", message="\U0001F600" * 32769)]
    got = {r.trace_id: (r.field, r.violation) for r in validate.validate_strict(logs(spark, *rows)).collect()}
    assert got == {"tags": ("tags[0].key", "invalid or too long"), "many": ("tags", "exceeds max count 100"),
                   "depth": ("aiContext.loopDepth", "must be non-negative number"),
                   "res": ("resourceIds", "exceeds max count 100"), "emoji": ("message", "exceeds max length 65536")}
    all_ = validate.validate_strict(logs(spark, rows[0]), first_only=False)
    assert [r.field for r in all_.collect()] == ["tags[0].key", "tags[1].category"]
    assert [r.tag_problem for r in validate.validate_tags(logs(spark, rows[0], rows[1])).collect()] == [
        "sanitize(tags[0].key): exceeds max length 128", "sanitize(tags): too many tags (101 > 100)"]


def test_hmac_equals_python(spark):
    values = ["", "a", "日本語", "x" * 200]
    for key in (b"k" * 32, b"long" * 40):
        df = spark.createDataFrame([(v,) for v in values], "s string")
        got = [r.h for r in df.select(crypto.hmac_sha256(F.col("s"), key).alias("h")).collect()]
        assert got == [hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in values]


def test_accessors(spark):
    df = norm(spark, {"tags": [("x", "1"), ("ip", "10.0.0.1"), ("ip", "2")]}, {"actor_id": "a", "resource_ids": ["r", "s"]})
    out = df.select(text.tag_value(F.col("tags"), "ip", "-").alias("ip"), text.first_resource(F.col("resource_ids"), "-").alias("r"),
                    text.actor_or(F.col("actor_id"), "-").alias("a")).collect()
    assert [tuple(r) for r in out] == [("10.0.0.1", "-", "-"), ("-", "r", "a")]


def test_json_masking_takes_registered_patterns(spark):
    """Classes stay ASCII, case folds as in Java, ``.`` and ``$`` as in the rule dialect."""
    table = pii.register_pattern("TICKET", r"(?i)tick-\d{3}\b")
    table = pii.register_pattern("STAFF", r"[\w.]+@corp$", table)
    value = {"a": "TICK-123 and tick-999", "b": ["x.y@corp", "x.y@corp\n", {"c": "tick-١٢٣"}], "d": 5}
    df = spark.createDataFrame([(json.dumps(value),), (None,), ("tick-555",)], "v string")
    names = ["TICKET", "STAFF"]
    got = [r.v for r in df.select(masking.json_leaves_masker(names, pattern_set=table)("v").alias("v")).collect()]
    assert json.loads(got[0]) == {"a": "[MASKED_TICKET] and [MASKED_TICKET]", "b": ["[MASKED_STAFF]", "x.y@corp\n", {"c": "tick-١٢٣"}], "d": 5}
    assert got[1:] == [None, "[MASKED_TICKET]"]
    flat = spark.createDataFrame([(s,) for s in ("TICK-123 and tick-999", "x.y@corp", "x.y@corp\n", "tick-١٢٣", "tick-1234")], "s string")
    native = [r.m for r in flat.select(pii.mask_pii(F.col("s"), names, table).alias("m")).collect()]
    python = [r.m for r in flat.select(masking.json_leaves_masker(names, pattern_set=table)(F.to_json(F.array("s"))).alias("m")).collect()]
    assert [json.loads(m)[0] for m in python] == native


def test_malformed_records_keep_their_text(spark):
    from logwarden.sources.logs import split_malformed

    rows = [('{"trace_id": "t", "message": "m", "level": 4}', 1), ('{"trace_id": "t", "level": "high"}', 2), ("plain text", 3), ('{"trace_id": ', 4), (None, 5), ("[1]", 6), ("{}", 7)]
    good, bad = split_malformed(spark.createDataFrame(rows, "value string, offset int"))
    assert [(r.trace_id, r.message, r.level) for r in good.collect()] == [("t", "m", 4), (None, None, None)]
    assert {r.offset: (r.value, r.parse_error) for r in bad.collect()} == {
        2: (rows[1][0], "record does not fit the log schema"), 3: ("plain text", "record is no JSON object"), 4: (rows[3][0], "record does not fit the log schema"),
        5: (None, "record is no JSON object"), 6: ("[1]", "record is no JSON object")}
