"""Text rules on cases whose results are known."""

from pyspark.sql import functions as F

from dubito.functions import names as N
from dubito.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_abstention_positions(spark):
    hit = lambda s: tuple(one(spark, s, T.abstention_hit))
    assert hit(None) == (True, "<empty>", 0) and hit("") == (True, "<empty>", 0)
    assert hit("   ") == (False, None, None)
    assert hit("x" * 199 + "not known") == (True, "not known", 199)
    assert hit("x" * 200 + "not known")[0] is False
    assert hit("is not available, not known")[1] == "not available"


def test_other_abstentions(spark):
    assert one(spark, "can refer to; not known", T.phrase_rule).phrase == "not known"
    assert one(spark, "a" * 149 + "No Widely Known", T.narrow_rule) and not one(spark, "a" * 150 + "no widely known", T.narrow_rule)
    assert one(spark, "a" * 180 + "no widely known" + "b" * 1000, T.narrow_rule)
    for s, want in (("", True), (" \n", True), ("n/a", True), ("in/an", False), ("I'm UNABLE to", True), ("Paris", False)):
        assert one(spark, s, T.short_abstention) is want
    assert one(spark, ["unknown", "x", "Not provided", "y", "z"], T.refusal_vote, "array<string>")


def test_corruption(spark):
    assert one(spark, "ok \U0001f600", T.is_corrupt) and one(spark, "deadbeef", T.is_corrupt) and not one(spark, "dead", T.is_corrupt)
    assert not one(spark, "12345678", lambda c: T.is_corrupt(c, F.lit("What is the population?")))
    assert one(spark, "abcd-1234", T.corruption_flags).uuid_fragment and one(spark, "y" * 101, T.corruption_flags).anomalously_long
    assert one(spark, "600000000", T.degenerate) is None and one(spark, "H. H. H. H. H.", T.degenerate) is not None


def test_replies(spark):
    for s, want in (("A", "CORRECT"), ("b.", "INCORRECT"), ("NOT ATTEMPTED", "NOT_ATTEMPTED"), ("this is a correct one", "CORRECT"), ("incorrect", "INCORRECT"), ("?", "NOT_ATTEMPTED")):
        assert one(spark, s, T.grade_letter) == want
    assert [one(spark, s, T.entailment_label) for s in ("Entailment", "contradiction", "hm")] == [2, 0, 1]
    assert one(spark, " Paris Question: ", T.trim_stop) == "Paris" and one(spark, "Paris\n\n", T.trim_stop) == "Paris"
    choices = F.array(*map(F.lit, "ABC"))
    assert [one(spark, s, lambda c: T.match_label(c, choices)) for s in ("C", " C.", "Carbon", "", "D")] == ["C", "C", None, None, None]


def test_parsers(spark):
    raw = "- One claim. [True] (source)\nstray\n* Two [false]\n"
    assert [tuple(c) for c in one(spark, raw, T.parse_claims)] == [("One claim.", True), ("Two", False)]
    assert one(spark, "\n- a\n* b\n\n- c", T.parse_facts) == ["a", "b"] and one(spark, "hm\n- a\nhm\n- b", T.parse_facts) == ["a"] and one(spark, "Sentence: x\n- a", T.parse_facts) == []
    assert [tuple(p) for p in one(spark, "1. Who? -- x -- y\nno\n5. Q -- a", T.parse_questions)] == [("Who?", "x -- y"), ("5. Q", "a")]
    assert one(spark, "# T\n- **a** `b`\n1. c\n---", T.clean_markdown) == "a b\nc"
    assert one(spark, "One two. Three! Four five?", T.sentences) == ["One two.", "Four five?"]
    assert tuple(one(spark, "l:local:", T.judge_spec)) == ("l", "local", None) and tuple(one(spark, "l:b:m:1", T.judge_spec)) == ("l", "b", "m:1")
    f = one(spark, "It is probably so.", T.compliance)
    assert f.has_hedge and f.has_bad_starter and f.looks_like_sentence and not f.compliant and f.word_count == 4


def test_logs(spark):
    assert one(spark, "Traceback\nKeyError: x\njudging done", T.outcome) == "done"
    assert one(spark, "a\nKeyError: x", T.outcome) == "python error" and one(spark, "OutOfMemoryError CANCELLED", T.outcome).startswith("OOM") and one(spark, "", T.outcome) == "running or unknown"
    m = one(spark, "2024-01-02T03:04:05+00:00 | a = 1 | job=7 | a=2", T.manifest_fields)
    assert m.fields == {"a": "2", "job": "7"} and one(spark, "yesterday | a=1 | b=2", T.manifest_fields) is None and one(spark, "2024-01-02T03:04:05 | a=1", T.manifest_fields) is None
    assert one(spark, "a\x07b\n", T.printable) == "ab"


def test_names(spark):
    for s, want in (("Qwen/Qwen3-32B", "Qwen3-32B"), ("/scratch/models/student", "student"), ("/a/b/", "b"), ("plain", "plain")):
        assert one(spark, s, N.short_model_name) == want
    assert one(spark, "Qwen/Qwen3-32B", lambda c: N.pair_name(c, F.lit("Qwen/Qwen3-4B"))) == "32Bto4B"
    assert one(spark, "Qwen/Qwen3-1.7B", lambda c: N.pair_name(c, F.lit("some/other-model"))) == "Qwen3-1.7Btoother-model"
    assert one(spark, "/x/gen_simpleqa_simpleqa_student_strict_seed44_a.jsonl", N.judged_name) == "judged_simpleqa_seed44_a.jsonl"
    assert one(spark, "/x/judged_simpleqa_Qwen3-32B_strict.jsonl", N.tag_of) == "Qwen3-32B_strict"


def test_answers_hold_whole_texts(spark, data):
    from dubito.plans import binding
    from dubito.plans.registry import SQL

    rows = binding.responses(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert rows and all(r.text in r.response for r in rows)
    assert not any("substring(text, 1" in x.replace("substring(text, 1, 12), '...'", "") for x in SQL.values())


def test_operators_reach_the_end_of_texts(spark, tmp_path):
    from dubito.plans import texts  # noqa: F401
    from dubito.plans.registry import QUERIES

    sentences = [f"sentence {i} of many" for i in range(40)]
    rows = [(3, ". ".join(sentences)), (4, "x" * 100 + " last"), (5, "two words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    patched = got("patch_positions")[3].patched.split("|")
    assert patched == ["patched" if (3 + i) % 3 == 0 else x for i, x in enumerate(sentences)]
    assert got("parse_facts")[3].facts.split("|") == sentences
    assert got("trim_stops")[4].trimmed == rows[1][1] and got("trim_stops")[3].trimmed == rows[0][1]
    assert got("clean_markdown")[4].cleaned.count("last") == 2
    claims = [r.claim for r in QUERIES["parse_claims"](spark, str(tmp_path)).where("doc_id = 4").collect()]
    assert claims == [rows[1][1] + " one.", "second claim"]
    label = got("labels_for_charts")[4]
    assert label.printable == rows[1][1] + "x" and label.label == "x" * 12 + "..."


def test_alternation_stands_for_its_values():
    import random
    import re

    from dubito.functions import phrases as P

    rng = random.Random(1)
    for values in (P.MERGED, P.PHRASES, P.SHORT, ["a", "ab", "b.c", "x|y", "no", "not"]):
        one = re.compile(T.alternation(values))
        for _ in range(300):
            t = "".join(rng.choice([*values, " ", "x", "no ", "a", "\U0001f600", "unk"]) for _ in range(rng.randrange(6)))
            want = min(((t.find(v), v) for v in values if v in t), default=None)
            m = one.search(t)
            assert (m and (m.start(), m.group())) == want


def test_position_counts_characters(spark):
    h = one(spark, "\U0001f600\U0001f600 there is no widely known name", T.abstention_hit)
    assert h.position == "\U0001f600\U0001f600 there is no widely known name".find(h.phrase)


def test_fixed_values_are_what_they_were():
    """Lists that must stay as they are, in their order: a changed one changes results."""
    import hashlib
    import json

    from dubito.functions import phrases as P

    golden = {
        "MERGED": "d781bd8ac61a", "PHRASES": "dff8e6cf7354", "SHORT": "6a1e3a66f444", "REFUSALS": "0616064bf0ef", "INSTRUCTIONS": "32f43541f61c", "HEDGES": "e6e79652aa6b",
        "EXPLANATIONS": "17b5f54dcaa2", "STARTERS": "e72f44cee6af", "FORMAT_REFUSALS": "ecf55cdc97f1", "STOPS": "6b7df3b1c4ca", "SUCCESS": "08a57a3e1338", "SETTINGS": "40140ede1489", "LEVELS": "40bcd8f92b4b",
    }
    assert {n: hashlib.md5(json.dumps(getattr(P, n)).encode()).hexdigest()[:12] for n in golden} == golden
