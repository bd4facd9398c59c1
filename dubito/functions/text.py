"""Text detectors and parsers as column expressions, all built-in functions.

Python's notions are kept: strip() takes every blank character, positions count from 0,
and split() takes runs of blanks. The abstention rules differ on purpose; they are not one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases as P

BLANK, NO_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]", r"[^\s\x1c-\x1f\x85\p{Z}]"


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_extract(c, f"(?s)^{BLANK}*+((?:.*{NO_BLANK})?)", 1)  # one match from the front, not one for each run of blanks


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def has_any(low: Column, values: list[str]) -> Column:
    """Whether one of the values stands in the text."""
    out = F.lit(False)
    for v in values:
        out = out | F.contains(low, F.lit(v))
    return out


def alternation(values: list[str]) -> str:
    """A pattern that matches where one of the values stands, the shortest of those at a place.

    Values with a common beginning share it, so a text is read once, whatever their number.
    """
    tree: dict = {}
    for v in values:
        node = tree
        for ch in v:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:
            return ""  # a longer value at this place doesn't matter
        parts = [re.escape(ch) + pattern(child) for ch, child in node.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    first = "".join(re.escape(ch) for ch in tree if ch)
    return f"(?=[{first}]){pattern(tree)}" if first and "" not in tree else pattern(tree)  # most places fail at their first character


def _hits(low: Column, values: list[str]) -> Column:
    """The values that stand in the text with their positions, in the order of the list."""
    there = F.filter(_array(values), lambda p: F.contains(low, p))
    return F.transform(there, lambda p: F.struct(F.instr(low, p).alias("pos"), p.alias("phrase")))


def abstention_hit(c: Column, cutoff: int = P.MERGED_CUTOFF) -> Column:
    """(is_abstained, phrase, position) of the earliest phrase; abstained if it starts before the cutoff.

    Null and empty answers abstain with "<empty>" at 0; blank ones don't.
    """
    one = alternation(P.MERGED)

    def earliest(low: Column) -> Column:
        before = F.regexp_extract(low, f"(?s)^(.*?)(?:{one})", 1)
        return F.when(low.rlike(one), F.struct((F.length(before) + 1).alias("pos"), F.regexp_extract(low, one, 0).alias("phrase")))

    first = let(F.lower(strip(c)), earliest)
    found = let(first, lambda f: F.struct((F.coalesce(f["pos"] <= cutoff, F.lit(False))).alias("is_abstained"), f["phrase"].alias("phrase"), (f["pos"] - 1).alias("position")))
    empty = F.struct(F.lit(True).alias("is_abstained"), F.lit("<empty>").alias("phrase"), F.lit(0).alias("position"))
    return F.when(c.isNull() | (c == ""), empty).otherwise(found)


def is_abstained(c: Column, cutoff: int = P.MERGED_CUTOFF) -> Column:
    """T2."""
    return abstention_hit(c, cutoff)["is_abstained"]


def phrase_rule(c: Column) -> Column:
    """T4: (is_non_answer, phrase, position) of the first phrase in the order of the list, anywhere."""
    one = alternation(P.PHRASES)
    first = let(F.lower(strip(c)), lambda low: F.when(low.rlike(one), F.get(_hits(low, P.PHRASES), F.lit(0))))
    found = let(first, lambda f: F.struct(f.isNotNull().alias("is_non_answer"), f["phrase"].alias("phrase"), (f["pos"] - 1).alias("position")))
    empty = F.struct(F.lit(True).alias("is_non_answer"), F.lit("<empty>").alias("phrase"), F.lit(0).alias("position"))
    return F.when(c.isNull() | (c == ""), empty).otherwise(found)


def narrow_rule(c: Column) -> Column:
    """T5: the first match of the narrow pattern starts before max(150, a fifth of the length)."""
    found = F.regexp_extract(c, f"(?is)^(.*?)(?:{P.NARROW})", 1)
    hit = c.rlike(f"(?iu){P.NARROW}")
    return F.coalesce(hit & (F.length(found) < F.greatest(F.lit(P.NARROW_CUTOFF), F.floor(F.lit(P.NARROW_SHARE) * F.length(c)))), F.lit(False))


def short_abstention(c: Column) -> Column:
    """Empty after strip(), a phrase anywhere, or n/a between characters that aren't a-z or 0-9."""
    return let(F.lower(strip(c)), lambda low: (low == "") | low.rlike(f"(?<![a-z0-9])n/a(?![a-z0-9])|{alternation(P.SHORT)}"))


def canonical(c: Column) -> Column:
    """F8: answers that abstain become the canonical one."""
    return F.when(short_abstention(c), F.lit(P.CANONICAL)).otherwise(c)


def refusal_vote(answers: Column) -> Column:
    """At least half (rounded down) of the answers hold a refusal token."""
    n = F.size(F.filter(answers, lambda a: let(F.lower(a), lambda low: has_any(low, P.REFUSALS))))
    return n >= F.floor(F.size(answers) / 2)


def numeric_hint(question: Column) -> Column:
    """T26."""
    return question.rlike(rf"(?iu)\b({P.NUMERIC})\b")


def is_corrupt(c: Column, question: Column | None = None, most: int = P.FIELD_MOST) -> Column:
    """T9 with a question, T10 without: emoji, a run of 8 hexadecimal digits (waived for numeric questions), or too long."""
    hexed = c.rlike(f"(?i){P.HEX}")
    if question is not None:
        hexed = hexed & ~numeric_hint(question)
    return c.rlike(P.EMOJI) | hexed | (F.length(c) > most)


def record_is_corrupt(raw: Column, question: Column | None = None, least: int = P.BAD_FIELDS) -> Column:
    """At least two of the raw samples are corrupt."""
    return F.size(F.filter(raw, lambda t: is_corrupt(t, question))) >= least


def corruption_flags(c: Column, most: int = P.SCAN_MOST) -> Column:
    """Emoji, uuid_fragment, instructional, anomalously_long, any."""
    emoji = c.rlike(P.SCAN_EMOJI)
    fragment = c.rlike(P.FRAGMENT)
    told, long = let(F.lower(c), lambda low: has_any(low, P.INSTRUCTIONS)), F.length(c) > most
    flags = F.struct(emoji.alias("emoji"), fragment.alias("uuid_fragment"), told.alias("instructional"), long.alias("anomalously_long"))
    return let(flags, lambda f: F.struct(*(f[n].alias(n) for n in ("emoji", "uuid_fragment", "instructional", "anomalously_long")), (f["emoji"] | f["uuid_fragment"] | f["instructional"] | f["anomalously_long"]).alias("any")))


def degenerate(c: Column) -> Column:
    """The first unit of up to 6 characters that stands 4 times or more over 8 characters or more, not of digits alone."""
    runs = F.regexp_extract_all(c, F.lit(P.DEGENERATE), F.lit(1))
    return F.get(F.filter(runs, lambda m: (F.length(m) >= P.DEGENERATE_LEAST) & ~m.rlike(P.NUMBER_RUN)), F.lit(0))


def compliance(c: Column, most: int = 6) -> Column:
    """word_count, six flags, compliant."""

    def flags(x: Column) -> Column:
        text, low, n = x["text"], x["low"], x["n"]
        starter = F.lit(False)
        for s in P.STARTERS:
            starter = starter | F.startswith(low, F.lit(s))
        return F.struct(
            n.alias("word_count"), (n > most).alias("too_long"), has_any(low, P.HEDGES).alias("has_hedge"), has_any(low, P.EXPLANATIONS).alias("has_explanation"),
            starter.alias("has_bad_starter"), has_any(low, P.FORMAT_REFUSALS).alias("has_refusal"), (F.endswith(text, F.lit(".")) & (n > 1)).alias("looks_like_sentence"),
        )

    names = ["too_long", "has_hedge", "has_explanation", "has_bad_starter", "has_refusal", "looks_like_sentence"]

    def verdict(f: Column) -> Column:
        bad = F.lit(False)
        for n in names:
            bad = bad | f[n]
        return F.struct(f["word_count"].alias("word_count"), *(f[n].alias(n) for n in names), (~bad).alias("compliant"))

    parts = let(strip(c), lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"), F.size(words(t)).alias("n")))
    return let(let(parts, flags), verdict)


def grade_letter(reply: Column) -> Column:
    """A letter A, B or C that stands alone, else a grade's name, else NOT_ATTEMPTED."""
    text = F.upper(strip(reply))
    letter = F.regexp_extract(text, r"(?U)\b([ABC])\b", 1)
    return (
        F.when(letter == "A", "CORRECT").when(letter == "B", "INCORRECT").when(letter == "C", "NOT_ATTEMPTED")
        .when(F.contains(text, F.lit("NOT_ATTEMPTED")), "NOT_ATTEMPTED").when(F.contains(text, F.lit("INCORRECT")), "INCORRECT")
        .when(F.contains(text, F.lit("CORRECT")), "CORRECT").otherwise("NOT_ATTEMPTED")
    )


def entailment_label(reply: Column) -> Column:
    """2 entailment, 0 contradiction, 1 anything else."""
    low = F.lower(strip(reply))
    return F.when(F.contains(low, F.lit("entailment")), 2).when(F.contains(low, F.lit("contradiction")), 0).otherwise(1)


def trim_stop(c: Column, stops: list[str] = P.STOPS) -> Column:
    """Strips, then removes the first stop that ends the text, once. Stops of blanks alone never match."""
    text = strip(c)
    out = text
    for s in reversed([x.strip() for x in stops if x.strip()]):
        out = F.when(F.endswith(text, F.lit(s)), strip(F.substring(text, F.lit(1), F.length(text) - len(s)))).otherwise(out)
    return out


def match_label(reply: Column, choices: Column) -> Column:
    """The choice that the reply is, or else starts with as a word; null if none."""
    text = strip(reply)
    same = F.filter(choices, lambda x: x == text)
    # A word boundary follows the label: a change between word characters and others.
    def follows(x: Column) -> Column:
        rest = F.substring(text, F.length(x) + 1, F.lit(1))
        ends = F.substring(x, F.length(x), F.lit(1)).rlike(r"(?U)^\w$")
        return F.startswith(text, x) & (ends != rest.rlike(r"(?U)^\w$"))

    return F.when(text == "", F.lit(None)).otherwise(F.coalesce(F.get(same, F.lit(0)), F.get(F.filter(choices, follows), F.lit(0))))


def parse_claims(raw: Column) -> Column:
    """(claim, is_true) of lines like "- claim [True]"."""
    pattern = r"(?i)^[-*]\s*(.+?)\s*\[(True|False)\]"
    lines = F.filter(F.transform(F.split(raw, "\n"), strip), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(strip(F.regexp_extract(x, pattern, 1)).alias("claim"), (F.lower(F.regexp_extract(x, pattern, 2)) == "true").alias("is_true")))


def parse_facts(raw: Column) -> Column:
    """Bulleted facts, up to a blank line or another line behind the first fact, or a new sentence."""
    empty = F.struct(F.array().cast("array<string>").alias("facts"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        x = strip(line)
        some, bullet = F.size(acc["facts"]) > 0, x.rlike(r"^[-*]\s*(.+)$")
        fact = strip(F.regexp_extract(x, r"^[-*]\s*(.+)$", 1))
        stop = F.startswith(F.lower(x), F.lit("sentence:")) | (some & ~bullet)
        add = ~acc["done"] & ~stop & bullet & (fact != "")
        return F.struct(F.when(add, F.array_append(acc["facts"], fact)).otherwise(acc["facts"]).alias("facts"), (acc["done"] | stop).alias("done"))

    return F.aggregate(F.split(raw, "\n"), empty, step)["facts"]


def parse_questions(raw: Column) -> Column:
    """(question, answer) of lines like "1. question -- answer"."""
    lines = F.filter(F.transform(F.split(raw, "\n"), strip), lambda x: F.contains(x, F.lit(" -- ")))

    def pair(x: Column) -> Column:
        parts = F.split(x, " -- ", 2)
        q = strip(parts[0])
        return F.struct(F.when(q.rlike(r"^[123]\."), strip(F.substring(q, F.lit(3), F.length(q)))).otherwise(q).alias("question"), strip(parts[1]).alias("answer"))

    return F.transform(lines, pair)


def clean_markdown(c: Column) -> Column:
    """Drops headers and rules, strips bullets and numbers, unwraps emphasis and code."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^\s*#{1,6}\s*.*$") & ~x.rlike(r"^\s*(-{3,}|\*{3,})\s*$"))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*[-*]\s+", ""), r"^\s*\d+[.)]\s+", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\*{1,3}([^*]+)\*{1,3}", "$1"), "`([^`]+)`", "$1")


def sentences(c: Column, least: int = 2) -> Column:
    """T25, an approximation of a statistical splitter: cuts behind . ! ? and blanks; sentences of two words or more."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: F.size(words(s)) >= least)


def fill(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns."""
    import re

    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if piece.startswith("{") and piece.endswith("}") else None
        parts.append(values[name] if name in values else F.lit(piece))
    return F.concat(*parts)


def ask_questions(claim: Column, context: Column) -> Column:
    """The prompt that asks for questions about a claim; another one without context."""
    told = F.lit(P.ASK_QUESTIONS)
    return F.when(context.isNull() | (context == ""), fill(P.SEE_SENTENCE, claim=claim, instruction=told)).otherwise(fill(P.SEE_SENTENCE_AFTER, claim=claim, context=context, instruction=told))


def ask_answer(asked: Column, question: Column, context: Column) -> Column:
    """The prompt that asks for a brief answer."""
    told = F.lit(P.ANSWER_BRIEFLY)
    return F.when(context.isNull() | (context == ""), fill(P.ANSWER_FIRST, asked=asked, question=question, instruction=told)).otherwise(fill(P.ANSWER_NEXT, asked=asked, question=question, context=context, instruction=told))


def fewshot_prompt(examples: Column, question: Column) -> Column:
    """Examples are (question, answer) structs."""
    pairs = F.transform(examples, lambda e: fill(P.FEWSHOT_PAIR, question=e["question"], answer=e["answer"]))
    return F.concat(F.lit(P.FEWSHOT_HEAD), F.array_join(pairs, ""), fill(P.FEWSHOT_TAIL, question=question))


def strict_prompt(question: Column) -> Column:
    """S16."""
    return fill(P.STRICT_PROMPT, question=question)


def choice_prompt(question: Column, options: Column) -> Column:
    """Options labelled from A on."""
    labels = option_labels(options)
    rows = F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), o))
    return fill(P.CHOICE_PROMPT, question=question, options=F.array_join(rows, "\n"), labels=F.array_join(labels, ", "))


def option_labels(options: Column) -> Column:
    return F.transform(options, lambda _, i: F.char(F.lit(65) + i))


def judge_spec(spec: Column) -> Column:
    """(label, backend, model) of label:backend:model; an empty or missing model is null."""
    parts = F.split(spec, ":", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("label"), F.get(parts, F.lit(1)).alias("backend"), F.nullif(F.get(parts, F.lit(2)), F.lit("")).alias("model"))


def outcome(log: Column) -> Column:
    """Done, the first failure that matches, or "running or unknown"."""
    out = F.when(log.rlike("|".join(P.SUCCESS)), "done")
    for pattern, reason in P.FAILURES:
        out = out.when(log.rlike(f"(?m){pattern}"), reason)
    return out.otherwise("running or unknown")


def manifest_fields(line: Column) -> Column:
    """(time, fields) of "time | key=value | ..."; null if malformed."""

    def last(entries: Column) -> Column:
        # Of equal keys the last one counts.
        return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda g: g["key"] == e["key"]))

    def entry(x: Column) -> Column:
        return let(F.split(x, "=", 2), lambda kv: F.struct(strip(kv[0]).alias("key"), strip(kv[1]).alias("value")))

    def fields(parts: Column) -> Column:
        pairs = F.filter(F.slice(parts, 2, F.size(parts)), lambda x: F.contains(x, F.lit("=")))
        when = F.try_to_timestamp(F.get(parts, F.lit(0)))
        return F.when((F.size(parts) >= 3) & when.isNotNull(), F.struct(when.alias("time"), F.map_from_entries(let(F.transform(pairs, entry), last)).alias("fields")))

    return let(F.transform(F.split(strip(line), r"\|"), strip), fields)


def printable(c: Column) -> Column:
    """Without control and other characters that don't print."""
    return F.regexp_replace(c, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")


def shorten_label(c: Column, most: int) -> Column:
    """Cut to a length, with three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
