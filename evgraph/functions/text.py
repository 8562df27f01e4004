"""Scalar text functions: options, answers, verification replies, labels and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that is stripped.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_S = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def letter_code(position: Column) -> Column:
    """0, 1, ... as A, B, ..."""
    return F.char(F.lit(65) + position)


def option_letters(n: Column) -> Column:
    """A.. for at least one option, as one string."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), letter_code), "")


def format_options(options: Column) -> Column:
    """One line for each option, led by its letter unless it already is."""

    def line(option: Column, at: Column) -> Column:
        own, text = letter_code(at), strip(option)
        led = text.rlike("^[(]?[A-Z][.):]") & (F.regexp_extract(text, "^[(]?([A-Z])[.):]", 1) == own)
        return F.when(led, text).otherwise(F.concat(own, F.lit(". "), text))

    return F.array_join(F.transform(options, line), "\n")


def query_text(question: Column, options: Column) -> Column:
    return F.concat_ws("\n", question, format_options(options))


def number_of_options(options: Column) -> Column:
    """The number of options, 4 where there are none."""
    return F.when(F.size(options) > 0, F.size(options)).otherwise(4)


def extract_answer(text: Column, n_options: int | Column = 4) -> Column:
    """The option letter, of so many, that a reply states, or null. Three ways of stating it are tried in turn."""
    last = letter_code(F.greatest(n_options, F.lit(1)) - 1) if isinstance(n_options, Column) else F.lit(chr(64 + max(n_options, 1)))
    # Fixed values: "answer is X" / "option: X"; a letter at the end; a letter at the start.
    patterns = [
        (rf"(?i)(?:answer|option){_S}*(?:is|:){_S}*[(]?([A-", "])[)]?"),
        (rf"(?i)(?:^|{_S})[(]?([A-", rf"])[)]?(?:[.]|{_S})*$"),
        ("(?i)^[(]?([A-", rf"])[)]?(?:[.]|{_S})"),
    ]
    clean = strip(text)
    found = [F.call_function("regexp_extract", clean, F.concat(F.lit(a), last, F.lit(b)), F.lit(1)) for a, b in patterns]
    return F.upper(F.coalesce(*[F.nullif(x, F.lit("")) for x in found]))


def reply_lines(reply: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), strip), lambda x: x != "")


def verified(reply: Column) -> Column:
    """Whether the first line that isn't blank begins with yes."""
    return F.coalesce(F.lower(F.try_element_at(reply_lines(reply), F.lit(1))).startswith("yes"), F.lit(False))


def statement(reply: Column) -> Column:
    """The sentence of a kept relation: the second line, or else what follows yes; null for a rejected one."""
    lines = reply_lines(reply)
    rest = F.btrim(F.substring(F.try_element_at(lines, F.lit(1)), 4, 1_000_000), F.lit(" .,:-"))
    return F.when(verified(reply), F.coalesce(F.try_element_at(lines, F.lit(2)), rest))


def time_label(start: Column, end: Column) -> Column:
    """12.0s - 15.5s; for bounds of one decimal (others are rounded half up)."""
    return F.concat(F.format_string("%.1f", start), F.lit("s - "), F.format_string("%.1f", end), F.lit("s"))


def sanitized(title: Column) -> Column:
    return F.regexp_replace(title, r"[^\p{L}\p{N}]", "_")


def first_letter(answer: Column) -> Column:
    return F.substring(F.upper(strip(answer)), 1, 1)


def base_name(path: Column) -> Column:
    """The file's name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def final_response(answer: Column) -> Column:
    return F.when(answer.isNotNull() & (answer != ""), F.concat(F.lit("The answer is "), answer, F.lit("."))).otherwise(F.lit(""))


# Prompts. A model gets what a step needs: what to look at, the question, the form of the reply.


GROUNDING = ("These pictures show one stretch of a film, ", ". Write down, in short, what can be seen there that bears on the question. Don't answer it.\n")
VERIFICATION = ("First stretch (", "): ", "\nSecond stretch (", "): ", "\nFor the question below, is the second tied to the first? Begin with Yes or No; after Yes, name the tie in one sentence on a new line.\n")
SYNTHESIS = ("Evidence in order of time:\n", "\nAnswer by the evidence. End with: The answer is <letter>.\n")


def _filled(parts: tuple[str, ...], *values: Column) -> Column:
    """The parts, each with a value after it."""
    return F.concat(*[x for part, value in zip(parts, values) for x in (F.lit(part), value)])


def grounding_prompt(label: Column, query: Column) -> Column:
    return _filled(GROUNDING, label, query)


def verification_prompt(label_a: Column, a: Column, label_b: Column, b: Column, query: Column) -> Column:
    return _filled(VERIFICATION, label_a, a, label_b, b, query)


def synthesis_prompt(context: Column, query: Column) -> Column:
    return _filled(SYNTHESIS, context, query)


def timeline_prompt(timeline: Column, query: Column) -> Column:
    return F.concat(F.lit("The pictures belong to these stretches of a film:\n"), timeline, F.lit("\nReason step by step, then end with: The answer is <letter>.\n"), query)


DIRECT = "Look at the pictures and pick an option. End with: The answer is <letter>.\n"


def direct_prompt(query: Column) -> Column:
    return F.concat(F.lit(DIRECT), query)
